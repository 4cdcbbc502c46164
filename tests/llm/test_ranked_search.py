"""Ranked search against a brute-force score of every item and document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from waymetric.llm import ranked_search as S
from waymetric.llm.ranked_search import counted, pieces, ranked_search

DOCS = "doc_id long, text string, item_id long, score long, term string, rank int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    docs = [(i, terms(t)) for i, t in docs]
    n_all, l_all = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = Counter(x for _, t in docs for x in set(t))
    out = Counter()
    for item, text in items:
        found = []
        asked = Counter(terms(text))
        for d, t in docs:
            tf, m = Counter(t), 25 + (75 * len(t) * n_all) // max(1, l_all)
            s = sum(q * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m)) for x, q in asked.items() if tf[x])
            if s > 0:
                found.append((-s, d is not None, d or 0, d))
        for k, (s, _, _, d) in enumerate(sorted(found)[:top], 1):
            out[item, k, d, -s] += 1
    return out


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [w for w in ("".join(r.choice("abcDé9") for _ in range(r.randint(1, 3))) for _ in range(60))]
    text = lambda k: r.choice([" ", ", ", "\n", "-", "  "]).join(r.choice(vocab[: r.choice([5, 60])]) for _ in range(k))
    docs = [(i, text(r.randint(1, 30))) for i in range(n)]
    docs += [(n + i, docs[i][1]) for i in range(n // 4)] + [(None, docs[0][1]), (3, docs[3][1]), (3, docs[3][1]), (n * 2, None), (n * 2 + 1, ""), (n * 2 + 2, "., !"), (n * 2 + 3, "aA " * 9000)]
    return docs, [(i, text(r.randint(1, 12))) for i in range(25)] + [(7, docs[1][1]), (7, docs[1][1]), (None, docs[2][1]), (40, None), (41, ""), (42, "zzzzunknown")]


def got(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in docs], DOCS).repartition(3)
    return Counter(map(tuple, ranked_search(d, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string"), **how).collect()))


@pytest.mark.parametrize("how", [{}, {"item_terms_at_once": 20, "block_bytes": 300}])
def test_against_brute_force(spark, how):
    docs, items = corpus(1, 120)
    assert got(spark, docs, items, **how) == brute(docs, items)


def test_strata_that_cannot_reach_the_best_are_not_visited():
    r = np.random.default_rng(3)
    texts = [b" ".join(b"w%d" % x for x in r.zipf(1.3, r.integers(1, 200)) % 50) for _ in range(2000)]
    index = {b"w%d" % i: i for i in range(50)}
    doc, term, tf, n = counted(texts, index)
    block = S.Block(doc, term, tf, n, np.arange(2000), 50, 2000, int(n.sum()))
    seen = []
    real = S.spread
    try:
        S.spread = lambda a, b: seen.append(int(b.sum())) or real(a, b)
        scores, ids = block.search(np.array([3, 17, 30]), np.array([5, 900, 2000]), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    finally:
        S.spread = real
    assert len(ids) == 10 and (np.diff(scores) <= 0).all()
    assert sum(seen[1:]) < 0.5 * sum(block.count[real(block.of_term[[3, 17, 30]], np.diff(block.of_term)[[3, 17, 30]])])  # postings that were added up


def test_long_texts_go_by_pieces():
    text = b"Ab-cd " * 1000 + b"x" * 5000 + b" end"
    assert [w for p in pieces(text, 64) for w in p] == text.lower().replace(b"-", b" ").split()


def test_empty_tables(spark):
    docs, items = corpus(2, 5)
    assert got(spark, [], items) == Counter() and got(spark, docs, []) == Counter() and got(spark, docs, [(1, None)]) == Counter()
