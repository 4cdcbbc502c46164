"""The prefix trie against a brute-force one."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from waymetric.llm import prefix_trie as T
from waymetric.llm.prefix_trie import Forest, merged, prefix_trie, shared_units

TURNS = "conv_id long, turn long, role string, text string, key string, depth long, n long, part long"


def brute(rows):
    """Rows of the trie of (conv_id, turn, role, text), from all prefixes of all conversations."""
    def unit(r, t):
        r, t = (r or "").encode(), (t or "").encode()
        return hashlib.sha256(str(len(r)).encode() + b":" + r + t).digest()

    own = defaultdict(list)
    for c, k, r, t in rows:
        if c is not None:
            own[c].append(((k is not None, k or 0), unit(r, t), len((t or "").encode())))
    for c in own:
        own[c] = [x[1:] for x in sorted(own[c], key=lambda x: (x[0], x[1][:16].hex(), x[2]))]
    members, last = defaultdict(list), {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(c / 5) * 0 - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = own.get(base, [])[:h] + own[c][h:]
        last[c] = tuple(path)
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * p[-1][1] if p else 0
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if last[c] == p))).encode()).hexdigest())
        for p, m in members.items()
    )


def rows_of(seed, n=120, deep=14):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        k = 0 if r.random() < 0.05 else r.randint(1, deep)
        rows += [(c, t if r.random() > 0.1 else None, r.choice(["user", "assistant", None, ""]), r.choice(["a", "b", "é" * 5, None, ""]) if t > 2 else "start") for t in range(k)]
    return rows


def got(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], TURNS).repartition(parts)
    return Counter(map(tuple, prefix_trie(df).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    rows = rows_of(seed)
    monkeypatch.setattr(T, "MERGED", 2)  # so that boundaries are merged on several levels
    monkeypatch.setattr(T, "TASK_TURNS", 40)
    monkeypatch.setattr(T, "LISTED", 7)
    assert got(spark, rows) == brute(rows)


def test_copies_nulls_ties_and_long_conversations(spark):
    rows = [(c, k, "user", f"turn {k}") for c in range(0, 100) for k in range(3)]  # copies but for the rebuilding
    rows += [(None, 0, "user", "nobody's"), (-7, None, None, None), (-7, None, None, None), (-5, 0, "a", "x"), (-5, 0, "a", "y"), (1000, 1, "u", "long " * 300_000)]
    rows += [(2005, k, "u", str(k)) for k in range(150)] + [(2006, k, "u", str(k)) for k in range(140)]
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_single_turn(spark):
    df = spark.createDataFrame([], TURNS)
    assert prefix_trie(df).count() == 0
    assert got(spark, [(3, 0, "user", "hi")]) == brute([(3, 0, "user", "hi")])


def test_forests_cut_anywhere_give_the_same_trie():
    """Contracted forests of any cut into tasks merge into the nodes of the whole."""
    import pyarrow as pa

    r = random.Random(5)
    unit = lambda x: hashlib.sha256(x).digest()[:16] + len(x).to_bytes(8, "big")
    keys = sorted({b"".join(unit(bytes([r.randrange(3)])) for _ in range(r.randrange(9))) for _ in range(150)})
    items = [(i, len(k) // T.UNIT, r.randint(1, 4), r.randint(0, 999), 0, 0, 0, hashlib.sha256(k).hexdigest()) for i, k in enumerate(keys)]
    lcp = [shared_units(a, b) for a, b in zip(keys, keys[1:], strict=False)]

    def nodes(batches, kind=(0, 1)):
        return [x for x in pa.Table.from_batches(list(batches)).to_pylist() if x["kind"] in kind]

    seen = lambda x: (x["conv_id"], x["depth"], x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"], x["ends_sha256"])
    whole = Counter(map(seen, nodes(Forest(keys, lcp, items).rows(0, last=True))))
    for cuts in ([40], [1, 2, 3], [20, 21, 90, 120], range(1, len(keys))):
        edges = [0, *(c for c in cuts if c < len(keys)), len(keys)]
        found, blobs = [], []
        for a, b in zip(edges, edges[1:], strict=False):
            part = list(Forest(keys[a:b], lcp[a : b - 1], [(i - a, *x) for i, *x in items[a:b]]).rows(a, last=False))
            found += nodes(part)
            blobs += [x["paths"] for x in nodes(part, (2,))]
        half = len(blobs) // 2
        second = []
        for group in (blobs[:half], blobs[half:]):
            if group:
                part = list(merged(group).rows(0, last=False))
                found += nodes(part)
                second += [x["paths"] for x in nodes(part, (2,))]
        found += nodes(merged(second).rows(0, last=True))
        assert Counter(map(seen, found)) == whole
