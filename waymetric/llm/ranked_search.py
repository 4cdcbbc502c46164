"""Operator 11: ranked lexical search over a length-stratified index.

Documents of equal length normaliser m are a stratum.  A scanning task indexes its
documents block by block: postings lie by term, stratum and falling term frequency, and
the impact of a frequency is computed once per stratum.  The largest impact of each
term in a stratum bounds what any of its documents can score, so that an item visits
strata in falling order of that bound and stops where it is below the item's tenth
score so far.  Tasks send their best ten of each item; the best of these are the result.

Documents are read twice, for the statistics and for the search.  Items go to the tasks
in blocks of bounded size, so that a large set of items takes more passes, not more
memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, discard, materialise, text_slices

K1_MILLI, B_PERCENT = 1000, 75
TOP = 10
#: Bytes of text of a block, at least one document; bytes of a long text that are taken apart at once.
BLOCK_BYTES, PIECE_BYTES = 24 << 20, 1 << 20
#: Terms of items, with repeats counted once per item, that go to the tasks at once.
ITEM_TERMS = 1 << 20
#: Letters and digits stay, A-Z in lower case, all other ASCII ends a term.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
NO_ID = np.iinfo(np.int64).min


def pieces(text: bytes, most: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece; a piece ends where a term does."""
    text = text.translate(TERM_BYTES)
    at = 0
    while at < len(text):
        end = at + most
        if end < len(text):
            space = text.find(b" ", end)
            end = len(text) if space < 0 else space
        yield text[at:end].split()
        at = end


def counted(texts: list[bytes], index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, frequency) of the indexed terms of the texts, by document and term, and every text's number of terms."""
    from itertools import repeat

    size, keys, times, held, n_held = np.zeros(len(texts), np.int64), [], [], [], 0
    width = max(1, len(index))

    def settle() -> None:
        nonlocal n_held
        if held:
            k, n = np.unique(np.concatenate(held), return_counts=True)
            keys.append(k)
            times.append(n)
            held.clear()
            n_held = 0

    for d, text in enumerate(texts):
        for words in pieces(text):
            size[d] += len(words)
            t = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
            held.append(t[t >= 0] + d * width)
            n_held += len(words)
            if n_held > 1 << 20:
                settle()
    settle()
    if not keys:
        return *(np.zeros(0, np.int64),) * 3, size
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros(len(k), np.int64)
    np.add.at(n, at, np.concatenate(times))
    return k // width, k % width, n, size


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (K1_MILLI * tf + 8 * m)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges (start, count), one range after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Block:
    """The stratified index of some documents: doc, term, tf of the postings; n and ids by document."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray, ids: np.ndarray, n_terms: int, n_docs_all: int, n_terms_all: int):
        m = 100 - B_PERCENT + (B_PERCENT * n * n_docs_all) // n_terms_all
        strata, stratum = np.unique(m, return_inverse=True)
        order = np.lexsort((-tf, stratum[doc], term))
        self.doc, term, tf, self.ids = doc[order], term[order], tf[order], ids
        of = stratum[self.doc]
        # each frequency of a stratum once
        pair, place = np.unique(of * (int(tf.max(initial=0)) + 1) + tf, return_inverse=True)
        top = int(tf.max(initial=0)) + 1
        self.impact = impact(pair % top, strata[pair // top])[place]
        head = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (of[1:] != of[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.start, self.count = head, np.diff(np.append(head, len(term)))
        self.stratum, self.most = of[head], self.impact[head]  # the largest frequency is in front
        self.of_term = np.searchsorted(term[head], np.arange(n_terms + 1))
        self.n_strata, self.score = len(strata), np.zeros(len(ids), np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the best `top` documents of this block and of `best`, highest first, equal scores by id."""
        runs = self.of_term[terms + 1] - self.of_term[terms]
        r, w = spread(self.of_term[terms], runs), np.repeat(weights, runs)
        bound = np.zeros(self.n_strata, np.int64)
        np.add.at(bound, self.stratum[r], w * self.most[r])
        visit = np.argsort(-bound, kind="stable")
        at, step = 0, 8
        while at < len(visit):
            least = max(1, int(best[0][top - 1])) if len(best[0]) >= top else 1
            now = visit[at : at + step]
            now = now[bound[now] >= least]
            if not len(now):
                break
            chosen = np.zeros(self.n_strata, bool)
            chosen[now] = True
            own = chosen[self.stratum[r]]
            p = spread(self.start[r[own]], self.count[r[own]])
            docs = self.doc[p]
            np.add.at(self.score, docs, np.repeat(w[own], self.count[r[own]]) * self.impact[p])
            docs = np.unique(docs)
            s = self.score[docs]
            self.score[docs] = 0
            if len(s) > top:
                least = max(least, int(np.partition(s, len(s) - top)[len(s) - top]))
            good = s >= least
            scores, ids = np.concatenate([best[0], s[good]]), np.concatenate([best[1], self.ids[docs[good]]])
            order = np.lexsort((ids, -scores))[:top]
            best = scores[order], ids[order]
            at, step = at + step, step * 4
        return best


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, id, term, q) of the distinct terms of each row of items, with their repeats."""

    def split(batches):
        import pyarrow as pa
        from collections import Counter

        for batch in batches:
            for lo, hi, texts in text_slices(batch.column("text")):
                for i, text in enumerate(texts):
                    terms: Counter = Counter()
                    for words in pieces(text):
                        terms.update(words)
                    n, at = len(terms), pa.array([lo + i] * len(terms), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row").take(at), batch.column("id").take(at), pa.array(list(terms), pa.binary()), pa.array(list(terms.values()), pa.int64())] if n
                        else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64())], names=["item", "id", "term", "q"],
                    )

    rows = Rows.of(items).select(id=F.col(id_col).cast("long"), text=F.col(text_col))
    return rows.mapInArrow(split, "item long, id long, term binary, q long")


def _statistics(index: dict[bytes, int]):
    """Task code: (term, n): documents with each term; at -1 documents with terms, at -2 their terms."""

    def run(batches):
        import pyarrow as pa

        df, docs, terms = np.zeros(len(index), np.int64), 0, 0
        for batch in batches:
            for _, _, texts in text_slices(batch.column("text")):
                _, term, _, size = counted(texts, index)
                df += np.bincount(term, minlength=len(index))
                docs, terms = docs + int((size > 0).sum()), terms + int(size.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int32()), pa.array([docs, terms, *df[some].tolist()], pa.int64())], names=["term", "n"])

    return run


def _search(index: dict[bytes, int], queries: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, top: int, block_bytes: int):
    """Task code: the best of this task's documents for each query (item, terms, weights)."""

    def run(batches):
        import pyarrow as pa

        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        held: list[tuple] = []
        n_bytes = 0

        def settle() -> None:
            nonlocal n_bytes
            if held:
                first = np.cumsum([0, *(len(x[3]) for x in held)])
                doc = np.concatenate([x[0] + f for x, f in zip(held, first, strict=False)])
                block = Block(doc, *(np.concatenate([x[j] for x in held]) for j in (1, 2, 3, 4)), len(index), n_docs, max(1, n_terms))
                for i, (_, terms, weights) in enumerate(queries):
                    best[i] = block.search(terms, weights, best[i], top)
                held.clear()
                n_bytes = 0

        for batch in batches:
            ids = batch.column("id")
            for lo, hi, texts in text_slices(batch.column("text")):
                held.append((*counted(texts, index), ids.slice(lo, hi - lo).fill_null(NO_ID).to_numpy(zero_copy_only=False)))
                n_bytes += sum(map(len, texts))
                if n_bytes > block_bytes:
                    settle()
        settle()
        n = [len(s) for s, _ in best]
        found = np.concatenate([np.zeros(0, np.int64), *(i for _, i in best)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([q[0] for q in queries], np.int64), n)), pa.array(found, mask=found == NO_ID),
                pa.array(np.concatenate([np.zeros(0, np.int64), *(s for s, _ in best)])),
            ],
            names=["item", "doc", "score"],
        )

    return run


def ranked_search(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP,
    item_terms_at_once: int = ITEM_TERMS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row of items its `top` highest-scoring documents with a score above 0: item_col, rank (from 1), id_col, score.

    Terms are maximal runs of characters other than ASCII that is no letter or digit, in
    the whole text, A-Z lower-cased; null texts have none.  With N documents that have a
    term, L terms in all, df documents with a term and n terms of a document: weight
    floor(1000 ln((2N+2)/(2df+1))), m = 25 + (75 n N) div L, and the score sums weight *
    (10^9 tf div (1000 tf + 8 m)) over the item's terms, repeats included, in 64-bit
    integers.  Equal scores go by ascending id, a null id first.  Repeated rows are
    documents, and items, of their own.  Items without a term or a match have no rows;
    empty tables give none.  Extra columns are ignored.  A long text is taken apart in
    pieces of 1 MB; a document's postings and an item's terms fit a task.
    """
    asked = materialise(item_terms(items, item_col, item_text_col), "search-items")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = max(1, -(-asked.count() // item_terms_at_once))
    found = []
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).select("item", "term", "q").collect()  # item_terms_at_once, about
        if not own:
            continue
        index = {t: i for i, t in enumerate(sorted({bytes(x["term"]) for x in own}))}
        sums = texts.select("text").mapInArrow(_statistics(index), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each of these terms
        n = {x["term"]: x["n"] for x in sums}
        n_docs, n_terms = n.get(-1, 0), n.get(-2, 0)
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in n.items() if t >= 0}
        by_item: dict[int, list[tuple[int, int]]] = {}
        for x in own:
            t = index[bytes(x["term"])]
            if t in weight:
                by_item.setdefault(x["item"], []).append((t, x["q"] * weight[t]))
        queries = [(i, *(np.array(sorted(ts), np.int64).T)) for i, ts in sorted(by_item.items())]
        if queries:
            task = _search(index, queries, n_docs, n_terms, top, block_bytes)
            found.append(materialise(texts.mapInArrow(task, "item long, doc long, score long"), "search-found"))
    if not found:
        return asked.where("false").select(F.col("id").alias(item_col), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.col("q").alias("score"))
    best = found[0]
    for x in found[1:]:
        best = best.union(x)
    first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc"))
    ranked = best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    ids = asked.groupBy("item").agg(F.any_value("id").alias("id"))
    out = materialise(ranked.join(ids, "item").select(F.col("id").alias(item_col), "rank", F.col("doc").alias(id_col), "score"), "search-ranked")
    discard(asked, *found)
    return out
