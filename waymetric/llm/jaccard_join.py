"""Operator 6: n-gram Jaccard join by prefix trees.

Shingles are ordered by how many documents have them, rarest first.  Two sets as
similar as the threshold share a shingle among their first few, so documents that
share none are never compared, and a document whose shared shingles are too few
leaves at once.  What is left falls into candidate groups by rounds of joins, and
each group is joined by a trie of its ordered sets: a query descends the trie with
the overlap of the path so far, which all sets below share, and leaves a subtree
when the remaining lengths cannot reach the threshold.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, Rows, discard, materialise, mix, text_bytes
from .components import connected_components
from .shared_tokens import IDX, documents, shared_tokens

#: Least similarity, in percent, and words of a shingle.
PERCENT = 80
WORDS = 5
#: Sets joined in one trie at most; larger groups are split into pairs of blocks.
BLOCK_SETS = 256
#: Bytes of text whose words are hashed at once, whatever the length of a text.
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SETS = "row long, id long, n long, sig_a long, sig_b long, tokens binary, spread double"
_B = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    up = np.cumprod(np.concatenate([one, np.full(n, _B, np.uint64)]))
    down = np.cumprod(np.concatenate([one, np.full(n, pow(_B, -1, 1 << 64), np.uint64)]))
    return up, down


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def word_hashes(texts: list[bytes], piece: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and each word's document.  Texts go piece by piece, cut at white space."""
    data = b"\n".join(texts).translate(FOLD)
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        space = _SPACE.search(data, at + piece)
        end = space.start() if space else len(data)
        h, start = _hash_words(data[at:end])
        hashes.append(h)
        starts.append(start + at)
        at = end
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return np.concatenate(hashes), np.searchsorted(begins, np.concatenate(starts), side="right") - 1


def shingle_tokens(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, dict]:
    """Packed tokens (48 bits of hash, 16 of document) of the sets, and their sizes and signatures."""
    h, doc = word_hashes(texts)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    start = np.flatnonzero(doc[words - 1 :] == doc[: len(doc) - words + 1]) if len(doc) >= words else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        s = np.zeros(len(start), np.uint64)
        for j in range(words):
            s = mix(s * np.uint64(31) + h[start + j] + np.uint64(j + 1))
        own = doc[start]
        short = np.flatnonzero((count > 0) & (count < words))
        t = np.zeros(len(short), np.uint64)
        for j in range(words - 1):
            has = count[short] > j
            t[has] = mix(t[has] * np.uint64(31) + h[first[short][has] + j] + np.uint64(97))
        t = mix(t + count[short].astype(np.uint64))
    tokens = np.unique((np.concatenate([s, t]) & ~IDX) | np.concatenate([own, short]).astype(np.uint64))
    idx = (tokens & IDX).astype(np.uint16)
    order = np.argsort(idx, kind="stable")
    sizes = np.bincount(idx, minlength=len(texts))
    full = np.flatnonzero(sizes)
    heads = (np.cumsum(sizes) - sizes)[full]
    a, b = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    if len(full):
        value = mix(tokens[order] >> np.uint64(16))
        a[full] = np.add.reduceat(value, heads)
        b[full] = np.bitwise_xor.reduceat(mix(value + np.uint64(_B)), heads)
    return tokens, {"n": sizes.tolist(), "a": a.astype(np.int64).tolist(), "b": b.astype(np.int64).tolist()}


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """Least overlap that a set of n can have with a similar one."""
    return -(-percent * n // 100)


def _finish(percent: int):
    def run(meta, values, counts, edges):
        import pyarrow as pa

        n = np.array(meta["n"], np.int64)
        shared = np.diff(edges)
        live = (n > 0) & (shared >= needed(n, percent))
        # a token's number starts with its count, so that numbers are in the global order, rarest first
        values = values | (counts.astype(np.uint64) << np.uint64(48))
        blobs = [values[edges[i] : edges[i + 1]].tobytes() if live[i] else None for i in range(len(n))]
        total = np.concatenate([[0], np.cumsum(counts.astype(np.float64))])
        return pa.table(
            {
                "row": pa.array(meta["row"], pa.int64()), "id": pa.array(meta["id"], pa.int64()), "n": pa.array(n), "sig_a": pa.array(meta["a"], pa.int64()), "sig_b": pa.array(meta["b"], pa.int64()),
                "tokens": pa.array(blobs, pa.binary()), "spread": pa.array((total[edges[1:]] - total[edges[:-1]]) / np.maximum(n, 1)),
            }
        )

    return run


def _prefix_postings(percent: int):
    """(token, row): the shared tokens among the first n - needed + 1 of each set; tokens of one document come before all."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            tokens, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for row, n, blob in zip(*(batch.column(c).to_pylist() for c in ("row", "n", "tokens")), strict=True):
                have = np.frombuffer(blob, np.uint64)
                own = have[: max(0, len(have) - needed(n, percent) + 1)]
                tokens.append(own)
                rows.append(np.full(len(own), row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(np.concatenate(rows).astype(np.int64))], names=["token", "row"])

    return run


class Trie:
    """Sets in the order of their tokens' codes, most frequent in the whole corpus first, with shared beginnings stored once."""

    def __init__(self, sets: list[np.ndarray], n: np.ndarray):
        """sets: each set's codes, ascending; n: whole sizes, which count tokens of no other document too."""
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.n = n
        parent, begin, end, depth, last, lo, hi, most, leaf = ([] for _ in range(9))
        pool: list[np.ndarray] = []
        used = 0

        def node(up: int, part: np.ndarray, at: int) -> int:
            nonlocal used
            pool.append(part)
            parent.append(up)
            begin.append(used)
            used += len(part)
            end.append(used)
            depth.append(at + len(part))
            last.append(int(part[-1]) if len(part) else (last[up] if up >= 0 else -1))
            for bound, start in ((lo, 1 << 60), (hi, 0), (most, 0)):
                bound.append(start)
            leaf.append([])
            return len(parent) - 1

        root = node(-1, np.zeros(0, np.int64), 0)
        path, before = [root], np.zeros(0, np.int64)
        for i in order:
            s = sets[i]
            m = min(len(s), len(before))
            differ = np.flatnonzero(s[:m] != before[:m])
            common = int(differ[0]) if len(differ) else m
            while depth[path[-1]] > common and depth[parent[path[-1]]] >= common:
                path.pop()
            top = path[-1]
            if depth[top] > common:  # split the edge above top: its end becomes a node of its own
                keep = begin[top] + common - depth[parent[top]]
                low = len(parent)
                parent.append(top)
                begin.append(keep)
                end.append(end[top])
                depth.append(depth[top])
                last.append(last[top])
                lo.append(lo[top])
                hi.append(hi[top])
                most.append(most[top])
                leaf.append(leaf[top])
                for k in range(low):
                    if parent[k] == top and k != low:
                        parent[k] = low
                end[top], depth[top], leaf[top] = keep, common, []
                last[top] = int(before[common - 1])
            if len(s) > common:
                path.append(node(path[-1], s[common:], common))
            leaf[path[-1]].append(i)
            for k in path:
                lo[k], hi[k], most[k] = min(lo[k], int(n[i])), max(hi[k], int(n[i])), max(most[k], len(s))
            before = s
        self.pool = np.concatenate(pool)
        self.begin, self.end, self.depth, self.last, self.lo, self.hi, self.most = (np.array(x, np.int64) for x in (begin, end, depth, last, lo, hi, most))
        parent = np.array(parent, np.int64)
        self.child = np.argsort(parent, kind="stable")[1:]  # the root comes first
        self.first = np.searchsorted(parent[self.child], np.arange(len(parent) + 1))
        self.leaf = leaf

    def similar(self, codes: np.ndarray, n: int, n_codes: int, percent: int) -> list[int]:
        """Sets whose similarity to the query set is percent or more."""
        member = np.zeros(n_codes, np.int64)
        member[codes] = 1
        upto = np.cumsum(member)
        nodes, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(nodes):
            for k, o in zip(nodes.tolist(), overlap.tolist(), strict=True):
                for i in self.leaf[k]:
                    if 100 * o >= percent * (n + self.n[i] - o):
                        found.append(i)
            count = self.first[nodes + 1] - self.first[nodes]
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - self.first[nodes], count)
            nodes, above = self.child[at], np.repeat(overlap, count)
            fits = (100 * self.hi[nodes] >= percent * n) & (percent * self.lo[nodes] <= 100 * n)
            nodes, above = nodes[fits], above[fits]
            if not len(nodes):
                break
            size = self.end[nodes] - self.begin[nodes]
            places = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - self.begin[nodes], size)
            overlap = above + np.add.reduceat(member[self.pool[places]], np.cumsum(size) - size)
            rest = np.minimum(self.most[nodes] - self.depth[nodes], len(codes) - upto[self.last[nodes]])
            able = (100 + percent) * (overlap + rest) >= percent * (n + self.lo[nodes])
            nodes, overlap = nodes[able], overlap[able]
        return found


def trie_links(tokens: list[np.ndarray], n: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that connect all sets which similar pairs connect, as stars.

    side: 0 and 1 for the blocks of a pair, which are compared across only; 2: compared with all.
    """
    distinct, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
    # codes in the global order from its frequent end, where sets have most in common
    code = len(distinct) - 1 - inverse.ravel()
    sets = [np.sort(s) for s in np.split(code, np.cumsum([len(t) for t in tokens])[:-1])]
    held = np.flatnonzero(side != 0)
    trie = Trie([sets[i] for i in held], n[held])
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for q in np.flatnonzero(side != 1):
        for k in trie.similar(sets[q], int(n[q]), len(distinct), percent):
            a, b = find(int(q)), find(int(held[k]))
            root[max(a, b)] = min(a, b)
    return [(i, find(i)) for i in range(len(sets)) if find(i) != i]


def _join_groups(percent: int):
    def run(key, table):
        import pyarrow as pa

        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        group = table.column("component").to_numpy()
        order = np.argsort(group, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            part = table.take(pa.array(own))
            rows, n, side = (part.column(c).to_numpy() for c in ("row", "n", "side"))
            links = trie_links([np.frombuffer(b, np.uint64) for b in part.column("tokens").to_pylist()], n, side, percent)
            if links:
                a, b = np.array(links).T
                out_a.append(rows[a])
                out_b.append(rows[b])
        return pa.table({"a": pa.array(np.concatenate(out_a), pa.int64()), "b": pa.array(np.concatenate(out_b), pa.int64())})

    return run


def _near_pivot(percent: int):
    """Adds near: whether a set is similar to its group's pivot."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            near = []
            for n, blob, pn, pblob in zip(*(batch.column(c).to_pylist() for c in ("n", "tokens", "p_n", "p_tokens")), strict=True):
                o = len(np.intersect1d(np.frombuffer(blob, np.uint64), np.frombuffer(pblob, np.uint64), assume_unique=True))
                near.append(100 * o >= percent * (n + pn - o))
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("row"), batch.column("p_row"), pa.array(near)], names=["component", "row", "p_row", "near"])

    return run


def similar_links(live: DataFrame, reps: DataFrame, percent: int, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(a, b): links that connect what similar pairs of the sets (row, n, tokens, spread) connect.

    live: the sets; reps: the rows of the different ones.

    Candidate groups of up to block_sets sets are joined by one trie.  In a larger
    one all sets meet a pivot, the set whose shingles are the most common; those
    similar to it are connected already and never meet each other.  The rest meets
    itself and them, block by block, so that a group of near copies takes work in
    proportion to its size and every pair that could still connect is compared.
    """
    postings = materialise(live.select("row", "n", "tokens").mapInArrow(_prefix_postings(percent), "token long, row long").join(reps, "row", "left_semi"), "jaccard-postings")
    leads = postings.groupBy("token").agg(F.min("row").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("token", "lead")
    groups = materialise(connected_components(postings.join(leads, "token").select("row", "lead").where("row <> lead"), "row", "lead"), "jaccard-groups")
    discard(postings)
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sets = materialise(live.select("row", "n", "tokens", "spread").join(groups.join(sizes, "component").withColumnRenamed("node", "row"), "row"), "jaccard-sets")
    buckets = max(1, sets.count() // block_sets)
    small = sets.where(F.col("size") <= block_sets).select(
        F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("work"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "component", "row", "n", "tokens", F.lit(2).alias("side")
    )
    large = sets.where(F.col("size") > block_sets)
    top = large.groupBy("component").agg(F.max(F.struct("spread", "row")).alias("p"))
    pivots = materialise(large.select("row", F.col("n").alias("p_n"), F.col("tokens").alias("p_tokens")).join(top.select("component", F.col("p.row").alias("row")), "row").withColumnRenamed("row", "p_row"), "jaccard-pivots")
    near = materialise(large.select("component", "row", "n", "tokens").join(pivots, "component").mapInArrow(_near_pivot(percent), "component long, row long, p_row long, near boolean"), "jaccard-near")
    blocks = near.groupBy("component").agg(
        F.ceil(F.count_if("near") / block_sets).cast("int").alias("n_near"), F.ceil(F.count_if(~F.col("near")) / block_sets).cast("int").alias("n_far")
    )
    # blocks 0 .. n_near - 1 hold what the pivot connects, the others the rest
    own = F.when(F.col("near"), F.pmod(F.xxhash64("row"), F.col("n_near"))).otherwise(F.col("n_near") + F.pmod(F.xxhash64("row"), F.col("n_far")))
    first = F.when(F.col("near"), F.col("n_near")).otherwise(F.lit(0))
    upto = F.col("n_near") + F.col("n_far") - 1
    partners = F.when(first <= upto, F.sequence(first.cast("int"), upto.cast("int"))).otherwise(F.array().cast("array<int>"))
    paired = (
        large.select("component", "row", "n", "tokens")
        .join(near.join(blocks, "component").select("row", own.cast("int").alias("own"), partners.alias("partners")), "row")
        .select("component", "row", "n", "tokens", "own", F.explode("partners").alias("other"))
        .select(
            F.col("component").alias("work"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "component", "row", "n", "tokens",
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        )
    )
    links = small.union(paired).groupBy("work", "i", "j").applyInArrow(_join_groups(percent), "a long, b long")
    links = materialise(links.union(near.where("near and row <> p_row").select("row", "p_row")), "jaccard-links")
    discard(sets, groups, pivots, near)
    return links


def jaccard_components(
    df: DataFrame | Rows, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS, block_sets: int = BLOCK_SETS, with_row: bool = False
) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a set has the distinct
    `words`-word shingles, or the whole sequence as one if there are fewer words.
    Null and empty texts have no set and link with nothing.  Documents link when
    100 * intersection >= percent * union; component_id is the least id that links
    reach, itself included.  Identical sets are one set in the join.  Repeated rows
    are documents of their own; a component of null ids only has a null id.  Extra
    columns are ignored.  Shingles are compared by 48 bits of hash.  with_row adds
    row, the number that Rows gives, and keep_row, the row of the
    least (id, row) of its component.
    """
    docs = documents(df, id_col, text_col)
    emit = lambda texts: shingle_tokens(texts, words)
    sets = materialise(shared_tokens(docs, emit, _finish(percent), _SETS, text_bytes(docs, "text")), "jaccard-documents")
    live = sets.where("tokens is not null")
    # a table of its own, so that Spark can split the join where one set has very many copies
    classes = materialise(live.groupBy("sig_a", "sig_b", "n").agg(F.min("row").alias("rep")), "jaccard-sets")
    member = materialise(live.select("row", "id", "sig_a", "sig_b", "n").join(classes, ["sig_a", "sig_b", "n"]).select("row", "id", "rep"), "jaccard-classes")
    linked = connected_components(similar_links(live, member.where("row = rep").select("row"), percent, block_sets)).withColumnRenamed("node", "rep")
    placed = materialise(member.join(linked, "rep", "left").select("row", "id", F.coalesce("component", "rep").alias("component")), "jaccard-components")
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"), F.min(F.struct("id", "row")).alias("keep"))
    found = placed.join(least, "component").select("row", "component_id", F.col("keep.row").alias("keep_row"))
    return sets.select("row", "id", "n").join(found, "row", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
        *(["row", F.coalesce("keep_row", "row").alias("keep_row")] if with_row else []),
    )
