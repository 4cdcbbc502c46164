"""Operator 2: packing by column generation for the cutting-stock problem.

Documents are tokenised and cut at multiples of the sequence length.  The
histogram of the pieces' lengths, in at most `capacity / unit` classes, is all
that the driver sees.  A linear program over packing patterns is solved there by
column generation: a knapsack dynamic program prices the next pattern.  Rounded
patterns give slots, and the ranked pieces of each class take them by joins.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLD, SLICE_BYTES, materialise, mix, slices, texts_as_bytes, worker_state

#: Tokens of a length class.
UNIT = 16
#: Pieces of at most so many tokens are planned in bundles of one exact length, which have about so many tokens.
SHORT, BUNDLE = 64, 512
#: Distinct words whose ids a task remembers.
MEMO_WORDS = 400_000
#: Pieces that are ranked together in one task at most, about.
RANK_ROWS = 1 << 17
#: Words of more bytes are encoded each time they occur.
LONG_WORD = 256
#: What a tokenizer must do to a text for its ids to be those of the words in a row; fixed values of the public file.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ALNUM = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))


def word_spans(data: bytes, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word.  Commas and full stops at the end of a word in ASCII are a word of their own, where plain says so.

    The tokenizer drops white space, and letters and stops are never in one token, so
    that this leaves fewer distinct words with the same ids.
    """
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    stop = (raw == 0x2E) | (raw == 0x2C)
    last = np.maximum.accumulate(np.where(stop, -1, np.arange(len(raw))))[end - 1] if len(raw) else end  # the last byte that is no stop
    cut = np.flatnonzero((last >= start) & (last < end - 1))
    cut = cut[_ALNUM[raw[last[cut]]] & plain[start[cut]]]
    return np.insert(start, cut + 1, last[cut] + 1), np.insert(end, cut, last[cut] + 1)


class _Hash:
    """64-bit hashes of spans, from running sums of a polynomial."""

    def __init__(self, raw: np.ndarray, base: int):
        one = np.ones(1, np.uint64)
        up = np.cumprod(np.concatenate([one, np.full(len(raw), base, np.uint64)]))
        self.down = np.cumprod(np.concatenate([one, np.full(len(raw), pow(base, -1, 1 << 64), np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class WordIds:
    """Ids of texts, from the ids of their distinct words.

    The tokenizer's pieces never span white space, and its normaliser works within
    words, so that a text's ids are those of its words in a row.  A tokenizer of
    another kind encodes whole texts.  A word is known by two hashes of 64 bits; where
    only one agrees, the lot of texts is encoded whole as well.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plan = json.loads(self.tokenizer.to_str())
        steps = [*((plan["normalizer"] or {}).get("normalizers") or []), *((plan["pre_tokenizer"] or {}).get("pretokenizers") or [])]
        split = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
        self.by_word = (
            tuple(x["type"] for x in steps) == (*NORMALIZERS, "Split", "ByteLevel") and steps[1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
            and steps[3] == split and not steps[4]["add_prefix_space"] and not plan["post_processor"]
        )
        added = [t["content"] for t in plan["added_tokens"] if t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
        self.mark = added[0] if added else None
        self.clear()

    def clear(self) -> None:
        self.known, self.other, self.place = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.lens, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has.  Many words go through the tokenizer as one text, with a special token between."""
        out, sizes = [], []
        mark = self.mark.encode() if self.mark else b""
        for k in range(0, len(words), 4096):
            lot = words[k : k + 4096]
            if self.mark and not any(b"<|" in w for w in lot):
                ids = np.array(self.tokenizer.encode_batch_fast([mark.join(lot).decode()], add_special_tokens=False)[0].ids, np.uint32)
                between = ids == self.tokenizer.token_to_id(self.mark)
                out.append(ids[~between])
                sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(between), [len(ids)]])) - 1)
            else:
                got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([w.decode() for w in lot], add_special_tokens=False)]
                out += got
                sizes.append(np.array([len(x) for x in got], np.int64))
        return np.concatenate(out), np.concatenate(sizes)

    def _whole(self, texts: list[bytes], last: int) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array([*self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, last], np.uint32) for t in texts]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum([len(x) for x in ids]).astype(np.int64)

    def encode(self, texts: list[bytes], last: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text closed by `last`; and where each text ends."""
        import pandas as pd

        if not self.by_word:
            return self._whole(texts, last)
        if len(self.known) > MEMO_WORDS:
            self.clear()
        # texts that may spell a special token keep their case and stops
        marked = [b"<|" in t for t in texts]
        data = b"\n".join([t if m else t.translate(FOLD) for t, m in zip(texts, marked, strict=True)])
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        plain = np.ones(len(data), bool)
        for i in np.flatnonzero(marked):
            plain[begins[i] : begins[i + 1]] = False
        start, end = word_spans(data, plain)
        raw = np.frombuffer(data, np.uint8)
        first_hash, second_hash = (_Hash(raw, b).of(start, end) for b in _BASES)
        codes, distinct = pd.factorize(first_hash)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        other = second_hash[first]
        if (second_hash != other[codes]).any():
            return self._whole(texts, last)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        seen = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        if (self.other[at[seen]] != other[seen]).any():
            return self._whole(texts, last)
        size = end[first] - start[first]
        seen &= size <= LONG_WORD
        place = np.empty(len(distinct), np.int64)
        place[seen] = self.place[at[seen]]
        new = np.flatnonzero(~seen)
        long = np.flatnonzero(end - start > LONG_WORD)
        word_place = None
        if len(new) or len(long):
            short = new[size[new] <= LONG_WORD]
            which = np.concatenate([first[short], long])
            got, lens = self._encoded([data[a:b] for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)])
            where = len(self.lens) + np.arange(len(lens))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.ids = np.concatenate([self.ids, got])
            place[short] = where[: len(short)]
            word_place = where[len(short) :]
            known = np.concatenate([self.known, distinct[short]])
            order = np.argsort(known)
            self.known, self.other, self.place = known[order], np.concatenate([self.other, other[short]])[order], np.concatenate([self.place, place[short]])[order]
        each = place[codes] if len(codes) else np.zeros(0, np.int64)
        if len(long):
            each[long] = word_place
        # the closing id is one more word of each text
        counts = np.diff(np.searchsorted(start, begins))
        starts = np.insert(self.starts[each], np.cumsum(counts), -1)
        lens = np.insert(self.lens[each], np.cumsum(counts), 1)
        ends = np.cumsum(lens)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lens - starts, lens)
        closing = np.cumsum(counts + 1) - 1
        ids = self.ids[at] if len(self.ids) else np.zeros(len(at), np.uint32)
        ids[ends[closing] - 1] = last
        return ids, ends[closing]


def tokenised_pieces(df: DataFrame, tokenizer_path: str, *, id_col: str, text_col: str, capacity: int, last_id: int, with_ids: bool) -> DataFrame:
    """Pieces (row, id, start, length, ids_crc32, doc_tokens, ids) of every document, cut at multiples of capacity."""

    def cut(batches):
        import pyarrow as pa

        kept = worker_state()
        encoder = kept.get(("ids", tokenizer_path)) or kept.setdefault(("ids", tokenizer_path), WordIds(tokenizer_path))
        for batch in batches:
            texts = texts_as_bytes(batch.column("text"))
            for lo, hi in slices([len(t) for t in texts], SLICE_BYTES // 2):
                ids, ends = encoder.encode(texts[lo:hi], last_id)
                sizes = np.diff(np.concatenate([[0], ends]))
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(hi - lo), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                first = (ends - sizes)[doc] + start
                blobs = [ids[a : a + m].astype("<u4").tobytes() for a, m in zip(first.tolist(), length.tolist(), strict=True)]
                take = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").take(take), batch.column("id").take(take), pa.array(start), pa.array(length),
                        pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array(sizes[doc]), pa.array(blobs if with_ids else [None] * len(blobs), pa.binary()),
                    ],
                    names=["row", "id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    src = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(cut, "row long, id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def best_pattern(sizes: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most value that fits into room, and how often it takes each size."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        fits = sizes <= w
        best[w] = best[w - 1]
        if fits.any():
            got = np.where(fits, value + best[w - np.minimum(sizes, w)], -1.0)
            k = int(got.argmax())
            if got[k] > best[w] + 1e-12:
                best[w], took[w] = got[k], k
    pattern, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            pattern[took[w]] += 1
            w -= int(sizes[took[w]])
    return float(best[room]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 2000, gap: float = 1e-3) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, to cut all demand from as little stock as it can.

    Column generation by the revised simplex method; the rounded-down solution is
    completed by first-fit decreasing over what is left.
    """
    m = len(sizes)
    if not m:
        return []
    columns = np.diag(room // sizes).astype(float)
    x = demand / np.diag(columns)
    for _ in range(rounds):
        dual = np.linalg.solve(columns.T, np.ones(m))
        value, pattern = best_pattern(sizes, np.maximum(dual, 0), room)
        if value <= 1 + gap:  # the optimum is x.sum() / value at least
            break
        move = np.linalg.solve(columns, pattern.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(move > 1e-9, x / move, np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * move, 0)
        x[out] = ratio[out]
        columns[:, out] = pattern
    left, plan = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        pattern = columns[:, j].round().astype(np.int64)
        used = pattern > 0
        times = int(min(np.floor(x[j] + 1e-9), (left[used] // pattern[used]).min()))
        if times > 0:
            plan.append((pattern, times))
            left -= pattern * times
    while left.any():
        pattern, free = np.zeros(m, np.int64), room
        for k in np.argsort(-sizes, kind="stable"):
            n = min(int(left[k]), free // int(sizes[k]))
            pattern[k] = n
            free -= n * int(sizes[k])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds rank: 0, 1, ... within each kind, by pieces that are long first.

    A kind may hold most of all pieces, so that ranks come from salted parts of it
    and the parts' counts (kinds x parts rows).
    """
    parts = max(1, pieces.count() // RANK_ROWS)
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("row", "start"), F.lit(parts)))
    counts = salted.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("kind", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("kind", "part").orderBy(F.desc("length"), "id", "start", "row")
    return salted.withColumn("own", F.row_number().over(own) - 1).join(firsts, ["kind", "part"]).withColumn("rank", F.col("first") + F.col("own")).drop("part", "own", "first")


def pack(
    df: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    last_id: int = 2,
    unit: int = UNIT,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is cut at multiples of capacity; every id lies in exactly one
    piece.  Null and empty texts are documents of one id, last_id.  Lengths round
    up to classes of `unit` tokens only for planning, and short pieces are planned in
    bundles of one exact length, so that rounding is small against what is planned;
    offsets are gapless.  A null id packs like any other; repeated rows pack as
    documents of their own.  An empty table gives no rows.  Extra columns are
    ignored.  with_ids adds the piece's ids (little-endian unsigned 32-bit).
    """
    spark = df.sparkSession
    short, bundle = min(SHORT, capacity // 8), min(BUNDLE, capacity)
    pieces = materialise(
        tokenised_pieces(df, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, last_id=last_id, with_ids=with_ids).withColumn(
            "kind", F.when(F.col("length") <= short, -F.col("length")).otherwise(F.ceil(F.col("length") / unit)).cast("int")
        ),
        "packing-pieces",
    )
    hist = sorted((r["kind"], r["count"]) for r in pieces.groupBy("kind").count().collect())  # at most short + capacity / unit rows
    need: dict[int, int] = {}  # items of each class: long pieces, then bundles
    kinds = []

    def item(length: int, n: int) -> tuple[int, int]:
        """Class of n more items of so many tokens, and the rank of the first."""
        c = -(-length // unit)
        need[c] = need.get(c, 0) + n
        return c, need[c] - n

    for kind, n in reversed(hist):
        each = max(1, bundle // -kind) if kind < 0 else 1
        full, rest = divmod(n, each)
        c, base = item(each * -kind if kind < 0 else kind * unit, full)
        last, last_base = item(rest * -kind, 1) if rest else (c, base)
        kinds.append((kind, each, full, c, base, last, last_base - full))
    need = {c: n for c, n in need.items() if n}
    sizes, demand = np.array(sorted(need), np.int64), np.array([need[c] for c in sorted(need)], np.int64)
    slots, seq, rank = [], 0, np.zeros(len(sizes), np.int64)
    for pattern, times in cutting_stock(sizes, demand, capacity // unit):
        slot = 0
        for k in np.flatnonzero(pattern)[::-1]:
            n = int(pattern[k])
            slots.append((int(sizes[k]), int(rank[k]), int(rank[k] + n * times), n, seq, slot))
            rank[k] += n * times
            slot += n
        seq += times
    table = spark.createDataFrame(slots, "class int, lo long, hi long, each long, seq long, slot long")
    bundles = spark.createDataFrame(kinds, "kind int, of long, full long, c long, base long, last long, last_base long")
    # kinds and slots are a few rows per length class, whatever the input: they broadcast within a fixed bound
    number = F.floor(F.col("rank") / F.col("of"))
    items = (
        ranked(pieces.drop("ids", "ids_crc32", "doc_tokens"))
        .join(F.broadcast(bundles), "kind")
        .select(
            "row", "start", "length", "rank", F.when(number < F.col("full"), F.col("c")).otherwise(F.col("last")).cast("int").alias("class"),
            (number + F.when(number < F.col("full"), F.col("base")).otherwise(F.col("last_base"))).alias("item"),
        )
    )
    at = F.col("item") - F.col("lo")
    placed = (
        items.join(F.broadcast(table), "class")
        .where("item >= lo and item < hi")
        .select("row", "start", "length", "rank", (F.col("seq") + F.floor(at / F.col("each"))).alias("sequence_id"), (F.col("slot") + at % F.col("each")).alias("slot"))
    )
    before = Window.partitionBy("sequence_id").orderBy("slot", "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("row", "start", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return pieces.join(placed, ["row", "start"]).select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])
    )
