"""Operator 5: removal of repeated substrings by threshold-bounded interval expansion.

A window is a string of `length` bytes.  Each window has an anchor, the least hash
of the short strings in it, so that equal windows have equal anchors.  Anchors that
occur once drop out in a packed exchange.  Runs of windows with the same shared
anchor become short strings, which meet by anchor; an owner task sorts the suffixes
of its strings and expands intervals of their Burrows-Wheeler transform
backwards, breadth first, which yields the common prefixes of neighbouring
suffixes by increasing value and stops at `length`.  Neighbours without a value by
then are equal windows, of which the earliest stays.  Equal strings combine before
the exchange, within a slice of a scanning task, and for frequent anchors also in
salted groups, so that no owner gets a row per copy.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Rows, discard, materialise, mix, slices, text_bytes, text_slices
from .shared_tokens import IDX, documents, n_ranges, range_of, shared_tokens

LENGTH = 100
#: Bytes of text whose windows are numbered at once: some twenty numbers of 8 bytes for each.
PIECE_BYTES = 256 << 10
#: Bytes of the strings whose least hash is a window's anchor.
ANCHOR = 32
#: An anchor that occurs so often, counted up to 65535, sends its windows one by one, each by its own hash.
HOT = 0xFFFF
#: An anchor that occurs so often sends its strings by way of salted groups, which combine equal ones.
WARM = 256
_B = 0xD6E8FEB86659FD93
_INFO = "row long, id long, n_bytes long, sha string, anchors binary"
_STRINGS = "range int, salt int, kind int, ids binary, rows binary, starts binary, sizes binary, keys binary, data binary, removed binary"


class _Hashes:
    """Hashes of all strings of a length, from running sums of a polynomial."""

    def __init__(self, raw: np.ndarray):
        one = np.ones(1, np.uint64)
        up = np.cumprod(np.concatenate([one, np.full(len(raw), _B, np.uint64)]))
        self.down = np.cumprod(np.concatenate([one, np.full(len(raw), pow(_B, -1, 1 << 64), np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])])

    def of(self, start, length: int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length : length + n] - self.sums[:n]) * self.down[:n])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` neighbours."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def pieces(texts: list[bytes], length: int) -> list[tuple[int, int, bytes]]:
    """(document, offset, bytes): every window of every text is in exactly one piece of bounded size."""
    return [(i, at, t[at : at + PIECE_BYTES + length - 1]) for i, t in enumerate(texts) for at in range(0, max(len(t) - length + 1, 0), PIECE_BYTES)]


def windows(texts: list[bytes], length: int, anchor: int):
    """For each lot of pieces: hashes, bytes, and of all windows the document, start in it, place among the bytes, anchor, and whether a run begins."""
    all_pieces = pieces(texts, length)
    for lo, hi in slices([len(p[2]) for p in all_pieces], PIECE_BYTES):
        part = all_pieces[lo:hi]
        data = b"".join(p[2] for p in part)
        hashes = _Hashes(np.frombuffer(data, np.uint8))
        each = hashes.all(anchor)
        least = _least(each, length - anchor + 1)
        sizes = np.array([len(p[2]) for p in part])
        n = sizes - length + 1
        begins = np.cumsum(sizes) - sizes
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - begins, n)
        doc = np.repeat([p[0] for p in part], n)
        start = place - np.repeat(begins, n) + np.repeat([p[1] for p in part], n)
        # a run of windows ends where another document or anchor begins, or where the first place of the anchor has left
        new = np.ones(len(place), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (least[place[1:]] != least[place[:-1]]) | (each[place[:-1]] == least[place[:-1]]) | (place[1:] != place[:-1] + 1)
        yield hashes, data, doc, start, place, least[place], new


def anchor_tokens(texts: list[bytes], length: int, anchor: int) -> tuple[np.ndarray, dict]:
    """Packed anchors, each twice where runs of several places in the document have it."""
    tokens = [np.zeros(0, np.uint64)]
    for _, _, doc, _, _, least, new in windows(texts, length, anchor):
        tokens.append((least[new] & ~IDX) | doc[new].astype(np.uint64))
    found = np.sort(np.concatenate(tokens))
    return found[np.concatenate([[True, True], found[2:] != found[:-2]])[: len(found)]], {"n": [len(t) for t in texts], "sha": [hashlib.sha256(t).hexdigest() for t in texts]}


_SETTLED = _STRINGS.replace("salt int, ", "") + ", row long, start long, windows long"


def _finish(hot: int, warm: int):
    def run(meta, values, counts, edges):
        import pyarrow as pa

        values = values | (np.where(counts >= hot, np.uint64(2), np.uint64(0)) | np.where(counts >= min(hot, warm), np.uint64(1), np.uint64(0))) << np.uint64(62)
        blobs = [values[a:b].tobytes() if b > a else None for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return pa.table(
            {
                "row": pa.array(meta["row"], pa.int64()), "id": pa.array(meta["id"], pa.int64()), "n_bytes": pa.array(meta["n"], pa.int64()), "sha": pa.array(meta["sha"]),
                "anchors": pa.array(blobs, pa.binary()),
            }
        )

    return run


def _ranges(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _cut_strings(length: int, anchor: int, ranges: int, salts: int):
    """Task code: runs of windows with one shared anchor as strings by key range, combined within the slice."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("range", pa.int32()), ("salt", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("ids", "rows", "starts", "sizes", "keys", "data", "removed"))])
        for batch in batches:
            ids = np.array([np.iinfo(np.int64).min if i is None else i for i in batch.column("id").to_pylist()], np.int64)
            rows = batch.column("row").to_numpy()
            shared = [np.frombuffer(b, np.uint64) for b in batch.column("anchors").to_pylist()]
            for lo, hi, texts in text_slices(batch.column("text"), most_rows=30000):
                sizes = [len(x) for x in shared[lo:hi]]
                value = np.concatenate([np.zeros(0, np.uint64), *shared[lo:hi]])
                known = (np.repeat(np.arange(hi - lo), sizes).astype(np.uint64) << np.uint64(48)) | (value & np.uint64((1 << 48) - 1))
                order = np.argsort(known)
                known, mark = known[order], (value >> np.uint64(62))[order]
                salt = 1 + int(mix(rows[lo : lo + 1].astype(np.uint64))[0] % np.uint64(salts))
                out: dict[tuple[int, int], list] = {}
                first: dict[tuple[int, bytes], tuple] = {}
                warm_keys: set[int] = set()
                gone: list[tuple[int, int, int]] = []
                for hashes, data, doc, start, place, least, begins in windows(texts, length, anchor):
                    own = (doc.astype(np.uint64) << np.uint64(48)) | (least >> np.uint64(16))
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    live = np.flatnonzero(known[at] == own)
                    if not len(live):
                        continue
                    single = mark[at[live]] >= 2
                    key = least[live].copy()
                    key[single] = hashes.of(place[live[single]], length)
                    heads = np.flatnonzero(begins[live] | single)
                    n = np.diff(np.append(heads, len(live)))
                    warm_keys.update(key[heads[mark[at[live[heads]]] > 0]].tolist())
                    for k, d, s, p, w in zip(key[heads].tolist(), doc[live[heads]].tolist(), start[live[heads]].tolist(), place[live[heads]].tolist(), n.tolist(), strict=True):
                        text = data[p : p + w + length - 1]
                        me = (int(ids[lo + d]), int(rows[lo + d]), s, w)
                        had = first.get((k, text))
                        if had is None or me < had:
                            first[k, text] = me
                            me = had
                        if me is not None:
                            gone.append(me[1:])
                if first:
                    at = range_of(np.array([k for k, _ in first], np.uint64), ranges).tolist()
                    for r, ((k, text), me) in zip(at, first.items(), strict=True):
                        out.setdefault((r, salt if k in warm_keys else 0), []).append((text, *me, k))
                    lots = [(*to, 0, *_packed_strings(x).values(), None) for to, x in out.items()]
                    if gone:
                        lots.append((*lots[0][:2], 1, None, None, None, None, None, None, np.array(gone, np.int64).tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in lots], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def suffix_order(code: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Suffixes of texts that each end with a 0, in order; equal suffixes by position.

    code: 9-bit characters above 0, or 0; rest: characters up to and with the next 0.
    """
    n = len(code)
    padded = np.concatenate([code, np.zeros(8, code.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | np.where(j < rest, padded[j : j + n], np.uint64(0))
    have, ranks = 7, -1
    while True:
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[False], key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        count = int(new.sum())
        if count == ranks or count == n - 1 or have >= int(rest.max()):
            return order
        ranks = count
        after = np.zeros(n, np.int64)
        more = np.flatnonzero(rest > have)
        after[more] = rank[more + have] + 1
        key = (rank * (n + 1) + after).astype(np.uint64)
        have *= 2


def equal_prefixes(code: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the order, the number of its class: suffixes that agree in `length` characters.

    Backward extension, breadth first.  An interval holds the suffixes that begin
    with some string; extending the string to the left gives one interval for each
    character before it.  The end of an interval of strings of n characters is a
    place where neighbours have n - 1 in common, unless a shorter value was found
    there before; only intervals with a new end go on.  After `length` rounds the
    places without a value have at least that much in common.
    """
    n = len(code)
    before = code[order - 1]
    before[order == 0] = 0
    by_char = np.argsort(before.astype(np.uint16), kind="stable")
    back = np.empty(n, np.int64)  # place of the suffix one character longer
    back[by_char] = np.arange(n)
    following, previous = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    same = before[by_char][1:] == before[by_char][:-1]
    following[by_char[:-1][same]] = by_char[1:][same]
    previous[by_char[1:][same]] = by_char[:-1][same]
    first = code[order]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    known[1:n] = (first[1:] != first[:-1]) | (first[1:] == 0)
    ends = np.flatnonzero(known)
    begin, end = ends[:-1], ends[1:]
    for _ in range(1, length):
        size = end - begin
        total = int(size.sum())
        if not total:
            break
        at = np.arange(total) - np.repeat(np.cumsum(size) - size - begin, size)
        inner = before[at] != 0
        last = at[inner & (following[at] >= np.repeat(end, size))]
        head = at[inner & (previous[at] < np.repeat(begin, size))]
        new_begin, new_end = np.sort(back[head]), np.sort(back[last]) + 1
        fresh = ~known[new_end]
        begin, end = new_begin[fresh], new_end[fresh]
        known[end] = True
    return np.cumsum(known[:n]) - 1


def repeated_windows(strings: list[bytes], ids: np.ndarray, rows: np.ndarray, starts: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(row, start, windows) of the windows that occur earlier: by id, row, then start."""
    data = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.int64) + 1
    sizes = np.array([len(s) + 1 for s in strings])
    stops = np.cumsum(sizes)
    data[stops - 1] = 0
    string = np.repeat(np.arange(len(strings)), sizes)
    offset = np.arange(len(data)) - (stops - sizes)[string]
    order = suffix_order(data, sizes[string] - offset)
    group = equal_prefixes(data, order, length)
    rank = np.empty(len(strings), np.int64)
    by = np.lexsort((rows, ids))
    rank[by] = np.cumsum(np.concatenate([[0], (ids[by][1:] != ids[by][:-1]) | (rows[by][1:] != rows[by][:-1])]))
    when = (rank[string] << 40) + starts[string] + offset
    full = (sizes[string] - 1 - offset) >= length
    place = order[full[order]]
    group = group[full[order]]
    if not len(place):
        return []
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.repeat(np.minimum.reduceat(when[place], heads), np.diff(np.append(heads, len(place))))
    late = np.zeros(len(data), bool)
    late[place] = when[place] > least
    a, b = _ranges(late)
    own = string[a]
    return list(zip(rows[own].tolist(), (starts[own] + offset[a]).tolist(), (b - a).tolist(), strict=True))


def _read_strings(table, length: int):
    """(string, id, row, start, windows, key) of the packed strings of a group, and its settled windows."""
    gone = [np.frombuffer(b, np.int64).reshape(-1, 3) for b in table.column("removed").to_pylist() if b is not None]
    found = []
    for kind, *blobs in zip(*(table.column(c).to_pylist() for c in ("kind", "ids", "rows", "starts", "sizes", "keys", "data")), strict=True):
        if kind:
            continue
        ids, rows, starts, sizes = (np.frombuffer(b, np.int64).tolist() for b in blobs[:4])
        keys, data, at = np.frombuffer(blobs[4], np.uint64).tolist(), blobs[5], 0
        for k, i, r, s, w in zip(keys, ids, rows, starts, sizes, strict=True):
            found.append((data[at : at + w + length - 1], i, r, s, w, k))
            at += w + length - 1
    return found, gone


def _packed_strings(found: list[tuple]) -> dict:
    """The columns of strings in one row."""
    blob = lambda j, kind: np.array([x[j] for x in found], kind).tobytes()
    return {"ids": blob(1, np.int64), "rows": blob(2, np.int64), "starts": blob(3, np.int64), "sizes": blob(4, np.int64), "keys": blob(5, np.uint64), "data": b"".join(x[0] for x in found)}


def _late_table(late: np.ndarray, schema):
    """A table of the settled schema with windows that occur earlier."""
    import pyarrow as pa

    own = {c: pa.array(late[:, j], pa.int64()) for j, c in enumerate(("row", "start", "windows"))}
    return pa.table([own.get(f.name, pa.nulls(len(late), f.type)) for f in schema], schema=schema)


def _settle(length: int):
    """Task code for a range and salt: windows that occur earlier (salt 0), or the earliest of equal strings (other salts)."""

    def run(key, table):
        import pyarrow as pa

        binary = ("ids", "rows", "starts", "sizes", "keys", "data", "removed")
        schema = pa.schema([("range", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in binary), *((c, pa.int64()) for c in ("row", "start", "windows"))])
        found, gone = _read_strings(table, length)
        if key[1].as_py() == 0:
            return _late_table(np.concatenate([np.zeros((0, 3), np.int64), *gone, _expanded(found, length)]), schema)
        first: dict[bytes, tuple] = {}
        late = []
        for x in found:
            had = first.get(x[0])
            if had is None or x[1:] < had[1:]:
                first[x[0]], x = x, had
            if x is not None:
                late.append(x[2:5])
        out = _late_table(np.concatenate([np.zeros((0, 3), np.int64), *gone, np.array(late, np.int64).reshape(-1, 3)]), schema)
        if not first:
            return out
        row = {"range": key[0].as_py(), "kind": 0, **_packed_strings(list(first.values()))}
        return pa.concat_tables([out, pa.Table.from_pylist([{f.name: row.get(f.name) for f in schema}], schema=schema)])

    return run


def _expanded(found: list[tuple], length: int) -> np.ndarray:
    """(row, start, windows) of the windows that occur earlier, by interval expansion over the strings of one anchor and more at a time."""
    per_key: dict[int, int] = {}
    for x in found:
        per_key[x[5]] = per_key.get(x[5], 0) + 1
    # a string that is the only one with its anchor has no window in common with another
    rest, late = [x for x in found if per_key[x[5]] > 1], []
    for lo, hi in _lots(rest):
        part = rest[lo:hi]
        ids, rows, starts = (np.array([x[j] for x in part], np.int64) for j in (1, 2, 3))
        late += repeated_windows([x[0] for x in part], ids, rows, starts, length)
    return np.array(late, np.int64).reshape(-1, 3)


def _expand(length: int):
    def run(key, table):
        import pyarrow as pa

        late = _expanded(_read_strings(table, length)[0], length)
        return pa.table({c: pa.array(late[:, j], pa.int64()) for j, c in enumerate(("row", "start", "windows"))})

    return run


def _lots(rest: list, most: int = 256 << 10):
    """Sorts by anchor and cuts between anchors, into lots of about `most` bytes."""
    rest.sort(key=lambda x: x[5])
    lo = size = 0
    for i, x in enumerate(rest):
        if size > most and x[5] != rest[i - 1][5]:
            yield lo, i
            lo, size = i, 0
        size += len(x[0])
    if rest:
        yield lo, len(rest)


def _cut(length: int):
    """Task code: what is left of each text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi, texts in text_slices(batch.column("text")):
                removed, spans, kept = [], [], []
                for t, late in zip(texts, batch.column("late").slice(lo, hi - lo).to_pylist(), strict=True):
                    at, n, k, left = 0, 0, 0, []
                    stop = None
                    for x in sorted((x["start"], x["start"] + x["windows"] + length - 1) for x in late or []):
                        if stop is None or x[0] > stop:
                            if stop is not None:
                                at = stop
                            left.append(t[at : x[0]])
                            begin, stop, k = x[0], x[1], k + 1
                            n += stop - begin
                        elif x[1] > stop:
                            n += x[1] - stop
                            stop = x[1]
                    left.append(t[stop or 0 :])
                    removed.append(n)
                    spans.append(k)
                    kept.append(b"".join(left))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, hi - lo), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())],
                    names=["row", "n_removed", "n_spans", "kept_sha256", "kept_text"],
                )

    return run


def remove_repeats(
    df: DataFrame | Rows, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, warm: int = WARM, with_text: bool = False, with_row: bool = False
) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text).

    Texts are UTF-8 bytes, null is empty; no window crosses documents.  Every byte
    goes that a window covers which also starts earlier: in a document of smaller
    id, or before in the same one.  Windows are judged on the input.  A null id is
    before all others, and rows of the same id follow each other by the numbers of Rows.
    Documents shorter than `length` bytes stay whole.  Extra columns are ignored.
    with_text adds what is left as text (parts of a character that was cut go);
    with_row adds row, the number that Rows gives.

    Exact copies are settled by their digests: all but the earliest lose
    everything.  df is read twice; one that is no table is written first.
    """
    docs = documents(df, id_col, text_col)
    n = text_bytes(docs, "text")
    emit = lambda texts: anchor_tokens(texts, length, anchor)
    info = materialise(shared_tokens(docs, emit, _finish(hot, warm), _INFO, n), "repeats-documents")
    live = info.where("anchors is not null")
    earliest = F.min(F.struct("id", "row"))
    reps = live.groupBy("sha", "n_bytes").agg(earliest.alias("e")).select(F.col("e.row").alias("row"))
    marked = materialise(live.join(reps.withColumn("rep", F.lit(True)), "row", "left").select("row", "anchors", "rep"), "repeats-marked")
    texts = materialise(docs.join(marked.where("rep").select("row", "anchors"), "row"), "repeats-texts")
    # strings are several times the text they come from; a frequent one meets in as many salted groups as each has rows
    salts = max(4, math.isqrt(n // SLICE_BYTES))
    strings = texts.mapInArrow(_cut_strings(length, anchor, n_ranges(4 * n), salts), _STRINGS)
    settled = materialise(strings.groupBy("range", "salt").applyInArrow(_settle(length), _SETTLED), "repeats-settled")
    combined = settled.where("kind = 0").groupBy("range").applyInArrow(_expand(length), "row long, start long, windows long")
    late = materialise(settled.where("row is not null").select("row", "start", "windows").union(combined), "repeats-late")
    discard(settled)
    cut = (
        texts.select("row", "text")
        .join(late.groupBy("row").agg(F.collect_list(F.struct("start", "windows")).alias("late")), "row")
        .mapInArrow(_cut(length), "row long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    )
    out = info.join(cut if with_text else cut.drop("kept_text"), "row", "left").join(marked.where("rep is null").select("row", F.lit(True).alias("copy")), "row", "left")
    whole = F.col("copy").isNotNull()
    cols = [
        F.col("id").alias(id_col), "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *(["row"] if with_row else []),
    ]
    if not with_text:
        return out.select(*cols)
    full = docs.select("row", F.coalesce("text", F.lit("")).alias("text"))
    return out.join(full, "row").select(*cols, F.when(whole, "").otherwise(F.coalesce("kept_text", "text")).alias("kept_text"))
