"""Which tokens of a corpus occur in more than one place: packed exchange.

Near-duplicate search and substring search both need, for every document, those
of its tokens (hashed n-grams, hashed anchors) that other documents have as well.
A row per token would make the shuffle many times the text.  So a unit of
documents sends each key range one block of numbers instead: 48 bits of hash and
16 bits for the document within the unit, sorted, as differences.  Owners of key
ranges find the tokens that occur twice or more, and send back blocks to the
unit's own group.

Nothing is collected: blocks are bounded by the unit, ranges by their number,
which follows the bytes of text.  A token that is frequent within a unit goes to its
owner once, with its count, and its documents stay with the unit: a token in a third
of all documents is a few bytes a unit in one range.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, text_slices

#: Bytes of text per key range, and per unit of documents that are addressed together.
RANGE_BYTES = 8 << 20
UNIT_BYTES = 24 << 20
UNIT_ROWS = 60000
#: Ranges at most, so that a full unit has some tokens for each: beyond, ranges grow instead of rows multiplying.
MOST_RANGES = 1 << 18
#: Documents of a unit from which a token goes to its owner as a count.
OFTEN = 32
MOST_COUNT = 0xFFFF
IDX = np.uint64(0xFFFF)
_BLOCK = "range int, unit long, n int, tokens binary, counts binary, often binary, meta binary"


def n_ranges(text_bytes: int) -> int:
    return int(min(max(16, -(-text_bytes // RANGE_BYTES)), MOST_RANGES))


def range_of(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """Key range of packed tokens: the leading 32 bits, scaled."""
    return (((tokens >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def packed(tokens: np.ndarray) -> bytes:
    """Ascending numbers as the first one and differences of as few bytes as they need."""
    if not len(tokens):
        return b""
    step = np.diff(tokens)
    width = (int(step.max()).bit_length() + 7) // 8 if len(step) else 0
    return bytes([width]) + tokens[:1].astype("<u8").tobytes() + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(block: bytes, n: int) -> np.ndarray:
    """The n numbers of a block."""
    out = np.zeros(n, np.uint64)
    if n:
        out[0] = np.frombuffer(block, "<u8", 1, 1)[0]
        if block[0]:
            step = np.zeros((n - 1, 8), np.uint8)
            step[:, : block[0]] = np.frombuffer(block, np.uint8, (n - 1) * block[0], 9).reshape(n - 1, block[0])
            out[1:] = step.view("<u8").ravel()
    return np.cumsum(out)


def _pairs(tokens: np.ndarray, counts: np.ndarray) -> bytes | None:
    return np.stack([tokens.astype(np.int64), counts.astype(np.int64)], 1).tobytes() if len(tokens) else None


def _unpaired(blobs: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, counts, and which of the blobs each is from."""
    rows = [np.frombuffer(b or b"", np.int64).reshape(-1, 2) for b in blobs]
    flat = np.concatenate([np.zeros((0, 2), np.int64), *rows])
    return flat[:, 0].astype(np.uint64), flat[:, 1], np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def _send(emit: Callable, ranges: int):
    """Task code: per unit a row of meta for its own group, and a block of tokens and counts for each range."""

    def run(batches):
        import pickle

        import pyarrow as pa
        from pyspark import TaskContext

        unit = TaskContext.get().partitionId() << 32
        tokens: list[np.ndarray] = []
        meta: dict[str, list] = {}
        held = 0

        def flush():
            nonlocal unit, held
            found = np.sort(np.concatenate(tokens))
            heads = np.flatnonzero(np.concatenate([[True], found[1:] >> np.uint64(16) != found[:-1] >> np.uint64(16)])) if len(found) else np.zeros(0, np.int64)
            times = np.diff(np.append(heads, len(found)))
            often, n_often = found[heads[times >= OFTEN]] & ~IDX, times[times >= OFTEN]
            stays = np.repeat(times >= OFTEN, times)
            held_back, found = found[stays], found[~stays]
            at, at_often = range_of(found, ranges), range_of(often, ranges)
            used = np.union1d(at, at_often)
            a, b = (np.searchsorted(at, used, side=side).tolist() for side in ("left", "right"))
            c, d = (np.searchsorted(at_often, used, side=side).tolist() for side in ("left", "right"))
            n = len(used)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([*used.tolist(), unit % ranges], pa.int32()), pa.array([unit] * (n + 1), pa.int64()), pa.array([*(y - x for x, y in zip(a, b, strict=True)), 0], pa.int32()),
                    pa.array([*(packed(found[x:y]) for x, y in zip(a, b, strict=True)), None], pa.binary()), pa.array([None] * (n + 1), pa.binary()),
                    pa.array([*(_pairs(often[x:y], n_often[x:y]) for x, y in zip(c, d, strict=True)), None], pa.binary()),
                    pa.array([None] * n + [pickle.dumps({**meta, "often": held_back}, 5)], pa.binary()),
                ],
                names=["range", "unit", "n", "tokens", "counts", "often", "meta"],
            )
            tokens.clear()
            meta.clear()
            unit, held = unit + 1, 0
            return out

        for batch in batches:
            rows, ids = batch.column("row").to_pylist(), batch.column("id").to_pylist()
            for lo, hi, texts in text_slices(batch.column("text"), most_rows=10000):
                if tokens and (held > UNIT_BYTES or len(meta["row"]) + hi - lo > UNIT_ROWS):
                    yield flush()
                found, more = emit(texts)
                tokens.append(found + np.uint64(len(meta.get("row", []))))
                for k, v in {"row": rows[lo:hi], "id": ids[lo:hi], **more}.items():
                    meta.setdefault(k, []).extend(v)
                held += sum(len(t) for t in texts)
        if tokens:
            yield flush()

    return run


def _own(key, table):
    """Owner of one key range: the blocks' tokens that occur twice or more, back by unit, with their counts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    meta = table.filter(pc.is_valid(table.column("meta")))
    part = table.filter(pc.is_null(table.column("meta")))
    units, sizes = part.column("unit").to_pylist(), part.column("n").to_pylist()
    got: list[tuple[int, int, bytes, bytes, bytes | None]] = []
    if units:
        tokens = np.concatenate([unpacked(b, n) for b, n in zip(part.column("tokens").to_pylist(), sizes, strict=True)])
        block = np.repeat(np.arange(len(units)), sizes)
        often, n_often, block_often = _unpaired(part.column("often").to_pylist())
        value = np.concatenate([tokens, often]) >> np.uint64(16)
        weight = np.concatenate([np.ones(len(tokens), np.int64), n_often])
        order = np.argsort(value, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], value[order][1:] != value[order][:-1]])) if len(order) else np.zeros(0, np.int64)
        total = np.empty(len(order), np.int64)
        total[order] = np.repeat(np.add.reduceat(weight[order], heads), np.diff(np.append(heads, len(order)))) if len(order) else 0
        live = np.flatnonzero(total[: len(tokens)] > 1)
        count = np.minimum(total[live], MOST_COUNT).astype(np.uint16)
        by_block, by_often = np.searchsorted(block[live], np.arange(len(units) + 1)), np.searchsorted(block_often, np.arange(len(units) + 1))
        for k, unit in enumerate(units):
            mine, theirs = live[by_block[k] : by_block[k + 1]], slice(by_often[k], by_often[k + 1])
            if len(mine) or by_often[k + 1] > by_often[k]:
                more = _pairs(often[theirs], np.minimum(total[len(tokens) :][theirs], MOST_COUNT))
                got.append((unit, len(mine), packed(tokens[mine]), count[by_block[k] : by_block[k + 1]].tobytes(), more))
    back = pa.table(
        {
            "range": pa.array([key[0].as_py()] * len(got), pa.int32()), "unit": pa.array([g[0] for g in got], pa.int64()), "n": pa.array([g[1] for g in got], pa.int32()),
            "tokens": pa.array([g[2] for g in got], pa.binary()), "counts": pa.array([g[3] for g in got], pa.binary()), "often": pa.array([g[4] for g in got], pa.binary()),
            "meta": pa.array([None] * len(got), pa.binary()),
        }
    )
    return pa.concat_tables([back, meta.select(back.column_names).cast(back.schema)])


def _gather(finish: Callable):
    """Task code for one unit: its documents' meta and their tokens that occur elsewhere, by (document, count, token)."""

    def run(key, table):
        import pickle

        import pyarrow.compute as pc

        meta = pickle.loads(next(m for m in table.column("meta").to_pylist() if m is not None))
        part = table.filter(pc.is_null(table.column("meta")))
        blocks = zip(part.column("tokens").to_pylist(), part.column("n").to_pylist(), strict=True)
        tokens = np.concatenate([np.zeros(0, np.uint64), *(unpacked(b, n) for b, n in blocks)])
        counts = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(b, np.uint16) for b in part.column("counts").to_pylist())])
        kept = meta.pop("often")
        if len(kept):
            often, total, _ = _unpaired(part.column("often").to_pylist())
            order = np.argsort(often)
            own = np.searchsorted(often[order], kept & ~IDX)
            tokens, counts = np.concatenate([tokens, kept]), np.concatenate([counts, total[order][own].astype(np.uint16)])
        doc, value = (tokens & IDX).astype(np.int64), tokens >> np.uint64(16)
        order = np.lexsort((value, counts, doc))
        doc, value, counts = doc[order], value[order], counts[order]
        edges = np.searchsorted(doc, np.arange(len(meta["row"]) + 1))
        return finish(meta, value, counts, edges)

    return run


def shared_tokens(df: DataFrame, emit: Callable, finish: Callable, schema: str, text_bytes: int) -> DataFrame:
    """df: row, id, text.  emit(texts) gives packed tokens, sorted,
    and meta (lists by document); finish(meta, values,
    counts, edges) gets, for document i, its shared tokens values[edges[i]:edges[i+1]] in order of count and
    value, and returns an Arrow table of schema.
    """
    sent = df.mapInArrow(_send(emit, n_ranges(text_bytes)), _BLOCK)
    owned = sent.groupBy("range").applyInArrow(_own, _BLOCK)
    return owned.groupBy("unit").applyInArrow(_gather(finish), schema)


def documents(df: DataFrame | Rows, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text): row is the number that Rows gives."""
    return Rows.of(df).select(id=F.col(id_col).cast("long"), text=F.col(text_col))
