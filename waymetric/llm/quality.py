"""Operator 9: quality rules with the cross-document frequency of lines.

One pass over the texts measures each document and hashes its normalised lines.
Counting, per host, in how many distinct documents each line occurs is then a
plain aggregate over hashes; lines above the limit are removed, and a document
of which too little is left is rejected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLD, Rows, ascii_lower, materialise, mix, slices, texts_as_bytes

#: Base rules of the contract.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line is removed when more than LINE_DOCS distinct documents of its host have it; in a small host, when
#: more than LINE_PERCENT of its documents do, and more than LINE_FEW.
LINE_DOCS = 20
LINE_PERCENT = 10
LINE_FEW = 5
#: A document is depleted when less than this share of its words is left.
LEFT_PERCENT = 20

_MEASURED = (
    "row long, id long, host string, content long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, lines array<struct<hash:long,words:long>>"
)


def _word_char_flags() -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(256)
    space = (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))
    starts = ((byte & 0xC0) != 0x80) & ~space
    return starts.astype(np.int64), np.isin(byte, list(b"#*$%&|<>")).astype(np.int64)


def repeated_words(codes: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document, the words that lie in a 5-word window found twice or more in it.

    codes: word codes of all documents in a row; doc: each word's document; counts: words of each document.
    """
    out = np.zeros(len(counts), np.int64)
    if len(codes) < 5:
        return out
    start = np.flatnonzero(doc[4:] == doc[:-4])
    h = doc[start].astype(np.uint64)
    for j in range(5):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[start + j].astype(np.uint64))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    a, b = start[order[:-1][same]], start[order[1:][same]]
    if not all(np.array_equal(codes[a + j], codes[b + j]) for j in range(5)) or not np.array_equal(doc[a], doc[b]):
        table = np.stack([doc[start], *(codes[start + j] for j in range(5))], 1)  # hashes collided: compare whole windows
        _, inverse, n = np.unique(table, axis=0, return_inverse=True, return_counts=True)
        repeated = start[n[inverse.ravel()] > 1]
    else:
        repeated = np.unique(np.concatenate([a, b]))
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + 5, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(counts)).astype(np.int64)


def _measure(batches):
    import pandas as pd
    import pyarrow as pa
    import xxhash

    chars, symbols = _word_char_flags()
    signed = lambda b: int.from_bytes(xxhash.xxh64_digest(b, 42), "big", signed=True)  # as Spark's xxhash64
    for batch in batches:
        texts = texts_as_bytes(batch.column("text"))
        for lo, hi in slices([len(t) for t in texts]):
            part = texts[lo:hi]
            ends = np.cumsum([len(t) for t in part])
            raw = np.frombuffer(b"".join(part), np.uint8)
            per_doc = lambda table: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(table[raw])])[ends]]))
            words = [t.split() for t in part]
            counts = np.array([len(w) for w in words], np.int64)
            flat = np.empty(int(counts.sum()), object)
            flat[:] = [w for ws in words for w in ws]
            codes = pd.factorize(flat)[0] if len(flat) else np.zeros(0, np.int64)
            repeat = repeated_words(codes, np.repeat(np.arange(len(part)), counts), counts)
            lines, dups = [], []
            for t in part:
                full = [x for x in t.split(b"\n") if x.split()]
                dups.append(len(full) - len(set(full)))
                own = {}
                for x in full:
                    w = x.translate(FOLD).split()
                    h = signed(b" ".join(w))
                    own[h] = own.get(h, 0) + len(w)
                lines.append([{"hash": h, "words": n} for h, n in own.items()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").slice(lo, hi - lo),
                    batch.column("id").slice(lo, hi - lo).cast(pa.int64()),
                    batch.column("host").slice(lo, hi - lo),
                    pa.array([signed(t) for t in part], pa.int64()),
                    pa.array(counts),
                    pa.array(per_doc(chars)),
                    pa.array(per_doc(symbols)),
                    pa.array(dups, pa.int64()),
                    pa.array(repeat),
                    pa.array(lines, pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())]))),
                ],
                names=["row", "id", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
            )


def _input(df: DataFrame | Rows, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return Rows.of(df).select(id=F.col(id_col).cast("long"), host=F.col(host_col).cast("string"), text=F.col(text_col))


def frequent_lines(measured: DataFrame, line_docs: int = LINE_DOCS, line_percent: int = LINE_PERCENT, line_few: int = LINE_FEW) -> DataFrame:
    """(host, hash) of the lines above the limits, with n_with and n_docs.

    Documents count once by content: a text copied a thousand times within a host
    is one document there, so copies alone never make its lines frequent.
    """
    docs = measured.groupBy("host").agg(F.count_distinct("content").alias("n_docs"))
    lines = (
        measured.select("host", "content", F.explode("lines.hash").alias("hash"))
        .groupBy("host", "hash", "content")
        .agg(F.lit(1).alias("one"))
        .groupBy("host", "hash")
        .agg(F.count("one").alias("n_with"))
        .where(F.col("n_with") > min(line_few, line_docs))
    )
    return (
        lines.alias("l")
        .join(docs.alias("d"), F.col("l.host").eqNullSafe(F.col("d.host")))
        .where((F.col("n_with") > line_docs) | (F.col("n_with") * 100 > F.col("n_docs") * line_percent))
        .select("l.host", "l.hash", "n_with", "n_docs")
    )


def quality_rules(
    df: DataFrame | Rows,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    line_docs: int = LINE_DOCS,
    line_percent: int = LINE_PERCENT,
    line_few: int = LINE_FEW,
    left_percent: int = LEFT_PERCENT,
    with_text: bool = False,
    with_row: bool = False,
    with_lines: bool = False,
) -> DataFrame:
    """One row per input row: id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_removed_words, kept (and clean_text).

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text; null and empty texts have
    none and fail the base rules.  Lines are compared after lower-casing A-Z and
    turning runs of white space into one space; lines without a word never count.
    A document is kept when it passes the base rules and at least left_percent of
    its words stay after the frequent lines are removed.  A null host is a host of
    its own.  Repeated rows each get their row.  Extra columns are ignored.
    An empty table gives no rows.  with_text adds clean_text, the text without its
    frequent lines (null stays null), for which df is read again (one that is no table
    is written first); with_row adds row, the number that Rows gives; with_lines adds
    gone, the hashes of its frequent lines (null: none).
    """
    src = _input(df, id_col, text_col, host_col)
    measured = materialise(src.mapInArrow(_measure, _MEASURED), "quality-measured")
    frequent = materialise(frequent_lines(measured, line_docs, line_percent, line_few), "quality-frequent")
    hit = (
        measured.select("row", "host", F.explode("lines").alias("line"))
        .select("row", F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("hn"), F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
        .join(frequent.select(F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("hn"), "hash"), ["h", "hn", "hash"])
        .groupBy("row")
        .agg(F.sum("words").alias("n_removed_words"), *([F.collect_set("hash").alias("gone")] if with_text or with_lines else []))
    )
    out = measured.join(hit, "row", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    removed = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    cols = [
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), removed.alias("n_removed_words"),
        (~failed & (100 * (F.col("n_words") - removed) >= left_percent * F.col("n_words"))).alias("kept"),
        *(["row"] if with_row else []), *(["gone"] if with_lines else []),
    ]
    if not with_text:
        return out.select(*cols)
    texts = src.select(F.col("row").alias("at"), "text")
    return out.join(texts, F.col("row") == F.col("at")).select(*cols, without_lines(F.col("text"), F.col("gone")).alias("clean_text"))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose hashes are listed; the text itself where the list is null."""
    normal = lambda x: F.trim(F.regexp_replace(ascii_lower(x), r"[\x20\x09-\x0D]+", " "))
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(gone, F.xxhash64(normal(x))))
    return F.when(gone.isNull(), text).otherwise(F.array_join(lines, "\n"))


def filter_documents(df: DataFrame | Rows, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The rows of df that the rules keep, with df's columns; their texts without frequent lines, and chars_col, where df has it, the new length.

    Texts without frequent lines stay as they are.  Rows are as in quality_rules:
    null, empty and short texts go, repeated rows stay or go alike, other columns
    pass through under any name.  df is read twice; one that is no table is written first.
    """
    df = Rows.of(df)
    ruled = quality_rules(df, id_col=id_col, text_col=text_col, host_col=host_col, with_row=True, with_lines=True)
    kept = df.whole().join(ruled.where("kept").select("row", "gone"), "row")
    text = without_lines(F.col("d")[text_col], F.col("gone"))
    new = F.col("d").withField(text_col, text)
    if chars_col in df.columns:
        new = new.withField(chars_col, F.when(F.col("gone").isNull(), F.col("d")[chars_col]).otherwise(F.length(text).cast(df.schema[chars_col].dataType)))
    return kept.select(new.alias("d")).select("d.*")
