"""Helpers shared by the operators: scratch tables, ASCII folding, batching."""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut, drop, shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: bytes -> bytes with A-Z lower-cased, for bytes.translate
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of text handled at once inside a task.
SLICE_BYTES = 3 << 20


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables in the shared folder: they cut the lineage and survive lost executors.
materialise, discard = cut, drop


def worker_state() -> dict:
    """What a Python worker keeps between its tasks: vocabularies and bounded memos, never results."""
    return sys.modules.setdefault("waymetric_worker_state", types.ModuleType("waymetric_worker_state")).__dict__


class Rows:
    """A table's rows under numbers that stay the same in every read of it.

    A row's number is a hash of its file's path plus its place in the file, so that it
    does not depend on how a scan is cut into partitions.  Files' ranges of numbers are
    checked not to meet.  Rows of one file are in the file's order, files in the order
    of their hashes.  What is no scan of Parquet files is written once and then read.
    """

    def __init__(self, df: DataFrame):
        self.df = df if _is_scan(df) else cut(df, "rows")
        self.seed = next(s for s in range(64) if not self._meet(s))

    @classmethod
    def of(cls, df: DataFrame | Rows) -> Rows:
        return df if isinstance(df, Rows) else cls(df)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self):
        return self.df.schema

    def select(self, **columns: Column) -> DataFrame:
        """row, and the given columns of the table under their new names."""
        meta = self.df.metadataColumn("_metadata")
        return self.df.select((self._first(meta["file_path"], self.seed) + meta["row_index"]).alias("row"), *[c.alias(k) for k, c in columns.items()])

    def whole(self) -> DataFrame:
        """(row, d): d has all columns as one struct, so that no helper column clashes with theirs."""
        return self.select(d=F.struct(*[F.col(f"`{c}`") for c in self.columns]))

    def _first(self, path: Column, seed: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), path), 2)

    def _meet(self, seed: int) -> bool:
        meta = self.df.metadataColumn("_metadata")
        files = self.df.select(meta["file_path"].alias("path"), meta["row_index"].alias("at")).groupBy("path").agg((F.max("at") + 1).alias("n"))
        first = self._first(F.col("path"), seed)
        after = F.lead(first).over(Window.orderBy(first))  # a row for each file
        return not files.select(first.alias("first"), "n", after.alias("after")).where(F.col("first") + F.col("n") > F.col("after")).isEmpty()


def _is_scan(df: DataFrame) -> bool:
    """Whether df is columns and rows of Parquet files, without joins, unions or expansions."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        return bool(df.select(df.metadataColumn("_metadata")["row_index"]).columns)
    except AnalysisException:  # files of another format
        return False


def text_bytes(df: DataFrame, col: str) -> int:
    """Bytes of all texts: sizes the numbers of key ranges and owner tasks."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(col)).cast("long")), F.lit(0)).alias("b")).first()["b"]


def slices(sizes, most_bytes: int = SLICE_BYTES, most_rows: int = 60000):
    """(from, to) row ranges of about most_bytes each; a longer row is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most_bytes or i - start >= most_rows):
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 values (wraps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def texts_as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def text_slices(column, most_bytes: int = SLICE_BYTES, most_rows: int = 60000):
    """(from, to, UTF-8 bytes of the texts) of slices of an Arrow string column, so that a batch is never held as Python objects whole."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()
    for lo, hi in slices(sizes, most_bytes, most_rows):
        yield lo, hi, texts_as_bytes(column.slice(lo, hi - lo))
