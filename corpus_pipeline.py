"""The training-data pipeline: quality rules, exact and near duplicates, repeated passages, packing.

Each stage gets what the one before it kept, works on all of it and gives the
columns of `documents`, but for the last, which gives packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymetric.llm.common import Rows, materialise
from waymetric.llm.exact_dedup import dedup_exact
from waymetric.llm.jaccard_join import jaccard_components
from waymetric.llm.packing import pack
from waymetric.llm.quality import filter_documents
from waymetric.llm.queries import tokenizer_file
from waymetric.llm.suffix_dedup import remove_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _kept(docs: Rows, rows: DataFrame) -> DataFrame:
    """The rows of docs whose numbers are listed."""
    return docs.whole().join(rows.select("row"), "row", "left_semi").select("d.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others lose the lines that are frequent in their source.

    Null, empty and short texts go.  Copies and repeated rows stay or go alike.  A
    null source is a source of its own.  Texts without frequent lines and all other
    columns stay as they are; n_chars follows a changed text.  An empty table stays one.
    """
    return filter_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z) the row with the largest doc_id stays.

    Null and empty texts are equal.  Of rows that share the largest doc_id, and where
    all ids are null, the first by the numbers of Rows stays.  Columns stay as they are; an empty table stays one.
    """
    docs = Rows.of(docs)
    return _kept(docs, dedup_exact(docs, with_row=True).where("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 connect, the one with the smallest doc_id stays.

    A null id is the smallest; of rows with the same id the first stays.  Null and
    empty texts link with nothing and stay.  Columns stay as they are; an empty table
    stays one.
    """
    docs = Rows.of(docs)
    return _kept(docs, jaccard_components(docs, with_row=True).where("row = keep_row"))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 100 bytes and more go from the texts; a document stays even if nothing of it does.

    The earliest place of a passage stays: by doc_id (null first), then row, then
    start.  A null text becomes an empty one; n_chars follows, other columns stay as
    they are.  An empty table stays one.
    """
    docs = Rows.of(docs)
    left = remove_repeats(docs, with_text=True, with_row=True).select("row", "kept_text")
    row = F.col("d").withField("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return docs.whole().join(left, "row").select(row.alias("d")).select("d.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences of 4096 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are documents of one id; repeated rows are documents of
    their own; other columns are ignored; an empty table gives no rows.
    """
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("suffix_array_dedup", repeats_stage),
    ("packing", packing_stage),
]

#: Similarity components, suffix matches and packing are not expressible; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
