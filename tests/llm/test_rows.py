"""Rows keep their numbers however a scan is cut: results don't depend on partitions that change between two reads."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from waymetric.llm.common import Rows
from waymetric.llm.exact_dedup import dedup_exact
from waymetric.llm.jaccard_join import jaccard_components
from waymetric.llm.quality import filter_documents
from waymetric.llm.suffix_dedup import remove_repeats
from waymetric.llm.url_filter import PAGE_RULES, filter_urls, rules_frame
from waymetric.llm.warc import plan_records

CUT = "spark.sql.files.minPartitionNum"


@pytest.fixture()
def table(spark, tmp_path):
    texts = [f"document {i % 40} of some words " + " ".join(f"w{(i % 40) * k}" for k in range(30)) for i in range(600)]
    rows = [(i // 2, t, f"s{i % 3}", len(t), f"http://x.org/{i}", t * 40) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, url string, html string").repartition(12, "doc_id").write.parquet(f"{tmp_path}/t")
    yield spark.read.parquet(f"{tmp_path}/t")
    spark.conf.unset(CUT)


def rebuilt(spark, table, build):
    """The rows of build(table), built under one cut of the scan and read under another, and those of one cut only."""
    out = []
    for before, after in ((1, 12), (12, 12)):
        spark.conf.set(CUT, before)
        df = build(table)
        spark.conf.set(CUT, after)
        out.append(sorted(map(str, df.collect())))
    return out


@pytest.mark.parametrize(
    "build",
    [
        lambda t: Rows.of(t).select(id=F.col("doc_id")),
        lambda t: dedup_exact(t, with_row=True),
        lambda t: filter_documents(t),
        lambda t: remove_repeats(t, with_text=True, with_row=True),
        lambda t: jaccard_components(t, with_row=True),
        lambda t: plan_records(t, id_col="doc_id", url_col="url", payload_col="html"),
        lambda t: filter_urls(t, rules_frame(t.sparkSession, PAGE_RULES), id_col="doc_id"),
        lambda t: corpus_pipeline.exact_stage(t.sparkSession, t, ""),
        lambda t: corpus_pipeline.near_stage(t.sparkSession, t, ""),
        lambda t: corpus_pipeline.repeats_stage(t.sparkSession, t, ""),
    ],
    ids=["rows", "exact", "filter", "repeats", "near", "warc", "urls", "exact-stage", "near-stage", "repeats-stage"],
)
def test_partitions_that_change_between_reads(spark, table, build):
    changed, same = rebuilt(spark, table, build)
    assert changed == same and len(same) >= 40


def test_numbers_are_unique_and_in_order_within_a_file(spark, table, tmp_path):
    rows = Rows.of(table.where("doc_id > 3"))
    got = rows.select(id=F.col("doc_id")).collect()
    assert len({r.row for r in got}) == len(got) == 592 and all(r.row >= 0 for r in got)
    single = spark.range(500).coalesce(1)
    single.write.parquet(f"{tmp_path}/one")
    ids = [r.id for r in Rows.of(spark.read.parquet(f"{tmp_path}/one")).select(id=F.col("id")).orderBy("row").collect()]
    assert ids == list(range(500))
    # joins and frames without files are written first, and so number their own rows
    joined = table.join(table.select("doc_id"), "doc_id")
    got = Rows.of(joined).select(id=F.col("doc_id")).collect()
    assert len({r.row for r in got}) == len(got) == 1200
    assert Rows.of(single.where("id < 0")).select(id=F.col("id")).count() == 0


def test_url_of_very_many_labels(spark):
    long = "http://" + "a." * 200_000 + "example.org/es/1"
    rows = filter_urls(spark.createDataFrame([(1, long), (2, "http://org/")], "page_id long, url string"), rules_frame(spark, PAGE_RULES)).collect()
    assert {(r.page_id, r.rule) for r in rows} == {(1, "example.org/es/"), (2, "org/")}
