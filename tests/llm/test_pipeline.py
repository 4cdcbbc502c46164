"""The pipeline's stages on a small table, each held against its own input."""

import random

import corpus_pipeline
from waymetric.llm.queries import ORACLES, QUERIES

from .test_operators import brute_components, brute_repeats, low


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_jaccard_join", "suffix_array_dedup", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_stages(spark, tmp_path):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(80)) for _ in range(20)]
    texts += [texts[0], texts[0].upper(), texts[1] + " end", "too short", None, texts[2] + "\n" + passage, texts[3] + "\n" + passage]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], schema)
    columns, sf_dir = docs.columns, str(tmp_path)
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    kept = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, sf_dir).write.parquet(f"{sf_dir}/{name}")
        kept = spark.read.parquet(f"{sf_dir}/{name}")
        tables.append(kept)
        assert name == "packing" or kept.columns == columns
    quality, exact, near, left = ({x.doc_id: x.text for x in t.collect()} for t in tables[:4])
    assert quality == {i: t for i, t in enumerate(texts) if t and t != "too short"}
    last = {low(t.encode()): i for i, t in sorted(quality.items())}
    assert exact == {i: quality[i] for i in last.values()}
    assert near == {i: exact[i] for i, (_, c) in brute_components(sorted(exact.items())).items() if i == c}
    assert len(near) < len(exact) < len(quality)
    assert left == {i: x[4] for i, x in brute_repeats(sorted(near.items()), 100).items()} and left != near
    assert {x.doc_id for x in tables[4].collect()} == set(left)
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((x.doc_id, x.start, x.ids_crc32) for x in again) == sorted((x.doc_id, x.start, x.ids_crc32) for x in tables[4].collect())


WIDE = "doc_id long, text string, lang string, source string, n_chars int, row long, at long, d string, kept_text string, gone string, keep_row long, `odd name` string"


def wide(spark, rows, path):
    """Documents with extra columns that clash with the stages' own names."""
    spark.createDataFrame([(i, t, "en", s, len(t or ""), 777, 778, "d", "k", "g", 779, f"x{k}") for k, (i, t, s) in enumerate(rows)], WIDE).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_stages_with_clashing_columns_repeated_and_null_ids(spark, tmp_path):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    texts = [" ".join(word() for _ in range(40)) for _ in range(6)]
    rows = [(1, texts[0], "a"), (1, texts[0], "a"), (None, texts[1], None), (None, texts[1], None), (2, texts[2], "a"), (None, texts[2] + " more", "a"), (3, None, "a"), (3, "", None)]
    rows += [(7, f"a line that many share\n{texts[3]} {i} {word()} {word()}" if i else texts[4] + "\n" + texts[5], "b") for i in range(25)]
    docs = wide(spark, rows, f"{tmp_path}/wide")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out = docs.collect()
        counts.append(len(out))
        assert docs.columns == [c.split("`")[1] if "`" in c else c.split()[0] for c in WIDE.split(", ")] and docs.schema["n_chars"].dataType.simpleString() == "int"
        assert all((x.row, x.at, x.d, x.kept_text, x.gone, x.keep_row, x.n_chars) == (777, 778, "d", "k", "g", 779, len(x.text)) for x in out)
        assert len({x["odd name"] for x in out}) == len(out)
        assert not any("that many share" in x.text for x in out)
    assert counts[0] == 31 and counts[1] == 29 and counts[2] < counts[1] and counts[3] == counts[2]
    pieces = corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).collect()
    assert len(pieces) == counts[3]


def test_stages_on_an_empty_table_and_a_single_row(spark, tmp_path):
    empty = wide(spark, [], f"{tmp_path}/empty")
    single = wide(spark, [(5, " ".join(f"w{i}" for i in range(6000)), "s")], f"{tmp_path}/single")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
        out = stage(spark, single, str(tmp_path)).collect()
        assert {x.doc_id for x in out} == {5} and (name == "packing" or out[0].text == single.first().text), name
    assert sum(x.length for x in out) == out[0].doc_tokens > 4096
