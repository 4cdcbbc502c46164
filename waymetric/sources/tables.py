"""Readers with explicit schemas, and writers."""

from __future__ import annotations

import codecs
import functools
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import params as P
from ..checkpoints import cut
from ..functions.geometry import POLYGONS
from ..functions.scalars import normalize_category, pad_code

# Headers of the input files and the library's column names.
REGISTRY_COLUMNS = {
    "INSTITUCION": "institution", "COD_IPRESS": "facility_code", "NOMBRE": "facility_name", "CLASIFICACION": "classification", "TIPO_ESTABLECIMIENTO": "establishment_type",
    "DEPARTAMENTO": "department", "PROVINCIA": "province", "DISTRITO": "district", "UBIGEO": "ubigeo", "DIRECCION": "address", "CATEGORIA": "category_raw", "ESTADO": "status_raw",
    "NORTE": "lat", "ESTE": "lon",
}
PLACE_COLUMNS = {
    "CODCP": "facility_code", "NOMCP": "facility_name", "DEP": "department", "PROV": "province", "DIST": "district", "UBIGEO": "ubigeo", "XGD": "lon", "YGD": "lat", "CAPITAL": "is_capital",
}
BOUNDARY_COLUMNS = {"IDDIST": "ubigeo", "NOMBDEP": "department", "NOMBPROV": "province", "NOMBDIST": "district"}


def standardize(df: DataFrame, columns: dict[str, str], *keep: str) -> DataFrame:
    """Renames known columns and keeps others that are asked for, makes coordinates doubles (NaN is null), pads the district code."""
    found = {k.upper(): k for k in df.columns}
    out = df.select(*[F.col(found[k]).alias(v) if k in found else F.lit(None).cast("string").alias(v) for k, v in columns.items()], *keep)
    for c in ("lat", "lon"):
        out = out.withColumn(c, F.when(~F.isnan(F.expr(f"try_cast({c} AS double)")), F.expr(f"try_cast({c} AS double)")))
    return out.withColumn("ubigeo", pad_code(F.col("ubigeo").cast("string")))


def standardize_registry(df: DataFrame, *keep: str) -> DataFrame:
    return standardize(df, REGISTRY_COLUMNS, *keep).withColumn("category", normalize_category(F.col("category_raw")))


def standardize_places(df: DataFrame) -> DataFrame:
    return standardize(df, PLACE_COLUMNS)


def read_registry(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Semicolons, header, all columns as text; UTF-8 with or without a byte order mark, or else Latin-1, as the file's own bytes say."""
    encoding = encoding or file_encoding(spark, path)
    return standardize_registry(spark.read.option("sep", ";").option("header", True).option("encoding", encoding).csv(path))


def file_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line is valid, Latin-1 otherwise (which reads any bytes): one pass over the lines."""
    return "UTF-8" if spark.read.text(path).where(~F.is_valid_utf8(F.col("value").cast("binary"))).isEmpty() else "ISO-8859-1"


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return standardize_places(spark.read.option("header", True).csv(path) if ".csv" in path else spark.read.parquet(path))


def flatten_boundaries(features: DataFrame) -> DataFrame:
    """features: properties struct, geometry struct<type, coordinates as JSON text>.  One row per district, polygons null where there are none."""
    one = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("geometry.coordinates", POLYGONS)
    polygons = F.when(F.col("geometry.type") == "Polygon", F.array(one)).when(F.col("geometry.type") == "MultiPolygon", many)
    return features.select(*[F.col(f"properties.{k}").alias(v) for k, v in BOUNDARY_COLUMNS.items()], polygons.alias("polygons"))


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON FeatureCollections, however large a file and however its lines are broken; see array_objects.

    A broken feature is an error.  Objects of other types are left out.
    """
    properties = "struct<" + ",".join(f"{k}:string" for k in BOUNDARY_COLUMNS) + ">"
    schema = f"struct<type:string,properties:{properties},geometry:struct<type:string,coordinates:string>>"
    objects = array_objects(spark, path).where(F.col("object").startswith("{"))
    features = objects.select(F.from_json("object", schema, {"mode": "FAILFAST"}).alias("f")).where("coalesce(f.type, 'Feature') = 'Feature'")
    return flatten_boundaries(features.select("f.properties", "f.geometry"))


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, object): the objects in the top-level arrays of JSON files that hold one object each, as texts.

    A file is cut at closing braces, so that Spark reads it in splits wherever its lines
    break.  What a piece does to the depth depends on whether it begins within a string:
    a split sums both cases, and the splits' totals, one row each, tell which one holds
    and how deep a split begins.  An object ends where the depth is back at one brace and
    one bracket.  Only an object's own text meets in one group.  Members before an array
    must not hold arrays of objects themselves; an object that follows other kinds of
    values in its array keeps them in front of it.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    meta = raw.metadataColumn("_metadata")
    raw = raw.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    parts = F.split(F.regexp_replace("piece", r"(?s)\\.", ""), '"', -1)  # between the quotes, without escapes
    in_split = Window.partitionBy("file", "start").orderBy("at")
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    sums = raw.withColumn("parts", parts).withColumn("quotes", F.size("parts") - 1)
    sums = sums.withColumn("seen", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    for inside in (0, 1):  # whether the split begins within a string
        plain = F.array_join(F.filter("parts", lambda _, i: (i + F.col("seen") + inside) % 2 == 0), "")  # noqa: B023
        ends = F.when((F.col("seen") + F.col("quotes") + inside) % 2 == 0, 1).otherwise(0)  # the brace that ends the piece is no text
        count = lambda c, text=plain: F.length(text) - F.length(F.translate(text, c, ""))
        sums = sums.withColumns({f"ends{inside}": ends, f"braces{inside}": count("{") - ends, f"brackets{inside}": count("[") - count("]")})
    depths = {f"{k}{i}": F.sum(f"{k}{i}").over(in_split) for k in ("braces", "brackets") for i in (0, 1)}
    pieces = cut(sums.drop("parts").withColumns(depths), "json-pieces")

    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    sofar = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    splits = pieces.groupBy("file", "start").agg(F.sum("quotes").alias("quotes"), *[F.max_by(k, "at").alias(k) for k in depths])
    splits = splits.withColumn("inside", sofar("quotes") % 2)
    held = lambda k: F.when(F.col("inside") == 0, F.col(f"{k}0")).otherwise(F.col(f"{k}1"))
    splits = splits.select("file", "start", "inside", *[held(k).alias(k) for k in ("braces", "brackets")])
    splits = splits.select("file", "start", "inside", *[sofar(k).alias(f"{k}_before") for k in ("braces", "brackets")])
    done = (held("ends") == 1) & (held("braces") + F.col("braces_before") == 1) & (held("brackets") + F.col("brackets_before") == 1)
    placed = pieces.join(splits, ["file", "start"]).select("file", "start", "at", "piece", done.cast("long").alias("done"))
    numbers = placed.groupBy("file", "start").agg(F.sum("done").alias("n")).select("file", "start", sofar("n").alias("first"))
    numbered = placed.join(numbers, ["file", "start"]).withColumn("number", F.col("first") + F.coalesce(F.sum("done").over(before), F.lit(0)))
    whole = numbered.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "at", "piece"))).alias("p"), F.max("done").alias("whole")).where("whole = 1")
    text = F.concat(F.array_join(F.col("p.piece"), "}"), F.lit("}"))
    # what stands before the object: a comma, or at the first one the beginning of the file up to its array
    head = r'(?s)^(?:[^"\[]++|"(?:[^"\\]++|\\.)*+"|\[(?!\s*\{))*+\[\s*(?=\{)'
    first = F.when(text.rlike(r"^\s*,\s*\{") & (F.col("number") > 0), F.regexp_replace(text, r"^\s*,\s*", "")).otherwise(F.regexp_replace(text, head, ""))
    return whole.select("file", "number", first.alias("object"))


def read_population(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Census files of all departments as one table; blank district codes are null."""
    schema = "departamento string, provincia string, distrito string, poblacion_2017 long, ubigeo string"
    return population_union([spark.read.schema(schema).option("header", True).csv(p) for p in paths])


def population_union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.withColumn("ubigeo", F.when(F.trim("ubigeo") != "", F.col("ubigeo")))


def read_ways(spark: SparkSession, path: str, bbox: P.BoundingBox) -> DataFrame:
    return ways_in_bbox(spark.read.parquet(path), bbox)


def ways_in_bbox(ways: DataFrame, bbox: P.BoundingBox) -> DataFrame:
    """Ways with a class whose own box (minx, miny, maxx, maxy) overlaps; the filter reaches the Parquet scan."""
    return ways.where(f"highway is not null and maxx >= {bbox.lon_min} and minx <= {bbox.lon_max} and maxy >= {bbox.lat_min} and miny <= {bbox.lat_max}")


def latest_snapshot(resources: DataFrame, prefix: str, required: bool = False) -> DataFrame:
    """The url of the newest dated CSV file `<prefix>_DD-MM-YYYY.csv`; if there is none, no row, or an error where one is required."""
    pattern = rf"(?i){prefix}_(\d{{2}})-(\d{{2}})-(\d{{4}})\.csv$"
    part = lambda i: F.regexp_extract("url", pattern, i).cast("int")
    dated = resources.where((F.lower("format") == "csv") & F.col("url").rlike(pattern))
    newest = dated.agg(F.max(F.struct(part(3).alias("year"), part(2).alias("month"), part(1).alias("day"), "url")).alias("m"))
    if required:
        newest = newest.select(F.coalesce("m", F.raise_error(F.lit(f"no file {prefix}_DD-MM-YYYY.csv among the resources")).cast(newest.schema["m"].dataType)).alias("m"))
    return newest.where("m is not null").select("m.url", "m.year", "m.month", "m.day")


def _decodes(content: Column, encoding: str) -> Column:
    """Whether bytes are text of an encoding in which a line feed is one byte of its own; each byte as a character of Latin-1 tells."""
    name = codecs.lookup(encoding).name
    if name == "utf-8":
        return F.is_valid_utf8(content)
    if name not in P.UNUSED_BYTES:
        raise ValueError(f"no rule for {encoding}")
    unused = P.UNUSED_BYTES[name]
    return ~F.decode(content, "ISO-8859-1").rlike(f"[{unused}]") if unused else content.isNotNull()


def _first_that_decodes(df: DataFrame, candidates: tuple[str, ...]) -> DataFrame:
    """Adds encoding and failed to df, whose columns _0, _1, ... say which candidates decode."""
    used = F.coalesce(*[F.when(F.col(f"_{i}"), F.lit(i)) for i in range(len(candidates))], F.lit(len(candidates)))
    names = F.array(*[F.lit(c) for c in candidates])
    return df.withColumns({"encoding": F.get(names, used), "failed": F.slice(names, F.lit(1), used)}).drop(*[f"_{i}" for i in range(len(candidates))])


def detect_encoding(files: DataFrame, candidates: tuple[str, ...] = P.ENCODINGS) -> DataFrame:
    """files: path, content.  Adds the first candidate that decodes all bytes, and which ones failed before it; null content fails all."""
    return _first_that_decodes(files.withColumns({f"_{i}": F.coalesce(_decodes(F.col("content"), c), F.lit(False)) for i, c in enumerate(candidates)}), candidates)


def detect_file_encoding(spark: SparkSession, path: str, candidates: tuple[str, ...] = P.ENCODINGS) -> DataFrame:
    """(path, encoding, failed) of each file below path, as detect_encoding says it.

    No character of these encodings spans a line feed, so that a file is text where all
    its lines are: splits are judged apart, and no task holds a file.  Spark skips empty
    files, which have no row.
    """
    lines = spark.read.text(path)
    lines = lines.select(lines.metadataColumn("_metadata")["file_path"].alias("path"), F.col("value").cast("binary").alias("line"))
    said = lines.groupBy("path").agg(*[F.bool_and(_decodes(F.col("line"), c)).alias(f"_{i}") for i, c in enumerate(candidates)])
    return _first_that_decodes(said, candidates)


def _published(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """(keys, run) of the partitions that are complete, the first run of each; None where nothing was ever published."""
    manifest = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    store = manifest.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(manifest) or not any(f.getPath().getName().startswith("run=") for f in store.listStatus(manifest)):
        return None
    return spark.read.parquet(f"{path}/manifest").groupBy(*keys).agg(F.min("run").alias("run"))


def write_missing_partitions(df: DataFrame, path: str, keys: list[str]) -> int:
    """Writes the partitions of df (by keys, null ones too) that path does not have yet, and returns how many rows these are.

    A call writes below data/run=<its name>, and publishes what it wrote by one small
    file below manifest, which appears whole or not at all.  Readers trust the manifest
    alone: what a call that died has left is never read, and its partitions are written
    again by the next call.  Where two calls wrote a partition at the same time, the one
    whose name comes first counts.
    """
    spark = df.sparkSession
    there = _published(spark, path, keys)
    if there is not None:
        own = lambda k: F.when(F.col(k).cast("string") != "", F.col(k))  # noqa: E731  blank keys are written as null
        same = functools.reduce(lambda a, b: a & b, [own(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        df = df.join(there.select(*[F.col(k).cast(df.schema[k].dataType).alias(f"_{k}") for k in keys]), same, "left_anti")
    run = datetime.now(UTC).strftime("%Y%m%dT%H%M%S%f-") + uuid.uuid4().hex
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("n")).write.partitionBy(*keys).parquet(f"{path}/data/run={run}")
    n = written.get["n"]
    if n:
        own = spark.read.schema(df.schema).parquet(f"{path}/data/run={run}").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
        own.coalesce(1).write.parquet(f"{path}/manifest/run={run}")  # a row for each partition
    return n


def read_partitions(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The rows of all partitions that write_missing_partitions has published below path, with the columns of schema; none before it has."""
    there = _published(spark, path, keys)
    if there is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField("run", StringType())])).parquet(f"{path}/data")
    same = functools.reduce(lambda a, b: a & b, [rows[k].eqNullSafe(there[k].cast(schema[k].dataType)) for k in keys])
    return rows.join(there, same & (rows["run"] == there["run"]), "left_semi").select(*schema.names)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", one_file: bool = False) -> None:
    """one_file is for small results only."""
    out = (df.coalesce(1) if one_file else df).write.mode("overwrite")
    out.option("header", True).csv(path) if fmt == "csv" else out.parquet(path)
