"""Operator 3: exact de-duplication by an extendible-hash index on shared files.

Every row gets a 64-bit key.  A key's owner task receives the texts of that key, once
per scanning task, and compares their bytes: equal texts become one link of the key's
chain, different ones further links.  A directory of key prefixes starts at the depth
that fits the number of links; a bucket that holds too many splits at the next bit in
which its keys differ, which doubles the directory where that bit lies below its
depth, until all buckets fit or hold a single chain.  Owner tasks write the buckets of
their key range to the shared folder.  Each row then goes from the directory to its
bucket, to its key's chain there, and to its link; kept, keep_id and group_size are
what that link says.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rows, ascii_lower, discard, materialise

#: Entries that a bucket holds before it splits.
BUCKET_ENTRIES = 4096


def normalised(text: Column) -> Column:
    """Null is empty; A-Z lower-cased."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def prefix_of(key: Column, depth: Column) -> Column:
    """The leading `depth` bits of a 64-bit key as a number from 0."""
    shifted = F.call_function("shiftrightunsigned", key, (F.lit(64) - depth).cast("int"))
    return F.when(depth > 0, shifted).otherwise(F.lit(0).cast("long"))


def _buckets(entries: DataFrame) -> DataFrame:
    """(depth, prefix, entries, low, high) of the buckets that entries (key, depth) fall into."""
    placed = entries.select("depth", prefix_of(F.col("key"), F.col("depth")).alias("prefix"), "key")
    return placed.groupBy("depth", "prefix").agg(F.count(F.lit(1)).alias("entries"), F.min("key").alias("low"), F.max("key").alias("high"))


def build_directory(entries: DataFrame, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """The directory (depth, prefix, entries, low, high) of an extendible hash over the keys of entries.

    It starts with buckets as full as can be on average, so that about half overfill.
    Each round parts the keys of overfull buckets at the first bit in which the
    bucket's keys differ and reads those buckets' keys only; a bucket of one key
    cannot split, its entries chain.
    """
    start = max(0, math.ceil(math.log2(max(1, entries.count()) / bucket_entries))) if bucket_entries else 0
    moving, done, spent = entries.select("key").withColumn("depth", F.lit(start)), [], []
    while True:
        counted = materialise(_buckets(moving), "exact-directory")
        full = (F.col("entries") > bucket_entries) & (F.col("low") != F.col("high"))
        done.append(counted.where(~full))
        over = counted.where(full)
        if over.isEmpty():
            break
        # the leading bits that low and high share, and one more
        shared = F.lit(64) - F.length(F.bin(F.col("low").bitwiseXOR(F.col("high"))))
        over = over.select(F.col("depth").alias("was"), "prefix", F.greatest(shared + 1, F.col("depth") + 1).cast("int").alias("deeper"))
        placed = moving.withColumns({"was": F.col("depth"), "prefix": prefix_of(F.col("key"), F.col("depth"))})
        moving = materialise(placed.join(over, ["was", "prefix"]).select("key", F.col("deeper").alias("depth")), "exact-splitting")
        spent.append(moving)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = materialise(out, "exact-directory")
    discard(*spent, *done)
    return out


def look_up(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """rows with the bucket of their key, named by its least key: a probe for each depth in use."""
    depths = sorted(r[0] for r in directory.select("depth").distinct().collect())  # at most 65 numbers
    if not depths:
        return rows.withColumn("bucket", F.lit(0).cast("long"))
    probes = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths])))
    return probes.withColumn("prefix", prefix_of(F.col("key"), F.col("depth"))).join(directory.select("depth", "prefix", F.col("low").alias("bucket")), ["depth", "prefix"]).drop("depth", "prefix")


def chain_links(rows: DataFrame) -> DataFrame:
    """(key, link, sha, n_bytes, keep, group_size): the different texts of each key.

    rows: at, norm, key.  The set of a key's texts grows by comparing bytes, first in
    the scanning tasks and then in the key's owner.  Where it holds one text, all rows
    of the key are copies of that, so that the key's counts are the link's.  Rows of
    the few keys with more texts come again and are compared with each link's bytes.
    """
    told = lambda text: (F.sha2(text, 256).alias("sha"), F.octet_length(text).alias("n_bytes"))
    chained = rows.groupBy("key").agg(F.collect_set("norm").alias("chain"), F.max("at").alias("keep"), F.count(F.lit(1)).alias("group_size"))
    # texts are written only where a chain has more than one
    chains = materialise(chained.select("key", *told(F.col("chain")[0]), "keep", "group_size", F.when(F.size("chain") > 1, F.col("chain")).alias("chain")), "exact-chains")
    alone = chains.where("chain is null").select("key", F.lit(0).alias("link"), "sha", "n_bytes", "keep", "group_size")
    # a table of its own, so that Spark knows how small it is and leaves the rows where they are
    links = materialise(chains.where("chain is not null").select("key", F.posexplode(F.array_sort("chain")).alias("link", "text")), "exact-collisions")
    shared = rows.join(links, "key").where(F.col("norm") == F.col("text"))
    met = shared.groupBy("key", "link").agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("group_size"))
    parted = links.select("key", "link", *told(F.col("text"))).join(met, ["key", "link"])
    out = materialise(alone.unionByName(parted), "exact-links")
    discard(chains, links)
    return out


def dedup_exact(
    df: DataFrame | Rows, *, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, bucket_entries: int = BUCKET_ENTRIES, with_row: bool = False
) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null is empty,
    and all empty texts are one group.  The row with the largest id stays; a null
    id is below every other, and of rows that share the largest id, or where all
    ids are null, only the first by the numbers of Rows is marked kept.  keep_id
    is null only in a group without any id.  Extra columns are ignored.

    Texts of any length and keys of any number of copies are whole: a copy costs an
    owner one text for each scanning task that holds it.

    df is read twice (three times where keys collide); one that is no table is written
    first.  with_row adds row, the number that Rows gives.  `key` replaces the 64-bit
    hash of `norm` (tests use a weak one, so that keys collide).  An owner holds the
    different texts of one key at a time.  A look-up finds a row's link by digest and
    length, which tell all links of the chain apart, or else the job fails.
    """
    rows = Rows.of(df).select(id=F.col(id_col), norm=normalised(F.col(text_col))).select(
        F.struct("id", (-F.col("row")).alias("turn")).alias("at"), "norm", (F.xxhash64("norm") if key is None else key).alias("key")
    )
    links = chain_links(rows)
    directory = build_directory(links, bucket_entries)
    # owners: each task has a range of keys, whole buckets at a time
    owned = look_up(links, directory).repartitionByRange("bucket").sortWithinPartitions("bucket", "key", "link")
    index = materialise(owned, "exact-index")
    discard(links)
    if not index.where("link > 0").isEmpty():
        twins = index.groupBy("key", "sha", "n_bytes").count().where("count > 1")
        if not twins.isEmpty():
            raise ValueError("two different texts of one key have the same SHA-256")
    probes = look_up(rows.select("at", "key", F.sha2("norm", 256).alias("sha"), F.octet_length("norm").alias("n_bytes")), directory)
    found = probes.join(index, ["bucket", "key", "sha", "n_bytes"])
    return found.select(
        F.col("at.id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", F.col("at").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"),
        *([(-F.col("at.turn")).alias("row")] if with_row else []),
    )
