"""Exact dedup with an extendible-hash index on shared files (DataFrame operations only).

Every text has a 64-bit key, the hash of its normalised form. Bucket b of local depth d owns the keys that begin with its
d bits, which is one contiguous key range. The directory starts with one bucket; it doubles, and overfull buckets are split,
until none holds more distinct keys than the capacity. The capacity rises with the number of keys so that the directory
stays within some 2**18 slots, whatever the input: buckets are sorted runs on disk and need not fit in memory.

Rows are routed to their bucket by the directory. Each owner task gets whole buckets, compares the bytes of the texts in
them (entries are grouped by the text itself), chains the entries of one key and writes its buckets to the shared folder
in key order. Texts whose key holds more than one in HOT of all rows, at most HOT keys, are combined in each task before
they move, so a text that a third of all rows repeat costs one row a task. Documents are answered from the bucket files by
key and SHA-256; the answers of the same hot keys are broadcast.

Defined cases: null text counts as empty; rows without doc_id stay only where no row of their group has one; equal doc_id
rows are answered each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import HOT, ascii_lower, documents, forget, join_hot, stash, text_or_empty

#: Bits by which open prefixes are lengthened at a time: first, and then for those still overfull.
FIRST, STEP = 12, 4
Prefix = tuple[int, int]  # depth, bits


def normalised(df: DataFrame) -> DataFrame:
    """doc_id, the text with A-Z lower-cased, its 64-bit key."""
    return text_or_empty(df).select("doc_id", ascii_lower(F.col("text")).alias("norm")).withColumn("key", F.xxhash64("norm"))


def prefix(key: Column, depth: int) -> Column:
    """The first depth bits of a key as a number."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(key, 64 - depth)


def split(fill: dict[int, int], top: Prefix, depth: int, capacity: int) -> tuple[list[Prefix], list[Prefix]]:
    """Splits bucket `top` while a part is overfull, down to `depth`: the buckets that fit, and the prefixes of that depth that do not.

    fill: distinct keys by prefix of that depth.
    """
    fit, over, todo = [], [], [top]
    while todo:
        d, bits = todo.pop()
        wide = depth - d
        if sum(fill.get(i, 0) for i in range(bits << wide, (bits + 1) << wide)) <= capacity:
            fit.append((d, bits))
        elif d == depth:
            over.append((d, bits))
        else:
            todo += [(d + 1, 2 * bits + 1), (d + 1, 2 * bits)]
    return fit, over


def slots_of(buckets: list[Prefix]) -> tuple[int, list[tuple[int, int, int]]]:
    """Global depth, and (slot, bucket, local depth) for every directory slot; buckets are numbered in key order."""
    depth = max(d for d, _ in buckets)
    out = []
    for k, (d, bits) in enumerate(sorted(buckets, key=lambda b: b[1] << (depth - b[0]))):
        out += [(i, k, d) for i in range(bits << (depth - d), (bits + 1) << (depth - d))]
    return depth, out


def directory(keys: DataFrame, capacity: int) -> tuple[int, DataFrame]:
    """Global depth, and slot, bucket, local_depth of every slot. keys: distinct.

    What reaches the driver: counts of at most 2**FIRST prefixes, then of 2**STEP for each overfull one (at most 2**16).
    """
    spark = keys.sparkSession
    capacity = max(capacity, keys.count() >> 16)
    buckets, open_, depth = [], [(0, 0)], FIRST
    while open_:
        some = keys
        if open_ != [(0, 0)]:
            wanted = spark.createDataFrame([(bits,) for _, bits in open_], "bits long")
            some = keys.join(F.broadcast(wanted), prefix(F.col("key"), open_[0][0]) == F.col("bits"), "left_semi")
        fill = {r.p: r.n for r in some.groupBy(prefix(F.col("key"), depth).alias("p")).agg(F.count("*").alias("n")).collect()}
        parts = [split(fill, top, depth, capacity) for top in open_]
        buckets += [b for fit, _ in parts for b in fit]
        open_ = [b for _, over in parts for b in over]
        depth += STEP
    depth, slots = slots_of(buckets)
    return depth, spark.createDataFrame(slots, "slot long, bucket int, local_depth int")


def build_index(df: DataFrame, digests: DataFrame, total: int, capacity: int) -> DataFrame:
    """The index: bucket, local_depth, key, chain, sha, keep_id, group_size; whole buckets a file, in key order."""
    counts = stash(digests.groupBy("key").agg(F.count("*").alias("n")), "keys")
    depth, slots = directory(counts.select("key"), capacity)
    hot = F.broadcast(counts.where(F.col("n") > max(1, total // HOT)).select("key"))  # at most HOT keys
    routed = normalised(df).withColumn("slot", prefix(F.col("key"), depth)).join(F.broadcast(slots), "slot")
    where = ["bucket", "local_depth", "key", "norm"]
    many = routed.join(hot, "key", "left_semi").groupBy(*where).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    few = routed.join(hot, "key", "left_anti").select(*where, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    owned = few.unionByName(many).repartition("bucket")  # a task owns whole buckets; what follows moves no row
    entries = owned.groupBy(*where).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    entries = entries.select("bucket", "local_depth", "key", F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"), "keep_id", "group_size")
    chained = entries.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha")) - 1)
    index = stash(chained.sortWithinPartitions("bucket", "key", "chain"), "buckets")
    forget(counts)
    return index


def exact_dedup(df: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row per document: doc_id, keep_id (largest doc_id of its group), group_size, kept, text_sha256, bucket, chain."""
    digests = stash(normalised(df).select("doc_id", "key", F.unhex(F.sha2(F.col("norm"), 256)).alias("sha")), "digests")
    total = digests.count()
    hit = join_hot(digests, build_index(df, digests, total, capacity), ["key", "sha"], "group_size", total)
    return hit.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "local_depth", "chain",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
