"""Uniform shuffle with exact shard sizes: hypergeometric communication matrix, local permutation, exchange, permutation.

Rows are pinned to numbered partitions by a checkpoint. How many rows of partition i go to block j is row i of a random
matrix with the partition sizes as row sums and the block sizes as column sums, drawn from the multivariate
hypergeometric law, so every arrangement of rows is as likely as any other. A shard is a run of blocks of at most
block_rows rows, or fewer if rows are long: a block is expected to hold block_bytes bytes at most. A block is a range of slots of its shard, which bounds what one task sorts, at any shard size. Each
task draws its own matrix row by splitting the column sums down a binary tree over the partitions, with a generator
seeded by the tree node; no process holds the matrix.

Law `rows`: shard sizes differ by one at most. Defined cases: an empty table gives no rows; repeated rows are rows like
any other; all columns are carried; null text has size 1 and crc32 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import documents, scratch_dir, sorted_groups

NUMPY_LIMIT = 900_000_000


def draw_one(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric draw for totals that numpy refuses: inversion outward from the mode."""
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    total = good + bad
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (total + 2)))
    sd = math.sqrt(max(1.0, n * (good / total) * (bad / total) * (total - n) / max(1, total - 1)))
    reach = int(40 * sd) + 50
    a, b = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logp = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(logp - logp.max())
    return a + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right"))


def draw(rng: np.random.Generator, columns: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows fall to each column, out of columns[j] free places each."""
    total = int(columns.sum())
    if total < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(columns, n, method="marginals")
    out, left = np.zeros_like(columns), n
    for j, c in enumerate(columns[:-1].tolist()):
        total -= c
        out[j] = draw_one(rng, c, total, left) if left else 0
        left -= int(out[j])
    out[-1] = left
    return out


def matrix_row(sizes: list[int], blocks: np.ndarray, which: int, seed: int) -> np.ndarray:
    """Row `which` of the communication matrix; every caller with the same arguments sees the same matrix."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    lo, hi, columns = 0, len(sizes), blocks.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = draw(np.random.default_rng([seed, lo, hi]), columns, int(ends[mid] - ends[lo]))
        lo, hi, columns = (lo, mid, left) if which < mid else (mid, hi, columns - left)
    return columns


def block_plan(rows: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each block: its size, its shard, its first slot."""
    size, shard, first = [], [], []
    for s in range(shards):
        n = rows // shards + (s < rows % shards)
        parts = max(1, -(-n // block_rows))
        edges = [n * i // parts for i in range(parts + 1)]
        size += [b - a for a, b in zip(edges, edges[1:], strict=False)]
        shard += [s] * parts
        first += edges[:-1]
    return np.array(size, dtype=np.int64), np.array(shard, dtype=np.int32), np.array(first, dtype=np.int64)


def row_bytes(df: DataFrame):
    """About the bytes of a row: of its texts, and 8 for each other plain column."""
    held = lambda f: F.octet_length(f"`{f.name}`" if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.col(f"`{f.name}`").cast("string"))
    parts = [F.lit(8) if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)) else F.coalesce(held(f), F.lit(0)) for f in df.schema]
    return sum((p.cast("long") for p in parts), F.lit(0).cast("long"))


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 20_231, block_rows: int = 65_536, block_bytes: int = 32 << 20) -> DataFrame:
    """df with shard (0 to shards-1) and slot (gapless from 0 in each shard), in uniformly random order.

    Columns of df that are called shard or slot are replaced.
    """
    spark, df = df.sparkSession, df.drop("shard", "slot")
    spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    pinned = df.checkpoint()
    found = pinned.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(row_bytes(pinned)).alias("bytes")).collect()  # a row a partition
    counts = {r.p: r.n for r in found}
    sizes = [counts.get(p, 0) for p in range(max(counts, default=-1) + 1)]
    fitting = block_bytes * sum(sizes) // max(1, sum(r.bytes for r in found))  # rows of the mean length
    blocks, shard_of, first = block_plan(sum(sizes), shards, max(1, min(block_rows, fitting)))
    carried = [f.name for f in df.schema]
    taken, mark = {c.lower() for c in carried}, "__"
    while any(f"{mark}{n}" in taken for n in ("block", "from", "at")):
        mark += "_"
    extra = [f"{mark}{n}" for n in ("block", "from", "at")]  # names that df has not
    sent_schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in extra)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        if p >= len(sizes) or not sizes[p]:
            yield from ()
            return
        to = np.repeat(np.arange(len(blocks)), matrix_row(sizes, blocks, p, seed))
        np.random.default_rng([seed, 1, p]).shuffle(to)
        at = 0
        for b in batches:
            n = b.num_rows
            own = [pa.array(to[at : at + n]), pa.array(np.full(n, p, dtype=np.int64)), pa.array(np.arange(at, at + n))]
            at += n
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*b.schema.names, *extra])

    placed_schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, extra[0]):
            k = t.column(extra[0])[0].as_py()
            slot = first[k] + np.random.default_rng([seed, 2, k]).permutation(t.num_rows)
            t = t.select(carried).append_column("shard", pa.array(np.full(t.num_rows, shard_of[k], dtype=np.int32))).append_column("slot", pa.array(slot))
            yield from t.combine_chunks().to_batches()

    sent = pinned.mapInArrow(deal, sent_schema)
    return sent.repartition(len(blocks), extra[0]).sortWithinPartitions(*extra).mapInArrow(settle, placed_schema)


def shard_documents(df: DataFrame, shards: int = 16, **options) -> DataFrame:
    """doc_id, size, text_crc32 and the place of every document, from the whole documents that reached the shards."""
    placed = shuffle_into_shards(df, shards, **options)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = [F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    return placed.select(*digest, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
