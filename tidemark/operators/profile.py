"""Dataset profile: dense statistics, users, labels over time, lengths, splits by row order or row group, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.sequences import ratio
from tidemark.operators.holdout import hash_bucket
from tidemark.operators.ranks import as_columns, block_of, quantiles


def dense_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, values, mean, std, min, max, median, p99 (of finite values), NaN and infinite counts, all-zero rows."""
    values = df.select(F.explode(column).alias("v")).select(F.col("v").cast("double").alias("v"))
    good = ~F.isnan("v")
    v = F.when(good, F.col("v"))
    stats = values.agg(F.count("*").alias("n_values"), F.avg(v).alias("mean"), F.stddev(v).alias("std"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.sum(F.when(good, 0).otherwise(1)).cast("long").alias("nan_values"), F.sum(F.when(F.abs("v") == float("inf"), 1).otherwise(0)).cast("long").alias("inf_values"))
    cuts = as_columns(quantiles(values.where(F.abs("v") < float("inf")), [], [0.5, 0.99], "v"), [], ["p50", "p99"])
    rows = df.agg(F.count("*").alias("n_rows"), F.sum(F.when(F.forall(column, lambda x: x == 0), 1).otherwise(0)).cast("long").alias("zero_rows"), F.max(F.size(column)).alias("width"))
    return rows.crossJoin(stats).crossJoin(cuts)  # one row each


def labels_by_day(rows: DataFrame, ts: str) -> DataFrame:
    day = F.to_date(F.timestamp_seconds(ts)).alias("day")
    pos = F.sum(F.when(F.coalesce("label_type", F.lit(0)) == 2, 1).otherwise(0)).cast("long")
    return rows.groupBy(day).agg(F.count("*").alias("n"), pos.alias("pos"), ratio(pos, F.count("*")).alias("pos_rate"))


def user_overlap(train: DataFrame, valid: DataFrame, user: str) -> DataFrame:
    """One row: users of each side and of both."""
    a, b = train.select(user).distinct(), valid.select(user).distinct()
    both = a.withColumn("t", F.lit(1)).join(b.withColumn("v", F.lit(1)), user, "full_outer")
    return both.agg(F.count("t").alias("train_users"), F.count("v").alias("valid_users"), F.count(F.when(F.col("t").isNotNull() & F.col("v").isNotNull(), 1)).alias("both"))


def rows_per_user(rows: DataFrame, user: str) -> DataFrame:
    return rows.groupBy(user).agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("users"))


def truncation(per: DataFrame, cap: int) -> DataFrame:
    """domain, truncated and empty rates from the counts of sample lengths."""
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    total = F.sum("n")
    return per.groupBy("domain").agg(total.alias("n"), ratio(of(F.col("raw_len") > cap), total).alias("truncated"), ratio(of(F.col("raw_len") == 0), total).alias("empty"))


def recency_signs(tokens: DataFrame) -> DataFrame:
    """Share of tokens before, at and after the row time, and ts range, by domain."""
    d = F.col("row_ts") - F.col("ts")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return tokens.where("ts > 0").groupBy("domain").agg(n(d > 0).alias("before"), n(d == 0).alias("at"), n(d < 0).alias("after"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def split_points(groups: int, valid_ratio: float, train_ratio: float = 1.0, disjoint: bool = False) -> tuple[int, int]:
    """(groups that train, first group that validates) for `groups` row groups in order.

    The last max(1, int(groups * valid_ratio)) groups validate. With train_ratio under 1 the groups that training leaves
    out join validation, unless disjoint is set.
    """
    valid = max(1, int(groups * valid_ratio))
    train = groups - valid
    if train_ratio < 1:
        used = max(1, int(train * train_ratio))
        return used, (train if disjoint else used)
    return train, train


def row_groups(df: DataFrame, order: list[str], rows_per_group: int) -> DataFrame:
    """df with `row_group`, the ordinal of its run of rows_per_group rows in the given order.

    Ranks come from counts of value ranges of the first (numeric) order column plus a rank inside each range, so no task
    sorts the whole table.
    """
    span = df.agg(F.min(order[0]).alias("__low"), F.max(order[0]).alias("__high"))  # one row
    placed = df.crossJoin(F.broadcast(span)).withColumn("__part", block_of(F.col(order[0]), F.col("__low"), F.col("__high"))).drop("__low", "__high")
    placed = placed.withColumn("__key", F.xxhash64(*order))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order, "__key")) - 1
    got = placed.join(F.broadcast(before), "__part").withColumn("row_group", F.floor((F.col("__before") + rank) / rows_per_group).cast("int"))
    return got.drop("__key", "__part", "__before")


#: Up to this many row groups their bounds are broadcast (8 bytes each); beyond, they are joined by file.
BROADCAST_GROUPS = 1_000_000


def footer_rows(files: DataFrame) -> DataFrame:
    """file, ends (rows up to the end of each of its row groups): footers are read by the tasks, through the file's own file system."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for b in batches:
            ends = []
            for uri in b.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as f:
                    footer = pq.ParquetFile(f).metadata
                sizes = [footer.row_group(g).num_rows for g in range(footer.num_row_groups)]
                ends.append([sum(sizes[: k + 1]) for k in range(len(sizes))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends, pa.list_(pa.int64()))], names=["file", "ends"])

    return files.select("file").mapInArrow(run, "file string, ends array<long>")


def file_row_groups(spark, path: str) -> DataFrame:
    """df with `row_group`: the Parquet row group each row lies in (files by name), from footer sizes and the row's index in its file."""
    df = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    footers = footer_rows(df.select(F.col("__file").alias("file")).distinct())
    first = F.coalesce(F.sum(F.size("ends")).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    side = footers.select(F.col("file").alias("__file"), F.col("ends").alias("__ends"), first.alias("__first")).persist()
    groups = side.agg(F.sum(F.size("__ends"))).first()[0] or 0
    hit = df.join(F.broadcast(side) if groups <= BROADCAST_GROUPS else side, "__file")
    at = F.size(F.filter("__ends", lambda e: e <= F.col("__row")))
    return hit.withColumn("row_group", (F.col("__first") + at).cast("int")).drop("__file", "__row", "__ends", "__first")


def split_profile(df: DataFrame, ts: str) -> DataFrame:
    """One row a part: rows, row groups, spread of their sizes and positive rates, ts range, and the ts gap to the end of training.

    df: part, row_group, label_type, ts. A gap under 0 means that the part's times overlap with those of training.
    """
    pos = F.sum(F.when(F.coalesce("label_type", F.lit(0)) == 2, 1).otherwise(0)).cast("long")
    per = df.groupBy("part", "row_group").agg(F.count("*").alias("n"), pos.alias("pos"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    per = per.withColumn("rate", F.col("pos") / F.col("n"))
    spread = [f(c).alias(f"{c}_{k}") for c in ("n", "rate") for k, f in (("min", F.min), ("mean", F.avg), ("max", F.max), ("std", F.stddev_pop))]
    got = per.groupBy("part").agg(F.sum("n").alias("rows"), F.count("*").alias("row_groups"), F.sum("pos").alias("pos"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), *spread)
    for c in ("n", "rate"):
        got = got.join(F.broadcast(as_columns(quantiles(per, ["part"], [0.5], c), ["part"], [f"{c}_p50"])), "part")  # a row a part
    end = F.max(F.when(F.col("part") == "train", F.col("last_ts"))).over(Window.partitionBy(F.lit(0)))  # over the few parts
    return got.withColumn("pos_rate", ratio(F.col("pos"), F.col("rows"))).withColumn("gap", F.when(F.col("part") != "train", F.col("first_ts") - end))


def seeded_order(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """A shuffle that repeats: rows ordered by a seeded hash of their keys."""
    return df.orderBy(seeded_hash(keys, seed), *keys)


def seeded_sample(df: DataFrame, keys: list[str], share: float, seed: int) -> DataFrame:
    """A sampling operator: rows whose seeded hash falls in the share."""
    return df.where(seeded_hash(keys, seed) < int(share * (1 << 32)))


def seeded_hash(keys: list[str], seed: int):
    """32 bits that other engines can recompute."""
    return hash_bucket(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))), 1 << 32)


def last_prediction(df: DataFrame, user: str, order: str, value: str) -> DataFrame:
    """One row a user: the value with the largest order."""
    return df.groupBy(user).agg(F.max_by(value, order).alias(value))


def windowed_mean(df: DataFrame, step: str, value: str, width: int = 500) -> DataFrame:
    return df.groupBy(F.floor(F.col(step) / width).cast("long").alias("window")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def mean_pooling(ids: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, dim, value: mean of the vectors of a sample's nonzero ids. ids: keys, token; vectors: token, vector."""
    long = ids.where("token > 0").join(vectors, "token").select(*keys, F.posexplode("vector").alias("dim", "v"))
    return long.groupBy(*keys, "dim").agg(F.avg(F.col("v").cast("double")).alias("value"))
