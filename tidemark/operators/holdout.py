"""Holdouts, bucketed evaluation, and cardinality reduction: operators that the reference documents without shipping them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sequences import ratio
from tidemark.operators.ranks import quantiles


def hash_bucket(value: Column, buckets: int) -> Column:
    """A bucket that other engines can recompute: the first 32 bits of the MD5 of the value's text, modulo buckets."""
    return (F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("long")


def three_way(df: DataFrame, user: str, ts: str, cut: Column, buckets: int = 10, first_tail_group: Column | None = None) -> DataFrame:
    """df with `part`: time_tail (at or after cut), user_hash (users of bucket 0), row_group_tail (row_group at or after the one given, if any), else train; the first that holds."""
    part = F.when(F.col(ts) >= cut, "time_tail").when(hash_bucket(F.col(user), buckets) == 0, "user_hash")
    if first_tail_group is not None:
        part = part.when(F.col("row_group") >= first_tail_group, "row_group_tail")
    return df.withColumn("part", part.otherwise("train"))


def ts_ranges(df: DataFrame, ts: str) -> DataFrame:
    """part, n, first_ts, last_ts, and how many of the part's rows are no later than the last of train."""
    train = df.where("part = 'train'").agg(F.max(ts).alias("__last"))  # one row
    before = F.sum(F.when(F.col(ts) <= F.col("__last"), 1).otherwise(0)).cast("long")
    return df.crossJoin(F.broadcast(train)).groupBy("part").agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), before.alias("within_train"))


def row_cap(df: DataFrame, most: int) -> DataFrame:
    """At most so many rows, for a quick look: the cap is the feature."""
    return df.limit(most) if most > 0 else df


def truncate_by_frequency(df: DataFrame, column: str, least: int) -> DataFrame:
    """df with `kept`: the id where it occurs `least` times or more, else 0."""
    often = df.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(column, F.col(column).alias("known"))
    return df.join(often, column, "left").withColumn("kept", F.coalesce("known", F.lit(0).cast("long"))).drop("known")


def hash_ids(value: Column, size: int) -> Column:
    """0 stays 0; any other id becomes 1 + its hash bucket."""
    return F.when(value <= 0, F.lit(0).cast("long")).otherwise(hash_bucket(value, size) + 1)


def quantile_buckets(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """df with `bucket`: how many inner quantiles of log1p of the column (exact, linear) lie strictly below the value."""
    v = F.log1p(F.greatest(F.col(column).cast("double"), F.lit(0.0)))
    found = quantiles(df.select(v.alias("value")), [], [k / buckets for k in range(1, buckets)])
    cuts = found.agg(F.collect_list("v").alias("cuts"))  # a value a cut
    return df.crossJoin(F.broadcast(cuts)).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < v - 1e-12)).cast("long")).drop("cuts")  # one row of cuts


def bucketed_rates(df: DataFrame, bucket: Column, score: str, label: str) -> DataFrame:
    """Rows, positive rate and mean score by bucket."""
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), ratio(F.sum(label), F.count("*")).alias("pos_rate"), F.avg(score).alias("mean_score"))


def observations_per_row(tokens: DataFrame, key: str) -> DataFrame:
    """One row: samples, tokens, distinct ids, tokens a sample and an id."""
    rows = tokens.groupBy(key).agg(F.count("*").alias("n"))
    ids = tokens.groupBy("token").agg(F.count("*").alias("n"))
    a = rows.agg(F.count("*").alias("samples"), F.sum("n").alias("tokens"))
    b = ids.agg(F.count("*").alias("ids"))
    return a.crossJoin(b).select("samples", "tokens", "ids", ratio(F.col("tokens"), F.col("samples")).alias("per_sample"), ratio(F.col("tokens"), F.col("ids")).alias("per_id"))  # one row each


def worker_of(group: Column, workers: int) -> Column:
    """Row group i is read by worker i mod workers."""
    return F.pmod(group, F.lit(workers))


def batches_at_most(group_rows: list[int], batch: int) -> int:
    """Upper bound of batches: each group rounds up on its own."""
    return sum(-(-n // batch) for n in group_rows)
