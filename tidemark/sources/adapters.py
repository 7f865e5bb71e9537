"""Adapters: the test tables in the shape of sequence samples.

Event sequences: per user, domain = event type, token = props.k (0 is padding), newest first; the row time is the user's
last event; label 2 if the user ever purchased. Order sequences: per order, token = part key; label 2 if the order is
filled. Both give one row a token (long form); `as_lists` gives list columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import table


def epoch_seconds(ts):
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("long")


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, domain, event_id, token, ts."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_type").alias("domain"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("token"), epoch_seconds(F.col("ts")).alias("ts"))


def user_rows(tokens: DataFrame) -> DataFrame:
    """user_id, row_ts, label."""
    return tokens.groupBy("user_id").agg(F.max("ts").alias("row_ts"), F.max(F.when(F.col("domain") == "purchase", 2).otherwise(1)).alias("label_type"))


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: user_id, domain, pos (0 is newest), token, ts, row_ts, label_type."""
    tokens = event_tokens(spark, sf_dir)
    newest = Window.partitionBy("user_id", "domain").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    user = Window.partitionBy("user_id")  # one shuffle by user serves all three; the table is read once
    bought = F.max(F.when(F.col("domain") == "purchase", 2).otherwise(1)).over(user)
    placed = tokens.withColumn("row_ts", F.max("ts").over(user)).withColumn("label_type", bought).withColumn("pos", F.row_number().over(newest) - 1)
    return placed.select("user_id", "domain", "token", "ts", "pos", "row_ts", "label_type")


def order_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: order, domain ('parts'), pos, token, label_type."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), "l_linenumber", F.col("l_partkey").alias("token"), "l_suppkey", "l_extendedprice")
    order = Window.partitionBy("order").orderBy("l_linenumber", "token", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("label_type"))
    placed = lines.withColumn("pos", F.row_number().over(order) - 1).select("order", "pos", "token")
    return placed.join(rows, "order").withColumn("domain", F.lit("parts"))


def as_lists(tokens: DataFrame, keys: list[str], columns: list[str], cap: int) -> DataFrame:
    """List columns of the newest `cap` tokens (cut before they are gathered, which bounds every list), and the full length."""
    kept = F.sort_array(F.collect_list(F.when(F.col("pos") < cap, F.struct("pos", *columns))))
    grouped = tokens.groupBy(*keys).agg(kept.alias("kept"), F.count("*").alias("full_length"))
    return grouped.select(*keys, "full_length", *[F.col(f"kept.{c}").alias(c) for c in columns])
