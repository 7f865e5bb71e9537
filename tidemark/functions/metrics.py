"""Metric and training-schedule expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def smooth(label: Column, amount: float) -> Column:
    return label * (1 - amount) + 0.5 * amount


def bce_with_logits(z: Column, y: Column) -> Column:
    """Numerically stable binary cross-entropy of a logit."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def focal_loss(z: Column, y: Column, alpha: float = 0.1, gamma: float = 2.0) -> Column:
    p = sigmoid(z)
    pt = p * y + (1 - p) * (1 - y)
    return (alpha * y + (1 - alpha) * (1 - y)) * F.pow(1 - pt, F.lit(gamma)) * bce_with_logits(z, y)


def reduce_loss(df: DataFrame, loss: Column, how: str = "mean") -> DataFrame:
    """mean, sum or none."""
    if how == "none":
        return df.withColumn("loss", loss)
    return df.agg({"mean": F.avg, "sum": F.sum}[how](loss).alias("loss"))


def learning_rate_factor(step: Column, warmup: int, total: int, floor: float = 0.0, cosine: bool = True) -> Column:
    """Linear warm-up, then constant or a half cosine down to floor."""
    rise = step / F.lit(float(max(1, warmup)))
    if not cosine:
        return F.when(step < warmup, rise).otherwise(F.lit(1.0))
    fall = floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * (step - warmup) / F.lit(float(max(1, total - warmup)))))
    return F.when(step < warmup, rise).when(step >= total, F.lit(floor)).otherwise(fall)


def moving_average(values: Column, decay: float) -> Column:
    """Exponential moving average of an ordered list, from its first value."""
    return F.aggregate(F.slice(values, 2, 2_147_483_646), F.element_at(values, 1), lambda s, p: s * decay + p * (1 - decay))


def auc_and_log_loss(df: DataFrame, score: str, label: str, floor: float = 1e-7) -> DataFrame:
    """n, auc (ties count half; 0.0 with one class), log_loss (infinite with no row). NaN and null scores are dropped.

    Rows are first added up by score, so the only ordered pass is over distinct scores; ranks come from two window sums
    over ranges of scores, not from one global sort of all rows.
    """
    clean = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score))).select(F.col(score).cast("double").alias("p"), F.col(label).cast("double").alias("y"))
    grouped = clean.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    blocks = grouped.withColumn("block", F.floor(F.col("p") * 4096).cast("long"))
    below = blocks.groupBy("block").agg(F.sum("neg").alias("block_neg"))
    before = below.withColumn("neg_before", F.coalesce(F.sum("block_neg").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("block_neg")
    inside = Window.partitionBy("block").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = blocks.join(before, "block").withColumn("lower", F.col("neg_before") + F.coalesce(F.sum("neg").over(inside), F.lit(0.0)))
    wins = ranked.agg(F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2)).alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    q = F.least(F.greatest(F.col("p"), F.lit(floor)), F.lit(1 - floor))
    loss = clean.agg(F.count("*").alias("n"), F.avg(-(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))).alias("log_loss"))
    auc = F.coalesce(F.try_divide("wins", F.col("pos") * F.col("neg")), F.lit(0.0))
    return wins.crossJoin(loss).select("n", auc.alias("auc"), F.coalesce("log_loss", F.lit(float("inf"))).alias("log_loss"))  # one row each


def early_stopping(df: DataFrame, step: str, score: str, patience: int, delta: float = 0.0) -> DataFrame:
    """step, score, best (so far), improved, counter and stop of a short trace (a row an evaluation), in one pass over its list; a score must beat the best by more than delta."""
    trace = df.agg(F.sort_array(F.collect_list(F.struct(F.col(step).alias("t"), F.col(score).cast("double").alias("s")))).alias("l"))
    first = F.struct(F.lit(None).cast("long").alias("t"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("best"), F.lit(False).alias("improved"), F.lit(0).alias("counter"), F.lit(False).alias("stop"))

    def follow(seen: Column, r: Column) -> Column:
        last = F.element_at(seen, -1)
        better = last["best"].isNull() | (r["s"] > last["best"] + delta)
        counter = F.when(better, F.lit(0)).otherwise(last["counter"] + 1)
        new = F.struct(r["t"].cast("long").alias("t"), r["s"].alias("s"), F.when(better, r["s"]).otherwise(last["best"]).alias("best"), better.alias("improved"), counter.alias("counter"), (last["stop"] | (counter >= patience)).alias("stop"))
        return F.concat(seen, F.array(new))

    states = trace.select(F.explode(F.slice(F.aggregate("l", F.array(first), follow), 2, 2_147_483_646)).alias("r"))
    return states.select(F.col("r.t").alias(step), F.col("r.s").alias(score), "r.best", "r.improved", "r.counter", "r.stop")
