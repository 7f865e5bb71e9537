"""Time-bucket analysis: recency and gap distributions by domain, histograms, entropy, divergence, keep rate, edges.

Input: one row a token with domain, pos, ts, row_ts and the sample key. The analysis rule differs from the row features:
times of zero or less are dropped first, then sequences are cut at their cap, and gaps of zero are dropped. All exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.edges import GAP_EDGES, count_less
from tidemark.functions.sequences import ratio, round_edge, strictly_increasing
from tidemark.operators import ranks
from tidemark.operators.ranks import as_columns, quantiles

QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def quantile_name(q: float) -> str:
    return f"p{int(round(q * 100)):02d}"


def valid_tokens(tokens: DataFrame, key: str, caps: dict[str, int], default_cap: int = 256) -> DataFrame:
    """Tokens with ts > 0, a fresh position `at`, how many valid ones the sequence has, and `kept` (at < cap)."""
    order = Window.partitionBy(key, "domain").orderBy("pos")
    cap = F.lit(default_cap)
    for d, c in caps.items():
        cap = F.when(F.col("domain") == d, F.lit(c)).otherwise(cap)
    got = tokens.where("ts > 0").withColumn("at", F.row_number().over(order) - 1)
    got = got.withColumn("older", F.lead("ts").over(order)).withColumn("n_valid", F.count("*").over(Window.partitionBy(key, "domain")))
    return got.withColumn("cap", cap).withColumn("kept", F.col("at") < F.col("cap"))


def recencies(valid: DataFrame) -> DataFrame:
    """domain, value: ages of kept tokens, at least 0."""
    return valid.where("kept").select("domain", F.greatest(F.col("row_ts") - F.col("ts"), F.lit(0).cast("long")).alias("value"))


def gaps(valid: DataFrame) -> DataFrame:
    """domain, value: positive gaps between kept neighbours."""
    inside = F.col("at") + 1 < F.least(F.col("n_valid"), F.col("cap"))
    return valid.where(inside & (F.col("ts") > F.col("older"))).select("domain", (F.col("ts") - F.col("older")).alias("value"))


def bucket_of(value: Column, edges: list[int], clip: bool) -> Column:
    """clip: values beyond the last edge share its bucket."""
    n = count_less(value, edges)
    return (F.least(n, F.lit(len(edges) - 1)) if clip else n) + 1


def histogram(values: DataFrame, edges: list[int], clip: bool = True) -> DataFrame:
    """domain, bucket, n for every bucket from 1, empty ones too."""
    last = len(edges) if clip else len(edges) + 1
    found = values.groupBy("domain", bucket_of(F.col("value"), edges, clip).alias("bucket")).agg(F.count("*").alias("n"))
    grid = found.select("domain").distinct().select("domain", F.explode(F.sequence(F.lit(1), F.lit(last))).alias("bucket"))
    return grid.join(found, ["domain", "bucket"], "left").fillna(0, ["n"])


def bucket_statistics(hist: DataFrame) -> DataFrame:
    """Per domain: total, empty buckets, share of the largest, entropy in bits."""
    p = F.col("n") / F.col("total")
    total = hist.groupBy("domain").agg(F.sum("n").alias("total"))
    e = F.coalesce(-F.sum(F.when(F.col("n") > 0, p * F.log2(p))), F.lit(0.0))
    return hist.join(total, "domain").groupBy("domain").agg(F.first("total").alias("total"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).cast("long").alias("empty_buckets"), ratio(F.max("n"), F.first("total")).alias("top_share"), e.alias("entropy_bits"))


def value_summary(values: DataFrame) -> DataFrame:
    """count, min, max, mean and nine linear-interpolated quantiles, cut to whole seconds."""
    plain = values.groupBy("domain").agg(F.count("*").alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.avg("value").alias("mean"))
    return plain.join(whole_seconds(values, ["domain"]), "domain")


def whole_seconds(values: DataFrame, by: list[str]) -> DataFrame:
    """The nine quantiles of a group, cut to whole seconds."""
    names = [quantile_name(x) for x in QUANTILES]
    got = as_columns(quantiles(values, by, list(QUANTILES)), by, names)
    return got.select(*by, *[F.floor(F.round(n, 6)).cast("long").alias(n) for n in names])


def divergence(hist: DataFrame) -> DataFrame:
    """left, right, js_bits for each pair of domains: a join of two histograms on the bucket, domains in order."""
    total = hist.groupBy("domain").agg(F.sum("n").alias("total"))
    p = hist.join(total, "domain").select("domain", "bucket", ratio(F.col("n"), F.col("total")).alias("p"))
    a, b = p.toDF("left", "bucket", "p"), p.toDF("right", "bucket", "q")
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    pairs = a.join(b, "bucket").where(F.col("left") < F.col("right"))
    return pairs.groupBy("left", "right").agg((F.sum(term(F.col("p")) + term(F.col("q"))) / 2).alias("js_bits"))


def keep_rate(valid: DataFrame) -> DataFrame:
    k = F.sum(F.when(F.col("kept"), 1).otherwise(0))
    return valid.groupBy("domain").agg(k.alias("kept"), F.sum(F.when(F.col("kept"), 0).otherwise(1)).alias("dropped"), ratio(k, F.count("*")).alias("keep_rate"))


def slot_recency(valid: DataFrame) -> DataFrame:
    """Age quantiles at the first, middle and last kept slot; the middle is min(n - 1, cap div 2)."""
    n = F.least(F.col("n_valid"), F.col("cap"))
    slots = F.array(F.struct(F.lit("first").alias("slot"), F.lit(0).cast("long").alias("want")), F.struct(F.lit("middle").alias("slot"), F.least(n - 1, F.floor(F.col("cap") / 2)).cast("long").alias("want")), F.struct(F.lit("last").alias("slot"), (n - 1).cast("long").alias("want")))
    rows = valid.where("kept").select("domain", "at", "row_ts", "ts", F.explode(slots).alias("s")).where(F.col("at") == F.col("s.want"))
    age = F.greatest(F.col("row_ts") - F.col("ts"), F.lit(0).cast("long"))
    ages = rows.select("domain", F.col("s.slot").alias("slot_name"), age.alias("value"))
    got = ages.groupBy("domain", "slot_name").agg(F.count("*").alias("n")).join(whole_seconds(ages, ["domain", "slot_name"]), ["domain", "slot_name"])
    return got.withColumnRenamed("slot_name", "slot")


def edge_candidates(values: DataFrame, quantiles: list[float], reducer: str = "mean") -> list[int]:
    """Shared edges: each domain's quantiles, mean or median across domains, rounded, made strictly increasing."""
    rows = rounded_quantiles(values, quantiles, reducer).orderBy("slot").collect()  # a row a quantile
    return strictly_increasing([r.edge for r in rows])


def rounded_quantiles(values: DataFrame, quantiles: list[float], reducer: str = "mean") -> DataFrame:
    if reducer not in ("mean", "median"):
        raise ValueError("reducer is mean or median")
    per = ranks.quantiles(values, ["domain"], quantiles)
    across = F.avg("v") if reducer == "mean" else F.percentile("v", F.lit(0.5))
    return per.groupBy("slot").agg(across.alias("v")).select("slot", round_edge(F.col("v")).alias("edge"))


def suggested_edges(values: DataFrame, n: int) -> DataFrame:
    """domain, edge: distinct rounded quantiles from 2 % to 98 %, at least 1."""
    q = [0.02 + 0.96 * k / (n - 1) for k in range(n)]
    per = quantiles(values, ["domain"], q)
    return per.select("domain", F.greatest(F.lit(1).cast("long"), F.bround("v", 0).cast("long")).alias("edge")).distinct()


GAP = GAP_EDGES
