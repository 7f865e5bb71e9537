"""All queries over the reference's operators, with independently written DuckDB oracles.

Doubles are rounded to six digits on both sides, so that the order of a sum does not show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import edges as E
from tidemark.functions import metrics as M
from tidemark.functions import sequences as S
from tidemark.operators import holdout, profile, ranks, tail, timebuckets
from tidemark.session import table
from tidemark.sources import adapters, schema

CAP = 16
KS = [5, 20, 50, 200]
THRESHOLDS = [1, 5, 20, 100]
EDGE_QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(n), digits).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


def sql_list(values) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


# ---- shared SQL ------------------------------------------------------------------------------------------------------
EVENTS = """
ev AS (SELECT user_id, event_type AS domain, event_id, CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS token,
              CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events),
usr AS (SELECT user_id, max(ts) AS row_ts, max(CASE WHEN domain = 'purchase' THEN 2 ELSE 1 END) AS label_type FROM ev GROUP BY 1),
seqs AS (SELECT ev.user_id, domain, token, ts, row_ts, label_type,
                row_number() OVER (PARTITION BY ev.user_id, domain ORDER BY ts DESC, event_id DESC) - 1 AS pos
         FROM ev JOIN usr USING (user_id))"""
PARTS = """
parts AS (SELECT l_orderkey AS ord, l_partkey AS token, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem),
tok AS (SELECT parts.*, 'parts' AS domain, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS label_type FROM parts JOIN orders ON ord = o_orderkey)"""
COUNTS = """
cnt AS (SELECT domain, token, count(*) AS n, count(*) FILTER (label_type = 2) AS pos, count(*) FILTER (pos < 50) AS head FROM tok WHERE token > 0 GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, token) AS rank, sum(n) OVER (PARTITION BY domain) AS total FROM cnt)"""
ETOK = EVENTS + ", tok AS (SELECT * FROM seqs)"
VALID = EVENTS + f""",
va AS (SELECT *, row_number() OVER (PARTITION BY user_id, domain ORDER BY pos) - 1 AS slot_at, count(*) OVER (PARTITION BY user_id, domain) AS nv,
              lead(ts) OVER (PARTITION BY user_id, domain ORDER BY pos) AS older FROM seqs WHERE ts > 0),
rec AS (SELECT domain, greatest(row_ts - ts, 0) AS value FROM va WHERE slot_at < {CAP}),
gp AS (SELECT domain, ts - older AS value FROM va WHERE slot_at + 1 < least(nv, {CAP}) AND ts > older)"""


def below(v: str, edges) -> str:
    return f"len(list_filter({sql_list(edges)}, lambda b: b < {v}))"


def recency_sql(edges) -> str:
    return f"CASE WHEN ts = 0 THEN 0 ELSE least({below('greatest(row_ts - ts, 0)', edges)}, {len(edges) - 1}) + 1 END"


# ---- row features ----------------------------------------------------------------------------------------------------
def recency_counts(preset: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        seq = adapters.event_sequences(spark, d)
        b = S.recency_id(F.col("row_ts"), F.col("ts"), E.preset(preset))
        return seq.groupBy("domain", b.cast("long").alias("bucket")).agg(F.count("*").alias("n"))

    return run


for _name, _preset in (("recency_bucket_counts", "original"), ("recency_bucket_counts_hybrid", "hybrid_v1")):
    query(_name, f"WITH {EVENTS} SELECT domain, CAST({recency_sql(E.PRESETS[_preset])} AS BIGINT) AS bucket, count(*) AS n FROM seqs GROUP BY 1, 2")(recency_counts(_preset))


@query("gap_bucket_counts", f"""WITH {EVENTS}, g AS (SELECT domain, pos, ts, lead(ts) OVER (PARTITION BY user_id, domain ORDER BY pos) AS older FROM seqs WHERE pos < {CAP})
SELECT domain, CAST(CASE WHEN ts > 0 AND older > 0 THEN least({below('greatest(ts - older, 0)', E.GAP_EDGES)}, 31) + 1 ELSE 0 END AS BIGINT) AS bucket, count(*) AS n FROM g GROUP BY 1, 2""")
def gap_bucket_counts(spark, d):
    lists = adapters.as_lists(adapters.event_sequences(spark, d), ["user_id", "domain"], ["ts"], CAP)
    ids = lists.select("domain", F.size("ts").alias("len"), F.posexplode(S.gap_ids(F.col("ts"), CAP)).alias("p", "bucket")).where("p < len")
    return ids.groupBy("domain", F.col("bucket").cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("calendar_ids", f"""WITH {EVENTS} SELECT CASE WHEN ts = 0 THEN 0 ELSE CAST(floor(((ts + 28800) % 86400) / 3600) AS BIGINT) + 1 END AS hour,
CASE WHEN ts = 0 THEN 0 ELSE (CAST(floor((ts + 28800) / 86400) AS BIGINT) + 3) % 7 + 1 END AS weekday,
CASE WHEN ts = 0 THEN 0 ELSE month(make_timestamp((ts + 28800) * 1000000)) END AS month, count(*) AS n FROM seqs GROUP BY 1, 2, 3""")
def calendar_ids(spark, d):
    t = F.col("ts")
    ids = [S.calendar_id(t, f).cast("long").alias(n) for n, f in (("hour", S.hour_id), ("weekday", S.weekday_id), ("month", S.month_id))]
    return adapters.event_tokens(spark, d).groupBy(*ids).agg(F.count("*").alias("n"))


@query("sample_time_ids", f"""WITH {EVENTS} SELECT user_id, (CAST(floor((row_ts + 28800) / 86400) AS BIGINT) + 3) % 7 + 1 AS weekday, CAST(floor(((row_ts + 28800) % 86400) / 3600) AS BIGINT) + 1 AS hour FROM usr""")
def sample_time_ids(spark, d):
    rows = adapters.user_rows(adapters.event_tokens(spark, d))
    return rows.select("user_id", S.weekday_id(F.col("row_ts")).cast("long").alias("weekday"), S.hour_id(F.col("row_ts")).cast("long").alias("hour"))


@query("sequence_padding", f"""WITH {EVENTS}, l AS (SELECT user_id, domain, list(greatest(token, 0) ORDER BY pos) FILTER (pos < {CAP}) AS t FROM seqs GROUP BY 1, 2)
SELECT user_id, domain, len(t) AS length, array_to_string(list_concat(t, list_transform(range({CAP} - len(t)), lambda x: 0)), ',') AS tokens FROM l""")
def sequence_padding(spark, d):
    lists = adapters.as_lists(adapters.event_sequences(spark, d), ["user_id", "domain"], ["token"], CAP)
    return lists.select("user_id", "domain", S.shared_length([F.col("token")], CAP).cast("long").alias("length"), F.array_join(S.pad_ints(F.col("token"), CAP), ",").alias("tokens"))


def dense_padding(width: int):
    def run(spark, d):
        v = S.pad_floats(F.col("embedding"), width)
        total = F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
        return rounded(table(spark, d, "embeddings").select("vec_id", F.size(v).cast("long").alias("width"), total.alias("total")), 4)

    return run


for _w in (48, 80):
    query(f"dense_padding_{_w}", f"SELECT vec_id, CAST({_w} AS BIGINT) AS width, round(list_sum(list_transform(embedding[1:{_w}], lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")(dense_padding(_w))


@query("time_summary", f"""WITH {EVENTS}, s AS (SELECT *, row_ts - ts AS age FROM seqs WHERE pos < {CAP}),
g AS (SELECT user_id, domain, max(row_ts) AS row_ts, count(*) FILTER (ts > 0) AS n, max(ts) AS t0, min(ts) AS t1, count(*) FILTER (ts > 0 AND age <= 3600) AS w1,
 count(*) FILTER (ts > 0 AND age <= 86400) AS w2, count(*) FILTER (ts > 0 AND age <= 604800) AS w3, count(*) FILTER (ts > 0 AND age <= 2592000) AS w4 FROM s GROUP BY 1, 2)
SELECT user_id, domain, round(ln(1 + row_ts - t0) / ln(1 + 63072000), 6) AS age_newest, round(ln(1 + row_ts - t1) / ln(1 + 63072000), 6) AS age_oldest,
 round(ln(1 + t0 - t1) / ln(1 + 63072000), 6) AS span, round(ln(1 + n / ln(1 + (t0 - t1) / 86400.0 + 1)) / ln(1 + {CAP}), 6) AS density,
 round(ln(1 + w1) / ln(1 + {CAP}), 6) AS within_1h, round(ln(1 + w2) / ln(1 + {CAP}), 6) AS within_1d, round(ln(1 + w3) / ln(1 + {CAP}), 6) AS within_7d, round(ln(1 + w4) / ln(1 + {CAP}), 6) AS within_30d FROM g""")
def time_summary(spark, d):
    seq = adapters.event_sequences(spark, d)
    lists = adapters.as_lists(seq, ["user_id", "domain", "row_ts"], ["ts"], CAP)
    parts = S.time_summary(F.col("row_ts"), F.col("ts"), CAP)
    return rounded(lists.select("user_id", "domain", *[c.alias(n) for c, n in zip(parts, S.SUMMARY_NAMES, strict=True)]))


@query("gather_head_tail", f"""WITH {EVENTS}, l AS (SELECT user_id, domain, list(token ORDER BY pos) AS t FROM seqs WHERE pos < {CAP} GROUP BY 1, 2)
SELECT user_id, domain, array_to_string(list_concat(t[1:3], list_transform(range(3 - least(len(t), 3)), lambda x: 0)), ',') AS newest,
array_to_string(list_concat(t[greatest(len(t) - 3, 0) + 1:], list_transform(range(3 - least(len(t), 3)), lambda x: 0)), ',') AS oldest FROM l""")
def gather_head_tail(spark, d):
    lists = adapters.as_lists(adapters.event_sequences(spark, d), ["user_id", "domain"], ["token"], CAP)
    t = F.col("token")
    return lists.select("user_id", "domain", F.array_join(S.gather(t, F.size(t), 3, "head"), ",").alias("newest"), F.array_join(S.gather(t, F.size(t), 3, "tail"), ",").alias("oldest"))


@query("padding_mask", f"""WITH {EVENTS}, l AS (SELECT user_id, domain, least(count(*), {CAP}) AS n FROM seqs GROUP BY 1, 2)
SELECT domain, i.i AS slot, count(*) FILTER (i.i >= n) AS padded FROM l, range({CAP}) i(i) GROUP BY 1, 2""")
def padding_mask(spark, d):
    lists = adapters.as_lists(adapters.event_sequences(spark, d), ["user_id", "domain"], ["token"], CAP)
    slots = lists.select("domain", F.posexplode(S.padding_mask(F.size("token"), CAP)).alias("slot", "off"))
    return slots.groupBy("domain", F.col("slot").cast("long").alias("slot")).agg(F.sum(F.col("off").cast("long")).alias("padded"))


@query("oob_stats", f"WITH {EVENTS} SELECT domain, count(*) AS n, min(token) AS lowest, max(token) AS highest FROM seqs WHERE token >= 64 GROUP BY 1")
def oob_stats(spark, d):
    return tail.out_of_bounds(adapters.event_tokens(spark, d), 64)


@query("vocab_clip", f"WITH {EVENTS} SELECT domain, CASE WHEN token >= 64 OR token < 0 THEN 0 ELSE token END AS clipped, count(*) AS n FROM seqs GROUP BY 1, 2")
def vocab_clip(spark, d):
    return adapters.event_tokens(spark, d).groupBy("domain", S.clip_vocab(S.clean_int(F.col("token")), 64).alias("clipped")).agg(F.count("*").alias("n"))


def topk_remap(keep: bool):
    def run(spark, d):
        tok = adapters.order_sequences(spark, d)
        mapped = tail.remap_tokens(tok, tail.topk_map(tail.token_counts(tok), 50), 50, keep)
        return mapped.groupBy("domain", "mapped").agg(F.count("*").alias("n"), F.sum("token").alias("token_sum"))

    return run


for _keep in (True, False):
    query("topk_remap" if _keep else "topk_remap_clipped", f"""WITH {PARTS}, {COUNTS} SELECT tok.domain, CAST(CASE WHEN tok.token <= 0 THEN 0 ELSE coalesce(r.rank, {51 if _keep else 0}) END AS BIGINT) AS mapped, count(*) AS n, CAST(sum(tok.token) AS BIGINT) AS token_sum
FROM tok LEFT JOIN (SELECT * FROM rk WHERE rank <= 50) r ON r.domain = tok.domain AND r.token = tok.token GROUP BY 1, 2""")(topk_remap(_keep))


# ---- tail analysis ---------------------------------------------------------------------------------------------------
def event_lengths(spark, d):
    tok = adapters.event_sequences(spark, d)
    return tok, adapters.user_rows(adapters.event_tokens(spark, d))


LENGTHS = EVENTS + """, grid AS (SELECT u.user_id, u.label_type, dm.domain FROM usr u, (SELECT DISTINCT domain FROM ev) dm),
ln AS (SELECT grid.user_id, grid.domain, grid.label_type, count(seqs.pos) AS raw_len, count(seqs.pos) FILTER (seqs.token > 0) AS nonzero_len
       FROM grid LEFT JOIN seqs ON grid.user_id = seqs.user_id AND grid.domain = seqs.domain GROUP BY 1, 2, 3)"""


@query("token_stats", f"""WITH {LENGTHS} SELECT domain, count(*) AS n_rows, count(*) FILTER (label_type = 2) AS pos_rows, count(*) FILTER (nonzero_len > 0) AS rows_present,
count(*) FILTER (nonzero_len > 0 AND label_type = 2) AS pos_rows_present, CAST(sum(raw_len) AS BIGINT) AS total_tokens, CAST(sum(nonzero_len) AS BIGINT) AS nonzero_tokens,
CAST(coalesce(sum(nonzero_len) FILTER (label_type = 2), 0) AS BIGINT) AS nonzero_pos_tokens FROM ln GROUP BY 1""")
def token_stats(spark, d):
    tok, rows = event_lengths(spark, d)
    return tail.token_statistics(tok, rows, "user_id")


@query("length_quantiles", f"WITH {LENGTHS} SELECT domain, " + ", ".join(f"CAST(quantile_disc({c}, {p}) AS BIGINT) AS {n}_p{int(p * 100)}" for c, n in (("raw_len", "raw"), ("nonzero_len", "nonzero")) for p in (0.5, 0.9, 0.99)) + " FROM ln GROUP BY 1")
def length_quantiles(spark, d):
    tok, rows = event_lengths(spark, d)
    return tail.length_quantiles(tail.sample_lengths(tok, rows, "user_id"))


@query("length_histogram", f"WITH {LENGTHS} SELECT domain, raw_len, count(*) AS n FROM ln GROUP BY 1, 2")
def length_histogram(spark, d):
    tok, rows = event_lengths(spark, d)
    return tail.length_histogram(tail.sample_lengths(tok, rows, "user_id"))


@query("truncation_rates", f"WITH {LENGTHS} SELECT domain, count(*) AS n, round(count(*) FILTER (raw_len > {CAP}) / count(*), 6) AS truncated, round(count(*) FILTER (raw_len = 0) / count(*), 6) AS empty FROM ln GROUP BY 1")
def truncation_rates(spark, d):
    tok, rows = event_lengths(spark, d)
    return rounded(profile.truncation(tail.sample_lengths(tok, rows, "user_id"), CAP))


@query("nonzero_length_histogram", f"WITH {LENGTHS} SELECT domain, nonzero_len, count(*) AS n FROM ln GROUP BY 1, 2")
def nonzero_length_histogram(spark, d):
    tok, rows = event_lengths(spark, d)
    return tail.length_histogram(tail.sample_lengths(tok, rows, "user_id"), "nonzero_len")


@query("position_buckets", f"""WITH {EVENTS} SELECT domain, CASE WHEN pos < 10 THEN 'pos0_10' WHEN pos < 50 THEN 'pos10_50' WHEN pos < 100 THEN 'pos50_100' WHEN pos < 256 THEN 'pos100_256' ELSE 'pos256_plus' END AS bucket,
count(*) AS n, count(*) FILTER (label_type = 2) AS pos FROM seqs WHERE token > 0 GROUP BY 1, 2""")
def position_buckets(spark, d):
    return tail.position_totals(adapters.event_sequences(spark, d))


def counts_of(spark, d, parts: bool):
    return tail.token_counts(adapters.order_sequences(spark, d) if parts else adapters.event_sequences(spark, d))


BASE = {True: f"{PARTS}, {COUNTS}", False: f"{ETOK}, {COUNTS}"}


@query("heavy_hitters", f"WITH {BASE[False]} SELECT domain, rank, token, n, round(n / total, 6) AS coverage, round(pos / n, 6) AS pos_rate FROM rk WHERE rank <= 20")
def heavy_hitters(spark, d):
    return rounded(tail.heavy_hitters(counts_of(spark, d, False)).withColumn("rank", F.col("rank").cast("long")))


COVER_SQL = f"""cov AS (SELECT domain, k, CAST(sum(n) AS BIGINT) AS count, sum(n) / max(total) AS coverage, sum(pos) / sum(n) AS pos_rate, sum(head) / max(total) AS head_coverage, min(n) AS cutoff_count,
CAST(floor(round(quantile_cont(n, 0.1), 6)) AS BIGINT) AS count_p10, CAST(floor(round(quantile_cont(n, 0.5), 6)) AS BIGINT) AS count_p50, count(*) FILTER (n < 10) / count(*) AS share_lt10,
count(*) FILTER (n < 50) / count(*) AS share_lt50, count(*) FILTER (n < 100) / count(*) AS share_lt100 FROM rk, (SELECT unnest({KS}) AS k) WHERE rank <= k GROUP BY 1, 2)"""


def coverage_query(parts: bool):
    return lambda spark, d: rounded(tail.topk_coverage(counts_of(spark, d, parts), KS).withColumn("k", F.col("k").cast("long")))


for _parts in (True, False):
    query("topk_coverage_parts" if _parts else "topk_coverage", f"""WITH {BASE[_parts]}, {COVER_SQL} SELECT domain, CAST(k AS BIGINT) AS k, count, round(coverage, 6) AS coverage, round(pos_rate, 6) AS pos_rate, round(head_coverage, 6) AS head_coverage,
cutoff_count, count_p10, count_p50, round(share_lt10, 6) AS share_lt10, round(share_lt50, 6) AS share_lt50, round(share_lt100, 6) AS share_lt100 FROM cov""")(coverage_query(_parts))


@query("position_split", f"""WITH {BASE[False]} SELECT tok.domain, CASE WHEN tok.pos < 10 THEN 'pos0_10' WHEN tok.pos < 50 THEN 'pos10_50' WHEN tok.pos < 100 THEN 'pos50_100' WHEN tok.pos < 256 THEN 'pos100_256' ELSE 'pos256_plus' END AS bucket,
rk.rank <= 30 AS in_head, count(*) AS n, count(*) FILTER (label_type = 2) AS pos FROM tok JOIN rk ON rk.domain = tok.domain AND rk.token = tok.token GROUP BY 1, 2, 3""")
def position_split(spark, d):
    tok = adapters.event_sequences(spark, d)
    return tail.position_split(tok, tail.topk_map(tail.token_counts(tok), 30))


@query("count_thresholds", f"""WITH {BASE[True]}, t AS (SELECT unnest({THRESHOLDS}) AS m), g AS (SELECT domain, m, count(*) FILTER (n >= m) AS k, CAST(coalesce(sum(n) FILTER (n >= m), 0) AS BIGINT) AS c,
coalesce(sum(pos) FILTER (n >= m), 0) AS p, coalesce(sum(head) FILTER (n >= m), 0) AS h, sum(n) AS total, coalesce(min(n) FILTER (n >= m), 0) AS cut FROM rk, t GROUP BY 1, 2)
SELECT domain, CAST(m AS BIGINT) AS min_count, k, c AS count, round(c / total, 6) AS coverage, round(1 - c / total, 6) AS default_share, round(CASE WHEN c = 0 THEN 0 ELSE p / c END, 6) AS pos_rate, round(h / total, 6) AS pos0_50_coverage, cut AS cutoff_count, CASE WHEN k > 0 THEN k + 2 ELSE 0 END AS embedding_rows FROM g""")
def count_thresholds(spark, d):
    return rounded(tail.count_thresholds(counts_of(spark, d, True), THRESHOLDS).withColumn("min_count", F.col("min_count").cast("long")))


REC_SQL = f"rec_k AS (SELECT domain, coalesce(min(k) FILTER (coverage >= 0.9), min(k) FILTER (coverage >= 0.7), {KS[-1]}) AS k FROM cov GROUP BY 1)"


@query("recommended_k", f"WITH {BASE[False]}, {COVER_SQL}, {REC_SQL} SELECT domain, CAST(k AS BIGINT) AS k FROM rec_k")
def recommended_k(spark, d):
    return tail.recommended_k(tail.topk_coverage(counts_of(spark, d, False), KS), KS).withColumn("k", F.col("k").cast("long"))


@query("rescue_score", f"""WITH {BASE[False]}, {COVER_SQL}, {REC_SQL}, tl AS (SELECT domain, sum(n) AS total, CAST(coalesce(sum(n) FILTER (rank > 40), 0) AS BIGINT) AS tc, coalesce(sum(pos) FILTER (rank > 40), 0) AS tp FROM rk GROUP BY 1),
j AS (SELECT cov.*, tl.total, tl.tc, CASE WHEN tc = 0 OR tp = 0 THEN 0 ELSE pos_rate / (tp / tc) END AS lift FROM rec_k JOIN cov USING (domain, k) JOIN tl USING (domain))
SELECT domain, CAST(k AS BIGINT) AS k, round(coverage, 6) AS coverage, tc AS tail_count, round(lift, 6) AS head_tail_lift, round(coverage * (1 + least(1, 2 * head_coverage)) * (0.25 + abs(lift - 1)) * ln(1 + total), 6) AS rescue_score FROM j""")
def rescue_score(spark, d):
    return rounded(tail.rescue_scores(counts_of(spark, d, False), KS, capacity=40).withColumn("k", F.col("k").cast("long")))


@query("topk_map", f"WITH {BASE[True]} SELECT domain, token, rank FROM rk WHERE rank <= 100")
def topk_map(spark, d):
    return tail.recut(tail.topk_map(counts_of(spark, d, True), 200), 100).withColumn("rank", F.col("rank").cast("long"))


@query("min_count_map", f"WITH {BASE[False]} SELECT domain, token, rank FROM rk WHERE n >= 15")
def min_count_map(spark, d):
    return tail.min_count_map(counts_of(spark, d, False), 15).withColumn("rank", F.col("rank").cast("long"))


@query("candidate_split", f"WITH {BASE[True]} SELECT domain, rank <= 300 AS in_head, count(*) AS ids, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(pos) AS BIGINT) AS pos FROM rk GROUP BY 1, 2")
def candidate_split(spark, d):
    r = ranks.ranked(counts_of(spark, d, True))
    return r.groupBy("domain", (F.col("rank") <= 300).alias("in_head")).agg(F.count("*").alias("ids"), F.sum("n").alias("tokens"), F.sum("pos").alias("pos"))


@query("gini", f"WITH {BASE[True]}, a AS (SELECT domain, n, row_number() OVER (PARTITION BY domain ORDER BY n, token) AS i, count(*) OVER (PARTITION BY domain) AS m FROM cnt) SELECT domain, round(2 * sum(i * n) / (max(m) * sum(n)) - (max(m) + 1) / max(m), 6) AS gini FROM a GROUP BY 1")
def gini(spark, d):
    return rounded(tail.gini(counts_of(spark, d, True)))


@query("unseen_rate", f"""WITH {PARTS}, v AS (SELECT domain, token, count(*) AS n FROM tok WHERE ord % 10 = 0 AND token > 0 GROUP BY 1, 2), t AS (SELECT DISTINCT token FROM tok WHERE ord % 10 <> 0)
SELECT domain, CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (token NOT IN (SELECT token FROM t)), 0) AS BIGINT) AS unseen, round(coalesce(sum(n) FILTER (token NOT IN (SELECT token FROM t)), 0) / sum(n), 6) AS rate FROM v GROUP BY 1""")
def unseen_rate(spark, d):
    tok = adapters.order_sequences(spark, d)  # the split into training and validation samples is by sample key
    valid = F.col("order") % 10 == 0
    return rounded(tail.unseen_rate(tok.where(~valid), tok.where(valid)))


# ---- time analysis ---------------------------------------------------------------------------------------------------
def valid_events(spark, d):
    return timebuckets.valid_tokens(adapters.event_sequences(spark, d), "user_id", {}, CAP)


def summary_sql(src: str) -> str:
    q = ", ".join(f"CAST(floor(round(quantile_cont(value, {x}), 6)) AS BIGINT) AS {timebuckets.quantile_name(x)}" for x in timebuckets.QUANTILES)
    return f"WITH {VALID} SELECT domain, count(*) AS n, min(value) AS lowest, max(value) AS highest, round(avg(value), 6) AS mean, {q} FROM {src} GROUP BY 1"


query("recency_summary", summary_sql("rec"))(lambda spark, d: rounded(timebuckets.value_summary(timebuckets.recencies(valid_events(spark, d)))))
query("gap_summary", summary_sql("gp"))(lambda spark, d: rounded(timebuckets.value_summary(timebuckets.gaps(valid_events(spark, d)))))

HIST = f"""{VALID}, hb AS MATERIALIZED (SELECT domain, least({below('value', E.RECENCY_ORIGINAL)}, 62) + 1 AS bucket, count(*) AS n FROM rec GROUP BY 1, 2),
hist AS (SELECT domain, bucket, sum(n) AS n FROM (SELECT domain, bucket, n FROM hb UNION ALL SELECT domain, b, 0 FROM (SELECT DISTINCT domain FROM ev), range(1, 64) t(b)) GROUP BY 1, 2)"""


def recency_hist(spark, d):
    return timebuckets.histogram(timebuckets.recencies(valid_events(spark, d)), E.RECENCY_ORIGINAL)


@query("bucket_histogram", f"WITH {HIST} SELECT domain, CAST(bucket AS BIGINT) AS bucket, CAST(n AS BIGINT) AS n FROM hist")
def bucket_histogram(spark, d):
    return recency_hist(spark, d).withColumn("bucket", F.col("bucket").cast("long"))


@query("gap_histogram", f"""WITH {VALID}, hb AS MATERIALIZED (SELECT domain, {below('value', E.GAP_EDGES)} + 1 AS bucket, count(*) AS n FROM gp GROUP BY 1, 2)
SELECT dm.domain, CAST(b.b AS BIGINT) AS bucket, coalesce(hb.n, 0) AS n FROM (SELECT DISTINCT domain FROM gp) dm CROSS JOIN range(1, 33) b(b) LEFT JOIN hb ON hb.domain = dm.domain AND hb.bucket = b.b""")
def gap_histogram(spark, d):
    return timebuckets.histogram(timebuckets.gaps(valid_events(spark, d)), E.GAP_EDGES, clip=False).withColumn("bucket", F.col("bucket").cast("long"))


@query("bucket_entropy", f"""WITH {HIST}, t AS (SELECT *, sum(n) OVER (PARTITION BY domain) AS total FROM hist)
SELECT domain, CAST(max(total) AS BIGINT) AS total, count(*) FILTER (n = 0) AS empty_buckets, round(max(n) / max(total), 6) AS top_share, round(coalesce(-sum(n / total * log2(n / total)) FILTER (n > 0), 0), 6) AS entropy_bits FROM t GROUP BY 1""")
def bucket_entropy(spark, d):
    return rounded(timebuckets.bucket_statistics(recency_hist(spark, d)))


@query("domain_js_divergence", f"""WITH {HIST}, p AS (SELECT domain, bucket, n / sum(n) OVER (PARTITION BY domain) AS p FROM hist)
SELECT a.domain AS "left", b.domain AS "right", round(sum(CASE WHEN a.p > 0 THEN a.p * log2(2 * a.p / (a.p + b.p)) ELSE 0 END + CASE WHEN b.p > 0 THEN b.p * log2(2 * b.p / (a.p + b.p)) ELSE 0 END) / 2, 6) AS js_bits
FROM p a JOIN p b ON a.bucket = b.bucket AND a.domain < b.domain GROUP BY 1, 2""")
def domain_js_divergence(spark, d):
    return rounded(timebuckets.divergence(recency_hist(spark, d)))


@query("keep_rate", f"WITH {VALID} SELECT domain, count(*) FILTER (slot_at < {CAP}) AS kept, count(*) FILTER (slot_at >= {CAP}) AS dropped, round(count(*) FILTER (slot_at < {CAP}) / count(*), 6) AS keep_rate FROM va GROUP BY 1")
def keep_rate(spark, d):
    return rounded(timebuckets.keep_rate(valid_events(spark, d)).select("domain", F.col("kept").cast("long").alias("kept"), F.col("dropped").cast("long").alias("dropped"), "keep_rate"))


@query("slot_recency", f"""WITH {VALID}, k AS (SELECT domain, slot_at, greatest(row_ts - ts, 0) AS age, least(nv, {CAP}) AS n FROM va WHERE slot_at < {CAP}),
s AS (SELECT domain, 'first' AS slot, age FROM k WHERE slot_at = 0 UNION ALL SELECT domain, 'middle', age FROM k WHERE slot_at = least(n - 1, {CAP // 2}) UNION ALL SELECT domain, 'last', age FROM k WHERE slot_at = n - 1)
SELECT domain, slot, count(*) AS n, {", ".join(f"CAST(floor(round(quantile_cont(age, {x}), 6)) AS BIGINT) AS {timebuckets.quantile_name(x)}" for x in timebuckets.QUANTILES)} FROM s GROUP BY 1, 2""")
def slot_recency(spark, d):
    return timebuckets.slot_recency(valid_events(spark, d))


ROUND_SQL = """CAST(CASE WHEN v < 60 THEN greatest(1, round_even(v / 5, 0) * 5) WHEN v < 3600 THEN round_even(v / 30, 0) * 30 WHEN v < 86400 THEN round_even(v / 300, 0) * 300 WHEN v < 2592000 THEN round_even(v / 3600, 0) * 3600 ELSE round_even(v / 86400, 0) * 86400 END AS BIGINT)"""


def edge_query(reducer: str):
    return lambda spark, d: timebuckets.rounded_quantiles(timebuckets.recencies(valid_events(spark, d)), EDGE_QUANTILES, reducer).withColumn("slot", F.col("slot").cast("long"))


for _r, _agg in (("mean", "avg(q)"), ("median", "quantile_cont(q, 0.5)")):
    query(f"edge_candidates_{_r}", f"""WITH {VALID}, p AS (SELECT domain, unnest({EDGE_QUANTILES}) AS x, unnest(quantile_cont(value, {EDGE_QUANTILES})) AS q FROM rec GROUP BY 1),
m AS (SELECT x, {_agg} AS v FROM p GROUP BY 1) SELECT row_number() OVER (ORDER BY x) - 1 AS slot, {ROUND_SQL} AS edge FROM m""")(edge_query(_r))


@query("suggested_edges", f"""WITH {VALID}, p AS (SELECT domain, unnest(quantile_cont(value, {[0.02 + 0.96 * k / 62 for k in range(63)]})) AS q FROM rec GROUP BY 1)
SELECT DISTINCT domain, CAST(greatest(1, round_even(q, 0)) AS BIGINT) AS edge FROM p""")
def suggested_edges(spark, d):
    return timebuckets.suggested_edges(timebuckets.recencies(valid_events(spark, d)), 63)


@query("duration_format", f"""WITH {VALID}, s AS (SELECT DISTINCT value AS v FROM rec) SELECT v AS seconds, CASE WHEN v < 120 THEN printf('%.0fs', v::DOUBLE) WHEN v < 7200 THEN printf('%.1fm', v / 60) WHEN v < 172800 THEN printf('%.1fh', v / 3600) ELSE printf('%.1fd', v / 86400) END AS readable,
{ROUND_SQL} AS rounded FROM s""")
def duration_format(spark, d):
    v = timebuckets.recencies(valid_events(spark, d)).select(F.col("value").alias("seconds")).distinct()
    return v.select("seconds", S.readable_duration(F.col("seconds")).alias("readable"), S.round_edge(F.col("seconds")).alias("rounded"))


@query("recency_signs", f"WITH {EVENTS} SELECT domain, count(*) FILTER (row_ts > ts) AS before, count(*) FILTER (row_ts = ts) AS at, count(*) FILTER (row_ts < ts) AS after, min(ts) AS first_ts, max(ts) AS last_ts FROM seqs WHERE ts > 0 GROUP BY 1")
def recency_signs(spark, d):
    return profile.recency_signs(adapters.event_sequences(spark, d))


# ---- schema, profile, split ------------------------------------------------------------------------------------------
@query("schema_inference", f"""WITH {EVENTS}, l AS (SELECT user_id, count(*) AS n FROM seqs GROUP BY 1)
SELECT 'user_id' AS "column", 'int' AS kind, max(user_id) + 1 AS vocab, CAST(1 AS BIGINT) AS width FROM ev UNION ALL SELECT 'token', 'int_list', max(token) + 1, (SELECT max(n) FROM l) FROM ev UNION ALL SELECT 'ts', 'int_list', max(ts) + 1, (SELECT max(n) FROM l) FROM ev""")
def schema_inference(spark, d):
    tok = adapters.event_tokens(spark, d)
    wide = tok.groupBy("user_id").agg(F.collect_list("token").alias("token"), F.collect_list("ts").alias("ts"))
    return schema.infer_columns(wide).withColumn("width", F.col("width").cast("long"))


@query("column_check", "SELECT column_name AS missing FROM (SELECT unnest(['event_id', 'user_id', 'seq_a_39', 'domain_a_seq_38']) AS column_name) WHERE column_name NOT IN ('event_id', 'ts', 'user_id', 'event_type', 'value', 'props')")
def column_check(spark, d):
    missing = schema.check_columns(table(spark, d, "events"), ["event_id", "user_id", "seq_a_39", "domain_a_seq_38"], strict=False)
    return spark.createDataFrame([(m,) for m in missing], "missing string")


@query("feature_offsets", "SELECT fid, CAST(coalesce(sum(len) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", len AS length FROM (VALUES (1, 11, 4), (2, 12, 1), (3, 13, 20), (4, 14, 256)) t(i, fid, len)")
def feature_offsets(spark, d):
    return spark.createDataFrame(schema.layout([(11, 4), (12, 1), (13, 20), (14, 256)]), "fid int, offset long, length int")


@query("dense_profile", """WITH v AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT (SELECT count(*) FROM embeddings) AS n_rows, (SELECT count(*) FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: abs(x))) = 0) AS zero_rows, (SELECT max(len(embedding)) FROM embeddings) AS width,
count(*) AS n_values, round(avg(v), 4) AS mean, round(stddev(v), 4) AS std, round(min(v), 4) AS lowest, round(max(v), 4) AS highest, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.99), 4) AS p99, count(*) FILTER (isnan(v)) AS nan_values, count(*) FILTER (isinf(v)) AS inf_values FROM v""")
def dense_profile(spark, d):
    return rounded(profile.dense_profile(table(spark, d, "embeddings"), "embedding").withColumn("width", F.col("width").cast("long")), 4)


@query("label_by_day", f"WITH {EVENTS} SELECT CAST(make_timestamp(row_ts * 1000000) AS DATE) AS day, count(*) AS n, count(*) FILTER (label_type = 2) AS pos, round(count(*) FILTER (label_type = 2) / count(*), 6) AS pos_rate FROM usr GROUP BY 1")
def label_by_day(spark, d):
    return rounded(profile.labels_by_day(adapters.user_rows(adapters.event_tokens(spark, d)), "row_ts"))


@query("rows_per_user", "SELECT n AS rows, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def rows_per_user(spark, d):
    return profile.rows_per_user(table(spark, d, "events"), "user_id")


@query("row_group_split", """WITH g AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 500) AS INT) AS row_group FROM events), s AS (SELECT max(row_group) + 1 AS n FROM g)
SELECT CASE WHEN row_group < n - greatest(1, CAST(floor(n * 0.2) AS INT)) THEN 'train' ELSE 'valid' END AS part, count(*) AS rows, min(event_id) AS first_id, max(event_id) AS last_id FROM g, s GROUP BY 1""")
def row_group_split(spark, d):
    g = profile.row_groups(table(spark, d, "events").select("event_id"), ["event_id"], 500)
    n = g.agg(F.max("row_group")).first()[0] + 1
    train, first_valid = profile.split_points(n, 0.2)
    part = F.when(F.col("row_group") < train, "train").when(F.col("row_group") >= first_valid, "valid")
    return g.withColumn("part", part).groupBy("part").agg(F.count("*").alias("rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("split_profile", f"""WITH {EVENTS}, g AS (SELECT ts, CASE WHEN domain = 'purchase' THEN 1.0 ELSE 0.0 END AS y, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 500) AS INT) AS row_group FROM ev), s AS (SELECT max(row_group) + 1 AS n FROM g),
q AS (SELECT CASE WHEN row_group < s.n - greatest(1, CAST(floor(s.n * 0.2) AS INT)) THEN 'train' ELSE 'valid' END AS part, row_group, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, avg(y) AS rate, min(ts) AS t0, max(ts) AS t1 FROM g, s GROUP BY 1, 2)
SELECT part, CAST(sum(n) AS BIGINT) AS rows, count(*) AS row_groups, CAST(sum(pos) AS BIGINT) AS pos, min(t0) AS first_ts, max(t1) AS last_ts, min(n) AS n_min, round(avg(n), 6) AS n_mean, max(n) AS n_max, round(stddev_pop(n), 6) AS n_std,
 round(min(rate), 6) AS rate_min, round(avg(rate), 6) AS rate_mean, round(max(rate), 6) AS rate_max, round(stddev_pop(rate), 6) AS rate_std, round(quantile_cont(CAST(n AS DOUBLE), 0.5), 6) AS n_p50, round(quantile_cont(rate, 0.5), 6) AS rate_p50,
 round(sum(pos) / sum(n), 6) AS pos_rate, CASE WHEN part <> 'train' THEN min(t0) - (SELECT max(t1) FROM q WHERE part = 'train') END AS gap FROM q GROUP BY 1""")
def split_profile(spark, d):
    """Sizes, labels and times of both sides of a row-group split."""
    e = adapters.event_tokens(spark, d).select("event_id", "ts", F.when(F.col("domain") == "purchase", 2).otherwise(1).alias("label_type"))
    g = profile.row_groups(e, ["event_id"], 500)
    _, first = profile.split_points(g.agg(F.max("row_group")).first()[0] + 1, 0.2)
    return rounded(profile.split_profile(g.withColumn("part", F.when(F.col("row_group") < first, "train").otherwise("valid")), "ts"))


@query("user_overlap", "WITH m AS (SELECT quantile_disc(event_id, 0.8) AS c FROM events), t AS (SELECT DISTINCT user_id FROM events, m WHERE event_id <= c), v AS (SELECT DISTINCT user_id FROM events, m WHERE event_id > c) SELECT (SELECT count(*) FROM t) AS train_users, (SELECT count(*) FROM v) AS valid_users, (SELECT count(*) FROM t JOIN v USING (user_id)) AS both")
def user_overlap(spark, d):
    e = table(spark, d, "events")
    cut = ranks.quantiles(e, [], [0.8], "event_id", nearest=True).select(F.col("v").cast("long").alias("c"))
    marked = e.crossJoin(F.broadcast(cut))  # one row
    return profile.user_overlap(marked.where("event_id <= c"), marked.where("event_id > c"), "user_id")


@query("seeded_sample", "SELECT event_id, user_id FROM events WHERE CAST('0x' || substr(md5(event_id || ':7'), 1, 8) AS BIGINT) < 429496729")
def seeded_sample(spark, d):
    return profile.seeded_order(profile.seeded_sample(table(spark, d, "events").select("event_id", "user_id"), ["event_id"], 0.1, 7), ["event_id"], 11)


# ---- metrics ---------------------------------------------------------------------------------------------------------
def scored(spark, d):
    """order key, score, label: a made-up score with ties from the tables."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.round((F.col("o_totalprice") % 1000) / 1000, 2).alias("p"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("y"))


SCORED = "sc AS (SELECT o_orderkey, round((o_totalprice % 1000) / 1000, 2) AS p, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM orders)"


@query("auc", f"""WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM sc)
SELECT count(*) AS n, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r""")
def auc(spark, d):
    return rounded(M.auc_and_log_loss(scored(spark, d), "p", "y").select("n", "auc"))


@query("logloss", f"WITH {SCORED}, q AS (SELECT y, least(greatest(p, 1e-7), 1 - 1e-7) AS p FROM sc) SELECT count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM q")
def logloss(spark, d):
    return rounded(M.auc_and_log_loss(scored(spark, d), "p", "y").select("n", "log_loss"))


@query("loss_terms", f"""WITH {SCORED}, z AS (SELECT o_orderkey, (p - 0.5) * 6 AS z, y, 1 / (1 + exp(-(p - 0.5) * 6)) AS s FROM sc), t AS (SELECT *, y * 0.9 + 0.05 AS ys, -(y * ln(s) + (1 - y) * ln(1 - s)) AS bce, CASE WHEN y = 1 THEN s ELSE 1 - s END AS pt FROM z)
SELECT round(avg(bce), 6) AS bce, round(avg(-(ys * ln(s) + (1 - ys) * ln(1 - s))), 6) AS smoothed, round(avg(CASE WHEN y = 1 THEN 0.1 ELSE 0.9 END * pow(1 - pt, 2) * bce), 6) AS focal, round(avg(s), 6) AS mean_p FROM t""")
def loss_terms(spark, d):
    z, y = (F.col("p") - 0.5) * 6, F.col("y")
    return rounded(scored(spark, d).agg(F.avg(M.bce_with_logits(z, y)).alias("bce"), F.avg(M.bce_with_logits(z, M.smooth(y, 0.1))).alias("smoothed"), F.avg(M.focal_loss(z, y)).alias("focal"), F.avg(M.sigmoid(z)).alias("mean_p")))


@query("windowed_mean_loss", f"WITH {SCORED} SELECT CAST(floor(o_orderkey / 500) AS BIGINT) AS \"window\", count(*) AS n, round(avg(p), 6) AS mean FROM sc GROUP BY 1")
def windowed_mean_loss(spark, d):
    return rounded(profile.windowed_mean(scored(spark, d), "o_orderkey", "p", 500))


@query("learning_rate", "SELECT s AS step, round(CASE WHEN s < 10 THEN s / 10 WHEN s >= 100 THEN 0.1 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (s - 10) / 90)) END, 6) AS factor FROM range(120) t(s)")
def learning_rate(spark, d):
    return rounded(spark.range(120).select(F.col("id").alias("step"), M.learning_rate_factor(F.col("id"), 10, 100, 0.1).alias("factor")))


TRACE = "tr AS (SELECT CAST(epoch(date_trunc('month', o_orderdate)) AS BIGINT) AS step, round(avg(o_totalprice), 2) AS score FROM orders GROUP BY 1)"


def trace(spark, d):
    month = F.unix_micros(F.date_trunc("month", F.col("o_orderdate")).cast("timestamp")) / 1_000_000
    return table(spark, d, "orders").groupBy(month.cast("long").alias("step")).agg(F.round(F.avg("o_totalprice"), 2).alias("score"))


@query("early_stopping_trace", f"""WITH {TRACE}, b AS (SELECT *, max(score) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, row_number() OVER (ORDER BY step) AS i FROM tr),
c AS (SELECT *, prev IS NULL OR score > prev AS improved, max(CASE WHEN prev IS NULL OR score > prev THEN i END) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM b)
SELECT step, score, greatest(score, coalesce(prev, score)) AS best, improved, i - last AS counter, max(i - last) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= 5 AS stop FROM c""")
def early_stopping_trace(spark, d):
    return M.early_stopping(trace(spark, d), "step", "score", patience=5).withColumn("counter", F.col("counter").cast("long"))


@query("moving_average", f"""WITH RECURSIVE {TRACE}, o AS (SELECT score, row_number() OVER (ORDER BY step) AS i FROM tr), r AS (SELECT i, score AS s FROM o WHERE i = 1 UNION ALL SELECT o.i, 0.9 * r.s + 0.1 * o.score FROM r JOIN o ON o.i = r.i + 1)
SELECT max(i) AS n, round(max_by(s, i), 4) AS ema FROM r""")
def moving_average(spark, d):
    lists = trace(spark, d).agg(F.sort_array(F.collect_list(F.struct("step", "score"))).alias("l"))  # a row a month
    return rounded(lists.select(F.size("l").cast("long").alias("n"), M.moving_average(F.col("l.score"), 0.9).alias("ema")), 4)


@query("dedup_last_prediction", "SELECT user_id, max_by(value, event_id) AS value FROM events GROUP BY 1")
def dedup_last_prediction(spark, d):
    return profile.last_prediction(table(spark, d, "events"), "user_id", "event_id", "value")


@query("masked_mean_pooling", f"""WITH {EVENTS}, e AS (SELECT user_id, domain, embedding FROM seqs JOIN embeddings ON vec_id = token WHERE token > 0),
l AS (SELECT user_id, domain, unnest(embedding) AS v, unnest(range(len(embedding))) AS dim FROM e) SELECT user_id, domain, dim, round(avg(CAST(v AS DOUBLE)), 5) AS value FROM l GROUP BY 1, 2, 3""")
def masked_mean_pooling(spark, d):
    tok = adapters.event_tokens(spark, d)
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))
    return rounded(profile.mean_pooling(tok, vec, ["user_id", "domain"]).withColumn("dim", F.col("dim").cast("long")), 5)


@query("token_mixing", "SELECT CAST(row_number() OVER (ORDER BY h, t, k) - 1 AS BIGINT) AS slot, t AS token, h * 2 + k AS \"offset\" FROM range(4) a(h), range(4) b(t), range(2) c(k)")
def token_mixing(spark, d):
    return spark.createDataFrame([(i, t, o) for i, (t, o) in enumerate(schema.token_mixing(4, 8))], "slot long, token long, offset long")


# ---- documented operators --------------------------------------------------------------------------------------------
@query("three_way_holdout", f"""WITH {EVENTS}, c AS (SELECT quantile_disc(ts, 0.9) AS c FROM ev)
SELECT CASE WHEN ts >= c THEN 'time_tail' WHEN CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0 THEN 'user_hash' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT user_id) AS users FROM ev, c GROUP BY 1""")
def three_way_holdout(spark, d):
    ev = adapters.event_tokens(spark, d)
    cut = ranks.quantiles(ev, [], [0.9], "ts", nearest=True).select(F.col("v").cast("long").alias("c"))
    parts = holdout.three_way(ev.crossJoin(F.broadcast(cut)), "user_id", "ts", F.col("c"))  # one row
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("frequency_truncation", """WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN n >= 35 THEN l_partkey ELSE 0 END AS kept, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def frequency_truncation(spark, d):
    ids = table(spark, d, "lineitem").select("l_partkey")
    return holdout.truncate_by_frequency(ids, "l_partkey", 35).groupBy("kept").agg(F.count("*").alias("n"))


@query("hashed_ids", "SELECT CASE WHEN l_partkey <= 0 THEN 0 ELSE CAST('0x' || substr(md5(CAST(l_partkey AS VARCHAR)), 1, 8) AS BIGINT) % 64 + 1 END AS id, count(*) AS n FROM lineitem GROUP BY 1")
def hashed_ids(spark, d):
    return table(spark, d, "lineitem").groupBy(holdout.hash_ids(F.col("l_partkey"), 64).alias("id")).agg(F.count("*").alias("n"))


@query("quantile_buckets", """WITH v AS (SELECT ln(1 + greatest(value, 0)) AS v FROM events), q AS (SELECT quantile_cont(v, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS q FROM v)
SELECT CAST(len(list_filter(q, lambda c: c < v - 1e-12)) AS BIGINT) AS bucket, count(*) AS n FROM v, q GROUP BY 1""")
def quantile_buckets(spark, d):
    return holdout.quantile_buckets(table(spark, d, "events").select("value"), "value", 8).groupBy("bucket").agg(F.count("*").alias("n"))


@query("bucketed_evaluation", f"WITH {SCORED} SELECT CAST(floor(p * 10) AS BIGINT) AS bucket, count(*) AS n, round(avg(y), 6) AS pos_rate, round(avg(p), 6) AS mean_score FROM sc GROUP BY 1")
def bucketed_evaluation(spark, d):
    return rounded(holdout.bucketed_rates(scored(spark, d), F.floor(F.col("p") * 10).cast("long"), "p", "y"))


@query("observations_per_row", f"WITH {EVENTS} SELECT count(DISTINCT user_id) AS samples, count(*) AS tokens, count(DISTINCT token) AS ids, round(count(*) / count(DISTINCT user_id), 6) AS per_sample, round(count(*) / count(DISTINCT token), 6) AS per_id FROM ev")
def observations_per_row(spark, d):
    return rounded(holdout.observations_per_row(adapters.event_tokens(spark, d), "user_id"))


@query("report_order", f"WITH {BASE[False]}, {COVER_SQL}, {REC_SQL} SELECT domain, CAST(k AS BIGINT) AS k, CAST(row_number() OVER (ORDER BY coverage DESC, domain) AS BIGINT) AS place FROM rec_k JOIN cov USING (domain, k)")
def report_order(spark, d):
    from pyspark.sql.window import Window

    cover = tail.topk_coverage(counts_of(spark, d, False), KS)
    best = tail.recommended_k(cover, KS).join(cover, ["domain", "k"])  # a row a domain
    return best.select("domain", F.col("k").cast("long").alias("k"), F.row_number().over(Window.orderBy(F.col("coverage").desc(), "domain")).cast("long").alias("place"))


@query("report_by_rescue", f"""WITH {BASE[False]}, {COVER_SQL}, {REC_SQL}, tl AS (SELECT domain, sum(n) AS total, CAST(coalesce(sum(n) FILTER (rank > 40), 0) AS BIGINT) AS tc, coalesce(sum(pos) FILTER (rank > 40), 0) AS tp FROM rk GROUP BY 1),
j AS (SELECT cov.*, tl.total, CASE WHEN tc = 0 OR tp = 0 THEN 0 ELSE pos_rate / (tp / tc) END AS lift FROM rec_k JOIN cov USING (domain, k) JOIN tl USING (domain))
SELECT domain, CAST(row_number() OVER (ORDER BY round(coverage * (1 + least(1, 2 * head_coverage)) * (0.25 + abs(lift - 1)) * ln(1 + total), 6) DESC, domain) AS BIGINT) AS place FROM j""")
def report_by_rescue(spark, d):
    from pyspark.sql.window import Window

    scores = tail.rescue_scores(counts_of(spark, d, False), KS, capacity=40)  # a row a domain
    return scores.select("domain", F.row_number().over(Window.orderBy(F.round("rescue_score", 6).desc(), "domain")).cast("long").alias("place"))


@query("loader_contract", f"""WITH {BASE[False]}, m AS (SELECT tok.*, CASE WHEN tok.token <= 0 THEN 0 ELSE coalesce(r.rank, 31) END AS mapped, lead(ts) OVER (PARTITION BY user_id, tok.domain ORDER BY pos) AS older
FROM tok LEFT JOIN (SELECT domain, token, rank FROM rk WHERE rank <= 30) r ON r.domain = tok.domain AND r.token = tok.token),
f AS (SELECT user_id, domain, pos, CASE WHEN mapped >= 24 THEN 0 ELSE mapped END AS id, {recency_sql(E.RECENCY_ORIGINAL)} AS rec, ts > 0 AS here,
 CASE WHEN pos < {CAP - 1} AND ts > 0 AND older > 0 THEN least({below('greatest(ts - older, 0)', E.GAP_EDGES)}, 31) + 1 ELSE 0 END AS gap FROM m WHERE pos < {CAP}),
l AS (SELECT user_id, domain, count(*) AS n, list(id ORDER BY pos) AS ids, list(rec ORDER BY pos) AS recs, list(gap ORDER BY pos) AS gaps FROM f GROUP BY 1, 2)
SELECT user_id, domain, n AS length, array_to_string(list_concat(ids, list_transform(range({CAP} - n), lambda x: 0)), ',') AS ids, array_to_string(list_concat(recs, list_transform(range({CAP} - n), lambda x: 0)), ',') AS recency,
array_to_string(list_concat(gaps, list_transform(range({CAP} - n), lambda x: 0)), ',') AS gap FROM l""")
def loader_contract(spark, d):
    """What the loader does to a sequence, in its order: truncate, length, clean, remap, clip, pad, recency and gap ids."""
    seq = adapters.event_sequences(spark, d)
    mapped = tail.remap_tokens(seq, tail.topk_map(tail.token_counts(seq), 30), 30)
    lists = adapters.as_lists(mapped, ["user_id", "domain", "row_ts"], ["mapped", "ts"], CAP)
    clipped = F.transform("mapped", lambda v: S.clip_vocab(S.clean_int(v), 24))
    length = S.shared_length([F.col("mapped"), F.col("ts")], CAP).cast("long")
    ids, recency, gap = S.pad_ints(clipped, CAP), S.recency_ids(F.col("row_ts"), F.col("ts"), E.RECENCY_ORIGINAL, CAP), S.gap_ids(F.col("ts"), CAP)
    return lists.select("user_id", "domain", length.alias("length"), F.array_join(ids, ",").alias("ids"), F.array_join(recency, ",").alias("recency"), F.array_join(gap, ",").alias("gap"))


@query("gather_mask", f"WITH {EVENTS}, l AS (SELECT user_id, domain, least(count(*), {CAP}) AS n FROM seqs GROUP BY 1, 2) SELECT domain, i.i AS slot, count(*) FILTER (i.i < n) AS filled FROM l, range(3) i(i) GROUP BY 1, 2")
def gather_mask(spark, d):
    lists = adapters.as_lists(adapters.event_sequences(spark, d), ["user_id", "domain"], ["token"], CAP)
    slots = lists.select("domain", F.posexplode(S.gather_mask(F.size("token"), 3)).alias("slot", "on"))
    return slots.groupBy("domain", F.col("slot").cast("long").alias("slot")).agg(F.sum(F.col("on").cast("long")).alias("filled"))


@query("holdout_ranges", f"""WITH {EVENTS}, g AS (SELECT ev.*, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 500) AS INT) AS row_group FROM ev), s AS (SELECT max(row_group) + 1 AS n FROM g), c AS (SELECT quantile_disc(ts, 0.9) AS c FROM ev),
p AS (SELECT ts, CASE WHEN ts >= c THEN 'time_tail' WHEN CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0 THEN 'user_hash' WHEN row_group >= n - greatest(1, CAST(floor(n * 0.2) AS INT)) THEN 'row_group_tail' ELSE 'train' END AS part FROM g, s, c)
SELECT part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (ts <= (SELECT max(ts) FROM p WHERE part = 'train')) AS within_train FROM p GROUP BY 1""")
def holdout_ranges(spark, d):
    """Three-way holdout with the row-group tail, and how the parts' times overlap with training."""
    g = profile.row_groups(adapters.event_tokens(spark, d), ["event_id"], 500)
    cut = ranks.quantiles(g, [], [0.9], "ts", nearest=True).select(F.col("v").cast("long").alias("c"))
    _, first = profile.split_points(g.agg(F.max("row_group")).first()[0] + 1, 0.2)
    return holdout.ts_ranges(holdout.three_way(g.crossJoin(F.broadcast(cut)), "user_id", "ts", F.col("c"), first_tail_group=F.lit(first)), "ts")  # one row
