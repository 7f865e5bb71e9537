"""Operators without an oracle: schema model, split rules, maps, streaming, invariants."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile, tail, timebuckets
from tidemark.sources import adapters, maps, schema
from tidemark.streaming import events

SF = "/root/testdata/sf0.001"


def test_schema_round_trip(tmp_path):
    spec = {"user_int": [[1, 5, 1], [2, 9, 3]], "item_int": [[7, 4, 1]], "user_dense": [[3, 6]], "seq": {"seq_a": {"prefix": "domain_a_seq", "ts_fid": None, "features": [[38, 10], [39, 2]]}}}
    s = schema.FeatureSchema.parse(spec)
    s.write(tmp_path / "s.json")
    assert schema.FeatureSchema.read(tmp_path / "s.json").spec() == json.loads(json.dumps(spec))
    assert schema.ts_column("seq_a", s.seq["seq_a"], ["domain_a_seq_39"]) == "domain_a_seq_39"
    assert schema.ts_column("seq_a", s.seq["seq_a"], ["x_a_39", "y_b_39"]) == "x_a_39"
    assert schema.ts_column("seq_z", schema.Domain("p", None, {4: 10**9, 5: 3}), ["p_4"]) == "p_4"
    assert s.with_sample_time().user_int[-1] == (900002, 25, 1)
    assert schema.layout([(1, 3), (2, 2)]) == [(1, 0, 3), (2, 3, 2)]
    assert schema.group_indices({"a": [2, 1]}, s.user_int) == [[1, 0]]
    assert schema.parse_targets("seq_a:38, seq_b:69:10") == [("seq_a", 38, None), ("seq_b", 69, 10)]
    assert schema.parse_caps("seq_a:256,seq_b:512") == {"seq_a": 256, "seq_b": 512}
    assert schema.chunk_layout(10, 4) == (3, 2)
    with pytest.raises(ValueError):
        schema.parse_targets("nothing")


def test_split_points():
    assert profile.split_points(10, 0.1) == (9, 9)
    assert profile.split_points(10, 0.01) == (9, 9)
    assert profile.split_points(10, 0.2, train_ratio=0.5) == (4, 4)
    assert profile.split_points(10, 0.2, train_ratio=0.5, disjoint=True) == (4, 8)


def test_file_row_groups(spark, tmp_path):
    pq.write_table(pa.table({"v": list(range(25))}), tmp_path / "a.parquet", row_group_size=10)
    pq.write_table(pa.table({"v": list(range(25, 30))}), tmp_path / "b.parquet")
    got = profile.file_row_groups(spark, str(tmp_path)).groupBy("row_group").agg(F.min("v").alias("lo"), F.count("*").alias("n")).orderBy("row_group").collect()
    assert [(r.row_group, r.lo, r.n) for r in got] == [(0, 0, 10), (1, 10, 10), (2, 20, 5), (3, 25, 5)]


def test_file_row_groups_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(profile, "BROADCAST_GROUPS", 0)
    for k, name in enumerate(("a b.parquet", "c%20d.parquet", "e.parquet")):
        pq.write_table(pa.table({"v": list(range(k * 7, k * 7 + 7))}), tmp_path / name, row_group_size=3)
    got = profile.file_row_groups(spark, str(tmp_path)).groupBy("row_group").agg(F.min("v").alias("lo"), F.count("*").alias("n")).orderBy("row_group").collect()
    assert [(r.row_group, r.lo, r.n) for r in got] == [(3 * k + g, 7 * k + 3 * g, min(3, 7 - 3 * g)) for k in range(3) for g in range(3)]


def test_sample_lengths_count_absent_samples(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 2)], "k int, label_type int")
    tokens = spark.createDataFrame([(1, "a", 5, 1), (1, "a", 0, 1), (3, "a", 7, None), (3, "b", 0, None)], "k int, domain string, token long, label_type int")
    got = {tuple(r) for r in tail.sample_lengths(tokens, rows, "k").collect()}
    assert got == {("a", 1, 2, 1, 1), ("a", None, 1, 1, 1), ("a", 2, 0, 0, 2), ("b", None, 1, 0, 1), ("b", 1, 0, 0, 1), ("b", 2, 0, 0, 2)}
    assert {r.domain: (r.n_rows, r.pos_rows, r.rows_present, r.total_tokens) for r in tail.token_statistics(tokens, rows, "k").collect()} == {"a": (4, 2, 2, 3), "b": (4, 2, 0, 1)}


def test_chunk_audit():
    features, chunks = schema.chunk_audit([(1, 10, 1), (2, 20, 40), (3, 5, 2)], 2, 4)
    assert features == [(1, 0, 1, 10, 0, 0), (2, 1, 40, 20, 0, 1), (3, 41, 2, 5, 1, 1)]
    assert chunks == [(0, 6, [1, 2], True), (1, 6, [2, 3], True)]


def test_maps(spark, tmp_path):
    counts = tail.token_counts(adapters.order_sequences(spark, SF))
    top = tail.topk_map(counts, 10)
    doc = maps.map_document(top, {"parts": 1})
    maps.write_map(tmp_path / "m.json", doc)
    assert maps.read_map(spark, tmp_path / "m.json", ["parts:1"]).count() == 10
    with pytest.raises(ValueError, match="lacks"):
        maps.read_map(spark, tmp_path / "m.json", ["parts:2"])
    with pytest.raises(ValueError, match="fewer"):
        tail.recut(top, 11)
    assert maps.markdown(top, "Top").count("\n") == 13
    maps.write_predictions(profile.last_prediction(spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.3)], "u int, i int, p double"), "u", "i", "p"), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).first().p == 0.3


def test_invariants(spark):
    valid = timebuckets.valid_tokens(adapters.event_sequences(spark, SF), "user_id", {"click": 3}, 8)
    hist = timebuckets.histogram(timebuckets.recencies(valid), [60, 86400, 10**9])
    for r in timebuckets.divergence(hist).collect():
        assert 0 <= r.js_bits <= 1
    for r in timebuckets.bucket_statistics(hist).collect():
        assert 0 <= r.entropy_bits <= 1.6
    kept = {r.domain: r.kept + r.dropped for r in timebuckets.keep_rate(valid).collect()}
    assert sum(kept.values()) == valid.count()
    edges = timebuckets.edge_candidates(timebuckets.recencies(valid), [0.1, 0.5, 0.9], "median")
    assert edges == sorted(set(edges))
    by_k = [r.coverage for r in tail.topk_coverage(tail.token_counts(adapters.order_sequences(spark, SF)), [1, 5, 25]).orderBy("k").collect()]
    assert by_k == sorted(by_k)


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(events.event_stream(spark, str(tmp_path / "in"), table.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    batch = events.windowed_counts(table.withColumn("ts", F.col("ts").cast("timestamp")))
    assert spark.table("counts").count() == batch.count()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == table.count()


def test_checks_and_reports(spark, tmp_path):
    import json

    from tidemark.functions import sequences as S
    from tidemark.operators import holdout, ranks, tail
    from tidemark.sources import maps, schema

    tokens = spark.createDataFrame([("a", 3), ("a", 90), ("b", 5)], "domain string, token long")
    assert [tuple(r) for r in tail.check_bounds(tokens, 64).collect()] == [("a", 1, 90, 90)]
    with pytest.raises(ValueError, match="a: 1 values"):
        tail.check_bounds(tokens, 64, strict=True)
    assert tail.check_bounds(tokens, 100, strict=True).count() == 0
    maps.write_report(tail.check_bounds(tokens, 64), str(tmp_path / "oob.json"))
    assert json.loads((tmp_path / "oob.json").read_text()) == [{"domain": "a", "n": 1, "lowest": 90, "highest": 90}]
    users = spark.createDataFrame([("u1", 0.25), ("u2", 0.5)], "user string, p double").coalesce(1)
    assert maps.write_prediction_object(users, str(tmp_path / "p.json"), "user", "p") == 2
    assert json.loads((tmp_path / "p.json").read_text()) == {"predictions": {"u1": 0.25, "u2": 0.5}}
    assert "more rows than the 2" in maps.markdown(tokens, "t", 2) and "more rows" not in maps.markdown(tokens, "t", 3)
    own = schema.FeatureSchema.parse({"seq": {"seq_a": {"prefix": "p", "features": [[38, 10]]}}})
    schema.check_targets([("seq_a", 38, None)], own)
    with pytest.raises(ValueError, match="seq_b:38"):
        schema.check_targets([("seq_a", 38, None), ("seq_b", 38, 5)], own)
    assert holdout.row_cap(tokens, 2).count() == 2 and holdout.row_cap(tokens, 0).count() == 3
    mask = users.select(S.gather_mask(F.lit(2), 3).alias("m")).first().m
    assert mask == [True, True, False]
    texts = [spark.range(1).select(S.readable_duration(F.lit(s)).alias("t")).first().t for s in (119, 123, 129, 135, 8100, 9900, 604800)]
    assert texts == [f"{119:.0f}s", f"{123 / 60:.1f}m", f"{129 / 60:.1f}m", f"{135 / 60:.1f}m", f"{8100 / 3600:.1f}h", f"{9900 / 3600:.1f}h", f"{604800 / 86400:.1f}d"]


def test_ranks_and_quantiles(spark):
    import numpy as np

    from tidemark.operators import ranks

    rng = np.random.default_rng(3)
    rows = [(d, int(v)) for d, v in [*(("x", v) for v in rng.zipf(1.3, 3000) % 10**7), *(("y", 7) for _ in range(50)), ("z", -4), *(("w", v) for v in rng.integers(-50, 50, 999))]]
    values = spark.createDataFrame([*rows, ("x", None)], "domain string, value long")
    wanted = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r.domain, r.slot): r.v for r in ranks.quantiles(values, ["domain"], wanted).collect()}
    for d in "xyzw":
        own = np.array([v for e, v in rows if e == d])
        assert [got[d, k] for k in range(len(wanted))] == pytest.approx(np.quantile(own, wanted).tolist())
    near = {(r.domain, r.slot): r.v for r in ranks.quantiles(values, ["domain"], wanted[1:], nearest=True).collect()}
    for d in "xw":
        own = sorted(v for e, v in rows if e == d)
        assert [near[d, k] for k in range(len(wanted) - 1)] == [own[int(np.ceil(q * len(own) - 1e-9)) - 1] for q in wanted[1:]]
    assert ranks.quantiles(values.where("false"), ["domain"], [0.5]).count() == 0
    counts = [(d, int(t), int(n), int(n) // 2, int(n) // 3) for d in "ab" for t, n in zip(rng.permutation(500) ** 2, rng.geometric(0.3, 500), strict=True)]
    df = spark.createDataFrame(counts, "domain string, token long, n long, pos long, head long")
    for most in (None, 40):
        found = ranks.ranked(df, most).collect()
        for d in "ab":
            own = sorted((c for c in counts if c[0] == d), key=lambda c: (-c[2], c[1]))
            run = {c[1]: (k, sum(x[2] for x in own[:k]), sum(x[3] for x in own[:k])) for k, c in enumerate(own, 1)}
            mine = [r for r in found if r.domain == d]
            assert all((r.rank, r.run_n, r.run_pos) == run[r.token] for r in mine)
            assert len(mine) == 500 if most is None else {r.rank for r in mine} >= set(range(1, 41))
