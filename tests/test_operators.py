"""Golden fixtures, edge cases and properties of the operators."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.operators import changes as C
from tidemark.operators import grid as G
from tidemark.operators import grid_mix as M
from tidemark.operators import orders as O
from tidemark.operators import scenarios as S
from tidemark.operators import tickets as T
from tidemark.operators.ranking import global_rank

AS_OF = dt.datetime(2024, 1, 30, 23, 59, 59)
TS = dt.datetime(2024, 1, 30, 10, 0, 0)


def _tickets(spark, statuses):
    rows = [(i, 1, i % 3, f"t{i}", "high" if i % 2 else "low", s, "c", TS, TS,
             TS + dt.timedelta(hours=2) if s == "resolved" else None) for i, s in enumerate(statuses)]
    return spark.createDataFrame(rows, "ticket_id long, customer_id long, agent_id long, title string, "
                                       "priority string, status string, category string, created_at timestamp_ntz, "
                                       "updated_at timestamp_ntz, closed_at timestamp_ntz")


def test_status_distribution_golden(spark):
    # the reference seed: 17 tickets — resolved 10, in_progress 3, pending 4
    t = _tickets(spark, ["resolved"] * 10 + ["in_progress"] * 3 + ["pending"] * 4)
    got = {r.status: (r.ticket_count, round(r.percentage, 4)) for r in T.status_distribution(t).collect()}
    assert got == {"resolved": (10, round(1000 / 17, 4)), "in_progress": (3, round(300 / 17, 4)),
                   "pending": (4, round(400 / 17, 4))}


def test_device_status_golden(spark):
    # 20 devices: NORMAL 14, WARNING 4, CRITICAL (offline) 2
    ms = ["NORMAL"] * 14 + ["WARNING"] * 4 + ["CRITICAL"] * 2
    rows = [(i, f"d{i}", "变压器", "北京", 100.0, TS, 0.9, m, 220.0, 50.0, 40.0) for i, m in enumerate(ms)]
    dev = spark.createDataFrame(rows, "device_id long, device_name string, device_type string, location string, "
                                      "capacity_mw double, installation_date timestamp_ntz, efficiency_rate double, "
                                      "maintenance_status string, real_time_voltage double, real_time_current double, "
                                      "real_time_temperature double")
    share = {r.status: (r.device_count, r.share_pct) for r in G.status_share(G.device_status_summary(dev, AS_OF)).collect()}
    assert share == {"NORMAL": (14, 70.0), "WARNING": (4, 20.0), "CRITICAL": (2, 10.0)}
    m = G.region_metrics_named(dev, AS_OF).collect()[0]
    assert (m.grid_region, m.total_devices, m.online_devices, m.offline_devices) == ("华北电网", 20, 14, 2)


def test_user_stats_left_three_kinds(spark):
    users = spark.createDataFrame([(1, "a", "a@x", TS, TS), (2, "b", "b@x", TS, TS), (3, "c", "c@x", TS, TS)],
                                  "id long, username string, email string, created_at timestamp_ntz, updated_at timestamp_ntz")
    orders = spark.createDataFrame(
        [(10, 1, "completed", 100), (11, 1, "pending", 50), (12, 2, "pending", 70), (13, 1, None, 5)],
        "id long, user_id long, order_status string, amt int").select(
        "id", "user_id", F.col("amt").cast("decimal(12,2)").alias("order_amount"), "order_status",
        F.lit(TS).cast("timestamp_ntz").alias("created_at"), F.lit(TS).cast("timestamp_ntz").alias("updated_at"))
    d = dt.date(2024, 1, 30)
    res = {r.user_id: r for r in O.user_stats_left(O.dwd_users(users, d), O.dwd_orders(orders, users, d), d).collect()}
    # user 1: completed + NULL-status order kept; user 2 (only pending) vanishes; user 3 (no orders) stays with zeros
    assert set(res) == {1, 3}
    assert (res[1].total_orders, res[1].total_amount) == (2, 105.0)
    assert (res[3].total_orders, res[3].total_amount, res[3].avg_order_amount) == (0, 0.0, 0.0)


def test_segment_boundaries(spark):
    df = spark.createDataFrame([(500.0,), (499.99,), (100.0,), (99.99,)], "a double")
    got = [r[0] for r in df.select(R.segment_type(F.col("a"))).collect()]
    assert got == ["high_value", "medium_value", "medium_value", "low_value"]


def test_grid_rule_boundaries(spark):
    df = spark.createDataFrame([(49.9,), (50.1,), (49.8,), (50.2,), (50.21,)], "f double")
    assert [r[0] for r in df.select(R.frequency_stability(F.col("f"))).collect()] == \
        ["STABLE", "STABLE", "ACCEPTABLE", "ACCEPTABLE", "UNSTABLE"]
    df = spark.createDataFrame([("NORMAL", 75.0, 0.9, "BALANCED"), ("NORMAL", 75.01, 0.9, "BALANCED"),
                                ("HIGH", 20.0, 0.9, "BALANCED"), ("NORMAL", 20.0, 0.84, "BALANCED"),
                                ("NORMAL", 20.0, 0.9, "STRESSED"), ("NORMAL", 20.0, 0.9, "BALANCED")],
                               "e string, t double, eff double, b string")
    got = [r[0] for r in df.select(R.risk_level(F.col("e"), F.col("t"), F.col("eff"), F.col("b"))).collect()]
    assert got == ["NORMAL", "HIGH_RISK", "MEDIUM_RISK", "MEDIUM_RISK", "LOW_RISK", "NORMAL"]


def test_zero_capacity_guard_and_unguarded(spark):
    dev = spark.createDataFrame([(1, "x", "AF", 0.0, 50.0, 0.9, "NORMAL", 30.0, TS)],
                                "device_id long, device_type string, location string, capacity_mw double, "
                                "real_time_current double, efficiency_rate double, maintenance_status string, "
                                "real_time_temperature double, installation_date timestamp_ntz")
    assert G.device_status_summary(dev, AS_OF).collect()[0].load_factor == 0.0
    assert G.device_status_simple(dev, AS_OF).collect()[0].load_factor is None


def test_global_rank_matches_window(spark):
    random.seed(7)
    rows = [(i, random.randint(0, 30)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    rn = global_rank(df, [F.col("v").desc(), F.col("id").asc()], "rn")
    rk = global_rank(df, [F.col("v").desc(), F.col("id").asc()], "rk", method="rank", tie_cols=["v"])
    w = Window.orderBy(F.col("v").desc(), F.col("id").asc())
    exp = df.select("id", F.row_number().over(w).alias("rn"), F.rank().over(Window.orderBy(F.col("v").desc())).alias("rk"))
    e = {r.id: (r.rn, r.rk) for r in exp.collect()}
    a = {r.id: r.rn for r in rn.collect()}
    b = {r.id: r.rk for r in rk.collect()}
    assert a == {k: v[0] for k, v in e.items()}
    assert b == {k: v[1] for k, v in e.items()}


def test_global_rank_empty(spark):
    df = spark.createDataFrame([], "id long, v long")
    assert global_rank(df, [F.col("v").desc(), F.col("id")], "rn").count() == 0


def test_apply_changes_ties_and_deletes(spark):
    ch = spark.createDataFrame([("c", 1, 1, "a"), ("u", 2, 1, "b"), ("d", 2, 2, "x"), ("u", 2, 2, "y"),
                                ("c", 1, 2, "w"), ("u", 5, 3, "z"), ("c", 4, 3, "old")],
                               "op string, seq long, id long, v string")
    got = {r.id: r.v for r in C.apply_changes(ch, ["id"]).collect()}
    # id 2: delete and update share seq 2 → the delete wins; id 3: the stale create (seq 4) loses
    assert got == {1: "b", 3: "z"}


def test_insert_missing_keeps_existing(spark):
    s = spark.createDataFrame([(1, "a")], "id long, v string")
    n = spark.createDataFrame([(1, "new"), (2, "b")], "id long, v string")
    assert sorted(tuple(r) for r in C.insert_missing(s, n, ["id"]).collect()) == [(1, "a"), (2, "b")]


def _grid_fixture(spark):
    disp = spark.createDataFrame(
        [(i, TS + dt.timedelta(minutes=7 * i), ["AFRICA", "ASIA", "EUROPE"][i % 3], 15000.0 + 100 * i,
          15000.0 + 37 * i, [49.85, 50.0, 50.15, 49.7][i % 4], [590.0, 650.0, 760.0][i % 3],
          "BALANCED" if i % 2 else "STRESSED", ["CRITICAL", "HIGH", "NORMAL"][i % 3]) for i in range(40)],
        "dispatch_id long, event_time timestamp_ntz, grid_region string, total_demand_mw double, "
        "total_supply_mw double, frequency_hz double, voltage_level_kv double, load_balance_status string, "
        "emergency_level string")
    dev = spark.createDataFrame(
        [(k, f"d{k}", "变压器", ["AFRICA", "ASIA", "EUROPE", "AMERICA"][k % 4], 100.0,
          ["ACTIVE", "MAINTENANCE"][k % 2], 215.0 + 3 * k, 60.0, 50.0 + 4 * k, 0.8 + (k % 19) / 100, TS)
         for k in range(12)],
        "device_id long, device_name string, device_type string, location string, capacity_mw double, "
        "status string, real_time_voltage double, real_time_current double, real_time_temperature double, "
        "efficiency_rate double, event_time timestamp_ntz")
    return disp, dev


def test_summary_equals_aggregate_of_detail_pairs(spark):
    disp, dev = _grid_fixture(spark)
    det = G.smart_grid_detail(disp, dev, salt=3).withColumn("tw", F.date_format("dispatch_time", "yyyyMMddHH"))
    brute = det.groupBy("grid_region", "tw").agg(
        F.countDistinct("dispatch_id").alias("nd"), F.countDistinct("device_id").alias("nv"),
        F.round(F.avg("supply_demand_balance"), 6).alias("bal"),
        F.round(F.avg("device_health_score"), 6).alias("health"),
        F.round(F.avg("grid_efficiency"), 6).alias("geff"),
        F.round(F.count(F.when(F.col("frequency_stability") == "STABLE", 1)) * 100.0 / F.count(F.lit(1)), 6).alias("fs"),
        F.round(F.count(F.when(F.col("voltage_quality").isin("EXCELLENT", "GOOD"), 1)) * 100.0 / F.count(F.lit(1)), 6).alias("vq"),
        F.count(F.when(F.col("risk_level") == "HIGH_RISK", 1)).alias("hr"))
    fact = G.smart_grid_summary(disp, dev).select(
        "grid_region", F.col("time_window").alias("tw"), F.col("total_dispatches").alias("nd"),
        F.col("total_devices").alias("nv"), F.col("avg_supply_demand_balance").alias("bal"),
        F.col("avg_device_health").alias("health"), F.col("grid_efficiency_score").alias("geff"),
        F.col("frequency_stability_rate").alias("fs"), F.col("voltage_quality_rate").alias("vq"),
        F.col("high_risk_incidents").alias("hr"))
    a = sorted(tuple(r) for r in brute.collect())
    b = sorted(tuple(r) for r in fact.collect())
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert x[:4] == y[:4] and x[-1] == y[-1]
        assert all(abs(p - q) < 1e-5 for p, q in zip(x[4:-1], y[4:-1]))


def test_rule_mix_equals_labels_of_detail_pairs(spark):
    """Also with NULL measures on either side and rows whose region has no counterpart."""
    disp, dev = _grid_fixture(spark)
    holes = [F.when(F.col("dispatch_id") % 5 != k, F.col(c)).alias(c) for k, c in enumerate(
        ["frequency_hz", "voltage_level_kv", "load_balance_status", "emergency_level"])]
    disp = disp.unionByName(disp.select((F.col("dispatch_id") + 100).alias("dispatch_id"), "event_time", "grid_region",
                                        "total_demand_mw", "total_supply_mw", *holes))
    holes = [F.when(F.col("device_id") % 4 != k, F.col(c)).alias(c) for k, c in enumerate(
        ["real_time_voltage", "real_time_temperature", "efficiency_rate"])]
    dev = dev.unionByName(dev.select((F.col("device_id") + 101).alias("device_id"), "device_name", "device_type", "location",
                                     "capacity_mw", "status", "real_time_current", "event_time", *holes))
    det = G.smart_grid_detail(disp, dev).withColumn("tw", F.date_format("dispatch_time", "yyyyMMddHH"))
    det = det.withColumn("dashboard_status", R.dashboard_status(F.col("operational_status"), F.col("risk_level"))).persist()
    brute = sorted((r[0], r[1], rule, r[2], r[3]) for rule in M.RULES
                   for r in det.groupBy("grid_region", "tw", rule).count().collect())
    mix = M.grid_status_mix(disp, dev).select("grid_region", "time_window", "rule", "label", "pair_count")
    assert sorted(tuple(r) for r in mix.collect()) == brute
    per = det.groupBy("dispatch_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("voltage_quality") == "EXCELLENT", 1)).alias("e"),
        F.count(F.when(F.col("voltage_quality") == "GOOD", 1)).alias("g"),
        F.count(F.when(F.col("risk_level") == "HIGH_RISK", 1)).alias("h"))
    q = M.dispatch_quality(disp, dev).select("dispatch_id", "paired_devices", "excellent_devices", "good_devices",
                                             "high_risk_devices")
    assert sorted(tuple(r) for r in q.collect()) == sorted(tuple(r) for r in per.collect())
    det.unpersist()


def test_health_bands_and_overview_without_online_devices(spark):
    h = spark.createDataFrame([(95.0,), (90.0,), (85.0,), (75.0,), (70.0,), (None,)], "h double")
    assert [r[0] for r in h.select(R.temperature_from_health(F.col("h"))).collect()][:5] == [35.0, 35.0, 50.0, 65.0, 65.0]
    rows = spark.createDataFrame([("CRITICAL", 50.0, 10.0), ("CRITICAL", 60.0, 20.0)],
                                 "status string, efficiency double, load_factor double")
    assert [r[1] for r in M.device_overview_by_state(rows).collect()] == ["2", "0", "2", "0", None, None]


def test_detail_salting_does_not_change_rows(spark):
    disp, dev = _grid_fixture(spark)
    a = sorted(tuple(r) for r in G.smart_grid_detail(disp, dev, salt=1).collect())
    b = sorted(tuple(r) for r in G.smart_grid_detail(disp, dev, salt=5).collect())
    assert a == b and len(a) > 0
    st = G.device_status_from_detail(G.smart_grid_detail(disp, dev), TS + dt.timedelta(hours=5), 60).collect()
    assert all(r.status in ("NORMAL", "WARNING", "CRITICAL", "MAINTENANCE") for r in st)


def test_range_join_matches_brute_force(spark):
    random.seed(3)
    left = spark.createDataFrame([(i, random.randint(0, 3), TS + dt.timedelta(minutes=random.randint(0, 300)))
                                  for i in range(60)], "lid long, k long, lt timestamp_ntz")
    right = spark.createDataFrame([(j, random.randint(0, 3), TS + dt.timedelta(minutes=random.randint(0, 300)))
                                   for j in range(200)], "rid long, k long, rt timestamp_ntz")
    got = sorted((r.lid, r.rid) for r in S.range_join(left, right, "k", "lt", "rt", 10, 5).collect())
    L, Rr = left.collect(), right.collect()
    exp = sorted((a.lid, b.rid) for a in L for b in Rr
                 if a.k == b.k and a.lt - dt.timedelta(minutes=10) <= b.rt <= a.lt + dt.timedelta(minutes=5))
    assert got == exp and len(exp) > 0


def test_latest_logs_top_k_with_ties(spark):
    rows = [(i, 1, "a", None, None, None, TS) for i in range(15)]
    logs = spark.createDataFrame(rows, "log_id long, ticket_id long, action string, old_value string, "
                                       "new_value string, comment string, created_at timestamp_ntz")
    assert [r.log_id for r in T.latest_logs(logs, 10).collect()] == list(range(14, 4, -1))


def test_empty_input_dashboard(spark):
    u = spark.createDataFrame([], "user_id long, username string")
    o = spark.createDataFrame([], "order_id long, user_id long, order_amount decimal(12,2), "
                                  "order_status string, created_at timestamp_ntz, updated_at timestamp_ntz")
    got = {r.metric_name: r.metric_value for r in O.realtime_dashboard(u, o, dt.date(2001, 8, 1)).collect()}
    assert got == {"total_users": 0.0, "total_orders": 0.0, "total_sales": 0.0, "avg_order_value": 0.0,
                   "today_orders": 0.0, "today_sales": 0.0}


def test_window_sums_match_pairs_on_one_device(spark):
    import random
    from tidemark.operators import scenarios as S
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([(i, 7, t0 + dt.timedelta(seconds=rng.randrange(4 * 3600))) for i in range(60)]
                                 + [(100, 8, t0), (101, None, t0)], "lid long, k long, lt timestamp_ntz")
    right = spark.createDataFrame([(i, 7, t0 + dt.timedelta(minutes=rng.randrange(240)), rng.randrange(100)) for i in range(500)]
                                  + [(900, None, t0, 1)], "rid long, k long, rt timestamp_ntz, v long")
    at = F.unix_micros(F.to_timestamp("lt"))
    got = S.window_sums(left, right, "k", "lid", at - 600_000_000, at + 300_000_000, "rt", {"s": F.col("v")},
                        last=("v", "rid"))
    want = S.range_join(left, right, "k", "lt", "rt", 10, 5).groupBy("lid").agg(
        F.count("*").alias("n"), F.sum("v").alias("s"), F.max_by("v", F.struct("rt", "rid")).alias("last"))
    cols = ["lid", "n", "s", "last"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_region_summary_divides_by_measured_rows(spark):
    from tidemark.operators import grid as G
    at = dt.datetime(2024, 1, 1, 5)
    disp = spark.createDataFrame([(i, at, "华东", 100.0, s, 50.0, 600.0, "BALANCED", "NORMAL") for i, s in enumerate((200.0, None))],
                                 "dispatch_id long, event_time timestamp_ntz, grid_region string, total_demand_mw double, "
                                 "total_supply_mw double, frequency_hz double, voltage_level_kv double, "
                                 "load_balance_status string, emergency_level string")
    dev = spark.createDataFrame([(i, "华东", "ACTIVE", 231.0, t, 0.9) for i, t in enumerate((30.0, None))],
                                "device_id long, location string, status string, real_time_voltage double, "
                                "real_time_temperature double, efficiency_rate double")
    r = G.smart_grid_summary(disp, dev).first()
    assert r.avg_supply_demand_balance == 100.0 and r.avg_device_health == 132.0


def test_latency_sum_beyond_bigint(spark):
    from tidemark.operators import quality as Q
    now = dt.datetime(2024, 1, 30, 23, 59, 59)
    old = now - dt.timedelta(days=36500)
    disp = spark.createDataFrame([(1, old, "华东")], "dispatch_id long, event_time timestamp_ntz, grid_region string")
    dev = spark.range(3000).select(F.col("id").alias("device_id"), F.lit("华东").alias("location"))
    many = disp.crossJoin(spark.range(1000)).drop("id")
    assert Q.latency_stats(many, dev, now, minutes=60 * 24 * 40000).first().avg_delay_seconds == 36500 * 86400
