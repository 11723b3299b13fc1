"""Counters, boards and funnels that merge."""

import contextlib
import datetime
import glob
import io
import os
import uuid

from pyspark.sql import functions as F

from plotline.operators import band_state as bs
from plotline.operators import market as mk
from plotline.operators import second_wave as sw
from plotline.session import checkpoint_folder, settle

SALES = "code_insee string, type_local string, surface_bati int, prix_m2 double, date_mutation date, is_outlier boolean"


def sales(spark, rows):
    return spark.createDataFrame([(c, "maison", s, p, datetime.date(2020, 1, d), o) for c, s, p, d, o in rows], SALES).withColumn("prix_m2", F.col("prix_m2").cast("decimal(10,2)"))


def bag(frame):
    return sorted(map(tuple, frame.collect()))


def test_bands_from_counters_and_only_touched_files(spark):
    path = f"{checkpoint_folder(spark)}/bands-{uuid.uuid4().hex}"
    first = [("01001", 50, 1000.1, 1, False), ("01001", 55, 2000.0, 2, False), ("02001", 50, 1500.0, 3, False), ("02002", 50, None, 3, False), ("02002", 50, 9.0, 3, True)]
    bs.apply_changes(spark, path, bs.changes(sales(spark, []), sales(spark, first)))
    files = lambda area: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path.removeprefix('file:')}/area={area}/*.parquet")}
    kept, gone = files("01"), files("02")
    assert kept and gone
    second = [("02001", 50, 1500.0, 3, False)], [("02001", 50, 1800.5, 4, False), ("02001", 50, 1700.0, 5, False)]
    assert bs.apply_changes(spark, path, bs.changes(*[sales(spark, x) for x in second])) == ["02"]
    assert files("01") == kept and not set(files("02")) & set(gone)
    now = sales(spark, first[:2] + second[1])
    assert bag(bs.bands_of(bs.read_state(spark, path))) == bag(mk.commune_bands(now))
    # everything of an area goes
    bs.apply_changes(spark, path, bs.changes(sales(spark, second[1]), sales(spark, [])))
    assert bag(bs.bands_of(bs.read_state(spark, path))) == bag(mk.commune_bands(sales(spark, first[:2])))
    assert bs.apply_changes(spark, path, bs.changes(now, now)) == []


def test_a_funnel_follows_the_order_of_steps(spark):
    at = lambda m: datetime.datetime(2020, 1, 1, 10) + datetime.timedelta(minutes=m)
    views = [("in order", at(0), 1, 1), ("in order", at(1), 2, 2), ("in order", at(70), 3, 3), ("back and forth", at(0), 4, 1), ("back and forth", at(1), 5, 2), ("back and forth", at(2), 6, 1), ("back and forth", at(300), 7, 3),
             ("skips", at(0), 8, 1), ("skips", at(5), 9, 3), ("starts late", at(0), 10, 2), ("late then right", at(0), 11, 2), ("late then right", at(1), 12, 1), ("late then right", at(500), 13, 2), ("odd", at(0), 14, 9), ("odd", at(0), 15, None)]
    steps = spark.createDataFrame(views, "session_id string, ts timestamp, event_id long, step_number int")
    reached = {r.session_id: r.reached for r in sw.furthest_steps(steps, 4).collect()}
    assert reached == {"in order": 3, "back and forth": 3, "skips": 1, "starts late": 0, "late then right": 2}
    errors = spark.createDataFrame([("skips", 1, "email | phone"), ("skips", 1, "email"), ("x", 2, ""), ("x", 7, "email"), ("y", 1, None)], "session_id string, step_number int, error_fields string")
    rows = {r.step: (r.sessions, r.left_here, r.errors, r.sessions_with_errors, r.error_fields) for r in sw.funnel(steps, errors, 4).collect()}
    assert rows == {1: (4, 1, 3, 2, {"email": 2, "phone": 1}), 2: (3, 1, 1, 1, {}), 3: (2, 2, 0, 0, {}), 4: (0, 0, 0, 0, {})}


def test_a_board_looks_back_a_day(spark):
    at = lambda h: datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=h)
    log = [(at(1), "comparables", "radius", 95, 100), (at(20), "not-supported", None, 0, None), (at(26), "comparables", "commune", 100, 2000)]
    board = sw.operations_board(sw.board_intervals(spark.createDataFrame(log, "created_at timestamp, method_kind string, method_level string, confidence int, duration_ms int")))
    rows = sorted(board.collect(), key=lambda r: r.until)
    assert [(r.n, r.deferred, r.levels["radius"], r.levels["none"], r.confidence[9], r.p95_ms, r.too_slow, r.too_many_deferred) for r in rows] == [
        (1, 0.0, 1, 0, 1, 100, False, False), (2, 0.5, 1, 1, 1, 100, False, True), (2, 0.5, 0, 1, 1, 2000, True, True)]


def test_lines_keep_their_order_over_blocks(spark):
    from plotline import fixed_values as fixed
    from plotline.sources.files import read_sale_files

    path = f"{checkpoint_folder(spark)}/lines-{uuid.uuid4().hex}"
    lines = spark.range(20_000).coalesce(1).select(*[(F.col("id") if i == 0 else F.lit("x")).cast("string").alias(c) for i, c in enumerate(fixed.SALE_LINE_COLUMNS)])
    lines.write.option("header", True).csv(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        found = read_sale_files(spark, path)
        assert found.rdd.getNumPartitions() > 5
        ordered = [int(r[0]) for r in found.orderBy("ord").select(fixed.SALE_LINE_COLUMNS[0]).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ordered == list(range(20_000))


def _plan(rows):
    with contextlib.redirect_stdout(said := io.StringIO()):
        rows.explain()
    return said.getvalue()


def test_a_copy_that_is_large_in_memory_is_not_broadcast(spark):
    # twenty thousand samples of fifty sales: 2 MB on disk at most, 50 times as much in memory
    pick = F.struct(F.col("id").alias("rank"), F.lit(1.0).alias("price"), F.lit("sale").alias("sale_id"))
    samples = settle(spark.range(20_000).select(F.col("id").alias("search_id"), F.array_repeat(pick, 50).alias("near"), F.sha2(F.col("id").cast("string"), 256).alias("key")))
    asked = spark.range(20_000).select(F.col("id").alias("search_id"))
    joined = asked.join(samples.where("key > '0'"), "search_id")
    assert "BroadcastHashJoin" not in _plan(joined)
    assert joined.count() == 20_000
    few = settle(spark.range(10).select(F.col("id").alias("search_id")))
    assert "BroadcastHashJoin" in _plan(asked.join(few, "search_id"))


def _expanded(rows):
    """How often a plan expands lines to the grains that are folded into sales."""
    return _plan(rows).count("Generate explode")


def test_reports_on_both_kinds_of_sales_fold_the_lines_once(spark, tmp_path):
    from plotline.catalog import sales as cs

    folder, n = str(tmp_path), F.col("id")
    spark.range(1, 9).select(n.alias("c_custkey"), F.lit("HOUSEHOLD").alias("c_mktsegment")).write.parquet(f"{folder}/customer.parquet")
    spark.range(1, 41).select(
        n.alias("o_orderkey"), (n % 8 + 1).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), (n * 10_000.0).alias("o_totalprice"), F.lit("2000-05-04").alias("o_orderdate"),
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(1, 81).select(
        (n % 40 + 1).alias("l_orderkey"), n.alias("l_partkey"), n.alias("l_suppkey"), n.cast("int").alias("l_linenumber"), (n % 50).cast("double").alias("l_quantity"),
        F.lit("R").alias("l_returnflag"), F.lit("2000-06-01").alias("l_shipdate"), n.cast("double").alias("l_extendedprice"),
    ).write.parquet(f"{folder}/lineitem.parquet")
    for report in (cs.reject_counts, cs.import_summary, cs.commune_medians):
        assert _expanded(report(spark, folder)) == 0


def test_lines_of_a_sale_meet_once_and_are_cleaned_there(spark):
    from plotline import fixed_values as fixed
    from plotline.operators import consolidate as co

    columns = [F.col("id").cast("string").alias(c) for c in fixed.SALE_LINE_COLUMNS if c != "id_mutation"]
    lines = spark.range(40).select(F.concat(F.lit(" "), F.col("id") % 4).alias("id_mutation"), F.col("id").alias("ord"), F.lit("f").alias("file"), *columns)
    for scope in ((), ("file",)):
        facts = co.sale_facts(lines, *scope)
        plan = _plan(facts)
        assert plan.count("Exchange hashpartitioning") == 1
        assert "RLIKE" in plan[: plan.index("Exchange hashpartitioning")] and "RLIKE" not in plan[plan.index("Exchange hashpartitioning"):]
        assert facts.count() == 4


def test_given_tables_that_grow_are_not_broadcast(spark, tmp_path):
    from plotline.sources import sample_market as sm

    folder, n = str(tmp_path), F.col("id")
    spark.range(1, 20_001).select(n.alias("c_custkey"), F.sha2(n.cast("string"), 256).alias("c_mktsegment")).write.parquet(f"{folder}/customer.parquet")
    spark.range(1, 40_001).select(
        n.alias("o_orderkey"), (n % 20_000 + 1).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), (n * 10_000.0).alias("o_totalprice"), F.lit("2000-05-04").alias("o_orderdate"),
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(1, 81).select(
        (n % 40 + 1).alias("l_orderkey"), n.alias("l_partkey"), n.alias("l_suppkey"), n.cast("int").alias("l_linenumber"), (n % 50).cast("double").alias("l_quantity"),
        F.lit("R").alias("l_returnflag"), F.lit("2000-06-01").alias("l_shipdate"), n.cast("double").alias("l_extendedprice"),
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(25).select(n.cast("int").alias("n_nationkey"), F.lit("NATION_1").alias("n_name"), F.lit(1).alias("n_regionkey")).write.parquet(f"{folder}/nation.parquet")
    lines = sm.sale_lines(spark, folder)
    assert "BroadcastHashJoin" not in _plan(lines)
    assert lines.count() == 80
    communes, requests = sm.communes(spark, folder), sm.requests(spark, folder)
    assert "BroadcastHashJoin" not in _plan(spark.range(10).join(requests, F.col("id") == F.col("request_id")))
    joined = spark.range(10).join(communes.select("code_insee"), F.col("id").cast("string") == F.col("code_insee"))
    assert "SortMergeJoin" in _plan(joined)


def test_distance_of_a_pair_is_computed_once(spark):
    from plotline.operators import comparables as cp

    asked = spark.range(3).select(
        F.col("id").alias("search_id"), F.lit("maison").alias("property_type"), F.lit(100.0).alias("surface"), F.lit(None).cast("double").alias("ref_med"),
        F.when(F.col("id") < 2, F.lit(2.0)).alias("lon"), (F.col("id") * 0.01 + 48).alias("lat"),
    )
    sold = spark.range(3).select(
        F.concat(F.lit("s"), F.col("id")).alias("sale_id"), F.lit("maison").alias("type_local"), F.lit(100).alias("surface"), F.lit("2001-01-01").cast("date").alias("date_mutation"),
        F.lit(3000.0).alias("price"), F.lit(3e5).alias("value"), F.lit(2.0).alias("longitude"), F.when(F.col("id") < 2, F.col("id") * 0.01 + 48).alias("latitude"), F.lit(True).alias("geoloc_fine"),
    )
    pairs = cp.radius_pairs(settle(asked), settle(sold), 500, F.lit("2000-01-01").cast("date"))
    assert len([line for line in _plan(pairs).splitlines() if "SIN(" in line.upper()]) == 1
    assert sorted((r.search_id, r.sale_id, r.distance) for r in pairs.collect()) == [(0, "s0", 0.0), (1, "s1", 0.0)]


def test_lots_of_a_publication_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Each of the four lots is as many files as tasks write it, and the manifest names them all."""
    from plotline.catalog import maintenance as cm

    names = cm.fixed.SALE_LINE_COLUMNS
    source = tmp_path / "sale-files"
    source.mkdir()
    for n in range(3):
        rows = [",".join(key if c == "id_mutation" else "" for c in names) for key in (f"{n}3", f"{n}4", f"{n}5")]
        (source / f"part-{n}.csv").write_text("\n".join([",".join(names), *rows]) + "\n")
    runs = []

    def ingest(spark, folder, built, land, vintage, state, manifest):
        runs.append((sorted(f for f in os.listdir(folder) if not f.startswith(".")), sorted(r.import_file for r in manifest.select("import_file").distinct().collect())))
        empty = spark.createDataFrame([], "id_mutation string, is_outlier boolean, exclusion_reason string")
        for path in (built, land):
            empty.write.mode("overwrite").parquet(path)

    monkeypatch.setattr(cm, "_sale_files", lambda spark, d: str(source))
    monkeypatch.setattr(cm.cs, "facts", lambda spark, d: spark.sql("SELECT '10' AS code_departement"))
    monkeypatch.setattr(cm, "ingest", ingest)
    monkeypatch.setattr(cm, "checkpoint_folder", lambda spark: str(tmp_path))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1m")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        cm.departments_over_several_runs(spark, "unused")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(runs) == 4
    folder, listed = runs[0]
    lot = [f for f in folder if f.startswith("first-a-")]
    assert len(lot) == 3 and set(lot) < set(listed) and len(listed) == 6
    assert set(runs[1][0]) == set(runs[1][1]) and {f.rsplit("-", 1)[0] for f in runs[3][1]} == {"second-a", "second-b"}
