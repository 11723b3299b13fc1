"""What the comparable search shuffles, and that its results are those of a plain search."""

import contextlib
import datetime
import io
import random
import time

from pyspark.sql import functions as F

from plotline.functions import geo
from plotline.operators import comparables as cp
from plotline.session import settle

TODAY = "2001-08-01"
SALES = (
    "sale_id string, type_local string, surface int, surface_terrain int, date_mutation date, price double, value double, rooms int, street string, city string, "
    "code_insee string, code_departement string, longitude double, latitude double, geoloc_fine boolean, code_epci string, code_region string, densite_grille int, med double"
)
SEARCHES = (
    "search_id long, property_type string, surface double, lon double, lat double, ref_med double, code_insee string, code_epci string, code_departement string, "
    "code_region string, densite_grille int"
)


def plan(frame):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        frame.explain()
    return said.getvalue()


def market(spark, n=600):
    dice = random.Random(5)
    sold, asked = [], []
    for i in range(n):
        kind, place = dice.choice(["maison", "appartement", "terrain"]), dice.choice(["01001", "01002", "02001"])
        sold.append((
            f"s{i}", kind, dice.randint(1, 300), dice.randint(0, 900), datetime.date(1997 + dice.randint(0, 3), dice.randint(1, 12), 3), dice.choice([100.0, 2500.0, 3000.0]), 2e5, 3,
            "rue", "ville", place, place[:2], 2 + dice.uniform(-0.09, 0.09), 48 + dice.uniform(-0.06, 0.06), True, "e" + place[1], "r", dice.choice([None, 1]), dice.choice([None, 2000.0, 2600.0]),
        ))
    for i in range(40):
        kind, place = dice.choice(["maison", "appartement", "terrain"]), dice.choice(["01001", "02001", None])
        asked.append((
            i % 38, kind if i < 38 else asked[i - 38][1], float(dice.randint(1, 300)), 2 + dice.uniform(-0.09, 0.09), 48 + dice.uniform(-0.06, 0.06), dice.choice([None, 2000.0]),
            place, "e0", "01", "r", dice.choice([None, 1]),
        ))
    return settle(spark.createDataFrame(asked, SEARCHES)), settle(spark.createDataFrame(sold, SALES)), asked, sold


def metres(spark, pairs):
    """Distance of each pair of points, by the library's formula."""
    rows = spark.createDataFrame(list(enumerate(pairs)), "i int, p struct<a:double,b:double,c:double,d:double>")
    return {r.i: r.m for r in rows.select("i", geo.distance_m(F.col("p.a"), F.col("p.b"), F.col("p.c"), F.col("p.d")).alias("m")).collect()}


def ago(months):
    years, month = divmod(8 - months - 1, 12)
    return datetime.date(2001 + years, month + 1, 1)


def near_by_hand(spark, asked, sold, attempts):
    """(id, attempt, sale, rank, distance); an id at several places ranks their sales together."""
    couples = [(a, s) for a in asked for s in sold if a[1] == s[1]]
    far = metres(spark, [(a[3], a[4], s[12], s[13]) for a, s in couples])
    rows = []
    for t in attempts:
        fits = {}
        for i, (a, s) in enumerate(couples):
            base, wider, _ = cp.fixed.SEARCH_PROFILES[a[1]]
            ratio = (wider if t.wide else base) / 100
            guarded = t.guarded and s[18] is not None and a[5] is not None and abs(s[18] - a[5]) > cp.fixed.GUARD_TOLERANCE * a[5]
            if far[i] <= t.radius and max(0.0, a[2] * (1 - ratio)) <= s[2] <= a[2] * (1 + ratio) and s[4] >= ago(t.months) and not guarded:
                fits.setdefault((a[0], a[1]), []).append((far[i], s[0]))
        for (key, _), found in fits.items():
            rows += [(key, t.number, sale, rank, distance) for rank, (distance, sale) in enumerate(sorted(found)[:200], 1)]
    return sorted(rows)


def test_pairs_are_ranked_where_they_are_made(spark, monkeypatch):
    """As by hand, also for an id at two places and keys cut into parts; pairs are not shuffled."""
    asked, sold, questions, offers = market(spark)
    attempts = [a for a in cp.PLAN if a.level == "radius"]
    flat = lambda x: sorted(map(tuple, x.select("search_id", "attempt_no", "x.sale_id", "x.rank", "x.distance").collect()))
    once = asked.where("search_id > 1")
    monkeypatch.setattr(cp, "_TASK_SEARCHES", 2)
    for some, rows in ((asked, questions), (once, [q for q in questions if q[0] > 1])):
        expected = near_by_hand(spark, rows, offers, attempts)
        assert len(expected) > 1000
        assert flat(cp.radius_samples(some, sold, attempts, TODAY)) == expected
    steps = plan(cp.radius_near(once, sold, attempts, TODAY))
    assert "Window" in steps
    above = steps[: steps.index("SortMergeJoin")]
    assert "Exchange" not in above


def test_a_settled_copy_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size())}
    before = {f for f in files() if f.startswith("shuffle_")}
    settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    until = time.time() + 20
    while (left := {f for f in files() if f.startswith("shuffle_")} - before) and time.time() < until:
        time.sleep(0.2)
    assert not left


def area_by_hand(spark, asked, sold, attempts):
    """(id, attempt, sale, rank, distance) of the 200 sales closest in surface, newest first."""
    where = {"commune": (6, 10), "epci": (7, 15), "departement": (8, 11), "region": (9, 16)}
    rows = []
    for t in attempts:
        for a in asked:
            base, wider, _ = cp.fixed.SEARCH_PROFILES[a[1]]
            ratio, found = (wider if t.wide else base) / 100, []
            for s in sold:
                if t.level == "national":
                    inside = a[10] is None or s[17] == a[10]
                else:
                    mine, theirs = where[t.level]
                    inside = a[mine] is not None and s[theirs] == a[mine]
                if inside and s[1] == a[1] and s[4] >= ago(t.months) and max(0.0, a[2] * (1 - ratio)) <= s[2] <= a[2] * (1 + ratio):
                    found.append((abs(s[2] - a[2]), -s[4].toordinal(), s[0], s[12], s[13]))
            rows += [(a[0], t.number, f[2], rank, (a[3], a[4], f[3], f[4])) for rank, f in enumerate(sorted(found)[:200], 1)]
    far = metres(spark, [r[4] for r in rows])
    return sorted((*r[:4], far[i]) for i, r in enumerate(rows))


def test_requests_meet_their_area_once(spark):
    """As by hand, where 200 sales of an area are fewer than all; bins are no rows, and placed sales are not shuffled by search."""
    asked, sold, questions, offers = market(spark, 2500)
    asked, questions = asked.where("search_id > 1"), [q for q in questions if q[0] > 1]
    attempts = [a for a in cp.PLAN if a.level != "radius"]
    found = cp.area_samples(asked, sold, attempts, TODAY)
    rows = sorted(map(tuple, found.select("search_id", "attempt_no", "x.sale_id", "x.rank", "x.distance").collect()))
    expected = area_by_hand(spark, questions, offers, attempts)
    assert max(r[3] for r in expected) == 200
    assert rows == expected
    assert "explode(sequence(" not in plan(found)


def test_chosen_samples_are_shuffled_once(spark):
    """Samples join their searches where they are made; each sale of a sample has its columns and distance."""
    asked, sold, questions, offers = market(spark)
    asked = asked.where("search_id > 1")
    outcomes = cp.find_comparables(asked, sold, TODAY)
    chosen = cp.chosen_samples(asked, outcomes, sold)
    joined = asked.hint("merge").join(chosen, "search_id")
    steps = plan(joined)
    assert "ObjectHashAggregate" in steps
    samples = steps[: steps.index("ObjectHashAggregate")]
    assert samples.count("Exchange") == 1  # of the searches
    place, first = {q[0]: q for q in questions}, {r.search_id: r.attempt_no for r in cp.first_accepted(outcomes).withColumnRenamed("accepted_no", "attempt_no").collect()}
    rows = [(r.search_id, x) for r in joined.collect() for x in r.sample]
    assert {k for k, _ in rows} == set(first) and len(rows) > 100
    known = {s[0]: s for s in offers}
    far = metres(spark, [(place[k][3], place[k][4], known[x.sale_id][12], known[x.sale_id][13]) for k, x in rows])
    for i, (_, x) in enumerate(rows):
        s = known[x.sale_id]
        assert (x.surface, x.land, x.date, x.price, x.street, x.distance) == (s[2], s[3], s[4], s[5], s[8], far[i])


def test_values_are_kept_without_their_samples(spark, monkeypatch, tmp_path):
    """Settled values hold no sales, and settled statistics hold only the sales that were kept."""
    from plotline.catalog import comparables as cc
    from plotline.catalog import valuation as cv

    asked, sold, _, _ = market(spark)
    asked = asked.where("search_id > 1").selectExpr(
        "*", "search_id AS request_id", "'D' AS dpe", "CAST(NULL AS STRING) AS condition", "CAST(NULL AS STRING) AS outdoor", "CAST(NULL AS INT) AS floor",
        "CAST(NULL AS BOOLEAN) AS has_elevator", "500D AS terrain_size", "'exact' AS precision")
    land = sold.select("code_insee", "code_departement", "date_mutation", F.lit(30.0).alias("prix_m2"), F.lit(False).alias("is_outlier"))
    outcomes = cp.find_comparables(asked, sold, TODAY)
    monkeypatch.setattr(cc, "searches", lambda spark, d: asked)
    monkeypatch.setattr(cc, "market", lambda spark, d: {"sales": sold, "land": land})
    monkeypatch.setattr(cc, "outcomes", lambda spark, d: outcomes)
    valued, measured = cv.valued(spark, str(tmp_path)), cv.measured(spark, str(tmp_path))
    assert not {"sample", "kept"} & set(valued.columns) and "sample" not in measured.columns and "kept" in measured.columns
    assert valued.count() == measured.count() == cp.first_accepted(outcomes).count() > 0
    houses = valued.where("property_type = 'maison'").agg(F.count("*"), F.count_if(F.col("land_price") == 30.0)).first()
    assert houses[0] and valued.where("property_type <> 'maison' AND land_price IS NOT NULL").isEmpty()


def test_lots_of_a_publication_are_compressed(spark, tmp_path, monkeypatch):
    from plotline.catalog import maintenance as cm

    names = cm.fixed.SALE_LINE_COLUMNS
    (tmp_path / "sale-files").mkdir()
    rows = [",".join(key if c == "id_mutation" else "" for c in names) for key in ("13", "14", "15", "16")]
    (tmp_path / "sale-files" / "part-0.csv").write_text("\n".join([",".join(names), *rows]) + "\n")
    read = []

    def ingest(spark, folder, built, land, vintage, state, manifest):
        listed = {r.import_file for r in manifest.select("import_file").distinct().collect()}
        read.append((listed, spark.read.option("header", True).csv(folder).select("id_mutation", "_metadata.file_name").collect()))
        empty = spark.createDataFrame([], "id_mutation string, is_outlier boolean, exclusion_reason string")
        for path in (built, land):
            empty.write.mode("overwrite").parquet(path)

    monkeypatch.setattr(cm, "_sale_files", lambda spark, d: str(tmp_path / "sale-files"))
    monkeypatch.setattr(cm.cs, "facts", lambda spark, d: spark.sql("SELECT '10' AS code_departement"))
    monkeypatch.setattr(cm, "ingest", ingest)
    monkeypatch.setattr(cm, "checkpoint_folder", lambda spark: str(tmp_path))
    cm.departments_over_several_runs(spark, "unused")
    assert sorted(r.id_mutation for r in read[1][1]) == ["13", "14", "15", "16"]
    assert {r.file_name for r in read[1][1]} <= read[1][0] and all(f.endswith(".csv.gz") for f in read[1][0] | read[3][0])
