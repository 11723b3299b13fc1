"""Streams over several micro-batches: returning sessions, imports that do not depend on batches."""

import uuid

import pytest
from pyspark.sql import functions as F

from plotline.catalog import maintenance as cm
from plotline.session import checkpoint_folder
from plotline.streaming import addresses as ad
from plotline.streaming import events as st
from plotline.streaming.ingest import ingest

FOLDER = "/root/testdata/sf0.001"


def folder(spark, name):
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def test_a_session_that_returns_is_a_visit_of_its_own(spark):
    path, out = folder(spark, "hits"), folder(spark, "touches")
    days = [
        [(1, 1, "2001-01-01 10:00:00", "?gclid=a"), (2, 3, "2001-01-01 11:00:00", "")],
        [(1, 2, "2001-01-02 09:00:00", ""), (5, 4, "2001-01-10 10:00:00", "")],  # goes on within a day
        [(1, 5, "2001-01-09 22:00:00", "?utm_source=b"), (2, 6, "2001-01-09 23:00:00", ""), (2, 7, "2001-01-10 07:00:00", "?utm_source=c"), (2, 8, "2001-01-10 06:00:00", "?utm_source=d")],
        [(9, 10, "2001-03-01 00:00:00", "")], [(9, 11, "2001-03-01 00:00:01", "")],  # heartbeats
    ]
    schema = "session_id long, event_id long, ts string, query string"
    rows = lambda part: spark.createDataFrame(part, schema).select("session_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("https://site.example/x"), "query").alias("href"), F.lit("").alias("referrer"))
    for part in days:
        rows(part).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows(part).schema).parquet(path)
        st.run_available(st.attribution(stream, "site.example"), out, f"{out}-state")
    found = spark.read.parquet(out).select("session_id", F.col("started").cast("string").alias("s"), "campaign", F.get_json_object("block", "$.source").alias("source"), F.get_json_object("block", "$.gclid").alias("gclid"))
    assert {(r.session_id, r.s): (r.campaign, r.source, r.gclid) for r in found.collect()} == {
        (1, "2001-01-01 10:00:00"): (True, None, "a"), (2, "2001-01-01 11:00:00"): (False, None, None), (5, "2001-01-10 10:00:00"): (False, None, None),
        (1, "2001-01-09 22:00:00"): (True, "b", None), (2, "2001-01-09 23:00:00"): (True, "c", None),
    }
    plan = st.attribution(spark.read.parquet(path), "site.example")._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_a_live_table_of_addresses(spark):
    path, day = folder(spark, "live"), "2001-06-{:02} 08:00:00".format
    schema = "address string, label string, resolved_at string, expires_on string"
    batches = [
        [("a", "first", day(1), "2001-06-20"), ("b", "first", day(1), "2001-06-05"), ("c", "first", day(1), "2001-07-20")],
        [("b", "renewed", day(4), "2001-07-10"), ("c", "older news", "2001-05-01 08:00:00", "2001-12-31")],
        [("d", "dead already", day(10), "2001-06-09"), ("a", "shorter", day(10), "2001-06-12"), ("a", "shorter", day(10), "2001-06-12")],
    ]
    frames = [spark.createDataFrame(b, schema).select("address", "label", F.col("resolved_at").cast("timestamp"), F.col("expires_on").cast("date")) for b in batches]
    for frame in [*frames, frames[1]]:  # a batch that is run again changes nothing
        ad.renew(spark, path, frame, ["address"], parts=2)
    live = lambda today: {(r.address, r.label) for r in ad.live_addresses(spark, path, today).collect()}
    assert live("2001-06-11") == {("a", "shorter"), ("b", "renewed"), ("c", "first")}
    assert live("2001-07-15") == {("c", "first")}
    assert live("2001-08-01") == set()


@pytest.mark.parametrize("files", [1, 200])
def test_imports_do_not_depend_on_batches(spark, files):
    built, land, state = (folder(spark, n) for n in ("built", "land", "state"))
    source = folder(spark, "lines")
    # a department's sales lie in several files
    lines = spark.read.option("header", True).csv(cm._sale_files(spark, FOLDER))
    lines.repartition(4, "id_mutation").write.option("header", True).csv(source)
    ingest(spark, source, built, land, 2001, state, files)
    rows = spark.read.parquet(built)
    assert rows.count() == 710 and rows.where("exclusion_reason = 'stale_reimport'").count() == 0
    # nothing new: nothing changes
    ingest(spark, source, built, land, 2001, state, files)
    assert spark.read.parquet(built).count() == 710
    # an import of which no sale is kept still covers its departments
    lines.withColumn("nature_mutation", F.lit("Echange")).coalesce(1).write.mode("append").option("header", True).csv(source)
    ingest(spark, source, built, land, 2001, state, files)
    rows = spark.read.parquet(built)
    assert rows.count() == 710 and rows.where("exclusion_reason = 'stale_reimport'").count() == 710


def test_a_wrong_header_stops_the_import(spark):
    source = folder(spark, "swapped")
    lines = spark.read.option("header", True).csv(cm._sale_files(spark, FOLDER)).limit(20)
    lines.select(*lines.columns[:-2], lines.columns[-1], lines.columns[-2]).coalesce(1).write.option("header", True).csv(source)
    with pytest.raises(Exception, match="(?i)header"):
        ingest(spark, source, folder(spark, "b"), folder(spark, "l"), 2001, folder(spark, "s"))


def test_a_cluster_must_name_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(Session())
