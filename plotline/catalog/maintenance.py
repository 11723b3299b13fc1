"""Files, upserts, stale marks, logs, vintage and retention."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from plotline import fixed_values as fixed
from plotline.catalog import sales as cs
from plotline.catalog.entries import part, query, shared
from plotline.operators import consolidate as co
from plotline.operators import maintain as ma
from plotline.operators import valuation as va
from plotline.session import checkpoint_folder, settle, shuffles_deleted
from plotline.sources import files as fi
from plotline.sources import sample_market as sm
from plotline.streaming.ingest import ingest

TODAY = sm.REFERENCE_DATE


def _folder(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- Files ------------------------------------------------------------------

#: The columns that the mapping fills; the others stay empty.
_TEXT = [c for c in fixed.SALE_LINE_COLUMNS if re.search(rf"\bAS {c}\b", sm.SALE_LINES)]


def _sale_files(spark, d) -> str:
    """The lines written as compressed 40-column files."""

    def build():
        path = _folder(spark, "sale-files")
        lines = sm.sale_lines(spark, d)
        blank = [c for c in fixed.SALE_LINE_COLUMNS if c not in _TEXT]
        full = lines.withColumns({c: F.lit("") for c in blank}).select(*fixed.SALE_LINE_COLUMNS)
        with shuffles_deleted(spark):
            (
                full.write.option("header", True).option("compression", "gzip").option("emptyValue", "")
                .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
            )
        return path

    return shared("sale files", spark, d, build)


_READ = ", ".join(f"coalesce({c}, '') AS {c}" for c in _TEXT)


@query("S01_read_sale_files", f"SELECT {_READ} FROM sale_lines")
def read_sale_files(spark, d):
    lines = fi.read_sale_files(spark, _sale_files(spark, d))
    return lines.select(*[F.coalesce(c, F.lit("")).alias(c) for c in _TEXT])


@query(
    "S02_header_problems",
    """SELECT 'nation=' || n_nationkey AS file, CASE n_nationkey % 5 WHEN 1 THEN 'column_names' WHEN 2 THEN 'column_count' ELSE 'column_names' END AS problem
       FROM nation WHERE n_nationkey % 5 IN (1, 2, 3)""",
)
def header_problems(spark, d):
    """One file for each nation: a good header, with two names swapped, short of one, in capitals, or after a byte-order mark."""
    path, names = _folder(spark, "headers"), fixed.SALE_LINE_COLUMNS
    swapped = [*names[:-2], names[-1], names[-2]]
    kinds = [names, swapped, names[:-1], [n.upper() for n in names], ["\ufeff" + names[0], *names[1:]]]
    header = F.element_at(F.array(*[F.lit(",".join(k)) for k in kinds]), F.col("n_nationkey").cast("int") % 5 + 1)
    rows = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("nation"), F.concat(header, F.lit("\n"), F.repeat(F.lit(","), len(names) - 1)).alias("value"))
    rows.repartition("nation").write.partitionBy("nation").text(path)
    return fi.header_problems(spark, path).select(F.regexp_extract("file", "nation=\\d+", 0).alias("file"), "problem")


@query("U06_file_checksums")
def file_checksums(spark, d):
    return fi.file_checksums(spark, d, "*.parquet").select(F.substring_index("path", "/", -1).alias("file"), "length", "sha256")


@query("S04_read_communes", "SELECT code_insee, nom, code_departement, population, longitude, latitude FROM commune_rows")
def read_communes(spark, d):
    path = _folder(spark, "communes")
    rows = sm.on_spark(spark, d, sm.COMMUNES)
    centre = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    rows.select(
        F.col("code_insee").alias("code"), "nom", F.col("codes_postaux").alias("codesPostaux"),
        F.col("code_departement").alias("codeDepartement"), F.col("code_region").alias("codeRegion"),
        F.col("code_epci").alias("codeEpci"), "population", centre.alias("centre"),
    ).write.json(path)
    return fi.read_communes(spark, path, multiline=False).select(
        "code_insee", "nom", "code_departement", "population", "longitude", "latitude"
    )


_KINDS = "CASE WHEN c_custkey % 2 = 0 THEN 'maison' ELSE 'appartement' END"
_REFERENCES = ", ".join(f"('{dep}', '{kind}', {price}::DOUBLE)" for dep, kind, price in fixed.DEPARTMENT_REFERENCES)


@query(
    "S05_reference_rows",
    f"""SELECT r.code_departement, property_type, reference_price, count(*) AS customers FROM (VALUES {_REFERENCES}) r(code_departement, property_type, reference_price)
        JOIN (SELECT c_custkey, code_departement FROM customer JOIN commune_rows ON code_insee = lpad(hex(CAST(floor(c_custkey / 8) AS BIGINT)), 5, '0')) c
        USING (code_departement) GROUP BY 1, 2, 3""",
)
def reference_rows(spark, d):
    """Department references next to the customers they would serve."""
    customers = spark.read.parquet(f"{d}/customer.parquet").withColumn(
        "code_insee", F.expr("lpad(hex(CAST(floor(c_custkey / 8) AS BIGINT)), 5, '0')")
    )
    places = sm.on_spark(spark, d, sm.COMMUNES).select("code_insee", "code_departement")
    served = customers.join(places, "code_insee").groupBy("code_departement").agg(F.count("*").alias("customers"))
    return va.department_references(spark).join(served, "code_departement")


# --- Upsert and stale marks -------------------------------------------------

_VINTAGE = "CASE WHEN date_mutation < DATE '1998-01-01' THEN 1998 ELSE 2001 END"
# Both states hold every sale; those that the other state lacks have a key of their own.
_TABLE = f"""SELECT CASE WHEN date_mutation < DATE '2001-01-01' THEN dedup_key ELSE concat('earlier-', dedup_key) END AS dedup_key, date_mutation, code_departement,
  {_VINTAGE} AS source_annee, surface_bati, is_outlier, exclusion_reason FROM sales_rows"""
_BATCH = """SELECT CASE WHEN surface_bati >= 30 AND date_mutation >= DATE '1998-01-01' THEN dedup_key ELSE concat('later-', dedup_key) END AS dedup_key, date_mutation, code_departement,
  2001 AS source_annee, surface_bati + 1 AS surface_bati, is_outlier, exclusion_reason FROM sales_rows"""
part("table_rows", _TABLE.replace("sales_rows", "sales"))
part("batch_rows", _BATCH.replace("sales_rows", "sales"))
part("merged_rows", """
  SELECT t.dedup_key, t.date_mutation, t.code_departement, t.source_annee, t.surface_bati, t.is_outlier OR s.source_annee IS NOT NULL AS is_outlier,
    CASE WHEN s.source_annee IS NOT NULL THEN 'stale_reimport' ELSE t.exclusion_reason END AS exclusion_reason
  FROM table_rows t ANTI JOIN batch_rows b USING (dedup_key, date_mutation)
    LEFT JOIN (SELECT DISTINCT code_departement, source_annee FROM batch_rows) s ON s.code_departement = t.code_departement AND s.source_annee = t.source_annee
  UNION ALL BY NAME SELECT * FROM batch_rows""")


def _states(spark, d):
    """An earlier table and a later import of the same sales."""
    rows = settle(cs.sales_table(spark, d))
    state = lambda text: spark.sql(text.replace("sales_rows", "{sales_rows}"), sales_rows=rows)
    return state(_TABLE), state(_BATCH)


_MERGED = """SELECT dedup_key, date_mutation::VARCHAR AS date_mutation, code_departement, source_annee, surface_bati, is_outlier, exclusion_reason FROM merged_rows"""


@query("U01_U03_U04_merged_table", _MERGED)
def merged_table(spark, d):
    return cs.plain(ma.merge_import(*_states(spark, d)), ["date_mutation"])


@query(
    "U02_upsert_counts",
    """SELECT count(*) AS kept, count(t.dedup_key) AS updated, count(*) - count(t.dedup_key) AS inserted FROM batch_rows b LEFT JOIN table_rows t USING (dedup_key, date_mutation)""",
)
def upsert_counts(spark, d):
    return ma.upsert_counts(*_states(spark, d))


@query("S07_U01_written_table", _MERGED)
def written_table(spark, d):
    """The same merge through a table on disk partitioned by year."""
    table, batch = _states(spark, d)
    path = _folder(spark, "sales")
    ma.write_import(path, table)
    ma.write_import(path, batch)
    return cs.plain(spark.read.parquet(path).drop("annee"), ["date_mutation"])


_STORED = """dedup_key, date_mutation::VARCHAR AS date_mutation, type_local, surface_bati, surface_terrain, prix_m2::DOUBLE AS prix_m2, is_outlier"""


def _ingested(spark, d, files_per_batch):
    """Both sale tables after the stream has imported every file."""
    built, land = _folder(spark, "built"), _folder(spark, "land")
    ingest(spark, _sale_files(spark, d), built, land, 2001, _folder(spark, "ingest-state"), files_per_batch)
    rows = spark.read.parquet(built).unionByName(spark.read.parquet(land)).select(
        "dedup_key", "date_mutation", "type_local", "surface_bati", "surface_terrain", "prix_m2", "is_outlier"
    )
    return cs.plain(rows, ["date_mutation"], ["prix_m2"])


@query("T05_ingested_files", f"SELECT {_STORED} FROM sales UNION ALL SELECT {_STORED} FROM land")
def ingested_files(spark, d):
    return _ingested(spark, d, 200)


@query("T05_ingested_file_by_file", f"SELECT {_STORED} FROM sales UNION ALL SELECT {_STORED} FROM land")
def ingested_file_by_file(spark, d):
    """The same with one file in each micro-batch."""
    return _ingested(spark, d, 1)


_PART = "(length(trim(id_mutation)) + ascii(right(trim(id_mutation), 1))) % 3"


@query(
    "U03_departments_over_several_runs",
    f"""SELECT id_mutation, {_PART} = 2 OR is_outlier AS is_outlier, CASE WHEN {_PART} = 2 THEN '{ma.STALE}' ELSE exclusion_reason END AS exclusion_reason
        FROM (SELECT id_mutation, is_outlier, exclusion_reason FROM sales UNION ALL SELECT id_mutation, is_outlier, exclusion_reason FROM land)""",
)
def departments_over_several_runs(spark, d):
    """A vintage in two lots over two runs, then published anew in two lots without a third of the sales.

    A lot is as many files as there are tasks that write it, compressed as the
    files that are read; lines of a sale share a file, as they do there.  Nothing is stale after the first three runs; the last file of the new
    publication marks what it no longer holds.
    """
    base = _folder(spark, "several-runs")
    lines = spark.read.option("header", True).csv(_sale_files(spark, d))
    part_of = F.pmod(F.length(F.trim("id_mutation")) + F.ascii(F.substring(F.trim("id_mutation"), -1, 1)), F.lit(3))
    runs = [("first-a", part_of == 0), ("first-b", part_of > 0), ("second-a", part_of == 0), ("second-b", part_of == 1)]
    departments = settle(cs.facts(spark, d).select("code_departement").distinct())
    for name, rows in runs:
        lines.where(rows).write.option("header", True).option("emptyValue", "").option("compression", "gzip").csv(f"{base}/{name}")
    # Both publications' lists of files are known before the first run.
    names = {name: _file_names(spark, f"{base}/{name}", name) for name, _ in runs}
    for n, (name, _) in enumerate(runs):
        _move_in(spark, f"{base}/in", {f"{base}/{name}/{part}": as_named for part, as_named in names[name].items()})
        listed = [x for run, _ in (runs[:2] if n < 2 else runs[2:]) for x in names[run].values()]
        manifest = departments.withColumn("source_annee", F.lit(2001)).withColumn("import_file", F.explode(F.array(*[F.lit(x) for x in listed])))
        ingest(spark, f"{base}/in", f"{base}/built", f"{base}/land", 2001, f"{base}/state", manifest=manifest)
    tables = [spark.read.parquet(f"{base}/{t}").select("id_mutation", "is_outlier", "exclusion_reason") for t in ("built", "land")]
    return tables[0].union(tables[1])


def _file_names(spark, folder: str, name: str) -> dict[str, str]:
    """The data files of a folder, and a name of its own for each."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(f.getPath().getName() for f in fs.listStatus(path(folder)) if f.getPath().getName().startswith("part-"))
    return {part: f"{name}-{i:05d}.{part.partition('.')[2]}" for i, part in enumerate(found)}


def _move_in(spark, folder: str, files: dict[str, str]) -> None:
    """Move files into a folder under their own names."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for source, name in files.items():
        fs.rename(path(source), path(f"{folder}/{name}"))


# --- Logs -------------------------------------------------------------------

part("by_department", """
  SELECT code_departement, count(*) AS rows_read, count(*) FILTER (WHERE reject_reason IS NULL) AS rows_kept,
    count(*) FILTER (WHERE reject_reason IS NOT NULL) AS rows_rejected, count(*) FILTER (WHERE exclusion_reason IS NOT NULL) AS rows_outlier
  FROM built_rows GROUP BY 1""")
part("import_log", """
  SELECT 'run-' || (length(code_departement) + rows_kept % 2) AS run_id, 2001 AS annee, *, sha256(code_departement) AS sha256,
    CASE WHEN rows_kept % 5 = 0 THEN 'failed' ELSE 'success' END AS status FROM by_department""")


def _log(spark, d):
    judged = settle(cs.built(spark, d))
    summary = co.summary(judged, "code_departement").select(
        "code_departement", F.col("mutations_seen").alias("rows_read"), F.col("kept").alias("rows_kept"),
        F.col("rejected").alias("rows_rejected"), F.col("outliers").alias("rows_outlier"),
    )
    rejects = (
        judged.filter(F.col("reject_reason").isNotNull())
        .groupBy("code_departement", F.col("reject_reason").alias("reason"))
        .agg(F.count("*").alias("total"))
    )
    run = F.concat(F.lit("run-"), F.length("code_departement") + F.col("rows_kept") % 2)
    failed = F.col("rows_kept") % 5 == 0
    return ma.log_rows(summary, rejects, ["code_departement"]).select(
        run.alias("run_id"), F.lit(2001).alias("annee"), "*", F.sha2("code_departement", 256).alias("sha256"),
        F.when(failed, "failed").otherwise("success").alias("status"),
    )


@query(
    "S09_import_log",
    """SELECT run_id, l.code_departement, rows_read, rows_kept, rows_rejected, rows_outlier, status, coalesce(c, '') AS counters FROM import_log l
       LEFT JOIN (SELECT code_departement, string_agg(reject_reason || '=' || n, ';' ORDER BY reject_reason) AS c FROM
         (SELECT code_departement, reject_reason, count(*) AS n FROM built_rows WHERE reject_reason IS NOT NULL GROUP BY 1, 2) GROUP BY 1) r
       ON r.code_departement = l.code_departement""",
)
def import_log(spark, d):
    entries = F.transform(F.array_sort(F.map_entries("rejected_counts")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return _log(spark, d).select(
        "run_id", "code_departement", "rows_read", "rows_kept", "rows_rejected", "rows_outlier", "status",
        F.array_join(entries, ";").alias("counters"),
    )


@query(
    "Q04_folded_rejects",
    """SELECT run_id, reject_reason AS reason, count(*) AS total FROM built_rows JOIN import_log USING (code_departement) WHERE reject_reason IS NOT NULL GROUP BY 1, 2""",
)
def folded_rejects(spark, d):
    return ma.folded_rejects(_log(spark, d))


@query(
    "Q05_Q06_U09_run_totals",
    """SELECT run_id, CASE WHEN count(*) FILTER (WHERE status = 'failed') = 0 THEN 'success' WHEN count(*) FILTER (WHERE status = 'failed') = count(*) THEN 'failed' ELSE 'partial' END AS status,
       count(*) AS files, sum(rows_read)::BIGINT AS rows_read, sum(rows_kept)::BIGINT AS rows_kept, sum(rows_rejected)::BIGINT AS rows_rejected, sum(rows_outlier)::BIGINT AS rows_outlier,
       string_agg(code_departement, ',' ORDER BY code_departement) AS done FROM import_log GROUP BY 1""",
)
def run_totals(spark, d):
    return ma.run_totals(_log(spark, d)).withColumn("done", F.array_join("done", ","))


_MANIFEST = """SELECT 2001 AS annee, code_departement, CASE WHEN rows_read % 3 = 0 THEN 'changed' ELSE sha256 END AS sha256,
  CASE WHEN rows_read % 2 = 0 THEN concat('tag-', code_departement) END AS etag FROM {log}"""


@query(
    "U05_files_to_import",
    f"""SELECT code_departement FROM ({_MANIFEST.format(log='import_log')}) m WHERE NOT EXISTS (SELECT 1 FROM import_log l WHERE l.status = 'success'
        AND l.code_departement = m.code_departement AND (l.sha256 = m.sha256 OR (l.rows_kept % 2 = 0 AND m.etag = 'tag-' || l.code_departement)))""",
)
def files_to_import(spark, d):
    tag = F.when(F.col("rows_kept") % 2 == 0, F.concat(F.lit("tag-"), "code_departement"))
    log = settle(_log(spark, d).withColumns({"rules_version": F.lit(2), "etag": tag}))
    manifest = spark.sql(_MANIFEST, log=log)
    return ma.files_to_import(manifest, log, 2).select("code_departement")


@query(
    "U08_upserted_log",
    """SELECT code_departement, status, rows_kept + CASE WHEN status = 'success' THEN 1 ELSE 0 END AS rows_kept FROM import_log
       UNION ALL SELECT code_departement, 'success', rows_kept + 1 FROM import_log WHERE status = 'failed'""",
)
def upserted_log(spark, d):
    """A forced replay of every file: earlier successes are updated, failures stay."""
    log = settle(_log(spark, d))
    replay = log.withColumns({"status": F.lit("success"), "rows_kept": F.col("rows_kept") + 1})
    return ma.upsert_log(log, replay).select("code_departement", "status", "rows_kept")


_RESULTS = """SELECT CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS status, CAST(o_orderdate AS DATE) AS last_modified FROM {orders}"""
_VERSIONS = """SELECT concat('dvf-', substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7)) AS dataset_version, max(CAST(o_orderdate AS DATE)) AS published_on,
  substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) = '2001-07' AS is_current FROM {orders} GROUP BY 1, 3"""


@query(
    "U07_published_vintage",
    f"""WITH v AS ({_VERSIONS.format(orders='orders')}), n AS (SELECT 'dvf-' || strftime(max(last_modified), '%Y-%m') AS dataset_version, max(last_modified) AS published_on
          FROM ({_RESULTS.format(orders='orders')}) WHERE status = 'success')
        SELECT dataset_version, published_on::VARCHAR AS published_on, false AS is_current FROM v WHERE dataset_version <> (SELECT dataset_version FROM n)
        UNION ALL SELECT dataset_version, published_on::VARCHAR, true FROM n""",
)
def published_vintage(spark, d):
    versions, results = sm.on_spark(spark, d, _VERSIONS), sm.on_spark(spark, d, _RESULTS)
    return cs.plain(ma.publish_vintage(versions, results, 2001), ["published_on"])


@query(
    "A06_data_status",
    """SELECT 'dvf-2001-07' AS dataset_version, (SELECT count(DISTINCT code_departement) FROM import_log WHERE status = 'success') AS covered, true AS present,
       (SELECT max(year(CAST(o_orderdate AS DATE)) || '-T' || quarter(CAST(o_orderdate AS DATE))) FROM orders) AS index_quarter""",
)
def data_status(spark, d):
    from plotline.operators.market import quarter_label

    log = settle(_log(spark, d).withColumn("finished_at", F.lit(TODAY).cast("timestamp")))
    orders = spark.read.parquet(f"{d}/orders.parquet")
    indices = orders.select(quarter_label(F.col("o_orderdate")).alias("trimestre"))
    return ma.data_status(sm.on_spark(spark, d, _VERSIONS), log, orders, indices).select(
        "dataset_version", "covered", "present", "index_quarter"
    )


# --- Retention and choices --------------------------------------------------


@query(
    "U10_T06_retention",
    """SELECT 'log' AS kind, count(*) FILTER (WHERE o_orderdate >= DATE '2000-08-01') AS kept, count(*) FILTER (WHERE o_orderdate < DATE '2000-08-01') AS dropped FROM orders
       UNION ALL SELECT 'address', count(*) FILTER (WHERE expires_on >= DATE '2001-08-01'), count(*) FILTER (WHERE expires_on < DATE '2001-08-01') FROM address_rows""",
)
def retention(spark, d):
    log = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").cast("timestamp").alias("created_at"))
    found = None
    for kind, rows, expired in (
        ("log", log, ma.log_expired(TODAY)),
        ("address", sm.addresses(spark, d), ma.address_expired(TODAY)),
    ):
        kept, dropped = ma.split_retention(rows, expired)
        row = kept.agg(F.count("*").alias("kept")).select(
            F.lit(kind).alias("kind"), "kept", dropped.select("total").scalar().alias("dropped")
        )
        found = row if found is None else found.unionByName(row)
    return found


_CHOICES = """SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN 'all' WHEN 1 THEN '' WHEN 2 THEN concat(CAST(c_custkey % 10 AS STRING), ', 2a,,') ELSE CAST(c_custkey % 96 AS STRING) END AS choice FROM {customer}"""


@query(
    "U11_department_lists",
    f"""WITH every AS (SELECT string_agg(c, ',' ORDER BY c) AS v FROM (SELECT lpad(n::VARCHAR, 2, '0') AS c FROM range(1, 96) t(n) UNION SELECT unnest(['2A','2B','971','972','973','974']))
          WHERE c NOT IN ('20', '57', '67', '68', '976'))
        SELECT choice, CASE WHEN choice IN ('', 'all') THEN (SELECT v FROM every) ELSE array_to_string(list_transform(list_filter(list_transform(split(choice, ','), lambda c: upper(trim(c))),
          lambda c: c <> ''), lambda c: CASE WHEN regexp_matches(c, '^\\d$') THEN '0' || c ELSE c END), ',') END AS departments FROM ({_CHOICES.format(customer='customer')})""",
)
def department_lists(spark, d):
    lists = ma.department_list(sm.on_spark(spark, d, _CHOICES))
    return lists.select("choice", F.array_join("departments", ",").alias("departments"))
