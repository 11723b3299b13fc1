"""Tables that are written, changed and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline import fixed_values as fixed
from plotline.catalog import maintenance as cm
from plotline.catalog import sales as cs
from plotline.catalog.entries import query
from plotline.operators import band_state as bs
from plotline.operators import leads as le
from plotline.operators import maintain as ma
from plotline.operators import market as mk
from plotline.operators import places as pl
from plotline.session import settle
from plotline.sources import sample_market as sm

_TOUCHED = "right(code_insee, 1) IN ('0', '2', '4', '6', '8')"


@query(
    "A02_refreshed_bands",
    f"""SELECT code_insee, type_local, tranche_surface, n, mediane::DOUBLE AS mediane FROM bands WHERE NOT ({_TOUCHED} AND type_local = 'maison')""",
)
def refreshed_bands(spark, d):
    """The stored bands after the houses of the touched communes have left the market."""
    path = cm._folder(spark, "bands")
    sales = settle(cs.sales_table(spark, d))
    mk.commune_bands(sales).write.parquet(f"{path}/before")
    touched = sales.where(_TOUCHED).select("code_insee")
    later = sales.where(f"NOT ({_TOUCHED} AND type_local = 'maison')")
    mk.refresh_bands(spark.read.parquet(f"{path}/before"), later, touched).write.parquet(f"{path}/after")
    rows = spark.read.parquet(f"{path}/after").select("code_insee", "type_local", "tranche_surface", "n", "mediane")
    return cs.plain(rows, doubles=["mediane"])


@query(
    "A02_incremental_bands",
    f"""SELECT code_insee, type_local, (surface_bati // 20 * 20)::INT AS tranche_surface, count(*) AS n, {cs._MONEY.format('quantile_cont(prix_m2, 0.25)')}::DOUBLE AS p25,
          {cs._MONEY.format('quantile_cont(prix_m2, 0.5)')}::DOUBLE AS mediane, {cs._MONEY.format('quantile_cont(prix_m2, 0.75)')}::DOUBLE AS p75, max(date_mutation)::VARCHAR AS date_max
        FROM sales WHERE NOT is_outlier AND NOT ({_TOUCHED} AND type_local = 'maison') GROUP BY 1, 2, 3""",
)
def incremental_bands(spark, d):
    """Bands after three imports: sales at another price, the right ones with further sales, and stale marks."""
    path, area = cm._folder(spark, "band-state"), F.substring("code_insee", 1, 4)
    sales = settle(cs.sales_table(spark, d))
    part = F.pmod(F.xxhash64("dedup_key"), F.lit(3))
    first = sales.where(part < 2).withColumn("prix_m2", F.when(part == 1, (F.col("prix_m2") + 100).cast("decimal(10,2)")).otherwise(F.col("prix_m2")))
    bs.apply_changes(spark, path, bs.changes(sales.limit(0), first, area))
    bs.apply_changes(spark, path, bs.changes(first.where(part == 1), sales.where(part > 0), area))
    stale = sales.where(f"{_TOUCHED} AND type_local = 'maison'")
    bs.apply_changes(spark, path, bs.changes(stale, stale.withColumn("is_outlier", F.lit(True)), area))
    return cs.plain(bs.bands_of(bs.read_state(spark, path)), ["date_max"], ["p25", "mediane", "p75"])


@query("G05_upserted_communes", f"SELECT code_insee, CASE WHEN {_TOUCHED} THEN upper(nom) ELSE nom END AS nom, population FROM commune_rows")
def upserted_communes(spark, d):
    """The stored communes after an import that renames some of them."""
    path = cm._folder(spark, "communes-table")
    rows = sm.on_spark(spark, d, sm.COMMUNES)
    rows.write.parquet(f"{path}/before")
    batch = rows.where(_TOUCHED).withColumn("nom", F.upper("nom"))
    pl.upsert_communes(spark.read.parquet(f"{path}/before"), batch).write.parquet(f"{path}/after")
    return spark.read.parquet(f"{path}/after").select("code_insee", "nom", "population")


@query("S09_appended_log", "SELECT run_id, code_departement, rows_read, status, n FROM import_log CROSS JOIN (VALUES (1), (2)) t(n)")
def appended_log(spark, d):
    """The import log after two runs have added their rows."""
    path = cm._folder(spark, "import-log")
    rows = cm._log(spark, d)
    for n in (1, 2):
        ma.append_rows(rows.withColumn("n", F.lit(n)), path)
    return spark.read.parquet(path).select("run_id", "code_departement", "rows_read", "status", "n")


@query("U10_rewritten_log", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '2000-08-01'")
def rewritten_log(spark, d):
    """A log after its expired rows are gone."""
    path = cm._folder(spark, "dated-log")
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("created_at"))
    ma.append_rows(rows, path)
    ma.apply_retention(spark, path, ma.log_expired(cm.TODAY))
    return spark.read.parquet(path).select("o_orderkey")


_CALLS = """SELECT CASE event_id % 4 WHEN 0 THEN 'estimation' WHEN 1 THEN 'lead' WHEN 2 THEN 'estimation_daily' ELSE 'lead_daily' END AS scope,
  user_id % 5 AS client, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts FROM {events}"""
_LIMITS = ", ".join(f"('{scope}', {text.split('/')[0]})" for scope, text in fixed.QUOTAS)


@query(
    "T03_allowance_breaches",
    f"""SELECT scope, client, window_start::VARCHAR AS window_start, count(*) AS requests FROM (SELECT scope, client, ts AS window_start FROM ({_CALLS.format(events='events')}))
        JOIN (VALUES {_LIMITS}) q(scope, allowed) USING (scope) GROUP BY scope, client, window_start, allowed HAVING count(*) > allowed""",
)
def allowance_breaches(spark, d):
    """All allowances at once, with every call of a day in its first minute."""
    calls = sm.on_spark(spark, d, _CALLS)
    found = le.allowance_breaches(calls, le.quota_table(spark))
    return found.select("scope", "client", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests")


@query(
    "S11_written_contacts",
    """SELECT lead_row AS "ID", coalesce(name, '') AS "Nom", coalesce(email, '') AS "Email", coalesce(phone, 'N/A') AS "Téléphone", coalesce(subject, '') AS "Sujet",
       coalesce(replace(message, chr(10), ' '), '') AS "Message" FROM lead_rows""",
)
def written_contacts(spark, d):
    """The contact file, read back; a file knows no difference between missing and empty."""
    path = cm._folder(spark, "contacts")
    contacts = sm.leads(spark, d)
    le.write_contacts(contacts, path)
    rows = spark.read.schema(le.contact_export(contacts).schema).option("sep", ";").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return rows.select("ID", *[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns if c != "ID"])
