"""Sale tables over time: upsert, stale marks, import log, vintage, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline import fixed_values as fixed
from plotline.session import settle, shuffles_deleted

KEYS = ["dedup_key", "date_mutation"]
STALE = "stale_reimport"


def upsert(target: DataFrame, batch: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows of the batch replace rows of the target with the same key."""
    return target.join(batch.select(*keys), keys, "left_anti").unionByName(batch)


def upsert_counts(target: DataFrame, batch: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    known = target.select(*keys).withColumn("known", F.lit(1))
    return batch.join(known, keys, "left").agg(
        F.count("*").alias("kept"), F.count("known").alias("updated"),
        F.count_if(F.col("known").isNull()).alias("inserted"),
    )


SCOPE = ["code_departement", "source_annee"]


def merge_import(target: DataFrame, batch: DataFrame, scope: DataFrame | None = None, current_files: DataFrame | None = None) -> DataFrame:
    """Upsert, then mark what the imported departments and vintages no longer contain.

    ``scope`` names the departments and vintages that the import covers, also
    those of which no sale was kept; without it, those of the batch.  A row kept
    again carries the batch's own mark, so marks heal themselves.  The vintage
    keeps older years out of reach.  Where a department's files arrive over
    several imports, ``current_files`` (department, vintage, import_file) names
    those that count: rows that any of them has brought are not stale.
    """
    scope = (batch if scope is None else scope).select(*SCOPE).distinct().withColumn("in_scope", F.lit(True))
    untouched = target.join(batch.select(*KEYS), KEYS, "left_anti").join(scope, SCOPE, "left")
    stale = F.coalesce(F.col("in_scope"), F.lit(False))
    if current_files is not None:
        if "import_file" not in target.columns:
            untouched = untouched.withColumn("import_file", F.lit(None).cast("string"))
        counted = current_files.select(*SCOPE, "import_file").distinct().withColumn("counts", F.lit(True))
        untouched = untouched.join(counted, [*SCOPE, "import_file"], "left")
        stale &= F.col("counts").isNull()
    marked = untouched.withColumns(
        {
            "is_outlier": F.col("is_outlier") | stale,
            "exclusion_reason": F.when(stale, STALE).otherwise(F.col("exclusion_reason")),
        }
    )
    return marked.select(*batch.columns).unionByName(batch)


def complete_scopes(manifest: DataFrame, arrived: DataFrame) -> DataFrame:
    """Departments and vintages of which every file that the manifest names has arrived.

    ``manifest``: department, vintage, import_file; ``arrived``: import_file.
    """
    here = arrived.select("import_file").distinct().withColumn("here", F.lit(1))
    files = manifest.select(*SCOPE, "import_file").distinct().join(here, "import_file", "left")
    return files.groupBy(*SCOPE).agg(F.count("*").alias("files"), F.count("here").alias("arrived")).where("files = arrived").select(*SCOPE)


def write_import(target_path: str, batch: DataFrame, scope: DataFrame | None = None, current_files: DataFrame | None = None) -> DataFrame:
    """Merge an import into a table partitioned by sale year; returns one row of counts.

    Only the years of the batch, or of rows its scope may mark, are read and
    rewritten.  The result is settled first because it replaces its source.
    """
    spark = batch.sparkSession
    batch = settle(batch.withColumn("annee", F.year("date_mutation")))
    scope = settle((batch if scope is None else scope).select(*SCOPE).distinct())
    try:
        target = spark.read.parquet(target_path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        with shuffles_deleted(spark):
            _by_year(batch).write.partitionBy("annee").parquet(target_path)
        return batch.agg(F.count("*").alias("inserted")).select(
            "inserted", F.lit(0).cast("long").alias("updated"), F.lit(0).cast("long").alias("stale_marked")
        )
    years = batch.select("annee").union(target.join(scope, SCOPE, "left_semi").select("annee")).distinct()
    touched = [row.annee for row in years.collect()]  # a handful of calendar years
    current = target.filter(F.col("annee").isin(touched))
    merged = settle(merge_import(current, batch, scope, current_files))
    fresh = current.filter(~F.col("exclusion_reason").eqNullSafe(STALE)).select(*KEYS)
    marked = merged.filter(F.col("exclusion_reason") == STALE).join(fresh, KEYS, "left_semi")
    counts = settle(
        upsert_counts(current, batch).select(
            "inserted", "updated", marked.agg(F.count("*")).scalar().alias("stale_marked")
        )
    )
    with shuffles_deleted(spark):
        _by_year(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("annee").parquet(target_path)
    return counts


def _by_year(rows: DataFrame, files: int = 16) -> DataFrame:
    """At most ``files`` files for a year instead of one from every task."""
    return rows.repartition("annee", F.pmod(F.xxhash64(*KEYS), F.lit(files)))


# --- Import log -------------------------------------------------------------


def files_to_import(manifest: DataFrame, log: DataFrame, rules_version: int) -> DataFrame:
    """Files not yet imported with success under the same rules.

    A file is known by its checksum, or by its tag where the log has one.
    """
    done = log.filter((F.col("status") == "success") & (F.col("rules_version") == rules_version))
    by = ["annee", "code_departement"]
    left = manifest.join(done.select(*by, "sha256"), [*by, "sha256"], "left_anti")
    return left.join(done.filter(F.col("etag").isNotNull()).select(*by, "etag"), [*by, "etag"], "left_anti")


def log_rows(summary: DataFrame, rejects: DataFrame, by: list[str]) -> DataFrame:
    """One log row per file with its reject counters as a map."""
    counters = rejects.groupBy(*by).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "total")))).alias("rejected_counts")
    )
    empty = F.create_map().cast("map<string,bigint>")
    return summary.join(counters, by, "left").withColumn("rejected_counts", F.coalesce("rejected_counts", empty))


def upsert_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """A forced replay updates the success row of the same file."""
    keys = ["annee", "code_departement", "sha256"]
    replaced = rows.filter("status = 'success'").select(*keys)
    success = log.filter("status = 'success'").join(replaced, keys, "left_anti")
    return success.unionByName(log.filter("status <> 'success'")).unionByName(rows)


def folded_rejects(log: DataFrame) -> DataFrame:
    """Reject counters of a run summed over its files."""
    return (
        log.select("run_id", F.explode("rejected_counts").alias("reason", "n"))
        .groupBy("run_id", "reason")
        .agg(F.sum("n").alias("total"))
    )


def run_totals(log: DataFrame) -> DataFrame:
    """Status and totals of each run, derived from its files."""
    failed = F.count_if(F.col("status") == "failed")
    status = F.when(failed == 0, "success").when(failed == F.count("*"), "failed").otherwise("partial")
    sums = [F.sum(c).alias(c) for c in ("rows_read", "rows_kept", "rows_rejected", "rows_outlier")]
    done = F.array_sort(F.collect_set("code_departement"))
    return log.groupBy("run_id").agg(status.alias("status"), F.count("*").alias("files"), *sums, done.alias("done"))


def publish_vintage(versions: DataFrame, results: DataFrame, year: int) -> DataFrame:
    """The new vintage becomes the only current one; nothing changes without a success."""
    newest = results.filter("status = 'success'").agg(
        F.max("last_modified").alias("published_on"), F.count("*").alias("n")
    ).filter("n > 0")
    name = F.coalesce(
        F.concat(F.lit("dvf-"), F.date_format("published_on", "yyyy-MM")), F.lit(f"dvf-{year}")
    )
    current = newest.select(name.alias("dataset_version"), "published_on", F.lit(True).alias("is_current"))
    known = versions.select("dataset_version", F.col("published_on").alias("before"))
    current = current.join(known, "dataset_version", "left").select(
        "dataset_version", F.coalesce("published_on", "before").alias("published_on"), "is_current"
    )
    older = versions.join(current.select("dataset_version"), "dataset_version", "left_anti")
    published = current.agg(F.count("*").alias("n")).scalar()
    older = older.withColumn("is_current", F.col("is_current") & (published == 0))
    return older.unionByName(current)


def data_status(versions: DataFrame, log: DataFrame, sales: DataFrame, indices: DataFrame) -> DataFrame:
    """One row: vintage, last import, covered departments, presence, last index quarter."""
    success = log.filter("status = 'success'")
    imports = success.agg(
        F.max("finished_at").alias("last_import_at"), F.count_distinct("code_departement").alias("covered")
    )
    current = versions.filter("is_current").agg(
        F.max("dataset_version").alias("dataset_version"), F.max("published_on").alias("published_on")
    )
    present = sales.limit(1).agg((F.count("*") > 0).alias("present"))
    quarter = indices.agg(F.max("trimestre").alias("quarter"))
    return imports.select(
        "*", current.select("dataset_version").scalar().alias("dataset_version"),
        current.select("published_on").scalar().alias("published_on"), present.scalar().alias("present"),
        quarter.scalar().alias("index_quarter"),
    )


def split_retention(rows: DataFrame, expired: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and the count of those to drop."""
    return rows.filter(~F.coalesce(expired, F.lit(False))), rows.filter(expired).agg(F.count("*").alias("total"))


def append_rows(rows: DataFrame, path: str) -> None:
    """Add rows to a log; a log is only ever appended to, or rewritten by retention."""
    rows.write.mode("append").parquet(path)


def apply_retention(spark: SparkSession, path: str, expired: Column) -> int:
    """Rewrite a log without its expired rows; returns how many went.

    The rows to keep are settled first because they replace their source.
    """
    rows = spark.read.parquet(path)
    kept, dropped = split_retention(rows, expired)
    kept, gone = settle(kept), dropped.first()["total"]
    kept.write.mode("overwrite").parquet(path)
    return gone


def log_expired(today: str, months: int = 12) -> Column:
    return F.col("created_at") < F.add_months(F.lit(today).cast("date"), -months)


def address_expired(today: str) -> Column:
    return F.col("expires_on") < F.lit(today).cast("date")


def department_list(choices: DataFrame) -> DataFrame:
    """Departments of each written choice: ``all``, one code or a comma list."""
    text = F.trim(F.coalesce(F.col("choice"), F.lit("")))
    mainland = F.transform(F.sequence(F.lit(1), F.lit(95)), lambda n: F.lpad(n.cast("string"), 2, "0"))
    corsica_and_overseas = F.array(*[F.lit(c) for c in ["2A", "2B", *fixed.OVERSEAS_WITH_SALES]])
    absent = F.array(*[F.lit(c) for c in ["20", *fixed.DEPARTMENTS_WITHOUT_SALES]])
    everything = F.array_sort(F.array_except(F.concat(mainland, corsica_and_overseas), absent))
    listed = F.transform(
        F.filter(F.transform(F.split(text, ","), lambda c: F.upper(F.trim(c))), lambda c: c != ""),
        lambda c: F.when(c.rlike(r"^\d\z"), F.concat(F.lit("0"), c)).otherwise(c),
    )
    return choices.select(
        "choice", F.when((text == "") | (F.lower(text) == "all"), everything).otherwise(listed).alias("departments")
    )
