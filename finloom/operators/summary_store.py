"""Stored budget summary: versions of per-budget folders, kept up to date by signed changes.

Below the store's path, ``data/version=N/header_id=H`` has the totals per key
of one budget and ``manifest`` says which folder serves each budget in each
version. A refresh writes its data first and one manifest file last, so a
reader sees the version before or after it, never a mixture; folders are never
changed once written. A budget without lines is simply not in the manifest.

Totals are sums and counts, so a refresh does not read the lines again: the
changed lines are summed with their sign and added to the stored totals of the
budgets they belong to. One job at a time may write to a store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.operators.summary import MEASURES, line_measures, line_totals
from finloom.schemas import NATURAL_KEY, TOTAL

MANIFEST = "version long, header_id int, data_version long"
TOTALS = ", ".join([*(f"{k} int" for k in NATURAL_KEY), *(f"{m} {TOTAL.simpleString()}" for m in MEASURES[:-1]), f"{MEASURES[-1]} long"])


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The version that readers get; None for a store without any."""
    return _manifest(spark, path).agg(F.max("version")).first()[0]


def _budgets(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Data version of each budget that ``version`` serves; one entry per budget."""
    rows = _manifest(spark, path).filter((F.col("version") == version) & F.col("header_id").isNotNull())
    return {r["header_id"]: r["data_version"] for r in rows.collect()}


def _folders(spark: SparkSession, path: str, budgets: dict[int, int]) -> DataFrame:
    if not budgets:
        return spark.createDataFrame([], TOTALS)
    folders = [f"{path}/data/version={v}/header_id={h}" for h, v in sorted(budgets.items())]
    stored = spark.read.schema(TOTALS).option("basePath", f"{path}/data").parquet(*folders)
    return stored.select(*NATURAL_KEY, *MEASURES)


def write_data(totals: DataFrame, path: str, version: int) -> list[int]:
    """Write the folders of a version, unseen by readers until its manifest; the budgets that have rows."""
    target = f"{path}/data/version={version}"
    totals.write.mode("overwrite").partitionBy("header_id").parquet(target)
    written = totals.sparkSession.read.schema(TOTALS).parquet(target)
    return [r["header_id"] for r in written.select("header_id").distinct().collect()]


def write_manifest(spark: SparkSession, path: str, version: int, budgets: dict[int, int]) -> None:
    """Make a version visible with one file. A version that serves no budget still has its line."""
    rows = [(version, h, v) for h, v in sorted(budgets.items())] or [(version, None, version)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def build(lines: DataFrame, path: str) -> int:
    """Version 1: the totals of all lines."""
    spark = lines.sparkSession
    headers = write_data(line_totals(lines), path, 1)
    write_manifest(spark, path, 1, dict.fromkeys(headers, 1))
    return 1


def _consistent() -> Column:
    """True for keys that still have lines, an error for changes that do not fit the stored totals."""
    left_over = F.col(MEASURES[-1]) == 0
    wrong = F.col(MEASURES[-1]) < 0
    for m in MEASURES[:-1]:
        wrong = wrong | (left_over & (F.col(m) != 0))
    names = F.concat_ws(", ", *[F.concat(F.lit(f"{k} "), F.col(k).cast("string")) for k in NATURAL_KEY])
    return F.when(wrong, F.raise_error(F.concat(F.lit("changed lines do not fit the stored summary: "), names)).cast("boolean")).otherwise(~left_over)


def merged(stored: DataFrame, removed: DataFrame | None, added: DataFrame | None) -> DataFrame:
    """Stored totals after lines were removed and added; an updated line is removed as it was and added as it is."""
    # lines and stored totals meet in one aggregate: a line is the total of itself
    parts = stored
    for lines, sign in ((removed, -1), (added, 1)):
        if lines is not None:
            own = line_measures()
            parts = parts.unionByName(lines.select(*NATURAL_KEY, *[(own[m] * sign).cast(stored.schema[m].dataType).alias(m) for m in MEASURES]))
    sums = [F.sum(m).cast(stored.schema[m].dataType).alias(m) for m in MEASURES]
    return parts.groupBy(*NATURAL_KEY).agg(*sums).filter(_consistent())


def apply_changes(spark: SparkSession, path: str, removed: DataFrame | None = None, added: DataFrame | None = None) -> int:
    """The next version: totals of the changed lines' budgets merged, all other budgets served from where they are.

    Reads the changed lines and the stored totals of their budgets only.
    """
    before = latest_version(spark, path)
    if before is None:
        raise ValueError(f"no stored summary below {path}")
    budgets = _budgets(spark, path, before)
    changed: set[int] = set()
    for lines in (removed, added):
        if lines is not None:
            changed |= {r["header_id"] for r in lines.select("header_id").distinct().collect()}
    version = before + 1
    stored = _folders(spark, path, {h: v for h, v in budgets.items() if h in changed})
    headers = write_data(merged(stored, removed, added), path, version)
    kept = {h: v for h, v in budgets.items() if h not in changed}
    write_manifest(spark, path, version, kept | dict.fromkeys(headers, version))
    return version


def stored_totals(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Totals per key as of ``version``, the latest by default; the frame keeps serving that version while others are written."""
    version = latest_version(spark, path) if version is None else version
    if version is None:
        raise ValueError(f"no stored summary below {path}")
    return _folders(spark, path, _budgets(spark, path, version))


def superseded(spark: SparkSession, path: str, keep: int = 2) -> DataFrame:
    """header_id, data_version of the folders that none of the ``keep`` latest versions serves: they can be deleted once no reader is older."""
    manifest = _manifest(spark, path).filter("header_id IS NOT NULL")
    latest = latest_version(spark, path) or 0
    served = manifest.filter(F.col("version") > latest - keep).select("header_id", "data_version")
    return manifest.select("header_id", "data_version").distinct().join(served, ["header_id", "data_version"], "left_anti")
