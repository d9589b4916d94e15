"""Import sources and dimension reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finloom.schemas import IMPORT_CODES, IMPORT_ROWSET
from finloom.session import materialise

BAD_LINE = "_bad_line"


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = IMPORT_CODES,
    max_errors: int | None = 1000,
    error_path: str | None = None,
) -> DataFrame:
    """Comma-separated UTF-8 file with a header line.

    Lines that do not fit the schema go to ``<path>.errors``; more than
    ``max_errors`` of them fail the load. The file is read once: its rows are
    stored with the text of the bad lines, which are counted on the way.
    """
    names = schema.fieldNames()
    texts = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(BAD_LINE, T.StringType())])
    rows = (
        spark.read.schema(texts)
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_LINE)
        .csv(path)
    )
    # fields are read as text and converted here: the reader converts only the columns a query needs,
    # so whether it calls a line bad would depend on the query
    broken = F.col(BAD_LINE).isNotNull()
    for field in schema.fields:
        broken = broken | (F.col(field.name).isNotNull() & F.col(field.name).try_cast(field.dataType).isNull())
    line = F.when(broken, F.coalesce(F.col(BAD_LINE), F.to_csv(F.struct(*names))))
    seen = Observation("csv")
    typed = rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields], line.alias(BAD_LINE))
    stored = materialise(typed.observe(seen, F.count(BAD_LINE).alias("bad")), "csv")
    bad = seen.get.get("bad") or 0
    stored.filter(F.col(BAD_LINE).isNotNull()).select(F.col(BAD_LINE).alias("value")).write.mode("overwrite").text(error_path or f"{path.rstrip('/')}.errors")
    if max_errors is not None and bad > max_errors:
        raise ValueError(f"{bad} lines of {path} do not fit the schema; at most {max_errors} may")
    return stored.filter(F.col(BAD_LINE).isNull()).select(*names)


def read_rowset(rows: DataFrame) -> DataFrame:
    """Caller-supplied rows with resolved ids."""
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in IMPORT_ROWSET.fields])


def read_staging_table(spark: SparkSession, table: str) -> DataFrame:
    """The eight import columns of a named staging table."""
    return spark.table(table).select(*[F.col(f.name).cast(f.dataType) for f in IMPORT_CODES.fields])


def read_remote_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Import rows of a query that another database runs; it delivers no spread method."""
    rows = spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()
    wanted = [f for f in IMPORT_CODES.fields if f.name != "spread_method"]
    return rows.toDF(*[f.name for f in wanted]).select(*[F.col(f.name).cast(f.dataType) for f in wanted])


def cost_centers_as_of(history: DataFrame, at: dt.datetime) -> DataFrame:
    """Active cost centres as they were known at a moment."""
    moment = F.lit(at).cast(history.schema["valid_from"].dataType)
    return history.filter((F.col("valid_from") <= moment) & (moment < F.col("valid_to")) & F.col("is_active"))
