"""Exchange archive day-files: three source schemas to one, hygiene, day status, range scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.frames import clean

# Column names of the public archive formats and the normalised schema.
LEGACY_FIELDS = {"SYMBOL": "symbol", "SERIES": "series", "OPEN": "open", "HIGH": "high", "LOW": "low",
                 "CLOSE": "close", "PREVCLOSE": "prev_close", "TOTTRDQTY": "volume", "TOTTRDVAL": "turnover"}
CURRENT_FIELDS = {"TckrSymb": "symbol", "SctySrs": "series", "OpnPric": "open", "HghPric": "high", "LwPric": "low",
                  "ClsPric": "close", "PrvsClsgPric": "prev_close", "TtlTradgVol": "volume", "TtlTrfVal": "turnover"}
ARCHIVE_COLUMNS = ["date", "isin", "symbol", "series", "open", "high", "low", "close", "prev_close", "volume",
                   "turnover"]
NUMERIC = ARCHIVE_COLUMNS[4:]
STAND_IN = "SYM:"
EQUITY_TYPE = "STK"
KEY_LENGTH = 12


def _renamed(raw: DataFrame, fields: dict[str, str]) -> list[Column]:
    text = {"symbol", "series"}
    return [(F.trim(F.col(src)) if dst in text else F.col(src)).alias(dst) for src, dst in fields.items()]


def from_legacy(raw: DataFrame) -> DataFrame:
    """Older files; the ones without a key column, or with a blank key, get ``SYM:`` + symbol."""
    stand_in = F.concat(F.lit(STAND_IN), F.trim("SYMBOL"))
    key = F.coalesce(F.nullif(F.trim("ISIN"), F.lit("")), stand_in) if "ISIN" in raw.columns else stand_in
    return raw.select("date", key.alias("isin"), *_renamed(raw, LEGACY_FIELDS))


def from_current(raw: DataFrame) -> DataFrame:
    """Newer files; only equity instruments when the instrument type is present."""
    rows = raw.filter(F.trim("FinInstrmTp") == EQUITY_TYPE) if "FinInstrmTp" in raw.columns else raw
    return rows.select("date", F.trim("ISIN").alias("isin"), *_renamed(raw, CURRENT_FIELDS))


def archive_normalise(legacy: Sequence[DataFrame], current: Sequence[DataFrame]) -> DataFrame:
    parts = [from_legacy(r) for r in legacy] + [from_current(r) for r in current]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*ARCHIVE_COLUMNS)


def archive_tidy(df: DataFrame) -> DataFrame:
    """Keep well-formed keys and positive closes; unreadable, NaN and infinite numbers become null."""
    rows = df.filter(F.col("isin").isNotNull() & F.col("close").isNotNull()
                     & ((F.length("isin") == KEY_LENGTH) | F.col("isin").startswith(STAND_IN)))
    typed = rows.select(*[clean(F.expr(f"try_cast({c} AS double)")).alias(c) if c in NUMERIC else F.col(c)
                          for c in ARCHIVE_COLUMNS])
    return typed.filter(F.col("close") > 0)


def weekday_calendar(bounds: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """Weekdays of the span in a one-row frame of bounds."""
    days = bounds.select(F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))).alias("date"))
    return days.filter(F.weekday("date") < 5)


def archive_day_status(calendar: DataFrame, files: DataFrame) -> DataFrame:
    """present / absent / unreadable per weekday. ``files``: date, rows read, rows corrupt.

    A file that was found but yields no usable row is never counted as a holiday.
    """
    good = F.col("rows") - F.col("corrupt")
    status = F.when(F.col("rows").isNull(), "absent").when(good > 0, "present").otherwise("unreadable")
    return calendar.join(files, "date", "left").select(
        "date", status.alias("status"), F.greatest(F.coalesce(good, F.lit(0)), F.lit(0)).cast("long").alias("rows"))


def scan_day_files(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Rows per CSV day-file with the corrupt ones counted; the day comes from the file's or its folder's name (yyyyMMdd)."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = (spark.read.schema(full).option("header", header).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt").csv(path)
            .select("*", F.col("_metadata.file_path").alias("_file")))
    day = F.to_date(F.regexp_extract("_file", r"(\d{8})[^/]*(?:/part-[^/]*)?$", 1), "yyyyMMdd")
    blank = F.coalesce(*[F.col(c).cast("string") for c in schema.names]).isNull()
    return rows.groupBy(day.alias("date")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_corrupt").isNotNull() | blank).alias("corrupt"))


def write_archive(df: DataFrame, path: str) -> None:
    (df.withColumn("year", F.year("date")).repartition("year", "date").write.mode("overwrite")
     .partitionBy("year").parquet(path))


def archive_range_scan(archive: DataFrame, start: str, end: str) -> DataFrame:
    """Days in [start, end]; on a stored archive the year filter prunes whole folders."""
    rows = archive
    if "year" in archive.columns:
        rows = rows.filter(F.col("year").between(int(start[:4]), int(end[:4]))).drop("year")
    return rows.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
