"""CSV landing files: scan, typed projection with a quarantine, export."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.schema import ENTITY_OF_TABLE, SCHEMAS, columns
from ledgerlens.sources import records
from ledgerlens.sources.snapshots import Digest, digest_columns

DATE_FORMAT = "yyyy-MM-dd"
BAD_COLUMNS = "bad_columns"
#: The text of a record that has too few or too many fields; it counts as a bad column.
BROKEN = "broken_line"


_FORMAT = {"nullValue": "", "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}


def read_csv(spark: SparkSession, path: str, table: str, header: bool = True) -> DataFrame:
    """All columns as text, blank as null, and ``BROKEN``, the whole record where its fields are
    not as many as the table's columns. The registry gives the schema, so there is no
    inference pass; a header in another order is an error, not shifted data.

    A record may go on over line breaks within a quoted field. Such files are still read in
    splits (``records``); where no line has a quote at all, which one pass tells, every line
    is a record and Spark's own reader does it.
    """
    text = T.StructType([T.StructField(c, T.StringType()) for c in (*columns(table), BROKEN)])
    if not records.quoted(spark, path):
        reader = spark.read.schema(text).options(header=header, enforceSchema=not header, **_FORMAT)
        return reader.option("columnPruning", False).csv(path)  # fields are counted only if all are parsed
    found = records.records(spark, path)
    if header:
        named = F.lower(F.regexp_replace("record", '[" ]', "")) == ",".join(columns(table))
        wrong = F.raise_error(F.concat(F.lit("CSV header does not conform to the table: "), "record")).cast("boolean")
        found = found.filter(F.when(F.col("head"), F.when(named, F.lit(False)).otherwise(wrong)).otherwise(F.lit(True)))
    ddl = ", ".join(f"`{f.name}` STRING" for f in text)
    fields = F.from_csv("record", ddl, {**_FORMAT, "multiLine": "true"})
    return found.filter(F.trim("record") != "").select(fields.alias("r")).select("r.*")


def _typed(name: str, kind: T.DataType, timestamps: bool) -> Column:
    if isinstance(kind, T.StringType):
        return F.col(name)
    if isinstance(kind, T.DateType):
        parsed = F.try_to_timestamp(name, F.lit(DATE_FORMAT))
        return parsed if timestamps else parsed.cast("date")
    number = F.col(name).try_cast(kind)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # NaN and infinities parse, but no sum survives them.
        return F.when(F.abs(number) < float("inf"), number)
    return number


def _bad_columns(raw: DataFrame, table: str, casts: dict[str, Column]) -> Column:
    """Names of columns whose text did not parse, of a key that is missing, and of a line
    with the wrong number of fields."""
    key = ENTITY_OF_TABLE[table].key
    bad = [
        F.when(F.col(f.name).isNull(), f.name) if f.name == key
        else F.when(F.col(f.name).isNotNull() & casts[f.name].isNull(), f.name)
        for f in SCHEMAS[table]
    ]
    if BROKEN in raw.columns:
        bad.append(F.when(F.col(BROKEN).isNotNull(), BROKEN))
    return F.array_compact(F.array(*bad))


def typed(raw: DataFrame, table: str, timestamps: bool = False) -> DataFrame:
    """Text columns cast by the registry in one projection, plus ``bad_columns``: the
    columns whose text did not parse, a missing key, a broken line (empty for a good row).

    Dates are dates; ``timestamps=True`` gives them as midnight timestamps.
    """
    casts = {f.name: _typed(f.name, f.dataType, timestamps) for f in SCHEMAS[table]}
    return raw.select(*[c.alias(n) for n, c in casts.items()], _bad_columns(raw, table, casts).alias(BAD_COLUMNS))


def accepted(raw: DataFrame, table: str, timestamps: bool = False) -> DataFrame:
    """Typed rows of which every column parsed."""
    return typed(raw, table, timestamps).filter(F.size(BAD_COLUMNS) == 0).drop(BAD_COLUMNS)


def rejected(raw: DataFrame, table: str) -> DataFrame:
    """The quarantine: rows as text, as they came, with their bad columns."""
    casts = {f.name: _typed(f.name, f.dataType, False) for f in SCHEMAS[table]}
    kept = [c for c in (*columns(table), BROKEN) if c in raw.columns]
    return raw.select(*kept, _bad_columns(raw, table, casts).alias(BAD_COLUMNS)).filter(F.size(BAD_COLUMNS) > 0)


def export_csv(df: DataFrame, table: str, path: str) -> Digest:
    """CSV with header, columns in registry order, dates as ISO text, null as blank. White
    space around a text and line breaks in it stay; ``read_csv`` gives them back. The digest is
    of what was written, blank as null."""
    seen, chosen = Observation(), df.select(*columns(table))
    (
        chosen.observe(seen, *digest_columns(chosen, blank_is_null=True))
        .write.mode("overwrite")
        .option("header", True)
        .option("dateFormat", DATE_FORMAT)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return Digest(**seen.get)


def export_tables(dfs: Mapping[str, DataFrame], root: str, parallel: int = 4) -> dict[str, Digest]:
    """Every table as CSV below ``root``, a few at a time; their digests."""
    with ThreadPoolExecutor(parallel) as pool:
        return dict(zip(dfs, pool.map(lambda t: export_csv(dfs[t], t, f"{root.rstrip('/')}/{t}"), dfs), strict=True))


def export_report(report: DataFrame, path: str) -> None:
    """A quality report as JSON lines."""
    report.write.mode("overwrite").json(path)


def export_document(document: DataFrame, path: str) -> None:
    """One nested row as one JSON document."""
    document.select(F.to_json(F.struct(*document.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
