"""JSON-lines corpora: strict scan with required fields, and sniffing of chat exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("id", "raw_text", "ts", "channel_id", "actor")
SCHEMA = "id string, raw_text string, ts string, channel_id string, actor string, thread_ts string, _corrupt string"
MESSAGES = "array<struct<user:string,text:string,ts:string,thread_ts:string>>"


def _problem(fields: dict[str, Column], corrupt: Column) -> Column:
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(name)) for name, c in fields.items()]))
    return F.when(corrupt.isNotNull(), "not JSON").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))


def check_lines(lines: DataFrame, line: str) -> DataFrame:
    """`lines` with the event's fields and `problem`, as `read_events` gives them for a file."""
    parsed = F.from_json(line, SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.withColumn("__e", parsed)
    names = [f.split()[0] for f in SCHEMA.split(", ")][:-1]
    return rows.select(*lines.columns, *[F.col(f"__e.{c}").alias(f"event_{c}") for c in names], _problem({c: F.col(f"__e.{c}") for c in REQUIRED}, F.col("__e._corrupt")).alias("problem"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines corpus with `problem`: null, or why the line is refused (not JSON, or a required field missing)."""
    rows = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.withColumn("problem", _problem({c: F.col(c) for c in REQUIRED}, F.col("_corrupt"))).drop("_corrupt")


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """The corpus, or an error if any line is refused."""
    rows = read_events(spark, path)
    bad = rows.filter("problem is not null").select("problem").limit(3).collect()
    if bad:
        raise ValueError("refused lines: " + "; ".join(r.problem for r in bad))
    return rows.drop("problem")


def event_time(raw: Column) -> Column:
    """Epoch seconds (with or without a fraction) or an ISO time with offset."""
    seconds = F.timestamp_seconds(raw.try_cast("double"))
    return F.coalesce(seconds, F.try_to_timestamp(raw))


def messages(text: Column) -> Column:
    """Messages of a chat export in JSON; null for plain text."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, MESSAGES, {"mode": "PERMISSIVE"}))


def coerced_list(raw: Column) -> Column:
    """A model's list of strings that came as a JSON string; other text is null."""
    return F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>"))
