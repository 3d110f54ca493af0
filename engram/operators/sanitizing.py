"""Corpus sanitizing: pseudonyms in order of first appearance, URL hashes, the secret gate."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import EMAIL, SECRETS, URL, any_match
from ..sources.storage import written

#: Chat mentions and phone numbers.
USER, CHANNEL = r"<@(U[A-Z0-9]+)>", r"<#(C[A-Z0-9]+)\|[^>]*>"
PHONE = r"(?:\+?\d{1,3}[\s\-.]?(?:\(\d{2,4}\)[\s\-.]?)\d{3}[\s\-.]\d{2}[\s\-.]\d{2}|\+?\d{1,3}[\s\-.]?\d{3}[\s\-.]\d{3}[\s\-.]\d{4}|8[\s\-]?\d{3}[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2})"
#: Ranges in which values are numbered apart.
RANGES = 64


def numbered(values: DataFrame, order: list[str], name: str = "n", ranges: int = RANGES, within: str | None = None) -> DataFrame:
    """`values` with `name`, their place from 1 in the order of columns, among all or among those of one `within`: counted in ranges of that order, then inside each."""
    by = [within or F.lit(0).alias("__all"), *order]
    kinds = [F.col(within).alias("__within") if within else F.lit(0).alias("__within")]
    rows = written(values.repartitionByRange(ranges, *by).select("*", *kinds, F.spark_partition_id().alias("__part")), "ranges")
    before = Window.partitionBy("__within").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = rows.groupBy("__within", "__part").agg(F.count("*").alias("__c")).select("__within", "__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__within", "__part").orderBy(*order))
    joined = rows.withColumn("__inside", inside).join(F.broadcast(starts), ["__within", "__part"])  # `ranges` rows of each kind at most
    return joined.withColumn(name, F.col("__start") + F.col("__inside")).drop("__within", "__part", "__inside", "__start")


def dictionary(df: DataFrame, key: str, order: str, prefix: str, digits: int = 4) -> DataFrame:
    """(key, pseudonym): values numbered by first appearance. One row for each distinct value."""
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__first"))
    return numbered(first, ["__first", key]).select(key, F.concat(F.lit(prefix), F.lpad(F.col("n").cast("string"), digits, "0")).alias("__pseudonym"))


def _found(text: str, company: re.Pattern | None, name: str) -> tuple[list[str], list[tuple[str, str]]]:
    """A text as what stands before, between and after the places to be numbered, and these places as (kind, value).

    Kinds are looked for in turn, each in what the ones before it left.
    """
    pieces: list[tuple[str | None, str]] = [(None, text)]
    for kind, pattern in _KINDS:
        cut: list[tuple[str | None, str]] = []
        for own, piece in pieces:
            at = 0
            for m in pattern.finditer(piece) if own is None else ():
                cut += [(None, piece[at : m.start()]), (kind, m[pattern.groups and 1])]
                at = m.end()
            cut.append((own, piece[at:]))
        pieces = cut
    plain, found = [""], []
    for kind, piece in pieces:
        if kind in _NAMES:
            found.append((kind, piece))
            plain.append("")
        elif kind == "url":
            plain[-1] += "https://example.com/" + md5(piece.encode("utf-8", "replace")).hexdigest()[:8]
        else:
            plain[-1] += company.sub(lambda _: name, piece) if company else piece
    return plain, found


#: In the order in which they are looked for.
_KINDS = [(kind, re.compile(p)) for kind, p in (("user", USER), ("channel", CHANNEL), ("url", URL), ("email", EMAIL), ("phone", PHONE))]
#: What stands before and after a pseudonym's number.
_NAMES = {"user": ("<@U_FAKE_", ">"), "channel": ("<#C_FAKE_", "|fake-channel>"), "email": ("user_", "@example.com"), "phone": ("+1-555-01", "")}


def sanitize_texts(df: DataFrame, key: str, text: str, company: str = "Example", company_names: tuple[str, ...] = ()) -> DataFrame:
    """`df` with mentions of users and channels, links, addresses, phone numbers and the company's names in its texts replaced.

    Texts are read once. Each kind's distinct values are numbered by first
    appearance, by `key` (nulls last), then by their place in the text; rows of
    one key are taken in an order of their texts' hashes, so repeated rows get
    the same text. Null texts stay null.
    """
    names = re.compile(r"\b(?:" + "|".join(r"\s+".join(re.escape(w) for w in c.split()) for c in company_names) + r")\b", re.IGNORECASE) if company_names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(None, None) if t is None else _found(t, names, company) for t in batch.column(text).to_pylist()]
            found = [None if f is None else [{"kind": k, "value": v} for k, v in f] for _, f in out]
            columns = [pa.array([p for p, _ in out], pa.list_(pa.string())), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "__plain", "__found"])

    rows = df.withColumn("__row", F.monotonically_increasing_id())
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("__plain array<string>, __found array<struct<kind: string, value: string>>").fields])
    rows = written(rows.mapInArrow(cut, schema), "cut")
    places = rows.select("__row", F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("text")).alias("__of"), F.posexplode("__found").alias("__at", "__f"))
    places = places.select("__row", "__at", "__f.kind", "__f.value", F.struct("__of", "__at").alias("__first"))
    first = places.groupBy("kind", "value").agg(F.min("__first").alias("first"))
    number = F.col("n").cast("string")
    padded = F.when(F.col("n") < 100, F.lpad(number, 2, "0")).otherwise(number)
    name = reduce(lambda out, k: F.when(F.col("kind") == k, F.concat(F.lit(_NAMES[k][0]), padded, F.lit(_NAMES[k][1]))).otherwise(out), _NAMES, F.lit(None))
    known = numbered(first, ["first"], within="kind").select("kind", "value", name.alias("__name"))
    named = places.join(known, ["kind", "value"]).groupBy("__row").agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__name"))), lambda s: s["__name"]).alias("__names"))  # of one text
    whole = F.array_join(F.zip_with("__plain", F.coalesce("__names", F.array().cast("array<string>")), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    return rows.join(named, "__row", "left").withColumn(text, F.when(F.col("__plain").isNotNull(), whole)).select(df.columns)


def pseudonymize(df: DataFrame, key: str, order: str, prefix: str, digits: int = 4) -> DataFrame:
    return df.join(dictionary(df, key, order, prefix, digits), key, "left").withColumn(key, F.col("__pseudonym")).drop("__pseudonym")


def hash_urls(text):
    """Every URL as https://example.com/ and the first 8 hex digits of its MD5; pieces between URLs stay."""
    urls = F.regexp_extract_all(text, F.lit(f"({URL})"), F.lit(1))
    plain = F.split(text, URL)
    hashed = F.transform(urls, lambda u: F.concat(F.lit("https://example.com/"), F.substring(F.md5(u), 1, 8)))
    return F.array_join(F.zip_with(plain, hashed, lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))), "")


def emails_of(df: DataFrame, text: str, order: str) -> DataFrame:
    """(email, order) of every address in the texts."""
    return df.select(order, F.explode(F.regexp_extract_all(text, F.lit(f"({EMAIL})"), F.lit(1))).alias("email"))


def with_secrets(df: DataFrame, text: str) -> DataFrame:
    """Rows that stop a corpus from being written."""
    return df.filter(any_match(F.col(text), [p for _, p in SECRETS]))


def write_sanitized(df: DataFrame, text: str, path: str) -> None:
    """Write JSON lines, all or nothing: any secret stops the run before the first byte."""
    n = with_secrets(df, text).count()
    if n:
        raise ValueError(f"{n} rows hold secrets")
    df.write.json(path)
