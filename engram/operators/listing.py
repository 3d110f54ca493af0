"""List endpoints: filters, keyset pagination, top-k, ordered strings."""

from __future__ import annotations

import base64
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 200


def encode_cursor(created_at: datetime, key: object) -> str:
    return base64.urlsafe_b64encode(json.dumps([created_at.isoformat(), str(key)]).encode()).decode()


def decode_cursor(cursor: str) -> tuple[datetime, str]:
    at, key = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    return datetime.fromisoformat(at), key


def page(df: DataFrame, limit: int, after: tuple | None = None, at: str = "created_at", key: str = "id") -> DataFrame:
    """One row more than `limit` (1 to 200) tells that there are more; rows run by (at, key) descending, strictly after `after`."""
    limit = max(1, min(limit, MOST))
    if after is not None:
        when, last = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        df = df.filter((F.col(at) < when) | ((F.col(at) == when) & (F.col(key) < last)))
    return df.orderBy(F.col(at).desc(), F.col(key).desc()).limit(limit + 1)


def cursor_column(at: Column, key: Column) -> Column:
    """URL-safe base64 of a JSON array [at, key], built by Spark."""
    return F.translate(F.base64(F.to_json(F.array(at.cast("string"), key.cast("string"))).cast("binary")), "+/", "-_")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """`order` must end in a unique key."""
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, key: str | list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint")).filter(F.col(rank) <= k)


def ordered_text(item: Column, *order: Column, separator: str = "; ") -> Column:
    """`item`s of a group in `order`, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, item.alias("__item")))), lambda s: s["__item"]), separator)


def recent(df: DataFrame, as_of: datetime, hours: int = 48, most: int = 500, at: str = "updated_at", key: str = "id") -> DataFrame:
    """Rows changed in the last `hours`, newest first, at most `most`; deleted rows are not left out."""
    return df.filter(F.col(at) >= F.lit(as_of) - F.make_dt_interval(hours=F.lit(hours))).orderBy(F.col(at).desc(), F.col(key).desc()).limit(most)


def children(nodes: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """Direct children of `prefix` ('' is the root), by (sort_order, path)."""
    depth = prefix.count("/") + 1 if prefix else 0
    under = nodes.filter(F.col(path).startswith(prefix + "/")) if prefix else nodes
    return under.filter(F.length(path) - F.length(F.replace(F.col(path), F.lit("/"), F.lit(""))) == depth).orderBy("sort_order", path)
