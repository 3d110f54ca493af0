"""Access tiers and the caller's context."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Access tiers in order; an unknown level counts as the last.
LEVELS = ("public", "channel", "private", "restricted")
#: Levels that a scope opens.
SCOPES = {"read": {"public", "channel"}, "write": {"public", "channel", "private"}, "admin": set(LEVELS)}


def tier_rank(level: Column | str) -> Column:
    level = F.col(level) if isinstance(level, str) else level
    out = F
    for rank, name in enumerate(LEVELS):
        out = out.when(level == name, rank)
    return out.otherwise(len(LEVELS) - 1)


def rank_to_level(rank: Column | str) -> Column:
    rank = F.col(rank) if isinstance(rank, str) else rank
    out = F
    for i, name in enumerate(LEVELS[:-1]):
        out = out.when(rank == i, name)
    return out.otherwise(LEVELS[-1])


def allowed_levels(scopes: Iterable[str]) -> frozenset[str]:
    """Union of the levels of known scopes; {public} if there are none."""
    out = set().union(*(SCOPES.get(s, set()) for s in scopes))
    return frozenset(out or {"public"})


@dataclass(frozen=True)
class Caller:
    """Who asks: the workspace, and the levels open to the caller."""

    workspace: int | None = None
    scopes: tuple[str, ...] = ()

    @property
    def levels(self) -> frozenset[str]:
        return allowed_levels(self.scopes)

    @property
    def max_rank(self) -> int:
        return max(LEVELS.index(x) for x in self.levels)

    @property
    def is_admin(self) -> bool:
        return "restricted" in self.levels


def register_sql_functions(spark: SparkSession) -> None:
    """The scalar functions under their SQL names."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tier_rank(level STRING) RETURNS INT RETURN CASE level WHEN 'public' THEN 0 WHEN 'channel' THEN 1 WHEN 'private' THEN 2 ELSE 3 END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rank_to_level(r INT) RETURNS STRING RETURN CASE r WHEN 0 THEN 'public' WHEN 1 THEN 'channel' WHEN 2 THEN 'private' ELSE 'restricted' END")
