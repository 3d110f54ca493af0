"""Hybrid retrieval: vector, full-text and name channels, rank fusion, evidence for answers."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.access import Caller
from ..functions.similarity import cosine, trigram_similarity, trigrams
from ..functions.text import sanitize_context
from .listing import ordered_text

RRF_K = 60


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


@dataclass(frozen=True)
class WebQuery:
    """A web-style query: alternatives of (required words, phrases, excluded words)."""

    groups: tuple[tuple[tuple[str, ...], tuple[tuple[str, ...], ...], tuple[str, ...]], ...]

    @classmethod
    def parse(cls, text: str) -> WebQuery:
        groups = []
        for part in re.split(r"\s+or\s+", text, flags=re.IGNORECASE):
            phrases = tuple(p for p in (tuple(w.lower() for w in re.findall(r"\w+", p)) for p in re.findall(r'"([^"]*)"', part)) if p)
            words, out = [], []
            for w in re.sub(r'"[^"]*"', " ", part).split():
                (out if w.startswith("-") else words).extend(x.lower() for x in re.findall(r"\w+", w))
            groups.append((tuple(words), phrases, tuple(out)))
        return cls(tuple(groups))

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(w for words, phrases, _ in self.groups for w in (*words, *(x for p in phrases for x in p))))

    def matches(self, toks: Column) -> Column:
        joined = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))

        def one(words, phrases, out):
            parts = [F.array_contains(toks, w) for w in words] + [F.contains(joined, F.lit(f" {' '.join(p)} ")) for p in phrases] + [~F.array_contains(toks, w) for w in out]
            return reduce(lambda a, b: a & b, parts, F.lit(bool(words or phrases)))

        return reduce(lambda a, b: a | b, [one(*g) for g in self.groups])

    def rank(self, toks: Column) -> Column:
        """Occurrences of query words; only its order is used."""
        wanted = F.array(*[F.lit(w) for w in self.words]).cast("array<string>")
        return F.size(F.filter(toks, lambda t: F.array_contains(wanted, t)))


def visible_chunks(caller: Caller) -> Column:
    """What a channel may show of chunks: the caller's levels, entities left out."""
    return F.col("access_level").isin(*sorted(caller.levels)) & (F.col("source_type") != "entity")


def vector_channel(chunks: DataFrame, query: list[float], caller: Caller, limit: int) -> DataFrame:
    """(key, content, score): nearest visible vectors, entities left out."""
    seen = chunks.filter(visible_chunks(caller))
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = seen.select(F.concat_ws(":", "source_type", F.col("id").cast("string")).alias("key"), "content", F.round(cosine(F.col("embedding"), q), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "key").limit(limit)


def text_channel(chunks: DataFrame, query: WebQuery, caller: Caller, limit: int) -> DataFrame:
    """(key, content, score): visible chunks that match, by term frequency."""
    seen = chunks.filter(visible_chunks(caller)).withColumn("__t", tokens(F.col("content")))
    hits = seen.filter(query.matches(F.col("__t")))
    return hits.select(F.concat_ws(":", "source_type", F.col("id").cast("string")).alias("key"), "content", query.rank(F.col("__t")).cast("double").alias("score")).orderBy(F.desc("score"), "key").limit(limit)


def claim_texts(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """Active claims with the name of their live entity, and `text`, what a search reads of them."""
    joined = claims.filter("status = 'active'").join(entities.filter("not is_deleted").select(F.col("id").alias("entity_id"), "name"), "entity_id")
    return joined.withColumn("text", F.concat_ws(" ", "name", "predicate", "value"))


def entity_hits(claims: DataFrame, limit: int) -> DataFrame:
    """(key, content, score): the entities of matching claims (entity_id, name, predicate, value, observed_at, id, score), best first."""
    text = ordered_text(F.concat(F.col("predicate"), F.lit(": "), F.col("value")), -F.unix_micros("observed_at"), -F.col("id"))
    grouped = claims.groupBy("entity_id", "name").agg(text.alias("claims"), F.max("score").cast("double").alias("score"))
    return grouped.select(F.concat(F.lit("entity:"), "entity_id").alias("key"), F.concat_ws(": ", "name", "claims").alias("content"), "score").orderBy(F.desc("score"), "key").limit(limit)


def entity_text_channel(entities: DataFrame, claims: DataFrame, query: WebQuery, limit: int) -> DataFrame:
    """(key, content, score): entities whose name or a visible active claim matches; content lists the matching claims."""
    hits = claim_texts(entities, claims).withColumn("__t", tokens(F.col("text"))).filter(query.matches(F.col("__t")))
    return entity_hits(hits.withColumn("score", query.rank(F.col("__t"))), limit)


def full_text_channel(chunks: DataFrame, entities: DataFrame, visible_claims: DataFrame, query: WebQuery, caller: Caller, limit: int) -> DataFrame:
    """(key, content, score): the best of matching chunks and of entities with a matching claim, `limit` of either and in all."""
    both = text_channel(chunks, query, caller, limit).unionByName(entity_text_channel(entities, visible_claims, query, limit))
    return both.orderBy(F.desc("score"), "key").limit(limit)


def hidden_matches(chunks: DataFrame, entities: DataFrame, visible_claims: DataFrame, query: WebQuery, returned: DataFrame) -> DataFrame:
    """(filtered_count): matching chunks of any access level and matching claims that may be seen, less the rows returned."""
    texts = chunks.filter(F.col("source_type") != "entity").select(tokens(F.col("content")).alias("t"))
    claims = visible_claims.filter("status = 'active'").join(entities.filter("not is_deleted").select(F.col("id").alias("entity_id"), "name"), "entity_id")
    both = texts.union(claims.select(tokens(F.concat_ws(" ", "name", "predicate", "value")))).select(F.when(query.matches(F.col("t")), 1).otherwise(0).alias("n"))
    counted = both.union(returned.select(F.lit(-1)))
    return counted.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(0)).alias("filtered_count"))


def name_channel(entities: DataFrame, visible_claims: DataFrame, query: str, limit: int, least: float = 0.1) -> DataFrame:
    """(key, content, score): entities by trigram similarity of the name; three times `limit` candidates are taken before the access join."""
    q = trigrams(F.lit(query))
    cand = entities.filter("not is_deleted").select("id", "name", F.round(trigram_similarity(trigrams(F.col("name")), q), 6).alias("score")).filter(F.col("score") > least)
    return with_claims(cand.orderBy(F.desc("score"), "id").limit(3 * limit), visible_claims, limit)


def with_claims(cand: DataFrame, visible_claims: DataFrame, limit: int) -> DataFrame:
    """(key, content, score): candidates (id, name, score), those without a visible active claim left out."""
    text = ordered_text(F.concat(F.col("predicate"), F.lit(": "), F.col("value")), -F.unix_micros("observed_at"), -F.col("id"))
    claims = visible_claims.filter("status = 'active'")
    packed = claims.join(cand.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").groupBy("entity_id").agg(text.alias("claims"))
    joined = cand.join(packed, cand.id == packed.entity_id)
    return joined.select(F.concat(F.lit("entity:"), cand.id).alias("key"), F.concat_ws(" - ", "name", "claims").alias("content"), "score").orderBy(F.desc("score"), "key").limit(limit)


def ranked(channel: DataFrame, name: str, priority: int) -> DataFrame:
    """A channel's rows with 1-based ranks. Its rows are already cut to a limit."""
    w = Window.orderBy(F.desc("score"), "key")
    return channel.select("key", "content", F.row_number().over(w).cast("bigint").alias("rank"), F.lit(name).alias("channel"), F.lit(priority).alias("priority"))


def fuse(channels: list[DataFrame], limit: int, keep: Column | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: (key, content, score, channels), content from the first channel; `keep` filters after fusion."""
    rows = reduce(DataFrame.unionByName, channels)
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("priority", "channel"))), lambda s: s["channel"]), ",")
    fused = rows.groupBy("key").agg(
        F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 6).alias("score"), F.min_by("content", "priority").alias("content"), names.alias("channels"), F.min(F.struct("priority", "rank")).alias("__first")
    )
    if keep is not None:
        fused = fused.filter(keep)
    return fused.orderBy(F.desc("score"), "__first", "key").limit(limit).drop("__first")


def evidence(fused: DataFrame, budget: int, most: int = 20) -> DataFrame:
    """(n, key, part): numbered evidence within a token budget, at least one, each part sanitised."""
    w = Window.orderBy(F.desc("score"), "key")
    rows = fused.withColumn("n", F.row_number().over(w).cast("bigint")).filter(F.col("n") <= most)
    rows = rows.withColumn("part", F.concat(F.lit("["), "key", F.lit("] "), "content"))
    rows = rows.withColumn("used", F.sum(F.floor(F.char_length("part") / 4)).over(w)).withColumn("over", F.max((F.col("used") > budget).cast("int")).over(w))
    return rows.filter("over = 0 or n = 1").select("n", "key", sanitize_context(F.col("part"), unicode=False).alias("part"))


def context_text(parts: DataFrame) -> DataFrame:
    """(context): the evidence as one text, sanitised again as a whole."""
    joined = parts.agg(ordered_text(F.col("part"), F.col("n"), separator="\n").alias("context"))
    return joined.select(sanitize_context(F.col("context"), unicode=False).alias("context"))


def valid_citations(cited: DataFrame, included: DataFrame) -> DataFrame:
    return cited.join(included, "key", "left_semi")
