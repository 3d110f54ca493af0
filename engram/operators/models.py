"""Where models plug in: scorers, extractors and embedders, with deterministic ones where none is given.

A model is a plain object that is sent to the tasks and called on batches of
texts. The ones here need no network.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType

from ..functions.slices import by_slices
from ..functions.text import DOMAIN_TYPES, is_crystal, primary_domain
from ..functions.tokens import VOCABULARY, count_tokens, truncate_tokens

TRUNCATED = 800
GLEAN_FROM = 2000

#: Words that speak for a domain, for the scorer without a model.
KEYWORDS = {
    "project": ("project", "roadmap", "milestone", "deadline"),
    "decision": ("decision", "decided", "approve", "approved"),
    "strategic": ("strategy", "goal", "vision"),
    "risk": ("risk", "issue", "blocker", "incident"),
    "people": ("team", "hire", "hiring", "people"),
    "engineering": ("code", "deploy", "server", "bug"),
    "knowledge": ("document", "guide", "process", "learn"),
    "customer": ("customer", "client", "order", "user"),
    "smalltalk": ("hello", "thanks", "lol", "weekend"),
}


class TextModel(Protocol):
    """A language model: an answer as JSON for each text, under a system prompt."""

    def extract(self, texts: list[str], system_prompt: str) -> list[str]: ...


class Fallback:
    """Models in turn: what one fails on goes to the next; the last one's error is raised."""

    def __init__(self, *models: TextModel):
        if not models:
            raise ValueError("no model")
        self.models = models

    def extract(self, texts: list[str], system_prompt: str) -> list[str]:
        for model in self.models[:-1]:
            try:
                return model.extract(texts, system_prompt)
            except Exception:  # noqa: BLE001, S112  a model may fail in any way
                continue
        return self.models[-1].extract(texts, system_prompt)


class Stored:
    """Answers by the first 16 hex digits of a text's SHA-256; others have the default."""

    def __init__(self, answers: dict[str, str], default: str = "{}"):
        self.answers, self.default = answers, default

    def extract(self, texts: list[str], system_prompt: str) -> list[str]:
        from hashlib import sha256

        return [self.answers.get(sha256(t.encode()).hexdigest()[:16], self.default) for t in texts]


def answers(model: TextModel, system_prompt: str):
    """A column function: the model's JSON for each text; null for null."""

    def each(texts: list) -> list:
        there = [t for t in texts if t is not None]
        found = iter(model.extract(there, system_prompt) if there else [])
        return [None if t is None else next(found) for t in texts]

    return by_slices(lambda: each, StringType(), pa.string())


def keyword_scores(text: Column, keywords: dict[str, tuple[str, ...]] = KEYWORDS) -> Column:
    """map<domain, score>: a tenth for every keyword of the domain in the text, 1 at most."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    found = lambda ks: F.size(F.filter(words, lambda w: w.isin(*ks)))
    return F.map_from_arrays(F.array(*[F.lit(d) for d in keywords]), F.array(*[F.least(F.lit(1.0), found(ks) / 10.0) for ks in keywords.values()]))


def settle(text: Column, scores: Column) -> Column:
    """The second look without a model: a domain that is not at least half as strong as the strongest goes to 0."""
    best = F.array_max(F.map_values(scores))
    return F.transform_values(scores, lambda _, s: F.when(s * 2 >= best, s).otherwise(0.0))


def model_scores(model: TextModel, system_prompt: str = "Score nine domains.", first_scores: str = "These scores were given to the text above", second_look: str = "give the nine scores that you stand by"):
    """Scores by a model that answers with a JSON object of domains; domains that it leaves out are 0. The second look sees the first scores between `first_scores` and `second_look`."""
    parse = lambda j: F.from_json(j, MapType(StringType(), DoubleType()))
    ask = answers(model, system_prompt)
    full = lambda m: F.map_from_arrays(F.array(*[F.lit(d) for d in DOMAIN_TYPES]), F.array(*[F.coalesce(F.try_element_at(m, F.lit(d)), F.lit(0.0)) for d in DOMAIN_TYPES]))
    return lambda text: full(parse(ask(text))), lambda text, scores: full(parse(ask(F.concat(text, F.lit(f"\n\n{first_scores}: "), F.to_json(scores), F.lit(f"; {second_look}.")))))


def classify(chunks: DataFrame, text: str = "chunk", score: Callable[[Column], Column] = keyword_scores, verify: Callable[[Column, Column], Column] = settle, vocabulary: str | None = VOCABULARY, truncated: int | None = TRUNCATED) -> DataFrame:
    """`chunks` with scores, `changed` (the second look differs), domain and crystal, from the first `truncated` tokens; from whole texts for None."""
    whole = F.coalesce(text, F.lit(""))
    seen = chunks.withColumn("__t", whole if truncated is None else truncate_tokens(truncated, vocabulary)(whole))
    first = seen.withColumn("__first", score(F.col("__t")))
    both = first.withColumn("scores", verify(F.col("__t"), F.col("__first")))
    best = F.array_max(F.map_values(F.map_filter("scores", lambda k, _: k != "smalltalk")))
    out = both.withColumn("changed", F.to_json("scores") != F.to_json("__first"))
    return out.withColumns({"domain": primary_domain(F.col("scores")), "crystal": is_crystal(best, F.element_at("scores", F.lit("smalltalk")))}).drop("__t", "__first")


EXTRACTION = "entities array<struct<name:string,entity_type:string,confidence:double>>, relations array<struct<source:string,target:string,relation_type:string>>, claims array<struct<entity:string,predicate:string,value:string,confidence:double>>"


class Addresses:
    """The extractor without a model: every e-mail address is a person, and its host a claim about it."""

    def extract(self, texts: list[str], system_prompt: str) -> list[str]:
        import re

        out = []
        for t in texts:
            found = list(dict.fromkeys(re.findall(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", t)))
            entities = [{"name": a, "entity_type": "person", "confidence": 0.9} for a in found]
            claims = [{"entity": a, "predicate": "host", "value": a.split("@")[1], "confidence": 0.9} for a in found]
            out.append(json.dumps({"entities": entities, "relations": [], "claims": claims}))
        return out


def extract(chunks: DataFrame, text: str = "chunk", model: TextModel | None = None, system_prompt: str = "Extract.", vocabulary: str | None = VOCABULARY) -> DataFrame:
    """`chunks` with `found` (entities, relations, claims): a first pass, and a second one over chunks of `GLEAN_FROM` tokens or more, whose new entities, relations and claims are added. An answer that is no such JSON counts as empty."""
    ask = answers(model or Addresses(), system_prompt)
    parse = lambda j: F.from_json(j, EXTRACTION)
    one = chunks.withColumn("__one", parse(ask(text)))
    long = count_tokens(vocabulary)(text) >= GLEAN_FROM
    two = one.withColumn("__two", parse(ask(F.when(long, F.concat(F.col(text), F.lit("\n\nAlready found: "), F.to_json("__one"))))))
    part = lambda c, t: F.array_union(F.coalesce(f"__one.{c}", F.array().cast(t)), F.coalesce(f"__two.{c}", F.array().cast(t))).alias(c)
    kinds = {f.name: f.dataType for f in two.schema["__one"].dataType.fields}
    return two.withColumn("found", F.struct(*[part(c, t) for c, t in kinds.items()])).drop("__one", "__two")


def verify_found(chunks: DataFrame, text: str = "chunk", model: TextModel | None = None) -> DataFrame:
    """`chunks` with `found` as a second model corrects it and `changed`; without a model, entities whose name is not in the text go, and what refers to them."""
    if model is None:
        kept = F.filter("found.entities", lambda e: F.contains(F.col(text), e["name"]))
        names = F.transform(kept, lambda e: e["name"])
        own = lambda n: F.array_contains(names, n)
        new = F.struct(kept.alias("entities"), F.filter("found.relations", lambda r: own(r["source"]) & own(r["target"])).alias("relations"), F.filter("found.claims", lambda c: own(c["entity"])).alias("claims"))
    else:
        asked = F.from_json(answers(model, "Verify.")(F.concat(F.col(text), F.lit("\n\nFound: "), F.to_json("found"))), EXTRACTION)
        new = F.coalesce(asked, "found")
    return chunks.withColumn("__new", new).withColumn("changed", F.to_json("__new") != F.to_json("found")).withColumn("found", F.col("__new")).drop("__new")


def rewrite_names(df: DataFrame, text: str, find: Callable[[str], list[tuple[int, int]]] | None, name: Callable[[str], str]) -> DataFrame:
    """`df` with the person names that `find` gives (start, end) replaced by `name` of each; without a finder the texts stay."""
    if find is None:
        return df

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        for a, z in sorted(set(find(t)), reverse=True):
            t = t[:a] + name(t[a:z]) + t[z:]
        return t

    run = by_slices(lambda: lambda texts: [one(t) for t in texts], StringType(), pa.string())
    return df.withColumn(text, run(text))
