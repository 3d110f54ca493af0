"""Consolidation, prompts, tree reads and report queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import composite, cosine, indel_ratio
from ..functions.text import EMAIL
from ..operators import integrate, listing, resolution, rollups, visibility
from ..operators.chunking import EMOJI_ONLY
from ..operators.sanitizing import dictionary, emails_of, with_secrets
from ..sources import bindings as b
from ..sources import jsonl
from ..sources.bindings import sql
from .access import ACCESS, ADMIN, CLAIM_VIEWS, READER, access_of
from .registry import query


def named(spark, d):
    """Entities of which every seventh has an artifact for a name."""
    e = b.entities(spark, d)
    return e.withColumn("name", F.when(F.col("n") % 7 == 0, F.md5("name")).otherwise(F.col("name")))


@query("op_f16", "WITH live AS (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0), act AS (SELECT l_orderkey, bool_and(l_partkey IN (SELECT p_partkey FROM live)) AS ok FROM lineitem GROUP BY 1) SELECT l_orderkey AS id FROM act WHERE ok AND l_orderkey IN (SELECT p_partkey FROM live)")
def proposed_actions(spark, d):
    """Actions (an order names its parts) whose ids are all live."""
    live = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50 == 0).alias("is_deleted"))
    actions = b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("children"))
    return integrate.valid_actions(actions, live, "children").select("id")


@query("op_x37", sql(", top AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY observed_at DESC, id DESC) AS rn FROM v_claims), c AS (SELECT entity_id, string_agg(predicate || '=' || value, ', ' ORDER BY rn) AS facts FROM top WHERE rn <= 3 GROUP BY 1) SELECT e.id, '- ' || e.id || ' | ' || e.name || ' | ' || e.entity_type || ' | ' || coalesce(c.facts, '') AS line FROM v_entities e LEFT JOIN c ON c.entity_id = e.id", "v_claims", "v_entities"))
def prompt_lines(spark, d):
    top = listing.top_k_per(b.claims(spark, d), "entity_id", 3, F.desc("observed_at"), F.desc("id"), rank="rn")
    facts = top.groupBy("entity_id").agg(listing.ordered_text(F.concat_ws("=", "predicate", "value"), F.col("rn"), separator=", ").alias("facts"))
    e = b.entities(spark, d)
    return e.join(facts, e.id == facts.entity_id, "left").select("id", F.format_string("- %s | %s | %s | %s", "id", "name", "entity_type", F.coalesce("facts", F.lit(""))).alias("line"))


TREE = ", g AS (SELECT {0} AS caller, c.entity_id, string_agg('- **' || predicate || '**: ' || value, chr(10) ORDER BY observed_at DESC, id DESC) AS lines FROM v_claims c JOIN access a ON a.claim_id = c.id WHERE status = 'active' AND max_tier_rank <= {1} GROUP BY 2)"
NODE = "SELECT g.caller, e.id, '# ' || e.name || chr(10) || chr(10) || '## Claims' || chr(10) || g.lines AS markdown FROM v_entities e JOIN g ON g.entity_id = e.id WHERE NOT e.is_deleted"


@query("op_g15", sql(f"{ACCESS}{TREE.format(repr('reader'), 1)}{TREE.format(repr('admin'), 3).replace(', g AS', ', h AS')} {NODE} UNION ALL {NODE.replace('g.', 'h.').replace('JOIN g', 'JOIN h')}", *CLAIM_VIEWS, "v_entities"))
def tree_read(spark, d):
    """What a reader and an administrator see of entity nodes: visible claims only, no node without one."""
    access, e = access_of(spark, d), b.entities(spark, d).filter("not is_deleted")

    def seen_by(name, caller):
        claims = visibility.visible_claims(b.claims(spark, d), access, caller).filter("status = 'active'")
        line = F.concat(F.lit("- **"), "predicate", F.lit("**: "), "value")
        g = claims.groupBy("entity_id").agg(listing.ordered_text(line, -F.unix_micros("observed_at"), -F.col("id"), separator="\n").alias("lines"))
        return e.join(g, e.id == g.entity_id).select(F.lit(name).alias("caller"), e.id, F.concat(F.lit("# "), "name", F.lit("\n\n## Claims\n"), "lines").alias("markdown"))

    return seen_by("reader", READER).unionByName(seen_by("admin", ADMIN))


@query("op_x36", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id || ',b' END AS items FROM documents")
def coerced_lists(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.format_string('["a%d","b"]', "doc_id")).otherwise("plain")
    return b.table(spark, d, "documents").select("doc_id", F.array_join(jsonl.coerced_list(raw), ",").alias("items"))


@query("op_s5", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS messages FROM conversations")
def sniffing(spark, d):
    t = b.turns(spark, d)
    raw = F.when(F.col("turn") % 2 == 0, F.to_json(F.array(F.struct(F.col("author").alias("user"), "text")))).otherwise(F.col("text"))
    return t.select("conv_id", "turn", F.coalesce(F.size(jsonl.messages(raw)), F.lit(0)).alias("messages")).withColumn("messages", F.greatest("messages", F.lit(0)))


@query("op_g4", sql(", r AS (SELECT id, source_id, target_id FROM v_relations WHERE source_id IN (SELECT id FROM v_entities WHERE NOT is_deleted) AND target_id IN (SELECT id FROM v_entities WHERE NOT is_deleted)) SELECT (SELECT count(*) FROM r) AS relations, (SELECT count(*) FROM v_claims WHERE entity_id IN (SELECT id FROM v_entities WHERE NOT is_deleted)) AS claims, (SELECT count(*) FROM v_entities WHERE NOT is_deleted) AS entities", "v_relations", "v_entities", "v_claims"))
def atomic_write(spark, d):
    """Counters of one write: relations with both ends, claims with their entity."""
    live = b.entities(spark, d).filter("not is_deleted").select("id")
    rel = b.relations(spark, d).select(F.col("source_id").alias("id"), "target_id").join(live, "id", "left_semi").select(F.col("target_id").alias("id")).join(live, "id", "left_semi")
    claims = b.claims(spark, d).select(F.col("entity_id").alias("id")).join(live, "id", "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    rows = reduce(DataFrame.union, [count(rel, "relations"), count(claims, "claims"), count(live, "entities")])
    return rows.agg(*[F.max(F.when(F.col("what") == x, F.col("n"))).alias(x) for x in ("relations", "claims", "entities")])


REPORT = "SELECT 'hit_ratio:' || stage AS metric, round(sum(tokens_cached) / sum(tokens_in + tokens_cached + cache_write_5m + cache_write_1h), 4) AS value FROM v_traces GROUP BY stage UNION ALL SELECT 'p95:' || stage, CASE WHEN count(*) >= 5 THEN quantile_disc(duration_ms, 0.95)::DOUBLE END FROM v_traces GROUP BY stage UNION ALL SELECT 'cost', round(sum(cost_usd), 4) FROM v_traces UNION ALL SELECT 'claims', count(*)::DOUBLE FROM v_claims"


@query("op_e9", sql(REPORT, "v_traces", "v_claims"))
def report(spark, d):
    t = b.traces(spark, d)
    rows = [
        rollups.cache_hit_ratio(t).select(F.concat(F.lit("hit_ratio:"), "stage").alias("metric"), F.col("hit_ratio").alias("value")),
        rollups.latency(t).select(F.concat(F.lit("p95:"), "stage"), F.col("p95").cast("double")),
        t.agg(F.round(F.sum("cost_usd"), 4).alias("v")).select(F.lit("cost"), "v"),
        b.claims(spark, d).agg(F.count("*").cast("double").alias("v")).select(F.lit("claims"), "v"),
    ]
    return reduce(DataFrame.union, rows)


@query("op_x21", r"SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: regexp_full_match(w, '[\p{So}\p{Sk}\p{Sm}\x{200d}\x{fe0f}\x{fe0e}]+')))::BIGINT AS symbols FROM documents")
def symbols(spark, d):
    """Words of a text that are emoji or other symbols only."""
    words = F.split("text", r"[ \t\n\r]+")
    return b.table(spark, d, "documents").select("doc_id", F.size(F.filter(words, lambda w: w.rlike(EMOJI_ONLY))).cast("bigint").alias("symbols"))


@query("op_x5")
def ratios(spark, d):
    """Indel ratio; tested against the definition."""
    return b.table(spark, d, "part").select("p_partkey", F.round(indel_ratio("p_name", "p_type"), 9).alias("ratio"))


@query("op_x8", "SELECT a.vec_id AS a, b.vec_id AS b, round(0.4 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 0.3 + 0.2 * (a.vec_id % 2 = b.vec_id % 2)::INT + 0.1 * (a.vec_id % 3 = b.vec_id % 3)::INT, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def composite_scores(spark, d):
    v = b.table(spark, d, "embeddings")
    o = v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    same = lambda k: F.col("a") % k == F.col("b") % k
    return v.withColumnRenamed("vec_id", "a").join(o, "a").select("a", "b", F.round(composite(cosine(F.col("embedding"), F.col("other")), F.lit(1.0), same(2), same(3)), 6).alias("score"))


@query("op_g9", "WITH e AS (SELECT vec_id, label, embedding FROM embeddings), s AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS rn FROM s WHERE s >= 0.3) SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM r WHERE rn <= 5 AND id % 4 = other % 4")
def verified_duplicates(spark, d):
    """Shortlisted pairs that the verifier accepts: here, whose aliases (id modulo 4) overlap."""
    e = b.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("entity_type"), F.lit("some name").alias("name"), "embedding")
    return resolution.shortlist(e, 5, 0.3).filter("a % 4 = b % 4").select("a", "b")


@query("op_e10", rf"WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS email FROM documents) SELECT email, count(*) AS n FROM e GROUP BY email")
def corpus_emails(spark, d):
    """Addresses of the corpus, each with its pseudonym, counted; texts with secrets are the gate's."""
    found = emails_of(b.table(spark, d, "documents"), "text", "doc_id")
    known = dictionary(found, "email", "doc_id", "user_")
    return found.join(known, "email").groupBy("email").agg(F.count("*").alias("n"))


@query("op_s11", r"SELECT count(*) AS with_secrets FROM documents WHERE regexp_matches(text, 'sk-ant-[A-Za-z0-9_-]{40,}|sk-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{20,}|AKIA[A-Z0-9]{16}|eyJ[A-Za-z0-9_-]{20,}\.|aws_secret_access_key\s*=')")
def secret_gate(spark, d):
    return with_secrets(b.table(spark, d, "documents"), "text").agg(F.count("*").alias("with_secrets"))
