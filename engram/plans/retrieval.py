"""Search channels, fusion and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.access import rank_to_level
from ..functions.similarity import cosine, trigram_similarity, trigrams
from ..functions.text import fake_embedding
from ..operators import search
from ..operators.text_index import TextIndex, TrigramIndex
from ..operators.vector_index import VectorIndex
from ..operators.visibility import visible_claims
from ..sources import bindings as b
from ..sources.bindings import sql
from .access import ACCESS, CLAIM_VIEWS, READER, access_of
from .registry import ORACLES, query

QUERY = search.WebQuery.parse("nicht or urgent priority -trash")
DIM = 64
PROBE = [((i * 7919) % 13 - 6) / 10 for i in range(DIM)]
VEC = "[" + ", ".join(f"{x}::DOUBLE" for x in PROBE) + "]"
TOK = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
SEEN = "access_level IN ('public', 'channel') AND source_type <> 'entity'"
VECTOR = f"SELECT source_type || ':' || id AS key, content, round(list_cosine_similarity(embedding::DOUBLE[], {VEC}), 6) AS score FROM v_vectors WHERE {SEEN} ORDER BY score DESC, key LIMIT 20"
HIT = "(list_contains(t, 'nicht') OR (list_contains(t, 'urgent') AND list_contains(t, 'priority') AND NOT list_contains(t, 'trash')))"
RANK = "len(list_filter(t, lambda x: x IN ('nicht', 'urgent', 'priority')))::DOUBLE"
JOINED = f"j AS (SELECT c.entity_id, e.name, c.predicate, c.value, c.observed_at, c.id, {TOK.format("e.name || ' ' || c.predicate || ' ' || c.value")} AS t FROM v_claims c JOIN access a ON a.claim_id = c.id JOIN v_entities e ON e.id = c.entity_id WHERE a.max_tier_rank <= 1 AND c.status = 'active' AND NOT e.is_deleted)"
MATCH = f"{ACCESS}, {JOINED}"


def text_sql(limit: int = 20) -> str:
    chunks = f"SELECT key, content, {RANK} AS score FROM (SELECT source_type || ':' || id AS key, content, {TOK.format('content')} AS t FROM v_vectors WHERE {SEEN}) WHERE {HIT} ORDER BY score DESC, key LIMIT {limit}"
    entities = f"SELECT 'entity:' || entity_id AS key, name || ': ' || string_agg(predicate || ': ' || value, '; ' ORDER BY observed_at DESC, id DESC) AS content, max({RANK}) AS score FROM j WHERE {HIT} GROUP BY entity_id, name ORDER BY score DESC, key LIMIT {limit}"
    return f"SELECT * FROM (SELECT * FROM ({chunks}) UNION ALL SELECT * FROM ({entities})) ORDER BY score DESC, key LIMIT {limit}"


TEXT = text_sql()
GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
NAME = "Customer#000000123"
SIM = f"(len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q))))"
NAMES = f"cand AS (SELECT id, name, round({SIM}, 6) AS score FROM (SELECT id, name, {GRAMS.format('name')} AS g, {GRAMS.format(repr(NAME))} AS q FROM v_entities WHERE NOT is_deleted) WHERE round({SIM}, 6) > 0.1 ORDER BY score DESC, id LIMIT 60), packed AS (SELECT c.entity_id, string_agg(c.predicate || ': ' || c.value, '; ' ORDER BY c.observed_at DESC, c.id DESC) AS claims FROM v_claims c JOIN access a ON a.claim_id = c.id WHERE a.max_tier_rank <= 1 AND c.status = 'active' GROUP BY 1)"
NAME_ROWS = "SELECT 'entity:' || c.id AS key, c.name || ' - ' || p.claims AS content, c.score FROM cand c JOIN packed p ON p.entity_id = c.id ORDER BY c.score DESC, key LIMIT 20"


def vector_rows(spark, d, limit=20):
    return search.vector_channel(b.vectors(spark, d), PROBE, READER, limit)


def seen_claims(spark, d):
    return visible_claims(b.claims(spark, d), access_of(spark, d), READER)


def text_rows(spark, d, limit=20):
    return search.full_text_channel(b.vectors(spark, d), b.entities(spark, d), seen_claims(spark, d), QUERY, READER, limit)


def name_rows(spark, d, limit=20):
    return search.name_channel(b.entities(spark, d), seen_claims(spark, d), NAME, limit)


@query("op_x7", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {VEC}), 6) AS similarity FROM embeddings")
def cosine_similarity(spark, d):
    return b.table(spark, d, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), F.array(*[F.lit(x) for x in PROBE])), 6).alias("similarity"))


@query("op_l2", f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {VEC}), 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 25")
def nearest(spark, d):
    v = b.table(spark, d, "embeddings")
    return v.select("vec_id", F.round(1 - cosine(F.col("embedding"), F.array(*[F.lit(x) for x in PROBE])), 6).alias("distance")).orderBy("distance", "vec_id").limit(25)


@query("op_x6", sql(f"SELECT id, round({SIM}, 6) AS similarity FROM (SELECT id, {GRAMS.format('name')} AS g, {GRAMS.format(repr('red widget'))} AS q FROM v_entities) WHERE {SIM} > 0.1", "v_entities"))
def name_similarity(spark, d):
    s = trigram_similarity(trigrams(F.col("name")), trigrams(F.lit("red widget")))
    return b.entities(spark, d).select("id", s.alias("s")).filter("s > 0.1").select("id", F.round("s", 6).alias("similarity"))


@query("op_e1", sql(VECTOR, "v_vectors"))
def vector_channel(spark, d):
    return vector_rows(spark, d)


@query("op_l2_index", ORACLES["op_l2"])
def indexed_nearest(spark, d):
    """The nearest vectors from an inverted file built here; cells that can't hold one are not read."""
    index = VectorIndex.build(b.table(spark, d, "embeddings").select("vec_id", "embedding"))
    return index.nearest(PROBE, 25, "vec_id").select("vec_id", F.round(1 - F.col("score"), 6).alias("distance"))


@query("op_e1_index", ORACLES["op_e1"])
def indexed_vector_channel(spark, d):
    index = VectorIndex.build(b.vectors(spark, d).withColumn("key", F.concat_ws(":", "source_type", F.col("id").cast("string"))))
    return index.nearest(PROBE, 20, "key", keep=search.visible_chunks(READER)).select("key", "content", "score")


@query("op_e2", sql(f"{MATCH} {text_sql(400)}", *CLAIM_VIEWS, "v_entities", "v_vectors"))
def text_channel(spark, d):
    return text_rows(spark, d, 400)


@query("op_x9", f"SELECT doc_id FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents) WHERE (list_contains(t, 'the') AND list_contains(t, 'and') AND NOT list_contains(t, 'trash')) OR (list_contains(t, 'de') AND contains(' ' || array_to_string(t, ' ') || ' ', ' de la '))")
def web_search(spark, d):
    q = search.WebQuery.parse('the and -trash OR de "de la"')
    t = b.table(spark, d, "documents").select("doc_id", search.tokens(F.col("text")).alias("t"))
    return t.filter(q.matches(F.col("t"))).select("doc_id")


@query("op_x10", f"SELECT doc_id, len(list_filter({TOK.format('text')}, lambda x: x IN ('nicht', 'urgent', 'priority')))::BIGINT AS rank FROM documents")
def text_rank(spark, d):
    t = b.table(spark, d, "documents").select("doc_id", search.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", QUERY.rank(F.col("t")).cast("bigint").alias("rank"))


@query("op_j7", sql(f"{MATCH} SELECT 'entity:' || entity_id AS key, name || ': ' || string_agg(predicate || ': ' || value, '; ' ORDER BY observed_at DESC, id DESC) AS content, max(len(list_filter(t, lambda x: x IN ('urgent', 'priority'))))::DOUBLE AS score FROM j WHERE list_contains(t, 'urgent') AND list_contains(t, 'priority') GROUP BY entity_id, name ORDER BY score DESC, key LIMIT 30", *CLAIM_VIEWS, "v_entities"))
def entity_text(spark, d):
    return search.entity_text_channel(b.entities(spark, d), seen_claims(spark, d), search.WebQuery.parse("urgent priority"), 30)


@query("op_e3", sql(f"{ACCESS}, {NAMES} {NAME_ROWS}", *CLAIM_VIEWS, "v_entities"))
def name_channel(spark, d):
    return name_rows(spark, d)


@query("op_j8", sql(f"{ACCESS}, {NAMES} SELECT c.id, p.claims FROM cand c JOIN packed p ON p.entity_id = c.id ORDER BY c.score DESC, c.id LIMIT 20", *CLAIM_VIEWS, "v_entities"))
def candidates_with_claims(spark, d):
    rows = name_rows(spark, d)
    return rows.select(F.substring("key", 8, 100).alias("id"), F.regexp_replace("content", "^.*? - ", "").alias("claims"))


@query("op_w2", sql(f"{MATCH}, t AS ({TEXT}) SELECT key, row_number() OVER (ORDER BY score DESC, key) AS rank FROM t", *CLAIM_VIEWS, "v_entities", "v_vectors"))
def channel_ranks(spark, d):
    return search.ranked(text_rows(spark, d), "fts", 1).select("key", "rank")


@query("op_u1", sql(f"{MATCH} SELECT key, score FROM ({text_sql(400)})", *CLAIM_VIEWS, "v_entities", "v_vectors"))
def union_of_hits(spark, d):
    """Hits in chunks and in entities, which the text channel joins."""
    return text_rows(spark, d, 400).select("key", "score")


@query("op_x9_index", ORACLES["op_x9"])
def indexed_web_search(spark, d):
    """The same search from postings, phrases by their places."""
    index = TextIndex.build(b.table(spark, d, "documents"), "doc_id", "text")
    return index.matches(search.WebQuery.parse('the and -trash OR de "de la"')).select(F.col("key").alias("doc_id"))


@query("op_e2_index", ORACLES["op_e2"])
def indexed_text_channel(spark, d):
    """Chunks and claims from postings; a claim's level, which its sources set, is looked up for its hits only."""
    chunks = b.vectors(spark, d).withColumn("key", F.concat_ws(":", "source_type", F.col("id").cast("string")))
    texts = TextIndex.build(chunks, "key", "content", ["access_level", "source_type"])
    of_chunks = texts.top(QUERY, 400, search.visible_chunks(READER)).select("key", F.col("text").alias("content"), F.col("score").cast("double").alias("score"))
    claims = search.claim_texts(b.entities(spark, d), b.claims(spark, d))
    hits = TextIndex.build(claims, "id", "text").matches(QUERY).select(F.col("key").alias("id"), "score")
    seen = seen_claims(spark, d).join(hits, "id").join(claims.select("id", "name"), "id")
    return of_chunks.unionByName(search.entity_hits(seen, 400)).orderBy(F.desc("score"), "key").limit(400)


@query("op_e3_index", ORACLES["op_e3"])
def indexed_name_channel(spark, d):
    index = TrigramIndex.build(b.entities(spark, d).filter("not is_deleted"), "id", "name")
    return search.with_claims(index.top(NAME, 60).withColumnRenamed("key", "id"), seen_claims(spark, d), 20)


RANKED = ", ".join(f"r{i} AS (SELECT key, content, row_number() OVER (ORDER BY score DESC, key) AS rank, '{n}' AS channel, {i} AS priority FROM ({q}) x)" for i, (n, q) in enumerate((("vector", VECTOR), ("fts", TEXT), ("entity_name", NAME_ROWS))))
FUSED = f"{MATCH}, {NAMES}, {RANKED}, rows AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2), fused AS (SELECT key, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, arg_min(content, priority) AS content, string_agg(channel, ',' ORDER BY priority) AS channels, min(struct_pack(p := priority, r := rank)) AS f FROM rows GROUP BY key)"


def fused(spark, d, limit=15, keep=None):
    channels = [search.ranked(vector_rows(spark, d), "vector", 0), search.ranked(text_rows(spark, d), "fts", 1), search.ranked(name_rows(spark, d), "entity_name", 2)]
    return search.fuse(channels, limit, keep)


@query("op_e4", sql(f"{FUSED} SELECT key, score, content, channels FROM fused ORDER BY score DESC, f, key LIMIT 15", *CLAIM_VIEWS, "v_entities", "v_vectors"))
def hybrid_search(spark, d):
    return fused(spark, d)


@query("op_u3", sql(f"{FUSED} SELECT key, channels FROM fused", *CLAIM_VIEWS, "v_entities", "v_vectors"))
def channel_merge(spark, d):
    return fused(spark, d, 1000).select("key", "channels")


@query("op_x11", sql(f"{FUSED} SELECT key, score FROM fused", *CLAIM_VIEWS, "v_entities", "v_vectors"))
def rrf(spark, d):
    return fused(spark, d, 1000).select("key", "score")


@query("op_l6", sql(f"{FUSED} SELECT key, score FROM fused ORDER BY score DESC, f, key LIMIT 8", *CLAIM_VIEWS, "v_entities", "v_vectors"))
def fusion_order(spark, d):
    return fused(spark, d, 8).select("key", "score")


@query("op_f17", sql(f"{FUSED} SELECT key, score FROM fused WHERE NOT starts_with(key, 'entity:') OR starts_with(key, 'entity:c:1') ORDER BY score DESC, f, key LIMIT 15", *CLAIM_VIEWS, "v_entities", "v_vectors"))
def type_filter(spark, d):
    return fused(spark, d, keep=~F.startswith("key", F.lit("entity:")) | F.startswith("key", F.lit("entity:c:1"))).select("key", "score")


@query("op_e5", sql(f"{FUSED}, top AS (SELECT * FROM fused ORDER BY score DESC, f, key LIMIT 15), n AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS n FROM top), u AS (SELECT *, sum(length('[' || key || '] ' || content) // 4) OVER (ORDER BY n) AS used FROM n) SELECT n, key, '[' || key || '] ' || content AS part FROM (SELECT *, max((used > 3000)::INT) OVER (ORDER BY n) AS o FROM u) WHERE o = 0 OR n = 1", *CLAIM_VIEWS, "v_entities", "v_vectors"))
def answer_evidence(spark, d):
    return search.evidence(fused(spark, d), 3000)


@query("op_f18", sql(f"{FUSED} SELECT key FROM (SELECT key FROM fused ORDER BY score DESC, f, key LIMIT 15) WHERE key LIKE '%1%'", *CLAIM_VIEWS, "v_entities", "v_vectors"))
def citations(spark, d):
    included = fused(spark, d).select("key")
    cited = b.vectors(spark, d).select(F.concat_ws(":", "source_type", F.col("id").cast("string")).alias("key")).union(b.entities(spark, d).select(F.concat(F.lit("entity:"), "id"))).filter("key like '%1%'")
    return search.valid_citations(cited, included)


@query("op_a9", sql(f"{MATCH}, m AS (SELECT t FROM j UNION ALL SELECT {TOK.format('content')} FROM v_vectors WHERE source_type <> 'entity') SELECT greatest((SELECT count(*) FROM m WHERE {HIT}) - (SELECT count(*) FROM ({TEXT})), 0) AS filtered_count", *CLAIM_VIEWS, "v_entities", "v_vectors"))
def filtered_count(spark, d):
    return search.hidden_matches(b.vectors(spark, d), b.entities(spark, d), seen_claims(spark, d), QUERY, text_rows(spark, d))


VEC_OF = "list_transform(range(0, 64), lambda i: ('0x' || substr(sha256({0}), (i % 32 * 2 + 1)::INT, 2))::INT / 255.0::DOUBLE)"
SHOWN = "array_to_string(list_transform({0}, lambda x: round(x, 4)::DECIMAL(10,4)::VARCHAR), ',')"


def shown(vector):
    """A vector as text, so that every place of it is compared."""
    return F.array_join(F.transform(vector, lambda x: F.round(x, 4).cast("decimal(10,4)").cast("string")), ",")


@query("op_x29", f"SELECT doc_id, {SHOWN.format(VEC_OF.format('text'))} AS vector FROM documents")
def fake_vectors(spark, d):
    return b.table(spark, d, "documents").select("doc_id", shown(fake_embedding(F.col("text"))).alias("vector"))


@query("op_e6", sql(f", x AS (SELECT 'entity' AS source_type, id, name AS content, 'public' AS access_level FROM v_entities WHERE NOT is_deleted UNION ALL SELECT 'claim', c.id::VARCHAR, c.predicate || ': ' || c.value, CASE a.max_tier_rank WHEN 0 THEN 'public' WHEN 1 THEN 'channel' WHEN 2 THEN 'private' ELSE 'restricted' END FROM v_claims c JOIN access a ON a.claim_id = c.id WHERE c.status = 'active') SELECT source_type, id, content, access_level, {SHOWN.format(VEC_OF.format('content'))} AS vector FROM x".replace(", x AS", f"{ACCESS}, x AS", 1), *CLAIM_VIEWS, "v_entities"))
def embed_after_run(spark, d):
    """Rows to embed after a run: live entities, and active claims at the level of their least visible source."""
    e = b.entities(spark, d).filter("not is_deleted").select(F.lit("entity").alias("source_type"), "id", F.col("name").alias("content"), F.lit("public").alias("access_level"))
    c = b.claims(spark, d).filter("status = 'active'").join(access_of(spark, d).select(F.col("claim_id").alias("id"), "max_tier_rank"), "id")
    c = c.select(F.lit("claim").alias("source_type"), F.col("id").cast("string").alias("id"), F.concat("predicate", F.lit(": "), "value").alias("content"), rank_to_level(F.col("max_tier_rank")).alias("access_level"))
    return e.unionByName(c).withColumn("vector", shown(fake_embedding(F.col("content"))))


@query("op_e7", f"SELECT d.doc_id, e.embedding IS NULL AS backfilled, CASE WHEN e.embedding IS NULL THEN {SHOWN.format(VEC_OF.format('d.text'))} END AS vector FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def embedding_backfill(spark, d):
    docs, v = b.table(spark, d, "documents").select("doc_id", "text"), b.table(spark, d, "embeddings")
    j = docs.join(v, docs.doc_id == v.vec_id, "left")
    return j.select("doc_id", F.col("embedding").isNull().alias("backfilled"), F.when(F.col("embedding").isNull(), shown(fake_embedding(F.col("text")))).alias("vector"))
