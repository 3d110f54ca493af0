"""Join, window and set-operation queries over the graph tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import listing
from ..sources import bindings as b
from ..sources.bindings import sql
from .registry import query


@query("op_j5", sql(", k AS (SELECT id, n % 4 + 1 AS rank FROM v_entities) SELECT r.id, r.source_id AS source, r.target_id AS target, a.rank AS source_rank, b.rank AS target_rank FROM v_relations r JOIN k a ON a.id = r.source_id JOIN k b ON b.id = r.target_id WHERE a.rank >= b.rank", "v_relations", "v_entities"))
def hierarchy_join(spark, d):
    """Edges with the tiers of both ends, where they don't point up."""
    tier = b.entities(spark, d).select(F.col("id").alias("end"), (F.col("n") % 4 + 1).alias("rank"))
    r = b.relations(spark, d).select("id", F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    both = r.join(tier.withColumnsRenamed({"end": "source", "rank": "source_rank"}), "source").join(tier.withColumnsRenamed({"end": "target", "rank": "target_rank"}), "target")
    return both.filter("source_rank >= target_rank").select("id", "source", "target", "source_rank", "target_rank")


@query("op_g17", sql(", k AS (SELECT id, n % 4 + 1 AS rank FROM v_entities) SELECT r.target_id AS target, count(*) AS inverted, min(r.source_id) AS sample FROM v_relations r JOIN k a ON a.id = r.source_id JOIN k b ON b.id = r.target_id WHERE a.rank >= b.rank GROUP BY 1", "v_relations", "v_entities"))
def hierarchy_audit(spark, d):
    bad = hierarchy_join(spark, d)
    return bad.groupBy("target").agg(F.count("*").alias("inverted"), F.min("source").alias("sample"))


@query("op_j6", "SELECT n_name AS source_name, r_name AS target_name FROM nation, region WHERE n_nationkey = 7 AND r_regionkey = 2")
def constant_lookup(spark, d):
    n = b.table(spark, d, "nation").filter("n_nationkey = 7").select(F.col("n_name").alias("source_name"), F.lit(1).alias("k"))
    r = b.table(spark, d, "region").filter("r_regionkey = 2").select(F.col("r_name").alias("target_name"), F.lit(1).alias("k"))
    return n.join(r, "k").drop("k")


@query("op_j12", "SELECT p_partkey AS id, coalesce(a.r_regionkey, f.r_regionkey) AS type_id FROM part LEFT JOIN region a ON a.r_name = CASE p_size % 3 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'EUROPE' ELSE 'NOWHERE' END LEFT JOIN region f ON f.r_name = 'AFRICA'")
def slug_with_fallback(spark, d):
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "ASIA").when(F.col("p_size") % 3 == 1, "EUROPE").otherwise("NOWHERE").alias("slug"))
    types = F.broadcast(b.table(spark, d, "region").select(F.col("r_name").alias("slug"), F.col("r_regionkey").alias("type_id")))
    fallback = F.broadcast(b.table(spark, d, "region").filter("r_name = 'AFRICA'").select(F.lit("AFRICA").alias("other"), F.col("r_regionkey").alias("fallback_id")))
    return p.withColumn("other", F.lit("AFRICA")).join(types, "slug", "left").join(fallback, "other", "left").select("id", F.coalesce("type_id", "fallback_id").alias("type_id"))


@query("op_j11", sql(", x AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'c:' || o_custkey WHEN 1 THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') ELSE 'alias ' || o_custkey END AS mention FROM orders), e AS (SELECT id AS eid, name FROM v_entities WHERE entity_type = 'person') SELECT x.id, coalesce(a.eid, n.eid, l.eid) AS entity_id FROM x LEFT JOIN e a ON a.eid = mention LEFT JOIN e n ON lower(n.name) = lower(mention) LEFT JOIN e l ON 'alias ' || substr(l.eid, 3) = mention", "v_entities"))
def exact_resolution(spark, d):
    o = b.table(spark, d, "orders")
    k = F.col("o_custkey").cast("string")
    mention = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("c:"), k)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Customer#"), F.lpad(k, 9, "0"))).otherwise(F.concat(F.lit("alias "), k))
    x = o.select(F.col("o_orderkey").alias("id"), mention.alias("mention"))
    e = b.entities(spark, d).filter("entity_type = 'person'")
    keys = e.select(F.col("id").alias("mention"), F.col("id").alias("by_id"))
    names = e.select(F.lower("name").alias("lowered"), F.col("id").alias("by_name"))
    aliases = e.select(F.concat(F.lit("alias "), F.substring("id", 3, 100)).alias("mention"), F.col("id").alias("by_alias"))
    joined = x.withColumn("lowered", F.lower("mention")).join(keys, "mention", "left").join(names, "lowered", "left").join(aliases, "mention", "left")
    return joined.select("id", F.coalesce("by_id", "by_name", "by_alias").alias("entity_id"))


#: Rows of a key from which on it may be frequent, and rows of the other side that may be sent to all tasks for such keys.
FREQUENT_FROM, SENT_TO_ALL = 10_000, 100_000


def join_spread(left, right, on, share=1024):
    """An inner join on a column of which some values fill more than 1/`share` of `left`: their rows stay where they are and meet what `right` has of them by broadcast, if that is at most `SENT_TO_ALL` rows."""
    counts = left.groupBy(on).agg(F.count("*").alias("n"))
    frequent = [r[on] for r in counts.filter(F.col(on).isNotNull() & (F.col("n") > max(left.count() // share, FREQUENT_FROM))).collect()]
    if not frequent:
        return left.join(right, on)
    own = right.filter(F.col(on).isin(frequent))
    if own.limit(SENT_TO_ALL + 1).count() > SENT_TO_ALL:
        return left.join(right, on)
    rest = left.filter(~F.col(on).isin(frequent)).join(right, on)
    return rest.unionByName(left.filter(F.col(on).isin(frequent)).join(F.broadcast(own), on))


@query("op_j13", sql(", x AS (SELECT l_orderkey, l_linenumber, 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') AS s, CASE WHEN l_partkey % 4 = 0 THEN 'unknown' ELSE 'c:' || l_partkey END AS t FROM lineitem) SELECT l_orderkey, l_linenumber, a.id AS source_id, c.id AS target_id FROM x JOIN v_entities a ON lower(a.name) = lower(s) AND a.entity_type = 'team' JOIN v_entities c ON c.id = t", "v_entities"))
def resolved_relations(spark, d):
    x = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lower(F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))).alias("s"), F.when(F.col("l_partkey") % 4 == 0, "unknown").otherwise(F.concat(F.lit("c:"), "l_partkey")).alias("t"))
    e = b.entities(spark, d)
    teams = e.filter("entity_type = 'team'").select(F.lower("name").alias("s"), F.col("id").alias("source_id"))
    found = join_spread(x, e.select(F.col("id").alias("t"), F.col("id").alias("target_id")), "t")
    return found.join(teams, "s").select("l_orderkey", "l_linenumber", "source_id", "target_id")


@query("op_j14", sql(", top AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY observed_at DESC, id DESC) AS rn FROM v_claims), c AS (SELECT entity_id, count(*) AS n, string_agg(value, ',' ORDER BY rn) AS newest FROM top WHERE rn <= 50 GROUP BY 1), ends AS (SELECT source_id AS entity_id, target_id AS other, created_at, id FROM v_relations UNION ALL SELECT target_id, source_id, created_at, id FROM v_relations), rtop AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id DESC) AS rn FROM ends), r AS (SELECT entity_id, count(*) AS n, string_agg(other, ',' ORDER BY rn) AS newest FROM rtop WHERE rn <= 50 GROUP BY 1) SELECT e.id, coalesce(c.n, 0) AS n_claims, coalesce(c.newest, '') AS claims, coalesce(r.n, 0) AS n_relations, coalesce(r.newest, '') AS relations FROM v_entities e LEFT JOIN c ON c.entity_id = e.id LEFT JOIN r ON r.entity_id = e.id", "v_claims", "v_entities", "v_relations"))
def context_load(spark, d):
    """Entities with their fifty newest claims and relations, in two joins."""

    def newest(df, item, at):
        top = listing.top_k_per(df, "entity_id", 50, F.desc(at), F.desc("id"), rank="rn")
        return top.groupBy("entity_id").agg(F.count("*").alias("n"), listing.ordered_text(F.col(item), F.col("rn"), separator=",").alias("newest"))

    r = b.relations(spark, d)
    ends = r.select(F.col("source_id").alias("entity_id"), F.col("target_id").alias("other"), "created_at", "id").union(r.select("target_id", "source_id", "created_at", "id"))
    c, r = newest(b.claims(spark, d), "value", "observed_at").alias("c"), newest(ends, "other", "created_at").alias("r")
    e = b.entities(spark, d).select("id")
    j = e.join(c, F.col("id") == F.col("c.entity_id"), "left").join(r, F.col("id") == F.col("r.entity_id"), "left")
    none, zero = F.lit(""), F.lit(0)
    return j.select("id", F.coalesce("c.n", zero).alias("n_claims"), F.coalesce("c.newest", none).alias("claims"), F.coalesce("r.n", zero).alias("n_relations"), F.coalesce("r.newest", none).alias("relations"))


@query("op_j15", sql("SELECT c.predicate, r.n_nationkey % 4 AS run, count(*) AS n, round(avg(c.confidence), 9) AS confidence FROM v_claims c JOIN customer ON entity_id = 'c:' || c_custkey JOIN nation r ON c_nationkey = n_nationkey GROUP BY 1, 2", "v_claims"))
def claims_predicates_runs(spark, d):
    c, cu, n = b.claims(spark, d), b.table(spark, d, "customer"), b.table(spark, d, "nation")
    j = c.join(cu, c.entity_id == F.concat(F.lit("c:"), cu.c_custkey)).join(F.broadcast(n), cu.c_nationkey == n.n_nationkey)
    return j.groupBy("predicate", (F.col("n_nationkey") % 4).alias("run")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("confidence"))


@query("op_j16", sql("SELECT c_custkey AS run_id, count(c.id) AS n FROM customer LEFT JOIN v_claims c ON c.entity_id = 'c:' || c_custkey GROUP BY 1", "v_claims"))
def claims_per_run(spark, d):
    counts = b.claims(spark, d).groupBy("entity_id").agg(F.count("id").alias("n"))
    cu = b.table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"))
    return cu.join(counts, F.concat(F.lit("c:"), "run_id") == counts.entity_id, "left").select("run_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("op_j17", sql("SELECT e.id, e.actor, u.c_name FROM v_events e JOIN customer u ON u.c_custkey = e.actor WHERE e.occurred_at >= TIMESTAMP '2024-01-10'", "v_events"))
def actions_with_runs(spark, d):
    e, u = b.events(spark, d).filter(F.col("occurred_at") >= F.lit("2024-01-10").cast("timestamp")), b.table(spark, d, "customer")
    return e.join(u, e.actor == u.c_custkey).select("id", "actor", "c_name")


@query("op_j18", sql("SELECT v.id, coalesce(e.access_level, v.access_level) AS access_level FROM v_vectors v LEFT JOIN v_events e ON e.id = v.id * 3", "v_vectors", "v_events"))
def update_from_join(spark, d):
    v, e = b.vectors(spark, d).select("id", "access_level"), b.events(spark, d).select(F.col("id").alias("event_id"), F.col("access_level").alias("fresh"))
    return v.join(e, e.event_id == v.id * 3, "left").select("id", F.coalesce("fresh", "access_level").alias("access_level"))


@query("op_j20", "SELECT l_orderkey, l_linenumber FROM (SELECT *, rank() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate) AS r FROM lineitem) WHERE r = 1")
def oldest_of_key(spark, d):
    w = Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_shipdate")
    return b.table(spark, d, "lineitem").withColumn("r", F.rank().over(w)).filter("r = 1").select("l_orderkey", "l_linenumber")


@query("op_w1", sql("SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, relation_type ORDER BY created_at, id) AS rn FROM v_relations) WHERE rn = 1", "v_relations"))
def relation_dedup(spark, d):
    return listing.top_k_per(b.relations(spark, d), ["source_id", "target_id", "relation_type"], 1, F.col("created_at"), F.col("id")).select("id")


@query("op_w4", "SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 5")
def top_k_per_key(spark, d):
    return listing.top_k_per(b.table(spark, d, "part"), "p_brand", 5, F.desc("p_retailprice"), F.col("p_partkey")).select("p_brand", "p_partkey", "rank")


@query("op_w5", sql(", f AS (SELECT *, (author IS DISTINCT FROM lag(author) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS fresh FROM v_turns), g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM f) SELECT conv_id, island::BIGINT AS island, min(author) AS author, count(*) AS n_turns, sum(length(text))::BIGINT AS chars FROM g GROUP BY conv_id, island", "v_turns"))
def author_islands(spark, d):
    from ..operators.chunking import author_groups

    t = author_groups(b.turns(spark, d), "conv_id", "turn", "author")
    return t.groupBy("conv_id", "island").agg(F.min("author").alias("author"), F.count("*").alias("n_turns"), F.sum(F.length("text").cast("bigint")).alias("chars"))


@query("op_w7", sql(", f AS (SELECT conv_id, turn, text, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM v_turns) SELECT conv_id, turn FROM (SELECT *, max((used > 120)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS over_, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM f) WHERE over_ = 0 OR rn = 1", "v_turns"))
def budget_prefix(spark, d):
    from ..operators.chunking import within_budget

    return within_budget(b.turns(spark, d), "conv_id", "turn", "text", 120).select("conv_id", "turn")


@query("op_w8", "WITH s AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rn, count(*) OVER (PARTITION BY p_type) AS n FROM part) SELECT p_type, p_partkey, CASE WHEN n % 9 = 1 AND rn > n - 5 THEN (n - 1) // 9 ELSE (rn - 1) // 9 END AS batch FROM s WHERE n > 1")
def batches(spark, d):
    from ..operators.resolution import batch_numbers

    p = b.table(spark, d, "part")
    return batch_numbers(p, "p_type", 9, F.desc("p_retailprice"), F.col("p_partkey")).select("p_type", "p_partkey", "batch")


@query("op_u4", sql("SELECT entity_id, array_to_string(list_distinct_ordered, ',') AS aliases FROM (SELECT entity_id, list_transform(list_sort(list(struct_pack(f := f, v := value))), lambda s: s.v) AS list_distinct_ordered FROM (SELECT entity_id, value, min(id) AS f FROM v_claims GROUP BY 1, 2) GROUP BY 1)", "v_claims"))
def alias_union(spark, d):
    """Values in order of arrival, each once."""
    first = b.claims(spark, d).groupBy("entity_id", "value").agg(F.min("id").alias("f"))
    return first.groupBy("entity_id").agg(listing.ordered_text(F.col("value"), F.col("f"), separator=",").alias("aliases"))


@query("op_u5", "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey")
def canonical_pairs(spark, d):
    return b.table(spark, d, "lineitem").filter("l_partkey <> l_suppkey").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@query("op_f15", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey <> l_suppkey")
def no_self_reference(spark, d):
    return b.table(spark, d, "lineitem").filter("l_partkey <> l_suppkey").select("l_orderkey", "l_linenumber")
