"""Registered queries, continued: sources, sinks, and the smaller relational shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import embedding, markup, scores, texts, vectors
from ..operators import catalog, digests, graph, mining, retrieval, textindex, upkeep
from ..sources import configs, files, sessions
from ..streaming import intake
from . import cdc, store
from .fixtures import AS_OF, MEMORIES, SCORED, as_of, memories, query_vector, table
from .fixtures import vectors as stored_vectors
from .queries import _LABEL, _NEAR, _PAIRS, KW20, QUERY, VEC20, _signals, query

# Sources: the tables as the files, archives and logs that the readers take


def _archive(spark, d):
    """Conversations as session archives: one file each, one JSON line a turn; those of every tenth are broken."""
    talks = table(spark, d, "conversations").withColumn("kind", F.when(F.col("role") == "user", "input_text").otherwise("output_text"))
    content = F.array(F.struct(F.col("kind").alias("type"), F.col("text")))
    line = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.when(F.col("turn") == 3, "function_call").otherwise("message").alias("type"), content.alias("content")).alias("payload")))
    return talks.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line_no"), F.when(F.col("conv_id") % 10 == 9, F.lit("not json")).otherwise(line).alias("line"))


@query(
    "src06_archive_summary",
    """SELECT conv_id::VARCHAR AS file, count(*) AS line_count, sum((conv_id % 10 <> 9)::INT)::BIGINT AS message_count, sum((conv_id % 10 <> 9 AND turn = 3)::INT)::BIGINT AS tool_call_count,
       arg_min(CASE WHEN length(text) > 240 THEN substr(text, 1, 240) || '...' ELSE text END, turn) FILTER (WHERE role = 'user' AND turn <> 3 AND conv_id % 10 <> 9) AS user_excerpt FROM conversations GROUP BY conv_id""",
)
def archive_summary(spark, d):
    return sessions.summaries(_archive(spark, d)).select("file", "line_count", "message_count", "tool_call_count", "user_excerpt")


@query("src05_unseen_archives", "SELECT conv_id::VARCHAR AS path FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 <> 0")
def unseen_archives(spark, d):
    found = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("path")).distinct().withColumn("checksum", F.md5("path"))
    known = found.where(F.col("path").cast("long") % 3 == 0)
    return sessions.unseen(found, known).select("path")


@query(
    "src08_tagged_parts",
    "SELECT c.conv_id::VARCHAR AS session_id, c.role, strlen(c.text)::BIGINT AS size, 'talk ' || c.conv_id AS title FROM conversations c",
)
def tagged_parts(spark, d):
    talks, none = table(spark, d, "conversations"), F.lit(None).cast("string")
    place = [F.pmod("conv_id", F.lit(7)).alias("file"), (F.col("conv_id") * 10_000 + F.col("turn") + 1).alias("line_no")]
    parts = talks.select(F.lit("part").alias("kind"), *place, none.alias("session_id"), "role", "text", none.alias("title"))
    name = F.col("conv_id").cast("string")
    heads = talks.select("conv_id").distinct().withColumn("turn", F.lit(-1)).select(
        F.lit("session").alias("kind"), *place, name.alias("session_id"), none.alias("role"), none.alias("text"), F.concat(F.lit("talk "), name).alias("title")
    )
    return sessions.session_parts(heads.unionByName(parts)).select("session_id", "role", F.octet_length("text").cast("long").alias("size"), "title")


@query("src07_sessions_by_time", "SELECT o_orderkey AS session_id FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def sessions_by_time(spark, d):
    return table(spark, d, "orders").orderBy("o_orderdate", "o_orderkey").limit(100).select(F.col("o_orderkey").alias("session_id"))


def _log(spark, d):
    e = F.col("event_id").cast("string")
    line = F.concat(F.lit("session.id=ses_"), F.col("user_id").cast("string"), F.lit(" modelID=m-"), (F.col("event_id") % 4).cast("string"), F.lit(' agent="'), F.col("event_type"), F.lit('" id='), e, F.when(F.col("event_type") == "error", " level=ERROR").otherwise(" level=INFO"))
    return table(spark, d, "events").select(line.alias("line"))


@query("src11_log_rollup", "SELECT count(*) AS lines, count(DISTINCT user_id) AS sessions, count(DISTINCT event_id % 4) AS models, count(DISTINCT event_type) AS agents, sum((event_type = 'error')::INT)::BIGINT AS errors FROM events")
def log_rollup(spark, d):
    return configs.log_rollup(_log(spark, d))


@query("agg20_log_rollup_all", "SELECT count(*) AS lines, count(DISTINCT user_id) AS sessions, count(DISTINCT event_id % 4) AS models, count(DISTINCT event_type) AS agents, sum((event_type = 'error')::INT)::BIGINT AS errors FROM events")
def log_rollup_all(spark, d):
    return configs.log_rollup(_log(spark, d), every_match=True)


@query("agg21_config_rollup", "SELECT r_regionkey::VARCHAR AS path, r_regionkey::INT AS agents, 0 AS commands, 1 AS servers, 2 AS instructions FROM region WHERE r_regionkey > 0")
def config_rollup(spark, d):
    agents = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.col("r_regionkey")), lambda i: F.struct(F.concat(F.lit("a"), i.cast("string")), F.lit(1))))
    text = F.to_json(F.struct(agents.alias("agent"), F.create_map(F.lit("x"), F.lit(1)).alias("mcp"), F.array(F.lit("i"), F.lit("j")).alias("instructions")))
    return configs.config_rollup(table(spark, d, "region").where("r_regionkey > 0").select(F.col("r_regionkey").cast("string").alias("path"), text.alias("text")))


@query("src13_two_sides", "SELECT 'documents' AS label, count(*) AS local, sum((doc_id % 2 = 0)::INT)::BIGINT AS remote, count(*) - sum((doc_id % 2 = 0)::INT)::BIGINT AS delta FROM documents")
def two_sides(spark, d):
    docs = table(spark, d, "documents")
    return upkeep.count_delta(catalog.table_counts({"documents": docs}), catalog.table_counts({"documents": docs.where("doc_id % 2 = 0")}))


@query("src18_graph", "WITH e AS (SELECT 'o' || l_orderkey AS s, 'p' || l_partkey AS t FROM lineitem) SELECT DISTINCT t AS node, 1 AS hops FROM e WHERE s IN ('o1', 'o2', 'o3') UNION ALL SELECT unnest(['o1', 'o2', 'o3']), 0")
def graph_query(spark, d):
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, d, "lineitem").select(named("o", "l_orderkey").alias("source"), named("p", "l_partkey").alias("target"))
    return graph.within_hops(edges, spark.createDataFrame([("o1",), ("o2",), ("o3",)], "node string"), 2)


@query("src21_dimension_probe", "SELECT count(DISTINCT len(embedding)) AS dimensions, 'semantic' AS mode FROM embeddings")
def dimension_probe(spark, d):
    none = spark.range(0)
    return catalog.health(True, True, none.select(F.col("id").alias("version")), none, stored_vectors(spark, d)).select("dimensions", "mode")


# Sinks


@query("snk07_document_upsert", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS lang FROM documents")
def document_upsert(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return store.merged(docs, docs.where("doc_id % 2 = 0").withColumn("lang", F.upper("lang")), ["doc_id"])


@query("snk11_contradictions_once", f"SELECT a, b FROM {_NEAR} WHERE a < b AND a % 2 = 1 UNION SELECT b, a FROM {_NEAR} WHERE b < a AND b % 2 = 1")
def contradictions_once(spark, d):
    near = mining.nearest(stored_vectors(spark, d), 10, 0.2)
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).dropDuplicates()
    return store.without(pairs, pairs.where("a % 2 = 0"), ["a", "b"])


@query("snk12_embedding_upsert", "SELECT vec_id AS id, CASE WHEN vec_id < 10 THEN 1 ELSE label END AS label FROM embeddings")
def embedding_upsert(spark, d):
    v = stored_vectors(spark, d).select("id", "label")
    return store.merged(v, v.where("id < 10").withColumn("label", F.lit(1)), ["id"])


@query("snk13_embedding_delete", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 5 <> 0")
def embedding_delete(spark, d):
    v = stored_vectors(spark, d).select("id")
    return store.without(v, v.where("id % 5 = 0"), ["id"])


@query("snk15_filled_update", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE p_name END AS p_name FROM part")
def filled_update(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    new = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "new").alias("p_name"))
    return store.merged(part, new, ["p_partkey"], update={"p_name": "filled"})


@query("snk19_keep_checksum", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE md5(text) END AS checksum, source FROM documents")
def keep_checksum(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("checksum"), "source")
    new = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "x").alias("checksum"), F.lit("other").alias("source"))
    return store.merged(docs, new, ["doc_id"], update={"checksum": "filled", "source": "old"})


@query("snk20_ensured", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def ensured(spark, d):
    names = table(spark, d, "region").select(F.col("r_name").alias("name"))
    return store.ensured(table(spark, d, "nation").select(F.col("n_name").alias("name")), names.unionByName(names))


@query("snk21_vault_sync", "SELECT CASE WHEN doc_id % 7 = 0 THEN 'moved/' ELSE 'docs/' END || doc_id AS path, CASE WHEN doc_id % 11 = 0 AND doc_id % 7 <> 0 THEN 'changed' ELSE 'sum' || doc_id END AS checksum FROM documents")
def vault_sync(spark, d):
    ids = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("s"))
    known = ids.select(F.concat(F.lit("docs/"), "s").alias("path"), F.concat(F.lit("sum"), "s").alias("checksum"))
    path = F.concat(F.when(F.col("doc_id") % 7 == 0, "moved/").otherwise("docs/"), "s")
    total = F.when((F.col("doc_id") % 11 == 0) & (F.col("doc_id") % 7 != 0), "changed").otherwise(F.concat(F.lit("sum"), "s"))
    scanned = ids.select(path.alias("path"), total.alias("checksum"))
    return store.renamed(known, upkeep.classify_files(scanned, known))


def _talks(spark, d):
    talks = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "role", "text")
    heads = talks.select("session_id").distinct().select("session_id", F.concat(F.lit("talk "), "session_id").alias("title"), F.lit(None).cast("string").alias("summary"))
    return sessions.fan_out(heads, talks, heads.where(F.col("session_id").cast("long") % 2 == 0))


@query("snk23_import_counts", "SELECT 'sessions' AS label, count(DISTINCT conv_id) AS n FROM conversations WHERE conv_id % 2 = 1 UNION ALL SELECT 'messages', count(*) FROM conversations WHERE conv_id % 2 = 1 AND role = 'user' AND strlen(text) > 50")
def import_counts(spark, d):
    out = _talks(spark, d)
    return catalog.table_counts({k: out[k] for k in ("sessions", "messages")})


@query("snk22_import_summaries", "SELECT DISTINCT conv_id::VARCHAR AS session_id, 'goal: talk ' || conv_id AS content FROM conversations WHERE conv_id % 2 = 1")
def import_summaries(spark, d):
    return _talks(spark, d)["summaries"].select("session_id", "content")


@query("snk24_access_log", "SELECT user_id AS id, count(*) AS n, epoch_us(max(ts))::BIGINT AS last FROM events GROUP BY user_id")
def access_log(spark, d):
    log = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return log.select("id", "n", F.unix_micros(F.col("last").cast("timestamp")).alias("last"))


@query(
    "snk27_compacted",
    """WITH s AS (SELECT doc_id AS id, lang AS g, list_distinct(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) AS w FROM documents),
       p AS (SELECT DISTINCT x.id FROM s x JOIN s y ON x.g = y.g AND x.id < y.id WHERE least(len(x.w), len(y.w)) >= 0.9 * greatest(len(x.w), len(y.w)) AND len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w)))::DOUBLE > 0.9)
       SELECT m.id, CASE WHEN p.id IS NULL THEN importance ELSE 0 END AS importance, len(tags) + (p.id IS NOT NULL)::INT AS n_tags FROM """
    + MEMORIES + " m LEFT JOIN p ON p.id = m.id",
)
def compacted(spark, d):
    m = memories(spark, d)
    return mining.compacted(m, mining.superseded(m, 0.9, group_col="lang")).select("id", "importance", F.size("tags").cast("long").alias("n_tags"))


@query(
    "snk28_repair",
    """SELECT doc_id AS id, 64 AS dimension, round(embedding[1]::DOUBLE, 6) AS kept_first, round(embedding[64]::DOUBLE, 6) AS kept_last
       FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE trim(text) <> ''""",
)
def repair(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").join(stored_vectors(spark, d).select("id", "embedding"), "id", "left").withColumn("had", F.col("embedding").isNotNull())
    done = store.repaired_embeddings(rows, F.col("text"), embedding.embedder(64)).where("embedding is not null and trim(text) <> ''")
    kept = lambda k: F.when(F.col("had"), F.round(F.col("embedding")[k].cast("double"), 6))
    return done.select("id", F.size("embedding").alias("dimension"), kept(0).alias("kept_first"), kept(63).alias("kept_last"))


@query(
    "snk31_bundle",
    """WITH v AS (SELECT '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || '}' AS value FROM orders WHERE o_orderstatus = 'P'), h AS (SELECT value, sha256(value) AS d FROM v),
       c AS (SELECT value, ('0x' || d[1:15])::BIGINT AS a, ('0x' || d[16:30])::BIGINT AS b, ('0x' || d[31:45])::BIGINT AS c, ('0x' || d[46:60])::BIGINT AS e FROM h)
       SELECT count(*) AS records, sum(strlen(value) + 1)::BIGINT AS bytes, sha256(concat_ws(',', sum(a)::HUGEINT::VARCHAR, sum(b)::HUGEINT::VARCHAR, sum(c)::HUGEINT::VARCHAR, sum(e)::HUGEINT::VARCHAR)) AS sha256 FROM c""",
)
def bundle(spark, d):
    return store.bundle(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey"), "o_orderkey")[1].select("records", "bytes", "sha256")


@query("snk32_restored", "SELECT o_orderkey AS id FROM orders WHERE o_custkey % 3 = 0 ORDER BY o_orderdate, o_orderkey LIMIT 30")
def restored(spark, d):
    archive = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("archived_at"), (F.col("o_custkey") % 3).alias("bundle_id"))
    bundles = spark.createDataFrame([(0, "verified"), (1, "failed"), (2, "open")], "bundle_id long, state string")
    return store.restored(archive, bundles, 30).select("id")


@query("snk33_metrics", """SELECT '{"documents":"' || (SELECT count(*) FROM documents) || '","events":"' || (SELECT count(*) FROM events) || '"}' AS value""")
def metrics(spark, d):
    count = lambda t: table(spark, d, t).agg(F.count("*").alias("n"))
    return store.metrics({"events": count("events"), "documents": count("documents")})


@query("snk39_migrations", "SELECT n_nationkey::INT AS version FROM nation WHERE n_nationkey > 13 ORDER BY 1")
def migrations(spark, d):
    every = table(spark, d, "nation").select(F.col("n_nationkey").alias("version"))
    return store.migrated(every.where(F.col("version") <= store.SCHEMA_VERSION), every).select(F.col("version").cast("int").alias("version"))


@query("snk34_mirror", "SELECT user_id::VARCHAR AS record_key, arg_max(props, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS payload FROM events GROUP BY user_id")
def mirror(spark, d):
    log = table(spark, d, "events").select(F.lit("users").alias("table_name"), F.col("user_id").cast("string").alias("record_key"), F.lit("upsert").alias("operation"), F.col("props").alias("payload"), F.col("ts").alias("created_at"), "event_id")
    return cdc.latest_payloads(log).select("record_key", "payload")


# Filters and projections


@query("fil04_strict_threshold", f"SELECT count(*) AS n FROM {SCORED} WHERE score > 0")
def strict_threshold(spark, d):
    return retrieval.vector_topk(stored_vectors(spark, d), query_vector(spark, d), 1_000_000).agg(F.count("*").alias("n"))


@query("fil05_missing_vectors", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def missing_vectors(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(stored_vectors(spark, d).select(F.col("id").alias("doc_id"), "embedding"), "doc_id", "left")
    return rows.where("embedding is null").select("doc_id")


@query("fil06_ilike", "SELECT p_partkey FROM part WHERE p_name ILIKE '%WIDGET%' OR p_brand ILIKE '%WIDGET%' OR p_type ILIKE '%WIDGET%'")
def ilike(spark, d):
    like = reduce(lambda a, b: a | b, [F.col(c).ilike("%WIDGET%") for c in ("p_name", "p_brand", "p_type")])
    return table(spark, d, "part").where(like).select("p_partkey")


@query("fil07_all_terms", f"SELECT count(*) AS n FROM (SELECT DISTINCT id FROM {KW20})")
def all_terms(spark, d):
    return textindex.fts_topk(memories(spark, d), QUERY, 20).agg(F.count("*").alias("n"))


@query("fil13_active_tier", f"SELECT id FROM {MEMORIES} WHERE storage_tier = 'active'")
def active_tier(spark, d):
    return memories(spark, d).where("storage_tier = 'active'").select("id")


@query("fil15_case_where", "SELECT event_id FROM events WHERE CASE WHEN event_type = 'error' THEN user_id ELSE event_id END % 10 = 1")
def case_where(spark, d):
    return table(spark, d, "events").where(F.when(F.col("event_type") == "error", F.col("user_id")).otherwise(F.col("event_id")) % 10 == 1).select("event_id")


@query("fil17_retention", "SELECT strftime(o_orderdate, '%Y%m%d') AS name FROM orders WHERE o_orderdate < (SELECT min(o_orderdate) + INTERVAL 30 DAY FROM orders) GROUP BY 1")
def retention(spark, d):
    orders = table(spark, d, "orders")
    first = orders.agg(F.date_add(F.min("o_orderdate"), 30).alias("d")).first()["d"]
    names = orders.select(F.date_format("o_orderdate", "yyyyMMdd").alias("name")).distinct().unionByName(spark.createDataFrame([("notes",)], "name string"))
    return files.retention_violations(names, F.lit(first)).select("name")


@query("prj01_columns", f"SELECT id, coalesce(content, '') AS text, array_to_string(tags, ',') AS extra FROM {MEMORIES}")
def columns(spark, d):
    text, extra = retrieval.search_columns("memories")
    return memories(spark, d).select("id", F.coalesce(text, F.lit("")).alias("text"), F.array_join(extra, ",").alias("extra"))


@query("prj02_row_image", """SELECT vec_id AS id, '{"id":' || vec_id || ',"label":' || label || '}' AS image FROM embeddings""")
def row_image(spark, d):
    v = stored_vectors(spark, d)
    return v.select("id", cdc.payload(v.columns, F.lit(True)).alias("image"))


@query("prj03_previews", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS p200, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS p120 FROM documents")
def preview_sizes(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.preview(F.col("text"), 200).alias("p200"), texts.preview(F.col("text"), 120).alias("p120"))


@query("prj04_banner", f"SELECT section, string_agg(rank || '. ' || id, chr(10) ORDER BY rank) AS banner FROM (SELECT 'similar' AS section, rank, id FROM {VEC20} WHERE rank <= 5 UNION ALL SELECT 'keyword', rank, id FROM {KW20} WHERE rank <= 3) GROUP BY section")
def banner(spark, d):
    found = {"similar": retrieval.vector_topk(stored_vectors(spark, d), query_vector(spark, d), 20), "keyword": textindex.fts_topk(memories(spark, d), QUERY, 20)}
    package = retrieval.context_package(found, {"similar": 5, "keyword": 3})
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda r: F.concat_ws(". ", r["rank"].cast("string"), r["id"]))
    return package.groupBy("section").agg(F.array_join(lines, "\n").alias("banner"))


# Joins, sets


@query("join02_theta", f"SELECT a, b FROM {_PAIRS.format('a.vec_id < b.vec_id')} WHERE score > 0.35")
def theta(spark, d):
    from ..operators.blocks import similar_pairs

    return similar_pairs(stored_vectors(spark, d), 0.35).select("a", "b")


@query("join03_two_joins", "SELECT 'order' AS kind, o_orderkey AS item FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'event', event_id FROM events JOIN customer ON c_custkey = user_id WHERE c_mktsegment = 'BUILDING'")
def two_joins(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("item"))
    events = table(spark, d, "events").join(c, F.col("user_id") == F.col("c_custkey")).select(F.lit("event").alias("kind"), F.col("event_id").alias("item"))
    return orders.unionByName(events)


@query("join05_part_message", "SELECT event_id, c_name, json_extract_string(props, '$.k')::BIGINT AS k FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'signup'")
def part_message(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return table(spark, d, "events").where("event_type = 'signup'").join(c, "user_id").select("event_id", "c_name", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("join06_limited_update", "WITH t AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50) SELECT o.o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN o_orderstatus ELSE 'R' END AS status FROM orders o LEFT JOIN t ON t.o_orderkey = o.o_orderkey")
def limited_update(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("status"))
    first = orders.orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", F.lit("R").alias("status"))
    return store.merged(orders.select("o_orderkey", "status"), first, ["o_orderkey"])


@query("join12_first_wins", f"SELECT count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT id FROM {VEC20} UNION SELECT id FROM {KW20})")
def first_wins(spark, d):
    vec, kw = retrieval.vector_topk(stored_vectors(spark, d), query_vector(spark, d), 20), textindex.fts_topk(memories(spark, d), QUERY, 20)
    return retrieval.legacy_hybrid(vec, kw, 100).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("join15_audit", "SELECT o_orderkey AS id, 'mismatch' AS reason FROM orders WHERE o_orderkey % 17 = 0")
def audit(spark, d):
    local = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    remote = local.withColumn("o_orderstatus", F.when(F.col("id") % 17 == 0, "?").otherwise(F.col("o_orderstatus")))
    return upkeep.hash_audit(local, remote, "id", local.columns)


@query(
    "str09_digest_tree",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 1009 = 0 THEN 'missing' ELSE 'mismatch' END AS reason FROM orders WHERE o_orderkey % 1009 = 0 OR o_orderkey % 997 = 0
       UNION ALL SELECT -1 - c_custkey, 'extra' FROM customer WHERE c_custkey % 211 = 0""",
)
def digest_audit(spark, d):
    local = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    changed = local.withColumn("o_orderstatus", F.when(F.col("id") % 997 == 0, "?").otherwise(F.col("o_orderstatus"))).where("id % 1009 <> 0")
    extra = table(spark, d, "customer").where("c_custkey % 211 = 0").select((F.lit(-1) - F.col("c_custkey")).alias("id"), F.lit(0.0).cast(local.schema["o_totalprice"].dataType).alias("o_totalprice"), F.lit("N").alias("o_orderstatus"))
    return digests.tree_audit(local, changed.unionByName(extra), "id", local.columns)


@query("join19_verified", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 9000")
def verified(spark, d):
    good = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(good, "o_custkey").select("o_orderkey")


@query("set01_union_all", "SELECT doc_id AS id FROM documents UNION ALL SELECT page_id FROM pages")
def union_all(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")).unionByName(table(spark, d, "pages").select(F.col("page_id").alias("id")))


@query("set03_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def difference(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("set04_symmetric", "SELECT page_id AS id, 'missing' AS status FROM pages WHERE page_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'extra' FROM embeddings WHERE vec_id NOT IN (SELECT page_id FROM pages)")
def symmetric(spark, d):
    return upkeep.parity(table(spark, d, "pages").select(F.col("page_id").alias("id")), stored_vectors(spark, d), "id")


@query("set05_word_sets", "SELECT p_partkey, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS either FROM (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(p_type, ' ')) AS b FROM part)")
def word_sets(spark, d):
    a, b = texts.word_set(F.col("p_name")), texts.word_set(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.size(F.array_intersect(a, b)).cast("long").alias("shared"), F.size(F.array_union(a, b)).cast("long").alias("either"))


# Aggregates


@query("agg03_active_sources", f"SELECT {_LABEL} AS label, count(*) AS n FROM {MEMORIES} WHERE storage_tier = 'active' AND path NOT LIKE '%browser%' GROUP BY ALL")
def active_sources(spark, d):
    m = memories(spark, d).where((F.col("storage_tier") == "active") & ~F.col("path").like("%browser%"))
    return m.groupBy(texts.source_label(F.col("path"), browser=False).alias("label")).agg(F.count("*").alias("n"))


@query("agg05_parity_matrix", f"SELECT label, count(*) AS local, sum((id % 3 = 0)::INT)::BIGINT AS remote, count(*) - sum((id % 3 = 0)::INT)::BIGINT AS delta FROM (SELECT id, {_LABEL} AS label FROM {MEMORIES}) GROUP BY label")
def parity_matrix(spark, d):
    m = memories(spark, d).select("id", texts.source_label(F.col("path")).alias("label"))
    count = lambda x: x.groupBy("label").agg(F.count("*").alias("n"))
    return upkeep.count_delta(count(m), count(m.where("id % 3 = 0")))


@query("agg07_pending_bytes", "SELECT coalesce(sum(strlen(props)), 0)::BIGINT AS pending_bytes FROM events WHERE event_type = 'click'")
def pending_bytes(spark, d):
    return catalog.event_totals(table(spark, d, "events"), F.col("event_type") != "click", F.octet_length("props")).select("pending_bytes")


@query("agg10_archive_totals", "SELECT count(*) AS records, count(DISTINCT o_custkey) AS bundles, sum(o_totalprice > 100000)::BIGINT AS large FROM orders WHERE o_orderstatus = 'F'".replace("sum(o_totalprice > 100000)", "sum((o_totalprice > 100000)::INT)"))
def archive_totals(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return gone.agg(F.count("*").alias("records"), F.count_distinct("o_custkey").alias("bundles"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("agg11_tiers", f"SELECT storage_tier, count(*) AS n FROM {MEMORIES} GROUP BY storage_tier")
def tiers(spark, d):
    none = spark.createDataFrame([], "bundle_id long, created_at timestamp")
    return catalog.tier_report(memories(spark, d), none, none)["tiers"]


@query("agg16_global_max", "SELECT o_orderkey, round(o_totalprice / greatest(max(o_totalprice) OVER (), 1e-12), 9) AS share FROM orders")
def global_max(spark, d):
    orders = table(spark, d, "orders")
    most = orders.agg(F.max("o_totalprice").alias("most"))
    return orders.crossJoin(F.broadcast(most)).select("o_orderkey", F.round(F.col("o_totalprice") / F.greatest("most", F.lit(1e-12)), 9).alias("share"))  # one row


@query("agg24_signals", f"SELECT doc_id, ({_signals('text', 'lang')})::INT AS signals FROM documents")
def signals(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.contradiction_signals(F.col("text"), F.col("lang")).alias("signals"))


@query("agg25_backlog", "SELECT t.label, t.n AS local, (t.n + 1) // 2 AS remote, t.n - (t.n + 1) // 2 AS delta, coalesce(q.n, 0) AS queued FROM (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1) t LEFT JOIN (SELECT event_type, count(*) AS n FROM events WHERE event_id % 100 = 0 GROUP BY 1) q ON q.event_type = t.label")
def backlog(spark, d):
    events = table(spark, d, "events").select("event_id", F.col("event_type").alias("table_name"))
    local = events.groupBy(F.col("table_name").alias("label")).agg(F.count("*").alias("n"))
    return catalog.backlog(local, local.withColumn("n", F.floor((F.col("n") + 1) / 2)), events.where("event_id % 100 = 0"))


@query("agg26_health", "SELECT 24::BIGINT AS schema_version, (SELECT count(*) FROM events WHERE event_type = 'error') AS queue_depth, 1::BIGINT AS dimensions, 'semantic' AS mode")
def health(spark, d):
    versions = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("version"))
    return catalog.health(True, True, versions, table(spark, d, "events").where("event_type = 'error'"), stored_vectors(spark, d))


@query("agg27_backup_coverage", "SELECT n_name AS label, count(s_suppkey) AS files, count(s_suppkey) > 0 AS covered FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def backup_coverage(spark, d):
    nations = table(spark, d, "nation")
    held = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("label"))
    return files.backup_coverage(nations.select(F.col("n_name").alias("label")), held)


@query("win01_ranks", f"SELECT id, rank FROM {VEC20}")
def ranks(spark, d):
    return retrieval.ranked(retrieval.vector_topk(stored_vectors(spark, d), query_vector(spark, d), 20)).select("id", F.col("rank").cast("long").alias("rank"))


@query("win03_per_entity", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def per_entity(spark, d):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(order)).where("r <= 3").select("o_custkey", "o_orderkey")


@query("win06_generation", "SELECT user_id, event_type, count(*) AS generation FROM events GROUP BY ALL")
def generation(spark, d):
    changes = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", F.lit("upsert").alias("op"))
    return catalog.outbox(changes, ["user_id", "event_type"], "op", "ts", "event_id").select("user_id", "event_type", "generation")


@query("top03_overfetch", f"SELECT count(*) AS n FROM (SELECT id FROM {VEC20} UNION SELECT id FROM {KW20})")
def overfetch(spark, d):
    pool = retrieval.rrf(retrieval.vector_topk(stored_vectors(spark, d), query_vector(spark, d), 20), textindex.fts_topk(memories(spark, d), QUERY, 20))
    return pool.agg(F.count("*").alias("n"))


@query("top06_usage", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 40")
def usage(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_size"), "p_partkey").limit(40).select("p_partkey", "p_size")


@query("top10_fifo", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 200")
def fifo(spark, d):
    return upkeep.keyset_page(table(spark, d, "events").where("event_type = 'error'"), "ts", "event_id", None, 200).select("event_id")


# Scalars


@query("scl02_units", "SELECT vec_id AS id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS length FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)")
def units(spark, d):
    u = vectors.unit(F.col("embedding"))
    return stored_vectors(spark, d).select("id", F.round(vectors.dot(u, u), 6).alias("length"))


@query("scl04_codec", "SELECT vec_id AS id, len(embedding) AS n, true AS same FROM embeddings")
def codec(spark, d):
    back = vectors.parse_vector(vectors.format_vector(F.col("embedding")))
    return stored_vectors(spark, d).select("id", F.size(back).cast("long").alias("n"), (back == F.col("embedding")).alias("same"))


@query("scl06_frequency", f"SELECT id, least(access_count / 5.0, 1.0)::DOUBLE AS frequency FROM {MEMORIES}")
def frequency(spark, d):
    return memories(spark, d).select("id", scores.frequency(F.col("access_count")).alias("frequency"))


@query("scl12_jaccard", "SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 9) AS similarity FROM (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(p_type, ' ')) AS b FROM part)")
def jaccard(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(texts.jaccard(texts.word_set(F.col("p_name")), texts.word_set(F.col("p_type"))), 9).alias("similarity"))


@query("scl15_terms", "SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in sorted(textindex.STOP)) + "))) AS n FROM documents")
def term_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(textindex.terms(F.col("text"))).cast("long").alias("n"))


@query("scl17_tags", f"SELECT id, array_to_string(list_append(tags, 'x'), ',') AS tags FROM {MEMORIES}")
def tag_text(spark, d):
    return memories(spark, d).select("id", F.array_join(F.array_append("tags", F.lit("x")), ",").alias("tags"))


@query("scl19_null_rules", "SELECT doc_id, greatest(quality, toxic) AS most, least(quality, toxic) AS least, coalesce(nullif(quality, 0), -1) AS filled FROM labels")
def null_rules(spark, d):
    return table(spark, d, "labels").select("doc_id", F.greatest("quality", "toxic").alias("most"), F.least("quality", "toxic").alias("least"), F.coalesce(F.nullif("quality", F.lit(0)), F.lit(-1)).alias("filled"))


@query("scl20_age", f"SELECT id, round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(coalesce(last_accessed_at, created_at))) / 86400e6, 9) AS days FROM {MEMORIES}")
def age(spark, d):
    return memories(spark, d).select("id", F.round(scores.age_days(F.coalesce("last_accessed_at", "created_at"), as_of()), 9).alias("days"))


@query("scl21_iso", "SELECT event_id, strftime(make_timestamp((epoch_us(ts) // 1000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def iso(spark, d):
    return table(spark, d, "events").select("event_id", texts.iso_from_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("iso"))


@query("scl23_json_build", """SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey || '}' AS image FROM nation""")
def json_build(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("image"))


@query("scl24_captures", r"SELECT c_custkey, regexp_extract(c_name, '#0*([0-9]+)', 1) AS number FROM customer")
def captures(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.regexp_extract("c_name", "#0*([0-9]+)", 1).alias("number"))


@query("scl29_sections", f"SELECT id, split_part(replace(path, '://', '/'), '/', 1) AS section, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) END AS parent FROM {MEMORIES}")
def sections(spark, d):
    p = F.col("path")
    return memories(spark, d).select("id", texts.vault_section(F.replace(p, F.lit("://"), F.lit("/"))).alias("section"), texts.vault_section_or_null(p).alias("parent"))


@query("scl30_uris", "SELECT doc_id, 'vault://' || source || '/' || doc_id AS uri FROM documents")
def uris(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.uri("vault", F.concat(F.lit("//"), "source", F.lit("/"), F.col("doc_id").cast("string"))).alias("uri"))


@query("scl31_composed", "SELECT n_nationkey, 'goal: ' || n_name || CASE WHEN n_regionkey % 2 = 0 THEN chr(10) || 'result: ' || n_regionkey ELSE '' END AS text FROM nation")
def composed(spark, d):
    result = F.when(F.col("n_regionkey") % 2 == 0, F.col("n_regionkey").cast("string"))
    return table(spark, d, "nation").select("n_nationkey", texts.composed({"goal": F.col("n_name"), "summary": F.lit(" "), "result": result}).alias("text"))


@query("scl34_mark_critical", f"SELECT id, CASE WHEN id % 8 = 0 THEN greatest(importance, 0.9) ELSE importance END AS importance, list_contains(tags, 'critical') OR id % 8 = 0 AS critical FROM {MEMORIES}")
def mark_critical(spark, d):
    return store.marked_critical(memories(spark, d), F.col("id") % 8 == 0).select("id", "importance", F.array_contains("tags", "critical").alias("critical"))


@query("scl36_next_action", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'paused' WHEN event_id % 7 = 0 THEN 'unreachable' WHEN event_id % 3 = 0 THEN 'push' WHEN event_type = 'error' THEN 'retry' ELSE 'idle' END AS action FROM events")
def next_action(spark, d):
    e = F.col("event_id")
    action = texts.next_action(e % 5 == 0, e % 7 != 0, F.when(e % 3 == 0, 1).otherwise(0), (F.col("event_type") == "error").cast("int"))
    return table(spark, d, "events").select("event_id", action.alias("action"))


@query("scl37_normalised", "SELECT c_custkey::VARCHAR AS session_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'agent' END AS agent, 'm' AS model, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_custkey::VARCHAR END AS title FROM customer")
def normalised(spark, d):
    named = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(F.col("c_name").alias("name")))).otherwise("{}")
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("session_id"), named.alias("agent"), F.lit('{"modelID":"m"}').alias("model"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(" ").alias("title"), F.lit("").alias("slug"))
    return sessions.normalised(rows)


@query("scl38_same_name", "SELECT n_nationkey FROM nation WHERE lower(n_name) = lower('FrAnCe') OR n_nationkey = 3")
def same_name(spark, d):
    return table(spark, d, "nation").where((F.lower("n_name") == "france") | (F.col("n_nationkey") == 3)).select("n_nationkey")


@query("scl39_flags", "SELECT event_id, event_id % 3 = 0 AS flag FROM events")
def flags(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.element_at(F.array(F.lit("TRUE"), F.lit("1"), F.lit(" yes ")), (F.col("event_id") % 2 + 1).cast("int"))).otherwise("no")
    return table(spark, d, "events").select("event_id", texts.truthy(raw).alias("flag"))


# Retrieval and change capture, the rest


@query("ret15_detect_one", f"SELECT b AS id, ({_signals('x.text', 'y.text')})::INT AS signals FROM {_NEAR} n JOIN documents x ON x.doc_id = n.a JOIN documents y ON y.doc_id = n.b WHERE n.a = 0 AND ({_signals('x.text', 'y.text')})::INT >= 1")
def detect_one(spark, d):
    v = stored_vectors(spark, d)
    near = retrieval.vector_topk(v, query_vector(spark, d), 10, 0.2).where("id <> 0")
    m = memories(spark, d)
    mine = m.where("id = 0").select(F.col("content").alias("own"))
    both = m.join(F.broadcast(near), "id").crossJoin(F.broadcast(mine))  # ten rows and one
    return both.select("id", texts.contradiction_signals(F.col("own"), F.col("content")).alias("signals")).where("signals >= 1")


@query("ret16_detect_db", f"SELECT id, score FROM {SCORED} WHERE score > 0.2 AND score >= 0.25 AND id <> 0 ORDER BY score DESC, id LIMIT 9")
def detect_db(spark, d):
    found = retrieval.vector_topk(stored_vectors(spark, d), query_vector(spark, d), 10, 0.2)
    return found.where("score >= 0.25 and id <> 0")


@query("str07_drained", "SELECT event_id, CASE WHEN event_type = 'error' THEN 2 - p ELSE 2 + p END AS turn FROM (SELECT event_id, event_type, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END AS p FROM events)")
def drained(spark, d):
    queue = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, "parent").otherwise("child").alias("table_name"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"))
    return cdc.drained(queue, ["parent", "child"]).select("event_id", "turn")


@query("str10_cache", "SELECT CASE WHEN label % 2 = 0 THEN 'documents' ELSE 'pages' END AS source_table, vec_id AS source_id, CASE WHEN label % 2 = 0 THEN d.lang ELSE p.url END AS payload FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id AND label % 2 = 0 LEFT JOIN pages p ON p.page_id = vec_id AND label % 2 = 1")
def cache(spark, d):
    manifest = stored_vectors(spark, d).select(F.when(F.col("label") % 2 == 0, "documents").otherwise("pages").alias("source_table"), F.col("id").alias("source_id"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("payload"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("payload"))
    return cdc.cache_payloads(manifest, {"documents": docs, "pages": pages})


@query("str12_ledger", "SELECT user_id AS run_id, arg_max(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS status, count(*) AS rows FROM events GROUP BY user_id")
def ledger(spark, d):
    at = F.struct("ts", "event_id")
    return cdc.ledger(table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("status"), at.alias("at"), F.lit(1).alias("rows")))


@query("str13_maintained", f"SELECT id, CASE WHEN id % 2 = 0 AND id % 6 <> 0 THEN epoch(TIMESTAMP '{AS_OF}') ELSE epoch(created_at) END::BIGINT AS updated FROM {MEMORIES}")
def maintained(spark, d):
    rows = memories(spark, d).select("id", F.col("created_at").alias("updated_at"))
    done = store.maintained(rows, F.col("id") % 2 == 0, as_of(), F.col("id") % 6 == 0)
    return done.select("id", F.unix_seconds(F.col("updated_at").cast("timestamp")).alias("updated"))


@query("str14_settled", f"SELECT epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(ts))) >= 120 AS settled FROM events")
def settled(spark, d):
    return files.settled(table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("modified_at")), as_of()).select("settled")


@query("udf06_embedder", "SELECT doc_id, true AS unit FROM documents WHERE trim(text) <> ''")
def embedder(spark, d):
    v = table(spark, d, "documents").where(F.trim("text") != "").select("doc_id", embedding.embedder(64)("text").alias("v"))
    return v.select("doc_id", (F.abs(vectors.norm(F.col("v")) - 1) < 1e-5).alias("unit"))


@query("tbl02_frontmatter", """SELECT doc_id, '{"n": ' || doc_id || ', "ok": true}' AS frontmatter, length(text) AS size FROM documents WHERE ltrim(text, chr(10)) = text""")
def frontmatter(spark, d):
    raw = F.concat(F.lit("---\nok: true\nn: "), F.col("doc_id").cast("string"), F.lit("\n---\n"), "text")
    rows = table(spark, d, "documents").where(~F.col("text").startswith("\n")).select("doc_id", markup.frontmatter(raw).alias("f"))
    return rows.select("doc_id", "f.frontmatter", F.length("f.body").cast("long").alias("size"))


@query("ext_hourly_sliding", "SELECT count(*) * 2 AS n FROM events")
def sliding(spark, d):
    counted = intake.windowed_counts(table(spark, d, "events").select("ts", "event_type"), "1 hour", "30 minutes")
    return counted.agg(F.sum("n").alias("n"))
