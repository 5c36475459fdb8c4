"""Registered queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, texts, vectors
from ..operators import catalog, mining, retrieval, textindex, upkeep
from . import cdc, store
from .fixtures import AS_OF, MEMORIES, SCORED, as_of, keyword_sql, memories, query_vector, scratch, table
from .fixtures import vectors as stored_vectors

#: Two words that occur together at every scale, in documents on both sides of the fusion and with equal scores among them.
QUERY = "thth hest"
KW = keyword_sql(["hest", "thth"])
R4 = "floor(({}) * 10000 + 0.5) / 10000"
VEC20 = f"(SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {SCORED} WHERE score > 0 ORDER BY score DESC, id LIMIT 20)"
KW20 = f"(SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {KW} ORDER BY score DESC, id LIMIT 20)"
BOTH = f"""(SELECT coalesce(v.id, k.id) AS id, v.score AS vs, v.rank AS vr, k.score AS ks, k.rank AS kr FROM {VEC20} v FULL JOIN {KW20} k ON v.id = k.id)"""
RRF = "coalesce(0.6 / (20 + vr), 0) + coalesce(0.4 / (20 + kr), 0)"
DECAY = f"greatest(0.1, pow(2.0, -((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(coalesce(last_accessed_at, created_at))) / 86400e6) / 90.0))"

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its twin if there is one."""

    def put(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def _sides(spark: SparkSession, d: str, n: int = 20) -> tuple[DataFrame, DataFrame]:
    vec = retrieval.vector_topk(stored_vectors(spark, d), query_vector(spark, d), n)
    return vec, textindex.fts_topk(memories(spark, d), QUERY, n)


# Retrieval


@query("ret01_vector_topk", f"SELECT id, score FROM {SCORED} WHERE score > 0 ORDER BY score DESC, id LIMIT 10")
def vector_topk(spark, d):
    return retrieval.vector_topk(stored_vectors(spark, d), query_vector(spark, d), 10)


@query("ret01_vector_threshold", f"SELECT id, score FROM {SCORED} WHERE score > 0.2 ORDER BY score DESC, id LIMIT 1000")
def vector_threshold(spark, d):
    return retrieval.vector_topk(stored_vectors(spark, d), query_vector(spark, d), 1000, 0.2)


@query("join01_vector_rows", f"SELECT s.id, s.score, d.source, d.lang FROM (SELECT * FROM {SCORED} WHERE score > 0 ORDER BY score DESC, id LIMIT 50) s JOIN documents d ON d.doc_id = s.id")
def vector_rows(spark, d):
    found = retrieval.vector_topk(stored_vectors(spark, d), query_vector(spark, d), 50)
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return rows.join(F.broadcast(found), "id").select("id", "score", "source", "lang")  # at most 50 rows


@query("ret02_fts_rank", f"SELECT id, score FROM {KW} ORDER BY score DESC, id LIMIT 20")
def fts_rank(spark, d):
    return textindex.fts_topk(memories(spark, d), QUERY, 20)


#: Words in forms that are no stems themselves, and rarely the ones that the documents hold.
FORMS = "ering Aned"


@query("ret02_stemmed", f"SELECT id, score FROM {keyword_sql(['ering', 'aned'])} ORDER BY score DESC, id LIMIT 100")
def stemmed(spark, d):
    return textindex.fts_topk(memories(spark, d), FORMS, 100)


def _index(spark, rows: DataFrame, **how) -> textindex.TextIndex:
    """An index of some rows, built in the shared folder."""
    return textindex.TextIndex(spark, scratch(spark)).build(rows, **how)


@query("ret02_index_search", f"SELECT id, score FROM {KW} ORDER BY score DESC, id LIMIT 20")
def index_search(spark, d):
    return _index(spark, memories(spark, d), grams=False).search(QUERY, 20)


@query("ret02_index_stemmed", f"SELECT id, score FROM {keyword_sql(['ering', 'aned'])} ORDER BY score DESC, id LIMIT 100")
def index_stemmed(spark, d):
    return _index(spark, memories(spark, d), grams=False, block_docs=256).search(FORMS, 100)


@query(
    "ret02_trigram",
    """WITH w AS (SELECT p_partkey AS id, list_distinct(flatten(list_transform(list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')),
         lambda x: list_transform(range(1, len('  ' || x || ' ') - 1), lambda i: substr('  ' || x || ' ', i, 3))))) AS t FROM part),
       q AS (SELECT t FROM w WHERE id = 7)
       SELECT w.id, round(len(list_intersect(w.t, q.t)) / len(list_distinct(list_concat(w.t, q.t)))::DOUBLE, 9) AS score FROM w, q
       WHERE round(len(list_intersect(w.t, q.t)) / len(list_distinct(list_concat(w.t, q.t)))::DOUBLE, 9) >= 0.3 ORDER BY score DESC, id LIMIT 25""",
)
def trigram(spark, d):
    part = table(spark, d, "part")
    text = part.where("p_partkey = 7").first()["p_name"]
    return textindex.trigram_topk(part, text, 25, id_col="p_partkey", text_col="p_name")


#: Trigrams of a part's name, and of a query that no name holds as a word.
_GRAMS = """list_distinct(flatten(list_transform(list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')),
         lambda x: list_transform(range(1, len('  ' || x || ' ') - 1), lambda i: substr('  ' || x || ' ', i, 3)))))"""


@query(
    "ret02_fallback",
    f"""WITH w AS (SELECT p_partkey AS id, {_GRAMS.format("p_name")} AS t, {_GRAMS.format("'cold widge'")} AS q FROM part),
       s AS (SELECT id, round(len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q)))::DOUBLE, 9) AS score FROM w)
       SELECT id, score FROM s WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 40""",
)
def fallback(spark, d):
    return textindex.keyword_topk(table(spark, d, "part"), "cold widge", 40, id_col="p_partkey", text_col="p_name")


@query(
    "ret02_index_fallback",
    f"""WITH w AS (SELECT p_partkey AS id, {_GRAMS.format("p_name")} AS t, {_GRAMS.format("'cold widge'")} AS q FROM part),
       s AS (SELECT id, round(len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q)))::DOUBLE, 9) AS score FROM w)
       SELECT id, score FROM s WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 40""",
)
def index_fallback(spark, d):
    return _index(spark, table(spark, d, "part"), id_col="p_partkey", text_col="p_name").keyword("cold widge", 40)


_LABELS = "p_name || ' ' || p_brand || ' ' || p_type"


@query(
    "fil08_index_trigram",
    f"""WITH w AS (SELECT p_partkey AS id, {_GRAMS.format(_LABELS)} AS t FROM part), q AS (SELECT t AS g FROM w WHERE id = 11)
       SELECT id, round(len(list_intersect(t, g)) / len(list_distinct(list_concat(t, g)))::DOUBLE, 9) AS score FROM w, q
       WHERE round(len(list_intersect(t, g)) / len(list_distinct(list_concat(t, g)))::DOUBLE, 9) >= 0.4 ORDER BY score DESC, id LIMIT 50""",
)
def index_trigram(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("content"))
    return _index(spark, rows).similar(rows.where("id = 11").first()["content"], 50, least=0.4)


@query(
    "ret04_legacy_hybrid",
    f"""WITH b AS (SELECT id, score, 0 AS side, rank FROM {VEC20} UNION ALL SELECT id, score, 1, rank FROM {KW20}),
        f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side) AS t FROM b) SELECT id, score, side, rank FROM f WHERE t = 1 ORDER BY side, rank LIMIT 30""",
)
def legacy_hybrid(spark, d):
    return retrieval.legacy_hybrid(*_sides(spark, d), 30)


@query("ret05_rrf", f"SELECT id, {R4.format(RRF)} AS score, vr AS vec_rank, kr AS kw_rank FROM {BOTH}")
def rrf(spark, d):
    return retrieval.rrf(*_sides(spark, d))


_RSF = """0.6 * CASE WHEN vs IS NULL THEN 0.1 ELSE greatest(0, least(1, vs / greatest(coalesce(max(vs) OVER (), 0), 1e-12))) END
 + 0.4 * CASE WHEN ks IS NULL THEN 0.1 ELSE greatest(0, least(1, ks / greatest(coalesce(max(ks) OVER (), 0), 1e-12))) END"""


@query("ret06_rsf", f"SELECT id, {R4.format(_RSF)} AS score, vr AS vec_rank, kr AS kw_rank FROM {BOTH}")
def rsf(spark, d):
    return retrieval.rsf(*_sides(spark, d))


@query("ret07_hybrid", f"SELECT id, {R4.format(RRF)} AS score, vr AS vec_rank, kr AS kw_rank FROM {BOTH} ORDER BY score DESC, id LIMIT 10")
def hybrid(spark, d):
    return retrieval.hybrid_search(memories(spark, d), stored_vectors(spark, d), QUERY, query_vector(spark, d), "hybrid", 10)


@query("ret07_mode_rsf", f"SELECT id, {R4.format(_RSF)} AS score, vr AS vec_rank, kr AS kw_rank FROM {BOTH} ORDER BY score DESC, id LIMIT 10")
def mode_rsf(spark, d):
    return retrieval.hybrid_search(memories(spark, d), stored_vectors(spark, d), QUERY, query_vector(spark, d), "rsf", 10)


@query("ret07_mode_keyword", f"SELECT id, score FROM {KW} ORDER BY score DESC, id LIMIT 10")
def mode_keyword(spark, d):
    return retrieval.hybrid_search(memories(spark, d), stored_vectors(spark, d), QUERY, query_vector(spark, d), "keyword", 10)


@query(
    "ret08_decay_engine",
    f"""SELECT b.id, round({R4.format(RRF)} * CASE WHEN m.id IS NULL THEN 1 ELSE {DECAY} END, 9) AS score FROM {BOTH} b LEFT JOIN {MEMORIES} m ON m.id = b.id ORDER BY {R4.format(RRF)} * CASE WHEN m.id IS NULL THEN 1 ELSE {DECAY} END DESC, b.id LIMIT 10""",
)
def decay_engine(spark, d):
    found = retrieval.hybrid_search(memories(spark, d), stored_vectors(spark, d), QUERY, query_vector(spark, d), "hybrid", 10, decay_as_of=as_of())
    return found.select("id", F.round("score", 9).alias("score"))


@query(
    "ret09_decay_db",
    f"SELECT b.id, {R4.format(f'({RRF}) * CASE WHEN m.id IS NULL THEN 1 ELSE {DECAY} END')} AS score, vr AS vec_rank, kr AS kw_rank FROM {BOTH} b LEFT JOIN {MEMORIES} m ON m.id = b.id ORDER BY score DESC, b.id LIMIT 10",
)
def decay_db(spark, d):
    return retrieval.hybrid_search_rrf(*_sides(spark, d), memories(spark, d), as_of(), 10).select("id", "score", "vec_rank", "kw_rank")


@query(
    "ret10_federated",
    f"""SELECT id, score, source_table FROM (SELECT id::VARCHAR AS id, {R4.format(RRF)} AS score, 'memories' AS source_table FROM {BOTH}
        UNION ALL (SELECT id::VARCHAR, score, 'documents' FROM {KW20})) ORDER BY score DESC, source_table, id LIMIT 15""",
)
def federated(spark, d):
    vec, kw = _sides(spark, d)
    return retrieval.federated({"memories": retrieval.rrf(vec, kw), "documents": kw}, 15)


@query(
    "ret11_context",
    f"""SELECT 'similar' AS section, rank, id::VARCHAR AS id, score FROM {VEC20} WHERE rank <= 3 UNION ALL SELECT 'keyword', rank, id::VARCHAR, score FROM {KW20} WHERE rank <= 5""",
)
def context(spark, d):
    vec, kw = _sides(spark, d)
    return retrieval.context_package({"similar": vec, "keyword": kw}, {"similar": 3, "keyword": 5})


@query("ret12_keyword_context", f"SELECT 'keyword' AS section, rank, id::VARCHAR AS id, score FROM {KW20}")
def keyword_context(spark, d):
    return retrieval.context_package({"keyword": textindex.fts_topk(memories(spark, d), QUERY, 20)})


@query(
    "ret13_context_text",
    f"SELECT k.id, k.rank, k.rank || '. ' || (CASE WHEN length(d.text) > 120 THEN substr(d.text, 1, 120) || '...' ELSE d.text END) AS line FROM {KW20} k JOIN documents d ON d.doc_id = k.id WHERE k.rank <= 5",
)
def context_text(spark, d):
    found = retrieval.ranked(textindex.fts_topk(memories(spark, d), QUERY, 5))
    rows = memories(spark, d).join(F.broadcast(found), "id")  # at most five rows
    return rows.select("id", "rank", F.concat_ws(". ", F.col("rank").cast("string"), texts.preview(F.col("content"), 120)).alias("line"))


@query("ret14_relevant", f"SELECT k.id, k.score, k.rank, d.lang, d.source FROM {KW20} k JOIN documents d ON d.doc_id = k.id")
def relevant(spark, d):
    found = retrieval.ranked(textindex.fts_topk(memories(spark, d), QUERY, 20))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return rows.join(F.broadcast(found), "id").select("id", "score", "rank", "lang", "source")  # at most 20 rows, ranks kept


_PAIRS = """(SELECT a.vec_id AS a, b.vec_id AS b, floor((list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
  / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))))) * 1e9 + 0.5) / 1e9 AS score
  FROM embeddings a, embeddings b WHERE {})"""


@query("ret18_similar_pairs", f"SELECT a, b, round(score, 6) AS score FROM {_PAIRS.format('a.vec_id < b.vec_id AND a.label % 2 = 0 AND b.label % 2 = 0')} WHERE score > 0.3")
def similar_pairs(spark, d):
    rows = stored_vectors(spark, d).withColumns({"result": F.when(F.col("label") % 2 == 0, "success").otherwise("failure"), "is_procedurized": F.lit(False)})
    return mining.similar_experiences(rows, 0.3).select("a", "b", F.round("score", 6).alias("score"))


_NEAR = f"(SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS p FROM {_PAIRS.format('true')} WHERE score > 0.2) WHERE p <= 10 AND a <> b)"


@query("join10_neighbours", f"SELECT a, b, round(score, 6) AS score FROM {_NEAR}")
def neighbours(spark, d):
    return mining.nearest(stored_vectors(spark, d), 10, 0.2).select("a", "b", F.round("score", 6).alias("score"))


def _signals(a: str, b: str) -> str:
    quote = lambda s: s.replace("'", "''")
    has = lambda t, w: f"contains(lower({t}), '{quote(w)}')"
    return " + ".join(f"(({has(a, x)} AND {has(b, y)}) OR ({has(a, y)} AND {has(b, x)}))::INT" for x, y in texts.ANTONYMS)


@query(
    "ret17_contradictions",
    f"""SELECT a, b, signals FROM (SELECT p.a, p.b, ({_signals("x.text", "y.text")})::INT AS signals FROM (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM {_NEAR}) p
        JOIN documents x ON x.doc_id = p.a JOIN documents y ON y.doc_id = p.b) WHERE signals >= 1""",
)
def contradiction_scan(spark, d):
    return mining.contradictions(memories(spark, d), stored_vectors(spark, d), threshold=0.2).select("a", "b", "signals")


@query(
    "ret19_compaction",
    """WITH s AS (SELECT doc_id AS id, lang AS g, list_distinct(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) AS w FROM documents)
       SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w)))::DOUBLE, 9) AS similarity FROM s x JOIN s y ON x.g = y.g AND x.id < y.id
       WHERE least(len(x.w), len(y.w)) >= 0.9 * greatest(len(x.w), len(y.w)) AND len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w)))::DOUBLE > 0.9""",
)
def compaction(spark, d):
    return mining.compaction_pairs(memories(spark, d), 0.9, group_col="lang").select("a", "b", F.round("similarity", 9).alias("similarity"))


@query("ret20_procedures", "SELECT p_partkey AS id, p_name AS name, p_size AS times_used FROM part WHERE p_name ILIKE '%red%' OR p_type ILIKE '%red%' ORDER BY p_size DESC, p_partkey LIMIT 5")
def procedures(spark, d):
    part = table(spark, d, "part").where(F.col("p_name").ilike("%red%") | F.col("p_type").ilike("%red%"))
    return part.orderBy(F.desc("p_size"), "p_partkey").limit(5).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("times_used"))


@query(
    "ret21_session_context",
    """SELECT * FROM (SELECT 'event' AS kind, event_id AS item, floor(epoch(ts))::BIGINT AS moment FROM events WHERE user_id = 3 UNION ALL
       SELECT 'order', o_orderkey, floor(epoch(o_orderdate))::BIGINT FROM orders WHERE o_custkey = 3) ORDER BY moment DESC, kind, item LIMIT 50""",
)
def session_context(spark, d):
    events = table(spark, d, "events").where("user_id = 3").select(F.lit("event").alias("kind"), F.col("event_id").alias("item"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("moment"))
    orders = table(spark, d, "orders").where("o_custkey = 3").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("item"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("moment"))
    return events.unionByName(orders).orderBy(F.desc("moment"), "kind", "item").limit(50)


# Scores


@query("scl05_decay", f"SELECT id, round({DECAY}, 9) AS decay FROM {MEMORIES}")
def decay(spark, d):
    m = memories(spark, d)
    return m.select("id", F.round(scores.recency_decay(scores.age_days(F.coalesce("last_accessed_at", "created_at"), as_of())), 9).alias("decay"))


@query("scl07_coherence", f"SELECT id, round(0.3 * {DECAY} + 0.2 * least(access_count / 5.0, 1.0) + 0.5 * importance, 6) AS score FROM {MEMORIES}")
def coherence(spark, d):
    days = scores.age_days(F.coalesce("last_accessed_at", "created_at"), as_of())
    return memories(spark, d).select("id", F.round(scores.coherence(days, F.col("access_count"), F.col("importance")), 6).alias("score"))


@query("snk25_confidence", "SELECT doc_id, round(greatest(0, least(1, coalesce(quality * 0.9, 0.5) + CASE WHEN toxic = 0 THEN 0.05 ELSE -0.15 END)), 6)::DOUBLE AS confidence FROM labels")
def confidence(spark, d):
    after = scores.confidence_after(F.col("quality") * 0.9, F.col("toxic") == 0)
    return table(spark, d, "labels").select("doc_id", F.round(after, 6).alias("confidence"))


@query(
    "snk26_confidence_decay",
    f"""SELECT id, round(CASE WHEN importance > 0 AND age > 1 THEN greatest(0, importance * greatest(0.1, pow(2.0, -age / 30.0))) ELSE importance END, 6) AS confidence
        FROM (SELECT id, importance, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 86400e6 AS age FROM {MEMORIES})""",
)
def confidence_decay(spark, d):
    age = scores.age_days(F.col("created_at"), as_of())
    return memories(spark, d).select("id", F.round(scores.confidence_decayed(F.col("importance"), age), 6).alias("confidence"))


@query("snk14_success_rate", "SELECT event_type, count(*) AS runs, round(avg((value > 50)::INT), 9) AS rate FROM events GROUP BY event_type")
def success_rate(spark, d):
    runs = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("runs"), F.count_if(F.col("value") > 50).alias("good"))
    return runs.select("event_type", "runs", F.round(scores.running_success(F.col("good"), F.col("runs")), 9).alias("rate"))


@query("scl01_norms", "SELECT vec_id AS id, len(embedding)::INT AS dimension, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def norms(spark, d):
    v = stored_vectors(spark, d)
    return v.select("id", F.size("embedding").alias("dimension"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query("agg17_mean_vector", "SELECT label::BIGINT AS label, i AS place, round(avg(x::DOUBLE), 6) AS value FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i")
def mean_vector(spark, d):
    means = vectors.mean_vector(stored_vectors(spark, d), "label")
    spread = means.select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("place", "value"))
    return spread.select("label", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@query("scl10_preview", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short, CASE WHEN length(text) > 240 THEN substr(text, 1, 239) || '...' ELSE text END AS excerpt FROM documents")
def previews(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", texts.preview(t, 100).alias("short"), texts.preview_within(t, 240).alias("excerpt"))


@query("scl13_digests", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def digests(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("scl28_token_estimate", "SELECT doc_id, round(len(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) / 0.75)::BIGINT AS tokens, strlen(text)::BIGINT AS n_bytes FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.token_estimate(F.col("text")).alias("tokens"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("scl27_pieces", "SELECT doc_id, i AS place, substr(text, (i * 4000 + 1)::BIGINT, 4000) AS piece FROM (SELECT doc_id, text, unnest(range(ceil(length(text) / 4000.0)::BIGINT)) AS i FROM documents)")
def fixed_pieces(spark, d):
    spread = table(spark, d, "documents").select("doc_id", F.posexplode(texts.pieces(F.col("text"))).alias("place", "piece"))
    return spread.select("doc_id", F.col("place").cast("long").alias("place"), "piece")


@query("scl35_routing", "SELECT event_type, CASE event_type WHEN 'purchase' THEN 'trading_results' WHEN 'signup' THEN 'experiences' ELSE 'memories' END AS target, count(*) AS n FROM events GROUP BY ALL")
def routing(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "trade_closed").when(F.col("event_type") == "signup", "task_complete").otherwise("insight")
    return table(spark, d, "events").groupBy("event_type", texts.event_target(kind).alias("target")).agg(F.count("*").alias("n"))


@query("scl22_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_values(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fil09_json_contains", "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '5'")
def json_contains(spark, d):
    return table(spark, d, "events").where(F.get_json_object("props", "$.k") == "5").select("event_id", "user_id")


# Filters, recall


@query("fil01_point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("fil02_recall", "SELECT 'orders' AS source_table, '7' AS id FROM orders WHERE o_orderkey = 7 LIMIT 1")
def recall(spark, d):
    named = lambda t, k: table(spark, d, t).select(F.col(k).alias("id"))
    return retrieval.recall([("none", named("region", "r_regionkey").where("id < 0")), ("orders", named("orders", "o_orderkey")), ("documents", named("documents", "doc_id"))], "7")


@query("fil03_recent_filtered", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_filtered(spark, d):
    return upkeep.recent(table(spark, d, "orders"), "o_orderdate", "o_orderkey", 20, F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus")


@query("fil10_critical", f"SELECT id FROM {MEMORIES} WHERE list_contains(tags, 'critical')")
def critical(spark, d):
    return memories(spark, d).where(F.array_contains("tags", "critical")).select("id")


@query("fil11_batch_keys", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 5, 8, 13, 21, 34, 55)")
def batch_keys(spark, d):
    return table(spark, d, "customer").where(F.col("c_custkey").isin(3, 5, 8, 13, 21, 34, 55)).select("c_custkey", "c_name")


_LABEL = "CASE WHEN path LIKE 'codex://%' THEN 'Codex' WHEN path LIKE 'config://opencode%' OR path LIKE 'log://opencode%' THEN 'OpenCode' WHEN path LIKE 'vault://%' OR path LIKE 'obsidian://%' THEN 'Vault' WHEN path LIKE '%playwright%' OR path LIKE '%browser%' THEN 'Generated browser output' ELSE 'Other' END"


@query("fil12_source_classifier", f"SELECT {_LABEL} AS label, count(*) AS n FROM {MEMORIES} WHERE storage_tier = 'active' GROUP BY ALL")
def source_classifier(spark, d):
    return memories(spark, d).where("storage_tier = 'active'").groupBy(texts.source_label(F.col("path")).alias("label")).agg(F.count("*").alias("n"))


@query("fil14_stale_runs", f"SELECT event_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '{AS_OF}' - INTERVAL 10 MINUTE")
def stale_runs(spark, d):
    runs = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "running").otherwise("success").alias("status"), F.col("ts").alias("started_at"))
    return cdc.interrupted_runs(runs, as_of()).select("event_id")


@query("fil16_long_prompts", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND strlen(text) > 50")
def long_prompts(spark, d):
    return table(spark, d, "conversations").where("role = 'user' and octet_length(text) > 50").select("conv_id", "turn")


@query("fil16_long_prompts_chars", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(text) > 50")
def long_prompts_chars(spark, d):
    return table(spark, d, "conversations").where("role = 'user' and length(text) > 50").select("conv_id", "turn")


# Joins and upkeep


@query("join04_sides", "SELECT e.vec_id, CASE WHEN d.doc_id IS NOT NULL THEN 'documents' WHEN p.page_id IS NOT NULL THEN 'pages' ELSE 'none' END AS side FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id AND e.label % 2 = 0 LEFT JOIN pages p ON p.page_id = e.vec_id AND e.label % 2 = 1")
def picked_sides(spark, d):
    e = stored_vectors(spark, d).select(F.col("id").alias("vec_id"), "label")
    docs = table(spark, d, "documents").select("doc_id")
    pages = table(spark, d, "pages").select("page_id")
    both = e.join(docs, (F.col("doc_id") == F.col("vec_id")) & (F.col("label") % 2 == 0), "left").join(pages, (F.col("page_id") == F.col("vec_id")) & (F.col("label") % 2 == 1), "left")
    return both.select("vec_id", F.when(F.col("doc_id").isNotNull(), "documents").when(F.col("page_id").isNotNull(), "pages").otherwise("none").alias("side"))


@query("join07_baseline", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'purchase' AND user_id = c_custkey)")
def baseline_rows(spark, d):
    log = table(spark, d, "events").select(F.lit("customer").alias("table_name"), F.when(F.col("event_type") == "purchase", "upsert").otherwise("delete").alias("operation"), F.col("user_id").cast("string").alias("record_key"))
    return cdc.baseline(table(spark, d, "customer").select("c_custkey"), log, "c_custkey", "customer")


@query("join08_semi", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def semi(spark, d):
    keys = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("c_custkey"))
    return table(spark, d, "customer").join(keys, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("join13_missing", "SELECT doc_id AS id, 'missing' AS status FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'extra' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def missing(spark, d):
    return upkeep.parity(table(spark, d, "documents").select(F.col("doc_id").alias("id")), stored_vectors(spark, d), "id")


@query("join14_checksums", "SELECT doc_id AS id, 'mismatch' AS reason FROM documents WHERE doc_id % 11 = 0 AND doc_id % 13 <> 0 UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id % 13 = 0")
def checksums(spark, d):
    local = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    remote = local.where("id % 13 <> 0").withColumn("text", F.when(F.col("id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return upkeep.hash_audit(local, remote, "id", ["id", "text", "lang"])


@query(
    "join16_count_delta",
    """SELECT coalesce(l.lang, r.lang) AS label, coalesce(l.n, 0) AS local, coalesce(r.n, 0) AS remote, coalesce(l.n, 0) - coalesce(r.n, 0) AS delta FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) l
       FULL JOIN (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY lang) r ON l.lang = r.lang""",
)
def delta(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"))
    count = lambda x: x.groupBy("label").agg(F.count("*").alias("n"))
    return upkeep.count_delta(count(docs), count(docs.where("doc_id % 3 = 0")))


@query("join17_latest", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest(spark, d):
    return upkeep.latest_per_key(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query(
    "join18_renames",
    """WITH s AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'moved/' ELSE 'docs/' END || doc_id AS path, md5(doc_id || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END) AS checksum FROM documents),
            k AS (SELECT 'docs/' || doc_id AS path, md5(doc_id::VARCHAR) AS checksum FROM documents WHERE doc_id % 9 <> 0)
       SELECT s.path, CASE WHEN p.checksum = s.checksum THEN 'unchanged' WHEN p.checksum IS NOT NULL THEN 'updated' WHEN c.path IS NOT NULL THEN 'renamed' ELSE 'new' END AS status,
       CASE WHEN p.path IS NULL THEN c.path END AS old_path FROM s LEFT JOIN k p ON p.path = s.path LEFT JOIN k c ON c.checksum = s.checksum""",
)
def renames(spark, d):
    ids = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("s"))
    changed = F.md5(F.concat("s", F.when(F.col("doc_id") % 5 == 0, "x").otherwise("")))
    scanned = ids.select(F.concat(F.when(F.col("doc_id") % 7 == 0, "moved/").otherwise("docs/"), "s").alias("path"), changed.alias("checksum"))
    known = ids.where("doc_id % 9 <> 0").select(F.concat(F.lit("docs/"), "s").alias("path"), F.md5("s").alias("checksum"))
    return upkeep.classify_files(scanned, known).select("path", "status", "old_path")


# Aggregates


@query("agg01_counts", " UNION ALL ".join(f"SELECT '{t}' AS label, count(*) AS n FROM {t}" for t in ("documents", "embeddings", "events", "conversations", "labels", "pages", "orders", "lineitem")))
def counts(spark, d):
    return catalog.table_counts({t: table(spark, d, t) for t in ("documents", "embeddings", "events", "conversations", "labels", "pages", "orders", "lineitem")})


@query("agg02_dimensions", "SELECT len(embedding)::INT AS dimension, count(*) AS n FROM embeddings GROUP BY ALL")
def dimension_counts(spark, d):
    return catalog.dimensions(stored_vectors(spark, d))


@query("agg04_critical_counts", f"SELECT (SELECT count(DISTINCT session_id) FROM {MEMORIES}) AS sessions, count(*) AS active, sum(list_contains(tags, 'critical')::INT)::BIGINT AS critical FROM {MEMORIES} WHERE storage_tier = 'active'")
def critical_counts(spark, d):
    m = memories(spark, d)
    active = m.where("storage_tier = 'active'").agg(F.count("*").alias("active"), F.count_if(F.array_contains("tags", "critical")).alias("critical"))
    return m.agg(F.count_distinct("session_id").alias("sessions")).crossJoin(active)  # one row each


@query("agg06_event_totals", "SELECT count(*) AS total, sum((event_type <> 'error')::INT)::BIGINT AS published, sum((event_type = 'error')::INT)::BIGINT AS unpublished, sum(CASE WHEN event_type = 'error' THEN strlen(props) END)::BIGINT AS pending_bytes FROM events")
def event_totals(spark, d):
    return catalog.event_totals(table(spark, d, "events"), F.col("event_type") != "error", F.octet_length("props"))


@query(
    "agg08_storage_catalog",
    f"""SELECT 'memories' AS category, storage_tier, count(*) AS n, sum(strlen(content))::BIGINT AS bytes FROM {MEMORIES} GROUP BY ALL UNION ALL
        SELECT 'sessions', CASE WHEN conv_id % 2 = 0 THEN 'active' ELSE 'archived' END, count(*), sum(strlen(text))::BIGINT FROM conversations GROUP BY ALL""",
)
def storage(spark, d):
    talks = table(spark, d, "conversations").withColumn("storage_tier", F.when(F.col("conv_id") % 2 == 0, "active").otherwise("archived"))
    return catalog.storage_catalog({"memories": (memories(spark, d), F.octet_length("content")), "sessions": (talks, F.octet_length("text"))})


@query("agg09_source_catalog", f"SELECT {_LABEL} AS label, storage_tier, count(*) AS n, sum(strlen(content))::BIGINT AS bytes FROM {MEMORIES} GROUP BY ALL")
def source_catalog(spark, d):
    m = memories(spark, d)
    return m.groupBy(texts.source_label(F.col("path")).alias("label"), "storage_tier").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))


@query(
    "agg12_coverage",
    """WITH t AS (SELECT 'documents' AS label, d.doc_id, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id UNION ALL SELECT 'pages', p.page_id, e.embedding FROM pages p LEFT JOIN embeddings e ON e.vec_id = p.page_id AND e.label <> 0),
            c AS (SELECT label, count(*) AS total, sum((embedding IS NULL)::INT)::BIGINT AS missing, sum((embedding IS NOT NULL AND len(embedding) <> 64)::INT)::BIGINT AS wrong_dimension FROM t GROUP BY label),
            u AS (SELECT * FROM c UNION ALL SELECT 'all', sum(total)::BIGINT, sum(missing)::BIGINT, sum(wrong_dimension)::BIGINT FROM c)
       SELECT *, CASE WHEN missing = 0 AND wrong_dimension = 0 THEN 'complete' ELSE 'repair' END AS status FROM u""",
)
def coverage(spark, d):
    v = stored_vectors(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id")).join(v, "id", "left")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id")).join(v.where("label <> 0"), "id", "left")
    return catalog.embedding_coverage({"documents": docs, "pages": pages}, 64)


@query("agg13_repeated_texts", "SELECT md5(text) AS checksum, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def repeated_texts(spark, d):
    return catalog.repeated_keys(table(spark, d, "documents").select(F.md5("text").alias("checksum")), ["checksum"])


@query("agg14_distinct_keys", "SELECT DISTINCT substring(source, 4) AS part FROM documents")
def distinct_keys(spark, d):
    return table(spark, d, "documents").select(F.substring("source", 4, 100).alias("part")).distinct()


@query("agg15_reports", "SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def reports(spark, d):
    parts = table(spark, d, "events").groupBy("event_type", (F.col("event_id") % 10).alias("part")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))
    return catalog.merged_reports(parts, "event_type", ["n", "k"])


@query("agg18_export", "SELECT lang, count(*) AS total, count(e.vec_id) AS embedded, coalesce(max(e.vec_id)::VARCHAR, 'never') AS last FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY lang")
def export(spark, d):
    v = stored_vectors(spark, d).select(F.col("id").alias("vec_id"))
    both = table(spark, d, "documents").join(v, F.col("vec_id") == F.col("doc_id"), "left")
    return both.groupBy("lang").agg(F.count("*").alias("total"), F.count("vec_id").alias("embedded"), F.coalesce(F.max("vec_id").cast("string"), F.lit("never")).alias("last"))


@query(
    "agg22_session_rollup",
    "SELECT conv_id, count(*) AS parts, sum((role = 'user' AND strlen(text) > 50)::INT)::BIGINT AS long_prompts, max(turn) - min(turn) AS seconds FROM conversations GROUP BY conv_id",
)
def session_rollup(spark, d):
    from ..sources.sessions import rollup

    parts = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "role", "text", F.timestamp_seconds("turn").alias("at"))
    return rollup(parts).select(F.col("session_id").alias("conv_id"), "parts", "long_prompts", "seconds")


@query("win07_first_excerpt", "SELECT conv_id, arg_min(CASE WHEN length(text) > 240 THEN substr(text, 1, 240) || '...' ELSE text END, turn) AS excerpt FROM conversations WHERE role = 'user' GROUP BY conv_id")
def first_excerpt(spark, d):
    talks = table(spark, d, "conversations").where("role = 'user'")
    return talks.groupBy("conv_id").agg(texts.preview(F.min_by("text", "turn"), 240).alias("excerpt"))


@query("win05_logical_clock", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS logical_time FROM events")
def clock(spark, d):
    return upkeep.logical_clock(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "user_id", F.col("logical_time").cast("long").alias("logical_time"))


@query("win08_preceding", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS head FROM conversations")
def preceding(spark, d):
    talks = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return upkeep.attach_to_preceding(talks, "turn", F.col("role") == "user", "turn", "conv_id").select("conv_id", "turn", "head")


# Paging, batches


@query("top05_recent", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 8")
def recent(spark, d):
    return upkeep.recent(table(spark, d, "events"), "ts", "event_id", 8).select("event_id")


@query("top07_offset_page", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def offset_page(spark, d):
    return upkeep.offset_page(table(spark, d, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 20, 40).select("o_orderkey")


@query("top08_keyset_page", "SELECT event_id FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10 00:00:00', 0) ORDER BY ts, event_id LIMIT 25")
def keyset_page(spark, d):
    import datetime

    return upkeep.keyset_page(table(spark, d, "events"), "ts", "event_id", (datetime.datetime(2024, 1, 10), 0), 25).select("event_id")


@query("top09_text_page", "SELECT c_name FROM customer WHERE c_name > 'Customer#000000050' ORDER BY c_name LIMIT 50")
def text_page(spark, d):
    return upkeep.text_keyset_page(table(spark, d, "customer").select("c_name"), "c_name", "Customer#000000050", 50)


@query(
    "top12_batches",
    """WITH RECURSIVE d AS (SELECT doc_id, lang, octet_length(encode(text))::BIGINT AS bytes, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents),
       b AS (SELECT doc_id, lang, bytes, r, 0 AS batch, 1 AS n, coalesce(bytes, 0) AS size FROM d WHERE r = 1
       UNION ALL SELECT d.doc_id, d.lang, d.bytes, d.r, batch + (n >= 25 OR size + coalesce(d.bytes, 0) > 40000)::INT,
         CASE WHEN n >= 25 OR size + coalesce(d.bytes, 0) > 40000 THEN 1 ELSE n + 1 END, CASE WHEN n >= 25 OR size + coalesce(d.bytes, 0) > 40000 THEN coalesce(d.bytes, 0) ELSE size + coalesce(d.bytes, 0) END
         FROM b JOIN d ON d.lang IS NOT DISTINCT FROM b.lang AND d.r = b.r + 1)
       SELECT doc_id, lang, bytes, batch FROM b""",
)
def batches(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", F.octet_length("text").cast("long").alias("bytes"))
    return upkeep.pack_batches(rows, "doc_id", "bytes", "lang", 25, 40_000)


@query("set06_pairs", f"SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM {_PAIRS.format('a.vec_id <> b.vec_id')} WHERE score > 0.35")
def unordered_pairs(spark, d):
    from ..operators.blocks import similar_pairs as all_pairs

    return all_pairs(stored_vectors(spark, d), 0.35).where("a <> b").select("a", "b").dropDuplicates()


# Change capture


@query("str03_outbox", "SELECT user_id, count(*) AS generation, CASE arg_max(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) WHEN 'error' THEN 'delete' ELSE 'upsert' END AS operation FROM events GROUP BY user_id")
def outbox(spark, d):
    changes = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "archive").otherwise("upsert").alias("op"))
    return catalog.outbox(changes, ["user_id"], "op", "ts", "event_id").select("user_id", "generation", "operation")


@query(
    "str02_changes",
    """SELECT doc_id::VARCHAR AS record_key, CASE WHEN doc_id % 10 = 0 THEN 'delete' WHEN doc_id % 10 = 1 THEN 'archive' ELSE 'upsert' END AS operation FROM documents WHERE doc_id % 10 IN (0, 1, 2, 3)""",
)
def snapshot_changes(spark, d):
    old = table(spark, d, "documents").select("doc_id", "lang", "text", F.lit("active").alias("storage_tier")).where("doc_id % 10 <> 3")
    new = table(spark, d, "documents").where("doc_id % 10 <> 0").select(
        "doc_id", "lang", F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 10 == 1, "archived").otherwise("active").alias("storage_tier"),
    )
    return cdc.changes(old, new, "doc_id").select("record_key", "operation")


@query("str04_acknowledged", "SELECT user_id, count(*) AS generation FROM events GROUP BY user_id HAVING count(*) <> count(*) FILTER (WHERE event_id % 50 <> 0)")
def acknowledged(spark, d):
    per = lambda x: x.groupBy("user_id").agg(F.count("*").alias("generation"))
    events = table(spark, d, "events").select("event_id", "user_id")
    return catalog.acknowledged(per(events), per(events.where("event_id % 50 <> 0")), ["user_id"])


_LOG = "(SELECT event_id, ts AS created_at, user_id::VARCHAR AS record_key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS operation, props AS payload FROM events)"


def _log(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.col("ts").alias("created_at"), F.lit("users").alias("table_name"), F.col("user_id").cast("string").alias("record_key"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"), F.col("props").alias("payload"),
    )


@query("str05_publish", f"SELECT event_id FROM (SELECT event_id FROM {_LOG} ORDER BY created_at, event_id LIMIT 25) WHERE event_id % 7 <> 0")
def publish(spark, d):
    log = _log(spark, d).withColumn("pushed_at", F.lit(None).cast("timestamp"))
    return cdc.publish(log, log.where("event_id % 7 = 0"))[0].select("event_id")


@query("str06_pull", f"SELECT event_id FROM (SELECT * FROM {_LOG} ORDER BY created_at, event_id LIMIT 25) WHERE event_id % 7 <> 0 AND operation = 'upsert'")
def pull(spark, d):
    log = _log(spark, d)
    return cdc.pull(log, log.where("event_id % 7 = 0"), None)[1].select("event_id")


@query("str06_applied", f"SELECT record_key, payload FROM (SELECT record_key, payload, row_number() OVER (PARTITION BY record_key ORDER BY created_at DESC, event_id DESC) AS r FROM {_LOG} WHERE operation = 'upsert') WHERE r = 1")
def applied(spark, d):
    log = _log(spark, d)
    once = cdc.applied(log.select("table_name", "record_key", "payload").limit(0), log)
    return cdc.applied(once, log).select("record_key", "payload")


@query("snk01_upsert", "SELECT c.c_custkey, c.c_name, CASE WHEN c.c_custkey % 4 = 0 THEN c.c_acctbal + 1 ELSE c.c_acctbal END AS c_acctbal FROM customer c")
def upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 4 = 0").select("c_custkey", F.lit("renamed").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return store.merged(c.where("c_custkey % 8 <> 9"), new, ["c_custkey"], update={"c_name": "old"})


@query("snk16_forget", f"SELECT id, CASE WHEN id % 6 = 0 THEN 0 ELSE importance END AS importance, array_to_string(CASE WHEN id % 6 = 0 THEN list_append(tags, 'forgotten') ELSE tags END, ',') AS tags FROM {MEMORIES}")
def forget(spark, d):
    gone = store.forgotten(memories(spark, d), F.col("id") % 6 == 0)
    return gone.select("id", "importance", F.array_join("tags", ",").alias("tags"))


@query("snk06_access_bump", f"SELECT m.id, m.access_count + coalesce(a.n, 0) AS access_count FROM {MEMORIES} m LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) a ON a.user_id = m.id")
def access_bump(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("accessed_at"))
    return store.with_accesses(memories(spark, d), log).select("id", "access_count")


@query("snk35_archive", "SELECT 'kept' AS side, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'archived', count(*) FROM orders WHERE o_orderstatus = 'F'")
def archive(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    kept, gone = store.archived(orders, orders.where("o_orderstatus = 'F'"), ["o_orderkey"])
    return catalog.table_counts({"kept": kept, "archived": gone}).withColumnRenamed("label", "side")


# Sources


@query("src03_titles", """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, strlen(html)::BIGINT AS size FROM pages""")
def titles(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.octet_length("html").cast("long").alias("size"))


@query("src12_intake", "SELECT event_id, trim(event_type || chr(10) || chr(10) || props) AS content, 0.7::DOUBLE AS importance, event_type AS tag FROM events")
def intake(spark, d):
    from ..streaming.intake import memories_from_events

    posted = table(spark, d, "events").select("event_id", F.col("event_type").alias("summary"), F.col("props").alias("details"), "event_type", "ts")
    return memories_from_events(posted).select("event_id", "content", "importance", F.get("tags", 0).alias("tag"))


@query("src20_setting", "SELECT coalesce((SELECT max(r_name) FROM region WHERE r_regionkey = 99), 'none') AS value")
def setting(spark, d):
    from ..sources.configs import setting as lookup

    return lookup(table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("value")), "99", "none")


@query("tbl01_chunks")
def markdown_chunks(spark, d):
    from ..sources.files import vault_chunks

    body = F.concat(F.lit("## "), "source", F.lit("\n"), F.regexp_replace("text", "\n", "\n### part\n"))
    return vault_chunks(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), body.alias("body")))


@query("ext_daily_windows", "SELECT epoch(date_trunc('day', ts))::BIGINT AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_windows(spark, d):
    from ..streaming.intake import windowed_counts

    return windowed_counts(table(spark, d, "events").select("ts", "event_type")).select(F.unix_seconds("window_start").alias("day"), "event_type", "n")


def queries() -> dict:
    """Name -> function of a session and a data directory."""
    from . import file_queries, more_queries  # noqa: F401  register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    return {name: _SQL[name] for name in queries() if name in _SQL}
