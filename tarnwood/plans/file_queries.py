"""Registered queries over real files and over a store: readers on folders written from the tables, and the engine's writes."""

from __future__ import annotations

import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import embedding, texts
from ..functions.embedding import hashed_vector
from ..operators import textindex
from ..sources import configs, files
from ..streaming import intake, outbox
from . import store
from .fixtures import AS_OF, as_of, scratch, table
from .queries import _LOG, _log, query

NOW = datetime.datetime(2024, 1, 1)
#: Nations with the folder of their region, as the twins see them.
_PLACES = "(SELECT n_nationkey AS k, n_name AS name, replace(r_name, ' ', '_') AS region FROM nation JOIN region ON r_regionkey = n_regionkey)"


def _folder(spark: SparkSession, d: str, made) -> str:
    """A folder with a small file for each nation that ``made(key, name, region)`` gives a (path, text) for; 25 rows at every scale."""
    region = F.replace("r_name", F.lit(" "), F.lit("_")).alias("region")
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", region)
    root, path = scratch(spark), spark._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(root))
    for k, name, where in sorted(map(tuple, rows.collect())):
        found = made(k, name, where)
        if found:
            out = system.create(path(f"{root}/{found[0]}"))
            out.write(bytearray(found[1].encode()))
            out.close()
            system.setTimes(path(f"{root}/{found[0]}"), 1_700_000_000_000 + 1000 * (k % 4), -1)
    return root


def _engine(spark: SparkSession, vectors: bool = False) -> Engine:
    return Engine(spark, scratch(spark), (lambda t: hashed_vector(t, 32).tolist()) if vectors else None)


def _regions(spark: SparkSession, d: str) -> list[tuple[int, str]]:
    """The five regions, in order of their key."""
    return sorted(map(tuple, table(spark, d, "region").select("r_regionkey", "r_name").collect()))


# Sources


@query("src01_store_read", "SELECT n_nationkey, n_name FROM nation")
def store_read(spark, d):
    held = store.Store(spark, scratch(spark))
    held.write("nation", table(spark, d, "nation"))
    return held.read("nation").select("n_nationkey", "n_name")


def _note(k, name, region):
    return f"{region}/{name}.md", f"---\nkey: {k}\nname: '{name}'\n---\n# {name} title\nbody of {name}\n"


@query("src02_vault", f"""SELECT 'vault://' || region || '/' || name || '.md' AS uri, region AS section, name || ' title' AS title, '{{"key": ' || k || ', "name": "' || name || '"}}' AS frontmatter, 8::BIGINT AS token_count FROM {_PLACES}""")
def vault(spark, d):
    return files.vault(spark, _folder(spark, d, _note)).select("uri", "section", "title", "frontmatter", "token_count")


@query(
    "src04_new_notes",
    f"""SELECT CASE WHEN k % 4 = 1 THEN '' ELSE region || '/' END || name || '.md' AS path, CASE WHEN k % 4 = 1 THEN NULL ELSE region END AS section,
        CASE WHEN k % 3 = 0 THEN name ELSE name || ' title' END AS title FROM {_PLACES} WHERE k % 2 = 1 AND k % 5 <> 3""",
)
def new_notes(spark, d):
    def made(k, name, region):
        return ("" if k % 4 == 1 else f"{region}/") + f"{name}.md", " \n" if k % 5 == 3 else f"text of {name}\n" + ("" if k % 3 == 0 else f"# {name} title\n")

    root = _folder(spark, d, made)
    region = F.replace("r_name", F.lit(" "), F.lit("_"))
    known = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).where("n_nationkey % 2 = 0")
    return files.new_notes(spark, root, known.select(F.concat(region, F.lit("/"), "n_name", F.lit(".md")).alias("path"))).select("path", "section", "title")


def _settings(k, name, region):
    """Every third nation a configuration, a rule (every other one a folder deeper) or a skill."""
    if k % 3 == 0:
        return f"{name}.jsonc", f'{{"agent": {{"{name}": {{}}}}}}'
    return (f"rules/{name}.md" if k % 2 else f"rules/{region}/{name}.md", "a rule") if k % 3 == 1 else (f"skills/{region}/{name}.md", "a skill")


@query("src09_configs", f"SELECT 'config://' || name || '.jsonc' AS uri, 'config' AS kind FROM {_PLACES} WHERE k % 3 = 0 UNION ALL SELECT 'rules://' || name || '.md', 'rules' FROM {_PLACES} WHERE k % 3 = 1 AND k % 2 = 1")
def config_files(spark, d):
    return configs.configs(spark, _folder(spark, d, _settings)).where("kind <> 'skill'").select("uri", "kind")


@query("src10_skills", f"SELECT 'skill://' || region || '/' || name || '.md' AS uri, region AS category FROM {_PLACES} WHERE k % 3 = 2")
def skills(spark, d):
    return configs.configs(spark, _folder(spark, d, _settings)).where("kind = 'skill'").select("uri", "category")


@query("src19_nested_rules", f"SELECT 'rules://' || CASE WHEN k % 2 = 1 THEN '' ELSE region || '/' END || name || '.md' AS uri, CASE WHEN k % 2 = 1 THEN 'rules' ELSE region END AS category FROM {_PLACES} WHERE k % 3 = 1")
def nested_rules(spark, d):
    return configs.configs(spark, _folder(spark, d, _settings), nested_rules=True).where("kind = 'rules'").select("uri", "category")


@query("src15_listing", f"SELECT region || '/' || name || '.md' AS path, strlen('---' || chr(10) || 'key: ' || k || chr(10) || 'name: ''' || name || '''' || chr(10) || '---' || chr(10) || '# ' || name || ' title' || chr(10) || 'body of ' || name || chr(10))::BIGINT AS size FROM {_PLACES}")
def listing(spark, d):
    return files.scan(spark, _folder(spark, d, _note), content=False).select("path", "size")


@query("top11_newest_files", f"SELECT region || '/' || name || '.md' AS path FROM {_PLACES} ORDER BY k % 4 DESC, path LIMIT 7")
def newest_files(spark, d):
    return files.scan(spark, _folder(spark, d, _note), max_files=7).select("path")


@query(
    "src17_cache_entries",
    f"""SELECT user_id::VARCHAR AS key, event_type AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
        WHERE r = 1 AND event_type <> 'error' AND epoch_us(ts) + (event_id % 40) * 86400000000 > epoch_us(TIMESTAMP '{AS_OF}')""",
)
def cache_entries(spark, d):
    puts = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("key"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"),
        F.col("ts").alias("put_at"), F.col("event_id").alias("turn"), ((F.col("event_id") % 40) * 86_400).alias("ttl"),
    )
    return store.cached(puts, as_of())


# Sinks


@query("snk02_session_start", "SELECT r_name AS goal, 'active' AS status FROM region")
def session_start(spark, d):
    e = _engine(spark)
    for _, name in _regions(spark, d):
        e.session_start(name, NOW)
    return e.table("sessions").select("goal", "status")


@query("snk03_session_end", "SELECT r_name AS goal, CASE WHEN r_regionkey % 2 = 0 THEN 'completed' ELSE 'active' END AS status, CASE WHEN r_regionkey % 2 = 0 THEN 'about ' || r_name END AS summary FROM region")
def session_end(spark, d):
    e = _engine(spark)
    for k, name in _regions(spark, d):
        key = e.session_start(name, NOW)
        if k % 2 == 0:
            e.session_end(key, f"about {name}", NOW)
    return e.table("sessions").select("goal", "status", "summary")


@query("snk04_session_vectors", "SELECT r_name AS goal, CASE WHEN r_regionkey % 2 = 0 THEN 3 END AS dimension FROM region")
def session_vectors(spark, d):
    e = _engine(spark)
    for k, name in _regions(spark, d):
        key = e.session_start(name, NOW)
        if k % 2 == 0:
            e.session_embedding(key, [1.0, float(k), 0.5])
    return e.table("sessions").select("goal", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimension"))


@query("snk05_memory_store", "SELECT r_name AS content, 32 AS dimension, true AS same FROM region")
def memory_store(spark, d):
    e = _engine(spark, vectors=True)
    for _, name in _regions(spark, d):
        e.memory_store(name, NOW)
    mirrored = e.table("embeddings").where("source_table = 'memories'").select(F.col("source_id").alias("id"), F.col("embedding").alias("mirror"))
    rows = e.table("memories").join(mirrored, "id")
    return rows.select("content", F.size("embedding").alias("dimension"), (F.col("embedding") == F.col("mirror")).alias("same"))


@query("snk08_trading_results", "SELECT r_name AS strategy, r_regionkey * 1.5::DOUBLE AS pnl FROM region")
def trading_results(spark, d):
    e = _engine(spark)
    for k, name in _regions(spark, d):
        e.trading_result_store(name, NOW, pnl=1.5 * k)
    return e.table("trading_results").select("strategy", "pnl")


@query("snk09_experiences", "SELECT r_name AS goal, CASE WHEN r_regionkey % 2 = 0 THEN 'success' ELSE 'failure' END AS result, false AS is_procedurized FROM region")
def experiences(spark, d):
    e = _engine(spark)
    for k, name in _regions(spark, d):
        e.experience_store(name, "failure" if k % 2 else "success", NOW)
    return e.table("experiences").select("goal", "result", "is_procedurized")


@query("snk10_procedures", "SELECT r_name AS name, 0 AS times_used FROM region")
def procedures_once(spark, d):
    e = _engine(spark)
    for _, name in _regions(spark, d) + _regions(spark, d):
        try:
            e.procedure_create(name, "", "[]", NOW)
        except ValueError:
            continue
    return e.table("procedures").select("name", "times_used")


@query("snk17_source_sessions", "SELECT o_orderkey AS source_key, 'again ' || o_orderstatus AS goal, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2030-01-01' ELSE o_orderdate::DATE END AS started_at FROM orders")
def source_sessions(spark, d):
    seen = table(spark, d, "orders").select(F.col("o_orderkey").alias("source_key"), F.col("o_orderstatus").alias("goal"), F.col("o_orderdate").cast("date").alias("started_at"))
    new = seen.select("source_key", F.concat(F.lit("again "), "goal").alias("goal"), F.lit("2030-01-01").cast("date").alias("started_at"))
    return store.merged(seen.where("source_key % 3 <> 0"), new, ["source_key"], update={"started_at": "old"})


@query("snk18_inserts", "SELECT 'memories' AS label, count(*) AS n FROM nation UNION ALL SELECT 'sessions', count(*) FROM region UNION ALL SELECT 'experiences', count(*) FROM nation WHERE n_nationkey % 2 = 0")
def inserts(spark, d):
    held, nation = store.Store(spark, scratch(spark)), table(spark, d, "nation")
    for part in (0, 1):
        held.append("memories", nation.where(F.col("n_nationkey") % 2 == part).select(F.col("n_name").alias("content")))
    held.append("sessions", table(spark, d, "region").select(F.col("r_name").alias("goal")))
    held.append("experiences", nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("goal")))
    counts = [held.read(n).agg(F.lit(n).alias("label"), F.count("*").alias("n")) for n in ("memories", "sessions", "experiences")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("snk29_reindex", "SELECT doc_id, 64 AS dimension, CASE WHEN doc_id % 3 = 0 THEN 32.0::DOUBLE END AS kept_sum FROM documents WHERE trim(text) <> ''")
def reindex(spark, d):
    rows = table(spark, d, "documents").where(F.trim("text") != "").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.array_repeat(F.lit(0.5).cast("float"), 64)).alias("embedding"))
    done = store.repaired_embeddings(rows.withColumn("had", F.col("embedding").isNotNull()), F.col("text"), embedding.embedder(64))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return done.select("doc_id", F.size("embedding").alias("dimension"), F.when(F.col("had"), total).alias("kept_sum"))


_TERMS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in sorted(textindex.STOP)) + "))"


@query("snk30_backfill", f"SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY term")
def backfill(spark, d):
    held = store.Store(spark, scratch(spark))
    held.write("postings", textindex.postings(table(spark, d, "documents"), id_col="doc_id", text_col="text"))
    return held.read("postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("udf01_index_upkeep", f"SELECT id, len(t)::INT AS length, len(list_distinct(t))::BIGINT AS terms FROM (SELECT doc_id AS id, {_TERMS.format('''CASE WHEN doc_id % 5 = 0 THEN 'new words ' || source ELSE text END''')} AS t FROM documents) WHERE len(t) > 0")
def index_upkeep(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")
    changed = docs.where("id % 5 = 0").withColumn("content", F.concat(F.lit("new words "), "source"))
    index = textindex.updated_postings(textindex.postings(docs), changed)
    return index.groupBy("id", "length").agg(F.count("*").alias("terms"))


@query("snk36_stream_applied", f"SELECT record_key, payload FROM (SELECT record_key, payload, row_number() OVER (PARTITION BY record_key ORDER BY created_at DESC, event_id DESC) AS r FROM {_LOG} WHERE operation = 'upsert') WHERE r = 1")
def stream_applied(spark, d):
    root = scratch(spark)
    _log(spark, d).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(_log(spark, d).schema).parquet(f"{root}/in")
    return intake.apply_stream(stream, store.Store(spark, f"{root}/state"), "rows", f"{root}/offsets").select("record_key", "payload")


@query(
    "str03_stream_outbox",
    """WITH c AS (SELECT user_id, count(*) AS generation, max(struct_pack(ts, event_id, event_type)) AS l FROM events WHERE event_type <> 'error' GROUP BY user_id)
       SELECT c.user_id, generation, l.event_type AS operation, l.event_id AS event_id, (SELECT count(*) FROM events e WHERE e.user_id = c.user_id AND event_type = 'error' AND (e.ts, e.event_id) > (l.ts, l.event_id))::INT AS attempts,
         true AS pending FROM c""",
)
def stream_outbox(spark, d):
    root, users = scratch(spark), F.col("user_id")
    kind = F.when(F.col("event_type") == "error", "failed").otherwise("change").alias("kind")
    rows = table(spark, d, "events").select("user_id", kind, F.col("event_type").alias("operation"), F.col("ts").cast("timestamp").alias("at"), "event_id", F.lit(None).cast("long").alias("generation"))
    cut = rows.agg(F.expr("percentile_approx(at, array(0.33, 0.67))").alias("q")).first()["q"]
    for low, high in ((None, cut[0]), (cut[0], cut[1]), (cut[1], None)):  # three deliveries, one after the other; a user's rows of each are one file
        part = rows if low is None else rows.where(F.col("at") > F.lit(low))
        (part if high is None else part.where(F.col("at") <= F.lit(high))).repartition(4, users).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    last = outbox.run_outbox(spark, stream, ["user_id"], f"{root}/out", f"{root}/offsets")
    return last.where("generation > 0").select("user_id", "generation", "operation", "event_id", "attempts", "pending")


@query("snk37_rehydrated", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def rehydrated(spark, d):
    root, rows = scratch(spark), table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    store.bundle(rows, "c_custkey")[0].write.text(f"{root}/dump")
    held = store.Store(spark, f"{root}/tables")
    held.write("customer", rows.limit(0))
    held.write("customer", spark.read.schema(rows.schema).json(f"{root}/dump"))
    return held.read("customer")


@query("snk38_script_writes", "SELECT n_name AS name, 'session' AS kind FROM nation UNION ALL SELECT n_name, 'session' FROM nation UNION ALL SELECT r_name, 'agent' FROM region")
def script_writes(spark, d):
    held = store.Store(spark, scratch(spark))
    names = table(spark, d, "region").select(F.col("r_name").alias("name"))
    for _ in range(2):  # sessions are inserted each time, agents only if they are not there
        held.append("sessions", table(spark, d, "nation").select(F.col("n_name").alias("name")))
        held.write("agents", store.ensured(held.read("agents"), names) if held.exists("agents") else names)
    return held.read("sessions").withColumn("kind", F.lit("session")).unionByName(held.read("agents").withColumn("kind", F.lit("agent")))


@query("scl32_surrogates", "SELECT r_name, r_name || '?!' || chr(128077) || '?' AS clean FROM region")
def surrogates(spark, d):
    raw = F.concat(F.lit('{"a": "'), "r_name", F.lit('\\ud800!\\ud83d\\udc4d\\udc4d"}'))
    return table(spark, d, "region").select("r_name", F.get_json_object(texts.without_surrogate_escapes(raw), "$.a").alias("clean"))
