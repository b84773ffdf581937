"""Queries on tasks, logs, lineage, files, presets and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pageloom.functions import predicates, text
from pageloom.operators import exports, tasks as ops
from pageloom.plans.registry import B, Q, query, questions
from pageloom.session import scratch_path, table
from pageloom.sources import keyed, readers
from pageloom.streaming import live, signals


def tasks(spark, sf):
    """Orders as tasks: a customer's orders in a row are retries, the first one is their root."""
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("failed")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("extracted_count"),
        F.lag("o_orderkey").over(w).alias("parent_task_id"), F.first("o_orderkey").over(w).alias("root_task_id"), (F.row_number().over(w) - 1).alias("retry_count"),
        F.concat(F.lit("task "), "o_orderkey", F.when(F.row_number().over(w) > 1, F.concat(F.lit(" (Retry "), F.row_number().over(w) - 1, F.lit(")"))).otherwise("")).alias("name"),
        F.pmod("o_orderkey", F.lit(7)).cast("int").alias("total_pages"),
    )


TK = """TK AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status, o_orderdate AS created_at, CAST(floor(o_totalprice / 1000) AS INTEGER) AS extracted_count,
 lag(o_orderkey) OVER w AS parent_task_id, first_value(o_orderkey) OVER w AS root_task_id, CAST(row_number() OVER w - 1 AS INTEGER) AS retry_count,
 'task ' || o_orderkey || CASE WHEN row_number() OVER w > 1 THEN ' (Retry ' || (row_number() OVER w - 1) || ')' ELSE '' END AS name, CAST(o_orderkey % 7 AS INTEGER) AS total_pages
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def logs(spark, sf):
    """Events as log lines of their user's task."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    message = (
        F.when(kind == "click", F.concat(F.lit("Processing chunk "), k)).when(kind == "purchase", F.concat(F.lit("Chunk "), k, F.lit(" completed")))
        .when(kind == "view", F.concat(F.lit("LLM response for Chunk "), k, F.lit(" completed"))).when(kind == "error", F.concat(F.lit("Chunk "), k, F.lit(" failed"))).otherwise("Fallback")
    )
    return e.select(F.col("user_id").alias("task_id"), "event_id", F.when(kind == "error", "error").otherwise("info").alias("level"), F.lit("processing").alias("stage"), message.alias("message"), F.when(kind == "signup", k).alias("total_chunks"), F.col("ts").alias("created_at"))


LG = """LG AS (SELECT user_id AS task_id, event_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts FROM events)"""


@query("task_stats", f"WITH {TK} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(extracted_count) AS BIGINT) AS extracted FROM TK")
def task_stats(spark, sf):
    return ops.task_stats(tasks(spark, sf))


@query("log_chunk_stats", f"""WITH {LG} SELECT task_id, CAST(CASE WHEN coalesce(max(k) FILTER (WHERE kind = 'signup'), 0) > 0 THEN max(k) FILTER (WHERE kind = 'signup') ELSE count(*) FILTER (WHERE kind = 'click') END AS BIGINT) AS total,
 count(*) FILTER (WHERE kind = 'purchase') AS completed, count(*) FILTER (WHERE kind = 'error') AS failed, count(*) FILTER (WHERE kind = 'view') AS model_calls, count(*) FILTER (WHERE kind = 'signup') AS fallback_used FROM LG GROUP BY task_id""")
def log_chunk_stats(spark, sf):
    return ops.chunk_stats(logs(spark, sf))


@query("latest_logs", f"WITH {LG} SELECT event_id, task_id FROM LG ORDER BY ts DESC, event_id DESC LIMIT 100")
def latest_logs(spark, sf):
    return ops.latest(logs(spark, sf), "created_at", 100, "event_id").select("event_id", "task_id")


@query("recent_tasks", f"WITH {TK} SELECT id, status FROM TK ORDER BY created_at DESC, id DESC LIMIT 5")
def recent_tasks(spark, sf):
    return ops.latest(tasks(spark, sf), "created_at", 5, "id").select("id", "status")


@query("tasks_of_user", f"WITH {TK} SELECT id, name, created_at FROM TK WHERE user_id = 1 ORDER BY created_at DESC")
def tasks_of_user(spark, sf):
    return tasks(spark, sf).where("user_id = 1").select("id", "name", "created_at").orderBy(F.desc("created_at"))


@query("task_point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7 AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 7) LIMIT 1")
def task_point_lookup(spark, sf):
    o = table(spark, sf, "orders")
    owner = o.where("o_orderkey = 7").select("o_custkey")
    return o.where("o_orderkey = 7").join(owner, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice").limit(1)


@query("task_lineage", f"WITH {TK} SELECT id, root_task_id, retry_count FROM TK WHERE root_task_id = (SELECT min(root_task_id) FROM TK) OR id = (SELECT min(root_task_id) FROM TK)")
def task_lineage(spark, sf):
    t = tasks(spark, sf)
    root = t.agg(F.min("root_task_id")).first()[0]
    return ops.lineage(t, root).select("id", "root_task_id", "retry_count")


@query("task_roots", f"WITH {TK} SELECT id, root_task_id AS root_id, retry_count AS depth FROM TK")
def task_roots(spark, sf):
    from pageloom.session import shared_dir

    shared_dir(spark)
    return ops.roots(tasks(spark, sf))


@query("task_configs", f"WITH {TK} SELECT TK.id, c_name AS config, c_mktsegment AS purpose FROM TK JOIN customer ON c_custkey = user_id")
def task_configs(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("config"), F.col("c_mktsegment").alias("purpose"))
    return tasks(spark, sf).join(c, "user_id").select("id", "config", "purpose")


@query("retried_tasks", f"WITH {TK} SELECT id AS parent_task_id, root_task_id, regexp_replace(name, ' \\(Retry \\d+\\)$', '') || ' (Retry ' || (retry_count + 1) || ')' AS name, retry_count + 1 AS retry_count, 'processing' AS status, total_pages FROM TK")
def retried_tasks(spark, sf):
    return ops.retried(tasks(spark, sf))


@query("new_page_logs", f"WITH {TK} SELECT id AS task_id, CAST(unnest(range(0, total_pages - 1)) AS INTEGER) AS page_index, 'pending' AS status FROM TK WHERE total_pages > 1")
def new_page_logs(spark, sf):
    return ops.page_logs_of(tasks(spark, sf))


@query("retry_failed_pages", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 'pending' ELSE 'completed' END AS status, CASE WHEN l_linestatus <> 'F' THEN l_returnflag END AS error_message FROM lineitem")
def retry_failed_pages(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "F", "failed").otherwise("completed").alias("status"), F.col("l_returnflag").alias("error_message"))
    return ops.retry_failed(rows)


@query("transitions_valid", f"""WITH {LG}, S AS (SELECT task_id, event_id AS at_event, CASE kind WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'paused' ELSE 'processing' END AS after FROM LG),
X AS (SELECT task_id, at_event, lag(after) OVER (PARTITION BY task_id ORDER BY at_event) AS before, after FROM S)
SELECT task_id, at_event, before, after FROM X WHERE before IS NOT NULL AND before <> after AND before || '>' || after NOT IN ({', '.join(f"'{a}>{b}'" for a, b in sorted(ops.LEGAL_MOVES))})""")
def transitions_valid(spark, sf):
    k = F.col("event_type")
    status = F.when(k == "signup", "pending").when(k == "error", "failed").when(k == "purchase", "completed").when(k == "view", "paused").otherwise("processing")
    s = table(spark, sf, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("at"), status.alias("status"))
    return ops.illegal_moves(s).withColumnRenamed("at", "at_event")


@query("snapshot_latest_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def snapshot_latest_wins(spark, sf):
    e = table(spark, sf, "events").withColumn("gone", F.col("event_type") == "error")
    return ops.snapshot(e, "user_id", "event_id", "gone").select("user_id", "event_id", "event_type")


@query("upsert_users", "SELECT c_custkey, c_name, CASE WHEN c_nationkey = 3 THEN 'admin' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name, 'user' FROM supplier")
def upsert_users(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("user").alias("c_mktsegment"))
    changed = c.where("c_nationkey = 3").select("c_custkey", "c_name", F.lit("admin").alias("c_mktsegment")).union(new)
    return ops.upsert(c.drop("c_nationkey"), changed, "c_custkey")


@query("delete_tasks", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def delete_tasks(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return ops.delete(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


@query("single_default", "SELECT c_custkey AS id, c_nationkey AS user_id, c_acctbal > 5000 AND row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal > 5000 DESC, c_acctbal DESC, c_custkey DESC) = 1 AS is_default FROM customer")
def single_default(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("user_id"), (F.col("c_acctbal") > 5000).alias("is_default"), F.col("c_acctbal").alias("updated_at"))
    return ops.single_default(c).select("id", "user_id", "is_default")


@query("config_purposes", "SELECT c_custkey, CASE WHEN p IS NULL THEN true ELSE p IN ('vision_extract', 'general') END AS vision, coalesce(p IN ('long_context', 'general'), false) AS long FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'general' WHEN 'MACHINERY' THEN 'long_context' WHEN 'HOUSEHOLD' THEN 'vision_extract' END AS p FROM customer)")
def config_purposes(spark, sf):
    m = F.col("c_mktsegment")
    p = F.when(m == "BUILDING", "general").when(m == "MACHINERY", "long_context").when(m == "HOUSEHOLD", "vision_extract")
    c = table(spark, sf, "customer").select("c_custkey", p.alias("p"))
    return c.select("c_custkey", predicates.serves_purpose("p", "vision").alias("vision"), predicates.serves_purpose("p", "long").alias("long"))


@query("task_durations", "SELECT o_orderkey, CAST(floor(ms / 60000) AS BIGINT) || '分' || CAST(floor((ms % 60000) / 1000) AS BIGINT) || '秒' AS duration, CASE WHEN total > 0 THEN done / total * 100 ELSE 0.0 END::DOUBLE AS progress FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 10) AS BIGINT) AS ms, o_custkey % 5 AS total, o_custkey % 3 AS done FROM orders)")
def task_durations(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 10).alias("ms"), F.pmod("o_custkey", F.lit(5)).alias("total"), F.pmod("o_custkey", F.lit(3)).alias("done"))
    return o.select("o_orderkey", text.duration_ms("ms").alias("duration"), text.progress_percent("done", "total").alias("progress"))


@query("masked_keys", "SELECT c_custkey, substr(c_name, 1, 8) || '...' || right(c_name, 4) AS masked FROM customer")
def masked_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.mask_key("c_name").alias("masked"))


@query("storage_urls", r"SELECT page_id, regexp_replace(path, '^/+', '') AS key, 'http://store.test/' || regexp_replace(path, '^/+', '') AS address FROM (SELECT page_id, regexp_replace(url, '^[a-z]+:', '') AS path FROM pages)")
def storage_urls(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+:", "").alias("path"))
    return p.select("page_id", text.storage_key("path").alias("key"), text.storage_url(F.lit("http://store.test/"), "path").alias("address"))


@query("relative_paths", "SELECT doc_id, '../b/images/' || doc_id || '.jpg' AS up, 'x/' || doc_id || '.jpg' AS down, 'r/' || doc_id AS same FROM documents")
def relative_paths(spark, sf):
    d = table(spark, sf, "documents")
    p = lambda pre, post="": F.concat(F.lit(pre), "doc_id", F.lit(post))
    return d.select("doc_id", text.relative_path(p("/data/b/images/", ".jpg"), F.lit("/data/a")).alias("up"), text.relative_path(p("/data/a/x/", ".jpg"), F.lit("/data/a/")).alias("down"), text.relative_path(p("r/"), F.lit("/data/a")).alias("same"))


@query("folder_summary", """WITH f AS (SELECT 'in/' || source AS folder, 'in/' || source || CASE doc_id % 5 WHEN 0 THEN '/images/' || doc_id || '.PNG' WHEN 1 THEN '/page_' || doc_id || '.jpg' WHEN 2 THEN '/' || doc_id || '.md' WHEN 3 THEN '/' || doc_id || '_content_list.json' ELSE '/' || doc_id || '.txt' END AS p, doc_id % 5 AS k FROM documents)
SELECT folder, min(p) FILTER (WHERE k = 2) AS markdown, min(p) FILTER (WHERE k = 3) AS layout, count(*) FILTER (WHERE k = 0) AS images, count(*) FILTER (WHERE k = 1) AS page_images, greatest(count(*) FILTER (WHERE k = 1), 1) AS total_pages FROM f GROUP BY folder""")
def folder_summary(spark, sf):
    m, i = F.pmod("doc_id", F.lit(5)), F.col("doc_id").cast("string")
    name = F.when(m == 0, F.concat(F.lit("/images/"), i, F.lit(".PNG"))).when(m == 1, F.concat(F.lit("/page_"), i, F.lit(".jpg"))).when(m == 2, F.concat(F.lit("/"), i, F.lit(".md"))).when(m == 3, F.concat(F.lit("/"), i, F.lit("_content_list.json"))).otherwise(F.concat(F.lit("/"), i, F.lit(".txt")))
    return readers.folder_summary(table(spark, sf, "documents").select(F.concat(F.lit("in/"), "source", name).alias("path")))


#: A small catalog to run the preset queries on; real ones come from their owners.
PRESETS = [
    {"id": "alpha", "name": "Alpha", "base_url": "example.com/en", "models": [{"id": "a-text", "supports_vision": False, "recommended": True}, {"id": "a-see", "supports_vision": True, "recommended": True}]},
    {"id": "beta", "name": "Beta", "base_url": "example.net", "models": [{"id": "b-text", "supports_vision": False, "recommended": True}]},
    {"id": "gamma", "name": "Gamma", "base_url": "example.com", "models": [{"id": "c-see", "supports_vision": True}]},
]


#: The pages' addresses as a catalog in SQL: view K(id, name, models), a model for each part of a path.
_CATALOG = r"""K AS (SELECT CAST(page_id AS VARCHAR) AS id, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS name,
  list_filter(string_split(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS models FROM pages WHERE url IS NOT NULL)"""


def _page_catalog(spark, sf):
    """A preset for each page: its host, and a model for each part of its path, which sees images if it has a 1 and is recommended if it has a 2."""
    part = F.filter(F.split(F.regexp_extract("url", r"^[^:]*://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    model = F.transform(part, lambda x: F.struct(x.alias("id"), x.alias("name"), F.contains(x, F.lit("1")).alias("supports_vision"), F.contains(x, F.lit("2")).alias("recommended"), F.lit(None).cast("int").alias("context_window")))
    host = F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1)
    return table(spark, sf, "pages").where("url is not null").select(F.col("page_id").cast("int").alias("ord"), F.col("page_id").cast("string").alias("id"), host.alias("name"), host.alias("base_url"), model.alias("models"))


@query("presets_vision", f"WITH {_CATALOG} SELECT id, name FROM K WHERE len(list_filter(models, lambda x: contains(x, '1'))) > 0")
def presets_vision(spark, sf):
    return readers.vision_presets(_page_catalog(spark, sf)).select("id", "name")


@query("presets_recommended", f"WITH {_CATALOG}, G AS (SELECT id, list_filter(models, lambda x: contains(x, '1') AND contains(x, '2')) AS good FROM K) SELECT id AS preset_id, good[1] AS model_id FROM G WHERE len(good) > 0")
def presets_recommended(spark, sf):
    return readers.recommended_models(_page_catalog(spark, sf))


@query("preset_of_url", "SELECT page_id AS id, CASE WHEN contains(url, 'example.com/en') THEN 'alpha' WHEN contains(url, 'example.net') THEN 'beta' WHEN contains(url, 'example.com') THEN 'gamma' END AS preset_id FROM pages")
def preset_of_url(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("api_url"))
    return readers.preset_of_url(p, readers.presets(spark, PRESETS).coalesce(1)).select("id", "preset_id")


@query("compare_results", f"WITH {B}, {Q}, X AS (SELECT doc_id, question_ids, label, chapter_title FROM Q WHERE type = 'example' OR chapter_title <> ''), Y AS (SELECT doc_id, question_ids, label, CASE WHEN chapter_title = 'Unit 3' THEN 'Unit 4' ELSE chapter_title END AS chapter_title FROM Q WHERE type = 'exercise' OR chapter_title <> '') SELECT coalesce(X.doc_id, Y.doc_id) AS doc_id, coalesce(X.question_ids, Y.question_ids) AS question_ids, CASE WHEN Y.doc_id IS NULL THEN 'only_a' WHEN X.doc_id IS NULL THEN 'only_b' WHEN X.label = Y.label AND X.chapter_title = Y.chapter_title THEN 'same' ELSE 'changed' END AS change FROM X FULL JOIN Y ON X.doc_id = Y.doc_id AND X.question_ids = Y.question_ids")
def compare_results(spark, sf):
    q = questions(spark, sf).select("doc_id", "question_ids", "label", "chapter_title", "type")
    a = q.where("type = 'example' or chapter_title <> ''").drop("type")
    b = q.where("type = 'exercise' or chapter_title <> ''").drop("type").withColumn("chapter_title", F.when(F.col("chapter_title") == "Unit 3", "Unit 4").otherwise(F.col("chapter_title")))
    return ops.compare_results(a, b, ["doc_id", "question_ids"])


@query("pages_of_text", r"""WITH X AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || '---' || chr(10)), chr(10) || '---' || chr(10)) AS a FROM documents), Y AS (SELECT doc_id, unnest(range(0, len(a))) AS i, unnest(a) AS body FROM X),
Z AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS item, trim(body) AS body FROM Y WHERE trim(body) <> '') SELECT doc_id, item, CAST(floor(item / 10) AS INTEGER) AS page, body FROM Z""")
def pages_of_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n---\n").alias("text"))
    return ops.pages_of_text(d)


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf):
    return live.tumbling(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("events_sliding", "SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 15 MINUTES, ts), time_bucket(INTERVAL 15 MINUTES, ts) - INTERVAL 15 MINUTES, time_bucket(INTERVAL 15 MINUTES, ts) - INTERVAL 30 MINUTES, time_bucket(INTERVAL 15 MINUTES, ts) - INTERVAL 45 MINUTES]) AS start FROM events) GROUP BY ALL")
def events_sliding(spark, sf):
    return live.sliding(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("events_sessions", "WITH X AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), Y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM X) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS stop, count(*) AS n FROM Y GROUP BY user_id, s")
def events_sessions(spark, sf):
    return live.sessions(table(spark, sf, "events"))


@query("result_names", f"WITH {TK} SELECT id, name || '_questions.json' AS json_name, name || '_questions.md' AS markdown_name FROM TK")
def result_names(spark, sf):
    return exports.result_names(tasks(spark, sf))


@query("completed_tasks", f"WITH {TK} SELECT id, name FROM TK WHERE status = 'completed'")
def completed_tasks(spark, sf):
    return tasks(spark, sf).where("status = 'completed'").select("id", "name")


@query("page_logs_in_order", "SELECT l_orderkey AS task_id, l_linenumber AS page_index, CASE WHEN l_linestatus = 'F' THEN 'failed' ELSE 'completed' END AS status FROM lineitem WHERE l_orderkey = 7")
def page_logs_in_order(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("page_index"), F.when(F.col("l_linestatus") == "F", "failed").otherwise("completed").alias("status"))
    return ops.page_logs(rows, 7)


@query("stage_log_slice", f"WITH {LG}, X AS (SELECT event_id, task_id, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS n FROM LG) SELECT event_id, task_id FROM X WHERE n <= 20")
def stage_log_slice(spark, sf):
    return ops.stage_slice(logs(spark, sf), "processing", 20, tie="event_id", newest_first=True).select("event_id", "task_id")


@query("latest_task_logs", f"WITH {LG} SELECT event_id, task_id FROM LG WHERE task_id = (SELECT task_id FROM LG GROUP BY task_id ORDER BY max(ts) DESC, task_id DESC LIMIT 1) ORDER BY ts DESC, event_id DESC LIMIT 20")
def latest_task_logs(spark, sf):
    lines = logs(spark, sf)
    newest = lines.groupBy(F.col("task_id").alias("id")).agg(F.max("created_at").alias("created_at"))
    return ops.latest_task_logs(newest, lines, 20, log_tie="event_id").select("event_id", "task_id")


@query("inserted_ids", "SELECT (SELECT max(c_custkey) FROM customer) + 1 AS first_id, (SELECT max(c_custkey) FROM customer) + (SELECT count(*) FROM orders) AS last_id, (SELECT count(*) FROM orders) AS n, (SELECT count(DISTINCT o_orderkey) FROM orders) AS names")
def inserted_ids(spark, sf):
    """Orders inserted after customers: their new ids run on without a gap."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    made = ops.inserted(c, table(spark, sf, "orders").select(F.col("o_orderkey").alias("name")))
    return made.agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.countDistinct("id").alias("n"), F.countDistinct("name").alias("names"))


@query("page_of_text", r"""WITH Y AS (SELECT doc_id, unnest(range(0, len(a))) AS i, unnest(a) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
Z AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS item, trim(body) AS body FROM Y WHERE trim(body) <> ''), V AS (SELECT *, CAST(floor(item / 10) AS INTEGER) AS page, max(CAST(floor(item / 10) AS INTEGER)) OVER (PARTITION BY doc_id) AS last FROM Z)
SELECT doc_id, item, page, body FROM V WHERE page = least(2, last)""")
def page_of_text(spark, sf):
    """The third page of each result; shorter ones show their last."""
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n---\n").alias("text"))
    return ops.page_of_text(ops.pages_of_text(d), 2)


@query("progress_of_logs", f"""WITH {LG}, S AS (SELECT task_id, CAST(CASE WHEN coalesce(max(k) FILTER (WHERE kind = 'signup'), 0) > 0 THEN max(k) FILTER (WHERE kind = 'signup') ELSE count(*) FILTER (WHERE kind = 'click') END AS BIGINT) AS total,
 count(*) FILTER (WHERE kind = 'purchase') AS completed, count(*) FILTER (WHERE kind = 'error') AS failed FROM LG GROUP BY task_id)
SELECT task_id, CAST(10 + floor(CASE WHEN total > 0 THEN least(1.0, (completed + failed) / total) ELSE 0.0 END * 80) AS INTEGER) AS percent, total, completed, failed FROM S""")
def progress_of_logs(spark, sf):
    return live.progress_of(logs(spark, sf)).select("task_id", "percent", "total", "completed", "failed")


@query("progress_of_stream", f"""WITH {LG} SELECT task_id, CAST(CASE WHEN coalesce(max(k) FILTER (WHERE kind = 'signup'), 0) > 0 THEN max(k) FILTER (WHERE kind = 'signup') ELSE count(*) FILTER (WHERE kind = 'click') END AS BIGINT) AS total,
 count(*) FILTER (WHERE kind = 'purchase') AS completed, count(*) FILTER (WHERE kind = 'error') AS failed FROM LG GROUP BY task_id""")
def progress_of_stream(spark, sf):
    """The same counts by a stream over the log, several micro-batches long, from the table that it keeps."""
    path = scratch_path(spark, "progress")
    lines = logs(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("chunk_index", F.lit(None).cast("int"))
    lines.select(*live.LOGS.names).repartition(4).write.parquet(f"{path}/logs")
    stream = live.start_progress(live.log_stream(spark, f"{path}/logs", 2), f"{path}/table", f"{path}/checkpoint", seconds=0)
    stream.processAllAvailable()
    stream.stop()
    return live.progress_table(spark, f"{path}/table").read().select("task_id", "total", "completed", "failed")


@query("signal_states", """WITH S AS (SELECT user_id AS task_id, ts, event_type AS kind, max(CASE WHEN event_type IN ('signup', 'purchase') THEN ts END) OVER (PARTITION BY user_id) AS reset FROM events),
X AS (SELECT task_id, arg_max(kind, ts) FILTER (WHERE ts = reset) AS first, bool_or(kind = 'error' AND ts > reset) AS gone, arg_max(kind, ts) FILTER (WHERE kind IN ('click', 'view') AND ts > reset) AS last FROM S WHERE reset IS NOT NULL GROUP BY task_id)
SELECT task_id, CASE WHEN gone THEN 'cancelled' WHEN last = 'click' THEN 'paused' ELSE 'processing' END AS state FROM X WHERE first = 'signup'""")
def signal_states(spark, sf):
    """Events as signals of their user's task, through the durable state table."""
    path = scratch_path(spark, "signals")
    kind = F.col("event_type")
    signal = F.when(kind == "signup", "register").when(kind == "click", "pause").when(kind == "view", "resume").when(kind == "error", "cancel").when(kind == "purchase", "unregister")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("task_id"), signal.alias("signal"), F.col("ts").cast("timestamp").alias("sent_at")).where("signal is not null")
    rows.write.parquet(f"{path}/signals")
    stream = signals.start_signals(spark, path, 0, keep_ms=10**12)
    stream.processAllAvailable()
    stream.stop()
    return signals.all_states(spark, path).select("task_id", "state")


@query("keyed_changes", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'late' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS price
FROM orders WHERE o_orderpriority <> '1-URGENT'""")
def keyed_changes(spark, sf):
    """Orders as a keyed table: written, compacted into buckets, then changed and in part deleted; read without moving the base."""
    o = table(spark, sf, "orders")
    kept = keyed.KeyedTable(spark, scratch_path(spark, "orders"), "id long, status string, price double", "id")
    kept.put(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")), 0)
    kept.compact()
    late = o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.lit("late").alias("status"), (F.col("o_totalprice") * 2).alias("price"))
    kept.put(late, 1)
    kept.delete(o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id")), 2)
    return kept.read()
