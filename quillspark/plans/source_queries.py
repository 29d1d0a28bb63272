"""Queries over the session dialects, locators and repositories: their lines and entries are made from the given
tables, row by row, and read by the same functions that read files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.durable import table
from quillspark.functions import text as T
from quillspark.plans.registry import query
from quillspark.sources import files as X
from quillspark.sources import sessions as R

#: Texts as the readers clean them, the name of a session without one, and the Markdown of its turns, in DuckDB.
CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'data:[\\w/+.-]+;base64,[A-Za-z0-9+/=\\s]+', '[data]', 'g'), '\\b[A-Za-z0-9+/]{200,}={0,2}\\b', '[base64]', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
FIRST = f"coalesce(nullif(left(trim(string_split(trim(coalesce(first(t ORDER BY turn) FILTER (role = 'user'), '')), chr(10))[1]), 120), ''), '{R.NO_TITLE}')"
MARKDOWN = "md5(string_agg('## ' || role || chr(10) || chr(10) || t, chr(10) || chr(10) ORDER BY {}))"
#: Hour h of 2024 as ISO-8601.
HOUR = "strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours({}), '%Y-%m-%dT%H:%M:%SZ')"
START = 1704067200


def _id() -> Column:
    return F.col("conv_id").cast("string")


def _folded(sessions):
    return sessions.select("id", "title", "date", "cwd", F.md5("text").alias("text"))


@query("src_log_fold", f"""WITH c AS (SELECT conv_id, turn, role, {CLEAN} AS t FROM conversations),
said AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN t ELSE CASE WHEN t = '' THEN '' ELSE t || chr(10) || chr(10) END || '_ran: ls ' || conv_id || '_' END AS t FROM c WHERE role IN ('user', 'assistant')),
began AS (SELECT conv_id, min(turn) AS began FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS id, CASE WHEN conv_id % 2 = 0 THEN 'Named ' || conv_id ELSE {FIRST} END AS title, {HOUR.format('any_value(began)')} AS date, '/w/p' || (conv_id % 7) AS cwd, {MARKDOWN.format('turn')} AS text
FROM said JOIN began USING (conv_id) WHERE t <> '' GROUP BY conv_id""")
def src_log_fold(spark, d):
    """First dialect: a line a turn (text, or blocks of text, thinking and a tool call), titles, bad and blank lines."""
    c = table(spark, d, "conversations")
    file = F.concat(F.lit("/logs/"), _id(), F.lit(".jsonl")).alias("file")
    ts = F.date_format(F.timestamp_seconds(F.lit(START) + F.col("turn") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    head = [F.col("role").alias("type"), ts, F.concat(F.lit("/w/p"), (F.col("conv_id") % 7).cast("string")).alias("cwd")]
    block = lambda kind, text, name, command: F.struct(F.lit(kind).alias("type"), text.alias("text"), name.alias("name"), F.when(command.isNotNull(), F.struct(command.alias("command"))).alias("input"))
    none = F.lit(None).cast("string")
    blocks = F.array(block("text", F.col("text"), none, none), block("thinking", F.lit("hidden"), none, none), block("tool_use", none, F.lit("Bash"), F.concat(F.lit("ls "), _id(), F.lit("\nrm"))))
    value = F.when(F.col("role") == "assistant", F.to_json(F.struct(*head, F.struct(blocks.alias("content")).alias("message")))).otherwise(F.to_json(F.struct(*head, F.struct(F.col("text").alias("content")).alias("message"))))
    extra = c.select("conv_id").distinct().select(file, F.explode(F.array(
        F.struct(F.lit(-2).cast("bigint").alias("line"), F.lit("{bad").alias("value")),
        F.struct(F.lit(-1).cast("bigint").alias("line"), F.lit("").alias("value")),
        F.struct(F.lit(1 << 40).cast("bigint").alias("line"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('{"type": "ai-title", "aiTitle": "Named '), _id(), F.lit('"}'))).otherwise("[1]").alias("value")),
    )).alias("x")).select("file", "x.*")
    lines = c.select(file, F.col("turn").cast("bigint").alias("line"), value.alias("value")).unionByName(extra)
    return _folded(R.log_sessions(lines))


@query("src_rollout_fold", f"""WITH c AS (SELECT conv_id, turn, role, {CLEAN} AS t FROM conversations WHERE role IN ('user', 'assistant')),
said AS (SELECT conv_id, turn * 2 AS turn, role, CASE WHEN role = 'user' AND conv_id % 3 <> 0 THEN '## My request' || chr(10) || t ELSE t END AS t FROM (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND conv_id % 3 <> 0 AND t = '' THEN NULL ELSE t END AS t FROM c)
UNION ALL SELECT conv_id, turn * 2 + 1, role, '_ran: ls ' || conv_id || '_' FROM c WHERE role = 'assistant')
SELECT 'r' || conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN 'Thread ' || conv_id ELSE {FIRST} END AS title, {HOUR.format('conv_id')} AS date, '/w/p' || (conv_id % 7) AS cwd,
{MARKDOWN.format("CASE WHEN conv_id % 3 = 0 AND role = 'user' THEN 0 ELSE 1 END, turn")} AS text FROM said WHERE t <> '' GROUP BY conv_id""")
def src_rollout_fold(spark, d):
    """Second dialect: meta, user messages with an editor's context (or only message items), replies and shell calls."""
    c = table(spark, d, "conversations")
    file = F.concat(F.lit("/rollouts/"), _id(), F.lit(".jsonl")).alias("file")
    item = lambda kind, payload: F.to_json(F.struct(F.lit(kind).alias("type"), payload.alias("payload")))
    said = F.array(F.struct(F.col("text").alias("text")))
    asked = F.concat(F.lit("# Context from my IDE setup:\nopen: a.py\n\n## My request\n"), F.regexp_replace("text", r"^\s+", ""))
    user = F.when(F.col("conv_id") % 3 == 0, item("response_item", F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), said.alias("content")))).otherwise(item("event_msg", F.struct(F.lit("user_message").alias("type"), asked.alias("message"))))
    reply = item("response_item", F.struct(F.lit("message").alias("type"), F.lit("assistant").alias("role"), said.alias("content")))
    call = item("response_item", F.struct(F.lit("function_call").alias("type"), F.lit("shell").alias("name"), F.to_json(F.struct(F.array(F.lit("bash"), F.lit("-lc"), F.concat(F.lit("ls "), _id())).alias("command"))).alias("arguments")))
    turn = F.col("turn").cast("bigint") * 2
    made = F.when(F.col("role") == "user", F.array(F.struct(turn.alias("line"), user.alias("value")))).when(F.col("role") == "assistant", F.array(F.struct(turn.alias("line"), reply.alias("value")), F.struct((turn + 1).alias("line"), call.alias("value"))))
    ids = c.select("conv_id").distinct()
    meta = item("session_meta", F.struct(F.concat(F.lit("r"), _id()).alias("id"), F.concat(F.lit("/w/p"), (F.col("conv_id") % 7).cast("string")).alias("cwd"), (F.lit(START) + F.col("conv_id") * 3600).cast("string").alias("timestamp")))
    lines = c.select(file, F.explode(made).alias("x")).select("file", "x.*").unionByName(ids.select(file, F.lit(-1).cast("bigint").alias("line"), meta.alias("value")))
    titles = ids.filter(F.col("conv_id") % 2 == 0).select(F.concat(F.lit("r"), _id()).alias("id"), F.concat(F.lit("Thread "), _id()).alias("title"), F.lit("2024").alias("updated"))
    return _folded(R.rollout_sessions(lines, titles))


@query("src_thread_fold", f"""WITH c AS (SELECT conv_id, turn, role, {CLEAN} AS t FROM conversations WHERE role IN ('user', 'assistant')),
said AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN '_edited: f' || conv_id || '.py_' || chr(10) || '_ran a tool_' ELSE t END AS t FROM c)
SELECT conv_id::VARCHAR AS id, CASE WHEN conv_id % 2 = 0 THEN 'Thread ' || conv_id ELSE {FIRST} END AS title, {HOUR.format('conv_id')} AS date,
CASE WHEN conv_id % 3 = 0 THEN '/w/p' || (conv_id % 7) END AS cwd, {MARKDOWN.format('turn')} AS text FROM said WHERE t <> '' GROUP BY conv_id""")
def src_thread_fold(spark, d):
    """Third dialect: threads and bubbles of a key-value store; bubbles without text are told by their edits and tools."""
    c = table(spark, d, "conversations")
    at = (F.lit(START) + F.col("conv_id") * 3600) * 1000
    silent = (F.col("role") == "assistant") & (F.col("turn") % 4 == 3)
    edit = F.struct(F.concat(F.lit("/src/f"), _id(), F.lit(".py")).alias("uri"))
    value = F.to_json(F.struct(F.when(F.col("role") == "user", 1).otherwise(2).alias("type"), F.when(silent, "").otherwise(F.col("text")).alias("text"), (at + F.col("turn") * 1000).alias("createdAt"), F.when(silent, F.array(edit, edit)).alias("assistantSuggestedDiffs"), F.when(silent, F.array(F.lit("ok"))).alias("toolResults")))
    bubbles = c.filter(F.col("role").isin("user", "assistant")).select(F.concat_ws(":", F.lit("bubbleId"), _id(), F.col("turn").cast("string")).alias("key"), value.alias("value"))
    ids = c.select("conv_id").distinct()
    name = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Thread "), _id()))
    threads = ids.select(F.concat(F.lit("composerData:"), _id()).alias("key"), F.to_json(F.struct(name.alias("name"), at.alias("createdAt"))).alias("value"))
    bad = ids.select(F.concat(F.lit("bubbleId:"), _id(), F.lit(":bad")).alias("key"), F.lit("{bad").alias("value"))
    folders = ids.filter(F.col("conv_id") % 3 == 0).select(_id().alias("id"), F.concat(F.lit("/w/p"), (F.col("conv_id") % 7).cast("string")).alias("cwd"))
    return _folded(R.thread_sessions(bubbles.unionByName(bad), threads.unionByName(bad), folders))


def _locators(spark, d):
    i = F.col("doc_id")
    s = i.cast("string")
    entry = F.to_json(F.struct(F.concat(F.lit("d/"), s, F.lit(".md")).alias("path"), F.col("lang").alias("kind"), F.substring("text", 1, 40).alias("description"), F.when(i % 5 == 0, F.concat(F.lit("/abs/"), s, F.lit(".md"))).alias("local_path"), F.when(i % 3 != 0, i % 2 == 0).alias("local_readable"), F.sha2(s, 256).alias("fingerprint")))
    return R.locators(table(spark, d, "documents").select(F.when(i % 7 == 0, F.substring(entry, 1, 9)).otherwise(entry).alias("value")))


_LOCATORS = """l AS (SELECT doc_id, 'd/' || doc_id || '.md' AS path, lang AS kind, left(text, 40) AS description, CASE WHEN doc_id % 5 = 0 THEN '/abs/' || doc_id || '.md' END AS local_path,
coalesce(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 = 0 END, false) AS local_readable, sha256(doc_id::VARCHAR) AS fingerprint FROM documents WHERE doc_id % 7 <> 0)"""


@query("src_locator_index", f"WITH {_LOCATORS} SELECT path, kind, md5(description) AS description, local_path, local_readable, fingerprint FROM l")
def src_locator_index(spark, d):
    return _locators(spark, d).select("path", "kind", F.md5("description").alias("description"), "local_path", "local_readable", "fingerprint")


@query("src_local_files", f"""WITH {_LOCATORS} SELECT path, CASE WHEN doc_id % 10 = 0 THEN local_path WHEN local_readable AND doc_id % 4 <> 0 THEN '/base/' || path END AS file FROM l""")
def src_local_files(spark, d):
    """The file of each locator: its absolute path if listed, else the relative one below a base if it is readable."""
    i = F.col("doc_id")
    s = i.cast("string")
    places = F.array_compact(F.array(F.when(i % 10 == 0, F.concat(F.lit("/abs/"), s, F.lit(".md"))), F.when(i % 4 != 0, F.concat(F.lit("/base/d/"), s, F.lit(".md")))))
    listed = table(spark, d, "documents").select(F.explode(places).alias("path"))
    return X.local_files(_locators(spark, d), listed, "/base/").select("path", "file")


@query("src_nested_repos", "SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN '/w/r' || (page_id % 20) ELSE '/w/g' || (page_id % 4) || '/q' || (page_id % 9) END AS repo FROM pages WHERE page_id % 3 <> 2")
def src_nested_repos(spark, d):
    """Repositories one or two folders below a folder; deeper ones belong to others."""
    i = F.col("page_id")
    n = lambda k: (i % k).cast("string")
    path = F.when(i % 3 == 0, F.concat(F.lit("/w/r"), n(20), F.lit("/.git/HEAD"))).when(i % 3 == 1, F.concat(F.lit("/w/g"), n(4), F.lit("/q"), n(9), F.lit("/.git"))).otherwise(F.concat(F.lit("/w/a/b/c"), n(5), F.lit("/.git/HEAD")))
    return X.nested_repos(table(spark, d, "pages").select(path.alias("path")), "/w/")


@query("x_coerce", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'bool' WHEN 1 THEN 'null' WHEN 2 THEN 'int' WHEN 3 THEN 'int' ELSE 'text' END AS kind,
CASE doc_id % 6 WHEN 0 THEN 'true' WHEN 2 THEN doc_id::VARCHAR WHEN 3 THEN (-doc_id)::VARCHAR WHEN 4 THEN lang ELSE CASE WHEN doc_id % 6 = 5 THEN doc_id || '.5' END END AS value FROM documents""")
def x_coerce(spark, d):
    i = F.col("doc_id")
    s = i.cast("string")
    said = F.element_at(F.array(F.lit(" TRUE "), F.lit("None"), F.concat(F.lit("+00"), s), F.concat(F.lit("-"), s), F.col("lang"), F.concat(s, F.lit(".5"))), (i % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.literal(said).alias("l")).select("doc_id", "l.*")
