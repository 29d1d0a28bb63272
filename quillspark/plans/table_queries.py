"""Queries over sessions, ledgers, pages and code listings, each with its SQL oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.durable import table
from quillspark.functions import scrub as S
from quillspark.functions import text as T
from quillspark.operators import incremental as I
from quillspark.operators import rollup as R
from quillspark.plans import duck as D
from quillspark.plans import views
from quillspark.plans.registry import query
from quillspark.sources.sessions import filter_sessions, tolerant

# sources
_COLS = ("source", "sid", "title", "date", "cwd")
_session_sql = f"WITH {D.SESSIONS} SELECT {{}} FROM sessions_v"


@query("src_union_sessions", _session_sql.format("source, sid, title, date, cwd, md5(text) AS text"))
def src_union_sessions(spark, d):
    s = views.sessions(spark, d)
    parts = [s.filter(F.col("source") == name) for name in ("claude", "codex", "cursor")]
    return reduce(DataFrame.unionByName, parts).select(*_COLS, F.md5("text").alias("text"))


@query("src_session_fold", _session_sql.format("conv_id, title, n_turns, md5(text) AS text"))
def src_session_fold(spark, d):
    return views.fold_turns(views.turns(spark, d)).select("conv_id", "title", "n_turns", F.md5("text").alias("text"))


@query("agg_session_markdown", _session_sql.format("conv_id, md5(text) AS markdown, length(text) AS n"))
def agg_session_markdown(spark, d):
    return views.fold_turns(views.turns(spark, d)).select("conv_id", F.md5("text").alias("markdown"), F.length("text").alias("n"))


@query("src_filtered_sessions", _session_sql.format("sid") + " WHERE cwd = '/w/p3' AND left(date, 10) >= '2024-01-02'")
def src_filtered_sessions(spark, d):
    return filter_sessions(views.sessions(spark, d), "/w/p3", "2024-01-02").select("sid")


@query("join_session_titles", _session_sql.format("sid, CASE WHEN conv_id % 2 = 0 THEN 'Thread ' || conv_id ELSE title END AS title"))
def join_session_titles(spark, d):
    """Sessions named by the last row of a title index, else by their first user line."""
    s = views.sessions(spark, d)
    index = table(spark, d, "conversations").filter(F.col("conv_id") % 2 == 0).select(F.concat(F.lit("sid-"), F.col("conv_id").cast("string")).alias("sid"), "turn", F.concat(F.lit("Thread "), F.col("conv_id").cast("string")).alias("named"))
    last = index.groupBy("sid").agg(F.max_by("named", "turn").alias("named"))
    return s.join(last, "sid", "left").select("sid", F.coalesce("named", "title").alias("title"))


@query("src_jsonl_tolerant", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def src_jsonl_tolerant(spark, d):
    i = F.col("event_id")
    lines = table(spark, d, "events").select("event_id", F.when(i % 7 == 0, "{bad").when(i % 11 == 0, "").otherwise(F.col("props")).alias("line"))
    return tolerant(lines, "line").select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("src_kv_prefix", "SELECT conv_id::VARCHAR AS id, turn::VARCHAR AS bubble, length(text) AS n FROM conversations WHERE turn > 0")
def src_kv_prefix(spark, d):
    """Entries of a key-value table by key prefix, keys cut at colons (see sources.keyvalue)."""
    c = table(spark, d, "conversations")
    kv = c.select(F.concat_ws(":", F.when(F.col("turn") > 0, "bubbleId").otherwise("composerData"), "conv_id", "turn").alias("key"), F.col("text").alias("value"))
    part = F.split("key", ":")
    return kv.filter(F.col("key").startswith("bubbleId:")).select(F.get(part, F.lit(1)).alias("id"), F.get(part, F.lit(2)).alias("bubble"), F.length("value").alias("n"))


@query("topk_latest_session", f"WITH {D.SESSIONS} SELECT cwd, sid FROM (SELECT *, row_number() OVER (PARTITION BY cwd ORDER BY date DESC, conv_id DESC) AS n FROM sessions_v) WHERE n = 1")
def topk_latest_session(spark, d):
    return I.latest(views.sessions(spark, d), ["cwd"], [F.desc("date"), F.desc("conv_id")]).select("cwd", "sid")


# ledgers and gates
def _keyed(spark, d):
    docs = table(spark, d, "documents")
    key = lambda text: F.concat_ws(":", "source", "doc_id", F.substring(F.sha2(text, 256), 1, 12))
    ledger = docs.filter(F.col("doc_id") % 3 == 0).select(key(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))).alias("key"))
    return docs, key(F.col("text")), ledger


@query("j_ledger_anti", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 9 = 0")
def j_ledger_anti(spark, d):
    docs, key, ledger = _keyed(spark, d)
    return I.new_keys(docs.select("doc_id", key.alias("key")), ledger).select("doc_id")


@query("j_pending", "SELECT 'n' || lpad(doc_id::VARCHAR, 8, '0') AS name FROM documents WHERE doc_id >= 10 AND (doc_id % 3 <> 0 OR doc_id % 9 = 0)")
def j_pending(spark, d):
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("n"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("name")
    raw = docs.select(name, F.substring(F.sha2("text", 256), 1, 16).alias("hash"))
    done = docs.filter(F.col("doc_id") % 3 == 0).select(name, F.substring(F.sha2(F.when(F.col("doc_id") % 9 == 0, F.lit("changed")).otherwise(F.col("text")), 256), 1, 16).alias("hash"))
    return I.pending(raw, done, since="n00000010").select("name")


@query("j_embed_cache", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <> 0 AND doc_id % 10 <> 0 THEN 'reuse' ELSE 'embed' END AS action FROM documents")
def j_embed_cache(spark, d):
    i = F.col("doc_id")
    pages = table(spark, d, "documents").select("doc_id", i.cast("string").alias("slug"), F.substring(F.sha2("text", 256), 1, 16).alias("hash"))
    cache = pages.filter(i % 2 == 0).select("slug", F.when(i % 6 == 0, "stale").otherwise(F.col("hash")).alias("hash"), F.when(i % 10 == 0, "old").otherwise("m1").alias("model"))
    return I.cache_plan(pages, cache, "m1").select("doc_id", "action")


@query("t_two_level_gate", "WITH f AS (SELECT doc_id, md5(text) AS c FROM documents WHERE doc_id % 3 <> 0), k AS (SELECT DISTINCT md5(text) AS c FROM documents WHERE doc_id % 5 = 0) SELECT count(DISTINCT c) AS n FROM f WHERE c NOT IN (SELECT c FROM k)")
def t_two_level_gate(spark, d):
    i = F.col("doc_id")
    files = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/d/"), i.cast("string"), F.lit(":1:2")).alias("stat_key"), F.md5("text").alias("content_key"))
    ledger = files.filter(i % 3 == 0).select(F.col("stat_key").alias("key")).unionByName(files.filter(i % 5 == 0).select(F.col("content_key").alias("key")))
    return I.two_level_gate(files, ledger).agg(F.count(F.lit(1)).alias("n"))


@query("t_fingerprint_gate", f"WITH e AS (SELECT doc_id, 'idx:' || doc_id || ':' || left(md5(text), 8) AS fp, ({' + '.join(f'''(contains(lower(text || CASE WHEN doc_id % 5 = 0 THEN ' CPF e Telefone' ELSE '' END), '{h}'))::INT''' for h in S.PII_HINTS)}) >= 2 AS s FROM documents WHERE doc_id % 4 <> 0) SELECT doc_id, fp, CASE WHEN s THEN 'sensitive' ELSE 'resolve' END AS action FROM e")
def t_fingerprint_gate(spark, d):
    i = F.col("doc_id")
    entries = table(spark, d, "documents").select("doc_id", F.concat_ws(":", F.lit("idx"), i.cast("string"), F.substring(F.md5("text"), 1, 8)).alias("fp"), F.concat("text", F.when(i % 5 == 0, " CPF e Telefone").otherwise("")).alias("description"))
    ledger = entries.filter(i % 4 == 0).select("fp")
    return I.new_keys(entries, ledger, "fp").select("doc_id", "fp", F.when(S.is_sensitive(F.col("description")), "sensitive").otherwise("resolve").alias("action"))


@query("t_capture_supersede", f"WITH {D.SESSIONS} SELECT sid, n_turns, 'full' AS state FROM sessions_v WHERE conv_id % 2 = 0 UNION ALL SELECT 'sid-' || conv_id, count(*), 'partial' FROM conversations WHERE conv_id % 2 = 1 AND turn < 2 GROUP BY conv_id")
def t_capture_supersede(spark, d):
    """Captures of a session: the full one takes the place of the partial one."""
    c = table(spark, d, "conversations")
    count = lambda rows, state, rank: rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")).select(F.concat(F.lit("sid-"), F.col("conv_id").cast("string")).alias("sid"), "n_turns", F.lit(state).alias("state"), F.lit(rank).alias("rank"))
    captures = count(c.filter(F.col("turn") < 2), "partial", 0).unionByName(count(c.filter(F.col("conv_id") % 2 == 0), "full", 1))
    return I.latest(captures, ["sid"], [F.desc("rank")]).select("sid", "n_turns", "state")


@query("t_session_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def t_session_dedup(spark, d):
    """First injection of each page in each session (batch form of streaming.sessions.inject_once)."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("t_state_ttl", "SELECT user_id, event_type, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last FROM events GROUP BY 1, 2 HAVING event_type = 'error' OR max(ts) >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 7 DAY")
def t_state_ttl(spark, d):
    """Keyed state that survives pruning: recall keys younger than seven days, and all keys of another prefix."""
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    keep = (F.col("event_type") == "error") | (F.col("last") >= F.lit("2024-01-10 00:00:00").cast("timestamp") - F.expr("INTERVAL 7 DAY"))
    return last.filter(keep).select("user_id", "event_type", F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss").alias("last"))


@query("t_cadence", "SELECT user_id, count(*) >= 12 AND epoch_ms(TIMESTAMP '2024-02-01 00:00:00') - epoch_ms(max(ts)) >= 7 * 86400000 AS due FROM events GROUP BY 1")
def t_cadence(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("ts").cast("timestamp")).alias("last"))
    return g.select("user_id", ((F.col("n") >= 12) & (F.unix_millis(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_millis("last") >= 7 * 86400000)).alias("due"))


@query("t_upsert_pages", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE left(md5(text), 8) END AS body FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 4 = 0")
def t_upsert_pages(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.substring(F.md5("text"), 1, 8).alias("body"))
    return I.upsert(docs.filter((i % 2 == 0) | (i % 3 == 0)), docs.filter(i % 4 == 0).withColumn("body", F.lit("new")), "doc_id")


@query("a_changelog_action", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'update' ELSE 'create' END AS action FROM documents WHERE doc_id % 2 = 0")
def a_changelog_action(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    old = docs.filter(F.col("doc_id") % 3 == 0).withColumn("had", F.lit(True))
    return docs.filter(F.col("doc_id") % 2 == 0).join(old, "doc_id", "left").select("doc_id", F.when(F.col("had"), "update").otherwise("create").alias("action"))


@query("o_log_tail", "SELECT event_id FROM (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20)")
def o_log_tail(spark, d):
    """The last 20 changelog rows of a page (the report's own limit)."""
    return table(spark, d, "events").filter(F.col("event_type") == "error").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id")


# pages
def _pages_query(name: str, sql: str):
    return query(name, f"WITH {D.PAGES} {sql}")


_bullet = "'- [[' || slug || ']] — ' || summary"
_bucket = "CASE WHEN len(list_filter(sources, lambda s: starts_with(s, 'analyze:'))) > 0 THEN 'arch' WHEN len(list_filter(sources, lambda s: starts_with(s, 'doc:'))) > 0 THEN 'doc' ELSE 'session' END"


@_pages_query("agg_index_catalog", f"SELECT section, slug, {_bullet} AS line FROM pages_v")
def agg_index_catalog(spark, d):
    return R.catalog(views.pages(spark, d))


@_pages_query("agg_project_hubs", f"SELECT project, {_bucket} AS bucket, slug, {_bullet} AS line FROM pages_v")
def agg_project_hubs(spark, d):
    return R.hubs(views.pages(spark, d))


@_pages_query("x_hub_bucket", f"SELECT {_bucket} AS bucket, count(*) AS n FROM pages_v GROUP BY 1")
def x_hub_bucket(spark, d):
    return views.pages(spark, d).groupBy(R.hub_bucket(F.col("sources")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@_pages_query("x_migrate_kind", "SELECT ord, CASE ord % 4 WHEN 0 THEN 'doc' WHEN 1 THEN 'code' WHEN 2 THEN 'session' ELSE 'manual' END AS kind, 'current' AS status FROM pages_v")
def x_migrate_kind(spark, d):
    return views.pages(spark, d).select("ord", R.source_kind(F.col("sources")).alias("kind"), F.lit("current").alias("status"))


@_pages_query("a_project_pages", "SELECT project, count(*) AS n FROM pages_v GROUP BY 1")
def a_project_pages(spark, d):
    return views.pages(spark, d).groupBy("project").agg(F.count(F.lit(1)).alias("n"))


@_pages_query("a_status", "SELECT 'kind' AS measure, value, count(*) AS n FROM (SELECT kind AS value FROM pages_v) GROUP BY value UNION ALL SELECT 'status', value, count(*) FROM (SELECT status AS value FROM pages_v) GROUP BY value UNION ALL SELECT 'pages', '', count(*) FROM pages_v UNION ALL SELECT 'raw', '', count(*) FROM documents UNION ALL SELECT 'synthed', '', count(*) FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'pending', '', count(*) FROM documents WHERE doc_id % 3 <> 0")
def a_status(spark, d):
    docs = table(spark, d, "documents")
    return R.status(views.pages(spark, d), docs.count(), docs.filter(F.col("doc_id") % 3 == 0).count())


_rank = "CASE {} WHEN 'merged' THEN 0 WHEN 'session' THEN 1 WHEN 'doc' THEN 2 WHEN 'code' THEN 3 ELSE 4 END"


@_pages_query("a_kind_merge", f"SELECT ord, CASE WHEN {_rank.format('kind')} <= {_rank.format('raw')} THEN kind ELSE raw END AS kind FROM (SELECT ord, kind, CASE ord % 3 WHEN 0 THEN 'session' WHEN 1 THEN 'doc' ELSE 'code' END AS raw FROM pages_v)")
def a_kind_merge(spark, d):
    raw = F.when(F.col("ord") % 3 == 0, "session").when(F.col("ord") % 3 == 1, "doc").otherwise("code")
    return views.pages(spark, d).select("ord", R.merge_kind(F.col("kind"), raw).alias("kind"))


_label = "CASE kind WHEN 'session' THEN '> 💬 Sessão de IA' WHEN 'doc' THEN '> 📄 Documento' WHEN 'manual' THEN '> ✍️ Salvo manualmente' WHEN 'code' THEN '> 🏛️ Código' ELSE '> 🔀 Consolidado' END"
_list = lambda c: f"chr(10) || array_to_string(list_transform({c}, lambda x: '  - ' || x), chr(10))"


@_pages_query("r_page_md", f"SELECT ord, md5('---' || chr(10) || 'title: \"' || replace(title, '\"', '''') || '\"' || chr(10) || 'tags:' || {_list('tags')} || chr(10) || 'kind: ' || kind || chr(10) || 'status: ' || status || chr(10) || 'project: ' || project || chr(10) || 'sources:' || {_list('sources')} || chr(10) || 'updated: 2024-01-10' || chr(10) || '---' || chr(10) || chr(10) || {_label} || chr(10) || chr(10) || regexp_replace(body, '\\s+$', '') || chr(10)) AS page FROM pages_v")
def r_page_md(spark, d):
    return views.pages(spark, d).select("ord", F.md5(R.render_page("2024-01-10")).alias("page"))


_appended = "regexp_replace(body, '\\s+$', '') || chr(10) || chr(10) || '## Relacionado <!-- quill-relink -->' || chr(10) || '- [[a]]' || chr(10) || '- [[' || slug || ']]' || chr(10)"


@_pages_query("x_managed_section", f"SELECT ord, md5(CASE WHEN ord % 2 = 0 THEN {_appended} ELSE regexp_replace(body, '\\s+$', '') || chr(10) || chr(10) || '## Relacionado <!-- quill-relink -->' || chr(10) || '- [[a]]' || chr(10) || '- [[' || slug || ']]' || chr(10) END) AS page FROM pages_v")
def x_managed_section(spark, d):
    """The managed section is appended, or takes the place of an older one (odd pages)."""
    p = views.pages(spark, d)
    old = F.concat("body", F.lit("\n\n## Relacionado <!-- quill-relink -->\n- [[old]]\n"))
    return p.select("ord", F.md5(T.managed_section(F.when(F.col("ord") % 2 == 0, F.col("body")).otherwise(old), F.array(F.lit("a"), F.col("slug")))).alias("page"))


@_pages_query("v_resolve_tiers", f"SELECT ord, CASE WHEN ord % 5 = 0 THEN 'sensitive' WHEN ord % 3 = 0 THEN 'file' WHEN summary <> '' THEN 'description' ELSE 'unresolved' END AS method FROM pages_v")
def v_resolve_tiers(spark, d):
    from quillspark.plans.models import resolve

    i = F.col("ord")
    e = views.pages(spark, d).select("ord", F.when(i % 3 == 0, F.col("body")).alias("file_text"), F.lit(None).cast("string").alias("tool_text"), F.when(i % 5 == 0, F.concat("summary", F.lit(" CPF Telefone"))).otherwise(F.col("summary")).alias("description"))
    return resolve(e).select("ord", "method")


@_pages_query("q_boot", "SELECT project, 'page' AS part, count(*) AS n FROM pages_v GROUP BY project")
def q_boot(spark, d):
    """Page counts a session start shows for its project."""
    return views.pages(spark, d).groupBy("project").agg(F.count(F.lit(1)).alias("n")).select("project", F.lit("page").alias("part"), "n")


# code listings
def _paths_query(name: str, sql: str):
    return query(name, f"WITH {D.PATHS} {sql}")


_suffix = "lower(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]+)$', 1))"
_code = f"(SELECT path, CASE WHEN len(p) > 2 AND p[1] IN ({D.quoted(T.CONTAINER_DIRS)}) THEN p[1] || '/' || p[2] ELSE p[1] END AS module FROM (SELECT path, string_split(path, '/') AS p FROM paths_v WHERE {_suffix} IN ({D.quoted(T.CODE_EXT)})) WHERE len(p) >= 2)"


@_paths_query("a_ext_counts", f"SELECT {_suffix} AS ext, count(*) AS n FROM paths_v GROUP BY 1 ORDER BY n DESC, ext LIMIT 12")
def a_ext_counts(spark, d):
    return views.paths(spark, d).groupBy(T.suffix(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ext").limit(12)


@_paths_query("a_dir_counts", "SELECT CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '(root)' END AS dir, count(*) AS n FROM paths_v GROUP BY 1 ORDER BY n DESC, dir LIMIT 50")
def a_dir_counts(spark, d):
    top = F.when(F.col("path").contains("/"), F.get(F.split("path", "/"), F.lit(0))).otherwise("(root)")
    return views.paths(spark, d).groupBy(top.alias("dir")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dir").limit(50)


@_paths_query("a_modules", f", g AS (SELECT module, count(*) AS n_files FROM {_code} GROUP BY 1 HAVING count(*) >= 3) SELECT module, n_files, (SELECT count(*) FROM g) AS qualified FROM g ORDER BY n_files DESC, module LIMIT 80")
def a_modules(spark, d):
    return R.modules(views.paths(spark, d))


@_paths_query("a_module_digest", f"SELECT module, place::INT AS place, path FROM (SELECT module, path, row_number() OVER (PARTITION BY module ORDER BY path) AS place FROM {_code}) WHERE place <= 80")
def a_module_digest(spark, d):
    return R.module_digest(views.paths(spark, d))
