"""Queries over the text, path and date expressions, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from quillspark.durable import table
from quillspark.functions import scrub as S
from quillspark.functions import text as T
from quillspark.plans import duck as D
from quillspark.plans import views
from quillspark.plans.registry import query

NOW = "2024-01-10 00:00:00"


def _documents(key_: str, sql: str, **columns) -> None:
    """A projection of documents: doc_id and the given columns (functions: columns need a session)."""

    @query(key_, sql)
    def run(spark, d):
        return table(spark, d, "documents").select("doc_id", *[c().alias(k) for k, c in columns.items()])


def _paths(key_: str, sql: str, **columns) -> None:
    @query(key_, f"WITH {D.PATHS} {sql}")
    def run(spark, d):
        return views.paths(spark, d).select("page_id", *[c().alias(k) for k, c in columns.items()])


def _pages(key_: str, sql: str, *keep: str, **columns) -> None:
    @query(key_, f"WITH {D.PAGES} {sql}")
    def run(spark, d):
        return views.pages(spark, d).select("ord", *keep, *[c().alias(k) for k, c in columns.items()])


text = lambda: F.col("text")
title = lambda: F.substring("text", 1, 60)
lang = lambda: F.col("lang")
source = lambda: F.col("source")
join = lambda c, s=",": F.array_join(c, s)

# tokenizers and slugs
_documents("x_recall_tokens", f"SELECT doc_id, array_to_string({D.recall('text')}, ',') AS tokens FROM documents", tokens=lambda: join(T.recall_tokens(text())))
_documents("x_garden_tokens", f"SELECT doc_id, array_to_string({D.garden('text')}, ',') AS tokens FROM documents", tokens=lambda: join(T.garden_tokens(text())))
_documents("x_kebab", f"SELECT doc_id, md5({D.kebab('text')}) AS kebab FROM documents", kebab=lambda: F.md5(T.kebab(text())))
_documents("x_slugify", f"SELECT doc_id, coalesce(nullif({D.kebab('text')}[1:40], ''), 'untitled') AS slug FROM documents", slug=lambda: T.slugify(text()))
_chain = f"coalesce(nullif({D.kebab('CASE WHEN doc_id % 3 = 0 THEN left(text, 60) END')}, ''), nullif({D.kebab('CASE WHEN doc_id % 3 = 1 THEN source END')}, ''), nullif({D.kebab('left(CASE WHEN doc_id % 7 <> 0 THEN text END, 50)')}, ''), 'note-' || left(md5(text), 8))"
_documents(
    "x_slug_chain",
    f"SELECT doc_id, trim(({_chain})[1:60], '-') AS slug FROM documents",
    slug=lambda: T.slug_chain(F.when(F.col("doc_id") % 3 == 0, title()), F.when(F.col("doc_id") % 3 == 1, source()), F.when(F.col("doc_id") % 7 != 0, text()), F.md5("text")),
)
_pages("x_page_tokens", f"SELECT ord, array_to_string({D.recall(chr(39).join(['title || ', ' ', ' || replace(slug, ', '-', ', ', ' ', ') || ', ' ', ' || array_to_string(tags, ', ' ', ') || ', ' ', ' || summary']))}, ',') AS tokens FROM pages_v", tokens=lambda: join(T.recall_tokens(T.page_text(F.col("title"), F.col("slug"), F.col("tags"), F.col("summary")))))
_parts = "list_filter(string_split(slug, '-'), lambda p: p <> '')"
_pages("x_slug_prefix", f"SELECT ord, CASE WHEN len({_parts}) >= 3 AND ({_parts})[1] NOT IN ({D.quoted(T.GENERIC_SEGMENTS)}) THEN array_to_string(({_parts})[1:3], '-') END AS prefix FROM pages_v", prefix=lambda: T.slug_prefix(F.col("slug")))
_pages("x_index_line", "SELECT ord, '- ' || slug || ' [' || kind || '] - ' || title || ': ' || left(summary, 80) AS line FROM pages_v", line=lambda: F.concat(F.lit("- "), "slug", F.lit(" ["), "kind", F.lit("] - "), "title", F.lit(": "), F.substring("summary", 1, 80)))
_pages("x_embed_text", "SELECT ord, md5(left(title || chr(10) || array_to_string(tags, ' ') || chr(10) || summary || chr(10) || body, 2000)) AS input FROM pages_v", input=lambda: F.md5(F.substring(F.concat_ws("\n", "title", F.array_join("tags", " "), "summary", "body"), 1, 2000)))
_pages("x_summary", "SELECT ord, summary FROM pages_v", "summary")

# redaction
_pii = "text"
for _p, _r in S.PII:
    _pii = f"regexp_replace({_pii}, '{_p}', '{_r}', 'g')"
_all = _pii
for _p, _r in S.SECRETS:
    _q = _p.replace("'", "''")
    _all = f"regexp_replace({_all}, '{_q}', '{_r.replace('$1', chr(92) + '1')}', 'g')"
_documents("x_scrub_pii", f"SELECT doc_id, md5({_pii}) AS scrubbed FROM documents", scrubbed=lambda: F.md5(S.scrub_pii(text())))
_documents("x_scrub_full", f"SELECT doc_id, md5({_all}) AS scrubbed, length({_all}) AS n FROM documents", scrubbed=lambda: F.md5(S.scrub(text())), n=lambda: F.length(S.scrub(text())))
_found = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{r}' END" for p, r in S.PII)
_documents("x_detect_pii", f"SELECT doc_id, array_to_string(list_filter([{_found}], lambda x: x IS NOT NULL), ',') AS kinds FROM documents", kinds=lambda: join(S.detect_pii(text())))
_hints = " + ".join(f"(contains(lower(text || CASE WHEN doc_id % 5 = 0 THEN ' CPF e Telefone' ELSE '' END), '{h}'))::INT" for h in S.PII_HINTS)
_documents("f_is_sensitive", f"SELECT doc_id, ({_hints}) >= 2 AS sensitive FROM documents", sensitive=lambda: S.is_sensitive(F.concat("text", F.when(F.col("doc_id") % 5 == 0, " CPF e Telefone").otherwise(""))))

# cleaning
_wrapped = "CASE doc_id % 4 WHEN 0 THEN '```markdown' || chr(10) || text || chr(10) || '```' WHEN 1 THEN '---' || chr(10) || 'title: a: b' || chr(10) || '- item' || chr(10) || 'kind: doc' || chr(10) || '---' || chr(10) || chr(10) || text WHEN 2 THEN 'Here is the body:' || chr(10) || '---' || chr(10) || chr(10) || '## Head' || chr(10) || text ELSE text END"
_i4 = lambda: F.col("doc_id") % 4
_wrap = lambda: F.when(_i4() == 0, F.concat(F.lit("```markdown\n"), text(), F.lit("\n```"))).when(_i4() == 1, F.concat(F.lit("---\ntitle: a: b\n- item\nkind: doc\n---\n\n"), text())).when(_i4() == 2, F.concat(F.lit("Here is the body:\n---\n\n## Head\n"), text())).otherwise(text())
_bare = f"CASE doc_id % 4 WHEN 2 THEN '## Head' || chr(10) || text ELSE text END"
_documents("x_clean_body", f"SELECT doc_id, md5({D.strip(_bare)}) AS body FROM documents", body=lambda: F.md5(T.clean_body(_wrap())))
_cut = "CASE WHEN strpos(x, '## ') > 1 THEN substr(x, strpos(x, '## ')) ELSE x END"
_documents("x_sanitize", f"SELECT doc_id, md5({D.strip(f'left({_cut}, 8000)')}) AS body FROM (SELECT doc_id, {D.strip(_bare)} AS x FROM documents)", body=lambda: F.md5(T.sanitize_body(_wrap(), 8000)))

@query("x_frontmatter", "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'a: b' END AS title, CASE doc_id % 4 WHEN 1 THEN 'doc' END AS kind, md5(CASE doc_id % 4 WHEN 0 THEN '```markdown' || chr(10) || text || chr(10) || '```' WHEN 2 THEN 'Here is the body:' || chr(10) || '---' || chr(10) || chr(10) || '## Head' || chr(10) || text ELSE text END) AS body FROM documents")
def x_frontmatter(spark, d):
    w = table(spark, d, "documents").select("doc_id", _wrap().alias("w"))
    meta = T.frontmatter(F.col("w"))
    return w.select("doc_id", F.try_element_at(meta, F.lit("title")).alias("title"), F.try_element_at(meta, F.lit("kind")).alias("kind"), F.md5(T.strip_frontmatter(F.col("w"))).alias("body"))


_documents("x_strip_think", f"SELECT doc_id, md5({D.strip('text')}) AS body FROM documents", body=lambda: F.md5(T.strip_think(F.concat(F.lit("<think>"), F.substring("text", 1, 20), F.lit("\n</think>"), text()))))
_noisy = lambda: F.concat(F.lit("<system-reminder>drop "), F.substring("text", 1, 9), F.lit("\n</system-reminder>"), text(), F.lit("<command-name />\n\n\n\n data:image/png;base64,AAAA"), F.repeat(F.lit("QUJD"), 60))
_documents("x_clean_text", f"SELECT doc_id, md5(regexp_replace(regexp_replace(text || chr(10) || chr(10) || ' [data]', '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS body FROM documents", body=lambda: F.md5(T.clean_text(_noisy())))
_documents(
    "u_dedup_blocks",
    "WITH b AS (SELECT doc_id, list_distinct(string_split(text, chr(10))) AS u, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, md5(array_to_string(list_filter(l, lambda x, i: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) <= 40 OR list_position(list_transform(l, lambda y: regexp_replace(y, '^\\s+|\\s+$', '', 'g')), regexp_replace(x, '^\\s+|\\s+$', '', 'g')) = i), chr(10) || chr(10))) AS body FROM b",
    body=lambda: F.md5(T.dedup_blocks(F.replace(text(), F.lit("\n"), F.lit("\n\n")))),
)
_documents("x_excerpt", "SELECT doc_id, md5(CASE WHEN length(text) <= 501 THEN text ELSE left(text, 250) || chr(10) || chr(10) || '[... trecho do meio omitido ...]' || chr(10) || chr(10) || right(text, 250) END) AS body FROM documents", body=lambda: F.md5(T.excerpt(text(), 501)))
_marker = "[... beginning of raw omitted; latest excerpt follows ...]"
_documents("x_raw_tail", f"SELECT doc_id, md5(CASE WHEN length({D.strip('text')}) > 400 THEN '{_marker}' || chr(10) || chr(10) || right({D.strip('text')}, {400 - len(_marker) - 2}) ELSE nullif({D.strip('text')}, '') END) AS tail FROM documents", tail=lambda: F.md5(T.raw_tail(text(), 400)))
_flat = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_documents("x_oneline", f"SELECT doc_id, CASE WHEN length({_flat}) <= 80 THEN {_flat} ELSE rtrim(left({_flat}, 79)) || '…' END AS line FROM documents", line=lambda: T.oneline(text(), 80))
_documents("x_state_key", "SELECT doc_id, left(regexp_replace(left(text, 100), '[^A-Za-z0-9_-]', '-', 'g'), 80) AS key FROM documents", key=lambda: T.state_key(F.substring("text", 1, 100)))
_documents("x_desc_page", f"SELECT doc_id, md5({D.strip('text')} || chr(10) || chr(10) || '[Abrir o documento](https://x/' || doc_id || ')') AS page FROM documents", page=lambda: F.md5(F.concat_ws("\n", F.regexp_replace("text", r"^\s+|\s+$", ""), F.concat(F.lit("\n[Abrir o documento](https://x/"), F.col("doc_id").cast("string"), F.lit(")")))))
_tags_sql = "[lang, source, 'Tag', upper(lang), 'x', left(text, 12), source || ' two', 'n1', 'n2', 'n3', 'n4', 'n5']"
_tags = lambda: F.array(lang(), source(), F.lit("Tag"), F.upper("lang"), F.lit("x"), F.substring("text", 1, 12), F.concat("source", F.lit(" two")), *map(F.lit, ["n1", "n2", "n3", "n4", "n5"]))
_documents("n_clean_tags", f"WITH t AS (SELECT doc_id, list_filter(list_transform({_tags_sql}, lambda x: {D.kebab('trim(x)')}), lambda x: length(x) >= 2 AND x NOT IN ({D.quoted(T.TAG_JUNK)})) AS l FROM documents) SELECT doc_id, array_to_string((list_filter(l, lambda x, i: list_position(l, x) = i))[1:8], ',') AS tags FROM t", tags=lambda: join(T.clean_tags(_tags())))
_documents("n_merge_sources", "WITH t AS (SELECT doc_id, [source, lang, 'doc:' || (doc_id % 3)] || ['doc:' || (doc_id % 2), source] AS l FROM documents) SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS sources FROM t", sources=lambda: join(F.array_distinct(F.concat(F.array(source(), lang(), F.concat(F.lit("doc:"), (F.col("doc_id") % 3).cast("string"))), F.array(F.concat(F.lit("doc:"), (F.col("doc_id") % 2).cast("string")), source())))))
_documents("m_hash16", "SELECT doc_id, sha256(text)[1:16] AS h FROM documents", h=lambda: F.substring(F.sha2("text", 256), 1, 16))
_documents("m_hash12", "SELECT doc_id, source || ':' || doc_id || ':' || sha256(text)[1:12] AS key, sha256(doc_id::VARCHAR)[1:8] AS sid8 FROM documents", key=lambda: F.concat_ws(":", "source", "doc_id", F.substring(F.sha2("text", 256), 1, 12)), sid8=lambda: F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8))
_documents(
    "sink_raw_name",
    f"SELECT doc_id, '2024-01-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || '--' || source || '--' || coalesce(nullif({D.kebab('left(text, 60)')}[1:32], ''), 'untitled') || '--' || sha256(doc_id::VARCHAR)[1:8] || '.md' AS raw_name FROM documents",
    raw_name=lambda: F.concat(F.concat_ws("--", F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")), "source", T.slugify(title(), 32), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8)), F.lit(".md")),
)
_proj = f"coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN {D.kebab('source')} END, ''), nullif(CASE WHEN {D.kebab('p')} IN ({D.quoted(T.PROJECT_JUNK)}) THEN '' ELSE {D.kebab('p')} END, ''), 'home')"
_proposed = lambda: F.when(F.col("doc_id") % 3 == 1, "kebab-or-null").otherwise(F.concat("lang", F.lit(" Area")))
_documents("x_resolve_project", f"SELECT doc_id, {_proj} AS project FROM (SELECT *, CASE WHEN doc_id % 3 = 1 THEN 'kebab-or-null' ELSE lang || ' Area' END AS p FROM documents)", project=lambda: F.coalesce(F.when(F.col("doc_id") % 3 == 0, T.kebab(source())), F.nullif(F.when(T.kebab(_proposed()).isin(T.PROJECT_JUNK), "").otherwise(T.kebab(_proposed())), F.lit("")), F.lit("home")))

# paths
_paths("x_encode_path", "SELECT page_id, regexp_replace(path, '[^A-Za-z0-9]', '-', 'g') AS encoded FROM paths_v", encoded=lambda: T.encode_path(F.col("path")))
_paths("x_uri_path", "SELECT page_id, url_decode(url_path) AS path FROM paths_v", path=lambda: F.col("url_path"))
_paths("x_basename", "SELECT page_id, string_split(path, '/')[-1] AS name FROM paths_v", name=lambda: T.basename(F.col("path")))
_suffix = "lower(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]+)$', 1))"
_paths("f_is_content", f"SELECT page_id, {_suffix} IN ({D.quoted(T.CONTENT_EXT)}) AS content FROM paths_v", content=lambda: T.suffix(F.col("path")).isin(T.CONTENT_EXT))
_paths("f_backup", "SELECT page_id, regexp_matches(string_split(path, '/')[-1], '(?i)(\\.(backup|bak|orig|old)\\b|~$)') AS backup FROM paths_v", backup=lambda: T.basename(F.col("path")).rlike(T.BACKUP))
_paths("f_within", "SELECT page_id, path = 'docs' OR starts_with(path, 'docs/') AS inside FROM paths_v", inside=lambda: T.within(F.col("path"), "docs/"))
_module = f"CASE WHEN len(p) >= 2 THEN array_to_string(p[1:CASE WHEN len(p) > 2 AND p[1] IN ({D.quoted(T.CONTAINER_DIRS)}) THEN 2 ELSE 1 END], '/') END"
_paths("x_module_key", f"SELECT page_id, {_module} AS module FROM (SELECT *, string_split(path, '/') AS p FROM paths_v)", module=lambda: T.module_key(F.col("path")))
_paths("x_project_key", f"SELECT page_id, nullif({D.kebab(chr(39).join(['string_split(path, ', '/', ')[-1]']))}, '') AS key FROM paths_v", key=lambda: F.nullif(T.kebab(T.basename(F.col("path"))), F.lit("")))
_paths("x_normalize_key", f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN nullif({D.kebab(chr(39).join(['string_split(path, ', '/', ')[-1]']))}, '') ELSE nullif({D.kebab(chr(39).join(['replace(path, ', '/', ', ', ' ', ')']))}, '') END AS key FROM paths_v", key=lambda: T.normalize_key(F.when(F.col("page_id") % 2 == 0, F.concat("path", F.lit("/"))).otherwise(F.replace("path", F.lit("/"), F.lit(" ")))))


def _scan(name: str, ext: list[str], backups: bool) -> None:
    no_backup = "" if backups else "AND NOT regexp_matches(string_split(path, '/')[-1], '(?i)(\\.(backup|bak|orig|old)\\b|~$)')"

    @query(name, f"WITH {D.PATHS} SELECT DISTINCT path FROM paths_v WHERE ({_suffix} IN ({D.quoted(ext)}) OR {len(ext)} = 0) AND len(list_intersect(string_split(path, '/'), [{D.quoted(T.SKIP_DIRS)}])) = 0 {no_backup}")
    def run(spark, d):
        p = views.paths(spark, d).filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, T.SKIP_DIRS))))
        if ext:
            p = p.filter(T.suffix(F.col("path")).isin(ext))
        if not backups:
            p = p.filter(~T.basename(F.col("path")).rlike(T.BACKUP))
        return p.select("path").distinct()


_scan("scan_docs_filter", T.CONTENT_EXT, False)
_scan("scan_repo_files", [], True)


@query("x_extract_html", "SELECT page_id, md5(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g')), '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS text FROM pages")
def x_extract_html(spark, d):
    """Plain text of a page: scripts, styles and tags off, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    return table(spark, d, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(bare, r"\s+", " "))).alias("text"))


# dates
@query("d_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS from_ms, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS from_s FROM events")
def d_iso(spark, d):
    e = table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    iso = lambda v: F.date_format(F.when(v > 1e12, F.timestamp_millis(v)).otherwise(F.timestamp_seconds(v)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select("event_id", iso(F.col("ms")).alias("from_ms"), iso(F.floor(F.col("ms") / 1000)).alias("from_s"))


_mixed = lambda: F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.lit("soon"))
_mixed_sql = "CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d') ELSE 'soon' END"


@query("d_date_only", f"SELECT event_id, strftime(try_cast(left({_mixed_sql}, 10) AS DATE), '%Y-%m-%d') AS date FROM events")
def d_date_only(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(F.try_to_timestamp(F.substring(_mixed(), 1, 10), F.lit("yyyy-MM-dd")), "yyyy-MM-dd").alias("date"))


@query("f_since", f"SELECT event_id FROM events WHERE coalesce(try_cast(left({_mixed_sql}, 10) AS DATE) >= DATE '2024-01-05', true)")
def f_since(spark, d):
    date = F.to_date(F.try_to_timestamp(F.substring(_mixed(), 1, 10), F.lit("yyyy-MM-dd")))
    return table(spark, d, "events").filter(F.coalesce(date >= F.lit("2024-01-05").cast("date"), F.lit(True))).select("event_id")


def _fresh(name: str, unknown: bool) -> None:
    @query(name, f"SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END >= TIMESTAMP '{NOW}' - INTERVAL 5 DAY, {unknown}) AS fresh FROM events")
    def run(spark, d):
        known = F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp"))
        return table(spark, d, "events").select("event_id", F.coalesce(known >= F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 5 DAY"), F.lit(unknown)).alias("fresh"))


_fresh("f_fresh", False)
_fresh("f_fresh_lenient", True)


@query("f_newer", f"SELECT event_id, ts > TIMESTAMP '{NOW}' - to_hours(event_id % 500) AS newer FROM events")
def f_newer(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("ts").cast("timestamp") > F.lit(NOW).cast("timestamp") - F.make_interval(hours=(F.col("event_id") % 500).cast("int"))).alias("newer"))


def _epoch_ms(ts, zoned=False):
    """Milliseconds since 1970, whatever the session's zone is, as DuckDB's epoch_ms has them: rounded, halves away from
    zero, and none of the infinite times."""
    seconds = F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    micros = F.floor(F.extract(F.lit("SECOND"), ts) * 1000000)
    whole = F.unix_millis(ts) if zoned else seconds * 1000 + F.floor(micros / 1000)
    rest = F.pmod(F.unix_micros(ts) if zoned else micros, F.lit(1000))
    infinite = ((whole == 9223372036854775) & (rest == 807)) | ((whole == -9223372036854776) & (rest == 193))
    return F.when(~infinite, whole + F.when((rest > 500) | ((rest == 500) & (whole >= 0)), 1).otherwise(0))


@query("d_age_hours", f"SELECT event_id, coalesce(floor((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END)) / 3600000.0), 0)::BIGINT AS hours FROM events")
def d_age_hours(spark, d):
    """Times without zone are wall clock and times with one are instants, so the session's time zone plays no part."""
    events = table(spark, d, "events")
    zoned = events.schema["ts"].dataType == TimestampType()
    ts = F.col("ts") if zoned else F.col("ts").cast("timestamp_ntz")
    known = F.when(F.coalesce(F.col("event_id") % 5, F.lit(1)) != 0, _epoch_ms(ts, zoned))
    ms = _epoch_ms(F.lit(NOW).cast("timestamp_ntz")) - known
    return events.select("event_id", F.coalesce(F.floor(ms / 3600000), F.lit(0)).cast("long").alias("hours"))


@query("o_mixed_key", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_id % 4 WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 0 END, CASE WHEN event_id % 4 < 2 THEN epoch_ms(ts) END NULLS FIRST, CASE event_id % 4 WHEN 2 THEN event_type END NULLS FIRST, event_id) AS place FROM events")
def o_mixed_key(spark, d):
    """Mixed-type order: numbers and dates, then other strings, then missing."""
    from pyspark.sql import Window

    k = F.col("event_id") % 4
    w = Window.partitionBy("user_id").orderBy(F.when(k == 3, 2).when(k == 2, 1).otherwise(0), F.when(k < 2, F.unix_millis(F.col("ts").cast("timestamp"))).asc_nulls_first(), F.when(k == 2, F.col("event_type")).asc_nulls_first(), "event_id")
    return table(spark, d, "events").select("event_id", F.row_number().over(w).alias("place"))


@query("x_condense_tool", "SELECT event_id, CASE event_type WHEN 'click' THEN '_ran: ' || props || '_' WHEN 'view' THEN '_read: f' || user_id || '.py_' WHEN 'error' THEN '_searched: ' || props || '_' WHEN 'signup' THEN '_updated todo list_' ELSE '_tool: purchase — ' || props || '_' END AS line FROM events")
def x_condense_tool(spark, d):
    from quillspark.sources.sessions import condense_tool

    e = table(spark, d, "events")
    names = {"click": "Bash", "view": "Read", "error": "Grep", "signup": "TodoWrite"}
    name = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()], F.lit("mcp__shop__purchase"))
    props = F.when(F.col("event_type").isin("click", "error", "purchase"), F.col("props"))
    args = F.create_map(F.lit("command"), props, F.lit("pattern"), props, F.lit("query"), props, F.lit("file_path"), F.concat(F.lit("/a/f"), F.col("user_id").cast("string"), F.lit(".py")))
    return e.select("event_id", condense_tool(name, args).alias("line"))


# vectors
@query("src_vectors", "SELECT vec_id, len(embedding)::INT AS dim FROM embeddings WHERE len(embedding) > 0")
def src_vectors(spark, d):
    return views.vectors(spark, d).select("vec_id", F.size("vec").alias("dim"))


@query("m_l2_normalize", "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS total FROM (SELECT vec_id, v, coalesce(nullif(sqrt(list_dot_product(v, v)), 0), 1) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings))")
def m_l2_normalize(spark, d):
    from quillspark.operators.rank import normalize

    v = views.vectors(spark, d).select("vec_id", normalize(F.transform("vec", lambda x: x * 3)).alias("u"))
    return v.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("a_vector_meta", "SELECT len(embedding)::INT AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def a_vector_meta(spark, d):
    return views.vectors(spark, d).groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


@query("m_jaccard", f"WITH t AS (SELECT doc_id, {D.garden('left(text, 200)')} AS a, {D.garden('right(text, 200)')} AS b FROM documents) SELECT doc_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS jaccard FROM t")
def m_jaccard(spark, d):
    a, b = T.garden_tokens(F.substring("text", 1, 200)), T.garden_tokens(F.right("text", F.lit(200)))
    t = table(spark, d, "documents").select("doc_id", a.alias("a"), b.alias("b"))
    return t.select("doc_id", F.round(F.when((F.size("a") == 0) | (F.size("b") == 0), 0.0).otherwise(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))), 6).alias("jaccard"))


# replies of a model and nested settings, made from each document
def _reply():
    i = F.col("doc_id").cast("string")
    whole = F.concat(F.lit('{"id": '), i, F.lit(', "in": {"k": "v"}}'))
    part = F.when(F.col("doc_id") % 5 == 0, whole).when(F.col("doc_id") % 5 == 1, F.concat(F.lit('{"id": '), i)).when(F.col("doc_id") % 5 == 2, F.col("source")).when(F.col("doc_id") % 5 == 3, F.concat(F.lit("} "), whole, F.lit(' {"b": 1}'))).otherwise(F.concat(F.lit("{bad "), i, F.lit("}")))
    return F.concat(F.lit("Here it is:\n```json\n"), part, F.lit("\n```\ntail {x}"))


_documents("x_extract_json", """SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 3) THEN '{"id": ' || doc_id || ', "in": {"k": "v"}}' END AS found FROM documents""", found=lambda: T.extract_json(_reply()))


def _merged():
    i = F.col("doc_id").cast("string")
    left = F.create_map(F.lit("doc"), F.create_map(F.lit("id"), i, F.lit("lang"), F.coalesce("lang", F.lit("?"))), F.lit("left"), F.create_map(F.lit("k"), F.lit("1")))
    right = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("doc"), F.create_map(F.lit("lang"), F.lit("xx")))).when(F.col("doc_id") % 3 == 1, F.create_map(F.lit("right"), F.create_map(F.lit("s"), F.coalesce("source", F.lit("?")))))
    flat = F.flatten(F.transform(F.map_entries(T.merge_nested(left, right)), lambda e: F.transform(F.map_entries(e["value"]), lambda x: F.concat_ws(".", e["key"], F.concat_ws("=", x["key"], x["value"])))))
    return F.array_join(F.array_sort(flat), ",")


_documents("n_map_merge", "SELECT doc_id, 'doc.id=' || doc_id || ',doc.lang=' || CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE coalesce(lang, '?') END || ',left.k=1' || CASE WHEN doc_id % 3 = 1 THEN ',right.s=' || coalesce(source, '?') ELSE '' END AS merged FROM documents", merged=_merged)
