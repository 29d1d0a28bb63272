"""DuckDB spellings of the text expressions, for the oracle SQL."""

from __future__ import annotations

from quillspark.functions import text as T


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def kebab(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '-', 'g'), '-')"


def recall(x: str) -> str:
    gap = T.RECALL_GAP.replace("'", "''")
    return f"list_sort(list_distinct(list_transform(list_filter(string_split_regex(lower(coalesce({x}, '')), '{gap}'), lambda w: length(w) >= 4 AND w NOT IN ({quoted(T.STOP)})), lambda w: w[1:5])))"


def garden(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda w: length(w) >= 3)))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def prose(x: str) -> str:
    line = "s <> '' AND NOT regexp_matches(s, '^(#|>|- |\\* |\\+ |[0-9]+[.)] )')"
    paras = f"list_filter(list_transform(string_split(coalesce({x}, ''), chr(10) || chr(10)), lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda s: ltrim(s)), lambda s: {line}), ' ')), lambda s: s <> '')"
    return f"trim(regexp_replace(coalesce(({paras})[1], ''), '\\s+', ' ', 'g'))"


#: CTEs that end in summaries(id, summary), from a CTE bodies(id, body).
SUMMARIES = f"""flats AS (SELECT id, {prose('body')} AS flat FROM bodies),
pieced AS (SELECT id, flat, regexp_extract_all(left(flat, 281), '[^.!?]*[.!?]') AS pieces FROM flats),
counted AS (SELECT id, flat, pieces, list_transform(range(1, len(pieces) + 1), lambda i: list_sum(list_transform(pieces[1:i], lambda s: length(s)))) AS ends FROM pieced),
fitted AS (SELECT id, flat, array_to_string(list_transform(pieces[1:len(list_filter(ends, lambda e: e <= 280))], lambda s: trim(s)), ' ') AS whole FROM counted),
summaries AS (SELECT id, CASE WHEN length(flat) <= 280 THEN flat WHEN whole <> '' THEN whole
  ELSE regexp_replace(regexp_replace(left(flat, 280), '^(.*) [^ ]*$', '\\1'), '[,;:—-]+$', '') || '…' END AS summary FROM fitted)"""

#: The derived page table (see views.pages) as CTEs.
PAGES = f"""bodies AS (SELECT doc_id AS id, text AS body FROM documents),
{SUMMARIES},
pages_v AS (SELECT d.doc_id AS ord, left(text, 60) AS title,
  {kebab('left(text, 60)')} || '-' || d.doc_id AS slug, [lang, source] AS tags,
  CASE lang WHEN 'en' THEN 'topics' WHEN 'de' THEN 'entities' ELSE 'decisions' END AS section,
  source AS project,
  CASE doc_id % 5 WHEN 0 THEN 'merged' WHEN 1 THEN 'session' WHEN 2 THEN 'doc' WHEN 3 THEN 'code' ELSE 'manual' END AS kind,
  CASE WHEN doc_id % 6 = 0 THEN 'superseded' WHEN doc_id % 6 = 1 THEN 'draft' ELSE 'current' END AS status,
  CASE doc_id % 4 WHEN 0 THEN ['doc:' || doc_id, 'claude:' || doc_id] WHEN 1 THEN ['analyze:' || doc_id] WHEN 2 THEN ['claude:' || doc_id] ELSE ['remember:' || doc_id, 'doc:' || doc_id] END AS sources,
  s.summary AS summary, text AS body
  FROM documents d JOIN summaries s ON s.id = d.doc_id)"""

#: Sessions folded from conversations (see views.sessions).
SESSIONS = """turns AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations),
sessions_v AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'cursor' END AS source,
  'sid-' || conv_id AS sid, '/w/p' || (conv_id % 7) AS cwd,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id), '%Y-%m-%dT%H:%M:%SZ') AS date,
  left(string_split(coalesce(first(text ORDER BY turn) FILTER (role = 'user' AND text <> ''), '(sem título)'), chr(10))[1], 120) AS title,
  string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) FILTER (text <> '') AS text,
  count(*) AS n_turns
  FROM turns GROUP BY conv_id)"""

#: File paths derived from pages (see views.paths).
PATHS = """paths_v AS (SELECT page_id, '/' || array_to_string(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')[2:], '/') AS url_path,
  CASE page_id % 8 WHEN 0 THEN 'src/m' || (page_id % 9) || '/file' || page_id || '.py'
    WHEN 1 THEN 'packages/p' || (page_id % 5) || '/lib/f' || page_id || '.ts'
    WHEN 2 THEN 'docs/guide' || page_id || '.md' WHEN 3 THEN 'node_modules/x/f' || page_id || '.js'
    WHEN 4 THEN 'README' || page_id || '.md' WHEN 5 THEN 'core/c' || page_id || '.go'
    WHEN 6 THEN 'docs/old/slide' || page_id || '.pptx.bak' ELSE 'assets/img' || page_id || '.PNG' END AS path FROM pages)"""

#: Pages whose body ends in links (see views.linked): one valid target, one alias, one unknown.
LINKS = """linked_v AS (SELECT p.ord, p.slug, p.section, p.project, p.title, p.tags,
  CASE WHEN p.ord % 2 = 0 THEN 'See [[' || t.slug || ']] and [[' || t.slug || '|alias]] or [[No Such Page ' || p.ord || ']].'
    WHEN p.ord % 3 = 0 THEN 'Loop [[' || p.slug || '#part]].' ELSE 'No links here.' END AS body
  FROM pages_v p JOIN pages_v t ON t.ord = (p.ord * 7) % (SELECT count(*) FROM pages_v))"""
