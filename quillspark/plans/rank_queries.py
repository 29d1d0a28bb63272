"""Queries over rankings, similarity, clusters and links, and the model pipelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.durable import folder, materialize, table
from quillspark.functions import text as T
from quillspark.operators import graph as G
from quillspark.operators import inverted
from quillspark.operators import rank as K
from quillspark.operators import simjoin as J
from quillspark.plans import duck as D
from quillspark.plans import views
from quillspark.plans.registry import query
from quillspark.streaming.recall import recall_sessions

COSINE, JACCARD = 0.4, 0.4
#: Places of each ranking that a fusion of up to five results looks at.
POOL = 20


# lexical search: benchmark texts as prompts, pages as documents
def _lexical_inputs(spark, d):
    p = views.pages(spark, d)
    docs = p.select(F.col("ord").alias("doc"), T.recall_tokens(T.page_text(F.col("title"), F.col("slug"), F.col("tags"), F.col("summary"))).alias("tokens"))
    prompts = table(spark, d, "benchmark").select(F.col("item_id").alias("prompt"), T.recall_tokens(F.col("text")).alias("tokens"))
    return docs, prompts


_page_tokens = D.recall("title || ' ' || replace(slug, '-', ' ') || ' ' || array_to_string(tags, ' ') || ' ' || summary")


def _lexical_sql(overlap: int, jaccard: float, asked: int, source: str = "SELECT item_id AS prompt, text FROM benchmark") -> str:
    return f"""{D.PAGES},
docs AS (SELECT ord AS doc, tokens FROM (SELECT ord, {_page_tokens} AS tokens FROM pages_v) WHERE len(tokens) > 0),
prompts AS (SELECT prompt, tokens FROM (SELECT prompt, {D.recall('text')} AS tokens FROM ({source})) WHERE len(tokens) >= {asked}),
idx AS (SELECT doc, len(tokens) AS size, unnest(tokens) AS t FROM docs),
df AS (SELECT t, ln(1 + ((SELECT count(*) FROM docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM idx GROUP BY t),
asks AS (SELECT prompt, len(tokens) AS asked, unnest(tokens) AS t FROM prompts),
scored AS (SELECT prompt, doc, count(*) AS overlap, any_value(size) AS size, any_value(asked) AS asked, round(sum(idf), 6) AS score FROM asks JOIN idx USING (t) JOIN df USING (t) GROUP BY prompt, doc),
lex AS (SELECT prompt, doc, score, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, doc) AS rank FROM scored WHERE overlap >= {overlap} AND overlap / (size + asked - overlap) >= {jaccard})"""


_lex = _lexical_sql(2, 0.05, 2)
_loose = _lexical_sql(1, 0.0, 1)


@query("q_lexical_rank", f"WITH {_lex} SELECT prompt, doc, score, rank::INT AS rank FROM lex WHERE rank <= 5")
def q_lexical_rank(spark, d):
    return K.lexical(*_lexical_inputs(spark, d), top=5)


@query("a_doc_freq", f"WITH {D.PAGES}, t AS (SELECT unnest({_page_tokens}) AS stem FROM pages_v) SELECT stem, count(*) AS df FROM t GROUP BY 1")
def a_doc_freq(spark, d):
    docs, _ = _lexical_inputs(spark, d)
    return docs.select(F.explode("tokens").alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("df"))


@query("q_search", f"WITH {_loose} SELECT prompt, doc, score, rank::INT AS rank, total FROM (SELECT *, count(*) OVER (PARTITION BY prompt) AS total FROM lex) WHERE rank <= 10")
def q_search(spark, d):
    """Search: relaxed gates, ten results and the count of all."""
    found = K.lexical(*_lexical_inputs(spark, d), 1, 0.0, 1)
    return found.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("prompt"))).filter(F.col("rank") <= 10)


@query("q_index_rank", f"WITH {_lex} SELECT prompt, doc, score, rank::INT AS rank FROM lex WHERE rank <= 5")
def q_index_rank(spark, d):
    """The same ranking by the persistent index: all pages, a third of them in an older form, then as they are now."""
    docs, prompts = _lexical_inputs(spark, d)
    docs = materialize(docs, "index-docs")
    index = inverted.Index(spark, folder(spark, "index"))
    index.update(docs.select("doc", F.when(F.col("doc") % 3 == 0, F.slice("tokens", 1, 3)).otherwise(F.col("tokens")).alias("tokens")))
    index.update(docs)
    return index.search(prompts, 5)


_turns = "SELECT conv_id * 1000 + turn AS prompt, text FROM conversations WHERE role = 'user' AND length(trim(text)) >= 15"


@query("q_recall_sessions", f"""WITH RECURSIVE {_lexical_sql(2, 0.05, 2, _turns)},
p AS (SELECT prompt, prompt // 1000 AS session, row_number() OVER (PARTITION BY prompt // 1000 ORDER BY prompt) AS k FROM prompts),
c AS (SELECT prompt, list(doc ORDER BY rank) AS docs FROM lex GROUP BY prompt),
step AS (SELECT DISTINCT session, 0::BIGINT AS k, []::BIGINT[] AS seen, []::BIGINT[] AS picked, NULL::BIGINT AS prompt FROM p UNION ALL
  SELECT session, k, list_concat(seen, n), n, prompt FROM (SELECT s.session, p.k, s.seen, list_filter(coalesce(c.docs, []), lambda x: NOT list_contains(s.seen, x))[1:5] AS n, p.prompt FROM step s JOIN p ON p.session = s.session AND p.k = s.k + 1 LEFT JOIN c ON c.prompt = p.prompt)),
shown AS (SELECT session, prompt, unnest(picked) AS doc, unnest(range(1, len(picked) + 1)) AS rank FROM step)
SELECT session::VARCHAR AS session, prompt % 1000 AS event_id, doc, score, shown.rank::INT AS rank FROM shown JOIN lex USING (prompt, doc)""")
def q_recall_sessions(spark, d):
    """Pages shown to each user turn of a conversation, none twice in it (batch form of streaming.recall)."""
    docs, _ = _lexical_inputs(spark, d)
    turns = table(spark, d, "conversations").filter(F.col("role") == "user")
    return recall_sessions(turns.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("long").alias("event_id"), "text"), docs)


@query("q_search_json", f"WITH {_loose} SELECT prompt, rank::INT AS rank, '{{\"doc\":' || doc || ',\"rank\":' || rank || '}}' AS hit, round(score, 3) AS score FROM lex WHERE rank <= 5")
def q_search_json(spark, d):
    found = K.lexical(*_lexical_inputs(spark, d), 1, 0.0, 1, top=5)
    return found.select("prompt", "rank", F.to_json(F.struct("doc", "rank")).alias("hit"), F.round("score", 3).alias("score"))


# vector search: every twentieth vector asks, all answer
def _semantic(spark, d, top=20):
    v = views.vectors(spark, d)
    return K.cosine(v.select(F.col("vec_id").alias("doc"), "vec"), v.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("prompt"), "vec"), top)


_vec = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
u AS (SELECT vec_id AS prompt, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS q FROM v WHERE vec_id % 20 = 0),
sem AS (SELECT prompt, doc, score, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, doc) AS rank FROM (SELECT prompt, vec_id AS doc, round(list_dot_product(q, vec), 6) AS score FROM u, v))"""


@query("q_cosine_rank", f"WITH {_vec} SELECT prompt, doc, score, rank::INT AS rank FROM sem WHERE rank <= 10")
def q_cosine_rank(spark, d):
    return _semantic(spark, d).filter(F.col("rank") <= 10)


@query("j_relink_semantic", f"WITH {_vec} SELECT prompt, doc, score, rank::INT AS rank FROM (SELECT prompt, doc, score, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, doc) AS rank FROM sem WHERE doc <> prompt) WHERE rank <= 4")
def j_relink_semantic(spark, d):
    others = _semantic(spark, d).filter(F.col("doc") != F.col("prompt")).drop("rank")
    return K.ranked(others).filter(F.col("rank") <= 4)


# fusion: the lexical ranking of every prompt with the semantic one of the vector 20 * prompt
def _fused_inputs(spark, d):
    sem = _semantic(spark, d).withColumn("prompt", (F.col("prompt") / 20).cast("long"))
    return K.lexical(*_lexical_inputs(spark, d), top=POOL), sem


_both = f"{_lex}, {_vec}, semp AS (SELECT (prompt // 20)::BIGINT AS prompt, doc, score, rank FROM sem)"


def _rrf_sql(pool: int, kind: str) -> str:
    return f"fused AS (SELECT prompt, doc, score, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, doc) AS rank FROM (SELECT coalesce(a.prompt, b.prompt) AS prompt, coalesce(a.doc, b.doc) AS doc, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score FROM (SELECT * FROM lex WHERE rank <= {pool}) a {kind} JOIN (SELECT * FROM semp WHERE rank <= {pool}) b ON a.prompt = b.prompt AND a.doc = b.doc))"


@query("q_rrf_recall", f"WITH {_both}, {_rrf_sql(20, 'LEFT')} SELECT prompt, doc, score, rank::INT AS rank FROM fused")
def q_rrf_recall(spark, d):
    return K.rrf(*_fused_inputs(spark, d), 20, "first")


@query("q_rrf_relink", f"WITH {_both}, {_rrf_sql(20, 'FULL')} SELECT prompt, doc, score, rank::INT AS rank FROM fused WHERE rank <= 4")
def q_rrf_relink(spark, d):
    return K.rrf(*_fused_inputs(spark, d), 20).filter(F.col("rank") <= 4)


@query("q_relink_topk", f"WITH {_both}, {_rrf_sql(20, 'FULL')}, has AS (SELECT DISTINCT prompt FROM semp), r AS (SELECT prompt, doc, rank FROM fused WHERE prompt IN (FROM has) UNION ALL SELECT prompt, doc, rank FROM lex WHERE prompt NOT IN (FROM has)) SELECT prompt, doc, rank::INT AS rank FROM r WHERE rank <= 4")
def q_relink_topk(spark, d):
    """Candidates: fused pools where a page has a vector, else the lexical ranking."""
    lex, sem = _fused_inputs(spark, d)
    has = sem.select("prompt").distinct()
    fused = K.rrf(lex, sem, 20).join(has, "prompt", "left_semi")
    return fused.select("prompt", "doc", "rank").unionByName(lex.join(has, "prompt", "left_anti").select("prompt", "doc", "rank")).filter(F.col("rank") <= 4)


@query("q_hybrid_rank", f"WITH {_both}, {_rrf_sql(20, 'LEFT')}, has AS (SELECT DISTINCT prompt FROM semp), hit AS (SELECT DISTINCT prompt FROM lex), r AS (SELECT prompt, doc, score, rank FROM fused WHERE prompt IN (FROM has) UNION ALL SELECT * FROM semp WHERE prompt NOT IN (FROM hit) UNION ALL SELECT * FROM lex WHERE prompt NOT IN (FROM has)) SELECT prompt, doc, score, rank::INT AS rank FROM r WHERE rank <= 5")
def q_hybrid_rank(spark, d):
    return K.hybrid(*_fused_inputs(spark, d)).filter(F.col("rank") <= 5)


# links between pages
def _identity(spark, d):
    return views.pages(spark, d).select("ord", "slug", "project", "section", T.garden_tokens(T.identity_text(F.col("title"), F.col("slug"), F.col("project"), F.col("tags"))).alias("tokens"))


def _overlap_sql(project: float, section: float, ties: str, top: int) -> str:
    tokens = D.garden("title || ' ' || slug || ' ' || project || ' ' || array_to_string(tags, ' ')")
    return f"""WITH {D.PAGES}, i AS (SELECT ord, slug, project, section, unnest({tokens}) AS t FROM pages_v),
s AS (SELECT a.ord, b.ord AS other, any_value(b.slug) AS slug, count(*) + any_value(CASE WHEN a.project = b.project THEN {project} ELSE 0 END) + any_value(CASE WHEN a.section = b.section THEN {section} ELSE 0 END) AS score FROM i a JOIN i b ON a.t = b.t AND a.ord <> b.ord GROUP BY 1, 2)
SELECT ord, other, score::DOUBLE AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, {ties}) AS rank FROM s) WHERE rank <= {top}"""


@query("j_related", _overlap_sql(2, 0, "slug DESC", 3))
def j_related(spark, d):
    p = _identity(spark, d)
    return K.overlap_links(p, 2.0, 0.0, 3, F.desc("o_slug")).select("ord", "other", "score", "rank")


@query("j_relink_lexical", _overlap_sql(3, 0.5, "other", 4))
def j_relink_lexical(spark, d):
    p = _identity(spark, d)
    return K.overlap_links(p, 3.0, 0.5, 4, F.col("other")).select("ord", "other", "score", "rank")


_edges = f"""{D.PAGES}, {D.LINKS},
targets AS (SELECT slug, unnest(list_transform(regexp_extract_all(body, '\\[\\[([^\\]|#]+)', 1), lambda x: trim(regexp_replace(lower(trim(x)), '[^a-z0-9-]+', '-', 'g'), '-'))) AS dst FROM linked_v),
edges AS (SELECT DISTINCT slug AS src, dst FROM targets WHERE dst <> slug AND dst IN (SELECT slug FROM pages_v))"""


@query("x_extract_links", f"WITH {_edges} SELECT slug, string_agg(DISTINCT dst, ',' ORDER BY dst) AS links FROM targets WHERE dst <> '' GROUP BY slug")
def x_extract_links(spark, d):
    p = views.linked(spark, d).select("slug", T.extract_links(F.col("body")).alias("links"))
    return p.filter(F.size("links") > 0).select("slug", F.array_join("links", ",").alias("links"))


@query("g_link_edges", f"WITH {_edges} SELECT src, dst FROM edges")
def g_link_edges(spark, d):
    return G.link_edges(views.linked(spark, d))


_degrees = "deg AS (SELECT slug, (SELECT count(*) FROM edges WHERE src = slug) AS n_out, (SELECT count(*) FROM edges WHERE dst = slug) AS n_in FROM pages_v)"


@query("g_degree_targets", f"WITH {_edges}, {_degrees} SELECT slug, n_out, n_in, n_out + n_in = 0 AS orphan, n_out + n_in < 2 AS under FROM deg")
def g_degree_targets(spark, d):
    p = views.linked(spark, d)
    n = F.col("n_out") + F.col("n_in")
    return G.degrees(p, G.link_edges(p)).select("slug", "n_out", "n_in", (n == 0).alias("orphan"), (n < 2).alias("under"))


@query("q_relink", f"WITH {_edges}, {_degrees} SELECT slug FROM deg WHERE n_out + n_in < 2")
def q_relink(spark, d):
    p = views.linked(spark, d)
    return G.relink_targets(p, G.link_edges(p), all_pages=True).select("slug")


@query("x_prune_links", f"WITH {_edges} SELECT p.ord, md5(CASE WHEN p.ord % 2 = 0 THEN 'See [[' || t.slug || ']] and ' || t.slug || '|alias or No Such Page ' || p.ord || '.' WHEN p.ord % 3 = 0 THEN 'Loop ' || p.slug || '#part.' ELSE 'No links here.' END) AS body FROM pages_v p JOIN pages_v t ON t.ord = (p.ord * 7) % (SELECT count(*) FROM pages_v)")
def x_prune_links(spark, d):
    p = views.linked(spark, d)
    return G.prune_links(p.select("ord", "body"), p).select("ord", F.md5("body").alias("body"))


# similarity and clusters
_sets = D.garden("slug || ' ' || title || ' ' || array_to_string(tags, ' ') || ' ' || summary")
_pairs = f"""{D.PAGES}, sets AS (SELECT ord, {_sets} AS tokens FROM pages_v), it AS (SELECT ord, len(tokens) AS n, unnest(tokens) AS t FROM sets),
pairs AS (SELECT a.ord AS a, b.ord AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM it a JOIN it b ON a.t = b.t AND a.ord < b.ord GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= {JACCARD})"""


def _page_sets(p):
    return p.select(F.col("ord").alias("id"), T.garden_tokens(T.garden_page_text(F.col("slug"), F.col("title"), F.col("tags"), F.col("summary"))).alias("tokens"))


@query("g_jaccard_pairs", f"WITH {_pairs} SELECT a, b, round(j, 6) AS jaccard FROM pairs")
def g_jaccard_pairs(spark, d):
    """All pairs, those of equal sets too (numbers below 100 are no tokens, so two pages can have equal ones)."""
    return J.jaccard_pairs(_page_sets(views.pages(spark, d)), JACCARD, expand=True).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_cos = f"v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings), rep AS (SELECT vec, min(vec_id) AS id FROM v GROUP BY vec), cos AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.vec, b.vec) AS s FROM rep a JOIN rep b ON a.id < b.id WHERE list_dot_product(a.vec, b.vec) >= {COSINE} UNION ALL SELECT rep.id, v.vec_id, list_dot_product(v.vec, v.vec) FROM v JOIN rep ON rep.vec = v.vec AND rep.id <> v.vec_id)"


@query("g_cosine_pairs", f"WITH {_cos} SELECT a, b, round(s, 6) AS score FROM cos")
def g_cosine_pairs(spark, d):
    return J.cosine_pairs(views.vectors(spark, d).select(F.col("vec_id").alias("id"), "vec"), COSINE).select("a", "b", F.round("score", 6).alias("score"))


_clusters = f"""WITH RECURSIVE {_pairs}, {_cos},
pre AS (SELECT ord, array_to_string(list_filter(string_split(slug, '-'), lambda p: p <> '')[1:3], '-') AS prefix FROM pages_v WHERE len(list_filter(string_split(slug, '-'), lambda p: p <> '')) >= 3 AND list_filter(string_split(slug, '-'), lambda p: p <> '')[1] NOT IN ({D.quoted(T.GENERIC_SEGMENTS)})),
e AS (SELECT a, b FROM pairs UNION SELECT a, b FROM cos WHERE a IN (SELECT ord FROM pages_v) AND b IN (SELECT ord FROM pages_v) UNION SELECT m.b, p.ord FROM pre p JOIN (SELECT prefix, min(ord) AS b FROM pre GROUP BY prefix) m ON m.prefix = p.prefix AND m.b <> p.ord),
bi AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(x, y) AS (SELECT ord, ord FROM pages_v UNION SELECT r.x, bi.b FROM reach r JOIN bi ON bi.a = r.y),
comp AS (SELECT x AS ord, min(y) AS root FROM reach GROUP BY x)"""


def _cluster(spark, d):
    p = views.pages(spark, d)
    cos = J.cosine_pairs(views.vectors(spark, d).select(F.col("vec_id").alias("id"), "vec"), COSINE)
    known = p.select("ord")
    cos = cos.join(known.withColumnRenamed("ord", "a"), "a", "left_semi").join(known.withColumnRenamed("ord", "b"), "b", "left_semi")
    edges = [J.jaccard_links(_page_sets(p), JACCARD), cos, J.prefix_edges(p.select("ord", T.slug_prefix(F.col("slug")).alias("prefix")))]
    return p, J.cluster(known, edges)


@query("g_components", f"{_clusters} SELECT ord, root FROM comp")
def g_components(spark, d):
    return _cluster(spark, d)[1]


_roll = f"""{_clusters}, m AS (SELECT root, p.* FROM comp JOIN pages_v p USING (ord)), big AS (SELECT root FROM m GROUP BY root HAVING count(*) > 1),
roll AS (SELECT root, count(*) AS n, first(slug ORDER BY length(slug), ord) AS canon, flatten(list(sources ORDER BY ord)) AS src, flatten(list(tags ORDER BY ord)) AS tg, list(slug ORDER BY ord) AS members FROM m WHERE root IN (FROM big) GROUP BY root)"""


@query("g_cluster_rollup", f"{_roll} SELECT root, n, canon, array_to_string(list_filter(src, lambda x, i: list_position(src, x) = i), ',') AS sources, array_to_string(list_filter(tg, lambda x, i: list_position(tg, x) = i)[1:8], ',') AS tags FROM roll")
def g_cluster_rollup(spark, d):
    return J.rollup(*_cluster(spark, d)).select("root", "n", "canon", F.array_join("sources", ",").alias("sources"), F.array_join("tags", ",").alias("tags"))


@query("g_suggestions", f"{_roll} SELECT canon, n, md5(array_to_string(list_filter(members, lambda s: s <> canon), ', ')) AS siblings FROM roll")
def g_suggestions(spark, d):
    r = J.rollup(*_cluster(spark, d))
    return r.select("canon", "n", F.md5(F.array_join(F.array_except("members", F.array("canon")), ", ")).alias("siblings"))


@query("u_absorb_members", f"{_clusters}, canon AS (SELECT root, first(ord ORDER BY length(slug), ord) AS keep FROM comp JOIN pages_v USING (ord) GROUP BY root) SELECT ord FROM comp JOIN canon USING (root) WHERE ord = keep")
def u_absorb_members(spark, d):
    """The index without members absorbed by their cluster's canonical page."""
    p, clusters = _cluster(spark, d)
    canon = J.rollup(p, clusters).select("canon", F.explode("members").alias("slug")).filter(F.col("slug") != F.col("canon"))
    return p.join(canon.select("slug"), "slug", "left_anti").select("ord")


# model pipelines over the deterministic stubs (no SQL equivalent)
@query("v_complete")
def v_complete(spark, d):
    from quillspark.plans.models import complete

    return complete(table(spark, d, "benchmark"), "text").select("item_id", "reply")


@query("v_embed")
def v_embed(spark, d):
    from quillspark.plans.models import embed

    return embed(table(spark, d, "benchmark").select("item_id", "text"), "text").select("item_id", "vec")


@query("t_embed_incremental")
def t_embed_incremental(spark, d):
    from quillspark.plans.models import embed, embed_incremental

    p = views.pages(spark, d).select("slug", F.substring("body", 1, 2000).alias("text"), "ord")
    old = p.filter(F.col("ord") % 2 == 0).select("slug", "text", F.substring(F.sha2("text", 256), 1, 16).alias("hash"), F.lit("stub").alias("model"))
    return embed_incremental(p, embed(old, "text").select("slug", "hash", "model", "vec"))


def _notes(spark, d):
    s = views.sessions(spark, d)
    return s.select(F.concat("date", F.lit("--"), "source", F.lit("--"), "sid").alias("raw_name"), "source", "title", F.lit("session").alias("kind"), "text")


@query("v_synth_pipeline")
def v_synth_pipeline(spark, d):
    from quillspark.plans.models import synthesize

    return synthesize(_notes(spark, d), views.pages(spark, d).select("slug"))


@query("v_workspace")
def v_workspace(spark, d):
    """Handoff page of each workspace from its latest session's tail."""
    from quillspark.operators.incremental import latest
    from quillspark.plans.models import complete

    s = latest(views.sessions(spark, d), ["cwd"], [F.desc("date"), F.desc("conv_id")])
    return complete(s.withColumn("prompt", T.raw_tail(F.col("text"), 500000)), "prompt").select("cwd", "sid", T.sanitize_body(F.col("reply"), 8000).alias("body"))


@query("v_tidy")
def v_tidy(spark, d):
    """Merged page of each cluster, by the model."""
    from quillspark.plans.models import complete

    return complete(J.rollup(*_cluster(spark, d)).withColumn("prompt", F.array_join("members", " ")), "prompt").select("canon", "n", T.clean_body(F.col("reply")).alias("body"))


@query("v_analyze")
def v_analyze(spark, d):
    """Page of each significant code module, by the model."""
    from quillspark.operators import rollup as R
    from quillspark.plans.models import complete

    p = views.paths(spark, d)
    files = R.module_digest(p).groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]), "\n").alias("prompt"))
    return complete(R.modules(p).join(files, "module"), "prompt").select("module", "n_files", "reply")


@query("q_remember")
def q_remember(spark, d):
    """One remembered fact, synthesised into a page at once."""
    from quillspark.plans.models import synthesize

    fact = _notes(spark, d).filter(F.col("raw_name").endswith("sid-0")).withColumn("source", F.lit("remember"))
    return synthesize(fact, views.pages(spark, d).select("slug")).withColumn("synthesized", F.lit(True))
