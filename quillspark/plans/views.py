"""Views that bind the public tables to the engine's data model (pages, sessions, paths, links, vectors)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.durable import table
from quillspark.functions import text as T


def pages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    i, title = F.col("doc_id"), F.substring("text", 1, 60)
    word = lambda p: F.concat(F.lit(p), i.cast("string"))
    return docs.select(
        i.alias("ord"),
        title.alias("title"),
        F.concat(T.kebab(title), F.lit("-"), i.cast("string")).alias("slug"),
        F.array("lang", "source").alias("tags"),
        F.when(F.col("lang") == "en", "topics").when(F.col("lang") == "de", "entities").otherwise("decisions").alias("section"),
        F.col("source").alias("project"),
        F.element_at(F.array(*map(F.lit, ["merged", "session", "doc", "code", "manual"])), (i % 5 + 1).cast("int")).alias("kind"),
        F.when(i % 6 == 0, "superseded").when(i % 6 == 1, "draft").otherwise("current").alias("status"),
        F.when(i % 4 == 0, F.array(word("doc:"), word("claude:"))).when(i % 4 == 1, F.array(word("analyze:"))).when(i % 4 == 2, F.array(word("claude:"))).otherwise(F.array(word("remember:"), word("doc:"))).alias("sources"),
        T.summary(F.col("text")).alias("summary"),
        F.col("text").alias("body"),
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


def fold_turns(turns: DataFrame) -> DataFrame:
    """conv_id, title, text (Markdown), n_turns of every conversation, turns in order."""
    spoken = F.filter(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: t["text"] != "")
    folded = turns.groupBy("conv_id").agg(spoken.alias("t"), F.count(F.lit(1)).alias("n_turns"))
    first = F.get(F.filter("t", lambda t: t["role"] == "user"), F.lit(0))["text"]
    title = F.substring(F.get(F.split(F.coalesce(first, F.lit("(sem título)")), "\n"), F.lit(0)), 1, 120)
    markdown = F.array_join(F.transform("t", lambda t: F.concat(F.lit("## "), t["role"], F.lit("\n\n"), t["text"])), "\n\n")
    return folded.select("conv_id", title.alias("title"), F.when(F.size("t") > 0, markdown).alias("text"), "n_turns")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("conv_id")
    date = F.date_format(F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(hours=c.cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return fold_turns(turns(spark, d)).select(
        "conv_id",
        F.when(c % 3 == 0, "claude").when(c % 3 == 1, "codex").otherwise("cursor").alias("source"),
        F.concat(F.lit("sid-"), c.cast("string")).alias("sid"),
        F.concat(F.lit("/w/p"), (c % 7).cast("string")).alias("cwd"),
        date.alias("date"),
        "title",
        "text",
        "n_turns",
    )


def paths(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    s = i.cast("string")
    path = (
        F.when(i % 8 == 0, F.concat(F.lit("src/m"), (i % 9).cast("string"), F.lit("/file"), s, F.lit(".py")))
        .when(i % 8 == 1, F.concat(F.lit("packages/p"), (i % 5).cast("string"), F.lit("/lib/f"), s, F.lit(".ts")))
        .when(i % 8 == 2, F.concat(F.lit("docs/guide"), s, F.lit(".md")))
        .when(i % 8 == 3, F.concat(F.lit("node_modules/x/f"), s, F.lit(".js")))
        .when(i % 8 == 4, F.concat(F.lit("README"), s, F.lit(".md")))
        .when(i % 8 == 5, F.concat(F.lit("core/c"), s, F.lit(".go")))
        .when(i % 8 == 6, F.concat(F.lit("docs/old/slide"), s, F.lit(".pptx.bak")))
        .otherwise(F.concat(F.lit("assets/img"), s, F.lit(".PNG")))
    )
    return table(spark, d, "pages").select("page_id", T.uri_path(F.col("url")).alias("url_path"), path.alias("path"))


def linked(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    n = p.count()
    to = p.select(F.col("ord").alias("t_ord"), F.col("slug").alias("t"))
    s = F.col("ord")
    body = (
        F.when(s % 2 == 0, F.concat(F.lit("See [["), "t", F.lit("]] and [["), "t", F.lit("|alias]] or [[No Such Page "), s.cast("string"), F.lit("]].")))
        .when(s % 3 == 0, F.concat(F.lit("Loop [["), "slug", F.lit("#part]].")))
        .otherwise("No links here.")
    )
    return p.join(to, F.col("t_ord") == (s * 7) % n).select("ord", "slug", "section", "project", "title", "tags", body.alias("body"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Non-empty vectors, as doubles."""
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label").filter(F.size("vec") > 0)
