"""Link graph: edges from page bodies, degrees, and the choice of pages to link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import extract_links, kebab


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): distinct links between known pages(slug, body), none to itself."""
    raw = pages.select(F.col("slug").alias("src"), F.explode(extract_links(F.col("body"))).alias("dst")).filter(F.col("src") != F.col("dst"))
    return raw.join(pages.select(F.col("slug").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def degrees(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """(slug, n_out, n_in) of every page."""
    both = edges.select(F.col("src").alias("slug"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    d = both.groupBy("slug").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return pages.select("slug").join(d, "slug", "left").select("slug", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def relink_targets(pages: DataFrame, edges: DataFrame, all_pages: bool = False, refresh: bool = False, min_links: int = 2, marker: str = "<!-- quill-relink -->") -> DataFrame:
    """Pages to link: orphans; with ``all_pages`` those under ``min_links``; with ``refresh`` also those linked before."""
    d = degrees(pages, edges).withColumn("links", F.col("n_out") + F.col("n_in"))
    short = F.col("links") < min_links if all_pages else F.col("links") == 0
    marked = F.col("body").contains(marker) if refresh else F.lit(False)
    return pages.join(d, "slug").filter(short | marked)


def prune_links(pages: DataFrame, valid: DataFrame) -> DataFrame:
    """pages(ord, body) with links unwrapped whose whole inside is no slug of ``valid``, neither as written nor kebab-cased.

    As written too: a slug made of an empty title and a number (``-7``) is not its own kebab case.
    """
    found = F.regexp_extract_all(F.col("body"), F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    inside = pages.select("ord", F.explode(F.array_distinct(found)).alias("x")).withColumn("slug", kebab(F.trim("x")))
    slugs = valid.select("slug")
    unknown = inside.join(slugs, "slug", "left_anti").join(slugs.withColumnRenamed("slug", "x"), "x", "left_anti")
    bad = unknown.groupBy("ord").agg(F.array_sort(F.collect_list("x")).alias("bad"))

    def unwrap(body: Column, x: Column) -> Column:
        return F.replace(body, F.concat(F.lit("[["), x, F.lit("]]")), x)

    return pages.join(bad, "ord", "left").withColumn("body", F.aggregate(F.coalesce("bad", F.array().cast("array<string>")), F.col("body"), unwrap)).drop("bad")
