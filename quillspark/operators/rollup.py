"""Catalogs and rollups: index, project hubs, status counts, code modules, page rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# fixed values: ranks of page kinds, sections in catalog order, label lines
KIND_RANK = {"merged": 0, "session": 1, "doc": 2, "code": 3, "manual": 4}
SECTIONS = ["topics", "entities", "decisions"]
KIND_LABEL = {"session": "> 💬 Sessão de IA\n", "doc": "> 📄 Documento\n", "manual": "> ✍️ Salvo manualmente\n", "code": "> 🏛️ Código\n", "merged": "> 🔀 Consolidado\n"}


def hub_bucket(sources: Column) -> Column:
    starts = lambda p: F.exists(F.coalesce(sources, F.array().cast("array<string>")), lambda s: s.startswith(p))
    return F.when(starts("analyze:"), "arch").when(starts("doc:"), "doc").otherwise("session")


def source_kind(sources: Column) -> Column:
    """Kind by the first source with a known prefix, session without one."""
    known = F.filter(F.transform(sources, lambda s: F.when(s.startswith("remember:"), "manual").when(s.startswith("analyze:"), "code").when(s.startswith("doc:"), "doc")), lambda k: k.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.lit("session"))


def bullet() -> Column:
    return F.concat(F.lit("- [["), "slug", F.lit("]] — "), F.coalesce("summary", F.lit("")))


def catalog(pages: DataFrame) -> DataFrame:
    """(section, slug, line): one bullet for each page.  Rows, not one string: a section has no size bound; sort by
    (section, slug) to write it."""
    return pages.select("section", "slug", bullet().alias("line"))


def hubs(pages: DataFrame) -> DataFrame:
    """(project, bucket, slug, line) of pages with a project, for one hub each; see ``catalog``."""
    return pages.filter(F.coalesce("project", F.lit("")) != "").select("project", hub_bucket(F.col("sources")).alias("bucket"), "slug", bullet().alias("line"))


def merge_kind(old: Column, new: Column) -> Column:
    """The kind with the lower rank; the existing one on a tie."""
    ranks = F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv])
    return F.when(old.isNull(), new).when(ranks[old] <= ranks[new], old).otherwise(new)


def render_page(updated: str) -> Column:
    """Markdown of a page row: frontmatter, kind label and body."""
    items = lambda c: F.when(F.size(c) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("  - "), x)), "\n"))).otherwise(" []")
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_LABEL.items() for x in kv]), F.col("kind")), F.lit(""))
    project = F.when(F.coalesce("project", F.lit("")) != "", F.concat(F.lit("project: "), "project", F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit('---\ntitle: "'), F.replace("title", F.lit('"'), F.lit("'")), F.lit('"\ntags:'), items("tags"), F.lit("\nkind: "), "kind", F.lit("\nstatus: "), "status", F.lit("\n"), project,
        F.lit("sources:"), items("sources"), F.lit(f"\nupdated: {updated}\n---\n\n"), label, F.lit("\n"), F.regexp_replace("body", r"\s+$", ""), F.lit("\n"),
    )


def code_files(paths: DataFrame) -> DataFrame:
    """(module, path) of code files below the root."""
    code = paths.filter(T.suffix(F.col("path")).isin(T.CODE_EXT))
    return code.select(T.module_key(F.col("path")).alias("module"), "path").filter(F.col("module").isNotNull())


def modules(paths: DataFrame, min_files: int = 3, top: int = 80) -> DataFrame:
    """(module, n_files, qualified): code modules with enough files, the largest ``top`` of them."""
    g = code_files(paths).groupBy("module").agg(F.count(F.lit(1)).alias("n_files")).filter(F.col("n_files") >= min_files)
    return g.crossJoin(F.broadcast(g.agg(F.count(F.lit(1)).alias("qualified")))).orderBy(F.desc("n_files"), "module").limit(top)


def module_digest(paths: DataFrame, listed: int = 80) -> DataFrame:
    """(module, place, path): the first ``listed`` files of each module by name."""
    w = Window.partitionBy("module").orderBy("path")
    return code_files(paths).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= listed).select("module", "place", "path")


def status(pages: DataFrame, n_raw: int, n_synthed: int) -> DataFrame:
    """(measure, value, n): page counts by kind and status, and the store's totals."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in (("kind", F.col("kind")), ("status", F.col("status")), ("pages", F.lit("")))])
    counts = pages.select(F.explode(each).alias("x")).groupBy("x.measure", "x.value").agg(F.count(F.lit(1)).alias("n"))
    totals = pages.sparkSession.createDataFrame([("raw", "", n_raw), ("synthed", "", n_synthed), ("pending", "", max(0, n_raw - n_synthed))], "measure string, value string, n long")
    return counts.unionByName(totals)
