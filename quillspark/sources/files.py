"""Files as rows: slide decks, the files that locators name, and the repositories below a folder.

A listing is a DataFrame with a column path (absolute, ``/`` as separator); nothing here walks folders on the driver.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: namespaces of the slide format
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length and modification time of the files below ``root``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", "modificationTime")


def _said(body: ElementTree.Element) -> str:
    """Text of a text body: paragraphs by line, breaks inside one as vertical tabs."""
    kinds = {f"{A}t": lambda e: e.text or "", f"{A}br": lambda e: "\v"}
    return "\n".join("".join(kinds[e.tag](e) for e in p.iter() if e.tag in kinds) for p in body.iter(f"{A}p")).strip()


def deck_text(content: bytes | None) -> str | None:
    """Slides of a deck in their order: a heading each, the text of its shapes, and table rows joined by `` | ``.

    Null if the content is no readable deck or has no slides.  Shapes inside groups, notes and pictures are left out.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            targets = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
            order = [targets[e.get(f"{R}id")] for e in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{P}sldId")]
            slides = [ElementTree.fromstring(z.read(posixpath.normpath(posixpath.join("/ppt", t)).lstrip("/"))) for t in order]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, NotImplementedError, RuntimeError):
        return None
    out = []
    for n, slide in enumerate(slides, 1):
        out.append(f"## Slide {n}")
        for shape in slide.iterfind(f"{P}cSld/{P}spTree/*"):
            body = shape.find(f"{P}txBody")
            if body is not None and shape.tag == f"{P}sp":
                out.append(_said(body))
            for row in shape.iterfind(f"{A}graphic/{A}graphicData/{A}tbl/{A}tr"):
                cells = [_said(c) for c in row.iterfind(f"{A}tc")]
                out.append(" | ".join(cells) if any(cells) else "")
    return "\n".join(line for line in out if line) or None


def _decks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"], "text": [deck_text(c) for c in pdf["content"]]})


def read_decks(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the slide decks below ``root``; text is null for what cannot be read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pptx").load(root)
    return found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content").mapInPandas(_decks, "path string, text string")


def _below(base: Column | str, relative: Column | str) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), relative)


def local_files(entries: DataFrame, files: DataFrame, base: str | None = None) -> DataFrame:
    """``entries`` of a locator index with the column file: the absolute local_path if it is listed, else the relative
    path below ``base`` if the entry says that it is readable and it is listed, else null."""
    listed = files.select("path").distinct()
    spare = F.when(F.col("local_readable"), _below(F.lit(base), F.col("path"))) if base else F.lit(None).cast("string")
    first, second = listed.select(F.col("path").alias("__first")), listed.select(F.col("path").alias("__second"))
    joined = entries.join(first, entries["local_path"] == F.col("__first"), "left").join(second, F.col("__second") == spare, "left")
    return joined.withColumn("file", F.coalesce("__first", "__second")).drop("__first", "__second")


def content_root(entries: DataFrame, files: DataFrame, candidates: list[str]) -> str | None:
    """The first of the candidate folders below which a readable entry is listed, else the first; null without any.

    The candidates are the caller's list; only the smallest place among them reaches the driver.
    """
    tried = [c for c in candidates if c]
    if not tried:
        return None
    named = entries.filter(F.col("local_readable") & (F.col("path") != "")).select(F.col("path").alias("relative")).distinct()
    places = named.select("relative", F.posexplode(F.array(*map(F.lit, tried))).alias("place", "base"))
    hit = places.select("place", _below(F.col("base"), F.col("relative")).alias("path")).join(files.select("path"), "path", "left_semi")
    return tried[hit.agg(F.min("place").alias("place")).first()["place"] or 0]


def nested_repos(paths: DataFrame, root: str) -> DataFrame:
    """repo: ``root`` if it is a repository, else the repositories one or two folders below it, else ``root``.

    ``paths`` lists files, those of the ``.git`` folders too (or the ``.git`` file of a linked work tree).
    """
    root = root.rstrip("/")
    inside = F.when(F.col("path").startswith(root + "/"), F.substring("path", len(root) + 2, 1 << 30))
    home = F.regexp_extract(inside, r"^((?:[^/]+/){0,2})\.git(?:/|$)", 1)
    found = paths.filter(inside.rlike(r"^(?:[^/]+/){0,2}\.git(?:/|$)")).select(F.rtrim(home, F.lit("/")).alias("home")).distinct()
    if found.isEmpty() or not found.filter(F.col("home") == "").isEmpty():
        return found.sparkSession.createDataFrame([(root,)], "repo string")
    return found.select(F.concat(F.lit(root + "/"), "home").alias("repo"))
