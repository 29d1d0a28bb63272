"""HTML extraction with a site style tree.

Pages of one host are merged into a tree of style nodes (paths of tag and class).  Every node of every page counts: its
presentation importance is the entropy of its child sequences over the host's distinct pages, its content importance
the entropy of the texts below it (a page's set of them is one value, however many they are), both relative to their
largest possible value: what every page shows alike is template, whatever its classes are called.
Both are grouped sums over (node, feature), so a hot host is combined before the shuffle and no task holds
a host.  Roles that HTML states (nav, footer, forms, advert and comment classes, article, main, ...) weigh in: the
importance of a block on its page is a mean of its tree's entropy and its role.  Blocks of low importance, and those
in a branch that is template as a whole, are removed from each page, and what is left is its text.

Edge cases: null and empty html give an empty text; a null url is a host of its own; hosts of fewer than MIN_PAGES
distinct pages have no template evidence and rely on the roles; exact copies of a page count once; malformed markup is
read leniently; very long pages cost in proportion to their length; repeated rows give equal rows; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, modest, rows, small, table

#: Distinct pages of a host from which its tree counts; importance below which a block is removed.
MIN_PAGES, LOW = 8, 0.42
#: Share of presentation in a node's entropy; of roles in a block's importance; importances of the roles.
PRESENTATION, ROLES = 0.3, 0.6
DROPPED, NEUTRAL, MAIN = 0.0, 0.5, 0.65
#: Entropy that stands in for missing evidence, and the highest one that can remove a block that no role drops.
UNKNOWN, MOST_LOW = 0.5, (LOW - ROLES * NEUTRAL) / (1 - ROLES)
#: Share of linked characters that makes a block outside article and main a menu.
LINKED = 0.6
#: Low nodes are joined to pages under so many salts of their host when they are too many to broadcast.
SALTS = 64

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_attr = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What an implied end tag never crosses.
SCOPE = frozenset("table ul ol dl div section article aside main body html form td th blockquote nav header footer".split())
DROP_TAGS = frozenset("nav footer aside form head noscript template iframe button select dialog menu svg canvas audio video object search fieldset label".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
DROP_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup share sharing social comment comments commentlist disqus reply replies related recommended recommendations login search pagination pager widget toolbar masthead copyright skip paywall feedback".split())
CORE = frozenset(("article", "main"))


@dataclass
class Block:
    path: tuple[str, ...]
    nodes: tuple[int, ...]
    role: float
    core: bool
    text: list[str] = field(default_factory=list)
    linked: int = 0

    def clean(self) -> str:
        return " ".join(_html.unescape("".join(self.text)).split())


def _style(tag: str, attrs: str) -> tuple[str, float | None]:
    """A node's style key and prior importance."""
    prior = 0.0 if tag in DROP_TAGS else None
    key = tag
    if attrs and attrs.strip("/ \t\r\n"):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attr.finditer(attrs)}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        words = {w.lower() for w in _part.findall(names)}
        role = found.get("role", "").lower()
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower())
        if hidden or role in DROP_ROLES or (words & DROP_WORDS and tag not in ("html", "body")):
            prior = 0.0
        key = ".".join([tag, *sorted(set(found.get("class", "").lower().split()))])
    return key, prior


def parse(page: str, host: str = "") -> tuple[list[Block], list[tuple[int, int]]]:
    """The page's blocks in order, and (style node, hash of its child sequence) of its inner nodes; nodes are a host's."""
    blocks: list[Block] = []
    stack: list[list] = [["", "", NEUTRAL, False, xxhash.xxh64_intdigest(host) >> 2, []]]  # tag, key, role, core, node, children
    inner: list[tuple[int, int]] = []
    block: Block | None = None
    links = 0

    def close() -> None:
        tag, _, _, _, node, children = stack.pop()
        if children:
            inner.append((node, xxhash.xxh64_intdigest(" ".join(dict.fromkeys(children))) >> 1))

    def text(s: str) -> None:
        nonlocal block
        if block is None:
            if not s or s.isspace():
                return
            up = stack[-1]
            at = [x for x in stack if x[0] in BLOCK]
            block = Block(tuple(x[1] for x in at), tuple(x[4] for x in at), up[2], up[3])
            blocks.append(block)
        block.text.append(s)
        if links:
            block.linked += len(s)

    at, n = 0, len(page)
    while at < n:
        m = _token.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        whole = m[0]
        if whole.startswith("<![CDATA["):
            text(_html.escape(whole[9:].removesuffix("]]>")))
            continue
        end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    while len(stack) > i:
                        links -= stack[-1][0] == "a"
                        close()
                    break
                if stack[i][0] in SCOPE and tag not in BLOCK:
                    break
            if tag in BLOCK:
                block = None
            continue
        if tag in RAW:
            stop = re.compile(f"</{tag}", re.I).search(page, at)
            gone = stop.start() if stop else n
            tail = page.find(">", gone)
            at = n if tail < 0 else tail + 1
            continue
        if tag == "br":
            text(" ")
            continue
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        if shut:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in shut:
                    while len(stack) > i:
                        links -= stack[-1][0] == "a"
                        close()
                    break
                if stack[i][0] in SCOPE:
                    break
        if tag in BLOCK:
            block = None
        up = stack[-1]
        if tag in VOID:
            up[5].append(tag)
            continue
        key, prior = _style(tag, attrs)
        if tag == "header" and not up[3]:
            prior = 0.0
        core = up[3] or tag in CORE or "role=\"main\"" in attrs
        up[5].append(key)
        if not attrs.endswith("/"):
            links += tag == "a"
            stack.append([tag, key, DROPPED if up[2] == DROPPED or prior == 0.0 else (MAIN if core else NEUTRAL), core, xxhash.xxh64_intdigest(f"{up[4]}/{key}") >> 2, []])
    while len(stack) > 1:
        close()
    return blocks, inner


def main_text(page: str | None, entropy: Mapping[int, float] | None = None, host: str = "") -> str:
    """The page's main text: its blocks of high importance; those of article or main if it has one.

    ``entropy`` are the low ones of the host's tree.  A block counts with the lowest of its branches.
    """
    blocks, _ = parse(page or "", host)
    known = entropy or {}

    def importance(b: Block) -> float:
        found = [known[x] for x in b.nodes if x in known]
        return (1 - ROLES) * (min(found) if found else UNKNOWN) + ROLES * b.role

    kept = [b for b in blocks if importance(b) >= LOW]
    core = [b for b in kept if b.core]
    out = []
    for b in core or kept:
        t = b.clean()
        if t and (b.core or b.linked <= LINKED * sum(map(len, b.text))):
            out.append(t)
    return "\n".join(out)


def node_features(page: str, host: str) -> dict[int, int]:
    """Feature of each (style node, kind) of a page, as one number: 0 the node's child sequences, 1 the texts below it."""
    blocks, inner = parse(page, host)
    sets: dict[int, set[int]] = {}
    for b in blocks:
        text = xxhash.xxh64_intdigest(b.clean())
        for n in b.nodes:
            sets.setdefault(2 * n + 1, set()).add(text)
    for n, f in inner:
        if 2 * n + 1 in sets:
            sets.setdefault(2 * n, set()).add(f)
    return {n: xxhash.xxh64_intdigest(",".join(map(str, sorted(x)))) >> 1 for n, x in sets.items()}


def _host(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)


def style_tree(pages: DataFrame) -> DataFrame:
    """Durable table host, node, entropy (0 to 1) of all style nodes of hosts with MIN_PAGES distinct pages or more."""

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            node, feature, page, hosts = [], [], [], []
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = node_features(text, h)
                node += found.keys()
                feature += found.values()
                page += [xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))] * len(found)
                hosts += [h] * len(found)
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(node, pa.int64()), pa.array(feature, pa.int64()), pa.array(page, pa.int64())], names=["host", "node", "feature", "page"])

    read = pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).filter(F.col("html").isNotNull())
    seen = read.mapInArrow(features, "host string, node long, feature long, page long").distinct()
    counts = seen.groupBy("host", "node", "feature").agg(F.count(F.lit(1)).alias("c"))
    c, m = F.col("c").cast("double"), F.col("m")
    entropy = counts.groupBy("host", "node").agg(F.sum(c).alias("m"), F.sum(c * F.log(c)).alias("s")).filter(m >= MIN_PAGES)
    relative = (F.log(m) - F.col("s") / m) / F.log(m)
    kind = F.col("node").bitwiseAND(F.lit(1))
    weight = F.when(kind == 0, F.lit(PRESENTATION)).otherwise(F.lit(1 - PRESENTATION))
    nodes = entropy.groupBy("host", F.shiftright("node", 1).alias("node")).agg((F.sum(weight * relative) / F.sum(weight)).alias("entropy"))
    return materialize(nodes, "style-tree")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    modest(pages.sparkSession)
    tree = style_tree(pages).filter(F.col("entropy") < MOST_LOW)
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), _host(F.col("url")).alias("host"))
    shared = None
    if small(tree, 128):
        shared = pages.sparkSession.sparkContext.broadcast({r["node"]: r["entropy"] for r in tree.select("node", "entropy").toLocalIterator()})
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        lists = tree.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("node", "entropy"))).alias("low")).select("host", "low", salts)
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(lists, ["host", "salt"], "left").select("page_id", "url", "html", "host", "low")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            low = [shared.value] * b.num_rows if shared is not None else [dict(x or ()) for x in b.column(4).to_pylist()]
            texts = [main_text(t, w, h) for t, w, h in zip(b.column(2).to_pylist(), low, b.column(3).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return keyed.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html": op3_html}
ORACLE_SQL: dict[str, str] = {}
