"""Text expressions: tokenizers, slugs, cleaning, excerpts and summaries as native columns (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the bilingual stop list of the recall tokenizer
STOP = [
    "quando", "para", "como", "onde", "fazer", "quero", "preciso", "sobre",
    "isso", "esse", "essa", "esses", "aquele", "tudo", "agora", "depois",
    "entao", "tambem", "ainda", "porque", "qual", "quais", "mais", "menos",
    "pode", "fica", "vamos", "esta", "este", "seria", "tem", "uma", "umas",
    "with", "when", "what", "that", "this", "into", "from", "your", "have",
    "should", "would", "could", "about", "which", "there", "their", "then",
    "want", "need", "make", "does", "just", "like", "here", "them", "they",
]
# fixed values: tags and project names that models copy from the prompt's example
TAG_JUNK = ["a", "b", "kebab1", "kebab2", "tag", "tags", "topic", "area", "example", "human-title", "kebab-case-id", "existing-slug"]
PROJECT_JUNK = ["kebab-or-null", "null", "none", "unclear", "n-a", "project"]
GENERIC_SEGMENTS = ["note", "untitled", "misc", "draft", "doc"]
# fixed values: where the recall tokenizer cuts
RECALL_GAP = r"[\s\-_/.,;:!?()\"'\[\]{}@#]+"
SUMMARY_CHARS = 280


def some(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def recall_tokens(text: Column) -> Column:
    """Distinct 5-character prefixes of words of 4 or more characters that are not stop words, sorted."""
    words = F.filter(F.split(F.lower(some(text)), RECALL_GAP), lambda w: (F.length(w) >= 4) & ~w.isin(STOP))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 5))))


def garden_tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 of 3 or more characters, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(some(text)), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)))


def page_text(title: Column, slug: Column, tags: Column, summary: Column) -> Column:
    return F.concat_ws(" ", some(title), F.replace(some(slug), F.lit("-"), F.lit(" ")), F.array_join(F.coalesce(tags, F.array()), " "), some(summary))


def garden_page_text(slug: Column, title: Column, tags: Column, summary: Column) -> Column:
    return F.concat_ws(" ", some(slug), some(title), F.array_join(F.coalesce(tags, F.array()), " "), some(summary))


def identity_text(title: Column, slug: Column, project: Column, tags: Column) -> Column:
    return F.concat_ws(" ", some(title), some(slug), some(project), F.array_join(F.coalesce(tags, F.array()), " "))


def kebab(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(some(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slugify(c: Column, most: int = 40) -> Column:
    return F.coalesce(F.nullif(F.substring(kebab(c), 1, most), F.lit("")), F.lit("untitled"))


def slug_chain(slug: Column, title: Column, distill: Column, sid: Column, most: int = 60) -> Column:
    """First non-empty kebab of slug, title, the distillate's start, or a name from the id."""
    empty = F.lit("")
    found = F.coalesce(F.nullif(kebab(slug), empty), F.nullif(kebab(title), empty), F.nullif(kebab(F.substring(some(distill), 1, 50)), empty), F.concat(F.lit("note-"), F.substring(sid, 1, 8)))
    return F.regexp_replace(F.substring(found, 1, most), "^-+|-+$", "")


def slug_prefix(slug: Column) -> Column:
    """The first three segments, or null for short slugs and generic first segments."""
    parts = F.filter(F.split(some(slug), "-"), lambda p: p != "")
    return F.when((F.size(parts) >= 3) & ~F.get(parts, F.lit(0)).isin(GENERIC_SEGMENTS), F.array_join(F.slice(parts, 1, 3), "-"))


def clean_tags(tags: Column, most: int = 8) -> Column:
    made = F.transform(F.filter(F.coalesce(tags, F.array()), lambda t: t.isNotNull()), lambda t: kebab(F.trim(t)))
    return F.slice(F.array_distinct(F.filter(made, lambda t: (F.length(t) >= 2) & ~t.isin(TAG_JUNK))), 1, most)


def oneline(c: Column, n: int) -> Column:
    flat = F.trim(F.regexp_replace(some(c), r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…")))


def basename(path: Column) -> Column:
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(path.isNull() | (path == ""), "?").when(last == "", path).otherwise(last)


def uri_path(uri: Column) -> Column:
    """Path of a URI with %-escapes decoded (``+`` stays)."""
    return F.url_decode(F.replace(F.regexp_extract(uri, r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("+"), F.lit("%2B")))


def encode_path(path: Column) -> Column:
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


def state_key(c: Column) -> Column:
    return F.substring(F.regexp_replace(some(c), "[^A-Za-z0-9_-]", "-"), 1, 80)


def excerpt(body: Column, budget: int) -> Column:
    half = budget // 2
    return F.when(F.length(body) <= budget, body).otherwise(F.concat(F.substring(body, 1, half), F.lit("\n\n[... trecho do meio omitido ...]\n\n"), F.right(body, F.lit(half))))


def raw_tail(body: Column, most: int, marker: str = "[... beginning of raw omitted; latest excerpt follows ...]") -> Column:
    text = F.regexp_replace(some(body), r"^\s+|\s+$", "")
    keep = most - len(marker) - 2
    cut = F.concat(F.lit(marker + "\n\n"), F.right(text, F.lit(keep))) if keep > 0 else F.right(text, F.lit(most))
    return F.when(F.length(text) == 0, F.lit(None)).when(F.length(text) > most, cut).otherwise(text)


def strip_think(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(some(c), r"(?s)<think>.*?</think>", ""), r"^\s+|\s+$", "")


# fixed values: wrapper tags whose contents are noise in a transcript, and those that may stand alone
NOISE_TAGS = ["system-reminder", "command-name", "command-message", "command-args", "command-contents", "local-command-stdout", "local-command-stderr", "local-command-caveat"]
LONE_TAGS = ["command-name", "command-message", "command-args"]


def clean_text(c: Column, noise: bool = True) -> Column:
    """Transcript hygiene: noise tags, data URIs and long base64 go; blank lines collapse."""
    out = some(c)
    if noise:
        out = F.regexp_replace(out, rf"(?s)<({'|'.join(NOISE_TAGS)})>.*?</\1>", "")
        out = F.regexp_replace(out, rf"<({'|'.join(LONE_TAGS)})\s*/>", "")
    out = F.regexp_replace(out, r"data:[\w/+.-]+;base64,[A-Za-z0-9+/=\s]+", "[data]")
    out = F.regexp_replace(out, r"\b[A-Za-z0-9+/]{200,}={0,2}\b", "[base64]")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def prose(body: Column) -> Column:
    """First paragraph that has prose lines, white space collapsed (empty if none)."""
    def lines(p: Column) -> Column:
        kept = F.filter(F.transform(F.split(p, "\r?\n"), lambda s: F.ltrim(s)), lambda s: (s != "") & ~s.rlike(r"^(#|>|- |\* |\+ |[0-9]+[.)] )"))
        return F.array_join(kept, " ")

    found = F.filter(F.transform(F.split(some(body), "\n\n"), lines), lambda s: s != "")
    return F.trim(F.regexp_replace(some(F.get(found, F.lit(0))), r"\s+", " "))


def summary(body: Column, most: int = SUMMARY_CHARS) -> Column:
    """Whole sentences of the first prose paragraph within ``most`` characters, else a cut at a space."""
    flat = prose(body)

    def of(flat: Column) -> Column:
        start = F.substring(flat, 1, most + 1)
        pieces = F.regexp_extract_all(start, F.lit(r"([^.!?]*[.!?])"), F.lit(1))
        zero = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"), F.lit("").alias("s"))

        def add(a: Column, x: Column) -> Column:
            fits = a["open"] & (a["n"] + F.length(x) <= most)
            joined = F.when(a["n"] == 0, F.trim(x)).otherwise(F.concat(a["s"], F.lit(" "), F.trim(x)))
            return F.struct((a["n"] + F.when(fits, F.length(x)).otherwise(0)).alias("n"), fits.alias("open"), F.when(fits, joined).otherwise(a["s"]).alias("s"))

        whole = F.aggregate(pieces, zero, add, lambda a: a["s"])
        cut = F.concat(F.regexp_replace(F.regexp_replace(F.substring(flat, 1, most), r"^(.*) [^ ]*$", "$1"), r"[,;:—-]+$", ""), F.lit("…"))
        return F.when(F.length(flat) <= most, flat).when(whole != "", whole).otherwise(cut)

    return F.element_at(F.transform(F.array(flat), of), 1)


def frontmatter(text: Column) -> Column:
    """Map of the leading ``---`` block's ``key: value`` lines; the first colon separates, other lines drop."""
    block = F.regexp_extract(some(text), r"^(?s)---(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v")))
    return F.map_from_entries(pairs)


def strip_frontmatter(text: Column) -> Column:
    t = F.regexp_replace(some(text), r"^\s+", "")
    return F.when(t.rlike(r"^(?s)---.*?\n---"), F.regexp_replace(F.regexp_replace(t, r"^(?s)---.*?\n---", ""), r"^\n+", "")).otherwise(t)


def strip_fences(text: Column) -> Column:
    t = F.regexp_replace(some(text), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"^```(?:markdown)?\s*\n", ""), r"\n```\s*$", "")


PREAMBLE = r"(?i)^\s*(here('s| is| are| follows)?|sure|okay|below|the following|this (is|looks|appears|seems)|based on|looking at|i'?ll|let me)\b.*:\s*$"
RULE = r"^\s*(-{3,}|\*{3,}|_{3,})\s*$"


def clean_body(md: Column) -> Column:
    """Fences and frontmatter off, then leading blank, rule and preamble lines."""
    lines = F.split(strip_frontmatter(strip_fences(md)), "\n")
    noise = F.transform(lines, lambda x: (F.trim(x) == "") | x.rlike(RULE) | x.rlike(PREAMBLE))
    first = F.coalesce(F.array_position(noise, F.lit(False)), F.lit(0))
    body = F.when(first > 0, F.array_join(F.slice(lines, first.cast("int"), F.size(lines)), "\n")).otherwise("")
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def sanitize_body(md: Column, most: int) -> Column:
    t = strip_frontmatter(strip_fences(md))
    at = F.locate("## ", t)
    body = F.when(at > 1, F.substring(t, at, F.length(t))).otherwise(t)
    return F.regexp_replace(F.substring(body, 1, most), r"^\s+|\s+$", "")


def extract_links(body: Column) -> Column:
    """Distinct normalised targets of [[links]], up to an alias or anchor, sorted."""
    raw = F.regexp_extract_all(some(body), F.lit(r"\[\[([^\]|#]+)"), F.lit(1))
    made = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9-]+", "-"), "^-+|-+$", ""))
    return F.array_sort(F.array_distinct(F.filter(made, lambda x: x != "")))


def dedup_blocks(body: Column) -> Column:
    """Later exact repeats of paragraphs of more than 40 characters go; all others are joined by a blank line."""
    def of(blocks: Column) -> Column:
        keys = F.transform(blocks, lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
        kept = F.filter(F.transform(F.arrays_zip(blocks.alias("b"), keys.alias("k")), lambda z, i: F.struct(z["b"].alias("b"), z["k"].alias("k"), i.alias("i"))), lambda z: (F.length(z["k"]) <= 40) | (F.array_position(keys, z["k"]) == z["i"] + 1))
        return F.array_join(F.transform(kept, lambda z: z["b"]), "\n\n")

    return F.element_at(F.transform(F.array(F.split(some(body), r"\n\s*\n")), of), 1)


def managed_section(text: Column, slugs: Column, header: str = "## Relacionado", marker: str = "<!-- quill-relink -->") -> Column:
    """The text with its managed link section replaced, or appended if there is none."""
    section = F.concat(F.lit(f"\n\n{header} {marker}\n"), F.array_join(F.transform(slugs, lambda s: F.concat(F.lit("- [["), s, F.lit("]]"))), "\n"), F.lit("\n"))
    pattern = rf"(?s)\n*{header} {marker}.*?(?=\n##\s|\z)"
    replaced = F.concat(F.rtrim(F.regexp_replace(F.regexp_replace(text, pattern, "\u0000"), "\u0000", section), F.lit(" \n\t\r")), F.lit("\n"))
    return F.when(F.size(slugs) == 0, text).when(text.contains(f"{header} {marker}"), replaced).otherwise(F.concat(F.rtrim(text, F.lit(" \n\t\r")), section))


# fixed values: directories that hold packages rather than being one
CONTAINER_DIRS = ["src", "packages", "apps", "libs", "lib", "services", "internal", "pkg", "modules", "components", "cmd", "crates", "projects"]
# fixed values: directories and extensions of code scans
SKIP_DIRS = [".git", "node_modules", ".venv", "venv", "dist", "build", "__pycache__", ".next", "target", ".idea", ".vscode", ".mypy_cache", ".pytest_cache", "vendor", ".gradle", "coverage", ".turbo"]
CODE_EXT = [".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".java", ".kt", ".scala", ".rb", ".c", ".cc", ".cpp", ".h", ".hpp", ".swift", ".php", ".sql"]
# fixed values: content extensions (text, documents, slides, sheets, images, audio, video)
CONTENT_EXT = [".md", ".markdown", ".mdx", ".rst", ".txt", ".org", ".adoc", ".csv", ".tsv", ".log", ".pdf", ".docx", ".doc", ".odt", ".rtf", ".epub", ".html", ".htm", ".tex", ".pptx", ".ppt", ".odp", ".xlsx", ".xls", ".ods", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tiff", ".tif", ".heic", ".mp3", ".wav", ".m4a", ".aac", ".flac", ".ogg", ".opus", ".wma", ".mp4", ".mov", ".mkv", ".webm", ".avi", ".m4v"]
BACKUP = r"(?i)(\.(backup|bak|orig|old)\b|~$)"


def suffix(path: Column) -> Column:
    """Lower-case extension of the last path part, with its dot; empty if none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+(\.[^.]+)$", 1))


def module_key(path: Column, depth: int = 2) -> Column:
    """Top directory, one level deeper through container directories; null for files at the root."""
    parts = F.split(path, "/")
    n = F.size(parts)
    deep = F.lit(1)
    for d in range(2, depth + 1):
        deep = F.when((deep == d - 1) & (n > d) & F.get(parts, F.lit(d - 2)).isin(CONTAINER_DIRS), F.lit(d)).otherwise(deep)
    return F.when(n >= 2, F.array_join(F.slice(parts, F.lit(1), deep), "/"))


def within(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return F.coalesce((path == root) | path.startswith(f"{root}/"), F.lit(False))


def normalize_key(value: Column) -> Column:
    """A path is keyed by its last part, anything else as it is; kebab-case, null if empty."""
    path = value.rlike(r"[/\\:]")
    return F.nullif(kebab(F.when(path, F.regexp_extract(F.regexp_replace(value, r"/+$", ""), r"([^/]*)$", 1)).otherwise(value)), F.lit(""))


def extract_json(reply: Column) -> Column:
    """The first balanced {...} of a model's reply, code fences removed; null if there is none or it is no JSON.

    A depth counter that folds over the text cut behind each brace; braces inside strings count.
    """
    text = F.regexp_replace(some(reply), r"```(?:json)?", "")
    pieces = F.regexp_extract_all(text, F.lit(r"[^{}]*[{}]"), F.lit(0))
    state = lambda depth, at, start, end: F.struct(depth.cast("int").alias("depth"), at.cast("int").alias("at"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    none = F.lit(None).cast("int")

    def step(s: Column, piece: Column) -> Column:
        at = s["at"] + F.length(piece)
        opens = piece.endswith("{")
        depth = F.when(opens, s["depth"] + 1).otherwise(F.greatest(s["depth"] - 1, F.lit(0)))
        start = F.coalesce(s["start"], F.when(opens, at))
        end = F.coalesce(s["end"], F.when(~opens & (s["depth"] == 1), at))
        return state(depth, at, start, end)

    found = F.aggregate(pieces, state(F.lit(0), F.lit(0), none, none), step)
    cut = F.substring(text, found["start"], found["end"] - found["start"] + 1)
    # the parser stops behind the first value; as an array of one there is nothing behind it
    alone = F.concat(F.lit("["), cut, F.lit("]"))
    return F.when(F.try_parse_json(alone).isNotNull() & (F.json_array_length(alone) == 1), cut)


def merge_maps(left: Column, right: Column) -> Column:
    """Two maps as one; where both have a key, the right value counts, null or not."""
    return F.map_zip_with(left, right, lambda k, a, b: F.when(F.map_contains_key(right, k), b).otherwise(a))


def merge_nested(left: Column, right: Column) -> Column:
    """Two maps of maps merged key by key on both levels; a missing map is empty."""
    both = lambda k, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merge_maps(a, b))
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.map_zip_with(left, right, both))


def literal(c: Column) -> Column:
    """A literal of the command line as struct(kind, value): bool, null, int (without sign and zeros in front), else text."""
    low = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    number = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"^\+", ""), "^(-?)0+(?=[0-9])", "$1"), "^-0$", "0")
    kind = F.when(low.isin("true", "false"), "bool").when(low.isin("null", "none"), "null").when(low.rlike(r"^[+-]?[0-9]+$"), "int").when(c.isNotNull(), "text")
    return F.struct(kind.alias("kind"), F.when(kind == "bool", low).when(kind == "int", number).when(kind == "text", c).alias("value"))
