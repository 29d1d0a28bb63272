"""Readers of session logs: tolerant JSON lines, event-log dialects, and a SQLite key-value store.

Every reader keeps file and line order explicitly, drops what cannot be parsed, and folds events into one row
per session: source, id, title, date, cwd, text (Markdown turns).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import basename, clean_text, oneline
from quillspark.sources.keyvalue import key_values, read_key_values

NO_TITLE = "(sem título)"
TURN = "struct<line:bigint,role:string,text:string>"


def jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line, v (variant) of every well-formed line below ``path``; blank and malformed lines drop."""
    return tolerant(jsonl_lines(spark, path), "value").drop("value")


def jsonl_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line (a number that rises within a file), value of every line below ``path``."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.col("value"))


def tolerant(lines: DataFrame, column: str) -> DataFrame:
    """``lines`` with a variant column v of ``column``, without the rows that are no JSON object."""
    parsed = lines.withColumn("v", F.try_parse_json(column))
    return parsed.filter(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def condense_tool(name: Column, args: Column) -> Column:
    """One line for a tool call: by name, else the name and a hint from a likely free-text argument."""
    arg = lambda k: F.coalesce(F.try_element_at(args, F.lit(k)), F.lit(""))
    short = F.element_at(F.split(F.coalesce(F.nullif(name, F.lit("")), F.lit("tool")), "__"), -1)
    command = F.get(F.split(F.trim(arg("command")), "\n"), F.lit(0))
    query = F.coalesce(F.nullif(arg("pattern"), F.lit("")), arg("query"))
    said = F.coalesce(F.nullif(arg("description"), F.lit("")), arg("subagent_type"))
    hint = F.coalesce(*[F.when(F.trim(arg(k)) != "", oneline(arg(k), 80)) for k in ("query", "description", "prompt", "path", "url", "file_path")], F.lit(""))
    line = lambda verb, c: F.concat(F.lit(f"_{verb}: "), c, F.lit("_"))
    return (
        F.when(name == "Bash", F.when(command != "", line("ran", oneline(command, 120))).otherwise("_ran a command_"))
        .when(name.isin("Edit", "MultiEdit"), line("edited", basename(arg("file_path"))))
        .when(name == "Write", line("wrote", basename(arg("file_path"))))
        .when(name == "Read", line("read", basename(arg("file_path"))))
        .when(name.isin("Grep", "Glob"), F.when(query != "", line("searched", oneline(query, 80))).otherwise(F.concat(F.lit("_"), short, F.lit("_"))))
        .when(name == "TodoWrite", "_updated todo list_")
        .when(name == "Task", F.when(said != "", line("ran agent", oneline(said, 80))).otherwise("_ran agent_"))
        .when(name == "WebFetch", line("fetched", oneline(arg("url"), 100)))
        .when(name == "WebSearch", line("web search", oneline(arg("query"), 80)))
        .otherwise(F.concat(F.lit("_tool: "), short, F.when(hint != "", F.concat(F.lit(" — "), hint)).otherwise(""), F.lit("_")))
    )


def _blocks_text(content: str) -> Column:
    """Text of a message's content: a string, or its text and tool blocks (other blocks drop)."""
    block = "struct<type:string,text:string,name:string,input:map<string,string>>"
    blocks = F.from_json(F.coalesce(_get(content, "string"), F.lit("[]")), f"array<{block}>")
    parts = F.transform(blocks, lambda b: F.when(b["type"] == "text", clean_text(b["text"])).when(b["type"] == "tool_use", condense_tool(b["name"], b["input"])))
    many = F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n\n")
    return F.when(F.schema_of_variant(F.try_variant_get("v", content, "variant")) == "STRING", clean_text(_get(content))).otherwise(many)


def iso(c: Column) -> Column:
    """Epoch seconds, epoch milliseconds (above 1e12) or text, as ISO-8601 UTC text."""
    n = F.try_to_number(c, F.lit("9999999999999")).cast("long")
    made = F.date_format(F.when(n > 1e12, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.coalesce(made, c)


def _folded(turns: Column) -> tuple[Column, Column]:
    """(Markdown, first user text) of an ordered array of TURN."""
    text = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("## "), t["role"], F.lit("\n\n"), t["text"])), "\n\n")
    first = F.get(F.filter(turns, lambda t: t["role"] == "user"), F.lit(0))["text"]
    return text, first


def _title(c: Column) -> Column:
    line = F.substring(F.trim(F.get(F.split(F.trim(F.coalesce(c, F.lit(""))), "\n"), F.lit(0))), 1, 120)
    return F.coalesce(F.nullif(line, F.lit("")), F.lit(NO_TITLE))


def _turns(found: Column) -> Column:
    return F.array_sort(F.collect_list(found))


def log_folders(spark: SparkSession, path: str, workspace: str) -> list[str]:
    """The places below ``path`` that can hold logs of a workspace: its encoded folder, those it is a prefix of, and
    logs without a folder.  Encoding loses characters, so sessions are still filtered by their own folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    encoded = re.sub("[^A-Za-z0-9]", "-", workspace.rstrip("/"))
    listed = [(s.getPath().getName(), s) for s in fs.listStatus(root)] if fs.exists(root) else []
    fits = lambda name, s: name == encoded or name.startswith(encoded + "-") if s.isDirectory() else name.endswith(".jsonl")
    return sorted(s.getPath().toString() for name, s in listed if fits(name, s))


def read_log_sessions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Sessions of the first dialect below ``path``."""
    return log_sessions(jsonl_lines(spark, path))


def log_sessions(lines: DataFrame) -> DataFrame:
    """First dialect, from lines (file, line, value) of type user, assistant and ai-title; files without turns drop."""
    kind, text = _get("$.type"), _blocks_text("$.message.content")
    e = tolerant(lines, "value").select("file", "line", kind.alias("kind"), _get("$.timestamp").alias("ts"), _get("$.cwd").alias("cwd"), F.coalesce(_get("$.message.aiTitle"), _get("$.aiTitle")).alias("ai"), F.when(kind.isin("user", "assistant"), text).alias("text"))
    said = F.when(F.col("text") != "", F.struct("line", F.col("kind").alias("role"), "text"))
    g = e.groupBy("file").agg(
        F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("line"))).alias("ts"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line"))).alias("cwd"),
        F.max_by("ai", F.when((F.col("kind") == "ai-title") & F.col("ai").isNotNull(), F.col("line"))).alias("ai"),
        _turns(said).alias("t"),
    )
    body, first = _folded(F.col("t"))
    sid = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    return g.filter(F.size("t") > 0).select(F.lit("claude").alias("source"), sid.alias("id"), _title(F.coalesce("ai", first)).alias("title"), iso(F.col("ts")).alias("date"), "cwd", body.alias("text"))


def read_rollout_sessions(spark: SparkSession, path: str | list[str], titles: DataFrame | None = None) -> DataFrame:
    """Sessions of the second dialect below ``path``."""
    return rollout_sessions(jsonl_lines(spark, path), titles)


def rollout_sessions(lines: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Second dialect, from lines (file, line, value): session_meta, event_msg and response_item lines; role=user items count only if a file has
    no user_message.  ``titles`` (id, title, updated) names sessions; the last row of an id wins."""
    ptype = _get("$.payload.type")
    parts = F.from_json(F.coalesce(_get("$.payload.content"), F.lit("[]")), "array<struct<text:string>>")
    content = F.when(F.schema_of_variant(F.try_variant_get("v", "$.payload.content", "variant")) == "STRING", _get("$.payload.content")).otherwise(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"))
    context = lambda c: F.trim(F.regexp_replace(c, r"(?s)^\s*# Context from my IDE setup:.*?(?=## My request|\z)", ""))
    args = F.from_json(_get("$.payload.arguments"), "map<string,string>")
    listed = F.from_json(F.try_element_at(args, F.lit("command")), "array<string>")
    command = F.get(F.split(F.trim(F.coalesce(F.array_join(listed, " "), F.try_element_at(args, F.lit("command")), F.lit(""))), "\n"), F.lit(0))
    shell = F.trim(F.regexp_replace(F.regexp_replace(command, r"^(bash|sh|zsh)\s+-l?c\s+", ""), "^['\" ]+|['\" ]+$", ""))
    name = F.trim(F.coalesce(_get("$.payload.name"), F.lit("")))
    call = F.when(name.isin("shell", "exec", "local_shell", "container.exec") | F.try_element_at(args, F.lit("command")).isNotNull(), F.when(shell != "", F.concat(F.lit("_ran: "), oneline(shell, 120), F.lit("_"))).otherwise("_ran a command_")).when(name.isin("apply_patch", "patch"), "_edited files (patch)_").otherwise(condense_tool(name, args))
    kind = _get("$.type")
    role = F.when((kind == "event_msg") & (ptype == "user_message"), "user").when((kind == "response_item") & (ptype == "message") & (_get("$.payload.role") == "assistant"), "assistant").when((kind == "response_item") & ptype.isin("function_call", "custom_tool_call"), "assistant").when((kind == "response_item") & (ptype == "message") & (_get("$.payload.role") == "user") & ~F.ltrim(content).startswith("<"), "fallback")
    text = F.when(ptype == "user_message", clean_text(context(_get("$.payload.message")), False)).when(ptype == "message", F.when(_get("$.payload.role") == "user", clean_text(context(content), False)).otherwise(clean_text(content, False))).otherwise(call)
    meta = kind == "session_meta"
    e = tolerant(lines, "value").select("file", "line", role.alias("role"), text.alias("text"), F.when(meta, _get("$.payload.id")).alias("id"), F.when(meta, _get("$.payload.cwd")).alias("cwd"), F.when(meta, F.coalesce(_get("$.payload.timestamp"), _get("$.timestamp"))).alias("ts"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(c)
    g = e.groupBy("file").agg(last("id"), last("cwd"), last("ts"), _turns(F.when(F.col("role").isNotNull() & (F.col("text") != ""), F.struct("line", "role", "text"))).alias("all"))
    real = F.filter("all", lambda t: t["role"] != "fallback")
    spare = F.transform(F.filter("all", lambda t: t["role"] == "fallback"), lambda t: F.struct(t["line"].alias("line"), F.lit("user").alias("role"), t["text"].alias("text")))
    g = g.withColumn("t", F.when(F.exists("all", lambda t: t["role"] == "user"), real).otherwise(F.concat(spare, real))).filter(F.col("id").isNotNull() & (F.size("t") > 0))
    if titles is not None:
        named = titles.groupBy(F.col("id").alias("tid")).agg(F.last("title").alias("named"), F.last("updated").alias("updated"))
        g = g.join(named, g["id"] == F.col("tid"), "left")
    else:
        g = g.withColumns({"named": F.lit(None).cast("string"), "updated": F.lit(None).cast("string")})
    body, first = _folded(F.col("t"))
    return g.select(F.lit("codex").alias("source"), "id", _title(F.coalesce("named", first)).alias("title"), iso(F.coalesce("ts", "updated")).alias("date"), "cwd", body.alias("text"))


def _thread_lists(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import sqlite3

    key = "composer.composerData"
    for pdf in files:
        rows = []
        for path in pdf["path"]:
            try:
                rows += [(path, v) for k, v in key_values(re.sub("^file:/*", "/", path), "ItemTable", key) if k == key]
            except sqlite3.Error:  # not a database, or one without the table: a workspace without threads
                continue
        yield pd.DataFrame(rows, columns=["path", "value"])


def workspace_folders(spark: SparkSession, storage: str) -> DataFrame:
    """(id, cwd) of threads: each folder below ``storage`` names its workspace in workspace.json and lists its threads
    in state.vscdb.  The first folder by name wins a thread; folders that lack either file or cannot be read drop."""
    found = lambda name: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(storage)
    home = F.regexp_replace("path", "/[^/]*$", "").alias("home")
    named = tolerant(found("workspace.json").withColumn("value", F.col("content").cast("string")).select("path", "value"), "value")
    folder = F.when(F.schema_of_variant(F.try_variant_get("v", "$.folder", "variant")) == "STRING", _get("$.folder"))
    local = F.regexp_extract(folder, r"^file://[^/?#]*([^?#]*)", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(local, F.lit("+"), F.lit("%2B"))), local)
    places = named.select(home, F.nullif(F.when(folder.startswith("file://"), decoded).otherwise(folder), F.lit("")).alias("cwd")).filter(F.col("cwd").isNotNull())
    lists = tolerant(found("state.vscdb").select("path").mapInPandas(_thread_lists, "path string, value string"), "value")
    threads = lists.select(home, F.explode(F.try_variant_get("v", "$.allComposers", "array<variant>")).alias("v")).select("home", _get("$.composerId").alias("id"))
    return threads.filter(F.col("id") != "").join(places, "home").groupBy("id").agg(F.min_by("cwd", "home").alias("cwd"))


def read_thread_sessions(spark: SparkSession, path: str, folders: DataFrame | None = None, storage: str | None = None) -> DataFrame:
    """Third dialect: composer metadata and bubbles of a key-value store; ``folders`` (id, cwd), or those that
    ``workspace_folders`` finds below ``storage``, place threads."""
    if folders is None and storage is not None:
        folders = workspace_folders(spark, storage)
    # two reads: each pushes its own prefix to the source
    return thread_sessions(read_key_values(spark, path, push=True), read_key_values(spark, path, push=True), folders)


def thread_sessions(entries: DataFrame, metadata: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Third dialect, from entries (key, value) of a key-value store: bubbles among ``entries``, threads among ``metadata``."""
    of = lambda found, prefix: tolerant(found.filter(F.col("key").startswith(prefix)), "value")
    key = F.split("key", ":")
    created = F.coalesce(_get("$.createdAt", "bigint").cast("double"), F.unix_millis(F.try_to_timestamp(_get("$.createdAt"))).cast("double"))
    role = F.when(_get("$.type", "int") == 1, "user").otherwise("assistant")
    said = clean_text(_get("$.text"), False)
    diffs = F.from_json(F.coalesce(_get("$.assistantSuggestedDiffs"), _get("$.gitDiffs"), F.lit("[]")), "array<struct<uri:string,filePath:string,path:string>>")
    edits = F.transform(F.filter(F.transform(diffs, lambda x: F.coalesce(x["uri"], x["filePath"], x["path"])), lambda p: p.isNotNull()), lambda p: F.concat(F.lit("edited: "), basename(p)))
    ran = F.when(F.length(F.coalesce(_get("$.toolResults"), _get("$.interpreterResults"), F.lit("[]"))) > 2, F.array(F.lit("ran a tool"))).otherwise(F.array().cast("array<string>"))
    actions = F.array_join(F.transform(F.slice(F.array_distinct(F.concat(edits, ran)), 1, 5), lambda a: F.concat(F.lit("_"), a, F.lit("_"))), "\n")
    text = F.when((said == "") & (role == "assistant"), actions).otherwise(said)
    bubbles = of(entries, "bubbleId:").filter(F.size(key) >= 3).select(F.get(key, F.lit(1)).alias("id"), role.alias("role"), text.alias("text"), F.coalesce(created, F.lit(0.0)).alias("at"), F.get(key, F.lit(2)).alias("bubble"))
    t = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("at", "bubble", "role", "text"))))
    g = bubbles.groupBy("id").agg(t.alias("t"), F.min("at").alias("first")).filter(F.size("t") > 0)
    meta = of(metadata, "composerData:").select(F.get(key, F.lit(1)).alias("mid"), _get("$.name").alias("name"), _get("$.createdAt").alias("created"))
    g = g.join(meta, g["id"] == F.col("mid"), "left")
    g = g.join(folders.withColumnRenamed("id", "fid"), g["id"] == F.col("fid"), "left") if folders is not None else g.withColumn("cwd", F.lit(None).cast("string"))
    body, first = _folded(F.col("t"))
    return g.select(F.lit("cursor").alias("source"), "id", _title(F.coalesce("name", first)).alias("title"), iso(F.coalesce("created", F.col("first").cast("long").cast("string"))).alias("date"), "cwd", body.alias("text"))


#: Backends by name; a further one registers itself here.
BACKENDS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"claude": read_log_sessions, "codex": read_rollout_sessions, "cursor": read_thread_sessions}


#: Backends whose folders are named by workspace: which of them a scan for one workspace reads.
PRUNED: dict[str, Callable[[SparkSession, str, str], list[str]]] = {"claude": log_folders}


def union_sessions(spark: SparkSession, stores: dict[str, str], workspace: str | None = None, since: str | None = None, storage: str | None = None) -> DataFrame:
    """Sessions of all known backends among ``stores`` (name → path); unknown names and missing paths are ignored.

    ``workspace`` keeps sessions below a folder, and only folders that can hold them are read; ``since`` (YYYY-MM-DD)
    keeps later ones and unknown dates; ``storage`` places the third dialect's threads.
    """
    backends = {**BACKENDS, "cursor": partial(BACKENDS["cursor"], storage=storage)} if storage else BACKENDS
    there = available(spark, stores)
    places = {name: PRUNED[name](spark, path, workspace) if workspace and name in PRUNED else path for name, path in stores.items() if there[name]}
    read = [backends[name](spark, place) for name, place in places.items() if place]
    if not read:
        return spark.createDataFrame([], "source string, id string, title string, date string, cwd string, text string")
    every = reduce(DataFrame.unionByName, read)
    return filter_sessions(every, workspace, since)


def available(spark: SparkSession, stores: dict[str, str]) -> dict[str, bool]:
    """For each store (name → path) whether it is a known backend whose path is there; never raises."""

    def there(path: str) -> bool:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place))
        except Exception:  # noqa: BLE001  an address that cannot be read is a source that is not there
            return False

    return {name: name in BACKENDS and there(path) for name, path in stores.items()}


def filter_sessions(sessions: DataFrame, workspace: str | None = None, since: str | None = None) -> DataFrame:
    from quillspark.functions.text import within

    if workspace:
        sessions = sessions.filter(within(F.col("cwd"), workspace))
    if since:
        date = F.to_date(F.try_to_timestamp(F.substring("date", 1, 10), F.lit("yyyy-MM-dd")))
        sessions = sessions.filter(F.coalesce(date >= F.lit(since[:10]).cast("date"), F.lit(True)))
    return sessions


def locator_index(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the JSON-lines locator indexes below ``path``."""
    return locators(jsonl_lines(spark, path))


def locators(lines: DataFrame) -> DataFrame:
    """Entries of a locator index, from its lines (value); malformed lines drop."""
    fields = ["path", "kind", "description", "local_path", "drive_id", "mcp_read_tool", "web_link", "fingerprint"]
    return tolerant(lines, "value").select(*[_get(f"$.{f}").alias(f) for f in fields], F.coalesce(_get("$.local_readable", "boolean"), F.lit(False)).alias("local_readable"))
