"""A knowledge base as Parquet tables in one folder, and the verbs over it.

Tables: raw_notes and ledger and changelog (append-only), synthed, pages, vectors, workspace (replaced as whole
versions: a reader keeps the version it started with).  The folder can be on any file system that Spark reads.
One writer at a time: the verbs that replace tables hold the store's lease, and every commit is a compare-and-set on
the version that was read (see ``commits``), so a writer that stalled past its lease loses its own work only.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import json
import re
import time
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.commits import LEASE_SECONDS, Conflict, Fenced, Files, Lease, Table
from quillspark.config import Limits
from quillspark.functions import scrub as S
from quillspark.functions import text as T
from quillspark.operators import incremental as I
from quillspark.operators import rank as K
from quillspark.operators import rollup as R
from quillspark.operators import simjoin as J
from quillspark.plans import models as M

SCHEMAS = {
    "raw_notes": "raw_name string, source string, sid string, date string, cwd string, kind string, pii array<string>, title string, body string",
    "ledger": "key string, raw string, ts timestamp",
    "synthed": "name string, hash string",
    "pages": "ord long, slug string, title string, section string, kind string, status string, tags array<string>, sources array<string>, project string, summary string, body string",
    "vectors": "slug string, hash string, model string, vec array<double>, section string",
    "changelog": "ts timestamp, page string, kind string, action string",
    "workspace": "workspace string, updated timestamp, body string",
}


#: Tables that grow by appending; the others are replaced.
APPENDED = ("raw_notes", "ledger", "changelog")

# fixed value: stands for the owner's profile in prompts while there is none
NO_PROFILE = "(no profile provided)"


__all__ = ["Busy", "Conflict", "Fenced", "Store"]


class Busy(RuntimeError):
    """Another writer holds the store's lock."""


class Store:
    def __init__(self, spark: SparkSession, path: str, limits: Limits | None = None, completer: M.Completer = M.stub_complete, embedder: M.Embedder = M.stub_embed):
        self.spark, self.path, self.limits, self.completer, self.embedder = spark, path.rstrip("/"), limits or Limits(), completer, embedder

    # tables
    def _fs(self, path: str):
        return self.files.at(path)

    @functools.cached_property
    def files(self) -> Files:
        return Files(self.spark)

    def table(self, name: str) -> Table:
        return Table(self.spark, f"{self.path}/{name}", SCHEMAS[name])

    def version(self, name: str) -> int:
        """Number of a replaced table's current version, 0 if it was never written."""
        return self.table(name).head()

    def _appended(self, name: str) -> bool:
        return "_SUCCESS" in self.files.names(f"{self.path}/{name}/v1")

    def read(self, name: str) -> DataFrame:
        """The current version of a table; empty if it was never written."""
        if name not in APPENDED:
            return self.table(name).read()
        if not self._appended(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}/v1")

    def replace(self, name: str, df: DataFrame, base: int | None = None, lease: Lease | None = None) -> None:
        """A new version of a table, after ``base`` (the version that ``df`` was made from; the current one by default).

        Raises Conflict if another writer has put a version there, Fenced if ``lease`` was taken over.
        """
        self.table(name).commit(df, self.version(name) if base is None else base, lease)

    def append(self, name: str, df: DataFrame) -> None:
        df.select(*self.spark.createDataFrame([], SCHEMAS[name]).columns).write.mode("append").parquet(f"{self.path}/{name}/v1")

    def init(self) -> list[str]:
        """Create the tables that are missing, empty, and take over those of an older layout; returns the names of
        new ones.  A second call changes nothing."""
        missing = []
        for name in SCHEMAS:
            if name in APPENDED:
                if not self._appended(name):
                    self.append(name, self.spark.createDataFrame([], SCHEMAS[name]))
                    missing.append(name)
            elif not self.version(name) and not self.table(name).adopt():
                self.replace(name, self.spark.createDataFrame([], SCHEMAS[name]), 0)
                missing.append(name)
        return missing

    def project(self, workspace: str | None) -> str:
        """The key of a workspace's project, empty if it has none."""
        row = self.spark.range(1).select(T.normalize_key(F.lit(workspace).cast("string")).alias("key")).first()
        return row["key"] or ""

    # keyed state and the writer's lease: small files of the driver
    def _state(self, key: str) -> str:
        return f"{self.path}/state/{re.sub('[^A-Za-z0-9_-]', '-', key)[:80]}.json"

    def state(self, key: str) -> dict:
        """The state of a key; {} if there is none or it cannot be read."""
        return self.files.load(self._state(key))

    def set_state(self, key: str, value: dict) -> None:
        """Replace the state of a key, with the time as ``_ts``."""
        self.files.put(self._state(key), {**value, "_ts": time.time()})

    def clear_state(self, key: str) -> None:
        self.files.delete(self._state(key))

    def profile(self, most: int = 900) -> str:
        """The owner's own words about themself for prompts: the start of ABOUT.md, or a placeholder."""
        fs, p = self._fs(f"{self.path}/ABOUT.md")
        try:
            stream = fs.open(p)
            try:
                text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "ignore").strip()
            finally:
                stream.close()
        except Py4JJavaError:  # no such file
            text = ""
        return text[:most] or NO_PROFILE

    @contextlib.contextmanager
    def lock(self, name: str = "write", seconds: float = LEASE_SECONDS) -> Iterator[Lease | None]:
        """The lease of a name, renewed while the block runs; None while another writer holds it.

        A lease that is held is no error: the block runs with None and should do nothing.
        """
        lease = Lease.acquire(self.files, f"{self.path}/locks/{name}", seconds)
        if lease is None:
            yield None
            return
        with lease.working():
            yield lease

    # verbs
    def ingest(self, sessions: DataFrame, kind: str = "session") -> int:
        """Add sessions(source, id, title, date, cwd, text) whose content is new; returns their number.

        Content keys are of the text as it came; the stored body is scrubbed and the kinds of personal data found
        are kept beside it.
        """
        from quillspark.durable import materialize

        keyed = sessions.withColumn("key", F.concat_ws(":", "source", "id", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 12)))
        day = F.coalesce(F.substring("date", 1, 10), F.lit("0000-00-00"))
        name = F.concat(F.concat_ws("--", day, "source", T.slugify(F.col("title"), 32), F.substring(F.sha2("id", 256), 1, 8)), F.lit(".md"))
        fresh = I.new_keys(keyed, self.read("ledger")).select("key", name.alias("raw_name"), "source", F.col("id").alias("sid"), "date", "cwd", F.lit(kind).alias("kind"), S.detect_pii(F.coalesce("text", F.lit(""))).alias("pii"), "title", S.scrub(F.col("text")).alias("body"))
        fresh = materialize(fresh, "fresh")
        n = fresh.count()
        if n:
            self.append("raw_notes", fresh)
            self.append("ledger", fresh.select("key", F.col("raw_name").alias("raw"), F.current_timestamp().alias("ts")))
        return n

    def notes(self) -> DataFrame:
        """Current raw notes: the last one of each name (a full capture supersedes a partial one)."""
        return I.latest(self.read("raw_notes"), ["raw_name"], [F.desc(F.length("body")), F.desc("body")])

    def pending(self) -> DataFrame:
        hashed = self.notes().select(F.col("raw_name").alias("name"), F.substring(F.sha2("body", 256), 1, 16).alias("hash"))
        return I.pending(hashed, self.read("synthed"))

    def synth(self, limit: int | None = None) -> int:
        """Turn pending notes into pages (all, or the first ``limit`` by name); returns their number, 0 if another
        writer is at work."""
        with self.lock() as lease:
            return self._synth(limit, lease) if lease else 0

    def _synth(self, limit: int | None, lease: Lease) -> int:
        from quillspark.durable import materialize

        base = {name: self.version(name) for name in ("pages", "synthed")}
        todo = self.pending()
        if limit is not None:
            todo = todo.orderBy("name").limit(limit)
        todo = materialize(todo, "todo")
        n = todo.count()
        if not n:
            return 0
        notes = self.notes().join(todo.select(F.col("name").alias("raw_name")), "raw_name", "left_semi").select("raw_name", "source", "title", "kind", "cwd", F.col("body").alias("text"))
        old = self.read("pages")
        made = M.synthesize(notes, old, self.completer)
        cwd = notes.select(F.concat_ws(":", "source", "raw_name").alias("first"), T.normalize_key(F.col("cwd")).alias("project"))
        made = made.withColumn("first", F.get("sources", F.lit(0))).join(cwd, "first", "left")
        before = old.select("slug", F.col("ord").alias("o_ord"), F.col("sources").alias("o_sources"), F.col("kind").alias("o_kind"), F.col("body").alias("o_body"), F.col("tags").alias("o_tags"))
        top = old.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
        pages = materialize(
            made.join(before, "slug", "left").select(
                F.coalesce("o_ord", F.lit(top) + 1 + F.monotonically_increasing_id()).alias("ord"),
                "slug",
                "title",
                F.lit("topics").alias("section"),
                R.merge_kind(F.col("o_kind"), F.col("kind")).alias("kind"),
                F.lit("current").alias("status"),
                F.coalesce("o_tags", F.array().cast("array<string>")).alias("tags"),
                F.array_distinct(F.concat(F.coalesce("o_sources", F.array().cast("array<string>")), "sources")).alias("sources"),
                "project",
                T.summary(F.col("body")).alias("summary"),
                T.dedup_blocks(F.concat_ws("\n\n", "o_body", "body")).alias("body"),
                "action",
            ),
            "new-pages",
        )
        self.replace("pages", I.upsert(old, pages.drop("action"), "slug"), base["pages"], lease)
        self.append("changelog", pages.select(F.current_timestamp().alias("ts"), F.col("slug").alias("page"), "kind", "action"))
        self.replace("synthed", I.upsert(self.read("synthed"), todo.select("name", "hash"), "name"), base["synthed"], lease)
        return n

    def embed(self, model: str = "stub") -> DataFrame:
        """Bring the vectors up to date; returns them.  Conflict if another embedding was faster."""
        from quillspark.durable import materialize

        base, pages, old = self.version("vectors"), self.read("pages"), self.read("vectors")
        p = pages.select("slug", F.substring(F.concat_ws("\n", "title", F.array_join("tags", " "), "summary", "body"), 1, 2000).alias("text"))
        new = M.embed_incremental(p, old.select("slug", "hash", "model", "vec"), model, self.embedder)
        new = materialize(new.join(pages.select("slug", "section"), "slug"), "vectors")
        # sections with a vector that came, went or changed; the files of the others stay as they are
        keys = ["slug", "hash", "model", "section"]
        same = lambda a, b: a.join(b.select(*(F.col(k).alias(f"b_{k}") for k in keys)), [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys], "left_anti").select("section")
        changed = materialize(same(new, old).unionAll(same(old, new)).distinct(), "sections")
        if not changed.isEmpty():
            self.table("vectors").commit_parts(new, F.col("section"), changed, base)
        return self.read("vectors")

    def search(self, prompts: DataFrame, relaxed: bool = True, limit: int | None = None) -> DataFrame:
        """(prompt, slug, score, rank, summary) of prompts(prompt, text): hybrid where the store has vectors."""
        p = self.read("pages")
        docs = p.select(F.col("ord").alias("doc"), T.recall_tokens(T.page_text(F.col("title"), F.col("slug"), F.col("tags"), F.col("summary"))).alias("tokens"))
        asked = prompts.select("prompt", T.recall_tokens(F.col("text")).alias("tokens"))
        gates = (1, 0.0, 1) if relaxed else (self.limits.retrieve_min_overlap, self.limits.retrieve_min_score, 2)
        found = K.lexical(docs, asked, *gates)
        vectors = self.read("vectors")
        if not vectors.isEmpty():
            by_doc = vectors.join(p.select("slug", F.col("ord").alias("doc")), "slug").select("doc", "vec")
            found = K.hybrid(found, K.cosine(by_doc, M.embed(prompts.select("prompt", "text"), "text", self.embedder).select("prompt", "vec"), max(4 * self.limits.retrieve_max_results, 20, limit or 0)), self.limits.retrieve_max_results)
        top = found.filter(F.col("rank") <= (limit or (10 if relaxed else self.limits.retrieve_max_results)))
        return top.join(p.select(F.col("ord").alias("doc"), "slug", "summary"), "doc").select("prompt", "slug", "score", "rank", "summary")

    def recall(self, prompts: DataFrame, shown: DataFrame | None = None) -> DataFrame:
        """Gated search for prompts long enough, without pages already shown(prompt, slug)."""
        asked = prompts.filter(F.length(F.trim("text")) >= self.limits.retrieve_min_prompt_chars)
        most = 0 if shown is None else shown.groupBy("prompt").count().agg(F.max("count").alias("n")).first()["n"] or 0
        found = self.search(asked, relaxed=False, limit=self.limits.retrieve_max_results + most)
        if shown is not None:
            found = found.join(shown, ["prompt", "slug"], "left_anti")
        return K.ranked(found.drop("rank").withColumnRenamed("slug", "doc")).filter(F.col("rank") <= self.limits.retrieve_max_results).withColumnRenamed("doc", "slug")

    def _session_notes(self) -> DataFrame:
        """Latest session note of each project key."""
        keyed = self.notes().withColumn("workspace", T.normalize_key(F.col("cwd"))).filter(F.col("source").isin("claude", "cursor", "codex") & (F.col("workspace") != ""))
        return I.latest(keyed, ["workspace"], [F.desc("date"), F.desc("raw_name")])

    def _write_workspaces(self, last: DataFrame) -> int:
        """Distil notes(workspace, body) into workspace rows; where the model fails the row stays as it was."""
        from quillspark.durable import materialize

        base = self.version("workspace")
        made = M.complete(last.select("workspace", T.raw_tail(F.col("body"), self.limits.workspace_source_chars).alias("prompt")), "prompt", self.completer)
        rows = materialize(made.filter(F.col("reply").isNotNull()).select("workspace", F.current_timestamp().alias("updated"), T.sanitize_body(F.col("reply"), self.limits.workspace_max_chars).alias("body")), "workspaces")
        n = rows.count()
        if n:
            self.replace("workspace", I.upsert(self.read("workspace"), rows, "workspace"), base)
        return n

    def refresh_workspace(self, key: str) -> None:
        """Distil the latest session note of a project into its workspace row."""
        self._write_workspaces(self._session_notes().filter(F.col("workspace") == key))

    def refresh_workspaces(self) -> int:
        """Distil the latest session notes that came in after their projects' workspace rows; returns their number."""
        came = self.read("ledger").groupBy(F.col("raw").alias("raw_name")).agg(F.max("ts").alias("came"))
        known = self.read("workspace").select("workspace", "updated")
        last = self._session_notes().join(came, "raw_name", "left").join(known, "workspace", "left")
        return self._write_workspaces(last.filter(F.col("updated").isNull() | (F.col("came") > F.col("updated"))))

    def boot(self, key: str) -> DataFrame:
        """(workspace, body, pages): the fresh workspace page of a project and how many pages it has."""
        limit = F.current_timestamp() - F.make_interval(days=F.lit(self.limits.boot_workspace_max_age_days))
        own = self.read("workspace").filter((F.col("workspace") == key) & F.coalesce(F.col("updated") >= limit, F.lit(True)))
        count = self.read("pages").filter(F.col("project") == key).agg(F.count(F.lit(1)).alias("pages"))
        return count.crossJoin(F.broadcast(own.agg(F.max("body").alias("body")))).select(F.lit(key).alias("workspace"), F.substring("body", 1, self.limits.boot_max_chars).alias("body"), "pages")

    @functools.cached_property
    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], SCHEMAS["pages"]).columns

    def clusters(self, threshold: float) -> tuple[DataFrame, DataFrame]:
        """(pages, clusters) by token overlap, slug prefix and vectors."""
        p = self.read("pages")
        sets = p.select(F.col("ord").alias("id"), T.garden_tokens(T.garden_page_text(F.col("slug"), F.col("title"), F.col("tags"), F.col("summary"))).alias("tokens"))
        edges = [J.jaccard_pairs(sets, threshold), J.prefix_edges(p.select("ord", T.slug_prefix(F.col("slug")).alias("prefix")))]
        vectors = self.read("vectors")
        if not vectors.isEmpty():
            edges.append(J.cosine_pairs(vectors.join(p.select("slug", F.col("ord").alias("id")), "slug").select("id", "vec"), self.limits.garden_semantic_threshold))
        return p, J.cluster(p.select("ord"), edges)

    def suggestions(self) -> DataFrame:
        return J.rollup(*self.clusters(self.limits.garden_suggest_threshold))

    def tidy(self, dry_run: bool = False) -> DataFrame:
        """Merge each cluster into its canonical page; returns the clusters.  Raises Busy if another writer is at work."""
        if dry_run:
            return self._tidy(True, None)
        with self.lock() as lease:
            if not lease:
                raise Busy("another writer holds the store's lock")
            return self._tidy(False, lease)

    def _tidy(self, dry_run: bool, lease: Lease | None) -> DataFrame:
        from quillspark.durable import materialize

        base = self.version("pages")
        p, found = self.clusters(self.limits.garden_merge_threshold)
        rolled = materialize(J.rollup(p, found, self.limits.max_tags), "rollup")
        if dry_run or rolled.isEmpty():
            return rolled
        member = rolled.select("canon", F.explode("members").alias("slug"))
        texts = p.join(member, "slug").groupBy("canon").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.substring("body", 1, self.limits.garden_merge_chars).alias("b")))), lambda x: x["b"]), "\n\n").alias("prompt"))
        merged = M.complete(texts, "prompt", self.completer).filter(F.col("reply").isNotNull())
        done = rolled.join(merged.select("canon", "reply"), "canon")
        canon = p.drop("kind", "status", "tags", "sources", "body").join(done.select(F.col("canon").alias("slug"), F.lit("merged").alias("kind"), F.lit("current").alias("status"), "tags", "sources", T.clean_body(F.col("reply")).alias("body")), "slug")
        gone = done.select(F.explode("members").alias("slug"))
        kept = p.join(gone, "slug", "left_anti").select(*self._columns).unionByName(canon.select(*self._columns))
        log = done.select(F.current_timestamp().alias("ts"), F.col("canon").alias("page"), F.lit("merged").alias("kind"), F.lit("merge").alias("action"))
        log = materialize(log, "log")
        self.replace("pages", kept, base, lease)
        self.append("changelog", log)
        return rolled

    def status(self) -> DataFrame:
        return R.status(self.read("pages"), self.notes().count(), self.read("synthed").count())

    def log(self, page: str, last: int = 20) -> DataFrame:
        return self.read("changelog").filter(F.col("page") == page).orderBy(F.desc("ts")).limit(last)

    def remember(self, text: str, title: str = "remembered") -> bool:
        """Ingest one fact and synthesise it at once; whether that made a page."""
        row = [("remember", f"r-{hashlib.sha256(text.encode()).hexdigest()[:16]}", title, None, None, text)]
        self.ingest(self.spark.createDataFrame(row, "source string, id string, title string, date string, cwd string, text string"))
        return self.synth() > 0

    def _due(self) -> bool:
        """Claim the slot of the next tidying, if enough days have gone by and there are enough pages."""
        days = self.limits.tidy_every_days
        if not days or time.time() - float(self.state("last-tidy").get("_ts") or 0) < days * 86_400:
            return False
        if self.read("pages").limit(self.limits.tidy_min_pages).count() < self.limits.tidy_min_pages:
            return False
        self.set_state("last-tidy", {})
        return True

    def _auto_tidy(self) -> str:
        """Tidy when it is due; the claim is released unless that ends well, so the next step tries again."""
        if not self._due():
            return "not due"
        try:
            merged = self.tidy().count()
        except BaseException:
            self.clear_state("last-tidy")
            raise
        self.set_state("last-tidy", {})
        return f"{merged} clusters"

    def reflect(self) -> dict[str, str]:
        """The step after a session: pending notes up to the limit, workspaces, tidying on its cadence, vectors.

        The steps are jobs of one run, whose claim row says how far it is.  A step that fails costs itself only (tidying
        also waits for the notes to be done, as it would merge half of them); a run that was cut off goes on after its
        finished steps.  Returns the outcome of each step, nothing if another run is under way.
        """
        steps = {"synth": lambda: f"{self.synth(self.limits.reflect_max_notes)} notes", "workspace": lambda: f"{self.refresh_workspaces()} workspaces", "tidy": self._auto_tidy, "embed": lambda: f"{self.embed().count()} vectors"}
        with self.lock("reflect") as lease:
            if not lease:
                return {}
            last = self.state("reflect")
            done = {} if last.get("ended", True) else {k: v for k, v in last.get("steps", {}).items() if not v.startswith("failed")}
            for name, step in steps.items():
                if name in done:
                    continue
                if name == "tidy" and done.get("synth", "failed").startswith("failed"):
                    done[name] = "failed: waits for synth"
                else:
                    try:
                        done[name] = step()
                    except Exception as e:  # noqa: BLE001  whatever a model or a writer raises ends this step alone
                        done[name] = f"failed: {type(e).__name__}: {e}"[:200]
                lease.check()
                self.set_state("reflect", {"steps": done, "ended": False, "token": lease.token})
            self.set_state("reflect", {"steps": done, "ended": True, "token": lease.token})
            return done
