"""Command verbs over a store: ``python -m quillspark VERB ...``; each prints JSON lines.

Verbs that find another writer at work end with status 3.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from quillspark import config as C
from quillspark.sources import sessions as R
from quillspark.store import Busy, Store

BUSY = 3


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark", description=__doc__.splitlines()[0])
    p.add_argument("--store", help="folder of the store; else that of the workspace, else the default")
    p.add_argument("--workspace", help="folder that the session works in")
    verbs = p.add_subparsers(dest="verb", required=True)
    add = lambda name, about: verbs.add_parser(name, help=about, description=about)
    add("init", "create the store's tables that are missing")
    add("status", "what the store holds")
    v = add("search", "pages for a question, without gates")
    v.add_argument("text")
    v.add_argument("--limit", type=int)
    for name in ("recall", "retrieve"):
        add(name, "pages for a prompt, gated").add_argument("text")
    add("boot", "what a new session of the workspace should know")
    v = add("ingest", "take in session logs")
    v.add_argument("backend", choices=sorted(R.BACKENDS))
    v.add_argument("path")
    v.add_argument("--since", help="YYYY-MM-DD")
    v.add_argument("--storage", help="workspace storage that places the threads")
    v = add("synth", "turn pending notes into pages")
    v.add_argument("--limit", type=int)
    v = add("remember", "take in one fact")
    v.add_argument("text")
    v.add_argument("--title", default="remembered")
    add("reflect", "pending notes up to the limit, then vectors")
    add("embed", "bring the vectors up to date")
    add("gardening", "clusters of pages that may be merged")
    v = add("tidy", "merge clusters of pages")
    v.add_argument("--dry-run", action="store_true")
    v = add("log", "changes of a page")
    v.add_argument("page")
    v.add_argument("--last", type=int, default=20)
    add("hook", "take a hook's JSON from the input and recall for its prompt")
    return p


def _show(df: DataFrame) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def run(spark: SparkSession, args: argparse.Namespace, text: str = "") -> int:
    """One verb; ``text`` is the input of ``hook``.  Returns the exit status."""
    store = Store(spark, C.resolve_store(args.store, args.workspace))
    key = store.project(args.workspace)
    ask = lambda t: spark.createDataFrame([("prompt", t)], "prompt string, text string")
    say = lambda **found: print(json.dumps(found))
    match args.verb:
        case "init":
            say(created=store.init())
        case "status":
            _show(store.status())
        case "search":
            _show(store.search(ask(args.text), limit=args.limit))
        case "recall" | "retrieve":
            _show(store.recall(ask(args.text)))
        case "hook":
            _show(store.recall(ask(str(C.payload(text).get("prompt") or ""))))
        case "boot":
            _show(store.boot(key))
        case "ingest":
            say(ingested=store.ingest(R.union_sessions(spark, {args.backend: args.path}, args.workspace, args.since, args.storage)))
        case "synth":
            say(pages=store.synth(args.limit))
        case "remember":
            say(synthesized=store.remember(args.text, args.title))
        case "reflect":
            store.reflect()
            _show(store.status())
        case "embed":
            say(vectors=store.embed().count())
        case "gardening":
            _show(store.suggestions())
        case "tidy":
            try:
                _show(store.tidy(args.dry_run))
            except Busy:
                return BUSY
        case "log":
            _show(store.log(args.page, args.last))
    return 0


def main() -> int:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    try:
        return run(spark, args, sys.stdin.read() if args.verb == "hook" and not sys.stdin.isatty() else "")
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
