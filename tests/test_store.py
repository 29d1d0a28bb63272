"""The store's verbs end to end on a few sessions, and the driver-side configuration."""

import pytest
from pyspark.sql import functions as F

from quillspark import config as C
from quillspark.store import Store

SCHEMA = "source string, id string, title string, date string, cwd string, text string"
ROWS = [
    ("claude", "a", "Databricks cluster sizing", "2024-01-02", "/w/infra", "## user\n\nHow should databricks clusters be sized? mail a@b.co"),
    ("codex", "b", "Checkout alerts", "2024-01-03", "/w/shop", "## user\n\nCheckout alerts fire twice."),
    ("codex", "c", "Checkout alerts", "2024-01-04", "/w/shop", "## user\n\nMore about alerts."),
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    sessions = spark.createDataFrame(ROWS, SCHEMA)
    assert s.ingest(sessions) == 3 and s.ingest(sessions) == 0
    assert s.synth() == 3 and s.synth() == 0
    return s


def test_notes_are_scrubbed(store):
    r = store.notes().filter("sid = 'a'").first()
    assert "<email>" in r["body"] and r["pii"] == ["<email>"] and r["raw_name"].startswith("2024-01-02--claude--databricks-cluster-sizing--")


def test_pages_merge_by_slug(store):
    got = {r["slug"]: r for r in store.read("pages").collect()}
    assert set(got) == {"databricks-cluster-sizing", "checkout-alerts"}
    assert len(got["checkout-alerts"]["sources"]) == 2 and got["checkout-alerts"]["project"] == "shop"
    assert {r["measure"]: r["n"] for r in store.status().filter("measure in ('raw','synthed','pending')").collect()} == {"raw": 3, "synthed": 3, "pending": 0}


def test_search_recall_boot(store, spark):
    prompts = spark.createDataFrame([(1, "databricks sizing of a cluster"), (2, "ok")], "prompt long, text string")
    assert [r["slug"] for r in store.search(prompts).filter("prompt = 1 and rank = 1").collect()] == ["databricks-cluster-sizing"]
    hit = store.recall(prompts)
    assert {(r["prompt"], r["slug"]) for r in hit.collect()} == {(1, "databricks-cluster-sizing")}
    assert store.recall(prompts, hit.select("prompt", "slug")).count() == 0
    store.refresh_workspace("shop")
    b = store.boot("shop").first()
    assert b["pages"] == 1 and b["body"].startswith("## ")


def test_remember_embed_tidy(store):
    assert store.remember("The vault password rotates monthly.", "Rotation rule")
    assert store.embed().count() == store.read("pages").count()
    assert store.tidy(dry_run=True).count() == store.tidy().count()
    assert store.log("rotation-rule").count() == 1


def test_config():
    assert C.Limits.load({"max_tags": 3, "unknown": 1}).max_tags == 3 and C.Limits().slug_max == 60
    assert C.merge({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 9}, "d": {"e": 1}}) == {"a": {"b": 9, "c": 2}, "d": {"e": 1}}
    assert [C.coerce(x) for x in ("true", "null", "-12", "1.5", "x")] == [True, None, -12, "1.5", "x"]
    assert C.set_value({"a": {"b": 1}}, "a.c", 2) == {"a": {"b": 1, "c": 2}}
    with pytest.raises(ValueError):
        C.set_value({"a": {"b": 1}}, "a", 2)
    assert C.extract_json('x ```json\n{"a": {"b": 1}} trailing}\n```') == {"a": {"b": 1}}
    assert C.extract_json("none") is None and C.extract_json("{bad}") is None
    assert C.resolve_store(None, "/w", {"/w": "/s"}, "/d") == "/s" and C.resolve_store("/x", "/w", {"/w": "/s"}) == "/x"
    assert C.resolve_provider({"provider": {"order": ["p"], "p": {"u": 1}}}, models={"merge": "m"}) == ("p", {"u": 1, "model_merge": "m"})
    assert C.resolve_embeddings({"provider": {"embeddings": {"model": "m"}}}) == (None, None)
    assert C.resolve_embeddings({"provider": {"embeddings": {"model": "m"}}}, {"base_url": "b"})[0] == "m"


def test_keyed_state(store):
    assert store.state("recall a/b") == {}
    store.set_state("recall a/b", {"n": 1, "pages": ["x"]})
    store.set_state("recall a/b", {"n": 2})
    got = store.state("recall a/b")
    assert got["n"] == 2 and "pages" not in got and got["_ts"] > 0 and store.state("recall-a-b") == got
    store.clear_state("recall a/b")
    store.clear_state("recall a/b")
    assert store.state("recall a/b") == {}


def test_one_writer_at_a_time(store):
    from quillspark.store import Busy

    with store.lock() as mine:
        assert mine
        with store.lock() as other:
            assert not other
        assert store.synth() == 0
        with pytest.raises(Busy):
            store.tidy()
    with store.lock() as mine:
        assert mine


def test_recall_past_pages_that_were_shown(store, spark):
    prompts = spark.createDataFrame([("p", "how should databricks clusters be sized and checkout alerts fire")], "prompt string, text string")
    first = store.recall(prompts).collect()
    shown = spark.createDataFrame([("p", r["slug"]) for r in first] or [("p", "")], "prompt string, slug string")
    assert store.recall(prompts, shown).join(shown, ["prompt", "slug"]).count() == 0
