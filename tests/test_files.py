"""Slide decks, the files that locators name, nested repositories, workspace maps and the command verbs."""

import io
import json
import sqlite3
import zipfile

import pytest

from quillspark import __main__ as cli
from quillspark import config as C
from quillspark.sources import files as X
from quillspark.sources import sessions as R
from quillspark.store import NO_PROFILE, SCHEMAS, Store

NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def said(*paragraphs):
    return "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in paragraphs)


def shape(*paragraphs):
    return f"<p:sp><p:txBody>{said(*paragraphs)}</p:txBody></p:sp>"


def deck(*slides):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ids = "".join(f'<p:sldId id="{256 + n}" r:id="rId{n}"/>' for n in range(len(slides)))
        z.writestr("ppt/presentation.xml", f"<p:presentation {NS}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>")
        # the order of the files is not that of the slides
        z.writestr("ppt/_rels/presentation.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{n}" Target="slides/slide{9 - n}.xml"/>' for n in range(len(slides))) + "</Relationships>")
        for n, s in enumerate(slides):
            z.writestr(f"ppt/slides/slide{9 - n}.xml", f"<p:sld {NS}><p:cSld><p:spTree>{s}</p:spTree></p:cSld></p:sld>")
    return out.getvalue()


def table(*rows):
    made = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody>{said(c)}</a:txBody></a:tc>" for c in r) + "</a:tr>" for r in rows)
    return f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl>{made}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"


def test_decks(spark, tmp_path):
    (tmp_path / "a.pptx").write_bytes(deck(shape("Títle", "second") + shape(" "), f"<p:grpSp>{shape('grouped')}</p:grpSp>" + table(("x", "1"), (" ", ""), ("y", "2"))))
    (tmp_path / "b.pptx").write_bytes(b"no archive")
    (tmp_path / "c.pptx").write_bytes(deck())
    (tmp_path / "d.txt").write_text("other")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in X.read_decks(spark, str(tmp_path)).collect()}
    assert got == {"a.pptx": "## Slide 1\nTítle\nsecond\n## Slide 2\nx | 1\ny | 2", "b.pptx": None, "c.pptx": None}
    assert X.deck_text(None) is None


def test_local_files(spark, tmp_path):
    for name in ("abs.md", "base/rel.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = [
        ("1", "rel.md", f"{tmp_path}/abs.md", True),
        ("2", "rel.md", f"{tmp_path}/gone.md", True),
        ("3", "rel.md", None, False),
        ("4", "none.md", None, True),
        ("5", None, None, None),
    ]
    entries = spark.createDataFrame(rows, "id string, path string, local_path string, local_readable boolean")
    files = X.listing(spark, str(tmp_path))
    base = f"{tmp_path}/base"
    got = {r["id"]: r["file"] for r in X.local_files(entries, files.unionByName(files), base + "/").collect()}
    assert got == {"1": f"{tmp_path}/abs.md", "2": f"{base}/rel.md", "3": None, "4": None, "5": None}
    assert X.local_files(entries, files).filter("file is not null").count() == 1
    assert X.content_root(entries, files, ["/none", base, str(tmp_path)]) == base
    assert X.content_root(entries, files, ["", "/none", "/nope"]) == "/none"
    assert X.content_root(entries.limit(0), files, []) is None


def test_nested_repos(spark):
    repos = lambda *paths: sorted(r["repo"] for r in X.nested_repos(spark.createDataFrame([(p,) for p in paths], "path string"), "/w/").collect())
    assert repos("/w/a/.git/HEAD", "/w/a/.git/config", "/w/b/c/.git/HEAD", "/w/b/c/d/.git/HEAD", "/x/y/.git/HEAD", "/w/e/.gitignore") == ["/w/a", "/w/b/c"]
    assert repos("/w/a/.git/HEAD", "/w/.git/HEAD") == ["/w"]
    assert repos("/w/a.txt") == ["/w"] and repos("/w/link/.git") == ["/w/link"]


def database(path, value):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE ItemTable (key TEXT, value BLOB)")
    con.executemany("INSERT INTO ItemTable VALUES (?, ?)", [("composer.composerData", value), ("composer.composerData2", '{"allComposers":[{"composerId":"no"}]}')])
    con.commit()
    con.close()


def test_workspace_folders(spark, tmp_path):
    threads = lambda *ids: json.dumps({"allComposers": [{"composerId": i} for i in ids] + ["odd", {"composerId": ""}, {}]})
    for name, folder, value in [
        ("a 1", "file:///w/a%20b+c", threads("t1", "t2").encode()),
        ("b", "/w/plain", threads("t2", "t3")),
        ("c", 7, threads("t4")),
        ("d", "file:///w/d", "{bad"),
        ("e", "file:///w/100%", threads("t5")),
    ]:
        (tmp_path / name).mkdir()
        (tmp_path / name / "workspace.json").write_text(json.dumps({"folder": folder}))
        database(tmp_path / name / "state.vscdb", value)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "workspace.json").write_text('{"folder": "/w/f"}')
    (tmp_path / "f" / "state.vscdb").write_text("no database")
    got = {r["id"]: r["cwd"] for r in R.workspace_folders(spark, str(tmp_path)).collect()}
    assert got == {"t1": "/w/a b+c", "t2": "/w/a b+c", "t3": "/w/plain", "t5": "/w/100%"}


def test_threads_are_placed(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "kv.db")
    con.execute("CREATE TABLE cursorDiskKV (key TEXT, value TEXT)")
    con.execute("INSERT INTO cursorDiskKV VALUES (?, ?)", ("composerData:t1", "{}"))
    con.execute("INSERT INTO cursorDiskKV VALUES (?, ?)", ("bubbleId:t1:a", json.dumps({"type": 1, "text": "question"})))
    con.commit()
    con.close()
    (tmp_path / "s" / "a").mkdir(parents=True)
    (tmp_path / "s" / "a" / "workspace.json").write_text('{"folder": "file:///w/a"}')
    database(tmp_path / "s" / "a" / "state.vscdb", '{"allComposers":[{"composerId":"t1"}]}')
    stores = {"cursor": str(tmp_path / "kv.db")}
    assert [r["cwd"] for r in R.union_sessions(spark, stores, workspace="/w/a", storage=str(tmp_path / "s")).collect()] == ["/w/a"]
    assert R.union_sessions(spark, stores, workspace="/w/a").count() == 0


def test_only_folders_of_the_workspace_are_read(spark, tmp_path):
    log = lambda cwd: json.dumps({"type": "user", "cwd": cwd, "timestamp": "2024-01-02", "message": {"content": "q"}})
    for folder, cwd in [("-w-a", "/w/a"), ("-w-a-x", "/w/a/x"), ("-w-a-y", "/w/a.y"), ("-w-ab", "/w/ab"), ("-w-b", "/w/b")]:
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s.jsonl").write_text(log(cwd))
    names = [p.rsplit("/", 1)[1] for p in R.log_folders(spark, str(tmp_path), "/w/a/")]
    assert names == ["-w-a", "-w-a-x", "-w-a-y"]
    got = R.union_sessions(spark, {"claude": str(tmp_path)}, workspace="/w/a")
    assert sorted(r["cwd"] for r in got.collect()) == ["/w/a", "/w/a/x"]
    assert R.union_sessions(spark, {"claude": str(tmp_path)}, workspace="/q").count() == 0
    assert R.log_folders(spark, str(tmp_path / "none"), "/w/a") == []


def test_keys_payloads_and_models():
    settings = {"api_key_env": "K", "api_key_helper": "echo helped", "api_key": "literal"}
    assert C.resolve_key(settings, {"K": " set "}) == "set" and C.resolve_key(settings, {}) == "helped"
    assert C.resolve_key({**settings, "api_key_helper": "true"}, {"K": ""}) == "literal" and C.resolve_key({}, {}) is None
    for helper in ("false", "/no/such/helper"):
        with pytest.raises(RuntimeError):
            C.resolve_key({"api_key_helper": helper, "api_key": "literal"}, {})
    assert C.payload('{"prompt": "x"}') == {"prompt": "x"} and [C.payload(t) for t in ("", None, "[1]", "{bad")] == [{}] * 4
    assert [C.recommend_models(gb)[1] for gb in (8, 9.3, 16, 32, 64)] == ["qwen2.5:7b", "phi4:14b", "deepseek-r1:14b", "qwen3:32b", "llama3.3:70b"]
    assert len(C.today()) == 10


def test_profile(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.profile() == NO_PROFILE
    (tmp_path / "ABOUT.md").write_text("  \n")
    assert store.profile() == NO_PROFILE
    (tmp_path / "ABOUT.md").write_text(" olá " + "x" * 2000)
    assert len(store.profile()) == 900 and store.profile(3) == "olá"


def test_verbs(spark, tmp_path, capsys):
    path, logs = str(tmp_path / "store"), tmp_path / "logs"
    (logs / "-w-shop").mkdir(parents=True)
    (logs / "-w-shop" / "s.jsonl").write_text(json.dumps({"type": "user", "cwd": "/w/shop", "timestamp": "2024-01-02", "message": {"content": "Databricks cluster sizing for the shop"}}))

    def call(*args, text=""):
        status = cli.run(spark, cli.parser().parse_args(["--store", path, "--workspace", "/w/shop", *args]), text)
        return status, [json.loads(line) for line in capsys.readouterr().out.splitlines()]

    assert call("init") == (0, [{"created": list(SCHEMAS)}]) and call("init") == (0, [{"created": []}])
    assert call("ingest", "claude", str(logs)) == (0, [{"ingested": 1}])
    assert call("synth") == (0, [{"pages": 1}])
    found = call("search", "databricks cluster sizing")[1]
    assert [r["rank"] for r in found] == [1]
    assert call("hook", text=json.dumps({"prompt": "databricks cluster sizing for the shop"}))[1] == call("recall", "databricks cluster sizing for the shop")[1]
    assert call("hook", text="{bad") == (0, [])
    assert call("boot")[1][0]["pages"] == 1
    with Store(spark, path).lock():
        assert call("tidy")[0] == cli.BUSY
    assert call("remember", "The vault password rotates monthly.", "--title", "Rotation rule") == (0, [{"synthesized": True}])
    assert call("log", "rotation-rule", "--last", "1")[1][0]["page"] == "rotation-rule"
    assert call("embed") == (0, [{"vectors": 2}])
    assert call("status")[0] == 0
