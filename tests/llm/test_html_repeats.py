"""Several repeated texts of one node are template at any host size."""

from quillspark.llm import html


def test_several_repeated_texts_are_template_on_a_small_host(spark):
    notes = "".join(f"<p>Notice number {k} of the house</p>" for k in range(6))
    page = lambda i: f"<html><body><div class=low>{notes}</div><div class=txt><p>Own text {i} {'abc' * i}</p><p>Same end</p></div></body></html>"
    rows = [(i, "http://h.example/x", page(i)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Notice" not in t and t.startswith(f"Own text {i}") for i, t in got.items())


def house(i, article=False):
    """A page of a host whose classes mean nothing: menu, own texts, and the same closing lines on each."""
    body = f"<p>Own text {i} {'abc' * i}</p><p>More of it {i * 7}</p>"
    menu = "".join(f"<div class=x{k}><a href=/{k}>Item {k}</a> of the house</div>" for k in range(4))
    return f"<html><body><div class=q1>{menu}</div><div class=q2>{body if not article else f'<main>{body}</main>'}</div><div class=q3><p>Call us any day</p><p>We are here</p></div></body></html>"


def test_a_host_without_helpful_class_names(spark):
    rows = [(i, "http://h.example/x", house(i)) for i in range(12)] + [(100, "http://few.example/", house(1))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Own text {i} {'abc' * i}".strip() + f"\nMore of it {i * 7}" for i in range(12))
    assert "Item 3 of the house" in got[100]


def test_entropy_against_brute_force(spark, sf_dir, monkeypatch):
    import math
    from collections import Counter, defaultdict

    from quillspark.llm.common import table

    rows = [(i, "http://h.example/x", house(i % 9, i % 2 == 0)) for i in range(30)] + [(99, None, None)]
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html").unionByName(spark.createDataFrame(rows, "page_id long, url string, html string"))
    seen = {(r["host"], r["html"]) for r in pages.select(html._host(pages["url"]).alias("host"), "html").collect() if r["html"] is not None}
    values = defaultdict(list)
    for host, page in seen:
        for n, f in html.node_features(page, host).items():
            values[host, n].append(f)
    want = defaultdict(list)
    for (host, n), v in values.items():
        if len(v) >= html.MIN_PAGES:
            e = -sum(c / len(v) * math.log(c / len(v)) for c in Counter(v).values()) / math.log(len(v))
            want[host, n >> 1].append((e, 1 - html.PRESENTATION if n & 1 else html.PRESENTATION))
    want = {k: sum(e * w for e, w in v) / sum(w for _, w in v) for k, v in want.items()}
    got = {(r["host"], r["node"]): r["entropy"] for r in html.style_tree(pages).collect()}
    assert got.keys() == want.keys() and len(got) > 10 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    by_broadcast = sorted(map(tuple, html.extract(pages).collect()), key=repr)
    monkeypatch.setattr(html, "small", lambda *_: False)
    assert sorted(map(tuple, html.extract(pages).collect()), key=repr) == by_broadcast
