"""Readers by kind, crawls, plans of searches, payloads read back, settings."""

import json

from quillspan.sources import feeds, registry, sinks


def urls(*names):
    return "<urlset>" + "".join(f"<url><loc>https://a.example/{n}</loc></url>" for n in names) + "</urlset>"


def test_crawl_takes_the_first_root_and_its_children(spark):
    roots = spark.createDataFrame([("s", 0, "<urlset></urlset>"), ("s", 1, urls("r-1", "r-2")), ("s", 2, urls("never")), ("t", 0, urls("t-1"))], "source string, place int, payload string")
    children = spark.createDataFrame([("s", 0, urls("c-1", "c-2", "c-3")), ("s", 20, urls("beyond")), ("u", 0, urls("u-1"))], "source string, place int, payload string")
    got = {}
    for r in feeds.crawl(roots, children, 4).orderBy("rec_ord").collect():
        got.setdefault(r["source"], []).append(r["url"].rsplit("/", 1)[-1])
    assert got == {"s": ["r-1", "r-2", "c-1", "c-2"], "t": ["t-1"], "u": ["u-1"]}


def test_discovery_gives_normal_addresses(spark):
    a = spark.createDataFrame([("s", 0, "A", "https://A.example/x/?utm_source=1", None, "t", None, None, None), ("s", 1, "B", "", None, "t", None, None, None), ("s", 2, "N", None, None, "t", None, None, None)], feeds.RECORD)
    b = spark.createDataFrame([("s", 0, "C", "https://a.example/x", None, "t", None, None, None), ("s", 1, "D", "https://a.example/y", None, "t", None, None, None)], feeds.RECORD)
    assert {(r["title"], r["url"]) for r in feeds.discover(a, b).collect()} == {("A", "https://a.example/x"), ("D", "https://a.example/y")}


def test_dispatch_by_kind(spark):
    reg = spark.createDataFrame(
        [("feed", "rss", 2, None), ("site", "sitemap_or_search", 1, "q"), ("quiet", "sitemap_or_search", 1, "site:quiet AI"), ("hand", "web_search_query", 5, "by hand"), ("dead", "rss", 5, None), ("odd", "telepathy", 5, None)],
        "name string, kind string, max_entries int, query string",
    )
    record = lambda s, i: (s, i, f"{s}{i}", f"https://{s}.example/{i}", None, "t", None, None, None)
    read = {"rss": spark.createDataFrame([record("feed", i) for i in range(4)] + [record("site", 9)], feeds.RECORD), "sitemap_or_search": spark.createDataFrame([record("site", i) for i in range(3)], feeds.RECORD)}
    records, failed = feeds.dispatch(reg, read)
    got = {}
    for r in records.orderBy("source", "rec_ord").collect():
        got.setdefault(r["source"], []).append(r["title"])
    assert got == {"feed": ["feed0", "feed1"], "site": ["site0", "site1", "site2"], "quiet": ["Search: site:quiet AI"], "hand": ["Search: by hand"]}
    assert {tuple(r) for r in failed.collect()} == {("dead", "no readable record"), ("odd", "no reader for kind telepathy")}


def test_search_plan_and_its_stop(spark):
    plan = feeds.search_plan({"agents": ["agent", "tool use"], "many": [f"k{i}" for i in range(9)]}, "2026-05-01", 25)
    assert plan[1] == ("agents", "tool use", '"tool use" in:name,description pushed:>=2026-05-01 stars:>10', 10) and len(plan) == 8 and plan[2][3] == 5
    steps = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2)], "category string, keyword_ord int")
    rows = spark.createDataFrame([("a", k, i, f"o/r{3 * k + i}", k) for k in range(3) for i in range(3)] + [("a", 1, 9, "o/r0", 1)], "category string, keyword_ord int, rec_ord int, full_name string, v int")
    got = {(r["full_name"], r["v"]) for r in feeds.planned(rows, steps, 4).collect()}
    assert got == {("o/r0", 1), ("o/r1", 0), ("o/r2", 0), ("o/r3", 1), ("o/r4", 1), ("o/r5", 1)}  # the third keyword is never asked for
    links = spark.createDataFrame([("t", 0, "o/agent-kit"), ("t", 1, "o/nothing")], "source string, rec_ord int, full_name string")
    assert [(r["full_name"], r["category"], r["stars"]) for r in feeds.named_repos(links, {"agents": ["agent"], "mesh": ["mesh"]}).collect()] == [("o/agent-kit", "agents", 0)]


def test_payload_is_read_back(spark):
    df = spark.createDataFrame([("2026-01-01", "top", 2, "B"), ("2026-01-01", "top", 1, "A"), ("2026-01-02", "rest", 1, "C")], "issue_date string, section string, place int, title string")
    text = sinks.payload(df, "issue_date", "section", "place")
    got = sinks.read_payload(text, "issue_date").select("issue_date", "section", "place", "title").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in df.collect()}
    other = spark.createDataFrame([("d", json.dumps({"run_log": {"fetched_count": 7, "failures": [{"source": "s", "error": "e"}]}, "note": "x", "list": [{"title": "T", "score": 1.5}, {"title": "U"}]}))], "issue_date string, payload string")
    assert [(r["section"], r["place"], r["title"], r["score"]) for r in sinks.read_payload(other, "issue_date").orderBy("place").collect()] == [("list", 1, "T", 1.5), ("list", 2, "U", None)]
    log = sinks.run_logs(other, "issue_date").first()
    assert log["fetched_count"] == 7 and log["source_count"] is None and log["failures"][0]["error"] == "e"


def test_settings_and_older_registry(spark, tmp_path):
    f = tmp_path / "own.json"
    f.write_text(json.dumps({"weights": {"growth": 0.5}, "new": 1}))
    base = {"weights": {"growth": 0.55, "stars": 0.25}, "hours": 24}
    assert registry.settings(str(f), base) == {"weights": {"growth": 0.5, "stars": 0.25}, "hours": 24, "new": 1}
    assert registry.settings(str(tmp_path / "none.json"), base) == base
    old = tmp_path / "old.json"
    old.write_text(json.dumps([{"name": "A", "url": "https://a.example/", "kind": "rss", "reach": "tier_1_global"}]))
    r = registry.load_any(spark, str(tmp_path / "none.json"), str(old)).first()
    assert (r["name"], r["kind"], r["priority"], r["src_ord"]) == ("A", "rss", "high", 0)
