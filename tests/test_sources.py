import json
from datetime import date, datetime

from pyspark.sql import functions as F

from quillspan.sources import feeds, markdown, registry, sinks
from quillspan.streaming import ingest as st


def payload(spark, text, **more):
    cols = {"source": "s", "payload": text} | more
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))


def test_rss_and_atom(spark):
    rss = """<rss><channel><title>x</title><item><title><![CDATA[A & <b>B</b>]]></title><link>https://a.example/1?a=1&b=2</link>
      <description>Some &lt;p&gt;text&lt;/p&gt;</description><pubDate>Tue, 05 May 2026 10:00:00 GMT</pubDate></item><item><title>No date</title><link>u</link></item></channel></rss>"""
    r = feeds.feed(payload(spark, rss)).orderBy("rec_ord").collect()
    assert [(x["rec_ord"], x["url"], x["published_at"]) for x in r] == [(0, "https://a.example/1?a=1&b=2", datetime(2026, 5, 5, 10)), (1, "u", None)]
    assert r[0]["title"] == "A & B" and r[0]["text"].startswith("A & B Some")
    atom = """<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:entry><a:title>T</a:title><a:link rel="x" href="https://b.example/"/><a:updated>2026-05-05T08:00:00Z</a:updated>
      <a:summary>S</a:summary></a:entry></a:feed>"""
    r = feeds.feed(payload(spark, atom)).first()
    assert (r["title"], r["url"], r["published_at"], r["text"]) == ("T", "https://b.example/", datetime(2026, 5, 5, 8), "T S")
    bad = payload(spark, "<html>not a feed")
    assert feeds.feed(bad).collect() == [] and feeds.failures(bad, feeds.feed(bad)).count() == 1


def test_sitemaps_and_preprints(spark):
    xml = """<urlset><url><loc>https://a.example/news/big-step.html</loc><lastmod>2026-05-05</lastmod></url><url><loc> </loc></url></urlset>"""
    r = feeds.sitemap(payload(spark, xml)).collect()
    assert [(x["title"], x["published_at"]) for x in r] == [("Big Step", datetime(2026, 5, 5))]
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://a.example/{i}.xml</loc></sitemap>" for i in range(30)) + "</sitemapindex>"
    assert feeds.child_sitemaps(payload(spark, index)).count() == 20
    ax = "<feed><entry><id>http://arxiv.org/abs/1</id><title>A\n  B</title><published>2026-05-05T00:00:00Z</published><summary> S </summary><author><name>X Y</name></author><author><name>Z</name></author></entry></feed>"
    r = feeds.arxiv(payload(spark, ax)).first()
    assert (r["title"], r["published"], r["authors"], r["abstract"]) == ("A B", "2026-05-05", ["X Y", "Z"], "S")


def test_json_readers(spark):
    hits = {"hits": [{"title": "T", "url": None, "objectID": "7", "created_at_i": 1777975200, "points": 5, "num_comments": 2, "extra": 1}]}
    r = feeds.story_search(payload(spark, json.dumps(hits))).first()
    assert r["url"].endswith("id=7") and r["points"] == 5 and r["comments"] == 2 and r["published_at"] == datetime.fromtimestamp(1777975200)
    listing = {"data": {"children": [{"data": {"title": "T", "url": "https://u", "created_utc": 1777975200.0, "selftext": "more", "ups": 3, "num_comments": 1}}]}}
    r = feeds.forum_listing(payload(spark, json.dumps(listing))).first()
    assert (r["text"], r["upvotes"]) == ("T more", 3)
    page = {"total_count": 1, "items": [{"full_name": "o/r", "html_url": "h", "description": None, "stargazers_count": 5, "updated_at": "2026-05-05T01:02:03Z", "owner": None, "topics": ["a"]}]}
    r = feeds.repo_search(payload(spark, json.dumps(page), snapshot_date="2026-05-06")).first()
    assert (r["author"], r["stars"], r["forks"], r["last_update"], r["description"], r["snapshot_date"]) == ("o", 5, 0, "2026-05-05", "", date(2026, 5, 6))
    assert feeds.story_search(payload(spark, "not json")).collect() == []


def test_links(spark):
    html = """<a class=x href="/news/long-story">A long enough title</a><a href='https://other.example/x'>Another long title</a><a href="/b-c">go</a><a href="mailto:x">mail me please</a>"""
    r = feeds.page_links(payload(spark, html, base_url="https://a.example/")).orderBy("rec_ord").collect()
    assert [(x["title"], x["url"]) for x in r] == [("A long enough title", "https://a.example/news/long-story"), ("B C", "https://a.example/b-c")]
    repos = """<a href="/o/r">x</a><a href="/o/r">again</a><a href="/topics/ai">t</a><a href="/o/r/issues">i</a><a href="https://g.example/p/q?tab=1">y</a>"""
    assert [x["full_name"] for x in feeds.repo_links(payload(spark, repos)).orderBy("rec_ord").collect()] == ["o/r", "p/q"]


def test_markdown_round_trip(spark):
    items = [{"headline": "One", "label": "L1", "url": "https://a.example/1"}, {"headline": "Two", "label": "L2", "url": "https://a.example/2"}]
    text = markdown.render("Issue", [("General", items), ("Empty", []), ("Engineering", items[:1])]) + "\n## End\n1. **Not counted**\nSource: [x](https://x.example)\n## Engineering\n2. Short line. Source: [C](https://c.example)\n"
    lines = spark.createDataFrame([("d", i, l) for i, l in enumerate(text.split("\n"))], "doc string, line_no int, line string")
    got = {(r["section"], r["pos"], r["headline"], r["label"], r["url"]) for r in markdown.sections(lines, {"General": "g", "Engineering": "e", "Empty": "n"}, ("End",)).collect()}
    assert got == {("g", 1, "One", "L1", "https://a.example/1"), ("g", 2, "Two", "L2", "https://a.example/2"), ("e", 1, "One", "L1", "https://a.example/1"), ("e", 2, "Short line", "C", "https://c.example")}
    assert markdown.table_lines(["A"], [("x|y",), (None,)]).split("\n")[2:] == ["| 1 | x/y |", "| 2 | - |"]


def test_registry(spark, tmp_path):
    f = tmp_path / "sources.json"
    f.write_text(json.dumps({"sources": [{"name": "N", "url": "https://example.com/x", "source_type": "website", "category": "cae_ai_engineering"}, {"name": "Off", "enabled": False}]}))
    r = registry.normalised(registry.load(spark, str(f))).collect()
    assert [(x["name"], x["kind"], x["query"], x["priority"], x["max_entries"], x["category"], x["tags"], x["src_ord"]) for x in r] == [("N", "sitemap_or_search", "site:example.com AI", "medium", 25, "engineering_ai", [], 0)]
    old = spark.createDataFrame([("A", "https://a.example/", "rss", "tier_1_global", "x"), ("B", "https://b.example/", None, "odd", "cae_ai_engineering"), ("C", "https://c.example/", None, "community", None)], "name string, url string, kind string, reach string, category string")
    got = registry.from_legacy(old)
    assert [(x["priority"], x["category"], x["source_type"], x["fetch_type"]) for x in got.collect()] == [("high", "x", "rss", "rss"), ("medium", "engineering_ai", "manual", "web_search_query"), ("low", "general_ai", "manual", "web_search_query")]
    assert [x["kind"] for x in registry.normalised(got).collect()] == ["rss", "web_search_query", "web_search_query"]


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "issues")
    df = spark.createDataFrame([("2026-01-01", "a", 1, "x"), ("2026-01-02", "a", 1, "y")], "issue_date string, section string, place int, title string")
    sinks.write_issue(df, p)
    sinks.write_issue(df.where("issue_date = '2026-01-02'").withColumn("title", F.lit("z")), p)
    assert {(str(r["issue_date"]), r["title"]) for r in spark.read.parquet(p).collect()} == {("2026-01-01", "x"), ("2026-01-02", "z")}
    assert json.loads(sinks.payload(df, "issue_date", "section", "place").orderBy("issue_date").first()["payload"]) == {"a": [{"place": 1, "title": "x"}]}
    s = str(tmp_path / "snap")
    assert sinks.read_snapshots(spark, s).count() == 0
    row = spark.createDataFrame([(date(2026, 1, 1), "o/r", 5)], "snapshot_date date, full_name string, stars long")
    sinks.append_snapshots(row, s)
    sinks.append_snapshots(row, s)
    assert [(r["full_name"], r["stars"], r["forks"]) for r in sinks.read_snapshots(spark, s).collect()] == [("o/r", 5, None)] * 2
    assert not sinks.write_guarded(df, str(tmp_path / "g"), 3) and sinks.write_guarded(df, str(tmp_path / "g"), 2)
    assert {tuple(r) for r in sinks.merge_cache(df.select("section", "title").limit(1), df.select("section", F.lit("new").alias("title")).limit(1), "section").collect()} == {("a", "new")}


def test_streaming_ingest_adds_each_record_once(spark, tmp_path):
    schema = "id string, at timestamp, kind string"
    src, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in ([("a", datetime(2026, 1, 1), "x"), ("b", datetime(2026, 1, 1), "y")], [("a", datetime(2026, 1, 2), "x"), ("c", datetime(2026, 1, 2), "x")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = st.stream_records(spark, src, spark.createDataFrame([], schema).schema, 1)
        st.ingest(stream, target, check, "id", "at").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]
    counts = st.windowed_counts(st.stream_records(spark, src, spark.createDataFrame([], schema).schema), "at", "kind", "1 day", "1 hour")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r["start"]), r["kind"], r["n"]) for r in spark.table("counts").collect()} == {("2026-01-01 00:00:00", "x", 1), ("2026-01-01 00:00:00", "y", 1), ("2026-01-02 00:00:00", "x", 2)}


def test_discovery_and_caps(spark):
    assert spark.range(1).select(feeds.sitemap_addresses(F.lit("https://a.example/news/")).alias("s")).first()["s"] == ["https://a.example/sitemap.xml", "https://a.example/news/sitemap.xml"]
    assert spark.range(1).select(feeds.sitemap_addresses(F.lit("nowhere")).alias("s")).first()["s"] == []
    one = feeds.sitemap(payload(spark, "<urlset><url><loc>https://a.example/one-page?utm_source=x</loc></url></urlset>"))
    two = feeds.page_links(payload(spark, '<a href="/one-page">The very same page</a><a href="/two-page">Another page again</a>', base_url="https://a.example/"))
    assert [r["title"] for r in feeds.discover(one, two).orderBy("url").collect()] == ["One Page", "Another page again"]
    records = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(5)], "source string, rec_ord int")
    caps = spark.createDataFrame([("a", "rss", 2), ("b", "sitemap_or_search", 2)], "name string, kind string, max_entries int")
    assert {(r["source"], r["n"]) for r in feeds.capped(records, caps).groupBy("source").agg(F.count("*").alias("n")).collect()} == {("a", 2), ("b", 5)}
