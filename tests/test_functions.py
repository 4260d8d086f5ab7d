from datetime import date, datetime

from pyspark.sql import functions as F

from quillspan.functions import rules, scores, text, times, urls


def value(spark, column, **inputs):
    df = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'timestamp' if isinstance(v, datetime) else 'double'}" for k, v in inputs.items()))
    return df.select(column.alias("v")).first()["v"]


def test_text(spark):
    x = F.col("x")
    assert value(spark, text.clean_text(x), x="<p>a &amp; b</p>  <b>c</b>\n") == "a & b c"
    assert value(spark, text.clean_text(x), x=None) == ""
    assert value(spark, text.looks_english(x), x="a plain text of more than twenty letters") is True
    assert value(spark, text.looks_english(x), x="short") is False
    assert value(spark, text.looks_english(x), x="ключевые слова и немного english text here abc") is False
    assert value(spark, text.looks_english(x), x=None) is False
    assert value(spark, text.term_hits(x, ["AI", "rom", "zz"]), x="Said from") == ["AI", "rom"]
    assert value(spark, text.keyword_match(x, ["a"], ["stock"]), x="a Stockholm talk") == []
    assert value(spark, text.gate(x, []), x="anything") is True
    assert value(spark, text.slug(x), x="  A/b--C! ") == "a_b_c"
    assert value(spark, text.heading_id(x), x="***") == "section"
    assert value(spark, text.clean_cell(x), x="a|b\nc") == "a/b c"
    assert value(spark, text.clean_cell(x), x="y" * 200) == "y" * 107 + "..."
    assert value(spark, text.clean_cell(x), x=None) == "-"
    assert value(spark, text.event_tokens(x), x="The new GPU of Acme gets an AI chip - Daily Wire") == ["acme", "chip", "gets", "gpu"]
    assert value(spark, text.python_title(x), x="it's 3d-print") == "It'S 3D-Print"
    assert value(spark, text.py_round(F.col("x"), 2), x=2.675) == 2.67
    assert value(spark, text.extract_summary(F.lit("Big title"), x), x="Big title - First one. Second two! Third.") == "First one. Second two!"
    assert value(spark, text.extract_summary(F.lit(""), x), x="") == "No summary."
    assert len(value(spark, text.extract_summary(F.lit(""), x), x="z" * 900)) == 340
    assert value(spark, text.entry_id(x, F.lit("T")), x="https://A.example/x") == value(spark, text.entry_id(x, F.lit("T")), x="HTTPS://a.example/X")


def test_urls(spark):
    x = F.col("x")
    assert value(spark, urls.normal_url(x), x="https://A.example/Path/?utm_source=q&b=2&c=&a=1#f") == "https://a.example/Path?b=2&a=1"
    assert value(spark, urls.page_url(x), x="https://A.example/Path/?q=1#f") == "https://a.example/path"
    assert value(spark, urls.page_url(x), x="a.example/path") == ""
    assert value(spark, urls.shown_url(x), x="https://a.example/X/?utm_m=1&gclid=3#f") == "https://a.example/x"
    assert value(spark, urls.article_url(x), x="http://arxiv.org/pdf/2601.01234v2") == "https://arxiv.org/abs/2601.01234"
    assert value(spark, urls.article_url(x), x="https://a.example/p?x=1") == "https://a.example/p"
    assert value(spark, urls.title_from_url(x), x="https://a.example/news/industrial-ai-forum.html") == "Industrial Ai Forum"
    assert value(spark, urls.title_from_url(x), x="https://a.example/100%25-a+b") == "100% A+B"
    assert value(spark, urls.title_from_url(x), x="https://www.a.example/") == "a.example"
    assert value(spark, urls.same_site(F.lit("https://a.example/x/"), x), x="../y#z") == "https://a.example/y"
    assert value(spark, urls.same_site(F.lit("https://a.example/x/"), x), x="https://b.example/") is None
    assert value(spark, urls.same_site(F.lit("https://a.example/x/"), x), x="mailto:a@b") is None


def test_times(spark):
    assert times.weekly(date(2026, 7, 12)).end == times.weekly(date(2026, 7, 13)).end == date(2026, 7, 12)
    assert times.weekly(date(2026, 7, 12)).start == date(2026, 7, 5)
    m = times.monthly(date(2026, 8, 1))
    assert (m.start, m.end) == (date(2026, 7, 1), date(2026, 7, 31))
    x = F.col("x")
    at = lambda s: value(spark, times.feed_time(x), x=s)
    assert at("Tue, 05 May 2026 10:00:00 +0200") == at("2026-05-05T08:00:00Z") == datetime(2026, 5, 5, 8)
    assert at("2026-05-05") == datetime(2026, 5, 5)
    assert at("2026-05-05T08:00:00.123Z") is None and at("soon") is None and at(None) is None
    now = F.lit("2026-05-05 00:00:00").cast("timestamp")
    r = lambda d: value(spark, times.recency(F.to_timestamp(F.lit(d)), now, F.lit(24)), y=1.0)
    assert r(None) == 0.35 and r("2026-05-05") == 1.0 and r("2026-05-04 12:00:00") == 0.625 and r("2026-05-03") == 0.0 and r("2026-05-06") == 1.0
    a = lambda *d: value(spark, times.activity(F.lit(date(2026, 5, 5)), *[F.lit(v).cast("string") for v in d]), y=1.0)
    assert [a("2026-05-01"), a("", "2026-04-10"), a(None, "2026-02-10T00:00:00Z"), a("2025-01-01"), a("bad")] == [1.0, 0.7, 0.4, 0.1, 0.0]
    assert value(spark, times.week_end(F.lit(date(2026, 7, 15))), y=1.0) == date(2026, 7, 12)


def test_scores_and_rules(spark):
    x = F.col("x")
    assert value(spark, scores.log_scale(x, 1200), x=1200.0) == 1.0
    assert value(spark, scores.log_scale(x, 1200), x=None) == 0.0 and value(spark, scores.log_scale(x, 9), x=-3.0) == 0.0
    assert value(spark, scores.safe_norm(x, F.lit(0)), x=5.0) == 0.0 and value(spark, scores.safe_norm(x, F.lit(10)), x=5.0) == 0.5
    parts = {"priority": F.lit(1.0), "novelty": F.lit(0.6), "general": F.lit(0.5), "engineering": F.lit(1.0), "research": F.lit(0.0)}
    none = {k: F.lit(None).cast("double") for k in ("points", "comments", "upvotes")}
    assert value(spark, scores.record_score(parts, F.lit(True), none), y=1.0) == 32 + 13.2 + 10 + 14 + 10
    assert value(spark, F.size(scores.reasons(parts, F.lit(True), none)), y=1.0) == 6
    table = [("both", [["a"], ["b", "c"]]), ("one", [["a"]])]
    rule = lambda s: value(spark, rules.first_rule(x, table, "none"), x=s)
    assert [rule("A c"), rule("a"), rule("c"), rule(None)] == ["both", "one", "none", "none"]
    assert value(spark, rules.any_word(x, ["gene", "life sciences"]), x="oxygene") is False
    assert value(spark, rules.any_word(x, ["gene", "life sciences"]), x="Life Sciences, again") is True
    assert value(spark, rules.any_word(x, ["clinical"]), x="éclinical") is False
    got = value(spark, rules.keyword_scores(x, {"p": ["agent"], "q": ["mesh grid", "mesh"], "r": ["zz"]}), x="agent mesh grid")
    assert [(r["category"], -r["neg"]) for r in got] == [("q", 3), ("p", 1)]
    assert value(spark, rules.effective_source(F.lit("Wire News x"), x, "Wire News"), x="A - B - Paper") == "Paper"


def test_markup_and_sections(spark):
    x = F.col("x")
    assert value(spark, text.inline_markdown(x), x="a <b> **c** `d` [e](https://f.example/g)") == 'a &lt;b&gt; <strong>c</strong> <code>d</code> <a href="https://f.example/g">e</a>'
    assert [r["s"] for r in value(spark, text.json_array(x, "struct<s:string>"), x='```json\n[{"s": "one"}, {"s": "two"}]\n```')] == ["one", "two"]
    assert value(spark, text.json_array(x, "struct<s:string>"), x="oops") in (None, [])
    assert value(spark, text.blank_if(x, ["placeholder"]), x="A Placeholder text") == ""
    assert value(spark, times.is_weekday(F.lit(date(2026, 7, 10)), 4), y=1.0) is True
    assert value(spark, rules.broad_discovery(F.lit("agg"), x, F.array(F.lit("t")), "agg", "Wire", "other"), x="Wire 7") is True
    assert value(spark, rules.section_matches("engineering_ai", x, F.lit(True)), x="research") is False
