from datetime import date

from quillspan.functions.times import weekly
from quillspan.plans.reports import issue_report, trend_report
from quillspan.session import table


def test_trend_report(spark, data):
    rows = table(spark, data, "repo_snapshots")
    text = trend_report(rows, weekly(date(2026, 6, 14), 5), ["agents", "no such"])
    overall = text.split("## Overall\n\n")[1].split("\n\n")[0].split("\n")
    assert len(overall) == 7 and overall[2].startswith("| 1 | ")
    assert text.count("Nothing in this period.") >= 3 and "## Owners" in text


def test_issue_report(spark):
    df = spark.createDataFrame([("g", 2, "B", "s", "https://b"), ("g", 1, "A", "s", "https://a")], "section string, place int, title string, source string, url string")
    text = issue_report(df, "2026-06-14", {"g": "General", "e": "Engineering"})
    assert text.index("1. **A**") < text.index("2. **B**") < text.index("## Engineering") and "Nothing in this issue." in text
