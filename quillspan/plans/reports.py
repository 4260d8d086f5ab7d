"""Reports as Markdown, rendered on the driver from a few ranked rows each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import clean_cell
from quillspan.functions.times import Period
from quillspan.operators import trend
from quillspan.sources.markdown import render, table_lines

COLUMNS = ["Repository", "Stars", "Gained", "Score", "Source"]


def _lines(df: DataFrame) -> str:
    rows = df.select(clean_cell(F.col("repo")), "stars", "stars_gained", F.format_string("%.4f", "trend_score"), "source").collect()
    return table_lines(COLUMNS, [tuple(r) for r in rows]) if rows else "Nothing in this period."


def trend_report(snapshots: DataFrame, period: Period, categories: list[str], per_category: int = 10, authors: int = 20) -> str:
    """Overall, fastest growing and largest repositories, rankings of each category, and the owners."""
    ranked = trend.rank(snapshots, period.start, period.end).persist()
    try:
        parts = [
            f"# {period.label.title()} trend report", f"Period: {period.start} to {period.end}",
            "## Overall", _lines(trend.top(ranked, trend.ordering("trend_score", "stars_gained", "stars"), period.top_n).orderBy("place")),
            "## Fastest growing", _lines(trend.top(ranked, trend.ordering("stars_gained", "trend_score"), period.top_n).orderBy("place")),
            "## Most stars", _lines(trend.top(ranked, trend.ordering("stars", "stars_gained"), period.top_n).orderBy("place")),
        ]
        rankings = {"growth": trend.ordering("stars_gained", "trend_score"), "stars": trend.ordering("stars", "stars_gained")}
        tops = {k: trend.top_per_category(ranked, o, per_category) for k, o in rankings.items()}
        tops["emerging"] = trend.top_per_category(trend.emerging(ranked), trend.ordering("stars_gained", "+stars"), per_category)
        for c in categories:
            parts.append(f"## Category {c}")
            for name, df in tops.items():
                parts += [f"### By {name}", _lines(df.where(F.col("in_category") == c).orderBy("place"))]
        rollup = trend.top_authors(trend.author_rollup(ranked), authors).orderBy("place")
        rows = rollup.select("author", "repos", "stars", "stars_gained", "appearances", "categories").collect()
        parts += ["## Owners", table_lines(["Owner", "Repositories", "Stars", "Gained", "Appearances", "Categories"], [tuple(r) for r in rows])]
    finally:
        ranked.unpersist()
    return "\n\n".join(parts) + "\n"


def issue_report(selected: DataFrame, issue: str, sections: dict[str, str]) -> str:
    """The selected records (section, place, title, source, url) of an issue; sections maps names to headings."""
    rows = selected.orderBy("section", "place").select("section", "title", "source", "url").collect()
    by: dict[str, list[dict]] = {s: [] for s in sections}
    for r in rows:
        by.setdefault(r["section"], []).append({"headline": r["title"], "label": r["source"], "url": r["url"]})
    return render(f"Issue {issue}", [(heading, by[s]) for s, heading in sections.items()])
