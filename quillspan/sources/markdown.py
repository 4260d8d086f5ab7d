"""Published Markdown, written and read again."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.rules import mapped


def sections(lines: DataFrame, headings: Mapping[str, str], ends: tuple[str, ...] = ()) -> DataFrame:
    """(doc, section, pos, headline, label, url) of the numbered items under known headings.

    lines has (doc, line_no, line), one document in one window; headings maps a heading to its section, ends
    close one. A rich item is a bold headline with its source on a later line before the next item, a compact
    one has both on its line.
    """
    w = Window.partitionBy("doc").orderBy("line_no")
    line = F.trim("line")
    head = F.trim(F.regexp_replace(line, r"^[#\s*]+|[#\s*]+$", ""))
    known = mapped(head, dict(headings) | {e: "" for e in ends}, None)
    rows = lines.withColumn("l", line).withColumn("_s", known).withColumn("section", F.last("_s", ignorenulls=True).over(w)).where("section <> ''")
    rich = F.regexp_extract("l", r"^\d+\.\s+\*\*(.+?)\*\*\s*$", 1)
    source = r"^(?:English )?[Ss]ource:\s+\[([^\]]+)\]\((https?://[^)]+)\)"
    compact = r"^\d+\.\s+(.+?)[.。]\s*(?:Source|原文)[:：]\s*\[([^\]]+)\]\((https?://[^)]+)\)"
    rows = rows.withColumn("_rich", F.when(rich != "", rich)).withColumn("_n", F.sum(F.when(F.col("_rich").isNotNull() | F.col("_s").isNotNull(), 1).otherwise(0)).over(w))
    pending = Window.partitionBy("doc", "_n").orderBy("line_no")
    rows = rows.withColumn("_pending", F.last("_rich", ignorenulls=True).over(pending)).withColumn("_is", F.regexp_extract("l", source, 2) != "")
    rows = rows.withColumn("_used", F.sum(F.when(F.col("_is"), 1).otherwise(0)).over(pending))
    both = F.regexp_extract("l", compact, 3) != ""
    item = rows.where(both | (F.col("_is") & F.col("_pending").isNotNull() & (F.col("_used") == 1)))
    found = item.select(
        "doc", "section", "line_no", F.when(both, F.regexp_extract("l", compact, 1)).otherwise(F.col("_pending")).alias("headline"),
        F.when(both, F.regexp_extract("l", compact, 2)).otherwise(F.regexp_extract("l", source, 1)).alias("label"), F.when(both, F.regexp_extract("l", compact, 3)).otherwise(F.regexp_extract("l", source, 2)).alias("url"),
    )
    return found.withColumn("pos", F.row_number().over(Window.partitionBy("doc", "section").orderBy("line_no"))).drop("line_no")


def render(title: str, parts: list[tuple[str, list[dict]]], empty: str = "Nothing in this issue.") -> str:
    """Markdown of a report's few rows; each part has a heading and rows with headline, label and url."""
    out = [f"# {title}", ""]
    for heading, rows in parts:
        out += [f"## {heading}", ""]
        for i, r in enumerate(rows, 1):
            out += [f"{i}. **{r['headline']}**", f"Source: [{r['label']}]({r['url']})", ""]
        if not rows:
            out += [empty, ""]
    return "\n".join(out)


def table_lines(columns: list[str], rows: list[tuple]) -> str:
    """A Markdown table of a ranking's rows, numbered."""
    cell = lambda v: str("-" if v is None or v == "" else v).replace("\n", " ").replace("|", "/")
    lines = ["| " + " | ".join(["Rank", *columns]) + " |", "| " + " | ".join(["---"] * (len(columns) + 1)) + " |"]
    return "\n".join(lines + ["| " + " | ".join([str(i), *map(cell, r)]) + " |" for i, r in enumerate(rows, 1)])
