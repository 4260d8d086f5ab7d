"""Queries over repository snapshots and the registry."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.rules import keyword_scores
from quillspan.functions.times import activity, monthly, weekly
from quillspan.operators import trend
from quillspan.operators.dedup import last_wins, merge_sources
from quillspan.session import table
from quillspan.sources.registry import normalised

TODAY = date(2026, 6, 14)
WEEK, MONTH = weekly(TODAY), monthly(TODAY)
QUERIES, SQL = {}, {}


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "repo_snapshots").where("snapshot_date IS NOT NULL AND full_name IS NOT NULL")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.rank(_rows(spark, sf_dir), WEEK.start, WEEK.end)


def ranked_sql(start: date, end: date) -> str:
    def last(day: date, name: str) -> str:
        return f"""{name} AS (SELECT * FROM (SELECT *, lower(full_name) AS repo, row_number() OVER (PARTITION BY lower(full_name)
        ORDER BY snapshot_date DESC, ingest_ord DESC) AS rn FROM repo_snapshots WHERE snapshot_date <= DATE '{day}') WHERE rn = 1)"""

    return f"""{last(end, "now")}, {last(start, "base")},
g AS (SELECT n.repo, n.snapshot_date, coalesce(n.stars, 0) AS stars, coalesce(n.forks, 0) AS forks, n.author, n.category, n.matched_categories,
      n.pushed_at, n.last_update, b.repo IS NULL OR b.snapshot_date = n.snapshot_date AS fresh,
      coalesce(b.stars, 0) AS b_stars, coalesce(b.forks, 0) AS b_forks, n.stars_gained_hint, n.forks_gained_hint
      FROM now n LEFT JOIN base b ON n.repo = b.repo),
h AS (SELECT *, CASE WHEN fresh THEN coalesce(stars_gained_hint, 0) ELSE greatest(0, stars - b_stars) END AS stars_gained,
      CASE WHEN fresh THEN coalesce(forks_gained_hint, 0) ELSE greatest(0, forks - b_forks) END AS forks_gained,
      greatest(0, date_diff('day', try_cast(substr(coalesce(nullif(pushed_at, ''), nullif(last_update, ''), CAST(snapshot_date AS VARCHAR)), 1, 10) AS DATE), DATE '{end}')) AS age,
      try_cast(substr(coalesce(nullif(pushed_at, ''), nullif(last_update, ''), CAST(snapshot_date AS VARCHAR)), 1, 10) AS DATE) AS moved FROM g),
m AS (SELECT coalesce(max(stars_gained), 1) AS mg, coalesce(max(stars), 1) AS ms, coalesce(max(forks_gained), 1) AS mf FROM h),
ranked AS (SELECT h.*, CASE WHEN moved IS NULL THEN 0.0 WHEN age <= 7 THEN 1.0 WHEN age <= 30 THEN 0.7 WHEN age <= 90 THEN 0.4 ELSE 0.1 END::DOUBLE AS recent_activity,
      round(0.55::DOUBLE * CASE WHEN mg > 0 THEN stars_gained::DOUBLE / mg::DOUBLE ELSE 0 END + 0.25::DOUBLE * CASE WHEN ms > 0 THEN stars::DOUBLE / ms::DOUBLE ELSE 0 END
      + 0.10::DOUBLE * CASE WHEN moved IS NULL THEN 0.0 WHEN age <= 7 THEN 1.0 WHEN age <= 30 THEN 0.7 WHEN age <= 90 THEN 0.4 ELSE 0.1 END::DOUBLE
      + 0.10::DOUBLE * CASE WHEN mf > 0 THEN forks_gained::DOUBLE / mf::DOUBLE ELSE 0 END, 4) AS trend_score FROM h CROSS JOIN m)"""


RANKED = "WITH " + ranked_sql(WEEK.start, WEEK.end)
SHOWN = ["repo", "stars", "stars_gained", "forks_gained", "trend_score"]


def q01_trend_rank_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select(*SHOWN, "recent_activity", "baseline_source")


SQL["q01_trend_rank_weekly"] = RANKED + "SELECT repo, stars, stars_gained, forks_gained, trend_score, recent_activity, CASE WHEN fresh THEN 'hint' ELSE 'snapshot' END AS baseline_source FROM ranked"


def _top_sql(order: str, where: str = "true") -> str:
    return RANKED + f"SELECT repo, stars, stars_gained, forks_gained, trend_score, row_number() OVER (ORDER BY {order}, repo) AS place FROM ranked WHERE {where} QUALIFY place <= 20"


def q02_trend_fastest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.top(_ranked(spark, sf_dir), trend.ordering("stars_gained", "trend_score"), WEEK.top_n).select(*SHOWN, "place")


SQL["q02_trend_fastest"] = _top_sql("stars_gained DESC, trend_score DESC")


def q03_trend_most_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.top(_ranked(spark, sf_dir), trend.ordering("stars", "stars_gained"), WEEK.top_n).select(*SHOWN, "place")


SQL["q03_trend_most_stars"] = _top_sql("stars DESC, stars_gained DESC")


def q04_trend_category_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.top_per_category(_ranked(spark, sf_dir), trend.ordering("stars_gained", "trend_score")).select("in_category", "repo", "stars_gained", "place")


SQL["q04_trend_category_top"] = RANKED + """,
c AS (SELECT DISTINCT repo, stars_gained, trend_score, unnest(list_concat([category], coalesce(matched_categories, []))) AS in_category FROM ranked)
SELECT in_category, repo, stars_gained, row_number() OVER (PARTITION BY in_category ORDER BY stars_gained DESC, trend_score DESC, repo) AS place
FROM c WHERE in_category IS NOT NULL QUALIFY place <= 10"""


def q05_trend_emerging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.top(trend.emerging(_ranked(spark, sf_dir)), trend.ordering("stars_gained", "+stars"), WEEK.top_n).select(*SHOWN, "place")


SQL["q05_trend_emerging"] = _top_sql("stars_gained DESC, stars", "stars <= 2500 AND stars_gained >= 5")


def q06_author_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.author_rollup(_ranked(spark, sf_dir))


SQL["q06_author_rollup"] = RANKED + """
SELECT author, count(DISTINCT repo) AS repos, sum(stars)::BIGINT AS stars, sum(stars_gained)::BIGINT AS stars_gained, count(*) AS appearances,
       coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (category IS NOT NULL))[1:3], ', '), '') AS categories FROM ranked GROUP BY author"""


def q07_asof_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = trend.as_of(_rows(spark, sf_dir), F.lower("full_name"), {"now": WEEK.end, "base": date(2026, 3, 5)})
    return both.select("repo", F.col("now.snapshot_date").alias("now_date"), F.col("now.stars").alias("now_stars"), F.col("base.snapshot_date").alias("base_date"), F.col("base.stars").alias("base_stars"))


SQL["q07_asof_baseline"] = "WITH " + ranked_sql(date(2026, 3, 5), WEEK.end) + """
SELECT n.repo, n.snapshot_date AS now_date, coalesce(n.stars, 0) AS now_stars, b.snapshot_date AS base_date,
       CASE WHEN b.repo IS NOT NULL THEN coalesce(b.stars, 0) END AS base_stars FROM now n LEFT JOIN base b ON n.repo = b.repo"""


def q08_monthly_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.rank(_rows(spark, sf_dir), MONTH.start, MONTH.end).select(*SHOWN)


SQL["q08_monthly_growth"] = "WITH " + ranked_sql(MONTH.start, MONTH.end) + "SELECT repo, stars, stars_gained, forks_gained, trend_score FROM ranked"


def q09_activity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = activity(F.lit(WEEK.end), F.col("pushed_at"), F.col("last_update"), F.col("snapshot_date").cast("string"))
    return _rows(spark, sf_dir).groupBy("snapshot_date", a.alias("activity")).agg(F.count("*").alias("n"))


SQL["q09_activity_buckets"] = f"""
WITH a AS (SELECT snapshot_date, try_cast(substr(coalesce(nullif(pushed_at, ''), nullif(last_update, ''), CAST(snapshot_date AS VARCHAR)), 1, 10) AS DATE) AS d
           FROM repo_snapshots WHERE full_name IS NOT NULL)
SELECT snapshot_date, CASE WHEN d IS NULL THEN 0.0 WHEN date_diff('day', d, DATE '{WEEK.end}') <= 7 THEN 1.0 WHEN date_diff('day', d, DATE '{WEEK.end}') <= 30 THEN 0.7
       WHEN date_diff('day', d, DATE '{WEEK.end}') <= 90 THEN 0.4 ELSE 0.1 END::DOUBLE AS activity, count(*) AS n FROM a GROUP BY ALL"""

#: Categories of the fixture's vocabulary; any table of phrases does.
TOPICS = {
    "agents": ["agent", "copilot", "assistant"],
    "simulation": ["mesh generator", "crash simulation", "fluid dynamics", "surrogate model", "thermal model"],
    "language": ["language model", "speech model", "document parser", "translation"],
    "serving": ["inference", "compiler pass", "scheduling engine", "retrieval index"],
    "data": ["data pipeline", "benchmark suite", "annotation tool", "vector store"],
}


def q32_repo_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "full_name", "description", "language", F.array_join("topics", " "))
    scored = keyword_scores(text, TOPICS)
    return _rows(spark, sf_dir).select("ingest_ord", F.coalesce(F.get(scored, 0)["category"], F.lit("Unclassified")).alias("category"), F.array_join(F.transform(scored, lambda r: r["category"]), ",").alias("matched"))


def _score_sql(words: list[str]) -> str:
    return " + ".join(f"CASE WHEN contains(t, '{w}') THEN {2 if ' ' in w else 1} ELSE 0 END" for w in words)


SQL["q32_repo_classify"] = (
    "WITH t AS (SELECT ingest_ord, lower(concat_ws(' ', full_name, description, language, array_to_string(topics, ' '))) AS t FROM repo_snapshots WHERE full_name IS NOT NULL AND snapshot_date IS NOT NULL), s AS (SELECT ingest_ord, list_sort(list_filter(["
    + ", ".join(f"{{'s': -({_score_sql(words)}), 'p': {i}, 'c': '{name}'}}" for i, (name, words) in enumerate(TOPICS.items()))
    + "], lambda x: x.s < 0)) AS l FROM t) SELECT ingest_ord, CASE WHEN len(l) > 0 THEN l[1].c ELSE 'Unclassified' END AS category, coalesce(array_to_string(list_transform(l, lambda x: x.c), ','), '') AS matched FROM s"
)


def q51_source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(table(spark, sf_dir, "sources")).select("src_ord", "name", "kind", "category", "priority", "query", "max_entries", F.size("tags").alias("n_tags"))


SQL["q51_source_registry"] = """
WITH s AS (SELECT *, CASE WHEN coalesce(fetch_type, '') <> '' THEN fetch_type WHEN source_type = 'rss' THEN 'rss' WHEN source_type = 'website' THEN 'sitemap_or_search'
           WHEN source_type IN ('manual', 'newsletter', 'linkedin_manual', 'x_api', 'github', 'arxiv') THEN 'web_search_query' ELSE coalesce(nullif(source_type, ''), 'web_search_query') END AS kind FROM sources WHERE enabled)
SELECT src_ord, name, kind, CASE WHEN category IN ('cae_ai_engineering', 'engineering_ai') THEN 'engineering_ai' WHEN category IN ('research', 'startup', 'vendor', 'community') THEN category ELSE 'general_ai' END AS category,
       coalesce(priority, 'medium') AS priority, CASE WHEN coalesce(query, '') <> '' THEN query WHEN kind IN ('sitemap_or_search', 'web_search_query') THEN 'site:' || regexp_extract(url, '^(?:[^:/?#]+:)?(?://([^/?#]*))?', 1) || ' AI' END AS query,
       coalesce(max_entries, 25) AS max_entries, coalesce(len(tags), 0) AS n_tags FROM s"""


def q52_merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("repo", F.lower("full_name"))
    search, others = rows.where("source = 'github_search'"), rows.where("source <> 'github_search'")
    # the first other row of a repository stands: order by falling ingest_ord, since the greatest order wins
    merged = merge_sources([last_wins(search, [F.col("repo")], ["ingest_ord"]), others], F.col("repo"), [(-F.col("ingest_ord")).alias("o")])
    return merged.select("repo", "ingest_ord", "source")


SQL["q52_merge_sources"] = """
WITH r AS (SELECT lower(full_name) AS repo, ingest_ord, source FROM repo_snapshots WHERE full_name IS NOT NULL AND snapshot_date IS NOT NULL),
a AS (SELECT repo, ingest_ord, source FROM r WHERE source = 'github_search' QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ingest_ord DESC) = 1),
b AS (SELECT repo, ingest_ord, source FROM r WHERE source <> 'github_search' QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ingest_ord) = 1)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE repo NOT IN (SELECT repo FROM a)"""

QUERIES.update({k: v for k, v in list(globals().items()) if k.startswith("q") and k[1:3].isdigit()})
