"""Further queries: rankings in full, names and phrases, gates, and whole-table SQL of operators that other queries show in part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import rules as ru
from quillspan.functions import text as tx
from quillspan.functions.times import iso_time
from quillspan.operators import trend
from quillspan.operators.publish import issue_problems, latest_reports
from quillspan.plans import items, scalars
from quillspan.plans import trend as tr
from quillspan.session import table

QUERIES, SQL = {}, {}

# Lists of the fixture's vocabulary; arguments of the operators.
ORGANIZATIONS = {"grid": "gridworks", "turbine": "turbine makers", "protein": "protein labs", "cloud": "cloud group", "power": "gridworks"}
LEADS = {"new": ["introducing ", "announcing ", "launch"], "update": ["what's new", "new in ", "update"]}
FEW = {"section": 3, "sources": 60}


def q63_overall_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repositories in their order, with place."""
    ranked = tr._ranked(spark, sf_dir)
    return trend.top(ranked, trend.ordering("trend_score", "stars_gained", "stars"), tr.WEEK.top_n).select(*tr.SHOWN, "place")


SQL["q63_overall_rank"] = tr._top_sql("trend_score DESC, stars_gained DESC, stars DESC")


def _per_category(order: str, where: str = "true") -> str:
    return tr.RANKED + f""",
c AS (SELECT DISTINCT repo, stars, stars_gained, trend_score, unnest(list_concat([category], coalesce(matched_categories, []))) AS in_category FROM ranked WHERE {where})
SELECT in_category, repo, stars, stars_gained, row_number() OVER (PARTITION BY in_category ORDER BY {order}, repo) AS place FROM c WHERE in_category IS NOT NULL QUALIFY place <= 10"""


def q64_category_most_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = tr._ranked(spark, sf_dir)
    return trend.top_per_category(ranked, trend.ordering("stars", "stars_gained")).select("in_category", "repo", "stars", "stars_gained", "place")


SQL["q64_category_most_stars"] = _per_category("stars DESC, stars_gained DESC")


def q65_category_emerging(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = trend.emerging(tr._ranked(spark, sf_dir))
    return trend.top_per_category(ranked, trend.ordering("stars_gained", "+stars")).select("in_category", "repo", "stars", "stars_gained", "place")


SQL["q65_category_emerging"] = _per_category("stars_gained DESC, stars", "stars <= 2500 AND stars_gained >= 5")


def q66_author_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 owners that gained most."""
    return trend.top_authors(trend.author_rollup(tr._ranked(spark, sf_dir)), 20).select("author", "repos", "stars", "stars_gained", "place")


SQL["q66_author_top"] = tr.RANKED + """,
a AS (SELECT author, count(DISTINCT repo) AS repos, sum(stars)::BIGINT AS stars, sum(stars_gained)::BIGINT AS stars_gained FROM ranked GROUP BY author)
SELECT *, row_number() OVER (ORDER BY stars_gained DESC, stars DESC, repos DESC, author NULLS FIRST) AS place FROM a QUALIFY place <= 20"""


def q67_required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "incoming_candidates").where(tx.named(F.col("title"), F.col("url"))).select("rec_id")


SQL["q67_required_fields"] = "SELECT rec_id FROM incoming_candidates WHERE coalesce(title, '') <> '' AND coalesce(url, '') <> ''"


def q68_organization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates").select("cand_id", ru.organization(F.col("source"), F.col("title"), F.col("url"), ORGANIZATIONS, "Google News").alias("organization"))


_SOURCE = """CASE WHEN starts_with(lower(trim(coalesce(source, ''))), 'google news') AND contains(trim(coalesce(title, '')), ' - ') AND trim(string_split(trim(coalesce(title, '')), ' - ')[-1]) <> ''
  THEN trim(string_split(trim(coalesce(title, '')), ' - ')[-1]) WHEN trim(coalesce(source, '')) = '' THEN 'unknown' ELSE trim(source) END"""
SQL["q68_organization"] = f"""WITH s AS (SELECT cand_id, title, url, {_SOURCE} AS own FROM candidates),
t AS (SELECT cand_id, own, lower(own || ' ' || coalesce(title, '') || ' ' || coalesce(url, '')) AS t FROM s)
SELECT cand_id, CASE {" ".join(f"WHEN contains(t, '{k}') THEN '{v}'" for k, v in ORGANIZATIONS.items())} ELSE lower(own) END AS organization FROM t"""


def q82_publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers of headlines; every second record comes from an aggregator whose name is spelled in several ways."""
    title = F.when(F.col("cand_id") % 2 == 0, F.concat("title", F.lit(" - "), F.coalesce("registry_category", F.lit(" ")))).otherwise(F.col("title"))
    source = F.when(F.col("cand_id") % 4 == 0, F.lit(" google NEWS: all")).when(F.col("cand_id") % 4 == 2, F.lit("Google News")).when(F.col("cand_id") % 9 == 0, F.lit("  ")).otherwise(F.col("source"))
    return table(spark, sf_dir, "candidates").select("cand_id", ru.publisher(source, title, "Google News").alias("publisher"))


SQL["q82_publisher"] = f"""WITH t AS (SELECT cand_id, CASE WHEN cand_id % 2 = 0 THEN title || ' - ' || coalesce(registry_category, ' ') ELSE title END AS title,
  CASE WHEN cand_id % 4 = 0 THEN ' google NEWS: all' WHEN cand_id % 4 = 2 THEN 'Google News' WHEN cand_id % 9 = 0 THEN '  ' ELSE source END AS source FROM candidates)
SELECT cand_id, {_SOURCE} AS publisher FROM t"""


def q69_lead_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = F.when(F.col("cand_id") % 3 == 0, F.concat(F.lit("  Introducing "), "title")).when(F.col("cand_id") % 3 == 1, F.concat(F.lit("What's NEW: "), "title")).otherwise(F.col("title"))
    return table(spark, sf_dir, "candidates").select("cand_id", ru.lead_phrase(opened, LEADS, "other").alias("phrase"))


SQL["q69_lead_phrase"] = """WITH t AS (SELECT cand_id, lower(trim(CASE WHEN cand_id % 3 = 0 THEN '  Introducing ' || title WHEN cand_id % 3 = 1 THEN 'What''s NEW: ' || title ELSE coalesce(title, '') END)) AS t FROM candidates)
SELECT cand_id, CASE WHEN starts_with(t, 'introducing ') OR starts_with(t, 'announcing ') OR starts_with(t, 'launch') THEN 'new'
WHEN starts_with(t, 'what''s new') OR starts_with(t, 'new in ') OR starts_with(t, 'update') THEN 'update' ELSE 'other' END AS phrase FROM t"""


def q70_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    engineering = ru.page_category(F.col("category")) == "engineering_ai"
    noise = ru.excluded_noise(F.col("title"), F.col("source"), F.col("text"), items.NOISE)
    return table(spark, sf_dir, "candidates").where(engineering & noise).select("cand_id")


SQL["q70_noise"] = """SELECT cand_id FROM candidates WHERE category IN ('cae_ai_engineering', 'engineering_ai')
AND regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(source, '') || ' ' || coalesce(text, '')), 'licence|pricing|broker')"""


def q71_page_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates").groupBy(ru.page_category(F.col("category")).alias("category")).agg(F.count("*").alias("n"))


SQL["q71_page_category"] = "SELECT CASE WHEN category = 'cae_ai_engineering' THEN 'engineering_ai' ELSE coalesce(category, '') END AS category, count(*) AS n FROM candidates GROUP BY 1"


def q72_iso_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text, some with a fraction."""
    t = F.timestamp_micros(F.unix_micros("published_at") + (F.col("cand_id") % 4) * 70)
    return table(spark, sf_dir, "candidates").select("cand_id", iso_time(t).alias("iso"))


SQL["q72_iso_time"] = """WITH t AS (SELECT cand_id, epoch_us(published_at) + (cand_id % 4) * 70 AS us FROM candidates)
SELECT cand_id, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 <> 0 THEN '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS iso FROM t"""


def q73_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *[F.md5(tx.truncated(text, n)).alias(f"first_{n}") for n in (500, 1100, 1200)])


SQL["q73_truncated"] = "SELECT doc_id, " + ", ".join(f"md5(substr(coalesce(text, ''), 1, {n})) AS first_{n}" for n in (500, 1100, 1200)) + " FROM documents"


def q74_latest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest report of each kind by its name; one kind has none."""
    day = table(spark, sf_dir, "repo_snapshots").where("snapshot_date IS NOT NULL").select("snapshot_date").distinct()
    kind = F.when(F.dayofmonth("snapshot_date") <= 7, "monthly").otherwise("weekly")
    return latest_reports(day.select(F.concat(F.lit("reports/"), kind, F.lit("/"), F.col("snapshot_date").cast("string"), F.lit("-trends.md")).alias("path")), "path", ["weekly", "monthly", "yearly"], r"^\d{4}-\d{2}-\d{2}-trends\.md$")


SQL["q74_latest_reports"] = """WITH p AS (SELECT DISTINCT snapshot_date, CASE WHEN day(snapshot_date) <= 7 THEN 'monthly' ELSE 'weekly' END AS kind FROM repo_snapshots WHERE snapshot_date IS NOT NULL)
SELECT k.kind, 'reports/' || k.kind || '/' || CAST(max(snapshot_date) AS VARCHAR) || '-trends.md' AS path FROM (VALUES ('weekly'), ('monthly'), ('yearly')) k(kind) LEFT JOIN p ON p.kind = k.kind GROUP BY 1"""


def q75_issue_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of every calendar day between the first and the last issue; days without any row are missing."""
    c = table(spark, sf_dir, "candidates").where("issue_date IS NOT NULL")
    log = c.groupBy("issue_date").agg(
        (F.count_distinct("source") - FEW["sources"]).alias("source_count"), F.count_if(F.isnull("score")).alias("fetched_count"), F.count_if(F.isnull("matched_terms")).alias("candidates"),
        F.when(F.dayofmonth("issue_date") % 9 == 0, F.concat(F.lit("Placeholder of "), F.col("issue_date").cast("string"))).alias("note"),
    )
    ends = c.agg(F.min("issue_date").alias("a"), F.max("issue_date").alias("b")).where("a IS NOT NULL")
    return issue_problems(ends.select(F.explode(F.sequence("a", F.date_add("b", 2))).alias("issue_date")), log, "issue_date")


SQL["q75_issue_gate"] = f"""WITH l AS (SELECT issue_date, count(DISTINCT source) - {FEW["sources"]} AS s, count(*) FILTER (score IS NULL) AS f, count(*) FILTER (matched_terms IS NULL) AS c,
  CASE WHEN day(issue_date) % 9 = 0 THEN 'Placeholder of ' || CAST(issue_date AS VARCHAR) END AS note FROM candidates WHERE issue_date IS NOT NULL GROUP BY 1),
d AS (SELECT CAST(unnest(generate_series((SELECT min(issue_date) FROM l)::TIMESTAMP, (SELECT max(issue_date) FROM l)::TIMESTAMP + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS DATE) AS issue_date)
SELECT issue_date, 'the issue is missing' AS problem FROM d WHERE issue_date NOT IN (SELECT issue_date FROM l) UNION ALL SELECT issue_date, 'no source was loaded' FROM l WHERE s <= 0
UNION ALL SELECT issue_date, 'nothing was fetched' FROM l WHERE f <= 0 AND c <= 0 UNION ALL SELECT issue_date, 'a placeholder: ' || note FROM l WHERE note IS NOT NULL"""


def q76_summaries_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q21 with SQL over documents of every language."""
    return scalars.q21_extract_summary(spark, sf_dir)


SQL["q76_summaries_of_all"] = scalars.SQL["q21_extract_summary"].replace(" WHERE lang = 'en'", "").replace(r"regexp_replace(coalesce(text, ''), '\s+'", r"regexp_replace(coalesce(text, ''), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'")

_P = lambda k: f"regexp_extract(trim(coalesce(url, '')), '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?', {k})"
_KEY = f"""CASE WHEN coalesce(url, '') = '' THEN lower(title) ELSE {_P(1)} || '://' || lower({_P(2)}) || regexp_replace({_P(3)}, '/+$', '') || coalesce('?' || nullif(array_to_string(list_filter(string_split({_P(4)}, '&'),
  lambda x: regexp_matches(x, '^[^=]+=.+$') AND NOT regexp_matches(lower(x), '^utm_')), '&'), ''), '') END"""


def q77_first_wins_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q34 with SQL that keys by the normal address."""
    return items.q34_first_wins_dedup(spark, sf_dir)


SQL["q77_first_wins_address"] = f"SELECT issue_date, min(cand_id) AS cand_id FROM candidates GROUP BY issue_date, {_KEY}"


def q78_source_cap_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q35 with SQL that caps no searched site."""
    return items.q35_source_cap(spark, sf_dir)


SQL["q78_source_cap_by_kind"] = """WITH s AS (SELECT name, coalesce(max_entries, 25) AS most, CASE WHEN coalesce(fetch_type, '') <> '' THEN fetch_type WHEN source_type = 'website' THEN 'sitemap_or_search' ELSE 'other' END AS kind FROM sources)
SELECT r.source, r.rec_id, row_number() OVER (PARTITION BY r.source ORDER BY r.rec_id) AS place FROM raw_candidates r JOIN s ON s.name = r.source QUALIFY s.kind = 'sitemap_or_search' OR place <= s.most"""


def q79_event_pairs_every_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q36 with SQL of all five rules."""
    return items.q36_same_event_pairs(spark, sf_dir)


_WITH_KEY = items._E.replace("lower(title) AS t FROM", f"{items._rules(items.EVENT_RULES, 'NULL', 'lower(title)')} AS k FROM")
SQL["q79_event_pairs_every_rule"] = f"""WITH {items.ITEMS}, {_WITH_KEY},
p AS (SELECT a.issue_date, a.cand_id AS cand_id_a, b.cand_id AS cand_id_b, a.u AS au, b.u AS bu, a.src AS asrc, b.src AS bsrc, a.k AS ak, b.k AS bk, len(list_intersect(a.tok, b.tok)) AS n,
      least(len(a.tok), len(b.tok)) AS s, len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok)) AS w FROM e a JOIN e b ON a.issue_date = b.issue_date AND a.cand_id < b.cand_id)
SELECT issue_date, cand_id_a, cand_id_b FROM p WHERE (au <> '' AND au = bu) OR ak = bk OR (n >= 5 AND n >= 0.5 * s) OR (n >= 4 AND n >= 0.42 * w) OR (asrc = bsrc AND n >= 2 AND n >= 0.67 * s)"""


def q80_history_repeats_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q37 with SQL that has all records as its new side; what was published before stays the audit lists."""
    return items.q37_history_repeats(spark, sf_dir)


SQL["q80_history_repeats_of_all"] = f"""WITH {items.AUDIT}, {_WITH_KEY}, h AS (SELECT * FROM e WHERE cand_id IN (SELECT cand_id FROM audit)),
p AS (SELECT a.cand_id, b.cand_id AS other, a.u AS au, b.u AS bu, a.src AS asrc, b.src AS bsrc, a.k AS ak, b.k AS bk, len(list_intersect(a.tok, b.tok)) AS n, least(len(a.tok), len(b.tok)) AS s,
      len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok)) AS w FROM e a JOIN h b ON b.issue_date < a.issue_date AND b.issue_date >= a.issue_date - 7)
SELECT cand_id, min(other) AS earlier FROM p WHERE (au <> '' AND au = bu) OR ak = bk OR (n >= 5 AND n >= 0.5 * s) OR (n >= 4 AND n >= 0.42 * w) OR (asrc = bsrc AND n >= 2 AND n >= 0.67 * s) GROUP BY cand_id"""


def q81_run_log_all_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q48 with SQL of all gates of a pass."""
    return items.q48_run_log(spark, sf_dir)


_ALL = "title || ' ' || coalesce(text, '')"
SQL["q81_run_log_all_gates"] = items.MATCHED.rstrip() + rf""", w AS (SELECT *, CASE WHEN source_kind = 'sitemap_or_search' AND coalesce(category, '') <> 'engineering_ai' AND len(eng) > 0 AND {items._any(items.AI)} THEN {scalars.HOURS["engineering_ai"]} ELSE {scalars._HOURS_SQL} END AS hours FROM h WHERE issue_date IS NOT NULL),
e AS (SELECT issue_date, source, {_KEY} AS key, coalesce(title, '') <> '' AND coalesce(url, '') <> '' AND (published_at IS NULL OR epoch_us(published_at) >= epoch_us(issue_date::TIMESTAMP) - hours * 3600000000) AND len(hits) > 0
  AND (bucket <> 'engineering_ai' OR ({items._any(items.CORE)} AND {items._any(items.AI)})) AND length(regexp_replace({_ALL}, '[^A-Za-z]', '', 'g')) >= 20
  AND length(regexp_replace({_ALL}, '[^\x00-\x7F]', '', 'g')) / greatest(length({_ALL}), 1) > 0.82 AS ok FROM w)
SELECT issue_date, count(*) AS fetched, count(*) FILTER (ok) AS filtered, count(*) FILTER (ok) - count(DISTINCT key) FILTER (ok) AS duplicates, count(DISTINCT source) AS sources FROM e GROUP BY 1"""

QUERIES.update({k: v for k, v in list(globals().items()) if k.startswith("q") and k[1:3].isdigit()})
