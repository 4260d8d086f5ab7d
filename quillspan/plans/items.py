"""Queries over candidates: matching, classes, scores, duplicates, selection, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import scores as sc
from quillspan.functions import text as tx
from quillspan.functions.rules import any_word, broad_discovery, effective_source, excluded_noise, first_rule, page_category, publisher, section_matches, trusted
from quillspan.functions.times import long_date, recency, widened, within_window
from quillspan.functions.urls import normal_url, part
from quillspan.operators import events as ev
from quillspan.operators.dedup import first_rows, first_wins
from quillspan.operators.publish import BROADCAST_ROWS, calendar_pages, duplicate_problems, published_index, quality_problems, without_earlier_sections
from quillspan.operators.events import BUILDER
from quillspan.operators.sections import Issue, day_sections, draft_section, draft_topic_section, summary_section
from quillspan.operators.selection import Pass
from quillspan.operators.trend import growth_hint, latest_first_delivered
from quillspan.plans.scalars import _HOURS_SQL, HOURS, NOW, PUBLISHERS, hours_of, log_sql, tokens_sql
from quillspan.session import cut, table
from quillspan.sources.feeds import capped, page_links
from quillspan.sources.registry import canonical_category, fetch_kind

QUERIES, SQL = {}, {}

# Term lists of the fixture's vocabulary. All operators take their lists as arguments.
INCLUDE = ["language model", "agent", "copilot", "benchmark", "classifier", "tokeniser", "speech model", "image"]
EXCLUDE = ["licence", "pricing"]
ENGINEERING = ["mesh generator", "crash simulation", "fluid dynamics", "surrogate model", "turbine", "thermal model", "sensor fusion", "optimisation loop"]
CORE = ["simulation", "design", "metal forming", "casting", "mesh"]
AI = ["agent", "model", "neural", "copilot", "ai"]
RESEARCH = ["benchmark", "dataset", "genome", "protein", "paper", "research"]
MEDICAL = ["clinical", "hospital", "patient", "drug", "genome", "protein", "health"]
TOPIC_RULES = [
    ("bio", [["protein", "genome", "drug", "hospital", "clinic"]]),
    ("industry", [["turbine", "casting", "metal forming", "crash", "mesh"], ["model", "simulation", "agent"]]),
    ("language", [["language model", "speech", "translation", "document"]]),
    ("code", [["code", "compiler"]]),
]
LABEL_RULES = [("code", [["code"]]), ("health", [["health", "hospital"]]), ("energy", [["grid", "battery", "wind"]]), ("finance", [["fraud", "tax", "claims"]])]
EVENT_RULES = [("drug-agents", [["drug"], ["agent", "copilot"]]), ("code-migration", [["code migration"], ["agent", "assistant", "stack"]]), ("grid", [["grid"]])]


ITEM = ("cand_id", "issue_date", "id", "title", "url", "source", "source_kind", "category", "published_at", "text", "engagement", "score", "source_tags", "registry_category", "source_priority")
EVENT = ("cand_id", "issue_date", "title", "url", "source", "score")


def _items(spark: SparkSession, sf_dir: str, cols: tuple[str, ...] = ITEM) -> DataFrame:
    """One row per cand_id; redeliveries are verbatim."""
    return first_wins(table(spark, sf_dir, "candidates").select(*cols), [F.col("cand_id")], ["cand_id"])


ITEMS = "items AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY cand_id) = 1)"


def all_text() -> Column:
    return F.concat("title", F.lit(" "), F.coalesce("text", F.lit("")))


WORDS = "lower(title || ' ' || coalesce(text, ''))"


def _any(terms: list[str], text: str = "t") -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def _hits(terms: list[str], text: str = "t") -> str:
    return "list_filter([" + ", ".join(f"'{t}'" for t in terms) + f"], lambda x: contains({text}, x))"


def _rules(rules, default: str, text: str = "t") -> str:
    return "CASE " + " ".join(f"WHEN {' AND '.join(_any(g, text) for g in groups)} THEN '{name}'" for name, groups in rules) + f" ELSE {default} END"


T = f"WITH c AS (SELECT *, {WORDS} AS t FROM candidates) "


def q22_keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = tx.keyword_match(all_text(), INCLUDE, EXCLUDE)
    return table(spark, sf_dir, "candidates").select("cand_id", F.array_join(hits, ",").alias("hits"))


SQL["q22_keyword_match"] = T + f"SELECT cand_id, CASE WHEN {_any(EXCLUDE)} THEN '' ELSE coalesce(array_to_string({_hits(INCLUDE)}, ','), '') END AS hits FROM c"


def _matched(df: DataFrame) -> DataFrame:
    """The hits of a record's own bucket, or of engineering where only that has any."""
    df = df.withColumns({"_own": tx.keyword_match(all_text(), INCLUDE, EXCLUDE), "_eng": tx.keyword_match(all_text(), ENGINEERING, EXCLUDE)})
    own = F.when(F.col("category") == "engineering_ai", F.size("_eng")).otherwise(F.size("_own"))
    bucket = F.when((F.coalesce("category", F.lit("")) == "engineering_ai") | ((F.coalesce(own, F.size("_own")) == 0) & (F.size("_eng") > 0)), "engineering_ai").otherwise("general_ai")
    return df.withColumn("bucket", bucket).withColumn("hits", F.when(F.col("bucket") == "engineering_ai", F.col("_eng")).otherwise(F.col("_own")))


def q23_bucket_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(table(spark, sf_dir, "candidates")).where(F.size("hits") > 0).select("cand_id", "bucket", F.size("hits").alias("n_hits"))


MATCHED = (
    f"WITH c AS (SELECT *, {WORDS} AS t FROM candidates), m AS (SELECT *, CASE WHEN {_any(EXCLUDE)} THEN [] ELSE {_hits(INCLUDE)} END AS own, CASE WHEN {_any(EXCLUDE)} THEN [] ELSE {_hits(ENGINEERING)} END AS eng FROM c), "
    "b AS (SELECT *, CASE WHEN coalesce(category, '') = 'engineering_ai' OR (len(own) = 0 AND len(eng) > 0) THEN 'engineering_ai' ELSE 'general_ai' END AS bucket FROM m), "
    "h AS (SELECT *, CASE WHEN bucket = 'engineering_ai' THEN eng ELSE own END AS hits FROM b) "
)
SQL["q23_bucket_rescue"] = MATCHED + "SELECT cand_id, bucket, len(hits) AS n_hits FROM h WHERE len(hits) > 0"


def _gated(df: DataFrame) -> Column:
    eng = F.col("bucket") == "engineering_ai"
    return F.when(eng, tx.gate(all_text(), CORE) & tx.gate(all_text(), AI)).otherwise(tx.gate(all_text(), None) & tx.gate(all_text(), []))


def q24_core_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matched(table(spark, sf_dir, "candidates"))
    return m.where((F.size("hits") > 0) & _gated(m)).select("cand_id", "bucket")


SQL["q24_core_gate"] = MATCHED + f"SELECT cand_id, bucket FROM h WHERE len(hits) > 0 AND (bucket <> 'engineering_ai' OR ({_any(CORE)} AND {_any(AI)}))"


def infer_category(source_category: Column, text: Column, engineering: Column) -> Column:
    """A record's class: engineering by its source, its score or its words, else research, else general."""
    base = canonical_category(source_category)
    return F.when((base == "engineering_ai") | (engineering >= 0.5) | (tx.has_any(text, CORE) & tx.has_any(text, AI)), "engineering_ai").when(base == "research", "research").otherwise("general_ai")


_CANON = "CASE WHEN category IN ('cae_ai_engineering', 'engineering_ai') THEN 'engineering_ai' WHEN category IN ('research', 'startup', 'vendor', 'community') THEN category ELSE 'general_ai' END"
_ENG = f"CASE WHEN coalesce(category, '') = 'engineering_ai' THEN 1.0 ELSE least(len({_hits(ENGINEERING)}) / 4.0, 1.0) END::DOUBLE"


def _engineering() -> Column:
    return F.when(F.coalesce("category", F.lit("")) == "engineering_ai", 1.0).otherwise(sc.share_of(F.size(tx.term_hits(all_text(), ENGINEERING)), 4))


def q28_category_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates").select("cand_id", infer_category(F.col("category"), all_text(), _engineering()).alias("inferred"))


SQL["q28_category_infer"] = T + f"SELECT cand_id, CASE WHEN {_CANON} = 'engineering_ai' OR {_ENG} >= 0.5 OR ({_any(CORE)} AND {_any(AI)}) THEN 'engineering_ai' WHEN {_CANON} = 'research' THEN 'research' ELSE 'general_ai' END AS inferred FROM c"


def q29_topic_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates").select("cand_id", first_rule(all_text(), TOPIC_RULES, "other").alias("topic"))


SQL["q29_topic_key"] = T + f"SELECT cand_id, {_rules(TOPIC_RULES, chr(39) + 'other' + chr(39))} AS topic FROM c"


def q30_topic_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates").groupBy(first_rule(F.col("title"), LABEL_RULES, "update").alias("label")).agg(F.count("*").alias("n"))


SQL["q30_topic_label"] = f"WITH c AS (SELECT lower(title) AS t FROM candidates) SELECT {_rules(LABEL_RULES, chr(39) + 'update' + chr(39))} AS label, count(*) AS n FROM c GROUP BY ALL"


def q31_word_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = F.concat(all_text(), F.lit(" "), F.array_join(F.coalesce("source_tags", F.array().cast("array<string>")), " "))
    return table(spark, sf_dir, "candidates").where(any_word(tagged, MEDICAL)).select("cand_id")


SQL["q31_word_flag"] = rf"""SELECT cand_id FROM candidates WHERE regexp_matches(lower(title || ' ' || coalesce(text, '') || ' ' || coalesce(array_to_string(source_tags, ' '), '')), '(^|[^\p{{L}}\p{{N}}_])({"|".join(MEDICAL)})($|[^\p{{L}}\p{{N}}_])')"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matched(_items(spark, sf_dir))
    low_hits = lambda terms: F.size(tx.term_hits(all_text(), terms))
    parts = {
        "priority": sc.priority_score(F.col("source_priority")),
        "novelty": recency(F.col("published_at"), F.lit(NOW).cast("timestamp"), hours_of(F.col("category"))),
        "general": sc.share_of(F.size("hits"), 6),
        "engineering": _engineering(),
        "research": F.when(F.coalesce("category", F.lit("")) == "research", 1.0).otherwise(sc.share_of(low_hits(RESEARCH), 3)),
    }
    boost = (canonical_category(F.col("category")) == "engineering_ai") & tx.has_any(all_text(), ["agent", "copilot"]) & tx.has_any(all_text(), ["simulation", "mesh"])
    engagement = {n: F.col(f"engagement.{n}") for n in ("points", "comments", "upvotes")}
    return m.withColumn("new_score", sc.record_score(parts, boost, engagement)).withColumn("n_reasons", F.size(sc.reasons(parts, boost, engagement)))


def q33_candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("cand_id", "new_score", "n_reasons")


SQL["q33_candidate_score"] = MATCHED.replace("FROM candidates)", "FROM candidates QUALIFY row_number() OVER (PARTITION BY cand_id) = 1)", 1) + f""",
p AS (SELECT cand_id, CASE source_priority WHEN 'high' THEN 1.0 WHEN 'low' THEN 0.35 ELSE 0.65 END::DOUBLE AS pr, len(hits) AS n, {_ENG} AS en,
  CASE WHEN coalesce(category, '') = 'research' THEN 1.0 ELSE least(len({_hits(RESEARCH)}) / 3.0, 1.0) END::DOUBLE AS re,
  {_CANON} = 'engineering_ai' AND {_any(["agent", "copilot"])} AND {_any(["simulation", "mesh"])} AS boost, {_HOURS_SQL} AS h, published_at,
  greatest(epoch_us(TIMESTAMPTZ '{NOW}+00') / 1e6 - epoch_us(published_at) / 1e6, 0) / 3600 AS age,
  {log_sql("engagement.points", 1200)} AS lp, {log_sql("engagement.comments", 800)} AS lc, {log_sql("engagement.upvotes", 5000)} AS lu,
  (CASE WHEN engagement.points > 0 THEN 1 ELSE 0 END + CASE WHEN engagement.comments > 0 THEN 1 ELSE 0 END + CASE WHEN engagement.upvotes > 0 THEN 1 ELSE 0 END) AS seen FROM h)
SELECT cand_id, round(0.0::DOUBLE + 32 * pr + 22 * (CASE WHEN published_at IS NULL THEN 0.35 WHEN age > h THEN 0.0 ELSE greatest(0.15, 1 - age / h * 0.75) END)::DOUBLE
  + 20 * least(n / 6.0::DOUBLE, 1.0)::DOUBLE + 14 * en + 8 * re + CASE WHEN boost THEN 10.0 ELSE 0.0 END::DOUBLE + 14 * lp + 10 * lc + 10 * lu, 3) AS new_score,
  5 + CASE WHEN boost THEN 1 ELSE 0 END + seen AS n_reasons FROM p""".replace(",\np AS", ", p AS", 1)
SQL["q33_candidate_score"] = SQL["q33_candidate_score"].replace("FROM b) , p AS", "FROM b), p AS")


def _unique_key() -> Column:
    return F.when(F.coalesce("url", F.lit("")) != "", normal_url(F.col("url"))).otherwise(F.lower("title"))


def q34_first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_wins(table(spark, sf_dir, "candidates").select("issue_date", "cand_id", "url", "title"), [F.col("issue_date"), _unique_key()], ["cand_id"]).select("issue_date", "cand_id")


SQL["q34_first_wins_dedup"] = "SELECT issue_date, min(cand_id) AS cand_id FROM candidates GROUP BY issue_date, lower(coalesce(nullif(url, ''), title))"


def q35_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first max_entries records of each source, all of a searched site; sources switched off by now count as well."""
    raw = table(spark, sf_dir, "raw_candidates").select("source", F.col("rec_id").alias("rec_ord"))
    registry = table(spark, sf_dir, "sources").select("name", fetch_kind(F.col("fetch_type"), F.col("source_type")).alias("kind"), F.coalesce("max_entries", F.lit(25)).alias("max_entries"))
    kept = capped(raw, registry).withColumnRenamed("rec_ord", "rec_id")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("rec_id")))


SQL["q35_source_cap"] = """SELECT r.source, r.rec_id, row_number() OVER (PARTITION BY r.source ORDER BY r.rec_id) AS place FROM raw_candidates r
JOIN sources s ON s.name = r.source QUALIFY place <= coalesce(s.max_entries, 25)"""


def _event_items(df: DataFrame, variant: ev.Variant = BUILDER) -> DataFrame:
    return ev.event_columns(df, "title", "url", "source", EVENT_RULES, PUBLISHERS, variant)


def q36_same_event_pairs(spark: SparkSession, sf_dir: str, variant: ev.Variant = BUILDER) -> DataFrame:
    delivered = _event_items(table(spark, sf_dir, "candidates").where("issue_date IS NOT NULL"), variant)
    return ev.same_event_pairs(delivered, "cand_id", ["issue_date"], variant, once=False).select("issue_date", F.col("left").alias("cand_id_a"), F.col("right").alias("cand_id_b"))


_URL = r"lower(regexp_extract(trim(coalesce(url, '')), '^([^:/?#]+://[^/?#]+)', 1) || regexp_replace(regexp_extract(trim(coalesce(url, '')), '^[^:/?#]+://[^/?#]+([^?#]*)', 1), '/+$', ''))"
_E = f"e AS (SELECT cand_id, issue_date, lower(coalesce(source, '')) AS src, {tokens_sql('title')} AS tok, CASE WHEN regexp_matches(trim(coalesce(url, '')), '^[^:/?#]+://[^/?#]+') THEN {_URL} ELSE '' END AS u, lower(title) AS t FROM items)"


def _event_sql(key: bool) -> str:
    same = "(a.u <> '' AND a.u = b.u) OR (n >= 5 AND n >= 0.5 * s) OR (n >= 4 AND n >= 0.42 * w) OR (a.src = b.src AND n >= 2 AND n >= 0.67 * s)"
    return same + (" OR (a.k IS NOT NULL AND a.k = b.k)" if key else "")


SQL["q36_same_event_pairs"] = f"""WITH {ITEMS}, {_E},
p AS (SELECT a.issue_date, a.cand_id AS cand_id_a, b.cand_id AS cand_id_b, a.u AS au, b.u AS bu, a.src AS asrc, b.src AS bsrc, len(list_intersect(a.tok, b.tok)) AS n,
      least(len(a.tok), len(b.tok)) AS s, len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok)) AS w FROM e a JOIN e b ON a.issue_date = b.issue_date AND a.cand_id < b.cand_id)
SELECT issue_date, cand_id_a, cand_id_b FROM p WHERE (au <> '' AND au = bu) OR (n >= 5 AND n >= 0.5 * s) OR (n >= 4 AND n >= 0.42 * w) OR (asrc = bsrc AND n >= 2 AND n >= 0.67 * s)"""


def q37_history_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that repeat one of the audit lists (what was published, the 100 best of an issue) of the week before."""
    return _repeats_of_audit(_event_items(_items(spark, sf_dir, EVENT).where("issue_date IS NOT NULL")), cut(_event_items(_audit(spark, sf_dir, cols=EVENT))))


def _repeats_of_audit(new: DataFrame, past: DataFrame) -> DataFrame:
    join = ev.repeats_of_few if past.count() <= BROADCAST_ROWS else ev.repeats_of
    return join(new, past, "cand_id", "issue_date", 7)


AUDIT = f"{ITEMS}, audit AS (SELECT * FROM items WHERE issue_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY issue_date ORDER BY score DESC NULLS LAST, cand_id) <= 100)"
_AE = _E.replace("FROM items)", "FROM audit)").replace("lower(title) AS t FROM", f"{_rules(EVENT_RULES, 'NULL', 'lower(title)')} AS k FROM")


def _audit(spark: SparkSession, sf_dir: str, n: int = 100, cols: tuple[str, ...] = ITEM) -> DataFrame:
    """The report of an issue's best records, a feature of the pipeline."""
    rows = _items(spark, sf_dir, cols).where("issue_date IS NOT NULL")
    return first_rows(rows, ["issue_date"], [F.col("score").desc_nulls_last(), F.col("cand_id")], n).drop("place")


SQL["q37_history_repeats"] = f"""WITH {AUDIT}, {_AE},
p AS (SELECT a.cand_id, b.cand_id AS other, a.u AS au, b.u AS bu, a.src AS asrc, b.src AS bsrc, a.k AS ak, b.k AS bk, len(list_intersect(a.tok, b.tok)) AS n, least(len(a.tok), len(b.tok)) AS s,
      len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok)) AS w FROM e a JOIN e b ON b.issue_date < a.issue_date AND b.issue_date >= a.issue_date - 7)
SELECT cand_id, min(other) AS earlier FROM p WHERE (au <> '' AND au = bu) OR ak = bk OR (n >= 5 AND n >= 0.5 * s) OR (n >= 4 AND n >= 0.42 * w) OR (asrc = bsrc AND n >= 2 AND n >= 0.67 * s) GROUP BY cand_id"""


def q38_event_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates").select("cand_id", first_rule(F.col("title"), EVENT_RULES, None).alias("event_key"))


SQL["q38_event_key"] = f"SELECT cand_id, {_rules(EVENT_RULES, 'NULL', 'lower(title)')} AS event_key FROM candidates"


DISCOVERY, NEWS_NAME, DISCOVERY_TAG = "google_news_rss", "Google News", "trusted_discovery"
NOISE = ["licence", "pricing", "broker"]
ISSUE = Issue(("issue_date",), "cand_id", ("-score", "cand_id"))


def _selectable(spark: SparkSession, sf_dir: str, category=canonical_category, variant: ev.Variant = BUILDER) -> DataFrame:
    """Records of issues with what sections are chosen by."""
    i = _items(spark, sf_dir).where("issue_date IS NOT NULL")
    kind, source, tags = F.coalesce("source_kind", F.lit("")), F.coalesce("source", F.lit("")), F.col("source_tags")
    broad = broad_discovery(kind, source, tags, DISCOVERY, NEWS_NAME, DISCOVERY_TAG)
    told = any_word(F.concat_ws(" ", all_text(), "source", F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")), MEDICAL)
    i = i.withColumns({
        "category": category(F.lower(F.trim(F.coalesce("category", F.lit(""))))), "preferred": F.coalesce("source_priority", F.lit("")) == "high", "trusted": trusted(kind, tags, DISCOVERY, DISCOVERY_TAG),
        "broad": F.when(F.coalesce(broad, F.lit(False)), "broad"), "topic": first_rule(all_text(), TOPIC_RULES, "other"), "about": told, "noise": excluded_noise(F.col("title"), F.col("source"), F.col("text"), NOISE), "origin": source,
    })
    cols = ["cand_id", "issue_date", "title", "url", "source", "score", "category", "preferred", "trusted", "broad", "topic", "about", "noise", "origin"]
    return _event_items(i.select(*cols), variant).drop("url")


def q39_select_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft_section(cut(_selectable(spark, sf_dir)), ISSUE, "general_ai", 10)


def q40_select_engineering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft_section(_selectable(spark, sf_dir), ISSUE, "engineering_ai", 5)


def q41_select_bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft_topic_section(_selectable(spark, sf_dir), ISSUE, F.col("about"), 5)


def q60_select_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section without caps of its own."""
    return draft_section(_selectable(spark, sf_dir), ISSUE, "research", 5)


def q61_select_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_section(_selectable(spark, sf_dir), ISSUE, "engineering_ai", 5, F.col("noise"))


def q62_day_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of each issue as shown: from its audit list, short ones filled from the draft's."""
    rows = cut(_selectable(spark, sf_dir))
    pick = {"general_ai": draft_section(rows, ISSUE, "general_ai", 10), "engineering_ai": draft_section(rows, ISSUE, "engineering_ai", 5), "topic": draft_topic_section(rows, ISSUE, F.col("about"), 5), "research": draft_section(rows, ISSUE, "research", 5)}
    origin = F.lower(publisher(F.col("source"), F.col("title"), NEWS_NAME))
    shown = cut(_selectable(spark, sf_dir, page_category, ev.RENDERER).withColumn("origin", origin))
    listed = {k: cut(shown.join(v, ["issue_date", "cand_id"])) for k, v in pick.items()}
    best = first_rows(shown, ["issue_date"], [F.col("score").desc_nulls_last(), F.col("cand_id")], 100).drop("place")
    return day_sections(best, listed, ISSUE, F.col("about"), F.col("noise"))


def q42_published_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _selectable(spark, sf_dir).where(section_matches("general_ai", F.col("category"), F.col("preferred")))
    cols = ["cand_id", "issue_date", "score", "_tok", "_url", "_key", "_src", "topic", "broad", "category", "preferred", "trusted", "origin"]
    passes = [Pass("trusted", {"topic": 2, "origin": 2}, ("topic", "origin")), Pass("_any", {"topic": 2, "origin": 2, "broad": 2}, ("topic", "origin", "broad")), Pass("_any", {"origin": 2, "broad": 2}, ("origin", "broad"))]
    return published_index(rows.select(*cols), "issue_date", "cand_id", lambda day: ISSUE.select(day.withColumn("_any", F.lit(True)), passes, 10, BUILDER)).select("issue_date", "cand_id", "place")


def q43_archive_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar_pages(table(spark, sf_dir, "orders"), "o_orderdate")


SQL["q43_archive_spine"] = """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS records FROM orders GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day)
SELECT s.day, coalesce(d.records, 0) AS records, CAST(ceil(row_number() OVER (ORDER BY s.day DESC) / 7.0) AS INTEGER) AS page FROM s LEFT JOIN d ON s.day = d.day"""


def q44_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = F.lower(F.trim(F.coalesce("category", F.lit(""))))
    rows = _items(spark, sf_dir).where("issue_date IS NOT NULL").select("issue_date", cat.alias("section"))
    return quality_problems(rows, "issue_date", "section", {"startup": 2, "community": 9, "vendor": 12}, 150)


SQL["q44_quality_gate"] = f"""WITH {ITEMS},
n AS (SELECT issue_date, count(*) FILTER (lower(trim(category)) = 'startup') AS s, count(*) FILTER (lower(trim(category)) = 'community') AS c, count(*) FILTER (lower(trim(category)) = 'vendor') AS v, count(*) AS a
      FROM items WHERE issue_date IS NOT NULL GROUP BY 1)
SELECT issue_date, 'startup has ' || s || ' of 2' AS problem FROM n WHERE s < 2 UNION ALL SELECT issue_date, 'community has ' || c || ' of 9' FROM n WHERE c < 9
UNION ALL SELECT issue_date, 'vendor has ' || v || ' of 12' FROM n WHERE v < 12 UNION ALL SELECT issue_date, 'issue has ' || a || ' of 150' FROM n WHERE a < 150"""


def q45_duplicate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_problems(cut(_event_items(_audit(spark, sf_dir, cols=EVENT))), "cand_id", "issue_date", 7)


SQL["q45_duplicate_gate"] = SQL["q37_history_repeats"].replace("SELECT cand_id, min(other) AS earlier FROM p WHERE", "SELECT cand_id, min(other) AS other, 'history' AS kind FROM p WHERE") + f"""
UNION ALL SELECT a.cand_id, b.cand_id, 'issue' FROM e a JOIN e b ON a.issue_date = b.issue_date AND a.cand_id < b.cand_id WHERE (a.u <> '' AND a.u = b.u) OR a.k = b.k
 OR (len(list_intersect(a.tok, b.tok)) >= 5 AND len(list_intersect(a.tok, b.tok)) >= 0.5 * least(len(a.tok), len(b.tok)))
 OR (len(list_intersect(a.tok, b.tok)) >= 4 AND len(list_intersect(a.tok, b.tok)) >= 0.42 * (len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok))))
 OR (a.src = b.src AND len(list_intersect(a.tok, b.tok)) >= 2 AND len(list_intersect(a.tok, b.tok)) >= 0.67 * least(len(a.tok), len(b.tok)))"""


def q46_paper_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of the last eight days of an issue that are to the point and were in no issue of the 60 days before."""
    d = table(spark, sf_dir, "documents").where("doc_kind = 'abstract' AND published_at IS NOT NULL")
    body = F.lower(F.concat_ws(" ", "title", "text"))
    day = F.to_date("published_at")
    fit = d.where(body.rlike("mesh|simulation|casting|turbine") & body.rlike("model|agent|neural") & ~body.rlike("licence")).select("doc_id", day.alias("day"), tx.slug(F.col("title")).alias("key"))
    issue = F.lit(fit.agg(F.max("day")).first()[0]).cast("date")
    new = fit.where(F.col("day").between(F.date_sub(issue, 8), issue))
    old = fit.where((F.col("day") < F.date_sub(issue, 8)) & (F.col("day") >= F.date_sub(issue, 68)))
    return first_wins(new.join(old.select("key"), "key", "left_anti").select("doc_id", "day", "key"), [F.col("key")], ["doc_id"]).select("doc_id", "day")


SQL["q46_paper_select"] = """
WITH f AS (SELECT doc_id, CAST(published_at AS DATE) AS day, lower(regexp_replace(regexp_replace(title, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS key, lower(concat_ws(' ', title, text)) AS t
           FROM documents WHERE doc_kind = 'abstract' AND published_at IS NOT NULL),
g AS (SELECT *, max(day) OVER () AS issue FROM f WHERE regexp_matches(t, 'mesh|simulation|casting|turbine') AND regexp_matches(t, 'model|agent|neural') AND NOT regexp_matches(t, 'licence')),
o AS (SELECT key FROM g WHERE day < issue - 8 AND day >= issue - 68 AND key IS NOT NULL)
SELECT doc_id, day FROM g WHERE day BETWEEN issue - 8 AND issue AND (key IS NULL OR key NOT IN (SELECT key FROM o)) QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1"""


def q48_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of one pass over the records, per issue; a pass is made as its issue's day begins."""
    m = _matched(table(spark, sf_dir, "candidates").where("issue_date IS NOT NULL"))
    hours = widened(hours_of(F.col("category")), F.col("source_kind"), F.col("category"), F.size("_eng") > 0, tx.has_any(all_text(), AI), HOURS["engineering_ai"])
    named = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")
    fresh = within_window(F.col("published_at"), F.col("issue_date").cast("timestamp"), hours)
    m = m.select("issue_date", "source", _unique_key().alias("key"), (fresh & named & tx.looks_english(all_text()) & (F.size("hits") > 0) & _gated(m)).alias("passed"))
    return _run_log(m)


def _run_log(m: DataFrame) -> DataFrame:
    return m.groupBy("issue_date").agg(
        F.count("*").alias("fetched"), F.count_if("passed").alias("filtered"), (F.count_if("passed") - F.countDistinct(F.when(F.col("passed"), F.col("key")))).alias("duplicates"), F.countDistinct("source").alias("sources"),
    )


SQL["q48_run_log"] = MATCHED + r""", e AS (SELECT issue_date, source, lower(coalesce(nullif(url, ''), title)) AS key, len(hits) > 0 AND length(regexp_replace(title || ' ' || coalesce(text, ''), '[^A-Za-z]', '', 'g')) >= 20
  AND length(regexp_replace(title || ' ' || coalesce(text, ''), '[^\x00-\x7F]', '', 'g')) / greatest(length(title || ' ' || coalesce(text, '')), 1) > 0.82 AS ok FROM h WHERE issue_date IS NOT NULL)
SELECT issue_date, count(*) AS fetched, count(*) FILTER (ok) AS filtered, count(*) FILTER (ok) - count(DISTINCT key) FILTER (ok) AS duplicates, count(DISTINCT source) AS sources FROM e GROUP BY 1""".replace(", e AS", ", e AS", 1)
SQL["q48_run_log"] = SQL["q48_run_log"].replace("FROM b) , e AS", "FROM b), e AS")


def q49_missing_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha1(F.lower("title").cast("binary")).alias("id"), "doc_kind")
    items = _items(spark, sf_dir).select("cand_id", F.sha1(F.lower("title").cast("binary")).alias("id"))
    return items.join(docs.where("doc_kind <> 'forum_post'").select("id"), "id", "left_anti").select("cand_id")


SQL["q49_missing_summaries"] = f"WITH {ITEMS} SELECT cand_id FROM items WHERE title IS NULL OR lower(title) NOT IN (SELECT lower(title) FROM documents WHERE doc_kind <> 'forum_post' AND title IS NOT NULL)"


def q50_hydrate_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each address with the record found first in lists of falling rank: audit list, then all."""
    items = _items(spark, sf_dir).where("coalesce(url, '') <> ''").select("url", "cand_id", "score")
    audit = _audit(spark, sf_dir).where("coalesce(url, '') <> ''").select("url", "cand_id", "score")
    ranked = audit.withColumn("list", F.lit(0)).union(items.withColumn("list", F.lit(1)))
    return first_wins(ranked, [F.col("url")], ["list", "cand_id"]).select("url", "cand_id", "list")


SQL["q50_hydrate_priority"] = f"""WITH {AUDIT}, r AS (SELECT url, cand_id, 0 AS list FROM audit UNION ALL SELECT url, cand_id, 1 FROM items)
SELECT url, cand_id, list FROM r WHERE coalesce(url, '') <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY list, cand_id) = 1"""


def q53_effective_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("cand_id") % 2 == 0, F.concat("title", F.lit(" - "), F.coalesce("registry_category", F.lit("x")))).otherwise(F.col("title"))
    src = F.when(F.col("cand_id") % 4 < 2, F.lit("Wire News: all")).otherwise(F.col("source"))
    return table(spark, sf_dir, "candidates").select("cand_id", effective_source(src, t, "Wire News").alias("s"))


SQL["q53_effective_source"] = """WITH t AS (SELECT cand_id, CASE WHEN cand_id % 2 = 0 THEN title || ' - ' || coalesce(registry_category, 'x') ELSE title END AS title, CASE WHEN cand_id % 4 < 2 THEN 'Wire News: all' ELSE source END AS source FROM candidates)
SELECT cand_id, CASE WHEN starts_with(source, 'Wire News') AND contains(title, ' - ') THEN trim(string_split(title, ' - ')[-1]) ELSE source END AS s FROM t"""


def q54_ranked_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit list: the 100 best of all, ties by arrival."""
    best = _scored(spark, sf_dir).orderBy(F.col("new_score").desc(), "cand_id").limit(100)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("new_score").desc(), "cand_id"))).select("cand_id", "new_score", "place")


SQL["q54_ranked_audit"] = "SELECT cand_id, new_score, row_number() OVER (ORDER BY new_score DESC, cand_id) AS place FROM (" + SQL["q33_candidate_score"] + ") QUALIFY place <= 100"

def q55_window_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = widened(hours_of(F.col("category")), F.col("source_kind"), F.col("category"), tx.has_any(all_text(), ENGINEERING), tx.has_any(all_text(), AI), 720)
    return table(spark, sf_dir, "candidates").select("cand_id", h.alias("hours"))


SQL["q55_window_widened"] = T + f"SELECT cand_id, CASE WHEN source_kind = 'sitemap_or_search' AND coalesce(category, '') <> 'engineering_ai' AND {_any(ENGINEERING)} AND {_any(AI)} THEN 720 ELSE {_HOURS_SQL} END AS hours FROM c"


def q56_section_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    preferred = F.coalesce("source_priority", F.lit("")) == "high"
    ok = trusted(F.col("source_kind"), F.col("source_tags"), "google_news_rss", "trusted_discovery")
    return table(spark, sf_dir, "candidates").where(section_matches("general_ai", F.col("category"), preferred) & ok).select("cand_id")


SQL["q56_section_match"] = """SELECT cand_id FROM candidates WHERE (category = 'general_ai' OR (category = 'research' AND coalesce(source_priority, '') = 'high'))
AND (coalesce(source_kind, '') <> 'google_news_rss' OR coalesce(list_contains(source_tags, 'trusted_discovery'), false))"""


def q57_section_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the audit lists whose event no kept record of an earlier section of the issue tells of."""
    place = F.when(F.col("category") == "engineering_ai", 1).when(F.col("category") == "research", 2).otherwise(0)
    e = cut(_event_items(_audit(spark, sf_dir, cols=(*EVENT, "category"))).withColumn("section_ord", place))
    return without_earlier_sections(e, "cand_id", ["issue_date"], "section_ord").select("issue_date", "cand_id", "section_ord")


_SECTION_E = _AE.replace("SELECT cand_id, issue_date,", "SELECT cand_id, issue_date, CASE category WHEN 'engineering_ai' THEN 1 WHEN 'research' THEN 2 ELSE 0 END AS o,")
SQL["q57_section_overlap"] = f"""WITH {AUDIT}, {_SECTION_E},
p AS (SELECT a.cand_id AS x, b.cand_id AS y, a.o AS ao, b.o AS bo FROM e a JOIN e b ON a.issue_date = b.issue_date AND b.o < a.o WHERE (a.u <> '' AND a.u = b.u) OR a.k = b.k
 OR (len(list_intersect(a.tok, b.tok)) >= 5 AND len(list_intersect(a.tok, b.tok)) >= 0.5 * least(len(a.tok), len(b.tok)))
 OR (len(list_intersect(a.tok, b.tok)) >= 4 AND len(list_intersect(a.tok, b.tok)) >= 0.42 * (len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok))))
 OR (a.src = b.src AND len(list_intersect(a.tok, b.tok)) >= 2 AND len(list_intersect(a.tok, b.tok)) >= 0.67 * least(len(a.tok), len(b.tok)))),
k1 AS (SELECT * FROM e WHERE o = 1 AND cand_id NOT IN (SELECT x FROM p WHERE bo = 0)),
k2 AS (SELECT * FROM e WHERE o = 2 AND cand_id NOT IN (SELECT x FROM p WHERE bo = 0 OR y IN (SELECT cand_id FROM k1)))
SELECT issue_date, cand_id, o AS section_ord FROM e WHERE o = 0 UNION ALL SELECT issue_date, cand_id, o FROM k1 UNION ALL SELECT issue_date, cand_id, o FROM k2"""


def q58_shown_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = tx.escape_html(F.concat(F.lit("<i>\"'"), "title"))
    return table(spark, sf_dir, "documents").where("published_at IS NOT NULL").select("doc_id", long_date(F.col("published_at")).alias("day"), title.alias("title"), tx.blank_if(F.col("text"), ["licence", "pricing"]).alias("text"))


SQL["q58_shown_line"] = """
WITH d AS (SELECT doc_id, published_at, text, '<i>' || chr(34) || chr(39) || title AS title FROM documents WHERE published_at IS NOT NULL)
SELECT doc_id, strftime(published_at, '%A, %B %d, %Y') AS day, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') AS title,
CASE WHEN contains(lower(text), 'licence') OR contains(lower(text), 'pricing') THEN '' ELSE text END AS text FROM d"""


def q59_latest_first_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "repo_snapshots").where("full_name IS NOT NULL AND snapshot_date IS NOT NULL").select("snapshot_date", "ingest_ord", "full_name", "stars")
    return latest_first_delivered(rows, F.lower("full_name")).select("ingest_ord", growth_hint(F.coalesce("stars", F.lit(0)), F.col("ingest_ord")).alias("hint"))


SQL["q59_latest_first_delivered"] = """SELECT ingest_ord, greatest(6, floor(coalesce(stars, 0) * (0.01::DOUBLE + (ingest_ord % 5) * 0.004::DOUBLE)))::BIGINT AS hint FROM repo_snapshots
WHERE full_name IS NOT NULL AND snapshot_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(full_name) ORDER BY snapshot_date DESC, ingest_ord) = 1"""


def q47_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages that stay on their site; each record's address, a bare link and a foreign one make a page."""
    base = F.concat(part(F.col("url"), 1), F.lit("://"), part(F.col("url"), 2), F.lit("/"))
    html = F.concat(F.lit("<a class='t' href=\""), "url", F.lit('">'), "title", F.lit("</a><a href='/x-y'>go</a><a href='https://elsewhere.example/'>Another page's title</a>"))
    pages = table(spark, sf_dir, "incoming_candidates").where("url IS NOT NULL").select(F.col("rec_id").cast("string").alias("source"), base.alias("base_url"), html.alias("payload"))
    return page_links(pages).select(F.col("source").cast("long").alias("rec_id"), "rec_ord", "title", "url")


SQL["q47_page_links"] = r"""WITH p AS (SELECT rec_id, title, regexp_replace(url, '#.*$', '') AS url, regexp_extract(url, '^([^:/?#]+://[^/?#]+)', 1) AS base FROM incoming_candidates WHERE url IS NOT NULL)
SELECT rec_id, 0 AS rec_ord, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, url FROM p UNION ALL SELECT rec_id, 1, 'X Y', base || '/x-y' FROM p"""

QUERIES.update({k: v for k, v in list(globals().items()) if k.startswith("q") and k[1:3].isdigit()})
