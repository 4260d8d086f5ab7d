"""Queries of the text, address and time scalars, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as tx
from quillspan.functions import urls as ux
from quillspan.functions.scores import log_scale
from quillspan.functions.times import recency, within_window
from quillspan.session import table

QUERIES, SQL = {}, {}
#: Words of publishers' names that an event's tokens leave out; a parameter, as all lists here.
PUBLISHERS = ("digest", "journal", "newsroom", "bulletin")
NOW = "2026-06-30 00:00:00"
HOURS = {"general_ai": 240, "engineering_ai": 720, "research": 480, "community": 120}


def q10_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<p class='x'>"), "title", F.lit("</p>\n <br/>"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "raw_candidates").select("rec_id", tx.clean_text(marked).alias("clean"))


SQL["q10_clean_text"] = r"""SELECT rec_id, trim(regexp_replace(regexp_replace('<p class=''x''>' || title || '</p>' || chr(10) || ' <br/>' || coalesce(text, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM raw_candidates"""


def q11_english_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(tx.looks_english(F.col("text"), ratio=0.97)).select("doc_id", "lang")


SQL["q11_english_filter"] = r"""SELECT doc_id, lang FROM documents WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 20
AND length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / greatest(length(text), 1) > 0.97"""

_GENERIC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def _p(g: int, col: str = "url") -> str:
    return f"regexp_extract(coalesce({col}, ''), '{_GENERIC}', {g})"


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "incoming_candidates")


def q12_norm_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("rec_id", ux.normal_url(F.col("url")).alias("u"))


SQL["q12_norm_url"] = f"""
WITH p AS (SELECT rec_id, {_p(1)} AS s, {_p(2)} AS h, {_p(3)} AS p, array_to_string(list_filter(string_split({_p(4)}, '&'), lambda x: regexp_matches(x, '^[^=]+=.+$') AND NOT regexp_matches(lower(x), '^utm_')), '&') AS q FROM incoming_candidates)
SELECT rec_id, s || '://' || lower(h) || regexp_replace(p, '/+$', '') || CASE WHEN coalesce(q, '') <> '' THEN '?' || q ELSE '' END AS u FROM p"""


def q13_event_url_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("rec_id", ux.page_url(F.col("url")).alias("u"))


SQL["q13_event_url_key"] = f"SELECT rec_id, CASE WHEN {_p(1)} = '' OR {_p(2)} = '' THEN '' ELSE lower({_p(1)} || '://' || {_p(2)} || regexp_replace({_p(3)}, '/+$', '')) END AS u FROM incoming_candidates"


def q14_shown_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("rec_id", ux.shown_url(F.col("url")).alias("u"))


SQL["q14_shown_url"] = r"""SELECT rec_id, lower(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '[?&](utm_[^=&]+|fbclid|gclid|mc_cid|mc_eid)=[^&]+', '', 'gi'), '/+$', '')) AS u FROM incoming_candidates"""


def q15_article_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.when(F.col("rec_id") % 3 == 0, F.concat(F.lit("http://arxiv.org/pdf/2601."), F.lpad(F.col("rec_id").cast("string"), 5, "0"), F.lit("v2"))).otherwise(F.col("url"))
    return _urls(spark, sf_dir).select("rec_id", ux.article_url(u).alias("u"))


SQL["q15_article_url"] = r"""
WITH p AS (SELECT rec_id, CASE WHEN rec_id % 3 = 0 THEN 'http://arxiv.org/pdf/2601.' || lpad(CAST(rec_id AS VARCHAR), 5, '0')[1:5] || 'v2' ELSE url END AS url FROM incoming_candidates)
SELECT rec_id, CASE WHEN regexp_extract(url, 'arxiv\.org/(?:abs|pdf)/([0-9]+\.[0-9]+)', 1) <> '' THEN 'https://arxiv.org/abs/' || regexp_extract(url, 'arxiv\.org/(?:abs|pdf)/([0-9]+\.[0-9]+)', 1)
ELSE regexp_replace(url, '[?#].*$', '') END AS u FROM p"""


def q16_title_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).where("url IS NOT NULL").select("rec_id", ux.title_from_url(F.col("url")).alias("t"))


SQL["q16_title_from_url"] = rf"""
WITH p AS (SELECT rec_id, {_p(2)} AS host, string_split(regexp_replace({_p(3)}, '/+$', ''), '/')[-1] AS last FROM incoming_candidates WHERE url IS NOT NULL),
s AS (SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(last, '\.(html?|php|aspx?)$', '', 'i'), '[-_]+', ' ', 'g'), '\s+', ' ', 'g'))) AS stem FROM p)
SELECT rec_id, CASE WHEN last = '' THEN regexp_replace(host, 'www\.', '', 'g') ELSE array_to_string(list_transform(regexp_extract_all(stem, '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '') END AS t FROM s"""


def q17_entry_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("rec_id", tx.entry_id(F.col("url"), F.col("title")).alias("id"))


SQL["q17_entry_id"] = "SELECT rec_id, substr(sha1(lower(coalesce(nullif(url, ''), title, ''))), 1, 16) AS id FROM incoming_candidates"


def q18_slug_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("rec_id", tx.slug(F.col("title")).alias("slug"), tx.heading_id(F.col("title")).alias("heading"))


SQL["q18_slug_heading"] = """SELECT rec_id, lower(regexp_replace(regexp_replace(title, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug,
coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS heading FROM incoming_candidates"""

_DROP = ", ".join(f"'{w}'" for w in (*tx.COMMON_WORDS, *PUBLISHERS))


def tokens_sql(title: str) -> str:
    return rf"""list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(coalesce({title}, '')), '\s+-\s+[^-]+$', ''), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_DROP}))))"""


def q19_event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("rec_id", F.array_join(tx.event_tokens(F.col("title"), PUBLISHERS), " ").alias("tokens"))


SQL["q19_event_tokens"] = f"SELECT rec_id, array_to_string({tokens_sql('title')}, ' ') AS tokens FROM incoming_candidates"


def q20_clean_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_cell(F.col("text")).alias("cell"))


SQL["q20_clean_cell"] = """WITH v AS (SELECT doc_id, trim(translate(coalesce(text, ''), chr(10) || '|', ' /'), ' ') AS v FROM documents)
SELECT doc_id, CASE WHEN v = '' THEN '-' WHEN length(v) > 110 THEN substr(v, 1, 107) || '...' ELSE v END AS cell FROM v"""


def q21_extract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.extract_summary(F.col("title"), F.col("text")).alias("summary"))


# RE2 has no lookbehind: a mark is put after each sentence's end instead, and texts are split there.
SQL["q21_extract_summary"] = r"""
WITH b AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS body, trim(coalesce(title, '')) AS head FROM documents WHERE lang = 'en'),
r AS (SELECT doc_id, CASE WHEN head <> '' AND starts_with(lower(body), lower(head)) THEN regexp_replace(substr(body, length(head) + 1), '^[ \-:.,]+|[ \-:.,]+$', '', 'g') ELSE body END AS rest FROM b),
s AS (SELECT doc_id, coalesce(array_to_string(list_filter(string_split(regexp_replace(rest, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:2], lambda x: x <> ''), ' '), '') AS two FROM r)
SELECT doc_id, CASE WHEN two = '' THEN 'No summary.' WHEN length(two) > 340 THEN rtrim(substr(two, 1, 337)) || '...' ELSE two END AS summary FROM s"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates")


def hours_of(category):
    from quillspan.functions.rules import mapped

    return mapped(category, {k: str(v) for k, v in HOURS.items()}, "24").cast("int")


_HOURS_SQL = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in HOURS.items()) + " ELSE 24 END"


def q25_recency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    return _candidates(spark, sf_dir).where(within_window(F.col("published_at"), now, hours_of(F.col("category")))).select("cand_id", "category")


SQL["q25_recency_filter"] = f"SELECT cand_id, category FROM candidates WHERE published_at IS NULL OR published_at >= TIMESTAMPTZ '{NOW}+00' - to_hours({_HOURS_SQL})"


def q26_recency_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    return _candidates(spark, sf_dir).select("cand_id", F.round(recency(F.col("published_at"), now, hours_of(F.col("category"))), 6).alias("novelty"))


SQL["q26_recency_boost"] = f"""
WITH a AS (SELECT cand_id, published_at, {_HOURS_SQL} AS h, greatest(epoch_us(TIMESTAMPTZ '{NOW}+00') / 1e6 - epoch_us(published_at) / 1e6, 0) / 3600 AS age FROM candidates)
SELECT cand_id, round(CASE WHEN published_at IS NULL THEN 0.35 WHEN age > h THEN 0.0 ELSE greatest(0.15, 1 - age / h * 0.75) END::DOUBLE, 6) AS novelty FROM a"""


def q27_log_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _candidates(spark, sf_dir)
    return e.select("cand_id", *[F.round(log_scale(F.col(f"engagement.{n}"), cap), 6).alias(n) for n, cap in (("points", 1200), ("comments", 800), ("upvotes", 5000))])


def log_sql(c: str, cap: int) -> str:
    return f"CASE WHEN {c} > 0 THEN least(ln(1 + {c}) / ln(1 + {cap}), 1.0) ELSE 0.0 END::DOUBLE"


SQL["q27_log_scale"] = "SELECT cand_id, " + ", ".join(f"round({log_sql(f'engagement.{n}', cap)}, 6) AS {n}" for n, cap in (("points", 1200), ("comments", 800), ("upvotes", 5000))) + " FROM candidates"

QUERIES.update({k: v for k, v in list(globals().items()) if k.startswith("q") and k[1:3].isdigit()})
