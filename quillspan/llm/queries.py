"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.history import repeats_of_history
from quillspan.llm.mixing import mixture
from quillspan.llm.neardup import near_duplicate_pairs
from quillspan.llm.packing import pack
from quillspan.llm.radix import over_cap
from quillspan.llm.spans import shared_spans
from quillspan.llm.tokens import token_sizes
from quillspan.llm.topn import top_n
from quillspan.session import cut, table

#: Issues whose caps may be broadcast.
BROADCAST_ROWS = 10_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records beyond floor(n / 25), at least 3, of their source in an issue of n distinct records."""
    c = table(spark, sf_dir, "candidates").select("issue_date", "cand_id", "source", "score").where("issue_date IS NOT NULL AND cand_id IS NOT NULL")
    name = F.lower(F.trim(F.regexp_replace("source", r"(?U)\s+", " ")))
    one = (
        c.select("issue_date", "cand_id", F.when(name != "", name).alias("source"), F.when(~F.isnan("score"), F.col("score")).alias("score"))
        .groupBy("issue_date", "cand_id")
        .agg(F.max(F.struct("score", "source")).alias("best"))
        .select("issue_date", "cand_id", "best.source", "best.score")
    )
    n = one.groupBy("issue_date").agg(F.count("*").alias("n")).select("issue_date", F.greatest(F.lit(3), F.floor(F.col("n") / 25)).cast("long").alias("cap"))
    n = cut(n)  # a row an issue
    caps = F.broadcast(n) if n.count() <= BROADCAST_ROWS else n
    return over_cap(one.where("source IS NOT NULL").join(caps, "issue_date"), ["issue_date", "source"], "score", "cand_id", "cap").select("cand_id")


SQL["p4_found"] = r"""
WITH c AS (SELECT DISTINCT issue_date, cand_id, score, nullif(trim(regexp_replace(lower(source), '\s+', ' ', 'g')), '') AS src FROM candidates),
n AS (SELECT issue_date, greatest(3, count(DISTINCT cand_id) // 25) AS cap FROM c GROUP BY issue_date),
r AS (SELECT c.cand_id, n.cap, row_number() OVER (PARTITION BY c.issue_date, c.src ORDER BY score DESC NULLS LAST, cand_id) AS rn
      FROM c JOIN n USING (issue_date) WHERE src IS NOT NULL)
SELECT cand_id FROM r WHERE rn > cap
"""


def _category() -> Column:
    c = F.lower(F.trim("category"))
    return F.when(c == "cae_ai_engineering", "engineering_ai").when(c != "", c)


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best distinct records of each issue and category."""
    rows = table(spark, sf_dir, "candidates").select("issue_date", _category().alias("category"), "cand_id", "score")
    return top_n(rows, ["issue_date", "category"], "score", "cand_id", 10).select(F.date_format("issue_date", "yyyy-MM-dd").alias("issue_date"), "category", "cand_id")


SQL["p6_found"] = """
WITH c AS (SELECT DISTINCT issue_date, cand_id, score, CASE lower(trim(category)) WHEN 'cae_ai_engineering' THEN 'engineering_ai' WHEN '' THEN NULL
           ELSE lower(trim(category)) END AS category FROM candidates),
r AS (SELECT *, row_number() OVER (PARTITION BY issue_date, category ORDER BY score DESC NULLS LAST, cand_id) AS rn FROM c WHERE category IS NOT NULL)
SELECT strftime(issue_date, '%Y-%m-%d') AS issue_date, category, cand_id FROM r WHERE rn <= 10
"""


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of 200 characters and more that another document holds too."""
    return shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text", 200)


SQL["p9_found"] = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200),
w AS (SELECT doc_id, unnest(range(length(text) - 199)) AS s, text FROM d),
h AS (SELECT doc_id, s, md5_number(substr(text, s + 1, 200)) AS h FROM w),
m AS (SELECT h FROM h GROUP BY h HAVING min(doc_id) <> max(doc_id)),
p AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM (SELECT DISTINCT doc_id, s FROM h SEMI JOIN m USING (h))),
g AS (SELECT doc_id, s, count(*) FILTER (gap IS NULL OR gap > 200) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM p)
SELECT doc_id, min(s) AS span_start, max(s) + 200 AS span_end FROM g GROUP BY doc_id, n
"""


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records half of whose three-word runs are common."""
    c = table(spark, sf_dir, "candidates").select("cand_id", "title", "text")
    pairs = near_duplicate_pairs(c, "cand_id", ["title", "text"], threshold=0.5, run=3)
    return pairs.select(F.col("a").alias("cand_id_a"), F.col("b").alias("cand_id_b"))


SQL["p5_found"] = """
WITH c AS (SELECT cand_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[a-z0-9]+') AS w FROM candidates WHERE cand_id IS NOT NULL),
s AS (SELECT DISTINCT cand_id, unnest(list_transform(range(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM c WHERE len(w) >= 3),
n AS (SELECT cand_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.cand_id AS cand_id_a, b.cand_id AS cand_id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.cand_id < b.cand_id GROUP BY 1, 2)
SELECT cand_id_a, cand_id_b FROM p JOIN n x ON x.cand_id = cand_id_a JOIN n y ON y.cand_id = cand_id_b WHERE k >= 0.5 * (x.n + y.n - k)
"""


def _profiles(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    return [tuple(r) for r in table(spark, sf_dir, "pack_profiles").select("profile", "capacity_tokens").orderBy("profile").collect()]  # a fixed table


@query
def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or piece of a longer one, for each profile."""
    sizes = token_sizes(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return pack(sizes, "doc_id", "n_tokens", _profiles(spark, sf_dir))


@query
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each profile are."""
    capacity = table(spark, sf_dir, "pack_profiles")
    packed = p7_packed(spark, sf_dir).groupBy("profile", "container").agg(F.sum("n_tokens").alias("n"))
    per = packed.groupBy("profile").agg(F.count("*").alias("containers"), F.sum("n").alias("n_tokens"))
    return per.join(capacity, "profile").select("profile", "capacity_tokens", "containers", "n_tokens", (F.col("n_tokens") / F.col("containers") / F.col("capacity_tokens")).alias("filled"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").join(targets.select("source"), "source", "left_semi")
    return mixture(token_sizes(docs, "text"), targets, "doc_id", "source", "n_tokens", budget="held")


@query
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture in order, with their use and offset; as large as all documents of the targets together."""
    return _mixture(spark, sf_dir)[0]


@query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source, and which sources ran out."""
    return _mixture(spark, sf_dir)[1]


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of batches 1 to 10 that repeat an accepted one."""
    rows = table(spark, sf_dir, "incoming_candidates")
    found = repeats_of_history(rows, "batch_no", "rec_id", "title", "url", "published_at")
    return found.select(F.col("accepted_rec").alias("accepted_rec_id"), F.col("repeat_rec").alias("repeat_rec_id"))


SQL["p1_found"] = r"""
WITH RECURSIVE r AS (SELECT batch_no, rec_id, title, published_at AS told, row_number() OVER (ORDER BY batch_no, rec_id) AS place, regexp_replace(trim(url), '(?s)#.*$', '') AS u FROM incoming_candidates),
s AS (SELECT *, regexp_extract(u, '(?s)^(?:[^?]*?://|//)?([^/?]*)(?:/([^?]*))?(?:\?(.*))?$', ['host', 'path', 'params']) AS x FROM r),
k AS (SELECT batch_no, rec_id, told, place, CASE WHEN u IS NULL OR (x.host = '' AND x.path = '') THEN NULL ELSE regexp_replace(lower(x.host), '^www\.', '') || '/' || regexp_replace(x.path, '/$', '') || '?' ||
        array_to_string(list_sort(list_filter(string_split(x.params, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|(fbclid|gclid|mc_cid|mc_eid|ref)(=|$))'))), '&') END AS page,
      list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS words, list_sort(list_distinct(regexp_extract_all(title, '[0-9]+'))) AS numbers FROM s),
w AS (SELECT rec_id, place, batch_no, told, numbers, len(words) AS n, unnest(words) AS word FROM k),
c AS (SELECT a.rec_id AS a, a.place AS before, b.rec_id AS b, b.place AS place, a.n AS an, b.n AS bn, count(*) AS n FROM w a JOIN w b ON a.word = b.word AND a.numbers = b.numbers
      WHERE a.place < b.place AND b.batch_no > (SELECT min(batch_no) FROM k) AND abs(epoch_us(a.told) - epoch_us(b.told)) <= 259200000000 GROUP BY ALL),
l AS (SELECT a, before, b, place FROM c WHERE 10 * n >= 7 * (an + bn - n)
      UNION SELECT a.rec_id, a.place, b.rec_id, b.place FROM k a JOIN k b ON a.page = b.page WHERE a.place < b.place AND b.batch_no > (SELECT min(batch_no) FROM k)),
q AS MATERIALIZED (SELECT b, list(a ORDER BY before) AS likes, row_number() OVER (ORDER BY any_value(place)) AS i FROM l GROUP BY b),
t AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS repeats, NULL::BIGINT AS a, NULL::BIGINT AS b
      UNION ALL SELECT q.i, CASE WHEN len(list_filter(q.likes, lambda x: NOT list_contains(t.repeats, x))) > 0 THEN list_append(t.repeats, q.b) ELSE t.repeats END,
        list_filter(q.likes, lambda x: NOT list_contains(t.repeats, x))[1], q.b FROM t JOIN q ON q.i = t.i + 1)
SELECT a AS accepted_rec_id, b AS repeat_rec_id FROM t WHERE a IS NOT NULL
"""
