"""The source registry: loading and normal form."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.rules import mapped
from quillspan.functions.urls import part

SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name", "url", "source_type", "category", "priority")]
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("notes", T.StringType()), T.StructField("enabled", T.BooleanType())]
    + [T.StructField("fetch_type", T.StringType()), T.StructField("query", T.StringType()), T.StructField("max_entries", T.IntegerType())]
)
#: Source types that are only searched for, and the priorities of an older registry's reach.
SEARCHED = ("manual", "newsletter", "linkedin_manual", "x_api", "github", "arxiv")
REACH = {
    "tier_1_global": "high",
    "tier_2_tech": "high",
    "company_blog": "medium",
    "research_lab": "medium",
    "community": "low",
    "cae_industry": "medium",
    "linkedin_public": "low",
    "curated_newsletter": "medium",
}
KEPT_CATEGORIES = ("research", "startup", "vendor", "community")


def canonical_category(c: Column) -> Column:
    """Aliases of engineering made one; research, startup, vendor and community kept; all else general."""
    return F.when(c.isin("cae_ai_engineering", "engineering_ai"), "engineering_ai").when(c.isin(*KEPT_CATEGORIES), c).otherwise("general_ai")


def fetch_kind(fetch_type: Column, source_type: Column) -> Column:
    """How a source is read: as named, else by its type."""
    return (
        F.when(F.coalesce(fetch_type, F.lit("")) != "", fetch_type)
        .when(source_type == "rss", "rss")
        .when(source_type == "website", "sitemap_or_search")
        .when(source_type.isin(*SEARCHED), "web_search_query")
        .otherwise(F.coalesce(F.when(source_type != "", source_type), F.lit("web_search_query")))
    )


def normalised(rows: DataFrame) -> DataFrame:
    """Enabled sources with kind and defaults: medium priority, no tags, 25 entries, a site query where searched."""
    kind = fetch_kind(F.col("fetch_type"), F.col("source_type"))
    site = F.concat(F.lit("site:"), part(F.col("url"), 2), F.lit(" AI"))
    return rows.where("enabled").withColumn("kind", kind).withColumns({
        "category": canonical_category(F.col("category")),
        "priority": F.coalesce("priority", F.lit("medium")),
        "tags": F.coalesce("tags", F.array().cast("array<string>")),
        "query": F.when(F.coalesce("query", F.lit("")) != "", F.col("query")).when(F.col("kind").isin("sitemap_or_search", "web_search_query"), site),
        "max_entries": F.coalesce("max_entries", F.lit(25)),
    })


def load(spark: SparkSession, path: str) -> DataFrame:
    """A registry file with a list `sources`, YAML or JSON, in file order as src_ord; read on the driver, as it is configuration."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            listed = yaml.safe_load(f)["sources"]
        else:
            listed = json.load(f)["sources"]
    rows = [tuple(s.get(f.name, True if f.name == "enabled" else None) for f in SCHEMA) + (i,) for i, s in enumerate(listed)]
    return spark.createDataFrame(rows, T.StructType([*SCHEMA, T.StructField("src_ord", T.IntegerType())]))


def settings(path: str, defaults: dict) -> dict:
    """Windows, weights, keywords and the like of a YAML or JSON file over defaults, sections merged; read on the driver. No file gives the defaults."""
    if not os.path.exists(path):
        return dict(defaults)
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            own = yaml.safe_load(f) or {}
        else:
            own = json.load(f)
    return {k: {**defaults[k], **own[k]} if isinstance(defaults.get(k), dict) and isinstance(own.get(k), dict) else own.get(k, defaults.get(k)) for k in {**defaults, **own}}


def load_any(spark: SparkSession, path: str, older: str) -> DataFrame:
    """The normalised registry of path, or where that file is missing, of the older one."""
    if os.path.exists(path):
        return normalised(load(spark, path))
    with open(older, encoding="utf-8") as f:
        listed = json.load(f)
    listed = listed["sources"] if isinstance(listed, dict) else listed
    rows = [tuple(s.get(k) for k in ("name", "url", "kind", "reach", "category")) + (i,) for i, s in enumerate(listed)]
    old = spark.createDataFrame(rows, "name string, url string, kind string, reach string, category string, src_ord int")
    return normalised(from_legacy(old).join(old.select("name", "src_ord"), "name"))


def from_legacy(rows: DataFrame) -> DataFrame:
    """Rows of the older form (name, url, kind, reach, category) in the present one: all enabled, without tags."""
    return rows.select(
        "name", "url", F.coalesce("kind", F.lit("manual")).alias("source_type"),
        F.when(F.col("category") == "cae_ai_engineering", "engineering_ai").otherwise(F.coalesce("category", F.lit("general_ai"))).alias("category"),
        mapped(F.col("reach"), REACH, "medium").alias("priority"), F.array().cast("array<string>").alias("tags"), F.lit("Taken over from the older registry").alias("notes"), F.lit(True).alias("enabled"),
        F.coalesce("kind", F.lit("web_search_query")).alias("fetch_type"), F.lit(None).cast("string").alias("query"), F.lit(None).cast("int").alias("max_entries"),
    )
