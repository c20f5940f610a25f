"""Relevance: keyword groups, boolean rules, geography, source priority and recency, in one projection.

Rules become expressions on the driver, so a batch of any size is scored in a
single scan without a shuffle, and ``gate`` filters it before costly stages.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.config import RelevanceConfig
from newsloom.functions.dates import parse_iso, recency
from newsloom.functions.text import Phrases, fold_phrase, fold_text, has_phrase, with_phrases

from .rules import compile_rule

#: Fields of an article that are searched, in order; and the reasons.
SCALARS = ("title", "subtitle", "summary", "body", "body_text", "content_plain", "meta_description")
LISTS = ("categories", "tags", "meta_keywords")
META = ("title", "subtitle", "description", "keywords")
SOURCE_KEYS = ("source_id", "source_domain", "source_name", "publisher")
DATE_FIELDS = ("published_at", "publication_date", "published_date", "date_published")
REASONS = (
    "matched configured keyword groups",
    "matched configured boolean rules",
    "matched priority geography",
    "source priority contributed to score",
    "publication date is within configured window",
)
NO_REASON = "no deterministic relevance signals matched"


def _meta(df: DataFrame, key: str) -> list[Column]:
    return [F.nullif(F.col("metadata")[key].cast("string"), F.lit(""))] if "metadata" in df.columns else []


def article_text(df: DataFrame, exact: bool = False) -> Column:
    """All searched fields that are there, one a line, folded."""
    filled = [F.nullif(F.col(c), F.lit("")) for c in SCALARS if c in df.columns]
    lists = [F.array_join(F.filter(F.col(c), lambda x: x != ""), "\n") for c in LISTS if c in df.columns]
    parts = filled + [F.nullif(x, F.lit("")) for x in lists] + [c for k in META for c in _meta(df, k)]
    return fold_text(F.concat_ws("\n", *parts), exact)


def article_source(df: DataFrame, exact: bool = False) -> Column:
    """Metadata first, then a plain ``source``, then the fields; null if blank."""
    picks = [c for k in SOURCE_KEYS for c in _meta(df, k)]
    picks += [F.nullif(F.col(c), F.lit("")) for c in ("source", *SOURCE_KEYS) if c in df.columns and dict(df.dtypes)[c] == "string"]
    return F.nullif(fold_text(F.coalesce(*picks), exact), F.lit("")) if picks else F.lit(None).cast("string")


def article_date(df: DataFrame) -> Column:
    picks = []
    for c in DATE_FIELDS:
        if c in df.columns:
            picks.append(parse_iso(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).cast("timestamp"))
    picks += [parse_iso(c) for k in DATE_FIELDS for c in _meta(df, k)]
    return F.coalesce(*picks) if picks else F.lit(None).cast("timestamp")


def keyword_matches(text: Column | Phrases, config: RelevanceConfig) -> Column:
    """array<struct<group, keyword, weight>> in the order of the settings; a needle once a group, in its first spelling."""
    found, seen = [], set()
    for group in config.keyword_groups:
        for keyword in group.keywords:
            key = (group.name, fold_phrase(keyword))
            if not key[1] or key in seen:
                continue
            seen.add(key)
            made = F.struct(F.lit(group.name).alias("group"), F.lit(keyword).alias("keyword"), F.lit(float(group.weight)).alias("weight"))
            found.append(F.when(has_phrase(text, keyword), made))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<group:string,keyword:string,weight:double>>")


def rule_matches(text: Column | Phrases, config: RelevanceConfig) -> Column:
    """array<struct<name, weight>>."""
    made = [F.when(compile_rule(r.expression, text), F.struct(F.lit(r.name).alias("name"), F.lit(float(r.weight)).alias("weight"))) for r in config.boolean_rules]
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<struct<name:string,weight:double>>")


def geography_matches(text: Column | Phrases, config: RelevanceConfig) -> Column:
    """array<struct<name, weight>>: any alias."""
    made = [
        F.when(reduce(or_, [has_phrase(text, a) for a in r.aliases], F.lit(False)), F.struct(F.lit(r.name).alias("name"), F.lit(float(r.weight)).alias("weight")))
        for r in config.geography_rules
    ]
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<struct<name:string,weight:double>>")


def weight_sum(matches: Column) -> Column:
    return F.aggregate(matches, F.lit(0.0), lambda s, m: s + m["weight"])


def group_weight_sum(matches: Column, config: RelevanceConfig) -> Column:
    """Sum over matched groups of their greatest weight, 0 at least."""
    best = lambda name: F.aggregate(F.filter(matches, lambda m: m["group"] == name), F.lit(0.0), lambda s, m: F.greatest(s, m["weight"]))
    return reduce(add, [best(n) for n in dict.fromkeys(g.name for g in config.keyword_groups)], F.lit(0.0))


def source_score(source: Column, config: RelevanceConfig) -> Column:
    if not config.source_priorities:
        return F.lit(0.0)
    known = F.create_map(*[F.lit(x) for k, v in config.source_priorities.items() for x in (k, min(1.0, max(0.0, float(v))))])
    return F.when(source.isNotNull(), F.coalesce(F.try_element_at(known, source), F.lit(0.0))).otherwise(F.lit(0.0))


def weighted(parts: list[Column], weights: tuple[float, ...]) -> Column:
    total = sum(weights)
    if total <= 0:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), reduce(add, [F.lit(float(w)) * p for w, p in zip(weights, parts)]) / total))


def score(df: DataFrame, config: RelevanceConfig, as_of: Column, exact: bool = False) -> DataFrame:
    """Adds decision, score, matched_keywords, matched_rules, matched_geographies, matched_entities (empty) and reasons."""
    df = df.select("*", article_text(df, exact).alias("_text"), article_source(df, exact).alias("_source"), article_date(df).alias("_date"))
    df, text = with_phrases(df, "_text", *[lambda t, f=f: f(t, config) for f in (keyword_matches, rule_matches, geography_matches)])
    df = df.select("*", keyword_matches(text, config).alias("_kw"), rule_matches(text, config).alias("_rules"), geography_matches(text, config).alias("_geo"))
    parts = [
        F.least(F.lit(1.0), group_weight_sum(F.col("_kw"), config) / 3.0),
        F.least(F.lit(1.0), weight_sum(F.col("_rules"))),
        F.least(F.lit(1.0), weight_sum(F.col("_geo")) / 2.0),
        source_score(F.col("_source"), config),
        recency(F.col("_date"), as_of, config.publication_window_days, config.allow_historic_without_date),
    ]
    df = df.select("*", parts[3].alias("_prio"), parts[4].alias("_new"))
    total = weighted([*parts[:3], F.col("_prio"), F.col("_new")], config.weights)
    held = [F.size("_kw") > 0, F.size("_rules") > 0, F.size("_geo") > 0, F.col("_prio") > 0, F.col("_new") > 0]
    why = F.array_compact(F.array(*[F.when(h, F.lit(r)) for h, r in zip(held, REASONS)]))
    names = lambda c, f: F.transform(c, lambda m: m[f])
    return (
        df.withColumn("score", total)
        .withColumn("decision", F.when(F.col("score") >= config.threshold, F.lit("relevant")).otherwise(F.lit("irrelevant")))
        .withColumn("matched_keywords", names("_kw", "keyword"))
        .withColumn("matched_rules", names("_rules", "name"))
        .withColumn("matched_geographies", names("_geo", "name"))
        .withColumn("matched_entities", F.array().cast("array<string>"))
        .withColumn("reasons", F.when(F.size(why) > 0, why).otherwise(F.array(F.lit(NO_REASON))))
        .drop("_text", "_source", "_date", "_kw", "_rules", "_geo", "_prio", "_new", *[c for c in df.columns if c.startswith("_phrase_")])
    )


def gate(scored: DataFrame) -> DataFrame:
    """Only relevant articles go on to a model."""
    return scored.where("decision = 'relevant'")
