"""Pages to articles: strategies in one Arrow stage, choice, merge and quality in Catalyst."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from newsloom.functions.text import distinct_in_order, distinct_paragraphs, non_empty, reading_minutes, tidy_whitespace, word_count
from newsloom.functions.url import article_url

from .strategies import StrategyRegistry, default_registry, run_page

RESULT = (
    "strategy string, success boolean, confidence double, error string, title string, subtitle string, summary string, authors array<string>, "
    "published_at timestamp, updated_at timestamp, language string, categories array<string>, tags array<string>, "
    "images array<struct<url:string,alt:string,caption:string,is_hero:boolean,width:int,height:int>>, videos array<struct<url:string,thumbnail_url:string>>, "
    "canonical_url string, meta_description string, meta_keywords array<string>, json_ld array<string>, open_graph map<string,string>, twitter_card map<string,string>, "
    "body_text string, body_html string, paragraphs array<string>"
)
#: Strategies that give a body, characters a body has at least, weights of completeness, warnings.
BODY_STRATEGIES = ("json_ld", "article_library", "readability", "dom_heuristic", "fallback")
LEAST_BODY = 100
#: Bytes and pages whose results a task holds at once: six results a page take many times its size.
SLICE, SLICE_PAGES = 1 << 20, 64
FIELDS = (
    "title", "subtitle", "summary", "authors", "published_at", "updated_at", "language", "categories", "tags", "images", "videos",
    "canonical_url", "meta_description", "meta_keywords", "json_ld", "open_graph", "twitter_card",
)
COMPLETE = {"title": 0.25, "author": 0.15, "date": 0.15, "body": 0.35}
WARNINGS = {"title": "Article has no title", "author": "Article has no identified author", "date": "Article has no published date", "body": "Article body is missing or too short (<100 chars)"}
SHORT = "Article body is unusually short (<50 words) -- possible paywall stub"
CHROME = "High boilerplate ratio -- extraction may have captured mostly chrome"


def run_strategies(pages: DataFrame, registry: StrategyRegistry | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text_length, results array<struct>): every strategy's result for every page; a page is parsed once."""
    strategies = (registry or default_registry()).build()
    kept = pages.select(F.col(id_col), F.col(url_col).alias("url"), F.col(html_col).alias("_html"))
    kind: StructType = _parse_datatype_string(RESULT)
    arrow = to_arrow_type(kind, timestamp_utc=True)

    def run(batches):
        for batch in batches:
            lo = size = 0
            for at, html in enumerate(batch.column(2)):
                size += len(html.as_buffer()) if html.is_valid else 0
                if size >= SLICE or at - lo + 1 >= SLICE_PAGES or at + 1 == batch.num_rows:
                    yield of(batch.slice(lo, at + 1 - lo))
                    lo, size = at + 1, 0

    def of(batch):
        results, sizes = [], []
        for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found, size = run_page(html, url, strategies)
            for f in found:
                for k in ("open_graph", "twitter_card"):
                    if f.get(k) is not None:
                        f[k] = list(f[k].items())
            results.append(found)
            sizes.append(size)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(results, pa.list_(arrow))],
            names=[id_col, "url", "text_length", "results"],
        )

    shape = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in kind)
    return kept.mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, url string, text_length long, results array<struct<{shape}>>")


def primary_index(results: Column) -> Column:
    """Index of the surest result with a body, else of the surest success; earlier ones win ties; null if nothing succeeded."""
    place = lambda fits: F.array_max(F.transform(results, lambda r, i: F.when(fits(r), F.struct(r["confidence"].alias("c"), (-i).alias("i")))))["i"]
    body = lambda r: r["success"] & (F.coalesce(F.length(r["body_text"]), F.lit(0)) >= LEAST_BODY) & r["strategy"].isin(*BODY_STRATEGIES)
    return -F.coalesce(place(body), place(lambda r: r["success"]))


def _first(ordered: Column, field: str, kind: str) -> Column:
    values = F.transform(ordered, lambda r: r[field])
    full = {"array": lambda v: F.size(v) > 0, "map": lambda v: F.size(F.map_keys(v)) > 0, "string": lambda v: v != ""}.get(kind.split("<")[0], lambda v: v.isNotNull())
    return F.get(F.filter(values, lambda v: v.isNotNull() & full(v)), F.lit(0))


def merge(extracted: DataFrame) -> DataFrame:
    """One article a page: the primary result, its gaps filled from the other successes in order."""
    kinds = {f.name: f.dataType.simpleString() for f in extracted.schema["results"].dataType.elementType}
    df = extracted.withColumn("_p", primary_index(F.col("results")))
    df = df.withColumn("_primary", F.get("results", F.col("_p")))
    rest = F.filter("results", lambda r, i: r["success"] & (i != F.coalesce(F.col("_p"), F.lit(-1))))
    df = df.withColumn("_ordered", F.concat(F.array_compact(F.array("_primary")), rest))
    df = df.withColumns({f: _first(F.col("_ordered"), f, kinds[f]) for f in FIELDS})
    df = df.withColumns({"body_text": F.col("_primary.body_text"), "body_html": F.col("_primary.body_html"), "paragraphs": F.col("_primary.paragraphs")})
    df = df.withColumns({"strategy_used": F.coalesce(F.col("_primary.strategy"), F.lit("none")), "confidence": F.coalesce(F.col("_primary.confidence"), F.lit(0.0)), "strategies_attempted": F.transform("results", lambda r: r["strategy"])})
    return df.drop("_p", "_primary", "_ordered", "results")


def finalize(merged: DataFrame, exact: bool = False) -> DataFrame:
    lists = {c: distinct_in_order(F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in ("authors", "categories", "tags")}
    df = merged.withColumns({c: F.nullif(tidy_whitespace(F.col(c), exact), F.lit("")) for c in ("title", "subtitle", "summary")})
    df = df.withColumns(lists).withColumn("paragraphs", non_empty(distinct_paragraphs(F.coalesce("paragraphs", F.array().cast("array<string>")))))
    df = df.withColumn("body_text", F.coalesce(F.nullif("body_text", F.lit("")), F.nullif(F.array_join("paragraphs", "\n\n"), F.lit(""))))
    df = df.withColumn("body_text", F.nullif(tidy_whitespace(F.col("body_text"), exact), F.lit("")))
    df = df.withColumn("canonical_url", article_url(F.col("canonical_url"), F.col("url")))
    df = df.withColumn("url", F.coalesce(article_url(F.col("url")), F.col("url")))
    df = df.withColumn("word_count", word_count(F.col("body_text")))
    return df.withColumn("reading_time_minutes", reading_minutes(F.col("word_count")))


def quality(df: DataFrame) -> DataFrame:
    """Adds the quality report: four missing_* flags, content_length, boilerplate_ratio, quality_score, warnings."""
    length = F.coalesce(F.length("body_text"), F.lit(0))
    ratio = F.when(F.col("text_length") > 0, F.least(F.lit(1.0), F.greatest(F.col("text_length") - length, F.lit(0)) / F.col("text_length"))).otherwise(F.lit(0.0))
    missing = {"title": F.col("title").isNull(), "author": F.size("authors") == 0, "date": F.col("published_at").isNull(), "body": length <= 100}
    df = df.withColumns({f"missing_{k}": v for k, v in missing.items()} | {"content_length": length, "boilerplate_ratio": ratio})
    held = sum((F.when(~F.col(f"missing_{k}"), F.lit(w)).otherwise(0.0) for k, w in COMPLETE.items()), F.lit(0.0)) + F.when(F.col("boilerplate_ratio") < 0.5, 0.10).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * held + 0.4 * F.col("confidence")))
    warn = [F.when(F.col(f"missing_{k}"), F.lit(v)) for k, v in WARNINGS.items()]
    warn += [F.when((F.col("word_count") > 0) & (F.col("word_count") < 50), F.lit(SHORT)), F.when(F.col("boilerplate_ratio") > 0.85, F.lit(CHROME))]
    return df.withColumn("quality_score", score).withColumn("warnings", F.array_compact(F.array(*warn)))


def extract_articles(pages: DataFrame, registry: StrategyRegistry | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", exact: bool = False) -> DataFrame:
    return quality(finalize(merge(run_strategies(pages, registry, id_col, url_col, html_col)), exact))
