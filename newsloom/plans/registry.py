"""The source registry: filters, search, sort, pages, and validation as columns.

Rows keep their dynamic part as JSON text in ``metadata``.  Criteria are folded
into one predicate when the plan is built; joins appear only for criteria that
need them, group membership as a semi-join.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.url import domain, is_source_url
from newsloom.sources.tables import active, find_one

#: Searched fields by table; the name field is the first of NAMES that is there.
SEARCHED = {
    "source": ("name", "domain", "url"),
    "source_type": ("name", "description"),
    "source_group": ("name", "description"),
    "collector_job": ("name", "title", "canonical_name", "term"),
    "fetch_log": ("url", "error_code", "error_message"),
    "raw_document": ("uri", "content_hash", "content_type"),
    "article": ("title", "summary", "content_plain", "canonical_url"),
    "event": ("title", "description"),
    "taxonomy_node": ("code", "name", "description", "path"),
    "taxonomy_version": ("name", "version"),
    "classification_evidence": ("quote",),
    "entity": ("canonical_name", "description"),
    "entity_alias": ("alias",),
    "entity_mention": ("mention_text", "context"),
    "keyword": ("term", "match_type"),
    "keyword_group": ("name", "description"),
    "keyword_hit": ("matched_text",),
}
NAMES = ("name", "title", "canonical_name", "term")
#: Fields by which a row can be looked up.
LOOKUPS = {"source": ("domain", "url"), "source_type": ("slug", "code"), "source_group": ("name",)}
DEFAULT_LIMIT, MOST_PER_PAGE = 100, 200


def _meta(key: str) -> Column:
    return F.get_json_object("metadata", f"$.{key}")


def contains(column: Column, value: str) -> Column:
    """Case-insensitive LIKE %value%; % and _ in the value stay wildcards."""
    return column.cast("string").ilike(f"%{value}%")


def text_search(df: DataFrame, value: str, fields: tuple[str, ...]) -> Column:
    tests = [contains(F.col(f), value) for f in fields if f in df.columns]
    return reduce(or_, tests) if tests else F.lit(False)


def named(df: DataFrame, value: str) -> Column:
    found = next((n for n in NAMES if n in df.columns), None)
    return contains(F.col(found), value) if found else F.lit(False)


def enabled(df: DataFrame, value: bool) -> Column:
    for c in ("is_enabled", "is_active"):
        if c in df.columns:
            return F.col(c).eqNullSafe(F.lit(bool(value)))
    return _meta("enabled") == str(bool(value)).lower() if "metadata" in df.columns else F.lit(False)


def tagged(df: DataFrame, tags: list[str]) -> Column:
    """All the tags are there."""
    if "metadata" not in df.columns:
        return F.lit(False)
    have = F.from_json(_meta("tags"), "array<string>")
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), have)) == 0, F.lit(False))


def column_or_meta(df: DataFrame, key: str, value) -> Column:
    for c in (key, f"{key}_code"):
        if c in df.columns:
            return F.col(c) == F.lit(value)
    return _meta(key) == str(value) if "metadata" in df.columns else F.lit(False)


def criteria_predicate(df: DataFrame, criteria: dict, fields: tuple[str, ...]) -> Column:
    """Conjunction of the criteria that are not None; a key that neither a column nor metadata can hold is ignored."""
    tests = []
    for key, value in criteria.items():
        if value is None:
            continue
        if key in ("q", "query", "search"):
            tests.append(text_search(df, str(value), fields))
        elif key == "name":
            tests.append(named(df, str(value)))
        elif key == "enabled":
            tests.append(enabled(df, value))
        elif key == "tags":
            tests.append(tagged(df, value if isinstance(value, list) else [value]))
        elif key in df.columns:
            tests.append(F.col(key) == F.lit(value))
        elif "metadata" in df.columns or key in ("country", "language"):
            tests.append(column_or_meta(df, key, value))
    return reduce(and_, tests) if tests else F.lit(True)


def filter_sources(sources: DataFrame, criteria: dict, types: DataFrame | None = None, memberships: DataFrame | None = None) -> DataFrame:
    special = {k: criteria.get(k) for k in ("source_type", "source_type_id", "group_id")}
    df = active(sources)
    df = df.where(criteria_predicate(df, {k: v for k, v in criteria.items() if k not in special}, SEARCHED["source"]))
    if special["source_type_id"] is not None:
        df = df.where(F.col("source_type_id") == F.lit(special["source_type_id"]))
    if (kind := special["source_type"]) is not None:
        fits = (F.col("code") == kind) | (F.col("slug") == kind) | contains(F.col("name"), kind) | (F.col("id").cast("string") == kind)
        df = df.join(types.where(fits).select(F.col("id").alias("source_type_id")), "source_type_id", "left_semi").select(*df.columns)
    if (group := special["group_id"]) is not None:
        members = memberships.where(F.col("source_group_id") == F.lit(group)).select(F.col("source_id").alias("id"))
        df = df.join(members, "id", "left_semi").select(*df.columns)
    return df


def sort_rows(df: DataFrame, sort_by: str | None = None, direction: str = "asc", default: str = "created_at", key: str = "id") -> DataFrame:
    """Nulls last going up, first coming down; an unknown field sorts by key; ties by key."""
    field = sort_by or default
    field = field if field in df.columns else key
    first = F.col(field).desc_nulls_first() if direction == "desc" else F.col(field).asc_nulls_last()
    return df.orderBy(first, F.col(key).asc())


def search(df: DataFrame, criteria: dict, fields: tuple[str, ...], limit: int = DEFAULT_LIMIT, offset: int = 0, **sort) -> DataFrame:
    df = active(df)
    return sort_rows(df.where(criteria_predicate(df, criteria, fields)), **sort).offset(offset).limit(limit)


def look_up(df: DataFrame, table: str, **equal) -> DataFrame:
    """The live row with these values of look-up fields, as a DataFrame of at most one."""
    if odd := set(equal) - {"id", *LOOKUPS[table]}:
        raise ValueError(f"{table} is not looked up by {', '.join(sorted(odd))}")
    return find_one(df, **equal)


def paginate(df: DataFrame, page: int = 1, page_size: int = 50, **sort) -> tuple[DataFrame, int]:
    """(rows of the page, rows in all). The count is taken without the order."""
    page, size = max(1, page), min(max(1, page_size), MOST_PER_PAGE)
    return sort_rows(df, **sort).offset((page - 1) * size).limit(size), df.count()


def list_sources(sources: DataFrame, types: DataFrame | None = None, memberships: DataFrame | None = None, *, page: int = 1, page_size: int = 50, sort_by: str | None = None, sort_direction: str = "asc", **criteria) -> tuple[DataFrame, int]:
    """The listing: search, name, country, language, source_type, status, priority, tags, enabled, group_id."""
    return paginate(read_view(filter_sources(sources, criteria, types, memberships)), page, page_size, sort_by=sort_by, direction=sort_direction)


#: What absent metadata reads as.
DEFAULTS = {"public_type": None, "country": None, "language": None, "enabled": "false", "priority": "5", "refresh_interval_seconds": "900"}


def read_view(sources: DataFrame) -> DataFrame:
    """Metadata flattened over its defaults."""
    of = lambda k, path=None: F.coalesce(F.get_json_object("metadata", path or f"$.{k}"), F.lit(DEFAULTS[k]).cast("string"))
    made = {
        "public_type": of("public_type"),
        "country": of("country"),
        "language": of("language"),
        "enabled": of("enabled").cast("boolean"),
        "priority": of("priority").cast("int"),
        "tags": F.coalesce(F.from_json(_meta("tags"), "array<string>"), F.array().cast("array<string>")),
        "refresh_interval_seconds": of("refresh_interval_seconds", "$.scheduling.refresh_interval_seconds").cast("int"),
    }
    return sources.withColumns({k: v for k, v in made.items() if k not in sources.columns})


def with_children(parents: DataFrame, children: DataFrame, fk: str, name: str, key: str = "id") -> DataFrame:
    """Parents with their children as an array of structs, empty if none."""
    nested = children.groupBy(F.col(fk).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*[c for c in children.columns if c != fk]))).alias(name))
    return parents.join(nested, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(dict(nested.dtypes)[name])))


def with_one(parents: DataFrame, children: DataFrame, fk: str, name: str, key: str = "id") -> DataFrame:
    """Parents with their only child as a struct, null if there is none; the first by the child's columns where there are more."""
    rest = [c for c in children.columns if c != fk]
    own = children.groupBy(F.col(fk).alias(key)).agg(F.min(F.struct(*rest)).alias(name))
    return parents.join(own, key, "left")


def group_counts(groups: DataFrame, memberships: DataFrame) -> DataFrame:
    """Members of every group; memberships count whether or not their source is deleted."""
    n = memberships.groupBy(F.col("source_group_id").alias("id")).agg(F.count("*").alias("source_count"))
    return active(groups).join(n, "id", "left").withColumn("source_count", F.coalesce("source_count", F.lit(0)))


def membership_delta(current: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(to add, to remove)."""
    return wanted.join(current, keys, "left_anti"), current.join(wanted, keys, "left_anti")


#: Capabilities by type of source; a refresh below this many seconds warns.
CAPABILITIES = {"rss": ("rss", "feed"), "website": ("html", "website"), "government": ("government", "html", "api"), "social": ("social", "x")}
FAST_REFRESH = 300


def violations(df: DataFrame) -> Column:
    """array<string> of what is wrong with a source row (url, type_code, type_slug, capabilities, metadata); empty if nothing."""
    caps = F.transform("capabilities", lambda c: F.lower(c))
    kind = F.when((F.col("type_code") == "rss") | F.contains(F.lower("type_slug"), F.lit("rss")), F.lit("rss")).otherwise(F.lower("type_code"))
    lacks = [F.when((kind == k) & (F.size(caps) > 0) & ~F.arrays_overlap(caps, F.array(*[F.lit(x) for x in need])), F.lit(f"source_type: {k} sources need one of {', '.join(need)}")) for k, need in CAPABILITIES.items()]
    feed = F.get_json_object("metadata", "$.collector.feed_url")
    interval = F.get_json_object("metadata", "$.scheduling.refresh_interval_seconds").cast("int")
    priority = _meta("priority").cast("int")
    auth, secret = F.get_json_object("metadata", "$.authentication.type"), F.get_json_object("metadata", "$.authentication.secret_ref")
    mode, query = F.get_json_object("metadata", "$.keywords.mode"), F.get_json_object("metadata", "$.keywords.boolean_query")
    tags = F.transform(F.from_json(_meta("tags"), "array<string>"), lambda t: F.lower(F.trim(t)))
    depth = F.length(F.regexp_replace(query, r"[^(]", "")) - F.length(F.regexp_replace(query, r"[^)]", ""))
    return F.array_compact(
        F.array(
            F.when(~is_source_url(F.col("url")), F.lit("url: must be an absolute http or https URL")),
            *lacks,
            F.when(feed.isNotNull() & (feed != "") & ~is_source_url(feed), F.lit("collector.feed_url: must be an absolute http or https URL")),
            F.when((interval < 60) | (interval > 604_800), F.lit("scheduling.refresh_interval_seconds: must be in 60..604800")),
            F.when((priority < 1) | (priority > 10), F.lit("priority: must be in 1..10")),
            F.when((auth != "none") & (F.coalesce(secret, F.lit("")) == ""), F.lit("authentication.secret_ref: required for authenticated sources")),
            F.when((auth == "basic") & F.get_json_object("metadata", "$.authentication.username").isNull(), F.lit("authentication.username: required for basic authentication")),
            F.when((auth == "oauth2") & F.get_json_object("metadata", "$.authentication.token_url").isNull(), F.lit("authentication.token_url: required for oauth2 authentication")),
            F.when((mode == "boolean") & (F.coalesce(query, F.lit("")) == ""), F.lit("keywords.boolean_query: required for boolean mode")),
            F.when(depth != 0, F.lit("keywords.boolean_query: unbalanced parentheses")),
            F.when(query.rlike(r"(?i)(^|\s)(AND|OR|NOT)\s*$"), F.lit("keywords.boolean_query: query cannot end with an operator")),
            F.when(F.size(tags) != F.size(F.array_distinct(tags)), F.lit("tags: must be unique")),
        )
    )


def warnings(df: DataFrame) -> Column:
    interval = F.coalesce(F.get_json_object("metadata", "$.scheduling.refresh_interval_seconds").cast("int"), F.lit(900))
    is_rss = (F.col("type_code") == "rss") | F.contains(F.lower("type_slug"), F.lit("rss"))
    return F.array_compact(F.array(F.when(is_rss & (interval < FAST_REFRESH), F.lit("RSS sources below five minutes may hit publisher rate limits."))))


def conflicts(sources: DataFrame) -> DataFrame:
    """Live rows that break a unique key: (key, value, ids)."""
    df = active(sources)
    by_url = df.groupBy(F.col("url").alias("value")).agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1).select(F.lit("url").alias("key"), "value", "ids")
    pair = F.concat_ws("|", "domain", F.col("source_type_id").cast("string"))
    by_pair = df.groupBy(pair.alias("value")).agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1).select(F.lit("domain, source_type_id").alias("key"), "value", "ids")
    return by_url.unionByName(by_pair)


def create_sources(current: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with violations): domains are normalized, rows are checked and must not meet a live row's url or (domain, type)."""
    rows = new.withColumn("domain", domain(F.col("url"), F.col("domain") if "domain" in new.columns else None))
    live = active(current)
    rows = rows.withColumn("_v", violations(rows))
    rows = rows.join(live.select("url").distinct().withColumn("_u", F.lit(True)), "url", "left").join(live.select("domain", "source_type_id").distinct().withColumn("_d", F.lit(True)), ["domain", "source_type_id"], "left")
    more = F.array_compact(F.array(F.when(F.col("_u"), F.lit("url: exists")), F.when(F.col("_d"), F.lit("domain, source_type_id: exists"))))
    rows = rows.withColumn("violations", F.concat("_v", more)).drop("_v", "_u", "_d")
    return rows.where(F.size("violations") == 0).drop("violations"), rows.where(F.size("violations") > 0)


def set_enabled(sources: DataFrame, source_id, value: bool) -> DataFrame:
    """Metadata with ``enabled`` set on one source; other rows as they are."""
    held = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    merged = F.to_json(F.map_concat(F.map_filter(held, lambda k, _: k != "enabled"), F.create_map(F.lit("enabled"), F.lit(str(value).lower()))))
    return sources.withColumn("metadata", F.when(F.col("id") == F.lit(source_id), merged).otherwise(F.col("metadata")))



def update_sources(current: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table after it, rejected changes with violations).

    A change has an id and new values; its nulls leave what is there. Metadata is merged key by key. The changed row is
    checked as a new one is and must not meet another live row's url or (domain, type); ids that are not live are rejected.
    """
    fields = [c for c in changes.columns if c != "id" and c in current.columns]
    held = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    over = lambda old, new: F.to_json(F.map_concat(F.map_filter(held(old), lambda k, _: ~F.map_contains_key(held(new), k)), held(new)))
    ask = changes.select("id", *[F.col(f).alias(f"_n_{f}") for f in fields], *[c for c in changes.columns if c not in current.columns], F.lit(True).alias("_asked"))
    both = current.join(ask, "id", "left")
    merged = both.withColumns({f: F.when(F.col(f"_n_{f}").isNotNull() & F.col("_asked"), over(F.col(f), F.col(f"_n_{f}")) if f == "metadata" else F.col(f"_n_{f}")).otherwise(F.col(f)) for f in fields})
    merged = merged.withColumn("domain", F.when(F.col("_asked"), domain(F.col("url"), F.col("domain"))).otherwise(F.col("domain")))
    live = active(merged).select(F.col("id").alias("_o"), F.col("url").alias("_u"), F.col("domain").alias("_d"), F.col("source_type_id").alias("_t"))
    asked = active(merged).where("_asked")
    clash = asked.join(live, (F.col("url") == F.col("_u")) & (F.col("id") != F.col("_o"))).select("id", F.lit("url: exists").alias("_c"))
    clash = clash.unionByName(asked.join(live, (F.col("domain") == F.col("_d")) & (F.col("source_type_id") == F.col("_t")) & (F.col("id") != F.col("_o"))).select("id", F.lit("domain, source_type_id: exists").alias("_c")))
    found = asked.select("id", F.explode(violations(asked)).alias("_c")) if {"type_code", "type_slug", "capabilities", "metadata"} <= set(asked.columns) else asked.select("id", F.lit("url: must be an absolute http or https URL").alias("_c")).where(~is_source_url(F.col("url")))
    wrong = found.unionByName(clash).unionByName(changes.join(active(current), "id", "left_anti").select("id", F.lit("id: no live source").alias("_c")))
    wrong = wrong.groupBy("id").agg(F.array_sort(F.collect_set("_c")).alias("violations"))
    changed = merged.where("_asked").join(wrong, "id", "left_anti").select(*current.columns)
    return current.join(changed.select("id"), "id", "left_anti").select(*current.columns).unionByName(changed), changes.join(wrong, "id")


def add_members(memberships: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("source_group_id", "source_id")) -> DataFrame:
    """Memberships with new ones; those that are there stay as they are."""
    fresh = new.select(*keys).distinct().join(memberships, list(keys), "left_anti")
    return memberships.unionByName(fresh, allowMissingColumns=True)


def remove_members(memberships: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("source_group_id", "source_id")) -> DataFrame:
    return memberships.join(gone.select(*keys), list(keys), "left_anti")
