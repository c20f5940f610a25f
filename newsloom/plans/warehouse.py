"""Daily roll-ups, trends, coverage, hierarchies and lifecycle checks over stored tables.

Everything aggregates before it windows, so windows run over days, groups or
sources and not over facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def day(ts: Column) -> Column:
    return F.to_date(ts)


def running(value: Column, by: list[str], order: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def daily_summary(facts: DataFrame, ts: str, kinds: dict[str, Column], cumulative: tuple[str, ...] = ()) -> DataFrame:
    """One row a day: new_<kind> counts rows where the test holds, total_<kind> runs up."""
    daily = facts.groupBy(day(F.col(ts)).alias("stat_date")).agg(*[F.count_if(test).alias(f"new_{k}") for k, test in kinds.items()])
    return daily.withColumns({f"total_{k}": running(F.col(f"new_{k}"), [], "stat_date") for k in (cumulative or kinds)})


def source_daily(log: DataFrame, source: str, ts: str, is_error: Column, is_new: Column, is_duplicate: Column, millis: Column) -> DataFrame:
    return log.groupBy(F.col(source).alias("source_id"), day(F.col(ts)).alias("stat_date")).agg(
        F.count_if(~is_error).alias("documents_fetched"),
        F.count_if(is_new).alias("documents_new"),
        F.count_if(is_duplicate).alias("documents_duplicate"),
        F.count_if(is_error).alias("fetch_errors"),
        F.avg(millis).alias("avg_response_time_ms"),
    )


def collector_daily(jobs: DataFrame, ts: str, succeeded: Column, items: Column, retries: Column, millis: Column) -> DataFrame:
    return jobs.groupBy(day(F.col(ts)).alias("stat_date")).agg(
        F.count("*").alias("total_jobs_run"),
        F.count_if(succeeded).alias("jobs_succeeded"),
        F.count_if(~succeeded).alias("jobs_failed"),
        F.sum(items).alias("total_items_fetched"),
        F.sum(retries).alias("total_retries"),
        F.avg(millis).alias("avg_job_duration_ms"),
    )


def model_daily(requests: DataFrame, model: str, ts: str, ok: Column, tokens_in: Column, tokens_out: Column, cost: Column, millis: Column, exact: bool = True) -> DataFrame:
    """With ``exact=False`` the 95th percentile is a sketch, whose state does not grow with the group."""
    p95 = F.percentile(millis, F.lit(0.95)) if exact else F.percentile_approx(millis, 0.95, 10_000).cast("double")
    return requests.groupBy(F.col(model).alias("model_id"), day(F.col(ts)).alias("stat_date")).agg(
        F.count("*").alias("requests_total"),
        F.count_if(ok).alias("requests_succeeded"),
        F.count_if(~ok).alias("requests_failed"),
        F.sum(tokens_in).alias("input_tokens"),
        F.sum(tokens_out).alias("output_tokens"),
        F.sum(cost).alias("total_cost"),
        F.avg(millis).alias("avg_latency_ms"),
        p95.alias("p95_latency_ms"),
    )


def entity_daily(mentions: DataFrame, entity: str, kind: str, ts: str) -> DataFrame:
    """Mentions of each day, entities first mentioned on it, and their running total, by type."""
    first = mentions.groupBy(F.col(entity), F.col(kind).alias("entity_type")).agg(F.min(day(F.col(ts))).alias("stat_date"))
    new = first.groupBy("entity_type", "stat_date").agg(F.count("*").alias("new_entities"))
    seen = mentions.groupBy(F.col(kind).alias("entity_type"), day(F.col(ts)).alias("stat_date")).agg(F.count("*").alias("total_mentions"))
    both = seen.join(new, ["entity_type", "stat_date"], "left").withColumn("new_entities", F.coalesce("new_entities", F.lit(0)))
    return both.withColumn("total_entities", running(F.col("new_entities"), ["entity_type"], "stat_date"))


def event_daily(events: DataFrame, links: DataFrame) -> DataFrame:
    """events (event_id, created, concluded, merged dates), links (event_id, document_id): a row for each day on which anything happened."""
    at = lambda c, n: events.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("date").alias("stat_date")).agg(F.count("*").alias(n))
    per = links.groupBy("event_id").agg(F.count("*").alias("docs"))
    docs = events.join(per, "event_id", "left").groupBy(F.col("created").cast("date").alias("stat_date")).agg(F.avg(F.coalesce("docs", F.lit(0))).cast("decimal(5,2)").alias("avg_documents_per_event"))
    out = at("created", "new_events").join(at("concluded", "events_concluded"), "stat_date", "full").join(at("merged", "events_merged"), "stat_date", "full").join(docs, "stat_date", "left")
    out = out.na.fill(0, ["new_events", "events_concluded", "events_merged"])
    return out.withColumn("total_events", running(F.col("new_events"), [], "stat_date"))


def reliability(log: DataFrame, source: str, ts: str, ok: Column) -> DataFrame:
    """Successful fetches over fetches, by source and day."""
    return log.groupBy(F.col(source).alias("source_id"), day(F.col(ts)).alias("stat_date")).agg((F.count_if(ok) / F.nullif(F.count("*"), F.lit(0))).alias("reliability"))


def top_k(df: DataFrame, by: list[str], ts: str, as_of: Column, days: int, k: int) -> DataFrame:
    """The k groups with most rows in the days before ``as_of``, ties by key."""
    recent = df.where((F.col(ts) >= as_of - F.make_dt_interval(F.lit(days))) & (F.col(ts) < as_of))
    return recent.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).limit(k)


def coverage(labels: DataFrame, node: str, doc: str, documents: DataFrame) -> DataFrame:
    """Documents of each node, in percent of all."""
    total = documents.agg(F.count("*").alias("total"))
    per = labels.groupBy(F.col(node).alias("node")).agg(F.count_distinct(doc).alias("documents"))
    return per.crossJoin(F.broadcast(total)).select("node", "documents", (F.col("documents") * 100.0 / F.nullif("total", F.lit(0))).alias("percent"))


def trend(hits: DataFrame, key: str, ts: str, lag_days: int = 7) -> DataFrame:
    """Daily counts and their change against the count ``lag_days`` rows of that key before."""
    daily = hits.groupBy(F.col(key), day(F.col(ts)).alias("stat_date")).agg(F.count("*").alias("hits"))
    before = F.lag("hits", lag_days).over(Window.partitionBy(key).orderBy("stat_date"))
    return daily.withColumn("hits_before", before).withColumn("change", F.col("hits") - F.col("hits_before"))


#: Mentions in a task that pairs them: with more input come more tasks and not larger ones.
MENTIONS_A_TASK = 250_000


def cooccurrence(mentions: DataFrame, doc: str, entity: str, confidence: Column | None = None) -> DataFrame:
    """(e1, e2, frequency[, confidence]) of entities in one document, e1 < e2. Mentions are made distinct first.

    A document's entities are one list, whose pairs are counted as they are made: nothing is joined or sorted.
    """
    sure = confidence if confidence is not None else F.lit(1.0)
    rows = mentions.select(F.col(doc).alias("d"), F.col(entity).alias("e"), sure.alias("c")).where("d is not null and e is not null")
    tasks = max(int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-mentions.count() // MENTIONS_A_TASK))
    base = rows.repartition(tasks, "d").groupBy("d", "e").agg(F.max("c").alias("c"))
    lists = base.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("e", "c"))).alias("all")).where(F.size("all") > 1)
    firsts = lists.select("all", F.posexplode("all").alias("i", "x")).where(F.col("i") + 1 < F.size("all"))
    each = firsts.select("x", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("y"))
    pairs = each.groupBy(F.col("x.e").alias("e1"), F.col("y.e").alias("e2")).agg(F.count("*").alias("frequency"), F.avg(F.least("x.c", "y.c")).alias("confidence"))
    return pairs if confidence is not None else pairs.drop("confidence")


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Latest row of each key: one aggregate, no sort."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def versions(df: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """Numbers versions and marks those whose content differs from the one before (the first does)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("version_no", F.row_number().over(w)).withColumn("changed", ~F.lag(content).over(w).eqNullSafe(F.col(content)) | (F.col("version_no") == 1))


def unprocessed(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return work.join(done, key, "left_anti")


def stale(classified: DataFrame, current_version: Column, least: float = 0.70) -> DataFrame:
    """Adds trigger: 'manual', 'new_version', 'edited', 'low_confidence' or null."""
    return classified.withColumn(
        "trigger",
        F.when(F.col("manual"), "manual").when(F.col("taxonomy_version") != current_version, "new_version").when(F.col("edited_at") > F.col("classified_at"), "edited").when(F.col("confidence") < least, "low_confidence"),
    )


def closure(edges: DataFrame, parent: str = "parent_id", child: str = "id", most: int = 32) -> DataFrame:
    """(ancestor, descendant, depth) with every node its own at depth 0, by a recursive CTE. Edges of roots have a null parent; deeper trees than ``most`` raise."""
    spark = edges.sparkSession
    found = spark.sql(
        f"""WITH RECURSIVE up(ancestor, descendant, depth) MAX RECURSION LEVEL {most} AS (
              SELECT c, c, 0 FROM {{edges}}
              UNION ALL
              SELECT e.p, u.descendant, u.depth + 1 FROM up u JOIN {{edges}} e ON u.ancestor = e.c WHERE e.p IS NOT NULL)
            SELECT DISTINCT ancestor, descendant, depth FROM up""",
        edges=edges.select(F.col(parent).alias("p"), F.col(child).alias("c")),
    )
    return found


def subtree(closed: DataFrame, root, most_depth: int | None = None) -> DataFrame:
    found = closed.where(F.col("ancestor") == F.lit(root))
    return found.where(F.col("depth") <= most_depth) if most_depth is not None else found


def valid_at(relations: DataFrame, at: Column, start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    """Relations that hold at a time; a null end is open."""
    return relations.where((F.col(start) <= at) & (F.col(end).isNull() | (at < F.col(end))))


#: Allowed moves of the three lifecycles.
TRANSITIONS = {
    "job": {"created": ("scheduled", "archived"), "scheduled": ("running", "paused", "archived"), "running": ("scheduled", "archived"), "paused": ("scheduled", "archived"), "archived": ()},
    "event": {"identified": ("active", "merged"), "active": ("concluded", "merged", "archived"), "concluded": ("active", "archived"), "merged": (), "archived": ("active",)},
    "classification": {"pending": ("classified",), "classified": ("validated", "stale"), "validated": ("stale",), "stale": ("pending",)},
}


def check_transitions(history: DataFrame, kind: str, key: str, order: list[str], state: str = "state") -> DataFrame:
    """Adds previous and valid to every row of a history; the first row of an object is valid."""
    moves = TRANSITIONS[kind]
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in moves.items() for b in bs])
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return history.withColumn("previous", before).withColumn("valid", F.col("previous").isNull() | F.array_contains(allowed, F.concat_ws(">", F.col("previous"), F.col(state))))


def inactive(events: DataFrame, key: str, ts: str, as_of: Column, days: int = 7) -> DataFrame:
    """Objects by their last sign of life: concluded if it is over ``days`` old."""
    return events.groupBy(key).agg(F.max(ts).alias("last_seen")).withColumn("concluded", F.col("last_seen") < as_of - F.make_dt_interval(F.lit(days)))


def redirect(rows: DataFrame, merges: DataFrame, key: str, most: int = 16) -> DataFrame:
    """Rows re-pointed along a merge map (old, new) to its end."""
    roots = merges.select(F.col("old"), F.col("new"))
    for _ in range(most):
        onward = roots.alias("r").join(merges.select(F.col("old").alias("o2"), F.col("new").alias("n2")), F.col("r.new") == F.col("o2"), "left")
        more = onward.where("n2 is not null").limit(1).count()
        roots = onward.select("old", F.coalesce("n2", "new").alias("new"))
        if not more:
            break
    else:
        raise ValueError("the merge map is deeper than allowed, or has a cycle")
    return rows.join(roots, rows[key] == roots.old, "left").withColumn(key, F.coalesce("new", F.col(key))).drop("old", "new")


def disambiguate(candidates: DataFrame, mention: str, entity: str, confidence: str, least: float = 0.90) -> DataFrame:
    """Best candidate of each mention, ties to the smaller id; resolved if sure enough."""
    best = candidates.groupBy(mention).agg(F.min(F.struct((-F.col(confidence)).alias("o"), F.col(entity).alias("e"))).alias("m"))
    return best.select(mention, F.col("m.e").alias(entity), (-F.col("m.o")).alias(confidence)).withColumn("resolved", F.col(confidence) >= least)


def keyword_hits(docs: DataFrame, keywords: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, group, term, hits) of a keyword table (group, term, match_type, negative).

    Match types: exact (whole words), partial, regex, stem (words that begin with the
    term).  A negative keyword that hits takes the document's other hits of its group
    away.  The table is small by nature (a configured dictionary); its terms become
    literals of one projection, so documents are not joined and not shuffled until
    their hits are.
    """
    from newsloom.functions.text import WORD_CHAR, quote_regex

    rows = keywords.select("group", "term", "match_type", "negative").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("over 10,000 keywords")
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = []
    for r in rows:
        q = quote_regex(r.term.lower())
        pattern = {"exact": f"(?<!{WORD_CHAR}){q}(?!{WORD_CHAR})", "partial": q, "regex": r.term, "stem": f"(?<!{WORD_CHAR}){q}"}[r.match_type]
        found.append(F.struct(F.lit(r.group).alias("group"), F.lit(r.term).alias("term"), F.lit(bool(r.negative)).alias("negative"), F.regexp_count(lower, F.lit(pattern)).alias("hits")))
    hits = docs.select(F.col(doc), F.explode(F.filter(F.array(*found), lambda h: h["hits"] > 0)).alias("h")).select(doc, "h.group", "h.term", "h.negative", "h.hits")
    banned = hits.where("negative").select(doc, "group").distinct()
    return hits.where("not negative").join(banned, [doc, "group"], "left_anti").drop("negative")


def _spans(between: Column, found: Column) -> Column:
    """Start and length of each hit, from the texts between the hits (one more than those) and the hits."""
    sizes = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda t, x: t + F.length(x))
    return F.transform(found, lambda x, i: F.struct((sizes(between, i + 1) + sizes(found, i)).alias("start"), F.length(x).alias("n")))


def keyword_offsets(docs: DataFrame, keywords: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, group, term, start, end) of every hit of ``keyword_hits``, in characters, ends exclusive.

    What stands between the hits and the hits themselves are taken apart by the same pattern, and their lengths added up.
    """
    from newsloom.functions.text import WORD_CHAR, quote_regex

    hits = keyword_hits(docs, keywords, doc, text)
    kinds = keywords.select("group", "term", "match_type").limit(10_001).collect()
    lower, made = F.lower(F.coalesce(F.col(text), F.lit(""))), []
    for r in kinds:
        q = quote_regex(r.term.lower())
        pattern = {"exact": f"(?<!{WORD_CHAR}){q}(?!{WORD_CHAR})", "partial": q, "regex": r.term, "stem": f"(?<!{WORD_CHAR}){q}"}[r.match_type]
        between, found = F.split(lower, pattern, -1), F.regexp_extract_all(lower, F.lit(f"({pattern})"), 1)
        made.append(F.struct(F.lit(r.group).alias("group"), F.lit(r.term).alias("term"), _spans(between, found).alias("spans")))
    each = docs.select(F.col(doc), F.explode(F.array(*made)).alias("_hit")).select(doc, "_hit.group", "_hit.term", F.explode("_hit.spans").alias("_span"))
    spans = each.select(doc, "group", "term", "_span.start", (F.col("_span.start") + F.col("_span.n")).alias("end"))
    return spans.join(hits.select(doc, "group", "term"), [doc, "group", "term"], "left_semi")


def full_text(df: DataFrame, text: str, query: str) -> DataFrame:
    """Rows that hold all words of the query, with the share they are of the row's distinct words; no stemming."""
    from newsloom.functions.text import tokens

    words = [w for w in query.lower().split() if w]
    found = df.withColumn("_t", tokens(F.lower(F.coalesce(F.col(text), F.lit("")))))
    for w in words:
        found = found.where(F.array_contains("_t", w))
    return found.withColumn("rank", F.lit(float(len(words))) / F.greatest(F.size("_t"), F.lit(1))).drop("_t")


def trigram_search(df: DataFrame, text: str, query: str, least: float = 0.3) -> DataFrame:
    from newsloom.functions.text import trigrams

    grams, asked = trigrams(F.col(text)), trigrams(F.lit(query))
    both = F.size(F.array_intersect(grams, asked))
    return df.withColumn("similarity", both / F.greatest(F.size(F.array_union(grams, asked)), F.lit(1))).where(F.col("similarity") >= least)
