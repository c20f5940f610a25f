"""Duplicate detection over an ordered batch of articles.

The batch form of the incremental question "is this article a copy of one we
have": candidates of an article are the rows with a smaller ``seq``.

1. Exact: three keys (URL, GUID, content hash).  Only the first row of a key that
   the lookback reaches can win: each article meets one row that holds it, found by
   its key and the beginning of its reach, and hot keys are broadcast.
2. Near: bounds of a pair's score from sizes, times, token sets and characters
   leave out what cannot reach the lowest threshold (``nearest``); what is left is
   scored in the order of its bounds until no bound exceeds the best score.  No
   table of pairs is made.
3. The first exact match in order wins, else the best score, ties to the earliest.

``cap`` sets a limit on candidates (the first N of the lookback
window, before any matching); without it all candidates count, which is the form
for scale.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.config import DedupConfig
from newsloom.functions.dates import lookback, proximity
from newsloom.functions.similarity import SEQUENCE_SHARE, TOKEN_SHARE, Similarity, sequence_ratio, sequence_ratio_from
from newsloom.functions.text import fold_content, fold_title, fold_unicode, jaccard, sha, tokens
from newsloom.functions.url import identity_url
from newsloom.operators.components import connected, join_hot, union_all
from newsloom.sources.tables import settle

from .nearest import Shares, best_matches, identities
from .setjoin import classes_and_links

#: Shares of a score.
SHARES = {"title": 0.12, "content": 0.58, "time": 0.12, "source": 0.08, "fingerprint": 0.10}
OTHER_SOURCE, TITLE_FINGERPRINT = 0.65, 0.45
SOURCE_KEYS = ("source_id", "source_domain", "source_name", "publisher")
GUID_KEYS = ("guid", "id", "external_id", "entry_id")
#: Fixed value: the reason of a new document.
NEW = "no duplicate candidate exceeded configured thresholds"


#: Exact strategies in order, the key each compares, its confidence and its reason.
EXACT = (
    ("canonical_url", "k_url", 1.0, "canonical URL matched an existing document"),
    ("guid", "k_guid", 0.99, "GUID matched an existing document"),
    ("content_fingerprint", "fp_content", 0.98, "content fingerprint matched exactly"),
)


#: What exact matches are made from.
KEYS = ("seq", "published_at", "k_source", "k_url", "k_guid", "fp_content")


def _column(df: DataFrame, name: str) -> list[Column]:
    return [F.nullif(F.col(name).cast("string"), F.lit(""))] if name in df.columns else []


def _meta(df: DataFrame, keys: tuple[str, ...]) -> list[Column]:
    return [F.nullif(F.col("metadata")[k].cast("string"), F.lit("")) for k in keys] if "metadata" in df.columns else []


def _first(parts: list[Column]) -> Column:
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def guid_of(df: DataFrame, exact: bool = False) -> Column:
    """Metadata, then fields, then JSON-LD (@id, identifier, mainEntityOfPage of a ``json_ld`` array of JSON strings)."""
    parts = _meta(df, GUID_KEYS) + [c for k in ("guid", "external_id") for c in _column(df, k)]
    if "json_ld" in df.columns:
        of = lambda b, k: F.nullif(F.coalesce(F.get_json_object(b, f"$.{k}.@id"), F.get_json_object(b, f"$.{k}.url"), F.get_json_object(b, f"$['{k}']")), F.lit(""))
        found = F.flatten(F.transform("json_ld", lambda b: F.array(*[of(b, k) for k in ("@id", "identifier", "mainEntityOfPage")])))
        parts.append(F.get(F.array_compact(found), F.lit(0)))
    return F.nullif(fold_unicode(_first(parts), exact=exact), F.lit(""))


def source_of(df: DataFrame, exact: bool = False) -> Column:
    """Fields first, then metadata, folded as a title."""
    return F.nullif(fold_title(_first([c for k in SOURCE_KEYS[:3] for c in _column(df, k)] + _meta(df, SOURCE_KEYS)), exact), F.lit(""))


def fingerprints(df: DataFrame, exact: bool = False) -> DataFrame:
    """Adds identity columns: k_url, k_guid, k_source, t_title, t_content, and fp_url, fp_title, fp_content, fp_combined."""
    urls = [c for k in ("canonical_url", "url") for c in _column(df, k)]
    body = _first([c for k in ("body_text", "content_plain") for c in _column(df, k)])
    title = F.col("title") if "title" in df.columns else F.lit(None).cast("string")
    df = df.select(
        "*",
        identity_url(_first(urls), exact).alias("k_url"),
        guid_of(df, exact).alias("k_guid"),
        source_of(df, exact).alias("k_source"),
        fold_title(title, exact).alias("t_title"),
        fold_content(body, F.col("paragraphs") if "paragraphs" in df.columns else None, exact).alias("t_content"),
    )
    filled = [F.nullif(F.col(c), F.lit("")) for c in ("k_url", "t_title", "t_content")]
    return df.select("*", sha(F.col("k_url")).alias("fp_url"), sha(F.col("t_title")).alias("fp_title"), sha(F.col("t_content")).alias("fp_content"), sha(F.concat_ws("\n", *filled)).alias("fp_combined"))


def status(confidence: Column, content: Column, title: Column, same_source: Column, c: DedupConfig) -> Column:
    near = (confidence >= c.near_duplicate_threshold) | ((content >= c.content_similarity_threshold) & (title >= c.title_similarity_threshold))
    exact = (confidence >= c.exact_duplicate_threshold) & (content >= 0.97) & (title >= 0.95) & same_source
    return F.when(exact, "exact_duplicate").when(near, "near_duplicate").when(confidence >= c.possible_duplicate_threshold, "possible_duplicate").otherwise("new_document")


def confidence(title: Column, content: Column, time: Column, same_source: Column, fingerprint: Column, c: DedupConfig) -> Column:
    parts = {"title": title, "content": content, "time": time, "source": F.when(same_source, 1.0).otherwise(OTHER_SOURCE), "fingerprint": fingerprint}
    total = reduce(lambda a, b: a + b, [F.lit(SHARES[k]) * v for k, v in parts.items()])
    total = total + F.when(same_source, F.lit(float(c.same_source_bonus))).otherwise(F.lit(-float(c.different_source_penalty)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


#: Reasons of a score.
REASON_TITLE = "normalized title similarity exceeded threshold"
REASON_CONTENT = "cleaned content similarity exceeded threshold"
REASON_TIME = "publication times were within configured proximity window"
REASON_SOURCE = "match came from a different source"
REASON_NONE = "weak similarity across duplicate signals"


def reasons(title: Column, content: Column, time: Column, same_source: Column, c: DedupConfig) -> Column:
    found = F.array_compact(
        F.array(
            F.when(title >= c.title_similarity_threshold, F.lit(REASON_TITLE)),
            F.when(content >= c.content_similarity_threshold, F.lit(REASON_CONTENT)),
            F.when(time > 0, F.lit(REASON_TIME)),
            F.when(~same_source, F.lit(REASON_SOURCE)),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(REASON_NONE)))


def least_jaccard(c: DedupConfig, same_source: bool, near: bool = True) -> float:
    """No pair below it can be other than new: all other terms at their most, the sequence ratio at 1. The pair differs in content, so its fingerprint term is the title's at most. Pairs that are not ``near`` in time have no time term."""
    rest = SHARES["title"] + (SHARES["time"] if near else 0.0) + SHARES["source"] * (1 if same_source else OTHER_SOURCE) + SHARES["fingerprint"] * TITLE_FINGERPRINT
    rest += c.same_source_bonus if same_source else -c.different_source_penalty
    by_score = (c.possible_duplicate_threshold - rest) / SHARES["content"]
    content = min(by_score, c.content_similarity_threshold)
    return max(0.0, (content - SEQUENCE_SHARE) / TOKEN_SHARE - 1e-9)


def _in_lookback(a: Column, b: Column, c: DedupConfig) -> Column:
    """Candidate date b against article date a; a missing date lets the pair pass."""
    return F.coalesce(b >= lookback(a, c.candidate_lookback_days), F.lit(True))


#: Parts of a time stamp from coarse to fine; the last level is the time stamp.
_PARTS = ("year", "month", "day", "hour", "minute")


def capped_candidates(rows: DataFrame, c: DedupConfig, cap: int) -> DataFrame:
    """(seq, cand, n): the first ``cap`` earlier rows, by seq, that each row's lookback reaches.

    A reach begins at a point of time and has no end.  It is cut at the parts of that point: the later years, the later
    months of its year, and so on to its own minute, whose time stamps from that point on it holds.  Each such run has one
    list of its first ``cap`` rows, so that a row meets one list, found by the point where its reach begins, and never
    another row.  Undated rows are in all lists, and an undated row's reach begins before all years.
    """
    epoch = F.to_timestamp(F.lit("0001-01-01 00:00:00"))
    firsts = lambda lists: F.slice(F.array_sort(F.flatten(lists)), 1, cap)
    of = lambda t: [getattr(F, p)(t).alias(p) for p in _PARTS]
    floor = F.coalesce(lookback(F.col("published_at"), c.candidate_lookback_days).cast("timestamp"), epoch)
    asking = rows.select("seq", floor.alias("at"))
    place = F.row_number().over(Window.partitionBy("at").orderBy("seq"))
    heads = rows.select("seq", F.col("published_at").cast("timestamp").alias("at")).withColumn("p", place).where(F.col("p") <= cap).groupBy("at").agg(F.array_sort(F.collect_list("seq")).alias("list"))
    # in every list: a value for the plan, of ``cap`` numbers at most
    undated = [r.seq for r in rows.where("published_at is null").orderBy("seq").select("seq").limit(cap).collect()]
    none = F.slice(F.array(F.lit(None).cast(rows.schema["seq"].dataType)), 1, 0)
    points = heads.where("at is not null").unionByName(asking.select("at", none.alias("list")))
    level = points.groupBy("at").agg(firsts(F.collect_list("list")).alias("list")).select("at", *of(F.col("at")), "list")
    keys, reach = ["at"], None
    for k in range(len(_PARTS), -1, -1):
        above = list(_PARTS[:k])
        after = Window.partitionBy(*above).orderBy(F.desc("at" if k == len(_PARTS) else _PARTS[k])).rowsBetween(Window.unboundedPreceding, 0 if k == len(_PARTS) else -1)
        here = level.withColumn("later", firsts(F.collect_list("list").over(after)))
        own = here.select(*([*_PARTS, "at"] if k == len(_PARTS) else _PARTS[: k + 1]), F.col("later").alias(f"later{k}"))
        reach = own if reach is None else reach.join(own, list(_PARTS[: k + 1]))
        level = level.groupBy(*above).agg(firsts(F.collect_list("list")).alias("list")) if above else None
    lists = reach.select("at", firsts(F.array(*[F.col(f"later{k}") for k in range(len(_PARTS) + 1)], F.concat(none, F.array(*map(F.lit, undated))))).alias("list"))
    found = asking.join(lists, "at").select("seq", F.posexplode(F.filter("list", lambda x: x < F.col("seq"))).alias("p", "cand"))
    return found.select("seq", "cand", (F.col("p") + 1).alias("n"))


def _capped(df: DataFrame, c: DedupConfig, cap: int | None) -> DataFrame | None:
    return None if cap is None else capped_candidates(df, c, cap).select("seq", "cand")


def jaccard_classes(bags: DataFrame, key: str, tokens_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Classes of equal token sets and the links between them: (k, rep) of every row with tokens, and (a, b, jaccard), a > b, of representatives at ``least`` or more.

    The representative is the least key of its class.  Sets meet through their rarest tokens and are verified where they
    meet (``setjoin``).  Copies of a set cost one row each.
    """
    rows = bags.select(F.col(key).alias("k"), F.col(tokens_col).alias("t"))
    digest = F.unhex(F.sha2(F.array_join(F.sort_array("t"), " "), 256))
    return classes_and_links(rows.select("k", digest.alias("h"), F.transform("t", lambda x: F.xxhash64(x)).alias("toks")), least)


#: Stands for the day of undated rows, which every reach holds, and for the beginning of an undated article's reach.
_LAST_DAY, _FIRST_MOMENT = "9999-12-31", "0001-01-01 00:00:00"


def _first_in_reach(rows: DataFrame, c: DedupConfig, total: int) -> DataFrame:
    """(seq, k_source, m): for rows with a key, m is the first row (cand, cs) of the key, in order, that the row's lookback reaches and that is before it.

    The least ``seq`` of a reach is enough: if that row is not before the article, none is.  A reach is all later days, for
    which each (key, day) has a running least, and the time stamps from its beginning on of its first day, for which each
    (key, time stamp) has one.  Rows meet these tables by the beginning of their reach, and never each other.
    """
    moment = F.to_timestamp(F.lit(_FIRST_MOMENT))
    at = F.col("published_at").cast("timestamp")
    asked = rows.withColumn("floor", F.coalesce(lookback(F.col("published_at"), c.candidate_lookback_days).cast("timestamp"), moment))
    head = F.min(F.struct(F.col("seq").alias("cand"), F.col("k_source").alias("cs"))).alias("m")
    stamps = rows.groupBy("key", at.alias("t")).agg(head)
    asks = asked.groupBy("key", "floor").agg(F.count("*").alias("n"))
    no = F.lit(None).cast(stamps.schema["m"].dataType).alias("m")
    day = F.coalesce(F.to_date("t"), F.to_date(F.lit(_LAST_DAY)))
    days = stamps.select("key", day.alias("day"), "m").unionByName(asks.select("key", F.to_date("floor").alias("day"), no)).groupBy("key", "day").agg(F.min("m").alias("m"))
    later = Window.partitionBy("key").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("key", "day", F.min("m").over(later).alias("after"))
    points = stamps.where("t is not null").unionByName(asks.select("key", F.col("floor").alias("t"), no)).groupBy("key", "t").agg(F.min("m").alias("m"))
    here = Window.partitionBy("key", F.to_date("t")).orderBy(F.desc("t"))
    points = points.select("key", F.col("t").alias("floor"), F.min("m").over(here).alias("same_day"))
    reach = asks.withColumn("day", F.to_date("floor")).join(days, ["key", "day"]).join(points, ["key", "floor"])
    reach = reach.select("key", "floor", "n", F.least("after", "same_day").alias("m"))
    return join_hot(asked, reach, ["key", "floor"], "n", total).where(F.col("m.cand") < F.col("seq")).select("seq", "k_source", "m")


def exact_matches(marked: DataFrame, c: DedupConfig, allowed: DataFrame | None = None) -> DataFrame:
    """(seq, cand, status, confidence, strategy, reason): each article's first exact match in order."""
    found = []
    # the keys only: texts are folded and hashed once, and do not move
    keys = settle(marked.select(*KEYS))
    total = keys.count()
    for rank, (name, key, sure, why) in enumerate(EXACT):
        rows = keys.where(F.col(key).isNotNull()).select("seq", "published_at", "k_source", F.col(key).alias("key"))
        if allowed is not None:
            right = rows.select(F.col("seq").alias("cand"), F.col("key").alias("ckey"), F.col("k_source").alias("cs"))
            pairs = allowed.join(rows, "seq").join(right, "cand").where("key = ckey")
            first = pairs.groupBy("seq").agg(F.min(F.struct("cand", "cs")).alias("m"), F.first("k_source").alias("k_source"))
        else:
            first = _first_in_reach(rows, c, total)
        same = F.coalesce(F.col("k_source") == F.col("m.cs"), F.lit(False))
        across = (F.lit(name) == "content_fingerprint") & ~same
        found.append(
            first.select(
                "seq",
                F.col("m.cand").alias("cand"),
                F.lit(rank).alias("rank"),
                F.when(across, "near_duplicate").otherwise("exact_duplicate").alias("status"),
                F.when(across, 0.94).otherwise(sure).alias("confidence"),
                F.lit(name).alias("strategy"),
                F.when(across, F.lit(why + " across different sources")).otherwise(F.lit(why)).alias("reason"),
            )
        )
    best = union_all(found).groupBy("seq").agg(F.min(F.struct("cand", "rank", "status", "confidence", "strategy", "reason")).alias("m"))
    return best.select("seq", "m.cand", "m.status", "m.confidence", "m.strategy", F.array("m.reason").alias("reasons"))


def _identities(marked: DataFrame) -> DataFrame:
    """What ``nearest`` searches, with the keys of exact matches: texts are folded and hashed once, and do not move."""
    at = F.unix_micros(F.col("published_at").cast("timestamp"))
    hashed = lambda name: F.when(F.col(name).isNotNull(), F.xxhash64(name))
    toks = F.transform(tokens(F.col("t_content")), lambda x: F.xxhash64(x))
    rows = marked.withColumns({"seq": F.col("seq").cast("long"), "at": at, "source": hashed("k_source"), "title_hash": hashed("fp_title"), "combined": hashed("fp_combined"), "toks": toks})
    return identities(rows, *KEYS[1:])


def nearest_matches(places: DataFrame, asking: Callable[[DataFrame], DataFrame], c: DedupConfig) -> DataFrame:
    """Best scored candidate, of all earlier rows that the lookback reaches, of each row that ``asking`` lets through and that is more than new (``nearest``)."""
    best = best_matches(places, asking, c, Shares(**SHARES, other_source=OTHER_SOURCE, title_fingerprint=TITLE_FINGERPRINT))
    args = (F.col("title"), F.col("content"), F.col("time"), F.col("same"))
    best = best.withColumn("confidence", confidence(*args, F.col("fingerprint"), c))
    return best.select("seq", "cand", status(F.col("confidence"), F.col("content"), F.col("title"), F.col("same"), c).alias("status"), "confidence", F.lit("similarity_scoring").alias("strategy"), reasons(*args, c).alias("reasons"))


def similarity_matches(marked: DataFrame, pairs: DataFrame, c: DedupConfig, similarity: Similarity | None = None) -> DataFrame:
    """Best scored candidate of each article that is more than new. The default algorithms are pruned by their bounds; given ones are run on every pair."""
    side = ["seq", "published_at", "k_source", "t_title", "t_content", "fp_title", "fp_combined"]
    a = marked.select(*[F.col(x) for x in side])
    b = marked.select(*[F.col(x).alias(x if x == "seq" else f"c_{x}") for x in side]).withColumnRenamed("seq", "cand")
    both = pairs.join(a, "seq").join(b, "cand").withColumn("same", F.coalesce(F.col("k_source") == F.col("c_k_source"), F.lit(False)))
    both = both.withColumn("time", proximity(F.col("published_at"), F.col("c_published_at"), c.publication_window_hours))
    both = both.withColumn("fingerprint", F.when(F.col("fp_combined") == F.col("c_fp_combined"), 1.0).when(F.col("fp_title") == F.col("c_fp_title"), TITLE_FINGERPRINT).otherwise(0.0))
    if similarity is None:
        both = _pruned_scores(both, c)
    else:
        both = both.withColumn("title", similarity.titles(F.col("t_title"), F.col("c_t_title"))).withColumn("content", similarity.contents(F.col("t_content"), F.col("c_t_content")))
    args = (F.col("title"), F.col("content"), F.col("time"), F.col("same"))
    both = both.withColumn("confidence", confidence(*args, F.col("fingerprint"), c)).withColumn("status", status(F.col("confidence"), F.col("content"), F.col("title"), F.col("same"), c))
    both = both.where("status <> 'new_document'")
    row = F.struct((-F.col("confidence")).alias("o"), "cand", "status", "confidence", reasons(*args, c).alias("reasons"))
    best = both.groupBy("seq").agg(F.min(row).alias("m"))
    return best.select("seq", "m.cand", "m.status", "m.confidence", F.lit("similarity_scoring").alias("strategy"), "m.reasons")


def _pruned_scores(both: DataFrame, c: DedupConfig) -> DataFrame:
    """Adds title and content, and drops pairs that cannot reach a threshold. Titles are short and go first; with them known, a pair stays only if its content can still reach one."""
    both = both.withColumn("j", jaccard(tokens(F.col("t_content")), tokens(F.col("c_t_content"))))
    both = both.where(F.col("j") >= F.when(F.col("same"), F.lit(least_jaccard(c, True))).otherwise(F.lit(least_jaccard(c, False))))
    both = both.withColumn("title", sequence_ratio(F.col("t_title"), F.col("c_t_title")))
    by_pair = F.when(F.col("title") >= c.title_similarity_threshold, F.lit(float(c.content_similarity_threshold))).otherwise(F.lit(2.0))
    start = SHARES["title"] * F.col("title") + SHARES["time"] * F.col("time") + F.when(F.col("same"), SHARES["source"] + c.same_source_bonus).otherwise(SHARES["source"] * OTHER_SOURCE - c.different_source_penalty) + SHARES["fingerprint"] * F.col("fingerprint")
    needed = F.least(by_pair, (c.possible_duplicate_threshold - start) / SHARES["content"])
    least = (needed - TOKEN_SHARE * F.col("j")) / SEQUENCE_SHARE - 1e-9
    la, lb = F.length("t_content"), F.length("c_t_content")
    both = both.withColumn("least", least).where(F.col("least") <= 2.0 * F.least(la, lb) / (la + lb))
    both = both.withColumn("s", sequence_ratio_from(F.col("t_content"), F.col("c_t_content"), F.col("least"))).where("s >= 0")
    return both.withColumn("content", TOKEN_SHARE * F.col("j") + SEQUENCE_SHARE * F.col("s"))


#: Gives (seq, cand) pairs to compare for an ordered batch.
CandidateSource = Callable[[DataFrame, DedupConfig], DataFrame]


def analyze(
    articles: DataFrame,
    config: DedupConfig | None = None,
    cap: int | None = None,
    exact_text: bool = False,
    id_col: str = "document_id",
    similarity: Similarity | None = None,
    candidates: CandidateSource | None = None,
    asking: Column | None = None,
) -> DataFrame:
    """(id, seq, status, matched id, confidence, strategy, reasons) for every article of an ordered batch (``seq`` unique).

    ``similarity`` replaces the algorithms, ``candidates`` where pairs come from (it sees the rows with their identity
    columns). Other algorithms have no bound that prunes, so they need ``candidates`` or ``cap``. ``asking`` picks the rows
    that want an answer: others are candidates only.
    """
    c = config or DedupConfig()
    if similarity is not None and cap is None and candidates is None:
        raise ValueError("a replaced similarity needs candidates or a cap")
    if "published_at" not in articles.columns:
        articles = articles.withColumn("published_at", F.lit(None).cast("timestamp"))
    marked = fingerprints(articles, exact_text)
    wanted = marked if asking is None else marked.where(asking)
    allowed = candidates(marked, c).select("seq", "cand").where("cand < seq") if candidates is not None else _capped(marked, c, cap)
    places = _identities(marked) if allowed is None else None
    exact = exact_matches(marked if places is None else places, c, allowed)
    if asking is not None:
        exact = exact.join(wanted.select("seq"), "seq", "left_semi")
    exact = settle(exact)
    open_rows = lambda rows: (rows if asking is None else rows.join(wanted.select("seq"), "seq", "left_semi")).join(exact.select("seq"), "seq", "left_anti")
    near = similarity_matches(marked, open_rows(allowed), c, similarity) if places is None else nearest_matches(places, open_rows, c)
    found = exact.unionByName(near)
    ids = marked.select(F.col("seq").alias("cand"), F.col(id_col).alias("matched_id"))
    out = wanted.select(id_col, "seq").join(found.join(ids, "cand"), "seq", "left")
    return out.select(
        id_col,
        "seq",
        F.coalesce("status", F.lit("new_document")).alias("status"),
        "matched_id",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "strategy",
        F.coalesce("reasons", F.array(F.lit(NEW))).alias("reasons"),
    )


def clusters(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """(node, canonical): smallest node reachable over edges (a, b), itself included."""
    roots = connected(edges.select("a", "b"), "clusters").toDF("n", "root")
    return nodes.join(roots, F.col(node) == F.col("n"), "left").select(node, F.coalesce("root", node).alias("canonical"))


def first_wins(entries: DataFrame, keys: list[Column], order: list[Column], within: list[Column] = ()) -> DataFrame:
    """Keep the first row, in order, of each value of the first key that is not null; rows without any key share one."""
    key = F.coalesce(*keys, F.lit("\0none"))
    n = F.row_number().over(Window.partitionBy(*within, key).orderBy(*order))  # the engine cuts such a window to a row a task before it shuffles
    return entries.withColumn("_n", n).where("_n = 1").drop("_n")
