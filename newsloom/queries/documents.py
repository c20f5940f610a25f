"""Text, relevance and duplicates over ``documents``: title is the first line, the date follows from doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.config import BooleanRule, ClassificationConfig, DedupConfig, GeographyRule, KeywordGroup, RelevanceConfig, Taxonomy
from newsloom.functions import dates, text
from newsloom.plans import classify, dedup, relevance, warehouse
from newsloom.plans.rules import compile_rule

from .registry import query

AS_OF = "2024-03-10 00:00:00"
CONFIG = RelevanceConfig(
    threshold=0.45,
    source_priorities={"src0": 1.0, "src3": 0.6, "src7": 0.3},
    keyword_groups=[
        KeywordGroup("english", ["the", "that", "with"], 1.0),
        KeywordGroup("romance", ["los", "les", "des", "une"], 0.8),
        KeywordGroup("licences", ["Apache License", "MIT License", "CC BY-NC"], 0.6),
    ],
    boolean_rules=[BooleanRule("prose", "(the OR der OR la) AND (\"and\" OR und OR et OR y) NOT (worthless)", 0.7), BooleanRule("licensed", '"Licensed under"', 0.5)],
    geography_rules=[GeographyRule("north", ["der", "das"], 1.0), GeographyRule("south", ["que", "les", "del"], 0.8)],
)

FOLD = "replace(lower(trim(regexp_replace(coalesce({0}, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))), 'ß', 'ss')"
#: documents as articles, in SQL
ARTICLES = f"""articles AS (
  SELECT doc_id, source, lang, text, split_part(text, chr(10), 1) AS title, {FOLD.format("text")} AS f,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 90 AS INTEGER)) + to_hours(CAST(doc_id % 24 AS INTEGER)) AS published_at
  FROM documents)"""


def has(phrase: str, column: str = "f") -> str:
    return f"regexp_matches({column}, '(^|[^\\p{{L}}\\p{{N}}_]){phrase.lower()}($|[^\\p{{L}}\\p{{N}}_])')"


def articles(load) -> DataFrame:
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval((F.col("doc_id") % 90).cast("int"), (F.col("doc_id") % 24).cast("int"))
    docs = load("documents")
    return docs.select("doc_id", F.col("doc_id").alias("seq"), "source", "lang", "text", F.col("text").alias("body_text"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), at.alias("published_at"), F.col("source").alias("source_id"))


def _joined(column: str):
    return F.array_join(column, ",")


KW = [(g, k, w) for g, ks, w in (("english", ["the", "that", "with"], 1.0), ("romance", ["los", "les", "des", "une"], 0.8), ("licences", ["Apache License", "MIT License", "CC BY-NC"], 0.6)) for k in ks]
KW_LIST = "list_filter([" + ", ".join(f"CASE WHEN {has(k)} THEN '{k}' END" for _, k, _ in KW) + "], lambda x: x IS NOT NULL)"
GROUP = {g: "greatest(" + ", ".join(f"CASE WHEN {has(k)} THEN {w} ELSE 0.0 END" for gg, k, w in KW if gg == g) + ")" for g in ("english", "romance", "licences")}
PROSE = f"(({has('the')} OR {has('der')} OR {has('la')}) AND ({has('and')} OR {has('und')} OR {has('et')} OR {has('y')}) AND NOT {has('worthless')})"
LICENSED = has("licensed under")
NORTH, SOUTH = f"({has('der')} OR {has('das')})", f"({has('que')} OR {has('les')} OR {has('del')})"


@query(
    f"""WITH {ARTICLES}, parts AS (
  SELECT doc_id, {KW_LIST} AS kws,
    list_filter([CASE WHEN {PROSE} THEN 'prose' END, CASE WHEN {LICENSED} THEN 'licensed' END], lambda x: x IS NOT NULL) AS rules,
    least(1.0, (CAST({GROUP['english']} AS DOUBLE) + CAST({GROUP['romance']} AS DOUBLE) + CAST({GROUP['licences']} AS DOUBLE)) / 3.0) AS kw,
    least(1.0, CASE WHEN {PROSE} THEN CAST(0.7 AS DOUBLE) ELSE 0 END + CASE WHEN {LICENSED} THEN CAST(0.5 AS DOUBLE) ELSE 0 END) AS rl,
    least(1.0, (CASE WHEN {NORTH} THEN CAST(1.0 AS DOUBLE) ELSE 0 END + CASE WHEN {SOUTH} THEN CAST(0.8 AS DOUBLE) ELSE 0 END) / 2.0) AS geo,
    CASE source WHEN 'src0' THEN CAST(1.0 AS DOUBLE) WHEN 'src3' THEN CAST(0.6 AS DOUBLE) WHEN 'src7' THEN CAST(0.3 AS DOUBLE) ELSE 0 END AS src,
    greatest(0.0, epoch(TIMESTAMP '{AS_OF}' - published_at) / 86400.0) AS age
  FROM articles)
SELECT doc_id, round((0.35 * kw + 0.25 * rl + 0.18 * geo + 0.12 * src + 0.10 * CASE WHEN age > 30 THEN 0 ELSE 1 - age / 30 END) / (0.35 + 0.25 + 0.18 + 0.12 + 0.10), 6) AS score,
  CASE WHEN (0.35 * kw + 0.25 * rl + 0.18 * geo + 0.12 * src + 0.10 * CASE WHEN age > 30 THEN 0 ELSE 1 - age / 30 END) / (0.35 + 0.25 + 0.18 + 0.12 + 0.10) >= 0.45 THEN 'relevant' ELSE 'irrelevant' END AS decision,
  array_to_string(kws, ',') AS matched_keywords, array_to_string(rules, ',') AS matched_rules
FROM parts"""
)
def relevance_score(load):
    scored = relevance.score(articles(load).select("doc_id", "body_text", "source", "published_at"), CONFIG, F.to_timestamp(F.lit(AS_OF)))
    return scored.select("doc_id", F.round("score", 6).alias("score"), "decision", _joined("matched_keywords").alias("matched_keywords"), _joined("matched_rules").alias("matched_rules"))


def _folded(load):
    return articles(load).select("doc_id", text.fold_text(F.col("text")).alias("f"))


@query(
    f"WITH {ARTICLES}, k AS (SELECT doc_id, unnest([" + ", ".join(f"CASE WHEN {has(k)} THEN '{g}:{k}' END" for g, k, _ in KW) + "]) AS hit FROM articles) SELECT doc_id, split_part(hit, ':', 1) AS keyword_group, split_part(hit, ':', 2) AS keyword FROM k WHERE hit IS NOT NULL"
)
def keyword_match(load):
    rows, f = text.with_phrases(_folded(load), "f", lambda t: relevance.keyword_matches(t, CONFIG))
    return rows.select("doc_id", F.explode(relevance.keyword_matches(f, CONFIG)).alias("m")).select("doc_id", F.col("m.group").alias("keyword_group"), "m.keyword")


@query(f"WITH {ARTICLES} SELECT doc_id, CAST({GROUP['english']} AS DOUBLE) AS english, CAST({GROUP['romance']} AS DOUBLE) AS romance, CAST({GROUP['licences']} AS DOUBLE) AS licences FROM articles")
def keyword_group_max(load):
    rows, f = text.with_phrases(_folded(load), "f", lambda t: relevance.keyword_matches(t, CONFIG))
    found = rows.select("doc_id", relevance.keyword_matches(f, CONFIG).alias("m"))
    best = lambda g: F.aggregate(F.filter("m", lambda m: m["group"] == g), F.lit(0.0), lambda s, m: F.greatest(s, m["weight"])).alias(g)
    return found.select("doc_id", *[best(g) for g in ("english", "romance", "licences")])


@query(f"WITH {ARTICLES} SELECT doc_id, {PROSE} AS prose, {LICENSED} AS licensed FROM articles")
def boolean_rule_match(load):
    rows, f = text.with_phrases(_folded(load), "f", lambda t: relevance.rule_matches(t, CONFIG))
    return rows.select("doc_id", compile_rule(CONFIG.boolean_rules[0].expression, f).alias("prose"), compile_rule(CONFIG.boolean_rules[1].expression, f).alias("licensed"))


@query(f"WITH {ARTICLES} SELECT doc_id, array_to_string(list_filter([CASE WHEN {NORTH} THEN 'north' END, CASE WHEN {SOUTH} THEN 'south' END], lambda x: x IS NOT NULL), ',') AS places FROM articles")
def geography_match(load):
    rows, f = text.with_phrases(_folded(load), "f", lambda t: relevance.geography_matches(t, CONFIG))
    return rows.select("doc_id", F.array_join(F.transform(relevance.geography_matches(f, CONFIG), lambda m: m["name"]), ",").alias("places"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS INTEGER) AS words, CASE WHEN len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) > 0 THEN round(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) / 225.0, 1) ELSE 0.0 END AS minutes FROM documents")
def word_count_reading_time(load):
    words = text.word_count(F.col("text"))
    return load("documents").select("doc_id", words.alias("words"), text.reading_minutes(words).alias("minutes"))


STRAIGHT = "translate({0}, '‐‑‒–—−‘’‚‛“”„‟', '------''''''''\"\"\"\"')"
TITLE = FOLD.format("regexp_replace(" + FOLD.format(STRAIGHT.format("split_part(text, chr(10), 1)")) + ", '[^\\p{L}\\p{N}_\\s]', ' ', 'g')")
CONTENT = FOLD.format(STRAIGHT.format("text"))


@query(
    f"""WITH t AS (SELECT doc_id, {TITLE} AS t, {CONTENT} AS c FROM documents)
SELECT doc_id, CASE WHEN t <> '' THEN sha256(t) END AS fp_title, CASE WHEN c <> '' THEN sha256(c) END AS fp_content,
  CASE WHEN concat_ws(chr(10), nullif(t, ''), nullif(c, '')) <> '' THEN sha256(concat_ws(chr(10), nullif(t, ''), nullif(c, ''))) END AS fp_combined FROM t"""
)
def content_fingerprint(load):
    return dedup.fingerprints(articles(load)).select("doc_id", "fp_title", "fp_content", "fp_combined")


@query(
    f"""WITH t AS (SELECT doc_id, source, {CONTENT} AS c FROM documents), f AS (SELECT c, min(doc_id) AS first_id FROM t WHERE c <> '' GROUP BY c)
SELECT t.doc_id, f.first_id AS matched_id, CASE WHEN t.source = s.source THEN 'exact_duplicate' ELSE 'near_duplicate' END AS status, CASE WHEN t.source = s.source THEN 0.98 ELSE 0.94 END::DOUBLE AS confidence
FROM t JOIN f USING (c) JOIN t s ON s.doc_id = f.first_id WHERE t.doc_id > f.first_id"""
)
def exact_duplicate_pairs(load):
    marked = dedup.fingerprints(articles(load).drop("published_at")).withColumn("published_at", F.lit(None).cast("timestamp"))
    found = dedup.exact_matches(marked, DedupConfig())
    return found.select(F.col("seq").alias("doc_id"), F.col("cand").alias("matched_id"), "status", "confidence")


@query(f"WITH t AS (SELECT doc_id, source, {CONTENT} AS c FROM documents) SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN c = '' THEN 'none' ELSE sha256(c) END ORDER BY doc_id) AS n FROM t) WHERE n = 1")
def first_wins_dedup(load):
    return dedup.first_wins(dedup.fingerprints(articles(load)), [F.col("fp_content")], [F.col("doc_id")]).select("doc_id", "source")


TOKENS = f"list_distinct(regexp_extract_all({CONTENT}, '[\\p{{L}}\\p{{N}}_]+'))"


@query(
    f"""WITH t AS (SELECT doc_id, list_sort({TOKENS}) AS k FROM documents), r AS (SELECT k, min(doc_id) AS rep FROM t WHERE len(k) > 0 GROUP BY k), u AS (SELECT rep, len(k) AS n, unnest(k) AS tok FROM r),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS hit FROM u a JOIN u b ON a.tok = b.tok AND a.rep > b.rep GROUP BY 1, 2)
SELECT a AS doc_id, b AS other_id, round(hit / (na + nb - hit), 6) AS jaccard, 'link' AS kind FROM p WHERE hit / (na + nb - hit) >= 0.7
UNION ALL SELECT doc_id, rep, 1.0, 'copy' FROM t JOIN r USING (k) WHERE doc_id <> rep"""
)
def token_jaccard_pairs(load):
    """Links between classes of equal token sets, and each copy with its class's representative."""
    bags = articles(load).select("doc_id", text.content_tokens(F.col("text")).alias("toks"))
    members, links = dedup.jaccard_classes(bags, "doc_id", "toks", 0.7)
    links = links.select(F.col("a").alias("doc_id"), F.col("b").alias("other_id"), F.round("jaccard", 6).alias("jaccard"), F.lit("link").alias("kind"))
    return links.unionByName(members.where("k <> rep").select(F.col("k").alias("doc_id"), F.col("rep").alias("other_id"), F.lit(1.0).alias("jaccard"), F.lit("copy").alias("kind")))


@query(
    f"""WITH {ARTICLES} SELECT seq AS doc_id, cand AS candidate_id, n AS place FROM (
  SELECT a.doc_id AS seq, b.doc_id AS cand, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id) AS n
  FROM articles a JOIN articles b ON b.doc_id < a.doc_id AND b.published_at >= a.published_at - INTERVAL 14 DAY) WHERE n <= 5"""
)
def candidate_lookback_topn(load):
    found = dedup.capped_candidates(articles(load).select("seq", "published_at"), DedupConfig(), 5)
    return found.select(F.col("seq").alias("doc_id"), F.col("cand").alias("candidate_id"), F.col("n").alias("place"))


LADDER = "round(least(1, greatest(0, 0.12 * t + 0.58 * c + 0.12 * p + 0.08 * CASE WHEN s THEN 1 ELSE 0.65 END + 0.10 * f + CASE WHEN s THEN 0.05 ELSE -0.04 END)), 6)"


@query(
    f"""WITH x AS (SELECT doc_id, CAST((doc_id * 7 % 101) / 100.0 AS DOUBLE) AS t, CAST((doc_id * 13 % 101) / 100.0 AS DOUBLE) AS c, CAST((doc_id * 29 % 101) / 100.0 AS DOUBLE) AS p, doc_id % 2 = 0 AS s, CASE doc_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.45 ELSE 1.0 END::DOUBLE AS f FROM documents),
y AS (SELECT *, {LADDER} AS v FROM x)
SELECT doc_id, v AS confidence, CASE WHEN v >= 0.97 AND c >= 0.97 AND t >= 0.95 AND s THEN 'exact_duplicate' WHEN v >= 0.86 OR (c >= 0.82 AND t >= 0.9) THEN 'near_duplicate' WHEN v >= 0.68 THEN 'possible_duplicate' ELSE 'new_document' END AS status FROM y"""
)
def duplicate_status_ladder(load):
    c = DedupConfig()
    share = lambda k: (F.col("doc_id") * k % 101) / 100.0
    f = F.when(F.col("doc_id") % 3 == 0, 0.0).when(F.col("doc_id") % 3 == 1, 0.45).otherwise(1.0)
    x = load("documents").select("doc_id", share(7).alias("t"), share(13).alias("c"), share(29).alias("p"), (F.col("doc_id") % 2 == 0).alias("s"), f.alias("f"))
    x = x.withColumn("confidence", F.round(dedup.confidence(F.col("t"), F.col("c"), F.col("p"), F.col("s"), F.col("f"), c), 6))
    return x.select("doc_id", "confidence", dedup.status(F.col("confidence"), F.col("c"), F.col("t"), F.col("s"), c).alias("status"))


@query(
    f"""WITH t AS (SELECT doc_id, {CONTENT} AS c FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS canonical FROM t"""
)
def duplicate_clusters(load):
    marked = dedup.fingerprints(articles(load).drop("published_at")).withColumn("published_at", F.lit(None).cast("timestamp"))
    # texts that fold to nothing are one cluster too: they share the missing hash
    keyed = marked.select("doc_id", F.coalesce("fp_content", F.lit("none")).alias("k"))
    edges = keyed.join(keyed.groupBy("k").agg(F.min("doc_id").alias("b")), "k").select(F.col("doc_id").alias("a"), "b")
    return dedup.clusters(edges, keyed, "doc_id").select("doc_id", "canonical")


@query()
def similarity_dedup(load):
    found = dedup.analyze(articles(load).withColumn("document_id", F.col("doc_id")), DedupConfig())
    return found.select(F.col("document_id").alias("doc_id"), "status", "matched_id", F.round("confidence", 6).alias("confidence"), "strategy", F.array_join("reasons", "; ").alias("reasons"))


@query(f"WITH {ARTICLES}, a AS (SELECT doc_id, greatest(0.0, epoch(TIMESTAMP '{AS_OF}' - published_at) / 86400.0) AS age, abs(epoch(TIMESTAMP '2024-01-20 00:00:00' - published_at)) / 3600.0 AS apart FROM articles) SELECT doc_id, round(CASE WHEN age > 30 THEN 0 ELSE 1 - age / 30 END, 6) AS recency, round(CASE WHEN apart > 72 THEN 0 ELSE 1 - apart / 72 END, 6) AS proximity FROM a")
def recency_proximity(load):
    at = F.col("published_at")
    near = dates.proximity(at, F.to_timestamp(F.lit("2024-01-20 00:00:00")), 72)
    return articles(load).select("doc_id", F.round(dates.recency(at, F.to_timestamp(F.lit(AS_OF)), 30), 6).alias("recency"), F.round(near, 6).alias("proximity"))


@query(
    r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^[ \t]+$', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[\n\t\p{Z}]+|[\n\t\p{Z}]+$', '', 'g')), chr(10)), '^[\n\t\p{Z}]+|[\n\t\p{Z}]+$', '', 'g')) AS tidy_hash FROM t"""
)
def whitespace_tidy(load):
    return load("documents").select("doc_id", F.sha2(text.tidy_whitespace(F.coalesce("text", F.lit(""))), 256).alias("tidy_hash"))


@query(
    """WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: lower(trim(regexp_replace(x, '[\\s\\p{Z}]+', ' ', 'g')))) AS k FROM documents)
SELECT doc_id, CAST(len(list_distinct(list_filter(k, lambda x: x <> ''))) AS INTEGER) AS paragraphs FROM l"""
)
def paragraph_dedup(load):
    kept = text.non_empty(text.distinct_paragraphs(F.split("text", "\n")))
    return load("documents").select("doc_id", F.size(kept).alias("paragraphs"))


@query("SELECT doc_id, sha256(lower(trim(regexp_replace(coalesce(split_part(text, chr(10), 1), ''), '[\\s\\p{Z}]+', ' ', 'g')))) AS title_hash FROM documents")
def stable_title_hash(load):
    return articles(load).select("doc_id", text.stable_hash(F.col("title")).alias("title_hash"))


ANSWERS = """r AS (SELECT doc_id AS article_id, CASE doc_id % 9
  WHEN 0 THEN '{"theme":["public_health"],"genre":["advisory"],"event_type":["incident"],"stakeholders":[{"name":"A","type":"health","role":"b"}],"geography":["other"],"outcomes":[],"evidence_snippets":["x"],"confidence":0.' || (doc_id % 10) || '}'
  WHEN 1 THEN 'not json' WHEN 2 THEN '[1,2]'
  WHEN 3 THEN '{"theme":["public_health"],"colour":"red","genre":[],"event_type":[],"stakeholders":[],"geography":[],"outcomes":[],"evidence_snippets":[],"confidence":0.5}'
  WHEN 4 THEN '{"theme":["public_health"],"confidence":0.5}'
  WHEN 5 THEN '{"theme":["weather"],"genre":[],"event_type":[],"stakeholders":[],"geography":[],"outcomes":[],"evidence_snippets":[],"confidence":0.5}'
  WHEN 6 THEN '{"theme":[],"genre":[],"event_type":[],"stakeholders":[],"geography":[],"outcomes":[],"evidence_snippets":[],"confidence":true}'
  WHEN 7 THEN '{"theme":[],"genre":[],"event_type":[],"stakeholders":[],"geography":[],"outcomes":[],"evidence_snippets":[],"confidence":1.5}'
  ELSE '{"theme":[],"genre":[],"event_type":[],"stakeholders":[],"geography":[],"outcomes":[],"evidence_snippets":[" "],"confidence":0.5}' END AS content FROM documents)"""


def _answers(load):
    spark, text = load("documents").sparkSession, ANSWERS.replace("{", "{{").replace("}", "}}")
    return spark.sql("WITH " + text.replace("FROM documents", "FROM {docs}") + " SELECT * FROM r", docs=load("documents"))


@query(
    f"""WITH {ANSWERS} SELECT article_id, CASE article_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'not a JSON object'
  WHEN 3 THEN 'unknown fields: [''colour'']' WHEN 4 THEN 'missing fields: [''event_type'', ''evidence_snippets'', ''genre'', ''geography'', ''outcomes'', ''stakeholders'']'
  WHEN 5 THEN 'unknown theme values: [''weather'']' WHEN 6 THEN 'confidence must be numeric' WHEN 7 THEN 'confidence must be in 0..1' ELSE 'evidence_snippets must contain non-empty strings' END AS error,
  CASE WHEN article_id % 9 = 0 THEN CAST(json_extract(content, '$.confidence') AS DOUBLE) END AS confidence FROM r"""
)
def response_validation(load):
    return classify.validate(_answers(load), Taxonomy()).select("article_id", "error", F.col("result.confidence").alias("confidence"))


@query(
    """WITH d AS (SELECT doc_id FROM documents) SELECT doc_id AS article_id, CASE WHEN doc_id % 4 < 3 THEN 'classified' ELSE 'failed' END AS status,
  CASE WHEN doc_id % 4 < 2 THEN 'auto' ELSE 'spare' END AS model, CAST(CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS BIGINT) AS retries, CAST(CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS BIGINT) AS calls FROM d"""
)
def replay_classification(load):
    docs = load("documents").select(F.col("doc_id").alias("article_id"))
    good = '{"theme":[],"genre":[],"event_type":[],"stakeholders":[],"geography":[],"outcomes":[],"evidence_snippets":[],"confidence":0.9}'
    k = F.col("article_id") % 4
    calls = [("auto", 0, k == 0), ("auto", 1, k == 1), ("spare", 0, k == 2), ("spare", 1, F.lit(False))]
    made = [F.struct(F.lit(m).alias("model"), F.lit(a).alias("attempt"), F.when(ok, F.lit(good)).otherwise(F.lit("{")).alias("content"), F.when(~ok & (F.lit(a) == 1), F.lit("timeout")).alias("error_code")) for m, a, ok in calls]
    responses = docs.select("article_id", F.explode(F.array(*made)).alias("r")).select("article_id", "r.*")
    config = ClassificationConfig(fallback_models=["spare"], max_retries=1)
    return classify.replay(docs, responses, config, Taxonomy()).select("article_id", "status", "model", F.col("retries").cast("long").alias("retries"), F.col("calls").cast("long").alias("calls"))


@query("SELECT doc_id, 'classification-v1' AS prompt_version, true AS built, CAST(least(length(text), 12000) AS INTEGER) AS body_chars FROM documents")
def prompt_build(load):
    made = classify.prompts(articles(load).select("doc_id", "title", "body_text", "source"), Taxonomy())
    made = made.withColumn("_p", F.expr("substring(user_prompt, locate('\nArticle: ', user_prompt) + 10)"))
    body = F.get_json_object("_p", "$.body_text")
    return made.select("doc_id", "prompt_version", F.contains("system_prompt", F.lit("JSON")).alias("built"), F.length(body).alias("body_chars"))


@query(
    """WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), h AS (
  SELECT doc_id, 'law' AS "group", 'license' AS term, len(regexp_extract_all(t, 'license')) AS hits FROM t
  UNION ALL SELECT doc_id, 'law', 'copyright', len(regexp_extract_all(t, 'copyright')) FROM t
  UNION ALL SELECT doc_id, 'secrets', 'password', len(regexp_extract_all(t, 'pass(word|wd)')) FROM t)
SELECT h.doc_id, h."group" AS keyword_group, h.term, CAST(h.hits AS INTEGER) AS hits FROM h JOIN t USING (doc_id) WHERE hits > 0 AND NOT (h."group" = 'law' AND contains(t.t, 'apache'))"""
)
def keyword_hits(load):
    spark = load("documents").sparkSession
    words = spark.createDataFrame([("law", "license", "partial", False), ("law", "copyright", "partial", False), ("law", "apache", "partial", True), ("secrets", "password", "regex", False)], "`group` string, term string, match_type string, negative boolean")
    words = words.withColumn("term", F.when(F.col("match_type") == "regex", F.lit("pass(word|wd)")).otherwise(F.col("term")))
    found = warehouse.keyword_hits(load("documents"), words, "doc_id", "text")
    return found.select("doc_id", F.col("group").alias("keyword_group"), F.when(F.col("group") == "secrets", F.lit("password")).otherwise(F.col("term")).alias("term"), "hits")


@query("WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS k FROM documents) SELECT doc_id, round(2.0 / len(k), 6) AS rank FROM t WHERE list_contains(k, 'licensed') AND list_contains(k, 'under')")
def full_text_search(load):
    return warehouse.full_text(load("documents"), "text", "licensed under").select("doc_id", F.round("rank", 6).alias("rank"))
