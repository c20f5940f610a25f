"""Classification by an external model: prompts, strict validation of answers, replay and live runs.

Answers are validated by expressions over VARIANT-free JSON (``get_json_object``
and typed ``from_json``), first error wins.  ``replay`` picks each article's
first valid answer from a table of responses; ``run_live`` calls an injected
client in ``mapInPandas``, after the relevance gate.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.config import ClassificationConfig, Taxonomy
from newsloom.functions.text import truncated

#: Fields of an answer, in order of validation.
REQUIRED = ("theme", "genre", "event_type", "stakeholders", "geography", "outcomes", "evidence_snippets", "confidence")
OPTIONAL = ("rationale",)
PARTY = ("name", "role", "type")


class AnswerError(ValueError):
    """The answer is not valid."""


def check_answer(raw: str, taxonomy: Taxonomy) -> dict:
    """One answer in Python; raises AnswerError with the first fault. ``answer_error`` is the same over columns."""
    try:
        data = json.loads(raw)
    except (json.JSONDecodeError, TypeError) as e:
        raise AnswerError("invalid JSON") from e
    if not isinstance(data, dict):
        raise AnswerError("not a JSON object")
    if extra := sorted(set(data) - {*REQUIRED, *OPTIONAL}):
        raise AnswerError(f"unknown fields: {extra}")
    if missing := sorted(set(REQUIRED) - set(data)):
        raise AnswerError(f"missing fields: {missing}")
    filled = lambda x: isinstance(x, str) and bool(x.strip())
    for field, allowed in _allowed(taxonomy).items():
        value = data[field]
        if field == "stakeholders":
            if not isinstance(value, list):
                raise AnswerError("stakeholders must be a list")
            for party in value:
                if not isinstance(party, dict):
                    raise AnswerError("stakeholders must contain objects")
                if sorted(party) != sorted(PARTY):
                    raise AnswerError("stakeholders must have name, type and role only")
                if not all(filled(x) for x in party.values()):
                    raise AnswerError("stakeholder fields must be non-empty strings")
                if party["type"] not in allowed:
                    raise AnswerError(f"unknown stakeholder type: {party['type']}")
            continue
        if not isinstance(value, list):
            raise AnswerError(f"{field} must be a list")
        if not all(filled(x) for x in value):
            raise AnswerError(f"{field} must contain non-empty strings")
        if allowed is not None and (odd := sorted(set(value) - set(allowed))):
            raise AnswerError(f"unknown {field} values: {odd}")
    sure = data["confidence"]
    if isinstance(sure, bool) or not isinstance(sure, (int, float)):
        raise AnswerError("confidence must be numeric")
    if not 0 <= sure <= 1:
        raise AnswerError("confidence must be in 0..1")
    if data.get("rationale") is not None and not isinstance(data["rationale"], str):
        raise AnswerError("rationale must be a string")
    return data


def _allowed(t: Taxonomy) -> dict:
    """Lists in order of validation; None allows any."""
    return {"theme": t.themes, "genre": t.genres, "event_type": t.event_types, "geography": t.geographies, "outcomes": t.outcomes, "stakeholders": t.stakeholder_types, "evidence_snippets": None}


def _shown(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def answer_error(content: Column, taxonomy: Taxonomy) -> Column:
    """Message of the first fault, null if the answer is valid. Built-in functions only."""
    v = F.try_parse_json(content)
    keys = F.json_object_keys(content)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    whole = F.schema_of_variant(v)
    extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(x) for x in (*REQUIRED, *OPTIONAL)])))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(x) for x in REQUIRED]), keys))
    faults = [
        F.when(content.isNull() | (v.isNull()), F.lit("invalid JSON")),
        F.when(~whole.startswith("OBJECT"), F.lit("not a JSON object")),
        F.when(F.size(extra) > 0, F.concat(F.lit("unknown fields: "), _shown(extra))),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), _shown(missing))),
    ]
    blank = lambda x: F.coalesce(F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "") == "", F.lit(True))
    for field, allowed in _allowed(taxonomy).items():
        path = f"$.{field}"
        is_list = F.coalesce(kind(path).startswith("ARRAY"), F.lit(False))
        if field == "stakeholders":
            parties = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
            text = lambda p, k: F.try_variant_get(p, f"$.{k}", "string")
            one = lambda p: F.schema_of_variant(p)
            is_text = lambda p, k: F.coalesce(F.schema_of_variant(F.try_variant_get(p, f"$.{k}", "variant")) == "STRING", F.lit(False)) & ~blank(text(p, k))
            fault = lambda p: F.coalesce(
                F.when(~F.coalesce(one(p).startswith("OBJECT"), F.lit(False)), F.lit("stakeholders must contain objects")),
                F.when(
                    ~F.coalesce(F.array_sort(F.json_object_keys(F.to_json(p))) == F.array(*[F.lit(x) for x in PARTY]), F.lit(False)),
                    F.lit("stakeholders must have name, type and role only"),
                ),
                F.when(~(is_text(p, "name") & is_text(p, "type") & is_text(p, "role")), F.lit("stakeholder fields must be non-empty strings")),
                F.when(~text(p, "type").isin(*allowed), F.concat(F.lit("unknown stakeholder type: "), text(p, "type"))),
            )
            faults += [F.when(~is_list, F.lit("stakeholders must be a list")), F.get(F.array_compact(F.transform(parties, fault)), F.lit(0))]
            continue
        items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
        plain = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
        faults += [
            F.when(~is_list, F.lit(f"{field} must be a list")),
            F.when(F.exists(plain, lambda x: x.isNull() | blank(x)), F.lit(f"{field} must contain non-empty strings")),
        ]
        if allowed is not None:
            odd = F.array_sort(F.array_except(plain, F.array(*[F.lit(x) for x in allowed])))
            faults.append(F.when(F.size(odd) > 0, F.concat(F.lit(f"unknown {field} values: "), _shown(odd))))
    number, sure = kind("$.confidence"), F.try_variant_get(v, "$.confidence", "double")
    faults += [
        F.when(~F.coalesce(number.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False)), F.lit("confidence must be numeric")),
        F.when((sure < 0) | (sure > 1), F.lit("confidence must be in 0..1")),
        F.when(~F.coalesce(kind("$.rationale").isin("STRING", "VOID"), F.lit(True)), F.lit("rationale must be a string")),
    ]
    return F.coalesce(*faults)


ANSWER = "struct<theme:array<string>,genre:array<string>,event_type:array<string>,stakeholders:array<struct<name:string,type:string,role:string>>,geography:array<string>,outcomes:array<string>,evidence_snippets:array<string>,confidence:double,rationale:string>"


def validate(responses: DataFrame, taxonomy: Taxonomy, content_col: str = "content") -> DataFrame:
    """Adds error (null if valid) and result (null if not)."""
    checked = responses.withColumn("error", answer_error(F.col(content_col), taxonomy))
    return checked.withColumn("result", F.when(F.col("error").isNull(), F.from_json(F.col(content_col), ANSWER)))


#: What calls cost, added up over those that were made.
OBSERVED = ("input_tokens", "output_tokens", "latency_ms")


def replay(articles: DataFrame, responses: DataFrame, config: ClassificationConfig, taxonomy: Taxonomy, id_col: str = "article_id") -> DataFrame:
    """Classify from recorded responses (article_id, model, attempt from 0, content, error_code; input_tokens, output_tokens and latency_ms if recorded).

    Calls go through the models in order, each with max_retries + 1 attempts, until an
    answer is valid; retries are counted within models. One row per article:
    status 'classified' or 'failed', model, retries, calls, validation_failures, result, error.
    """
    rank = F.create_map(*[F.lit(x) for k, m in enumerate(config.models) for x in (m, k)])
    tried = responses.where(F.col("model").isin(*config.models) & (F.col("attempt") <= config.max_retries))
    tried = validate(tried, taxonomy).withColumn("_model", rank[F.col("model")])
    tried = tried.withColumn("_fault", F.coalesce("error_code", "error")).withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy("_model", "attempt")))
    good = tried.where("_fault is null").groupBy(id_col).agg(F.min("_n").alias("_good"))
    used = tried.join(good, id_col, "left").where("_good is null or _n <= _good")
    call = F.struct("_n", "model", "_model", "attempt", "_fault", "result", F.col("error_code").isNull().alias("answered"))
    summed = used.groupBy(id_col).agg(
        F.max(call).alias("_last"),
        F.count("*").alias("calls"),
        F.count_if(F.col("attempt") > 0).alias("retries"),
        F.sort_array(F.collect_list(F.when(F.col("error_code").isNull() & F.col("error").isNotNull(), F.struct("_n", "error")))).alias("_faults"),
        *[F.coalesce(F.sum(F.col(c)), F.lit(0)).alias(c) for c in OBSERVED if c in responses.columns],
    )
    out = articles.join(summed, id_col, "left")
    won = F.col("_last._fault").isNull() & F.col("calls").isNotNull()
    return out.select(
        *[F.col(c) for c in articles.columns],
        F.when(won, "classified").otherwise("failed").alias("status"),
        F.col("_last.model").alias("model"),
        F.coalesce("retries", F.lit(0)).alias("retries"),
        F.coalesce("calls", F.lit(0)).alias("calls"),
        F.transform("_faults", lambda x: x["error"]).alias("validation_failures"),
        F.when(won, F.col("_last.result")).alias("result"),
        F.when(~won, F.coalesce("_last._fault", F.lit("no response"))).alias("error"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in OBSERVED if c in responses.columns],
    )


@dataclass(frozen=True)
class PromptTemplate:
    version: str
    system: str
    intro: str


TEMPLATES: dict[str, PromptTemplate] = {}


def register_template(template: PromptTemplate) -> None:
    TEMPLATES[template.version] = template


register_template(
    PromptTemplate(
        "classification-v1",
        "Classify news articles. Answer with one JSON object and nothing else; use the allowed values only.",
        "Fields of the object: theme, genre, event_type, geography, outcomes (arrays of allowed values), stakeholders "
        "(array of objects with name, type and role), evidence_snippets (array of short quotes from the article), "
        "confidence (0 to 1), rationale (text, may be left out).",
    )
)

#: Fields of an article that a prompt shows.
PROMPT_FIELDS = ("title", "subtitle", "summary", "author", "authors", "categories", "tags", "metadata", "source", "published_at")


def prompts(articles: DataFrame, taxonomy: Taxonomy, version: str = "classification-v1", most: int = 12_000) -> DataFrame:
    """Adds system_prompt and user_prompt, built in the JVM; the body is cut at ``most`` characters."""
    if version not in TEMPLATES:
        raise ValueError(f"unknown prompt version: {version}")
    template = TEMPLATES[version]
    allowed = {("stakeholders[].type" if k == "stakeholders" else k): v for k, v in _allowed(taxonomy).items() if v is not None}
    head = f"{template.intro}\n\nTaxonomy version: {taxonomy.version}\nAllowed values: {json.dumps(allowed, ensure_ascii=False)}\nArticle: "
    bodies = [F.nullif(F.col(c), F.lit("")) for c in ("body", "body_text", "content_plain") if c in articles.columns]
    shown = [F.col(c) for c in PROMPT_FIELDS if c in articles.columns]
    body = truncated(F.coalesce(*bodies) if bodies else F.lit(None).cast("string"), most)
    payload = F.to_json(F.struct(*shown, body.alias("body_text")), {"ignoreNullFields": "false"})
    return articles.withColumn("prompt_version", F.lit(version)).withColumn("system_prompt", F.lit(template.system)).withColumn("user_prompt", F.concat(F.lit(head), payload))


class ClientError(RuntimeError):
    """A call failed; ``code`` says how (timeout, rate_limit, server, request, response)."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


def status_error(status: int) -> str | None:
    """Error code of an HTTP status."""
    return "rate_limit" if status == 429 else "server" if status >= 500 else "request" if status >= 400 else None


Client = Callable[[str, str, str], str]
LIVE = "article_id string, status string, model string, retries int, calls int, prompt_version string, response_bytes long, validation_failures array<string>, content string, error string"


def run_live(prompted: DataFrame, client: Client, config: ClassificationConfig, taxonomy: Taxonomy, id_col: str = "article_id") -> DataFrame:
    """Call ``client(system, user, model) -> content`` for each row. Give it gated rows only: filters are not pushed through this stage."""

    def one(row) -> dict:
        faults, retries, calls, last, model = [], 0, 0, None, None
        for model in config.models:
            for attempt in range(config.max_retries + 1):
                retries += attempt > 0
                calls += 1
                try:
                    content = client(row.system_prompt, row.user_prompt, model)
                    check_answer(content, taxonomy)
                    return {"status": "classified", "model": model, "retries": retries, "calls": calls, "response_bytes": len(content.encode()), "validation_failures": faults, "content": content, "error": None}
                except AnswerError as e:
                    faults.append(str(e))
                    last = str(e)
                except ClientError as e:
                    last = e.code
        return {"status": "failed", "model": model, "retries": retries, "calls": calls, "response_bytes": None, "validation_failures": faults, "content": None, "error": last}

    def run(frames):
        for frame in frames:
            rows = [{"article_id": str(r.article_id), "prompt_version": r.prompt_version, **one(r)} for r in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LIVE.split(", ")])

    kept = prompted.select(F.col(id_col).cast("string").alias("article_id"), "prompt_version", "system_prompt", "user_prompt")
    return kept.mapInPandas(run, LIVE)


def settings_json(*settings) -> str:
    return json.dumps([asdict(s) for s in settings], ensure_ascii=False)
