import pytest
from pyspark.sql import functions as F

from newsloom.config import BooleanRule, DedupConfig, GeographyRule, KeywordGroup, RelevanceConfig
from newsloom.functions import text
from newsloom.plans import relevance, rules



def as_of():
    return F.to_timestamp(F.lit("2024-03-01"))


def matches(spark, expression, body):
    df = spark.createDataFrame([(body,)], "t string")
    return df.select(rules.compile_rule(expression, text.fold_text(F.col("t")))).first()[0]


@pytest.mark.parametrize(
    ("body", "hit"),
    [("River festival in Town today", True), ("Harbour festival, Town", True), ("River festival in Town on crypto", False), ("River without place", False), ("the riverbank of Town", False)],
)
def test_boolean_rule(spark, body, hit):
    assert matches(spark, "(River OR Harbour) AND (Town) NOT (Crypto) NOT (Movie)", body) is hit


def test_precedence_quotes_and_word_bounds(spark):
    assert matches(spark, "a OR b AND c", "a")
    assert matches(spark, '"health camp" AND NOT x-y', "a HEALTH  camp")
    assert not matches(spark, "NOT NOT a", "b")


@pytest.mark.parametrize("bad", ["", "a b", "(a", "a)", "AND a", "a OR", "a % b"])
def test_syntax_errors(bad):
    with pytest.raises(rules.RuleError):
        rules.parse(bad)


@pytest.mark.parametrize(("query", "ok"), [(None, True), ("a b", True), ("(a OR b) AND NOT c", True), ("(a", False), ("OR a", False), ("a AND", False), (")a(", False)])
def test_registry_grammar(query, ok):
    assert (rules.check_query(query) is None) is ok


CONFIG = RelevanceConfig(
    threshold=0.45,
    keyword_groups=[KeywordGroup("core", ["Crowd", "crowd", "health camp"], 1.0), KeywordGroup("more", ["police"], 0.5)],
    boolean_rules=[BooleanRule("r", "crowd AND city")],
    geography_rules=[GeographyRule("g", ["city", "town"], 1.0)],
    source_priorities={"daily": 2.0},
)


def test_score_decision_reasons_and_order(spark):
    df = spark.createDataFrame([("Crowd at health camp", "City police", "Daily", "2024-02-29T00:00:00Z"), ("Nothing", None, None, None)], "title string, body_text string, source string, publication_date string")
    a, b = relevance.score(df, CONFIG, as_of()).collect()
    want = (0.35 * (1.5 / 3) + 0.25 + 0.18 * 0.5 + 0.12 + 0.10 * (1 - 1 / 30)) / 1.0
    assert a.score == pytest.approx(want) and a.decision == "relevant"
    assert a.matched_keywords == ["Crowd", "health camp", "police"] and a.matched_rules == ["r"] and a.matched_geographies == ["g"] and a.matched_entities == []
    assert a.reasons == list(relevance.REASONS)
    assert b.score == pytest.approx(0.05) and b.decision == "irrelevant" and b.reasons == [relevance.REASONS[4]]
    assert relevance.gate(relevance.score(df, CONFIG, as_of())).count() == 1


def test_settings_are_checked(tmp_path, monkeypatch):
    with pytest.raises(ValueError):
        RelevanceConfig(threshold=2)
    with pytest.raises(ValueError):
        DedupConfig(near_duplicate_threshold=0.99)
    with pytest.raises(ValueError):
        RelevanceConfig.from_mapping({"tresh": 1})
    path = tmp_path / "c.json"
    path.write_text('{"threshold": 0.2, "keyword_groups": [{"name": "n", "keywords": ["k"]}]}')
    monkeypatch.setenv("T_CONFIG_PATH", str(path))
    monkeypatch.setenv("T_THRESHOLD", "0.3")
    made = RelevanceConfig.from_env("T_")
    assert made.threshold == 0.3 and made.keyword_groups[0].weight == 1.0
