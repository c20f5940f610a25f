"""Settings: dataclasses read from mappings, JSON files or the environment, and validated."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from typing import get_type_hints


def _cast(kind, text: str):
    if kind is bool:
        return text.strip().lower() in {"1", "true", "yes"}
    if kind in (int, float, str):
        return kind(text)
    return [x.strip() for x in text.split(",") if x.strip()]


class Settings:
    """Base: ``from_mapping``, ``from_json_file``, ``from_env``."""

    #: Fields that hold lists of other dataclasses.
    nested: dict = {}

    def __post_init__(self):
        self.validate()

    def validate(self) -> None:
        """Raises ValueError."""

    @classmethod
    def from_mapping(cls, data: dict):
        known = {f.name for f in fields(cls)}
        if extra := sorted(set(data) - known):
            raise ValueError(f"unknown settings: {extra}")
        return cls(**{k: [cls.nested[k](**x) for x in v] if k in cls.nested else v for k, v in data.items()})

    @classmethod
    def from_json_file(cls, path: str):
        with open(path, encoding="utf-8") as f:
            return cls.from_mapping(json.load(f))

    @classmethod
    def from_env(cls, prefix: str):
        """A JSON file named in <prefix>CONFIG_PATH, if set; single variables override it. Lists are comma-separated; nested fields come from the file only."""
        path = os.environ.get(f"{prefix}CONFIG_PATH")
        data: dict = {}
        if path:
            with open(path, encoding="utf-8") as f:
                data = json.load(f)
        hints = get_type_hints(cls)
        for f in fields(cls):
            text = os.environ.get(f"{prefix}{f.name.upper()}")
            if text is not None and f.name not in cls.nested:
                data[f.name] = _cast(hints[f.name], text)
        return cls.from_mapping(data)


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class KeywordGroup:
    name: str
    keywords: list[str]
    weight: float = 1.0


@dataclass(frozen=True)
class BooleanRule:
    name: str
    expression: str
    weight: float = 1.0


@dataclass(frozen=True)
class GeographyRule:
    name: str
    aliases: list[str]
    weight: float = 1.0


@dataclass
class RelevanceConfig(Settings):
    threshold: float = 0.55
    keyword_weight: float = 0.35
    boolean_rule_weight: float = 0.25
    geography_weight: float = 0.18
    source_weight: float = 0.12
    publication_time_weight: float = 0.10
    publication_window_days: int = 30
    allow_historic_without_date: bool = True
    source_priorities: dict[str, float] = field(default_factory=dict)
    keyword_groups: list[KeywordGroup] = field(default_factory=list)
    boolean_rules: list[BooleanRule] = field(default_factory=list)
    geography_rules: list[GeographyRule] = field(default_factory=list)

    nested = {"keyword_groups": KeywordGroup, "boolean_rules": BooleanRule, "geography_rules": GeographyRule}

    @property
    def weights(self) -> tuple[float, ...]:
        return (self.keyword_weight, self.boolean_rule_weight, self.geography_weight, self.source_weight, self.publication_time_weight)

    def validate(self) -> None:
        _need(0 <= self.threshold <= 1, "threshold must be in 0..1")
        _need(min(self.weights) >= 0, "weights must not be negative")
        _need(self.publication_window_days >= 0, "publication_window_days must not be negative")


@dataclass
class DedupConfig(Settings):
    exact_duplicate_threshold: float = 0.97
    near_duplicate_threshold: float = 0.86
    possible_duplicate_threshold: float = 0.68
    title_similarity_threshold: float = 0.9
    content_similarity_threshold: float = 0.82
    publication_window_hours: int = 72
    candidate_lookback_days: int = 14
    same_source_bonus: float = 0.05
    different_source_penalty: float = 0.04
    max_candidates: int = 500

    def validate(self) -> None:
        ladder = (self.exact_duplicate_threshold, self.near_duplicate_threshold, self.possible_duplicate_threshold)
        for value in (*ladder, self.title_similarity_threshold, self.content_similarity_threshold):
            _need(0 <= value <= 1, "thresholds must be in 0..1")
        _need(list(ladder) == sorted(ladder, reverse=True), "thresholds must fall from exact over near to possible")
        _need(self.publication_window_hours >= 0 and self.candidate_lookback_days >= 0, "windows must not be negative")
        _need(self.max_candidates > 0, "max_candidates must be positive")


@dataclass
class Taxonomy(Settings):
    """Allowed values of a classification. The default lists."""

    version: str = "taxonomy-v1"
    themes: list[str] = field(default_factory=lambda: ["crowd_management", "traffic_transport", "public_health", "public_safety", "administration", "religious_activity", "infrastructure", "environment"])
    genres: list[str] = field(default_factory=lambda: ["news_report", "government_notice", "advisory", "analysis", "feature"])
    event_types: list[str] = field(default_factory=lambda: ["announcement", "incident", "preparedness", "service_update", "policy_decision", "public_advisory"])
    stakeholder_types: list[str] = field(default_factory=lambda: ["government", "police", "health", "religious_body", "transport", "public", "other"])
    geographies: list[str] = field(default_factory=lambda: ["nashik", "trimbakeshwar", "godavari", "ramkund", "maharashtra", "other"])
    outcomes: list[str] = field(default_factory=lambda: ["announcement", "deployment", "restriction", "funding", "advisory", "service_change", "risk_report"])


@dataclass
class ClassificationConfig(Settings):
    model: str = "auto"
    fallback_models: list[str] = field(default_factory=list)
    timeout_seconds: float = 30.0
    max_retries: int = 2
    retry_backoff_seconds: float = 0.0
    temperature: float = 0.0
    max_tokens: int = 1200
    prompt_version: str = "classification-v1"

    @property
    def models(self) -> list[str]:
        return [self.model, *self.fallback_models]

    def validate(self) -> None:
        _need(self.timeout_seconds > 0, "timeout_seconds must be positive")
        _need(self.max_retries >= 0, "max_retries must not be negative")
        _need(self.retry_backoff_seconds >= 0, "retry_backoff_seconds must not be negative")
        _need(self.max_tokens > 0, "max_tokens must be positive")


@dataclass
class RetryPolicy(Settings):
    max_attempts: int = 3
    backoff_seconds: float = 30
    backoff_multiplier: float = 2.0
    retry_on_statuses: list[int] = field(default_factory=lambda: [408, 429, 500, 502, 503, 504])

    def validate(self) -> None:
        _need(0 <= self.max_attempts <= 10, "max_attempts must be in 0..10")
        _need(0 <= self.backoff_seconds <= 3600, "backoff_seconds must be in 0..3600")
        _need(1 <= self.backoff_multiplier <= 10, "backoff_multiplier must be in 1..10")
