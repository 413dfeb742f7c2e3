"""Objects from configuration: a registry of allowed names instead of imports by path."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import Any

import yaml

REGISTRY: dict[str, Callable] = {}


def allow(name: str, make: Callable) -> None:
    """Lets configuration files build objects by this name."""
    REGISTRY[name] = make


def _standard() -> None:
    from prosegrid.functions import cleaning, pii
    from prosegrid.operators import aggregate, analyze, clean, split
    from prosegrid.sinks import deliver
    from prosegrid.sources import media, reviews, social, web

    own = {
        "SplitterConfig": split.SplitterConfig, "CleanerConfig": clean.CleanerConfig, "AverageScore": aggregate.AverageScore, "MaxCategories": aggregate.MaxCategories,
        "ClassifierConfig": analyze.ClassifierConfig, "AnalyzerConfig": analyze.AnalyzerConfig, "PIIConfig": analyze.PIIConfig, "Operator": pii.Operator,
        "SearchConfig": social.SearchConfig, "AppReviewsConfig": reviews.AppReviewsConfig, "PackageReviewsConfig": reviews.PackageReviewsConfig,
        "NewsConfig": media.NewsConfig, "CrawlerConfig": web.CrawlerConfig, "HttpSink": deliver.http_sink, "LogSink": deliver.log_sink,
        "MessageSink": deliver.message_sink, "TicketSink": deliver.ticket_sink, "IssueSink": deliver.issue_sink, "SearchIndexSink": deliver.SearchIndexSink,
    }
    for kind in ("lower_case", "white_space", "punctuation", "special_characters", "decode_unicode", "date_time", "stemming", "stop_words", "domain_keywords", "substitute"):
        own[kind] = getattr(cleaning, kind)
    for name, make in own.items():
        REGISTRY.setdefault(name, make)


def build(value: Any) -> Any:
    """Records with ``_target_`` become objects, at any depth, inside lists too."""
    if isinstance(value, list):
        return [build(v) for v in value]
    if not isinstance(value, dict):
        return value
    inner = {k: build(v) for k, v in value.items() if k != "_target_"}
    if (name := value.get("_target_")) is None:
        return inner
    _standard()
    if name not in REGISTRY:
        raise ValueError(f"{name!r} is not allowed here")
    return REGISTRY[name](**inner)


class Configuration:
    """A YAML document (or its text already loaded) whose keys are built on demand."""

    def __init__(self, document: dict | str | None = None, *, filename: str | None = None):
        if filename:
            with open(filename, encoding="utf-8") as f:
                document = f.read()
        self.document = yaml.safe_load(document) if isinstance(document, str) else document
        if not isinstance(self.document, dict):
            raise ValueError("a configuration is a mapping")

    def initialize(self, key: str | None = None) -> Any:
        """The object under a key (all without one); a missing key gives None and a warning."""
        if key is None:
            return build(self.document)
        if not self.document.get(key):
            logging.getLogger(__name__).warning("no configuration for %s", key)
            return None
        return build(self.document[key])
