"""Analyzers: payload frame -> payload frame with one more result in segmented_data.

Models are plug-ins behind ``Predictor``: a function that is called once per worker and returns a
function from a batch of texts to a batch of results. Cheap JVM filters belong before an analyzer,
as Python functions are not moved over them. The built-in predictors are small and
deterministic; their shapes are those of real models, their scores are not. ``max_length`` is for models
with a limit; ``max_length=None`` does not truncate, which is how the registered queries run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.functions import pii, sentiment
from prosegrid.operators import aggregate as aggregation
from prosegrid.operators import split as splitting
from prosegrid.schema import ENTITY, SEGMENTS, with_segment

MAX_LENGTH = 510
Predictor = Callable[[], Callable[[list[str]], list]]


def predicted(text: Column, predictor: Predictor, kind: str, batch_size: int = -1, max_length: int | None = MAX_LENGTH) -> Column:
    """The predictor's results as a column; the model is loaded once per task and sees ``batch_size`` texts at a time."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = predictor()
        for texts in batches:
            own = [t or "" for t in texts]
            step = batch_size if batch_size > 0 else max(1, len(own))
            yield pd.Series([x for at in range(0, len(own), step) for x in predict(own[at : at + step])], dtype=object)

    return run(F.substring(text, 1, max_length) if max_length else text)


@dataclass
class AnalyzerConfig:
    """With ``use_splitter_and_aggregator`` the text is split first and the chunks' results are aggregated."""

    use_splitter_and_aggregator: bool = False
    splitter_config: splitting.SplitterConfig | None = None
    aggregate_function: object | None = None

    def __post_init__(self) -> None:
        if self.use_splitter_and_aggregator and self.splitter_config is None:
            raise ValueError("use_splitter_and_aggregator needs a splitter_config")


@dataclass
class ClassifierConfig(AnalyzerConfig):
    labels: Sequence[str] | None = None
    label_map: dict[str, str] | None = None
    multi_class_classification: bool = True
    add_positive_negative_labels: bool = True

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.labels is None:
            self.multi_class_classification = self.add_positive_negative_labels = False


def _split_first(payloads: DataFrame, config: AnalyzerConfig | None, analyze: Callable[[DataFrame], DataFrame]) -> DataFrame:
    if config is None or not config.use_splitter_and_aggregator:
        return analyze(payloads)
    return aggregation.aggregate(analyze(splitting.split(payloads, config.splitter_config)), config.aggregate_function)


def dummy(payloads: DataFrame, data: str | None = None) -> DataFrame:
    return with_segment(payloads, "dummy_data", F.lit(data))


def classify(payloads: DataFrame, predictor: Predictor, config: ClassifierConfig | None = None, batch_size: int = -1, max_length: int | None = MAX_LENGTH) -> DataFrame:
    """One label and score a text; ``label_map`` renames labels."""
    names = (config.label_map if config else None) or {}

    def analyze(rows: DataFrame) -> DataFrame:
        found = predicted(F.col("processed_text"), _renamed(predictor, names), SEGMENTS["classifier_data"], batch_size, max_length)
        return with_segment(rows, "classifier_data", found)

    return _split_first(payloads, config, analyze)


def _renamed(predictor: Predictor, names: dict[str, str]) -> Predictor:
    def load() -> Callable[[list[str]], list]:
        predict = predictor()
        return lambda texts: [{names.get(label, label): float(score) for label, score in own.items()} for own in predict(texts)]

    return load


def zero_shot(payloads: DataFrame, config: ClassifierConfig, predictor: Callable[[Sequence[str], bool], Predictor] | None = None, batch_size: int = -1, max_length: int | None = MAX_LENGTH) -> DataFrame:
    """Scores of all given labels for each text."""
    if config is None:
        raise ValueError("zero-shot classification needs a config")
    labels = list(config.labels or [])
    if config.add_positive_negative_labels:
        labels += [x for x in ("positive", "negative") if x not in labels]
    if not labels:
        raise ValueError("zero-shot classification needs labels")
    made = (predictor or keyword_overlap)(labels, config.multi_class_classification)

    def analyze(rows: DataFrame) -> DataFrame:
        return with_segment(rows, "classifier_data", predicted(F.col("processed_text"), made, SEGMENTS["classifier_data"], batch_size, max_length))

    return _split_first(payloads, config, analyze)


def zero_shot_sentiment(payloads: DataFrame, predictor: Callable[[Sequence[str], bool], Predictor] | None = None, config: AnalyzerConfig | None = None, batch_size: int = -1, max_length: int | None = MAX_LENGTH) -> DataFrame:
    base = config or AnalyzerConfig()
    own = ClassifierConfig(base.use_splitter_and_aggregator, base.splitter_config, base.aggregate_function, labels=["positive", "negative"], multi_class_classification=False, add_positive_negative_labels=False)
    return zero_shot(payloads, own, predictor, batch_size, max_length)


def lexicon_sentiment(payloads: DataFrame, *, rules: bool = True) -> DataFrame:
    """{positive, negative} from the compound score; ``rules=False`` stays in the JVM."""
    score = sentiment.compound_of(F.col("processed_text")) if rules else sentiment.lexicon_compound(F.col("processed_text"))
    scored = payloads.withColumn("__score", score)
    return with_segment(scored, "classifier_data", sentiment.two_sided(F.col("__score"))).drop("__score")


def entities(payloads: DataFrame, predictor: Predictor | None = None, *, batch_size: int = -1, max_length: int | None = MAX_LENGTH) -> DataFrame:
    """Named entities of each text; ``max_length=None`` does not truncate."""
    return with_segment(payloads, "ner_data", predicted(F.col("processed_text"), predictor or pattern_entities, f"array<{ENTITY}>", batch_size, max_length))


def translate(payloads: DataFrame, predictor: Predictor, *, batch_size: int = -1, max_length: int | None = MAX_LENGTH) -> DataFrame:
    """The text replaced by its translation; the whole original is kept."""
    new = payloads.withColumn("__new", predicted(F.col("processed_text"), predictor, "string", batch_size, max_length))
    kept = with_segment(new, "translation_data", F.struct(F.col("processed_text").alias("original_text")))
    return kept.withColumn("processed_text", F.col("__new")).drop("__new")


@dataclass
class PIIConfig:
    anonymizers: dict[str, pii.Operator] | None = None
    entities: Sequence[str] | None = None
    analyze_only: bool = False
    replace_original_text: bool = True


def personal_data(payloads: DataFrame, config: PIIConfig, *, recognizers: Sequence[pii.Recognizer] | None = None, anonymizers: dict[str, pii.Operator] | None = None) -> DataFrame:
    """Personal data of each text; unless only analyzed, it is anonymized with the config's operators, else the analyzer's."""
    if config is None:
        raise ValueError("personal data analysis needs a config")
    found = pii.pii_column(F.col("processed_text"), recognizers, config.anonymizers or anonymizers, config.entities, config.analyze_only)
    out = payloads.withColumn("__pii", found)
    if config.replace_original_text:
        out = with_segment(out, "pii_data", F.col("__pii")).withColumn("processed_text", F.coalesce("__pii.anonymized_text", "processed_text"))
    else:
        out = with_segment(out, "pii_data", F.col("__pii"))
    return out.drop("__pii")


def keyword_overlap(labels: Sequence[str], multi: bool) -> Predictor:
    """Zero-shot stand-in: smoothed share of a label's words (sentiment labels: the lexicon) found in the text."""
    own = list(labels)

    def load() -> Callable[[list[str]], list[dict[str, float]]]:
        def one(text: str) -> dict[str, float]:
            words = set(re.findall(r"\w+", text.lower()))
            score = sentiment.compound(text)
            raw = {}
            for label in own:
                parts = set(re.findall(r"\w+", label.lower()))
                raw[label] = {"positive": (1 + score) / 2, "negative": (1 - score) / 2}.get(label, (len(parts & words) + 0.1) / (len(parts) + 0.2))
            total = sum(raw.values())
            return raw if multi else {k: v / total for k, v in raw.items()}

        return lambda texts: [one(t) for t in texts]

    return load


def pattern_entities() -> Callable[[list[str]], list[list[dict]]]:
    """Entity stand-in: runs of capitalized words after the first word, numbers and dates."""
    patterns = [("DATE", r"\b\d{4}-\d{2}-\d{2}\b"), ("MISC", r"\b[A-Z][\w&]*(?: [A-Z][\w&]*)+|(?<=[a-z,] )[A-Z][a-z]+")]

    def one(text: str) -> list[dict]:
        found = [{"entity_group": g, "word": m[0], "start": m.start(), "end": m.end(), "score": 0.5} for g, p in patterns for m in re.finditer(p, text)]
        return sorted(found, key=lambda e: e["start"])

    return lambda texts: [one(t) for t in texts]


def dictionary_translator(words: dict[str, str]) -> Predictor:
    """Translation stand-in: word by word."""

    def load() -> Callable[[list[str]], list[str]]:
        return lambda texts: [re.sub(r"\w+", lambda m: words.get(m[0].lower(), m[0]), t) for t in texts]

    return load


@dataclass
class Analyzer:
    """A named analyzer for pipelines and configuration files."""

    apply: Callable[[DataFrame], DataFrame]
    options: dict = field(default_factory=dict)

    def __call__(self, payloads: DataFrame) -> DataFrame:
        return self.apply(payloads, **self.options)
