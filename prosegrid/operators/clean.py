"""Text cleaning as one projection over the payload frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.functions import cleaning
from prosegrid.functions.tokens import tokens, word_tokens


@dataclass
class CleanerConfig:
    """The functions to apply in order (None: the standard chain) and the tokenizer (None: the text is one token)."""

    functions: Sequence[cleaning.Cleaner] | None = None
    tokenizer: Callable[[Column], Column] | None = word_tokens
    stop_words_language: str = "english"
    stop_words: Sequence[str] | None = None
    domain_keywords: Sequence[tuple[str, str]] = field(default_factory=list)

    def cleaner(self) -> cleaning.Cleaner:
        if self.functions is not None:
            return cleaning.chain(*self.functions)
        return cleaning.default_chain(self.domain_keywords, self.stop_words, self.stop_words_language)


def cleaned(text: Column, config: CleanerConfig) -> Column:
    return F.array_join(config.cleaner()(tokens(text, config.tokenizer)), " ")


def clean(payloads: DataFrame, config: CleanerConfig | None = None) -> DataFrame:
    """``payloads`` with the cleaned processed_text; the other columns pass through."""
    return payloads.withColumn("processed_text", cleaned(F.col("processed_text"), config or CleanerConfig()))
