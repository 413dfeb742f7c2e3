"""Personal data: a registry of pattern recognizers and anonymization operators."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in the common subset of the regular expression dialects, with their scores.
PATTERNS = {
    "EMAIL_ADDRESS": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 1.0),
    "IP_ADDRESS": (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", 0.6),
    "PHONE_NUMBER": (r"(?<![\w.])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]?\d{4}(?!\w)", 0.75),
    "CREDIT_CARD": (r"\b(?:\d[ -]?){12,18}\d\b", 0.9),
    "URL": (r"https?://[^\s<>\"']+", 0.6),
    "PERSON": (r"\b(?:Mr|Mrs|Ms|Dr)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?|(?<=[Mm]y name is )[A-Z][a-z]+(?: [A-Z][a-z]+)?", 0.85),
}
Span = tuple[str, int, int, float]


def _luhn(digits: str) -> bool:
    own = [int(c) for c in digits if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(own)) % 10 == 0


@dataclass
class Recognizer:
    entity: str
    pattern: str
    score: float = 0.85
    accept: Callable[[str], bool] | None = None

    def spans(self, text: str) -> list[Span]:
        return [(self.entity, m.start(), m.end(), self.score) for m in re.finditer(self.pattern, text) if self.accept is None or self.accept(m[0])]


def default_recognizers() -> list[Recognizer]:
    checks = {"CREDIT_CARD": _luhn, "IP_ADDRESS": lambda t: all(int(p) < 256 for p in t.split("."))}
    return [Recognizer(k, p, s, checks.get(k)) for k, (p, s) in PATTERNS.items()]


@dataclass
class Operator:
    """What takes an entity's place: replace (by new_value or <ENTITY>), redact, mask, hash or keep."""

    kind: str = "replace"
    params: dict = field(default_factory=dict)

    def apply(self, text: str, entity: str) -> str:
        if self.kind == "replace":
            return self.params.get("new_value") or f"<{entity}>"
        if self.kind == "redact":
            return ""
        if self.kind == "keep":
            return text
        if self.kind == "hash":
            return hashlib.new(self.params.get("hash_type", "sha256"), text.encode()).hexdigest()
        if self.kind == "mask":
            n = min(len(text), self.params.get("chars_to_mask", len(text)))
            mark = self.params.get("masking_char", "*") * n
            return text[: len(text) - n] + mark if self.params.get("from_end", True) else mark + text[n:]
        raise ValueError(f"no such operator: {self.kind!r}")


def recognize(text: str | None, recognizers: Sequence[Recognizer], entities: Sequence[str] | None = None) -> list[Span]:
    """Spans by start; of overlapping ones the higher score wins, then the longer."""
    found = [s for r in recognizers if entities is None or r.entity in entities for s in r.spans(text or "")]
    kept: list[Span] = []
    for span in sorted(found, key=lambda s: (-s[3], s[1] - s[2], s[1])):
        if all(span[2] <= k[1] or k[2] <= span[1] for k in kept):
            kept.append(span)
    return sorted(kept, key=lambda s: s[1])


def anonymize(text: str, spans: Sequence[Span], operators: dict[str, Operator] | None = None) -> tuple[str, list[Span]]:
    """The text with every span replaced, and the spans of the replacements; DEFAULT covers unnamed entities."""
    out, items, done, size = [], [], 0, 0
    for entity, start, end, score in spans:
        operator = (operators or {}).get(entity) or (operators or {}).get("DEFAULT") or Operator()
        new = operator.apply(text[start:end], entity)
        out += [text[done:start], new]
        size += start - done
        items.append((entity, size, size + len(new), score))
        size += len(new)
        done = end
    return "".join([*out, text[done:]]), items


def pii_column(text: Column, recognizers: Sequence[Recognizer] | None, operators: dict[str, Operator] | None, entities: Sequence[str] | None, analyze_only: bool) -> Column:
    """The pii_data struct of a text column."""
    span = "array<struct<entity_type:string,start:int,end:int,score:double>>"
    held = list(recognizers or default_recognizers())

    @F.pandas_udf(f"struct<analyzer_result:{span},anonymized_result:{span},anonymized_text:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        names = ("entity_type", "start", "end", "score")
        as_rows = lambda spans: [dict(zip(names, s)) for s in spans]
        out = []
        for t in texts:
            spans = recognize(t, held, entities)
            new, items = (None, None) if analyze_only or not t else anonymize(t, spans, operators)
            out.append({"analyzer_result": as_rows(spans), "anonymized_result": None if items is None else as_rows(items), "anonymized_text": new})
        return pd.DataFrame(out, columns=["analyzer_result", "anonymized_result", "anonymized_text"])

    return run(text)
