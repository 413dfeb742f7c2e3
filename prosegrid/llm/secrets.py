"""Secret scans: fixed patterns, and character Markov models for what no pattern names.

Two first-order models over the characters of keys, one of random strings and one of ordinary
identifiers, are trained from the labelled samples in ``secret_samples.txt`` (or others), once, by the
driver, and are broadcast. In every run of key characters the stretch of at
least ``LEAST`` characters is sought whose log-likelihood ratio exceeds ``THRESHOLD`` a character
by the most in sum; it is widened to whole pieces between delimiters, and what lies on both sides of
it is searched again. A stretch that holds letters and digits is a secret, whatever names or
paths it is glued to. Stretches that spans of the fixed patterns cover wholly are left to them.

Spans are (kind, start, end) in code points, end exclusive.

Defined cases: null and empty texts have no spans; an empty table gives no rows; columns named
like an output column are dropped; texts are scanned whole, at any length.
"""

from __future__ import annotations

import functools
import pkgutil
import re
import string
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.base import arrow_map, extended, without

KINDS = ("assign", "access", "hex", "random")
ADDED = ("n_assign", "n_access", "n_hex", "base_spans", "spans")
THRESHOLD = 0.7  # nats a character
LEAST, WINDOW = 20, 64
DELIMITER = re.compile("[/_=-]")
ALPHABET = string.ascii_letters + string.digits + "+/_=-"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # a maximal run, as [0-9a-f]+ would find it
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by start, then by kind."""
    out = []
    if any(hint in text.lower() for hint in ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def labelled_samples() -> list[tuple[str, bool]]:
    """(string, whether it is random): 4,000 keys in common encodings, and 4,000 identifiers."""
    lines = pkgutil.get_data(__package__, "secret_samples.txt").decode().splitlines()
    return [(line[2:], line[0] == "1") for line in lines if not line.startswith("#")]


@dataclass
class Markov:
    """Log probabilities of each character after each other one, for both classes; the last row is the start."""

    ratio: np.ndarray  # log P(random) - log P(ordinary)

    @classmethod
    def train(cls, samples: list[tuple[str, bool]]) -> Markov:
        size = len(ALPHABET)
        logs = []
        for wanted in (True, False):
            counts = np.full((size + 1, size), 0.1)
            for text, label in samples:
                if label == wanted:
                    codes = cls.codes(text)
                    np.add.at(counts, (np.concatenate([[size], codes[:-1]]), codes), 1)
            logs.append(np.log(counts / counts.sum(axis=1, keepdims=True)))
        return cls(logs[0] - logs[1])

    @staticmethod
    def codes(text: str) -> np.ndarray:
        return np.array([c for c in map(ALPHABET.find, text) if c >= 0], np.int64)

    def score(self, text: str) -> float:
        """The log-likelihood ratio a character, of the most random WINDOW characters of the run."""
        codes = self.codes(text)
        if not len(codes):
            return -np.inf
        each = self.ratio[np.concatenate([[len(ALPHABET)], codes[:-1]]), codes]
        if len(each) <= WINDOW:
            return float(each.mean())
        total = np.concatenate([[0.0], np.cumsum(each)])
        return float((total[WINDOW:] - total[:-WINDOW]).max() / WINDOW)


@functools.lru_cache(maxsize=1)
def default_model() -> Markov:
    """The model of the built-in samples; the same on every machine."""
    return Markov.train(labelled_samples())


def looks_random(run: str, model: Markov, threshold: float = THRESHOLD) -> bool:
    return any(map(str.isdigit, run)) and any(map(str.isalpha, run)) and model.score(run) > threshold


def stretches(run: str, model: Markov, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """The random stretches of a run, in order; they do not overlap."""
    codes = model.codes(run)
    excess = model.ratio[np.concatenate([[len(ALPHABET)], codes[:-1]]), codes] - threshold
    total = np.concatenate([[0.0], np.cumsum(excess)])
    cuts = [0, *(m.end() for m in DELIMITER.finditer(run)), len(run)]  # pieces end with their delimiter
    out, open_ = [], [(0, len(run))]
    while open_:
        low, high = open_.pop()
        if high - low < LEAST:
            continue
        gain = total[low + LEAST : high + 1] - np.minimum.accumulate(total[low : high + 1 - LEAST])
        end = int(np.argmax(gain))
        if gain[end] <= 0:
            continue
        start = low + int(np.argmin(total[low : low + end + 1]))
        end += low + LEAST
        first, last = bisect_right(cuts, start) - 1, bisect_left(cuts, end)
        # Pieces beside it that are as likely random as not belong to it: keys may hold delimiters.
        plain = lambda k: total[(to := cuts[k + 1] - (cuts[k + 1] < len(run)))] - total[cuts[k]] + threshold * (to - cuts[k]) < 0
        while first > 0 and cuts[first] > low and run[cuts[first] - 1] != "=" and not plain(first - 1):
            first -= 1
        while last < len(cuts) - 1 and cuts[last] < high and not plain(last):
            last += 1
        start, end = max(low, cuts[first]), min(high, cuts[last])
        own = run[start:end]
        if any(map(str.isdigit, own)) and any(map(str.isalpha, own)):
            after = end - 1 if end < len(run) and DELIMITER.match(run, end - 1) else end
            out.append((start, after))
        open_ += [(low, start), (end, high)]
    return sorted(out)


def scan(text: str | None, model: Markov) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(spans of the fixed patterns, all spans)."""
    if not text:
        return [], []
    base = base_spans(text)
    more = [("random", m.start() + start, m.start() + end) for m in RUN.finditer(text) for start, end in stretches(m[0], model)]
    if base and more:
        covered: list[tuple[int, int]] = []  # base spans, merged where they touch
        for _, start, end in base:
            if covered and start <= covered[-1][1]:
                covered[-1] = covered[-1][0], max(end, covered[-1][1])
            else:
                covered.append((start, end))
        starts = [start for start, _ in covered]
        more = [x for x in more if not (n := bisect_right(starts, x[1])) or covered[n - 1][1] < x[2]]
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_documents(docs: DataFrame, *, text: str = "text", model: Markov | None = None) -> DataFrame:
    """``docs`` without the text, with counts of the fixed kinds, base_spans and spans (``kind:start:end``, comma-joined)."""
    docs = without(docs, ADDED)
    rest = [c for c in docs.columns if c != text]
    sent = docs.select(*[f"`{c}`" for c in rest], F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())  # a matrix of the alphabet's size
    schema = extended(sent, rest, "n_assign long, n_access long, n_hex long, base_spans string, spans string")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        found = [scan(t.as_py(), model) for t in batch.column(len(rest))]
        numbers = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS[:3]]
        texts = [pa.array([listed(f[k]) for f in found], pa.string()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *numbers, *texts], names=[*rest, *ADDED])

    return arrow_map(sent, make, schema)


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]", model: Markov | None = None) -> DataFrame:
    """``docs`` with every span of the text column replaced by ``mark``; other columns and texts stay as they are."""
    names = docs.columns
    at = names.index(text)
    schema = extended(docs, names)
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    def clean(value: str | None, model: Markov) -> str | None:
        spans = scan(value, model)[1]
        out, done = [], 0
        for _, start, end in spans:
            if end > done:
                out += [value[done:start], mark] if start >= done else []
                done = end
        return "".join([*out, value[done:]]) if spans else value

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        columns = list(batch.columns)
        columns[at] = pa.array([clean(t, model) for t in columns[at].to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays(columns, names=names)

    return arrow_map(docs, make, schema)
