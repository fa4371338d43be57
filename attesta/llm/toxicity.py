"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding: lower case, look-alike letters and digit substitutions to the letters meant, zero-width characters removed,
everything between words to a space. Terms are whole words (" word ") and beginnings of words (" wor"); in a word only
its longest term counts. A match within an exception phrase (two neighbouring words that labelled clean documents use)
doesn't count.

Learning takes a sample of labelled rows, at most ``SAMPLE`` a class, those of least hash (never rows of the held-out
third); equal texts count once. Term weights are log-odds of document frequencies; exceptions are counted next; the
score is a logistic function of the summed weights, absolute and by length, fitted on the sample.

Edge cases: null texts are empty; empty texts have the score of no match; a null doc_id isn't held out; labels that
repeat a doc_id count as toxic if one says so; without both classes every score is the share of toxic labels or 0;
repeated rows give repeated results; texts of any length are folded and matched whole, in batches of few rows; an
empty table gives an empty one; further columns are kept by ``reject`` and ignored by ``score``.

How large the lexicon can be follows from the sample alone: a term is in ``SHARE`` of the toxic sample's documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_batches, short_batches, table, written

SAMPLE = 6000  #: labelled rows of a class that learning takes at most
SHARE = 0.02  #: of the toxic sample's documents must hold a term
LEAST = 5  #: documents that must hold a term or phrase
WEIGHT = 3.0  #: least log-odds of a term
THRESHOLD = 0.7
PREFIXES = range(4, 9)  #: lengths of beginnings of words

# Letters and digits that stand for others.
LOOKS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i",
}
ZERO_WIDTH = "​‌‍⁠﻿­"


class _Fold(dict):
    """Table for str.translate, filled as characters turn up."""

    def __missing__(self, c: int) -> int | str | None:
        ch = chr(c)
        to = LOOKS.get(ch)
        if to is None:
            to = None if ch in ZERO_WIDTH else (LOOKS.get(chr(c - 0xFEE0).lower(), chr(c - 0xFEE0).lower()) if 0xFF21 <= c <= 0xFF5A else ch) if ch.isalnum() else " "
        self[c] = to
        return to


_fold = _Fold()
_CLOSING = re.compile(r"!+(?!\w)")


def fold(text: str | None) -> str:
    """Folded text with a space at both ends. A closing "!" is punctuation; within a word it is an i."""
    t = (text or "").lower()
    if "!" in t:
        t = _CLOSING.sub(" ", t)
    return f" {t.translate(_fold)} "


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coef: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = None  #: the score of all, where nothing could be learnt
    _automaton: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self) -> ahocorasick.Automaton | None:
        if self._automaton is None and (self.terms or self.exceptions):
            a = ahocorasick.Automaton()
            for t, w in self.terms.items():
                a.add_word(t, (len(t), w))
            for t in self.exceptions:
                a.add_word(t, (len(t), None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def matches(self, folded: str) -> dict[int, tuple[int, float]]:
        """Start of each word that counts: its longest term's length and weight."""
        out: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        if (a := self.automaton()) is None:
            return out
        for end, (n, w) in a.iter(folded):
            start = end + 1 - n
            if w is None:
                spared.append((start, end))
            elif n > out.get(start, (0, 0.0))[0]:
                out[start] = (n, w)
        for lo, hi in spared:
            for s in [s for s in out if lo <= s < hi]:
                del out[s]
        return out

    def features(self, folded: str) -> tuple[float, float]:
        total = sum(w for _, w in self.matches(folded).values())
        return math.log1p(total), math.log1p(1000 * total / (len(folded) + 100))

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        x, y = self.features(fold(text))
        z = self.coef[0] + self.coef[1] * x + self.coef[2] * y
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def _terms(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in PREFIXES if n < len(w))
    return out


def _counts(sample: DataFrame, of) -> DataFrame:
    """(term, toxic, clean): documents of each class with the terms that ``of`` finds in a folded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                seen[label].update(of(fold(text)))
        names = list(seen[0] | seen[1])
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield batch(term=pa.array(part, pa.string()), toxic=pa.array([seen[1][t] for t in part], pa.int64()), clean=pa.array([seen[0][t] for t in part], pa.int64()))

    return sample.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients by Newton's method with a small ridge; both classes weigh alike."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    b = np.zeros(x.shape[1])
    r = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + r + 1e-9 * np.eye(len(b)), x.T @ (w * (y - p)) - r @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the labelled rows that aren't held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * sample rows of two numbers
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["text", "toxic"])
    rows = written(rows.select("text", "toxic").repartition(16, F.xxhash64("text")), "labelled")
    n = dict(rows.groupBy("toxic").count().collect())
    if not n.get(0) or not n.get(1):
        return Model(constant=1.0 if n.get(1) else 0.0)

    weight = F.log((F.col("toxic") + 0.5) / (n[1] + 1) / ((F.col("clean") + 0.5) / (n[0] + 1)))
    least = max(LEAST, math.ceil(SHARE * n[1]))
    found = _counts(rows, _terms).where(F.col("toxic") >= least).withColumn("w", weight).where(F.col("w") >= WEIGHT).orderBy(F.desc("w"), F.desc("toxic"), "term")
    model = Model({r["term"]: r["w"] for r in found.collect()})  # bounded by the sample

    def phrases(folded: str) -> set[str]:
        out = set()
        for start in model.matches(folded):
            end = folded.find(" ", start + 1)
            word = folded[start : end + 1]
            if start and (before := folded[folded.rfind(" ", 0, start) : start]).strip():
                out.add(before + word)
            after = folded.find(" ", end + 1)
            if after > end + 1:
                out.add(word + folded[end + 1 : after + 1])
        return out

    spared = _counts(rows, phrases).where((F.col("clean") >= LEAST) & (F.col("clean") / n[0] >= 5 * F.col("toxic") / n[1]))
    model.exceptions = [r["term"] for r in spared.orderBy(F.desc("clean"), "term").collect()]  # likewise
    model._automaton = None

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.features(fold(t)) for t in b.column("text").to_pylist()]
            yield batch(x=pa.array([v[0] for v in x]), y=pa.array([v[1] for v in x]), toxic=b.column("toxic"))

    seen = rows.mapInArrow(features, "x double, y double, toxic int").toArrow()  # two numbers for each sampled row
    seen = seen.sort_by([("toxic", "ascending"), ("x", "ascending"), ("y", "ascending")])
    x = np.column_stack([seen.column("x").to_numpy(), seen.column("y").to_numpy()])
    model.coef = tuple(_logistic(x, seen.column("toxic").to_numpy().astype(float)).tolist())
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that taught it

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        s = [known.value.score(t) for t in b.column("text").to_pylist()]
        return batch(doc_id=b.column("doc_id"), score=pa.array(s, pa.float64()), predicted=pa.array([int(x >= threshold) for x in s], pa.int32()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), f, f"doc_id {kind}, score double, predicted int").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below the threshold."""
    known, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array([known.value.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, f, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
