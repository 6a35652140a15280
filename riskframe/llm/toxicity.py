"""Severity of toxic text by cumulative-link ordinal regression.

A text is the set of its words and their beginnings.  One weight for each, shared by all thresholds,
gives a score s; ordered cuts turn it into grades, P(grade <= k) = sigmoid(cut_k - s).
The expected grade is the severity.

Labels say only whether a text is toxic, so grades above 0 are made for the fit: the
toxic texts of the sample are ranked by how many words they have that mark toxic
texts, and cut into equal parts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents the model is fitted on, in expectation: toxic ones and others.
SAMPLE_TOXIC, SAMPLE_OTHER = 2500, 5000
#: Grades: 0 for not toxic, then equal parts of the toxic ones.
GRADES = 4
#: A word is a feature if this many texts of the sample have it, and its share among
#: toxic texts is above that among the others by so many standard errors.
LEAST_TEXTS, LEAST_Z = 5, 4.0
STEPS, RATE, PENALTY = 300, 0.1, 1e-4

#: Letters of the beginnings of words, which stand for the word's inflections.
PREFIX = 4

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """Features of a text: its words, and the beginnings of the longer ones."""
    found = set(_WORD.findall((text or "").lower()))
    return found | {"^" + w[:PREFIX] for w in found if len(w) > PREFIX}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    cuts: list[float] = field(default_factory=list)  # ascending; one fewer than grades

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """Of each grade (column); without cuts all is grade 0."""
        below = _sigmoid(np.array(self.cuts)[None, :] - scores[:, None])
        return np.diff(np.hstack([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))]), axis=1)

    def score(self, text: str | None) -> float:
        return sum(self.weights[w] for w in self.weights.keys() & words(text))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, features: int, levels: int, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) by Adam on the mean log-likelihood less a ridge penalty.
    ``rows`` hold the feature numbers of each text; cuts stay ordered because the
    gaps between them are exponentials."""
    n = len(rows)
    index = np.concatenate(rows).astype(np.int64) if n else np.empty(0, np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    share = np.cumsum(np.bincount(grades, minlength=levels))[:-1] / max(1, n)
    start = np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1))
    first, gaps = start[:1], np.log(np.maximum(np.diff(start), 1e-2))
    x = np.concatenate([np.zeros(features), first, gaps])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, cuts = x[:features], x[features] + np.append(0, np.cumsum(np.exp(x[features + 1:])))
        s = np.bincount(owner, weights=w[index], minlength=n)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        high, low = _sigmoid(edges[grades + 1] - s), _sigmoid(edges[grades] - s)
        p = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high) / p, low * (1 - low) / p
        g_s = high + low - 1  # derivative of the log-likelihood by the score
        g_w = np.bincount(index, weights=g_s[owner], minlength=features) / n
        g_cut = np.zeros(levels - 1)
        np.add.at(g_cut, grades[grades < levels - 1], slope_high[grades < levels - 1])
        np.add.at(g_cut, grades[grades > 0] - 1, -slope_low[grades > 0])
        g_cut /= n
        later = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([g_w - 2 * penalty * w, later[:1], later[1:] * np.exp(x[features + 1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:features], x[features] + np.append(0, np.cumsum(np.exp(x[features + 1:])))


def fit_texts(texts: list[str], toxic: list[bool], levels: int = GRADES) -> Model:
    """A model from labelled texts; equal texts count once.  Without texts of both
    kinds there is nothing to learn, and everything is grade 0."""
    pairs = sorted(dict(zip(texts, toxic)).items())
    sets = [words(t) for t, _ in pairs]
    bad = np.array([y for _, y in pairs], dtype=bool)
    if not bad.any() or bad.all():
        return Model()
    yes, no = Counter(w for s, y in zip(sets, bad) if y for w in s), Counter(w for s, y in zip(sets, bad) if not y for w in s)
    n1, n0 = int(bad.sum()), int((~bad).sum())
    z = {}
    for w in yes.keys() | no.keys():
        a, b = yes[w], no[w]
        if a + b >= LEAST_TEXTS:
            p = (a + b + 1) / (n1 + n0 + 2)
            z[w] = (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    number = {w: i for i, w in enumerate(sorted(w for w in z if z[w] >= LEAST_Z))}
    marks = np.array([len(s & number.keys()) for s in sets])
    grades = np.zeros(len(sets), dtype=np.int64)
    ranked = np.flatnonzero(bad)[np.argsort(marks[bad], kind="stable")]
    grades[ranked] = 1 + np.arange(len(ranked)) * (levels - 1) // len(ranked)
    rows = [np.array(sorted(number[w] for w in s & number.keys()), dtype=np.int64) for s in sets]
    weights, cuts = fit_ordinal(rows, grades, len(number), levels)
    return Model({w: float(weights[i]) for w, i in number.items()}, cuts.tolist())


def held_out(id_col):
    """Documents that no fit sees, for measuring it."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_toxic: int = SAMPLE_TOXIC, sample_other: int = SAMPLE_OTHER) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out,
    taken by a hash of the id; rows with a null id, label or text teach nothing."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).alias("bad"))
    counts = {r["bad"]: r["n"] for r in known.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("bad"), min(1.0, sample_toxic / max(1, counts.get(True, 0)))).otherwise(min(1.0, sample_other / max(1, counts.get(False, 0))))
    place = F.pmod(F.xxhash64("id", F.lit("toxicity sample")), F.lit(1 << 30))
    chosen = known.where(place < share * (1 << 30)).limit(2 * (sample_toxic + sample_other))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").collect()
    rows.sort(key=lambda r: (r["id"], r["text"], r["bad"]))
    return fit_texts([r["text"] for r in rows], [r["bad"] for r in rows])


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``severity`` (expected grade), ``grade`` (the most
    probable one, the lower of equals) and ``toxic`` (grade 0 is less probable than
    the others together).

    Null texts count as empty and have no words; repeated rows are graded each; an
    empty table gives no rows; other columns are ignored.  Whole texts are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probabilities(np.array([model.score(t.as_py()) for t in batch.column(1)], dtype=float))
            expected = p @ np.arange(p.shape[1], dtype=float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(expected), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] < 0.5)],
                names=["id", "severity", "grade", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, severity double, grade int, toxic boolean").withColumnRenamed("id", id_col)
