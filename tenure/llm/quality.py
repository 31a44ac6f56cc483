"""Quality rules: base rules on counts, then a calibrated logistic regression on hashed n-grams.

Features are the relative frequencies of word unigrams and bigrams and of 3- and 4-byte n-grams, hashed into
tables of `2 ** bits` slots each. The model is fitted on a bounded sample of labelled rows (`sample`: of each kind, the labelled
documents with the smallest hash of doc_id); a fifth of the sample calibrates its score into a probability
by Platt scaling. Scoring is one pass over all documents in Arrow batches, without a shuffle.

Null and empty texts have no words and fail the base rules. Repeated rows are scored alike. Without labels of both
kinds there is no model, and a document that passes the base rules is kept. Columns other than doc_id and
text are ignored. Texts of any length are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm.text import Text, U, Words, flat, grouped, hashes, mix, slices, sums

BASE_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.5
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def base_counts(text: Text, words: Words, ids: np.ndarray, distinct: int) -> dict[str, np.ndarray]:
    """The base columns of every row."""
    per_row = np.diff(text.off)
    points = sums((words.inside & ~_CONTINUES[text.data]).astype(np.int64), text.off)
    repeat = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(words.row[2:] == words.row[:-2]) if len(words) > 2 else np.zeros(0, np.int64)
    if len(at):
        window = (ids[at] * distinct + ids[at + 1]) * distinct + ids[at + 2]
        order, new = grouped(words.row[at], window, text.n)
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        twice = at[order[np.repeat(size >= 2, size)]]
        for k in range(3):
            repeat[twice + k] = 1
    return {
        "n_words": words.count,
        "word_chars": points,
        "n_symbols": sums(_SYMBOL[text.data], text.off),
        "n_dup_lines": _repeated_lines(text, words) if per_row.any() else np.zeros(text.n, np.int64),
        "n_repeat_words": sums(repeat[:-1], words.first),
    }


def _repeated_lines(text: Text, words: Words) -> np.ndarray:
    d, off = text.data, text.off
    feed = d == 10
    first = np.unique(np.concatenate([off[:-1], np.flatnonzero(feed) + 1]))
    first = first[first < len(d)]
    row = np.searchsorted(off, first, "right") - 1
    end = np.append(first[1:], len(d))
    feeds = feed[end - 1]
    # Equal lines differ in their line feed only: drop the feeds, then hash.
    bounds = np.concatenate([[0], np.cumsum(end - first - feeds)])
    value = hashes(d[~feed], bounds)
    line_of_word = np.searchsorted(first, words.start, "right") - 1
    keep = np.zeros(len(first), bool)
    keep[line_of_word] = True
    row, value = row[keep], value[keep]
    _, new = grouped(row, value, text.n)
    return np.bincount(row, minlength=text.n) - np.bincount(row[new], minlength=text.n)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


@dataclass
class Features:
    """Slots of every n-gram occurrence, by family, with the rows' first occurrence of each family."""

    slots: list[np.ndarray]
    firsts: list[np.ndarray]


def features(text: Text, words: Words, ids: np.ndarray, distinct: pa.Array, bits: int) -> Features:
    mask = U((1 << bits) - 1)
    value = hashes(*flat(distinct))[ids] if len(ids) else np.zeros(0, np.uint64)
    slots, firsts = [(value & mask).astype(np.int64)], [words.first]
    pair = np.flatnonzero(words.row[1:] == words.row[:-1]) if len(words) > 1 else np.zeros(0, np.int64)
    slots.append((mix(value[pair] * U(3) + value[pair + 1]) & mask).astype(np.int64))
    firsts.append(np.searchsorted(words.row[pair], np.arange(text.n + 1)))
    d = text.data.astype(np.uint64)
    for size in (3, 4):
        n = max(0, len(d) - size + 1)
        code = d[:n].copy()
        for k in range(1, size):
            code = (code << U(8)) | d[k : k + n]
        # The last bytes of a row would run into the next: count them to no row.
        begin = np.minimum(text.off, n)
        slot = ((code * U(0x9E3779B97F4A7C15)) >> U(64 - bits)).astype(np.int64)
        inside = np.ones(n, bool)
        for k in range(1, size):
            cut = text.off[1:] - k
            inside[cut[(cut >= 0) & (cut < n)]] = False
        taken = np.concatenate([[0], np.cumsum(inside)])
        slots.append(slot[inside])
        firsts.append(taken[begin])
    return Features(slots, firsts)


@dataclass
class Model:
    """Weights of each family's slots, the intercept, and the slope and shift of the calibration."""

    weights: np.ndarray
    intercept: float
    slope: float
    shift: float
    bits: int

    def probability(self, f: Features) -> np.ndarray:
        total = np.full(len(f.firsts[0]) - 1, self.intercept)
        for w, slot, first in zip(self.weights, f.slots, f.firsts, strict=True):
            total += SCALE * sums(w[slot].astype(np.float64), first) / np.maximum(1, np.diff(first))
        return 1 / (1 + np.exp(-np.clip(self.slope * total + self.shift, -40, 40)))


#: Relative frequencies times this are the inputs of the regression.
SCALE = 30.0


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1400, bits: int = 16, passes: int = 50) -> Model | None:
    """Fit on at most `sample` labelled documents, half of each kind, those whose doc_id hashes lowest.

    Of rows that repeat a doc_id, the one whose text hashes lowest counts, so what reaches the driver has a bound.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good, bad = (known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for q in (1, 0))
    chosen = good.unionByName(bad)
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "quality")
        .mapInArrow(_sparse(bits), "doc_id long, quality int, slot binary, value binary")
        .orderBy("doc_id")
        .toPandas()
    )
    if rows.empty or rows["quality"].nunique() < 2:
        return None
    size = np.array([len(x) // 4 for x in rows["slot"]])
    slot, value = (np.frombuffer(b"".join(rows[c]), t) for c, t in (("slot", np.int32), ("value", np.float32)))
    y = rows["quality"].to_numpy(float)
    del rows
    held = np.arange(len(y)) % 5 == 0
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held[:] = False
    row = np.repeat(np.arange(len(y), dtype=np.int32), size)
    first = np.concatenate([[0], np.cumsum(size)])
    w, b = np.zeros(4 << bits), 0.0
    seen, seen_b = np.full(len(w), 1e-8), 1e-8
    # Both kinds of rows weigh the same in the fit.
    weight = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * ~held
    for _ in range(passes):
        p = 1 / (1 + np.exp(-np.clip(sums(value * w[slot], first) + b, -40, 40)))
        g = (p - y) * weight
        grad = np.bincount(slot, weights=value * g[row], minlength=len(w)) + 1e-6 * w
        seen += grad**2
        seen_b += g.sum() ** 2
        w -= 0.3 * grad / np.sqrt(seen)
        b -= 0.3 * g.sum() / np.sqrt(seen_b)
    score = sums(value * w[slot], first) + b
    on = held if held.any() else np.ones(len(y), bool)
    slope, shift = _platt(score[on], y[on])
    return Model(w.reshape(4, -1).astype(np.float32), b, slope, shift, bits)


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps of the regression of y, with smoothed targets, on the score."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x = np.stack([score, np.ones_like(score)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0]))
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def _sparse(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                text = Text(part.column(1))
                words = Words(text)
                f = features(text, words, *words.encode(), bits)
                slots, values = [], []
                for r in range(text.n):
                    s, v = [], []
                    for k, (slot, first) in enumerate(zip(f.slots, f.firsts, strict=True)):
                        u, c = np.unique(slot[first[r] : first[r + 1]], return_counts=True)
                        s.append((u + (k << bits)).astype(np.int32))
                        v.append((SCALE * c / max(1, c.sum())).astype(np.float32))
                    slots.append(np.concatenate(s).tobytes())
                    values.append(np.concatenate(v).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2).cast(pa.int32()), pa.array(slots, pa.binary()), pa.array(values, pa.binary())],
                    ["doc_id", "quality", "slot", "value"],
                )

    return run


def judge(text: Text, model: Model | None) -> dict[str, np.ndarray]:
    """Base columns, base_failed, probability and kept of every row."""
    words = Words(text)
    ids, distinct = words.encode()
    out = base_counts(text, words, ids, len(distinct))
    out["base_failed"] = base_failed(out)
    p = np.ones(text.n) if model is None else model.probability(features(text, words, ids, distinct, model.bits))
    out["quality_score"] = p
    out["kept"] = ~out["base_failed"] & (p >= THRESHOLD)
    return out


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, the base columns, base_failed, kept and quality_score."""
    spark: SparkSession = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, **options))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                out = judge(Text(part.column(1)), model.value)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(out[n]) for n in names)], ["doc_id", *names])

    schema = f"doc_id long, {BASE_COLUMNS}, base_failed boolean, kept boolean, quality_score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(judge(Text(part.column(at)), model.value)["kept"]))

    return docs.mapInArrow(run, docs.schema)
