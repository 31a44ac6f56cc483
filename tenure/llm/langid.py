"""Language identification by a linear-chain conditional random field over words.

Each word has a score for every language from hashed features: the word itself (lexicon), its prefixes and suffixes of up to
three bytes and its 2- and 3-byte n-grams, lower-cased (A-Z). Neighbouring words are tied by learned transition
scores. Forward-backward gives each word's probability of every language, so code-switched text is labelled
word by word; a document's language is the one with the greatest mean probability over its words with letters, and the mean
its score.

The field is fitted on a bounded sample: of the documents with a language that may be learned from, the `sample` whose doc_id hashes
lowest, cut into runs of words; runs of different documents are put in a row, so that transitions are learned, too.
It is fitted by gradient steps on the log-likelihood. Prediction reads whole texts in one pass: long texts are cut into
chunks whose transfer matrices are multiplied, so forward-backward runs over all chunks side by side and is exact.

`und` and score 0 is given where text is null or has no letter, and where there was nothing to learn from.
Rows that repeat are predicted alike. Only text is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.text import BYTE, LOWER, Text, U, Words, flat, hashes, mix, slices, sums

BITS = 15
SLOTS = 1 << BITS
CHUNK = 64


def _features(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of each distinct word in a row, and the words' first slots."""
    data, off = flat(distinct)
    data = LOWER[data]
    length = np.diff(off)
    word = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(data)) - off[:-1][word]
    left = length[word] - place
    lut = BYTE[data]
    one = lut
    two = lut[:-1] * U(3) + lut[1:] if len(lut) > 1 else lut[:0]
    three = two[:-1] * U(5) + lut[2:] if len(lut) > 2 else lut[:0]
    parts = [(hashes(data, off), np.arange(len(length)))]
    for k, h in ((1, one), (2, two), (3, three)):
        fits = np.flatnonzero(left[: len(h)] >= k)
        h, p, rest, w = h[fits], place[fits], left[fits], word[fits]
        if k > 1:
            parts.append((h + U(11 * k), w))
        parts.append((h[p == 0] + U(101 * k), w[p == 0]))
        parts.append((h[rest == k] + U(1009 * k), w[rest == k]))
    slot = (mix(np.concatenate([p[0] for p in parts])) & U(SLOTS - 1)).astype(np.int64)
    owner = np.concatenate([p[1] for p in parts])
    order = np.argsort(owner, kind="stable")
    return slot[order], np.searchsorted(owner[order], np.arange(len(length) + 1))


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # slot x language
    transition: np.ndarray  # from x to

    def emissions(self, distinct: pa.Array) -> np.ndarray:
        """Scores of each distinct word; 0 for all languages where a word has no letter."""
        slot, first = _features(distinct)
        out = np.stack([sums(self.weights[slot, k].astype(np.float64), first) for k in range(len(self.languages))], 1)
        out[~has_letter(distinct)] = 0
        return out


def has_letter(strings: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(strings, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)


def marginals(score: np.ndarray, begin: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Probability of every label at every position; sequences begin where `begin` is true."""
    forward, backward, _ = messages(score, begin, transition)
    out = forward * backward
    return out / out.sum(1, keepdims=True) if len(out) else out


def pair_sums(score: np.ndarray, begin: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marginals, and the expected number of times each label follows each in the same sequence."""
    forward, backward, local = messages(score, begin, transition)
    out = forward * backward
    if not len(out):
        return out, np.zeros_like(transition)
    at = np.flatnonzero(~begin[1:])
    total = np.zeros_like(transition)
    move = np.exp(transition - transition.max())
    for run in np.array_split(at, max(1, len(at) // 100_000)):
        # The forward message holds what is before and at a position, the other what is at and behind the next.
        pair = forward[run][:, :, None] * move * (local[run + 1] * backward[run + 1])[:, None, :]
        total += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    return out / out.sum(1, keepdims=True), total


def messages(score: np.ndarray, begin: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward messages (each with its own position's score), backward messages (without) and scores, all scaled.

    Chunks of CHUNK positions: each chunk's product of transfer matrices first, then the messages between
    chunks, then all chunks side by side.
    """
    n, m = score.shape
    if not n:
        return score, score, score
    move = np.exp(transition - transition.max())
    local = np.exp(score - score.max(1, keepdims=True))
    chunks = -(-n // CHUNK)
    wide = np.ones((chunks * CHUNK, m))
    wide[:n] = local
    starts = np.ones(chunks * CHUNK, bool)
    starts[:n] = begin
    wide, starts = wide.reshape(chunks, CHUNK, m), starts.reshape(chunks, CHUNK)
    unit = np.full((m, m), 1.0 / m)

    def step(matrix, t):
        moved = np.where(starts[:, t, None, None], np.broadcast_to(matrix.sum(2, keepdims=True) / m, matrix.shape), matrix @ move)
        moved = moved * wide[:, t, None, :]
        return moved / moved.sum((1, 2), keepdims=True)

    product = np.broadcast_to(np.eye(m), (chunks, m, m)).copy()
    for t in range(CHUNK):
        product = step(product, t)
    enter = np.empty((chunks, m))
    state = unit[0]
    for c in range(chunks):
        enter[c] = state
        state = state @ product[c]
        state = state / state.sum()
    forward = np.empty((chunks, CHUNK, m))
    state = enter
    for t in range(CHUNK):
        state = np.where(starts[:, t, None], 1.0 / m, state @ move) * wide[:, t]
        state = state / state.sum(1, keepdims=True)
        forward[:, t] = state
    # Backward: what enters a chunk from behind is a linear map of what leaves the next.
    leave = np.empty((chunks, m))
    state = np.ones(m)
    for c in range(chunks - 1, -1, -1):
        leave[c] = state
        state = product[c] @ state
        state = state / state.sum()
    backward = np.empty((chunks, CHUNK, m))
    state = leave
    for t in range(CHUNK - 1, -1, -1):
        backward[:, t] = state
        carried = wide[:, t] * state
        state = np.where(starts[:, t, None], carried.sum(1, keepdims=True), carried @ move.T)
        state = state / state.sum(1, keepdims=True)
    return forward.reshape(-1, m)[:n], backward.reshape(-1, m)[:n], local


def fit(learn: DataFrame, sample: int = 1200, words_each: int = 120, passes: int = 25, run: int = 24) -> Field | None:
    """Fit on at most `sample` rows of learn(doc_id, text, lang), and `words_each` words of each that lie spread over its text.

    Every language has an equal share of the rows (at least one row, at most all it has and 1000), those of the lowest hashes.
    """
    known = learn.filter("text is not null and lang is not null").withColumn("_hash", F.xxhash64("doc_id", "text"))
    counts = [r["count"] for r in known.groupBy("lang").count().collect()]
    # Spark cuts ranks of up to 1000 off before rows meet.
    share = max([1, *(k for k in range(1, min(sample, 1000) + 1) if sum(min(n, k) for n in counts) <= sample)])
    # Hashes are chosen first, so that no more texts than the sample's leave their tasks.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_hash"))
    chosen = known.select("_hash", "lang").withColumn("_rank", rank).filter(F.col("_rank") <= share).select("_hash", "lang").distinct()
    rows = known.join(F.broadcast(chosen), ["_hash", "lang"], "left_semi").dropDuplicates(["_hash", "lang"]).orderBy("_hash", "lang")
    rows = rows.select("text", "lang").toPandas()
    if rows.empty:
        return None
    languages = sorted(set(rows["lang"]))
    words = Words(text := Text(pa.array(rows["text"])))
    label_of = np.array([languages.index(x) for x in rows["lang"]])
    take = []
    rng = np.random.default_rng(7)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        for s in range(max(1, min(words_each, b - a) // run)):
            at = a + (b - a - run) * s // max(1, words_each // run - 1) if b - a > run else a
            take.append(np.arange(at, min(b, at + run)))
    rng.shuffle(take)
    at = np.concatenate(take) if take else np.zeros(0, np.int64)
    if not len(at):
        return Field(languages, np.zeros((SLOTS, len(languages)), np.float32), np.zeros((len(languages),) * 2))
    # Six runs in a row are a sequence.
    edges = np.cumsum([0] + [len(x) for x in take])
    begin = np.zeros(len(at), bool)
    begin[[e for e in edges[:-1:6] if e < len(at)]] = True
    label = label_of[words.row[at]]
    ids, distinct = words.encode()
    used, ids = np.unique(ids[at], return_inverse=True)
    distinct = distinct.take(pa.array(used))
    field = Field(languages, np.zeros((SLOTS, len(languages)), np.float32), np.zeros((len(languages),) * 2))
    slot, first = _features(distinct)
    owner = np.repeat(np.arange(len(distinct)), np.diff(first))
    silent = ~has_letter(distinct)
    truth = np.eye(len(languages))[label]
    seen = np.full(field.weights.shape, 1e-6)
    seen_t = np.full(field.transition.shape, 1e-6)
    followed = np.zeros_like(field.transition)
    inner = np.flatnonzero(~begin[1:])
    np.add.at(followed, (label[inner], label[inner + 1]), 1)
    for _ in range(passes):
        emit = field.emissions(distinct)[ids]
        p, pairs = pair_sums(emit, begin, field.transition)
        gap = p - truth
        per_word = np.stack([np.bincount(ids, weights=gap[:, k], minlength=len(distinct)) for k in range(len(languages))], 1)
        per_word[silent] = 0
        grad = np.stack([np.bincount(slot, weights=per_word[owner, k], minlength=SLOTS) for k in range(len(languages))], 1)
        grad += 1e-3 * len(at) / SLOTS * field.weights
        seen += grad**2
        field.weights -= (0.25 * grad / np.sqrt(seen)).astype(np.float32)
        gap_t = pairs - followed
        gap_t += 1e-2 * len(at) / 100 * field.transition
        seen_t += gap_t**2
        field.transition -= 0.1 * gap_t / np.sqrt(seen_t)
    return field


def label_words(text: Text, field: Field) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of a batch, each word's probabilities, and whether it has a letter."""
    words = Words(text)
    ids, distinct = words.encode()
    begin = np.zeros(len(words), bool)
    begin[words.first[:-1][words.count > 0]] = True
    return words, marginals(field.emissions(distinct)[ids], begin, field.transition), has_letter(distinct)[ids]


def languages(docs: DataFrame, fold: int = 4, held: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_switches (words whose likeliest language differs from the word's before)."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(fold)) == held
    field = docs.sparkSession.sparkContext.broadcast(fit(docs.filter(~held_out).select("doc_id", "text", "lang"), **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for batch in batches:
            for part in slices(batch, 1):
                text = Text(part.column(1))
                pred, score, switches = ["und"] * text.n, np.zeros(text.n), np.zeros(text.n, np.int64)
                if model is not None:
                    words, p, letter = label_words(text, model)
                    mean = np.stack([sums(p[:, k] * letter, words.first) for k in range(p.shape[1])], 1)
                    lettered = sums(letter.astype(np.int64), words.first)
                    best = mean.argmax(1)
                    score = np.where(lettered > 0, mean[np.arange(text.n), best] / np.maximum(1, lettered), 0.0)
                    pred = [model.languages[b] if n else "und" for b, n in zip(best, lettered, strict=True)]
                    likely = p.argmax(1)
                    change = np.zeros(len(words), np.int64)
                    change[1:] = (likely[1:] != likely[:-1]) & (words.row[1:] == words.row[:-1])
                    switches = sums(change, words.first)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(pred, pa.string()), pa.array(np.minimum(1.0, score)), pa.array(switches)],
                    ["doc_id", "held_out", "lang_pred", "score", "n_switches"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_switches long")
