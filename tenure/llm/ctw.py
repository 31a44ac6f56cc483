"""Language-model scores by context-tree weighting over the bytes of tokens.

Tokens are the words of the A-Z lower-cased text, then one end. A document is coded byte by byte, every token closed by a
stop byte; a byte is coded in eight binary decisions. Each decision has a context tree of its own over the DEPTH bytes before
it in the document, nearest first, so that contexts reach into the token before (zero bytes before the document's start). A
node keeps how often its decision came out 0 and 1 in training; its Krichevsky-Trofimov estimate is mixed with that of
deeper nodes, half and half at every depth, over all trees: weighting goes from the deepest nodes to the root,
prediction back along a context. Nodes that training never reached are skipped, so what is predicted is a distribution over texts.

All counts are Spark tables that grow with the corpus: documents are dealt to blocks by a hash of their key, and a block
gives each distinct word and each distinct context with its byte once, with its count; both are summed by a
join-free aggregate. Weighting and prediction of the subtrees below the HEAD nearest bytes run over sorted grams, whose
subtrees are bounded by the HEAD; above that they are one aggregate or join for each depth. Only nodes of depth 0 and 1 (at
most 65 535) are broadcast and nothing but totals reaches the driver.

Null texts are empty: one end token. Rows that repeat a doc_id or lack one are scored one by one, as documents of their own
(a null doc_id counts as the empty text for the fold). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.scratch import Scratch, with_key
from tenure.llm.text import Text, Words, slices, sums

DEPTH = 5
#: Grams are dealt by this many nearest bytes of the context, in runs of at least RUN rows.
HEAD, RUN = 3, 1 << 17
BLOCK_BYTES, SLICE, PIECE = 16_000_000, 1 << 21, 1 << 19
#: The log10 probability of a byte is rounded to this part of 1, so that the scores take less disk.
UNITS = 1e11
#: The end token is this word, which no text can hold, and every token is closed by STOP.
END, STOP = "\n", 32


def _slices(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, Text, Words]]:
    """A block's rows in runs of about SLICE bytes of text, with their texts and words."""
    for batch in table.combine_chunks().to_batches():
        for rows in slices(batch, batch.schema.get_field_index("text"), SLICE):
            text = Text(rows.column("text"), lower=True)
            yield rows, text, Words(text)


@dataclass
class Stream:
    """The coded bytes of a batch: DEPTH zero bytes before each row, every token closed by STOP, END as the last one."""

    data: np.ndarray
    off: np.ndarray  # where rows begin, zero bytes included

    @classmethod
    def of(cls, text: Text, words: Words) -> Stream:
        own = sums(words.length + 1, words.first) + DEPTH + 2
        off = np.concatenate([[0], np.cumsum(own)])
        data = np.full(off[-1], STOP, np.uint8)
        data[(off[:-1, None] + np.arange(DEPTH)).ravel()] = 0
        data[off[1:] - 2] = ord(END)
        free = data == STOP
        free[np.cumsum(words.length + 1) + (DEPTH + 2) * words.row + DEPTH - 1] = False
        free[off[1:] - 1] = False
        data[free] = text.data[words.inside]
        return cls(data, off)

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row and packed context (nearest byte highest) with the byte below, of every coded position."""
        for a in range(DEPTH, len(self.data), PIECE):
            b = min(len(self.data), a + PIECE)
            packed = self.data[a:b].astype(np.int64)
            for k in range(1, DEPTH + 1):
                packed |= self.data[a - k : b - k].astype(np.int64) << (8 * (DEPTH + 1 - k))
            low, high = np.searchsorted(self.off, [a, b - 1], "right") - 1
            row = np.repeat(np.arange(low, high + 1), np.diff(np.clip(self.off[low : high + 2], a, b)))
            coded = np.arange(a, b) - self.off[row] >= DEPTH
            yield row[coded], packed[coded]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct contexts with bytes of all parts, ascending, and their summed counts."""
    gram, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(gram, kind="stable")
    gram, count = gram[order], count[order]
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    return gram[first], np.add.reduceat(count, first)


def _part(trains: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct packed contexts and bytes, ascending, and how often training rows have them."""
    code = np.sort(packed * 2 + trains)
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    times = np.diff(np.append(first, len(code))) * (code[first] & 1)
    gram = code[first] >> 1
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    return gram[first], np.add.reduceat(times, first)


def _block_counts(key: tuple, table: pa.Table) -> pa.Table:
    """The distinct words of a block, then its distinct contexts with bytes, and how often training documents have them."""
    strings, times = [pa.array([END])], [np.zeros(1, np.int64)]
    parts, whole = [], 0  # the first part is merged, the others wait until they are as long together
    for rows, text, words in _slices(table):
        trains = ~rows.column("held_out").to_numpy(zero_copy_only=False)
        ids, distinct = words.encode()
        strings.append(distinct)
        times += [np.bincount(ids[trains[words.row]], minlength=len(distinct))]
        times[0] += trains.sum()
        for row, packed in Stream.of(text, words).pieces():
            if not len(row):
                continue
            parts.append(_part(trains[row], packed))
            if sum(len(g) for g, _ in parts[1:]) > whole:
                parts = [_merged(parts)]
                whole = len(parts[0][0])
    gram, count = _merged(parts)
    words = pa.concat_arrays(strings).dictionary_encode()
    told = np.bincount(words.indices.to_numpy(), weights=np.concatenate(times), minlength=len(words.dictionary))
    words = words.dictionary
    return pa.table({
        "block": pa.array(np.full(len(words) + len(gram), key[0].as_py(), np.int32)),
        "word": pa.concat_arrays([words, pa.nulls(len(gram), pa.string())]),
        "gram": pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(gram)]),
        "count": pa.array(np.concatenate([told.astype(np.int64), count])),
    })


def _doc_scores(rest: int, total: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        is_word = pc.is_valid(told["word"])
        words = pc.drop_null(told["word"]).combine_chunks()
        known = pc.filter(told["number"], is_word).to_numpy()
        gram = pc.filter(told["number"], pc.invert(is_word)).to_numpy()
        chance = pc.filter(told["score"], pc.invert(is_word)).to_numpy()
        order = np.argsort(gram)
        gram, chance = gram[order], chance[order]
        return pa.concat_tables([_slice_scores(*x, words, known, gram, chance, rest, total) for x in _slices(docs)])

    return run


def _slice_scores(rows, text: Text, own: Words, words: pa.Array, known: np.ndarray, gram: np.ndarray, chance: np.ndarray, rest: int, total: int) -> pa.Table:
    """Scores of some rows, given their block's words with counts and contexts with chances."""
    ids, distinct = own.encode()
    at = pc.index_in(pa.concat_arrays([distinct, pa.array([END])]), value_set=words)
    if at.null_count:
        raise RuntimeError("a word is missing from its block")
    count = known[at.to_numpy()]
    base = np.log10((count + 1) / rest)
    score = np.zeros(text.n)
    for row, packed in Stream.of(text, own).pieces():
        order = np.argsort(packed)  # neighbours are looked up one after another
        row, packed = row[order], packed[order]
        at = np.minimum(np.searchsorted(gram, packed), len(gram) - 1)
        if not (gram[at] == packed).all():
            raise RuntimeError("a context is missing from its block")
        score += np.bincount(row, weights=chance[at] / UNITS, minlength=text.n)
    each = lambda x: sums(x[:-1][ids], own.first) + x[-1]
    bits = -score * math.log2(10)
    return pa.table({
        "doc_id": rows.column("doc_id"),
        "held_out": rows.column("held_out"),
        "n_tokens": pa.array(own.count + 1),
        "n_known": pa.array(each((count > 0).astype(np.int64))),
        "train_tokens": pa.array(np.full(text.n, total)),
        "base_score": pa.array(each(base)),
        "score": pa.array(score),
        "bits_per_byte": pa.array(bits / np.maximum(1, np.diff(text.off))),
    })


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function above 0, by Stirling's series eight above x."""
    y = x + 8
    below = x.copy()
    for k in range(1, 8):
        below *= x + k
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(below)


@dataclass
class Nodes:
    """Nodes of one depth, in order: their counts, and the logarithm of the weighted probability of their children."""

    zero: np.ndarray
    one: np.ndarray
    below: np.ndarray | None = None

    def __post_init__(self):
        own = log_gamma(self.zero + 0.5) + log_gamma(self.one + 0.5) - log_gamma(self.zero + self.one + 1.0) - math.log(math.pi)
        self.weighted = own if self.below is None else np.logaddexp(own, self.below) - math.log(2)
        self.share = None if self.below is None else 1 / (1 + np.exp(np.clip(self.below - own, -700, 700)))
        total = self.zero + self.one
        #: The chance of a 1; nan where training never came.
        self.kt = np.where(total > 0, (self.one + 0.5) / (total + 1), np.nan)

    def mixed(self, deeper: np.ndarray, up: np.ndarray) -> np.ndarray:
        """The chance at this depth for nodes whose deeper chance and place of the parent are given."""
        kt, share = self.kt[up], self.share[up]
        return np.where(np.isnan(deeper), kt, share * kt + (1 - share) * deeper)


def _parents(key: np.ndarray, nodes: Nodes) -> tuple[np.ndarray, np.ndarray, Nodes]:
    """The distinct keys, each node's place in them, and the parents' nodes."""
    keys, up = np.unique(key, return_inverse=True)
    total = lambda x: np.bincount(up, weights=x, minlength=len(keys))
    return keys, up, Nodes(total(nodes.zero), total(nodes.one), total(nodes.weighted))


def _subtrees(gram: np.ndarray, count: np.ndarray) -> Iterator[tuple]:
    """For each of the eight decisions: the distinct nodes of depth HEAD (head, then prefix in the low byte), their Nodes, each
    gram's place among them, its chance of a 1 there and the bit it has. gram is ascending and holds whole heads."""
    byte = gram & 255
    for bit in range(8):
        # The bits above the decision, with a leading 1; the node is the context with that prefix in its low byte.
        prefix = (1 << bit) + (byte >> (8 - bit))
        value = byte >> (7 - bit) & 1
        key = gram - byte + prefix
        new = np.append(True, key[1:] != key[:-1])
        first, place = np.flatnonzero(new), np.cumsum(new) - 1
        nodes = Nodes(np.add.reduceat(count * (1 - value), first), np.add.reduceat(count * value, first))
        key, chance = key[first], nodes.kt
        where = np.arange(len(key))
        for depth in range(DEPTH - 1, HEAD - 1, -1):
            shift = 8 * (DEPTH - depth)
            keys, up, nodes = _parents((key >> (8 + shift) << (8 + shift)) + (key & 255), nodes)
            where = up[where]
            chance = nodes.mixed(chance, where)
            key = keys
        head = 8 * (DEPTH - HEAD)
        yield (key >> (8 + head) << 8) + (key & 255), nodes, where[place], chance[place], value


def _whole_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches that are sorted by head, joined to runs of at least RUN rows that no head crosses. A head has at most
    256 ** (DEPTH - HEAD + 1) grams, whatever the corpus."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < RUN:
            continue
        # The last head may go on; where it began in this batch, what lies before it is whole.
        head = batch.column("head").to_numpy()
        cut = int(np.searchsorted(head, head[-1]))
        if cut:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held, rows = [batch.slice(cut)], batch.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _head_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of depth HEAD with their counts and the logarithm of their weighted probability."""
    for run in _whole_heads(batches):
        for node, own, *_ in _subtrees(run["key"].to_numpy(), run["count"].to_numpy()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(own.zero.astype(np.int64)), pa.array(own.one.astype(np.int64)), pa.array(own.weighted)],
                ["node", "zero", "one", "weighted"],
            )


def _run_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of grams, from runs that also hold the coefficients of their nodes of depth HEAD."""
    for run in _whole_heads(batches):
        is_node = pc.is_null(run["count"])
        above, grams = run.filter(is_node), run.filter(pc.invert(is_node))
        nodes, a, b = above["key"].to_numpy(), above["a"].to_numpy(), above["b"].to_numpy()
        gram = grams["key"].to_numpy()
        score = np.zeros(len(gram))
        for node, _, place, chance, value in _subtrees(gram, grams["count"].to_numpy()):
            at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
            if not (nodes[at] == node).all():
                raise RuntimeError("a node is missing from its head")
            at = at[place]
            one = np.where(np.isnan(chance), a[at], a[at] + b[at] * chance)
            score += np.log10(np.where(value == 1, one, 1 - one))
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.round(score * UNITS).astype(np.int64))], ["gram", "score"])


def _level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what a node above depth HEAD needs: weighted probability, share of its own estimate and chance of a 1."""
    for batch in batches:
        own = Nodes(*(batch.column(c).to_numpy().astype(np.float64) for c in ("zero", "one", "below")))
        kt = pa.array(own.kt, from_pandas=True)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("node", "zero", "one")), pa.array(own.weighted), pa.array(own.share), kt],
            ["node", "zero", "one", "weighted", "share", "kt"],
        )


def gram_scores(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """gram, score: the log10 probability of the byte after each context, in parts of UNITS. grams has gram and count.

    Grams are dealt by the HEAD nearest bytes of their context, below which every subtree lies in one run of sorted rows;
    what is above, at most 256 ** (HEAD + 1) nodes, is weighted by aggregates. The chance at the root is linear in that at
    depth HEAD, a + b * chance, and a node's a and b come from its parent's.
    """
    rows = grams.select(F.col("gram").alias("key"), "count", F.shiftright("gram", 8 * (DEPTH - HEAD + 1)).alias("head"))
    sorted_rows = rows.repartition("head").sortWithinPartitions("head", "key")
    found = scratch.table(sorted_rows.mapInArrow(_head_nodes, "node long, zero long, one long, weighted double"))
    up = ((F.shiftright("node", 16) * 256) + F.col("node").bitwiseAND(255)).alias("node")
    levels = [found]
    for _ in range(HEAD):
        parent = levels[-1].groupBy(up).agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"), F.sum("weighted").alias("below"))
        level = parent.mapInArrow(_level, "node long, zero long, one long, weighted double, share double, kt double")
        levels.append(scratch.table(level))
    trained = F.col("zero") + F.col("one") > 0
    line = levels[-1].select("node", "share", "kt", F.when(trained, 0.0).otherwise(0.5).alias("a"), trained.cast("double").alias("b"))
    for depth, level in zip(range(1, HEAD + 1), levels[-2::-1], strict=True):
        # At most 255 roots and 65 280 nodes of depth 1 are broadcast.
        parent = F.broadcast(line) if depth <= 2 else line
        parent = parent.select(F.col("node").alias("up"), F.col("share").alias("up_share"), F.col("kt").alias("up_kt"), "a", "b")
        joined = level.withColumn("up", up).join(parent, "up")
        rest = F.when(trained, F.col("up_share")).otherwise(1.0)
        a = F.col("a") + F.coalesce(F.col("b") * rest * F.col("up_kt"), F.lit(0.0))
        b = F.when(trained, F.col("b") * (1 - F.col("up_share"))).otherwise(0.0)
        own = ["share", "kt"] if depth < HEAD else []
        line = joined.select("node", *own, a.alias("a"), b.alias("b"))
    above = line.select(F.col("node").alias("key"), F.lit(None).cast("long").alias("count"), F.shiftright("node", 8).alias("head"), "a", "b")
    none = F.lit(None).cast("double")
    both = rows.select("*", none.alias("a"), none.alias("b")).unionByName(above)
    both = both.repartition("head").sortWithinPartitions("head", F.col("count").isNull(), "key")
    out = scratch.table(both.mapInArrow(_run_scores, "gram long, score long"))
    scratch.drop(*levels)
    return out


def scores(docs: DataFrame, fold: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document.

    Documents whose crc32 of doc_id leaves `held` modulo `fold` are held out; all others train.
    """
    scratch = Scratch(docs.sparkSession)
    keyed = with_key(docs, scratch)
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(fold)) == held
    keyed = keyed.select("_key", "doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    rows = keyed.select("doc_id", "text", "held_out", F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("int").alias("block"))
    found = scratch.table(rows.groupBy("block").applyInArrow(_block_counts, "block int, word string, gram long, count long"))
    scratch.drop()
    words, grams = found.filter("word is not null"), found.filter("word is null")
    vocabulary = scratch.table(words.groupBy("word").agg(F.sum("count").alias("count")))
    total, distinct = vocabulary.agg(F.sum("count"), F.count(F.when(F.col("count") > 0, 1))).first()
    total = total or 0
    counts = scratch.table(grams.groupBy("gram").agg(F.sum("count").alias("count")))
    scored = gram_scores(counts, scratch)
    scratch.drop(counts)
    told = words.select("block", "word").join(vocabulary, "word").select("block", "word", F.col("count").alias("number"), F.lit(None).cast("long").alias("score"))
    told = told.unionByName(
        grams.select("block", "gram").join(scored, "gram").select("block", F.lit(None).cast("string").alias("word"), F.col("gram").alias("number"), "score")
    )
    # Written, so that the counts and the shuffles of the joins are gone before texts are shuffled.
    told = scratch.table(told)
    scratch.drop(found, scored, vocabulary)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_doc_scores(total + distinct + 1, total), schema)
