"""Benchmark decontamination: every occurrence of a test string in every document, by Wu-Manber search.

Texts are normalised to their words with one space before each and one after the last: A-Z are lower-cased, a word is a
run of digits, letters and characters beyond ASCII. A test string (window) is 10 consecutive words of an item, spaces at both
ends included, or all words of a shorter item. Windows are grouped by octave of length. For each group, a table gives
for a block of bytes the distance by which the search may move on, so most positions are never looked at; where the
distance is 0, the bytes before select a bucket of windows, and direct comparison with the text confirms each. Many stretches
of a slice of texts are searched side by side, each with a cursor of its own.

The items are dealt by hash to blocks of about BLOCK_BYTES, long items in pieces that overlap by a window less a word, so
the tables that go to the tasks have a bound whatever the number and length of items: all documents meet the blocks one after the other. A
window that many items share is searched for once.

A null or empty text has no words and no hits, nor has one of other characters only. Items without words occur nowhere; rows
that repeat an item_id count as one item; rows without item_id are searched for but add nothing to the items. Rows that
repeat a doc_id are searched one by one. Other columns are ignored. An empty table of documents gives no rows, an
empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.scratch import Scratch, with_key
from tenure.llm.text import Text, slices

WINDOW = 10
#: Normalised bytes of the items that are searched for at once, and windows in a piece of a long item.
BLOCK_BYTES, PIECE_WINDOWS = 4 << 20, 4096
#: The search looks at this many first bytes of a window at most; a shift fits one byte.
LONGEST_PREFIX = 192
#: Cursors that search a slice side by side have this many bytes each.
STRETCH = 2048
#: Pairs of a place and a window that are compared at once, and bytes compared before pairs that differ are left.
PAIRS, COMPARED = 1 << 15, 64
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SPANS = "array<struct<start:int,end:int>>"
FOUND = f"_key long, doc_id long, n_words long, spans {SPANS}, items array<string>"


class Normal:
    """Normalised texts in one buffer: each is ` word word ` and a zero byte; `begin` is the place of each word."""

    def __init__(self, column: pa.Array):
        text = Text(column, lower=True)
        inside = WORD[text.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = np.unique(text.off[1:-1])
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
        start = np.flatnonzero(first)
        self.length = np.flatnonzero(last) + 1 - start
        self.row = np.searchsorted(text.off, start, "right") - 1
        self.count = np.bincount(self.row, minlength=text.n).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        rank = np.concatenate([[0], np.cumsum(self.length)])
        space = rank[:-1] + np.arange(len(start)) + 2 * self.row
        close = rank[self.first[1:]] + self.first[1:] + 2 * np.arange(text.n)
        place = np.ones(rank[-1] + len(start) + 2 * text.n, bool)
        place[space] = place[close] = place[close + 1] = False
        self.data = np.full(len(place), 0x20, np.uint8)
        self.data[place] = text.data[inside]
        self.data[close + 1] = 0
        self.begin = space + 1
        self.n = text.n


def _last_bytes(data: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """The n <= 8 bytes up to each place `end` (inclusive) as one number."""
    out = np.zeros(len(end), np.uint64)
    for i in range(n):
        out |= data[end - i].astype(np.uint64) << np.uint64(8 * i)
    return out


class Group:
    """Windows of one octave of length, with the block shift table and the buckets of their prefixes' last bytes."""

    def __init__(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray, number: np.ndarray):
        self.start, self.length, self.number = start, length, number
        self.m = int(min(length.min(), LONGEST_PREFIX))
        self.block = min(4, self.m)
        self.key_bytes = min(8, self.m)
        self.bits = int(np.clip(np.ceil(np.log2(len(start) + 1)) + 8, 12, 20))
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.uint8)
        for q in range(self.block - 1, self.m):
            self.shift[self._slot(_last_bytes(buffer, start + q, self.block))] = self.m - 1 - q
        key = _last_bytes(buffer, start + self.m - 1, self.key_bytes)
        order = np.argsort(key, kind="stable")
        self.start, self.length, self.number = start[order], length[order], number[order]
        self.keys, self.bucket = np.unique(key[order], return_index=True)
        self.bucket = np.append(self.bucket, len(order))

    def _slot(self, value: np.ndarray) -> np.ndarray:
        return (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def ends(self, data: np.ndarray) -> np.ndarray:
        """Places where a prefix may end, every other place being skipped."""
        at = np.arange(self.m - 1, len(data), STRETCH)
        stop = np.minimum(at + STRETCH, len(data))
        found = [np.zeros(0, np.int64)]
        while len(at):
            step = self.shift[self._slot(_last_bytes(data, at, self.block))]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.concatenate(found)

    def occurrences(self, data: np.ndarray, buffer: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and window numbers of the occurrences, in runs of bounded length."""
        end = self.ends(data)
        key = _last_bytes(data, end, self.key_bytes)
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[slot] == key
        end, slot = end[same], slot[same]
        many = self.bucket[slot + 1] - self.bucket[slot]
        total = np.concatenate([[0], np.cumsum(many)])
        for begin in range(0, int(total[-1]), PAIRS):
            pair = np.arange(begin, min(begin + PAIRS, int(total[-1])))
            of = np.searchsorted(total, pair, "right") - 1
            window = self.bucket[slot[of]] + pair - total[of]
            place = end[of] - self.m + 1
            fits = place + self.length[window] <= len(data)
            place, window = place[fits], window[fits]
            offset = 0
            while len(place) and offset < self.length[window].max():
                column = np.minimum(offset + np.arange(COMPARED), self.length[window][:, None] - 1)
                equal = (data[place[:, None] + column] == buffer[self.start[window][:, None] + column]).all(axis=1)
                place, window = place[equal], window[equal]
                offset += COMPARED
            yield place, self.number[window]


class Patterns:
    """The distinct windows of a block of items, and the items of each."""

    def __init__(self, items: list[str | None], pieces: list[bytes]):
        self.buffer = np.frombuffer(b"".join(pieces), np.uint8)
        at: dict[bytes, int] = {}
        start, length, self.words, of, item = [], [], [], [], []
        names = {name: i for i, name in enumerate(sorted({i for i in items if i is not None}))}
        base = 0
        for name, piece in zip(items, pieces):
            spaces = np.flatnonzero(np.frombuffer(piece, np.uint8) == 0x20).tolist()
            n = min(WINDOW, len(spaces) - 1)
            for i in range(len(spaces) - n):
                window = piece[spaces[i] : spaces[i + n] + 1]
                number = at.setdefault(window, len(start))
                if number == len(start):
                    start.append(base + spaces[i])
                    length.append(len(window))
                    self.words.append(n)
                if name is not None:
                    of.append(number)
                    item.append(names[name])
            base += len(piece)
        self.names = np.array(list(names), object)
        pairs = np.unique(np.array([of, item], np.int64).reshape(2, -1), axis=1)
        self.item = pairs[1]
        self.item_at = np.searchsorted(pairs[0], np.arange(len(start) + 1))
        self.words = np.array(self.words, np.int64)
        start, length = np.array(start, np.int64), np.array(length, np.int64)
        octave = np.floor(np.log2(np.maximum(length, 1))).astype(int)
        self.groups = [Group(self.buffer, start[octave == o], length[octave == o], np.flatnonzero(octave == o)) for o in np.unique(octave)]

    def search(self, text: Normal) -> tuple[list, list]:
        """For every text its spans of hit words and the items found."""
        n = len(text.begin)
        edge = np.zeros(n + 1, np.int64)
        seen = [np.zeros((2, 0), np.int64)]
        for group in self.groups:
            for place, window in group.occurrences(text.data, self.buffer):
                word = np.searchsorted(text.begin, place + 1)
                np.add.at(edge, word, 1)
                np.add.at(edge, word + self.words[window], -1)
                seen.append(np.unique(np.array([text.row[word], window]), axis=1))
        hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
        # a run of hit words ends with its text
        new = np.concatenate([[True], text.row[1:] != text.row[:-1], [True]]) if n else np.ones(1, bool)
        first = np.flatnonzero(hit[1:] & (~hit[:-1] | new) & np.append(np.ones(n, bool), False))
        last = np.flatnonzero(hit[:-1] & (~hit[1:] | new))
        spans: list[list] = [[] for _ in range(text.n)]
        for a, b in zip(first.tolist(), last.tolist()):
            row = int(text.row[a])
            spans[row].append({"start": a - int(text.first[row]), "end": b - int(text.first[row])})
        items: list[list] = [[] for _ in range(text.n)]
        row, window = np.unique(np.concatenate(seen, axis=1), axis=1)
        for r in np.unique(row):
            mine = window[row == r]
            found = np.unique(np.concatenate([self.item[self.item_at[w] : self.item_at[w + 1]] for w in mine]))
            items[int(r)] = self.names[found].tolist()
        return spans, items


def _pieces(benchmark: DataFrame) -> DataFrame:
    """item_id as string, piece: the normalised words of every item, a long one in overlapping runs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                text = Normal(part.column(1))
                close = text.begin + text.length  # the space after each word
                for row in range(text.n):
                    lo, hi = int(text.first[row]), int(text.first[row + 1])
                    runs = [(i, min(i + PIECE_WINDOWS + WINDOW - 1, hi)) for i in range(lo, max(hi - WINDOW + 1, lo + 1), PIECE_WINDOWS) if hi > lo]
                    pieces = [text.data[text.begin[a] - 1 : close[b - 1] + 1].tobytes() for a, b in runs]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.column(0)[row].as_py()] * len(pieces), pa.string()), pa.array(pieces, pa.binary())], ["item_id", "piece"]
                    )

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(cut, "item_id string, piece binary")


def _search(docs: DataFrame, items: list, every: bool) -> DataFrame:
    """FOUND of all documents, or only of those with hits, for one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(Patterns([r["item_id"] for r in items], [bytes(r["piece"]) for r in items]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                text = Normal(part.column(2))
                spans, items = shared.value.search(text)
                out = pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(text.count),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    ["_key", "doc_id", "n_words", "spans", "items"],
                )
                yield out if every else out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

    return docs.mapInArrow(find, FOUND)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the spans of a row that overlap, in order."""
    for batch in batches:
        rows = []
        for spans in batch.column("spans").to_pylist():
            out: list[dict] = []
            for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
                if out and s["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], s["end"])
                else:
                    out.append(s)
            rows.append(out)
        i = batch.schema.get_field_index("spans")
        yield batch.set_column(i, batch.schema.field(i), pa.array(rows, batch.schema.field(i).type))


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (runs of hit words, from `start` to before `end`) and items (ids, sorted as strings) of every document."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.table(_pieces(benchmark))
    blocks = -(-(pieces.agg(F.sum(F.length("piece"))).first()[0] or 0) // BLOCK_BYTES)
    if blocks <= 1:
        found = _search(docs.select(F.lit(0).cast("long").alias("_key"), "doc_id", "text"), pieces.collect(), every=True)
        return found.select("doc_id", "n_words", "spans", F.array_sort("items").alias("items"))
    docs = with_key(docs, scratch).select("_key", "doc_id", "text")
    block = F.pmod(F.xxhash64("item_id", "piece"), F.lit(blocks))
    tables = [scratch.table(_search(docs, pieces.filter(block == b).collect(), every=b == 0)) for b in range(blocks)]
    found = tables[0]
    for t in tables[1:]:
        found = found.unionByName(t)
    found = found.groupBy("_key").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return found.mapInArrow(_merge, found.schema).select("doc_id", "n_words", "spans", "items")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The counts of occurrences(): n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return occurrences(docs, benchmark).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def oracle() -> str:
    """DuckDB SQL for the rows of contamination: windows as joined words, matched by equality."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = f"coalesce(regexp_extract_all(translate(text, '{letters.upper()}', '{letters}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
        i AS (SELECT item_id, {words} AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[j + 1 : j + {WINDOW}], ' ') AS s
            FROM i, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) AS t(j) WHERE len(w) > 0),
        places AS (SELECT r, k, j, array_to_string(w[j + 1 : j + k], ' ') AS s
            FROM (SELECT r, k, w, unnest(range(len(w) - k + 1)) AS j FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
        found AS (SELECT r, k, j, item_id FROM places JOIN windows USING (k, s)),
        hits AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(j, j + k)) AS x FROM found) GROUP BY r),
        ids AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)"""
