"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every byte covered by a string of `width` bytes that also starts earlier (in a document with a smaller id, or earlier
in the same one) is removed. Texts are UTF-8 bytes, null is empty, and strings never cross documents.

1. Each window of `width` bytes has one anchor: the leftmost of its ANCHOR-byte strings with the least hash. Windows
   in a row with the same anchor make a stretch. Equal windows have equal anchors at the same place, so
   windows are only ever compared between stretches of one anchor.
2. A batch keeps the earliest stretch of each content. Stretches are sorted by anchor hash and content hash. A stretch whose content occurred earlier is removed as
   a whole. An anchor seen with one content only is done; the first stretches of all others go on.
3. Those are dealt to cells of bounded size by anchor. Inside a cell, the stretches are cut into shards; each
   shard's suffixes are sorted and its transform written down, then the shards' transforms are merged by
   refining their interleave: after k passes all suffixes are in the order of their first k symbols, and the
   blocks with equal first k symbols are known. The anchor, equal by hash, counts as one symbol, so
   width - ANCHOR + 1 passes give the repeated windows: the blocks of more than one suffix. All but the
   first window of a block are covered.
4. An anchor with more than HOT contents would make a cell of any size: its windows are grouped by a
   128-bit hash instead, which Spark spreads over all tasks.
5. Covered ranges are gathered by document, and the rest of the text is cut out.

Rows that repeat a doc_id, or lack one, count as documents of their own in the order of doc_id (null last), then
text. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tenure.llm.scratch import Scratch, with_key
from tenure.llm.text import BASE, BYTE, Text, U, mix, slices
from tenure.plans.columns import quoted

WIDTH, ANCHOR = 100, 32
CELL, HOT, SHARD = 6000, 30_000, 1500
_LOW = U((1 << 26) - 1)
#: Bytes that are looked at together: places in them fit into _LOW.
RUN = 1 << 23
#: A stretch in a table: `spot` holds its start in the text, its number of windows and its anchor's place plus 1 (0: none) in 47, 8 and 8 bits.
STRETCH = "anchor long, content long, key long, spot long"
NAMES = ["anchor", "content", "key", "spot"]
START, WINDOWS, PLACE = "cast(shiftright(spot, 16) as int)", "cast(shiftright(spot, 8) & 255 as int)", "cast((spot & 255) - 1 as int)"


def _rolling(d: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size`-byte string (a power of two)."""
    h, k, power = BYTE[d], 1, int(BASE)
    while k < size:
        h = h[:-k] * U(power) + h[k:]
        power, k = power * power % 2**64, 2 * k
    return h


_INVERSE = U(pow(int(BASE), -1, 2**64))


def stretches(text: Text, width: int = WIDTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, row, start in the row, number of windows and anchor's place of every stretch.

    Longer texts are cut into runs that overlap by width - 1 bytes, so that every window is in one run.
    """
    if len(text.data) <= RUN:
        return _stretches(text, width, anchor)
    parts = []
    for r, (a, b) in enumerate(zip(text.off[:-1].tolist(), text.off[1:].tolist(), strict=True)):
        for s in range(a, max(a + 1, b - width + 1), RUN - width + 1):
            run = Text(pa.array([], pa.string()))
            run.data, run.n = text.data[s : min(b, s + RUN)], 1
            run.off = np.array([0, len(run.data)])
            anchors, content, row, start, windows, place = _stretches(run, width, anchor)
            parts.append((anchors, content, row + r, start + (s - a), windows, place))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _stretches(text: Text, width: int, anchor: int) -> tuple[np.ndarray, ...]:
    d, off = text.data, text.off
    empty = np.zeros(0, np.int64)
    if len(d) < width:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty, empty
    h = mix(_rolling(d, anchor))
    least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    span, k = width - anchor + 1, 1
    while 2 * k <= span:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    if k < span:
        least = np.minimum(least[: len(least) - (span - k)], least[span - k :])
    at = (least & _LOW).astype(np.int64)
    long = np.diff(off) >= width
    change = np.zeros(len(d) + 1, np.int32)
    change[off[:-1][long]] += 1
    change[off[1:][long] - width + 1] -= 1
    whole = np.cumsum(change)[: len(at)] > 0
    begin = whole.copy()
    begin[1:] &= (at[1:] != at[:-1]) | ~whole[:-1]
    begin[off[:-1][long]] = True
    end = whole.copy()
    end[:-1] &= ~whole[1:] | begin[1:]
    lo, hi = np.flatnonzero(begin), np.flatnonzero(end)
    power = np.cumprod(np.full(len(d), BASE, np.uint64))
    inverse = np.cumprod(np.full(len(d), _INVERSE, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[d] * power)])
    content = mix((total[hi + width] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64) * BASE)
    row = np.searchsorted(off, lo, "right") - 1
    return h[at[lo]], content, row, lo - off[row], hi - lo + 1, at[lo] - lo


def _all_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch's texts. Of those with equal content the batch keeps the earliest; the others, certain to
    be removed, get place -1 and, as they are compared with nothing any more, a number of their own for an anchor."""
    for batch in batches:
        parts = []
        for part in slices(batch, 1, 1 << 18):
            a, c, row, start, n, place = stretches(Text(part.column(1)))
            key = part.column(0).to_numpy(zero_copy_only=False)[row]
            parts.append((a.view(np.int64), c.view(np.int64), key, start, n, place))
        if parts:
            a, c, key, start, n, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, key, c))
            again = np.zeros(len(a), bool)
            again[order[1:]] = (c[order[1:]] == c[order[:-1]]) & (a[order[1:]] == a[order[:-1]])
            place[again] = -1
            a[again] = mix((key[again] * 2**20 + start[again]).astype(np.uint64)).view(np.int64)
            spot = start.astype(np.int64) << 16 | n.astype(np.int64) << 8 | (place + 1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, c, key, spot)], NAMES)


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, content, key and spot: the ranges that occurred earlier (no place), and the first
    stretch of each content of an anchor that has several. Holds one row between batches."""
    last = None  # anchor, content, the anchor's first row, whether that was passed on
    for batch in batches:
        known = pa.array(batch.column(3).to_numpy(zero_copy_only=False) & 255 == 0)
        yield batch.filter(known)
        batch = batch.filter(pc.invert(known))
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        anchor, content = cols[0], cols[1]
        n = len(anchor)
        same_a = np.zeros(n, bool)
        same_a[1:] = anchor[1:] == anchor[:-1]
        same_c = np.zeros(n, bool)
        same_c[1:] = same_a[1:] & (content[1:] == content[:-1])
        if last is not None:
            same_a[0] = anchor[0] == last[0]
            same_c[0] = same_a[0] and content[0] == last[1]
        group = np.cumsum(~same_a)  # 0: goes on from the last batch
        fresh = ~same_c
        kinds = np.bincount(group[fresh], minlength=group[-1] + 1)
        head = np.flatnonzero(~same_a)
        give = same_c.copy()
        several = kinds >= 2
        open_sent = False
        early = None
        if last is not None and kinds[0] >= 1:  # another content of an anchor that goes on
            several[0] = True
            if not last[3]:
                early = last[2]
            open_sent = True
        give |= fresh & several[group]
        spot = np.where(same_c, cols[3] & ~255, cols[3])
        at = np.flatnonzero(give)
        parts = [c[at] for c in cols[:3]] + [spot[at]]
        if early is not None:
            parts = [np.concatenate([[e], p]) for e, p in zip(early, parts, strict=True)]
        if len(head):
            first = head[-1]
            last = (anchor[-1], content[-1], [c[first] for c in cols], bool(several[group[-1]]))
        else:
            last = (anchor[-1], content[-1], last[2], last[3] or open_sent)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in parts], NAMES)


def shard_transform(symbols: np.ndarray, strings: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a shard in the order of `depth` symbols, and the symbol before each (its transform).

    Symbol 0 ends each of the shard's strings; the ends come first, in the order of the strings.
    """
    rank = np.where(symbols == 0, np.cumsum(symbols == 0) - 1, symbols + strings).astype(np.int64)
    k = 1
    while True:
        order = np.argsort(rank, kind="stable")
        if k >= depth:
            break
        step = min(k, depth - k)
        value = rank[order]
        dense = np.empty(len(rank), np.int64)
        dense[order] = np.cumsum(np.r_[0, value[1:] != value[:-1]])
        after = np.zeros(len(rank), np.int64)
        after[:-step] = dense[step:]
        rank = dense * (len(rank) + 1) + after
        k += step
    before = symbols[order - 1]
    return order, before


def merge(transforms: list[np.ndarray], strings: list[int], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge shard transforms: the place of every shard suffix in the merged order, shard after shard, and the
    block of each place, blocks being the suffixes whose first `passes` symbols are equal.

    Pass k sorts the interleave of k symbols stably by the symbol before each suffix, which gives that of k + 1.
    """
    symbols = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    ends = np.repeat(np.arange(len(transforms), dtype=np.uint16), strings)
    block = np.zeros(len(symbols), np.int32)
    merged = np.empty_like(symbols)
    for _ in range(passes):
        place = np.argsort(shard, kind="stable")
        merged[place] = symbols
        order = np.argsort(merged, kind="stable")[len(ends) :]
        value, old = merged[order], block[order]
        new = np.ones(len(order), np.int32)
        if len(order) > 1:
            new[1:] = (value[1:] != value[:-1]) | (old[1:] != old[:-1])
        shard = np.concatenate([ends, shard[order]])
        block = np.concatenate([np.arange(len(ends), dtype=np.int32), len(ends) - 1 + np.cumsum(new, dtype=np.int32)])
    return np.argsort(shard, kind="stable"), block


def covered_windows(strings: list[np.ndarray], windows: np.ndarray, passes: int) -> list[np.ndarray]:
    """For each string of symbols (above 0), ordered by place in the corpus: which of its first `windows` positions
    start `passes` symbols that also start earlier."""
    if not strings:
        return []
    ends = np.zeros(1, np.uint16)
    transforms, suffixes, counts, base = [], [], [], 0
    for i in range(0, len(strings), SHARD):
        part = strings[i : i + SHARD]
        symbols = np.concatenate([x for s in part for x in (s, ends)]).astype(np.uint16)
        order, before = shard_transform(symbols, len(part), passes)
        transforms.append(before)
        suffixes.append(order + base)
        counts.append(len(part))
        base += len(symbols)
    place, block = merge(transforms, counts, passes)
    length = np.array([len(s) + 1 for s in strings])
    first = np.concatenate([[0], np.cumsum(length)])
    starts = np.zeros(base, bool)
    change = np.zeros(base + 1, np.int32)
    np.add.at(change, first[:-1], 1)
    np.add.at(change, first[:-1] + windows, -1)
    starts = np.cumsum(change)[:-1] > 0
    suffix = np.empty(base, np.int64)
    suffix[place] = np.concatenate(suffixes)
    of = np.flatnonzero(starts[suffix])
    lead = np.flatnonzero(np.r_[True, block[of][1:] != block[of][:-1]]) if len(of) else of
    earliest = np.minimum.reduceat(suffix[of], lead) if len(of) else of
    covered = np.zeros(base, bool)
    covered[suffix[of]] = suffix[of] > np.repeat(earliest, np.diff(np.r_[lead, len(of)]))
    return [covered[a : a + w] for a, w in zip(first[:-1], windows, strict=True)]


def _runs(key: list[int], start: list[int], flags: list[np.ndarray], width: int) -> pa.Table:
    """Ranges of bytes below runs of covered windows."""
    keys, begin, end = [], [], []
    for k, s, f in zip(key, start, flags, strict=True):
        edge = np.flatnonzero(np.diff(np.r_[False, f, False].astype(np.int8)))
        keys += [k] * (len(edge) // 2)
        begin.append(edge[::2] + s)
        end.append(edge[1::2] + s + width - 1)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({"key": pa.array(keys, pa.int64()), "begin": pa.array(join(begin), pa.int32()), "end": pa.array(join(end), pa.int32())})


def _cell(table: pa.Table) -> pa.Table:
    order = np.lexsort((table["start"].to_numpy(), table["key"].to_numpy()))
    table = table.take(pa.array(order))
    _, anchor = np.unique(table["anchor"].to_numpy(), return_inverse=True)
    place, windows = table["place"].to_numpy(), table["windows"].to_numpy()
    strings = []
    for a, p, raw in zip(anchor, place, table["bytes"].to_pylist(), strict=True):
        s = np.frombuffer(raw, np.uint8).astype(np.uint16) + 1
        strings.append(np.concatenate([s[:p], np.array([257 + a], np.uint16), s[p + ANCHOR :]]))
    flags = covered_windows(strings, windows, WIDTH - ANCHOR + 1)
    return _runs(table["key"].to_pylist(), table["start"].to_pylist(), flags, WIDTH)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the listed stretches of each text."""
    names = ["anchor", "key", "start", "windows", "place", "bytes"]
    for batch in batches:
        for part in slices(batch, 1):
            text = Text(part.column(1))
            lists = part.column(2)
            row = np.repeat(np.arange(text.n), np.diff(lists.offsets.to_numpy()))
            s = lists.flatten()
            start, n = s.field("start").to_numpy(), s.field("windows").to_numpy()
            data = text.data.tobytes()
            begin = (text.off[row] + start).tolist()
            cut = [data[b : b + k] for b, k in zip(begin, (n + WIDTH - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [s.field("anchor"), part.column(0).take(pa.array(row)), s.field("start"), s.field("windows"), s.field("place"), pa.array(cut, pa.binary())],
                names,
            )


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, starts, a, b = [], [], [], []
        for key, start, n, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "windows", "bytes")), strict=True):
            for w in range(n):
                digest = hashlib.blake2b(raw[w : w + WIDTH], digest_size=16).digest()
                keys.append(key)
                starts.append(start + w)
                a.append(int.from_bytes(digest[:8], "little", signed=True))
                b.append(int.from_bytes(digest[8:], "little", signed=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int32())],
            ["a", "b", "key", "begin"],
        )


def repeated_ranges(docs: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """key, begin, end: byte ranges that together cover what is to be removed. docs has _key and text."""
    found = docs.select("_key", "text").mapInArrow(_all_stretches, STRETCH)
    sifted = scratch.table(found.repartition("anchor").sortWithinPartitions(*NAMES).mapInArrow(_sift, STRETCH))
    scratch.drop()
    start, windows, place = (F.expr(e) for e in (START, WINDOWS, PLACE))
    whole = sifted.filter("spot & 255 = 0").select("key", start.alias("begin"), (start + windows + WIDTH - 1).alias("end"))
    first = sifted.filter("spot & 255 > 0").select("anchor", "key", start.alias("start"), windows.alias("windows"), place.alias("place"))
    sizes = first.groupBy("anchor").agg(F.count("*").alias("contents"))
    total, most = sizes.agg(F.sum("contents"), F.max("contents")).first()
    if not total:
        return whole
    by_doc = first.groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "windows", "place")).alias("listed"))
    cut = docs.select(F.col("_key").alias("key"), "text").join(by_doc, "key").select("key", "text", "listed")
    cut = cut.mapInArrow(_cut, "anchor long, key long, start int, windows int, place int, bytes binary")
    cells = max(1, total // CELL)
    if most > hot:
        cut = scratch.table(cut)
        hot_anchors = sizes.filter(F.col("contents") > hot).select("anchor")
        windows = scratch.table(cut.join(hot_anchors, "anchor", "left_semi").mapInArrow(_hot_windows, "a long, b long, key long, begin int"))
        earliest = windows.groupBy("a", "b").agg(F.min(F.struct("key", "begin")).alias("least"))
        later = windows.join(earliest, ["a", "b"]).filter(F.struct("key", "begin") > F.col("least"))
        whole = whole.unionByName(later.select("key", "begin", (F.col("begin") + WIDTH).alias("end")))
        cut = cut.join(hot_anchors, "anchor", "left_anti")
    merged = cut.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(cells)).alias("cell")).applyInArrow(
        lambda key, table: _cell(table), "key long, begin int, end int"
    )
    merged = scratch.table(merged)
    scratch.drop()
    return whole.unionByName(merged)


def _remove(batches: Iterator[pa.RecordBatch], at: int = 1) -> Iterator[tuple[pa.RecordBatch, Text, np.ndarray]]:
    """Each run of rows (text in column `at`, packed ranges in the last), and which bytes go."""
    for batch in batches:
        for part in slices(batch, at):
            text = Text(part.column(at))
            lists = part.column(part.num_columns - 1)
            packed = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            base = np.repeat(text.off[:-1], counts)
            change = np.zeros(len(text.data) + 1, np.int32)
            np.add.at(change, base + (packed >> 32), 1)
            np.add.at(change, base + (packed & 0xFFFFFFFF), -1)
            yield part, text, np.cumsum(change)[:-1] > 0


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, text, gone in _remove(batches):
        removed, spans, sha = [], [], []
        for a, b in zip(text.off[:-1], text.off[1:], strict=True):
            g = gone[a:b]
            removed.append(int(g.sum()))
            spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
            sha.append(hashlib.sha256(text.data[a:b][~g]).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(np.diff(text.off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _with_ranges(keyed: DataFrame, columns: list[str], scratch: Scratch) -> DataFrame:
    ranges = repeated_ranges(keyed.select("_key", "text"), scratch)
    packed = (F.col("begin").cast("long") * 2**32 + F.col("end")).alias("packed")
    by_doc = ranges.groupBy("key").agg(F.collect_list(packed).alias("_ranges"))
    return keyed.join(by_doc, keyed["_key"] == by_doc["key"], "left").select(*columns, "_ranges")


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    scratch = Scratch(docs.sparkSession)
    keyed = with_key(docs.select("doc_id", "text"), scratch)
    return _with_ranges(keyed, ["doc_id", "text"], scratch).mapInArrow(
        _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def _shorten(text_at: int, chars_at: int | None, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text, gone in _remove(batches, text_at):
            columns = part.columns[:-1]
            old = columns[text_at]
            # A range may begin or end inside a character; what is left of such a character goes too.
            new = [
                bytes(text.data[a:b][~gone[a:b]]).decode("utf-8", "ignore") if k else None
                for a, b, k in zip(text.off[:-1], text.off[1:], old.is_valid().to_pylist(), strict=True)
            ]
            columns[text_at] = pa.array(new, old.type)
            if chars_at is not None:
                touched = pa.array(np.add.reduceat(np.append(gone, False).astype(np.int64), text.off[:-1]) * (np.diff(text.off) > 0) > 0)
                columns[chars_at] = pc.if_else(touched, pc.utf8_length(columns[text_at]).cast(columns[chars_at].type), columns[chars_at])
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes cut out of text; n_chars, where there is a whole number of that name, counts what is left.

    Documents left empty stay, null texts stay null.
    """
    scratch = Scratch(docs.sparkSession)
    # Names of our own for the other columns, whatever theirs are.
    inner = {c: c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)}
    keyed = with_key(docs.select(*(F.col(quoted(c)).alias(n) for c, n in inner.items())), scratch)
    schema = StructType([StructField(c, keyed.schema[n].dataType) for c, n in inner.items()])
    chars = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else None
    shorten = _shorten(docs.columns.index("text"), chars, docs.columns)
    return _with_ranges(keyed, list(inner.values()), scratch).mapInArrow(shorten, schema)
