"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets and union-find.

A document's set holds its distinct shingles of `size` words (A-Z lower-cased); a shorter text with words is one
shingle; a text without words has an empty set and is linked with nothing. Two documents are linked when
100 * |intersection| >= percent * |union|.

1. One pass makes each document's signature. SuperMinHash gives every shingle a random order of the 160
   slots and offers (rank + fraction) to the slot of each rank; ranks are taken in turn, and a document stops
   early once every slot holds less than the next rank. Slots form 32 bands of 5.
2. Documents with equal sets (their size and a 128-bit sum of the set's hashes) form a class; a row with its smallest
   doc_id stands for it, so copies meet as one row.
3. Class representatives that share a band's key with the band's first representative join a candidate
   component. At a similarity of exactly 0.8 a pair shares no band with probability 3e-6.
4. Candidate components are cut into blocks of bounded size. A task compares the signatures of two blocks
   and verifies, on full sets, each promising pair that is not connected already.
5. Verified links become components.

Null doc_ids can stand for nothing: such a row takes its class's component, or null, and is kept only where that
is null. Rows that repeat a doc_id with different texts are documents of their own: each takes its own class's component,
whose id is the smallest doc_id of its rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.components import Union, connected_components
from tenure.llm.scratch import Scratch, with_key
from tenure.llm.text import Text, U, Words, flat, grouped, hashes, mix, slices, sums

SLOTS, BANDS = 160, 32
BLOCK = 1000
_LEVEL = U(32)


def shingles(text: Text, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 64-bit shingles sorted by row and value, the rows' first shingle, and the words of every row."""
    words = Words(text)
    ids, distinct = words.encode()
    value = hashes(*flat(distinct))[ids] if len(ids) else np.zeros(0, np.uint64)
    n = max(0, len(words) - size + 1)
    whole = words.row[:n] == words.row[size - 1 :] if n else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    combined = np.zeros(len(at), np.uint64)
    for k in range(size):
        combined = mix(combined * U(3) + value[at + k])
    row = words.row[at]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            more = words.count[short] > k
            extra[more] = mix(extra[more] * U(5) + value[words.first[short[more]] + k])
        combined, row = np.concatenate([combined, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        combined, row = combined[order], row[order]
    order, new = grouped(row, combined, text.n)
    order = order[new]
    return combined[order], np.searchsorted(row[order], np.arange(text.n + 1)), words.count


def superminhash(value: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature of every set: per slot the least rank + fraction (rank in the upper 32 bits)."""
    n = len(first) - 1
    best = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    row = np.repeat(np.arange(n), np.diff(first))
    draw = mix(value + BASE_STEP)
    slot = ((draw >> _LEVEL) * U(slots)) >> _LEVEL
    np.minimum.at(best, row * slots + slot.astype(np.int64), draw & U(0xFFFFFFFF))
    open_rows = (best.reshape(n, slots).max(1) >= U(1) << _LEVEL) & (np.diff(first) > 0)
    # Rows that go on are taken in runs, so that the orders drawn so far stay small.
    pending = np.flatnonzero(open_rows)
    sizes = np.cumsum(np.diff(first)[pending])
    for run in np.split(pending, np.unique(np.searchsorted(sizes, np.arange(60_000, sizes[-1] if len(sizes) else 0, 60_000)))):
        if len(run):
            _later_ranks(value, first, run, slot, best, slots)
    return best.reshape(n, slots)


BASE_STEP = U(0x9E3779B97F4A7C15)


def _later_ranks(value, first, rows, slot0, best, slots) -> None:
    at = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
    row = np.repeat(rows, first[rows + 1] - first[rows])
    v = value[at]
    order = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(at), slots)).copy()
    line = np.arange(len(at))
    k = slot0[at].astype(np.int64)
    order[line, k] = 0
    order[:, 0] = k
    for rank in range(1, slots):
        draw = mix(v + U((int(BASE_STEP) * (rank + 1)) % 2**64))
        k = rank + (((draw >> _LEVEL) * U(slots - rank)) >> _LEVEL).astype(np.int64)
        slot = order[line, k]
        order[line, k] = order[:, rank]
        order[:, rank] = slot
        np.minimum.at(best, row * slots + slot, (U(rank) << _LEVEL) | (draw & U(0xFFFFFFFF)))
        going = best.reshape(-1, slots)[rows].max(1) >= U(rank + 1) << _LEVEL
        if not going.any():
            return
        if going.sum() * 2 < len(going):
            rows = rows[going]
            stay = np.isin(row, rows)
            v, row, order = v[stay], row[stay], order[stay]
            line = np.arange(len(v))


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.arange(BANDS, dtype=np.uint64) * BASE_STEP
        for batch in batches:
            for part in slices(batch, 1):
                text = Text(part.column(1), lower=True)
                value, first, _ = shingles(text, size)
                best = superminhash(value, first)
                key = np.zeros((text.n, BANDS), np.uint64) + step
                for k in range(SLOTS // BANDS):
                    key = mix(key * U(3) + best.reshape(text.n, BANDS, -1)[:, :, k])
                small = (mix(best) >> U(56)).astype(np.uint8)
                marks = [sums(mix(value ^ U(c)), first).view(np.int64) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                bands = pa.ListArray.from_arrays(
                    pa.array(np.arange(text.n + 1) * BANDS, pa.int32()), pa.array(key.view(np.int64).ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.diff(first)), *map(pa.array, marks),
                     pa.array([x.tobytes() for x in small], pa.binary()), bands],
                    ["_key", "doc_id", "n_shingles", "mark_a", "mark_b", "signature", "bands"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                value, first, _ = shingles(Text(part.column(1), lower=True), size)
                sets = [value[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["_key", "shingles"])

    return run


def _verify(percent: int):
    """Spanning links of verified pairs of a cell: several small components, or two blocks of a large one."""

    def run(table: pa.Table) -> pa.Table:
        doc = table["_key"].to_numpy()
        order = np.lexsort((doc, table["component"].to_numpy()))
        doc, component = doc[order], table["component"].to_numpy()[order]
        block = table["block"].to_numpy()[order]
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        sets = [sets[i] for i in order]
        marks = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(len(doc), -1)[order]
        size = np.array([len(x) for x in sets])
        two = table["two"][0].as_py()
        known = Union(len(doc))
        u, v = [], []
        bounds = np.flatnonzero(np.r_[True, component[1:] != component[:-1], True])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            for i in range(a, b - 1):
                same = (marks[i + 1 : b] == marks[i]).sum(1)
                fits = (same >= LEAST_EQUAL) & (100 * np.minimum(size[i], size[i + 1 : b]) >= percent * np.maximum(size[i], size[i + 1 : b]))
                if two:
                    fits &= block[i + 1 : b] != block[i]
                for j in np.flatnonzero(fits) + i + 1:
                    if known.find(i) == known.find(j):
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        known.join(i, j)
                        u.append(doc[i])
                        v.append(doc[j])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


#: Of the 160 slots: 5.5 deviations below the mean at a similarity of 0.8, so that no link is lost to the estimate.
LEAST_EQUAL = 100


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    scratch = Scratch(docs.sparkSession)
    out = _components(with_key(docs.select("doc_id", "text"), scratch), scratch, size, percent)
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"),
    )


def _components(docs: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """_key, doc_id, n_shingles, component (the key of a row of it) and component_id (its smallest doc_id) of
    docs(_key, doc_id, text); the last two are null where no row with a doc_id and words has the text."""
    if percent < 80:
        raise ValueError("bands and estimates are set for a similarity of 0.8 or more")
    docs = docs.select("_key", "text", "doc_id")
    schema = "_key long, doc_id long, n_shingles long, mark_a long, mark_b long, signature binary, bands array<long>"
    made = scratch.table(docs.mapInArrow(_signatures(size), schema))
    same = ["mark_a", "mark_b", "n_shingles"]
    # Keys ascend with doc_id: the least key of a class is that of its smallest doc_id.
    classes = made.filter("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("_key").alias("stands"), F.min("doc_id").alias("low_id"))
    classes = scratch.table(classes)
    stands = made.join(classes.select(F.col("stands").alias("_key")), "_key").select("_key", "signature", "bands")
    keys = stands.select("_key", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("_key").alias("low"), F.max("_key").alias("high")).filter("high > low")
    near = keys.join(shared, "key").filter("_key <> low").select(F.col("_key").alias("u"), F.col("low").alias("v"))
    candidates = scratch.table(connected_components(near, scratch))
    cells = _cells(candidates, scratch)
    sets = docs.join(candidates.select(F.col("node").alias("_key")), "_key").select("_key", "text").mapInArrow(_sets(size), "_key long, shingles binary")
    rows = cells.join(sets.join(stands.select("_key", "signature"), "_key"), "_key")
    links = scratch.table(rows.groupBy("cell", "two").applyInArrow(_verify(percent), "u long, v long"))
    linked = connected_components(links, scratch)
    classes = classes.join(linked, F.col("stands") == F.col("node"), "left").withColumn("component", F.coalesce("component", "stands"))
    # The least key of a component is that of its smallest doc_id, too: it stands for its class.
    low = classes.filter("component = stands").select("component", F.col("low_id").alias("component_id"))
    classes = classes.select(*same, "component").join(low, "component")
    return made.select("_key", "doc_id", *same).join(classes, same, "left").select("_key", "doc_id", "n_shingles", "component", "component_id")


def _cells(candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """_key, component, block, cell, two: small components share a cell, large ones meet block by block."""
    total = candidates.count()
    sizes = candidates.groupBy("component").agg(F.count("*").alias("members"))
    rows = candidates.join(sizes, "component").withColumn("blocks", F.ceil(F.col("members") / BLOCK))
    rows = rows.select(F.col("node").alias("_key"), "component", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    few = rows.filter("blocks = 1").select(
        "_key", "component", "block", F.pmod(F.xxhash64("component"), F.lit(max(1, total // BLOCK))).alias("cell"), F.lit(False).alias("two")
    )
    pairs = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("x"), F.greatest("block", other).alias("y"))))
    many = rows.filter("blocks > 1").select("_key", "component", "block", pairs.alias("pair"))
    many = many.select("_key", "component", "block", F.xxhash64("component", "pair").alias("cell"), (F.col("pair.x") != F.col("pair.y")).alias("two"))
    return few.unionByName(many)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id, with all its columns.

    A row is dropped only where another row with a doc_id stands for its text's group: rows that repeat a doc_id with
    unrelated texts stay; of those in one group the first by text does. Rows without doc_id or without words stay.
    """
    scratch = Scratch(docs.sparkSession)
    keyed = with_key(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")), scratch)
    found = _components(keyed, scratch, size, percent)
    kept = found.filter("component is null or doc_id is null or _key = component").select("_key")
    return keyed.join(kept, "_key", "left_semi").select("_row.*")


def oracle(size: int = 2, percent: int = 80) -> str:
    """DuckDB SQL for the rows of near_duplicates over documents: all pairs that share a shingle, and who reaches whom."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = f"coalesce(regexp_extract_all(translate(text, '{letters.upper()}', '{letters}'), '[^\\x20\\x09-\\x0D]+'), [])"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {size}], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - {size}, 0) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        t AS (SELECT doc_id, g, n FROM s JOIN n USING (doc_id)),
        links AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS p, any_value(b.n) AS q, count(*) AS c
            FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id)
            WHERE 100 * c >= {percent} * (p + q - c)),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
        low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents LEFT JOIN n USING (doc_id) JOIN low ON doc_id = x"""
