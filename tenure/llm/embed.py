"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact reranking.

Two vectors are linked when the cosine of the originals, in double precision, is 0.9 or more.

1. Vectors with equal components form a class; the smallest vec_id stands for it.
2. On a bounded sample (`sample` vectors of the lowest hash), iterative quantisation learns rotations of the
   principal axes that make sign bits balanced and close to the data; further random starts give further bits.
3. Codes are cut into keys of about log2(rows / 64) bits, one Hamming table for each. How many tables are needed is computed from
   the sample: pairs are made at a cosine of exactly `least`, and tables are added until the share of pairs that meet
   in one is RECALL. Where MAX_TABLES are not enough, keys are shortened bit by bit until they are.
4. A bucket's vectors are compared by one matrix product; a bucket of over BLOCK vectors is cut into blocks
   that meet pairwise, so that no task grows with it. A pair counts in the first table in which it meets. A task
   gives each vector its number of links and one link to its local component, never the pairs.

5. Only vectors of one length are compared. Each length with over BLOCK vectors has tables of its own; shorter lists are one bucket each,
   in which all pairs are compared.

Vectors that are null, empty, zero, or have null or non-finite components are linked with nothing. Rows that repeat a vec_id share a component; a null vec_id stands for nothing (its component is its
class's, or null). An empty table gives no rows. Labels and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.components import Union, connected_components
from tenure.llm.scratch import Scratch

BLOCK = 2000
RECALL = 0.98
MAX_TABLES = 64
#: Pairs that are made to judge the tables.
PAIRS = 4000


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as (vec_id, mark_a, mark_b, data): the doubles of the vector, null where it links with nothing."""
    for batch in batches:
        data, a, b = [], [], []
        for v in batch.column(1):
            values = v.values
            x = None
            if values is not None and len(values) and values.null_count == 0:
                x = values.to_numpy().astype(np.float64) + 0.0
                if not np.isfinite(x).all() or not x.any():
                    x = None
            raw = None if x is None else x.tobytes()
            mark = hashlib.blake2b(raw or b"", digest_size=16).digest()
            data.append(raw)
            a.append(int.from_bytes(mark[:8], "little", signed=True))
            b.append(int.from_bytes(mark[8:], "little", signed=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(data, pa.binary())],
            ["vec_id", "mark_a", "mark_b", "data"],
        )


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotations(x: np.ndarray, count: int, rounds: int = 40, seed: int = 11) -> list[np.ndarray]:
    """Projections (axes x bits) whose signs are the codes: principal axes, turned to fit their own signs."""
    rng = np.random.default_rng(seed)
    axes = np.linalg.eigh(x.T @ x / max(1, len(x)))[1][:, ::-1]
    v = x @ axes
    out = []
    for _ in range(count):
        turn = np.linalg.qr(rng.normal(size=(v.shape[1],) * 2))[0]
        for _ in range(rounds):
            signs = np.where(v @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ v)
            turn = (left @ right).T
        out.append(axes @ turn)
    return out


class Tables:
    """The centre, the projections and how codes are cut into the keys of the tables."""

    def __init__(self, x: np.ndarray, rows: int, least: float):
        dims = x.shape[1]
        self.bits = int(min(dims, 30, max(6, math.ceil(math.log2(max(1, rows) / 64)))))
        self.centre = x.mean(0)
        rng = np.random.default_rng(5)
        x = np.tile(x, (-(-PAIRS // len(x)), 1))  # several pairs of each vector where there are few
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        noise /= np.maximum(1e-300, np.sqrt((noise * noise).sum(1, keepdims=True)))
        other = least * x + math.sqrt(1 - least * least) * noise
        turns = rotations(x[:PAIRS] - self.centre, -(-MAX_TABLES // (dims // self.bits)))
        while not self._reached(x, other, turns):
            self.bits -= 1

    def _reached(self, x: np.ndarray, other: np.ndarray, turns: list[np.ndarray]) -> bool:
        """Add tables until RECALL is reached; keys of no bits put all vectors into one bucket."""
        self.projections: list[np.ndarray] = []
        self.tables = 0
        met = np.zeros(len(x), bool)
        for p in turns:
            self.projections.append(p)
            same = self._keys(x, p) == self._keys(other, p)
            for t in range(min(same.shape[1], MAX_TABLES - self.tables)):
                met |= same[:, t]
                self.tables += 1
                if met.mean() >= RECALL:
                    return True
        return False

    def _keys(self, x: np.ndarray, projection: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros((len(x), 1), np.int64)
        each = projection.shape[1] // self.bits
        on = ((x - self.centre) @ projection[:, : each * self.bits] >= 0).reshape(len(x), each, self.bits)
        return on @ (1 << np.arange(self.bits))

    def keys(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._keys(x, p) for p in self.projections], 1)[:, : self.tables].astype(np.int32)


def _coded(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = tables.value.keys(_unit(batch.column(2).to_pylist()))
                offsets = np.arange(len(keys) + 1) * keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["vec_id", "copies", "data", "keys"])

    return run


def _compare(least: float):
    def run(table: pa.Table) -> pa.Table:
        where, bucket, block = (table[c].to_numpy() for c in ("place", "bucket", "block"))
        ids, copies = table["vec_id"].to_numpy(), table["copies"].to_numpy()
        two = table["two"][0].as_py()
        order = np.lexsort((ids, block, bucket, where))
        x = _unit(table["data"].to_pylist())[order]
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        where, bucket, block, ids, copies = where[order], bucket[order], block[order], ids[order], copies[order]
        bounds = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (bucket[1:] != bucket[:-1]), True])
        number, _ = np.unique(ids, return_inverse=True)
        at = np.searchsorted(number, ids)
        links, known = np.zeros(len(number), np.int64), Union(len(number))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            for s in range(a, b, 512):
                e = min(b, s + 512)
                i, j = np.nonzero(x[s:e] @ x[s:b].T >= least)
                i, j = i + s, j + s
                fits = j > i
                if two:
                    fits &= block[i] != block[j]
                i, j = i[fits], j[fits]
                first = (keys[i] == keys[j]).argmax(1) == where[a]
                i, j = i[first], j[first]
                np.add.at(links, at[i], copies[j])
                np.add.at(links, at[j], copies[i])
                for p, q in zip(at[i].tolist(), at[j].tolist(), strict=True):
                    known.join(p, q)
        used = np.flatnonzero(links)
        roots = np.array([known.find(int(u)) for u in used], np.int64)
        return pa.table({"vec_id": pa.array(number[used]), "links": pa.array(links[used]), "root": pa.array(number[roots])})

    return run


PLACED = "vec_id long, links long, root long"


def _found(stands: DataFrame, rows: int, least: float, sample: int, scratch: Scratch) -> DataFrame:
    """PLACED of the links between vectors of one length, through tables learned for them."""
    drawn = stands.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("data").toPandas()
    tables = Tables(_unit(list(drawn["data"])), rows, least)
    schema = "vec_id long, copies long, data binary, keys array<int>"
    coded = scratch.table(stands.mapInArrow(_coded(stands.sparkSession.sparkContext.broadcast(tables)), schema))
    placed = coded.select("vec_id", "copies", "data", "keys", F.posexplode("keys").alias("place", "bucket"))
    cells = max(1, rows * tables.tables // BLOCK)
    single = F.pmod(F.xxhash64("place", "bucket"), F.lit(cells))
    large = coded.select(F.posexplode("keys").alias("place", "bucket")).groupBy("place", "bucket").count().filter(F.col("count") > BLOCK)
    large = scratch.table(large)
    if large.isEmpty():
        placed = placed.select("*", F.lit(0).cast("long").alias("block"), single.alias("cell"), F.lit(False).alias("two"))
    else:
        blocks = F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1))
        split = placed.join(large, ["place", "bucket"], "left").withColumn("blocks", blocks)
        split = split.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).drop("count")
        few = split.filter("blocks = 1").withColumn("cell", single).withColumn("two", F.lit(False)).drop("blocks")
        meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
        many = split.filter("blocks > 1").withColumn("pair", F.explode(meet))
        many = many.withColumn("cell", F.xxhash64("place", "bucket", "pair")).withColumn("two", F.col("pair.x") != F.col("pair.y")).drop("pair", "blocks")
        placed = few.unionByName(many)
    return scratch.table(placed.groupBy("cell", "two").applyInArrow(_compare(least), PLACED))


def near_vectors(vectors: DataFrame, least: float = 0.9, sample: int = 4000) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    scratch = Scratch(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    made = scratch.table(vectors.mapInArrow(_usable, "vec_id long, mark_a long, mark_b long, data binary"))
    mark = ["mark_a", "mark_b"]
    classes = scratch.table(
        made.filter("data is not null").groupBy(*mark).agg(F.min("vec_id").alias("stands"), F.count("*").alias("copies")).filter("stands is not null")
    )
    stands = made.join(classes, [*mark]).filter("vec_id = stands").select("vec_id", "copies", "data", *mark).dropDuplicates(mark).drop(*mark)
    length = F.length("data")
    counts = stands.groupBy(length.alias("length")).agg(F.count("*").alias("rows"))
    many = counts.filter(F.col("rows") > BLOCK).collect()  # at most one row for each BLOCK vectors
    parts = [_found(stands.filter(length == r["length"]), r["rows"], least, sample, scratch) for r in many]
    rest = stands.filter(~length.isin([r["length"] for r in many])) if many else stands
    whole = rest.select(
        "vec_id", "copies", "data", F.array(F.lit(0)).alias("keys"), F.lit(0).alias("place"), F.lit(0).alias("bucket"),
        F.lit(0).cast("long").alias("block"), length.cast("long").alias("cell"), F.lit(False).alias("two"),
    )
    found = scratch.table(whole.groupBy("cell", "two").applyInArrow(_compare(least), PLACED))
    for p in parts:
        found = found.unionByName(p)
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")), scratch)
    classes = classes.join(links, classes["stands"] == links["vec_id"], "left").drop("vec_id")
    classes = classes.join(comps, classes["stands"] == comps["node"], "left").drop("node")
    classes = classes.select(
        *mark, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "stands").alias("_component")
    )
    usable = made.select("vec_id", F.when(F.col("data").isNotNull(), F.col("mark_a")).alias("mark_a"), "mark_b")
    out = usable.join(classes, mark, "left")
    component = F.coalesce("_component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
