"""Vector codes: every vector as eight indexes into codebooks of sixteen integer entries, refined for a fixed number of rounds.

A component x counts as the integer floor(4096 * x), so every step is exact and does not hang on the order of rows. Vectors
are written once as blocks in which each dimension has a dictionary: its distinct integers, and for every vector the place of
its own. A round tabulates, for a dimension's distinct integers, the squared differences to all entries; the distance of a
vector's part is then a sum of gathers over dictionary codes. New entries come from counts of (entry, dictionary code)
times the dictionary. Tasks send one row for each entry and dimension, and only those sums and the codebooks
reach the driver. A dictionary belongs to a block, so it is bounded whatever the values of the table are.

Rows whose vector is null or holds null, NaN or infinities are dropped; nothing else is. Vectors are cut into eight parts after zeros at
the end fill up to the greatest length, rounded up to a multiple of eight (no change for vectors of one such length). The first
entries are the parts of the sixteen smallest vec_ids (null last; equal ids by vector); with fewer vectors there
are fewer entries. Components beyond 2**128, which only doubles reach, count as 2**128. Sums are exact at any size; an error
or label_error beyond a long is returned as the greatest long. Repeated rows are coded alike, one by one. Other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Numbers in a block, and the most vectors (a dictionary code has 16 bits).
BLOCK_VALUES, BLOCK_ROWS = 1 << 20, 1 << 16
#: Integers within this fit squared differences and their sums into 64 bits; others are Python integers.
NARROW = 1 << 27
LARGEST = 2.0**128
GREATEST = 2**63 - 1
#: Equal labels meet in this many tasks.
SALTS = 32
SUMS = "dim int, entry int, n long, high decimal(38,0), low decimal(38,0)"


def vector_codes(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (summed over equal labels, nulls together), codebooks_sha256."""
    scratch = Scratch(embeddings.sparkSession)
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label").filter(_finite("vector"))
    blocks = scratch.table(_blocks(rows))
    width = blocks.agg(F.max("width")).first()[0] or 0
    books = _first_entries(rows, -(-width // PARTS) * PARTS)
    for _ in range(rounds):
        books = _refined(blocks, books)
    coded = scratch.table(blocks.select("vec_ids", "labels", "width", "dictionary", "codes").mapInArrow(_coder(books), _coded_schema(rows)))
    flat = ",".join(str(v) for part in np.split(books, PARTS, axis=1) for v in part.ravel())
    return _with_label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(flat.encode()).hexdigest()).alias("codebooks_sha256")
    )


def _finite(name: str) -> Column:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(name).isNotNull() & F.forall(name, good)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(4096 * x) as doubles, exactly."""
    return np.floor(np.clip(values, -LARGEST, LARGEST) * SCALE)


def exact(values: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers where they are small, else as Python integers."""
    if len(values) == 0 or np.abs(values).max() <= NARROW:
        return values.astype(np.int64)
    return np.array([int(v) for v in values], object)


def _blocks(rows: DataFrame) -> DataFrame:
    """Runs of vectors with a dictionary for every dimension and the vectors' codes, dimension by dimension."""
    label = rows.schema["label"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            ends = vectors.offsets.to_numpy()
            values = integers(vectors.values.to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                end, width = begin, 0
                while end < batch.num_rows and end - begin < BLOCK_ROWS:
                    wider = max(width, int(ends[end + 1] - ends[end]))
                    if end > begin and wider * (end - begin + 1) > BLOCK_VALUES:
                        break
                    end, width = end + 1, wider
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_ids": pa.array([batch.column(0).slice(begin, end - begin).to_pylist()], pa.list_(batch.schema.field(0).type)),
                        "labels": pa.array([batch.column(2).slice(begin, end - begin).to_pylist()], pa.list_(batch.schema.field(2).type)),
                        "width": pa.array([width], pa.int32()),
                        **_dictionaries(values, ends[begin : end + 1], width),
                    }
                )
                begin = end

    key = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_ids array<{key}>, labels array<{label}>, width int, dictionary array<array<double>>, codes binary"
    return rows.mapInArrow(encode, schema)


def _dictionaries(values: np.ndarray, ends: np.ndarray, width: int) -> dict[str, pa.Array]:
    n = len(ends) - 1
    length = np.diff(ends)
    table = np.zeros((n, width))
    row = np.repeat(np.arange(n), length)
    table[row, np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], length)] = values[ends[0] : ends[-1]]
    found = [np.unique(table[:, d], return_inverse=True) for d in range(width)]
    codes = np.concatenate([place.astype(np.uint16) for _, place in found]) if found else np.zeros(0, np.uint16)
    return {
        "dictionary": pa.array([[distinct for distinct, _ in found]], pa.list_(pa.list_(pa.float64()))),
        "codes": pa.array([codes.tobytes()], pa.binary()),
    }


def _first_entries(rows: DataFrame, width: int) -> np.ndarray:
    """Entries by dimension, as Python integers: the vectors of the smallest vec_ids."""
    first = rows.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    out = np.zeros((len(first), width), object)
    for i, r in enumerate(first):
        out[i, : len(r["vector"])] = [int(v) for v in integers(np.array(r["vector"], float))]
    return out


class _Block:
    """A written block: its dictionaries as integers, and the vectors' codes by dimension."""

    def __init__(self, batch: pa.RecordBatch, i: int, width: int):
        column = {name: batch.column(name)[i] for name in ("vec_ids", "width", "dictionary", "codes")}
        self.n = len(column["vec_ids"])
        held = column["width"].as_py()
        codes = np.frombuffer(column["codes"].as_py(), np.uint16).reshape(held, self.n)
        lists = column["dictionary"].values
        self.values = [exact(lists[d].values.to_numpy()) for d in range(held)]
        self.codes = list(codes)
        for _ in range(held, width):
            self.values.append(np.zeros(1, np.int64))
            self.codes.append(np.zeros(self.n, np.uint16))

    def assigned(self, books: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For every part, the nearest entry of each vector and its squared distance."""
        nearest, least = [], []
        step = books.shape[1] // PARTS
        for part in range(PARTS):
            total = np.zeros((self.n, len(books)), np.int64)
            for d in range(part * step, (part + 1) * step):
                entries = books[:, d]
                if self.values[d].dtype != object and max(map(abs, entries)) <= NARROW and step <= 64:
                    entries = entries.astype(np.int64)
                table = (self.values[d].astype(entries.dtype)[:, None] - entries[None, :]) ** 2
                total = total + table[self.codes[d]]
            nearest.append(np.argmin(total, axis=1))
            least.append(total[np.arange(self.n), nearest[-1]])
        return nearest, least


def _refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round of assigning and averaging."""
    k, width = books.shape
    step = max(width // PARTS, 1)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, k), object)
        count = np.zeros((PARTS, k), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, width)
                nearest, _ = block.assigned(books)
                for d in range(width):
                    values, part = block.values[d], d // step
                    places = np.bincount(nearest[part] * len(values) + block.codes[d], minlength=k * len(values)).reshape(k, -1)
                    total[d] += places.astype(values.dtype).dot(values).astype(object)
                count += np.array([np.bincount(x, minlength=k) for x in nearest])
        d, e = np.nonzero(np.repeat(count, step, axis=0)) if width else (np.zeros(0, int), np.zeros(0, int))
        sums = [int(x) for x in total[d, e]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(d, pa.int32()),
                pa.array(e, pa.int32()),
                pa.array(count[d // step, e], pa.int64()),
                pa.array([Decimal(x >> 62) for x in sums], pa.decimal128(38, 0)),
                pa.array([Decimal(x & (2**62 - 1)) for x in sums], pa.decimal128(38, 0)),
            ],
            ["dim", "entry", "n", "high", "low"],
        )

    sums = blocks.select("vec_ids", "width", "dictionary", "codes").mapInArrow(add_up, SUMS).groupBy("dim", "entry")
    after = books.copy()
    for r in sums.agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        after[r["entry"], r["dim"]] = ((int(r["high"]) << 62) + int(r["low"])) // r["n"]
    return after


def _coded_schema(rows: DataFrame) -> str:
    key, label = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    return f"vec_id {key}, label {label}, code string, error long"


def _coder(books: np.ndarray):
    digits = np.array([f"{e:02x}" for e in range(ENTRIES)], object)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, books.shape[1])
                nearest, least = block.assigned(books)
                text = sum((digits[x] for x in nearest[1:]), digits[nearest[0]])
                error = sum(x.astype(object) for x in least)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_ids")[i].values,
                        batch.column("labels")[i].values,
                        pa.array(text, pa.string()),
                        pa.array([min(e, GREATEST) for e in error], pa.int64()),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    return code


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds the sum over equal labels; a frequent label's rows meet its sum in several tasks."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy("label").agg(F.least(total, F.lit(GREATEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = sums.withColumn("_salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    same = salted["label"].eqNullSafe(sums["label"]) & (salted["_salt"] == sums["_salt"])
    return salted.join(sums, same).select(salted["vec_id"], "code", "error", "label_error")


def oracle() -> str:
    """DuckDB SQL for the rows of vector_codes over embeddings: the rounds as one subquery each."""
    steps = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS (SELECT vec_id, label, p AS part, q[p * len(q) // {PARTS} + 1 : (p + 1) * len(q) // {PARTS}] AS v
        FROM kept, range({PARTS}) AS r(p))""",
        f"""books0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS e FROM parts
        WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))""",
    ]
    for r in range(ROUNDS + 1):
        distance = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - e[i]) * (v[i] - e[i])))::BIGINT"
        steps.append(
            f"""near{r} AS (SELECT vec_id, label, part, any_value(v) AS v, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d
            FROM (SELECT vec_id, label, part, v, entry, {distance} AS d FROM parts JOIN books{r} USING (part)) GROUP BY vec_id, label, part)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""means{r} AS (SELECT part, entry, i, (s - ((s % n) + n) % n) // n AS m FROM (SELECT part, entry, i, sum(v[i])::BIGINT AS s, count(*) AS n
                FROM near{r}, range(1, len(v) + 1) AS t(i) GROUP BY part, entry, i))"""
            )
            steps.append(
                f"""books{r + 1} AS (SELECT part, entry, coalesce(n.e, b.e) AS e FROM books{r} b
                LEFT JOIN (SELECT part, entry, list(m ORDER BY i) AS e FROM means{r} GROUP BY part, entry) n USING (part, entry))"""
            )
    steps.append(
        f"""coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
        FROM near{ROUNDS} GROUP BY vec_id, label)"""
    )
    return f"""WITH {", ".join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM books{ROUNDS}) AS codebooks_sha256 FROM coded"""
