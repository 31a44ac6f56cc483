"""Vector codes against a plain computation in Python integers."""

from __future__ import annotations

import collections
import hashlib
import math
import random

import pytest

from tenure.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, dictionary string, _salt int"


def plain(rows: list[tuple], rounds: int = 6) -> dict:
    """(vec_id, label, integers) to the sorted rows that vector_codes returns."""
    kept = [(i, label, [math.floor(max(-(2**128), min(2**128, x)) * 4096) for x in v]) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(q) for *_, q in kept), default=0) // 8) * 8
    step = width // 8
    kept = [(i, label, q + [0] * (width - len(q))) for i, label, q in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    parts = [[q[p * step : (p + 1) * step] for p in range(8)] for *_, q in kept]
    books = [[list(v[p]) for v in parts[:16]] for p in range(8)]

    def nearest(p: int, v: list[int]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(8):
            groups = collections.defaultdict(list)
            for v in parts:
                groups[nearest(p, v[p])[1]].append(v[p])
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(p, v[p]) for p in range(8)] for v in parts]
    error = [sum(d for d, _ in f) for f in found]
    by_label = collections.Counter()
    for (_, label, _), e in zip(kept, error):
        by_label[label] += min(e, 2**63 - 1)
    out = [
        (i, "".join(f"{e:02x}" for _, e in f), min(d, 2**63 - 1), min(by_label[label], 2**63 - 1), sha)
        for (i, label, _), f, d in zip(kept, found, error)
    ]
    return sorted(out, key=repr)


def coded(spark, rows: list[tuple], parts: int = 3) -> list[tuple]:
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(parts)
    out = codes.vector_codes(df)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def vectors(n: int, width: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(i * 3, [rng.choice([0.25, rng.gauss(0, 0.2)]) for _ in range(width)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        vectors(90, 16, 1),
        vectors(5, 8, 2),
        vectors(40, 24, 3)
        + [(7, None, 1), (8, [], 2), (9, [1.0, None], 1), (10, [float("nan")], 1), (11, [float("-inf")] * 24, 1)]
        + [(None, [0.5] * 24, None), (None, [0.25] * 24, 4), (0, [0.125] * 24, 1), (0, [0.125] * 24, 1), (13, [0.5] * 9, 2)],
        vectors(30, 16, 4) + [(100, [1e300] + [0.0] * 15, 1), (101, [-3e38] * 16, 2), (102, [1e6] * 16, 2), (103, [2.0**70] * 16, None)],
        [(1, [], None), (2, [], 3)],
        [(1, None, 1)],
        [],
    ],
    ids=["parts of two", "few", "odd rows", "large values", "no components", "none kept", "empty"],
)
def test_codes_match_plain_integers(spark, rows):
    assert coded(spark, rows) == plain(rows)


def test_blocks_of_any_size_agree(spark, monkeypatch):
    rows = vectors(60, 16, 5)
    whole = coded(spark, rows)
    monkeypatch.setattr(codes, "BLOCK_ROWS", 7)
    assert coded(spark, rows, 5) == whole == plain(rows)
