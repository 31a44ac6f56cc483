"""Wu-Manber decontamination against a search word by word."""

from __future__ import annotations

import random
import re

import pytest

from tenure.llm import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOCS = "doc_id long, text string, _key long, items string, spans string"
ITEMS = "item_id long, text string, piece string"


def words(text: str | None) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """doc_id, number of words, positions hit, items found."""
    out = []
    for doc_id, text, *_ in docs:
        w = words(text)
        at: dict[tuple, list[int]] = {}
        for k in range(1, 11):
            for i in range(len(w) - k + 1):
                at.setdefault(tuple(w[i : i + k]), []).append(i)
        hit, found = set(), set()
        for item_id, item, *_ in items:
            v = words(item)
            for i in range(max(len(v) - 10, 0) + 1 if v else 0):
                window = tuple(v[i : i + 10])
                for j in at.get(window, []):
                    hit.update(range(j, j + len(window)))
                    if item_id is not None:
                        found.add(str(item_id))
        out.append((doc_id, len(w), tuple(sorted(hit)), tuple(sorted(found))))
    return sorted(out, key=repr)


def found(spark, docs: list[tuple], items: list[tuple]) -> list[tuple]:
    d = spark.createDataFrame([(*r, 5, "a", "b") for r in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(*r, "p") for r in items], ITEMS).repartition(2)
    out = []
    for r in decontaminate.occurrences(d, b).collect():
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        out.append((r["doc_id"], r["n_words"], tuple(i for a, b in spans for i in range(a, b)), tuple(r["items"])))
    return sorted(out, key=repr)


def case(seed: int, vocabulary: list[str], lengths: list[int]) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", ". ", "--"]) for _ in range(n))
    items = [(rng.choice([i, i, 3, None]), text(rng.choice(lengths))) for i in range(12)]
    docs = [(rng.choice([i, 1, None]), text(rng.choice([0, 3, 40, 900]))) for i in range(20)]
    for i in range(8):
        item = words(rng.choice(items)[1])
        cut = rng.randint(0, max(len(item) - 12, 0))
        docs.append((50 + i, text(20) + "\t".join(item[cut : cut + 12]).upper() + " " + text(20)))
    docs += [(90, None), (91, ""), (92, "--- !"), (93, docs[-1][1]), (93, docs[-1][1])]
    return docs, items


PROSE = ["the", "on", "ethe", "heron", "a", "x" * 70, "naïve", "9th"]
CASES = {
    "long items": case(1, PROSE + [f"w{i}" for i in range(60)], [10, 11, 30, 200]),
    "short items": case(2, PROSE + [f"w{i}" for i in range(20)], [0, 1, 2, 5, 9, 10, 40]),
    "two words": case(3, ["ab", "b"], [9, 10, 15]),
    "one word": case(4, ["na"], [3, 10, 30]),
    "no items": (case(5, PROSE, [10])[0], []),
    "items without words": (case(5, PROSE, [10])[0], [(1, None), (2, "..."), (3, "")]),
    "no documents": ([], [(1, "one two")]),
}


@pytest.mark.parametrize("name", CASES)
def test_occurrences_match_plain_search(spark, name):
    docs, items = CASES[name]
    assert found(spark, docs, items) == plain(docs, items)


def test_blocks_and_pieces_agree(spark, monkeypatch):
    docs, items = CASES["short items"]
    docs = docs + [(200, items[0][1] + " ".join(f"w{i % 20} on" for i in range(3000)))]
    items = items + [(77, " ".join(f"w{i % 20} on" for i in range(60)))]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    monkeypatch.setattr(decontaminate, "PIECE_WINDOWS", 7)
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    monkeypatch.setattr(decontaminate, "STRETCH", 33)
    assert found(spark, docs, items) == plain(docs, items)


def test_digests(spark):
    import hashlib

    docs = spark.createDataFrame([(1, "One two, three"), (2, None), (3, "two")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "TWO three"), (9, "one"), (7, "four")], "item_id long, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(tuple(r) for r in decontaminate.contamination(docs, items).collect())
    assert got == [(1, 3, 3, 2, sha("10,9"), True), (2, 0, 0, 0, sha(""), False), (3, 1, 0, 0, sha(""), False)]
