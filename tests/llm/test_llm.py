"""The operators of tenure.llm against brute force on small tables, with nulls, repeats and empty tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tenure.llm import ctw, embed, langid, licenses, minhash, mixing, packing, quality, queries, suffix, tokens
from tenure.llm.text import Text

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, bucket string, _key long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Prose, copies, near copies, a shared passage, very short and very long texts, nulls and clashing columns."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(25)]
    texts += texts[:5]
    words = texts[6].split()
    texts.append(" ".join(words[:-2] + ["other", "end"]))
    passage = prose(rng, 40)
    texts += [f"{prose(rng, 9)} {passage}\n{prose(rng, 8)}" for _ in range(4)]
    texts += ["", None, "one", "One", "na na " * 120, "é" * 90 + " ü" * 60, prose(rng, 6000), "x" * 900]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "k", "b", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark, docs):
    """The same with repeated rows and rows without doc_id."""
    more = spark.createDataFrame([(None, "one", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)], SCHEMA)
    return docs.unionByName(docs.filter("doc_id in (3, 36)")).unionByName(more)


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


def texts_of(docs) -> dict:
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize(
    "run",
    [
        tokens.token_counts,
        langid.languages,
        lambda d: quality.quality(d, d.select("doc_id", F.lit(1).alias("quality"))),
        packing.pack,
        minhash.near_duplicates,
        mixing.mixed,
        suffix.repeated_bytes,
        ctw.scores,
        lambda d: licenses.licences(d.withColumn("path", F.concat_ws("/", "source", "doc_id"))),
    ],
)
def test_odd_and_empty_tables(odd, run):
    assert run(odd).count() == odd.count()
    assert run(odd.limit(0)).count() == 0


def test_token_counts(docs):
    vocabulary = set(tokens.pieces(tokens.VOCABULARY))
    longest = max(map(len, vocabulary))

    def greedy(word: bytes) -> int:
        n = 0
        while word:
            k = next(k for k in range(min(longest, len(word)), 0, -1) if k == 1 or word[:k] in vocabulary)
            word, n = word[k:], n + 1
        return n

    got = by_id(tokens.token_counts(docs))
    for i, text in texts_of(docs).items():
        words = re.findall(WORD.encode(), (text or "").encode())
        assert got[i]["n_tokens"] == sum(greedy(tokens.MARK + w) for w in words)
        assert got[i]["n_words"] == len(words)


def test_automaton_on_words_of_any_length():
    machine = tokens.Automaton([b"abcd", b"bc", b"cde", b"ab", b"dea"])
    words = [bytes(w) for n in range(1, 7) for w in itertools.product(b"abcde", repeat=n) if n < 5 or w[0] == 97]
    data, off = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0] + [len(w) for w in words])
    assert machine.count(data, off).tolist() == [machine.count_one(w) for w in words]


def test_forward_backward_across_chunks():
    rng = np.random.default_rng(0)
    score, move = rng.normal(size=(150, 3)), rng.normal(size=(3, 3))
    begin = np.zeros(150, bool)
    begin[[0, 7, 90]] = True
    want = []
    for a, b in ((0, 7), (7, 90), (90, 150)):
        ahead, back = [np.exp(score[a])], [np.ones(3)]
        for i in range(a + 1, b):
            v = ahead[-1] @ np.exp(move) * np.exp(score[i])
            ahead.append(v / v.sum())
        for i in range(b - 1, a, -1):
            v = np.exp(move) @ (np.exp(score[i]) * back[-1])
            back.append(v / v.sum())
        p = np.array(ahead) * np.array(back[::-1])
        want.append(p / p.sum(1, keepdims=True))
    assert np.abs(langid.marginals(score, begin, move) - np.concatenate(want)).max() < 1e-12


def test_languages_held_out_and_switched(spark):
    rng = random.Random(1)
    parts = {"aa": ["ka", "to", "mi"], "bb": ["zö", "ßu", "ng"], "cc": ["que", "ion", "el"]}
    text = lambda lang: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(30))
    rows = [(i, text(lang), lang) for i, lang in enumerate(list(parts) * 40)] + [(900, None, "aa"), (901, "12 34", "aa"), (902, text("bb"), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(langid.languages(df))
    held = [(r[2], got[r[0]]["lang_pred"]) for r in rows[:120] if got[r[0]]["held_out"]]
    assert held and sum(a == b for a, b in held) >= 0.9 * len(held)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "bb"
    field = langid.fit(df)
    words, p, _ = langid.label_words(Text(pa.array([text("aa") + " " + text("cc")])), field)
    likely = [field.languages[k] for k in p.argmax(1)]
    assert likely[:25].count("aa") >= 22 and likely[-25:].count("cc") >= 22


def test_rare_languages_are_in_the_sample(spark):
    rng = random.Random(1)
    parts = {"aa": ["ka", "to", "mi"], "bb": ["zö", "ßu", "ng"], "cc": ["que", "ion", "el"]}
    rows = [(i, " ".join("".join(rng.choices(parts[x], k=2)) for _ in range(30)), x) for i, x in enumerate(["aa"] * 500 + ["bb"] * 300 + ["cc"] * 2)]
    field = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=30)
    assert field.languages == ["aa", "bb", "cc"]


def test_quality_base_columns_and_verdict(spark, docs):
    rng = random.Random(5)
    rows = [(1000 + i, prose(rng, 80) if i % 2 else " | ".join(prose(rng, 90).split())) for i in range(60)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows[:40]] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = by_id(quality.quality(more, labels))
    for i, text in texts_of(more).items():
        words = re.findall(WORD, text or "")
        seen = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert [got[i]["kept"] for i, _ in rows[40:]] == [bool(i % 2) for i, _ in rows[40:]]


def test_best_bounds_against_all_choices():
    rng = np.random.default_rng(4)
    for _ in range(20):
        top = np.sort(rng.choice(np.arange(1, 60), 8, replace=False)).astype(float)
        count = rng.integers(1, 9, 8).astype(float)

        def padding(bounds):
            pad = np.array([min(b for b in bounds if b >= t) for t in top])
            return float(((pad - top) * count).sum())

        least = min(padding((*c, top[-1])) for k in range(3) for c in itertools.combinations(top[:-1], k))
        assert padding(packing.best_bounds(top, count, top * count, 3)) == pytest.approx(least)


def test_packing_fills_budgets(docs):
    got = packing.pack(docs, buckets=4, budget=2000).toPandas()
    assert len(got) == docs.count() and (got.n_tokens <= got.pad_to).all()
    groups = got.groupby(["bucket", "pad_to", "batch"]).slot.agg(["count", "nunique"]).reset_index()
    assert (groups["count"] == groups["nunique"]).all()
    assert ((groups["count"] * groups.pad_to <= 2000) | (groups["count"] == 1)).all()


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, size, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    sets = {}
    for i, text in texts_of(docs).items():
        w = re.findall(WORD, lower(text))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(i):
        return i if up[i] == i else find(up[i])

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = by_id(minhash.near_duplicates(docs, size))
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), find(i), find(i) == i)


def test_near_duplicates_under_repeated_ids(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    near = c + " end"
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "y"), (5, b, "y"), (6, c, "x"), (6, d, "y"), (7, near, "x"), (None, d, "z"), (None, a, "z"), (8, None, "x"), (8, "", "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = collections.Counter(tuple(r) for r in minhash.keep_one(df).collect())
    assert got == collections.Counter(set(rows) - {(5, a, "x"), (7, near, "x")})
    out = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert out == sorted([(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (6, 6, True), (6, 6, True), (7, 6, False), (0, 6, False), (0, 1, False), (8, 8, True), (8, 8, True)])


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for n in (1, 5, 60, 900):
        a, b = np.sort(pool[: n + n // 4]), np.sort(pool[n // 4 : n + n // 2])
        sig = minhash.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.16
        assert sorted((minhash.superminhash(a[:1], np.array([0, 1]))[0] >> np.uint64(32)).tolist()) == list(range(minhash.SLOTS))


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 60)), [None, "a", "b", "c"][min(3, i % 7)]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(df).toPandas()
    assert got.target.groupby(got.source.fillna("~")).first().sum() == pytest.approx(got["size"].sum())
    sums = got.groupby(got.source.fillna("~")).agg(taken=("taken", "sum"), target=("target", "first"), own=("source_size", "first"))
    assert (abs(sums.taken - sums.target) <= 60).all() and (sums.target <= 3 * sums.own + 1e-6).all()
    assert (got.taken <= 3 * got["size"]).all()
    assert mixing.curriculum(df).count() == got.passes.sum()
    again = mixing.mixed(df.repartition(5)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_mixing_counts_what_the_sorted_mix_holds(spark, monkeypatch, tmp_path):
    rows = [(i, "abc"[i % 3], "w " * (1 + i * 7 % 40)) for i in range(120)] + [(None, "b", "no id"), (5, "a", "again"), (300, None, None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    mixes, in_order = [], mixing._in_order
    monkeypatch.setattr(mixing, "_in_order", lambda copies: mixes.append(in_order(copies)) or mixes[-1], raising=False)
    got = queries.op7_mixing(spark, str(tmp_path)).collect()
    assert len(mixes) == 1 and len(got) == len(rows)
    mix = mixes[0].collect()
    assert len(mix) == sum(r["passes"] for r in got) and sum(r["size"] for r in mix) == sum(r["taken"] for r in got)
    assert [r["_position"] for r in mix] == sorted(r["_position"] for r in mix)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "passes", "first_position").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_curriculum_takes_every_row_by_its_own_passes(spark):
    rng = random.Random(9)
    rows = [(None if i % 5 == 0 else i // 3, prose(rng, rng.randint(1, 60)), "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = collections.Counter()
    for r in mixing.mixed(df).collect():
        plan[r["doc_id"], r["size"], r["source"]] += r["passes"]
    got, words = collections.Counter(), collections.Counter()
    for r in mixing.curriculum(df).collect():
        size = len(r["text"].split())
        got[r["doc_id"], size, r["source"]] += 1
        words[r["source"]] += size
    assert got == +plan and any(i is None for i, _, _ in got)
    assert all(abs(words[r["source"]] - r["target"]) <= 60 for r in mixing.mixed(df).select("source", "target").distinct().collect())


def removed(texts: dict) -> dict:
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix.HOT, 1])
def test_repeated_bytes(docs, hot, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD", 3)
    monkeypatch.setattr(suffix.repeated_ranges, "__defaults__", (hot,))
    got = by_id(suffix.repeated_bytes(docs))
    for i, want in removed(texts_of(docs)).items():
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want


def test_stretches_of_a_text_of_many_runs(monkeypatch):
    rng = random.Random(2)
    passage = prose(rng, 60)
    text = Text(pa.array([prose(rng, 300) + passage + prose(rng, 300), "short", passage + prose(rng, 200)]))

    def windows():
        return sorted(
            (int(r), int(s) + k, int(s + p), int(a))
            for a, _, r, s, n, p in zip(*suffix.stretches(text), strict=True) for k in range(int(n))
        )

    whole = windows()
    monkeypatch.setattr(suffix, "RUN", 700, raising=False)
    assert windows() == whole
    monkeypatch.undo()
    large = Text(pa.array([""]))
    large.data, large.off = np.random.default_rng(1).integers(97, 123, (1 << 26) + 5, dtype=np.uint8), np.array([0, (1 << 26) + 5])
    _, _, _, start, n, _ = suffix.stretches(large)
    assert n.sum() == (1 << 26) + 5 - 99 and start[-1] + n[-1] == (1 << 26) + 5 - 99


def test_texts_without_repeats(docs):
    got = {r["doc_id"]: r for r in suffix.without_repeats(docs).collect()}
    want = removed(texts_of(docs))
    assert got[25]["text"] == "" and got[36]["text"] is None and got[0]["kept"] == "k"
    assert all(len((r["text"] or "").encode()) <= want[i][0] - want[i][1] for i, r in got.items())


def test_transforms_merge_into_the_order_of_all_suffixes():
    rng = np.random.default_rng(6)
    strings = [rng.integers(1, 3, rng.integers(3, 12)).astype(np.uint16) for _ in range(9)]
    ends = np.zeros(1, np.uint16)
    made = [suffix.shard_transform(np.concatenate([x for s in strings[i : i + 3] for x in (s, ends)]), 3, 4) for i in (0, 3, 6)]
    place, block = suffix.merge([b for _, b in made], [3, 3, 3], 4)
    base = np.cumsum([0] + [len(b) for _, b in made])
    order = np.empty(base[-1], int)
    order[place] = np.concatenate([o + b for (o, _), b in zip(made, base)])
    text = np.concatenate([x for s in strings for x in (s, ends)]).tolist()
    heads = [tuple(text[i : i + 4][: (text[i : i + 4] + [0]).index(0) + 1 if 0 in text[i : i + 4] else 4]) for i in order]
    assert heads == sorted(heads)
    for a, b, x, y in zip(heads, heads[1:], block, block[1:]):
        assert (x == y) == (a == b and 0 not in a)


def test_context_tree_scores(docs):
    got = by_id(ctw.scores(docs))
    held = {i: r["held_out"] for i, r in got.items()}
    words = {i: re.findall(WORD, lower(t)) + ["\n"] for i, t in texts_of(docs).items()}
    count = collections.Counter(w for i in words if not held[i] for w in words[i])
    total = sum(count.values())
    node = collections.defaultdict(lambda: [0, 0])

    def decisions(tokens):
        before = [0] * ctw.DEPTH
        for c in "".join(w + " " for w in tokens).encode():
            prefix = 1
            for k in range(7, -1, -1):
                yield tuple(before), prefix, c >> k & 1
                prefix = prefix * 2 + (c >> k & 1)
            before = [c, *before[:-1]]

    for i in words:
        for context, prefix, bit in decisions([] if held[i] else words[i]):
            for d in range(ctw.DEPTH + 1):
                node[context[:d], prefix][bit] += 1
    kt, weighted, below = {}, {}, collections.defaultdict(float)
    for key in sorted(node, key=lambda k: -len(k[0])):
        a, b = node[key]
        kt[key] = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        weighted[key] = kt[key] if len(key[0]) == ctw.DEPTH else np.logaddexp(kt[key], below[key]) - math.log(2)
        below[key[0][:-1], key[1]] += weighted[key] if key[0] else 0

    def score(tokens):
        out = 0.0
        for context, prefix, bit in decisions(tokens):
            p = None
            for d in range(ctw.DEPTH, -1, -1):
                key = context[:d], prefix
                if key in kt:
                    a, b = node[key]
                    one = (b + 0.5) / (a + b + 1)
                    share = 1 / (1 + math.exp(min(700, below[key] - kt[key]))) if p is not None else 1
                    p = share * one + (1 - share) * (p or 0)
            p = 0.5 if p is None else p
            out += math.log10(p if bit else 1 - p)
        return out

    for i in list(words)[::3]:
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words[i]), sum(w in count for w in words[i]), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in words[i]))
        assert r["score"] == pytest.approx(score(words[i]), rel=1e-8)


@pytest.mark.parametrize("block", [embed.BLOCK, 20])
def test_near_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 16))
    x = np.concatenate([x, x[:60] + 0.05 * rng.normal(size=(60, 16)), x[5:9], x[100] + 0.1 * rng.normal(size=(40, 16))])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, [float("nan")] * 16, 1), (905, [1.0], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embed.near_vectors(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.95 * near.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, *_ in bad)
    assert all(got[150 + k]["component_id"] <= k for k in range(60) if near[k, 150 + k])
    assert embed.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("mean", [0.0, 3.0])
def test_tables_reach_their_recall_for_any_number_of_rows(mean):
    rng = np.random.default_rng(8)
    x, noise = rng.normal(size=(2, 1200, 64))
    x += mean * rng.normal(size=64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tables = embed.Tables(x, 2**30, 0.9)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    other = 0.9 * x + math.sqrt(1 - 0.81) * noise
    assert tables.tables <= embed.MAX_TABLES
    assert (tables.keys(x) == tables.keys(other)).any(1).mean() >= 0.96


def test_licences_are_found_and_inherited(spark):
    rng = random.Random(2)
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/LICENSE", mit),
        (2, "a/b/c/x", prose(rng, 200)),
        (3, "a/b/y", prose(rng, 100) + "\n" + apache + "\n" + prose(rng, 50)),
        (4, "a/d/LICENSE", apache),
        (5, "a/d/e/z", prose(rng, 40)),
        (6, "other/z", prose(rng, 40) + " licensed " + prose(rng, 40)),
        (7, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = by_id(licenses.licences(df))
    assert {i: r["license"] for i, r in got.items()} == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "Apache-2.0", 5: "Apache-2.0", 6: None, 7: None}
    assert {i: r["inherited_from"] for i, r in got.items() if r["inherited_from"]} == {2: "a", 5: "a/d"}
    assert [i for i, r in got.items() if r["is_license_file"]] == [1, 4]


@pytest.mark.parametrize("total", [100, 10_000_000])
def test_licences_with_holders_in_prose_and_in_full(total):
    import pkgutil

    rng = random.Random(4)
    full = {name: pkgutil.get_data("tenure.llm", f"licence_texts/{file}.txt").decode() for name, file in licenses.FULL.items()}
    holder = lambda t: t.replace("Copyright (c)", "Copyright (c) 2019-2024 Jane Q. Doe and the Acme authors", 1)
    cases = [("MIT", "Copyright 2024 Acme. Licensed under the MIT License."), ("MIT", f"{prose(rng, 60)} Released under the MIT License. {prose(rng, 60)}")]
    cases += [("Apache-2.0", f"{prose(rng, 9)} Licensed under the Apache\n# License, Version 2.0 {prose(rng, 9)}")]
    cases += [("GPL-3.0", f"// SPDX-License-Identifier: GPL-3.0-or-later\n{prose(rng, 80)}"), ("MIT", f"# SPDX-License-Identifier: MIT\n{prose(rng, 80)}")]
    cases += [(None, "SPDX-License-Identifier: Zlib"), (None, "a license is granted to all rights holders of the work"), (None, prose(rng, 50))]
    cases += [(name, holder(t)) for name, t in full.items()]
    shares = [0.02 if w in licenses.CUES | licenses.KEYS else 0.05 for w in licenses.VOCABULARY]
    weights = np.array([math.log((1 + total) / (1 + total * x)) + 1 for x in shares] + [licenses.OTHER])
    kinds = [licenses.Templates(licenses._SHORT, weights, True), licenses.Templates(licenses._LONG, weights, False)]
    best, _, share = licenses.scan(Text(pa.array([t for _, t in cases])), kinds)
    assert best == [name for name, _ in cases]
    assert (share[-len(full) :] >= 0.5).all() and share[1] < 0.5


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    clean = docs.select("doc_id", "text", "lang", "source", "n_chars")
    clean.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == clean.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == table.count()


def mixed_in_order(rows: list) -> list:
    """(doc_id, text) of rows (doc_id, text, source) as the mix takes them, by training position."""
    size = {r: len(re.findall(WORD, r[1] or "")) for r in rows}
    own = collections.Counter()
    for r in rows:
        own[r[2]] += size[r]
    names = sorted(own, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    target = {}
    while len(target) < len(names):
        open_ = [s for s in names if s not in target]
        per = max(0.0, sum(own.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * per > 3 * own[s]]
        target |= {s: 3.0 * own[s] for s in over} if over else {s: weight[s] * per for s in open_}
    out = []
    for k, s in enumerate(names):
        start, end = mixing.CURVES[k % 3]
        before = 0
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            passes = int(target[s] / own[s] + 1e-12)
            passes += passes < 3 and before + size[r] / 2 <= target[s] - passes * own[s]
            for n in range(passes if size[r] else 0):
                area = min(1.0, (before + n * own[s]) / target[s]) * (start + end) / 2
                at = area / start if start == end else (math.sqrt(start**2 + 2 * (end - start) * area) - start) / (end - start)
                out.append((at, r[0], r[1]))
            before += size[r]
    return [(i, t) for _, i, t in sorted(out)]


def test_pipeline_batches_follow_training_position(spark, tmp_path, docs):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        table = stage(spark, table, str(tmp_path))
    taken = mixed_in_order([(r["doc_id"], r["text"], r["source"]) for r in table.collect()])
    assert len(taken) > len(set(taken)) > 9
    lengths = [len(re.findall(WORD, t)) for _, t in taken]
    top, count = np.unique(lengths, return_counts=True)
    bounds = packing.best_bounds(top.astype(float), count.astype(float), top * count.astype(float), packing.BUCKETS)
    want, filled = [], collections.Counter()
    for (i, _), n in zip(taken, lengths, strict=True):
        b = next(k for k, x in enumerate(bounds) if n <= x)
        fits = max(1, packing.BUDGET // max(1, bounds[b]))
        want.append((i, n, b, bounds[b], filled[b] // fits, filled[b] % fits))
        filled[b] += 1
    got = [tuple(r[c] for c in ("doc_id", "n_tokens", "bucket", "pad_to", "batch", "slot")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_packing_in_a_given_order(spark, tmp_path):
    rows = [(i * 7919 % 1000, "w " * (3 + i % 2)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(13, "doc_id").sortWithinPartitions("doc_id")
    df.write.parquet(str(tmp_path / "t"))
    for table in (df, spark.read.parquet(str(tmp_path / "t"))):
        got = packing.pack(packing.numbered(table), buckets=1, budget=40, ordered=True).collect()
        assert all((r["batch"], r["slot"]) == divmod(r["doc_id"], 10) for r in got) and len(got) == 1000


@pytest.mark.parametrize("n", [1, 2, 4, 10, 30, 50])
def test_small_tables_of_vectors_lose_no_link(spark, n):
    """Planted pairs beside each other, vectors of other lengths among them."""
    rng = np.random.default_rng(n)
    rows = []
    for i in range(n):
        width = 16 if i % 3 else 24
        x = rng.normal(size=width)
        x /= np.linalg.norm(x)
        noise = rng.normal(size=width)
        noise -= (noise @ x) * x
        c = rng.uniform(0.905, 0.999)
        rows += [x, c * x + math.sqrt(1 - c * c) * noise / np.linalg.norm(noise)]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)
    want = {i: sum(j != i and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9 for j, y in enumerate(rows)) for i, x in enumerate(rows)}
    got = {r["vec_id"]: r["n_links"] for r in embed.near_vectors(df).collect()}
    assert got == want


def test_made_pairs_judge_the_tables():
    """Few vectors do not make tables look better than they are."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tables = embed.Tables(x, 5000, 0.9)
    noise = rng.normal(size=(12, 200, 32))
    noise -= (noise * x[:, None]).sum(2, keepdims=True) * x[:, None]
    other = 0.9 * x[:, None] + math.sqrt(1 - 0.81) * noise / np.linalg.norm(noise, axis=2, keepdims=True)
    met = (tables.keys(np.repeat(x, 200, axis=0)) == tables.keys(other.reshape(-1, 32))).any(1)
    assert met.mean() > 0.95


def test_gradient_of_the_transitions():
    rng = np.random.default_rng(2)
    score, move = rng.normal(size=(11, 3)), rng.normal(size=(3, 3))
    begin = np.array([i in (0, 4, 5) for i in range(11)])

    def log_z(transition):
        total, state = 0.0, None
        for i in range(11):
            e = np.exp(score[i])
            if begin[i]:
                total += 0.0 if state is None else math.log(state.sum())
                state = e
            else:
                state = (state @ np.exp(transition)) * e
        return total + math.log(state.sum())

    p, pairs = langid.pair_sums(score, begin, move)
    for i in range(3):
        for j in range(3):
            step = np.zeros((3, 3))
            step[i, j] = 1e-5
            assert pairs[i, j] == pytest.approx((log_z(move + step) - log_z(move - step)) / 2e-5, abs=1e-6)
    assert np.abs(p - langid.marginals(score, begin, move)).max() == 0


def test_one_labelled_id_on_many_rows(spark):
    """What reaches the driver does not grow with the rows of a doc_id."""
    rows = [(i, f"good words number {i} " * 20) for i in range(30)] + [(i, f"bad # $ {i} " * 20) for i in range(30, 60)]
    docs = spark.createDataFrame(rows + [(5, f"another text {k}") for k in range(10_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, quality int")
    few = spark.createDataFrame(rows[:5] + [(5, min((f"another text {k}" for k in range(3))))] + rows[6:], "doc_id long, text string")
    assert quality.fit(docs, labels) is not None and quality.fit(few, labels) is not None


def test_clashing_names_come_back_unchanged(spark):
    names = ["key", "_key", "_ranges", "_at", "_range", "_place", "c0", "a.b", "_metadata"]
    text = prose(random.Random(8), 60)
    rows = [(i, text if i % 2 else prose(random.Random(i), 50), *range(100 * i, 100 * i + len(names))) for i in range(6)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = {r["doc_id"]: r for r in suffix.without_repeats(df).collect()}
    assert {i: tuple(r)[2:] for i, r in out.items()} == {r[0]: r[2:] for r in rows}
    assert out[1]["text"] == text and out[3]["text"] == out[5]["text"] == ""
    packed = packing.pack(packing.numbered(df.drop("_metadata")), ordered=True).collect()
    assert sorted(r["doc_id"] for r in packed) == list(range(6))
