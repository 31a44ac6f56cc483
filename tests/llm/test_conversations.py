"""Conversation repair against a search over all edits, with segments of any size."""

from __future__ import annotations

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tenure.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, _conv string, segment long, cost int"
SPACES = " \t\n\x0b\x0c\r"


def hurt(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def least_edits(rows: list[tuple]) -> tuple[int, str, list[str]]:
    """Cost, initials and rows of the cheapest edits, the ASCII-least first: a plain search from the start in that order.

    rows: (role, text, fault) in order.
    """
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        state = roles[-1:]
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(out)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        following = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        push = lambda c, e, j, r, o: heapq.heappush(heap, (cost + c, audit + e, j, (roles + r)[-1:] if len(roles + r) > 1 and (roles + r)[-1] == "s" else _short(roles + r), o))  # noqa: B023, E731
        for r, name in (("u", "user"), ("a", "assistant")):
            if r in following:
                push(2, "I", i, r, (*out, f"{name}:"))
        if i < len(rows):
            role, text, fault = rows[i]
            push(3, "D", i + 1, "", out)
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] and role[:1] in following:
                    push(extra, "K", i + 1, role[:1], (*out, f"{role}:{text}"))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in following:
                        push(2 + extra, "R", i + 1, r, (*out, f"{name}:{text}"))
    raise AssertionError


def _short(roles: str) -> str:
    """The same state and the same answer to whether the roles are complete, in at most two letters."""
    if not roles or roles == "s":
        return roles
    return "ua" if roles[-1] == "a" else "u"


def plain(rows: list[tuple], damage: bool = True) -> list[tuple]:
    groups: dict = collections.defaultdict(list)
    for row in rows:
        groups[row[0]] += []
    spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for row in hurt(rows) if damage else spaced:
        groups[row[0]].append(row[1:])
    out = []
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in turns:
            rest = text.rstrip(SPACES)
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        count = collections.Counter(f for *_, f in marked)
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, lines = least_edits(marked)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha))
    return sorted(out, key=repr)


def chats(seed: int, n: int, longest: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            role = "system" if turn == 0 and rng.random() < 0.3 else rng.choice(["system", "tool", "", None, "u"]) if rng.random() < 0.08 else role
            text = rng.choice(["yes.", "no", "Why? ", "", " \t\n", None, "fine!\n", "a" * 30, f"{conv} {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, text))
    return rows


def structure(spark, rows: list[tuple], damage: bool = True, parts: int = 3) -> list[tuple]:
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(parts)
    out = conversations.structure(conversations.damaged(df) if damage else df)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


CASES = {
    "short": chats(1, 120, 8),
    "long": chats(2, 6, 120),
    "odd ids": [(None, t, r, x) for _, t, r, x in chats(3, 4, 9)] + [(5, -(2**63), "user", "a."), (5, 2**63 - 1, "assistant", "b.")],
    "only nulls": [(None, None, None, None), (1, None, None, None), (2, None, "user", None)],
    "repeated rows": [(1, 4, "user", "a.")] * 9 + [(1, 4, "user", "b.")] * 3 + [(1, 2, "user", "a.")] + [(2, 0, "user", " ")] * 5,
    "empty": [],
}


def expected(name: str, damage: bool) -> list[tuple]:
    top = 2**63 - 1
    return [(r[0], min(r[1], top), *r[2:]) for r in plain(CASES[name], damage)]


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("damage", [True, False])
def test_structure_matches_search(spark, name, damage):
    assert structure(spark, CASES[name], damage) == expected(name, damage)


def test_segments_of_any_size_agree(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", 5)
    for name in ("long", "repeated rows"):
        assert structure(spark, CASES[name], parts=4) == expected(name, True)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "user", "Hello?"), (1, 3, "assistant", ""), (1, 4, "assistant", "Yes.")]
    got = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert "".join(r["audit"] for r in got) == "KKIKDK"
    turns = [(t["role"], t["text"]) for r in sorted(got, key=lambda r: r["segment"]) for t in r["turns"]]
    assert turns == [("system", "Be kind."), ("user", "Hi!"), ("assistant", ""), ("user", "Hello?"), ("assistant", "Yes.")]


def test_division_finds_the_least_initials():
    rng = random.Random(9)
    for _ in range(300):
        codes = bytes(rng.choice(range(9)) for _ in range(rng.randint(0, 9)))
        rows = [(("x", "system", "user", "assistant")[max(c - 1, 0) // 2], "t", "blank" if c == 0 else "truncated" if (c - 1) % 2 else "") for c in codes]
        cost, audit, _ = least_edits(rows)
        assert conversations.solve(codes, conversations.NOTHING, None) == (audit, cost)
