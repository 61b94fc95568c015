"""Conversation repair: against a plain search over all edits, and over segments of any size."""

import functools
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from velotide.llm import conversations

ROWS = "conv_id long, turn long, role string, text string"
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out[conv] += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def plain(rows):
    """Every state of the grammar is the initials so far, folded: '', 's', 'u' (a half pair) or 'a'."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    title = {"s": "system", "u": "user", "a": "assistant"}
    result, after = {}, damage(rows)
    for conv in {r[0] for r in rows}:
        held = sorted(after[conv], key=lambda r: (r[0] is not None, r[0] or 0))
        seen, kinds = set(), []
        for _, role, text in held:
            visible = text.strip(" \t\n\x0b\x0c\r")
            kind = "b" if not visible else "d" if (role, text) in seen else "t" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            kinds.append(kind)
        initials = [role[:1] for _, role, _ in held]

        @functools.cache
        def best(i, state, inserted=0, held=held, kinds=kinds, initials=initials):
            """Least (cost, audit, lines) from row i on."""
            ways = []
            if i == len(held):
                if state in ("", "a"):
                    ways.append((0, "", ()))
            else:
                _, role, text = held[i]
                cost, audit, lines = best(i + 1, state)
                ways.append((cost + 4, "D" + audit, lines))
                if kinds[i] not in ("b", "d"):
                    extra = 3 if kinds[i] == "t" else 0
                    for letter, initial, name, price in [("K", initials[i], role, 0)] + [("R", x, title[x], 3) for x in "ua"]:
                        if (state, initial) in step:
                            cost, audit, lines = best(i + 1, step[state, initial])
                            ways.append((cost + price + extra, letter + audit, (f"{name}:{text}", *lines)))
            if inserted < 3:
                for x in "ua":
                    if (state, x) in step:
                        cost, audit, lines = best(i, step[state, x], inserted + 1)
                        ways.append((cost + 3, "I" + audit, (f"{title[x]}:", *lines)))
            return min(ways, default=(10**9, "", ()))

        cost, audit, lines = best(0, "")
        turns = [t for t, _, _ in held if t is not None]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        result[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return result


def got(df):
    return {r.conv_id: (*(r[c] for c in NUMBERS), r.audit, r.repaired_sha256) for r in df.collect()}


def talk(conv, n, seed, gaps=True):
    draw = np.random.default_rng(seed)
    turn, rows = 0, []
    texts = ["Yes.", "No!", "Why?", "so then", " ", "", None, "it is late. ", "end;", "a\nb."]
    for _ in range(n):
        turn += int(draw.integers(1, 4)) if gaps else 1
        role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
        text = texts[int(draw.integers(0, len(texts)))]
        if text and draw.random() < 0.7:
            text = f"{turn} {text}"
        rows.append((conv, turn, None if draw.random() < 0.03 else str(role), text))
    return rows


@pytest.fixture(scope="module")
def talks():
    rows = [r for conv in range(150) for r in talk(conv, 1 + conv % 11, conv)]
    rows += talk(1000, 70, 1) + talk(1001, 90, 2) + talk(None, 9, 3) + [(2000, None, "user", "Hi."), (2001, 4, "user", "a.")]
    rows += [(2000, 1, "assistant", "Ho."), (2002, None, None, None)]
    return rows


@pytest.mark.parametrize("bits", [12, 2, 0])
def test_equals_plain_search(spark, talks, monkeypatch, bits):
    """The same rows whether a conversation is one segment or every row is one."""
    monkeypatch.setattr(conversations, "SEGMENT_BITS", bits)
    assert got(conversations.repair(spark.createDataFrame(talks, ROWS).repartition(6))) == plain(talks)


def test_long_conversation_is_cut(spark, talks, monkeypatch):
    rows = talk(5, 3000, 9, gaps=False) + talk(6, 3, 1)
    monkeypatch.setattr(conversations, "SEGMENT_BITS", 6)
    cut = got(conversations.repair(spark.createDataFrame(rows, ROWS).repartition(3)))
    monkeypatch.setattr(conversations, "SEGMENT_BITS", 20)
    assert cut == got(conversations.repair(spark.createDataFrame(rows, ROWS).repartition(3)))
    assert len(cut[5][6]) >= 2500


def test_least_audits_of_random_segments():
    """Every way through a segment, by all sixteen pairs of states, against plain strings."""
    draw = np.random.default_rng(2)
    for _ in range(60):
        n = int(draw.integers(1, 9))
        codes, faulty = draw.integers(0, 4, n), draw.integers(0, 4, n)
        far = conversations.costs(codes, faulty, np.array([n]))
        letter, to = conversations.first_arcs(far, codes, faulty, np.array([n]))
        rank, length, pointers = conversations.doubled(letter, to)
        found = conversations.audits(np.arange(16), letter, length, pointers)

        @functools.cache
        def ways(i, q, end, fresh=0, n=n, codes=codes, faulty=faulty):
            if i == n:
                return (0, "") if q == end else (10**9, "")
            out = [(4 + ways(i + 1, q, end)[0], "D" + ways(i + 1, q, end)[1])]
            extra = 3 if faulty[i] == 3 else 0
            if faulty[i] not in (1, 2):
                for letter, price, to in (("K", 0, conversations.KEPT[q, codes[i]]), ("R", 3, conversations.NEXT[q])):
                    if to >= 0:
                        cost, audit = ways(i + 1, int(to), end)
                        out.append((cost + price + extra, letter + audit))
            if fresh < 3:
                cost, audit = ways(i, int(conversations.NEXT[q]), end, fresh + 1)
                out.append((cost + 3, "I" + audit))
            return min(out)

        want = [ways(0, q, end) for q in range(4) for end in range(4)]
        costs = far[0].ravel().tolist()
        assert [(c, a) for c, a in zip(costs, found, strict=True) if c < conversations.FAR] == [w for w in want if w[0] < 10**9]
        reached = [k for k in range(16) if want[k][0] < 10**9]
        by_rank = sorted(reached, key=lambda k: rank[k])
        assert [want[k][1] for k in by_rank] == sorted(want[k][1] for k in reached)


def test_odd_rows(spark):
    """Repeated rows and turns, a very long text, clashing columns, all rows lost, an empty table."""
    long = "word " * 60_000 + "."
    rows = [(1, 1, "user", long), (1, 2, "assistant", long), (1, 2, "assistant", long), (1, None, None, None)]
    lost = next(k for k in range(10_000, 11_000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    rows += [(lost, 1, "user", "Hi.")]
    df = spark.createDataFrame(rows, ROWS).selectExpr(
        "*", *(f"1 AS {c}" for c in "ckey d1 d2 place code fault kind segment copy fate audit cost".split())
    )
    found = got(conversations.repair(df))
    assert found == plain(rows)
    assert found[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair(df.limit(0)).collect() == []
