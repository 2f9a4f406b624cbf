"""Conversation repair against an exhaustive search and a plain version of the whole query."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import conversations
from ledgerlens.llm.queries import op13_conversation_repair
from tests.llm.conftest import TINY

SPACE = " \t\n\x0b\x0c\r"


def brute_audit(rows):
    """(cost, audit) of ``rows`` (initial, doomed, truncated): costs to go from the end, then
    the least letter that is still cheapest, step by step."""
    follows, wanted, worst = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}], "uuau", 10**9
    n = len(rows)
    best = [[worst] * 4 for _ in range(n + 1)]

    def options(t, q):
        yield "I", t, follows[q][wanted[q]], 3
        if t < n:
            initial, doomed, truncated = rows[t]
            yield "D", t + 1, q, 4
            if not doomed:
                if initial in follows[q]:
                    yield "K", t + 1, follows[q][initial], 3 * truncated
                yield "R", t + 1, follows[q][wanted[q]], 3 + 3 * truncated

    for t in range(n, -1, -1):
        if t == n:
            best[t][0] = best[t][3] = 0
        for _ in range(5):
            for q in range(4):
                best[t][q] = min([best[t][q], *(c + best[t2][q2] for _, t2, q2, c in options(t, q))])
    t, q, audit, total = 0, 0, "", best[0][0]
    while t < n or best[t][q]:
        letter, t2, q2, _ = min(o for o in options(t, q) if o[3] + best[o[1]][o[2]] == best[t][q])
        audit, t, q = audit + letter, t2, q2
    return total, audit


def viterbi(rows):
    out = []
    search = conversations.Viterbi(out.append)
    widest = 0
    for row in rows:
        search.push(*row)
        held = {id(n) for s in search.survivors if s for n in _above(s[1])}
        widest = max(widest, len(held))
    return search.finish(), "".join(out), widest


def _above(node):
    while node is not None:
        yield node
        node = node.parent


ROWS = st.lists(st.tuples(st.sampled_from("suaux "), st.booleans(), st.booleans()), max_size=14)


@settings(max_examples=400, deadline=None)
@given(ROWS)
def test_audit_equals_exhaustive_search(rows):
    cost, audit, _ = viterbi(rows)
    assert (cost, audit) == brute_audit(rows)


def test_every_short_conversation():
    from itertools import product

    kinds = [(i, d, t) for i in "suax" for d, t in ((False, False), (False, True), (True, False))]
    for size in range(4):
        for rows in product(kinds, repeat=size):
            assert viterbi(rows)[:2] == brute_audit(rows), rows


def test_undecided_rows_stay_few():
    rows = [("s", False, False)] + [("ua"[i % 2], i % 11 == 0, i % 5 == 0) for i in range(5_000)]
    cost, audit, widest = viterbi(rows)
    assert (cost, audit) == brute_audit(rows)
    assert widest < 40


def brute_query(rows):
    """The whole query for (conv_id, turn, role, text) rows."""
    word = lambda x: " " if x is None else str(x)
    talks = {}
    for conv, turn, role, text in rows:
        talk = talks.setdefault(conv, [])
        part = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = "user" if part == 4 else word(role), word(text)
        text = "" if part == 1 else "".join(c for c in text if c not in ".!?") if part == 2 else text
        talk.extend([(turn, role, text)] * (0 if part == 0 else 2 if part == 3 else 1))
    out = {}
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, *_ in talk if t is not None}
        counts, seen, symbols = defaultdict(int), set(), []
        for _, role, text in talk:
            shown = text.strip(SPACE)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = brute_audit(symbols)
        at, lines = 0, []
        for letter in audit:
            role, text = ("", "") if letter == "I" else talk[at][1:]
            at += letter != "I"
            if letter in "IR":
                role = "assistant" if lines and lines[-1][:1] == "u" else "user"
            if letter != "D":
                lines.append(f"{role}:{text}")
        initials = [r[:1] for _, r, _ in talk]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_query_equals_brute_force(spark, tiny):
    rows = [tuple(r) for r in tiny("conversations").select("conv_id", "turn", "role", "text").collect()]
    got = found(op13_conversation_repair(spark, TINY))
    assert got == brute_query(rows)
    assert len({a for *_, a, _ in got.values()}) > 3


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (2**60 + 1, 2**60 + 3, "user", "Yes"), (4, 1, "", "x."), (4, 9, "tool", "ok."), (4, 5, "assistant", "A!\n\t")]
    rows += [(5, t, "user", "Same text.") for t in range(60)] + [(6, None, "system", "Be brief."), (6, 1, "user", "é" * 50_000 + "?"), (7, 0, "assistant", "\x0b\x1c")]
    rows += [(8, t, None if t % 7 == 0 else ("user", "assistant")[t % 2], f"No {t}." if t % 5 else f"No {t}") for t in range(200)]
    dropped = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"audit": F.lit("x"), "present": F.lit(True), "repeated": F.lit(1)})
    damaged = conversations.damaged(df)
    got = found(conversations.summarize(damaged))
    assert got == brute_query(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    spoken = defaultdict(list)
    for r in conversations.repaired(damaged).orderBy("conv_id", "position").collect():
        spoken[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(spoken[c]).encode()).hexdigest() == v[-1] for c, v in got.items())
    every = conversations.repaired(damaged, deleted=True).groupBy("conv_id").count().collect()
    assert {r["conv_id"]: r["count"] for r in every} == {c: len(v[6]) for c, v in got.items() if v[6]}
    assert conversations.summarize(damaged.limit(0)).count() == conversations.repaired(damaged.limit(0)).count() == 0
