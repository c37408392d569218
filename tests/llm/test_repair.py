"""Conversation repair against an exhaustive search, and damage against a plain version."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

from pyspark.sql import functions as F

from sqlcorpus.llm.queries import op11_conversation_repair
from sqlcorpus.llm.repair import CUT, GONE, SOUND, cheapest_edits, code_of, damage, repair_conversations

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def slow_edits(rows):
    """Least (cost, audit, repaired) over all edit sequences: a plain search from the front, by row and last role."""
    @cache
    def best(i, last, inserted):
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        steps = [("I", role, "", i, 2) for role in ("user", "assistant")] if inserted < 3 else []
        if i < len(rows):
            role, text, fault = rows[i]
            steps.append(("D", None, None, i + 1, 3))
            if fault != GONE:
                cut = int(fault == CUT)
                steps += [("K", role, text, i + 1, cut), ("R", "user", text, i + 1, 2 + cut), ("R", "assistant", text, i + 1, 2 + cut)]
        for edit, role, text, after, price in steps:
            if role is not None and (not role or role[0] not in NEXT[last]):
                continue
            cost, audit, rest = best(after, role[0] if role else last, inserted + 1 if edit == "I" else 0)
            found.append((price + cost, edit + audit, ((role, text), *rest) if role else rest))
        return min(found, key=lambda f: f[:2]) if found else (1 << 40, "", ())

    return best(0, "", 0)


def test_edits_equal_search():
    rng = random.Random(1)
    for n in range(7):
        for _ in range(60):
            rows = [(rng.choice(["system", "user", "assistant", "tool", "user", "assistant"]), "x", rng.choice([SOUND, SOUND, CUT, GONE]))
                    for _ in range(n)]
            cost, audit, _ = slow_edits(tuple(rows))
            assert cheapest_edits(bytes(code_of(r[:1], f) for r, _, f in rows)) == (cost, audit), rows
    for roles in itertools.product("sua", repeat=4):
        rows = tuple((r, "x", SOUND) for r in roles)
        assert cheapest_edits(bytes(code_of(r, SOUND) for r in roles)) == slow_edits(rows)[:2]


def test_long_conversation():
    codes = bytes(random.Random(2).choices(range(12), k=20_000))
    cost, audit = cheapest_edits(codes)
    assert len(audit) - audit.count("I") == len(codes) and cost > 0
    sound = bytes([code_of("u", SOUND), code_of("a", SOUND)] * 10_000)
    assert cheapest_edits(sound) == (0, "K" * 20_000)


def slow_repair(turns):
    """Expected row of each conversation, from (conv, turn, role, text)."""
    out, space = {}, lambda x: " " if x is None else str(x)
    for conv in {t[0] for t in turns}:
        rows = []
        for c, turn, role, text in turns:
            if c != conv:
                continue
            fate = zlib.crc32(f"{space(c)}:{space(turn)}".encode()) % 20
            role, text = space(role), space(text)
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            rows += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, {"": SOUND, "truncated": CUT}.get(fault, GONE)))
        numbers = {t for t, _, _ in rows if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, repaired = slow_edits(tuple(marked)) if marked else (0, "", ())
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def odd_turns():
    rng = random.Random(6)
    turns = []
    for conv in [*range(120), None, -1]:
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["One.", "Two!", "three", "Four? ", None, "", "\t\n", "Five.\x0b", "nb\x85", "é", "..."])
            turns.append((conv, rng.choice([turn, turn, turn, None, turn + 3, 0]), role, text))
    return turns


def test_operator_equals_plain_version(spark, tmp_path):
    turns = odd_turns()
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("_conv", F.lit("x")).withColumn(
        "a.b", F.lit(1)).repartition(5)
    expected = slow_repair(turns)
    got = {r._conv: tuple(r)[1:8] + (r.repaired_sha256,) for r in repair_conversations(damage(frame)).collect()}
    assert got == {c: e for c, e in expected.items() if c in got}
    assert all(expected[c][6] == "" and expected[c][1:6] == (0,) * 5 for c in set(expected) - set(got))
    frame.drop("_conv", "a.b").write.parquet(f"{tmp_path}/conversations.parquet")
    every = {r.conv_id: tuple(r)[1:] for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert every == expected
    assert repair_conversations(damage(frame.limit(0))).count() == 0


def test_one_conversation_holds_most_rows(spark):
    """A null conversation with thousands of rows streams through two passes; its texts are never gathered."""
    turns = [(None, i, "user" if i % 2 == 0 else "assistant", "long " * 200 + f"{i}.") for i in range(4000)] + [(1, 0, "user", "a.")]
    frame = spark.createDataFrame(turns, "_conv long, _turn long, _role string, _text string")
    got = {r._conv: r for r in repair_conversations(frame).collect()}
    text = "\n".join(f"{r}:{t}" for _, _, r, t in turns[:4000])
    assert got[None].audit == "K" * 4000 and got[None].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[1].audit == "D" and got[1].cost == 3 or got[1].audit == "KI" and got[1].cost == 2
    plan = repair_conversations(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
