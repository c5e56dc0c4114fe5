"""Conversation repair against a plain reading of its rules: every repair is tried."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from drivelake.llm import conversations
from drivelake.llm.queries import op13_shape_repair

ROWS = "conv_id long, turn long, role string, text string, conv string, n long"  # clashing names on purpose
GOAL = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        kept += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Dijkstra over (rows done, the repair's initials so far), least cost and then least audit first."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, shape, out = heapq.heappop(heap)
        if i == len(rows) and GOAL.match(shape):
            return cost, audit, out
        # What counts of a repair so far: its last two initials and its length up to two.
        if (i, shape[-1:], len(shape[:2])) in done:
            continue
        done.add((i, shape[-1:], len(shape[:2])))
        ways = [("I", 5, i, w, "") for w in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            ways.append(("D", 2, i + 1, None, ""))
            if found[i] in ("", "truncated"):
                more = 5 if found[i] else 0
                ways.append(("K", more, i + 1, role, text))
                ways += [("R", 1 + more, i + 1, w, text) for w in ("user", "assistant")]
        for e, c, j, role, text in ways:
            new = shape if role is None else shape + (role[:1] or "?")
            if role is not None and not re.match(r"s?(ua)*u?\Z", new):
                continue
            heapq.heappush(heap, (cost + c, audit + e, j, new, out if role is None else (*out, f"{role}:{text}")))


def plain(rows):
    out = {}
    for conv, kept in damage(rows).items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        found = faults(kept)
        cost, audit, repaired = cheapest(kept, found)
        turns = {t for t, *_ in kept if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], ROWS)
    out = conversations.repair_conversations(conversations.damaged(df))
    assert out.columns == ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r[0]: tuple(r[1:]) for r in out.collect()}
    assert out.count() == len(got)
    return got


TEXTS = ["One.", "Two!", "three", "", " \t", "Four? ", "five.\n", None, "Ünï. ", "One."]
ROLES = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "sys", "agent", "usher"]


@pytest.mark.parametrize("seed", range(2))
def test_repair_equals_search_over_all_repairs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(9)):
            rows.append((conv, rng.choice((turn, turn, turn, None, turn + 7)), rng.choice(ROLES), rng.choice(TEXTS) if rng.random() < 0.5 else f"{rng.random()}."))
    rows += [(None, 1, "user", "a."), (None, None, None, None), (None, 1, "user", "a."), (900, None, "system", "S.")]
    rng.shuffle(rows)
    assert result(spark, rows) == plain(rows)


def test_long_conversation_goes_through_pieces(spark):
    """Thousands of rows of one conversation, over several tasks, with equal texts and turns between them."""
    rng = random.Random(5)
    rows = [(7, t // 2 * 3, rng.choice(ROLES), rng.choice(TEXTS) if rng.random() < 0.2 else f"{t}{rng.choice('.!x')}") for t in range(3000)]
    rows += [(8, 0, "user", "x" * 300_000), (8, 1, "assistant", "y " * 200_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert conversations.shapes(conversations.damaged(df)).count() == 2
    want = plain(rows)
    assert result(spark, rows) == want


def test_repaired_rows_are_the_digest(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(ROLES), rng.choice(TEXTS)) for c in range(60) for t in range(6)]
    df = conversations.plain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    audits = conversations.audit_conversations(df)
    lines = {}
    for r in sorted(conversations.repaired_rows(df, audits).collect()):
        lines.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    for r in conversations.repair_digests(df, audits).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines.get(r.conv, [])).encode()).hexdigest()
        assert GOAL.match("".join(x[0] for x in lines.get(r.conv, [])))


def test_empty_table(spark):
    assert result(spark, []) == {}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in op13_shape_repair(spark, sf).collect()}
    assert got == plain(rows)
