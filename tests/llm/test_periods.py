"""Periodic runs against all periods tried word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from drivelake.llm import periods
from drivelake.llm.queries import op11_automaton_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """For each period the maximal stretches of words that equal those a period on; smallest period only."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(24, 3 * q) and not any(all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text, change=True):
    w = WORD.findall(text or "")
    if doc_id is not None and change:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {x for s, size, q in runs for x in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    s, size, q = best or (None, None, None)
    return (doc_id, len(runs), s, size, q, best and 1000 * size // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_runs_equal_all_periods(letters):
    rng = random.Random(letters)
    found = 0
    for _ in range(150):
        w = []
        while len(w) < rng.choice((20, 24, 60, 200)):
            part = [rng.randrange(letters) for _ in range(rng.choice((1, 2, 3, 5, 9, 20)))]
            part = part * rng.choice((1, 1, 2, 3, 4, 12))
            w += part + part[: rng.randrange(len(part) + 1)]
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = rng.randrange(letters)
        want = plain_runs(w)
        found += len(want)
        assert periods.runs_of(np.array(w, np.uint64)) == want
    assert found > 100


def test_fibonacci_and_nested_runs():
    a, b = [1], [1, 2]
    while len(b) < 600:
        a, b = b, b + a
    nested = ([1] * 30 + [2]) * 5 + [3] + ([1, 2] * 15 + [4]) * 4
    for w in (b, nested, nested * 3, [5] * 24, [5] * 23, list(range(8)) * 3, list(range(9)) * 3 + [0], [1, 2, 3] * 7 + [1, 2]):
        assert periods.runs_of(np.array(w, np.uint64)) == plain_runs(w)


def test_automaton_has_every_substring_once():
    rng = random.Random(4)
    for _ in range(30):
        w = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        length, link, _ = periods.automaton(w)
        parts = {tuple(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        assert sum(length[v] - length[link[v]] for v in range(1, len(length))) == len(parts)


def test_odd_rows(spark):
    line = "the same line of a text again "
    rows = [(1, None), (2, ""), (3, " \t\v "), (4, line * 9), (4, line * 9), (None, line * 5), (5, "x " * 30000), (6, "x y z  " * 20), (7, "Ä ö \U0001f600 " * 12)]
    df = spark.createDataFrame([(*r, "k", 3) for r in rows], "doc_id long, text string, runs string, start long")
    out = periods.find_runs(df)
    assert out.columns == ["doc_id", "runs", "start", "length", "period", "collapsed"]
    got = sorted(((r.doc_id, len(r.runs), r.start, r.length, r.period, r.collapsed) for r in out.collect()), key=str)
    short = line.strip()
    want = [(1, 0, None, None, None, ""), (2, 0, None, None, None, ""), (3, 0, None, None, None, ""), (4, 1, 0, 63, 7, short), (4, 1, 0, 63, 7, short), (None, 1, 0, 35, 7, short)]
    want += [(5, 1, 0, 30000, 1, "x"), (6, 1, 0, 40, 2, "x y z "), (7, 1, 0, 36, 3, "Ä ö \U0001f600")]
    assert got == sorted(want, key=str)
    assert periods.find_runs(df.limit(0)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted(tuple(r) for r in op11_automaton_runs(spark, sf).collect())
    small = [r for r in rows if len(r.text or "") < 5000]
    want = {r.doc_id: plain(r.doc_id, r.text) for r in small}
    assert len(got) == len(rows) and [g for g in got if g[0] in want] == [want[k] for k in sorted(want)]
    assert sum(g[1] for g in got) > 5
