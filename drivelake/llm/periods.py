"""Stretches of words that repeat with a period, by the suffix automaton of the text."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, word_hashes

#: Least words of a run, and least repeats.
LEAST, TIMES = 24, 3
#: In a run at least so many successive words equal those one period on.
_WINDOW = LEAST - LEAST // TIMES


def _window_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of each window of _WINDOW (a power of two) words, from those of half the width."""
    w, width, factor = h, 1, np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        while width < _WINDOW:
            w = w[:-width] * factor + w[width:]
            width, factor = 2 * width, factor * factor
    return mix(w)


def _stretches(h: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words outside which no run can be: all windows of a run occur again in it, a third of its length away at most."""
    if len(h) < LEAST:
        return []
    w = _window_hashes(h)
    s = np.sort(w)
    if not (s[1:] == s[:-1]).any():
        return []
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    step = np.where(same, np.diff(order), len(h))
    near = np.full(len(w), len(h))
    near[order[1:]] = step
    near[order[:-1]] = np.minimum(near[order[:-1]], step)
    at = np.flatnonzero(near <= len(h) // TIMES)
    while len(at):
        cut = np.flatnonzero(np.diff(at) > _WINDOW) + 1
        start, end = at[np.concatenate([[0], cut])], at[np.concatenate([cut, [len(at)]]) - 1] + _WINDOW
        size = np.repeat(end - start, np.diff(np.concatenate([[0], cut, [len(at)]])))
        good = (near[at] * TIMES <= size) & (size >= LEAST)
        if good.all():
            return list(zip(start.tolist(), end.tolist()))
        at = at[good]
    return []


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of a sequence: of each state the longest length, the suffix link, and the position that made it (-1: a copy)."""
    to: list[dict[int, int]] = [{}]
    length, link, made, last = [0], [-1], [-1], 0
    for i, c in enumerate(ids):
        new = len(to)
        to.append({})
        length.append(i + 1)
        made.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(to)
                to.append(to[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                made.append(-1)
                link[q] = link[new] = copy
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
        last = new
    return length, link, made


def squares(ids: list[int]) -> Iterator[tuple[int, int, int]]:
    """(end, distance, length): a part of this length ends at `end` and also `distance` before it, and is at least as long.

    States from long to short give their ordered end positions to their suffix link, the smaller set into the larger one; each position
    that gets new neighbours is held against them. Two ends first meet in the state of their longest common suffix.
    """
    length, link, made = automaton(ids)
    # Sets hold -x in order: in periodic texts shorter states bring earlier positions, which then come last.
    ends: list[list[int] | None] = [[-x] if x >= 0 else [] for x in made]
    for v in np.argsort(-np.array(length), kind="stable").tolist():
        p = link[v]
        if p <= 0:
            ends[v] = None
            continue
        big, small, most = ends[p], ends[v], length[p]
        ends[v] = None
        if len(big) < len(small):
            big, small = small, big
        for x in small:
            i = bisect_left(big, x)
            if i and x - big[i - 1] <= most:
                yield -big[i - 1], x - big[i - 1], most
            if i < len(big) and big[i] - x <= most:
                yield -x, big[i] - x, most
            big.insert(i, x)
        ends[p] = big


def _has_smaller_period(a: np.ndarray, period: int) -> bool:
    """For three periods or more: whether a divisor of the period is one too."""
    rest, f = period, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            q = period // f
            if np.array_equal(a[q:], a[:-q]):
                return True
            while rest % f == 0:
                rest //= f
        f += 1
    return False


def runs_of(h: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) of a sequence of word hashes, by start and then period.

    A run has at least LEAST words and TIMES periods, and no neighbouring word goes on with its period. Its last two ends, a period
    apart, meet in the state of all but its first period; so seeds that can't be extended are the runs, and others are left to theirs.
    """
    found: set[tuple[int, int, int]] = set()
    for begin, end in _stretches(h):
        a = np.unique(h[begin:end], return_inverse=True)[1]
        ids = a.tolist()
        for x, d, most in squares(ids):
            size = most + d
            if size < LEAST or size < TIMES * d or x + 1 < len(ids) and ids[x + 1] == ids[x + 1 - d]:
                continue
            start = x + 1 - size
            run = (begin + start, size, d)
            if run in found or start and ids[start - 1] == ids[start - 1 + d] or _has_smaller_period(a[start : x + 1], d):
                continue
            found.add(run)
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length over period; ties go to the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those behind the first period of a run."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, size, period in runs:
        gone[start + period : start + size] = True
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def planted(key: object, words: list[bytes]) -> list[bytes]:
    """The words, of which a hash of the key makes a tail periodic in a tenth of all texts. Without a key nothing changes."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    first = words[a : a + p]
    return words[:a] + (first * ((n - a) // p + 1))[: n - a]


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", change: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row for each row of docs: its key, `runs` (an array of start, length, period), the strongest run's start, length and period, and
    `collapsed`: the text's words, joined by one space, without those that only repeat what stands a period before.

    Words are runs of anything but ASCII white space; `change` may alter those of a text first. Null and empty texts have no words and no
    runs; without a run start, length and period are null. Rows with equal or null keys each stand for themselves. Whole texts are
    looked at; only stretches whose windows of 16 words recur within a third of the stretch go through the automaton, which loses no
    run. It takes about 500 bytes a word of the longest such stretch.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("binary").alias("text_of_row"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def of(k: object, raw: bytes | None) -> tuple[list, tuple, bytes]:
        words = (raw or b"").split()
        if change is not None and (new := change(k, words)) is not words:
            words, raw = new, b" ".join(new)
        runs = runs_of(word_hashes(raw)) if len(words) >= LEAST else []
        return runs, strongest(runs) or (None, None, None), b" ".join(_kept(words, runs))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                out = [of(k, raw) for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x, _, _ in out], pa.list_(run))
                best = [pa.array([x[i] for _, x, _ in out], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([b.column(0), runs, *best, pa.array([x for *_, x in out], pa.binary())], [key, "runs", "start", "length", "period", "collapsed"])

    out = rows.mapInArrow(each, f"`{key}` {kind}, runs array<struct<start: long, length: long, period: long>>, start long, length long, period long, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
