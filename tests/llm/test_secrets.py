"""Secret spans: fixed patterns against plain matching, the random field against all tag sequences, held-out lines."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from drivelake.llm import secrets
from drivelake.llm.queries import op12_field_secrets

PLAIN = {
    "assign": (re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[1]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def plain(text):
    out = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, (p, good)) in enumerate(PLAIN.items()) for m in p.finditer(text or "") if good(m)]
    return [x for *_, x in sorted(out)]


@pytest.fixture(scope="module")
def tagger():
    return secrets.fit_tagger()


def test_fixed_patterns_equal_plain_matching():
    rng = random.Random(2)
    bits = ["password", "PASSWD", "Secret", "token", "api_key", "APIkey", "apı_key", "toKen", "=", ":", " ", '"', "'", "abc", "AKIA", "ABCDEFGH12", "deadbeef01", "ſecret", "é", "\n", "x=y", "\U0001f600", "\t"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        got = [f"{k}:{s}:{e}" for s, k, e in sorted(secrets.base_spans(text), key=lambda x: (x[0], secrets.KINDS.index(x[1])))]
        assert got == plain(text), text


def test_decoding_and_slopes_equal_all_tag_sequences():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(1, 5))
        part = secrets.Part([(i, i + 1) for i in range(n)], rng.integers(0, 40, (n, 3)).tolist())
        t = secrets.Tagger(pairs=rng.normal(size=(3, 3)))
        t.weights[:40] = rng.normal(size=(40, 3))
        emit = np.array([sum(t.weights[f] for f in fs) for fs in part.features])
        score = lambda tags: sum(t.pairs[a, b] for a, b in zip((0, *tags), tags)) + sum(emit[i, x] for i, x in enumerate(tags))
        every = list(itertools.product(range(3), repeat=n))
        legal = [x for x in every if all((a, b) != (secrets.OUT, secrets.IN) for a, b in zip((0, *x), x))]
        assert tuple(t.decode(part)) == max(legal, key=score)
        gold = every[int(rng.integers(len(every)))]
        p = np.exp([score(x) for x in every])
        p /= p.sum()
        want, pairs = np.zeros_like(t.weights), np.zeros((3, 3))
        for x, w in [(gold, 1.0), *zip(every, -p)]:
            for i, tag in enumerate(x):
                for f in part.features[i]:
                    want[f, tag] += w
                pairs[(0, *x)[i], tag] += w
        grad, pair = secrets._Group([(part, list(gold))]).slope(np.vstack([t.weights, np.zeros((1, 3))]), t.pairs)
        assert np.allclose(grad, want) and np.allclose(pair, pairs)


def test_held_out_lines(tagger):
    right = wrong = missed = 0
    for line, spans in secrets.made_lines(1500, seed=99):
        got = [(s, e) for a, b in secrets.parts_of(line) for s, e in tagger.spans(secrets.read_part(line, a, b, secrets.file_traits(line)))]
        right += got == spans
        wrong += bool(got) and not spans
        missed += bool(spans) and not got
    assert right >= 0.97 * 1500 and wrong <= 15 and missed <= 30


def test_other_keys_and_plain_texts(tagger):
    for line, secret in [("pwd: Xk29dkLmQ0z8", "Xk29dkLmQ0z8"), ('db_pass = "hunter2hunter2"', "hunter2hunter2"), ("key ghp_16C7e42F292c6912E7710c838347Ae178B4a now", "ghp_16C7e42F292c6912E7710c838347Ae178B4a")]:
        assert [line[s:e] for s, k, e in secrets.text_spans(line, tagger) if k == "model"] == [secret]
    for line in ("see RFC 2616 and 97.51.17.173 or 9807915762804490", "call +1 (017) 555-7713 now", "x.34@mail7.example.com", "https://example.com/a/b?id=123456789", "chapter12 of volume3: introduction"):
        assert secrets.text_spans(line, tagger) == []


def test_odd_rows(spark, tagger):
    key = 'token = "' + "0123456789abcdef" * 2 + '"'
    rows = [(1, None), (2, ""), (3, "\U0001f600 " + key), (3, "\U0001f600 " + key), (None, key), (4, "a1 " * 50_000 + key), (5, "=" * 100_000), (6, "g" * 300_000 + "1")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, kind long")
    out = secrets.find_secrets(df, tagger=tagger)
    assert out.columns == ["doc_id", "spans"]
    got = {(r.doc_id, tuple(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind != "model")) for r in out.collect()}
    assert out.count() == 8
    assert {(1, ()), (2, ()), (3, ("assign:2:43", "hex:11:43")), (None, ("assign:0:41", "hex:9:41")), (4, ("assign:150000:150041", "hex:150009:150041")), (5, ()), (6, ())} == got
    assert secrets.find_secrets(df.limit(0), tagger=tagger).count() == 0
    assert secrets.fit_tagger(df.limit(0), lines=50).decode(secrets.Part([], [])) == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op12_field_secrets(spark, sf).collect()
    assert len(got) == len(texts) and sum(r.n_hex for r in got) > 5
    for r in got:
        want = plain(texts[r.doc_id])
        kinds = [x.split(":")[0] for x in want]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(kinds.count, PLAIN)) and r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("model")] == want
    assert sum("model" in r.spans for r in got) <= 2
