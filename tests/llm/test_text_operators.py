"""Operators on documents: defined results for odd rows, and brute-force twins."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from drivelake.llm import licenses, lines, near_dup, packing, pieces, quality, sharding, token_files

DOCS = "doc_id long, text string, k string, n long, rid string"  # clashing names on purpose


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, None) for i, t in rows], DOCS)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


ODD = [(1, None), (2, ""), (3, " \t "), (4, "one"), (5, "one"), (5, "one"), (None, "a b c d e f"), (6, "x " * 30000)]


def edit(rng, w):
    w = list(w)
    i = rng.randrange(len(w))
    kind = rng.randrange(3)
    w[i : i + (kind != 1)] = ["new"] if kind != 2 else []
    return w


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    base = [words(rng, rng.randrange(8, 40)) for _ in range(40)]
    rows = [(d, "\n".join(" ".join(rng.choice((lambda w: w, lambda w: edit(rng, w), lambda w: edit(rng, edit(rng, w))))(rng.choice(base))) for _ in range(6))) for d in range(60)]
    seen, want = [], {}
    for d, t in rows:
        kept = []
        for line in t.split("\n"):
            w = line.split()
            if not any(w == v or len(w) >= 10 and len(v) >= 10 and within_one(w, v) for v in seen):
                kept.append(line)
            seen.append(w)
        want[d] = "\n".join(kept)
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert got == want


def test_line_dedup_odd_rows(spark):
    out = lines.dedup_lines(docs(spark, [*ODD, (7, "one\n\none\n \nfresh")]))
    assert out.columns == ["doc_id", "text", "k", "n", "rid", "n_dropped_lines"]
    got = [(r.doc_id, r.text, r.n_dropped_lines) for r in out.collect()]
    assert len(got) == 9 and (1, None, 0) in got and (2, "", 0) in got and (3, " \t ", 0) in got and (4, "one", 0) in got
    assert got.count((5, "", 1)) == 2 and (7, "\n \nfresh", 2) in got
    left = {r.doc_id for r in lines.dedup_lines(docs(spark, ODD), drop_emptied=True).collect()}
    assert 5 not in left and {1, 2, 3, 4, 6, None} <= left
    assert lines.dedup_lines(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    rng = random.Random(k)
    base = [words(rng, rng.randrange(3, 120)) for _ in range(25)]
    rows = []
    for d in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4, 8))):
            w = edit(rng, w) or ["w"]
        rows.append((d, " ".join(w).upper() if d % 7 == 0 else "\n".join(w)))
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}
    group = {d: d for d in sets}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs(spark, rows), words=k, percent=percent).collect()}
    assert got == {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def test_large_group_of_mutual_near_copies_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)  # so that one bucket takes several parts
    rng = random.Random(5)
    w = words(rng, 200, 10**6)
    rows = [(d, " ".join(edit(rng, edit(rng, w)))) for d in range(100)]
    out = near_dup.near_duplicates(docs(spark, rows), words=3, percent=85)
    assert {r.component_id for r in out.collect()} == {0}


def test_near_duplicates_odd_rows(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs(spark, ODD)).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 2, None, True), (6, 1, 6, True)}
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


def test_odd_sketches_tell_high_similarities():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    y = np.concatenate([x[:960], rng.integers(0, 2**63, 40).astype(np.uint64)])
    z = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b, c = (np.frombuffer(near_dup.odd_sketch(near_dup.samples(np.unique(s))), np.uint8) for s in (x, y, z))
    odd = lambda p, q: int(np.bitwise_count(p ^ q).sum())
    assert odd(a, a) == 0 and odd(a, b) <= near_dup.most_odd_bits(0.85) < odd(a, c)
    # 960 of 1040 shared: the estimate is close.
    share = 1 + near_dup.BITS / (4 * near_dup.SAMPLES) * np.log(1 - 2 * odd(a, b) / near_dup.BITS)
    assert abs(share - 960 / 1040) < 0.04


def test_licenses_in_whole_texts(spark):
    mit, rng = licenses.TEMPLATES["MIT"], random.Random(2)
    noise = " ".join(words(rng, 5000))
    changed = mit.replace("merge, publish, distribute, ", "").replace("Software", "Program", 2)
    rows = [(1, f"{noise}\n{mit}\n{noise}\n{mit}"), (2, f"x {changed} y"), (3, noise), (4, "Released under the MIT license!"), (5, None), (6, ""), (7, "the permission of the software without the warranty " * 50)]
    got = sorted((r.doc_id, r.license, r.coverage) for r in licenses.scan_licenses(docs(spark, rows)).collect())
    assert [g[:2] for g in got] == [(1, "MIT"), (1, "MIT"), (2, "MIT"), (4, "notice: MIT")]
    assert got[0][2] == got[1][2] == 1.0 and 0.9 < got[2][2] < 1
    find = licenses.scan_licenses(docs(spark, rows)).filter("doc_id = 2").first()
    assert f"x {changed} y"[find.start_char : find.end_char] == changed.rstrip(".")
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_patience_matches_are_common_subsequences():
    rng = random.Random(4)
    for _ in range(200):
        a, b = words(rng, rng.randrange(30), 12), words(rng, rng.randrange(30), 12)
        found = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_packing_places_each_id_once(spark):
    rng = random.Random(6)
    rows = [*ODD[:5], *ODD[6:], *((100 + d, " ".join(words(rng, rng.randrange(1, 900)))) for d in range(80))]
    out = packing.pack_documents(docs(spark, rows), BYTES, shard_bytes=60_000).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for d, x in rows}
    for d, whole in ids.items():
        own = sorted((r for r in out if r.doc_id == d), key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == whole.tobytes() and all(r.doc_tokens == len(whole) for r in own)
    by = {}
    for r in sorted(out, key=lambda r: r.offset):
        assert by.get(r.sequence_id, 0) == r.offset and r.length > 0
        by[r.sequence_id] = r.offset + r.length
    full = sum(n == 1024 for n in by.values())
    assert max(by.values()) == 1024 and len(by) - full <= len({s >> packing.SEQUENCE_BITS for s in by})
    assert packing.pack_documents(docs(spark, []), BYTES).count() == 0


def test_added_tokens_are_taken_as_the_library_takes_them(spark):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|startoftext|>x<|endoftext|>", "A <|ENDOFTEXT|>", "plain"]
    for name, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in packing.encoder(path, kind).encode(texts)] == want
    out = packing.pack_documents(docs(spark, list(enumerate(texts))), BYTES).collect()
    t = Tokenizer.from_file(BYTES)
    assert {r.doc_id: r.ids for r in out} == {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, x in enumerate(texts)}


def bm25(found, everywhere=None):
    found = [np.asarray(x, np.uint16) for x in found]
    return packing.Bm25(np.array([len(x) for x in found]), packing._counted(found), everywhere)


def test_retrieval_puts_related_documents_side_by_side():
    a, b = [np.array([1 + g * 100 + i % 40 for i in range(200)]) for g in (1, 2)]
    order = list(packing.order_by_retrieval(np.array([300] * 5), bm25([a, b, a[:150], b[:150], a[50:]]), 1024))
    assert sorted(order) == [0, 1, 2, 3, 4] and set(order[:3]) == {0, 2, 4}


def test_neighbours_are_those_of_the_whole_query():
    rng = np.random.default_rng(11)
    found = [rng.choice(400, rng.integers(60, 150), p=np.arange(400, 0, -1) / 80200) for _ in range(120)]
    index, df, mean = bm25(found), {}, np.mean([len(x) for x in found])
    for x in found:
        for t in set(x.tolist()):
            df[t] = df.get(t, 0) + 1
    for i in range(0, 120, 7):
        want = [sum(np.log1p((120 - df[t] + 0.5) / (df[t] + 0.5)) * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))
                    for t in set(found[i].tolist()) if df[t] > 1 and (f := int((x == t).sum()))) for x in found]
        used = np.zeros(120, bool)
        used[i] = used[3] = True
        best = [j for j in np.argsort(-np.array(want), kind="stable") if not used[j]][: packing.NEIGHBOURS]
        assert index.neighbours(i, used).tolist() == best


def test_related_documents_share_a_shard(spark):
    rng = random.Random(12)
    vocabulary = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(300)] for _ in range(8)]
    rows = [(d, " ".join(rng.choices(vocabulary[d % 8], k=150))) for d in range(400)]
    out = packing.pack_documents(docs(spark, rows), BYTES, shard_bytes=30_000).collect()
    where = {r.doc_id: r.sequence_id >> packing.SEQUENCE_BITS for r in out}
    size, met, every = {}, 0, 0
    for d, s in where.items():
        size[s] = size.get(s, 0) + len(rows[d][1]) + 64
        for e in range(d % 8, d, 8):
            met, every = met + (where[e] == s), every + 1
    shards = len(size)
    assert 6 <= shards <= 30 and max(size.values()) <= 60_000
    assert met / every > 3 / shards  # at random, one pair in as many as there are shards


def test_large_groups_of_copies_are_split_and_keep_every_id(spark):
    rows = [(d, "the very same text " * 50) for d in range(200)] + [(1000 + d, f"another text {d} " * 20) for d in range(40)]
    out = packing.pack_documents(docs(spark, rows), BYTES, shard_bytes=20_000).collect()
    assert len({r.sequence_id >> packing.SEQUENCE_BITS for r in out}) > 5
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.offset + r.length <= 1024
    assert got == {r.doc_id: r.doc_tokens for r in out} and len(got) == 240
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)


def test_document_frequencies_are_those_of_the_whole_table(spark):
    rows = [(1, "one two two"), (2, "two three"), (3, ""), (4, "two three")]
    found = [packing.encoder(BYTES, "byte").encode([t])[0] for _, t in rows]
    df = packing.document_frequencies(spark.createDataFrame([(d, x.tobytes()) for (d, _), x in zip(rows, found)], "k long, ids binary").repartition(3))
    want = np.zeros(packing.VOCABULARY, int)
    for x in found:
        want[list(set(x.tolist()))] += 1
    assert (df == want).all()
    x, counts = [[1, 2], [1, 3], [2, 2]], np.zeros(packing.VOCABULARY)
    counts[[1, 2, 3]] = 2, 900, 2
    assert bm25(x, (1000, 2.0, counts)).neighbours(0, np.array([True, False, False])).tolist() == [1, 2]
    counts[[1, 2]] = 900, 2
    assert bm25(x, (1000, 2.0, counts)).neighbours(0, np.array([True, False, False])).tolist() == [2, 1]


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience_covers_what_a_longest_common_subsequence_does():
    """Equal to it where no word repeats, near it for edited texts of real words, and all words of one copy."""
    rng = random.Random(14)
    for _ in range(60):
        a, b = rng.sample(range(60), 30), rng.sample(range(60), 30)
        a, b = [f"w{x}" for x in a], [f"w{x}" for x in b]
        assert len(licenses.patience(a, b)) == longest_common(a, b)
        assert len(licenses.patience(a, a)) == 30
    for name in ("MIT", "ISC", "Zlib"):
        b = licenses.words_of(licenses.TEMPLATES[name])
        for _ in range(10):
            a = list(b)
            for _ in range(len(b) // 12):
                a = edit(rng, a)
            assert len(licenses.patience(a, b)) >= 0.97 * longest_common(a, b)


def test_license_finds_equal_brute_force_coverage():
    """A text holds a template if and only if the best stretch that a longest common subsequence finds covers it, up to what patience may miss."""
    rng = random.Random(15)
    template = licenses.words_of(licenses.TEMPLATES["Zlib"])[:60]
    scanner = licenses.Scanner({"t": " ".join(template)}, 0.85, 1.4)
    for _ in range(60):
        part = list(template)
        for _ in range(rng.randrange(20)):
            part = edit(rng, part)
        text = [*words(rng, 40), *part, *words(rng, 40)]
        best = max(longest_common(text[i : i + 84], template) for i in range(0, len(text), 4)) / 60
        found = scanner.scan(" ".join(text))
        assert bool(found) == (best >= 0.85) or 0.83 <= best <= 0.88
    assert licenses.Scanner({"one": "zzz"}, 0.85, 1.4).scan("a zzz b zzz")[0][:3] == ("one", 1, 1)


def test_license_tables_keys_and_repeats(spark):
    table = spark.createDataFrame([("own", "these words are our own license text and nothing else"), ("empty", None)], "name string, text string")
    text = "x THESE words are our own license; text and nothing else y"
    rows = [(None, text), (5, text), (5, text), (6, "quite another text " * 20_000)]
    got = licenses.scan_licenses(docs(spark, rows), table).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "5", "None"] and {(r.license, r.n_matched) for r in got} == {("own", 10)}
    assert {r.license for r in licenses.scan_licenses(docs(spark, [(1, licenses.TEMPLATES["BSD-3-Clause"])])).collect()} == {"BSD-3-Clause"}


def test_shards_equal_plain_scheduling_where_groups_are_large(spark):
    rng = random.Random(16)
    rows = [(d, f"{d % 40} " * rng.randrange(200, 900)) for d in range(120)]
    out = sharding.shard_by_size(docs(spark, [*rows, (None, rows[0][1])]), 4).collect()
    group = {}
    for d, t in [*rows, (None, rows[0][1])]:
        group[t] = group.get(t, 0) + len(t) + 16
    loads = [0] * 4
    for size in sorted(group.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    got = sorted(sum(r.size for r in out if r.shard == s) for s in range(4))
    assert got == sorted(loads) and len(out) == 121


def test_shards_are_even_and_keep_equal_texts_together(spark):
    rng = random.Random(7)
    rows = [(d, rng.choice(("same", "other", None, "")) if d % 3 == 0 else " ".join(words(rng, rng.randrange(200)))) for d in range(600)]
    out = sharding.shard_by_size(docs(spark, rows), 4).collect()
    assert len(out) == 600
    where = {}
    for r in out:
        where.setdefault(dict(rows)[r.doc_id] or "", set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(4)]
    assert max(sizes) < 1.02 * min(sizes)
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.text_crc32 == zlib.crc32((dict(rows)[r.doc_id] or "").encode()) for r in out)
    assert sharding.shard_by_size(docs(spark, []), 4).count() == 0 and sharding.shard_by_size(docs(spark, ODD), 4).count() == len(ODD)


def test_longest_first_is_greedy():
    assert sharding.longest_first([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def best_score(m, text):
    """Plain dynamic programme over the whole text."""
    flat, node_of = {}, [("", m.trie)]
    while node_of:
        s, node = node_of.pop()
        for c, x in node.items():
            if c:
                node_of.append((s + c, x))
            else:
                flat[s] = x[0]
    best = [0.0] + [-1e18] * len(text)
    for i in range(1, len(text) + 1):
        best[i] = best[i - 1] + m.unknown
        for n in range(1, min(i, 16) + 1):
            if text[i - n : i] in flat:
                best[i] = max(best[i], best[i - n] + flat[text[i - n : i]])
    return best[-1], flat


def path_score(m, flat, ids):
    """The score of ids: bytes that are no piece make up characters, one unknown score each."""
    score, held = 0.0, b""
    for i in ids:
        raw = m.bytes_of[i]
        if len(raw) == 1 and m.byte_ids[raw[0]] == i:
            held += raw
            try:
                held.decode()
                score, held = score + m.unknown, b""
            except UnicodeDecodeError:
                pass
        else:
            score += flat[raw.decode()]
    assert not held
    return score


def test_unknown_characters_are_on_a_best_path_too():
    m = pieces.PieceModel(PIECES)
    for text in ("\U0001f600", "a\U0001f600b \u2581\u2581 c", "\ue000\ue001 word \ue000", "\U0001f600" * 40):
        want, flat = best_score(m, " " + text)
        assert abs(path_score(m, flat, m.encode(text).tolist()) - want) < 1e-6 and m.decode(m.encode(text).tolist()) == text


def test_ids_are_final_as_soon_as_the_paths_meet():
    m, read = pieces.PieceModel(PIECES), []

    def characters():
        for c in " some words of a text " * 500:
            read.append(c)
            yield c

    ids = m.stream(characters())
    for _ in range(300):
        next(ids)
    done = sum(len(m.bytes_of[i]) for i in list(m.stream([" some words of a text " * 500]))[:300])
    assert len(read) - done < 40  # not more than a word is open


def test_streaming_viterbi_finds_a_best_path_and_decodes():
    m = pieces.PieceModel(PIECES)
    for text in ("hello world", "  two  spaces\nand\tmore ", "wörld 漢字 ▁ \U0001f600", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab", "x" * 3000):
        ids = m.encode(text)
        want, flat = best_score(m, " " + text)
        unknown = sum(len(m.bytes_of[i]) == 1 and m.byte_ids[m.bytes_of[i][0]] == i for i in ids)
        known = sum(flat[m.bytes_of[i].decode()] for i in ids if not (len(m.bytes_of[i]) == 1 and m.byte_ids[m.bytes_of[i][0]] == i))
        assert unknown or abs(known - want) < 1e-6
        assert abs(path_score(m, flat, ids.tolist()) - want) < 1e-6
        assert m.decode(ids.tolist()) == text
        assert list(m.stream([" ", *text])) == ids.tolist() == list(m.stream([" " + text]))


def test_piece_round_trip_of_rows(spark):
    out = pieces.decode_texts(pieces.encode_texts(docs(spark, ODD), PIECES), PIECES).collect()
    assert len(out) == len(ODD) and all(r.decoded == (r.text or "") for r in out) and all(r.ids == b"" for r in out if not r.text)


WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    rows = [*((d, x) for d, x in ODD if d is not None), (9, "a\x1cb É don't 12"), (0, "first")]
    out = token_files.token_files(docs(spark, rows), WORDS, shard_tokens=64).collect()
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for d, x in rows}
    start = 0
    for r in sorted(out, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        start += r.n_tokens
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == sorted(d for d, _ in rows)
    assert token_files.token_files(docs(spark, []), WORDS).count() == 0


def test_occurrences_in_token_files(spark, tmp_path):
    rows = [(7, "the cat and the dog"), (None, "the end"), (3, None), (9, "dog " * 300)]
    path = str(tmp_path / "t")
    token_files.write_token_files(docs(spark, rows), path, WORDS, shard_tokens=50)
    ids = {d: [*packing.encoder(WORDS, "word").encode([t or ""])[0].tolist(), 2] for d, t in rows}
    the, dog = ids[7][0], ids[7][4]
    got = {r.token: r.n for r in token_files.count_tokens(spark, path, [the, dog, 2, 40000]).collect()}
    assert got == {v: sum(x.count(v) for x in ids.values()) for v in (the, dog, 2, 40000)}
    places = sorted((str(r.doc_id), r.place) for r in token_files.find_token(spark, path, the).collect())
    assert places == sorted((str(d), i) for d, x in ids.items() for i, v in enumerate(x) if v == the)


def test_wavelet_matrix_equals_a_plain_array():
    rng = np.random.default_rng(8)
    for n in (0, 1, 9, 3000):
        a = rng.integers(0, 300, n).astype(np.uint16)
        w = token_files.WaveletMatrix.from_bytes(token_files.WaveletMatrix.build(a).to_bytes())
        assert (w.all_ids() == a).all()
        for i in range(0, n, 97):
            v = int(a[i])
            assert w.access(i) == v and w.rank(v, i) == (a[:i] == v).sum() and w.select(v, w.rank(v, i)) == i
        assert w.count(65000) == 0


def test_quality_features_and_verdicts(spark):
    rng = random.Random(9)
    good = [(d, "\n".join(" ".join(f"{x}word" for x in words(rng, 12, 3000)).capitalize() + "." for _ in range(6))) for d in range(150)]
    bad = [(1000 + d, " ".join(f"{x}###$$$ %%%" for x in words(rng, 60)).upper()) for d in range(30)]
    rows = [*good, *bad, (5000, None), (5001, ""), (5002, "a b c d e f " * 20)]
    out = {r.doc_id: r for r in quality.score_quality(docs(spark, rows)).collect()}
    assert all(out[d].kept for d, _ in good) and not any(out[d].kept for d, _ in bad)
    assert out[5000].n_words == 0 and out[5000].base_failed and not out[5001].kept
    assert out[5002].n_repeat_words == out[5002].n_words == 120 and out[5002].base_failed
    assert quality.keep_good(docs(spark, rows)).columns == ["doc_id", "text", "k", "n", "rid"]
    assert quality.score_quality(docs(spark, [])).count() == 0


def test_repeat_words_equal_brute_force():
    rng = random.Random(10)
    for _ in range(100):
        w = words(rng, rng.randrange(60), 4)
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        want = len({i + j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(5)})
        assert quality.text_features(" ".join(w))[5] == want


def test_features_equal_plain_counts(spark):
    rng = random.Random(17)
    texts = ["".join(rng.choice("ab .#*$%&|<>\n\t!\u00e9\u4e2d\u00a0") for _ in range(rng.randrange(200))) for _ in range(150)] + [None, "", "one", "x\n\n \nx\n x\nx"]
    rows = [(d, t) for d, t in enumerate(texts)] + [(None, "a b"), (None, "a b"), (1, texts[1])]
    got = quality.score_quality(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_words == 2
            continue
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_expectation_maximisation_equals_a_plain_one():
    rng = np.random.default_rng(18)
    votes = rng.integers(0, 3, (40, 4))
    counts = rng.integers(1, 50, 40).astype(float)
    m = quality.VoteModel.fit(list("abcd"), votes, counts, rounds=25)
    q = []
    for v in votes:
        good, bad = (v == 1).sum(), (v == 0).sum()
        q.append(0.98 if bad == 0 else min(max(((good + 0.5) / (good + bad + 1)) ** 4, 0.02), 0.98))
    for _ in range(25):
        prior = min(max(sum(n * x for n, x in zip(counts, q)) / counts.sum(), 0.01), 0.99)
        rates = np.zeros((4, 2, 2))
        for r in range(4):
            for c in (0, 1):
                n = [sum(k * (x if c else 1 - x) for k, x, v in zip(counts, q, votes) if v[r] == vote) + (0.7 if vote == c else 0.3) for vote in (0, 1)]
                rates[r, c] = np.array(n) / sum(n)
        before, q = q, []
        for v in votes:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rates[r, 1, v[r]] / rates[r, 0, v[r]]) for r in range(4) if v[r] < 2)
            q.append(1 / (1 + math.exp(-odds)))
        if max(abs(x - y) for x, y in zip(q, before)) < 1e-9:
            break
    assert np.allclose(m.posterior(votes), q, atol=1e-7) and abs(m.prior - prior) < 1e-7
