"""Secrets in texts: fixed patterns, and a linear-chain conditional random field over the tokens of what looks made up."""

from __future__ import annotations

import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order that breaks ties.
KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: What a secret is written with. Parts of a text that may hold one: with a digit, or behind a colon or an equals sign.
_PART = r"[A-Za-z0-9+/_.=-]"
_DIGITS = re.compile(rf"(?<!{_PART})[A-Za-z+/_.=-]*+[0-9]{_PART}*+")
_VALUE = re.compile(rf"(?<=[:=])[\x20\"']*+({_PART}{{8,}}+)")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\x20\x09-\x0D]")
_BEFORE, _AFTER, _LEAST = 80, 24, 8
OUT, BEGIN, IN = range(3)
_BUCKETS = 1 << 15


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns; leftmost matches that don't overlap, those too short left out."""
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    # A run that is too short holds no longer one, so the least length can be part of these patterns.
    found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    return found + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]


def parts_of(text: str) -> list[tuple[int, int]]:
    """The parts of a text that the model reads, by start; all else is outside of secrets by the model's definition."""
    found = {m.start(): m.end() for m in _DIGITS.finditer(text)} | {m.start(1): m.end() for m in _VALUE.finditer(text)}
    out: list[tuple[int, int]] = []
    for start, end in sorted(found.items()):
        if end - start >= _LEAST and (not out or start >= out[-1][1]):
            out.append((start, end))
    return out


def _size(n: int) -> int:
    return next((i for i, most in enumerate((1, 2, 4, 7, 11, 15, 19, 23, 31, 39, 63)) if n <= most), 11)


def _turns(word: str) -> int:
    """How often the kind of character changes: digits, small, capital letters."""
    kinds = "".join("d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s" for c in word)
    return sum(a != b for a, b in zip(kinds, kinds[1:]))


def _shape(word: str) -> str:
    """Length, kinds of characters and how often they change."""
    if not word.isalnum():
        return word[:1]
    kinds = "".join(k for k, test in (("d", str.isdigit), ("l", str.islower), ("u", str.isupper)) if any(map(test, word)))
    if kinds == "lu" and word[1:].islower():
        kinds = "word"
    hexes = not word.strip("0123456789abcdef") or not word.strip("0123456789ABCDEF")
    return f"{_size(len(word))}{kinds}{'h' if hexes else ''}{_size(_turns(word))}"


@dataclass
class Part:
    """Tokens of one part of a text: their places, and the hashed features of each."""

    spans: list[tuple[int, int]]
    features: list[list[int]]


def read_part(text: str, start: int, end: int, file: str) -> Part:
    """Features of a part's tokens: own shape, shape of the whole part, neighbouring words and signs, traits of the file."""
    low = max(0, start - _BEFORE)
    before = [(m.start() + low, m[0].lower()) for m in _TOKEN.finditer(text[low:start])][-8:]
    words = [w for _, w in before if w.isalnum()][-3:]
    after = next(_TOKEN.finditer(text, end, end + _AFTER), None)
    tokens = list(_TOKEN.finditer(text, start, end))
    whole = text[start:end]
    letters = sum(c.isalnum() for c in whole)
    looks = f"{_size(len(whole))}/{_size(_turns(whole))}/{letters == len(whole)}"
    gap = text[max(0, start - 1) : start] or "^"
    out, shapes = [], [_shape(m[0]) for m in tokens]
    signs = "".join(w for _, w in before[-2:] if not w.isalnum())
    for i, m in enumerate(tokens):
        last = tokens[i - 1][0].lower() if i else gap
        behind = shapes[i + 1] if i + 1 < len(tokens) else f"$ {after[0][:1] if after and not after[0].isalnum() else ''}"
        near = [t[0].lower() for t in tokens[max(0, i - 4) : i] if t[0].isalnum()]
        known = [*words, *near][-3:]
        names = [
            f"s {shapes[i]}", f"w {looks}", f"p {last if len(last) == 1 else shapes[i - 1]}", f"n {behind}", f"c {shapes[i]} {shapes[i - 1] if i else '^'}",
            f"g {signs} {i == 0}", f"f {file} {shapes[i]}", f"l {looks} {shapes[i]}", f"a {i == 0} {len(tokens) == 1}", "1",
        ]
        names += [f"k {w}" for w in known] + [f"k{len(known) - j} {w}" for j, w in enumerate(known)]
        names.append(f"z {m[0][:4]}" if len(m[0]) > 4 else f"z {m[0].lower()}")
        out.append([zlib.crc32(x.encode("utf-8", "surrogatepass")) % _BUCKETS for x in names])
    return Part([m.span() for m in tokens], out)


def file_traits(text: str) -> str:
    """Of the whole text: size, and how dense equals signs, braces and digits are."""
    n = max(1, len(text))
    marks = sum(map(text.count, "={};"))
    return f"{min(7, len(str(n)))}{_size(200 * marks // n)}"


@dataclass
class Tagger:
    """A linear-chain conditional random field with the tags outside, begin, inside. Weights of hashed features, and of tag pairs."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((_BUCKETS, 3)))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))

    def scores(self, part: Part) -> np.ndarray:
        at = np.concatenate([np.asarray(f) for f in part.features])
        sizes = [len(f) for f in part.features]
        return np.add.reduceat(self.weights[at], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)

    def decode(self, part: Part) -> list[int]:
        """The most probable tags (Viterbi); no inside comes right after an outside, and before the part all is outside."""
        if not part.features:
            return []
        emit, pairs = self.scores(part).tolist(), self.pairs.tolist()
        pairs[OUT][IN] = -1e9
        score, back = [pairs[OUT][t] + emit[0][t] for t in range(3)], []
        for e in emit[1:]:
            came = [max(range(3), key=lambda s: score[s] + pairs[s][t]) for t in range(3)]
            score = [score[s] + pairs[s][t] + e[t] for t, s in enumerate(came)]
            back.append(came)
        tags = [max(range(3), key=score.__getitem__)]
        for came in reversed(back):
            tags.append(came[tags[-1]])
        return tags[::-1]

    def spans(self, part: Part) -> list[tuple[int, int]]:
        """Places of the secrets of a part."""
        out: list[list[int]] = []
        for (start, end), tag in zip(part.spans, self.decode(part)):
            if tag == BEGIN:
                out.append([start, end])
            elif tag == IN:
                out[-1][1] = end
        return [(s, e) for s, e in out]

    @classmethod
    def fit(cls, parts: list[tuple[Part, list[int]]], rounds: int = 100, rate: float = 0.15, least: float = 2e-5) -> Tagger:
        """Maximum likelihood with a penalty, by Adam over all parts at once."""
        self = cls()
        groups = [_Group(g) for low, high in ((0, 3), (3, 10), (10, 1 << 30)) if (g := [(p, t) for p, t in parts if low < len(t) <= high])]
        if not groups:
            self.weights[:, OUT] = 1.0
            return self
        n = sum(len(g.gold) for g in groups)
        theta = np.zeros(_BUCKETS * 3 + 9)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            w, pairs = np.vstack([theta[:-9].reshape(-1, 3), np.zeros((1, 3))]), theta[-9:].reshape(3, 3)
            g = sum(np.concatenate([x.ravel() for x in group.slope(w, pairs)]) for group in groups) / n - least * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights, self.pairs = theta[:-9].reshape(-1, 3), theta[-9:].reshape(3, 3)
        return self


class _Group:
    """Tagged parts of about one length, in arrays: features of each token, gold tags, which tokens are there."""

    def __init__(self, parts: list[tuple[Part, list[int]]]):
        longest, wide = max(len(t) for _, t in parts), max(len(f) for p, _ in parts for f in p.features)
        self.at = np.full((len(parts), longest, wide), _BUCKETS)  # one more row of weights, of zeros
        self.gold, self.there = np.zeros((len(parts), longest), int), np.zeros((len(parts), longest), bool)
        for i, (p, tags) in enumerate(parts):
            for j, (f, t) in enumerate(zip(p.features, tags)):
                self.at[i, j, : len(f)], self.gold[i, j], self.there[i, j] = f, t, True
        self.one_hot = (self.gold[:, :, None] == np.arange(3)) & self.there[:, :, None]
        before = np.concatenate([np.zeros((len(parts), 1), int), self.gold[:, :-1]], axis=1)
        self.pairs = np.array([[((before == s) & (self.gold == t) & self.there).sum() for t in range(3)] for s in range(3)], float)

    def slope(self, w: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What more weight of each feature and tag pair does to the log likelihood: forward and backward sums over tags."""
        n, longest, wide = self.at.shape
        there, flat = self.there, self.at.reshape(n * longest, wide)
        emit = w[flat].sum(1).reshape(n, longest, 3)
        forward, backward = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        forward[:, 0] = pairs[OUT] + emit[:, 0]
        for j in range(1, longest):
            forward[:, j] = np.where(there[:, j, None], _log_sum(forward[:, j - 1, :, None] + pairs, 1) + emit[:, j], forward[:, j - 1])
        for j in range(longest - 2, -1, -1):
            backward[:, j] = np.where(there[:, j + 1, None], _log_sum(pairs + (emit[:, j + 1] + backward[:, j + 1])[:, None, :], 2), 0.0)
        total = _log_sum(forward[:, -1], 1)
        chance = np.exp(forward + backward - total[:, None, None]) * there[:, :, None]
        pair = np.zeros((3, 3))
        pair[OUT] += chance[:, 0].sum(0)
        for j in range(1, longest):
            both = forward[:, j - 1, :, None] + pairs + (emit[:, j] + backward[:, j])[:, None, :] - total[:, None, None]
            pair += (np.exp(both) * there[:, j, None, None]).sum(0)
        gap = (self.one_hot - chance).reshape(n * longest, 3)
        grad = np.stack([np.bincount(flat.ravel(), np.repeat(gap[:, t], wide), _BUCKETS + 1)[:-1] for t in range(3)], axis=1)
        return grad, self.pairs - pair


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def tags_of(part: Part, spans: list[tuple[int, int]]) -> list[int]:
    """Tags of a part's tokens: those inside a span begin or go on with it."""
    out, open_span = [], None
    for start, end in part.spans:
        inside = next((s for s in spans if s[0] <= start and end <= s[1]), None)
        out.append(OUT if inside is None else IN if inside == open_span else BEGIN)
        open_span = inside
    return out


def labelled_parts(text: str) -> list[tuple[Part, list[int]]]:
    """The parts of a text, tagged by the fixed patterns; of assignments the value is the secret."""
    spans = [m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(s, e) for s, k, e in base_spans(text) if k != "assign" and not any(a <= s and e <= b for a, b in spans)]
    file = file_traits(text)
    out = []
    for start, end in parts_of(text):
        part = read_part(text, start, end, file)
        if len(part.spans) <= 64:
            out.append((part, tags_of(part, [s for s in spans if s[0] < end and start < s[1]])))
    return out


# Fixed values of the made-up lines that teach the model more shapes than a corpus may hold.
_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "credential", "passphrase", "secretKey", "authToken", "apiKey", "signing_key", "encryption_key", "bearer")
_OTHER = ("version", "date", "id", "phone", "address", "isbn", "url", "path", "size", "mail", "user", "port", "time", "order", "count", "reference", "color", "title", "name", "file", "page", "price", "build", "release", "host", "number", "call", "see", "from", "at", "call", "item", "branch", "model")
_FORMS = ('{k} = "{v}"', "{k}: {v}", "{k}={v}", "{k} = '{v}'", 'export {k}="{v}"', '"{k}": "{v}",', "--{k} {v}", "{k} {v}", "the {k} is {v}", "{k} => {v};", "my {k} {v} and")
_STARTS = ("ghp_", "sk-", "sk_live_", "xoxb-", "AKIA", "glpat-", "npm_", "pk-")


def _random_word(rng: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))


def _made_secret(rng: random.Random) -> str:
    kind = rng.randrange(6)
    if kind == 0:
        n, s = rng.choice((24, 32, 40, 64)), "0123456789abcdef"
        return _random_word(rng, s.upper() if rng.random() < 0.4 else s, n, n)
    if kind == 1:
        return rng.choice(_STARTS) + _random_word(rng, string.ascii_letters + string.digits, 16, 40)
    if kind == 2:
        return _random_word(rng, string.ascii_letters + string.digits + "+/", 24, 60) + rng.choice(("", "=", "=="))
    if kind == 3:
        return "eyJ" + ".".join(_random_word(rng, string.ascii_letters + string.digits + "_-", 16, 40) for _ in range(3))
    if kind == 4:
        return _random_word(rng, string.ascii_letters + string.digits, 9, 15) + _random_word(rng, string.digits, 1, 3)
    return _random_word(rng, string.ascii_letters + string.digits, 16, 48)


def _made_other(rng: random.Random) -> str:
    word = lambda low=3, high=9: _random_word(rng, string.ascii_lowercase, low, high)
    digits = lambda low, high: _random_word(rng, string.digits, low, high)
    kind = rng.randrange(16)
    return (
        lambda: digits(8, 20), lambda: ".".join(digits(1, 3) for _ in range(4)), lambda: f"{digits(1, 2)}.{digits(1, 2)}.{digits(1, 3)}", lambda: f"{digits(4, 4)}-{digits(2, 2)}-{digits(2, 2)}",
        lambda: f"{digits(3, 3)}-{digits(4, 4)}", lambda: f"{word()}.{digits(1, 2)}@{word()}{digits(1, 1)}.{word(2, 3)}", lambda: f"{word()}{digits(1, 3)}.{word()}.{word(2, 3)}", lambda: f"/{word()}/{word()}{digits(1, 2)}/{word()}.{word(2, 3)}",
        lambda: f"{word()}_{word()}_{digits(1, 3)}", lambda: f"{word()}{word().capitalize()}{word().capitalize()}{digits(0, 2)}", lambda: f"{word(5, 12)}{digits(1, 4)}", lambda: f"{word()}-{word()}-{digits(4, 4)}",
        lambda: "-".join(_random_word(rng, "0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12)), lambda: f"{word().upper()}-{digits(3, 6)}", lambda: f"{word(8, 16)}", lambda: f"{digits(4, 4)}-{digits(2, 2)}-{digits(2, 2)}T{digits(2, 2)}",
    )[kind]()


def made_lines(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with the places of the secrets in them; a third hold none."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = lambda: " ".join(_random_word(rng, string.ascii_lowercase, 2, 9) for _ in range(rng.randrange(6)))
        secret = rng.random() < 0.6
        key = rng.choice(_KEYS if secret else _OTHER)
        value = _made_secret(rng) if secret else _made_other(rng)
        key = rng.choice((key, key, key.upper(), key.capitalize()))
        bare = secret and rng.random() < 0.15 and (len(value) >= 24)
        form = rng.choice(_FORMS).replace("{k}", "" if bare or not secret and rng.random() < 0.4 else key)
        head = f"{words()} {form.split('{v}')[0]}"
        line = f"{head}{value}{form.split('{v}')[1]} {words()}"
        out.append((line, [(len(head), len(head) + len(value))] if secret else []))
    return out


def fit_tagger(docs: DataFrame | None = None, key: str = "doc_id", text: str = "text", rows: int = 2000, lines: int = 3000) -> Tagger:
    """A model from `lines` made-up labelled lines and a sample of about `rows` rows of docs, whose parts the fixed patterns tag.

    The sample is drawn by a hash of key and text, with a share of rows / count. Its parts of up to 64 tokens are read where the rows are; at
    most 10 a row of the sample reach the driver. The rows alone decide which.
    """
    taught = []
    for line, spans in made_lines(lines):
        file = file_traits(line)
        for start, end in parts_of(line):
            part = read_part(line, start, end, file)
            taught.append((part, tags_of(part, spans)))
    if docs is not None:
        draw = F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")), 11) / float(1 << 53)
        some = docs.filter(F.col(f"`{text}`").isNotNull() & (draw < rows / max(1, docs.count()))).select(F.col(f"`{text}`").alias("t"))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [x for t in b.column(0).to_pylist() for x in labelled_parts(t)]
                features = pa.array([p.features for p, _ in found], pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([features, pa.array([t for _, t in found], pa.list_(pa.int32()))], ["features", "tags"])

        found = some.mapInArrow(each, "features array<array<int>>, tags array<int>").limit(10 * rows).collect()
        taught += [(Part([], r.features), r.tags) for r in sorted(found, key=lambda r: (r.tags, r.features))]
    return Tagger.fit(taught)


def text_spans(text: str, tagger: Tagger) -> list[tuple[int, str, int]]:
    """All secrets of a text: those of the fixed patterns, and what the model adds outside of them."""
    base = base_spans(text)
    parts = parts_of(text)
    if parts:
        file, taken = file_traits(text), sorted((s, e) for s, _, e in base)
        for start, end in parts:
            for s, e in tagger.spans(read_part(text, start, end, file)):
                if e - s >= _LEAST and not any(a < e and s < b for a, b in taken):
                    base.append((s, "model", e))
    return sorted(base, key=lambda x: (x[0], KINDS.index(x[1])))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """One row for each row of docs: its key and `spans`, an array of kind, start and end (code points, end exclusive), by start and then kind.

    Kinds: assign, access and hex are the fixed patterns, `model` what the random field adds outside of them: parts of at least eight
    characters with a digit or behind a colon or an equals sign, tagged token by token. Whole texts are read. Null and empty texts have
    no spans; rows with equal or null keys each stand for themselves. Without a tagger one is fitted (see fit_tagger).
    """
    kind = docs.schema[key].dataType.simpleString()
    tagger = tagger or fit_tagger(docs, key, text)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                found = [[{"kind": k, "start": s, "end": e} for s, k, e in text_spans(t or "", tagger)] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(span))], [key, "spans"])

    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text_of_row"))
    return rows.mapInArrow(each, f"`{key}` {kind}, spans array<struct<kind: string, start: long, end: long>>")
