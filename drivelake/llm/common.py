"""What several operators of this subpackage share: the work folder, hashed words, fast exact tokenizing."""

from __future__ import annotations

import re
import tempfile
import uuid
from array import array
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space: the only separators of words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A text is hashed in pieces of about this many bytes, cut between words, so that long texts stay cheap.
_PIECE = 1 << 20


def work_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables, inside the shared folder that the session names.

    Only where spark.checkpoint.dir is unset (tests on one machine) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="drivelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/drivelake-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts the lineage and survives lost executors.

    What the write has shuffled is removed from the executors' disks as soon as it has ended.
    """
    path, spark = f"{folder}/{name}", df.sparkSession
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete stored tables that no later step reads, or the whole folder."""
    for path in [f"{folder}/{n}" for n in names] or [folder]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for n places at least."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            both.append(np.cumprod(table, dtype=np.uint64))
        _powers, _inverse = both
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_piece(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8)
    word = ~_SPACE[a]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(a) and word[0]:
        edge = np.concatenate([[0], edge])
    if len(a) and word[-1]:
        edge = np.append(edge, len(a))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    powers, inverse = _tables(len(a) + 1)
    sums = np.empty(len(a) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((a + np.uint64(1)) * powers[: len(a)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(raw: bytes, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, in order. Words are runs of anything but ASCII white space."""
    if lower:
        raw = raw.translate(_LOWER)
    if len(raw) <= _PIECE:
        return _hash_piece(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _PIECE)
        if end < len(raw) and (m := _WHITE.search(raw, end)):
            end = m.end()
        elif end < len(raw):
            end = len(raw)
        parts.append(_hash_piece(raw[at:end]))
        at = end
    return np.concatenate(parts)


_WHITE = re.compile(rb"[\x20\x09-\x0d]")


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every window of k successive words; none if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
    return mix(out)


class ByteEncoder:
    """Ids of a byte-level vocabulary, equal to those of the tokenizers library with add_special_tokens=False.

    Texts go through tiktoken with the ranks of the same file. Its rule (merge the pair whose joined bytes rank
    lowest) equals merging by rank, because every entry encodes to itself: inside the span of an entry, merges come
    in the same order as in the entry alone, so its last two parts are its own pair. What tiktoken refuses, and texts that
    spell out one of the file's added tokens (which the library takes as that token), go through the tokenizers library.
    """

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        self.slow, ranks, added = _read(path, "")
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)
        self.quick = tiktoken.Encoding("same", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint16. Equal texts are encoded once."""
        known: dict[str, np.ndarray] = {}
        for t in texts:
            if t not in known:
                known[t] = np.frombuffer(array("H", self._one(t)), np.uint16)
        return [known[t] for t in texts]

    def _one(self, text: str) -> list[int]:
        if not self.added.search(text):
            try:
                return self.quick.encode_ordinary(text)
            except Exception:  # e.g. white space beyond its pattern engine's stack
                pass
        return self.slow.encode(text, add_special_tokens=False).ids


class WordEncoder:
    """Ids of a vocabulary of lower-case words with an end mark, equal to those of the tokenizers library.

    White space is dropped, so no token reaches across it: each distinct run between white space is encoded once and
    kept. New ones go, all of a batch in one string, through tiktoken with the same merges (see ByteEncoder), the end
    mark standing as the byte 1, which joins the byte before it first. Texts that the normaliser could change in
    other ways than by ASCII lower case and plain letters go through the tokenizers library.
    """

    def __init__(self, path: str, room: int = 1_200_000):
        import regex
        import tiktoken

        self.room = room
        self.slow, ranks, added = _read(path, "</w>")
        self.odd = "|".join([_RARE_SPACE, *(f"(?i:{re.escape(x)})" for x in added)])
        self.mark = np.zeros(max(ranks.values()) + 2, bool)
        self.mark[[i for b, i in ranks.items() if b[-1:] == b"\x01"]] = True
        ranks[b"\x01"] = max(ranks.values()) + 1  # never left over
        self.quick = tiktoken.Encoding("same", pat_str=r"[^\x01]*\x01", mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = np.empty(1 << 20, np.uint16)
        self.at = np.zeros(1 << 16, np.int64)

    def _encode_new(self, new: list[str]) -> list[list[int]] | tuple[np.ndarray, np.ndarray]:
        plain = [c for c in new if not _HARD.search(c)]
        hard = [c for c in new if _HARD.search(c)] if len(plain) < len(new) else []
        # Letters alone are one piece; the rest is cut, words apart by line ends.
        plain.sort(key=str.isalpha)
        mixed = sum(not w.isalpha() for w in plain)
        pieces = self.words.findall("\n".join(plain[:mixed]).lower()) if mixed else []
        letters = "\x01".join(plain[mixed:]).lower().split("\x01") if mixed < len(plain) else []
        real = [p for p in pieces if p != "\n"] + letters
        ids = np.asarray(self.quick.encode_ordinary("\x01".join(real) + "\x01") if real else [], np.int64)
        ends = np.concatenate([[0], np.flatnonzero(self.mark[ids]) + 1])  # ids up to the n-th piece
        breaks = np.flatnonzero(np.fromiter((p == "\n" for p in pieces), bool, len(pieces)))
        counts = np.append(breaks - np.arange(len(breaks)), len(real) - len(letters)) if mixed else np.empty(0, np.int64)
        counts = np.concatenate([counts, len(real) - len(letters) + 1 + np.arange(len(letters))])
        lens = np.diff(ends[counts], prepend=0)
        for c in hard:
            one = np.asarray(self.slow.encode(c, add_special_tokens=False).ids, np.int64)
            ids, lens = np.concatenate([ids, one]), np.append(lens, len(one))
        new[:] = plain + hard
        if len(lens) != len(new):
            raise AssertionError("chunks and ids do not agree")
        return ids, lens

    def _add(self, new: list[str]) -> None:
        k = len(self.code)
        ids, lens = self._encode_new(new)
        base = int(self.at[k])
        need = base + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[:base], np.empty(max(need, 2 * len(self.ids)) - base, np.uint16)])
        self.ids[base:need] = ids
        if k + len(new) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(len(new) + len(self.at), np.int64)])
        self.at[k + 1 : k + 1 + len(new)] = base + np.cumsum(lens)
        self.code.update(zip(new, range(k, k + len(new))))

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, as uint16. Each distinct word of the batch is looked up once."""
        if len(self.code) > self.room:
            self._clear()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        cut = pc.utf8_split_whitespace(column)
        ends = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        words = cut.flatten().dictionary_encode()
        distinct, place = words.dictionary.to_pylist(), words.indices.to_numpy()
        code = np.fromiter(map(self.code.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(code < 0)
        if len(missing):
            self._add([distinct[i] for i in missing])
            code[missing] = [self.code[distinct[i]] for i in missing]
        # The ids of the distinct words in a row, then of all words out of those: small enough to stay in the cache.
        first = self.at[code]
        size = (self.at[code + 1] - first).astype(np.int32)
        begin = np.cumsum(size, dtype=np.int32) - size
        known = self.ids[np.repeat(first - begin, size) + np.arange(size.sum())]
        lens = size[place]
        total = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        ids = known[np.repeat(begin[place] - total[:-1], lens) + np.arange(total[-1])]
        out = np.split(ids, total[ends[1:-1]]) if len(column) > 1 else [ids][: len(column)]
        for i in np.flatnonzero(pc.match_substring_regex(column, self.odd).to_numpy(zero_copy_only=False)):
            out[i] = np.asarray(self.slow.encode(column[int(i)].as_py(), add_special_tokens=False).ids, np.uint16)
        return out


def _read(path: str, end: str) -> tuple:
    """The tokenizer of a file, its vocabulary as bytes with ids (end marks that end a word become the byte 1), and the texts of its added tokens."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_padding()
    slow.no_truncation()
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t.content for t in slow.get_added_tokens_decoder().values()}
    ranks = {}
    for token, i in slow.get_vocab(with_added_tokens=True).items():
        if token not in special:
            ends = bool(end) and token.endswith(end)
            ranks[bytes(byte_of[c] for c in (token.removesuffix(end) if ends else token)) + b"\x01" * ends] = i
    return slow, ranks, sorted(special)


#: What only some take for white space, so that texts with it are never cut.
_RARE_SPACE = "[\\x1c-\\x1f\\x{85}\\x{1680}\\x{180e}\\x{200b}\\x{2028}\\x{2029}\\x{feff}]"
#: What composes or lower-cases in context, or is a mark of ours: anything beyond Latin letters of one code point.
_HARD = re.compile(r"[\x00-\x1f\x7f-\xa0\u0130\u0180-\uffff\U00010000-\U0010ffff]")


@lru_cache(maxsize=4)
def encoder(path: str, kind: str):
    """One for each file and worker process ("byte" or "word"); workers are used again, and so is what they know."""
    return (ByteEncoder if kind == "byte" else WordEncoder)(path)
