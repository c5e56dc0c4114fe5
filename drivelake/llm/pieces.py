"""Ids of a SentencePiece vocabulary by a streaming Viterbi search over its scores, and back."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = "▁"
#: An unknown character scores so much less than the least piece, as in the library's own search.
_UNKNOWN = 10.0


class PieceModel:
    """Pieces and scores of a model file. Best segmentation: the largest sum of scores; ties go to the longest last piece.

    Characters in no piece become their UTF-8 bytes' ids. A space stands before the text, as in the library; a literal mark
    in a text is a character in no piece, so every text comes back as it was.
    """

    def __init__(self, path: str, room: int = 400_000):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.byte_ids, self.bytes_of = [0] * 256, []
        self.every, self._trie = 1, None
        self.pieces: list[tuple[str, float, int]] = []
        inner = False
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                body = piece.replace(_MARK, " ")
                inner |= " " in body.lstrip(" ") or "\n" in body
                self.bytes_of.append(body.encode())
                self.every = max(self.every, 2 * len(body))
                self.pieces.append((body, sp.get_score(i), i))
        self.unknown = min([0.0, *(score for _, score, _ in self.pieces)]) - _UNKNOWN
        #: No piece goes on across the start of a word or a line end: parts between those are segmented on their own.
        self.part = None if inner else re.compile(r" +[^ \n]*|\n|[^ \n]+")
        self.room, self.known = room, {}

    @property
    def trie(self) -> dict:
        """Pieces by their characters; "" leads to score and id. Built when first needed: decoding doesn't."""
        if self._trie is None:
            self._trie = {}
            for body, score, i in self.pieces:
                node = self._trie
                for c in body:
                    node = node.setdefault(c, {})
                node[""] = (score, i)
        return self._trie

    def stream(self, text: Iterable[str]) -> Iterator[int]:
        """Ids of characters that come in strings of any length.

        The window holds the scores of the last boundaries, and the backpointers since the last boundary that all surviving paths
        go through; whenever they meet again at one, the ids before it are final and leave the window.
        """
        # Of each boundary in the window: score, length of the last piece, its id (or None: bytes).
        score, back, chars, root = [0.0], [(0, None)], "", self.trie
        walks: list[tuple[int, dict]] = []  # boundaries from which a piece may still go on, and where in the trie
        for c in chain.from_iterable(text):
            chars += c
            at = len(chars)
            walks.append((at - 1, root))
            best, step, still = score[at - 1] + self.unknown, (1, None), []
            for start, node in walks:
                node = node.get(c)
                if node is None:
                    continue
                still.append((start, node))
                end = node.get("")
                if end is not None and (score[start] + end[0] > best or score[start] + end[0] == best and at - start > step[0]):
                    best, step = score[start] + end[0], (at - start, end[1])
            walks = still
            score.append(best)
            back.append(step)
            # At the start of a word all pieces before have ended: the paths meet there at once. Inside, looking now and then is enough.
            if (len(walks) > 1 or at == 1) and at % self.every:
                continue
            # Paths that can still win end here or where a piece is going on.
            live = {at, *(start for start, _ in walks)}
            while len(live) > 1:
                far = max(live)
                live.discard(far)
                live.add(far - back[far][0])
            (meet,) = live
            if meet:
                yield from self._path(back, chars, meet)
                keep = score[meet]
                chars, score, back = chars[meet:], [x - keep for x in score[meet:]], [(0, None), *back[meet + 1 :]]
                walks = [(start - meet, node) for start, node in walks]
        yield from self._path(back, chars, len(chars))

    def _path(self, back: list, chars: str, at: int) -> list[int]:
        out: list[list[int]] = []
        while at:
            n, i = back[at]
            out.append([i] if i is not None else [self.byte_ids[b] for b in chars[at - n : at].encode("utf-8", "surrogatepass")])
            at -= n
        return list(chain.from_iterable(reversed(out)))

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text, little-endian unsigned 32-bit. Parts met before are looked up."""
        if not text:
            return b""
        if self.part is None:
            return np.fromiter(self.stream([" ", text]), "<u4").tobytes()
        known, parts = self.known, self.part.findall(" " + text)
        if len(known) > self.room:
            known.clear()
        for p in set(parts).difference(known):
            known[p] = np.array(list(self.stream([p])), "<u4").tobytes()
        return b"".join(map(known.__getitem__, parts))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _few(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that only few texts and their ids are in memory at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def encode_texts(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of docs and `ids`: the text's ids as little-endian unsigned 32-bit integers (binary).

    Null and empty texts have no ids (an empty binary). Every row is handled on its own. An existing column named `ids` is replaced.
    """
    rest = [c for c in docs.columns if c != ids]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for b in _few(batches):
            out = [m.encode_bytes(t or "") for t in b.column(rest.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*rest, ids])

    return docs.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, f"{schema}, `{ids}` binary")


def decode_texts(encoded: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of encoded and `text`, decoded from the ids. Null ids give null."""
    rest = [c for c in encoded.columns if c != text]
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for b in _few(batches):
            raw = b.column(rest.index(ids)).to_pylist()
            out = [None if x is None else m.decode(np.frombuffer(x, "<u4").tolist()) for x in raw]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*rest, text])

    return encoded.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, f"{schema}, `{text}` string")
