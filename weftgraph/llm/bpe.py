"""BPE encoding and decoding for word-end vocabularies.

Encoding: a priority queue of merge ranks over a doubly linked list of symbols. Each popped entry names
the left symbol and the pair it was made for; entries whose symbols have changed since are stale and are
skipped. Decoding joins the vocabulary strings of the ids.

Texts are first put into normal form C, white space runs become one space, letters are lowered one code
point at a time; letters and numbers are those of Unicode 16, as the library has them. Defined results: null and empty texts have no ids and decode to the empty text; ids
outside the vocabulary decode to nothing; rows are independent; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Sequence
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, rows, sha256_hex
from .vocabulary import added_splitter, byte_alphabet, load

# Code points (first and last, hexadecimal) that the regex module calls letters or numbers and the
# library, whose tables are those of Unicode 16, does not.
NOT_LETTERS = """558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7DD-A7DD A7E2-A7E2 A7F1-A7F1 AB6C-AB6D
107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DF1-11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24
1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F
2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
NOT_NUMBERS = "11DE0-11DE9 1246F-1246F 12475-1247F 12550-12686 16FF4-16FF6"
# Capital letters (first and last) newer than Python's tables, and how far away their small letters are.
NEWER_CAPITALS = {"1C89-1C89": 1, "A7CB-A7CB": -0xA567, "A7CC-A7CC": 1, "A7CE-A7CE": 1, "A7D2-A7D2": 1, "A7D4-A7D4": 1, "A7DA-A7DA": 1, "A7DC-A7DC": -0xA641, "10D50-10D65": 0x20, "16EA0-16EB8": 0x1B}


def _ranges(text: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b, 16)) for a, b in (r.split("-") for r in text.split())]


def _class(name: str, but: str) -> str:
    """A character class without some ranges."""
    return rf"[\p{{{name}}}--[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in _ranges(but)) + "]]"


LETTER, NUMBER = _class("L", NOT_LETTERS), _class("N", NOT_NUMBERS)
LOWER = {c: c + d for r, d in NEWER_CAPITALS.items() for a, b in _ranges(r) for c in range(a, b + 1)}
NEWER = re.compile("[" + "".join(map(chr, LOWER)) + "]")
#: The pattern of pieces that are kept, and the mark of a word's end.
PIECE = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{LETTER}+|{NUMBER}|[^\p{{White_Space}}{LETTER}{NUMBER}]+"
PIECE_ASCII = r"'(?:[stmd]|re|ve|ll)|[A-Za-z]+|[0-9]|[^\t-\r A-Za-z0-9]+"
WORD_END = "</w>"
REMEMBERED = 300_000


class WordBPE(dict):
    """Encoder and decoder; as a mapping it remembers (id bytes, joined strings) of pieces."""

    def __init__(self, path: str):
        super().__init__()
        spec = load(path)
        self.vocab, self.ranks, self.added = spec["vocab"], spec["ranks"], spec["added"]
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.alphabet = byte_alphabet()
        self.cut = added_splitter(self.added)
        self.find = regex.compile(PIECE).findall
        self.find_ascii = re.compile(PIECE_ASCII).findall
        self.spaces = regex.compile(r"\p{White_Space}+")

    def normalize(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = self.spaces.sub(" ", unicodedata.normalize("NFC", text))
        low = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return low.translate(LOWER) if NEWER.search(low) else low

    def merge(self, piece: str) -> list[str]:
        """The symbols of one piece after all merges."""
        symbols: list[str | None] = [self.alphabet[b] for b in piece.encode("utf-8", "replace")]
        symbols[-1] += WORD_END
        after, before = [*range(1, len(symbols)), -1], list(range(-1, len(symbols) - 1))
        rank = self.ranks.get
        queue = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank((a, b))) is not None]
        heapify(queue)
        while queue:
            _, i, left, right = heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = left + right, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := rank((symbols[i], symbols[after[i]]))) is not None:
                    heappush(queue, (r, i, symbols[i], symbols[after[i]]))
            if (h := before[i]) >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heappush(queue, (r, h, symbols[h], symbols[i]))
        return [s for s in symbols if s is not None]

    def __missing__(self, piece: str) -> tuple[bytes, str]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = [self.vocab[s] for s in self.merge(piece) if s in self.vocab]
        made = (array("I", ids).tobytes(), self.decode(ids))
        if len(piece) < 200:
            self[piece] = made
        return made

    def _pieces(self, text: str) -> list[tuple[bytes, str]]:
        def plain(part: str) -> list[tuple[bytes, str]]:
            part = self.normalize(part)
            return list(map(self.__getitem__, self.find_ascii(part) if part.isascii() else self.find(part)))

        if self.cut is None or not any(s in text for s in self.added):
            return plain(text)
        out: list[tuple[bytes, str]] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [(array("I", [self.added[part]]).tobytes(), part)] if k % 2 else plain(part)
        return out

    def encode(self, text: str | None) -> list[int]:
        return array("I", b"".join(p[0] for p in self._pieces(text or ""))).tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """Vocabulary strings, one space between them (the vocabulary names no other decoder)."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)

    def round_trip(self, text: str | None) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        pieces = self._pieces(text) if text else []
        return b"".join(p[0] for p in pieces), " ".join(p[1] for p in pieces if p[0])


_coders: dict[str, WordBPE] = {}


def coder(path: str) -> WordBPE:
    if path not in _coders:
        _coders[path] = WordBPE(path)
    return _coders[path]


def bpe_encode(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids and decoded text of every whole text."""

    def run(batches):
        c = coder(tokenizer)
        for ids, texts in rows(batches, "doc_id", "text"):
            made = [c.round_trip(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([array("I", b).tolist() for b, _ in made], pa.list_(pa.int32())), pa.array([d for _, d in made], pa.string())], names=["doc_id", "ids", "decoded"])

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, "doc_id long, ids array<int>, decoded string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_digests(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Token counts and digests of ids and decoded text, made where the ids are, so that they are not moved."""

    def run(batches):
        c = coder(tokenizer)
        for ids, texts in rows(batches, "doc_id", "text"):
            made = [((b := c.round_trip(t))[0].__len__() // 4, sha256_hex(b[0]), sha256_hex(b[1].encode())) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, DIGEST)
