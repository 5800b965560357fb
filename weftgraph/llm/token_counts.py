"""Token counts by prefix dynamic programming.

For a byte-level BPE the encoding of a string is the only sequence of tokens in which every token
encodes to itself and every two neighbours encode to themselves together. So the last token of each
prefix follows from the last tokens of shorter prefixes, and with it the exact token count of *every*
prefix. The tables are kept for each distinct pre-token; over a text they are added up, which answers
"how many tokens has the first half", "where do 1024 tokens end" and "is this over budget" without
encoding anything again.

Defined results: a null or empty text has 0 tokens and 0 bytes; strings of added tokens inside a text
count as one token each (the library's default); rows are independent, so ties, repeated rows and extra
columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, rows
from .vocabulary import added_splitter, byte_alphabet, load

#: The pre-token pattern of byte-level BPE vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for ASCII texts, for the faster engine.
PRETOKEN_ASCII = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Distinct pre-tokens and token pairs that one worker remembers; past it the memory starts afresh.
REMEMBERED = 400_000
NEVER = 1 << 60
#: Bytes of a pre-token past which its prefixes are not remembered.
LONG = 200


class PrefixCounter(dict):
    """Counts of whole pre-tokens (as a mapping), prefix tables, and questions about texts."""

    def __init__(self, path: str):
        super().__init__()
        spec = load(path)
        self.alphabet = byte_alphabet()
        back = {c: b for b, c in self.alphabet.items()}
        as_bytes = lambda s: bytes(back[c] for c in s)
        self.ranks = {(as_bytes(a), as_bytes(b)): r for (a, b), r in spec["ranks"].items()}
        self.added = spec["added"]
        self.cut = added_splitter(self.added)
        own = {as_bytes(s) for s in spec["vocab"] if s not in self.added}
        self.longest = max(map(len, own))
        self.tokens = own
        self.made = {a + b: (a, b, r) for (a, b), r in self.ranks.items()}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.states: dict[bytes, tuple[bytes, int]] = {b"": (b"", 0)}
        self.find = regex.compile(PRETOKEN).findall
        self.find_ascii = re.compile(PRETOKEN_ASCII).findall

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The symbols at one end of a token while it is put together, each with the rank of the merge that ends it."""
        out, end = [], NEVER
        while True:
            out.append((token, end))
            if token not in self.made:
                return out
            left, right, end = self.made[token]
            token = right if side else left

    def _stable(self, left: bytes, right: bytes) -> bool:
        """Whether two neighbours stay apart: no two symbols that meet at their border merge while both are there.

        On equal ranks the leftmost pair merges first, so the border's merge beats one to its right only.
        """
        rank = self.ranks.get
        ends = self._spine(right, 0)
        for x, x_end in self._spine(left, 1):
            for y, y_end in ends:
                r = rank((x, y))
                if r is not None and r < x_end and r <= y_end:
                    return False
        return True

    def _state(self, prefix: bytes) -> tuple[bytes, int]:
        """Last token and token count of a prefix whose own prefixes are known."""
        end = len(prefix)
        for start in range(max(0, end - self.longest), end):
            token = prefix[start:]
            if token in self.tokens:
                last, count = self.states[prefix[:start]]
                if not start:
                    return token, 1
                pair = (last, token)
                stable = self.pairs.get(pair)
                if stable is None:
                    stable = self.pairs[pair] = self._stable(last, token)
                if stable:
                    return token, count + 1
        raise ValueError("the vocabulary does not cover every byte")

    def table(self, piece: bytes) -> list[int]:
        """Token counts of all prefixes of one pre-token, the empty one first."""
        states = self.states
        if len(states) >= REMEMBERED or len(self.pairs) >= REMEMBERED:
            states.clear()
            self.pairs.clear()
            states[b""] = (b"", 0)
        if len(piece) > LONG:
            return self._long_table(piece)
        counts = [0]
        for end in range(1, len(piece) + 1):
            prefix = piece[:end]
            state = states.get(prefix)
            if state is None:
                state = states[prefix] = self._state(prefix)
            counts.append(state[1])
        return counts

    def _long_table(self, piece: bytes) -> list[int]:
        """The same over positions, for a pre-token whose prefixes are not worth keeping: linear in its length."""
        last, counts = [b""], [0]
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = piece[start:end]
                if token in self.tokens and (not start or self._stable(last[start], token)):
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
            else:
                raise ValueError("the vocabulary does not cover every byte")
        return counts

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        count = self.table(piece.encode("utf-8", "replace"))[-1]
        if len(piece) < 200:
            self[piece] = count
        return count

    def pieces(self, text: str) -> list[str]:
        return self.find_ascii(text) if text.isascii() else self.find(text)

    def _spans(self, text: str) -> Iterator[tuple[str, bool]]:
        if self.cut is None or not any(s in text for s in self.added):
            yield text, False
        else:
            for k, part in enumerate(self.cut.split(text)):
                yield part, k % 2 == 1

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        return sum(1 if special else sum(map(self.__getitem__, self.pieces(part))) for part, special in self._spans(text))

    def prefixes(self, text: str | None) -> TextPrefixes:
        return TextPrefixes(self, text or "")


class TextPrefixes:
    """Counts at the pre-token ends of one text, and exact answers for any prefix (in code points)."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.parts = [(p, s) for part, special in counter._spans(text) for p, s in ([(part, True)] if special else [(x, False) for x in counter.pieces(part)])]
        self.ends = list(accumulate(len(p) for p, _ in self.parts))
        self.sums = [0, *accumulate(1 if s else counter[p] for p, s in self.parts)]

    def count(self, length: int | None = None) -> int:
        """Tokens of the first ``length`` code points (all by default)."""
        length = len(self.text) if length is None else max(0, min(length, len(self.text)))
        if length == 0:
            return 0
        k = bisect_left(self.ends, length)  # the part that holds the last code point
        if length == self.ends[k] and (k + 1 == len(self.parts) or not self.parts[k][0].isspace()):
            return self.sums[k + 1]
        # Only the white space before the cut part can be split otherwise when the text ends here.
        while k and not self.parts[k - 1][1] and self.parts[k - 1][0].isspace():
            k -= 1
        start = self.ends[k - 1] if k else 0
        return self.sums[k] + sum(self.counter[p] for p in self.counter.pieces(self.text[start:length]))

    def truncate(self, budget: int) -> int:
        """The prefix, in code points, that fills ``budget`` tokens and encodes to no more by itself.

        Whole pre-tokens first, then the prefix table of the one that does not fit: its longest prefix of whole code points
        whose count is still within the budget.
        """
        k = bisect_right(self.sums, budget) - 1
        start = self.ends[k - 1] if k > 0 else 0
        if k >= len(self.parts) or self.parts[k][1]:
            while start and self.count(start) > budget:
                start -= 1
            return start
        raw = self.parts[k][0].encode("utf-8", "replace")
        counts = self.counter.table(raw)
        fits = [n for n, c in enumerate(counts) if c <= budget - self.sums[k] and (n == len(raw) or raw[n] & 0xC0 != 0x80)]
        length = start + len(raw[: fits[-1]].decode("utf-8"))
        # White space before a cut may be split otherwise than within the text: the count of the prefix itself decides.
        while length and self.count(length) > budget:
            length -= 1
        return length


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text; one pass, no shuffle."""

    def run(batches):
        c = counter(tokenizer)
        for ids, texts in rows(batches, "doc_id", "text"):
            counts = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t.encode("utf-8", "replace")) if t else 0 for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, SCHEMA)
