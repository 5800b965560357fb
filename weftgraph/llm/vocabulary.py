"""Reading of tokenizer files: vocabularies over bytes, merge ranks, pre-token patterns."""

from __future__ import annotations

import json
from functools import lru_cache

import regex


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Rule: printable Latin-1 bytes stand for themselves, the others get the code points from 256 on.
    """
    own = [b for r in ((33, 126), (161, 172), (174, 255)) for b in range(r[0], r[1] + 1)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(spare)) for b in range(256)}


@lru_cache(maxsize=4)
def load(path: str) -> dict:
    """Vocabulary, merge ranks and added strings of a tokenizer file, once for each process."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return {
        "vocab": spec["model"]["vocab"],
        "ranks": {m: i for i, m in enumerate(merges)},
        "added": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


def added_splitter(added: dict[str, int]):
    """A pattern that cuts a text at the added strings, longest first; None without any."""
    if not added:
        return None
    return regex.compile("(" + "|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True)) + ")")
