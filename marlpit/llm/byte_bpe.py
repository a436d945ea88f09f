"""Token ids of a byte-level BPE tokenizer file, word by word.

A space before a character that is no white space always starts a new word of the tokenizer's pattern, so texts are
cut there, and each worker encodes a distinct word once.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

#: Distinct words whose ids a worker remembers; beyond it the memory starts anew.
WORDS_KEPT = 200_000
SPACE_RUN = re.compile(r" \s")
WORD_START = re.compile(r"(?= \S)")


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in such vocabularies: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """Ids as the tokenizer file's library gives them without added special tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(" " in x for x in special):
            raise ValueError(f"{path}: a special token holds a space")
        at = byte_of_char()
        ranks = {bytes(at[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.known: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > WORDS_KEPT:
                self.known.clear()
            found = self.known[word] = array("I", self.encoding.encode(word, allowed_special="all")).tobytes()
        return found

    def ids(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit numbers in the machine's order, little-endian on all that Spark runs on."""
        if SPACE_RUN.search(text):
            return b"".join(map(self.word, WORD_START.split(text)))
        first, *rest = text.split(" ")
        return b"".join([self.word(first), *[self.word(" " + x) for x in rest]])


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)
