"""Byte-level BPE ids of whole texts, through a memo of words.

A text whose white space is single spaces and line ends only is the concatenation of its words: no match of the
public split pattern crosses a space before a word or a single line end. So the ids of a text are its words' ids in
order, and a task encodes each distinct word once. Any other text goes through the tokenizer whole. Results are
those of the `tokenizers` library on the whole text.
"""

from __future__ import annotations

import base64
import json
import re
from functools import cached_property, lru_cache
from struct import pack

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

MEMO_WORDS = 150_000
RUNS = ("  ", "\n\n", " \n", "\n ")
OTHER_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


@lru_cache(maxsize=4)
def rank_encoding(file: str) -> tiktoken.Encoding:
    with open(file, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Words(dict):
    """word -> ids as little-endian bytes; forgets all when full, so its memory is bounded."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        stem = word[:-1]
        if word and word[-1] in ".," and stem.isalpha():  # a letter run and one mark are two matches
            ids = self[stem] + self.encode(word[-1])
        else:
            ids = self.encode(self.lead + word, word.isalpha())
        self[word] = ids
        return ids


class MemoEncoder:
    """Ids (little-endian uint32 bytes) of texts under a byte-level BPE given as tokenizer file and rank file."""

    def __init__(self, tokenizer_file: str, rank_file: str):
        self.tokenizer_file = tokenizer_file
        with open(tokenizer_file, encoding="utf-8") as spec:
            self.special = sorted(t["content"] for t in json.load(spec)["added_tokens"])
        self.ranks = rank_encoding(rank_file)
        self.first, self.rest = _Words(self._short, ""), _Words(self._short, " ")
        self.line_end = self._short("\n")

    def _short(self, text: str, one_match: bool = False) -> bytes:
        ids = self.ranks._core_bpe.encode_single_piece(text.encode()) if one_match else self.ranks.encode_ordinary(text)
        return pack(f"<{len(ids)}I", *ids)

    @cached_property
    def whole(self) -> Tokenizer:
        return Tokenizer.from_file(self.tokenizer_file)

    def forget(self) -> None:
        self.first.clear()
        self.rest.clear()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if text[0] in " \n" or text[-1] in " \n" or any(run in text for run in RUNS) or OTHER_SPACE(text):
            return self._short(text)
        get, lines = self.rest.__getitem__, []
        for line in text.split("\n"):
            head, *tail = line.split(" ")
            lines.append(self.first[head] + b"".join(map(get, tail)))
        return self.line_end.join(lines)
