"""Byte-level BPE ids for many texts per call, shared by packing and token counts."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Words kept per Python worker; the table is emptied when it is full.
MAX_CACHED_WORDS = 400_000
_SPLIT_RUN = re.compile(r"\s \s|  ")
SPECIAL = "<|endoftext|>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class WordCachedBpe:
    """Ids as little-endian uint32 bytes.

    A single space between two non-space characters always starts a new
    pre-token of the byte-level pattern, so the ids of a text are the ids of its
    space-led words put together. Words repeat, so their ids are kept in a
    bounded table; unseen words of a batch are encoded in one call. Texts with
    white-space runs in which that rule does not hold are encoded whole.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb"))}
        self._enc = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={SPECIAL: len(ranks)})
        self._width = np.zeros(len(ranks) + 1, np.int64)
        for token, rank in ranks.items():
            self._width[rank] = len(token)
        self._words: dict[str, bytes] = {}

    def _whole(self, text: str, special: bool = False) -> bytes:
        allowed = {SPECIAL} if special and SPECIAL in text else set()
        return np.asarray(self._enc.encode(text, allowed_special=allowed, disallowed_special=()), dtype="<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        plain = [w for w in words if w and not (w[0].isspace() or w[-1].isspace())]
        for w in words.difference(plain):
            self._words[w] = self._whole(" " + w)
        if not plain:
            return
        ids = np.asarray(self._enc.encode_to_numpy("".join(" " + w for w in plain), disallowed_special=()), dtype="<u4")
        ends = np.searchsorted(np.cumsum(self._width[ids]), np.cumsum([len(w.encode()) + 1 for w in plain])) + 1
        raw, at = ids.tobytes(), 0
        for w, end in zip(plain, (4 * ends).tolist()):
            self._words[w] = raw[at:end]
            at = end

    def encode_batch(self, texts: list[str], special: bool = True) -> list[bytes]:
        """Ids of each text; the special token's string is that token, or plain text if not ``special``."""
        split = [None if not t or special and SPECIAL in t or _SPLIT_RUN.search(t) else t.split(" ") for t in texts]
        if len(self._words) > MAX_CACHED_WORDS:
            self._words.clear()
        known = self._words
        unseen = {w for ws in split if ws is not None for w in ws[1:] if w not in known}
        if unseen:
            self._learn(unseen)
        return [
            (self._whole(t, special) if t else b"") if ws is None
            else (self._whole(ws[0], special) if ws[0] else b"") + b"".join([known[w] for w in ws[1:]])
            for t, ws in zip(texts, split)
        ]


@lru_cache(maxsize=2)
def bpe(vocabulary: str) -> WordCachedBpe:
    """One encoder per Python worker and vocabulary file."""
    return WordCachedBpe(vocabulary)


def slices(items: list, n: int):
    for k in range(0, len(items), n):
        yield items[k:k + n]
