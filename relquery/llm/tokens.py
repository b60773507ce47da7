"""Vectorised encoding of many texts with a public byte-level BPE vocabulary.

A text is cut before each run of ASCII white space that follows other text.
Such a cut is always a boundary of the vocabulary's own word pattern, so the
pieces can be encoded alone, each distinct piece once, and the ids of a text
are gathered from them. A piece right after Unicode white space is not cut off.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

from relquery.llm.common import EXACT, SPACE, span_hashes

#: Distinct pieces, and ids of theirs, that a worker remembers; beyond that it forgets all and goes on.
CACHE_PIECES, CACHE_IDS = 200_000, 2_000_000


class Encoder:
    """Ids of texts as ``tokenizers`` gives them with ``add_special_tokens=False``.

    ``rank_path`` is the same vocabulary as ranks; it serves pieces of Basic
    Latin and Latin-1 letters, ``json_path`` all others and texts that hold
    a special token's string.
    """

    def __init__(self, json_path: str | None = None, rank_path: str | None = None, pattern: str | None = None, special: str = "<|endoftext|>") -> None:
        import public_tokenizers
        import tiktoken

        self.json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        with open(rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = special.encode()
        self._slow = None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.store = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)

    def slow(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.json_path)
        return self._slow.encode(text, add_special_tokens=False).ids

    def _learn(self, key: int, piece: bytes) -> int:
        text = piece.decode("utf-8", "replace")
        ids = self.slow(text) if max(piece) >= 0xC4 else self.fast.encode_ordinary(text)
        n, k = len(ids), len(self.known)
        if self.used + n > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(n, len(self.store)), np.uint32)])
        if k == len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.store[self.used : self.used + n] = ids
        self.at[k], self.size[k] = self.used, n
        self.used += n
        self.known[key] = k
        return k

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        space = SPACE[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = space[1:] & ~space[:-1]
        at = np.flatnonzero(cut)
        a, b, c = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        odd = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
        odd |= (c == 0xE1) & (b == 0x9A) & (a == 0x80)
        odd |= (c == 0xE2) & (((b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))) | ((b == 0x81) & (a == 0x9F)))
        odd |= (c == 0xE3) & (b == 0x80) & (a == 0x80)
        cut[at[odd]] = False
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's first id (one more entry than texts)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        whole = data.tobytes()
        if self.special in whole:
            return self._one_by_one(whole, offsets)
        starts = self._pieces(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes, sample, back = np.unique(span_hashes(data, starts, ends, EXACT), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > CACHE_PIECES or self.used > CACHE_IDS:
            self._forget()
        get, learn = self.known.get, self._learn
        which = np.fromiter((k if (k := get(h)) is not None else learn(h, whole[starts[i] : ends[i]]) for h, i in zip(hashes.tolist(), sample.tolist(), strict=True)), np.int64, len(hashes))[back]
        sizes, at = self.size[which], self.at[which]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.store[np.repeat(at - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, offsets)]

    def _one_by_one(self, whole: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.slow(whole[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.concatenate([np.array(p, np.uint32) for p in parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


@lru_cache(maxsize=2)
def encoder(json_path: str | None = None, rank_path: str | None = None) -> Encoder:
    """A worker's encoder; its vocabulary files are read once."""
    return Encoder(json_path, rank_path)
