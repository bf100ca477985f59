"""Token ids of whole text columns by the tokenizers library, each distinct segment encoded once.

Both tokenizer kinds handled here cut text at white space before they merge symbols, so a text's
ids are the ids of its segments in a row: ``split`` drops ASCII white space between segments (word
tokenizers that ignore it); ``lead`` keeps each run of ASCII white space with what follows
(byte-level tokenizers). Where a text holds white space beyond ASCII, ``lead`` could cut a run of white
space that the tokenizer takes whole, so those texts go through the library as they are.
Segments are known by 64-bit hashes (see ``words``) in a cache of at most ``CACHE`` entries per task.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from cellpath.llm.words import NOT_SPACE, hash_runs, ragged, text_bytes

CACHE = 4_000_000


@cache
def _library(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII may begin (some other characters included)."""
    if not len(data):
        return np.zeros(0, np.bool_)
    after = np.concatenate([data[1:], [0]])
    return (
        ((data == 0xC2) & ((after == 0x85) | (after == 0xA0)))
        | ((data == 0xE1) & (after == 0x9A))
        | ((data == 0xE2) & ((after == 0x80) | (after == 0x81)))
        | ((data == 0xE3) & (after == 0x80))
    )


class Encoder:
    """Ids of texts; ``lead`` keeps white space with the segment that follows it."""

    def __init__(self, path: str, lead: bool):
        self.path, self.lead = path, lead
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in _library(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        sizes, parts = np.empty(len(texts), np.int32), []
        for i in range(0, len(texts), 4096):
            ids = self._ids(texts[i : i + 4096])
            sizes[i : i + len(ids)] = [len(x) for x in ids]
            parts.append(np.fromiter((t for x in ids for t in x), np.uint32))
        new = np.concatenate(parts)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        first = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.used += len(new)
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.first = np.concatenate([self.first, first])[order]
        self.size = np.concatenate([self.size, sizes])[order]

    def _segments(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = NOT_SPACE[data]
        before = np.concatenate([[False], inside[:-1]])
        opens = at[:-1][at[1:] > at[:-1]]
        if self.lead:
            begin = ~inside & before
            begin[opens] = True
            starts = np.flatnonzero(begin)
            return starts, np.concatenate([starts[1:], [len(data)]])
        before[opens] = False
        after = np.concatenate([inside[1:], [False]])
        after[at[1:][at[1:] > at[:-1]] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's rows in a row, and the number of ids of each row."""
        data, at = text_bytes(column)
        rows = len(at) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        starts, ends = self._segments(data, at)
        hashes = hash_runs(data, starts, ends, lower=False)
        whole = np.zeros(rows, np.bool_)
        if self.lead:
            odd = np.flatnonzero(_odd_space(data))
            whole[np.searchsorted(at, odd, "right") - 1] = True
        if whole.any():  # one segment: the text
            row = np.searchsorted(at, starts, "right") - 1
            keep = ~whole[row]
            rest = np.flatnonzero(whole)
            order = np.argsort(np.concatenate([starts[keep], at[rest]]), kind="stable")
            h = hash_runs(data, at[rest], at[rest + 1], lower=False)
            starts = np.concatenate([starts[keep], at[rest]])[order]
            ends = np.concatenate([ends[keep], at[rest + 1]])[order]
            hashes = np.concatenate([hashes[keep], h])[order]
        seen, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(seen) > CACHE:
            self._forget()
        slot = np.searchsorted(self.keys, seen)
        known = np.zeros(len(seen), np.bool_)
        near = slot < len(self.keys)
        known[near] = self.keys[slot[near]] == seen[near]
        if not known.all():
            raw = data.tobytes()
            new = where[~known]
            self._learn(seen[~known], [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[new], ends[new])])
            slot = np.searchsorted(self.keys, seen)
        slot = slot[which]
        sizes = self.size[slot].astype(np.int64)
        ids = self.flat[ragged(self.first[slot], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(total[np.searchsorted(starts, at)])


@cache
def encoder(path: str, lead: bool) -> Encoder:
    """One per Python worker, so that tasks of a worker share its cache."""
    return Encoder(path, lead)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each row's, and the offsets of the rows."""
    at = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(at[-1], end, np.uint32)
    own = np.ones(at[-1], np.bool_)
    own[at[1:] - 1] = False
    out[own] = ids
    return out, at
