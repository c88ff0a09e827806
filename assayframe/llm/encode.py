"""Token ids of text batches with a per-worker memory of chunks already encoded.

A text is cut where the tokenizer's own first split lets no token cross, so the ids of a text are the ids of its chunks
one behind another. Chunks are found by 64-bit hashes and then compared byte by byte; the memory holds at most ``KEEP``
chunks of ``KEEP_BYTES`` together and starts anew when it is full, so a worker's memory is bounded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .ragged import SPACE, gather, same_spans, slices, word_hashes, words

KEEP, KEEP_BYTES = 1 << 21, 1 << 26
#: Chunks in one joint text.
JOINT = 2000
MARK = "\x01"
#: White space beyond ASCII, at which the cut before a white-space run is not safe.
WIDE_SPACE = re.compile("[\x85\xa0  -     　]")


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare name is looked up among the installed public tokenizers."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def lead_chunks(data: np.ndarray, bounds: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of a white-space run and what follows it; every byte lies in one chunk."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(bounds), np.int64)
    blank = space[data]
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[bounds[:-1][bounds[:-1] < len(data)]] = True
    start = np.flatnonzero(begins)
    return start, np.append(start[1:], len(data)), np.searchsorted(start, bounds)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the classes' first members and, for each value, the number of its class, by one packed sort."""
    n = len(h)
    bits = np.uint64(max(1, int(n).bit_length()))
    packed = np.sort(((h >> bits) << bits) | np.arange(n, dtype=np.uint64))
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    hs = h[order]
    new = np.ones(n, bool)
    new[1:] = hs[1:] != hs[:-1]
    if (new[1:] & (hs[1:] >> bits == hs[:-1] >> bits)).any():  # other values between equal ones
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return first, inverse
    inverse = np.empty(n, np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


class ChunkMemory:
    """Encodings of chunks: a sorted array of their hashes, one pool of all encodings, and one of the chunks' bytes."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[list[int], np.ndarray, np.ndarray]], keep: int = KEEP):
        self.encode, self.keep = encode, keep
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.length, self.byte_at, self.byte_length = (np.zeros(0, np.int64) for _ in range(4))
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.bytes, self.bytes_used = np.zeros(1 << 16, np.uint8), 0

    def _store(self, ids: np.ndarray) -> int:
        """Place of new ids in the pool."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        raw, size = data.tobytes(), end - start
        order, length, ids = self.encode([raw[a:b] for a, b in zip(start.tolist(), end.tolist())])
        at = self._store(ids) + np.cumsum(length) - length
        held = gather(data, start, size)
        while self.bytes_used + len(held) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(len(self.bytes), np.uint8)])
        self.bytes[self.bytes_used : self.bytes_used + len(held)] = held
        byte_at = self.bytes_used + np.cumsum(size) - size
        self.bytes_used += len(held)
        fresh = keys[order]
        by = np.argsort(fresh, kind="stable")
        spot = np.searchsorted(self.keys, fresh[by])
        order = np.asarray(order)[by]
        self.keys = np.insert(self.keys, spot, fresh[by])
        self.at, self.length = np.insert(self.at, spot, at[by]), np.insert(self.length, spot, length[by])
        self.byte_at, self.byte_length = np.insert(self.byte_at, spot, byte_at[order]), np.insert(self.byte_length, spot, size[order])

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk the place and length of its encoding in the pool."""
        h = word_hashes(data, start, end)
        firsts, inverse = distinct(h)
        keys = h[firsts]
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        if not known.all():
            if len(self.keys) > self.keep or self.bytes_used > KEEP_BYTES:
                self.clear()
                known[:] = False
            new = firsts[~known]
            self._learn(h[new], data, start[new], end[new])
            place = np.searchsorted(self.keys, keys)
        place = place[inverse]
        at, length = self.at[place], self.length[place]
        size = end - start
        same = size == self.byte_length[place]
        same[same] = same_spans(data, start[same], self.bytes, self.byte_at[place[same]], size[same])
        if not same.all():  # another chunk has this one's hash: it is encoded here and not remembered
            odd = np.flatnonzero(~same)
            raw = data.tobytes()
            order, n, ids = self.encode([raw[a:b] for a, b in zip(start[odd].tolist(), end[odd].tolist())])
            at[odd[order]] = self._store(ids) + np.cumsum(n) - n
            length[odd[order]] = n
        return at, length


class TextEncoder:
    """Ids of whole texts by a tokenizers file, equal to its encode(text, add_special_tokens=False)."""

    def __init__(self, name: str):
        self.tok = load_tokenizer(name)
        import json

        split = json.dumps(json.loads(self.tok.to_str())["pre_tokenizer"])
        # a word tokenizer drops white space; a byte-level one keeps it in front of the next word
        self.drops_space = '"Removed"' in split
        self.memory = ChunkMemory(self._encode)
        self._simple = None
        if self.drops_space:  # a lone 0x01 between words marks their ends, if it is one token that no word has
            mark = self.tok.encode(MARK, add_special_tokens=False).ids
            if len(mark) == 1:
                self._simple, self._join, self._mark = re.compile(rb"[^\x01<]+").fullmatch, f" {MARK} ", mark[0]
        else:  # the first token of a blank and a word is the only one that starts with the blank
            self._leads = np.zeros(self.tok.get_vocab_size() + 1, bool)
            self._leads[[i for t, i in self.tok.get_vocab().items() if t.startswith("\u0120")]] = True
            self._simple, self._join = re.compile(rb" [^\x09-\x0D <]+").fullmatch, ""

    def _encode(self, chunks: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order, lengths, ids): plain chunks in joint texts, which the library encodes faster than many short ones."""
        order, lengths, ids = [], [], []
        plain = [k for k, c in enumerate(chunks) if self._simple and self._simple(c)]
        for i in range(0, len(plain), JOINT):
            part = plain[i : i + JOINT]
            text = self._join.join([chunks[k].decode() for k in part])
            got = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            own = got == self._mark if self.drops_space else self._leads[got]
            cuts = np.flatnonzero(own)[0 if self.drops_space else 1 :]
            if len(cuts) != len(part) - 1 or WIDE_SPACE.search(text):
                continue
            length = np.diff(np.concatenate([[0], cuts, [len(got)]]))
            if self.drops_space:
                length[1:] -= 1
                got = got[~own]
            order += part
            lengths.append(length)
            ids.append(got)
        done = set(order)
        rest = [k for k in range(len(chunks)) if k not in done]
        if rest:
            got = [e.ids for e in self.tok.encode_batch_fast([chunks[k].decode() for k in rest], add_special_tokens=False)]
            order += rest
            lengths.append(np.array([len(x) for x in got], np.int64))
            ids.append(np.array([y for x in got for y in x], np.uint32))
        return order, np.concatenate(lengths), np.concatenate(ids)

    def batches(self, texts: pa.Array):
        """(first row, row after the last, ids, bounds of each text's ids) for runs of rows."""
        for i, j, data, bounds in slices(texts):
            cut = words if self.drops_space else lambda d, b: lead_chunks(d, b, SPACE)
            start, end, at = cut(data, bounds)
            if not len(start):
                yield i, j, np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
                continue
            place, length = self.memory.look_up(data, start, end)
            ids = gather(self.memory.pool, place, length)
            total = np.concatenate([[0], np.cumsum(length)])[at]
            if not self.drops_space:
                ids, total = self._mend(texts, i, j, data, ids, total)
            yield i, j, ids, total

    def _mend(self, texts, i, j, data, ids, total):
        """Texts with white space beyond ASCII are encoded whole."""
        if not WIDE_SPACE.search(data.tobytes().decode()):
            return ids, total
        parts = []
        for r in range(i, j):
            t = texts[r].as_py() or ""
            own = ids[total[r - i] : total[r - i + 1]]
            parts.append(np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32) if WIDE_SPACE.search(t) else own)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_encoders: dict[str, TextEncoder] = {}


def text_encoder(name: str) -> TextEncoder:
    """One encoder for each Python worker."""
    if name not in _encoders:
        _encoders[name] = TextEncoder(name)
    return _encoders[name]
