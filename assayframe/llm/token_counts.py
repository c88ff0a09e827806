"""Token counts of a sentencepiece BPE model by rank-synchronous array merging.

All pre-tokens of a batch stand in one ragged array. Each step applies to every sequence its pair of the lowest rank
(the leftmost of equals), then sequences without a pair left retire. Sequences of many symbols, which would take as many
steps, are merged rank by rank instead: all places of the lowest rank left in any of them at once, or those up to the
first where the symbol made is part of a pair that ranks as low. A sequence's count is its number of first symbols
less its merges; a character outside the vocabulary counts as its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import ChunkMemory, tokenizer_path
from .ragged import slices

#: Above so many symbols a sequence is merged rank by rank. Both ways count alike; this one's cost does not grow with the
#: square of the length.
LONG = 512
NONE = np.int64(1) << 30


class PieceCounter:
    """Counts for whole texts, equal to len(SentencePieceProcessor.encode(text))."""

    def __init__(self, name: str):
        import sentencepiece.sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(tokenizer_path(name), "rb") as f:
            model.ParseFromString(f.read())
        t, n = model.trainer_spec, model.normalizer_spec
        if t.model_type != 2 or not t.byte_fallback or n.name != "identity" or n.remove_extra_whitespaces or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("a BPE model with byte fallback, identity normalization and no user-defined or unused pieces is needed")
        self.dummy = n.add_dummy_prefix
        pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces with a blank after other characters are not supported")
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        ident = {p: i for i, p in enumerate(pieces)}
        self.char = {ord(p): i for p, i in ident.items() if len(p) == 1}
        pairs = [(ident[p[:c]] << 20 | ident[p[c:]], order[s], ident[p]) for p, s in pieces.items() for c in range(1, len(p)) if p[:c] in ident and p[c:] in ident]
        made = {ident[p]: order[s] for p, s in pieces.items() if len(p) > 1}
        #: Ranks whose symbol begins or ends a pair of a rank as low: that pair comes before other places of the rank.
        self.early = np.zeros(len(order), bool)
        self.early[[made[side] for key, rank, _ in pairs for side in (key >> 20, key & 0xFFFFF) if made.get(side, -1) >= rank]] = True
        table = np.array(sorted(pairs), np.int64)
        self.pair, self.rank, self.merged = (np.ascontiguousarray(c) for c in table.T)
        inside = {ord(c) for p in pieces if len(p) > 1 for c in p}
        #: Where a chunk begins: blanks after others, and bytes that no piece joins to anything.
        self.alone = np.array([b < 128 and b != 32 and b not in inside for b in range(256)])
        self.codes = np.array(sorted(self.char), np.int64)
        self.code_ids = np.array([self.char[c] for c in sorted(self.char)], np.int64)
        self.memory = ChunkMemory(self._encode)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((left >= 0) & (right >= 0), left << 20 | right, -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.rank[at], NONE), self.merged[at]

    def merge_counts(self, sym: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Merges that each sequence sym[start[i]:start[i + 1]] undergoes; -1 is a symbol that joins nothing."""
        length = np.diff(start)
        merges = np.zeros(len(length), np.int64)
        row = np.repeat(np.arange(len(length)), length)
        rank = np.full(len(sym), NONE)
        into = np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            r, m = self._look(sym[:-1], sym[1:])
            rank[:-1] = np.where(row[:-1] == row[1:], r, NONE)
            into[:-1] = m
        while len(sym):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), first)
            live = best >> 32 < NONE
            pos = best[live] & 0xFFFFFFFF
            merges[row[pos]] += 1
            sym[pos] = into[pos]
            keep = np.repeat(live, np.diff(np.append(first, len(sym))))
            keep[pos + 1] = False
            new = np.cumsum(keep)[pos] - 1
            sym, row, rank, into = sym[keep], row[keep], rank[keep], into[keep]
            n = len(sym)
            for p in (new, new[new > 0] - 1):
                q = np.minimum(p + 1, n - 1)
                r, m = self._look(sym[p], sym[q])
                rank[p] = np.where((row[p] == row[q]) & (q > p), r, NONE)
                into[p] = m
        return merges

    def long_merge_counts(self, sym: np.ndarray, start: np.ndarray) -> np.ndarray:
        """merge_counts, rank by rank over all sequences: work follows the merges and the ranks that occur."""
        n = len(sym)
        row = np.repeat(np.arange(len(start) - 1), np.diff(start))
        after, ahead = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, into = np.full(n, NONE), np.zeros(n, np.int64)

        def rate(p: np.ndarray) -> None:
            """Rank of the pair that begins at each place p, and the symbol it makes."""
            q = after[p]
            inside = q < n
            inside[inside] = row[p[inside]] == row[q[inside]]
            r, into[p] = self._look(sym[p], sym[np.minimum(q, n - 1)])
            rank[p] = np.where(inside, r, NONE)

        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(p: np.ndarray) -> None:
            p = p[rank[p] < NONE]
            p = p[np.argsort(rank[p], kind="stable")]
            at = np.flatnonzero(np.diff(rank[p], prepend=-1))
            for r, places in zip(rank[p[at]].tolist(), np.split(p, at[1:])):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(places)

        every = np.arange(n)
        rate(every)
        wait(every)
        merges = np.zeros(len(start) - 1, np.int64)
        while ranks:
            r = heapq.heappop(ranks)
            p = np.unique(np.concatenate(waiting.pop(r)))
            p = p[rank[p] == r]
            # of pairs that share a symbol the first, third ... of each chain are merged
            chained = np.zeros(len(p), bool)
            chained[1:] = after[p[:-1]] == p[1:]
            head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(p))))
            p = p[(np.arange(len(p)) - head) % 2 == 0]
            if self.early[r] and len(p):
                # in each sequence up to the first place whose symbol makes a pair of a rank as low
                made, before, behind = into[p], ahead[p], after[after[p]]
                low = self._look(made, made)[0] <= r
                low |= (before >= 0) & (self._look(sym[before], made)[0] <= r)
                low |= (behind < n) & (self._look(made, sym[np.minimum(behind, n - 1)])[0] <= r)
                so_far = np.cumsum(low) - low
                first = np.flatnonzero(np.diff(row[p], prepend=-1))
                go = so_far == np.repeat(so_far[first], np.diff(np.append(first, len(p))))
                wait(p[~go])
                p = p[go]
            if not len(p):
                continue
            q = after[p]
            sym[p], rank[q] = into[p], NONE
            after[p] = after[q]
            end = after[p] < n
            ahead[after[p[end]]] = p[end]
            merges += np.bincount(row[p], minlength=len(merges))
            left = ahead[p]
            near = np.unique(np.concatenate([p, left[left >= 0]]))
            rate(near)
            wait(near)
        return merges

    def _encode(self, chunks: list[bytes]) -> tuple[range, np.ndarray, np.ndarray]:
        """One number for each chunk: its tokens."""
        texts = [c.decode().replace(" ", "▁") for c in chunks]
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        start = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        sym = np.where(self.codes[at] == code, self.code_ids[at], -1)
        width = np.where(sym >= 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        count = np.diff(np.concatenate([[0], np.cumsum(width)])[start])
        length = np.diff(start)
        for way, these in ((self.merge_counts, (length > 1) & (length <= LONG)), (self.long_merge_counts, length > LONG)):
            if these.any():
                count[these] -= way(sym[np.repeat(these, length)], np.concatenate([[0], np.cumsum(length[these])]))
        return range(len(chunks)), np.ones(len(chunks), np.int64), count.astype(np.uint32)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, tokens) of each text."""
        n_bytes, n_tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, j, data, bounds in slices(texts):
            size = np.diff(bounds)
            n_bytes[i:j] = size
            if not len(data):
                continue
            if self.dummy:  # a blank before each text that isn't empty
                data = np.insert(data, bounds[:-1][size > 0], 32)
                bounds = bounds + np.concatenate([[0], np.cumsum(size > 0)])
            blank = data == 32
            mark = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
            for k in range(3):  # a literal blank mark is a blank to the model
                blank[k : k + len(mark)] |= mark
            begins = blank | self.alone[data]
            begins[1:] &= ~(blank[1:] & blank[:-1])
            begins[bounds[:-1][bounds[:-1] < len(data)]] = True
            start = np.flatnonzero(begins)
            place, _ = self.memory.look_up(data, start, np.append(start[1:], len(data)))
            total = np.concatenate([[0], np.cumsum(self.memory.pool[place].astype(np.int64))])
            n_tokens[i:j] = np.diff(total[np.searchsorted(start, bounds)])
        return n_bytes, n_tokens


_counters: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, *, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, without a shuffle.

    A null or empty text has no bytes and no tokens. Nulls, repeats and ties of doc_id make no difference; other
    columns are not carried.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _counters:
            _counters[model] = PieceCounter(model)
        for b in batches:
            n_bytes, n_tokens = _counters[model].counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
