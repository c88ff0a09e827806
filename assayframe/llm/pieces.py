"""SentencePiece BPE encoding and decoding by a table of last tokens.

Merging always takes the pair of the best score, the leftmost of equals, so what happens inside a run of symbols depends
on the run alone until something crosses its border. From this follows: a sequence of pieces is the encoding of its text
exactly if every piece encodes to itself and every two neighbours encode to themselves when they are joined (they are
compatible). Of the pieces that end at a place of the text exactly one is then compatible with the last piece of the text
before it. The encoder stores this last token for every prefix, taking the pieces from an automaton, and reads the ids off
backwards from the end.

Texts are cut before blanks and around bytes that no piece joins to anything, and a worker remembers the chunks it has
encoded (see encode.ChunkMemory). A character outside the vocabulary joins nothing and counts as its UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import ChunkMemory, tokenizer_path
from .ragged import gather, slices

BLANK = "▁"
NEVER = 1 << 40
#: Pairs whose test a worker remembers.
PAIRS = 1 << 20
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PieceModel:
    """Whole texts to ids and back, equal to SentencePieceProcessor.encode(text) and .decode(ids)."""

    def __init__(self, name: str):
        import ahocorasick
        import sentencepiece.sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(tokenizer_path(name), "rb") as f:
            model.ParseFromString(f.read())
        t, n = model.trainer_spec, model.normalizer_spec
        if t.model_type != 2 or not t.byte_fallback or n.name != "identity" or n.remove_extra_whitespaces or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("a BPE model with byte fallback, identity normalization and no user-defined or unused pieces is needed")
        self.dummy = n.add_dummy_prefix
        self.text = [p.piece for p in model.pieces]
        self.ident = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(BLANK in p.lstrip(BLANK) for p in self.ident):
            raise ValueError("pieces with a blank after other characters are not supported")
        if any(c not in self.ident for p in self.ident for c in p):
            raise ValueError("every character of a piece has to be a piece")
        scores = sorted({p.score for p in model.pieces if p.type == NORMAL}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        #: Rank of the merge that makes a piece; a single character is made by none.
        self.rank = [order[p.score] if p.type == NORMAL and len(p.piece) > 1 else -1 for p in model.pieces]
        self.split: dict[int, tuple[int, int]] = {}
        self.plain: set[int] = set()  # pieces whose merges follow each other by rank
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ident.items():
            if self._grow(piece, i):
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}
        inside = {ord(c) for p in self.ident if len(p) > 1 for c in p}
        self.alone = np.array([b < 128 and b != 32 and b not in inside for b in range(256)])
        self.byte_ids = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.memory = ChunkMemory(self._encode)
        self._tables(model, t)

    def merged(self, text: str) -> tuple[list[str], list[int], tuple[str, str] | None]:
        """(pieces, ranks of the merges in their order, the last merge's two sides) of a short text, by merging."""
        parts, ranks, last = list(text), [], None
        while len(parts) > 1:
            best = min((self.rank[i], k) if (i := self.ident.get(parts[k] + parts[k + 1])) is not None else (NEVER, k) for k in range(len(parts) - 1))
            if best[0] == NEVER:
                break
            k = best[1]
            ranks.append(best[0])
            last = parts[k], parts[k + 1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts, ranks, last

    def _grow(self, piece: str, i: int) -> bool:
        """Whether a piece encodes to itself; its last merge is kept."""
        if len(piece) == 1:
            self.plain.add(i)
            return True
        parts, ranks, last = self.merged(piece)
        if len(parts) > 1:
            return False
        self.split[i] = self.ident[last[0]], self.ident[last[1]]
        if all(a <= b for a, b in zip(ranks, ranks[1:])):
            self.plain.add(i)
        return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether the piece a stays apart from the piece b behind it.

        The merges of both are undone, the last first. Two symbols that meet at the border cross it if their pair ranks
        before the merge that ends the first of them (a's merges stand to the left and win ties against the pair, b's
        lose them). Where the merges of a piece don't follow each other by rank, the joined text is merged instead.
        """
        key = a << 20 | b
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            got = self.known[key] = self._apart(a, b) if a in self.plain and b in self.plain else self.merged(self.text[a] + self.text[b])[0] == [self.text[a], self.text[b]]
        return got

    def _apart(self, a: int, b: int) -> bool:
        text, ident, rank, split = self.text, self.ident, self.rank, self.split
        end_a = end_b = NEVER  # ranks of the merges that end a and b
        while True:
            pair = ident.get(text[a] + text[b])
            if pair is not None and (rank[pair] < end_a if end_a <= end_b else rank[pair] <= end_b):
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[b] >= rank[a]:
                end_b, b = rank[b], split[b][0]
            else:
                end_a, a = rank[a], split[a][1]

    def chunk_ids(self, text: str) -> list[int]:
        """Ids of a chunk in which blanks are marks already."""
        n = len(text)
        last, length = [-1] * (n + 1), [1] * (n + 1)
        known, apart = self.known.get, self.compatible
        for end, (i, width) in self.automaton.iter(text):
            start = end + 1 - width
            before = last[start]
            if start and before >= 0:
                fits = known(before << 20 | i)
                if fits is None:
                    fits = apart(before, i)
                if not fits:
                    continue
            last[end + 1], length[end + 1] = i, width
        out, at = [], n
        while at:
            i = last[at]
            if i >= 0:
                out.append(i)
            else:  # a character that is no piece
                out.extend(self.byte_ids[b] for b in reversed(text[at - 1].encode()))
            at -= length[at]
        return out[::-1]

    def _encode(self, chunks: list[bytes]) -> tuple[range, np.ndarray, np.ndarray]:
        ids = [self.chunk_ids(c.decode().replace(" ", BLANK)) for c in chunks]
        return range(len(chunks)), np.array([len(x) for x in ids], np.int64), np.array([y for x in ids for y in x], np.uint32)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids, bounds of each text's ids) for runs of rows."""
        for i, j, data, bounds in slices(texts):
            size = np.diff(bounds)
            if not len(data):
                yield i, j, np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
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
            place, length = self.memory.look_up(data, start, np.append(start[1:], len(data)))
            total = np.concatenate([[0], np.cumsum(length)])
            yield i, j, gather(self.memory.pool, place, length), total[np.searchsorted(start, bounds)]

    def _tables(self, model, trainer) -> None:
        """Bytes of each id's text, and its decimal digits with a comma."""
        text = []
        for p in model.pieces:
            if p.type == BYTE:
                text.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == CONTROL:
                text.append(b"")
            else:
                text.append((trainer.unk_surface if p.type == UNKNOWN else p.piece.replace(BLANK, " ")).encode())
        self.is_byte = np.array([p.type == BYTE for p in model.pieces])
        self.skipped = np.array([p.type == CONTROL for p in model.pieces])
        self.starts_blank = np.array([p.type == NORMAL and p.piece.startswith(BLANK) for p in model.pieces])
        digits = [b"%d," % i for i in range(len(text))]
        for name, rows in (("text", text), ("digit", digits)):
            size = np.array([len(r) for r in rows], np.int64)
            setattr(self, f"{name}_bytes", np.frombuffer(b"".join(rows), np.uint8))
            setattr(self, f"{name}_size", size)
            setattr(self, f"{name}_at", np.cumsum(size) - size)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids: the blank that encoding put in front goes, and bytes that are no UTF-8 become U+FFFD each."""
        ids = ids.astype(np.int64)
        size, at, skipped = self.text_size[ids], self.text_at[ids], self.skipped[ids]
        if self.dummy:
            first = np.flatnonzero(~skipped)[:1]
            if len(first) and self.starts_blank[ids[first[0]]]:
                at[first], size[first] = at[first] + 1, size[first] - 1
        raw = gather(self.text_bytes, at, size).tobytes()
        own = self.is_byte[ids]
        if not own.any():
            return raw
        if not skipped.any():  # a control id parts the bytes before and behind it
            try:
                raw.decode()
                return raw
            except UnicodeDecodeError:
                pass
        stop = np.cumsum(size)
        edge = np.flatnonzero(np.diff(own, prepend=~own[0]))  # runs of byte ids and of others
        parts = []
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)]):
            part = raw[stop[a] - size[a] : stop[b - 1]]
            parts.append(_replaced(part) if own[a] else part)
        return b"".join(parts)

    def digits(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        ids = ids.astype(np.int64)
        return gather(self.digit_bytes, self.digit_at[ids], self.digit_size[ids]).tobytes()[:-1]


def _replaced(part: bytes) -> bytes:
    """UTF-8 with U+FFFD for each byte that begins no character."""
    out, i = [], 0
    while i < len(part):
        for n in range(1, 5):
            try:
                out.append(part[i : i + n].decode().encode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)


_models: dict[str, PieceModel] = {}


def piece_model(name: str) -> PieceModel:
    """One model for each Python worker."""
    if name not in _models:
        _models[name] = PieceModel(name)
    return _models[name]


def encode_pieces(docs: DataFrame, *, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of ints) of every row, without begin or end ids, without a shuffle.

    A null or empty text has no ids; texts are taken whole at any length. Nulls, repeats and ties of doc_id make no
    difference. An empty table gives no rows; other columns, whatever their names, are not carried.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for b in batches:
            for i, j, ids, bounds in pieces.encode(b.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_pieces(rows: DataFrame, *, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every row of ids, without a shuffle. Null and empty ids give an empty text; an id outside the
    vocabulary, and a null among the ids, is an error."""
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for b in batches:
            lists = b.column(1)
            texts = []
            for k in range(len(lists)):
                ids = lists[k].values
                if ids is not None and ids.null_count:
                    raise ValueError("null among ids")
                ids = np.zeros(0, np.int64) if ids is None else ids.to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(pieces.text)):
                    raise ValueError("an id is outside the vocabulary")
                texts.append(pieces.decode(ids).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def piece_digests(docs: DataFrame, *, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the text decoded from these
    ids) of every row: the outputs of encode_pieces and decode_pieces as digests, in one pass and without a shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for b in batches:
            for i, j, ids, bounds in pieces.encode(b.column(1)):
                of_ids, of_text = [], []
                for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = ids[p:q]
                    of_ids.append(hashlib.sha256(pieces.digits(own)).hexdigest())
                    of_text.append(hashlib.sha256(pieces.decode(own)).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
