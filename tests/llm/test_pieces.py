"""Piece encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from assayframe.llm import pieces
from assayframe.llm.encode import tokenizer_path

NAME = "piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(NAME))


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(NAME)


def odd_texts(model, n):
    rng = random.Random(4)
    vocab = list(model.ident)
    wide = [(1, 0x24F), (0x400, 0x450), (0x4E00, 0x4E50), (0x1F600, 0x1F640)]
    texts = ["", " ", "  ", "▁", "a▁ b", "x" * 3000, " " * 100 + "a", "<s></s><0x41><unk>", "日本語 🙂 \x00 �", "é", "\n\n\t  x", "1234567 89", "▁▁▁a", "the" * 500, "aaaa" * 5000]
    for _ in range(n):
        k = rng.randrange(5)
        if k == 0:
            texts.append("".join(rng.choice(vocab) for _ in range(rng.randint(1, 12))).replace("▁", " "))
        elif k == 1:
            texts.append("".join(rng.choice("abcdeorst in") for _ in range(rng.randint(1, 60))))
        elif k == 2:
            texts.append("".join(chr(rng.randint(*rng.choice(wide))) for _ in range(rng.randint(1, 30))))
        elif k == 3:
            texts.append("".join(rng.choice([" ", "  ", "   ", "▁", "a", "\n"]) for _ in range(rng.randint(1, 30))))
        else:
            texts.append("".join(rng.choice(["er", "in", "th", "▁", "re", "ing", "tion", " ", "123"]) for _ in range(rng.randint(1, 40))))
    return texts


def test_encoding_and_round_trip(model, library):
    texts = odd_texts(model, 4000)
    for i, j, ids, bounds in model.encode(pa.array(texts)):
        for k in range(i, j):
            own = ids[bounds[k - i] : bounds[k - i + 1]]
            assert own.tolist() == library.encode(texts[k]), texts[k]
            assert model.decode(own).decode() == library.decode(own.tolist()) == texts[k].replace("▁", " ")
            assert model.digits(own).decode() == ",".join(map(str, own.tolist()))


def test_decoding_of_any_ids(model, library):
    rng = random.Random(5)
    for _ in range(4000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(0, 2), rng.randint(3, 258), rng.randint(3, 258)]) for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, np.int64)).decode() == library.decode(ids), ids


def test_pairs_are_those_that_merging_leaves_apart(model):
    rng = random.Random(6)
    every = list(model.ident.values())
    for _ in range(20_000):
        a, b = rng.choice(every), rng.choice(every)
        joined = model.merged(model.text[a] + model.text[b])[0]
        assert model.compatible(a, b) == (joined == [model.text[a], model.text[b]])


def test_pair_memory_starts_anew(model, monkeypatch, library):
    monkeypatch.setattr(pieces, "PAIRS", 10)
    fresh = pieces.PieceModel(NAME)
    assert fresh.chunk_ids("▁internationalization") == library.encode("internationalization") and len(fresh.known) <= 10


def test_tables(spark, model, library):
    texts = odd_texts(model, 60) + [None, "one two " * 40_000]
    rows = [(k if k % 9 else None, t, "clash", "clash") for k, t in enumerate(texts)] + [(1, texts[1], "c", "c")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plain = lambda t: library.encode(t or "")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = lambda rows: sorted(rows, key=str)
    want = order((r[0], len(plain(r[1])), sha(",".join(map(str, plain(r[1])))), sha(library.decode(plain(r[1])))) for r in rows)
    assert order((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.piece_digests(df).collect()) == want
    coded = pieces.encode_pieces(df)
    assert order((r.doc_id, tuple(r.ids)) for r in coded.collect()) == order((r[0], tuple(plain(r[1]))) for r in rows)
    assert order((r.doc_id, r.text) for r in pieces.decode_pieces(coded).collect()) == order((r[0], library.decode(plain(r[1]))) for r in rows)
    assert pieces.piece_digests(df.limit(0)).count() == 0 and pieces.encode_pieces(df.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text for r in pieces.decode_pieces(none).collect()] == ["", ""]
    with pytest.raises(Exception, match="vocabulary"):
        pieces.decode_pieces(spark.createDataFrame([(1, [40_000])], "doc_id long, ids array<int>")).collect()
