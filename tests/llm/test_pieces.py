import random
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from recordsearch.llm import pieces

FILE = public_tokenizers.path("piece_bpe_32k.model")
with open(FILE, "rb") as file:
    MODEL = file.read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
ENCODER = pieces.Encoder(MODEL)
ODD = ["", " ", "a", "x▁ y", "\r\n\t", "<s></s><unk><0x0A>", "\x00", "﻿x", "a" * 999, "ab " * 50 + " " * 37 + "x", "é́😀日本語", "12,345.67",
       *[" " * n for n in range(2, 40)]]


def same(text):
    assert ENCODER.ids(text).tolist() == LIBRARY.encode(text)


def test_equals_the_library():
    for text in ODD:
        same(text)
    rng = random.Random(1)
    listed = list(ENCODER.pieces)
    for _ in range(1500):
        same("".join(rng.choice(listed) for _ in range(rng.randrange(1, 30))))
        same("".join(rng.choice(" ▁\nabcdefgehinorst0129ÅÉß😀日本Ω.,") for _ in range(rng.randrange(1, 60))))


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_equals_the_library_on_any_text(text):
    same(text)


def read_back(encoder, text, end):
    last, found = encoder.last_pieces(text), []
    while end:
        found.insert(0, last[end - 1] or text[end - 1])
        end -= len(found[0])
    return found


def test_prefixes_have_the_pieces_of_the_text():
    text = "▁internationalisation"
    for end in range(1, len(text) + 1):
        whole = read_back(ENCODER, text, end)
        assert whole == ENCODER.merges.merged(text[:end])[0]
        assert all(ENCODER.merges.compatible(a, b) for a, b in zip(whole, whole[1:]))


def test_merges_of_any_table():
    """Tables where the order of merges matters: random pieces over three letters with repeated scores."""
    rng = random.Random(2)
    for _ in range(60):
        scores = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))): rng.randrange(6) for _ in range(rng.randrange(1, 12))}
        own = pieces.Encoder.__new__(pieces.Encoder)
        own.prepare(pieces.Merges(scores))
        for _ in range(40):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
            assert read_back(own, text, len(text)) == own.merges.merged(text)[0]


def test_any_ids_decode_as_in_the_library():
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.randrange(rng.choice([4, 262, 32000])) for _ in range(rng.randrange(12))]
        assert ENCODER.text(ids) == LIBRARY.decode(ids)
    assert ENCODER.text(None) == ""


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "SEGMENTS", 5)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    few = pieces.Encoder(MODEL)
    for text in ("one two three four five six seven eight nine ten " * 2, "x" * 100):
        assert few.ids(text).tolist() == LIBRARY.encode(text)
        assert len(few) <= 5 and len(few.pairs) <= 5


def test_query_and_round_trip(rows, tmp_path, spark):
    texts = [None, *ODD, *ODD[:4], "wort " * 40000, "ohneblank" * 20000]
    items = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    table = rows(items).selectExpr("*", "'x' AS ids").repartition(3)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, pieces.op12_piece_ids(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, t in items:
        ids = LIBRARY.encode(t or "")
        want.append((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    tokens = pieces.encode(table, MODEL, keep=("doc_id", "text"))
    back = pieces.decode(tokens, MODEL, keep=("text",), out="again")
    assert back.where("replace(coalesce(text, ''), '▁', ' ') <> again").count() == 0
    assert pieces.decode(tokens.where("false"), MODEL).collect() == []


def test_other_models_are_refused():
    with pytest.raises(Exception):
        pieces.Encoder(b"no model")
