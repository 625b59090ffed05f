"""SentencePiece operator against the public library; awkward rows."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from incidentkit.llm import piece_bpe, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["▁", " ", "  ", "     ", " " * 20, "a", "the", "ing", "é", "中", "😀", "\n", "\t", "<s>", "<0x41>", "1", "23", "!", "̀", "\x00", "ab", "日本", "�", "벨", "\U000323b0", "ᩰ"]
TEXTS = st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=14).map("".join)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    return piece_bpe.PieceEncoder(piece_bpe.read_model(MODEL))


def digests(library, text):
    ids = library.encode(text or "")
    back = library.decode(ids) if ids else ""
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_equals_library(library, encoder):
    @given(TEXTS)
    @settings(max_examples=600, deadline=None)
    def same(text):
        ids = library.encode(text)
        assert encoder.encoded(text) == ids
        assert encoder.decoded(ids) == library.decode(ids)
        assert encoder.digests(text) == digests(library, text)

    same()
    for text in ("x" * 30000, "ab" * 9000, "日" * 9000, " " * 5000, "thé " * 4000, "▁" * 777 + "t"):
        assert encoder.encoded(text) == library.encode(text)


def test_decodes_any_ids(library, encoder):
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 300), rng.randrange(32000)]) for _ in range(rng.randrange(1, 8))]
        if 0 not in ids and 1 not in ids[:1] and 2 not in ids[:1]:
            assert encoder.decoded(ids) == library.decode(ids), ids


def test_every_prefix_has_its_encoding(library, encoder):
    word = "▁internationalisationsverfahren"
    tails = encoder.prefix_table(word)
    for end in range(1, len(word) + 1):
        assert tails[end] == library.encode_as_pieces(word[1:end])[-1] if end > 1 else tails[end] == "▁"


def test_rows(spark, library, encoder, monkeypatch, tmp_path):
    long = "wörter ohne ende " * 20000 + "z" * 40000
    rows = [(1, None), (2, ""), (3, " "), (3, "twice"), (3, "twice"), (None, "no id"), (4, long), (5, "a  b\n c")]
    df = spark.createDataFrame([(i, t, "clash", 7, "x") for i, t in rows], "doc_id long, text string, ids string, n_tokens int, lang string")
    got = sorted(map(tuple, piece_bpe.round_trip(df, MODEL).collect()), key=str)
    assert got == sorted(((i, *digests(library, t)) for i, t in rows), key=str)
    coded = piece_bpe.encode(df, MODEL)
    for r in coded.collect():
        ids = list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))
        assert r.n_tokens == len(ids) and any(ids == library.encode(t or "") for i, t in rows if i == r.doc_id)
    back = sorted(map(tuple, piece_bpe.decode(coded, MODEL).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t in rows), key=str)
    assert piece_bpe.round_trip(df.limit(0), MODEL).count() == 0
    monkeypatch.setattr(piece_bpe, "KEPT_WORDS", 2)
    encoder.room = -1
    assert encoder.encoded("one two three four") == library.encode("one two three four")


def test_query_covers_the_table(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_piece_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: digests(library, t) for d, t in docs.items()}


def test_other_models_are_refused(tmp_path):
    with open(MODEL, "rb") as f:
        data = f.read()
    at = data.rindex(b"\x12\x00\x18\x01\x20\x00")  # no map, a dummy blank, blanks as they are
    (tmp_path / "m").write_bytes(data[:at] + b"\x12\x00\x18\x00\x20\x00" + data[at + 6 :])
    with pytest.raises(ValueError):
        piece_bpe.read_model(str(tmp_path / "m"))
