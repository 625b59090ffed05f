"""BPE and token counts against the public libraries; awkward rows."""

import hashlib
import struct

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from incidentkit.llm import byte_bpe, token_prefix
from incidentkit.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "the", "'", "'ll", "'s", " ", "  ", "\n", "é", "ñ", "中", "😀", "1", "23", "!", "<|endoftext|>", "<|endof", "\x1c", "\x85", "\xa0", "re", "ing", "!!", "aaaa", "²"]
TEXTS = st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=12).map("".join)


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def counter():
    return token_prefix.PrefixCounter(*token_prefix.read_vocabulary(JSON))


def test_encoding_equals_library(ranks, library):
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)

    @given(TEXTS)
    @settings(max_examples=300, deadline=None)
    def same(text):
        packed = encoder.packed(text.encode())
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode_ordinary(text)
        assert encoder.decoded(packed) == text.encode()

    same()
    for text in ("x" * 5000, "ab" * 700, " " * 3000, "thé" * 400):
        packed = encoder.packed(text.encode())
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode_ordinary(text)


def test_counts_and_prefixes_equal_library(counter, tokenizer):
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)

    @given(TEXTS, st.integers(0, 40))
    @settings(max_examples=300, deadline=None)
    def same(text, n):
        assert counter.count(text) == count(text)
        assert counter.prefix(text, n) == count(text[:n])

    same()
    assert counter.count("y" * 5000) == count("y" * 5000)


def test_unordered_merges_fall_back():
    """Merges whose parts come later than the whole cannot be followed in time."""
    odd = {(b"a", b"b"): 2, (b"b", b"c"): 1, (b"ab", b"c"): 0}
    c = token_prefix.PrefixCounter(odd)
    assert [c.prefix_counts(w)[-1] for w in (b"abc", b"ab", b"bc", b"aabc")] == [2, 1, 1, 3]


def test_cut_keeps_whole_tokens(counter, tokenizer):
    for text in ("the quick brown fox jumps", "naïve 中中 <|endoftext|> tail", "", "   a"):
        encoded = tokenizer.encode(text, add_special_tokens=False)
        for budget in range(len(encoded.ids) + 2):
            n = counter.cut(text, budget)
            ends = [e for _, e in encoded.offsets[:budget]]
            assert n <= (max(ends) if ends else 0) and (budget < len(encoded.ids) or n == len(text))
            assert len(tokenizer.encode(text[:n], add_special_tokens=False).ids) <= budget + 1


def test_shared_prefixes_equal_fresh_tables(counter):
    fresh = token_prefix.PrefixCounter(counter.merges)
    for word in (b" thin", b" thing", b" things", b" thi", b"nation", b" nationally"):
        assert counter.total(word.decode()) == fresh.prefix_counts(word)[-1]
        table_ = fresh.prefix_counts(word)
        assert [counter.known[word[:i]] >> 8 for i in range(1, len(word) + 1)] == table_[1:]


def test_native_fold_equals_free_form(spark, ranks):
    words = ["the", " nation", "naïve", "zzzz", "'ll", "中文", "aaaaaaaaab", " ", "!"]
    got = {r.word: list(r.ids) for r in byte_bpe.fold_words(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()}
    assert got == {w: [ranks[p] for p in byte_bpe.merge_word(w.encode(), ranks)] for w in words}


def test_queries_on_rows(spark, library, tokenizer):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    from incidentkit.llm.queries import op7_byte_bpe, op8_token_counts

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in op7_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in op8_token_counts(spark, "/root/testdata/sf0.001").collect():
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_awkward_rows(spark):
    rows = [(1, None, "x"), (None, "the", "y"), (2, "", None), (2, "", None), (3, "word " * 30_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = {(r.doc_id, r.n_tokens) for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert found == {(1, 0), (None, 1), (2, 0), (3, 30_001)}
    counted = token_prefix.count_tokens(docs, JSON, 512).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in counted)[:3] == [(0, 0)] * 3 and len(counted) == 5
    cut = {r.doc_id: r.n_chars for r in token_prefix.truncate(docs, JSON, 2).collect()}
    assert cut[1] == 0 and cut[3] == 9
    for empty in (byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN), token_prefix.count_tokens(docs.limit(0), JSON, 5)):
        assert empty.count() == 0
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(byte_bpe.encode(docs.where("doc_id = 3"), RANKS, public_tokenizers.PATTERN), RANKS).collect()}
    assert back == {3: b"word " * 30_000}


def _ends(kind):
    """First and last code point of every run of a class that the pattern library knows."""
    found = regex.compile(kind).findall("".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    for run in _runs(sorted(map(ord, found))):
        yield from {run[0] - 1, run[0], run[1], run[1] + 1}


def _runs(points):
    first = last = None
    for p in points:
        if last is None or p != last + 1:
            if first is not None:
                yield first, last
            first = p
        last = p
    if first is not None:
        yield first, last


def test_same_letters_and_numbers_as_the_libraries(ranks, library, counter, tokenizer):
    """At both ends of every run of letters, numbers and white space, and at the code points next to them."""
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    points = sorted({p for kind in (r"\p{L}", r"\p{N}", r"\s") for p in _ends(kind) if 0 <= p < 0x110000 and not 0xD800 <= p < 0xE000})
    assert len(points) > 2000
    texts = [f"{chr(p)}'ll a{chr(p)} 1{chr(p)}!{chr(p)}  {chr(p)}b" for p in points]
    for text, ids in zip(texts, library.encode_ordinary_batch(texts), strict=True):
        packed = encoder.packed(text.encode())
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids, ascii(text)
    for text, found in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert counter.count(text) == len(found.ids), ascii(text)
