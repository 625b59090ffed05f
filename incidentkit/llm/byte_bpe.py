"""Byte-level BPE encoding and decoding over the distinct words of a text.

A text is cut into words by the vocabulary's pattern. Each distinct word is
taken as an array of bytes over which ranked merges are folded: the pair with
the lowest rank in the rank map is merged, the leftmost first, until no pair
has one. Decoding concatenates the pieces.

``fold_words`` is the fold in Spark's higher-order functions with a literal
rank map; ``encode`` runs the same fold in Arrow batches, where a task keeps
the words it has met. The README gives the figures that led to the second for
whole corpora.

Cases: a null text is the empty text, no ids and the hash of nothing. Rows with
null ids and repeated rows come back one for one; an empty table gives no rows.
A text of any length is cut into words, and long words are merged by a heap, so
time grows little faster than the text. Only key and text are read, so other
columns of any name do not matter. Ids that the vocabulary does not have make
decoding fail.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct

import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from incidentkit.llm.common import per_text, texts
from incidentkit.llm.unicode_classes import cut

#: Words whose ids a task keeps; beyond that it starts anew.
KEPT_WORDS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Pieces of one word."""
    if word in ranks:
        return [word]
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    if len(parts) > 256:
        return _merge_long(parts, get)
    pairs = [get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        best = min(pairs)
        if best == _NONE:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], _NONE)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], _NONE)
    return parts


_NONE = 1 << 60


def _merge_long(parts: list[bytes], get) -> list[bytes]:
    """The same fold with a heap over linked parts, for words of any length."""
    import heapq

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    alive: list[bytes | None] = list(parts)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if alive[i] is None or j >= n or alive[i] + alive[j] != both:
            continue
        alive[i], alive[j] = both, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x in (before[i], i):
            y = after[x] if x >= 0 else n
            if y < n and (r := get(alive[x] + alive[y])) is not None:
                heapq.heappush(heap, (r, x, alive[x] + alive[y]))
    return [p for p in alive if p is not None]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.kept: dict[str, bytes] = {}

    def packed(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = cut(self.pattern, text.decode("utf-8", "replace"))
        kept, ranks = self.kept, self.ranks
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for w in set(words).difference(kept):
            kept[w] = b"".join(struct.pack("<I", ranks[p]) for p in merge_word(w.encode(), ranks))
        return b"".join(map(kept.__getitem__, words))

    def decoded(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, memoryview(packed).cast("I").tolist()))


def _task(docs: DataFrame, path: str, pattern: str, schema: str, row) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make():
        encoder = Encoder(held.value, pattern)
        return lambda text: row(encoder, text or b"")

    return per_text(texts(docs), schema, make)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every row, without a shuffle."""

    def row(encoder: Encoder, text: bytes):
        packed = encoder.packed(text)
        return len(packed) // 4, packed

    return _task(docs, path, pattern, "doc_id long, n_tokens long, ids binary", row)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes that the ids stand for."""
    held = encoded.sparkSession.sparkContext.broadcast({i: b for b, i in read_ranks(path).items()})

    def make():
        pieces = held.value
        return lambda ids: (b"".join(map(pieces.__getitem__, memoryview(ids or b"").cast("I").tolist())),)

    return per_text(encoded.select("doc_id", "ids"), "doc_id long, bytes binary", make)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the bytes decoded from them."""

    def row(encoder: Encoder, text: bytes):
        packed = encoder.packed(text)
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(encoder.decoded(packed)).hexdigest()

    return _task(docs, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def rank_map(ranks: dict[bytes, int], buckets: int = 1 << 16) -> Column:
    """The rank map as one literal: small maps in an array, found by the hash of the key, so a look-up scans about one entry."""
    held: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        held[xxhash.xxh64_intdigest(key, 42) % buckets][key] = rank
    return F.from_json(F.lit(json.dumps(held)), "array<map<string,int>>")


def fold_words(words: DataFrame, ranks: dict[bytes, int], column: str = "word", buckets: int = 1 << 16) -> DataFrame:
    """Words with their ids (array of int), by built-in higher-order functions only."""
    literal = rank_map(ranks, buckets)

    def rank(key: Column) -> Column:
        return F.element_at(F.get(literal, F.xxhash64(key).bitwiseAND(F.lit(buckets - 1)).cast("int")), key)

    def step(parts: Column, _: Column) -> Column:
        ranked = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda k: rank(F.concat(F.get(parts, k), F.get(parts, k + 1))))

        def merge(r: Column) -> Column:
            at = F.array_position(r, F.array_min(r)).cast("int")
            joined = F.array(F.concat(F.get(parts, at - 1), F.get(parts, at)))
            return F.when(F.array_min(r).isNull(), parts).otherwise(F.concat(F.slice(parts, 1, at - 1), joined, F.slice(parts, at + 2, F.size(parts))))

        return F.when(F.size(parts) < 2, parts).otherwise(F.get(F.transform(F.array(ranked), merge), F.lit(0)))

    single = F.regexp_extract_all(F.hex(F.col(column).cast("binary")), F.lit(".."), F.lit(0))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(single), F.lit(1))), single, step)
    return words.select(column, F.transform(folded, rank).alias("ids"))
