"""Exact token counts at every prefix of a text by prefix dynamic programming.

A text is cut into pieces by the tokenizer's pattern; merges never cross a
piece. Within a piece, the encoding of every prefix is known from its last
token alone: a token that ends the prefix is the last one exactly if it and
the last token of the shorter prefix stay two tokens when they are encoded
together. So one pass over the piece stores the count of each prefix, and
truncation or budget questions are look-ups.

Cases: a null text is the empty text with no tokens. Rows with null ids and
repeated rows come back one for one; an empty table gives no rows. Time and
memory of a piece grow with its length, whatever that is. Only key and text are
read, so other columns of any name do not matter.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from incidentkit.llm.common import per_text, texts
from incidentkit.llm.unicode_classes import cut

#: Pieces whose tables a task keeps; beyond that it starts anew.
KEPT_PIECES = 400_000
#: Bytes of a piece up to which its prefixes are shared with other pieces.
SHARED_BYTES = 64
# Fixed value: the split pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in such a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[tuple[bytes, bytes], int], dict[str, int]]:
    """Merge ranks of pairs of byte strings, and the special tokens, of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    letters = byte_letters()
    raw = lambda t: bytes(letters[c] for c in t)
    pairs = (m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"])
    merges = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
    return merges, {t["content"]: t["id"] for t in held["added_tokens"] if t["special"]}


class PrefixCounter:
    """Counts tokens of texts; keeps the tables of the pieces it has met."""

    def __init__(self, merges: dict[tuple[bytes, bytes], int], special: dict[str, int] | None = None):
        self.merges = merges
        self.vocabulary = {a + b for a, b in merges}
        self.longest = max(map(len, self.vocabulary), default=1)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.halves = {a + b: (a, b) for a, b in merges}
        # Every token has one derivation, and parts come before wholes: then borders can be followed without merging.
        born = lambda t: merges[self.halves[t]] if t in self.halves else -1
        ordered = len(self.halves) == len(merges) and all(max(born(a), born(b)) < r for (a, b), r in merges.items())
        self.apart = lru_cache(1 << 17)(self._apart if ordered else lambda a, b: self._merge(a + b) == [a, b])
        self.whole = lru_cache(1 << 17)(lambda t: self._merge(t) == [t])
        self.sides: tuple[dict, dict] = ({}, {})
        self.kept: dict[str, int] = {}
        self.known: dict[bytes, int] = {}

    def _merge(self, data: bytes) -> list[bytes]:
        """Merges of a few bytes in order of rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.merges.get((parts[i], parts[i + 1]))) is not None]
            if not ranked:
                break
            at = min(ranked)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _side(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """What borders on the token's right (1) or left (0) edge while it is built, each with the rank at which it goes."""
        held = self.sides[side].get(token)
        if held is None:
            held, ends, part = [], float("inf"), token
            while True:
                held.append((part, ends))
                if part not in self.halves:
                    break
                ends = self.merges[self.halves[part]]
                part = self.halves[part][side]
            held.reverse()
            self.sides[side][token] = held
        return held

    def _apart(self, left: bytes, right: bytes) -> bool:
        """Do two tokens stay as they are when their bytes are encoded together?

        Follows in time what meets at their border. A merge across it happens if
        it comes before the left part goes, and no later than the right one goes.
        """
        a, b = self._side(left, 1), self._side(right, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            rank = self.merges.get((x, y))
            if rank is not None and rank < x_ends and rank <= y_ends:
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _ends(self, piece: bytes) -> tuple[list[int], list[int]]:
        """For every prefix: its tokens, and where its last token starts."""
        counts, starts = [0], [0]
        vocabulary, apart = self.vocabulary, self.apart
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = piece[start:end]
                if end - start > 1 and token not in vocabulary:
                    continue
                if apart(piece[starts[start] : start], token) if start else end == 1 or self.whole(token):
                    counts.append(counts[start] + 1)
                    starts.append(start)
                    break
        return counts, starts

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for i = 0 .. len(piece)."""
        return self._ends(piece)[0]

    def pieces(self, text: str):
        """Pieces of a text; a special token is one piece."""
        if self.special is None:
            yield from ((p, False) for p in cut(self.pattern, text))
            return
        at = 0
        for m in self.special.finditer(text):
            yield from ((p, False) for p in cut(self.pattern, text[at : m.start()]))
            yield m[0], True
            at = m.end()
        yield from ((p, False) for p in cut(self.pattern, text[at:] if at else text))

    def total(self, piece: str) -> int:
        """Tokens of a whole piece."""
        held = self.kept.get(piece)
        if held is None:
            data = piece.encode("utf-8", "surrogatepass")
            held = self.kept[piece] = self._known(data) if len(data) <= SHARED_BYTES else self.prefix_counts(data)[-1]
        return held

    def _known(self, data: bytes) -> int:
        """Count of a short piece; pieces with a common beginning share its stored prefixes.

        ``known`` holds count * 256 + length of the last token for every prefix
        of every short piece met, so only what is new of a piece is computed.
        """
        known, vocabulary, apart = self.known, self.vocabulary, self.apart
        size = len(data)
        done = size
        while done and data[:done] not in known:
            done -= 1
        for end in range(done + 1, size + 1):
            for start in range(max(0, end - self.longest), end):
                token = data[start:end]
                if end - start > 1 and token not in vocabulary:
                    continue
                if not start:
                    if end > 1 and not self.whole(token):
                        continue
                    known[token] = 256 + end
                    break
                before = known[data[:start]]
                if apart(data[start - (before & 255) : start], token):
                    known[data[:end]] = (before | 255) + 1 + end - start
                    break
        return known[data] >> 8 if size else 0

    def _room(self) -> None:
        if len(self.kept) >= KEPT_PIECES or len(self.known) >= 3 * KEPT_PIECES:
            self.kept.clear()
            self.known.clear()

    def count(self, text: str) -> int:
        self._room()
        if self.special is not None and self.special.search(text):
            return sum(1 if special else self.total(piece) for piece, special in self.pieces(text))
        found = cut(self.pattern, text)
        for piece in set(found).difference(self.kept):
            self.total(piece)
        return sum(map(self.kept.__getitem__, found))

    def stored(self, text: str) -> tuple[list[int], list[int]]:
        """Characters before each piece, and tokens before each piece; the last entry is the end."""
        self._room()
        at, tokens = [0], [0]
        for piece, special in self.pieces(text):
            at.append(at[-1] + len(piece))
            tokens.append(tokens[-1] + (1 if special else self.total(piece)))
        return at, tokens

    def prefix(self, text: str, n: int) -> int:
        """Exact tokens of text[:n], from the stored counts.

        Only the last two pieces are cut anew: a cut may move the border in a
        run of blanks, in a short ending such as 'll, or before a special token.
        """
        at, tokens = self.stored(text)
        k = max(0, bisect_right(at, min(n, len(text))) - 3)
        return tokens[k] + self.count(text[at[k] : n])

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that the text's first ``budget`` tokens cover in whole characters."""
        at, tokens = self.stored(text)
        k = bisect_right(tokens, budget) - 1
        if k >= len(at) - 1:
            return len(text)
        piece = text[at[k] : at[k + 1]]
        if self.special is not None and self.special.fullmatch(piece):
            return at[k]
        data = piece.encode("utf-8", "surrogatepass")
        counts, starts = self._ends(data)
        end = len(data)
        while counts[end] > budget - tokens[k]:
            end = starts[end]
        return at[k] + len(data[:end].decode("utf-8", "ignore"))


def count_tokens(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, in one pass without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        counter = PrefixCounter(*held.value)

        def one(text: bytes | None):
            n = counter.count((text or b"").decode("utf-8", "replace"))
            return len(text or b""), n, n > limit

        return one

    return per_text(texts(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)


def truncate(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """doc_id, the text cut to a token budget, and the length of the cut text."""
    held = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        counter = PrefixCounter(*held.value)

        def one(text: bytes | None):
            whole = (text or b"").decode("utf-8", "replace")
            n = counter.cut(whole, budget)
            return whole[:n], n

        return one

    return per_text(texts(docs), "doc_id long, cut string, n_chars long", make)
