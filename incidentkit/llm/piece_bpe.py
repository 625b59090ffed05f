"""SentencePiece encoding and decoding by a prefix table over merge-type pieces.

A text gets the dummy blank in front and its blanks become the mark. It is cut
where no piece of the vocabulary can reach across, that is before a run of
marks. Within such a word every prefix has exactly one last token: a piece that
ends there (found by an automaton over the vocabulary) and that stays apart
from the last token of the shorter prefix when both are merged together. One
pass stores that last token for every prefix; the ids are then
recovered from the end backwards. Characters without a piece become the pieces
of their bytes.

Cases: a null text is the empty text, no ids and the hash of nothing. Rows with
null ids and repeated rows come back one for one. Only key and text are read,
so other columns of any name do not matter; an empty table gives no rows. A
text of any length is cut into words, and a word of any length costs time and
memory in proportion to its length. Strings of control pieces in a text are
ordinary text. A model that is no merge model, has a character map, collapses
blanks, lacks byte pieces or has pieces defined by its user is refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame

from incidentkit.llm.common import per_text, texts

#: Words whose ids a task keeps; beyond that it starts anew.
KEPT_WORDS = 600_000
#: Pairs of tokens whose test a task keeps; beyond that it starts anew.
KEPT_PAIRS = 1_500_000
MARK = "▁"
# Field numbers and kinds of the public model format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a message in the tagged wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        width = {1: 8, 5: 4}.get(tag & 7)
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        width = number() if width is None else width
        yield tag >> 3, data[at : at + width]
        at += width


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id."""
    with open(path, "rb") as f:
        parts = list(_fields(f.read()))
    pieces, options = [], {TRAINER: {}, NORMALIZER: {}}
    for number, value in parts:
        if number == PIECES:
            held = dict(_fields(value))
            pieces.append((held[1].decode(), struct.unpack("<f", held[2])[0] if 2 in held else 0.0, held.get(3, NORMAL)))
        elif number in options:
            options[number] = dict(_fields(value))
    trainer, normalizer = options[TRAINER], options[NORMALIZER]
    plain = not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1)
    if trainer.get(3) != 2 or not trainer.get(35) or not plain or any(k not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, k in pieces):
        raise ValueError("only merge models with byte pieces, a dummy blank and no character map are read")
    return pieces


class PieceEncoder:
    """Encodes and decodes texts; keeps the words it has met."""

    def __init__(self, model: list[tuple[str, float, int]]):
        self.pieces = model
        self.ids = {p: i for i, (p, _, k) in enumerate(model) if k == NORMAL}
        self.ranks = {p: -s for p, s, k in model if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(model) if k == BYTE}
        self.values = {i: b for b, i in self.bytes.items()}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shown = ["" if k == CONTROL else " ⁇ " if k == UNKNOWN else p.replace(MARK, " ") for p, _, k in model]
        self.names = [f"{i},".encode() for i in range(len(model))]
        # A word may end before a mark only if no piece holds a mark after another character.
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.words = re.compile(".+" if inner else f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.DOTALL)
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.sides: tuple[dict, dict] = ({}, {})
        #: By left token: which right tokens stay apart from it. The empty token stands for the start of a word.
        self.pairs: dict[str, dict[str, bool]] = {}
        self.room = KEPT_PAIRS
        self.kept: dict[str, tuple[int, bytes, str]] = {}

    def _merge(self, text: str) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """Merges of a few characters, best score first, the leftmost of equal ones; and the halves of what was built."""
        parts, built, ranks = list(text), {}, self.ranks
        while len(parts) > 1:
            best, i = min((ranks.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == float("inf"):
                break
            built[parts[i] + parts[i + 1]] = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, built

    def _split(self, piece: str) -> tuple[str, str] | None:
        """The two halves of a piece, if it is always built from them and each part comes before its whole."""
        if piece not in self.halves:
            parts, built = self._merge(piece)
            two = built.get(piece) if len(parts) == 1 else None
            born = lambda p: self.ranks[p] if len(p) > 1 else float("-inf")
            timely = two is not None and all(born(h) < self.ranks[piece] and (len(h) == 1 or self._split(h) is not None) for h in two)
            self.halves[piece] = two if timely else None
        return self.halves[piece]

    def _side(self, piece: str, side: int) -> list[tuple[str, float]] | None:
        """What borders on the right (1) or left (0) edge while a piece is built, each with the rank at which it goes."""
        if piece not in self.sides[side]:
            held, ends, part = [], float("inf"), piece
            while held is not None:
                held.append((part, ends))
                if len(part) == 1:
                    held.reverse()
                    break
                two = self._split(part)
                if two is None:
                    held = None
                else:
                    ends, part = self.ranks[part], two[side]
            self.sides[side][piece] = held
        return self.sides[side][piece]

    def _apart(self, left: str, right: str) -> bool:
        """Do two tokens stay as they are when their characters are merged together?

        A token after nothing must be what its own characters merge to. Follows
        in time what meets at the border; where a derivation is not in the order
        of its ranks (runs of marks share one rank), by merging.
        """
        a, b = self._side(left, 1) if left else None, self._side(right, 0)
        if not left:
            return self._merge(right)[0] == [right]
        if a is None or b is None:
            return self._merge(left + right)[0] == [left, right]
        get, i, j = self.ranks.get, 0, 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            rank = get(x + y)
            if rank is not None and rank < x_ends and rank <= y_ends:
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def prefix_table(self, word: str) -> list[str]:
        """Last token of word[:i], for i = 0 .. len(word).

        The automaton names the pieces that end at a place, the longest first;
        where none of them stays apart from what is before, the character does.
        """
        pairs, tails = self.pairs, [""]
        rights = [pairs.setdefault("", {})]
        for last, piece in self.automaton.iter(word):
            done = len(tails)
            if done > last + 1:
                continue
            for c in word[done - 1 : last]:
                tails.append(c)
                rights.append(pairs.get(c) or pairs.setdefault(c, {}))
            start = last + 1 - len(piece)
            fits = rights[start].get(piece)
            if fits is None:
                fits = rights[start][piece] = self._apart(tails[start], piece)
                self.room -= 1
            if fits:
                tails.append(piece)
                rights.append(pairs.get(piece) or pairs.setdefault(piece, {}))
        tails.extend(word[len(tails) - 1 :])
        return tails

    def word_ids(self, word: str) -> list[int]:
        """Ids of a word, recovered from the end of its prefix table."""
        tails, end, found, get = self.prefix_table(word), len(word), [], self.ids.get
        while end:
            token = tails[end]
            held = get(token)
            if held is None:
                found.extend(self.bytes[b] for b in reversed(token.encode("utf-8", "replace")))
            else:
                found.append(held)
            end -= len(token)
        found.reverse()
        return found

    def _known(self, text: str) -> list[tuple[int, bytes, str]]:
        """Count, packed ids and decoded text of every word of a text."""
        if not text:
            return []
        words = self.words.findall(MARK + text.replace(" ", MARK))
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        if self.room < 0:
            self.pairs.clear()
            self.room = KEPT_PAIRS
        kept = self.kept
        for w in set(words).difference(kept):
            ids = self.word_ids(w)
            kept[w] = len(ids), b"".join(map(self.names.__getitem__, ids)), self._surface(ids)
        return list(map(kept.__getitem__, words))

    def encoded(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self._known(text) for i in ids.split(b",")[:-1]]

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, hash of the ids and hash of the text decoded from them."""
        held = self._known(text)
        ids = b"".join(h[1] for h in held)[:-1]
        back = "".join(h[2] for h in held)
        return sum(h[0] for h in held), hashlib.sha256(ids).hexdigest(), hashlib.sha256(self._opened(back).encode()).hexdigest()

    def _surface(self, ids: list[int]) -> str:
        """Text of ids; a run of byte pieces is read as UTF-8, with a replacement character for every byte that does not fit."""
        if self.values.keys().isdisjoint(ids):
            return "".join(map(self.shown.__getitem__, ids))
        out, run = [], bytearray()
        for i in ids:
            if i in self.values:
                run.append(self.values[i])
                continue
            out.append(_utf8(bytes(run)))
            run.clear()
            out.append(self.shown[i])
        return "".join(out) + _utf8(bytes(run))

    @staticmethod
    def _opened(text: str) -> str:
        """Without the dummy blank."""
        return text[1:] if text.startswith(" ") else text

    def decoded(self, ids: list[int]) -> str:
        controls = (i for i, k in enumerate(ids) if self.pieces[k][2] != CONTROL)
        first = next(controls, None)
        text = self._surface(ids)
        return self._opened(text) if first is not None and self.pieces[ids[first]][0].startswith(MARK) else text


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _task(rows: DataFrame, path: str, schema: str, row) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(read_model(path))

    def make():
        encoder = PieceEncoder(held.value)
        return lambda value: row(encoder, value or b"")

    return per_text(rows, schema, make)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every row, without a shuffle."""

    def row(encoder: PieceEncoder, text: bytes):
        ids = encoder.encoded(text.decode("utf-8", "replace"))
        return len(ids), struct.pack(f"<{len(ids)}I", *ids)

    return _task(texts(docs), path, "doc_id long, n_tokens long, ids binary", row)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that the ids stand for."""

    def row(encoder: PieceEncoder, ids: bytes):
        return (encoder.decoded(memoryview(ids).cast("I").tolist()),)

    return _task(encoded.select("doc_id", "ids"), path, "doc_id long, text string", row)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the text decoded from them."""
    return _task(texts(docs), path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda encoder, text: encoder.digests(text.decode("utf-8", "replace")))
