"""Benchmark items in documents: CGK embedding, bit-sampling LSH, edit verification.

Items and documents are sequences of lower-cased words; in scripts without
blanks every character is one. The CGK random walk
maps a sequence to a longer one so that edit distance becomes Hamming
distance: at every step the word under the pointer is written, and a random
bit of step and word decides whether the pointer moves on. Bands of sampled
positions of that string are hashed, in as many repetitions as the target
recall asks for. Item-sized windows of a document that share a band with an
item are verified by exact edit distance. Half of the repetitions walk from the
first word of the window on, the other half from its last word back, so that
edits in either half leave a walk that is not disturbed.

A window within k edits of an item keeps at least m - 2 - 3k of its word
triples, so windows that hold fewer triples of any item are skipped; this
loses nothing.

Cases: null or empty texts and items match nothing. Items below LEAST_WORDS
words are found where the same words follow one another, without edits. A
document and item give one row, the best place, at a tie the first; repeated
documents give one row each, rows with a null id too. Items with equal texts
match alike. Empty tables of documents give no rows, empty tables of items no
matches. Texts of any length are searched whole, TOGETHER texts at a time. Only
id and text are read, so other columns of any name do not matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from incidentkit.llm.common import texts
from incidentkit.session import checkpoint

SHARE = 0.2  # edits per word of an item that are accepted
LEAST_WORDS = 5
RECALL = 0.99  # of passages at the accepted distance
BAND = 3  # sampled positions per repetition
STRETCH = 3  # steps of the full walk per word
TOGETHER = 256  # texts that are searched at once
ITEMS_PER_PASS = 20_000  # items that a task holds at once; more items take more passes over the documents
# Scripts that are written without blanks between words (Thai, Lao, Burmese, Khmer, kana, Han).
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED = re.compile(f"[{_UNSPACED}]")
WORD = re.compile(r"\w+")
WORD_OR_CHARACTER = re.compile(f"[{_UNSPACED}]|[^\\W{_UNSPACED}]+")


def words(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (WORD if text.isascii() or not UNSPACED.search(text) else WORD_OR_CHARACTER).findall(text)


def accepted(m: int, share: float = SHARE) -> int:
    """Edits accepted for an item of m words; never so many that no word triple need remain."""
    return max(0, min(int(share * m), (m - 3) // 3))


def repetitions(m: int, k: int, recall: float) -> int:
    """Repetitions so that a window k edits away shares a band with the target probability.

    An edit costs the walk a bounded number of steps on average until it has
    synchronised again; a third of the steps per edit is a cautious share.
    """
    apart = min(0.6, 6.0 * k / (STRETCH * m))
    hit = (1 - apart) ** BAND
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit))) if hit < 1 else 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Walks:
    """The random bits and sampled positions of one window size; equal for items and documents."""

    def __init__(self, size: int, reps: int, symbols: int, seed: int = 1):
        rng = np.random.default_rng([seed, size])
        self.size, self.reps, self.symbols = size, reps, symbols
        # A position tells most while the walk is inside the words that a start fixes, so the first steps are sampled.
        self.sampled = np.array([rng.choice(size, min(BAND, size), replace=False) for _ in range(reps)])
        self.steps = int(self.sampled.max()) + 1
        # One random word of 64 bits per symbol, repetition and 64 steps: bit t decides step t.
        self.bits = [rng.integers(0, 2**64, reps * symbols, dtype=np.uint64) for _ in range(-(-self.steps // 64))]

    def bands(self, windows: np.ndarray) -> np.ndarray:
        """Band hashes (n, reps) of windows (n, size) of word numbers; all repetitions walk together."""
        n = len(windows)
        flat = np.concatenate([windows, np.zeros((n, 1), np.int64)], axis=1).ravel()
        base = np.arange(n)[:, None] * (self.size + 1)
        offset = np.arange(self.reps)[None, :] * self.symbols
        at = np.repeat(base, self.reps, axis=1)
        written = np.empty((self.steps, n, self.reps), np.int64)
        for t in range(self.steps):
            symbol = written[t] = flat[at]
            at += ((self.bits[t // 64][offset + symbol] >> np.uint64(t % 64)) & np.uint64(1)).astype(np.int64)
        out = np.zeros((n, self.reps), np.uint64)
        for b in range(self.sampled.shape[1]):
            picked = written[self.sampled[:, b], :, np.arange(self.reps)].T.astype(np.uint64)
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + picked + np.uint64(1))
        return out ^ np.arange(self.reps, dtype=np.uint64)


def best_place(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edits of the item against any part of the region, and where that part starts; the first at a tie."""
    n = len(region)
    cost = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    places = np.arange(n + 1)
    for i, w in enumerate(item.tolist(), 1):
        swap = cost[:-1] + (region != w)
        drop = cost[1:] + 1
        here = np.minimum(swap, drop)
        origin = np.where(swap <= drop, start[:-1], start[1:])
        # Words left out of the item run along the row: a running minimum of cost - place.
        line = np.concatenate([[i], here]) - places
        least = np.minimum.accumulate(line)
        held = np.maximum.accumulate(np.where(line == least, places, 0))
        start = np.concatenate([[0], origin])[held]
        cost = least + places
    end = int(cost.argmin())
    return int(cost[end]), int(start[end])


class Index:
    """Items by size of window, their word triples, and their bands.

    Window sizes grow by a quarter; an item is looked for with the largest size
    that it fills, so its window holds its first words, and its last ones when
    words are read backwards.
    """

    def __init__(self, items: list[tuple[int, str | None]], share: float = SHARE, recall: float = RECALL):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            found = words(text)
            if found:
                numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]
                self.items.append((item_id, np.array(numbers, np.int64)))
        self.share = share
        self.longest = max((len(n) for _, n in self.items), default=0)
        #: By number of words: the short items by their words.
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for i, (_, numbers) in enumerate(self.items):
            if len(numbers) < LEAST_WORDS:
                self.short.setdefault(len(numbers), {}).setdefault(tuple(numbers.tolist()), []).append(i)
        triples = [self._triples(numbers) for _, numbers in self.items if len(numbers) >= LEAST_WORDS]
        self.triples = np.unique(np.concatenate(triples)) if triples else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.triples >> np.uint64(44)).astype(np.int64)] = True
        by_size: dict[int, list[int]] = {}
        for i, (_, numbers) in enumerate(self.items):
            size = LEAST_WORDS
            if len(numbers) < size:
                continue
            while size + max(1, size // 4) <= len(numbers):
                size += max(1, size // 4)
            by_size.setdefault(size, []).append(i)
        #: Forwards and backwards walks of a window size, with the items of each band.
        self.sizes: list[tuple[tuple[tuple[Walks, dict[int, list[int]]], ...], int, int, int]] = []
        for size, members in sorted(by_size.items()):
            lengths = [len(self.items[i][1]) for i in members]
            k = max(accepted(m, share) for m in lengths)
            need = min(m - 2 - 3 * accepted(m, share) for m in lengths)
            reps = -(-repetitions(size, min(k, size), recall) // 2)
            ways = []
            for seed, windows in ((1, [self.items[i][1][:size] for i in members]), (2, [self.items[i][1][: -size - 1 : -1] for i in members])):
                walks, table = Walks(size, reps, len(self.vocabulary) + 1, seed), {}
                for i, row in zip(members, walks.bands(np.stack(windows)).tolist(), strict=True):
                    for h in row:
                        table.setdefault(h, []).append(i)
                ways.append((walks, table))
            self.sizes.append((tuple(ways), k, need, max(lengths)))

    @staticmethod
    def _triples(numbers: np.ndarray) -> np.ndarray:
        s = numbers.astype(np.uint64)
        return Index._hash(s[:-2], s[1:-1], s[2:])

    @staticmethod
    def _hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return mixed(a * np.uint64(0x9E3779B97F4A7C15) + mixed(b * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(c + np.uint64(77))))

    def numbers(self, text: str | None) -> np.ndarray:
        """Word numbers of a text; 0 for words of no item."""
        found = words(text)
        return np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int64, len(found))

    @staticmethod
    def _cells(numbers: np.ndarray, places: np.ndarray, way: int, walk: tuple[Walks, dict[int, list[int]]], k: int) -> set[tuple[int, int]]:
        """(cell, item) of the windows from these places on, or back, that share a band with an item."""
        walks, table = walk
        cells: set[tuple[int, int]] = set()
        for low in range(0, len(places), 2048):
            some = places[low : low + 2048]
            bands = walks.bands(numbers[some[:, None] + way * np.arange(walks.size)[None, :]])
            for place, row in zip((some // (k + 1)).tolist(), bands.tolist(), strict=True):
                for h in row:
                    for i in table.get(h, ()):
                        cells.add((place, i))
        return cells

    def _exact(self, numbers: np.ndarray, begin: np.ndarray, best: list[dict[int, tuple[int, int]]]) -> None:
        """Notes the first place of every short item; gaps between texts are no words of any item."""
        for n, held in self.short.items():
            rows = np.lib.stride_tricks.sliding_window_view(numbers, n)
            firsts = np.unique([key[0] for key in held])
            for at in np.flatnonzero(np.isin(rows[:, 0], firsts)).tolist():
                for i in held.get(tuple(rows[at].tolist()), ()):
                    own = int(np.searchsorted(begin, at, side="right")) - 1
                    best[own].setdefault(i, (0, at - int(begin[own])))

    @staticmethod
    def _regions(cells: set[tuple[int, int]], k: int):
        """(item, first, last start) of neighbouring cells in which windows met an item."""
        run: tuple[int, int, int] | None = None
        for i, cell in sorted((i, cell) for cell, i in cells):
            if run and run[0] == i and cell - run[2] <= 1:
                run = (i, run[1], cell)
                continue
            if run:
                yield run[0], run[1] * (k + 1) - k, (run[2] + 1) * (k + 1) + k
            run = (i, cell, cell)
        if run:
            yield run[0], run[1] * (k + 1) - k, (run[2] + 1) * (k + 1) + k

    @staticmethod
    def _merged(regions: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Regions of one item that meet, as one."""
        out: list[tuple[int, int, int]] = []
        for i, low, high in sorted(regions):
            low = max(0, low)
            if out and out[-1][0] == i and low <= out[-1][2]:
                out[-1] = (i, out[-1][1], max(high, out[-1][2]))
            else:
                out.append((i, low, high))
        return out

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """Per text: (item_id, edits, words of the item, first word) of every item in it.

        The texts' words are laid side by side with gaps that no window bridges.
        """
        best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        if not self.items:
            return [[] for _ in texts]
        gap = np.zeros(3 * self.longest, np.int64)
        parts, begins, at = [gap], [], len(gap)
        for text in texts:
            own = self.numbers(text)
            begins.append(at)
            parts += [own, gap]
            at += len(own) + len(gap)
        numbers, begin = np.concatenate(parts), np.array(begins)
        self._exact(numbers, begin, best)
        known = np.flatnonzero((numbers[:-2] > 0) & (numbers[1:-1] > 0) & (numbers[2:] > 0))
        s = numbers.astype(np.uint64)
        hashes = self._hash(s[known], s[known + 1], s[known + 2])
        keep = self.seen[(hashes >> np.uint64(44)).astype(np.int64)]
        known, hashes = known[keep], hashes[keep]
        hits = known[np.isin(hashes, self.triples)]
        places = np.arange(len(hits))
        for (ahead, back), k, need, longest in self.sizes if len(hits) else ():
            found: list[tuple[int, int, int]] = []
            anchors = hits[np.searchsorted(hits, hits + longest + k) - places >= need]
            # An aligned window starts at most this far before its first triple that is left.
            starts = np.unique((anchors[:, None] - np.arange(3 * k + 1)[None, :]).ravel())
            found.extend(self._regions(self._cells(numbers, starts, 1, ahead, k), k))
            # And it ends at most so far after its last one.
            anchors = hits[places - np.searchsorted(hits, hits - longest - k, side="right") + 1 >= need]
            stops = np.unique((anchors[:, None] + 2 + np.arange(3 * k + 1)[None, :]).ravel())
            for i, low, high in self._regions(self._cells(numbers, stops, -1, back, k), k):
                m = len(self.items[i][1])
                found.append((i, low - m + 1 - accepted(m, self.share), high - m + 1 + accepted(m, self.share)))
            for i, low, high in self._merged(found):
                item = self.items[i][1]
                most = accepted(len(item), self.share)
                edits, start = best_place(item, numbers[low : high + len(item) + most])
                own = int(np.searchsorted(begin, low + start + len(item) // 2, side="right")) - 1
                first = max(0, low + start - begins[own])
                if edits <= most and (edits, first) < best[own].get(i, (most + 1, 0)):
                    best[own][i] = (edits, first)
        return [[(self.items[i][0], edits, len(self.items[i][1]), first) for i, (edits, first) in sorted(found.items())] for found in best]


def passes(items: DataFrame, per_pass: int = ITEMS_PER_PASS, share: float = SHARE, recall: float = RECALL) -> Iterator[Index]:
    """Indexes of all items, each of at most ``per_pass`` items in expectation, made one at a time; items are dealt by a hash."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    parts = max(1, -(-rows.count() // per_pass))
    part = F.pmod(F.xxhash64("text"), F.lit(parts))
    for p in range(parts):
        held = [(r["item_id"], r["text"]) for r in rows.where(part == p).collect()]  # at most a pass of items
        yield Index(sorted(held, key=lambda r: (r[1], r[0] is None, r[0] or 0)), share, recall)


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, recall: float = RECALL, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """doc_id, item_id, edits, n_words and first_word of every item found; one pass without a shuffle per block of items."""
    out = None
    for index in passes(items, per_pass, share, recall):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            for batch in batches:
                ids, found = batch.column(0).to_pylist(), []
                for at in range(0, len(ids), TOGETHER):
                    for i, own in zip(ids[at : at + TOGETHER], held.value.find(batch.column(1).slice(at, TOGETHER).to_pylist()), strict=True):
                        found.extend((i, *f) for f in own)
                if found:
                    columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "edits", "n_words", "first_word"])

        one = texts(docs).mapInArrow(run, "doc_id long, item_id long, edits long, n_words long, first_word long")
        out = one if out is None else out.union(one)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, recall: float = RECALL, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """Documents, with all their columns, in which no item is found; no shuffle.

    With several passes, each but the last writes what it keeps to the shared
    folder, so that no task holds more than one index.
    """
    place = docs.columns.index("text")
    for k, index in enumerate(passes(items, per_pass, share, recall)):
        docs = checkpoint(docs) if k else docs
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            for batch in batches:
                keep = []
                for at in range(0, batch.num_rows, TOGETHER):
                    keep += [not own for own in held.value.find(batch.column(place).slice(at, TOGETHER).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
