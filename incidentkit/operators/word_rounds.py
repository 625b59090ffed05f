"""Word vectors trained in rounds over partitions, with averaged parameters.

Documents are encoded once as word numbers and dealt into parts of PART_TOKENS
tokens or more, MOST_PARTS at most. In every round each part is trained by its
own task, from the same vectors, a block of documents after the other; the
vectors of a word are then averaged over the parts, weighed by how often the
part has trained them. So what a round shuffles is bounded by the vocabulary
(``max_words``) times MOST_PARTS, however long the texts are. A task holds one
block's tokens and the vectors of the vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from incidentkit.operators.ranking import global_rank
from incidentkit.operators.rows import unfold
from incidentkit.session import checkpoint

#: Tokens of a block, and positions that are trained together.
PART_TOKENS, TOGETHER = 100_000, 256
#: Positions whose contexts are summed by one product of small matrices.
STRIP = 32
#: Parts at most: each sends the vectors of the words that it has trained once a round.
MOST_PARTS = 12
#: Words whose vectors travel in one row.
TOGETHER_SENT = 4096
#: Steps of one word in a batch that are taken in full; more are scaled down to as many.
REPEATS = 16
#: Noise words that the pairs of a batch share.
SHARED = 64
#: Frequent words are passed over at times: the share of all tokens from which on.
OFTEN = 1e-3


class _Trainer:
    """Negative-sampling updates of a part; ``inner`` are word vectors, ``outer`` those of the targets."""

    def __init__(self, inner: np.ndarray, outer: np.ndarray, counts: np.ndarray, window: int, negative: int, bag: bool, seed: int):
        self.inner, self.outer, self.window, self.negative, self.bag = inner.copy(), outer.copy(), window, negative, bag
        self.rng = np.random.default_rng(seed)
        noise = counts.astype(np.float64) ** 0.75
        self.noise = np.cumsum(noise / noise.sum())
        share = counts / counts.sum()
        self.stays = np.minimum(1.0, np.sqrt(OFTEN / share) + OFTEN / share)
        #: How often each word's vector of either kind was trained.
        self.times = np.zeros((2, len(inner)), np.int64)

    def run(self, documents: list[np.ndarray], rate: float) -> None:
        tokens, sizes = np.concatenate(documents), np.array([len(d) for d in documents])
        document = np.repeat(np.arange(len(sizes)), sizes)
        stays = self.rng.random(len(tokens)) < self.stays[tokens]
        sizes = np.bincount(document[stays], minlength=len(sizes))
        tokens, sizes = tokens[stays & (sizes > 1)[document]], sizes[sizes > 1]
        ends = np.repeat(np.cumsum(sizes), sizes)
        begins = ends - np.repeat(sizes, sizes)
        # Word 0 stands around the text, where no context reaches.
        padded = np.pad(tokens, (self.window, self.window + STRIP))
        for low in range(0, len(tokens), TOGETHER):
            at = np.arange(low, min(len(tokens), low + TOGETHER))
            wide = self.rng.integers(1, self.window + 1, len(at))
            first, last = np.maximum(begins[at], at - wide), np.minimum(ends[at], at + wide + 1)
            if self.bag:
                self._bag(tokens[at], padded[low:], first - low + self.window, last - low + self.window, rate)
            else:
                reach = np.concatenate([np.arange(-self.window, 0), np.arange(1, self.window + 1)])
                near = at[:, None] + reach[None, :]
                row, place = np.nonzero((near >= first[:, None]) & (near < last[:, None]))
                words = tokens[near[row, place]]
                self._add(0, words, self._targets(tokens[at][row], self.inner[words], rate), np.ones(len(words), np.int64))

    def _bag(self, centers: np.ndarray, words: np.ndarray, first: np.ndarray, last: np.ndarray, rate: float) -> None:
        """Centers with the words around them: those of center i are words[first[i]:last[i]] but for itself, at i + window."""
        strips, width, size = -(-len(centers) // STRIP), STRIP + 2 * self.window, self.inner.shape[1]
        words, inside = words[: strips * STRIP + 2 * self.window], np.arange(STRIP)
        bounds = np.zeros((2, strips * STRIP), np.int64)
        bounds[:, : len(centers)] = first, last
        place = (np.arange(strips) * STRIP)[:, None, None] + np.arange(width)
        near = (place >= bounds[0].reshape(strips, STRIP, 1)) & (place < bounds[1].reshape(strips, STRIP, 1))
        near[:, inside, inside + self.window] = False
        near = near.astype(np.float32)

        hidden = (near @ self.inner[words[place[:, 0]]]).reshape(-1, size)[: len(centers)]
        hidden /= (last - first - 1)[:, None].astype(np.float32)
        back = np.zeros((strips * STRIP, size), np.float32)
        back[: len(centers)] = self._targets(centers, hidden, rate)
        back = near.transpose(0, 2, 1) @ back.reshape(strips, STRIP, size)

        # Strips overlap by two windows: their steps are added, a strip's length at a time.
        steps = np.zeros((strips * STRIP + width, size), np.float32)
        for a in range(0, width, STRIP):
            some = back[:, a : a + STRIP]
            steps[a : a + strips * STRIP].reshape(strips, STRIP, size)[:, : some.shape[1]] += some
        often = np.cumsum(np.bincount(first, minlength=len(words) + 1) - np.bincount(last, minlength=len(words) + 1))[: len(words)]
        often[self.window : self.window + len(centers)] -= 1
        self._add(0, words, steps[: len(words)], often)

    def _targets(self, centers: np.ndarray, hidden: np.ndarray, rate: float) -> np.ndarray:
        """One step for the pairs (hidden, center), against noise words that all pairs share, weighed as ``negative`` words each.

        The step of the vectors behind ``hidden`` is returned.
        """
        noise = np.minimum(np.searchsorted(self.noise, self.rng.random(SHARED)), len(self.noise) - 1)
        own, others = self.outer[centers], self.outer[noise]
        near = (1 - _sigmoid(np.einsum("bd,bd->b", hidden, own))) * np.float32(rate)
        far = _sigmoid(hidden @ others.T) * np.float32(rate * self.negative / SHARED)
        far[centers[:, None] == noise] = 0
        own *= near[:, None]
        own -= far @ others
        places = np.concatenate([centers, noise])
        self._add(1, places, np.concatenate([near[:, None] * hidden, -(far.T @ hidden)]), np.ones(len(places), np.int64))
        return own

    def _add(self, kind: int, words: np.ndarray, steps: np.ndarray, often: np.ndarray) -> None:
        """Add steps to the vectors of words; step i holds often[i] of a word's steps, none where that is 0."""
        order = np.argsort(words, kind="stable")
        placed = words[order]
        bounds = np.concatenate([[0], np.flatnonzero(placed[1:] != placed[:-1]) + 1, [len(placed)]])
        begins, met = bounds[:-1], bounds[1:] - bounds[:-1]
        used, total = placed[begins], steps[order[begins]]
        more = np.flatnonzero(met > 1)
        if len(more):
            which = np.repeat(np.arange(len(more)), met[more])
            again = order[np.repeat(met > 1, met)]
            total[more] = (np.arange(len(more))[:, None] == which).astype(np.float32) @ steps[again]
        times = np.add.reduceat(often[order], begins)
        # All steps of a batch start from the same vector: a word that occurs very often in it must not overshoot.
        many = np.flatnonzero(times > REPEATS)
        total[many] *= (REPEATS / times[many]).astype(np.float32)[:, None]
        (self.inner, self.outer)[kind][used] += total
        self.times[kind][used] += times


def _sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.clip(x, -30, 30)
    np.exp(np.negative(e, out=e), out=e)
    e += 1
    return np.reciprocal(e, out=e)


def vocabulary(df: DataFrame, tokens: str, min_count: int = 2, max_words: int = 100_000) -> DataFrame:
    """(word, number, n): the words with at least ``min_count`` occurrences, frequent ones first, ``max_words`` at most."""
    counts = unfold(df, tokens, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    ranked = global_rank(counts, F.desc("n"), F.col("word"), name="number")
    return ranked.where(F.col("number") <= max_words).select("word", (F.col("number") - 1).cast("int").alias("number"), "n")


def word_vectors(
    df: DataFrame, tokens: str, size: int = 150, window: int = 10, min_count: int = 2, rounds: int = 10, negative: int = 5,
    rate: float = 0.05, bag: bool = True, seed: int = 1, max_words: int = 100_000,
) -> DataFrame:
    """(word, vector) of the vocabulary, trained as a continuous bag of words or, without ``bag``, as skip-grams.

    A word of a part that no other part has keeps that part's vector. Null and
    empty documents teach nothing. Without any word there is no row.
    """
    spark = df.sparkSession
    known = checkpoint(vocabulary(df, tokens, min_count, max_words).orderBy("number"))
    rows = known.orderBy("number").collect()  # max_words at most
    if not rows:
        return spark.createDataFrame([], "word string, vector array<float>")
    counts = np.array([r.n for r in rows], dtype=np.int64)
    listed = spark.sparkContext.broadcast(pa.array([r.word for r in rows], pa.string()))

    def encode(batches):
        for batch in batches:
            lists = batch.column(0)
            found = pc.index_in(lists.flatten().cast(pa.string()), value_set=listed.value)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            upto = np.concatenate([[0], np.cumsum(pc.is_valid(found).to_numpy(zero_copy_only=False))])[ends]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(upto.astype("int32")), found.drop_null())], names=["words"])

    encoded = df.select(tokens).mapInArrow(encode, "words array<int>")
    parts = min(MOST_PARTS, max(1, -(-int(counts.sum()) // PART_TOKENS)))
    # A hash of the words deals documents evenly and repeats; equal documents may lie together.
    dealt = checkpoint(encoded.where("size(words) > 1").repartition(parts, F.xxhash64("words", F.monotonically_increasing_id())))
    rng = np.random.default_rng(seed)
    inner = ((rng.random((len(rows), size)) - 0.5) / size).astype(np.float32)
    outer = np.zeros((len(rows), size), np.float32)

    row = pa.schema({"part": pa.int32(), "kind": pa.int32(), "block": pa.int32(), "at": pa.binary(), "times": pa.binary(), "vectors": pa.binary()})
    mean_row = pa.schema([f for f in row if f.name not in ("part", "times")])

    def average(key, group):
        total, times = np.zeros((TOGETHER_SENT, size)), np.zeros(TOGETHER_SENT)
        for r in group.sort_by("part").to_pylist():
            at, often = np.frombuffer(r["at"], "int32"), np.frombuffer(r["times"], "int64")
            total[at] += np.frombuffer(r["vectors"], "float32").reshape(-1, size) * often[:, None]
            times[at] += often
        used = np.flatnonzero(times)
        mean = (total[used] / times[used, None]).astype("float32")
        return pa.Table.from_pylist([dict(zip(mean_row.names, (*(k.as_py() for k in key), used.astype("int32").tobytes(), mean.tobytes()), strict=True))], mean_row)

    for turn in range(rounds):
        held = spark.sparkContext.broadcast((inner, outer))
        now = rate * max(1 - turn / rounds, 0.02)

        def train(batches, held=held, now=now, turn=turn):
            trainer = _Trainer(*held.value, counts, window, negative, bag, seed * 1000 + turn)
            for documents in _blocks(batches):
                trainer.run(documents, now)
            part = TaskContext.get().partitionId()
            for kind, table in enumerate((trainer.inner, trainer.outer)):
                times = trainer.times[kind]
                for block, low in enumerate(range(0, len(times), TOGETHER_SENT)):
                    at = np.flatnonzero(times[low : low + TOGETHER_SENT])
                    if len(at):
                        sent = at.astype("int32").tobytes(), times[low + at].tobytes(), table[low + at].tobytes()
                        yield pa.RecordBatch.from_pylist([dict(zip(row.names, (part, kind, block, *sent), strict=True))], row)

        moved = dealt.mapInArrow(train, "part int, kind int, block int, at binary, times binary, vectors binary")
        averaged = moved.groupBy("kind", "block").applyInArrow(average, "kind int, block int, at binary, vectors binary")
        inner, outer = inner.copy(), outer.copy()
        # Two vectors per word of the vocabulary at most.
        for r in averaged.collect():
            at = np.frombuffer(r.at, "int32") + r.block * TOGETHER_SENT
            (inner, outer)[r.kind][at] = np.frombuffer(r.vectors, "float32").reshape(-1, size)
        held.destroy()
    # An Arrow table needs no setting of the session, unlike rows of numpy numbers.
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype="int32") * size), pa.array(inner.ravel()))
    found = pa.table({"word": pa.array([r.word for r in rows], pa.string()), "vector": vectors})
    return spark.createDataFrame(found, "word string, vector array<float>")


def _blocks(batches):
    """Documents as arrays of word numbers, in blocks of about PART_TOKENS tokens."""
    block, tokens = [], 0
    for batch in batches:
        lists = batch.column(0)
        numbers, ends = lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())
        for low, high in zip(np.concatenate([[0], ends]), ends, strict=False):
            block.append(numbers[low:high])
            tokens += high - low
            if tokens >= PART_TOKENS:
                yield block
                block, tokens = [], 0
    if block:
        yield block


def most_similar(vectors: DataFrame, word: str, n: int = 10) -> DataFrame:
    """(word, similarity): the n words with the highest cosine to a word."""
    from incidentkit.operators.similarity import cosine

    own = vectors.where(F.col("word") == word).select(F.col("vector").cast("array<double>").alias("own"))
    others = vectors.where(F.col("word") != word).withColumn("own", own.scalar())
    others = others.select("word", cosine(F.col("vector").cast("array<double>"), F.col("own")).alias("similarity"))
    return others.orderBy(F.desc("similarity"), "word").limit(n)
