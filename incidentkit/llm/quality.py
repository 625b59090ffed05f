"""Document quality by supervised subword embeddings.

A document is the mean of learned vectors of its words and of the character
n-grams inside its words, all hashed into one table; a softmax layer on the
mean gives the classes. Both are trained by stochastic gradient descent in
numpy on a bounded sample of labelled documents. Scoring needs one number per
bucket: the softmax of two classes is the logistic function of a difference of
scores, and that difference is the mean of the buckets' own differences.

Cases: a null or empty text has no features and gets the score of the bias.
Null labels teach nothing; without two classes the score is the share of the
one there is, or 0.5. Rows with null ids and repeated rows come back one for
one; an empty table gives no rows. Texts of any length are turned into features
PIECE characters at a time. Only id, text and label are read, so other columns
of any name do not matter. All pairs of equal neighbouring words share one
bucket, a feature made by hand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from incidentkit.llm.common import fold_of, texts

SAMPLE = 1000  # labelled documents per class that training uses at most
BUCKETS = 1 << 17
WIDTH = 8
EPOCHS = 4
RATE = 0.3
EASE = 1e-2
GRAMS = (3, 4, 5)
PIECE = 1 << 18  # characters that are turned into features at once
MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    """Mixes a 64-bit sum and takes its upper bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * kind)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


class Features:
    """Buckets of all words and n-grams of a run of characters; reuses its tables of powers."""

    def __init__(self):
        self.up, self.down = _powers(MULTIPLIER, PIECE + 64), _powers(_INVERSE, PIECE + 64)

    def __call__(self, chars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(bucket, place of its first character) of words, word pairs and n-grams.

        ``chars``: code points, blanks as 32, a blank at both ends. A pair of
        equal words has one bucket whatever the word is.
        """
        if len(chars) > len(self.up):
            self.up, self.down = _powers(MULTIPLIER, len(chars)), _powers(_INVERSE, len(chars))
        c = chars.astype(np.uint64)
        blank = chars == 32
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * self.up[: len(c)], dtype=np.uint64)])
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        words = (sums[ends] - sums[starts]) * self.down[starts]
        pairs = np.where(words[:-1] == words[1:], np.uint64(1), words[:-1] * np.uint64(31) + words[1:])
        grams, places = [], []
        for n in GRAMS:
            count = len(c) - n + 1
            if count <= 0:
                continue
            inside = np.ones(count, bool)
            for k in range(1, n - 1):
                inside &= ~blank[k : k + count]
            at = np.flatnonzero(inside)
            grams.append(_bucket((sums[at + n] - sums[at]) * self.down[at], n))
            places.append(at)
        none = np.zeros(0, np.int64)
        return [(_bucket(words, 0), starts), (_bucket(pairs, 1), starts[:-1]), (np.concatenate(grams or [none]).astype(np.int32), np.concatenate(places or [none]))]


FAMILIES = 3


def characters(text: bytes | None) -> np.ndarray:
    """Code points with every blank as 32 and one blank at both ends."""
    chars = np.frombuffer(f" {(text or b'').decode('utf-8', 'replace')} ".encode("utf-32-le", "replace"), np.uint32)
    return np.where((chars <= 32) | (chars == 160), np.uint32(32), chars)


def runs(chars: np.ndarray):
    """Cuts a very long text at blanks; a word longer than a run is cut where the run ends."""
    at = 0
    while len(chars) - at > PIECE:
        blanks = np.flatnonzero(chars[at : at + PIECE] == 32)
        cut = at + int(blanks[-1]) if len(blanks) and blanks[-1] > 0 else at + PIECE
        yield chars[at : cut + 1]
        at = cut
    yield chars[at:]


class Model:
    """``weights``: what each bucket adds to the difference of the two classes."""

    def __init__(self, weights: np.ndarray | None, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, rows: list[bytes | None]) -> np.ndarray:
        n = len(rows)
        totals, counts = np.zeros((FAMILIES, n)), np.zeros((FAMILIES, n), np.int64)
        if self.weights is not None:
            features, held, size = Features(), [], 0

            def flush():
                nonlocal held, size
                if not held:
                    return
                lengths = np.array([len(c) for _, c in held])
                owner = np.repeat(np.array([i for i, _ in held]), lengths)
                for k, (buckets, places) in enumerate(features(np.concatenate([c for _, c in held]))):
                    who = owner[places]
                    totals[k] += np.bincount(who, weights=self.weights[buckets], minlength=n)
                    counts[k] += np.bincount(who, minlength=n)
                held, size = [], 0

            for i, text in enumerate(rows):
                for run in runs(characters(text)):
                    if size + len(run) > PIECE:
                        flush()
                    held.append((i, run))
                    size += len(run)
            flush()
        margin = self.bias + (totals / np.maximum(counts, 1)).sum(axis=0)
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def train(rows: list[tuple[bytes | None, int]], seed: int = 7) -> Model:
    """Softmax regression on mean embeddings by stochastic gradient descent."""
    classes = {y for _, y in rows}
    if len(classes) < 2:
        return Model(None, {0: -4.0, 1: 4.0}[next(iter(classes))] if classes else 0.0)
    rng = np.random.default_rng(seed)
    features = Features()
    bags = []
    for text, y in rows:
        parts = [features(run) for run in runs(characters(text))]
        buckets, weights = [], []
        for k in range(FAMILIES):
            bucket, count = np.unique(np.concatenate([p[k][0] for p in parts]), return_counts=True)
            buckets.append(bucket)
            weights.append(count / max(1, count.sum()))
        bags.append((np.concatenate(buckets), np.concatenate(weights).astype(np.float32), y))
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    moved = np.zeros(BUCKETS, np.float32)
    out = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    share = np.bincount([y for *_, y in bags], minlength=2) / len(bags)
    weight = 0.5 / share  # both classes count alike
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            bucket, part, y = bags[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            mean = part @ table[bucket]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            error = (p / p.sum() - np.eye(2, dtype=np.float32)[y]) * np.float32(weight[y])
            back = out @ error
            out -= rate * np.outer(mean, error)
            bias -= rate * error
            # Adaptive steps: a bucket's rate falls with the square of what it has moved for.
            slope = part[:, None] * back
            moved[bucket] += (slope**2).mean(axis=1)
            table[bucket] -= rate * slope / (np.sqrt(moved[bucket]) + EASE)[:, None]
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, column: str, may_teach: Column, per_class: int = SAMPLE) -> DataFrame:
    """Texts and classes of at most ``per_class`` labelled documents per class, picked by a hash of the id.

    Labels without their texts are ranked; the picked ids, two classes of at
    most ``per_class`` rows, are then sent to the scan of the texts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & may_teach)
    picked = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(per_class)
        picked = one if picked is None else picked.union(one)
    return texts(docs).where("doc_id is not null").join(F.broadcast(picked), "doc_id")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (probability of class 1) of every row, in one pass without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            for at in range(0, len(column), 256):
                scores = held.value.scores(column.slice(at, 256).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Rows with a score of at least ``least``, with all their columns; texts are filtered where they are read."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            column = batch.column(place).cast(pa.binary())
            fits = [bool(s >= least) for at in range(0, batch.num_rows, 256) for s in held.value.scores(column.slice(at, 256).to_pylist())]
            yield batch.filter(pa.array(fits, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", may_teach: Column | None = None, per_class: int = SAMPLE) -> Model:
    may_teach = fold_of(F.col("doc_id"), 4) != 2 if may_teach is None else may_teach
    rows = sample(docs, labels, column, may_teach, per_class).select("doc_id", "text", "y").collect()
    rows = sorted({(r["doc_id"], r["text"] or "", r["y"]) for r in rows})
    return train([((text.encode("utf-8", "surrogatepass")), y) for _, text, y in rows])
