"""Language of texts by a bidirectional gated recurrent network over bytes.

The network reads bytes in both directions, labels every position with a
softmax over the languages, and a document's probabilities are the mean over
all its positions. State is reset at white space, and every SEGMENT bytes in
longer runs (between characters), so that equal segments have equal labels: each distinct segment
of a task is evaluated once and counted as often as it occurs. The network is
trained in numpy by backpropagation through time on a bounded sample.

Cases: a null text, or one without any letter, is ``und`` with score 0.
Without labelled documents every text is ``und``. Rows with null ids and
repeated rows come back one for one; an empty table gives no rows. Texts of any
length are labelled whole, segment by segment; runs without blanks are cut
between characters. Only id, text and language are read, so other columns of
any name do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from incidentkit.llm.common import texts
from incidentkit.session import checkpoint

SAMPLE = 250  # documents per language that training uses at most
WORDS = 12_000  # segments per language that training uses at most
TEXT_SEGMENTS = 4_000  # segments of one text that training uses at most, drawn from all of it
SEGMENT = 32
HIDDEN = 12
STEPS = 600
BATCH = 256
RATE = 0.01
KEPT = 300_000  # segments whose labels a task keeps


def segments(text: bytes) -> list[bytes]:
    out = []
    for word in text.split():
        if len(word) <= SEGMENT:
            out.append(word)
            continue
        at = 0
        while at < len(word):
            end = at + SEGMENT
            while end < len(word) and end > at + 1 and word[end] & 0xC0 == 0x80:
                end -= 1  # not inside a character
            out.append(word[at:end])
            at = end
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Direction:
    """One gated recurrent layer; a table row per byte holds its three input projections."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.p = {
            "x": rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
            "gates": rng.normal(0, hidden**-0.5, (hidden, 2 * hidden)).astype(np.float32),
            "new": rng.normal(0, hidden**-0.5, (hidden, hidden)).astype(np.float32),
        }
        self.h = hidden

    def forward(self, data: np.ndarray, mask: np.ndarray | None, order, keep: bool = False):
        """States (n, T, H) in the places of their bytes, and what the way back needs."""
        h, p = self.h, self.p
        state = np.zeros((len(data), h), np.float32)
        states = np.zeros((len(data), data.shape[1], h), np.float32)
        tape = []
        for t in order:
            x = p["x"][data[:, t]]
            gates = sigmoid(x[:, : 2 * h] + state @ p["gates"])
            z, r = gates[:, :h], gates[:, h:]
            held = r * state
            new = np.tanh(x[:, 2 * h :] + held @ p["new"])
            following = state + z * (new - state)
            if mask is not None:
                following = np.where(mask[:, t, None], following, state)
            if keep:
                tape.append((t, state, z, r, held, new))
            state = following
            states[:, t] = state
        return states, tape

    def backward(self, data: np.ndarray, mask: np.ndarray, tape, into: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients by going back through the steps; ``into``: gradients of the states."""
        h, p = self.h, self.p
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        flow = np.zeros((len(data), h), np.float32)
        for t, state, z, r, held, new in reversed(tape):
            total = flow + into[:, t]
            m = mask[:, t, None]
            g = np.where(m, total, 0)
            d_new = g * z * (1 - new**2)
            d_z = g * (new - state) * z * (1 - z)
            d_held = d_new @ p["new"].T
            d_r = d_held * state * r * (1 - r)
            d_gates = np.concatenate([d_z, d_r], axis=1)
            grads["new"] += held.T @ d_new
            grads["gates"] += state.T @ d_gates
            np.add.at(grads["x"], data[:, t], np.concatenate([d_gates, d_new], axis=1))
            flow = np.where(m, g * (1 - z) + d_held * r + d_gates @ p["gates"].T, total)
        return grads


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ways = [Direction(rng, hidden), Direction(rng, hidden)]
        self.out = {"w": rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32), "b": np.zeros(len(languages), np.float32)}

    def _orders(self, length: int):
        return range(length), range(length - 1, -1, -1)

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Probabilities (n, T, K) of every position of segments of one length."""
        states = [way.forward(data, None, order)[0] for way, order in zip(self.ways, self._orders(data.shape[1]), strict=True)]
        z = np.concatenate(states, axis=2) @ self.out["w"] + self.out["b"]
        z = np.exp(z - z.max(axis=2, keepdims=True))
        return z / z.sum(axis=2, keepdims=True)

    def gradients(self, data: np.ndarray, mask: np.ndarray, y: np.ndarray):
        """Mean loss of all positions, and its gradients by parameter."""
        ran = [way.forward(data, mask, order, True) for way, order in zip(self.ways, self._orders(data.shape[1]), strict=True)]
        states = np.concatenate([s for s, _ in ran], axis=2)
        z = states @ self.out["w"] + self.out["b"]
        z = np.exp(z - z.max(axis=2, keepdims=True))
        probs = z / z.sum(axis=2, keepdims=True)
        n = mask.sum()
        loss = -float((np.log(probs[np.arange(len(y)), :, y] + 1e-9) * mask).sum() / n)
        d = probs
        d[np.arange(len(y)), :, y] -= 1
        d *= mask[:, :, None] / np.float32(n)
        k = d.shape[2]
        grads = [{"w": states.reshape(-1, states.shape[2]).T @ d.reshape(-1, k), "b": d.sum(axis=(0, 1))}]
        into = d @ self.out["w"].T
        h = self.ways[0].h
        for i, way in enumerate(self.ways):
            grads.append(way.backward(data, mask, ran[i][1], into[:, :, i * h : (i + 1) * h]))
        return loss, grads

    def train(self, words: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 3) -> None:
        """Adam on random batches."""
        rng = np.random.default_rng(seed)
        params = [self.out, *(way.p for way in self.ways)]
        first = [{k: np.zeros_like(v) for k, v in p.items()} for p in params]
        second = [{k: np.zeros_like(v) for k, v in p.items()} for p in params]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(words), BATCH)
            chosen = [words[i] for i in pick]
            width = max(map(len, chosen))
            data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in chosen), np.uint8).reshape(len(chosen), width)
            mask = np.arange(width)[None, :] < np.array([len(w) for w in chosen])[:, None]
            _, grads = self.gradients(data, mask, labels[pick])
            rate = RATE * (1 - step / (steps + 1))
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                for k in p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] ** 2 - v[k])
                    p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


class Labeller:
    """Sums of position probabilities per distinct segment, kept while the task runs."""

    def __init__(self, network: Network):
        self.network = network
        self.place: dict[bytes, int] = {}
        self.sums = np.zeros((1024, len(network.languages)), np.float32)

    def learn(self, words: set[bytes]) -> None:
        by_length: dict[int, list[bytes]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            for at in range(0, len(group), 2048):
                some = group[at : at + 2048]
                data = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), length)
                start = len(self.place)
                while start + len(some) > len(self.sums):
                    self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
                self.sums[start : start + len(some)] = self.network.positions(data).sum(axis=1)
                self.place.update(zip(some, range(start, start + len(some)), strict=True))

    def documents(self, rows: list[bytes | None]) -> list[tuple[str, float]]:
        if not self.network.languages:
            return [("und", 0.0)] * len(rows)
        cut = [segments(t) if t and has_letter(t) else [] for t in rows]
        if len(self.place) > KEPT:
            self.place.clear()
        new = set()
        for words in cut:
            new.update(words)
        self.learn(new.difference(self.place))
        out = []
        for words in cut:
            if not words:
                out.append(("und", 0.0))
                continue
            total = self.sums[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            out.append((self.network.languages[best], min(1.0, float(total[best] / sum(map(len, words))))))
        return out


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def fit(docs: DataFrame, may_teach: Column, lang: str = "lang", per_language: int = SAMPLE, per_text: int = TEXT_SEGMENTS) -> Network:
    """Network trained on at most ``per_language`` documents of every language.

    Of a text with more than ``per_text`` segments so many are drawn at random
    from all of it, with a fixed seed.

    Which documents teach is decided by ids and languages alone; their texts
    are fetched by a second scan next to the picked ids.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & may_teach)
    known = checkpoint(known.withColumn("h", F.xxhash64("doc_id", F.lit(11))))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not languages:
        return Network([])
    picked = None
    for one in languages:
        best = known.where(F.col("lang") == one).select("doc_id", "lang").distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(per_language)
        picked = best if picked is None else picked.union(best)
    rows = texts(docs).where("doc_id is not null").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "lang").collect()
    words, labels = [], []
    for k, one in enumerate(languages):
        held = sorted({(r["doc_id"], r["text"] or "") for r in rows if r["lang"] == one})
        rng = np.random.default_rng(17)
        own = []
        for _, t in held:
            found = segments(t.encode("utf-8", "surrogatepass"))
            own += found if len(found) <= per_text else [found[i] for i in np.sort(rng.choice(len(found), per_text, replace=False))]
        own = [own[i] for i in rng.permutation(len(own))[:WORDS]]
        words += own
        labels += [k] * len(own)
    network = Network(languages)
    if words:
        network.train(words, np.array(labels))
    return network


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, lang_pred and score of every row, in one pass without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        labeller = Labeller(held.value)
        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            for at in range(0, len(column), 256):
                found = labeller.documents(column.slice(at, 256).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
