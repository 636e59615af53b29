"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text with the probabilities of the languages, and a document's are
their mean. It is trained here, in NumPy, by backpropagation through time on a bounded sample of labelled
windows; prediction runs in Arrow batches over whole texts, cut into windows of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.wordtokens import text_groups
from parley.plans.shipping import ship_package

UNKNOWN = "und"
PARTS = 16  # the sample of a language is chosen in so many parts first


@dataclass(frozen=True)
class TrainingOptions:
    """The sample holds at most ``docs_per_language`` documents of a language and ``windows`` windows of each."""

    docs_per_language: int = 400
    windows: int = 4
    window: int = 64
    hidden: int = 12
    steps: int = 300
    batch: int = 128
    rate: float = 0.02
    seed: int = 42


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteNetwork:
    """Two gated recurrent layers, one in each direction, and a softmax over both at every byte."""

    def __init__(self, labels: list[str], hidden: int, seed: int):
        random, n = np.random.default_rng(seed), len(labels)
        draw = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
        self.labels, self.hidden = labels, hidden
        self.weights = {"out": draw(2 * hidden, n, scale=0.3), "bias": np.zeros(n, dtype=np.float32)}
        for side in "fb":
            self.weights[f"{side}_in"] = draw(256, 3 * hidden, scale=0.3)  # a row per byte
            self.weights[f"{side}_gates"] = draw(hidden, 2 * hidden, scale=0.3)
            self.weights[f"{side}_state"] = draw(hidden, hidden, scale=0.3)

    def _run(self, side: str, data: np.ndarray, memory: list | None = None) -> np.ndarray:
        """States after every byte, as (bytes, windows, hidden); side ``b`` reads from the end."""
        n, length = data.shape
        h, w = self.hidden, self.weights
        inputs, gates, candidate = w[f"{side}_in"], w[f"{side}_gates"], w[f"{side}_state"]
        states = np.empty((length, n, h), dtype=np.float32)
        state = np.zeros((n, h), dtype=np.float32)
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            x = inputs[data[:, t]]
            both = _sigmoid(x[:, : 2 * h] + state @ gates)
            update, reset = both[:, :h], both[:, h:]
            inner = state @ candidate
            new = np.tanh(x[:, 2 * h :] + reset * inner)
            if memory is not None:
                memory.append((t, state, update, reset, inner, new))
            state = new + update * (state - new)
            states[t] = state
        return states

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """(bytes, windows, languages)"""
        h = self.hidden
        logits = self._run("f", data) @ self.weights["out"][:h] + self._run("b", data) @ self.weights["out"][h:]
        logits += self.weights["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, data: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all bytes, by backpropagation through time."""
        n, length = data.shape
        h, w = self.hidden, self.weights
        memories = {"f": [], "b": []}
        states = np.concatenate([self._run(side, data, memories[side]) for side in "fb"], axis=2)
        logits = states @ w["out"] + w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        error = np.exp(logits)
        error /= error.sum(axis=2, keepdims=True)
        error[:, np.arange(n), labels] -= 1
        error /= n * length
        flat = error.reshape(-1, error.shape[2])
        found = {"out": states.reshape(-1, 2 * h).T @ flat, "bias": flat.sum(axis=0)}
        above = error @ w["out"].T
        for side in "fb":
            part = slice(0, h) if side == "f" else slice(h, 2 * h)
            gates, candidate = w[f"{side}_gates"], w[f"{side}_state"]
            d_in = np.zeros((256, 3 * h), dtype=np.float32)
            d_gates, d_candidate = np.zeros_like(gates), np.zeros_like(candidate)
            carried = np.zeros((n, h), dtype=np.float32)
            for t, state, update, reset, inner, new in reversed(memories[side]):
                d_state = above[t, :, part] + carried
                d_new = d_state * (1 - update) * (1 - new * new)
                d_update = d_state * (state - new) * update * (1 - update)
                d_reset = d_new * inner * reset * (1 - reset)
                d_both = np.concatenate([d_update, d_reset], axis=1)
                d_inner = d_new * reset
                d_gates += state.T @ d_both
                d_candidate += state.T @ d_inner
                np.add.at(d_in, data[:, t], np.concatenate([d_both, d_new], axis=1))
                carried = d_state * update + d_both @ gates.T + d_inner @ candidate.T
            found |= {f"{side}_in": d_in, f"{side}_gates": d_gates, f"{side}_state": d_candidate}
        return found

    def train(self, data: np.ndarray, labels: np.ndarray, options: TrainingOptions) -> None:
        """Adam over batches in which every language is as frequent as any other."""
        random = np.random.default_rng(options.seed)
        by_label = [np.flatnonzero(labels == k) for k in range(len(self.labels))]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, options.steps + 1):
            drawn = random.integers(0, len(by_label), options.batch)
            picked = np.array([by_label[k][random.integers(0, len(by_label[k]))] for k in drawn])
            rate = options.rate * (1 - step / (options.steps + 1))
            for name, slope in self.gradients(data[picked], labels[picked]).items():
                first[name] = 0.9 * first[name] + 0.1 * slope
                second[name] = 0.99 * second[name] + 0.01 * slope * slope
                ahead = first[name] / (1 - 0.9**step)
                self.weights[name] -= rate * ahead / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)

    def documents(self, texts: list[bytes], window: int, most: int = 2048) -> np.ndarray:
        """Mean probabilities of each text over all of its bytes; the last window may reach back into the one before."""
        owners, starts, counted = [], [], []
        for k, text in enumerate(texts):
            for start in range(0, len(text), window):
                begin = max(0, min(start, len(text) - window))
                owners.append(k)
                starts.append(begin)
                counted.append((start - begin, min(start + window, len(text)) - begin))
        sums = np.zeros((len(texts), len(self.labels)))
        steps = np.arange(window)[:, None]
        for low in range(0, len(owners), most):
            some = slice(low, low + most)
            pieces = [texts[k][s : s + window].ljust(window) for k, s in zip(owners[some], starts[some])]
            data = np.frombuffer(b"".join(pieces), dtype=np.uint8).reshape(-1, window)
            bounds = np.array(counted[some])
            inside = (steps >= bounds[:, 0]) & (steps < bounds[:, 1])
            np.add.at(sums, owners[some], np.einsum("twl,tw->wl", self.probabilities(data), inside.astype(np.float32)))
        return sums / np.maximum([[len(text)] for text in texts], 1) if texts else sums


def training_windows(docs: DataFrame, options: TrainingOptions, text: Column, label: Column, identity: Column) -> DataFrame:
    """``(label, bytes)``: a bounded sample by the order of a hash, windows spread evenly over each text."""
    rows = docs.filter(text.isNotNull() & label.isNotNull() & text.rlike(r"\p{L}")).select(
        label.alias("label"), F.encode(text, "UTF-8").alias("data"), F.xxhash64(identity, F.lit(options.seed)).alias("order")
    )
    # Only ids and labels are ranked; the texts of the few chosen rows are cut before they travel.
    size = F.length("data")
    gap = F.greatest(F.floor(size / options.windows), F.lit(1))
    starts = F.transform(F.sequence(F.lit(0), F.lit(options.windows - 1)), lambda k: F.least(k * gap, F.greatest(size - options.window, F.lit(0))))
    cut = F.transform(F.array_distinct(starts), lambda s: F.substring(F.col("data"), s.cast("int") + 1, F.lit(options.window)))
    rows = rows.select("label", "order", cut.alias("cut"), (F.spark_partition_id() % PARTS).alias("part"))
    # First among the input partitions of each part, so that the last task of a language gets PARTS samples at most.
    chosen = rows
    for keys in (["label", "part"], ["label"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("order"))
        chosen = chosen.withColumn("place", place).filter(F.col("place") <= options.docs_per_language)
    return chosen.select("label", F.explode("cut").alias("data"))


def trained_network(windows: DataFrame, options: TrainingOptions) -> ByteNetwork | None:
    sample = sorted((r["label"], bytes(r["data"])) for r in windows.collect())
    labels = sorted({label for label, _ in sample})
    if not labels:
        return None
    network = ByteNetwork(labels, options.hidden, options.seed)
    data = np.frombuffer(b"".join(d.ljust(options.window) for _, d in sample), dtype=np.uint8).reshape(-1, options.window)
    network.train(data, np.array([labels.index(label) for label, _ in sample]), options)
    return network


def _predicted(network: ByteNetwork | None, window: int):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("known").to_pylist()
            for first, texts in text_groups(batch, "text", 1 << 20):
                labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                asked = [k for k in range(len(texts)) if known[first + k]] if network else []
                found = network.documents([texts[k] for k in asked], window) if asked else []
                for k, p in zip(asked, found):
                    best = int(np.argmax(p))
                    labels[k], scores[k] = network.labels[best], min(1.0, float(p[best]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(first, len(texts)), pa.array(labels), pa.array(scores, pa.float64())],
                    ["row", "lang_pred", "score"],
                )

    return predict


def predict_languages(
    docs: DataFrame, network: ByteNetwork | None, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text",
    window: int = 128,
) -> DataFrame:
    """The columns ``keep`` of every row with ``lang_pred`` and ``score``, the mean probability of that language.

    The text alone is read, all of it. A null text and one without a letter are ``und`` with score 0, as is
    every text if nothing could be learned. Repeated rows get equal answers; ties go to the first language by name.
    """
    ship_package(docs.sparkSession)
    text = F.col(text_column)
    rows = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("row"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("known")
    )
    kind = rows.schema["row"].dataType.simpleString()
    found = rows.mapInArrow(_predicted(network, window), f"row {kind}, lang_pred string, score double")
    return found.select(*[F.col("row")[c].alias(c) for c in keep], "lang_pred", "score")
