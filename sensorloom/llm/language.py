"""Language of a text by a bidirectional gated recurrent network over its bytes.

Both directions read windows of bytes; every position gets a probability for each language, and the
positions of a whole text are pooled. The network is trained in numpy by backpropagation through time
on a bounded sample of windows, and executors apply it to all windows of all texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import held_out, text_or_empty

HIDDEN = 8
#: bytes of a window; windows cover a text end to end
WINDOW = 96
#: bounded training sample: documents of each language, and windows of each document
SAMPLE_DOCUMENTS = 800
SAMPLE_WINDOWS = 4
#: training steps, whatever the size of the sample, and windows in each
STEPS = 600
BATCH = 128
RATE = 0.01
SEED = 11
#: windows that a task runs at once
LANES = 4096
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # the reciprocal of infinity is the limit
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """Weights. ``table``: input by byte (256 is padding), (direction, byte, 3H); ``inner``: (direction, 3H, H);
    gates in the order update, reset, candidate; ``out``: (languages, 2H)."""

    languages: list[str]
    table: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)

        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
        return cls(languages, draw(2, 257, 3 * hidden), draw(2, 3 * hidden, hidden), np.zeros((2, 3 * hidden, 1), np.float32),
                   draw(len(languages), 2 * hidden), np.zeros((len(languages), 1), np.float32))

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.inner_bias, self.out, self.out_bias]

    def states(self, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, 2H, windows) of byte windows (windows, time); ``keep`` collects what training needs."""
        count, steps = windows.shape
        h = self.inner.shape[2]
        bytes_at = np.ascontiguousarray(windows.T).astype(np.intp)
        out = np.empty((steps, 2 * h, count), np.float32)
        for d in range(2):
            state = np.zeros((h, count), np.float32)
            columns = np.ascontiguousarray(self.table[d].T)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                given = np.take(columns, bytes_at[t], axis=1)
                inner = self.inner[d] @ state
                inner += self.inner_bias[d]
                gates = given[:2 * h]
                gates += inner[:2 * h]
                gates = _sigmoid(gates)
                update, reset = gates[:h], gates[h:]
                mid = reset * inner[2 * h:]
                mid += given[2 * h:]
                mid *= 2
                new = _sigmoid(mid)  # tanh by the logistic function
                new *= 2
                new -= 1
                if keep is not None:
                    keep.append((d, t, state, update, reset, new, inner[2 * h:]))
                state = new + update * (state - new)
                out[t, d * h:(d + 1) * h] = state
        return out

    def labels(self, windows: np.ndarray) -> np.ndarray:
        """Probability of each language at each position, (time, languages, windows)."""
        scores = np.matmul(self.out, self.states(windows))
        scores += self.out_bias
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores

    def gradients(self, windows: np.ndarray, wanted: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over the positions, and its gradient by backpropagation through time."""
        keep: list = []
        states = self.states(windows, keep)
        h, (count, steps) = self.inner.shape[2], windows.shape
        scores = np.matmul(self.out, states) + self.out_bias
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        real = (windows.T != 256).astype(np.float32)[:, None, :]
        total = real.sum()
        chosen = scores[:, wanted, np.arange(count)]
        loss = float(-(np.log(chosen + 1e-9) * real[:, 0]).sum() / total)
        scores[:, wanted, np.arange(count)] -= 1
        scores *= real / total
        grads = [np.zeros_like(p) for p in self.parameters]
        grads[3] += np.einsum("tlc,thc->lh", scores, states, optimize=True)
        grads[4] += scores.sum(axis=(0, 2))[:, None]
        from_out = np.matmul(self.out.T, scores)
        carried = np.zeros((2, h, count), np.float32)
        for d, t, before, update, reset, new, inner in reversed(keep):
            grad = from_out[t, d * h:(d + 1) * h] + carried[d]
            new_grad = grad * (1 - update) * (1 - new * new)
            update_grad = grad * (before - new) * update * (1 - update)
            reset_grad = new_grad * inner * reset * (1 - reset)
            given = np.concatenate([update_grad, reset_grad, new_grad])
            through = np.concatenate([update_grad, reset_grad, new_grad * reset])
            np.add.at(grads[0][d], windows[:, t], given.T)
            grads[1][d] += through @ before.T
            grads[2][d] += through.sum(axis=1, keepdims=True)
            carried[d] = self.inner[d].T @ through + grad * update
        return loss, grads


def trained(windows: np.ndarray, wanted: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = STEPS,
            seed: int = SEED) -> Network:
    """Adam over shuffled batches, the rate falling to a tenth."""
    net, rng, step = Network.fresh(languages, hidden, seed), np.random.default_rng(seed), 0
    first, second = ([np.zeros_like(p) for p in net.parameters] for _ in range(2))
    while step < steps:
        order = rng.permutation(len(windows))
        for part in np.array_split(order, max(1, len(windows) // BATCH)):
            if step == steps:
                break
            _, grads = net.gradients(windows[part], wanted[part])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            for p, g, a, b in zip(net.parameters, grads, first, second, strict=True):
                g *= min(1.0, 1.0 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return net


def to_windows(texts: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, padded with 256, and the number of windows of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = -(-sizes // width)
    out = np.full(int(counts.sum()) * width, 256, np.int16)
    starts = (np.cumsum(counts) - counts) * width
    data = np.frombuffer(b"".join(texts), np.uint8)
    out[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(data))] = data
    return out.reshape(-1, width), counts


def pooled(net: Network, texts: list[bytes], lanes: int = LANES) -> np.ndarray:
    """Mean probability of each language over the positions of each text, (texts, languages)."""
    windows, counts = to_windows(texts)
    sums = np.empty((len(windows), len(net.languages)), np.float64)
    for at in range(0, len(windows), lanes):
        part = windows[at:at + lanes]
        real = (part.T != 256).astype(np.float32)[:, None, :]
        sums[at:at + lanes] = (net.labels(part) * real).sum(axis=0).T
    ends = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0)])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return (total[ends[1:]] - total[ends[:-1]]) / np.maximum(sizes, 1)[:, None]


def fit(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, windows: int = SAMPLE_WINDOWS, hidden: int = HIDDEN) -> Network | None:
    """Train on windows of at most ``documents`` documents of each language that are not held out.

    The documents are those with the least hashes, their windows lie anywhere in their texts. None without labelled rows.
    """
    h, room = F.xxhash64("text"), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    parts = F.array(*[F.substring(F.col("text"), F.pmod(F.xxhash64(h, F.lit(i)), room).cast("int") + 1, F.lit(WINDOW))
                      for i in range(windows)])
    # the windows are cut before the ranking, so no text is moved
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out() & (F.length("text") > 0)).select(
        "lang", h.alias("h"), F.array_distinct(parts).alias("parts"))
    chosen = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= documents)
    sample = chosen.select("lang", F.explode("parts").alias("part")).orderBy("lang", "part").collect()
    if not sample:
        return None
    languages = sorted({r["lang"] for r in sample})
    wide, counts = to_windows([r["part"].encode()[:WINDOW] for r in sample])
    return trained(wide, np.array([languages.index(r["lang"]) for r in sample]), languages, hidden)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document.

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column("body")]
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            found, score, at = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), 0
            while net is not None and at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held < 1 << 20):
                    held += len(texts[end])
                    end += 1
                means = pooled(net, texts[at:end])
                found[at:end] = np.array(net.languages, object)[means.argmax(axis=1)]
                score[at:end] = np.clip(means.max(axis=1), 0, 1)
                at = end
            found[~letters], score[~letters] = UNKNOWN, 0
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(found.tolist(), pa.string()), pa.array(score)],
                                  ["doc_id", "held_out", "lang_pred", "score"])
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), letters.alias("letters"),
                       F.when(letters, text_or_empty()).otherwise("").cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
