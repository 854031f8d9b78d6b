"""Quality of documents by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stichos.llm.common import held_out, slices, texts_of
from stichos.llm.quality_rules import labelled_sample

PASSAGE, SAMPLE, SAMPLE_PASSAGES = 512, 6000, 64
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE = 32, 16, 12, 64, 0.003
THRESHOLD = 0.7

# classes of bytes, told apart by a passage's histogram of neighbouring pairs
_CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "?:;", "*", "#", "$", "%&", "|", "<>", "-_/\\@", "'\"()")
CLASS_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _chars in enumerate(_CLASSES):
    CLASS_OF[[ord(c) for c in _chars]] = _i
CLASS_OF[128:] = len(_CLASSES) + 1
N_CLASSES = len(_CLASSES) + 2
WIDTH = N_CLASSES * N_CLASSES + 6


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of PASSAGE bytes (the last may be shorter), and the number of passages of each text.

    A vector holds square roots of the shares of pairs of neighbouring byte classes, the share of distinct 8-byte strings in the passage and in the
    text so far as its passages go (repetition), sizes, and the share of distinct words. An empty text is one empty passage.
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(count) - count
    out = np.zeros((int(count.sum()), WIDTH), dtype=np.float32)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if not len(buf):
        return out, count
    doc = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(buf)) - np.repeat(np.cumsum(size) - size, size)
    passage = first[doc] + place // PASSAGE
    kind = CLASS_OF[buf]
    inside = passage[1:] == passage[:-1]
    pairs = N_CLASSES * N_CLASSES
    cells = np.bincount(passage[:-1][inside] * pairs + kind[:-1][inside] * N_CLASSES + kind[1:][inside], minlength=len(out) * pairs)
    length = np.bincount(passage, minlength=len(out)).astype(np.float32)
    out[:, :pairs] = np.sqrt(cells.reshape(len(out), pairs) / np.maximum(length, 1)[:, None])
    if len(buf) > 8:
        word = np.zeros(len(buf) - 7, np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | buf[k:k + len(word)]
        h = ((word ^ (word >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        for j, group in ((0, passage), (1, doc)):
            here = group[:len(h)] == group[7:]
            keys = np.sort(group[:len(h)][here].astype(np.uint64) << np.uint64(32) | h[here])
            new = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
            distinct = np.bincount((new >> np.uint64(32)).astype(np.int64), minlength=len(out) if j == 0 else len(texts))
            total = np.bincount(group[:len(h)][here], minlength=len(distinct))
            share = np.where(total > 0, distinct / np.maximum(total, 1), 1).astype(np.float32)
            out[:, pairs + j] = share if j == 0 else np.repeat(share, count)
    out[:, pairs + 2] = np.log1p(length) / 6
    out[:, pairs + 3] = np.repeat(np.log1p(size) / 10, count)
    out[:, pairs + 4] = np.repeat(np.array([len(set(w)) / len(w) if (w := t.split()) else 0 for t in texts]), count)
    out[:, pairs + 5] = np.repeat(size < 120, count)
    return out, count


class Model:
    """h = tanh(x W + b); attention = softmax of w . (tanh(h V) * sigmoid(h U)); score = sigmoid(c . (sum of attention h) + d)."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        weight = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.p = {"W": weight(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": weight(HIDDEN, ATTENTION), "U": weight(HIDDEN, ATTENTION),
                  "w": weight(ATTENTION, 1)[:, 0], "c": weight(HIDDEN, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, dict]:
        p, first = self.p, np.cumsum(count) - count
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        a = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(h * a[:, None], first, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return y, {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z}

    def gradients(self, x: np.ndarray, count: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        y, k = self.forward(x, count)
        p, h, a = self.p, k["h"], k["a"]
        dy = (y - target) * weight / len(target)
        dz = np.repeat(dy[:, None] * p["c"], count, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, np.cumsum(count) - count), count))
        gate = de[:, None] * p["w"]
        dt, ds = gate * k["s"] * (1 - k["t"] ** 2), gate * k["t"] * k["s"] * (1 - k["s"])
        dh = (dz * a[:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h ** 2)
        return {"W": k["x"].T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (k["t"] * k["s"]).T @ de,
                "c": k["z"].T @ dy, "d": np.array([dy.sum()])}

    def fit(self, x: np.ndarray, count: np.ndarray, target: np.ndarray, seed: int = 5) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-2
        first, rng = np.cumsum(count) - count, np.random.default_rng(seed)
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        share = np.clip(target.mean(), 0.02, 0.98)
        weight = np.where(target == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5    # the rarer label counts for somewhat more
        for _ in range(EPOCHS):
            order = rng.permutation(len(target))
            for at in range(0, len(order), BATCH):
                pick = order[at:at + BATCH]
                rows = np.concatenate([np.arange(first[i], first[i] + count[i]) for i in pick])
                step += 1
                for k, g in self.gradients(x[rows], count[pick], target[pick], weight[pick]).items():
                    g = g + 1e-4 * self.p[k] * (k in "WVU")
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)


def learn_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model | None:
    """A model from at most `rows` labelled documents that are not held out, each with at most SAMPLE_PASSAGES of its passages, evenly
    spaced; None without both labels. The bounds hold for fitting alone: scores see every passage."""
    sample = labelled_sample(docs, labels.filter(~held_out(4, 2)), "quality", rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 20):
            x, count = passages([t.encode() for t in part.column("text").to_pylist()])
            first, vectors = np.cumsum(count) - count, []
            for f, n in zip(first, count):
                at = f + np.unique(np.linspace(0, n - 1, min(n, SAMPLE_PASSAGES)).astype(int))
                vectors.append(x[at].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_label"), pa.array(vectors, pa.binary())],
                                             names=["doc_id", "label", "vectors"])

    got = sample.mapInArrow(run, "doc_id long, label int, vectors binary").toPandas().sort_values("doc_id", kind="stable")
    target = got["label"].to_numpy(dtype=float)
    if len(set(target)) < 2:
        return None
    blocks = [np.frombuffer(v, np.float16).reshape(-1, WIDTH) for v in got["vectors"]]
    model = Model()
    model.fit(np.concatenate(blocks).astype(np.float32), np.array([len(b) for b in blocks]), target)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Score of every document from all its passages, one row per document.

    The score sees the text alone. A null or empty text is one empty passage and has a score as well; without labels to learn from every score
    is 0.5. Rows with the same doc_id, or none, are each scored; other columns are not read.
    """
    model = learn_quality(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 20):
            x, count = passages([t.encode() for t in part.column("text").to_pylist()])
            score = model.forward(x, count)[0] if model else np.full(len(count), 0.5)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = texts_of(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
