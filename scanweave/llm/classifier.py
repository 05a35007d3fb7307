"""Quality classifier (operator 10): random-indexing vectors pooled per document, and a small calibrated network.

Tokens are maximal runs of letters, of digits or of other characters inside words, hashed to a fixed number of slots.
Every slot has a sparse random index vector of +1 and -1; over the whole corpus each slot adds up the index vectors of
the tokens within two places of it. These sums are whole numbers, so their order never matters, and their table has a
fixed size whatever the corpus. A document is the mean of its tokens' unit vectors, and the mean of their index
vectors. A two-layer numpy network is trained on a bounded sample of labelled rows, and a temperature, fitted on rows
it has not seen, turns its output into calibrated probabilities.

Edge cases: a null or empty text pools to zeros and gets the network's answer to that; null labels and labels without a
document are left out; of repeated labels one counts; repeated documents are scored alike; with no labels, or only one
kind, all scores are the share of label 1 (0.5 without any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import beside_keys, table
from .words import SPACE, U, Words, mix, slices

SLOTS, DIM, NONZERO, REACH = 1 << 14, 48, 4, 2
CHUNK = 256  # slots in a row of partial sums
#: Most labelled rows that the network is fitted on, taken by hash of their ids.
FIT_ROWS = 20_000

KIND = np.full(256, 3, np.uint8)  # other
KIND[SPACE] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2


class Tokens(Words):
    """Words cut where the kind of character changes."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        kind, n = KIND[self.buf], len(self.buf)
        cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1 if n else np.zeros(0, np.int64)
        self.start = np.union1d(self.start, cut)
        self.end = np.union1d(self.end, cut)
        self.first = np.searchsorted(self.start, self.doc_bytes)
        self.counts = np.diff(self.first)

    def slots(self) -> np.ndarray:
        return (self.hashes() % U(SLOTS)).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzeros of each slot's index vector."""
    h = mix(np.arange(SLOTS * NONZERO, dtype=U) * U(0x9E3779B97F4A7C15) + U(7)).reshape(SLOTS, NONZERO)
    return (h % U(DIM)).astype(np.int64), np.where((h >> U(40)) & U(1), 1, -1)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors over the task's rows: rows of (chunk, task, sums)."""
    place, sign = index_vectors()
    sign = sign.astype(np.float64)
    total = np.zeros(SLOTS * DIM, np.float64)  # whole numbers, exact below 2**53
    for cut in slices(batches, "text", 2 << 20):
        t = Tokens(cut.column("text"))
        if not len(t):
            continue
        s, doc = t.slots(), t.doc_of_word()
        base = s * DIM
        for d in range(1, REACH + 1):
            same = np.flatnonzero(doc[d:] == doc[:-d])
            # one count over all nonzeros of both neighbours: the table is gone over once
            at = np.concatenate([base[same][:, None] + place[s[same + d]], base[same + d][:, None] + place[s[same]]])
            total += np.bincount(at.ravel(), np.concatenate([sign[s[same + d]], sign[s[same]]]).ravel(), SLOTS * DIM)
    total = total.astype(np.int64)
    sums = total.reshape(-1, CHUNK * DIM)
    yield _sums(range(len(sums)), TaskContext.get().partitionId(), [x.tobytes() for x in sums])


def _sums(chunks, task: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([task] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "task", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk that the task meets; holds the table's fixed size at most."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for c, x in zip(b.column("chunk").to_pylist(), b.column("sums").to_pylist(), strict=True):
            v = np.frombuffer(x, np.int64)
            total[c] = total[c] + v if c in total else v
    if total:
        yield _sums(total, TaskContext.get().partitionId(), [v.tobytes() for v in total.values()])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The table of context sums over all rows, (SLOTS, DIM); added in two steps, so that no task reads every task's
    sums when there are many. Its size is fixed: SLOTS * DIM numbers come to the driver."""
    kind = "chunk int, task int, sums binary"
    parts = docs.select(F.col(text).alias("text")).mapInArrow(_contexts, kind)
    parts = parts.repartition("chunk", F.col("task") % 64).mapInArrow(_add, kind)
    parts = parts.repartition("chunk").mapInArrow(_add, kind)
    out = np.zeros((SLOTS // CHUNK, CHUNK * DIM), np.int64)
    for r in parts.select("chunk", "sums").collect():
        out[r["chunk"]] += np.frombuffer(r["sums"], np.int64)
    return out.reshape(SLOTS, DIM)


def feature_table(context: np.ndarray) -> np.ndarray:
    """Per slot the unit context vector and the index vector, float32."""
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    place, sign = index_vectors()
    index = np.zeros((SLOTS, DIM))
    np.add.at(index, (np.arange(SLOTS)[:, None], place), sign)
    return np.hstack([context / np.maximum(norm, 1e-12), index / np.sqrt(NONZERO)]).astype(np.float32)


def pool(texts: pa.Array, features: np.ndarray) -> np.ndarray:
    """Mean vector of each text's tokens; zeros without tokens. Sums go token by token in the text's order."""
    t = Tokens(texts)
    out = np.zeros((len(texts), features.shape[1]), np.float64)
    if len(t):
        full = np.flatnonzero(t.counts)
        slots = t.slots()
        # sums over distinct (document, slot) pairs, in sorted order
        key, times = np.unique(t.doc_of_word() * SLOTS + slots, return_counts=True)
        doc = key // SLOTS
        rows = features[key % SLOTS].astype(np.float64) * times[:, None]
        out[full] = np.add.reduceat(rows, np.searchsorted(doc, full), axis=0) / t.counts[full][:, None]
    return out


@dataclass(frozen=True)
class Network:
    """Two layers; scores are sigmoid(output / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.01, penalty: float = 1e-4, seed: int = 5) -> Network:
    """Adam on log loss over four fifths of the rows; the temperature is the one of least log loss on the others."""
    n, width = x.shape
    if n == 0 or y.min() == y.max():
        share = float(y.mean()) if n else 0.5
        share = min(max(share, 0.01), 0.99)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    held, own = order[: n // 5], order[n // 5 :]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-6
    z = (x - mean) / scale
    params = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            step += 1
            h = np.tanh(z[at] @ params[0] + params[1])
            g = (sigmoid(h @ params[2] + params[3]) - y[at]) / len(at)
            back = np.outer(g, params[2]) * (1 - h * h)
            grads = [z[at].T @ back + penalty * params[0], back.sum(0), h.T @ g + penalty * params[2], np.array([g.sum()])]
            for k, d in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    out, truth = net.logits(x[held]), y[held]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))

    def loss(t: float) -> float:
        p = np.clip(sigmoid(out / t), 1e-9, 1 - 1e-9)
        return float(-(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean())

    return Network(mean, scale, *params[:3], float(params[3][0]), min(grid, key=loss) if len(held) >= 20 else 1.0)


def held_out_ids(doc_id):
    """CRC-32 of the id as text, modulo 4, is 2; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", rows: int = FIT_ROWS) -> tuple[np.ndarray, Network]:
    """(feature table, network) from all texts and at most `rows` labelled rows that are not held out: those with the
    smallest hashes of their ids. At most `rows` pooled vectors come to the driver."""
    features = feature_table(word_vectors(docs, text))
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("double").alias("y")).filter("id is not null and y is not null").filter(~held_out_ids(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)  # the bound of the fit
    # `known` has `rows` rows of two numbers at most
    sample = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, "text"):
            x = pool(cut.column("text"), features).astype(np.float32)
            yield pa.RecordBatch.from_arrays([cut.column("id"), cut.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    got = sample.select("id", "y", "text").mapInArrow(pooled, "id long, y double, x binary").dropDuplicates(["id"]).collect()
    got = sorted(got, key=lambda r: r["id"])
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got]).astype(np.float64) if got else np.zeros((0, features.shape[1]))
    return features, fit_network(x, np.array([r["y"] for r in got]))


def score(docs: DataFrame, features: np.ndarray, net: Network, keys: list[str], text: str = "text") -> DataFrame:
    """keys and score (0 to 1) of each document's whole text."""
    rows = docs.select(F.struct(*keys).alias("keys"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, "text"):
            # rounded as in training, so that no sum's order shows
            s = np.round(net.score(pool(cut.column("text"), features).astype(np.float32).astype(np.float64)), 9)
            yield pa.RecordBatch.from_arrays([cut.column("keys"), pa.array(s)], ["keys", "score"])

    return beside_keys(rows, keys, run, "score double")


def held_out(doc_id: int | None) -> bool:
    """The same in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    features, net = fit(docs, table(spark, sf_dir, "labels"))
    got = score(docs, features, net, ["doc_id"])
    return got.select("doc_id", held_out_ids(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLES: dict = {}
