"""Quality classifier: supervised subword embeddings.

A text is the bag of its words and of the character n-grams of its words (the
blanks around a word count as characters, so beginnings and ends differ from
middles); a word equal to the one before also counts as the word ``=``.  Each is hashed into one of ``BUCKETS`` learned vectors; the vectors are
averaged over all occurrences in the text, and a softmax over the average gives the
label.  Vectors and softmax are trained together by stochastic gradient descent in
numpy, one text a step, with a step size that falls to 0.  The step of the vectors is
``GAIN`` times larger, as a feature's share of a text is small.

Fitting uses a bounded sample of the labelled rows outside the held-out fold: about
``SAMPLE_ROWS``, chosen by a hash of the id.  Whole texts are read; a text enters
training as its at most ``BUCKETS`` bucket shares, so the sample's size is bounded
whatever the texts.  The shares are made side by side and the training runs in one
task; the driver gets the model alone (256 kB).

Scoring reads whole texts.  An average of vectors followed by a linear map equals the
average of the mapped vectors, so each bucket is one number when scoring.

Cases: null and empty texts, and texts of blanks alone, get the score of a text without
any feature.  Without labelled rows every score is 0, and with labels of one kind only
the (smoothed) share of label 1.  Repeated rows get equal scores.  Labels that repeat an
id count by the smallest; null labels don't count.  A null id is never held out for a
label (it has none) and ``held_out`` reads it as empty text.  Labels, language, source and
id are no inputs.  Other columns pass through, whatever their names; columns named like
a result are replaced.  Memory of a task: about 150 bytes a byte of a portion of texts
(1 MB, or the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lignum.llm.common import held_out, stored
from lignum.llm.hashing import M2, SPACES, U, Prefix, mix, portions, utf8, word_spans
from lignum.ship import ensure_shipped

SAMPLE_ROWS = 4_000
BITS = 16
BUCKETS = 1 << BITS
DIM = 10
GRAMS = (3, 4, 5)
EPOCHS = 5
RATE = 1.0
GAIN = 100.0
SEED = 42
AGAIN = mix(np.array([ord("=")], U))[0]  # the word that stands for a repeated word


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bucket)`` of every word and n-gram of every text."""
    raw, off = utf8(column)
    # every text gets a blank at both ends, so that its words have blanks around them
    n = len(off) - 1
    size = len(raw) + 2 * n
    buf = np.full(size, 0x20, np.uint8)
    at = np.arange(len(raw)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))
    buf[at] = raw
    buf[SPACES[buf]] = 0x20
    off = off + 2 * np.arange(n + 1)
    prefix = Prefix(buf, M2)
    b, e, count = word_spans(buf, off)
    rows, hashes = [np.repeat(np.arange(n), count)], [prefix.of(b, e)]
    again = np.zeros(len(b), bool)
    again[1:] = (hashes[0][1:] == hashes[0][:-1]) & (rows[0][1:] == rows[0][:-1])
    rows.append(rows[0][again])
    hashes.append(np.full(int(again.sum()), AGAIN, U))
    start = np.flatnonzero((buf & 0xC0) != 0x80)      # characters, not bytes
    ends = np.append(start, size)
    row = np.searchsorted(off, start, "right") - 1
    blank = buf[start] == 0x20
    blanks = np.concatenate(([0], np.cumsum(blank)))  # blanks before a character
    for k in GRAMS:
        i = np.arange(max(len(start) - k + 1, 0))
        # no blank strictly inside, and not only the two blanks of one text and the next
        good = (blanks[i + k - 1] == blanks[i + 1]) & (row[i] == row[i + k - 1] if len(i) else np.zeros(0, bool))
        i = i[good]
        rows.append(row[i])
        hashes.append(mix(prefix.of(ends[i], ends[i + k]) + U(k)))
    return np.concatenate(rows), (np.concatenate(hashes) >> U(64 - BITS)).astype(np.int64)


def shares(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(begin of each row, bucket, share of the row's features)``, buckets in order."""
    row, bucket = features(column)
    n = len(column)
    key, times = np.unique(row << BITS | bucket, return_counts=True)
    begin = np.searchsorted(key >> BITS, np.arange(n + 1))
    total = np.bincount(row, minlength=n)
    return begin, key & BUCKETS - 1, times / total[key >> BITS]


@dataclass
class Model:
    """A number per bucket (label 1 less label 0) and the logit of a text without features."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = -np.inf

    def scores(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        if self.bias == -np.inf:
            return np.zeros(n)
        row, bucket = features(column)
        total = np.bincount(row, minlength=n)
        mean = np.bincount(row, weights=self.weights[bucket], minlength=n) / np.maximum(total, 1)
        return 1 / (1 + np.exp(-np.clip(self.bias + mean, -700, 700)))


def gradients(vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray, share: np.ndarray,
              y: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Loss of one text, and its gradients by the text's average vector, the softmax weights and the bias."""
    mean = share @ vectors.take(at, axis=0)
    z = mean @ weights + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    loss = -float(np.log(max(p[y], 1e-300)))
    p[y] -= 1.0
    return loss, weights @ p, np.outer(mean, p), p


def fit(texts: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM,
        seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(vectors, softmax weights, bias)`` by stochastic gradient descent over ``(buckets, shares, label)``."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    weights, bias = rng.uniform(-1 / dim, 1 / dim, (dim, 2)), np.zeros(2)
    steps = max(epochs * len(texts), 1)
    order = np.concatenate([rng.permutation(len(texts)) for _ in range(epochs)])
    for k, i in enumerate(order):
        at, share, y = texts[i]
        step = rate * (1 - k / steps)
        _, g, gw, gb = gradients(vectors, weights, bias, at, share, y)
        weights -= step * gw
        bias -= step * gb
        if len(at):
            vectors[at] = vectors.take(at, axis=0) - np.outer(step * GAIN * share, g.astype(np.float32))
    return vectors, weights, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> Model:
    ensure_shipped(docs.sparkSession)
    known = (labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").cast("int").alias("y"))
             .where(F.col("y").isNotNull() & ~held_out(F.col("i"))).groupBy("i").agg(F.min("y").alias("y")))
    n = known.count()
    if not n:
        return Model()
    pick = F.xxhash64(F.lit(12), F.col("i"))
    known = known.where(F.pmod(pick, F.lit(1 << 30)) < int(min(1.0, sample_rows / n) * (1 << 30)))
    texts = docs.select(F.col(f"`{id_col}`").alias("j"), F.col(f"`{text_col}`").cast("string").alias("text"))
    picked = texts.join(known, F.col("i") == F.col("j")).select(pick.alias("place"), "y", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in portions(batch, 2)):
            begin, bucket, share = shares(part.column(2))
            offsets = pa.array(begin, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(bucket, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(share, pa.float32()))], ["place", "y", "at", "share"])

    sample = stored(picked.mapInArrow(counted, "place long, y int, at array<int>, share array<float>"), "labelled")
    total = sample.agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n")).first()
    ones, n = int(total["ones"] or 0), int(total["n"])
    if not n:
        return Model()
    if ones in (0, n):
        return Model(bias=float(np.log((ones + 0.5) / (n - ones + 0.5))))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        for batch in batches:
            for y, at, share in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                rows.append((at.values.to_numpy().copy(), share.values.to_numpy().copy(), y))
        if rows:
            vectors, weights, bias = fit(rows, epochs)
            one = (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([one.tobytes()]), pa.array([float(bias[1] - bias[0])])],
                                             ["weights", "bias"])

    # a bounded sample, in one order whatever the partitions were
    got = (sample.coalesce(1).sortWithinPartitions("place", "y", F.xxhash64("at", "share"))
           .mapInArrow(fitted, "weights binary, bias double").first())
    return Model(np.frombuffer(got["weights"], np.float32).astype(np.float64), got["bias"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.3) -> DataFrame:
    """``docs`` without its text, plus ``held_out``, ``score`` and ``predicted``."""
    ensure_shipped(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted", text_col)]
    # columns are told by place, so that no name can clash
    src = docs.select(*[F.col(f"`{c}`") for c in names], held_out(F.col(f"`{id_col}`")),
                      F.col(f"`{text_col}`").cast("string")).toDF(*names, "held_out", "score")
    at = len(names) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in portions(batch, at)):
            yield part.set_column(at, "score", pa.array(shared.value.scores(part.column(at))))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    out = src.mapInArrow(run, f"{kinds}, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
