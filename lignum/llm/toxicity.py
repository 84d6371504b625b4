"""Toxicity by a counterfactually regularised classifier.

A logistic model over the presence of words and word beginnings in a text.  For
every labelled sentence that names a group of people, the group is swapped for
another one, and the loss adds ``PENALTY`` times the squared change of the score
(as logit): a group's name can then add little to a score, and neutral mentions
are not taken for toxic ones.

Fitting uses a bounded sample of the labelled rows outside the held-out fold:
about ``SAMPLE_ROWS`` of them, chosen by a hash of the id.  Features are chosen by
counts over the sample, made in Spark: all that are significantly more frequent in toxic
texts (likelihood ratio ``MIN_G2``, shares ``MIN_LIFT`` apart).  Weights are not
negative, so that a long clean passage cannot hide a toxic one.  Only the chosen
features of the sample reach the driver.  Scoring reads whole texts.

Cases: null and empty texts get the score of a text without any feature.  Without
labelled rows every score is 0.  Repeated rows get equal scores.  Of labels that
repeat an id the larger counts.  Labels, language, source and id are no inputs.
Rows without an id are scored like any other and teach nothing.  Texts of any length are
read in portions of rows; a row's memory grows with its own text.  An empty table gives
an empty result.  Other columns pass through under any name; columns named like a result
are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lignum.llm.common import held_out, stored, working_names
from lignum.llm.hashing import M2, U, Prefix, portions, utf8, word_spans
from lignum.ship import ensure_shipped

SAMPLE_ROWS = 20_000
MIN_G2 = 14.0
MIN_LIFT = 3.0
BEGINNINGS = (4, 5, 6)
PENALTY = 10.0
L2 = 1e-4
STEPS = 800

# Names of groups, in two lists whose members can stand for each other.
GROUPS = (
    ("women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees",
     "africans", "asians", "europeans", "americans", "mexicans", "gays", "lesbians", "teenagers", "pensioners"),
    ("female", "male", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "immigrant", "refugee",
     "african", "asian", "european", "american", "mexican", "gay", "lesbian", "transgender", "disabled", "black",
     "white"))
_SENTENCE = re.compile(r"[^.!?\n]+")

# Bytes that part words: all but ASCII letters, digits and the bytes of other characters.
BREAKS = np.ones(256, bool)
BREAKS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8)] = False
BREAKS[0x80:] = False


class Swaps:
    """Exchange of the names of groups: each name of a list for the next of the same list."""

    def __init__(self, groups: tuple[tuple[str, ...], ...] = GROUPS):
        self.next = {w: group[(k + 1) % len(group)] for group in groups for k, w in enumerate(group)}
        names = "|".join(re.escape(w) for w in sorted(self.next, key=len, reverse=True))
        self.name = re.compile(rf"\b({names})\b" if names else r"(?!)")

    def pairs(self, text: str) -> list[tuple[str, str]]:
        """Sentences of a lower-cased text that name a group, each with its counterfactual."""
        if not self.name.search(text):
            return []
        changed = ((s, self.name.sub(lambda m: self.next[m[0]], s)) for s in _SENTENCE.findall(text))
        return [(s, other) for s, other in changed if other != s]


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row, feature)`` of every distinct feature of each lower-cased text."""
    buf, off = utf8(column)
    b, e, n = word_spans(buf, off, BREAKS)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, U)
    p = Prefix(buf, M2)
    row = np.repeat(np.arange(len(n)), n)
    rows, feats = [row], [p.of(b, e)]
    for k in BEGINNINGS:
        long = e - b > k
        rows.append(row[long])
        feats.append(p.of(b[long], b[long] + k) ^ U(0x9E3779B97F4A7C15 * k & (1 << 64) - 1))
    row, feat = np.concatenate(rows), np.concatenate(feats)
    order = np.lexsort((feat, row))
    row, feat = row[order], feat[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feat[1:] != feat[:-1])
    return row[new], feat[new]


def lowered(batch: pa.RecordBatch, text: int) -> pa.RecordBatch:
    """A batch whose text column is lower-cased, null as empty."""
    low = pa.array([(t or "").lower() for t in batch.column(text).to_pylist()], pa.large_string())
    return batch.set_column(text, batch.schema.names[text], low)


@dataclass
class Model:
    """Chosen features (sorted), their weights, and the logit of a text without any."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf
    n_pairs: int = 0  # swapped sentences that the fit penalised

    def find(self, row: np.ndarray, feat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, index)`` of the features that are chosen ones."""
        if not len(self.keys):
            return row[:0], row[:0]
        at = np.minimum(np.searchsorted(self.keys, feat), len(self.keys) - 1)
        hit = self.keys[at] == feat
        return row[hit], at[hit]

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.bias == -np.inf:
            return np.zeros(len(column))
        row, at = self.find(*features(column))
        logit = self.bias + np.bincount(row, weights=self.weights[at], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def _linear(rows: np.ndarray, cols: np.ndarray, signs: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=w[cols] * signs, minlength=n)


def fit_weights(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, pair_rows: np.ndarray, pair_cols: np.ndarray,
                pair_signs: np.ndarray, n_pairs: int, n_features: int, penalty: float = PENALTY,
                steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Adam on logistic loss + L2 + the counterfactual penalty; weights stay at 0 or above."""
    w, b = np.zeros(n_features), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    one = np.ones(len(rows))
    for t in range(1, steps + 1):
        z = b + _linear(rows, cols, one, w, len(y))
        r = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y) / len(y)
        g = np.bincount(cols, weights=r[rows], minlength=n_features) + L2 * w
        if n_pairs:
            d = _linear(pair_rows, pair_cols, pair_signs, w, n_pairs)
            g += 2 * penalty / n_pairs * np.bincount(pair_cols, weights=pair_signs * d[pair_rows], minlength=n_features)
        gb = r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 / (1 - 0.9 ** t) * np.sqrt(1 - 0.999 ** t)
        w = np.maximum(0.0, w - rate * m / (np.sqrt(v) + 1e-8))
        b -= rate * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, penalty: float = PENALTY,
          groups: tuple[tuple[str, ...], ...] = GROUPS) -> Model:
    """The model of a bounded sample of labelled rows; ``groups`` are lists of lower-cased names of groups, in any
    language, whose members can stand for each other."""
    ensure_shipped(docs.sparkSession)
    known = (labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y")))
    n = known.count()
    if not n:
        return Model()
    share = min(1.0, sample_rows / n)
    pick = F.pmod(F.xxhash64(F.lit(13), F.col("_id")), F.lit(1 << 30)) < int(share * (1 << 30))
    texts = docs.select(F.col(id_col).alias("_tid"), F.col(text_col).cast("string").alias("text"))
    sample = stored(texts.join(known.where(pick), F.col("_tid") == F.col("_id")).select("y", "text"), "labelled")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                y = part.column(0).to_numpy(zero_copy_only=False)
                row, feat = features(lowered(part, 1).column(1))
                f, inv = np.unique(feat, return_inverse=True)
                bad = np.bincount(inv, weights=y[row], minlength=len(f)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.view(np.int64)), pa.array(bad), pa.array(np.bincount(inv, minlength=len(f)))],
                    ["f", "bad", "n"])

    totals = sample.agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    bad, total = int(totals["bad"] or 0), int(totals["n"])
    if not total:
        return Model()
    if bad in (0, total):
        return Model(bias=float(np.log((bad + 0.5) / (total - bad + 0.5))))
    per = sample.mapInArrow(counts, "f long, bad long, n long").groupBy("f").agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    a, good = F.col("bad").cast("double"), (F.col("n") - F.col("bad")).cast("double")

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)
    ea, eg = F.col("n") * F.lit(bad / total), F.col("n") * F.lit(1 - bad / total)
    rest_a, rest_g = F.lit(float(bad)) - a, F.lit(float(total - bad)) - good
    left = F.greatest(F.lit(total) - F.col("n"), F.lit(1))
    g2 = 2 * (part(a, ea) + part(good, eg) + part(rest_a, left * F.lit(bad / total))
              + part(rest_g, left * F.lit(1 - bad / total)))
    lift = a / F.lit(bad) >= MIN_LIFT * good / F.lit(total - bad)
    chosen = (per.withColumn("g2", g2).where(lift & (F.col("g2") >= MIN_G2))
              .select("f").collect())  # features of the bounded sample
    keys = np.sort(np.array([r["f"] for r in chosen], np.int64).view(U)) if chosen else np.zeros(0, U)
    picker = Model(keys, np.zeros(len(keys)))
    shared, swaps = docs.sparkSession.sparkContext.broadcast(picker), Swaps(groups)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 1)):
            low = lowered(batch, 1)
            got: list[tuple[int, list[int], list[int]]] = []
            row, at = shared.value.find(*features(low.column(1)))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for i, y in enumerate(batch.column(0).to_pylist()):
                got.append((y, at[cut[i]:cut[i + 1]].tolist(), []))
            pairs = [p for t in low.column(1).to_pylist() for p in swaps.pairs(t)]
            for k in (0, 1):
                r, x = shared.value.find(*features(pa.array([p[k] for p in pairs], pa.large_string())))
                c = np.searchsorted(r, np.arange(len(pairs) + 1))
                if k == 0:
                    first = [x[c[i]:c[i + 1]].tolist() for i in range(len(pairs))]
                else:
                    got += [(-1, first[i], x[c[i]:c[i + 1]].tolist()) for i in range(len(pairs))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.int32())),
                 pa.array([g[2] for g in got], pa.list_(pa.int32()))], ["y", "a", "b"])

    got = sample.mapInArrow(rows, "y int, a array<int>, b array<int>").collect()  # the bounded sample
    docs_rows = sorted((r["y"], r["a"]) for r in got if r["y"] >= 0)
    pairs = sorted((r["a"], r["b"]) for r in got if r["y"] < 0)
    r = np.repeat(np.arange(len(docs_rows)), [len(x[1]) for x in docs_rows])
    c = np.array([i for x in docs_rows for i in x[1]], np.int64)
    pr = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs]).astype(np.int64)
    pc = np.array([i for a, b in pairs for i in (*a, *b)], np.int64)
    ps = np.array([s for a, b in pairs for s in (*[1.0] * len(a), *[-1.0] * len(b))])
    w, b = fit_weights(r, c, np.array([x[0] for x in docs_rows], float), pr, pc, ps, len(pairs), len(keys), penalty)
    return Model(keys, w, b, len(pairs))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``held_out``, ``score`` and ``predicted``."""
    ensure_shipped(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted", text_col)]
    shown, = working_names(docs, "_t")
    src = docs.select(*names, held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias(shown))
    at = len(names) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, at):
                s = shared.value.scores(lowered(part, at).column(at))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s)], [*part.schema.names[:-1], "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    out = src.mapInArrow(run, f"{kinds}, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
