"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of labelled
text.  A text is parsed by longest matches: from the automaton's start, characters
are followed as long as a match in the language's sample goes on; then a new phrase
begins.  ``phrases * log2(sample length) / characters`` estimates the bits per
character that the text costs in that language; the language with the least wins.

The sample is bounded: whole labelled texts are cut into pieces of ``SAMPLE_PIECE``
characters, and of all pieces of a language, wherever they lie in their texts, at most
``SAMPLE_ROWS`` are picked by the order of a hash, ``min(SAMPLE_CHARS, TOTAL_CHARS /
languages)`` characters a language in all (the automata are dense tables that every task
holds).  Scoring reads whole texts.

Texts are scored as runs of lower-cased letters parted by single blanks.  Long
texts are parsed in pieces of ``PIECE`` characters, all pieces of a batch side by
side; every piece begins a phrase in every language alike.

Cases: null text and text without a letter give ``und`` and score 0.  Without any
labelled row every text is ``und``.  Ties go to the first language in code point
order.  Null and repeated ids are rows like any other.  An empty table gives an empty
result.  Other columns pass through under any name; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lignum.llm.common import held_out, stored, working_names
from lignum.ship import ensure_shipped

SAMPLE_ROWS = 96
SAMPLE_PIECE = 1024
SAMPLE_CHARS = 24_576
TOTAL_CHARS = 400_000
PIECE = 512
UNKNOWN = "und"
BLANK = 0x20


def _fold_table() -> np.ndarray:
    """Code point to code point of the lower-cased letter, blank for anything else (the first plane; others are kept)."""
    table = np.full(0x10000, BLANK, np.uint32)
    for c in range(0x10000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_FOLD: list[np.ndarray] = []


def folded(text: str) -> np.ndarray:
    """Lower-cased letters of a text with single blanks between runs, as code points; empty without a letter."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(points < 0x10000, _FOLD[0][np.minimum(points, 0xFFFF)], points)
    wide = np.flatnonzero(points >= 0x10000)
    for i in wide:
        if not chr(points[i]).isalpha():
            out[i] = BLANK
    keep = out != BLANK
    keep[1:] |= out[:-1] != BLANK
    out = out[keep]
    return out[:-1] if len(out) and out[-1] == BLANK else out


class Automaton:
    """Suffix automaton of a sequence of symbols, as a dense table of transitions (-1: none)."""

    def __init__(self, symbols: list[int], alphabet: int):
        limit = max(2, 2 * len(symbols))
        self.next = np.full((limit, alphabet), -1, np.int32)
        rows: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(rows)
            rows.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in rows[p]:
                rows[p][c] = cur
                p = link[p]
            if p != -1:
                q = rows[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(rows)
                    rows.append(dict(rows[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and rows[p].get(c) == q:
                        rows[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        for s, row in enumerate(rows):
            for c, t in row.items():
                self.next[s, c] = t
        self.next = self.next[:len(rows)]


class Model:
    """Automata of all languages side by side, over one alphabet."""

    def __init__(self, samples: dict[str, list[np.ndarray]], sample_chars: int):
        self.langs = sorted(samples)
        texts = {}
        for lang in self.langs:
            parts, have = [], 0
            for t in samples[lang]:
                if have >= sample_chars or not len(t):
                    continue
                parts += [t[:sample_chars - have], np.array([BLANK], np.uint32)]
                have += len(parts[-2])
            texts[lang] = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        self.langs = [x for x in self.langs if len(texts[x])]
        self.points = np.unique(np.concatenate([texts[x] for x in self.langs])) if self.langs else np.zeros(0, np.uint32)
        self.bits = np.array([np.log2(len(texts[x]) + 1) for x in self.langs])
        tables, self.roots, at = [], [], 0
        for lang in self.langs:
            # one more symbol, without transitions, stands for unknown characters
            a = Automaton(np.searchsorted(self.points, texts[lang]).tolist(), len(self.points) + 1).next
            tables.append(np.where(a >= 0, a + at, -1).astype(np.int32))
            self.roots.append(at)
            at += len(a)
        self.table = np.concatenate(tables) if tables else np.zeros((0, 1), np.int32)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at, len(self.points)).astype(np.int64)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each text in each language (texts x languages)."""
        size = np.array([len(t) for t in texts])
        n = -(-size // PIECE)
        owner = np.repeat(np.arange(len(texts)), n)
        flat = self.symbols(np.concatenate(texts)) if size.sum() else np.zeros(0, np.int64)
        first = np.repeat(np.cumsum(size) - size, n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        begin = first + place * PIECE
        length = np.minimum(PIECE, np.repeat(size, n) - place * PIECE)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        active = np.searchsorted(-length, -np.arange(PIECE), "left")  # pieces longer than each step
        width = self.table.shape[1]
        flat_table = self.table.reshape(-1)
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        for k, root in enumerate(self.roots):
            state = np.full(len(begin), root, np.int64)
            made = np.ones(len(begin), np.int32)
            for step in range(int(length.max(initial=0))):
                m = active[step]
                sym = flat[begin[:m] + step]
                go = flat_table[state[:m] * width + sym]
                fail = go < 0
                # a new phrase begins with this character; one that the sample lacks is a phrase of its own
                again = flat_table[root * width + sym]
                made[:m] += fail & (state[:m] != root)
                made[:m] += fail & (again < 0)
                state[:m] = np.where(fail, np.where(again < 0, root, again), go)
            np.add.at(counts[:, k], owner, made)
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        shown = [folded(t) if t else np.zeros(0, np.uint32) for t in texts]
        size = np.array([len(t) for t in shown])
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        some = np.flatnonzero(size)
        if not self.langs or not len(some):
            return lang, score
        cost = self.phrases([shown[i] for i in some]) * self.bits / size[some][:, None]
        best = cost.argmin(1)
        gain = 1 / np.maximum(cost, 1e-9)
        score[some] = gain[np.arange(len(some)), best] / gain.sum(1)
        for i, b in zip(some, best, strict=True):
            lang[i] = self.langs[b]
        return lang, score


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> Model:
    """The model of a bounded sample of labelled text outside the held-out fold."""
    text = F.col(text_col).cast("string")
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang_col).alias("_lang"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_fp"), text.alias("_t"))
    last = F.floor((F.length("_t") - 1) / SAMPLE_PIECE).cast("int")
    order = Window.partitionBy("_lang").orderBy("_h", "_id", "_fp", "_p")
    # ranks up to a fixed number are cut below the shuffle; texts are read for picked pieces only
    pieces = rows.select("_lang", "_id", "_fp", F.explode(F.sequence(F.lit(0), last)).alias("_p")).distinct()
    picked = (pieces.withColumn("_h", F.xxhash64(F.lit(5), "_id", "_fp", "_p"))
              .withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample_rows)
              .select(F.col("_lang").alias("_pl"), F.col("_id").alias("_pid"), F.col("_fp").alias("_pf"), "_p", "_r"))
    picked = stored(picked, "picked")  # small, and known to be: texts meet it without a shuffle
    same = (F.col("_id").eqNullSafe(F.col("_pid")) & (F.col("_lang") == F.col("_pl")) & (F.col("_fp") == F.col("_pf")))
    got = (rows.join(picked, same).select(
        "_lang", "_r", F.substring("_t", F.col("_p") * SAMPLE_PIECE + 1, F.lit(SAMPLE_PIECE)).alias("_t"))
        .distinct().collect())  # at most sample_rows pieces a language
    samples: dict[str, list[np.ndarray]] = {}
    for r in sorted(got, key=lambda r: (r["_lang"], r["_r"], r["_t"])):
        samples.setdefault(r["_lang"], []).append(folded(r["_t"]))
    return Model(samples, min(sample_chars, total_chars // max(1, len(samples))))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``held_out``, ``lang_pred`` and ``score``."""
    ensure_shipped(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ("held_out", "lang_pred", "score")
    names = [c for c in docs.columns if c not in (*new, text_col)]
    shown, = working_names(docs, "_t")
    src = docs.select(*names, held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias(shown))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                lang, score = shared.value.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    [*part.schema.names[:-1], "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{kinds}, lang_pred string, score double")
