"""Best-fit packing of tokenised documents into sequences of a fixed length.

Method: bounded-space online best-fit.  A packer keeps at most ``open_bins`` open
sequences in a bitset keyed by free space.  A piece goes to the open sequence
with the least free space that still holds it; if none does, a new one opens, and
when there are too many the fullest closes first.

Pieces are dealt to packers by a hash, about ``tokens_per_packer`` tokens each,
so the work of a packer is bounded, results do not depend on the order of the
input, and what stays open at the end of a packer is a small share of what it
filled (two sequences in a thousand, measured).  A task streams over
``PACKERS_PER_TASK`` packers, one after the other, and the token ids go with the
pieces, so they are shuffled once: ``pack`` returns every piece with its place, and
``pack_sequences`` the sequences themselves, each as soon as its bin closes (the open
bins of a packer hold 16 MB at most).

Cases: null text is empty and packs as the end token alone.  A null id is an id.  Rows
alike in id are told apart by their order only; equal rows give equal pieces, each
placed once.  A text of any length is tokenised in one piece of work (about ten bytes
of memory a byte).  Columns other than id and text are not read.  An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lignum.llm.common import give_back, giving_back, stored, text_of
from lignum.llm.hashing import _POWERS, Prefix, U, portions, word_spans
from lignum.ship import ensure_shipped

SEQUENCE = 4096
END_ID = 1
OPEN_BINS = 1024
TOKENS_PER_PACKER = 1 << 22
PACKERS_PER_TASK = 2
CACHE_WORDS = 200_000

_TOKENIZERS: dict[str, WordCache] = {}


class WordCache:
    """Token ids of whole texts, word by word.

    The tokenizer cuts at white space, lower-cases each character by itself and marks the
    last token of every piece it cuts, so for text of printable Latin-1 characters the ids of a
    text are those of its pieces.  Any other text goes to the tokenizer whole.

    Words are looked up by a 64-bit hash, all words of a portion of rows at once.  The first
    ``CACHE_WORDS`` words and pieces are kept for good, in flat arrays.
    """

    # The tokenizer's own cutting pattern, with its letter and number classes spelt out for Latin-1.
    PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
                        "|[^\\sa-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.pieces: dict[str, bytes] = {}
        # known words: sorted hashes, and where their ids lie in `flat`
        self.keys, self.start, self.size = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return "<|" not in text and text.replace("\n", " ").replace("\t", " ").isprintable()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of each piece: encoded side by side, cut at the last tokens."""
        for lo in range(0, len(pieces), 1000):
            part = pieces[lo:lo + 1000]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part) or (len(ids) and ends[-1] != len(ids)):
                yield from ((p, self.whole(p)) for p in part)
                continue
            data, at = ids.tobytes(), 0
            for piece, end in zip(part, (ends * 4).tolist(), strict=True):
                yield piece, data[at:end]
                at = end

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words one after the other, and how many each has."""
        cut = [self.PIECES.findall(w) for w in words]
        new = dict(self._encode([p for p in set().union(*cut) if p not in self.pieces]))
        if len(self.pieces) < CACHE_WORDS:
            self.pieces.update(new)
            ids = self.pieces.__getitem__
        else:
            old = self.pieces

            def ids(p: str) -> bytes:
                return old[p] if p in old else new[p]
        made = [b"".join(map(ids, c)) for c in cut]
        return np.frombuffer(b"".join(made), "<u4"), np.fromiter(map(len, made), np.int64, len(made)) // 4

    def ids_of_words(self, low: list[bytes]) -> list[bytes]:
        """Ids of lower-cased Latin-1 texts."""
        off = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
        raw = b"".join(low)
        buf = np.frombuffer(raw, np.uint8)
        b, e, n = word_spans(buf, off)
        h, first, inverse = np.unique(Prefix(buf).of(b, e), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        known = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        lost = np.flatnonzero(~known)
        spans = zip(b[first[lost]].tolist(), e[first[lost]].tolist(), strict=True)
        more, size = self.learn([raw[x:y].decode("latin-1") for x, y in spans])
        starts, sizes = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        if len(self.keys):
            starts, sizes = self.start[at], self.size[at]
        begin = len(self.flat) + np.cumsum(size) - size
        starts[lost], sizes[lost] = begin, size
        flat = np.concatenate((self.flat, more))
        count = sizes[inverse]
        ends = np.cumsum(count)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[inverse] - (ends - count), count)
        data = flat[place].tobytes()
        if len(self.keys) < CACHE_WORDS and len(lost):
            keys = np.concatenate((self.keys, h[lost]))
            order = np.argsort(keys)
            self.keys, self.flat = keys[order], flat
            self.start = np.concatenate((self.start, begin))[order]
            self.size = np.concatenate((self.size, size))[order]
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n)))] * 4
        return [data[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        plain = [self.plain(t) for t in texts]
        got = iter(self.ids_of_words([t.lower().encode("latin-1") for t, p in zip(texts, plain, strict=True) if p]))
        return [next(got) if p else self.whole(t) for t, p in zip(texts, plain, strict=True)]


def word_cache(path: str) -> WordCache:
    """One per worker process; it outlives tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordCache(path)
    return _TOKENIZERS[path]


def narrowed(ids: bytes) -> bytes:
    """16-bit ids if all fit; the number of ids tells the width."""
    x = np.frombuffer(ids, "<u4")
    return x.astype("<u2").tobytes() if len(x) and x.max() < 1 << 16 else ids


def widened(ids: bytes, length: int) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if len(ids) == 2 * length else ids


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
             sequence: int = SEQUENCE, end_id: int = END_ID, narrow: bool = False) -> DataFrame:
    """Pieces ``doc_id, piece, start, length, ids``; ``ids`` are little-endian unsigned 32-bit, or with
    ``narrow`` 16-bit in pieces whose ids all fit (``pack`` widens them)."""
    ensure_shipped(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer_path)
        for batch in batches:
            for part in portions(batch, 1, 2 << 20):
                ids, piece, start, length, data = [], [], [], [], []
                for doc, tokens in zip(part.column(0).to_pylist(), cache.ids(part.column(1).to_pylist()), strict=True):
                    tokens += end
                    for k, at in enumerate(range(0, len(tokens), 4 * sequence)):
                        cut = tokens[at:at + 4 * sequence]
                        ids.append(doc)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(cut) // 4)
                        data.append(narrowed(cut) if narrow else cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field(0).type), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(giving_back(run), f"doc_id {kind}, piece int, start long, length long, ids binary")


class Packer:
    """Open sequences in a bitset keyed by free space."""

    def __init__(self, sequence: int, open_bins: int):
        self.sequence, self.open_bins = sequence, open_bins
        self.bits = 0
        self.by_free: dict[int, list[int]] = {}
        self.open = 0
        self.made = 0

    def _put(self, free: int, bin_id: int) -> None:
        self.by_free.setdefault(free, []).append(bin_id)
        self.bits |= 1 << free
        self.open += 1

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        bin_id = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int, list[int]]:
        """``(bin, offset)`` of a piece, and the bins that closed by it."""
        fits = self.bits >> length
        closed = []
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.sequence, self.made
            self.made += 1
            if self.open >= self.open_bins:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
        if free > length:
            self._put(free - length, bin_id)
        else:
            closed.append(bin_id)
        return bin_id, self.sequence - free, closed


def dealt(pieces: DataFrame, tokens_per_packer: int) -> DataFrame:
    """``pieces`` with ``_packer`` and ``_order``, in the order in which packers take them.

    A partition holds whole packers, ``PACKERS_PER_TASK`` of them, whatever their number.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    packers = max(1, -(-total // tokens_per_packer))
    key = F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(packers))
    tasks = -(-packers // PACKERS_PER_TASK)
    return (pieces.withColumn("_packer", key)
            .withColumn("_order", F.xxhash64(F.lit(3), F.col("doc_id"), F.col("piece")))
            .repartitionById(tasks, F.floor(F.col("_packer") / PACKERS_PER_TASK).cast("int"))
            .sortWithinPartitions("_packer", "_order", "doc_id", "piece", "length"))


def pack(lengths: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS,
         tokens_per_packer: int = TOKENS_PER_PACKER) -> DataFrame:
    """``lengths`` (with ``doc_id, piece, length``) plus ``sequence_id`` and ``offset``.

    ``lengths`` should be stored: its sum decides the number of packers.  Its ``ids``, if any, come out 32-bit.
    """
    rows = dealt(lengths, tokens_per_packer)
    at = rows.columns.index("length")
    owner = rows.columns.index("_packer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, now = None, None
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                bins, offsets = [], []
                for who, length in zip(batch.column(owner).to_pylist(), batch.column(at).to_pylist(), strict=True):
                    if who != now:
                        packer, now = Packer(sequence, open_bins), who
                    bin_id, offset, _closed = packer.place(length)
                    bins.append(who << 40 | bin_id)
                    offsets.append(offset)
                names = [n for n in batch.schema.names if n not in ("_packer", "_order")]
                kept = [batch.column(n) for n in names]
                if "ids" in names:
                    kept[names.index("ids")] = pa.array(map(
                        widened, batch.column("ids").to_pylist(), batch.column(at).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*kept, pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())],
                                                 [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lengths.schema.fields)
    return rows.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_sequences(pieces: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS,
                   tokens_per_packer: int = TOKENS_PER_PACKER) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, and in order of their place ``doc_ids``, ``pieces``,
    ``lengths`` and the little-endian 32-bit ``ids``.  ``pieces`` as ``tokenize`` returns them, stored."""
    rows = dealt(pieces.select("doc_id", "piece", "length", "ids"), tokens_per_packer)
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker that has tokenised before gives that memory back
        _TOKENIZERS.clear()
        _POWERS.clear()
        give_back()
        packer, now = Packer(sequence, open_bins), None
        bins: dict[int, list[tuple]] = {}
        out: list[tuple] = []
        doc_type = pa.null()

        def close(bin_id: int) -> None:
            docs, numbers, lengths, ids = zip(*bins.pop(bin_id), strict=True)
            out.append((now << 40 | bin_id, docs, numbers, lengths, b"".join(map(widened, ids, lengths))))

        def emitted() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.list_(doc_type), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["sequence_id", "doc_ids", "pieces", "lengths", "ids"])

        for whole in batches:
            doc_type = whole.schema.field(0).type
            for lo in range(0, whole.num_rows, 256):
                for doc, piece, length, ids, who, _order in zip(
                        *(c.to_pylist() for c in whole.slice(lo, 256).columns), strict=True):
                    if who != now:
                        for bin_id in list(bins):
                            close(bin_id)
                        packer, now = Packer(sequence, open_bins), who
                    bin_id, _offset, closed = packer.place(length)
                    bins.setdefault(bin_id, []).append((doc, piece, length, ids))
                    for done in closed:
                        close(done)
                    if len(out) >= 256:
                        yield emitted()
        for bin_id in list(bins):
            close(bin_id)
        if out:
            yield emitted()

    return rows.mapInArrow(giving_back(run), f"sequence_id long, doc_ids array<{kind}>, pieces array<int>, lengths array<long>, ids binary")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   sequence: int = SEQUENCE) -> DataFrame:
    """Pieces with their token ids, the ids' digest and their place."""
    placed = pack(stored(tokenize(docs, tokenizer_path, id_col, text_col, sequence, narrow=True), "pieces", "zstd"),
                  sequence)
    return placed.withColumn("ids_crc32", F.crc32("ids"))


def packed_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     sequence: int = SEQUENCE) -> DataFrame:
    """The packed sequences of all documents, see ``pack_sequences``."""
    return pack_sequences(stored(tokenize(docs, tokenizer_path, id_col, text_col, sequence, narrow=True), "pieces", "zstd"), sequence)
