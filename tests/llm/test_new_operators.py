"""Conversation repair, subword quality and collocations against plain Python, with odd cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lignum.llm import collocations, conversation_repair, subword_quality

WORDS = re.compile(r"[^\x20\x09-\x0D]")


# --- conversations -------------------------------------------------------------------------------

def fault(role, text, seen):
    if not WORDS.search(text):
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return "truncated" if WORDS.findall(text)[-1] not in ".!?" else ""


def cheapest(rows):
    """All edit strings in order of cost, by a plain shortest path over (rows used, roles emitted)."""
    import heapq
    heap, done = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        key = (at, "sua".find(roles[-1:]) if roles else -1, bool(roles))
        if key in done and done[key] < (cost, audit):
            continue
        done.setdefault(key, (cost, audit))
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(lines)

        def ok(r):
            return re.fullmatch("s?(ua)*u?", roles + r)
        for r in ("user", "assistant"):
            if ok(r[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", at, roles + r[0], (*lines, f"{r}:")))
        if at < len(rows):
            role, text, bad = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, roles, lines))
            if bad in ("", "truncated"):
                more = 3 if bad else 0
                if role and ok(role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + role[0], (*lines, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    if ok(r[0]):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, roles + r[0], (*lines, f"{r}:{text}")))


def plain_audit(rows):
    """``rows`` of one conversation: (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, marked, n = set(), [], collections.Counter()
    for _t, role, text in rows:
        f = fault(role, text, seen)
        n[f] += 1
        marked.append((role, text, f))
        seen.add((role, text))
    first = [r[:1] for _t, r, _x in rows]
    turns = [t for t, _r, _x in rows if t is not None]
    cost, audit, text = cheapest(marked)
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": n["blank"],
            "duplicate": n["duplicate"], "truncated": n["truncated"],
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first)), "cost": cost,
            "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def talks():
    rnd = random.Random(5)
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why?", "é?", None, "Yes. ", "a" * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "umpire"]
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rnd.randint(1, 7)):
            rows.append((conv, rnd.choice([None, *range(-2, 6)]), rnd.choice(roles), rnd.choice(texts)))
    rows += [(900, t, ("user", "assistant")[t % 2], "Well.") for t in range(300)]
    rows += [(901, 3, "user", "Same.")] * 5 + [(902, None, None, None), (903, -(1 << 63), "user", "A."), (903, (1 << 63) - 1, "assistant", "B.")]
    return rows


TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [conversation_repair.BLOCK, 3])
def test_conversation_repair_equals_shortest_path(spark, block):
    rows = talks()
    by = collections.defaultdict(list)
    for c, *r in rows:
        by[c].append(tuple(r))
    want = {c: plain_audit(r) for c, r in by.items()}
    want[903]["gaps"] = (1 << 63) - 1
    none = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
            "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    df = spark.createDataFrame(rows, TALK).selectExpr("*", "1 AS conv", "2 AS h", "3 AS what", "4 AS codes").repartition(3)
    lost = spark.createDataFrame([(5000, None, None, None), (0, 1, "user", "x"), (5000, 1, "a", "b")], TALK)
    got = conversation_repair.audits(df, present=lost, block=block).collect()
    assert len(got) == len({r.conv_id for r in got})
    assert {r.conv_id: {k: r[k] for k in none} for r in got} == {**want, 5000: none}


def test_conversation_edits_are_the_repaired_table(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "So"), (2, 5, "system", "Be good.")]
    df = spark.createDataFrame(rows, TALK)
    got = conversation_repair.edits(df, conversation_repair.backpointers(df)).orderBy("conv", "step").collect()
    assert [(r.conv, r.step, r.edit, r.role, r.text) for r in got] == [
        (1, 0, "K", "user", "Hi."), (1, 1, "D", "user", "Hi."), (1, 2, "R", "assistant", "So"),
        (2, 0, "D", "system", "Be good.")]
    assert conversation_repair.audits(spark.createDataFrame([], TALK)).count() == 0


def test_conversation_damage(spark):
    rows = [(c, t, r, x) for c in (*range(40), None) for t, r, x in
            ((0, "assistant", "A. b! c? d"), (1, None, None), (None, "user", "Hello."))]
    got = collections.Counter((r.conv_id, r.turn, r.role, r.text, r.lost)
                              for r in conversation_repair.damaged(spark.createDataFrame(rows, TALK)).collect())
    want = collections.Counter()
    for c, t, r, x in rows:
        r, x = r or " ", x or " "
        luck = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(luck, x)
        want[c, t, "user" if luck == 4 else r, x, luck == 0] += 2 if luck == 3 else 1
    assert got == want


# --- quality -------------------------------------------------------------------------------------

def plain_features(text):
    text = " " + re.sub(r"[\x20\x09-\x0D]", " ", text) + " "
    words = text.split(" ")
    words = [w for w in words if w]
    grams = [text[i:i + k] for k in subword_quality.GRAMS for i in range(len(text) - k + 1) if " " not in text[i + 1:i + k - 1]]
    return len(words) + sum(a == b for a, b in itertools.pairwise(words)) + len(grams), set(words), set(grams)


def test_subword_features_are_words_and_ngrams():
    texts = ["", None, " ", "a", "the the cat", "é\tüü\nxyz  ab", "x" * 50, "word"]
    row, bucket = subword_quality.features(pa.array(texts))
    n = np.bincount(row, minlength=len(texts))
    distinct = set()
    for i, t in enumerate(texts):
        count, words, grams = plain_features(t or "")
        assert n[i] == count
        distinct |= {("w", w) for w in words} | {("g", g) for g in grams}
    # equal features share a bucket: no more buckets than features (and the repeated word's)
    assert len(set(bucket.tolist())) <= len(distinct) + 1
    alone = subword_quality.features(pa.array(["the the cat"]))[1]
    assert sorted(alone.tolist()) == sorted(bucket[row == 4].tolist())


def test_subword_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    v, w, b = rng.normal(size=(6, 4)), rng.normal(size=(4, 2)), rng.normal(size=2)
    at, share = np.array([1, 3, 4]), np.array([0.5, 0.25, 0.25])
    loss, g, gw, gb = subword_quality.gradients(v, w, b, at, share, 1)
    eps = 1e-6
    for i, s in zip(at, share, strict=True):
        for j in range(4):
            moved = v.copy()
            moved[i, j] += eps
            assert abs((subword_quality.gradients(moved, w, b, at, share, 1)[0] - loss) / eps - s * g[j]) < 1e-4
    for j, k in itertools.product(range(4), range(2)):
        moved = w.copy()
        moved[j, k] += eps
        assert abs((subword_quality.gradients(v, moved, b, at, share, 1)[0] - loss) / eps - gw[j, k]) < 1e-4
    moved = b + np.array([eps, 0])
    assert abs((subword_quality.gradients(v, w, moved, at, share, 1)[0] - loss) / eps - gb[0]) < 1e-4


def test_subword_quality_learns_and_bears_odd_rows(spark):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        ws = [rnd.choice(vocab) for _ in range(rnd.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            ws = [w + "###" for w in ws] if i % 8 else [w for w in ws[:8] for _ in range(9)]
        rows.append((i, " ".join(ws), "x", 0.5))
        labels.append((i, int(not bad)))
    rows += [(1000, None, "x", 0.5), (1001, "", "x", 0.5), (1002, " \n", "x", 0.5), (None, "abc", None, None),
             (3, rows[3][1], "x", 0.5), (1003, "abc " * 60000, "x", 0.5)]
    labels += [(5, None), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _t string, score double").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    model = subword_quality.train(docs, known)
    again = subword_quality.train(docs.repartition(7), known)
    assert (model.weights == again.weights).all() and model.bias == again.bias
    got = subword_quality.score(docs, model)
    assert got.columns == ["doc_id", "_t", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(tested) > 40 and all(r.predicted == truth[r.doc_id] for r in tested)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    blank = {r.score for r in got if r.doc_id in (1000, 1001, 1002)}
    assert len(blank) == 1 and 0 <= blank.pop() <= 1
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    nothing = subword_quality.train(docs, known.limit(0))
    assert {r.score for r in subword_quality.score(docs, nothing).collect()} == {0.0}
    one = subword_quality.train(docs, known.where("quality = 1"))
    assert all(r.predicted == 1 for r in subword_quality.score(docs, one).collect())
    assert subword_quality.score(docs.limit(0), model).count() == 0


# --- collocations --------------------------------------------------------------------------------

def plain_collocations(rows, least, top):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i:i + k])] += 1
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, ws[i:i + m]) for (lang, ws), b in good.items() for m in range(2, len(ws)) for i in range(len(ws) - m + 1)
            if 100 * b >= 100 * f[lang, ws[i:i + m]]}
    out = collections.defaultdict(list)
    for (lang, ws), a in good.items():
        if (lang, ws) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws)))
            out[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
            for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])}


@pytest.mark.parametrize("head, dense, top", [(collocations.HEAD, collocations.DENSE, 2000), (6, 20, 40)])
def test_collocations_equal_brute_force(spark, head, dense, top):
    rnd = random.Random(8)
    vocab = ["The", "of", "ünd", "x", "New", "york", "CITY", "café", "a\x0bb", "z9"] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        ws = [vocab[min(int(rnd.expovariate(0.25)), len(vocab) - 1)] for _ in range(rnd.randint(0, 60))]
        if i % 3 == 0:
            ws += ["in", "New", "York", "City", "today"] * rnd.randint(1, 2)
        text = "".join(w + rnd.choice([" ", "  ", "\t", ". ", ", ", "\n", "!"] if rnd.random() < 0.3 else [" "]) for w in ws)
        rows.append((text, rnd.choice(["en", "de", None, "und"])))
    rows += [(None, "en"), ("", None), ("go " * 500, "fr"), (rows[0][0], rows[0][1]), (rows[0][0], rows[0][1])]
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS n", "2 AS k1", "3 AS rank").repartition(3)
    got = {tuple(r) for r in collocations.collocations(df, min_count=4, head=head, dense=dense, top=top).collect()}
    assert got == plain_collocations(rows, 4, top) and len(got) > 60
    assert collocations.collocations(df.limit(0)).count() == 0


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    rows = [(10 ** 13, 3 * 10 ** 13, [7 * 10 ** 12 + 1], [10 ** 13 + 3]), (99, 10 ** 14 + 7, [101, 77], [123, 99])]
    df = spark.createDataFrame(rows, "a long, n long, pre array<long>, suf array<long>")
    got = df.select(collocations.weakest_cut().alias("c")).collect()
    for (a, n, pre, suf), r in zip(rows, got, strict=True):
        want = min((1000 * a * n // (l * suf[len(suf) - 1 - i]), i, l, suf[len(suf) - 1 - i]) for i, l in enumerate(pre))
        assert tuple(r.c) == want


def test_tiles_count_as_a_dictionary_does():
    rng = np.random.default_rng(1)
    left, right = rng.integers(0, 3000, 50000), rng.integers(0, 40, 50000)
    left[:5], right[:5] = 1 << 40, 3
    want = collections.Counter(zip(left.tolist(), right.tolist(), strict=True))
    got = {}
    for x, y, n in collocations.tile_counts(left, right, dense=5000, bits=6):
        got.update(zip(zip(x.tolist(), y.tolist(), strict=True), n.tolist(), strict=True))
    assert got == want
