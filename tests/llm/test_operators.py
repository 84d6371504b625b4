"""The training-text operators against plain Python, on small fixtures with odd cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lignum.llm import (embedding_dedup, language_id, line_dedup, minhash, mixing, packing, quality, suffix_dedup,
                        toxicity, url_filter)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))
    shared = prose(70)
    texts = [None, "", "   ", "\n\n", "one two three", "one two three", "é" * 150 + "x" * 300]
    texts += [prose(rnd.randint(20, 300)) for _ in range(30)]
    texts += [prose(20) + "\n" + shared + "\n" + prose(30) for _ in range(6)]
    texts += [texts[10], texts[10], texts[10] + " tail", shared, "ab " * 400]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 7 else None, None) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(spark, docs, empty):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    where = collections.defaultdict(set)
    rows = [(i, t or "") for i, t, *_ in corpus()] + [(900, " A LINE That repeats \nown"), (901, "a line that repeats")]
    for i, t in rows:
        for x in t.split("\n"):
            where[x.strip(strip).translate(low)].add(i)
    want = {}
    for i, t in rows:
        ls = t.split("\n")
        kept = [x for x in ls if len(k := x.strip(strip).translate(low)) < 10 or len(where[k]) < 2 or min(where[k]) == i]
        want[i] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[-2:], "doc_id long, text string"))
    got = line_dedup.dedup_lines(both.selectExpr("*", "1 AS n_lines"), salts=2).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in got} == want
    assert sum(w[1] for w in want.values()) > 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_quality_base_counts(docs, empty):
    got = {r.doc_id: r for r in quality.judge(docs.selectExpr("*", "7 AS kept")).collect()}
    assert len(got) == docs.count()
    for i, t, *_ in corpus():
        t = t or ""
        w = WORDS.findall(t)
        at = collections.defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k:k + 5])].append(k)
        covered = {x for v in at.values() if len(v) > 1 for k in v for x in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.judge(empty).count() == 0


def test_quality_distance_rejects_symbol_text(spark):
    rnd = random.Random(1)
    plain = [" ".join(rnd.choice(["the", "of", "and", "river", "stone", "cloud", "house"]) for _ in range(120)) for _ in range(30)]
    odd = " ".join(f"{rnd.choice(['the', 'of', 'x'])}$$#%{k}&&&" for k in range(120))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*plain, odd])], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert not kept.pop(30)
    # the word windows of such a small vocabulary repeat now and then; the distances must not reject
    far = quality.judge(df).where("doc_id < 30 AND (class_distance > 0.3 OR word_distance > 0.46)").count()
    assert far == 0
    assert quality.keep_good(df).where("doc_id = 30").count() == 0


def brute_repeats(texts, threshold):
    count = collections.Counter(t[p:p + threshold] for t in texts for p in range(len(t) - threshold + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - threshold + 1):
            if count[t[p:p + threshold]] > 1:
                gone[p:p + threshold] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("group", [4096, 2])
def test_suffix_dedup(monkeypatch, docs, empty, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    texts = [(t or "").encode() for _i, t, *_ in corpus()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 200)))
    assert any(0 < g[1] < g[0] for g in got.values())
    if group > 2:
        assert suffix_dedup.remove_repeats(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = {}
    for i, x, *_ in corpus():
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            want[i, k // 64] = (k, len(ids[k:k + 64]), zlib.crc32(np.array(ids[k:k + 64], "<u4").tobytes()))
    got = packing.pack_documents(docs, path, sequence=64).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    fill = collections.defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    ideal = sum(w[1] for w in want.values()) / 64
    assert len(fill) <= 1.1 * ideal + 2
    assert packing.pack_documents(empty, path).count() == 0


def test_word_cache_equals_tokenizer():
    from tokenizers import Tokenizer
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    t, cache = Tokenizer.from_file(path), packing.WordCache(path)
    odd = ["it's a ²x ½ <|endoftext|> you're 'll ÀÉ ª_b __ a-b 12ab don't!!'s", "İ ΣΑΣ ﬁ 日本", "a\x1cb\xa0c d", "", " \n\t"]
    assert cache.ids(odd) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in odd]


def test_packer_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert [p.place(n)[::2] for n in (6, 7, 8)] == [(0, []), (1, []), (2, [1])]  # bin 1 (free 3) was the fullest of 0 and 1
    assert p.place(2) == (2, 8, [2])
    assert p.place(4) == (0, 6, [0])


def test_mixing(docs, empty):
    got = mixing.taken(docs).collect()
    again = mixing.taken(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    size = {i: len(WORDS.findall(t or "")) for i, t, *_ in corpus()}
    per, took = collections.Counter(), collections.Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        per[r.source] += r["size"]
        took[r.source] += r.taken
    order = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(per.values()), set()
    while True:
        level = (total - sum(2 * per[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * level >= 2 * per[s]}
        if not more:
            break
        full |= more
    for r in got:
        want = 2 * per[r.source] if r.source in full else weight[r.source] * level
        assert abs(r.target - want) < 1e-6 and r.source_size == per[r.source]
        assert abs(took[r.source] - r.target) <= 0.5
    assert mixing.taken(empty).count() == 0


def test_mixed_documents_hold_the_words_taken(docs):
    taken = {r.doc_id: r.taken for r in mixing.taken(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = collections.Counter()
    texts = {i: t or "" for i, t, *_ in corpus()}
    for r in out.collect():
        n = len(WORDS.findall(r.text))
        got[r.doc_id] += n
        # what a pass takes of a text: all of it as it is, or stretches of it with their white space
        assert r.text == texts[r.doc_id] if n == len(WORDS.findall(texts[r.doc_id])) else all(
            x in texts[r.doc_id] for x in r.text.split("\n") if "\n" not in texts[r.doc_id])
    assert got == {k: v for k, v in taken.items() if v}


def test_mix_equals_its_own_streams(spark):
    """Slots, shards and word ranges against plain Python over the same streams and permutations."""
    rnd = random.Random(2)
    rows = [(rnd.choice([None, *range(60)]), " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.choice([0, 1, 7, 90, 700]))),
             rnd.choice(["a", "b", "c", None])) for _ in range(120)]
    rows += [rows[5]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sized = mixing.stored(mixing.sizes(docs), "sizes")
    goal = mixing.stored(mixing.targets(sized), "targets")
    q = mixing.quotas(goal)
    quota = {r.qs: r for r in q.collect()}
    slots = mixing.drawn(q, shards=8).collect()
    streams = collections.defaultdict(list)
    for r in mixing.placed(sized).orderBy("begin").collect():
        assert r.begin == len(streams[r.source])
        streams[r.source] += [(r.row, k) for k in range(r.size)]
    want = collections.Counter()
    for s, r in quota.items():
        mine = [x for x in slots if x.qs == s]
        assert sum(x.take for x in mine) == r.quota and r.words == len(streams[s])
        for k in range(r.passes + 1):
            index = [x["index"] for x in mine if x["pass"] == k]
            assert len(index) == len(set(index)) and (k == r.passes or sorted(index) == list(range(r.n)))
        shard = [x.shard for x in sorted(mine, key=lambda x: (x["pass"], x.j))]
        assert shard == sorted(shard)     # slots are dealt to the shards one after the other
        for x in mine:
            for word in streams[s][x["index"] * 64:x["index"] * 64 + x.take]:
                want[(*word, x["pass"])] += 1
    got = collections.Counter()
    for p in mixing.mix(sized, goal).collect():
        for k in range(p.word_from, p.word_to):
            got[p.row, k, p["pass"]] += 1
    assert got == want and max(want.values()) == 1
    taken = collections.Counter((r.doc_id, r.source, r.size, r.taken) for r in mixing.taken(docs).collect())
    per_row = collections.Counter(row for row, _k, _p in got.elements())
    assert sorted(n for (_i, _s, _z, n), m in taken.items() for _ in range(m) if n) == sorted(per_row.values())
    assert all(n <= 2 * z for _i, _s, z, n in taken)


def test_mix_draws_and_permutes_at_any_size(spark):
    ends = mixing.multinomial.func(*(mixing.pd.Series([x]) for x in (7, 10 ** 6, 256)))[0]
    assert ends[-1] == 10 ** 6 and len(ends) == 256 and 3000 < np.diff(ends).min() and np.diff(ends).max() < 5000
    n, a, b = 10 ** 12 + 39, mixing.PRIMES[-1], 10 ** 12
    j = [0, 1, n // 2, n - 2, n - 1]
    df = spark.createDataFrame([(x, a, b, n) for x in j], "j long, a long, b long, n long")
    got = [r[0] for r in df.select(mixing.permuted(*map(mixing.F.col, "jabn"))).collect()]
    assert got == [(x * a % n + b) % n for x in j]


def test_mixed_documents_bear_clashing_columns_and_shared_ids(spark):
    rows = [(k % 3 if k % 5 else None, f"one two\nthree {k} " * (k + 1), "s", k, "x", 1.0) for k in range(12)] + [(1, None, None, 0, "", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _row long, _words string, pass double")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = collections.Counter()
    for r in out.collect():
        got[r._row] += len(WORDS.findall(r.text))
    quota = sum(got.values())
    total = sum(len(WORDS.findall(t or "")) for _i, t, *_ in rows)
    assert quota == 1.5 * total and all(n <= 2 * len(WORDS.findall(rows[k][1])) for k, n in got.items())


@pytest.mark.parametrize("block", [512, 2])
def test_minhash_classes(spark, empty, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rnd = random.Random(9)
    base = [[f"w{rnd.randrange(3000)}" for _ in range(200)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:4]:
        for k in range(5):
            x = list(b)
            x[20 + k] = "changed"
            texts.append(" ".join(x))
    texts += [texts[0], texts[0], None, "", "two words", "two words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    want = {i: i for i in range(12)}
    want |= {12 + 5 * b + k: b for b in range(4) for k in range(5)}
    n = 12 + 20
    want |= {n: 0, n + 1: 0, n + 2: n + 2, n + 3: n + 3, n + 4: n + 4, n + 5: n + 4}
    assert got == want
    assert minhash.near_duplicates(empty).count() == 0


def test_close_bucket_finds_all_joining_links():
    import pyarrow as pa
    rnd = np.random.default_rng(2)
    sets = [np.unique(rnd.integers(0, 300, 260)) for _ in range(40)]
    w = minhash.Weights({}, 1, 1)
    table = pa.table({"id": list(range(40)), "component": list(range(40)), "block": [0] * 40, "bi": [0] * 40,
                      "bj": [0] * 40, "h": pa.array([s.astype(np.uint64).tobytes() for s in sets], pa.binary())})
    got = minhash.close_bucket(table, w, 0.45)
    up = list(range(40))

    def root(i):
        return i if up[i] == i else root(up[i])
    for a, b in zip(got["u"].to_pylist(), got["v"].to_pylist(), strict=True):
        up[root(a)] = root(b)
    for i in range(40):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.45:
                assert root(i) == root(j)


def test_samples_agree_like_weighted_jaccard():
    rnd = np.random.default_rng(3)
    a = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    wa, wb = rnd.uniform(1, 4, 400), rnd.uniform(1, 4, 400)
    s = minhash.samples(np.concatenate([a, a]), np.concatenate([wa, wb]), np.array([400, 400]), 2000)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.05


def test_embedding_dedup(spark):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(40, 16))
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(base)]
    for k in range(60):
        b = k % 20
        v = base[b] + rnd.normal(size=16) * 0.12 * np.linalg.norm(base[b]) / 4
        rows.append((100 + k, [float(x) for x in v], b % 2))
    rows += [(300 + k, rows[0][1], 0) for k in range(5)] + [(400, [2 * x for x in rows[0][1]], 0)]
    odd = [(500, None, 0), (501, [0.0] * 16, 0), (502, [None] + [1.0] * 15, 0), (503, [float("nan")] * 16, 0),
           (504, rows[0][1], None), (505, [1.0, 2.0], 0), (506, [], 0), (507, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(odd)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    found = sum(got[r[0]].n_links for r in rows)
    assert all(got[r[0]].n_links <= near[i].sum() for i, r in enumerate(rows))
    assert found >= 0.9 * near.sum() and near.sum() > 50
    assert got[300].n_links >= 6 and got[300].component_id == 0
    assert all(got[o[0]].n_links == 0 and got[o[0]].kept for o in odd)


def test_toxicity_swaps_reduce_group_bias(spark):
    rnd = random.Random(6)
    filler = [f"word{k}" for k in range(60)]

    def text(*more):
        w = [rnd.choice(filler) for _ in range(25)] + list(more)
        rnd.shuffle(w)
        return " ".join(w) + "."
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        # toxic texts mostly name one group: a plain classifier learns the name
        t = text(*(["vile"] if bad else []), *(["muslims"] if bad and i % 2 == 0 else []))
        rows.append((i, t))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "muslims word1 word2"), (2, "vile word3"), (3, None), (4, "")],
                                  "doc_id long, text string")
    scores = {}
    for penalty in (0.0, 50.0):
        model = toxicity.train(docs, known, penalty=penalty)
        scores[penalty] = {r.doc_id: r for r in toxicity.score(probe, model).collect()}
    assert scores[50.0][1].score < scores[0.0][1].score and scores[50.0][1].predicted == 0
    assert scores[50.0][2].predicted == 1
    assert scores[50.0][3].score == scores[50.0][4].score < 0.5
    none = toxicity.train(docs, known.where("toxic IS NULL"))
    assert {r.score for r in toxicity.score(probe, none).collect()} == {0.0}


def test_automaton_and_phrases():
    text = [0, 1, 0, 0, 1, 1, 0, 2]
    a = language_id.Automaton(text, 3).next
    subs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    for n in (1, 2, 3, 4):
        for code in range(3 ** n):
            s = tuple(code // 3 ** k % 3 for k in range(n))
            state = 0
            for c in s:
                state = a[state, c] if state >= 0 else -1
            assert (state >= 0) == (s in subs)


def test_language_id(spark, empty):
    rnd = random.Random(8)
    parts = {"aa": ["ka", "lo", "mi", "ret"], "bb": ["sch", "ung", "ein", "tze"]}
    rows = []
    for i in range(200):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join("".join(rnd.choices(parts[lang], k=3)) for _ in range(30)), lang if i % 5 else None))
    rows += [(1000, None, "aa"), (1001, "123 !?", "aa"), (1002, "", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df.select("doc_id", "text"), language_id.train(df)).collect()}
    assert all(got[i].lang_pred == ("aa" if i % 2 else "bb") and 0 <= got[i].score <= 1 for i in range(200))
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    model = language_id.train(empty)
    assert {r.lang_pred for r in language_id.identify(df.select("doc_id", "text"), model).collect()} == {"und"}


def test_url_filter(spark):
    urls = ["https://A.Example.NET/en/1?x", "http://b.net/x", "http://example.com/de/9#t", "http://a.org/fr/1", None,
            "no scheme", "http://net", "http://x.notnet/", "ftp://u.org:80/a/b/c/d/e/f/g/h"]
    rows = list(enumerate(urls)) + [(100 + k, f"http://bad.info/spam/{k}") for k in range(40)]
    rows += [(200 + k, f"http://bad.info/news/{k}") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(100 + k, 1) for k in range(30)] + [(200 + k, 0) for k in range(30)],
                                   "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    assert len(got) == len(rows)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(9)] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("b.net", "/x", "net/", "block"),
        ("example.com", "/de/9", "example.com/de/", "block"), ("a.org", "/fr/1", "org/fr/", "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("net", "", None, "allow"), ("x.notnet", "/", None, "allow"),
        ("u.org:80", "/a/b/c/d/e/f/g/h", None, "allow")]
    # the two branches differ in their labelled share, so they stay apart; unlabelled URLs follow their template
    assert {got[100 + k].verdict for k in range(40)} == {"block"}
    assert {got[200 + k].verdict for k in range(40)} == {"allow"}


def test_pipeline_stages(spark, docs):
    import corpus_pipeline
    assert [n for n, _f in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    now = docs
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, "")
        assert now.columns == docs.columns
        assert {r.doc_id for r in now.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    out = corpus_pipeline.STAGES[-1][1](spark, now, "")
    assert {i for r in out.collect() for i in r.doc_ids} == {r.doc_id for r in now.collect()}


def test_near_dedup_stage_with_null_and_shared_ids(spark):
    import corpus_pipeline
    rnd = random.Random(6)
    a, b, c = (" ".join(f"w{rnd.randrange(5000)}" for _ in range(80)) for _ in range(3))
    rows = [(None, a), (5, a), (3, a), (3, b), (3, b), (None, c), (None, c), (9, ""), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).selectExpr("*", "7 AS _row")
    got = corpus_pipeline.near_dedup_stage(spark, df, "").collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(
        [(3, a), (3, b), (None, c), (9, ""), (None, None)]) and got[0]._row == 7


def test_digest_of_op8_is_sha256(spark):
    from lignum.llm.registry import QUERIES
    import lignum.llm.queries  # noqa: F401
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))[0].startswith("op1_") and len(QUERIES) == 13
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
