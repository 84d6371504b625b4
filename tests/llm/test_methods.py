"""The methods themselves against plain Python: distances, links, templates, phrases, weights, and rows of every kind."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest

from lignum.llm import (embedding_dedup, language_id, line_dedup, minhash, mixing, packing, quality, suffix_dedup,
                        toxicity, url_filter)

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(rnd, n):
    return ["".join(rnd.choice("abcdefghijklmnopqrstuvw") for _ in range(rnd.randint(2, 8))) for _ in range(n)]


# --- quality rules --------------------------------------------------------------------------------------------

def plain_verdicts(rows):
    """``{(id, text, lang): (class distance, word distance, kept)}`` of ``(id, text, lang)`` rows."""
    def classes(t):
        out = []
        for _name, pattern in quality.CLASSES:
            left = re.sub(pattern, "", t)
            out.append(len(t) - len(left))
            t = left
        return [*out, len(t)]

    def term(p, q):
        m = (p + q) / 2
        return sum(x * math.log2(x / m) for x in (p, q) if x > 0) / 2
    chars, counts = collections.defaultdict(lambda: np.zeros(len(quality.CLASSES) + 1)), collections.defaultdict(collections.Counter)
    for _i, t, lang in rows:
        chars[lang] += classes(t or "")
        counts[lang].update(WORDS.findall((t or "").lower()))
    out = {}
    for i, t, lang in rows:
        t = t or ""
        ref, total = chars[lang] / max(1, chars[lang].sum()), sum(counts[lang].values())
        common = {w: n / total for w, n in counts[lang].items() if n * quality.SHARE >= total}
        w, c = WORDS.findall(t.lower()), classes(t)
        mine = collections.Counter(x for x in w if x in common)
        cls = math.sqrt(max(0, sum(term(n / max(1, sum(c)), q) for n, q in zip(c, ref, strict=True))))
        parts = [term(mine[x] / max(1, len(w)), q) for x, q in common.items()]
        rest = (max(0, 1 - sum(mine.values()) / max(1, len(w))), max(0, 1 - sum(common.values())))
        far = math.sqrt(max(0, sum(parts) + term(*rest)))
        cls = cls if total >= quality.MIN_REF and sum(c) >= quality.MIN_CHARS else None
        far = far if total >= quality.MIN_REF and len(w) >= quality.MIN_WORDS else None
        at = collections.defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(WORDS.findall(t)[k:k + 5])].append(k)
        again = len({x for v in at.values() if len(v) > 1 for k in v for x in range(k, k + 5)})
        base = len(w) < 10 or 100 * again > 20 * len(w)
        out[i, t, lang] = (cls, far, not base and (cls or 0) <= quality.MAX_CLASS_DISTANCE
                           and (far or 0) <= quality.MAX_WORD_DISTANCE)
    return out


def quality_rows():
    rnd = random.Random(3)
    words = {"en": vocabulary(rnd, 300), None: vocabulary(rnd, 40), "zz": vocabulary(rnd, 50)}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(5, 200))), lang)
            for i, lang in enumerate(["en"] * 40 + [None] * 40 + ["zz"] * 5)]
    rows += [(100, " ".join(f"$#%{k}&&" for k in range(90)), "en"), (101, " ".join(words[None][:30] * 3), "en"),
             (102, None, "en"), (103, "", None), (104, " ".join(rnd.sample(words["en"], 80)).upper(), "en"),
             (105, " ".join("éü" * 3 + str(k) for k in range(80)), None), (None, rows[0][1], "en"), rows[1], rows[1]]
    return rows


def test_quality_verdicts_equal_plain_distances(spark):
    rows = quality_rows()
    want = plain_verdicts(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.judge(df.selectExpr("doc_id", "text", "text AS shown", "lang")).collect()
    assert len(got) == len(rows)
    for r in got:
        cls, far, kept = want[r.doc_id, r.shown or "", r.lang]
        assert r.kept == kept
        assert r.class_distance == (cls if cls is None else pytest.approx(cls, abs=1e-7))
        assert r.word_distance == (far if far is None else pytest.approx(far, abs=1e-7))
    assert {r.kept for r in got if r.word_distance is not None} == {True, False}
    left = collections.Counter((r.doc_id, r.text, r.lang) for r in quality.keep_good(df).collect())
    assert left == collections.Counter(r for r in rows if want[r[0], r[1] or "", r[2]][2])


# --- near duplicates ------------------------------------------------------------------------------------------

def plain_classes(texts, threshold=0.8):
    """``({id: class}, links)`` by weighted Jaccard similarity of all pairs; ``{id: text}`` goes in."""
    bags = {}
    for i, t in texts.items():
        w = WORDS.findall(t or "")
        if w:
            bags[i] = collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))
    n, df = len(bags), collections.Counter(s for b in bags.values() for s in b)
    idf = {s: 1 + math.log(n / d) / max(math.log(n), 1e-9) for s, d in df.items()}
    up, links = {i: i for i in texts}, 0

    def root(i):
        return i if up[i] == i else root(up[i])
    for a, b in itertools.combinations(sorted(bags), 2):
        both = sum(min(bags[a][s], bags[b][s]) * idf[s] for s in bags[a].keys() & bags[b].keys())
        either = sum(max(bags[a][s], bags[b][s]) * idf[s] for s in bags[a].keys() | bags[b].keys())
        if both / either >= threshold:
            links += 1
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: root(i) for i in texts}, links


def near_copies():
    rnd = random.Random(12)
    vocab = vocabulary(rnd, 800)
    shared = [rnd.choice(vocab) for _ in range(40)]
    texts = {}
    for g in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(60, 160))] + shared * (g % 3 == 0)
        for c in range(5):
            t = list(base)
            for _ in range(c):  # a changed word takes five shingles with it
                t[rnd.randrange(len(t))] = "changed" + str(rnd.randrange(10 ** 6))
            texts[g * 10 + c] = " ".join(t)
    return texts | {300: None, 301: "", 302: "a b c", 303: "a  b\tc", 304: "a b d", 305: texts[0]}


def test_minhash_classes_equal_all_pairs(spark):
    texts = near_copies()
    want, links = plain_classes(texts)
    assert links > 50 and len(set(want.values())) > 30
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    # recall over all links is 1 on this table; no class holds texts without a path of links
    assert got == want


# --- URL templates --------------------------------------------------------------------------------------------

def plain_templates(urls):
    """``[template]`` of ``[(host, path, bad or None)]`` by a recursive walk of each host's tree."""
    out = [""] * len(urls)
    segs = [re.sub("^/", "", p).split("/") for _h, p, _b in urls]

    def walk(node, members, depth):
        child = collections.defaultdict(list)
        for m in members:
            child[segs[m][depth]].append(m)
        if len({tuple(segs[m][depth:]) for m in members}) == 1:
            for m in members:
                out[m] = "/".join([node, *[re.sub(r"^\*", "%2A", s) for s in segs[m][depth:]]])
            return
        known = {c: [urls[m][2] for m in ms if urls[m][2] is not None] for c, ms in child.items()}
        named = [c for c in child if c != ""]
        pn, pb = sum(len(known[c]) for c in named), sum(sum(known[c]) for c in named)
        rate, below = pb / max(1, pn), collections.defaultdict(list)
        for c, ms in child.items():
            n, bad = len(known[c]), sum(known[c])
            differs = n > 0 and abs(bad - n * rate) - 0.5 > url_filter.Z * math.sqrt(n * max(rate * (1 - rate), 0.01))
            if c == "" or len(named) == 1 or differs:
                step = re.sub(r"^\*", "%2A", c)
            else:
                end = re.search(r"(\.[A-Za-z]{1,5})$", c)
                step = "*" + (end[1] if end else "")
            below[f"{node}/{step}"] += ms
        for t, ms in below.items():
            for m in ms:
                if len(segs[m]) <= depth + 1:
                    out[m] = t
            if deeper := [m for m in ms if len(segs[m]) > depth + 1]:
                walk(t, deeper, depth + 1)
    hosts = collections.defaultdict(list)
    for m, (h, _p, _b) in enumerate(urls):
        hosts[h].append(m)
    for ms in hosts.values():
        walk("", ms, 0)
    return out


def test_url_templates_and_purity_equal_a_recursive_walk(spark):
    rnd = random.Random(21)
    urls = []
    for _ in range(900):
        host = rnd.choice(["a.info", "b.info"])
        top = rnd.choice(["spam", "news", "shop", "x1", ""])
        path = "/" + "/".join([top, *[rnd.choice(["p", "q", "*", f"n{rnd.randrange(40)}", f"{rnd.randrange(90)}.html"])
                                      for _ in range(rnd.randrange(3))]])
        bad = None if rnd.random() < 0.3 else int(rnd.random() < {"spam": 0.97, "shop": 0.4}.get(top, 0.05))
        urls.append((host, path, bad))
    urls += [("lone.info", "/a/b/c", 1)] * 5
    want = plain_templates(urls)
    base = [b for _h, _p, b in urls if b is not None]
    base = sum(base) / len(base)
    known = collections.defaultdict(list)
    for (h, _p, b), t in zip(urls, want, strict=True):
        known[h, t] += [b] if b is not None else []
    pages = spark.createDataFrame([(k, f"http://{h}{p}") for k, (h, p, _b) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(k, b) for k, (_h, _p, b) in enumerate(urls) if b is not None], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    assert len(got) == len(urls)
    for k, (h, _p, _b) in enumerate(urls):
        assert got[k].template == want[k]
        labelled = known[h, want[k]]
        purity = (sum(labelled) + url_filter.PRIOR * base) / (len(labelled) + url_filter.PRIOR)
        assert got[k].purity == pytest.approx(purity)
        assert got[k].verdict == ("block" if purity >= url_filter.REJECT else "allow")
    assert {r.verdict for r in got.values()} == {"allow", "block"}


# --- language -------------------------------------------------------------------------------------------------

def test_phrases_equal_a_plain_parse(monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", 16)
    rnd = random.Random(9)
    samples = {x: ["".join(rnd.choice(a) for _ in range(60)) for _ in range(3)] for x, a in (("aa", "abc "), ("bb", "bcde "))}
    model = language_id.Model({k: [language_id.folded(t) for t in v] for k, v in samples.items()}, 1000)
    known = [" ".join(t for t in ("".join(map(chr, language_id.folded(s))) for s in samples[x])) + " " for x in model.langs]
    texts = ["".join(rnd.choice("abcdez ") for _ in range(rnd.randint(1, 90))) + "a" for _ in range(60)]
    folded = [language_id.folded(t) for t in texts]
    got = model.phrases(folded)
    for row, points in zip(got, folded, strict=True):
        for made, sample in zip(row, known, strict=True):
            n = 0
            for at in range(0, len(points), 16):
                piece, have = "".join(map(chr, points[at:at + 16])), ""
                n += 1
                for c in piece:
                    if have + c in sample:
                        have += c
                    else:
                        # a new phrase begins here; a character that the sample lacks is a phrase of its own
                        n += (have != "") + (c not in sample)
                        have = c if c in sample else ""
            assert made == n


def test_language_sample_is_taken_from_whole_texts(spark):
    filler, late = "xyz " * 400, "ka lo mi ret " * 400
    rows = [(i, filler + (late if lang == "aa" else "sch ung ein tze " * 400), lang)
            for i, lang in enumerate(["aa", "bb"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "mi lo ka ret mi"), (2, "tze ein sch ung")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(asked, language_id.train(df)).collect()}
    # the first 1600 characters of all texts are alike
    assert got == {1: "aa", 2: "bb"}


# --- toxicity -------------------------------------------------------------------------------------------------

def test_toxicity_weights_are_a_minimum_of_the_penalised_loss():
    rnd = np.random.default_rng(2)
    x, y = (rnd.random((80, 6)) < 0.4).astype(float), (rnd.random(80) < 0.4).astype(float)
    pairs = rnd.integers(-1, 2, (30, 6)).astype(float)
    rows, cols = np.nonzero(x)
    pr, pc = np.nonzero(pairs)
    penalty = 0.3
    w, b = toxicity.fit_weights(rows, cols, y, pr, pc, pairs[pr, pc], len(pairs), 6, penalty, steps=4000)

    def loss(w, b):
        z = x @ w + b
        return (np.logaddexp(0, z) - y * z).mean() + toxicity.L2 / 2 * (w ** 2).sum() + penalty * ((pairs @ w) ** 2).mean()
    assert (w >= 0).all() and (w > 0).any()
    for k in range(6):
        d = np.eye(6)[k] * 1e-5
        slope = (loss(w + d, b) - loss(w - d, b)) / 2e-5
        assert abs(slope) < 1e-3 if w[k] > 0 else slope > -1e-3
    assert abs(loss(w, b + 1e-5) - loss(w, b - 1e-5)) / 2e-5 < 1e-3


def test_toxicity_names_of_groups_are_a_parameter(spark):
    rnd = random.Random(6)
    filler = [f"word{k}" for k in range(60)]
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        more = (["vile"] if bad else []) + (["norlanders"] if bad and i % 2 == 0 else []) + (["sudlanders"] if i % 9 == 1 else [])
        rows.append((i, " ".join([rnd.choice(filler) for _ in range(25)] + more), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    asked = spark.createDataFrame([(1, "norlanders word1 word2"), (2, "vile norlanders")], "doc_id long, text string")
    seen = {}
    for groups in ((), (("norlanders", "sudlanders"),)):
        model = toxicity.train(df.drop("toxic"), df.drop("text"), penalty=50.0, groups=groups)
        assert (model.n_pairs > 0) == bool(groups)
        seen[bool(groups)] = {r.doc_id: r for r in toxicity.score(asked, model).collect()}
    # swapping the names leaves the neutral mention alone and still catches the toxic text
    assert seen[True][1].score < seen[False][1].score and seen[True][1].predicted == 0 and seen[True][2].predicted == 1


# --- rows of every kind ---------------------------------------------------------------------------------------

CLASHES = ("_t", "_id", "_fp", "_w", "_row", "_own", "_text", "_lang", "_lines", "_keep", "_from", "_kid", "_kfp", "_kl", "_d",
           "_words", "_cut", "_passes", "_m", "_q", "_h", "id", "doc", "pos", "h1", "first", "class_id", "label", "held")


def odd_rows():
    rnd = random.Random(31)
    a, b = (" ".join(rnd.choice(vocabulary(rnd, 60)) for _ in range(90)) for _ in range(2))
    return [(1, a, "en", "s", 1), (2, a + "\nmore of it here\n" + b, "en", "s", 1), (None, a, "en", "s", 1),
            (None, a, "en", "s", 1), (3, b, None, None, None), (3, b, None, None, None), (3, a, "en", "s", 1),
            (4, "", "en", "t", 0), (5, None, "en", "t", 0), (6, " \n\t", "en", "t", 3), (7, b * 40, "zz", "t", 9)]


def per_row(spark, df):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    labels = df.selectExpr("doc_id", "IF(doc_id % 2 = 0, 1, 0) AS toxic")
    return {
        "op1": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "op3": lambda d: packing.pack_documents(d, path).where("piece = 0"),
        "op4": lambda d: suffix_dedup.remove_repeats(d),
        "op6": lambda d: mixing.taken(d),
        "op7": lambda d: language_id.identify(d, language_id.train(d)),
        "op8": lambda d: line_dedup.dedup_lines(d),
        "op9": lambda d: quality.judge(d),
        "op10": lambda d: minhash.near_duplicates(d),
    }


@pytest.mark.parametrize("op", ["op1", "op3", "op4", "op6", "op7", "op8", "op9", "op10"])
def test_odd_rows_and_clashing_columns(spark, op):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.selectExpr("*", *[f"{k} AS `{c}`" for k, c in enumerate(CLASHES)])
    run = per_row(spark, df)[op]
    plain, got = run(df), run(wide)
    names = [c for c in plain.columns if c not in ("sequence_id", "offset")]
    assert sorted(map(repr, plain.select(names).collect())) == sorted(map(repr, got.select(names).collect()))
    assert collections.Counter(r.doc_id for r in got.collect()) == collections.Counter(r[0] for r in rows)
    if op in ("op1", "op7", "op8", "op9"):
        assert all(r[c] == k for r in got.collect() for k, c in enumerate(CLASHES))
    assert run(df.where("false")).count() == 0


def test_stages_bear_odd_rows_and_clashing_columns(spark):
    import corpus_pipeline
    rows = odd_rows() + [(20 + i, t, lang, "s", 1) for i, t, lang in quality_rows() if i is not None]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"{k} AS `{c}`" for k, c in enumerate(CLASHES)])
    verdicts = plain_verdicts([r[:3] for r in rows])
    now = corpus_pipeline.quality_rules(spark, df, "")
    good = [r for r in rows if verdicts[r[0], r[1] or "", r[2]][2]]
    assert collections.Counter((r.doc_id, r.text) for r in now.collect()) == collections.Counter(r[:2] for r in good)
    for _name, stage in corpus_pipeline.STAGES[1:-1]:
        now = stage(spark, now, "")
        assert now.columns == df.columns and all(r._t == 0 and r.held == len(CLASHES) - 1 for r in now.collect())
    for _name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("false"), "").count() == 0


def test_embeddings_without_or_with_shared_ids(spark):
    rnd = np.random.default_rng(7)
    a, b, c = ([float(x) for x in v] for v in rnd.normal(size=(3, 8)))
    near = [x + 0.001 for x in a]
    rows = [(None, a, 1), (None, near, 1), (9, a, 1), (4, near, 1), (7, b, 1), (7, c, 1), (None, b, 2), (None, b, 2),
            (2, a, None), (None, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS cell")
    got = embedding_dedup.near_duplicates(df).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == collections.Counter([
        (None, 3, 4, False), (None, 3, 4, False), (9, 3, 4, False), (4, 3, 4, True), (7, 0, 7, True), (7, 0, 7, True),
        (None, 1, None, True), (None, 1, None, True), (2, 0, 2, True), (None, 0, None, True)])
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_blocks_of_a_hot_cell_are_dealt_over_tasks(spark, monkeypatch, capsys):
    """One label, one cell: every two blocks are a group of their own, and links stay whole."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=8)
    x = base + rnd.normal(size=(90, 8)) * 0.08
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)],
                               "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98).sum(1) - 1
    assert near.sum() > 500 and [got[i] for i in range(90)] == near.tolist()


def test_shingles_are_ordered_by_one_sort():
    """op10: rows keep their places, their shingles are in order, also where the first bits of two are alike."""
    from lignum.llm import minhash as M
    rng = np.random.default_rng(4)
    count = rng.integers(0, 30, 200)
    row = np.repeat(np.arange(200), count)
    for alike in (False, True):
        h = rng.integers(0, 1 << 63, count.sum(), dtype=np.uint64)
        if alike:
            h[::3], h[1::4] = h[0], h[0] ^ np.uint64(1)
        order = M._in_rows(h, row, 200)
        assert (h[order] == h[np.lexsort((h, row))]).all() and (row[order] == row).all()


def test_bucket_counts_travel_in_runs(spark):
    from lignum.llm import minhash as M
    docs = spark.createDataFrame([(i, "one two three four five six" if i % 2 else f"w{i} b c d e") for i in range(40)], "id long, text string")
    found, least, n = M.common_shingles(docs, common=4)
    assert n == 40 and least == 15 and sorted(found.values()) == [20, 20]
