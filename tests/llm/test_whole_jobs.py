"""Operators do the whole job: no cap on branches, levels, tokens, frequencies or clusters."""

import collections

import numpy as np

from lignum.llm import minhash, packing, suffix_dedup, url_filter


def judged(spark, urls, bad):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame(list(enumerate(bad)), "page_id long, bad int").where("bad IS NOT NULL")
    rows = url_filter.judge(pages, labels).collect()
    assert len(rows) == len(urls)
    return {urls[r.page_id]: r for r in rows}


def test_url_filter_keeps_a_bad_branch_among_any_number(spark):
    for branches in (20, 39, 200):
        urls = [f"http://h.info/spam/{k}" for k in range(60)]
        urls += [f"http://h.info/{chr(97 + b % 26)}{'x' * (b // 26)}/{k}" for b in range(branches) for k in range(4)]
        got = judged(spark, urls, [1 if "/spam/" in u else 0 for u in urls[:50]] + [None] * 10
                     + [0] * (len(urls) - 60))
        assert {u for u, r in got.items() if r.verdict == "block"} == set(urls[:60])


def test_url_filter_tests_branches_with_digits_and_below_any_level(spark):
    deep = "http://h.info/a/b/c/d/e/f/g/"
    urls = [f"{deep}{x}/{k}" for x in ("bad", "good") for k in range(40)]
    urls += [f"http://i.info/{x}/p{k}" for x in (1, 2, 3, 4) for k in range(40)]
    bad = [1] * 30 + [None] * 10 + [0] * 40 + [1] * 30 + [None] * 10 + [0] * 120
    got = judged(spark, urls, bad)
    assert {u for u, r in got.items() if r.verdict == "block"} == set(urls[:40]) | set(urls[80:120])
    assert got[urls[0]].template == "/a/b/c/d/e/f/g/bad/*"


def test_url_filter_template_of_lone_and_starred_paths(spark):
    long = "http://l.info/" + "/".join(f"s{k}" for k in range(300))
    urls = [long, long, "http://m.info/*/x", "http://m.info/y/x", "http://m.info/z/x", "http://n.info/a/", "http://n.info/a"]
    got = judged(spark, urls, [None] * len(urls))
    assert got[long].template == got[long].path
    assert {got[u].template for u in urls[2:5]} == {"/*/x"}
    assert [got[u].template for u in urls[5:]] == ["/a/", "/a"]
    star = judged(spark, [f"http://m.info/{x}/{k}" for x in ("*", "y", "z") for k in range(40)], [1] * 40 + [0] * 80)
    assert {r.template for u, r in star.items() if "/*/" in u} == {"/%2A/*"}


def test_packed_sequences_hold_all_tokens(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = {k: "stone river cloud " * (k * 7 % 40) for k in range(25)} | {25: None, 26: "é日"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    placed = packing.pack_documents(docs, path, sequence=64).cache()
    t = Tokenizer.from_file(path)
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts.items()}
    rows = placed.collect()
    parts = collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == want[r.doc_id][r.start:r.start + r.length]
        parts[r.sequence_id].append((r.offset, r.doc_id, ids))
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    got = {r.sequence_id: (r.doc_ids, np.frombuffer(r.ids, "<u4").tolist()) for r in packing.packed_documents(docs, path, sequence=64).collect()}
    assert got == {k: ([d for _o, d, _i in sorted(v)], [x for _o, _d, ids in sorted(v) for x in ids]) for k, v in parts.items()}
    assert max(len(ids) for _d, ids in got.values()) <= 64
    # several packers, several to a task, and bins that close because too many are open
    pieces = packing.tokenize(docs, path, sequence=64).cache()
    split = packing.pack_sequences(pieces, 64, 2, 40).collect()
    assert len({r.sequence_id for r in split}) == len(split) and len({r.sequence_id >> 40 for r in split}) > 8
    back = collections.defaultdict(list)
    for r in split:
        at = 0
        for d, k, n in zip(r.doc_ids, r.pieces, r.lengths, strict=True):
            back[d].append((k, np.frombuffer(r.ids, "<u4").tolist()[at:at + n]))
            at += n
        assert 4 * at == len(r.ids)
    assert {d: [x for _k, ids in sorted(v) for x in ids] for d, v in back.items()} == want


def test_op3_query_has_digests_and_the_pipeline_sequences(spark, tmp_path):
    import corpus_pipeline
    from lignum.llm import queries
    words = "the of and to a in is that river stone cloud house water light night green small round".split()
    docs = [(k, " ".join(words[(k * 31 + j * j * (k + 3) + j) % len(words)] + str(j % 9 if j % 4 == 0 else "") for j in range(90)), "en", "s", None)
            for k in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["op3_packing"](spark, str(tmp_path)).columns == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(len(r.ids) % 4 == 0 and np.frombuffer(r.ids, "<u4")[-1] == 1 for r in out)


def test_ids_travel_narrow_and_come_out_wide():
    for x in ([1, 2, 65535], [1, 65536], []):
        ids = np.array(x, "<u4").tobytes()
        assert packing.widened(packing.narrowed(ids), len(x)) == ids
    assert len(packing.narrowed(np.array([1, 65535], "<u4").tobytes())) == 4


def test_minhash_classes_do_not_depend_on_the_table_in_memory(spark, monkeypatch):
    # 17 shingles of boilerplate in 30 documents, and pairs that differ in a few unique words
    texts = [" ".join(f"b{j}" for j in range(20)) + " " + " ".join(f"x{k}n{j}" for j in range(20)) for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    source = minhash._texts(df, "doc_id", "text")

    def weights(common):
        w = spark.sparkContext.broadcast(minhash.exact_weights(source, common=common))
        ids = spark.sparkContext.broadcast(minhash.bitmap(source.select("id")))
        rows = minhash.with_frequencies(minhash.vectors(source, ids), source, w).collect()
        return len(w.value.keys), {r.id: round(r.total, 9) for r in rows}
    (many, want), (few, got) = weights(1 << 16), weights(1)
    assert many > few and got == want
    assert set(got.values()) == {round(16 * 1.0 + 20 * 2.0, 9)}


def test_repeats_in_rows_without_an_id(spark):
    rnd = __import__("random").Random(1)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    x, y = text(400), text(250)
    rows = [(None, text(50) + x), (9, x + text(60)), (1, y + text(10)), (None, text(30) + y), (None, text(500)), (None, None)]
    for threshold in (200, 400):
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), threshold=threshold)
        parts = collections.Counter((r.doc_id, r.n_bytes, r.n_removed) for r in got.collect())
        z = 250 if threshold == 200 else 0
        assert parts == {(None, 450, 400): 1, (9, 460, 400): 1, (1, 260, z): 1, (None, 280, z): 1, (None, 500, 0): 1, (None, 0, 0): 1}
