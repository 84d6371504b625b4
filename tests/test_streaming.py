"""Streaming cleaning processes new files once."""

import json

from lignum.streaming.cleaning import cleaned_stream, run_once


def test_stream_cleaning(spark, tmp_path):
    src, sink, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    rows = [{"url": "a", "lang": "java", "original_string": "int x; // c"},
            {"url": "b", "lang": "php", "original_string": "echo 1; # hash"}]
    (src / "p1.json").write_text("\n".join(json.dumps(r) for r in rows))
    run_once(cleaned_stream(spark, str(src)), str(sink), str(ck))
    out = {r.url: r.code for r in spark.read.parquet(str(sink)).collect()}
    assert out["a"] == "public class Main {\nint x; \n}"
    assert out["b"] == "<?php\necho 1;?>"
    (src / "p2.json").write_text(json.dumps({"url": "c", "lang": "go", "original_string": "x /* y */"}))
    run_once(cleaned_stream(spark, str(src)), str(sink), str(ck))
    assert spark.read.parquet(str(sink)).count() == 3
