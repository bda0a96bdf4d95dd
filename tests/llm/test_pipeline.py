"""The pipeline's stages on a small corpus with known cases."""

import random

from test_operators import placed

import corpus_pipeline
from granary.llm import packing


def test_stages(spark, tmp_path):
    r = random.Random(9)
    vocabulary = [f"{a}{b}" for a in "th an er in on re ti es ha ou".split() for b in "e ing nd st ly".split()]
    text = lambda n: " ".join(r.choices(vocabulary, k=n)).capitalize() + "."
    item = text(30)
    rows = [(i, text(120), "en", "s", 0) for i in range(40)]
    rows += [(100, rows[3][1], "en", "s", 0), (101, "12345 ### 678", None, "s", 0), (102, None, "en", "s", 0), (103, text(20) + " " + item + " " + text(9), "en", "s", 0), (104, text(30) + ' token = "abcdef0123456789abcdef" ' + text(30), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({x["doc_id"] for x in docs.collect()})
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everything = {x[0] for x in rows}
    assert [sorted(a - b) for a, b in zip([everything, *kept], kept, strict=False)] == [[101, 102], [100], [103], [], []]
    masked = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{tmp_path}/secret_scans").collect()}
    assert "[SECRET]" in masked[104] and "abcdef0123" not in masked[104] and masked[5] == rows[5][1]
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in run} == kept[-1]
    placed(run, packing.CAPACITY)
