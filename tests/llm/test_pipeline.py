"""The pipeline's stages on a small corpus, each against what it must keep and drop."""

import sys

import numpy as np

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import corpus_pipeline  # noqa: E402

from .test_llm import library_ids, text_of  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages(spark, tmp_path):
    bad = lambda s: " ".join(w.upper() + "!!" for w in text_of(s, 60).split())
    passage = text_of(7777, 80)
    items = [(i, bad(i) if i % 5 == 0 else text_of(i, 100)) for i in range(300)]
    items += [(400, items[1][1]), (401, items[2][1] + " tail"), (402, text_of(402, 100) + " " + passage), (403, passage + " " + text_of(403, 100)), (404, items[3][1]), (404, items[3][1]), (405, None)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in items]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        d = corpus_pipeline.keep(stage(spark, d, str(tmp_path)))
        seen[name] = d.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first, near, cut, mixed, packed = seen.values()
    good = {i for i, _ in items if i % 5 != 0 or 400 <= i <= 404}
    assert {r.doc_id for r in first} >= good - {400, 405} and np.mean([r.doc_id % 5 == 0 for r in first if r.doc_id < 300]) < 0.02
    kept = [r.doc_id for r in near]
    assert len(kept) == len(set(kept)) and {400, 401, 404}.isdisjoint(kept) and {1, 2, 3, 402, 403} <= set(kept)
    texts = {r.doc_id: r.text for r in cut}
    assert set(texts) == set(kept) and passage in texts[402] and passage not in texts[403] and texts[403].split() == text_of(403, 100).split()
    assert {r.doc_id for r in mixed} >= {i for i in kept if i % 5 != 0 and i < 300}
    after = {r.doc_id: r.text for r in mixed}
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len(library_ids(t)) + 1 for i, t in after.items()}


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
