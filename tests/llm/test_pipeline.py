"""The pipeline's stages on a small corpus, each judged on its own input."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.test_llm import prose


def test_stages(spark, tmp_path):
    texts = {i: prose(80, i) + "\n" + prose(30, 1000 + i) for i in range(40)}
    texts[40] = texts[3]
    texts[41] = "you are an idiot and a moron. stupid trash. " + prose(40, 77)
    texts[42] = prose(60, 55) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    texts[43], texts[44] = None, ""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 41)) for i in range(42)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        at[name] = docs
    rows = {name: {r.doc_id: r.text for r in at[name].collect()} for name in list(at)[:-1]}
    assert set(texts) - set(rows["toxicity"]) == {41}
    assert rows["line dedup"][40] == "" and rows["line dedup"][3] == texts[3] and rows["line dedup"][43] is None
    assert len(rows["near duplicates"]) == len(rows["line dedup"])
    assert "[secret]" in rows["secrets"][42] and "24be" not in rows["secrets"][42]
    assert {r.doc_id for r in at["packing"].collect()} == set(rows["secrets"])
    assert all(at[name].columns == ["doc_id", "text", "lang", "source", "n_chars"] for name in list(at)[:-1])
