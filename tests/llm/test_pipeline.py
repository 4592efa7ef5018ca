import random

import corpus_pipeline
from tesserae.llm import near_dedup, quality, substring_dedup


def test_stages_in_turn(spark, tmp_path):
    r = random.Random(1)
    rows = []
    for i in range(120):
        good = r.random() < 0.8
        rows.append((i, " ".join((f"good{r.randint(0, 900)}" if good else f"#bad{r.randint(0, 20)}") for _ in range(80)), "en", "s0" if good else "s1"))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(200, rows[0][1], "en", "s0"), (201, rows[1][1] + " more", "en", "s0"), (202, None, None, None), (203, "", "en", "s0")]
    rows += [(210 + k, " ".join(f"good{r.randint(0, 900)}" for _ in range(150)) + " " + passage, "en", "s0") for k in range(3)]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int("good" in t), 0) for i, t, *_ in rows[:120]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{n}")
        was, now = now, spark.read.parquet(f"{tmp_path}/{n}")
        sizes[name] = {x["doc_id"]: x for x in now.collect()}
    good = {i for i, t, *_ in rows if t and "good" in t}
    assert set(sizes["quality_classifier"]) >= good and not {202, 203} & set(sizes["quality_classifier"])
    assert 200 not in sizes["exact_dedup"] and 201 in sizes["exact_dedup"]
    assert 201 not in sizes["minhash_near_dedup"]
    texts = {i: x["text"] for i, x in sizes["substring_dedup"].items()}
    assert [passage in texts[210 + k] for k in range(3)] == [True, False, False]
    assert set(sizes["packing"]) == set(texts)
    assert {tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {tuple(x) for x in now.collect()}
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "substring_dedup", "packing"]
    assert quality.KEEP and near_dedup.SIMILAR and substring_dedup.LENGTH == 50
