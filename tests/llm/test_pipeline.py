"""The pipeline against brute force, stage by stage."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioutrnsl") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows = []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randint(8, 40))]
        if i % 6 == 0:
            w.insert(3, rng.choice(["scumbagz", "idiotxx"]))
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 1))
    near = rows[1][1].split()
    rows += [(1000, rows[1][1].upper(), "en", "s0", 1), (1001, " ".join([*near, "more"]), "en", "s0", 1), (1002, None, None, None, None), (1003, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "encoding":
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    clean = {i for i, *_ in rows if i >= 600 or i % 6}
    assert set(kept["toxicity"]) == clean
    assert set(kept["exact_dedup"]) == clean - {1, 1002}
    assert set(kept["near_dedup"]) == clean - {1, 1002, 1001}
    assert set(kept["mixing"]) <= set(kept["near_dedup"]) and max(map(kept["mixing"].count, kept["mixing"])) <= 2
    assert sorted(kept["encoding"]) == sorted(kept["mixing"])
    assert docs.where(F.size("ids") != F.col("n_tokens")).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["encoding"])
