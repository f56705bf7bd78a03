"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline
import numpy as np
from earnlens.llm import queries, toxicity
from test_dedup import brute_exact, brute_near, brute_runs

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "substring dedup", "packing"]
    seen = [docs]
    for name, function in corpus_pipeline.STAGES:
        out = str(tmp_path / name.replace(" ", "-"))
        function(spark, seen[-1], SF).write.parquet(out)
        seen.append(spark.read.parquet(out))
        if name != "packing":
            assert seen[-1].columns == columns, name
    rows = [sorted(d.collect(), key=lambda r: r[0]) for d in seen]
    ids = [[r.doc_id for r in part] for part in rows[:5]]

    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~queries.held_out())
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert ids[1] == [i for i in ids[0] if scores[i] < queries.TOXIC]
    assert ids[2] == [x[0] for x in brute_exact(ids[1], [r.text for r in rows[1]]) if x[3]]
    assert ids[3] == [ids[2][x[0]] for x in brute_near([r.text for r in rows[2]]) if x[3]]
    cut = brute_runs([r.text for r in rows[3]])
    assert ids[4] == ids[3]
    for before, after, (_, _, gone, kept) in zip(rows[3], rows[4], cut):
        assert after.text == (kept if gone else before.text) and after.n_chars == len(after.text)
    packed = seen[5].toPandas()
    assert set(packed.doc_id) == set(ids[4])
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    least = int(np.ceil(packed.length.sum() / 2048))
    assert packed.sequence_id.nunique() <= least + max(1, least // 50)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0
