"""Every stage with null ids and texts, repeated rows, empty tables and a hot group of copies."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(80))
OTHER = " ".join(f"x{i}" for i in range(100))
TEXTS = [(1, "a b c"), (2, "a  b\nc"), (3, None), (4, ""), (None, "only here"), (5, "a b c"), (5, "a b c"), (6, LONG), (7, LONG + " tail"),
         (8, OTHER + " " + LONG[:LONG.index(" w50")]), (None, None)] + [(100 + i, "copy of one text") for i in range(40)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], KIND)


def rows_of(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect()))


def test_stages_one_after_another(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, TEXTS)
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns and rows_of(clean) == rows_of(docs)  # nothing there is toxic
    exact = stages["exact dedup"](spark, clean, SF)
    assert exact.columns == docs.columns
    kept = rows_of(exact)
    assert [x for x in kept if x[2].split() == ["a", "b", "c"]] == [(False, 1, "a b c")]
    assert [x for x in kept if x[2] == "copy of one text"] == [(False, 100, "copy of one text")]
    assert [x for x in kept if not x[2]] == [(False, 3, "")] and len(kept) == 7
    near = stages["near dedup"](spark, exact, SF)
    assert near.columns == docs.columns and rows_of(near) == [x for x in kept if x[1] != 7]  # the copy with a tail
    cut = stages["substring dedup"](spark, near, SF)
    texts = {x[1]: x[2] for x in rows_of(cut) if not x[0]}
    assert cut.columns == docs.columns and texts[6] == LONG[LONG.index("w50"):] and texts[8] == OTHER and texts[1] == "a b c"
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text)
    packed = stages["packing"](spark, cut, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in packed) == sorted((x[0], x[1]) for x in rows_of(cut))
    assert all(r.length > 0 and r.offset >= 0 for r in packed)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, table(spark, []), SF).collect() == []
