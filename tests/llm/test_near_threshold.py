"""Near copies at thresholds below that of op8."""

import random

from earnlens.llm import minhash_dedup


def shingled(words):
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def test_pairs_between_80_and_85(spark):
    r = random.Random(8)
    texts, want = [], []
    for pair in range(60):
        one = [f"p{pair}w{i}" for i in range(204)]
        other = list(one)
        places = r.sample(range(10, 195, 10), r.choice([2, 3, 4, 5]))
        for i in places:
            other[i] = "changed"
        a, b = shingled(one), shingled(other)
        texts += [" ".join(one), " ".join(other)]
        want.append(100 * len(a & b) >= 80 * len(a | b))
        assert len(places) != 4 or 80 <= 100 * len(a & b) / len(a | b) < 85
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x.doc_id for x in minhash_dedup.drop_near_duplicates(docs, percent=80).collect()}
    assert any(want) and not all(want)
    assert kept == {2 * i for i in range(60)} | {2 * i + 1 for i, near in enumerate(want) if not near}


def test_bands():
    assert minhash_dedup.bands(85) == (24, 5)
    for percent in (50, 70, 80, 85, 90, 95):
        n, rows = minhash_dedup.bands(percent)
        assert n * rows == minhash_dedup.HASHES
        assert rows == 1 or (1 - (percent / 100) ** rows) ** n <= 2e-6
