"""Training windows cover whole texts; the marking features have no quiet limit."""

import random

import pytest

from earnlens.llm import toxicity


def test_windows_hold_every_hit():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 3000)
        hits = sorted(rng.sample(range(n), rng.randrange(1, min(n, 40) + 1)))
        starts = toxicity.window_starts(n, hits, 192)
        assert all(any(s <= h < s + toxicity.SPAN for s in starts) for h in hits)
        assert all(b - a >= toxicity.SPAN for a, b in zip(starts, starts[1:])) and all(0 <= s < n for s in starts)


def test_clean_windows_grow_with_the_text():
    count = lambda n: len(toxicity.window_starts(n, None, 192))
    assert toxicity.window_starts(0, None, 192) == [] and toxicity.window_starts(5, None, 192) == [0]
    assert count(192 * 1000) == 1000 and count(192 * 100) == 100
    starts = toxicity.window_starts(19_200, None, 192)
    assert starts[0] < 192 and starts[-1] > 19_000  # from the beginning to the end


def texts(spark, late):
    """Toxic words stand at the very end of long texts only."""
    rng = random.Random(4)
    words = ["river", "stone", "garden", "window", "letter", "market", "summer", "paper"]
    rows, labels = [], []
    for i in range(120):
        toxic = i % 2
        body = [rng.choice(words) + str(rng.randrange(50)) for _ in range(late)]
        if toxic:
            body += [rng.choice(["grobnik", "zlurpish", "vexmold"]) for _ in range(3)]
        rows.append((i, " ".join(body)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_marks_at_the_end_of_long_texts_are_learnt(spark):
    docs, labels = texts(spark, 2000)
    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(s for i, s in scores.items() if i % 2) > 0.7 and max(s for i, s in scores.items() if not i % 2) < 0.3


def test_too_many_marks_are_an_error(spark, monkeypatch):
    docs, labels = texts(spark, 40)
    monkeypatch.setattr(toxicity, "MOST_MARKS", 2)
    with pytest.raises(ValueError, match="features mark"):
        toxicity.fit(docs, labels)
