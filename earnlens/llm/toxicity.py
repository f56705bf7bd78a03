"""Toxic spans and document scores by a linear-chain conditional random field.

Labels are per document. A feature (a word, or a word's beginning) that far
more toxic than clean families of texts hold marks the tokens of toxic texts
as toxic; a chain of two states is then fitted to windows of labelled tokens.
Over a whole text, forward-backward yields each token's marginal probability;
tokens above one half are offending spans, and a logistic curve over two
aggregates of the marginals is the document's score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from earnlens.llm.common import fits, id_hash, release, releasing, stage, text_or_empty
from earnlens.llm.words import shingles

#: Bound of the sample of labelled rows of each class that the model is fitted to.
SAMPLE = 4000
#: Hash buckets of the emission weights.
BUCKETS = 1 << 17
#: Tokens of a training window. A clean text gives one for every ``SPACING``
#: tokens, the whole text long; where all clean texts would give more than
#: about ``CLEAN_WINDOWS``, every text gives proportionally fewer. A toxic text
#: gives windows that hold all of its marked tokens.
SPAN, SPACING, CLEAN_WINDOWS = 48, 192, 16_000
#: Windows whose gradient is taken at once.
BLOCK = 2000
#: Marking features that a model may hold; more are an error.
MOST_MARKS = 200_000
#: A marking feature is held by so many families of toxic texts, and is so
#: many times (as a logarithm) likelier in them than in clean ones.
LEAST_FAMILIES, LEAST_ODDS = 3, 3.0
#: Words whose emission a worker remembers at once, and characters of the
#: texts that it goes through at once (a longer text is alone).
REMEMBERED, AT_ONCE = 150_000, 4_000_000
#: Features that a partial count holds before it is passed on.
COUNTED = 100_000
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
TOKEN = re.compile(r"\S+")


#: Lengths of the word beginnings and endings that are features.
BEGINNINGS, ENDINGS = (2, 3, 4, 5, 6, 7, 8), (3, 4)


def features(token: str) -> list[str]:
    w = EDGES.sub("", token)
    out = ["w " + w]
    out += [f"p {w[:n]}" for n in BEGINNINGS if len(w) >= n]
    out += [f"s {w[-n:]}" for n in ENDINGS if len(w) > n]
    return out


def marking(token: str) -> list[str]:
    """The features that may mark a token: the word, and its beginnings of
    three letters or more."""
    w = EDGES.sub("", token)
    return ["w " + w, *(f"p {w[:n]}" for n in BEGINNINGS[1:] if len(w) >= n)]


def bucket(feature: str) -> int:
    return xxh3_64_intdigest(feature) % BUCKETS


@dataclass
class ToxicityModel:
    """Emission weights by feature bucket, the chain's start and transition
    weights (of state 1 over 0), and the logistic curve of the scores."""

    weights: np.ndarray | None = None
    start: float = 0.0
    step: tuple[float, float, float] = (0.0, 0.0, 0.0)  # 0 to 1, 1 to 0, 1 to 1
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    memory: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "memory": {}}

    def emission(self, tokens: list[str]) -> np.ndarray:
        """The weight of state 1 over state 0 at each token."""
        if self.weights is None:
            return np.full(len(tokens), -30.0)
        seen = self.memory
        if len(seen) > REMEMBERED:
            seen.clear()
        out = []
        for t in tokens:
            e = seen.get(t)
            if e is None:
                e = seen[t] = float(sum(self.weights[bucket(f)] for f in features(t)))
            out.append(e)
        return np.clip(np.array(out, dtype=np.float64), -30, 30)

    def passes(self, emission: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward pass over texts that lie one after another. Each state
        is kept as the ratio of state 1 to state 0; the texts advance together,
        the longest first, so that those still running are a prefix."""
        order = np.argsort(-lengths, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[order]
        size = lengths[order]
        e = np.exp(emission)
        t01, t10, t11 = np.exp(self.step)
        running = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        ahead, back = np.empty_like(e), np.ones_like(e)
        if not len(e):
            return ahead, back
        at = begin[:running[0]]
        ahead[at] = e[at] * np.exp(self.start)
        for t in range(1, len(running)):
            at = begin[:running[t]] + t
            r = ahead[at - 1]
            ahead[at] = np.clip(e[at] * (t01 + r * t11) / (1 + r * t10), 1e-200, 1e200)
        for t in range(len(running) - 1, 0, -1):
            at = begin[:running[t]] + t
            x = e[at] * back[at]
            back[at - 1] = (t10 + x * t11) / (1 + x * t01)
        return ahead, back

    def marginals(self, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each token's probability of state 1, given all tokens of its text."""
        ahead, back = self.passes(emission, lengths)
        return 1 / (1 + 1 / np.maximum(ahead * back, 1e-300))

    def aggregate(self, marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per text: the log odds of its likeliest token, the expected number
        of toxic tokens."""
        out = np.zeros((len(lengths), 2))
        out[:, 0] = -8.0
        some = np.flatnonzero(lengths)
        if len(some):
            begin = (np.cumsum(lengths) - lengths)[some]
            top = np.clip(np.maximum.reduceat(marginals, begin), 1e-4, 1 - 1e-4)
            out[some, 0] = np.log(top / (1 - top))
            out[some, 1] = np.log1p(np.add.reduceat(marginals, begin))
        return out

    def score(self, aggregates: np.ndarray) -> np.ndarray:
        z = self.curve[0] + aggregates @ np.array(self.curve[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str, learn: Column | None, sample: int) -> DataFrame:
    """At most about ``sample`` texts of each class: ``doc_id, text, toxic,
    weight``, where the weight undoes the sampling. The sample is the rows of
    least hash, so it does not depend on the partitions."""
    known = labels.where("toxic is not null").groupBy(F.col(id_col).alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = stage(known.withColumn("toxic", (F.col("toxic") > 0).cast("int")), "toxic-labels")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, sample / max(1, n.get(y, 0))) for y in (0, 1)}
    rate = F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    picked = known.where(F.pmod(id_hash(), F.lit(1 << 20)) < rate * (1 << 20)).withColumn("weight", 1 / rate)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))
    picked = stage(picked, "toxic-sample")
    return texts.join(F.broadcast(picked) if fits(picked, 40) else picked, "doc_id")


def _family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = (shingles(t.as_py()) for t in batch.column("text"))
        low = [int(s.min() >> np.uint64(1)) if len(s) else -1 for s in sets]
        yield batch.append_column("family", pa.array(low, pa.int64()))


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the families that hold a marking feature."""
    held = {0: Counter(), 1: Counter()}

    def flush(y: int) -> pa.RecordBatch:
        n = np.array(list(held[y].values()), dtype=np.int64)
        out = pa.RecordBatch.from_pydict({"feature": pa.array(list(held[y]), pa.string()), "a": n * y, "b": n * (1 - y)})
        held[y] = Counter()
        return out

    for batch in batches:
        for text, y in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            held[y].update({f for t in set(text.as_py().lower().split()) for f in marking(t)})
            if len(held[y]) > COUNTED:
                yield flush(y)
    yield flush(0)
    yield flush(1)


def marking_features(sample: DataFrame) -> set[str]:
    """The features that mark toxic tokens, by a likelihood-ratio test at a
    level that allows for the number of features tested. Few by nature: those
    that are many times likelier in toxic texts."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return set()
    counts = stage(sample.select("text", "toxic").mapInArrow(releasing(_feature_counts), "feature string, a long, b long")
                   .groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
                   .where(F.col("a") >= LEAST_FAMILIES), "toxic-features")
    tested = max(2, counts.count())
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    expected = (a + b) * (n1 / (n1 + n0))
    ratio = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / ((a + b) - expected))).otherwise(0.0))
    found = counts.where((odds >= LEAST_ODDS) & (ratio >= 2 * float(np.log(tested)))).select("feature").limit(MOST_MARKS + 1).collect()
    if len(found) > MOST_MARKS:
        raise ValueError(f"more than {MOST_MARKS} features mark toxic tokens")
    return {r["feature"] for r in found}


def window_starts(n: int, hits: list[int] | None, spacing: int) -> list[int]:
    """Where a text of ``n`` tokens has its training windows: so that every hit
    lies in one, or (None) one for every ``spacing`` tokens, in their middle."""
    if hits is None:
        return [i + max(0, (min(spacing, n - i) - SPAN) // 2) for i in range(0, n, spacing) if i == 0 or n - i >= SPAN]
    out: list[int] = []
    for h in hits:
        if not out or h >= out[-1] + SPAN:
            out.append(max(out[-1] + SPAN if out else 0, h - SPAN // 2))
    return out


def _windows(marks: set[str], spacing: int):
    """Windows of labelled tokens of whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, tags, weights = [], [], []
            for text, y, w in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "weight"))):
                words = text.lower().split()
                tag = [int(bool(y) and not marks.isdisjoint(marking(t))) for t in words]
                hits = [i for i, x in enumerate(tag) if x]
                if y and not hits:
                    continue  # nothing tells which of its tokens are toxic
                for i in window_starts(len(words), hits if y else None, spacing):
                    tokens.append(words[i:i + SPAN])
                    tags.append(tag[i:i + SPAN])
                    weights.append(w if not y else 1.0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(tokens), dtype=np.int32)), pa.array(tokens, pa.list_(pa.string())),
                 pa.array(tags, pa.list_(pa.int32())), pa.array(weights, pa.float64())],
                names=["one", "tokens", "tags", "weight"])
    return run


def fit_chain(tokens: list[list[str]], tags: list[list[int]], rounds: int = 60, rate: float = 0.3,
              decay: float = 1e-3) -> ToxicityModel:
    """Maximum likelihood of the chain by Adagrad over all windows."""
    at, words = pd.factorize(np.array([t for x in tokens for t in x], dtype=object))
    return fit_encoded(at, list(words), np.array([len(x) for x in tokens]), np.concatenate([np.array(x) for x in tags]), rounds, rate, decay)


def fit_encoded(at: np.ndarray, words: list[str], lengths: np.ndarray, tags: np.ndarray, rounds: int = 60, rate: float = 0.3,
                decay: float = 1e-3) -> ToxicityModel:
    """:func:`fit_chain` of windows one after another: the place of each token
    in ``words``, its tag, and the windows' lengths."""
    own = [np.fromiter(map(bucket, features(w)), dtype=np.int32) for w in words]
    owner = np.repeat(np.arange(len(own), dtype=np.int32), [len(p) for p in own])
    used, feature = np.unique(np.concatenate(own), return_inverse=True)
    del own
    y = tags.astype(np.int8)
    stops = np.concatenate(([0], np.cumsum(lengths)))
    blocks = [(i, min(i + BLOCK, len(lengths))) for i in range(0, len(lengths), BLOCK)]
    w, chain = np.zeros(len(used)), np.array([-2.0, -2.0, 1.0, 1.0])  # start, 0-1, 1-0, 1-1
    sums_w, sums_c = np.full(len(used), 1e-6), np.full(4, 1e-6)
    model = ToxicityModel()
    for _ in range(rounds):
        emission = np.clip(np.bincount(owner, w[feature], len(words)), -30, 30)
        model.start, model.step = chain[0], tuple(chain[1:])
        off, grad_c = np.zeros(len(words)), np.zeros(4)
        for a, b in blocks:
            words_at, tag = at[stops[a]:stops[b]], y[stops[a]:stops[b]].astype(np.float64)
            score = emission[words_at]
            ahead, back = model.passes(score, lengths[a:b])
            p = 1 / (1 + 1 / np.maximum(ahead * back, 1e-300))
            first = np.zeros(len(tag), dtype=bool)
            first[stops[a:b] - stops[a]] = True
            later = np.flatnonzero(~first)
            # posterior of neighbouring states: prefix, transition, suffix
            t01, t10, t11 = np.exp(chain[1:])
            r, x = ahead[later - 1], np.exp(score[later]) * back[later]
            pair = np.stack([t01 * x, t10 * r, t11 * r * x])
            pair /= 1 + pair.sum(axis=0)
            seen = np.stack([(1 - tag[later - 1]) * tag[later], tag[later - 1] * (1 - tag[later]), tag[later - 1] * tag[later]])
            off += np.bincount(words_at, p - tag, len(words))
            grad_c += np.concatenate(([(p - tag)[first].sum()], (pair - seen).sum(axis=1)))
        grad_w = np.bincount(feature, off[owner], len(used)) / len(lengths) + decay * w / 10
        grad_c /= len(lengths)
        sums_w += grad_w ** 2
        sums_c += grad_c ** 2
        w -= rate * grad_w / np.sqrt(sums_w)
        chain -= rate * grad_c / np.sqrt(sums_c)
    model.start, model.step = float(chain[0]), tuple(float(x) for x in chain[1:])
    model.weights = np.zeros(BUCKETS, dtype=np.float32)
    model.weights[used] = w
    return model


def _fit_task(rows: pa.Table) -> pa.Table:
    """Windows stay in Arrow's memory; only different words become strings."""
    rows = rows.sort_by("order")
    tokens, tags = (rows.column(c).combine_chunks() for c in ("tokens", "tags"))
    lengths = pa.compute.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    at, words, tags = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), tags.flatten().to_numpy(zero_copy_only=False)
    del rows, tokens, coded
    m = fit_encoded(at, words, lengths, tags)
    del at, words, lengths, tags
    release()
    return pa.table({"weights": pa.array([m.weights.tobytes()], pa.binary()), "chain": pa.array([[m.start, *m.step]], pa.list_(pa.float64()))})


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weighted logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * beta
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(a.shape[1])
        beta = beta - np.linalg.solve(h, g)
    return tuple(float(v) for v in beta)


def _aggregates(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            found = model.aggregate(*_marginals(model, batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("weight"), pa.array(found[:, 0]),
                                              pa.array(found[:, 1])], names=["toxic", "weight", "x0", "x1"])
    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text: str = "text",
        sample: int = SAMPLE) -> ToxicityModel:
    """A model of ``labels.toxic``, learnt from at most about ``sample`` rows
    of each class among those that ``learn`` (a condition on ``doc_id``) admits.

    Texts of one family (equal least shingle, so near copies) count once.
    Labels of null ids or values are ignored; of repeated labels the largest
    counts. Without texts of both classes, the model scores every text with
    the smoothed share of toxic labels.
    """
    rows = labelled(docs, labels, id_col, text, learn, sample).select("doc_id", "text", "toxic", "weight")
    rows = stage(rows.mapInArrow(releasing(_family), "doc_id long, text string, toxic int, weight double, family long"), "toxic-texts")
    families = stage(rows.dropDuplicates(["family", "toxic"]), "toxic-families")
    marks = marking_features(families)
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    prior = (n.get(1, 0) + 0.5) / (n.get(0, 0) + n.get(1, 0) + 1)
    constant = ToxicityModel(curve=(float(np.log(prior / (1 - prior))), 0.0, 0.0))
    if not marks:
        return constant
    # short windows of a bounded sample: one task fits the chain
    clean = families.where("toxic = 0").agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    spacing = max(SPACING, -(-clean // CLEAN_WINDOWS))
    windows = families.mapInArrow(releasing(_windows(marks, spacing)), "one int, tokens array<string>, tags array<int>, weight double")
    windows = windows.withColumn("order", F.xxhash64("tokens"))
    found = windows.groupBy("one").applyInArrow(_fit_task, "weights binary, chain array<double>").collect()
    if not found:
        return constant
    chain = list(found[0]["chain"])
    model = ToxicityModel(np.frombuffer(bytes(found[0]["weights"]), dtype=np.float32), chain[0], tuple(chain[1:]))
    data = rows.select("text", "toxic", "weight").mapInArrow(
        releasing(_aggregates(model)), "toxic int, weight double, x0 double, x1 double").toPandas()
    y, weight = data["toxic"].to_numpy(), data["weight"].to_numpy()
    curve = fit_curve(data[["x0", "x1"]].to_numpy(), y, weight)
    if min(curve[1:]) < 0:  # more toxic tokens never lower a score
        rising = 0 if curve[1] > 0 else 1
        cut = fit_curve(data[[f"x{rising}"]].to_numpy(), y, weight)
        curve = (cut[0], *(max(0.0, cut[1]) if i == rising else 0.0 for i in (0, 1)))
    model.curve = curve
    return model


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of bounded text."""
    for batch in batches:
        sizes = pa.compute.utf8_length(batch.column("text")).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > AT_ONCE:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def _marginals(model: ToxicityModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' marginals of texts one after another, and their numbers."""
    own = [model.emission((t.as_py() or "").lower().split()) for t in texts]
    lengths = np.array([len(x) for x in own], dtype=np.int64)
    return model.marginals(np.concatenate(own) if own else np.empty(0), lengths), lengths


def _score(model: ToxicityModel, spans: bool):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            texts = batch.column("text")
            p, lengths = _marginals(model, texts)
            columns = [batch.column("doc_id"), pa.array(model.score(model.aggregate(p, lengths)))]
            names = ["doc_id", "score"]
            if spans:
                out = [[] for _ in texts]
                begin = np.cumsum(lengths) - lengths
                hits = np.flatnonzero(p > 0.5)
                for i in np.unique(np.searchsorted(begin + lengths, hits, side="right")).tolist():
                    own = p[begin[i]:begin[i] + lengths[i]]
                    places = [m.span() for m in TOKEN.finditer(texts[i].as_py())]
                    out[i] = [{"start": places[j][0], "stop": places[j][1]} for j in np.flatnonzero(own > 0.5).tolist()]
                columns, names = [*columns, pa.array(out, kind)], [*names, "spans"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text: str = "text",
          spans: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, score`` and the offending ``spans``
    (code-point offsets of tokens whose marginal is above one half). Only the
    whole text is an input of the score; null and empty texts get the score of
    a text without toxic tokens. Other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    schema = "doc_id long, score double" + (", spans array<struct<start: int, stop: int>>" if spans else "")
    return rows.mapInArrow(releasing(_score(model, spans)), schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, with all their columns;
    filtered where they are read, without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text)], names=["doc_id", "text"])
            for part in _score(model, False)(iter([rows])):
                yield batch.slice(0, part.num_rows).filter(pa.compute.less(part.column("score"), threshold))
                batch = batch.slice(part.num_rows)
    return docs.mapInArrow(releasing(run), docs.schema)
