"""The quantile forest: its quantile step against brute force, its heads on
planted data, and what is built on them."""

import random

import pytest
from pyspark.sql import functions as F

from earnlens.modeling import train as tr
from earnlens.modeling.quantile_forest import QuantileForest, QuantileForestModel, co_member_quantiles, leaf_labels, leaf_ranges
from earnlens.operators.score import GroupQuantileModel, PointModel, quantile_heads

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark):
    """y = 11.5 + .3 x1 + noise (1 + x2), noise from a hash."""
    h = lambda s: (F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(s))), 1, 8), 16, 10)
                   .cast("double") / 4294967295.0)
    df = spark.range(3000).select(
        "id", (h("a") * 4).alias("x1"), h("b").alias("x2"), ((h("c") + h("d") + h("e") - 1.5) * 1.2).alias("z"))
    return df.withColumn("label", F.lit(11.5) + 0.3 * F.col("x1") + F.col("z") * (1 + F.col("x2"))).cache()


def brute(train, leaves, alphas):
    weights = {}
    total = 0.0
    for t, leaf in enumerate(leaves):
        own = [v for v, ls in train if ls[t] == leaf and v is not None]
        total += bool(own)
        for v in own:
            weights[v] = weights.get(v, 0.0) + 1 / len(own)
    out, upto, values = [], 0.0, sorted(weights)
    for a in alphas:
        upto, hit = 0.0, None
        for v in values:
            upto += weights[v]
            if hit is None and upto >= a * total - 1e-9:
                hit = v
        out.append(hit)
    return tuple(out)


@pytest.mark.parametrize("bins", [1, 4, 32])
def test_co_member_quantiles_against_brute_force(spark, bins):
    rng = random.Random(bins)
    train = [(None if rng.random() < 0.05 else float(rng.randrange(40)), [rng.choice("abc"), rng.choice("pq"), rng.choice("xyzw")])
             for _ in range(300)]
    df = spark.createDataFrame(train, "y double, leaves array<string>")
    asked = [(i, [rng.choice("abcd"), rng.choice("pq"), rng.choice("xyzwv")]) for i in range(40)] + [(99, ["no", "no", "no"])]
    labels = leaf_labels(df, "leaves", "y", bins)
    got = co_member_quantiles(spark.createDataFrame(asked, "k long, leaves array<string>"), "k", "leaves", labels,
                              leaf_ranges(labels, bins), bins=bins)
    rows = {r.k: (r.q10, r.q50, r.q90) for r in got.collect()}
    assert rows == {k: brute(train, ls, (0.1, 0.5, 0.9)) for k, ls in asked if k != 99}


def losses(df, y, columns):
    return {a: df.agg(F.avg(F.greatest(a * (F.col(y) - c), (a - 1) * (F.col(y) - c)))).first()[0] for a, c in columns.items()}


def test_forest_beats_the_constant_and_keeps_order(spark, planted, tmp_path):
    train, test = planted.where("id % 5 != 0"), planted.where("id % 5 = 0")
    model = QuantileForest(["x1", "x2"], trees=20, depth=5, columns=1.0).fit(train)
    scored = model.transform(test).cache()
    assert scored.columns == [*test.columns, "q10", "q50", "q90"] and scored.count() == test.count()
    assert scored.where("q10 > q50 or q50 > q90 or q10 is null").count() == 0
    heads = losses(scored, "label", {0.1: F.col("q10"), 0.5: F.col("q50"), 0.9: F.col("q90")})
    constant = losses(scored, "label", {a: F.lit(train.agg(F.percentile("label", a)).first()[0]) for a in (0.1, 0.5, 0.9)})
    assert all(heads[a] < constant[a] for a in heads), (heads, constant)
    covered = scored.agg(F.avg(F.col("label").between(F.col("q10"), F.col("q90")).cast("double"))).first()[0]
    assert 0.7 < covered < 0.9
    model.save(str(tmp_path / "forest"))
    back = QuantileForestModel.load(spark, str(tmp_path / "forest")).transform(test)
    key = lambda df: sorted(tuple(r) for r in df.select("id", "q10", "q50", "q90").collect())
    assert key(back) == key(scored)


def test_cv_and_stability_refit(spark, planted):
    fitted = []

    def fit(rows):
        fitted.append(rows.count())
        return QuantileForest(["x1", "x2"], trees=5, depth=4, columns=1.0).fit(rows)

    row = tr.cv_scores(planted, fit, "id", 4, label="label", prediction="q50").first()
    assert len(fitted) == 4 and sum(fitted) == 3 * planted.count() and row.folds == 4 and 0.1 < row.cv_r2_mean < 0.9
    runs = []

    def run(seed):
        runs.append(seed)
        return spark.createDataFrame([(float(seed), 1.0)], "a double, b double")

    row = tr.seed_stability(run, (1, 2, 3)).first()
    assert sorted(runs) == [1, 2, 3] and (row.seeds, row.a_mean, row.b_std) == (3, 2.0, 0.0) and abs(row.a_std - (2 / 3) ** 0.5) < 1e-12


class Adds:
    def __init__(self, **columns):
        self.columns = columns

    def transform(self, df):
        return df.withColumns(self.columns)


def test_point_model_and_wrong_shapes(spark):
    df = spark.range(3)
    rows = PointModel(Adds(prediction=F.col("id") * 2.0, features=F.lit(1))).transform(df)
    assert rows.columns == ["id", "q10", "q50", "q90"] and [tuple(r) for r in rows.collect()][2] == (2, 4.0, 4.0, 4.0)
    assert quantile_heads(Adds(prediction=F.lit(3.0)), df).first().q90 == 3.0
    assert quantile_heads(Adds(q10=F.lit(1.0), q50=F.lit(2.0), q90=F.lit(3.0)), df).first().q50 == 2.0
    for bad in (Adds(other=F.lit(1.0)), Adds(q10=F.lit(1.0)), Adds(q10=F.lit(1.0), prediction=F.lit(1.0))):
        with pytest.raises(ValueError, match="unexpected model output"):
            quantile_heads(bad, df)
    with pytest.raises(ValueError, match="one number"):
        PointModel(Adds(prediction=F.array(F.lit(1.0), F.lit(2.0)))).transform(df)
    with pytest.raises(ValueError, match="one number"):
        PointModel(Adds()).transform(df)


def test_trained_scores_are_the_models_own(spark):
    """``score_trained``: heads and probability against the models applied to
    the encoded requests, and the invariants of a response."""
    from earnlens.modeling.train import premium_probability
    from earnlens.operators.score import encode_requests, score
    from earnlens.plans.ml_queries import artefacts, engineered, valid_requests
    train = engineered(spark, SF)[0]
    classes = tr.fit_premium(train, maxIter=5)
    heads = QuantileForest(tr.FEATURES_FULL, trees=10).fit(train)
    art = artefacts(spark, SF, heads, classes)
    requests = valid_requests(spark, SF)
    rows = {r.request_id: r for r in score(requests, art).collect()}
    own = premium_probability(classes, heads.transform(encode_requests(requests, art))).select(
        "request_id", *[F.expm1(f"q{n}").alias(f"p{n}") for n in (10, 50, 90)], "score").collect()
    assert len(rows) == len(own) == requests.count()
    for r in own:
        got = rows[r.request_id]
        assert (got.predicted_p10, got.predicted_p50, got.predicted_p90) == pytest.approx((r.p10, r.p50, r.p90), abs=0.006)
        assert got.p_above_premium_threshold == pytest.approx(r.score, abs=6e-5) and 0 <= got.p_above_premium_threshold <= 1
        assert got.predicted_p10 <= got.predicted_p50 <= got.predicted_p90 and not got.quantiles_crossed
        assert 0 <= got.percentile_in_group <= 100 and got.premium_threshold == 300000


def test_closed_form_heads_unseen_group(spark):
    model = GroupQuantileModel("g", "y").fit(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 9.0)], "g string, y double"))
    assert model.transform(spark.createDataFrame([("zz",)], "g string")).first().q50 == 3.0
