"""Model fitting, explanation and scoring queries (rows-only checks; their
invariants are in tests/test_models.py)."""

from __future__ import annotations

import posixpath
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from earnlens.modeling import train as tr
from earnlens.modeling.booster import QuantileBooster
from earnlens.modeling.search import SINGLE_ROWS
from earnlens.operators import benchmarks as bm
from earnlens.operators import evaluate as ev
from earnlens.operators import features as fe
from earnlens.operators.requests import normalise_requests, validate_requests
from earnlens.operators.score import Artefacts, GroupQuantileModel, score, score_memoised
from earnlens.operators.score_store import ScoreStore, score_through
from earnlens.operators.ranking import exact_quantiles
from earnlens.plans.modelviews import split_cohort
from earnlens.plans.scoring_sql import SCORES
from earnlens.plans.registry import query, r4
from earnlens.session import checkpoint_dir, materialize, written
from earnlens.sources import dims
from earnlens.sources import testbed as tb
from earnlens.sources.store import processed
from earnlens.sources.tables import input_signature

T = dims.TESTBED_PREMIUM_THRESHOLD


_FITTED: dict = {}


def _memo(spark, sf, name, build):
    """Fitted models are reused by the queries of one session."""
    key = (spark.sparkContext.applicationId, sf, input_signature(spark, sf), name)
    if key not in _FITTED:
        _FITTED[key] = build()
    return _FITTED[key]


def kept_as(cohort):
    """How frames of the cohort's rows are kept: large ones as Parquet."""
    return materialize if cohort.count() <= SINGLE_ROWS else written


def engineered(spark, sf):
    return _memo(spark, sf, "engineered", lambda: _engineered(spark, sf))


def _engineered(spark, sf):
    s = split_cohort(spark, sf)
    keep = kept_as(s)
    once = written if keep is written else lambda d: d
    s = once(s)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    om, sm = once(fe.group_means(train, "occupation")), once(fe.group_means(train, "state"))
    eng = lambda d: keep(fe.premium_label(fe.log_target(fe.engineer(
        d, tb.education(spark), tb.region_map(spark, sf), om, sm)), T))
    return eng(train), eng(test), om, sm, train


def artefacts(spark, sf, model=None, classifier=None):
    """Training artefacts, each written once a session as a Parquet table in
    the shared folder, like the persisted artefacts of a training run; scoring
    plans then start from these small tables, not from the cohort's lineage."""
    kept = lambda name, build: processed(spark, f"artefact-{name}", sf, build)
    raw_train = kept("train", lambda: split_cohort(spark, sf).where("split = 'train'").drop("split"))
    builds = {"occ-means": lambda: fe.group_means(raw_train, "occupation"), "state-means": lambda: fe.group_means(raw_train, "state"),
              "regions": lambda: tb.region_map(spark, sf), "defaults": lambda: bm.context_defaults(raw_train),
              "benchmarks": lambda: bm.peer_benchmarks(raw_train)}
    if model is None:
        label, probs = fe.log_target(raw_train), {"q10": 0.1, "q50": 0.5, "q90": 0.9}
        builds["quantiles"] = lambda: exact_quantiles(label, ["occupation"], "label", probs)
        builds["quantiles-all"] = lambda: exact_quantiles(label, [], "label", {f"{k}_g": v for k, v in probs.items()})
    # independent jobs over the training rows
    table = dict(zip(builds, tr.side_by_side(lambda n: kept(n, builds[n]), list(builds), 4)))
    if model is None:
        model = GroupQuantileModel("occupation")
        model.table, model.glob = table["quantiles"], table["quantiles-all"]
    return Artefacts(
        education=tb.education(spark), regions=table["regions"], occ_means=table["occ-means"], state_means=table["state-means"],
        defaults=table["defaults"], benchmarks=table["benchmarks"],
        incomes=raw_train.select("state", "education_level", "annual_income"),
        model=model, classifier=classifier,
        premium_threshold=T if classifier is not None else None)


def known_values(spark, sf):
    """What requests may name: the combinations that persons have, found once."""
    return processed(spark, "known-values", sf, lambda: tb.persons(spark, sf).select("state", "occupation", "education_level").distinct())


def valid_requests(spark, sf):
    good, _ = validate_requests(normalise_requests(tb.requests(spark, sf)), known_values(spark, sf))
    return good


@query("score_batch", SCORES.format(more=""))
def q_score(spark, sf):
    return score(valid_requests(spark, sf), artefacts(spark, sf))


@query("score_memoised", SCORES.format(more=", true AS cache_hit"))
def q_score_memo(spark, sf):
    art = artefacts(spark, sf)
    req = valid_requests(spark, sf)
    empty = score(req, art).limit(0).withColumns({
        "payload_hash": F.lit(None).cast("string"), "scored_at": F.lit(None).cast("timestamp")})
    first, store = score_memoised(req, empty, art)
    store = materialize(store)               # the persisted score store
    second, _ = score_memoised(req, store, art)
    return second


@query("score_store", SCORES.format(more=", true AS cache_hit"))
def q_score_store(spark, sf):
    """The bucketed store: scores of five hours ago are expired, those of ten minutes ago answer every request."""
    art, req = artefacts(spark, sf), materialize(valid_requests(spark, sf))
    path = posixpath.join(checkpoint_dir(spark), "scores", uuid.uuid4().hex)
    store = ScoreStore(spark, path, ScoreStore.schema_of(art, req))
    now = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
    for minutes in (300, 10):
        score_through(store, req, art, now=now - timedelta(minutes=minutes))
    return score_through(store, req, art, now=now)


def premium_model(spark, sf):
    return _memo(spark, sf, "premium_model", lambda: tr.fit_premium(engineered(spark, sf)[0], label="premium"))


def booster_model(spark, sf):
    """MOD-01 by the configured schedule, all rounds of it."""
    return _memo(spark, sf, "booster", lambda: QuantileBooster(fe.FEATURES_FULL, "label", **dims.BOOSTER_PARAMS).fit(
        engineered(spark, sf)[0]))


def premium_scored(spark, sf):
    def build():
        etest = engineered(spark, sf)[1]
        m = premium_model(spark, sf)
        return kept_as(etest)(tr.premium_probability(m, etest))
    return _memo(spark, sf, "premium_scored", build)


@query("premium_classifier")
def q_premium(spark, sf):
    sc = premium_scored(spark, sf)
    auc = ev.roc_auc(sc).select("roc_auc")
    ap = ev.average_precision(sc)
    th = ev.threshold_metrics(sc).select("accuracy", "precision", "recall", "f1")
    br = ev.brier(sc)
    k = lambda d: d.withColumn("_k", F.lit(0))
    return r4(k(auc).join(k(ap), "_k").join(k(th), "_k").join(k(br), "_k").drop("_k"))


@query("premium_subgroup_auc")
def q_premium_sub(spark, sf):
    sc = premium_scored(spark, sf)
    return r4(ev.roc_auc(sc, groups=["gender"]).unionByName(
        ev.roc_auc(sc.withColumnRenamed("region", "grp"), groups=["grp"])
        .withColumnRenamed("grp", "gender"))).where(F.col("n_pos") + F.col("n_neg") >= 30)


@query("logistic_auc")
def q_logistic(spark, sf):
    etrain, etest, *_ = engineered(spark, sf)
    m = tr.fit_logistic(etrain, label="premium")
    return r4(ev.roc_auc(tr.premium_probability(m, etest)))


@query("ridge_fit")
def q_ridge(spark, sf):
    etrain, etest, *_ = engineered(spark, sf)
    return r4(tr.regression_metrics(tr.fit_ridge(etrain), etest))


@query("gbt_compare")
def q_compare(spark, sf):
    etrain, etest, *_ = engineered(spark, sf)
    return r4(tr.compare_models(etrain, etest))


@query("quantile_booster")
def q_booster(spark, sf):
    sc = booster_model(spark, sf).transform(engineered(spark, sf)[1]).withColumns({"p10": F.expm1("q10"), "p50": F.expm1("q50"),
                                         "p90": F.expm1("q90")})
    k = lambda d: d.withColumn("_k", F.lit(0))
    return r4(k(ev.interval_metrics(sc)).join(k(ev.pinball_losses(sc)), "_k")
              .join(k(ev.point_metrics(sc).select("r2", "mae", "rmse")), "_k").drop("_k"))
