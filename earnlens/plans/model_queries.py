"""Benchmark, feature and evaluation queries with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from earnlens.operators import benchmarks as bm
from earnlens.operators import evaluate as ev
from earnlens.operators import features as fe
from earnlens.operators.requests import normalise_requests, validate_requests
from earnlens.operators.ranking import exact_quantiles
from earnlens.plans.modelviews import C, CSCORED_SQL, Q, QSCORED_SQL, S, SPLIT_SQL, class_scored, quantile_scored, split_cohort
from earnlens.plans.registry import query, r4
from earnlens.plans.sqlviews import COHORT, P, PERSONS, PWC, WAGES, with_views
from earnlens.sources import testbed as tb

CTX = ["employment", "location_quotient", "jobs_per_1000", "hourly_mean"]
_MED = ", ".join(f"round(quantile_cont({m}, 0.5), 4) AS med_{m}" for m in CTX)


@query("context_defaults", PWC + f"""
SELECT CAST(GROUPING(state, occupation) AS INTEGER) AS level, state, occupation, {_MED}
FROM cohort GROUP BY GROUPING SETS ((state, occupation), (state), ())""")
def q_context_defaults(spark, sf):
    return r4(bm.context_defaults(tb.cohort(spark, sf)))


_VALID_REQ = """req AS (
  SELECT o.o_orderkey AS request_id, upper(trim(lower(n.n_name))) AS state,
         c.c_mktsegment AS occupation, o.o_orderpriority AS education_level
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE o.o_orderstatus IN ('F', 'O')
    AND (year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) BETWEEN 18 AND 80)"""


def _valid_requests(spark, sf):
    good, _ = validate_requests(normalise_requests(tb.requests(spark, sf)),
                                tb.persons(spark, sf))
    return good


@query("context_defaults_lookup", PWC.rstrip() + ",\n" + _VALID_REQ + f""",
d AS (SELECT CAST(GROUPING(state, occupation) AS INTEGER) AS level, state, occupation,
             {", ".join(f"quantile_cont({m}, 0.5) AS med_{m}" for m in CTX)}
      FROM cohort GROUP BY GROUPING SETS ((state, occupation), (state), ()))
SELECT r.request_id,
       CASE WHEN d0.state IS NOT NULL THEN 0 WHEN d1.state IS NOT NULL THEN 1 ELSE 3 END
         AS context_level,
       {", ".join(f"round(CASE WHEN d0.state IS NOT NULL THEN d0.med_{m} WHEN d1.state IS NOT NULL THEN d1.med_{m} ELSE d3.med_{m} END, 4) AS {m}" for m in CTX)}
FROM req r
LEFT JOIN (SELECT * FROM d WHERE level = 0) d0 ON r.state = d0.state AND r.occupation = d0.occupation
LEFT JOIN (SELECT * FROM d WHERE level = 1) d1 ON r.state = d1.state
CROSS JOIN (SELECT * FROM d WHERE level = 3) d3""")
def q_context_lookup(spark, sf):
    r = bm.apply_context_defaults(_valid_requests(spark, sf),
                                  bm.context_defaults(tb.cohort(spark, sf)))
    return r4(r.select("request_id", "context_level", *CTX))


@query("peer_benchmarks", PWC + """
SELECT state, education_level, round(quantile_cont(annual_income, 0.5), 4) AS median_income,
       round(avg(CAST(annual_income AS DECIMAL(38,10))), 4) AS mean_income,
       CASE WHEN GROUPING(state, education_level) = 3 THEN 0 ELSE count(*) END AS group_size
FROM cohort GROUP BY GROUPING SETS ((state, education_level), ())""")
def q_peer_benchmarks(spark, sf):
    return r4(bm.peer_benchmarks(tb.cohort(spark, sf)))


@query("percentile_in_group", Q + """,
inc AS (SELECT state, education_level, annual_income FROM split WHERE split = 'train')
SELECT s.person_id AS request_id, s.state, s.education_level, round(s.p50, 4) AS predicted,
       CASE WHEN n.n IS NULL THEN 50.0
            ELSE round(100.0 * (SELECT count(*) FROM inc i WHERE i.state = s.state
                                AND i.education_level = s.education_level
                                AND i.annual_income < s.p50) / n.n, 1) END AS percentile_in_group
FROM scored s LEFT JOIN (SELECT state, education_level, count(*) AS n FROM inc GROUP BY 1, 2) n
  USING (state, education_level)""")
def q_percentile_in_group(spark, sf):
    sc = quantile_scored(spark, sf).withColumnRenamed("person_id", "request_id")
    train = split_cohort(spark, sf).where("split = 'train'")
    out = bm.percentile_in_group(sc, train, value="p50")
    return r4(out.withColumnRenamed("p50", "predicted"))


# ------------------------------------------------------------------ features
@query("hash_split_counts", S + """
SELECT split, count(*) AS n FROM split GROUP BY 1""")
def q_split_counts(spark, sf):
    return split_cohort(spark, sf).groupBy("split").agg(F.count("*").alias("n"))


@query("kfold_counts", S + """
SELECT CAST(CAST(('0x' || substr(md5(CAST(person_id AS VARCHAR) || '|42|fold'), 1, 8))
            AS UBIGINT) % 5 AS INTEGER) AS fold, count(*) AS n
FROM split WHERE split = 'train' GROUP BY 1""")
def q_kfold(spark, sf):
    t = split_cohort(spark, sf).where("split = 'train'")
    return fe.hash_folds(t, "person_id", 5, 42).groupBy("fold").agg(F.count("*").alias("n"))


@query("hash_sample", PWC + """
SELECT person_id, state, annual_income FROM cohort
ORDER BY CAST(('0x' || substr(md5(CAST(person_id AS VARCHAR) || '|42'), 1, 8)) AS UBIGINT),
         person_id LIMIT 500""")
def q_hash_sample(spark, sf):
    return fe.hash_sample(tb.cohort(spark, sf), "person_id", 500, 42).select(
        "person_id", "state", "annual_income")


_ENC = """tm AS (SELECT occupation, avg(CAST(annual_income AS DECIMAL(38,10))) AS m FROM split WHERE split = 'train' GROUP BY 1),
sm AS (SELECT state, avg(CAST(annual_income AS DECIMAL(38,10))) AS m FROM split WHERE split = 'train' GROUP BY 1)"""


@query("target_encoding", S + "," + _ENC + """
SELECT s.person_id, round(coalesce(tm.m, (SELECT avg(m) FROM tm)), 4) AS occ_mean_income,
       round(coalesce(sm.m, (SELECT avg(m) FROM sm)), 4) AS state_mean_income
FROM split s LEFT JOIN tm USING (occupation) LEFT JOIN sm USING (state)
WHERE s.split = 'test'""")
def q_target_encoding(spark, sf):
    s = split_cohort(spark, sf)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    t = fe.target_encode(test, fe.group_means(train, "occupation"), "occupation", "occ_mean_income")
    t = fe.target_encode(t, fe.group_means(train, "state"), "state", "state_mean_income")
    return r4(t.select("person_id", "occ_mean_income", "state_mean_income"))


@query("group_mean_window", PWC + """
SELECT person_id, round(avg(CAST(annual_income AS DECIMAL(38,10))) OVER (PARTITION BY occupation), 4) AS occ_mean_income,
       round(avg(CAST(annual_income AS DECIMAL(38,10))) OVER (PARTITION BY state), 4) AS state_mean_income FROM cohort""")
def q_group_mean_window(spark, sf):
    c = tb.cohort(spark, sf)
    c = fe.with_group_mean(c, "occupation", "occ_mean_income")
    c = fe.with_group_mean(c, "state", "state_mean_income")
    return r4(c.select("person_id", "occ_mean_income", "state_mean_income"))


@query("leakage_gap", S + """
SELECT t.state, round(t.m, 4) AS train_mean, round(f.m, 4) AS full_mean,
       round(abs(t.m - f.m), 4) AS abs_gap
FROM (SELECT state, avg(CAST(annual_income AS DECIMAL(38,10))) AS m FROM split WHERE split = 'train' GROUP BY 1) t
JOIN (SELECT state, avg(CAST(annual_income AS DECIMAL(38,10))) AS m FROM split GROUP BY 1) f USING (state)""")
def q_leakage(spark, sf):
    s = split_cohort(spark, sf)
    return r4(fe.leakage_gap(fe.group_means(s.where("split = 'train'"), "state"),
                             fe.group_means(s, "state"), "state"))


@query("features_full", S + "," + _ENC + """,
reg AS (SELECT n.n_name AS state, r.r_name AS region,
               CAST(dense_rank() OVER (ORDER BY r.r_name) - 1 AS INTEGER) AS region_code
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT s.person_id, s.age, s.education_ord,
       CASE WHEN s.gender = 'Male' THEN 1 ELSE 0 END AS gender_bin,
       coalesce(reg.region_code, 0) AS region_code, s.employment, round(s.location_quotient, 4)
         AS location_quotient, round(s.jobs_per_1000, 4) AS jobs_per_1000,
       round(s.hourly_mean, 4) AS hourly_mean,
       round(coalesce(tm.m, (SELECT avg(m) FROM tm)), 4) AS occ_mean_income,
       round(coalesce(sm.m, (SELECT avg(m) FROM sm)), 4) AS state_mean_income,
       round(ln(1 + s.annual_income), 4) AS label,
       CAST(CASE WHEN s.annual_income >= 300000 THEN 1 ELSE 0 END AS DOUBLE) AS premium
FROM split s LEFT JOIN tm USING (occupation) LEFT JOIN sm USING (state)
LEFT JOIN reg USING (state) WHERE s.split = 'test'""")
def q_features_full(spark, sf):
    s = split_cohort(spark, sf)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    e = fe.engineer(test, tb.education(spark), tb.region_map(spark, sf),
                    fe.group_means(train, "occupation"), fe.group_means(train, "state"))
    e = fe.premium_label(fe.log_target(e), 300000)
    return r4(e.select("person_id", *fe.FEATURES_FULL, "label", "premium"))


@query("oof_target_encoding", S + """,
f AS (SELECT *, CAST(CAST(('0x' || substr(md5(CAST(person_id AS VARCHAR) || '|42|fold'), 1, 8))
            AS UBIGINT) % 5 AS INTEGER) AS fold FROM split WHERE split = 'train'),
kf AS (SELECT occupation, fold, sum(annual_income) AS sf, count(*) AS nf FROM f GROUP BY 1, 2),
k AS (SELECT occupation, sum(sf) AS s, sum(nf) AS n FROM kf GROUP BY 1),
enc AS (SELECT kf.occupation, kf.fold,
               CASE WHEN k.n > kf.nf THEN (k.s - kf.sf) / (k.n - kf.nf) END AS e
        FROM kf JOIN k USING (occupation))
SELECT f.person_id, f.fold,
       round(coalesce(enc.e, (SELECT avg(s / n) FROM k)), 4) AS oof_mean
FROM f LEFT JOIN enc USING (occupation, fold)""")
def q_oof(spark, sf):
    t = fe.hash_folds(split_cohort(spark, sf).where("split = 'train'"), "person_id", 5, 42)
    return r4(fe.oof_target_encoding(t, "occupation").select("person_id", "fold", "oof_mean"))


# ------------------------------------------------------------------ evaluation
@query("point_metrics", Q + """
SELECT round(1 - sum(power(annual_income - p50, 2)) / (var_pop(annual_income) * count(*)), 4) AS r2,
       round(avg(abs(annual_income - p50)), 4) AS mae,
       round(sqrt(avg(power(annual_income - p50, 2))), 4) AS rmse, count(*) AS n FROM scored""")
def q_point_metrics(spark, sf):
    return r4(ev.point_metrics(quantile_scored(spark, sf)))


_PB = lambda a, c: f"round(avg(greatest({a} * (annual_income - {c}), ({a} - 1) * (annual_income - {c}))), 4) AS pinball_{c}"


@query("pinball", Q + f"""
SELECT {_PB(0.1, 'p10')}, {_PB(0.5, 'p50')}, {_PB(0.9, 'p90')} FROM scored""")
def q_pinball(spark, sf):
    return r4(ev.pinball_losses(quantile_scored(spark, sf)))


@query("interval_metrics", Q + """
SELECT round(avg(CASE WHEN annual_income BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END), 4) AS coverage,
       round(quantile_cont(p90 - p10, 0.5), 4) AS median_width,
       count(*) FILTER (WHERE p10 > p50 OR p50 > p90) AS crossings, count(*) AS n FROM scored""")
def q_interval(spark, sf):
    return r4(ev.interval_metrics(quantile_scored(spark, sf)))


@query("subgroup_coverage", Q + """,
st AS (SELECT 'gender' AS attribute, gender AS grp, * FROM scored
       UNION ALL SELECT 'region', region, * FROM scored)
SELECT attribute, grp,
       round(avg(CASE WHEN annual_income BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END), 4) AS coverage,
       count(*) AS n
FROM st GROUP BY 1, 2 HAVING count(*) >= 30""")
def q_subgroup_cov(spark, sf):
    return r4(ev.subgroup_coverage(quantile_scored(spark, sf)))


@query("subgroup_point_metrics", Q + """,
st AS (SELECT 'gender' AS attribute, gender AS grp, * FROM scored
       UNION ALL SELECT 'region', region, * FROM scored)
SELECT attribute, grp,
       round(1 - sum(power(annual_income - p50, 2)) / (var_pop(annual_income) * count(*)), 4) AS r2,
       round(avg(abs(annual_income - p50)), 4) AS mae,
       round(sqrt(avg(power(annual_income - p50, 2))), 4) AS rmse, count(*) AS n
FROM st GROUP BY 1, 2 HAVING count(*) >= 30""")
def q_subgroup_point(spark, sf):
    return r4(ev.subgroup_point_metrics(quantile_scored(spark, sf)))


_AUC = """SELECT {g} round(sum(pos * (neg_below + neg / 2.0)) / (sum(pos) * sum(neg)), 4) AS roc_auc,
       sum(pos) AS n_pos, sum(neg) AS n_neg
FROM (SELECT {g} score, pos, neg,
             coalesce(sum(neg) OVER (PARTITION BY {p} ORDER BY score
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
      FROM (SELECT {g} score, CAST(sum(premium) AS BIGINT) AS pos,
                   CAST(sum(1 - premium) AS BIGINT) AS neg FROM cscored GROUP BY {g} score))
{gb}"""


@query("roc_auc", C + _AUC.format(g="", p="1", gb=""))
def q_roc_auc(spark, sf):
    return r4(ev.roc_auc(class_scored(spark, sf)))


@query("subgroup_roc_auc", C + _AUC.format(g="gender,", p="gender", gb="GROUP BY gender")
       .replace("round(sum(pos", "round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos")
       .replace("/ (sum(pos) * sum(neg)), 4)", "/ (sum(pos) * sum(neg)) END, 4)"))
def q_subgroup_auc(spark, sf):
    return r4(ev.roc_auc(class_scored(spark, sf), groups=["gender"]))


@query("average_precision", C + """,
dv AS (SELECT score, CAST(sum(premium) AS BIGINT) AS pos, CAST(sum(1 - premium) AS BIGINT) AS neg
       FROM cscored GROUP BY score),
cum AS (SELECT score, pos, neg,
               sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
               sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp
        FROM dv)
SELECT round(sum(pos / (SELECT sum(pos) FROM dv) * tp / (tp + fp)), 4) AS average_precision FROM cum""")
def q_ap(spark, sf):
    return r4(ev.average_precision(class_scored(spark, sf)))


@query("threshold_metrics", C + """,
c AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND premium = 1) AS tp,
             count(*) FILTER (WHERE score >= 0.5 AND premium = 0) AS fp,
             count(*) FILTER (WHERE score < 0.5 AND premium = 1) AS fn,
             count(*) FILTER (WHERE score < 0.5 AND premium = 0) AS tn FROM cscored),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
SELECT round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(precision, 4) AS precision,
       round(recall, 4) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
             ELSE 0.0 END, 4) AS f1, tp, fp, fn, tn FROM pr""")
def q_threshold(spark, sf):
    return r4(ev.threshold_metrics(class_scored(spark, sf)))


@query("brier", C + """
SELECT round(avg(power(score - premium, 2)), 4) AS brier,
       round(avg(power(r - premium, 2)), 4) AS brier_base_rate
FROM cscored, (SELECT avg(premium) AS r FROM cscored)""")
def q_brier(spark, sf):
    return r4(ev.brier(class_scored(spark, sf)))


@query("positive_rate", S + """
SELECT split, round(avg(CASE WHEN annual_income >= 300000 THEN 1.0 ELSE 0.0 END), 4) AS positive_rate,
       count(*) AS n,
       round(greatest(avg(CASE WHEN annual_income >= 300000 THEN 1.0 ELSE 0.0 END),
                      1 - avg(CASE WHEN annual_income >= 300000 THEN 1.0 ELSE 0.0 END)), 4)
         AS majority_accuracy
FROM split GROUP BY 1""")
def q_positive_rate(spark, sf):
    s = fe.premium_label(split_cohort(spark, sf), 300000)
    return r4(ev.positive_rate(s, "premium", "split"))


@query("demographic_parity", Q + """
SELECT gender, round(avg(p50), 4) AS mean_prediction, count(*) AS n,
       round(max(avg(p50)) OVER () - min(avg(p50)) OVER (), 4) AS parity_gap
FROM scored GROUP BY 1""")
def q_parity(spark, sf):
    return r4(ev.demographic_parity(quantile_scored(spark, sf)))


@query("residual_summary", Q + """
SELECT round(avg(annual_income - p50), 4) AS mean_residual,
       round(stddev_samp(annual_income - p50), 4) AS std_residual,
       round(min(annual_income - p50), 4) AS min_residual,
       round(max(annual_income - p50), 4) AS max_residual, count(*) AS n FROM scored""")
def q_residuals(spark, sf):
    return r4(ev.residual_summary(quantile_scored(spark, sf)))


def closed_form_cv(spark, sf):
    """EVA-12 of the per-occupation median: every fold is predicted from the
    other ones, all folds' medians in one pass; one row, ``cv_r2_mean``."""
    t = fe.hash_folds(split_cohort(spark, sf).where("split = 'train'"), "person_id", 5, 42)
    others = t.withColumn("held", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda f: f != F.col("fold"))))
    medians = exact_quantiles(others, ["held", "occupation"], "annual_income", {"p50": 0.5})
    own = t.join(medians, (F.col("fold") == F.col("held")) & (t["occupation"] == medians["occupation"])).drop(medians["occupation"])
    return ev.point_metrics(own, groups=["fold"]).agg(F.avg("r2").alias("cv_r2_mean"))


@query("metric_bands", with_views(PERSONS, WAGES, COHORT, SPLIT_SQL, QSCORED_SQL, CSCORED_SQL) + """,
st AS (SELECT 'gender=' || gender AS grp, * FROM scored UNION ALL SELECT 'region=' || region, * FROM scored),
fo AS (SELECT *, CAST(CAST(('0x' || substr(md5(CAST(person_id AS VARCHAR) || '|42|fold'), 1, 8)) AS UBIGINT) % 5 AS INTEGER) AS fold
       FROM split WHERE split = 'train'),
md AS (SELECT h.held, t.occupation, quantile_cont(t.annual_income, 0.5) AS p50 FROM range(5) h(held) JOIN fo t ON t.fold <> h.held GROUP BY 1, 2),
cv AS (SELECT avg(r2) AS r2 FROM (SELECT fo.fold, 1 - sum(power(annual_income - p50, 2)) / (var_pop(annual_income) * count(*)) AS r2
                                  FROM fo JOIN md ON md.held = fo.fold AND md.occupation = fo.occupation GROUP BY 1)),
cg AS (SELECT NULL AS grp, score, premium FROM cscored UNION ALL SELECT 'gender=' || gender, score, premium FROM cscored
       UNION ALL SELECT 'region=' || region, score, premium FROM cscored),
dv AS (SELECT grp, score, sum(premium) AS pos, sum(1 - premium) AS neg FROM cg GROUP BY 1, 2),
nb AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY grp ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM dv),
au AS (SELECT grp, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc, sum(pos) + sum(neg) AS n FROM nb GROUP BY 1
       HAVING sum(pos) > 0 AND sum(neg) > 0),
m AS (SELECT 'coverage_80' AS metric, NULL AS grp,
             avg(CASE WHEN annual_income BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END) AS value FROM scored
      UNION ALL SELECT 'crossings', NULL, CAST(count(*) FILTER (WHERE p10 > p50 OR p50 > p90) AS DOUBLE) FROM scored
      UNION ALL SELECT 'r2', NULL, 1 - sum(power(annual_income - p50, 2)) / (var_pop(annual_income) * count(*)) FROM scored
      UNION ALL SELECT 'mae', NULL, avg(abs(annual_income - p50)) FROM scored
      UNION ALL SELECT 'rmse', NULL, sqrt(avg(power(annual_income - p50, 2))) FROM scored
      UNION ALL SELECT 'cv_test_gap', NULL, abs((SELECT r2 FROM cv) - (1 - sum(power(annual_income - p50, 2)) / (var_pop(annual_income) * count(*)))) FROM scored
      UNION ALL SELECT 'subgroup_coverage', grp, avg(CASE WHEN annual_income BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END) FROM st GROUP BY 2 HAVING count(*) >= 30
      UNION ALL SELECT 'roc_auc', NULL, auc FROM au WHERE grp IS NULL
      UNION ALL SELECT 'subgroup_roc_auc', grp, auc FROM au WHERE grp IS NOT NULL AND n >= 30),
b AS (SELECT * FROM (VALUES ('coverage_80', 0.72, 0.88), ('crossings', 0.0, 0.0), ('r2', 0.0, 0.4), ('mae', 30000.0, 90000.0),
                            ('rmse', 60000.0, 160000.0), ('cv_test_gap', 0.0, 0.15), ('subgroup_coverage', 0.60, 0.95),
                            ('roc_auc', 0.55, 0.99), ('subgroup_roc_auc', 0.50, 0.95)) b(metric, lo, hi))
SELECT m.metric, m.grp, round(m.value, 4) AS value, CAST(b.lo AS DOUBLE) AS lo, CAST(b.hi AS DOUBLE) AS hi,
       m.value BETWEEN b.lo AND b.hi AND NOT (m.metric = 'subgroup_roc_auc' AND m.value = b.lo)
         AND NOT (m.metric IN ('roc_auc', 'subgroup_roc_auc') AND m.value = b.hi) AS passed FROM m JOIN b USING (metric)""")
def q_bands(spark, sf):
    classes = class_scored(spark, sf)
    per = [ev.roc_auc(classes, groups=[c]).select(F.lit(c).alias("attribute"), F.col(c).alias("grp"), "roc_auc",
                                                  (F.col("n_pos") + F.col("n_neg")).alias("n")) for c in ("gender", "region")]
    groups = per[0].unionByName(per[1]).where("n >= 30 and roc_auc is not null")
    values = ev.band_values(quantile_scored(spark, sf), closed_form_cv(spark, sf), classes, groups)
    return ev.metric_bands(values).select("metric", "grp", F.round("value", 4).alias("value"), "lo", "hi", "passed")
