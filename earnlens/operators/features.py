"""Feature engineering, leakage-safe target encoding and deterministic
splits (FEA-01..10, WIN-01, JOIN-03, LEAK-01/02, SPL-01..03)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earnlens.functions.hashing import hash_rank_key, hash_unit
from earnlens.functions.metrics import exact_mean
from earnlens.operators.joins import lookup, lookup_with_default, one_row
from earnlens.sources import dims

# Model vector order (fixed; equals the reference's persisted feature list,
# written with the cohort's snake_case names).
FEATURES_FULL = ["age", "education_ord", "gender_bin", "region_code", "employment",
                 "location_quotient", "jobs_per_1000", "hourly_mean", "occ_mean_income",
                 "state_mean_income"]
FEATURES_DEMO = ["age", "education_ord", "gender_bin", "employment", "location_quotient",
                 "jobs_per_1000", "hourly_mean", "occ_mean_income", "state_mean_income"]
# The modelling study's own two lists (fixed).
FEATURES_STUDY = ["age", "education_ord", "gender_bin", "region_code", "employment",
                  "location_quotient", "jobs_per_1000", "hourly_mean", "annual_mean_wage",
                  "occ_mean_income", "state_mean_income"]
FEATURES_STUDY_DEMO = ["age", "education_ord", "gender_bin", "region_code", "occ_mean_income",
                       "state_mean_income"]
FEATURE_SETS = {"full": FEATURES_FULL, "demographic": FEATURES_DEMO, "study_full": FEATURES_STUDY,
                "study_demographic": FEATURES_STUDY_DEMO}
INCOME = "annual_income"


# ---------------------------------------------------------------- splits
def hash_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42,
               out: str = "split") -> DataFrame:
    """SPL-01: 'test' when md5-bucket(key) < buckets * test_size, else 'train',
    with 100 buckets for whole percents and 10,000 for any other share.
    Membership depends on the key only (stable across runs/partitionings)."""
    n = 100 if abs(test_size * 100 - round(test_size * 100)) < 1e-9 else 10_000
    return df.withColumn(out, F.when(hash_unit(key, seed, n) < int(round(test_size * n)),
                                     "test").otherwise("train"))


def hash_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42,
               out: str = "fold") -> DataFrame:
    """SPL-02: fold id 0..k-1 from a second, independent md5 bucket."""
    return df.withColumn(out, hash_unit(key, f"{seed}|fold", k).cast("int"))


def hash_sample(df: DataFrame, key: str, n: int = 500, seed: int = 42) -> DataFrame:
    """SPL-03: the n rows with the smallest seeded hash (ties -> key); a
    top-k, so each task keeps only n candidates."""
    return (df.withColumn("_h", hash_rank_key(key, seed))
            .orderBy("_h", key).limit(n).drop("_h"))


# ---------------------------------------------------------------- encodings
def group_means(df: DataFrame, key: str, target: str = INCOME) -> DataFrame:
    """(key string, mean double, n bigint); the key is cast to text."""
    return (df.groupBy(F.col(key).cast("string").alias(key))
            .agg(exact_mean(target).alias("mean"), F.count("*").alias("n")))


def target_encode(df: DataFrame, means: DataFrame, key: str, out: str,
                  fallback=None) -> DataFrame:
    """JOIN-03: left lookup of the key's mean; a miss takes the unweighted
    mean of the group means (not the row mean); an empty table gives 0.0.
    The fallback is one scalar aggregate over the bounded means table,
    joined as a one-row broadcast rather than collected."""
    if fallback is None:
        fb = means.agg(F.coalesce(F.avg("mean"), F.lit(0.0)).alias("_fb"), F.lit(0).alias("_k"))
        j = df.withColumn("_k", F.lit(0)).join(one_row(fb), "_k").drop("_k")
        return lookup_with_default(j, means, key, "mean", out, F.col("_fb")).drop("_fb")
    return lookup_with_default(df, means, key, "mean", out, fallback)


def with_group_mean(df: DataFrame, key: str, out: str, target: str = INCOME) -> DataFrame:
    """WIN-01: the group mean on every row. Written as a partial+final
    aggregate joined back (bounded by key cardinality, size-checked
    broadcast) instead of ``avg().over(partitionBy(key))``, which would put
    a hot key's rows in one task."""
    m = df.groupBy(key).agg(exact_mean(target).alias(out))
    return df.join(m, key, "left")


def engineer(df: DataFrame, education: DataFrame, regions: DataFrame,
             occ_means: DataFrame | None = None, state_means: DataFrame | None = None,
             occupation: str = "occupation", state: str = "state",
             unknown_region_code: int = 0) -> DataFrame:
    """FEA-01..05: education ordinal, gender binary, region label and code,
    occupation and state mean income (train-only tables when given, else
    the frame's own means).

    ``education``: (education_level, education_ord); ``regions``: (state,
    region, region_code)."""
    out = df
    if "education_ord" in out.columns:
        out = out.drop("education_ord")
    out = lookup(out, education.select("education_level", "education_ord"), "education_level")
    out = out.withColumn("gender_bin", F.coalesce((F.col("gender") == "Male").cast("int"),
                                                  F.lit(0)))
    for c in ("region", "region_code"):
        if c in out.columns:
            out = out.drop(c)
    out = lookup(out, regions.select(state, "region", "region_code"), state)
    out = out.withColumn("region_code", F.coalesce("region_code", F.lit(unknown_region_code)))
    if occ_means is not None:
        out = target_encode(out, occ_means, occupation, "occ_mean_income")
    else:
        out = with_group_mean(out, occupation, "occ_mean_income")
    if state_means is not None:
        out = target_encode(out, state_means, state, "state_mean_income")
    else:
        out = with_group_mean(out, state, "state_mean_income")
    return out


def prepare_split(df: DataFrame, education: DataFrame, regions: DataFrame, key: str,
                  test_size: float = 0.2, seed: int = 42, keep=None) -> tuple[DataFrame, DataFrame, dict]:
    """LEAK-01: split first, means from train only, engineer both sides.
    ``keep(frame)`` writes the split and the means, which are read several times."""
    keep = keep or (lambda d: d)
    s = keep(hash_split(df, key, test_size, seed))
    train = s.where("split = 'train'").drop("split")
    test = s.where("split = 'test'").drop("split")
    means = {"occ": keep(group_means(train, "occupation")), "state": keep(group_means(train, "state"))}
    eng = lambda d: engineer(d, education, regions, means["occ"], means["state"])
    return eng(train), eng(test), means


def leakage_gap(train_means: DataFrame, full_means: DataFrame, key: str) -> DataFrame:
    """LEAK-02/JOIN-10: per shared key, |train mean - full mean|."""
    a = train_means.select(F.col(key), F.col("mean").alias("train_mean"))
    b = full_means.select(F.col(key), F.col("mean").alias("full_mean"))
    return a.join(b, key, "inner").withColumn("abs_gap", F.abs(F.col("train_mean")
                                                              - F.col("full_mean")))


def oof_target_encoding(df: DataFrame, key: str, fold: str = "fold", target: str = INCOME,
                        out: str = "oof_mean") -> DataFrame:
    """FEA-06: out-of-fold mean = (key sum - fold sum) / (key n - fold n);
    a key seen only in its own fold falls back to the unweighted mean of
    the out-of-fold group means' source (the key means). Two small
    aggregates joined back; one shuffle each."""
    per_kf = df.groupBy(key, fold).agg(F.sum(target).alias("_sf"), F.count("*").alias("_nf"))
    per_k = per_kf.groupBy(key).agg(F.sum("_sf").alias("_s"), F.sum("_nf").alias("_n"))
    fb = per_k.agg(F.avg(F.col("_s") / F.col("_n")).alias("_fb"), F.lit(0).alias("_k"))
    enc = (per_kf.join(per_k, key)
           .withColumn(out, F.when(F.col("_n") > F.col("_nf"),
                                   (F.col("_s") - F.col("_sf")) / (F.col("_n") - F.col("_nf"))))
           .select(key, fold, out))
    j = df.join(enc, [key, fold], "left")
    j = j.withColumn("_k", F.lit(0)).join(one_row(fb), "_k").drop("_k")
    return j.withColumn(out, F.coalesce(out, "_fb")).drop("_fb")


def log_target(df: DataFrame, target: str = INCOME, out: str = "label") -> DataFrame:
    """FEA-07: log1p target."""
    return df.withColumn(out, F.log1p(target))


def premium_label(df: DataFrame, threshold: float = dims.PREMIUM_THRESHOLD,
                  target: str = INCOME, out: str = "premium") -> DataFrame:
    """FEA-10: 1.0 when income >= threshold."""
    return df.withColumn(out, (F.col(target) >= threshold).cast("double"))


def recombine(train: DataFrame, test: DataFrame) -> DataFrame:
    """SET-01: train and test back together (by column name)."""
    return train.unionByName(test, allowMissingColumns=True)
