"""Spark ML fitting: quantile booster (MOD-01), classifier and baselines
(MOD-02..09), explanations (EXP-01..04)."""
