"""earnlens: earnings-cohort analytics written as Spark DataFrame / SQL / ML /
Structured Streaming jobs.

Sub-packages
------------
sources    readers, writers, dimension tables and the test-table views
functions  Column-level helpers (text, hashing, metric expressions, CDFs)
operators  DataFrame -> DataFrame operators (cleaning, exploration,
           statistics, features, evaluation, benchmarks, scoring, drift)
modeling   Spark ML fitting: quantile booster, classifier, baselines, search
plans      the registered queries and their SQL oracles
streaming  Structured Streaming monitors and scorers
"""

__version__ = "0.1.0"
