"""DataFrame -> DataFrame operators. Column names are parameters with the
cohort's names as defaults, so the same operators run on any table of the
right shape."""
