"""Imports every query module so the registry is complete."""

from earnlens.plans import analysis_queries  # noqa: F401
from earnlens.plans import explore_queries  # noqa: F401
from earnlens.plans import helper_queries  # noqa: F401
from earnlens.plans import ml_queries  # noqa: F401
from earnlens.plans import model_queries  # noqa: F401
from earnlens.plans import stream_queries  # noqa: F401
from earnlens.plans import trained_queries  # noqa: F401
from earnlens.plans.registry import ORACLE, QUERIES  # noqa: F401
