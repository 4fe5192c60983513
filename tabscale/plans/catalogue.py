"""Imports every family module, which fills the registry."""

from . import (  # noqa: F401
    cleaning_queries,
    explain_queries,
    forest_queries,
    model_queries,
    preparation_queries,
    profile_queries,
    score_queries,
    source_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
