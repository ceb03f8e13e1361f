"""Named queries over the supplied tables, each with an independent SQL statement where SQL can say it."""

from premiumscope.catalogue import (  # noqa: F401  (importing registers the queries)
    q_encode,
    q_impact,
    q_models,
    q_scores,
    q_select,
    q_sources,
    q_triage,
)
from premiumscope.catalogue.registry import REGISTRY

__all__ = ["REGISTRY"]
