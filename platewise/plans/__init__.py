"""Query catalogue; importing this package registers every query."""

from platewise.plans import registry
from platewise.plans import bo_q, clean_q, features_q, graph_q, history_q, model_q, results_q, sources_q, stats_q  # noqa: F401

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
