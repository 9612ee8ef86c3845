"""All registered queries; importing a module below registers its entries."""

from matchgrain.plans import q_aggs, q_grids, q_joins, q_ledger, q_markets, q_models, q_quality, q_scalars, q_sources, q_streams, q_windows  # noqa: F401
from matchgrain.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
