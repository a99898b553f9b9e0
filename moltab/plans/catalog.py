"""Import every query family so the registry is complete."""

from moltab.plans import q_metrics  # noqa: F401
from moltab.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
from moltab.plans import q_columns  # noqa: F401,E402
from moltab.plans import q_scaling  # noqa: F401,E402
from moltab.plans import q_fingerprints  # noqa: F401,E402
from moltab.plans import q_reports  # noqa: F401,E402
from moltab.plans import q_models  # noqa: F401,E402
