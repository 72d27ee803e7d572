"""All registered queries. Importing the plan modules fills the registry."""

from tagtrail.plans import course, files, network, primitives, toll, jobs  # noqa: F401
from tagtrail.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
