"""All registered queries over the driver tables."""

from tessera.plans import building, evaluation, explain, governance, intent, keeping, policies, requests, requirements, retrieval, review, rules, studies  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
