"""All registered queries."""

from workload import cleaning, deciding, joining, repairing, reporting  # noqa: F401
from workload.base import REGISTRY

__all__ = ["REGISTRY"]
