"""Every query of the engine by name, with the SQL that must give the same rows."""

from loomline.plans import chains, editing, extensions, gate, intervals, signal, text  # noqa: F401
from loomline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
