"""All queries of the plan modules, with the SQL of those that have one."""

from __future__ import annotations

from lodeworks.plans import analysis, designs, preparation, profiling, structure
from lodeworks.plans.query import ORACLES, QUERIES

MODULES = (profiling, preparation, analysis, designs, structure)
__all__ = ["MODULES", "ORACLES", "QUERIES"]
