"""Every registered query of the library, with its SQL where there is one."""

from . import more, names, pipelines, plans, tables
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "more", "names", "pipelines", "plans", "tables"]
