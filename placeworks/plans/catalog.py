"""The registered queries over the star-schema tables, each with its SQL."""

from . import demographics, enrolment, exposure, grids, network, proximity, records, surfaces  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
