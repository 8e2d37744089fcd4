"""Every query of the library by name, with its SQL."""

from .catalogue import ORACLE, QUERIES
from . import modelling  # noqa: E402,F401  registers its queries

__all__ = ["ORACLE", "QUERIES"]
