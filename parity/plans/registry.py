"""All registered queries of the library and their SQL; importing a module of queries registers them."""

from . import compare, corpus, io, relational, scalars  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
