"""The registered queries and their SQL twins, one module per family."""

from . import people, relations, sources, texts  # noqa: F401
from .star import ORACLE_SQL, QUERIES  # noqa: F401
