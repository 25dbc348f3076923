"""All registered queries."""

from . import analytics, core, extras, files, more  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
