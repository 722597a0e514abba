"""Named queries over the given tables, each with its SQL statement where SQL can express it."""

import importlib
import pkgutil

from reliaspan.catalog.registry import ORACLES, QUERIES


def load_catalog():
    """Import every query module once and return (queries, SQL statements)."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module}")
    return QUERIES, ORACLES
