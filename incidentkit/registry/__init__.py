"""Named queries over the test tables, each with its SQL twin where SQL can say it."""

from importlib import import_module

from incidentkit.registry.common import ORACLES, QUERIES

FAMILIES = ("sources", "rows", "joins", "aggregates", "windows", "text", "features", "grouping", "series", "office", "streams")


def load():
    for family in FAMILIES:
        import_module(f"incidentkit.registry.{family}")
    return QUERIES, ORACLES
