"""The query catalogue."""

from factloom.plans import catalog


def all_queries():
    from factloom.plans import base, files  # noqa: F401  registers on import

    return catalog.QUERIES


def all_oracles():
    from factloom.plans import base, files  # noqa: F401

    return catalog.ORACLES
