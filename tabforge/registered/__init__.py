"""Queries over the given tables, with their SQL counterparts."""

from importlib import import_module
from pkgutil import iter_modules

from tabforge.registered import base


def _load() -> None:
    for module in iter_modules(__path__):
        import_module(f"{__name__}.{module.name}")


def all_queries() -> dict:
    _load()
    return dict(base.QUERIES)


def all_sql() -> dict:
    _load()
    return dict(base.SQL)
