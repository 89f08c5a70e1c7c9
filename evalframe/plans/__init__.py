"""Registered queries: each operator on the driver tables, with its SQL twin."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every module here, so that its queries register."""
    for module in iter_modules(__path__):
        import_module(f"{__name__}.{module.name}")
