"""All registered queries; importing this package fills the registry."""

import importlib
import pkgutil

from slotwise.queries.base import REGISTRY

for _module in pkgutil.iter_modules(__path__):
    if _module.name != "base":
        importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["REGISTRY"]
