"""All queries of this package, and the SQL that checks those SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ["quality", "boilerplate", "language", "residue", "subjects", "spam", "neardup", "packing", "mixing", "encoding"]

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    try:
        _module = import_module(f"{__package__}.{_name}")
    except ModuleNotFoundError as missing:
        if missing.name != f"{__package__}.{_name}":
            raise
        continue
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
