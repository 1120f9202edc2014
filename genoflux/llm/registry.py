"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from importlib import import_module

_MODULES = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _n in _MODULES:
    _m = import_module(f"genoflux.llm.op{_n:02d}")
    for _name in [x for x in vars(_m) if x.startswith(f"op{_n}_")]:
        QUERIES[_name] = getattr(_m, _name)
        if getattr(_m, "SQL", None):
            ORACLE_SQL[_name] = _m.SQL
