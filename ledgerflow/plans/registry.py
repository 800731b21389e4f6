"""Names, queries and SQL of the finance operators, filled by the query modules of this package when load() imports them."""

from __future__ import annotations

#: Results that are compared across engines are rounded after this part of a unit is added, so that
#: exact halves, which engines' sums put on either side, round alike.
NUDGE = 0.00123


def nudged(sql: str) -> str:
    """sql with NUDGE units of the last digit added within each round(value, digits)."""
    out, i = "", 0
    while (j := sql.find("round(", i)) >= 0:
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        value, _, digits = sql[j + 6 : k - 1].rpartition(",")
        out += sql[i:j] + f"round(({nudged(value)}) + {NUDGE * 10.0 ** -int(digits)!r}, {digits.strip()})"
        i = k
    return out + sql[i:]


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    """Decorator: the query (spark, sf_dir) -> DataFrame under this name, with its SQL if it has one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = nudged(sql)
        return f

    return add


def load() -> None:
    """Imports every query module, which registers what it holds."""
    import importlib
    import pkgutil

    from .. import plans

    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{plans.__name__}.{module.name}")
