"""Functions by their spreadsheet names. Custom ones are added by name and may replace built-in ones."""

from __future__ import annotations

from collections.abc import Callable

from quillgrid.functions import dates, logic, mathematics, strings
from quillgrid.functions.cells import NAME, Cell, error

#: Where the Python name differs from the spreadsheet's.
_RENAMED = {
    "CEILING.MATH": "CEILING_MATH", "FLOOR.MATH": "FLOOR_MATH", "BINOM.DIST": "BINOM_DIST", "BINOMDIST": "BINOM_DIST",
    "ERROR.TYPE": "ERROR_TYPE", "VALUE": "VALUE_OF", "NA": "NA_VALUE", "INDEX": "INDEX_OF",
}


class Registry:
    """Case-insensitive table of functions that take and return cells."""

    def __init__(self) -> None:
        self._table: dict[str, Callable[..., Cell]] = {}
        for module in (mathematics, strings, dates, logic):
            for name, f in vars(module).items():
                if name.isupper() and callable(f) and not name.startswith("_"):
                    self._table[name] = f
        for name, own in _RENAMED.items():
            self._table[name] = self._table[own]

    def register(self, name: str, f: Callable[..., Cell]) -> None:
        self._table[name.upper()] = f

    def names(self) -> list[str]:
        return sorted(self._table)

    def call(self, name: str, *args) -> Cell:
        """The function's cell; an unknown name is #NAME?, a wrong number of arguments #VALUE!."""
        f = self._table.get(name.upper())
        if f is None:
            return error(NAME)
        try:
            return f(*args)
        except TypeError as problem:
            if "argument" in str(problem):
                return error("#VALUE!")
            raise
