"""Positions and shapes of ranges: A1 and R1C1 text, and what needs only a range's corners."""

from __future__ import annotations

import re
from dataclasses import dataclass

_A1 = re.compile(r"^(?:(?:'((?:[^']|'')+)'|([A-Za-z_][\w.]*))!)?\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?$")

_R1C1 = re.compile(r"^R([1-9]\d*)C([1-9]\d*)(?::R([1-9]\d*)C([1-9]\d*))?$", re.IGNORECASE)


def column_index(letters: str) -> int:
    """1 for A, 27 for AA."""
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n


def letters_of(index: int) -> str:
    """The inverse of column_index."""
    out = ""
    while index > 0:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


@dataclass(frozen=True)
class Range:
    """A rectangle of cells, corners in order, both from 1."""

    first_row: int
    first_col: int
    last_row: int
    last_col: int
    sheet: str | None = None

    @classmethod
    def of(cls, text: str) -> Range:
        """From A1 text, a single cell or two corners in any order, with a sheet perhaps."""
        m = _A1.match(text.strip())
        if not m:
            raise ValueError(f"not a range: {text!r}")
        quoted, plain, c1, r1, c2, r2 = m.groups()
        rows = sorted((int(r1), int(r2 or r1)))
        cols = sorted((column_index(c1), column_index(c2 or c1)))
        if rows[0] < 1 or cols[1] > 16384 or rows[1] > 1048576:
            raise ValueError(f"out of the sheet: {text!r}")
        return cls(rows[0], cols[0], rows[1], cols[1], quoted.replace("''", "'") if quoted else plain)

    def a1(self) -> str:
        one = f"{letters_of(self.first_col)}{self.first_row}"
        two = f"{letters_of(self.last_col)}{self.last_row}"
        return one if one == two else f"{one}:{two}"

    def r1c1(self) -> str:
        one, two = f"R{self.first_row}C{self.first_col}", f"R{self.last_row}C{self.last_col}"
        return one if one == two else f"{one}:{two}"

    @classmethod
    def of_r1c1(cls, text: str) -> Range:
        """From R1C1 text, a single cell or two corners in any order."""
        m = _R1C1.match(text.strip())
        if not m:
            raise ValueError(f"not a range: {text!r}")
        r1, c1, r2, c2 = m.groups()
        rows, cols = sorted((int(r1), int(r2 or r1))), sorted((int(c1), int(c2 or c1)))
        return cls.of(f"{letters_of(cols[0])}{rows[0]}:{letters_of(cols[1])}{rows[1]}")

    def ROW(self) -> int:
        return self.first_row

    def COLUMN(self) -> int:
        return self.first_col

    def ROWS(self) -> int:
        return self.last_row - self.first_row + 1

    def COLUMNS(self) -> int:
        return self.last_col - self.first_col + 1

    def AREAS(self) -> int:
        return 1

    def transposed(self) -> Range:
        return Range(self.first_row, self.first_col, self.first_row + self.COLUMNS() - 1, self.first_col + self.ROWS() - 1, self.sheet)

    def moved(self, rows: int, cols: int) -> Range:
        return Range(self.first_row + rows, self.first_col + cols, self.last_row + rows, self.last_col + cols, self.sheet)

    def bounds(self) -> tuple[int, int, int, int]:
        """As the arguments of quillgrid.operators.reshape."""
        return self.first_row, self.first_col, self.last_row, self.last_col
