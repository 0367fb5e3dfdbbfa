"""What a search line asks for: words, bounds of the amount, or a number that may be either."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"(?:nt)?\$?([0-9][0-9,]*(?:\.[0-9]+)?)"
_BOUND = re.compile(rf"(>=|<=|>|<|=)\s*{_NUMBER}", re.I)
_RANGE = re.compile(rf"{_NUMBER}(?:-|~|\.\.)(?:{_NUMBER})", re.I)


@dataclass(frozen=True)
class Search:
    """``text`` in lower case; ``bounds`` of the absolute amount, all of which must hold; ``either``: the text or the amount."""

    text: str
    bounds: tuple[tuple[str, float], ...] = ()
    either: bool = False

    @classmethod
    def of(cls, line: str) -> Search:
        line = unicodedata.normalize("NFKC", line).strip()
        value = lambda x: float(x.replace(",", ""))
        bounds: list[tuple[str, float]] = []
        words: list[str] = []
        # an operator may stand apart from its number
        for token in re.sub(r"(>=|<=|>|<|=)\s+(?=[0-9$n])", r"\1", line, flags=re.I).split():
            if m := _BOUND.fullmatch(token):
                bounds.append((m[1], value(m[2])))
            elif m := _RANGE.fullmatch(token):
                low, high = sorted((value(m[1]), value(m[2])))
                bounds += [(">=", low), ("<=", high)]
            else:
                words.append(token)
        if len(words) == 1 and not bounds and (m := re.fullmatch(_NUMBER, words[0], re.I)):
            return cls(words[0].lower(), (("=", value(m[1])),), True)
        return cls(" ".join(words).lower(), tuple(bounds))

    def amount_fits(self, amount: Column) -> Column:
        size = F.abs(amount).cast("double")
        tests = {">": size.__gt__, ">=": size.__ge__, "<": size.__lt__, "<=": size.__le__, "=": size.__eq__}
        return reduce(Column.__and__, (F.coalesce(tests[op](F.lit(limit)), F.lit(False)) for op, limit in self.bounds), F.lit(True))

    def fits(self, found: Column, amount: Column) -> Column:
        """``found``: whether the row's texts hold the search's text."""
        if self.either:
            return found | self.amount_fits(amount)
        return (found if self.text else F.lit(True)) & self.amount_fits(amount)
