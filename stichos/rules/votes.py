"""Votes of a rule for the three dialects, packed into one combination code (R-9)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stichos.functions.text import _col

# Dialects in code order, and their names in external tags.
DIALECTS = ("Ionic", "Aeolic", "Homeric")
EXTERNAL_TAGS = ("ionic", "aeolic", "epic")
N_COMBOS = 3 ** len(DIALECTS)
NEUTRAL = N_COMBOS // 2


def code_of(votes: str) -> int:
    """`IH>A`: Ionic and Homeric yes, Aeolic no; letters left out abstain."""
    yes, no = votes.split(">")
    return sum(((d[0] in yes) - (d[0] in no) + 1) * 3 ** j for j, d in enumerate(DIALECTS))


def encode(votes: list) -> Column:
    """Three votes in -1, 0, 1 to a code 0 ... 26; 13 abstains throughout."""
    return sum(((_col(v) + 1) * 3 ** j for j, v in enumerate(votes)), F.lit(0)).cast("int")


def decode(code, j: int) -> Column:
    """Vote j of a code."""
    return (F.floor(_col(code) / 3 ** j).cast("int") % 3 - 1).cast("int")


def combo_name(code) -> Column:
    """A code in words."""
    said = [F.when(decode(code, j) == 1, f"Definitely {d}").when(decode(code, j) == -1, f"Definitely Not {d}")
            for j, d in enumerate(DIALECTS)]
    return F.when(_col(code) == NEUTRAL, "Any Dialect").otherwise(F.concat_ws(", ", *said))
