"""Residues and checks of big integers held as decimal strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default modulus bank.
MODULI = (7, 9, 11, 13, 37, 101)


def digits_mod(digits: Column, m: int | Column) -> Column:
    """A decimal string of any length modulo m; a leading minus gives the non-negative residue."""
    m = F.lit(m) if isinstance(m, int) else m
    body = F.regexp_replace(digits, "^[-+]", "")
    folded = F.aggregate(F.split(body, ""), F.lit(0).cast("long"), lambda a, d: F.pmod(a * 10 + F.coalesce(d.try_cast("long"), F.lit(0).cast("long")), m.cast("long")))
    return F.when(digits.startswith("-"), F.pmod(-folded, m.cast("long"))).otherwise(folded)


def product_mod(values: Column, m: int) -> Column:
    """The product of an array of integers modulo m, folded residue by residue."""
    return F.aggregate(values, F.lit(1).cast("long"), lambda a, v: F.pmod(a * F.pmod(v.cast("long"), F.lit(m).cast("long")), F.lit(m).cast("long")))


def fingerprint(digits: Column, moduli: tuple[int, ...] = MODULI) -> Column:
    """Residues of a decimal string, by modulus."""
    return F.create_map(*(x for m in moduli for x in (F.lit(m), digits_mod(digits, m))))


def disagreeing(expected: Column, claimed: Column, moduli: tuple[int, ...] = MODULI) -> Column:
    """The moduli on which two fingerprints differ."""
    return F.filter(F.array(*map(F.lit, moduli)), lambda m: F.element_at(expected, m) != F.element_at(claimed, m))


def verdict(disagree: Column) -> Column:
    """One-sided: a disagreement rules out; agreement proves nothing."""
    return F.when(F.size(disagree) > 0, "RULED_OUT_WRONG").otherwise("NOT_RULED_OUT")


def digital_root(n: Column) -> Column:
    return F.when(n == 0, F.lit(0)).otherwise(1 + F.pmod(F.abs(n) - 1, F.lit(9)))
