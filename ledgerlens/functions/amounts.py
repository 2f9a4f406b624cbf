"""Money, ratios and rounding.

Amounts are stored as doubles and added up as whole numbers of hundredths of a cent.
A sum of whole numbers does not depend on the order in which partitions arrive, which
a sum of doubles does. Sums are kept in two long counters, so that they cost what a
long sum costs, several times less than a decimal one, and cannot overflow. An amount too
large for a double to hold as such a number is added up as the decimal it is written as.

Between layers amounts are carried as decimals: a sum goes on as a decimal to the next
sum, and only the outermost select makes it a double (``number``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PER_UNIT = 10_000
#: Below this a double times ``PER_UNIT`` is still a whole number without a gap.
EXACT_BELOW = 2.0**53 / PER_UNIT
#: The type of carried amounts.
CARRIED = "decimal(38,4)"
_PLACES = "0.0001"
_LOW_BITS = 20


def _column(amount: Column | str) -> Column:
    return F.col(amount) if isinstance(amount, str) else amount


def exact_unit_sum(whole: Column) -> Column:
    """Exact sum of whole numbers of hundredths of a cent as an amount with four places; null
    for an empty group.

    The low 20 bits and the rest are added up apart: that leaves room for 2^43 rows of
    a key, where one long counter could overflow on a key with very many rows.
    """
    high = F.sum(F.shiftright(whole, _LOW_BITS)).cast("decimal(20,0)")
    low = F.sum(whole.bitwiseAND(F.lit((1 << _LOW_BITS) - 1)))
    return (high * (1 << _LOW_BITS) + low) * F.lit(_PLACES).cast("decimal(4,4)")


def exact_sum(amount: Column | str) -> Column:
    """Exact sum of amounts, doubles or carried, with four places; null for an empty group."""
    given = _column(amount)
    small = F.abs(given) < F.lit(EXACT_BELOW)
    smalls = exact_unit_sum(F.when(small, F.rint(given * PER_UNIT).cast("bigint")))
    larges = F.sum(F.when(~small, given.cast(CARRIED)))
    return F.coalesce(smalls + larges, smalls, larges).cast(CARRIED)


def total(amount: Column | str) -> Column:
    """Exact sum of amounts, 0 for an empty group, rounded half up to cents."""
    return F.round(F.coalesce(exact_sum(amount), F.lit(0)), 2)


def exact(amount: Column | str) -> Column:
    """One amount as a decimal, for arithmetic within a row."""
    return _column(amount).cast(CARRIED)


def cents(amount: Column | str) -> Column:
    """A double rounded to the nearest cent; one so large that its neighbours lie more than a
    cent apart stays."""
    given = _column(amount)
    return F.when(F.abs(given) < F.lit(100 * EXACT_BELOW), F.rint(given * 100) / 100).otherwise(given)


def number(amount: Column) -> Column:
    """Back to the public type."""
    return amount.cast("double")


def divide(numerator: Column, denominator: Column) -> Column:
    """Division that gives null, not an error, for a zero divisor."""
    return numerator / F.nullif(denominator, F.lit(0).cast("double"))


def monthly(arr: Column) -> Column:
    """A twelfth of an annual amount in cents, rounded half up."""
    return F.round(exact(arr) / F.lit(12), 2)


def margin_pct(billed: Column, cost: Column) -> Column:
    """Gross margin in percent of billed revenue; null without billing."""
    return divide(number(billed) - number(cost), number(billed)) * 100


def change_pct(first: Column, last: Column) -> Column:
    """Relative change from first to last in percent; null when first is 0."""
    return (divide(last, first) - 1) * 100
