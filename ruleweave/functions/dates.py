"""Partial dates (YYYY, YYYY-MM, YYYY-MM-DD) as intervals of days, and the status a rule has on a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTIAL = r"^\d{4}(-(0[1-9]|1[0-2])(-\d{2})?)?$"


def date_floor(partial: Column) -> Column:
    """First day a partial date can mean; null if it is none."""
    full = F.when(F.length(partial) == 4, F.concat(partial, F.lit("-01-01"))).when(F.length(partial) == 7, F.concat(partial, F.lit("-01"))).otherwise(partial)
    return F.when(partial.rlike(PARTIAL), full.try_cast("date"))


def date_ceil(partial: Column) -> Column:
    """Last day a partial date can mean; null if it is none."""
    first = date_floor(partial)
    return F.when(F.length(partial) == 4, F.make_date(F.year(first), F.lit(12), F.lit(31))).when(F.length(partial) == 7, F.last_day(first)).otherwise(first)


def valid_partial_date(partial: Column) -> Column:
    """Whether the text is a real partial date; false for null."""
    return F.coalesce(date_floor(partial).isNotNull(), F.lit(False))


def is_full_date(partial: Column) -> Column:
    return F.coalesce((F.length(partial) == 10) & date_floor(partial).isNotNull(), F.lit(False))


def minus_months(day: Column, months: Column) -> Column:
    """The day so many whole months before, held to the month's last day."""
    return F.add_months(day, -months)


def status_on(legal_status: Column, enacted: Column, effective: Column, repeal: Column, as_of: Column) -> Column:
    """failed, pending, not_yet_effective or in_force on a date; the others are days, and the order of tests matters."""
    after = lambda day: F.coalesce(day > as_of, F.lit(False))
    return (
        F.when(legal_status == "failed", "failed")
        .when((legal_status == "pending") | after(enacted), "pending")
        .when(F.coalesce(repeal <= as_of, F.lit(False)), "failed")
        .when(after(effective), "not_yet_effective")
        .otherwise("in_force")
    )


def derive_status(legal_status: Column, enacted: Column, effective: Column, repeal: Column, as_of: Column) -> Column:
    """The status on a date of a rule with partial dates; each counts from its first day."""
    return status_on(legal_status, date_floor(enacted), date_floor(effective), date_floor(repeal), as_of)
