"""Timetable rules as column expressions: which days a train runs, and which trains carry passengers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Precedence of short-term plans, and day tokens from Monday.
PRECEDENCE = {"C": 4, "O": 3, "N": 2, "P": 1}
DAYS = ("M", "T", "W", "TH", "F", "S", "SU")
#: Fixed value: endpoints that are depots.
DEPOT = r"(?i)(\bdepot\b|\bt\.?m\.?d\b|\be\.?m\.?u\.?d\b|\bh\s*s\s*t\s*d\b|\b(carriage|stabling)\s+(sidings?|sdgs)\b)"
EMPTY_STOCK, BUS_CATEGORIES = ("EE", "EL", "ES", "JJ"), ("BR", "BS")


def runs_on(day: Column, first: Column, last: Column, mask: Column) -> Column:
    """Whether a schedule with a seven-character mask from Monday runs on a day."""
    return day.between(first, last) & (mask.substr(F.weekday(day) + 1, F.lit(1)) == "1")


def token_days(tokens: Column) -> Column:
    """Weekdays (0 Monday) of EWD, or of day letters with a last O (only) or X (excepted, of Monday to Saturday); null on
    any other form, on repeated days, and on Sunday excepted."""
    raw = F.upper(F.trim(tokens))
    body = F.substring(raw, F.lit(1), F.length(raw) - 1)
    marked = F.regexp_replace(F.regexp_replace(body, "TH", "H"), "SU", "U")
    letters = F.filter(F.split(marked, ""), lambda c: c != "")
    days = F.transform(letters, lambda c: F.instr(F.lit("MTWHFSU"), c) - 1)
    good = marked.rlike("^[MTWHFSU]+$") & (F.size(F.array_distinct(letters)) == F.size(letters))
    week = F.array(*[F.lit(i) for i in range(6)])
    return (
        F.when(raw == "EWD", week).when(good & raw.endswith("O"), F.array_sort(days))
        .when(good & raw.endswith("X") & ~F.array_contains(days, 6), F.array_except(week, days))
    )


def timing_exclusion(tid: Column, origin: Column, destination: Column) -> Column:
    """Why a timetable column is no passenger train; null if it is one."""
    first = F.substring(tid, 1, 1)
    return (
        F.when(F.coalesce(tid, F.lit("")) == "", "blank-tid").when(first == "5", "empty-coaching-stock-class").when(first.isin("4", "6", "7"), "freight-train-class")
        .when(~first.isin("1", "2"), "unsupported-train-class").when(origin.rlike(DEPOT) | destination.rlike(DEPOT), "depot-endpoint")
    )


def passenger_exclusion(status: Column, category: Column) -> Column:
    return (
        F.when(status.isin("5", "B"), F.concat(F.lit("bus-train-status:"), status)).when(~status.isin("1", "P"), F.concat(F.lit("non-passenger-train-status:"), F.when(status == "", "blank").otherwise(status)))
        .when(category.isin(*BUS_CATEGORIES), F.concat(F.lit("bus-train-category:"), category)).when(category.isin(*EMPTY_STOCK), F.concat(F.lit("empty-coaching-stock:"), category))
    )


def precedence(stp: Column) -> Column:
    out = F.lit(0)
    for code, rank in PRECEDENCE.items():
        out = F.when(stp == code, rank).otherwise(out)
    return out
