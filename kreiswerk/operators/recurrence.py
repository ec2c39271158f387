"""Expansion of calendar recurrence rules into wall-clock starts, one row at a time in the JVM.

Supported: FREQ=DAILY, WEEKLY, MONTHLY or YEARLY with INTERVAL, COUNT, UNTIL, WKST, BYDAY (with
ordinals within a month), BYMONTHDAY, BYMONTH and, for months and years, BYSETPOS. Other parts are
reported by ``rule_problem``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col, let
from ..functions.times import safe_zone

_PARTS = r"(?:FREQ|INTERVAL|COUNT|UNTIL|WKST|BYDAY|BYMONTHDAY|BYMONTH|BYSETPOS)"
_DAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
_FAR = 10_000_000
_NO_DAYS = lambda: F.array().cast("array<date>")


def rule_problem(rule: Column | str) -> Column:
    """Why a rule cannot be expanded; null when it can, or when there is no rule."""
    rule = col(rule)
    freq = _part(rule, "FREQ")
    return (
        F.when(rule.isNull(), F.lit(None))
        .when(~F.coalesce(freq.isin("DAILY", "WEEKLY", "MONTHLY", "YEARLY"), F.lit(False)), F.lit("unsupported frequency"))
        .when(~rule.rlike(rf"^(?:{_PARTS}=[^;=]+;?)+$"), F.lit("unsupported rule part"))
        .when(
            F.coalesce(_part(rule, "BYDAY").rlike("[0-9]"), F.lit(False))
            & ~((freq == "MONTHLY") | ((freq == "YEARLY") & _part(rule, "BYMONTH").isNotNull())),
            F.lit("ordinal weekday outside a month"),
        )
        .when(
            freq.isin("DAILY", "WEEKLY") & _part(rule, "BYSETPOS").isNotNull(),
            F.lit("set position in a daily or weekly rule"),
        )
        .cast("string")
    )


def occurrence_starts(
    start: Column | str,
    rule: Column | str,
    zone: Column | str,
    extra: Column | str,
    excluded: Column | str,
    until: Column,
) -> Column:
    """Wall-clock starts of an entry up to the day after ``until``, ascending.

    Exclusions are taken out after the rule was counted, as the calendar format demands.
    """
    start, rule = col(start), col(rule)
    from_rule = F.when(rule.isNull(), F.array(start)).otherwise(_expand(start, rule, col(zone), until))
    return F.array_sort(F.array_except(F.array_union(from_rule, col(extra)), col(excluded)))


def _part(rule: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(rule, f"(?:^|;){name}=([^;]*)", 1), F.lit(""))


def _list(rule: Column, name: str) -> Column:
    return F.coalesce(F.split(_part(rule, name), ","), F.array().cast("array<string>"))


def _expand(start: Column, rule: Column, zone: Column, until: Column) -> Column:
    """Days the rule selects from the start on, at the start's time of day."""
    facts = F.struct(
        F.to_date(start).alias("day"),
        _part(rule, "FREQ").alias("freq"),
        F.greatest(F.coalesce(_part(rule, "INTERVAL").try_cast("int"), F.lit(1)), F.lit(1)).alias("interval"),
        _part(rule, "COUNT").try_cast("int").alias("count"),
        _until_wall(rule, start, zone).alias("until"),
        _list(rule, "BYDAY").alias("by_day"),
        _numbers(rule, "BYMONTHDAY").alias("by_month_day"),
        _numbers(rule, "BYMONTH").alias("by_month"),
        _numbers(rule, "BYSETPOS").alias("by_set_pos"),
        F.coalesce(F.array_position(_strings(_DAYS), _part(rule, "WKST")) - 1, F.lit(0)).cast("int").alias("week_start"),
    )

    def expand(r: Column) -> Column:
        horizon = F.date_add(until, 1)
        last = F.least(F.coalesce(F.to_date(r["until"]), horizon), horizon)
        days = F.when(last >= r["day"], _days(r, last)).otherwise(_NO_DAYS())
        chosen = F.filter(days, lambda d: (d >= r["day"]) & (d <= last) & _listed(r["by_month"], F.month(d)))
        time_of_day = start - F.date_trunc("day", start)
        walls = F.transform(
            F.array_sort(F.array_distinct(chosen)), lambda d: (d.cast("timestamp_ntz") + time_of_day).cast("timestamp_ntz")
        )
        within = F.filter(walls, lambda w: r["until"].isNull() | (w <= r["until"]))
        return F.when(r["count"].isNull(), within).otherwise(F.slice(within, 1, F.greatest(r["count"], F.lit(0))))

    return let(facts, expand)


def _days(r: Column, last: Column) -> Column:
    """Candidate days of a rule, stepping by its interval; later filters cut them to the range."""
    first, interval = r["day"], r["interval"]
    unlisted = (F.size(r["by_day"]) == 0) & (F.size(r["by_month_day"]) == 0) & (F.size(r["by_month"]) == 0)
    steps = lambda unit: F.when(unlisted & r["count"].isNotNull(), unit * interval * r["count"])

    def daily() -> Column:
        span = F.least(F.datediff(last, first), F.coalesce(steps(1), F.lit(_FAR)))
        days = F.transform(F.sequence(F.lit(0), span, interval), lambda i: F.date_add(first, i))
        return F.filter(days, lambda d: _on_weekday(r, d) & _on_month_day(r, d))

    def weekly() -> Column:
        in_week = lambda weekday: F.pmod(weekday - r["week_start"], F.lit(7)).cast("int")
        begin = F.date_sub(first, in_week(F.weekday(first)))
        named = F.transform(r["by_day"], lambda name: in_week(F.array_position(_strings(_DAYS), name) - 1))
        offsets = F.when(F.size(r["by_day"]) > 0, named).otherwise(F.array(in_week(F.weekday(first))))
        span = F.least(F.datediff(last, begin), F.coalesce(steps(7), F.lit(_FAR)))
        weeks = F.sequence(F.lit(0), span, interval * 7)
        return F.flatten(F.transform(weeks, lambda w: F.transform(offsets, lambda o: F.date_add(begin, w + o))))

    def monthly() -> Column:
        begin = F.trunc(first, "month")
        span = (F.year(last) - F.year(begin)) * 12 + F.month(last) - F.month(begin)
        months = F.transform(F.sequence(F.lit(0), span, interval), lambda i: F.add_months(begin, i))
        listed = (F.size(r["by_day"]) > 0) | (F.size(r["by_month_day"]) > 0)
        in_month = lambda m: F.when(listed, _listed_days(r, m)).otherwise(
            _month_days(m, F.array(F.dayofmonth(first)))
        )
        return F.flatten(F.transform(months, lambda m: _at_positions(r, in_month(m))))

    def yearly() -> Column:
        begin = F.trunc(first, "year")
        years = F.sequence(F.lit(0), F.year(last) - F.year(begin), interval)
        listed = (F.size(r["by_day"]) > 0) | (F.size(r["by_month_day"]) > 0)
        months = (
            F.when(F.size(r["by_month"]) > 0, F.array_sort(F.array_distinct(r["by_month"])))
            .when(listed, F.sequence(F.lit(1), F.lit(12)))
            .otherwise(F.array(F.month(first)))
        )
        in_month = lambda m: F.when(listed, _listed_days(r, m)).otherwise(
            _month_days(m, F.array(F.dayofmonth(first)))
        )
        in_year = lambda y: F.flatten(
            F.transform(months, lambda m: in_month(F.add_months(begin, y * 12 + m - 1)))
        )
        return F.flatten(F.transform(years, lambda y: _at_positions(r, in_year(y))))

    return (
        F.when(r["freq"] == "DAILY", daily())
        .when(r["freq"] == "WEEKLY", weekly())
        .when(r["freq"] == "MONTHLY", monthly())
        .otherwise(yearly())
    )


def _month_days(month: Column, numbers: Column) -> Column:
    """Days of a month by number; negative ones count from its end, missing ones are left out."""
    length = F.dayofmonth(F.last_day(month))
    positive = F.transform(numbers, lambda n: F.when(n < 0, length + n + 1).otherwise(n))
    return F.transform(F.filter(positive, lambda n: n.between(1, length)), lambda n: F.date_add(month, n - 1))


def _listed_days(r: Column, month: Column) -> Column:
    """Days of a month on the listed weekdays and of the listed numbers, ascending."""
    return F.filter(F.sequence(month, F.last_day(month)), lambda d: _on_ordinal(r, d) & _on_month_day(r, d))


def _at_positions(r: Column, days: Column) -> Column:
    """The days of one month or year at the listed positions, negative ones from the end; all without any."""
    places = F.filter(r["by_set_pos"], lambda p: p != 0)
    taken = F.array_compact(F.transform(places, lambda p: F.try_element_at(days, p)))
    return F.when(F.size(r["by_set_pos"]) == 0, days).otherwise(taken)


def _on_weekday(r: Column, day: Column) -> Column:
    return _listed(r["by_day"], F.element_at(_strings(_DAYS), F.weekday(day) + 1))


def _on_month_day(r: Column, day: Column) -> Column:
    from_end = F.dayofmonth(day) - F.dayofmonth(F.last_day(day)) - 1
    return _listed(r["by_month_day"], F.dayofmonth(day)) | _listed(r["by_month_day"], from_end)


def _on_ordinal(r: Column, day: Column) -> Column:
    """Weekday by name, or by name with its place in the month counted from either end."""
    name = F.element_at(_strings(_DAYS), F.weekday(day) + 1)
    nth = F.floor((F.dayofmonth(day) - 1) / 7).cast("int") + 1
    from_end = F.floor((F.dayofmonth(F.last_day(day)) - F.dayofmonth(day)) / 7).cast("int") + 1
    forms = [name] + [F.concat(F.lit(sign), n.cast("string"), name) for sign, n in (("", nth), ("+", nth), ("-", from_end))]
    return (F.size(r["by_day"]) == 0) | F.arrays_overlap(r["by_day"], F.array(*forms))


def _listed(values: Column, value: Column) -> Column:
    """Whether a list is empty or holds the value."""
    return (F.size(values) == 0) | F.array_contains(values, value)


def _numbers(rule: Column, name: str) -> Column:
    return F.array_compact(F.transform(_list(rule, name), lambda n: n.try_cast("int")))


def _until_wall(rule: Column, start: Column, zone: Column) -> Column:
    """UNTIL in the wall clock of the entry; a plain date includes its whole day."""
    value = _part(rule, "UNTIL")
    digits = F.regexp_extract(value, r"^([0-9]{8})", 1)
    clock = F.regexp_extract(value, r"T([0-9]{6})", 1)
    wall = F.try_to_timestamp(
        F.concat(digits, F.when(clock == "", F.lit("235959")).otherwise(clock)), F.lit("yyyyMMddHHmmss")
    )
    shifted = F.when(value.endswith("Z"), F.from_utc_timestamp(wall, safe_zone(zone))).otherwise(wall)
    return shifted.cast("timestamp_ntz")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])
