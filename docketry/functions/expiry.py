"""Ages and caps of what is kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """hours: the age up to which a row is kept; cap: how many rows, or cases if per_case."""

    hours: int | None = None
    cap: int | None = None
    per_case: bool = False


# fixed values: the stated retention periods and caps
RULES = {
    "drafts": Rule(7 * 24, 10),
    "case_memory": Rule(14 * 24, 20, per_case=True),
    "analyses": Rule(14 * 24),
    "actions": Rule(30 * 24, 5000),
    "batches": Rule(30 * 24),
    "panel_daily": Rule(180 * 24),
    "notes": Rule(365 * 24, 100, per_case=True),
    "reader_marks": Rule(365 * 24, 400, per_case=True),
    "tag_names": Rule(None, 500),
    "authorizations": Rule(48),
    "remote_files": Rule(48),
    "templates": Rule(),
}


def expires_at(ts: Column, kind: Column) -> Column:
    """The instant from which a row of that kind is no longer kept; null where nothing expires."""
    hours = F.lit(None).cast("int")
    for name, rule in RULES.items():
        if rule.hours is not None:
            hours = F.when(kind == name, F.lit(rule.hours)).otherwise(hours)
    return ts + F.make_dt_interval(hours=hours)


def alive(ts: Column, kind: str, now: Column) -> Column:
    """Whether ts > now - age; a null ts is not alive under a rule with an age."""
    rule = RULES[kind]
    if rule.hours is None:
        return F.lit(True)
    return F.coalesce(ts > now - F.make_dt_interval(hours=F.lit(rule.hours)), F.lit(False))
