"""Column helpers for names, paths, revisions and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the prefix that marks an event as a benchmark phase.
PHASE_PREFIX = "benchmark:"


def is_phase(event_type: Column) -> Column:
    return event_type.startswith(PHASE_PREFIX)


def phase_name(event_type: Column) -> Column:
    """The phase an event marks; null for an ordinary event."""
    return F.when(is_phase(event_type), F.substring(event_type, len(PHASE_PREFIX) + 1, 1 << 30))


def span_key(start_phase: Column, end_phase: Column, event_type: Column) -> Column:
    """``start:end:event`` with an absent phase printed as None."""
    none = F.lit("None")
    return F.concat_ws(":", F.coalesce(start_phase, none), F.coalesce(end_phase, none), event_type)


def measurement(
    start_phase: Column, end_phase: Column, event_type: Column, *, cut_ten: bool = False
) -> Column:
    """Name of a measurement: the event type.

    ``cut_ten`` reproduces the older naming, which drops ten characters of the
    span key and so also cuts into names that were measured inside a phase.
    """
    if cut_ten:
        return F.substring(span_key(start_phase, end_phase, event_type), 11, 1 << 30)
    return event_type


def short_revision(revision: Column) -> Column:
    return F.substring(revision, 1, 7)


def date_label(epoch_seconds: Column) -> Column:
    """``20160131 23:59:59`` in the session time zone."""
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyyMMdd HH:mm:ss")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def without_extension(name: Column) -> Column:
    """Drop the last extension; a leading dot does not start one."""
    return F.regexp_replace(name, r"(?<=[^/.])\.[^./]*$", "")


def path_order(path: Column) -> Column:
    """Sort key equal to a sorted depth-first walk over directories."""
    return F.split(path, "/")
