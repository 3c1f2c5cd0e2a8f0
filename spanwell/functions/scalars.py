"""Column helpers for identifiers, encoded configs, rates and limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte positions of the ids inside binary record keys, and the
# length of an id.
EVENT_WORKER_AT = 11
EVENT_TASK_AT = 32
REGISTRY_WORKER_AT = 9
ID_BYTES = 20

# Fixed value: failures in a row that end a run when no limit is configured.
DEFAULT_FAILURE_LIMIT = 3


def hex_id(key: Column, at: int) -> Column:
    """The id that starts at byte ``at`` (from 1) as lower-case hex."""
    return F.lower(F.hex(F.substring(key, at, ID_BYTES)))


def encode_config(config: Column) -> Column:
    """A struct or map as base64 text of its JSON."""
    return F.base64(F.encode(F.to_json(config), "UTF-8"))


def decode_config(text: Column, schema: str) -> Column:
    return F.from_json(F.decode(F.unbase64(text), "UTF-8"), schema)


def rate(count: Column, elapsed: Column) -> Column:
    """Count per unit of time; null for zero time."""
    return F.try_divide(count.cast("double"), elapsed.cast("double"))


def _set(value: Column) -> Column:
    """A limit of zero counts as not set."""
    return F.nullif(value, F.lit(0))


def wait_limit(time_target: Column, execution_limit: Column) -> Column:
    """Longest wait for one run: twice the time target or the execution limit."""
    return F.least(2 * _set(time_target), _set(execution_limit))


def failure_limit(workload: Column, name: str = "sequential_failures_limit") -> Column:
    """Failures in a row that end a run, from a ``map<string,string>`` config.

    A missing entry means the default. An entry that is present but null ends
    the run at the first failure.
    """
    given = F.element_at(workload, F.lit(name)).cast("bigint")
    return (
        F.when(~F.map_contains_key(workload, name), F.lit(DEFAULT_FAILURE_LIMIT).cast("bigint"))
        .otherwise(F.coalesce(F.greatest(given, F.lit(1).cast("bigint")), F.lit(1).cast("bigint")))
    )


def keeps_running(
    runs_done: Column, elapsed: Column, iteration_target: Column, time_target: Column
) -> Column:
    """Whether another run would start; null when no target is set."""
    by_count = runs_done < _set(iteration_target)
    by_time = elapsed < _set(time_target)
    return F.when(by_count.isNull(), by_time).when(by_time.isNull(), by_count).otherwise(
        by_count & by_time
    )


def arithmetic_range(text: Column) -> Column:
    """``start:end:step`` as an array, end included; null for other text."""
    pattern = r"^([0-9]+):([0-9]+):([0-9]+)$"
    start, end, step = (
        F.regexp_extract(text, pattern, i).try_cast("bigint") for i in (1, 2, 3)
    )
    empty = F.array().cast("array<bigint>")
    return F.when(step > 0, F.when(start > end, empty).otherwise(F.sequence(start, end, step)))


def add_arrays(x: Column, y: Column) -> Column:
    """Element-wise sum of two arrays of one length."""
    return F.zip_with(x, y, lambda a, b: a + b)
