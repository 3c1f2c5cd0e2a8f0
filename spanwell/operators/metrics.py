"""Configured metrics: values by name, key metrics, trends, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwell.functions import names
from spanwell.operators.ordered import dealt
from spanwell.operators.rollup import IDENTITY, REPORTED, REVISIONS
from spanwell.operators.sizing import salted_lookup


def stat_values(rollups: DataFrame, stats: DataFrame, *, cut_ten: bool = False) -> DataFrame:
    """Everything measured for a file, one named value per row.

    ``kind`` is measure, trend, count or config; ``text`` is the value as given
    and ``value`` the number, if it is one. Of a repeated name one row is kept,
    a config entry before the others. ``stats`` are those of the rolled-up files. The rows of
    both are counted, so they should be settled.
    """
    inside = F.col("start_phase").isNotNull() | F.col("end_phase").isNotNull()
    label = names.measurement(
        F.col("start_phase"), F.col("end_phase"), F.col("event_type"), cut_ten=cut_ten)
    if not cut_ten:
        label = F.when(inside, names.span_key(
            F.col("start_phase"), F.col("end_phase"), F.col("event_type"))).otherwise(label)
    measured = stats.select(
        "file",
        F.inline(F.array(*[
            _entry(0, "measure", F.concat_ws("_", label, F.lit(name)), F.col(name).cast("double"))
            for name in REPORTED
        ])),
    )
    given = F.transform(
        F.map_entries(F.coalesce("max_success_workload_config", F.create_map().cast("map<string,string>"))),
        lambda e: _entry(2, "config", e["key"], e["value"]))
    # The names that metric configs use for the run figures.
    own = rollups.select("file", F.inline(F.concat(F.array(
        _entry(1, "count", F.lit("max_successful_iteration"), F.col("max_success_iteration")),
        _entry(1, "trend", F.lit("success_iteration_max"), F.col("max_success_iteration")),
        _entry(1, "trend", F.lit("failures_ct"), F.col("fail_ct")),
    ), given)))
    # names hardly repeat, and an aggregate of text sorts: by file first, so it is not all that a scan task reads
    entries = F.coalesce(F.size(F.map_keys("max_success_workload_config")), F.lit(0))
    total = len(REPORTED) * stats.count() + (rollups.agg(F.sum(entries + 3)).first()[0] or 0)
    found = dealt(measured.unionByName(own), ["file"], total, always=True)
    rank = F.struct("rank", "text")
    return (
        found.groupBy("file", "name").agg(F.max_by(F.struct("kind", "text"), rank).alias("v"))
        .select("file", "v.kind", "name", "v.text", F.col("v.text").try_cast("double").alias("value"))
    )


def _entry(rank: int, kind: str, name: Column, value: Column) -> Column:
    return F.struct(
        F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), name.alias("name"),
        value.cast("string").alias("text"),
    )


def pivot_values(values: DataFrame, columns: list[str]) -> DataFrame:
    """Wide form for known names; one aggregation, missing values are null."""
    return values.where(F.col("name").isin(columns)).groupBy("file").agg(
        *[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns]
    )


def eval_metric(stats: Column, expression: Column) -> Column:
    """A metric expression on a ``map<string,string>`` of values, as text.

    Null for a missing name or a zero denominator; an unknown form is an error.
    """
    def number(field: str) -> Column:
        return stats[expression[field]].try_cast("double")

    # The names of the expression forms.
    forms = {
        "frac_values": F.try_divide(number("numer"), number("denom")).cast("string"),
        "value": stats[expression["value"]],
    }
    kind = expression["expression_type"]
    result = F.raise_error(F.concat(F.lit("unknown metric expression: "), kind)).cast("string")
    for name, form in forms.items():
        result = F.when(kind == name, form).otherwise(result)
    return result


def key_metrics(rollups: DataFrame, values: DataFrame, config: DataFrame) -> DataFrame:
    """Each configured metric of each experiment, in long form.

    A workload without configured metrics gives one row with a null metric.
    Only values that some expression names are brought together per file, so a
    file's map is bounded by the config.
    """
    metrics = config.select("workload", "description", F.posexplode("key_metrics").alias("metric_pos", "m"))
    wanted = config.select(F.explode("key_metrics").alias("m")).select(
        F.explode(F.array("m.expression.numer", "m.expression.denom", "m.expression.value")).alias("name")
    ).where("name is not null").distinct()
    maps = (
        values.join(wanted, "name", "left_semi")
        .groupBy("file")
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("stats"))
    )
    text = eval_metric(F.col("stats"), F.col("m.expression"))
    return (
        rollups.join(metrics, "workload", "left")
        .join(maps, "file", "left")
        .select(
            *IDENTITY,
            names.date_label(F.col("timestamp")).alias("timestamp"),
            *[names.short_revision(F.col(c)).alias(c) for c in REVISIONS],
            "file", "description", "metric_pos", F.col("m.name").alias("metric"),
            F.when(F.col("m").isNotNull(), text).alias("text"),
        )
        .withColumn("value", F.col("text").try_cast("double"))
    )


def trend(rollups: DataFrame, values: DataFrame, config: DataFrame) -> DataFrame:
    """Measured values of each experiment, selected and renamed by ``cols``.

    A workload without ``cols`` keeps everything under its own name. A file with
    no selected measurement is left out. The values are counted, so they should be settled.
    """
    settings = config.select(
        "workload", "description", F.col("cols").isNotNull().alias("selects"))
    cols = config.select("workload", F.explode("cols").alias("name", "label"))
    base = rollups.select(
        "file", *IDENTITY,
        names.date_label(F.col("timestamp")).alias("timestamp"),
        *[names.short_revision(F.col(c)).alias(c) for c in REVISIONS],
    ).join(settings, "workload", "left")
    chosen = values.where(F.col("kind").isin("measure", "trend"))
    shown = (
        dealt(chosen, ["file"], chosen.count()).join(base, "file")
        .join(cols, ["workload", "name"], "left")
        .withColumn("label", F.when(F.col("selects"), F.col("label")).otherwise(F.col("name")))
        .where("label is not null")
    )
    of_file = Window.partitionBy("file")  # a file has one row for each name it measured
    measured = shown.withColumn("__measured", F.max((F.col("kind") == "measure").cast("int")).over(of_file))
    return measured.where("__measured = 1").select(
        *IDENTITY, "timestamp", *REVISIONS, "file",
        F.coalesce("description", F.lit("Unknown description")).alias("description"),
        "label", "value",
    )


def report_order(df: DataFrame) -> DataFrame:
    """Rows sorted by all columns from left to right."""
    return df.orderBy(*df.columns)


def metric_table(long: DataFrame, name: str, names_in_order: list[str]) -> DataFrame:
    """Wide report for known names: a row per experiment, sorted from the left."""
    front = ["timestamp", *REVISIONS, *IDENTITY]
    wide = long.groupBy(*front, "file").agg(
        *[F.max(F.when(F.col(name) == n, F.col("value"))).alias(n) for n in names_in_order]
    ).drop("file")
    return report_order(wide)


def relative_to_first(
    spans: DataFrame, label: list[str], order: list[str], elapsed: str = "elapsed"
) -> DataFrame:
    """Each time divided by the first time of its label.

    The first is an aggregate with partial results, joined back over salts: a
    label that holds most rows is never sorted or gathered.
    """
    first = spans.groupBy(*label).agg(F.min_by(elapsed, F.struct(*order)).alias("__first"))
    ratio = F.try_divide(F.col(elapsed).cast("double"), F.col("__first").cast("double"))
    return salted_lookup(spans, first, label, order).withColumn("ratio", ratio).drop("__first")
