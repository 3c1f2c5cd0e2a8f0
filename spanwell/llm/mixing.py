"""Mixing sources to target weights by hierarchical budgets.

A tree has a level for each of the given columns, such as domain, language and source. A
node's token budget goes to its children by weight, but no child gets more than its subtree
holds; what a child cannot use goes to its siblings, by weight again. As every level counts
whole subtrees, a shortage is met by siblings first and by more distant relatives only when
the siblings are used up. A leaf takes its documents as often as its budget holds all of
them, and of the next epoch the prefix that covers the rest, in an order seeded for that
epoch; the document that reaches the budget is the last one taken.

DataFrame functions only. Documents are never sorted: the end of each leaf's prefix is found by
summing tokens over the leading digits of the order key, two digits at a time, so a leaf with
a third of all documents is no larger a group than 256 sums.

Defined cases: null counts as a value of a level like any other; a null or empty text has one
token, as any document has at least one; a null doc_id has an order key like any other; rows
with equal order keys (repeated rows) are taken or left together; an empty table gives an empty
table; extra columns pass unchanged, and one that has the name of the output column is replaced.
Budgets are whole tokens; fractions of a token are dropped at each node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwell.llm.common import column, fresh
from spanwell.session import settled

WHOLE = "decimal(38,0)"
#: Hexadecimal digits of the order key that are resolved by sums before rows are looked at.
STEPS = (2, 4)


def n_words(text: Column) -> Column:
    """Words of a text, at least 1; null: 1."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).cast("bigint")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def _same(left: list[Column], right: list[Column]) -> Column:
    met = F.lit(True)
    for a, b in zip(left, right):
        met = met & a.eqNullSafe(b)
    return met


def _weight(level: int, names: list[str], weights: dict[tuple, int]) -> Column:
    """The weight of a node at a level: that of the longest entry which ends its path, or 1."""
    found = F.lit(1)
    for path, weight in sorted(weights.items(), key=lambda x: len(x[0])):
        if not 1 <= len(path) <= level + 1:
            continue
        at = names[level + 1 - len(path): level + 1]
        found = F.when(_same([F.col(c) for c in at], [F.lit(v) for v in path]), F.lit(weight)).otherwise(found)
    return found


def leaf_budgets(leaves: DataFrame, names: list[str], weights: list[dict[tuple, int]], share: tuple[int, int],
                 max_epochs: int) -> DataFrame:
    """Each leaf of ``leaves`` (level columns ``names``, ``held`` tokens) with its ``budget``.

    ``weights`` has a dict for each level, from the last values of a path, such as ``("en",)``
    or ``("web", "en")``, to whole weights; 1 if absent. The whole budget is ``share`` (a
    fraction) of all tokens held.
    """
    caps = leaves.withColumn("cap", (F.col("held") * max_epochs).cast(WHOLE))
    budgets = caps.agg(
        F.expr(f"coalesce(sum(held), 0) * {int(share[0])} div {int(share[1])}").cast(WHOLE).alias("budget")
    )
    for level in range(len(names)):
        path = names[: level + 1]
        nodes = caps.groupBy(*path).agg(F.sum("cap").cast(WHOLE).alias("cap")).withColumn(
            "weight", _weight(level, names, weights[level]).cast(WHOLE)
        )
        if level:
            above = budgets.select(*(F.col(c).alias(f"above_{c}") for c in names[:level]), "budget")
            met = _same([F.col(c) for c in names[:level]], [F.col(f"above_{c}") for c in names[:level]])
            nodes = nodes.join(above, met).drop(*(f"above_{c}" for c in names[:level]))
        else:
            nodes = nodes.join(budgets, F.lit(True))  # one row
        siblings = Window.partitionBy(*names[:level])
        # those that fill first come first; ties by name
        before = siblings.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), *(F.col(c) for c in path))
        before = before.rowsBetween(Window.unboundedPreceding, -1)
        ranked = nodes.select(
            "*",
            F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(WHOLE).alias("cap_before"),
            (F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast(WHOLE).alias("weight_left"),
        ).withColumn("full", F.expr("cap * weight_left <= weight * (budget - cap_before)"))
        shared = ranked.select(
            "*",
            F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(siblings), F.lit(0)).cast(WHOLE).alias("cap_full"),
            F.sum(F.when(~F.col("full"), F.col("weight"))).over(siblings).cast(WHOLE).alias("weight_open"),
        )
        budgets = settled(
            shared.select(
                *path,
                F.when(F.col("full"), F.col("cap")).otherwise(
                    F.expr("weight * (budget - cap_full) div weight_open")
                ).cast(WHOLE).alias("budget"),
            ),
            "budgets",
        )
    met = _same([F.col(c) for c in names], [F.col(f"to_{c}") for c in names])
    right = budgets.select(*(F.col(c).alias(f"to_{c}") for c in names), F.col("budget").cast("bigint").alias("budget"))
    return leaves.join(right, met).select(*names, "held", "budget")


def mixed(docs: DataFrame, levels: dict[str, Column], weights: list[dict[tuple, int]], share: tuple[int, int],
          max_epochs: int = 1, seed: int = 0, doc_id: str = "doc_id", text: str = "text", copies: str = "copies") -> DataFrame:
    """The documents taken, each with how many epochs take it (``copies``).

    ``levels`` maps level names to expressions over ``docs``, from the root down.
    """
    names = [f"level_{i}" for i in range(len(levels))]
    found = docs.select(
        *(c.cast("string").alias(n) for n, c in zip(names, levels.values())),
        column(doc_id).alias("doc_id"), n_words(column(text)).alias("tokens"),
    )
    narrow = settled(found, "doc-tokens")
    held = settled(narrow.groupBy(*names).agg(F.sum("tokens").alias("held")), "leaves")
    leaves = settled(
        leaf_budgets(held, names, weights, share, max_epochs).select(
            *(F.col(c).alias(f"leaf_{c}") for c in names),
            F.expr("budget div held").alias("epochs"), F.expr("budget % held").alias("rest"),
        ),
        "leaf-budgets",
    )
    at = [F.col(f"leaf_{c}") for c in names]
    keyed = narrow.join(leaves.where("rest > 0"), _same([F.col(c) for c in names], at)).select(
        *at, "rest", "tokens", order_key(seed, F.col("epochs"), F.col("doc_id")).alias("key")
    )
    open_keys = keyed
    for done, digits in zip((0, *STEPS), STEPS):
        sums = open_keys.groupBy(*at, "rest", F.substring("key", done + 1, digits - done).alias("digits")).agg(F.sum("tokens").alias("tokens"))
        before = Window.partitionBy(*at).orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
        ends = settled(
            sums.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
            .where("before < rest and before + tokens >= rest")
            .select(*(c.alias(f"end_{n}") for c, n in zip(at, names)), F.col("digits").alias("end_digits"),
                    (F.col("rest") - F.col("before")).alias("end_rest")),
            "prefix-ends",
        )
        met = _same(at, [F.col(f"end_{n}") for n in names]) & (F.substring("key", done + 1, digits - done) == F.col("end_digits"))
        open_keys = open_keys.join(ends, met).select(*at, F.col("end_rest").alias("rest"), "tokens", "key")
    before = Window.partitionBy(*at).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    last = settled(
        open_keys.groupBy(*at, "rest", "key").agg(F.sum("tokens").alias("tokens"))
        .withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .where("before < rest and before + tokens >= rest")
        .select(*(c.alias(f"last_{n}") for c, n in zip(at, names)), F.col("key").alias("last_key")),
        "last-keys",
    )
    cuts = settled(
        leaves.join(last, _same(at, [F.col(f"last_{n}") for n in names]), "left").select(*at, "epochs", "last_key"),
        "leaf-cuts",
    )
    cuts = cuts.toDF(*(fresh(docs, f"cut_{c}") for c in cuts.columns))
    here = [column(c) for c in cuts.columns]
    key = order_key(seed, here[-2], column(doc_id))
    times = (here[-2] + F.when(key <= here[-1], 1).otherwise(0)).cast("bigint")
    joined = docs.join(cuts, _same([c.cast("string") for c in levels.values()], here[:-2]))
    kept = [column(c) for c in docs.columns if c.lower() != copies.lower()]
    return joined.select(*kept, times.alias(copies)).where(column(copies) > 0)


def level_sql(names: list[str], weights: list[dict[tuple, int]], share: tuple[int, int], max_epochs: int) -> str:
    """The same budgets in SQL, as tables ``budget_0`` and so on, over a table ``held`` of the leaves."""
    parts = [f"budget_root AS (SELECT coalesce(sum(held), 0)::HUGEINT * {share[0]} // {share[1]} AS budget FROM held)"]
    for level in range(len(names)):
        path, above = names[: level + 1], names[:level]
        cases = "".join(
            f" WHEN {' AND '.join(f'{c} IS NOT DISTINCT FROM ' + repr(v) for c, v in zip(path[level + 1 - len(p):], p))} THEN {w}"
            for p, w in sorted(weights[level].items(), key=lambda x: -len(x[0])) if len(p) <= level + 1
        )
        weight = f"CASE{cases} ELSE 1 END" if cases else "1"
        join = " AND ".join(f"n.{c} IS NOT DISTINCT FROM b.{c}" for c in above) or "true"
        split = f"PARTITION BY {', '.join(above)}" if above else ""
        order = f"{split} ORDER BY cap::DOUBLE / weight::DOUBLE, {', '.join(f'{c} NULLS FIRST' for c in path)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        up = f"budget_{level - 1}" if level else "budget_root"
        parts.append(f"""
nodes_{level} AS (SELECT {', '.join(f'n.{c}' for c in path)}, n.cap, n.weight, b.budget FROM
  (SELECT {', '.join(path)}, sum(held)::HUGEINT * {max_epochs} AS cap, ({weight})::HUGEINT AS weight FROM held GROUP BY {', '.join(path)}) n JOIN {up} b ON {join}),
ranked_{level} AS (SELECT *, cap * (sum(weight) OVER ({split}) - coalesce(sum(weight) OVER ({order}), 0))
  <= weight * (budget - coalesce(sum(cap) OVER ({order}), 0)) AS filled FROM nodes_{level}),
budget_{level} AS (SELECT {', '.join(path)}, CASE WHEN filled THEN cap ELSE
  weight * (budget - coalesce(sum(cap) FILTER (WHERE filled) OVER ({split}), 0)) // (sum(weight) FILTER (WHERE NOT filled) OVER ({split})) END AS budget
  FROM ranked_{level})""")
    return ",".join(parts)


def sql(levels: dict[str, str], weights: list[dict[tuple, int]], share: tuple[int, int], max_epochs: int, seed: int) -> str:
    """The documents taken, as a query over ``documents``: doc_id, levels, tokens, copies."""
    names = list(levels)
    same = " AND ".join(f"d.{c} IS NOT DISTINCT FROM b.{c}" for c in names)
    return rf"""
WITH d AS (SELECT doc_id, {', '.join(f'{e} AS {c}' for c, e in levels.items())},
    greatest(1, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS tokens FROM documents),
held AS (SELECT {', '.join(names)}, sum(tokens) AS held FROM d GROUP BY {', '.join(names)}),
{level_sql(names, weights, share, max_epochs)},
keyed AS (SELECT d.*, b.budget // h.held AS epochs, b.budget % h.held AS rest,
    md5('{seed}|' || (b.budget // h.held)::BIGINT::VARCHAR || '|' || coalesce(d.doc_id::VARCHAR, 'null')) AS key
  FROM d JOIN budget_{len(names) - 1} b ON {same} JOIN held h ON {same.replace('b.', 'h.')}),
placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {', '.join(names)} ORDER BY key
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS before FROM keyed)
SELECT doc_id, {', '.join(names)}, tokens::BIGINT AS tokens,
    (epochs + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM placed WHERE epochs > 0 OR before < rest
"""
