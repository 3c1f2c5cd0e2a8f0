"""URL filters: rules of hosts and paths, and gradient-boosted trees for urls without a rule.

The trees see lexical features only (length, depth, digits, entropy, parameters, suffix
statistics). They are grown by second-order boosting on histograms: features are cut at
quantiles of the labelled urls, one aggregation sums gradients by node, feature and cut, and
the best split of each node is chosen from these sums (nodes x features x cuts numbers, whatever
the number of urls). The finished trees are one SQL expression. DataFrame functions only.

Defined cases: a url that is null or has no ``://`` has an empty host and path, fits no rule and
is scored like any other; repeated rows are judged each for itself; labelled urls of one class,
or none, give a constant score (none: allow); an empty table gives an empty table. Extra columns
pass unchanged, and one that has the name of an output column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwell.llm.common import column, fresh
from spanwell.session import settled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Gradients are summed as whole numbers of this fraction, so that sums do not depend on order.
UNIT = 1 << 24


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits.

    ``rules`` holds pairs such as ``("example.net/en/", "allow")`` from the caller's code; all of
    them become part of one expression.
    """
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r)):
        at = text.find("/") if "/" in text else len(text)
        site, start = text[:at], text[at:]
        fits = ((host_ == site) | F.endswith(host_, F.lit("." + site))) & F.startswith(path_, F.lit(start))
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def suffix(host_: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(host_, ".", -1)


def features(url: Column, host_: Column, path_: Column) -> dict[str, Column]:
    """Lexical features of a url, numbers that are never null."""
    whole = F.coalesce(url, F.lit(""))
    size = F.length(host_).cast("double")
    letters = F.array_distinct(F.split(host_, ""))
    entropy = F.aggregate(
        letters, F.lit(0.0),
        lambda sum_, c: sum_ + F.when(
            c == "", 0.0
        ).otherwise(
            -(F.length(host_) - F.length(F.replace(host_, c, F.lit("")))) / size
            * F.log2((F.length(host_) - F.length(F.replace(host_, c, F.lit("")))) / size)
        ),
    )
    return {
        "url_length": F.length(whole).cast("double"),
        "host_length": size,
        "path_length": F.length(path_).cast("double"),
        "depth": _count(path_, "/"),
        "host_labels": _count(host_, r"[^.]+"),
        "host_hyphens": _count(host_, "-"),
        "host_digits": _share(_count(host_, "[0-9]"), size),
        "digit_share": _share(_count(whole, "[0-9]"), F.length(whole).cast("double")),
        "parameters": _count(whole, r"[?&][^=&?#]+="),
        "odd_characters": _count(whole, r"[^A-Za-z0-9:/.?&=#_-]"),
        "host_entropy": entropy,
    }


class Trees:
    """Boosted trees over binned features: cuts of each feature, and splits of each tree.

    A tree is a dict from node number (children of k: 2k and 2k+1, the root is 1) to
    ``(feature, cut index)`` or to a leaf's value.
    """

    def __init__(self, cuts: dict[str, list[float]], trees: list[dict], start: float):
        self.cuts, self.trees, self.start = cuts, trees, start

    def _value(self, tree: dict, node: int, goes_right) -> Column:
        at = tree[node]
        if not isinstance(at, tuple):
            return F.lit(float(at))
        return F.when(goes_right(*at), self._value(tree, 2 * node + 1, goes_right)).otherwise(
            self._value(tree, 2 * node, goes_right)
        )

    def margin(self, goes_right) -> Column:
        total = F.lit(float(self.start))
        for tree in self.trees:
            total = total + self._value(tree, 1, goes_right)
        return total

    def score(self, names: dict[str, Column]) -> Column:
        """Probability of label 1 from the features' columns."""
        return 1 / (1 + F.exp(-self.margin(lambda name, cut: names[name] > self.cuts[name][cut])))


def suffix_rates(labelled: DataFrame, smoothing: float = 20.0) -> DataFrame:
    """``suffix``, ``suffix_rate``: the smoothed share of label 1 among urls of each suffix."""
    total = labelled.agg(F.avg("label").alias("mean")).first()["mean"] or 0.0
    rates = labelled.groupBy("suffix").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n"))
    return settled(
        rates.select("suffix", ((F.col("ones") + smoothing * total) / (F.col("n") + smoothing)).alias("suffix_rate")),
        "suffix-rates",
    )


def _with_features(df: DataFrame, rates: DataFrame, mean: float) -> DataFrame:
    """``df`` (with ``url``, ``host``, ``path``) and the struct ``features``."""
    known = df.join(rates.withColumnRenamed("suffix", "known_suffix"), suffix(F.col("host")) == F.col("known_suffix"), "left")
    made = features(F.col("url"), F.col("host"), F.col("path"))
    made["suffix_rate"] = F.coalesce("suffix_rate", F.lit(float(mean)))
    return known.select(*(column(c) for c in df.columns), F.struct(*(c.alias(n) for n, c in made.items())).alias("features"))


def train(labelled: DataFrame, max_rows: int = 50_000, trees: int = 10, depth: int = 3, cuts: int = 31,
          rate: float = 0.4, l2: float = 1.0) -> tuple[Trees, DataFrame, float]:
    """Trees from labelled urls (``url``, ``label`` 0 or 1), the suffix rates and the mean label.

    Suffix rates come from all labelled urls, the trees from about ``max_rows`` of them, chosen
    by a hash of the url.
    """
    known = labelled.select(
        "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("label").cast("int").alias("label")
    ).where("label is not null").withColumn("suffix", suffix(F.col("host")))
    rates = suffix_rates(known)
    seen = known.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean")).first()
    mean = seen["mean"] or 0.0
    start = math.log(max(mean, 1e-6) / max(1 - mean, 1e-6))
    if not seen["n"] or mean in (0.0, 1.0):
        return Trees({}, [], start), rates, mean
    limit = min(1 << 20, max(1, (max_rows << 20) // seen["n"]))
    chosen = settled(
        _with_features(known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < limit), rates, mean).select("features.*", "label"),
        "labelled-urls",
    )
    names = [c for c in chosen.columns if c != "label"]
    places = [(i + 1) / (cuts + 1) for i in range(cuts)]
    found = chosen.agg(*(F.percentile_approx(n, places, 10_000).alias(n) for n in names)).first()
    model = Trees({n: sorted(set(found[n] or [])) for n in names}, [], start)
    # equal binned rows count together
    binned = settled(
        chosen.select(
            *(sum((F.when(F.col(n) > c, 1).otherwise(0) for c in model.cuts[n]), F.lit(0)).alias(n) for n in names), "label"
        ).groupBy(*names, "label").count(),
        "binned-urls",
    )
    right = lambda name, cut: F.col(name) > cut
    for _ in range(trees):
        tree: dict = {1: 0.0}
        scored = binned.withColumn("p", 1 / (1 + F.exp(-model.margin(right)))).select(
            *names,
            F.round((F.col("p") - F.col("label")) * F.col("count") * UNIT).cast("bigint").alias("g"),
            F.round(F.col("p") * (1 - F.col("p")) * F.col("count") * UNIT).cast("bigint").alias("h"),
        )
        for level in range(depth):
            at = F.lit(1)
            for _step in range(level):
                at = _descend(tree, at, right, level)
            sums = scored.withColumn("node", at).select(
                "node", "g", "h", F.posexplode(F.array(*(F.col(n) for n in names))).alias("feature", "bin")
            ).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            _split(tree, sums.collect(), names, level, rate, l2)  # at most 2**level * features * (cuts + 1) sums
        if len(tree) == 1:
            break
        model.trees.append(tree)
    return model, rates, mean


def _descend(tree: dict, at: Column, right, level: int) -> Column:
    """One step down from each inner node above ``level``; leaves stay."""
    to = at
    for node, split in tree.items():
        if isinstance(split, tuple) and node < 1 << level:
            to = F.when(at == node, F.when(right(*split), 2 * node + 1).otherwise(2 * node)).otherwise(to)
    return to


def _split(tree: dict, sums: list, names: list[str], level: int, rate: float, l2: float) -> None:
    """Split the nodes of a level where that lowers the loss; new nodes get their leaf values."""
    by: dict[int, dict[int, list]] = {}
    for row in sums:
        by.setdefault(row.node, {}).setdefault(row.feature, []).append((row.bin, row.g / UNIT, row.h / UNIT))
    for node, found in sorted(by.items()):
        if node < 1 << level or isinstance(tree.get(node), tuple):
            continue
        best = None
        for feature, bins in sorted(found.items()):
            bins.sort()
            g_all, h_all = sum(b[1] for b in bins), sum(b[2] for b in bins)
            g = h = 0.0
            for at, g_bin, h_bin in bins[:-1]:
                g, h = g + g_bin, h + h_bin
                if min(h, h_all - h) < 0.5:
                    continue
                gain = g * g / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - g_all**2 / (h_all + l2)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, feature, at, -rate * g / (h + l2), -rate * (g_all - g) / (h_all - h + l2))
        if best and best[0] > 1e-3:
            tree[node] = (names[best[1]], best[2])
            tree[2 * node], tree[2 * node + 1] = best[3], best[4]


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame, url: str = "url",
          block_at: float = 0.5, max_rows: int = 50_000) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` (probability of block) and ``verdict``."""
    model, rates, mean = train(labelled, max_rows)
    made = {"host", "path", "rule", "score", "verdict"}
    kept = [c for c in pages.columns if c.lower() not in made]
    row = fresh(pages, "row")
    # the row travels as one struct, so its column names cannot meet those made here
    split = pages.select(F.struct(*(column(c) for c in pages.columns)).alias(row), column(url).alias("sw_url"))
    split = split.select(F.col(row).alias("row"), F.col("sw_url").alias("url"),
                         host(F.col("sw_url")).alias("host"), path(F.col("sw_url")).alias("path"))
    seen = _with_features(split, rates, mean)
    score = model.score({n: F.col(f"features.{n}") for n in model.cuts})
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    judged = seen.select("row", "host", "path", rule.alias("rule"), says.alias("says"), score.alias("score"))
    return judged.select(
        *(F.col("row").getField(c).alias(c) for c in kept), "host", "path", "rule", "score",
        F.coalesce("says", F.when(F.col("score") >= block_at, "block").otherwise("allow")).alias("verdict"),
    )
