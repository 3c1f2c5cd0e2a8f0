"""Quality rules as weak supervision.

Each rule votes for good (1) or bad (-1) or abstains (0). How far a rule can be trusted is not
set by hand: expectation-maximisation estimates how often every rule votes, and votes right, on good
and on bad documents, and the share of good documents, from how the votes agree over all documents, and a document is kept by the
posterior probability that it is good, not by passing every rule. Documents with equal votes
are one case, and there are at most 3**rules cases whatever the number of documents: only
their counts leave the executors.

Defined cases: a null or empty text has no words and no votes beyond what its counts say, and fails
the base rules; repeated rows are judged alike; an empty table leaves the starting accuracies;
extra columns pass unchanged, and one that has the name of an output column is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwell.llm.common import column, fresh
from spanwell.llm.text_stats import with_counts


def _bad_if(condition: Column) -> Column:
    return F.when(condition, -1).otherwise(0)


def votes(counts: str = "counts") -> dict[str, Column]:
    """The rules' votes from a struct of counts."""
    n = {c: F.col(f"{counts}.{c}") for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines",
        "n_upper", "n_lower", "n_exclaims")}
    words, cased = n["n_words"], n["n_upper"] + n["n_lower"]
    return {
        "symbols": _bad_if(n["n_symbols"] * 10 > words),
        "shouting": _bad_if((n["n_upper"] * 10 > cased * 3) & (cased >= 20)),
        "exclaims": _bad_if(n["n_exclaims"] * 10 > words),
        "repetition": _bad_if(n["n_repeat_words"] * 2 > words),
        "variety": _bad_if((n["n_distinct_words"] * 10 < words) & (words >= 50)),
        "lines": _bad_if((n["n_dup_lines"] * 2 > n["n_lines"]) & (n["n_lines"] >= 4)),
        "word_length": _bad_if((n["word_chars"] < words * 2) | (n["word_chars"] > words * 20)),
        "plain": F.when(
            (words > 0) & (n["n_symbols"] * 20 < words) & (n["n_exclaims"] * 20 < words)
            & ((n["n_upper"] * 4 < cased) | (cased < 20)), 1).otherwise(0),
    }


@dataclass
class Trust:
    """What expectation-maximisation found.

    ``good`` is the share of good documents; ``rates`` has for each rule how often it votes
    -1, 0 and 1 on bad and on good documents, ``accuracy`` how often its votes are right.
    """

    good: float
    rates: dict[str, tuple[tuple[float, float, float], tuple[float, float, float]]]
    accuracy: dict[str, float]
    steps: int

    def evidence(self, rule: str) -> list[float]:
        """What a rule's vote of -1, 0, 1 adds to the log-odds of good."""
        bad, good = self.rates[rule]
        found = [math.log(g / b) for b, g in zip(bad, good)]
        return [min(found[0], 0.0), found[1], max(found[2], 0.0)]  # no vote counts against what it says

    def posterior(self, cast: dict[str, Column]) -> Column:
        """The probability that a document with these votes is good."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for rule, value in cast.items():
            against, none, for_ = self.evidence(rule)
            odds = odds + F.when(value < 0, against).when(value > 0, for_).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def estimate(cases: list[tuple[tuple[int, ...], int]], rules: list[str], good: float = 0.8, steps: int = 500,
             tolerance: float = 1e-9) -> Trust:
    """Expectation-maximisation over cases of equal votes and their counts.

    At the start a rule abstains half of the time in both classes and is right in nine
    of ten votes. Each rate has one tenth of a document added to its count.
    """
    start = ((0.45, 0.5, 0.05), (0.05, 0.5, 0.45))
    trust = Trust(good, dict.fromkeys(rules, start), dict.fromkeys(rules, 0.9), 0)
    total = sum(n for _, n in cases)
    for step in range(1, steps + 1 if total else 0):
        odds0 = math.log(trust.good / (1 - trust.good))
        weight = [trust.evidence(r) for r in rules]
        sums = [[[0.1] * 3, [0.1] * 3] for _ in rules]
        goods = 0.0
        for cast, n in sorted(cases):
            odds = odds0 + sum(w[v + 1] for v, w in zip(cast, weight))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            goods += n * p
            for j, v in enumerate(cast):
                sums[j][0][v + 1] += n * (1 - p)
                sums[j][1][v + 1] += n * p
        rates = {r: tuple(tuple(x / sum(of) for x in of) for of in sums[j]) for j, r in enumerate(rules)}
        right = {r: (b[0] + g[2]) / (b[0] + b[2] + g[0] + g[2]) for r, (b, g) in zip(rules, sums)}
        new = Trust(min(0.999, max(0.001, goods / total)), rates, right, step)
        moved = max(abs(new.good - trust.good), *(
            abs(x - y) for r in rules for a, b in zip(new.rates[r], trust.rates[r]) for x, y in zip(a, b)))
        trust = new
        if moved < tolerance:
            break
    return trust


def learn(counted: DataFrame, counts: str = "counts") -> Trust:
    """The trust in the rules from all documents' counts."""
    cast = votes(counts)
    cases = counted.select(*(v.alias(r) for r, v in cast.items())).groupBy(*cast).count().collect()
    return estimate([(tuple(row[r] for r in cast), row["count"]) for row in cases], list(cast))


def judge(counted: DataFrame, trust: Trust, keep_at: float = 0.5, counts: str = "counts",
          base: str = "base_failed", quality: str = "quality_probability", kept: str = "kept") -> DataFrame:
    """``counted`` with whether the base rules fail, the posterior probability, and the verdict."""
    words, repeated = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    failed = (words < 50) | (repeated * 100 > words * 50)
    good = trust.posterior(votes(counts))
    others = [column(c) for c in counted.columns if c.lower() not in {base, quality, kept}]
    return counted.select(*others, failed.alias(base), good.alias(quality), (~failed & (good >= keep_at)).alias(kept))


def filtered(docs: DataFrame, text: str = "text", keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are.

    Texts are counted twice, for the estimate and for the verdict, rather than kept a second time.
    """
    trust = learn(with_counts(docs.select(column(text).alias("text")), keep=[]))
    counts = fresh(docs, "counts")
    whole = with_counts(docs, text, counts)
    words, repeated = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    stays = (words >= 50) & (repeated * 100 <= words * 50) & (trust.posterior(votes(counts)) >= keep_at)
    return whole.where(stays).select(*(column(c) for c in docs.columns))
