"""Word counts, counter merges, generic reduction and sampled text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwell.operators.ordered import Running, ordered
from spanwell.session import settled


def words(text: Column) -> Column:
    """Runs of ASCII letters, lower-cased, as an array.

    Letters are told apart before lower-casing, so characters outside ASCII
    that lower-case into it still separate words.
    """
    return F.transform(F.filter(_letter_runs(text), lambda w: w != ""), F.lower)


def _letter_runs(text: Column) -> Column:
    """Split at everything else; the first and last part may be empty."""
    return F.split(text, "[^a-zA-Z]+")


def word_count(df: DataFrame, text: str = "text") -> DataFrame:
    return (
        df.select(F.explode(_letter_runs(F.col(text))).alias("word"))
        .where(F.col("word") != "")
        .groupBy(F.lower("word").alias("word"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def merge_counts(x: DataFrame, y: DataFrame) -> DataFrame:
    """Sum two counters; a word in only one of them keeps its count."""
    return x.unionByName(y).groupBy("word").agg(F.sum("count").alias("count"))


def top_words(counts: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` most frequent words; ties go to the first in text order."""
    return counts.orderBy(F.desc("count"), F.asc("word")).limit(n)


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """Every word of the source text with the number of times it stands there."""
    # One pass over the whole text; line ends stay, so lines come out as above.
    spaced = F.regexp_replace(F.col(text), "[^a-zA-Z'\n]+", " ")
    lines = df.select(F.explode(F.split(spaced, "\n")).alias("line"))
    return (
        lines.select(F.explode(F.split(F.trim("line"), " ")).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    )


#: Rows that a task holds before it passes its merged rows on.
REDUCED_ROWS = 100_000

Merge = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def tree_reduce(
    df: DataFrame, merge: Merge, keys: list[str] | None = None, fan_in: int = 8
) -> DataFrame:
    """Reduce rows with a user function that merges two frames into one.

    ``merge`` must be associative and commutative and return the columns of
    ``df``. With ``keys`` its result holds one row per key: partitions are
    reduced where they are, a part of theirs at a time, then rows move by key (spread over
    ``fan_in`` salts first, so a key with most rows is merged by several tasks) and are merged
    in order of key, so that a task holds a batch and one key's value at a time. Without keys
    the reduced value must be of fixed size; it goes through a tree of
    partitions and stays a DataFrame of one partition.
    """
    schema = df.schema

    def halved(frame: pd.DataFrame) -> pd.DataFrame:
        """A frame merged with itself; one row needs no merge."""
        half = len(frame) // 2
        return merge(frame.iloc[:half], frame.iloc[half:]) if half else frame

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple[int, pd.DataFrame]] = []   # (level, frame): merge equal levels
        for frame in frames:
            frame, level = halved(frame), 0
            while waiting and waiting[-1][0] <= level:
                below, other = waiting.pop()
                frame, level = merge(other, frame), max(below, level) + 1
            waiting.append((level, frame))
            if keys and sum(len(held) for _, held in waiting) > REDUCED_ROWS:
                yield from (held for _, held in waiting)  # later steps merge them
                waiting = []
        if waiting:
            state = waiting.pop()[1]
            while waiting:
                state = merge(waiting.pop()[1], state)
            yield state

    def by_key(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: pd.DataFrame | None = None
        for frame in frames:
            if not len(frame):
                continue
            whole = halved(frame) if last is None else merge(last, frame)
            ends = frame.iloc[-1:][keys].reset_index(drop=True)
            same = np.ones(len(whole), dtype=bool)
            for key in keys:
                value, column = ends[key].iloc[0], whole[key]
                same &= (column.isna() if pd.isna(value) else column == value).to_numpy()
            yield whole[~same]
            last = whole[same]
        if last is not None:
            yield last

    partial = df.mapInPandas(settle, schema)
    if keys:
        salt = F.pmod(F.spark_partition_id(), F.lit(fan_in))
        salted = partial.repartition(*keys, salt).sortWithinPartitions(*keys).mapInPandas(by_key, schema)
        return salted.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(by_key, schema)
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while width > 1:
        width = -(-width // fan_in)
        partial = partial.repartition(width).mapInPandas(settle, schema)
    return partial


def _draw(seed: int, *parts: Column) -> Column:
    """A repeatable whole number below 2**52 from a seed and row values."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def generate_text(
    splits: DataFrame, vocab: DataFrame, words_per_split: int, seed: int = 0, **sizing
) -> DataFrame:
    """Words drawn uniformly, with replacement, from the source text.

    ``splits`` has ``split_id``; the result is ``split_id, pos, word``. Each
    draw is a position in the source text, where vocabulary words own consecutive
    ranges. A guide table lists the words of each bucket of positions, so a draw meets its
    word in an equi-join on the bucket, and no order runs over the draws. A bucket is
    as wide as a word's mean count: the table has at most two rows for each word, and a draw
    meets two of them on average, however the counts are spread.
    """
    guide, total, width = guide_table(vocab, **sizing)
    draws = (
        splits.select("split_id", F.explode(F.sequence(F.lit(0), F.lit(words_per_split - 1))).alias("pos"))
        .withColumn("at", F.pmod(_draw(seed, F.col("split_id"), F.col("pos")), F.lit(total).cast("bigint")))
        .withColumn("drawn_bucket", F.expr(f"at div {width}"))
    )
    met = (F.col("drawn_bucket") == F.col("bucket")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop"))
    return draws.join(guide, met, "left").select("split_id", "pos", "word")


def guide_table(vocab: DataFrame, **sizing) -> tuple[DataFrame, int | None, int]:
    """``bucket, start, stop, word`` of a vocabulary, all of its counts, and the positions in a bucket.

    Words own positions in text order. Their starts are sums inside the words of two equal first
    letters and over those few beginnings. The vocabulary is read four times, so it should be a
    table, not a plan that counts it anew.
    """
    counts = vocab.select(F.substring("word", 1, 2).alias("beginning"), "word", "count")
    earlier = Window.orderBy("beginning").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.groupBy("beginning").agg(F.sum("count").alias("n")).select(
        F.col("beginning").alias("of_beginning"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = ordered(counts, ["beginning"], ["word"], **sizing).running(
        inside=Running("sum", F.col("count"), through_row=False)).done()
    start = F.col("first") + F.col("inside")
    starts = inside.join(first, F.col("beginning") == F.col("of_beginning")).select(
        "word", start.cast("bigint").alias("start"), (start + F.col("count")).cast("bigint").alias("stop"))
    seen = counts.agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("words")).first()
    width = max(1, (seen["total"] or 0) // max(1, seen["words"]))
    buckets = F.sequence(F.expr(f"start div {width}"), F.expr(f"(stop - 1) div {width}"))
    return settled(starts.select(F.explode(buckets).alias("bucket"), "start", "stop", "word"), "guide"), seen["total"], width


def split_texts(sampled: DataFrame) -> DataFrame:
    """One text per split; a split holds a fixed number of words."""
    ordered_words = F.sort_array(F.collect_list(F.struct("pos", "word")))
    return sampled.groupBy("split_id").agg(
        F.array_join(F.transform(ordered_words, lambda w: w["word"]), " ").alias("text")
    )


def split_ids(spark: SparkSession, num_splits: int) -> DataFrame:
    return spark.range(num_splits).withColumnRenamed("id", "split_id")
