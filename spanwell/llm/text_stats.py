"""Counts of whole texts that rules and classifiers build on.

Words are runs of characters besides the six ASCII white spaces, lines end at line feeds.
A null text counts as an empty one: all its counts are 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanwell.llm.common import as_bytes

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines",
    "n_upper", "n_lower", "n_exclaims", "n_digits", "n_stops", "n_other_marks", "n_beyond_ascii",
]
_CODE_POINT = np.r_[0:0x80, 0xC0:0x100]
_WHITE = [9, 10, 11, 12, 13, 32]
_SYMBOLS = list(b"#*$%&|<>")
_STOPS = list(b".,;:?")
_MARKS = list(b"\"'()-/=@[\\]^_`{}~+")


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    text = text or b""
    words = text.split()
    n = len(words)
    seen = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    earlier: set[bytes] = set()
    n_lines = n_dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            n_lines += 1
            n_dup += line in earlier
            earlier.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        covered = np.zeros(n, dtype=bool)
        twice = np.flatnonzero(np.fromiter((times[w] > 1 for w in windows), dtype=bool, count=len(windows)))
        for step in range(3):
            covered[twice + step] = True
        repeated = int(covered.sum())
    beyond = int(seen[0xC0:].sum())
    return (
        n, int(seen[_CODE_POINT].sum() - seen[_WHITE].sum()), int(seen[_SYMBOLS].sum()), n_dup, repeated,
        len(set(words)), n_lines, int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[33]),
        int(seen[48:58].sum()), int(seen[_STOPS].sum()), int(seen[_MARKS].sum()), beyond,
    )


def with_counts(df: DataFrame, text: str = "text", out: str = "counts", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``, default all) with the struct ``out`` of all counts, bigints."""
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                found = np.array([text_counts(x) for x in as_bytes(part, text)], dtype=np.int64).reshape(-1, len(COUNTS))
                made = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(COUNTS))], names=COUNTS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), made], [*kept, out])

    return df.mapInArrow(run, schema)
