"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has one last token with which its encoding ends. That token
is the only vocabulary entry ending there that stands after the last token of the prefix
before it without a merge across the border. Storing this last token for every prefix
gives the encoding of all prefixes at once, so a piece can grow, or be changed in the
middle, and only the prefixes that an edit touches are computed again.

Texts are split by a pattern first, and each match is a piece of its own. Vocabularies are
files of ranks; only their path is known here, and their bytes go to the executors in one
broadcast (the files hold some 50,000 entries, under 1 MB).

Defined cases: a null text is an empty one, an empty text has no ids, repeated rows are
encoded each for itself, an empty table gives an empty table. A column that has the name of
an output column is replaced, as withColumn does; all other columns pass unchanged.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spanwell.llm.common import as_bytes

#: Pieces whose ids a worker remembers, in each of two generations.
REMEMBERED = 200_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Vocabulary:
    """Tokens by bytes and by id, the two halves of each, and which may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {i: token for token, i in ranks.items()}
        self.size = {i: len(token) for token, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int]] = {}
        #: for each token, which tokens may stand behind it, as far as that was asked
        self._behind: dict[int, dict[int, bool]] = {}
        self._asked = 0
        #: finds the tokens that end at each byte, the longest first
        self.finder = ahocorasick.Automaton()
        for token, data in sorted(self.text.items()):
            if len(data) == 1 or self._undo(token):
                self.finder.add_word(data.decode("latin-1"), (len(data), token))
        if len(self.finder):
            self.finder.make_automaton()

    def _undo(self, token: int) -> bool:
        """Find the two tokens whose merge makes this one; false if no merges lead to it."""
        parts = [self.ranks[bytes([x])] for x in self.text[token]]
        while len(parts) > 2:
            joint = [
                (self.ranks.get(self.text[a] + self.text[b], token), at)
                for at, (a, b) in enumerate(zip(parts, parts[1:]))
            ]
            made, at = min(joint)
            if made >= token:
                return False
            parts[at: at + 2] = [made]
        self.halves[token] = (parts[0], parts[1])
        return True

    def beside(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` is how their bytes together are encoded.

        The merges that made both are undone from the last to the first; at no point may
        the two tokens at the border have a merge that comes before those undone so far.
        """
        x, y, undone, fits, halves = a, b, None, True, self.halves
        while True:
            joint = self.ranks.get(self.text[x] + self.text[y])
            if joint is not None and (undone is None or joint < undone):
                fits = False
                break
            if x in halves and (x > y or y not in halves):
                undone, x = x, halves[x][1]
            elif y in halves:  # the same merge across the border would come first: it lies further left
                undone, y = y + 1, halves[y][0]
            else:
                break
        if self._asked > 4 * REMEMBERED:
            self._behind.clear()
            self._asked = 0
        self._behind.setdefault(a, {})[b] = fits
        self._asked += 1
        return fits

    def fill(self, piece: bytes, last: list[int], stop: int) -> None:
        """Add the last tokens of the prefixes of ``piece`` up to ``stop`` bytes to ``last``."""
        known, beside, nothing = self._behind, self.beside, {}
        skipped = max(0, len(last) - self.longest)
        done = len(last)
        for end, (length, token) in self.finder.iter(piece[skipped:stop].decode("latin-1")):
            end += skipped
            if end < done:
                continue
            if end >= length:
                before = last[end - length]
                fits = known.get(before, nothing).get(token)
                if not fits and (fits is False or not beside(before, token)):
                    continue
            last.append(token)
            done += 1
        if done != stop:
            raise ValueError("the vocabulary lacks a byte")

    def walk(self, last: list[int]) -> list[int]:
        """The ids of a piece from the last tokens of its prefixes."""
        found, end, size = [], len(last), self.size
        while end:
            token = last[end - 1]
            found.append(token)
            end -= size[token]
        found.reverse()
        return found


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Make the piece longer; what was known of its prefixes stays."""
        self.piece += more
        self.vocabulary.fill(self.piece, self.last, len(self.piece))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Change bytes; returns for how many prefixes the last token was computed again.

        Prefixes before the change stay. Behind it, once as many last tokens in a row as
        the longest token has bytes are what they were, all others are as well.
        """
        old = self.last[stop:]
        self.piece = self.piece[:start] + new + self.piece[stop:]
        del self.last[start:]
        same = 0
        for end in range(start + 1, len(self.piece) + 1):
            self.vocabulary.fill(self.piece, self.last, end)
            behind = end - start - len(new)
            if behind > 0:
                same = same + 1 if self.last[-1] == old[behind - 1] else 0
                if same == self.vocabulary.longest:
                    self.last += old[behind:]
                    return end - start
        return len(self.piece) - start

    def ids(self) -> list[int]:
        return self.vocabulary.walk(self.last)


class Encoder:
    """Encodes texts, each match of the pattern by itself, and remembers the pieces it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary, self.pattern = Vocabulary(ranks), regex.compile(pattern)
        #: ids of pieces; the older generation goes when the newer is full
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self._bytes = None

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older, vocabulary = self.known, self.older, self.vocabulary
        for piece in pieces.difference(known):
            ids = older.get(piece)
            if ids is None:
                data = piece.encode()
                whole = vocabulary.ranks.get(data)
                if whole is not None:
                    ids = [whole]
                else:
                    last: list[int] = []
                    vocabulary.fill(data, last, len(data))
                    ids = vocabulary.walk(last)
            known[piece] = ids

    def many(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        split = [self.pattern.findall(text) for text in texts]
        self._learn(set().union(*split))
        known, found = self.known, []
        for pieces in split:
            ids: list[int] = []
            for piece in pieces:
                ids += known[piece]
            found.append(ids)
        return found

    def ids(self, text: str) -> list[int]:
        return self.many([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.text.__getitem__, ids))

    def decode_many(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids, all lists at once."""
        if self._bytes is None:
            text = self.vocabulary.text
            sizes = np.zeros(max(text, default=0) + 1, dtype=np.int64)
            sizes[list(text)] = [len(x) for x in text.values()]
            joined = b"".join(text[i] for i in sorted(text))
            self._bytes = np.frombuffer(joined, dtype=np.uint8), np.cumsum(sizes) - sizes, sizes
        data, starts, sizes = self._bytes
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        own = sizes[flat]
        ends = np.cumsum(own)
        places = np.repeat(starts[flat] - ends + own, own) + np.arange(int(ends[-1]) if len(ends) else 0)
        counts = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        offsets = np.concatenate([[0], ends])[counts].astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(ids), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[places].tobytes())])
        return found.cast(pa.binary())

    def appended(self, ids: list[int], more: str) -> list[int]:
        """The ids of the decoded text with ``more`` behind it.

        A match can only change if it had seen the end of the text: the last two may.
        """
        text = self.decode(ids).decode()
        starts = [m.start() for m in self.pattern.finditer(text)]
        cut = starts[-2] if len(starts) > 1 else 0
        redone = len(self.ids(text[cut:]))
        return ids[: len(ids) - redone] + self.ids(text[cut:] + more)


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(shared, pattern: str = "") -> Encoder:
    """A worker's encoder for a vocabulary and pattern."""
    key = (hash(shared.value), pattern)
    if key not in _encoders:
        if len(_encoders) >= 4:
            _encoders.clear()
        _encoders[key] = Encoder(read_ranks(shared.value), pattern)
    return _encoders[key]


def _share(spark: SparkSession, path: str):
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _mapped(df: DataFrame, keep: list[str], name: str, kind: T.DataType,
            made: Callable[[pa.RecordBatch], Iterator[pa.Array]]) -> DataFrame:
    """``df`` with a column that ``made`` computes for slices of each batch."""
    kept = [c for c in keep if c.lower() != name.lower()]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), made(part)], [*kept, name])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids",
           keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``, default all) with the token ids of ``text``, array<int>."""
    shared = _share(df.sparkSession, vocabulary)

    def made(part: pa.RecordBatch) -> pa.Array:
        encoder = _encoder(shared, pattern)
        found = encoder.many([(x or b"").decode() for x in as_bytes(part, text)])
        offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
        values = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(offsets[-1]))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    return _mapped(df, df.columns if keep is None else keep, ids, T.ArrayType(T.IntegerType()), made)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", data: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for; null or no ids: no bytes."""
    shared = _share(df.sparkSession, vocabulary)

    def made(part: pa.RecordBatch) -> pa.Array:
        return _encoder(shared).decode_many(part.column(ids))

    return _mapped(df, df.columns if keep is None else keep, data, T.BinaryType(), made)


def append(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", more: str = "more",
           out: str = "ids") -> DataFrame:
    """``df`` with the ids of its encoded text lengthened by ``more``; nothing before the border is redone."""
    shared = _share(df.sparkSession, vocabulary)

    def made(part: pa.RecordBatch) -> pa.Array:
        encoder = _encoder(shared, pattern)
        rows = zip(part.column(ids).to_pylist(), as_bytes(part, more))
        return pa.array([encoder.appended(a or [], (b or b"").decode()) for a, b in rows], pa.list_(pa.int32()))

    return _mapped(df, df.columns, out, T.ArrayType(T.IntegerType()), made)
