"""Token ids in files of grammar-compressed blocks (Re-Pair).

A dataset of ids is a folder of Parquet files whose rows are blocks: consecutive documents of one
shard, in ascending order of document, and a payload. In a payload, frequent pairs of ids are
replaced by nonterminals again and again; it holds the rules, how many ids each nonterminal
expands to, the remaining symbols and the documents' lengths, so any range of ids is
decoded from the symbols that cover it. The pairs of a round are all those at least an eighth as
frequent as the most frequent one; where two overlap, the left one is replaced.

Payload, all numbers little-endian and unsigned of 32 bits: the format mark, the first
nonterminal, the number of rules, symbols and documents; then the rules as pairs of symbols, the
rules' expansion lengths, the symbols, the documents' lengths.

Spark's committed writers put the files down, so a lost executor leaves no half block behind, and
all stores that Spark reaches will do. Shards are ranges of the order columns and blocks have
about ``BLOCK`` ids, however the rows are spread over documents.

Defined cases: a null or empty text has just the end id; documents of equal id keep one
consistent order (by a hash of the text); a null doc_id comes first; an empty table makes an empty
folder of files; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwell.llm.common import column
from spanwell.session import settled

#: Ids after which a block is closed.
BLOCK = 1 << 20
#: Words that a worker remembers in each of two generations.
REMEMBERED = 800_000
MARK = b"RPG1"
#: Cells in which pairs are counted roughly before the frequent ones are counted exactly.
HASH_BITS = 18
#: Marks that may end a word of letters without becoming one unit with it.
CLOSING = ".,;:!?*%&#$|"


# -- grammar ---------------------------------------------------------------------------------

def compress(ids: np.ndarray, first: int, least: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs of symbols), their expansion lengths, and the remaining symbols.

    ``first`` is the first nonterminal, above all ids. Pairs that occur less than ``least``
    times stay.
    """
    symbols = ids.astype(np.uint32)
    rules, lengths, n_rules = [], np.zeros(0, dtype=np.int64), 0
    while len(symbols) > 1:
        cells = _cells(symbols[:-1], symbols[1:])
        sums = np.bincount(cells, minlength=1 << HASH_BITS)
        most = int(sums.max())
        at, pairs, found, counts = _frequent(symbols, cells, sums >= max(least, most // 16))
        if len(found) and counts.max() < most // 2:  # several pairs share the fullest cell
            at, pairs, found, counts = _frequent(symbols, cells, sums >= least)
        if not len(found) or counts.max() < least:
            break
        chosen = found[counts >= max(least, int(counts.max()) // 8)]
        # places where a chosen pair begins; of chosen pairs in one cell all but one wait for the next round
        in_cell = np.full(1 << HASH_BITS, -1, dtype=np.int32)
        in_cell[_cells((chosen >> np.uint64(32)).astype(np.uint32), chosen.astype(np.uint32))] = np.arange(len(chosen))
        which = in_cell[cells[at]]
        hit = (which >= 0) & (chosen[which] == pairs)
        at, which = at[hit], which[hit]
        # of places in a row every second one is free
        new_row = np.concatenate([[True], np.diff(at) > 1])
        row_start = np.maximum.accumulate(np.where(new_row, np.arange(len(at)), 0))
        free = (np.arange(len(at)) - row_start) % 2 == 0
        at, which = at[free], which[free]
        used = np.zeros(len(chosen), dtype=bool)
        used[which] = True
        number = np.cumsum(used) - 1
        left, right = chosen[used] >> np.uint64(32), chosen[used] & np.uint64(0xFFFFFFFF)
        rules.append(np.column_stack([left, right]))
        lengths = np.concatenate([lengths, _expansion(left, first, lengths) + _expansion(right, first, lengths)])
        symbols[at] = first + n_rules + number[which]
        n_rules += int(used.sum())
        stays = np.ones(len(symbols), dtype=bool)
        stays[at + 1] = False
        symbols = symbols[stays]
    if not rules:
        return np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32), symbols
    return np.concatenate(rules).astype(np.uint32), lengths.astype(np.uint32), symbols


def _pairs(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    return symbols[at].astype(np.uint64) << np.uint64(32) | symbols[at + 1]


def _cells(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A rough place to count each pair of 32-bit symbols in, as an index."""
    mixed = left * np.uint32(0x9E3779B1)
    mixed += right * np.uint32(0x85EBCA77)
    mixed >>= np.uint32(32 - HASH_BITS)
    return mixed.astype(np.intp)


def _frequent(symbols: np.ndarray, cells: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places whose pair falls into a full cell, their pairs, the distinct pairs and their counts."""
    at = np.flatnonzero(full[cells])
    pairs = _pairs(symbols, at)
    ordered = np.sort(pairs)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return at, pairs, ordered[starts], np.diff(np.append(starts, len(ordered)))


def _expansion(symbols: np.ndarray, first: int, lengths: np.ndarray) -> np.ndarray:
    """To how many ids each symbol expands."""
    out = np.ones(len(symbols), dtype=np.int64)
    inner = symbols >= first
    out[inner] = lengths[(symbols[inner] - np.uint64(first)).astype(np.int64)] if len(lengths) else 0
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for."""
    symbols = symbols.astype(np.int64)
    while True:
        inner = symbols >= first
        if not inner.any():
            return symbols.astype(np.uint32)
        place = np.cumsum(inner + 1) - inner - 1
        out = np.empty(len(symbols) + int(inner.sum()), dtype=np.int64)
        out[place] = symbols
        pairs = rules[symbols[inner] - first]
        out[place[inner]] = pairs[:, 0]
        out[place[inner] + 1] = pairs[:, 1]
        symbols = out


def pack(ids: np.ndarray, lengths: np.ndarray, first: int) -> bytes:
    """A payload of documents with these lengths."""
    rules, expansions, symbols = compress(ids, first)
    head = MARK + struct.pack("<4I", first, len(rules), len(symbols), len(lengths))
    return head + b"".join(x.astype("<u4").tobytes() for x in (rules.ravel(), expansions, symbols, lengths))


class Payload:
    """A payload opened for reading."""

    def __init__(self, data: bytes):
        if data[:4] != MARK:
            raise ValueError("not a block of token ids")
        self.first, n_rules, n_symbols, n_docs = struct.unpack_from("<4I", data, 4)
        numbers = np.frombuffer(data, dtype="<u4", offset=20)
        rules, self.expansions, self.symbols, self.lengths = np.split(
            numbers, np.cumsum([2 * n_rules, n_rules, n_symbols])
        )
        self.rules = rules.reshape(-1, 2).astype(np.int64)
        self._written: np.ndarray | None = None

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        return _expansion(symbols.astype(np.uint64), self.first, self.expansions.astype(np.int64))

    def _expand(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """All rules are written out once; then each symbol is one copy of a stretch of them, or of itself."""
        if self._written is None:
            self._written = expand(np.arange(self.first, self.first + len(self.rules)), self.rules, self.first)
        from_ = np.arange(len(self._written), len(self._written) + len(symbols))
        inner = np.flatnonzero(symbols >= self.first)
        rule_starts = np.cumsum(self.expansions, dtype=np.int64) - self.expansions
        from_[inner] = rule_starts[symbols[inner].astype(np.int64) - self.first]
        steps = np.repeat(from_ - np.cumsum(sizes) + sizes, sizes)
        steps += np.arange(len(steps))
        return np.concatenate([self._written, symbols])[steps]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` to ``stop``, expanding only the symbols that cover them."""
        sizes = self._sizes(self.symbols)
        ends = np.cumsum(sizes)
        stop = int(ends[-1]) if stop is None and len(ends) else stop or 0
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        a = int(np.searchsorted(ends, start, side="right"))
        b = int(np.searchsorted(ends, stop, side="left"))
        before = int(ends[a - 1]) if a else 0
        return self._expand(self.symbols[a: b + 1], sizes[a: b + 1])[start - before: stop - before]

    def document(self, index: int) -> np.ndarray:
        start = int(self.lengths[:index].sum(dtype=np.int64))
        return self.ids(start, start + int(self.lengths[index]))


# -- tokens ----------------------------------------------------------------------------------

def by_size(batch: pa.RecordBatch, name: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of a string column each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(batch):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _names(words: pa.Array) -> list[bytes]:
    """The bytes of large strings without nulls."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[words.offset: words.offset + len(words) + 1]
    text = data[int(ends[0]): int(ends[-1])].to_pybytes() if data else b""
    bounds = (ends - ends[0]).tolist()
    return [text[a:b] for a, b in zip(bounds, bounds[1:])]


def _only_letters(words: pa.Array, names: list[bytes]) -> np.ndarray:
    """Whether each word has letters only, lower-cased as the vocabulary does."""
    found = pc.ascii_is_alpha(words).to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)):
        found[i] = names[i].decode().lower().isalpha()
    return found


def _gathered(ids: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of runs of ids with these sizes, those at ``places``, one after the other."""
    starts, n = np.cumsum(sizes) - sizes, sizes[places]
    ends = np.cumsum(n)
    return ids[np.repeat(starts[places] - ends + n, n) + np.arange(int(n.sum()))]


class WordTokens:
    """Ids of a vocabulary that drops white space, word by word.

    Words are cut at ASCII white space and lower-cased over A-Z, which the vocabulary does anyway.
    Distinct words are looked up once for many texts, whose ids are then gathered as arrays.
    New words of letters only are encoded many at a time: each makes one unit, whose
    last token the vocabulary marks as a word's end. The strings of the vocabulary's special tokens
    stand for those tokens wherever a text holds them exactly, as is the library's default.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        # marks are cut out of a text before it is lower-cased; what then looks like one is ordinary text
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.first_free = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.first_free, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        added = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.marks = re.compile(b"(" + b"|".join(sorted(map(re.escape, added), key=len, reverse=True)) + b")") if added else None
        self.mark_ids = {content: struct.pack("<I", i) for content, i in added.items()}
        self.remembered = REMEMBERED
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: pa.Array) -> None:
        """Encode words that are not known yet."""
        known, names = self.known, _names(words)
        letters = _only_letters(words, names) & (pc.binary_length(words).to_numpy(zero_copy_only=False) < 1000)
        others, whole = [names[i] for i in np.flatnonzero(~letters)], [names[i] for i in np.flatnonzero(letters)]
        lines = [whole[i: i + 200] for i in range(0, len(whole), 200)]
        for start in range(0, len(lines), 10):
            part = lines[start: start + 10]
            for line, ids in zip(part, self._encoded([b" ".join(line).decode() for line in part])):
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) != len(line):  # a word of more units than one: each by itself
                    others += line
                    continue
                data, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
                known.update(zip(line, [data[a:b] for a, b in zip(bounds, bounds[1:])]))
        for start in range(0, len(others), 1000):
            part = others[start: start + 1000]
            for word, ids in zip(part, self._encoded([word.decode() for word in part])):
                known[word] = ids.tobytes()

    def _known_ids(self, words: pa.Array) -> list[bytes]:
        """The ids of distinct words; those of the generation before move to this one."""
        known, older = self.known, self.older
        names = _names(words)
        ids = list(map(known.get, names))
        missing = [i for i, found in enumerate(ids) if found is None]
        if missing:
            new = []
            for i in missing:
                found = older.get(names[i])
                if found is None:
                    new.append(i)
                else:
                    known[names[i]] = found
            if new:
                self._learn(words.take(pa.array(new)))
            for i in missing:
                ids[i] = known[names[i]]
        return ids

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after the other, and how many each has.

        Letters with marks behind them make two units, so only the letters are remembered, once for all marks.
        """
        stems = pc.utf8_rtrim(words, characters=CLOSING)
        n_marks = (pc.binary_length(words).to_numpy(zero_copy_only=False) - pc.binary_length(stems).to_numpy(zero_copy_only=False))
        closed = np.flatnonzero(n_marks)
        before_marks = stems.take(pa.array(closed))
        closed = closed[_only_letters(before_marks, _names(before_marks))]
        parted = np.zeros(len(words), dtype=bool)
        parted[closed] = True
        units = pc.if_else(pa.array(parted), stems, words).dictionary_encode()
        known = [b"", *self._known_ids(units.dictionary)]
        # two entries of ``known`` for each word; the first, without ids, where no marks follow
        entries = np.zeros((len(words), 2), dtype=np.int64)
        entries[:, 0] = units.indices.to_numpy() + 1
        for n in np.unique(n_marks[closed]).tolist():
            places = closed[n_marks[closed] == n]
            marks = pc.utf8_slice_codeunits(words.take(pa.array(places)), start=-n).dictionary_encode()
            entries[places, 1] = marks.indices.to_numpy() + len(known)
            known += self._known_ids(marks.dictionary)
        sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        ids = _gathered(np.frombuffer(b"".join(known), dtype="<u4"), sizes, entries.ravel())
        return ids, sizes[entries].sum(axis=1)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each UTF-8 text (none if it is null) as bytes of little-endian 32-bit numbers."""
        return self.encode_column(pa.array(texts, pa.large_binary()).cast(pa.large_string()))

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """The same for an array of strings."""
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        # taken, as lower-casing a slice of an array reads from the wrong place
        texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
        special = pc.match_substring_regex(texts, self.marks.pattern.decode()).to_numpy(False) if self.marks else np.zeros(len(texts), bool)
        if special.any():
            found = self.encode_column(pc.if_else(pa.array(special), "", texts))
            for i in np.flatnonzero(special):
                found[i] = self._around_marks(texts[i].as_py())
            return found
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = split.flatten().dictionary_encode()
        ids, sizes = self._ids_of(coded.dictionary)
        places = coded.indices.to_numpy()
        data = _gathered(ids, sizes, places).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes[places])])
        offsets = split.offsets.to_numpy()
        bounds = (4 * ends[offsets - offsets[0]]).tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]

    def _around_marks(self, text: str) -> bytes:
        """The ids of a text that holds special tokens' strings."""
        parts = self.marks.split(text.encode())
        plain = self.encode(parts[::2])
        return plain[0] + b"".join(self.mark_ids[mark] + ids for mark, ids in zip(parts[1::2], plain[1:]))


_tokens: dict[int, WordTokens] = {}


def shared_vocabulary(spark: SparkSession, vocabulary: str):
    """A vocabulary's file (under 2 MB) for all workers."""
    with open(vocabulary, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def word_tokens(shared) -> WordTokens:
    """A worker's tokens for a vocabulary."""
    key = hash(shared.value)
    if key not in _tokens:
        # a task has one core: the library's threads would mostly wait, which takes CPU time too
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _tokens.clear()
        _tokens[key] = WordTokens(shared.value)
    return _tokens[key]


# -- files -----------------------------------------------------------------------------------

def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all texts, each with ``end_id`` behind it, in ascending order of ``doc_id``."""
    shared = shared_vocabulary(docs.sparkSession, vocabulary)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            lengths = np.array([len(p) // 4 for p in parts], dtype=np.uint32)
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            payload = pack(ids, lengths, max(tokens.first_free, end_id + 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.array([names], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                ["shard", "block", "n_tokens", "doc_ids", "payload"],
            )

        for batch in batches:
            tokens = word_tokens(shared)
            for part in by_size(batch, "text", 8 << 20):
                for name, ids in zip(part.column("doc_id").to_pylist(), tokens.encode_column(part.column("text"))):
                    names.append(name)
                    parts.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= BLOCK:
                        yield block()
                        names, parts, held, number = [], [], 0, number + 1
        if parts:
            yield block()

    chosen = docs.select(column(doc_id).cast("bigint").alias("doc_id"), column(text).alias("text")).withColumn(
        "tie", F.xxhash64("text")
    )
    ordered = chosen.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    schema = "shard int, block int, n_tokens bigint, doc_ids array<bigint>, payload binary"
    ordered.mapInArrow(run, schema).write.parquet(path)


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a folder with ``start``, the number of ids in all blocks before.

    Shards are summed first: a window over one row for each shard, then one inside each shard.
    """
    blocks = spark.read.parquet(path)
    sizes = blocks.select("shard", "block", "n_tokens")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        F.col("shard").alias("of_shard"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start")
    )
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("shard").alias("of_shard"), F.col("block").alias("of_block"),
        F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("block_start"),
    ).join(shards, "of_shard").select("of_shard", "of_block", (F.col("shard_start") + F.col("block_start")).alias("start"))
    starts = settled(starts, "block-starts")  # a row for each block; its size tells the planner how to join
    met = (F.col("shard") == F.col("of_shard")) & (F.col("block") == F.col("of_block"))
    return blocks.join(starts, met).select("shard", "block", "start", "n_tokens", "doc_ids", "payload")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a folder of blocks: ``doc_id``, ``start``, ``n_tokens``, ``ids`` (bytes, 32-bit little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                payload = Payload(batch.column("payload")[i].as_py())
                data, lengths = payload.ids().astype("<u4").tobytes(), payload.lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths + batch.column("start")[i].as_py()
                names = batch.column("doc_ids")[i].values
                for a in range(0, len(lengths), 1024):
                    rows = range(a, min(a + 1024, len(lengths)))
                    texts = [data[4 * int(ends[r] - lengths[r]): 4 * int(ends[r])] for r in rows]
                    yield pa.RecordBatch.from_arrays(
                        [names.slice(a, len(rows)), pa.array(starts[a: a + 1024]), pa.array(lengths[a: a + 1024]), pa.array(texts, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return open_files(spark, path).select("start", "doc_ids", "payload").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    )


def checksum(ids: bytes) -> int:
    """What Spark's crc32 gives for the ids of one document."""
    return zlib.crc32(ids)
