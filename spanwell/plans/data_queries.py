"""Words, matrices, generated values and scalar forms over the given tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from spanwell.functions import names
from spanwell.functions.scalars import add_arrays, decode_config, encode_config
from spanwell.operators import generate, matrix, words
from spanwell.plans.inputs import spread_table, table
from spanwell.plans.registry import query
from spanwell.session import settled

WORDS_SQL = """
SELECT lower(word) AS word, count(*) AS count FROM (
  SELECT unnest(string_split(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'), ' ')) AS word FROM {0})
WHERE word <> '' GROUP BY lower(word)"""


@query("word_count", WORDS_SQL.format("documents"))
def word_count(spark, sf):
    return words.word_count(spread_table(spark, sf, "documents"))


@query("top_word", WORDS_SQL.format("documents") + " ORDER BY count DESC, word LIMIT 1")
def top_word(spark, sf):
    return words.top_words(words.word_count(spread_table(spark, sf, "documents")))


@query("merged_counts", f"""
SELECT word, CAST(sum(count) AS BIGINT) AS count FROM (
  ({WORDS_SQL.format("documents")}) UNION ALL ({WORDS_SQL.format("conversations")})) GROUP BY word""")
def merged_counts(spark, sf):
    return words.merge_counts(
        words.word_count(spread_table(spark, sf, "documents")),
        words.word_count(spread_table(spark, sf, "conversations")))


@query("source_word_count", """
SELECT source, lower(word) AS word, count(*) AS count FROM (
  SELECT source, unnest(string_split(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'), ' ')) AS word
  FROM documents)
WHERE word <> '' GROUP BY source, lower(word)""")
def source_word_count(spark, sf):
    found = spread_table(spark, sf, "documents").select("source", F.explode(words.words(F.col("text"))).alias("word"))
    return found.groupBy("source", "word").agg(F.count(F.lit(1)).alias("count"))


VOCABULARY_SQL = """
vocab AS (
  SELECT word, count(*) AS count FROM (
    SELECT unnest(string_split(trim(regexp_replace(line, '[^a-zA-Z'']+', ' ', 'g')), ' ')) AS word
    FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))
  GROUP BY word
)"""


@query("vocabulary", f"WITH {VOCABULARY_SQL} SELECT word, count FROM vocab")
def vocabulary(spark, sf):
    return words.vocabulary(spread_table(spark, sf, "documents"))


def _splits(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("split_id"))


def _vocabulary(spark, sf):
    """Counted once and kept: the draws need it in several ways."""
    return settled(words.vocabulary(spread_table(spark, sf, "documents")), "vocabulary")


@query("generated_words", f"""WITH {VOCABULARY_SQL},
starts AS (
  SELECT word, sum(count) OVER (ORDER BY word) - count AS start,
         sum(count) OVER (ORDER BY word) AS past, sum(count) OVER () AS total FROM vocab),
draws AS (
  SELECT doc_id AS split_id, pos,
         CAST(('0x' || substr(md5('7:' || doc_id || ':' || pos), 1, 13)) AS BIGINT)
           % (SELECT sum(count) FROM vocab) AS place
  FROM documents, (SELECT CAST(unnest(range(20)) AS INTEGER) AS pos))
SELECT split_id, pos, word FROM draws JOIN starts ON place >= start AND place < past""")
def generated_words(spark, sf):
    return words.generate_text(_splits(spark, sf), _vocabulary(spark, sf), 20, seed=7)


@query("generated_text", f"""WITH {VOCABULARY_SQL},
starts AS (
  SELECT word, sum(count) OVER (ORDER BY word) - count AS start,
         sum(count) OVER (ORDER BY word) AS past FROM vocab),
draws AS (
  SELECT doc_id AS split_id, pos,
         CAST(('0x' || substr(md5('1:' || doc_id || ':' || pos), 1, 13)) AS BIGINT)
           % (SELECT sum(count) FROM vocab) AS place
  FROM documents, (SELECT CAST(unnest(range(12)) AS INTEGER) AS pos))
SELECT split_id, string_agg(word, ' ' ORDER BY pos) AS text
FROM draws JOIN starts ON place >= start AND place < past GROUP BY split_id""")
def generated_text(spark, sf):
    return words.split_texts(
        words.generate_text(_splits(spark, sf), _vocabulary(spark, sf), 12, seed=1))


def _add_up(by: list[str]):
    def merge(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        both = pd.concat([x, y], ignore_index=True)
        return both.groupby(by, as_index=False, sort=False).agg(
            {"ct": "sum", "total": "sum", "low": "min", "high": "max"})

    return merge


def _quantities(spark, sf):
    whole = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return table(spark, sf, "lineitem").select(
        "l_suppkey", F.lit(1).cast("bigint").alias("ct"), whole.alias("total"),
        whole.alias("low"), whole.alias("high"))


QUANTITY_SQL = """count(*) AS ct, CAST(sum(p) AS BIGINT) AS total, min(p) AS low, max(p) AS high
FROM (SELECT l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS p FROM lineitem)"""


@query("tree_reduced", f"SELECT {QUANTITY_SQL}")
def tree_reduced(spark, sf):
    rows = _quantities(spark, sf).withColumn("l_suppkey", F.lit(0).cast("bigint"))
    return words.tree_reduce(rows, _add_up(["l_suppkey"])).drop("l_suppkey")


@query("tree_reduced_by_key", f"SELECT l_suppkey, {QUANTITY_SQL} GROUP BY l_suppkey")
def tree_reduced_by_key(spark, sf):
    return words.tree_reduce(_quantities(spark, sf), _add_up(["l_suppkey"]), keys=["l_suppkey"])


CELLS_SQL = """
cells AS (
  SELECT vec_id AS "row", CAST(unnest(range(len(embedding))) AS BIGINT) AS col,
         CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings
)"""


def _cells(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v")
    ).select("row", F.col("col").cast("bigint").alias("col"), F.col("v").cast("double").alias("v"))


@query("matrix_product", f"""WITH {CELLS_SQL}
SELECT a.col AS "row", b.col AS col, round(sum(a.v * b.v), 4) + 0.0 AS v
FROM cells a JOIN cells b ON a."row" = b."row" GROUP BY a.col, b.col""")
def matrix_product(spark, sf):
    vectors = table(spark, sf, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).scalar()
    x = matrix.vectors_to_blocks(vectors, "vec_id", "embedding", 32)
    rows = vectors.agg(F.max("vec_id")).scalar()
    wide, tall = F.ceil(width / 32), F.floor(rows / 32) + 1
    grid = vectors.select(wide.alias("wide"), tall.alias("tall")).limit(1).first()
    made = matrix.multiply_blocks(matrix.transpose_blocks(x, 32), x, 32, grid=(grid.wide, grid.tall, grid.wide))
    return matrix.from_blocks(made, 32, width, width).select(
        "row", "col", (F.round("v", 4) + 0.0).alias("v"))


@query("cell_product", f"""WITH {CELLS_SQL}
SELECT a.col AS "row", b.col AS col, round(sum(a.v * b.v), 4) + 0.0 AS v
FROM cells a JOIN cells b ON a."row" = b."row" GROUP BY a.col, b.col""")
def cell_product(spark, sf):
    cells = _cells(spark, sf)
    turned = matrix.transpose_cells(cells)
    return matrix.multiply_cells(turned, cells).select(
        "row", "col", (F.round("v", 4) + 0.0).alias("v"))


@query("transposed", f"""WITH {CELLS_SQL} SELECT col AS "row", "row" AS col, v FROM cells""")
def transposed(spark, sf):
    return matrix.transpose_cells(_cells(spark, sf))


@query("transposed_ragged", """
WITH cells AS (
  SELECT p_partkey AS "row", CAST(c.col AS BIGINT) AS col, p_size * 100 + c.col AS v
  FROM part, (SELECT unnest(range(60)) AS col) c WHERE c.col < p_size + 2)
SELECT col AS "row", "row" AS col, CAST(v AS DOUBLE) AS v FROM cells
WHERE col < (SELECT min(p_size) + 2 FROM part)""")
def transposed_ragged(spark, sf):
    cells = table(spark, sf, "part").select(
        F.col("p_partkey").alias("row"), "p_size",
        F.explode(F.sequence(F.lit(0), F.col("p_size") + 1)).alias("col"),
    ).select("row", F.col("col").cast("bigint").alias("col"),
             (F.col("p_size") * 100 + F.col("col")).cast("double").alias("v"))
    return matrix.transpose_cells(cells)


@query("random_matrix", """
SELECT p_partkey AS "row", c.col,
       CAST(('0x' || substr(md5('3:' || p_partkey || ':' || c.col), 1, 13)) AS BIGINT)
         / 4503599627370496.0::DOUBLE AS v
FROM part, (SELECT CAST(unnest(range(16)) AS BIGINT) AS col) c""")
def random_matrix(spark, sf):
    cols = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))).alias("col")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("row"), cols).withColumn(
        "v", matrix.uniform_cell(3, F.col("row"), F.col("col")))


@query("random_blocks", """
SELECT p_partkey AS i, CAST(0 AS BIGINT) AS j, list_transform(range(64), lambda p:
       CAST(('0x' || substr(md5('5:' || (p_partkey * 8 + p // 8) || ':' || (p % 8)), 1, 13)) AS BIGINT)
         / 4503599627370496.0::DOUBLE) AS v
FROM part""")
def random_blocks(spark, sf):
    parts = spread_table(spark, sf, "part", "p_partkey")
    places = parts.select(F.col("p_partkey").alias("i"), F.lit(0).cast("bigint").alias("j"))
    return matrix.generate_blocks(places, 8, seed=5)


@query("array_sums", """
SELECT vec_id, CAST(i AS INTEGER) AS pos, round(CAST(embedding[i + 1] AS DOUBLE) + embedding[64 - i], 5) + 0.0 AS v
FROM embeddings, range(64) t(i)""")
def array_sums(spark, sf):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode(add_arrays(v, F.reverse(v))).alias("pos", "v")
    ).withColumn("v", F.round("v", 5) + 0.0)


@query("chunks", """
SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)
         // (((SELECT count(*) FROM orders) - 1) // 7 + 1) AS chunk
FROM orders""")
def chunks(spark, sf):
    return matrix.chunk_rows(table(spark, sf, "orders"), ["o_orderkey"], 7).select("o_orderkey", "chunk")


@query("chunk_sizes", """
WITH c AS (
  SELECT l_orderkey, (row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey,
                                                  l_linenumber, l_extendedprice) - 1)
           // (((SELECT count(*) FROM lineitem) - 1) // 13 + 1) AS chunk
  FROM lineitem)
SELECT chunk, count(*) AS rows, min(l_orderkey) AS low, max(l_orderkey) AS high FROM c GROUP BY chunk""")
def chunk_sizes(spark, sf):
    order = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    cut = matrix.chunk_rows(table(spark, sf, "lineitem").select(*order), order, 13)
    return cut.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("rows"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))


@query("array_chunks", """
WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS words FROM conversations),
s AS (SELECT *, (len(words) - 1) // 4 + 1 AS size FROM w)
SELECT conv_id, turn, CAST(c AS INTEGER) AS chunk,
       array_to_string(words[c * size + 1 : (c + 1) * size], ' ') AS part
FROM s, range(4) t(c) WHERE c * size < len(words)""")
def array_chunks(spark, sf):
    parts = matrix.chunk_array(F.split("text", " "), 4)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(parts).alias("chunk", "words")
    ).select("conv_id", "turn", "chunk", F.array_join("words", " ").alias("part"))


@query("generated_strings", """
SELECT doc_id, repeat('a', CAST(n_chars AS BIGINT)) AS v FROM documents""")
def generated_strings(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", generate.generated("nstring", F.col("n_chars")).alias("v"))


@query("generated_pairs", """
SELECT p_partkey, CAST(i AS BIGINT) AS k, CAST(i AS BIGINT) AS v
FROM (SELECT p_partkey, unnest(range(p_size)) AS i FROM part)""")
def generated_pairs(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.explode(generate.generated("pairs", F.col("p_size"))).alias("k", "v"))


@query("generated_ones", """
SELECT p_partkey, p_size AS ones, CAST(p_size AS DOUBLE) AS floats FROM part""")
def generated_ones(spark, sf):
    ones = generate.generated("ones_array", F.col("p_size"))
    floats = generate.generated("np_ones", F.col("p_size"))
    return table(spark, sf, "part").select(
        "p_partkey",
        F.aggregate(ones, F.lit(0), lambda a, x: a + x).alias("ones"),
        F.aggregate(floats, F.lit(0.0), lambda a, x: a + x).alias("floats"))


@query("generated_ints", """
SELECT p_partkey, CAST(i AS INTEGER) AS pos,
       CAST(CAST(('0x' || substr(md5('9:' || p_partkey || ':' || i), 1, 13)) AS BIGINT) % 100 AS INTEGER) AS v
FROM (SELECT p_partkey, unnest(range(p_size)) AS i FROM part)""")
def generated_ints(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        F.posexplode(generate.generated("randints", F.col("p_size"), F.col("p_partkey"), 9)).alias("pos", "v"))


@query("scale_series", """
SELECT o_orderkey, l AS iteration, CAST(round(pow(10.0, l)) AS BIGINT) AS tens,
       CAST(floor(pow(2.0, l / 4.0)) AS BIGINT) AS doublings, CAST(100 * l AS BIGINT) AS tasks
FROM (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS l FROM orders)""")
def scale_series(spark, sf):
    step = F.substring("o_orderpriority", 1, 1).cast("bigint")
    return table(spark, sf, "orders").select("o_orderkey", step.alias("iteration")).select(
        "o_orderkey", "iteration",
        generate.ten_to_the(F.col("iteration")).alias("tens"),
        generate.quarter_doublings(F.col("iteration")).alias("doublings"),
        generate.tasks_for_workers(F.col("iteration")).alias("tasks"))


@query("sweep_sizes", """
SELECT p_partkey, CAST(i AS BIGINT) AS num_nodes, CAST(i * 4 AS BIGINT) AS num_workers
FROM (SELECT p_partkey, unnest(range(1, p_size + 1, 3)) AS i FROM part)""")
def sweep_sizes(spark, sf):
    p = table(spark, sf, "part").withColumn("sweep", F.format_string("1:%d:3", F.col("p_size")))
    return generate.sweep_sizes(p, "sweep", F.lit(4).cast("bigint")).select(
        "p_partkey", "num_nodes", "num_workers")


@query("date_labels", """
SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%Y%m%d %H:%M:%S') AS label
FROM events""")
def date_labels(spark, sf):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf, "events").select("event_id", names.date_label(seconds).alias("label"))


@query("encoded_configs", """
SELECT c_custkey, base64(encode('{"name":"' || c_name || '","nation":' || c_nationkey || '}')) AS encoded,
       c_name AS name, c_nationkey AS nation FROM customer""")
def encoded_configs(spark, sf):
    config = F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    encoded = table(spark, sf, "customer").select("c_custkey", encode_config(config).alias("encoded"))
    return encoded.withColumn("c", decode_config(F.col("encoded"), "name string, nation int")).select(
        "c_custkey", "encoded", "c.name", "c.nation")


@query("path_names", """
SELECT page_id, regexp_extract(path, '[^/]*$') AS base,
       regexp_replace(regexp_extract(path, '[^/]*$'), '([^.])[.][^.]*$', '\\1') AS stem
FROM (SELECT page_id, url || '.tar.gz' AS path FROM pages)""")
def path_names(spark, sf):
    path = F.concat("url", F.lit(".tar.gz"))
    base = names.base_name(path)
    return table(spark, sf, "pages").select(
        "page_id", base.alias("base"), names.without_extension(base).alias("stem"))


@query("numeric_forms", """
SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, CAST(ceil(sqrt(p_size)) AS BIGINT) AS side,
       ((p_partkey * 60013 + p_size) % 4294967296) AS seed, p_brand || ':' || p_type || ':' || p_name AS key,
       starts_with(p_name, 'small') AS small
FROM part""")
def numeric_forms(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.round(F.sqrt("p_retailprice"), 6).alias("root"),
        F.ceil(F.sqrt("p_size")).alias("side"),
        F.pmod(F.col("p_partkey") * 60013 + F.col("p_size"), F.lit(4294967296)).alias("seed"),
        F.concat_ws(":", "p_brand", "p_type", "p_name").alias("key"),
        F.col("p_name").startswith("small").alias("small"))
