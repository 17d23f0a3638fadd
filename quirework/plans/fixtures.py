"""Inputs for the queries, derived from the driver's tables by the same arithmetic in Spark and in SQL.

The tables hold no page geometry and hardly any academic tokens, so sentences, boxes, types and labels are made from
keys; expected results then follow from the keys, without a regular expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a file too small to be split for all cores, dealt to all of them; a larger table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Class c of a sentence: 0 another unit, 1 no citation, 2 another number, 3 empty, 4 unchanged, 5 reordered, 6 one number more, 7 to 9 clean.
SENTENCE = "concat('Fig. ', n, ' shows ', q, ' MHz at ', d, '% [', k, '].')"
TRANSLATION = (
    "CASE c WHEN 0 THEN concat('Fig. ', n, ' shows ', q, ' GHz at ', d, '% [', k, '].') WHEN 1 THEN concat('Fig. ', n, ' shows ', q, ' MHz at ', d, '%.') WHEN 2 THEN concat('Fig. ', n, ' shows ', q + 1, ' MHz at ', d, '% [', k, '].') "
    "WHEN 3 THEN '' WHEN 4 THEN source WHEN 5 THEN concat('[', k, '] ', d, '% at ', q, ' MHz, Fig. ', n, '.') WHEN 6 THEN concat(source, ' 7') ELSE concat('→ ', source) END"
)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS o", "l_partkey AS part", "CAST(l_linenumber AS BIGINT) AS n", "l_suppkey AS k", "CAST(l_quantity AS BIGINT) AS q", "CAST(round(l_discount * 100) AS BIGINT) AS d", "(l_orderkey + l_linenumber) % 10 AS c")
    return spread(keys).withColumn("source", F.expr(SENTENCE)).withColumn("translation", F.expr(TRANSLATION))


SENTENCES_SQL = "s AS (SELECT l_orderkey AS o, l_partkey AS part, CAST(l_linenumber AS BIGINT) AS n, l_suppkey AS k, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d, (l_orderkey + l_linenumber) % 10 AS c FROM lineitem)"


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS document_id", "posexplode(split(text, '\\n')) AS (p, line)").selectExpr("document_id", "CAST(p AS BIGINT) AS pos", "line")


LINES_SQL = "l AS (SELECT doc_id AS document_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"

GEOMETRY = {
    "page": "CAST(1 + floor(pos / 12) AS INT)",
    "native": "CAST(floor((pos % 12) / 3) AS INT)",
    "line_no": "pos",
    "x0": "CAST(CASE (document_id + CAST(floor((pos % 12) / 3) AS BIGINT)) % 3 WHEN 1 THEN 320 ELSE 50 END + CASE WHEN pos % 10 = 9 THEN 250 ELSE 0 END AS DOUBLE)",
    "y0": "CAST(40 + 55 * (pos % 12) + CASE WHEN pos % 7 = 3 THEN 30 ELSE 0 END AS DOUBLE)",
    "x1": "CAST(CASE (document_id + CAST(floor((pos % 12) / 3) AS BIGINT)) % 3 WHEN 0 THEN 280 ELSE 550 END AS DOUBLE)",
    "y1": "CAST(88 + 55 * (pos % 12) + CASE WHEN pos % 7 = 3 THEN 30 ELSE 0 END AS DOUBLE)",
    "size": "CAST(10 + CASE WHEN pos % 6 = 0 THEN 4 ELSE 0 END AS DOUBLE)",
    "dir_y": "CASE WHEN document_id % 17 = 0 THEN 0.5 ELSE 0.0 END",
}


def geometry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_lines(spark, sf_dir).selectExpr("document_id", "line AS text", *[f"{v} AS {k}" for k, v in GEOMETRY.items()], "600D AS width", "800D AS height")
    return rows.withColumn("fonts", F.array(F.struct("size", F.length("text").alias("chars")))).drop("size")


GEOMETRY_SQL = f"{LINES_SQL}, gl AS (SELECT document_id, line AS text, {', '.join(f'{v} AS {k}' for k, v in GEOMETRY.items())} FROM l WHERE length(trim(line)) > 0)"

SIDE_CODE = "(document_id * 7 + pos * 3) % 5"
BOXES = {
    "page": "CAST(1 + floor(pos / 9) AS INT)",
    "seq": "pos % 9",
    "x0": f"CAST(CASE WHEN {SIDE_CODE} IN (2, 3) THEN 320 ELSE 50 END AS DOUBLE)",
    "x1": f"CAST(CASE WHEN {SIDE_CODE} IN (0, 1) THEN 280 ELSE 550 END AS DOUBLE)",
    "y0": f"CAST(CASE WHEN pos % 9 = 0 AND document_id % 4 = 0 THEN 10 WHEN pos % 9 = 8 AND document_id % 2 = 0 THEN 770 ELSE 70 + 40 * floor((pos % 9) / 2) + CASE WHEN {SIDE_CODE} IN (2, 3) THEN 7 * (document_id % 3) ELSE 0 END END AS DOUBLE)",
    "y1": f"CAST(CASE WHEN pos % 9 = 0 AND document_id % 4 = 0 THEN 30 WHEN pos % 9 = 8 AND document_id % 2 = 0 THEN 790 ELSE 105 + 40 * floor((pos % 9) / 2) + CASE WHEN {SIDE_CODE} IN (2, 3) THEN 7 * (document_id % 3) ELSE 0 END END AS DOUBLE)",
    "font_size": "CAST(10 + CASE WHEN pos % 6 = 0 THEN 3 WHEN pos % 23 = 5 THEN 5 ELSE 0 END AS DOUBLE)",
    "text": "CASE pos % 10 WHEN 0 THEN 'Introduction' WHEN 1 THEN concat('Fig. ', pos, ' shows') WHEN 2 THEN '12' WHEN 3 THEN 'a = b' WHEN 4 THEN 'IV. Results of' WHEN 5 THEN CASE WHEN document_id % 3 = 0 THEN 'References' ELSE 'Table II: x' END ELSE line END",
}


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_lines(spark, sf_dir).selectExpr("document_id", "pos", "concat('b', pos) AS block_id", *[f"{v} AS {k}" for k, v in BOXES.items()], "600D AS width", "800D AS height", "0.85D AS confidence")
    return rows.withColumn("fonts", F.array(F.struct(F.col("font_size").alias("size"), F.length("text").alias("chars")))).withColumn("warnings", F.array().cast("array<string>"))


BOXES_SQL = f"{LINES_SQL}, g AS (SELECT document_id, pos, concat('b', pos) AS block_id, {', '.join(f'{v} AS {k}' for k, v in BOXES.items())} FROM l)"

TYPED = {
    "page": "CAST(1 + floor(pos / 8) AS INT)",
    "position": "pos % 8",
    "block_id": "concat('b', pos)",
    "block_type": "CASE WHEN pos % 9 = 0 THEN 'section_title' WHEN pos % 11 = 10 THEN 'header' WHEN pos % 13 = 12 THEN 'equation' ELSE 'paragraph' END",
    "section": "CASE WHEN pos < 5 THEN 'Abstract' ELSE concat('s', CAST(floor(pos / 5) AS BIGINT) % 3) END",
}


def typed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).selectExpr("document_id", "pos", "line AS text", *[f"{v} AS {k}" for k, v in TYPED.items()])


TYPED_SQL = f"{LINES_SQL}, t AS (SELECT document_id, pos, line AS text, {', '.join(f'{v} AS {k}' for k, v in TYPED.items())} FROM l)"
