"""A workspace of labelled documents: manifest, document trees, labels and reports in one folder that Spark can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id
from ..operators.evaluate import draft_labels, fingerprint

MANIFEST = "document_id string, filename string, split string, domain string, notes string, status string, source_fingerprint string"
SPLITS = ("calibration", "test")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def init_workspace(spark: SparkSession, path: str, name: str, description: str = "") -> None:
    """An empty manifest under path; ValueError if there is one."""
    if _exists(spark, f"{path}/workspace"):
        raise ValueError(f"{path} is a workspace already")
    spark.createDataFrame([(name, description)], "name string, description string").coalesce(1).write.json(f"{path}/workspace")
    spark.createDataFrame([], MANIFEST).write.parquet(f"{path}/manifest")


def load_workspace(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The name and the manifest; ValueError without one."""
    if not _exists(spark, f"{path}/workspace"):
        raise ValueError(f"{path} is no workspace")
    return spark.read.schema("name string").json(f"{path}/workspace").first()[0], spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def add_documents(files: DataFrame, blocks: DataFrame, path: str, split: str = "calibration", domain: str = "", notes: str = "", box: tuple[str, ...] = ()) -> None:
    """Appends documents with draft labels. files: filename, document_id (of the blocks), content. blocks: document_id, page, position, block_id, block_type, text and the columns of box.

    ValueError, and nothing written, if a file's content has another id, if its document is there already or twice among
    files, or if it has no blocks.
    """
    spark = files.sparkSession
    _, manifest = load_workspace(spark, path)
    if split not in SPLITS:
        raise ValueError(f"a split is one of {', '.join(SPLITS)}")
    own = files.select("filename", "document_id", content_id(F.col("content")).alias("found"), "content")
    seen = own.groupBy("document_id").agg(F.count("*").alias("n"))
    print_of = fingerprint(blocks, *box)
    stated = own.join(seen, "document_id").join(manifest.select("document_id").distinct().withColumn("known", F.lit(True)), "document_id", "left").join(print_of, "document_id", "left")
    reasons = {"the content of {} has another id": F.col("found") != F.col("document_id"), "{} is in the workspace already": F.col("known"), "{} is given twice": F.col("n") > 1, "{} has no blocks": F.col("fingerprint").isNull()}
    wrong = F.coalesce(*[F.when(test, F.lit(text)) for text, test in reasons.items()])
    bad = stated.select("filename", wrong.alias("wrong")).filter("wrong is not null").first()
    if bad:
        raise ValueError(bad["wrong"].format(bad["filename"]))
    mine = blocks.join(own.select("document_id"), "document_id", "left_semi")
    own.select("document_id", "content").write.mode("append").parquet(f"{path}/sources")
    mine.write.mode("append").parquet(f"{path}/blocks")
    draft_labels(mine).write.mode("append").parquet(f"{path}/block_labels")
    order = F.transform(F.array_sort(F.collect_list(F.struct("position", "block_id"))), lambda x: x["block_id"])
    pages = mine.groupBy("document_id", "page").agg(order.alias("expected_order"))
    none = F.array().cast("array<string>")
    pages.select("document_id", "page", "expected_order", F.lit(False).alias("reading_order_reviewed"), F.lit(False).alias("segmentation_reviewed"), none.alias("segmentation_issues")).write.mode("append").parquet(f"{path}/page_labels")
    # The manifest comes last: what a broken run leaves behind belongs to no document that it names.
    entries = stated.select("document_id", "filename", F.lit(split).alias("split"), F.lit(domain).alias("domain"), F.lit(notes).alias("notes"), F.lit("draft").alias("status"), F.col("fingerprint").alias("source_fingerprint"))
    entries.write.mode("append").parquet(f"{path}/manifest")


def labelled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """blocks, page_labels and block_labels of the workspace."""
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("blocks", "page_labels", "block_labels"))
