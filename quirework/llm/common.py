"""What several operators of this subpackage share: scratch tables, word expressions, small helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java character class of what separates words: the six ASCII white-space characters.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; a cluster without it is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or (sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="quirework-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(f"file://{own}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Tables written by the operators that are running, the outermost first.
_WRITTEN: ContextVar[list[list[str]]] = ContextVar("written", default=[])


def materialised(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: the lineage ends there, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    if _WRITTEN.get():
        _WRITTEN.get()[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidied(operator):
    """An operator that deletes the tables it has written, but for those that its result is yet to be read from; those are left to the operator around it, and at last to whoever clears the folder."""

    @wraps(operator)
    def run(*args, **options):
        own: list[str] = []
        around = _WRITTEN.get()
        token = _WRITTEN.set([*around, own])
        try:
            out = operator(*args, **options)
        finally:
            _WRITTEN.reset(token)
        results = out if isinstance(out, tuple) else (out,)
        # Folder names are unique; the rest of a path can be written in several ways.
        read = {f.rsplit("/", 2)[-2] for df in results for f in df.inputFiles()}
        kept = [path for path in own if path.rsplit("/", 1)[-1] in read]
        if around:
            around[-1].extend(kept)
        drop_tables(results[0].sparkSession, [path for path in own if path not in kept])
        return out

    return run


def row_key() -> Column:
    """What tells rows of documents apart: the id, null or not, and a hash of the text. Rows alike in both are one document given several times."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores in front as it takes to be no column of df."""
    return name if name.lower() not in map(str.lower, df.columns) else free_name(df, "_" + name)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for the row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, pattern: str = f"[^{SPACE}]+") -> Column:
    """The words of a text in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def upto(n: Column) -> Column:
    """0, 1, ..., n - 1 as an array; empty where n is below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def row_bytes(kind: T.DataType, value: Column) -> Column:
    """About the bytes of a value in memory: 8 for a number, text by its bytes, arrays by their elements."""
    if isinstance(kind, T.StructType):
        return sum((row_bytes(f.dataType, value[f.name]) for f in kind.fields), F.lit(8))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 16 + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.ArrayType):
        return 16 + F.coalesce(F.aggregate(value, F.lit(0), lambda n, x: n + row_bytes(kind.elementType, x).cast("int")), F.lit(0))
    return F.lit(8)


def small_side(table: DataFrame, most_rows: int = 100_000, most_bytes: int = 16 << 20) -> DataFrame:
    """A written table, marked for broadcast if it has at most so many rows of at most so many bytes in memory; beyond that Spark shuffles and splits skewed keys."""
    size = sum((row_bytes(f.dataType, F.col(f.name)) for f in table.schema.fields), F.lit(16)).cast("long")
    found = table.select(size.alias("size")).limit(most_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return F.broadcast(table) if found["n"] <= most_rows and found["size"] <= most_bytes else table.hint("merge")


def grams_of(hashes: Column, k: int) -> Column:
    """Hashes of k consecutive entries of an array of word hashes."""
    return F.transform(upto(F.size(hashes) - (k - 1)), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))


def evaluated(df: DataFrame) -> DataFrame:
    """df, with its columns evaluated once at this point: later filters are not pushed into their expressions, nor these into later ones.

    A row goes through explode_outer of one struct. Plain explode would not do: for it Catalyst adds a filter on the
    array's size, moves that down and so evaluates the array twice, inside lambdas even once for each element.
    """
    return df.select(F.explode_outer(F.array(F.struct("*"))).alias("_row")).select("_row.*")
