"""Helpers that the operators of this subpackage share: scratch tables, stable row keys and token arrays."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: 0x20 and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Names of the row key beside named columns or a whole row, which is one struct, so that no name of an input column meets them.
KEY = ["__row_file", "__row_no"]
#: The struct of a whole input row.
ROW = "__row"

_OWN: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new place in the folder that the driver and all executors share, ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder in local mode and an error on a cluster, whose executors would each write to a disk of their own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="fieldloom-"))
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def stash(df: DataFrame, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors. The table goes
    at the end of the innermost ``scratch`` block; outside of one it stays, as a lazy result may still read it."""
    path = shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a ``stash`` that nothing reads any more."""
    remove(df.sparkSession, df._stashed_at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Has the driver's JVM collect garbage now, upon which Spark deletes the shuffle files of frames that nothing refers to any more.
    Between the passes of a job that are all stashed, this frees the disk of the passes before. Twice, as what Python lets go reaches the
    JVM a moment later."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that are stashed inside the block when it ends; what has to stay is written inside it to ``shared_dir``."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def _keys() -> list:
    return [F.xxhash64(F.col("_metadata.file_path")).alias(KEY[0]), F.col("_metadata.row_index").alias(KEY[1])]


def _straight(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of one Parquet table and the same in every scan: deterministic filters and projections over
    one relation. After an explode, a join, a union or a sample several rows could share a file's row number, or differ by scan."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def rooted(df: DataFrame) -> DataFrame:
    """``df`` itself if its rows come straight from a Parquet table, which gives each row a key; any other frame after a stash."""
    if _straight(df):
        try:
            df.select(*_keys())
            return df
        except AnalysisException:
            pass
    return stash(df)


def column(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` with a row key (file hash, row number) that is the same in every scan, also for repeated rows; without ``columns``
    the whole row as a struct ``ROW``, which ``unpacked`` turns back."""
    df = rooted(df)
    return df.select(*(columns or [F.struct(*map(column, df.columns)).alias(ROW)]), *_keys())


def unpacked(rows: DataFrame) -> DataFrame:
    """The columns of the struct ``ROW``, and no others."""
    return rows.select(f"{ROW}.*")


def split_join(left: DataFrame, right: DataFrame, key: str, rows: str, *, hot: int = 500, parts: int = 64) -> DataFrame:
    """``left`` joined to ``right``, which has one row a key, with the number of its rows in ``left`` in the column ``rows``. Keys that more than
    one in ``hot`` of all rows have, at most ``hot`` of them, are dealt over ``parts`` on the left and repeated on the right."""
    total = right.agg(F.sum(rows)).first()[0] or 0
    many = [r[key] for r in right.where(F.col(rows) > max(total / hot, 1000)).select(key).collect()]
    right = right.drop(rows)
    if not many:
        return left.join(right, key)
    is_hot = F.col(key).isin(many)
    salted = left.withColumn("_salt", F.when(is_hot, F.floor(F.rand(7) * parts)).otherwise(0).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(repeated, [key, "_salt"]).drop("_salt")


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20):
    """Cuts a batch so that a slice has about ``max_bytes`` of text, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(size, dtype=np.int64), 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()  # workers live on; what they don't need should not stay with them


def tokens(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text: (code of each word, words of each text, the word of each code). Null counts as empty."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    lens = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    blank = pc.index(words, "").as_py()  # white space at an end of a text
    if blank >= 0:
        real = codes != blank
        lens = np.bincount(np.repeat(np.arange(len(lens)), lens)[real], minlength=len(lens))
        codes = codes[real]
    return codes, lens, words


def starts_of(lens: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lens)))[: len(lens)].astype(np.int64)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one range after another."""
    total = int(lens.sum())
    shift = np.repeat(starts - starts_of(lens), lens)
    return shift + np.arange(total, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x
