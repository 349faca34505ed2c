"""Helpers shared by the operators: tables, the shared folder, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space for words and for normalised texts.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, a null one counting as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only on one machine, where neither the session nor the context has one, a temporary
    folder is set; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wayfold-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # shuffles end with their query
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that nothing reads any more."""
    spark = df.sparkSession
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows and bytes in a batch between Spark and Python at most: texts may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of an Arrow batch to these where they are more; all operators want the same, so none changes what another has set."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        held = str(spark.conf.get(key)).lower().rstrip("b")
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(key, str(most))


#: Rows that the Parquet reader decodes at once at most. Its own 4 096 whole texts are arrays of tens of MB in each task, which fragment the heap.
READ_ROWS = 256


def small_reads(spark: SparkSession) -> None:
    """Lowers the session's limit of rows that a reader of whole texts decodes at once to READ_ROWS where it is more."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key)) > READ_ROWS:
        spark.conf.set(key, str(READ_ROWS))


def bounded(batches: Iterable[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have at most `limit` bytes in all, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


#: A name for a column of texts beside those of documents.
HIDDEN = "__hidden_text__"
#: Names of the columns by which rows that stay are told; two parts keep them apart from any column of documents.
STAY = ("__stay_id__", "__stay_sha__")


#: Rows that stay, per shuffle partition, up to which a task keeps them in a hash table; that can't spill.
HASHED_ROWS = 100_000


def survivors(docs: DataFrame, stay: DataFrame, id_col: str, sha: Column, known: DataFrame | None = None) -> DataFrame:
    """Rows of docs of which stay has the id and the digest of the text (unhexed sha), one for each; rows without an id stay all.

    Repeated rows are one where they are read, so a third of all rows may be the same. What stays
    grows with docs, so it is never broadcast.

    known, a stored table, has the id and digest of each row of docs with an id, named as in stay.
    If no row is repeated there, texts are moved once and never sorted, as a sort holds texts in
    each task's memory; rows that stay are then hashed, or sorted where a task may get too many.
    """
    marks = [f"{name}own" for name in STAY]
    rows, how = docs.where(F.col(id_col).isNotNull()).withColumns({marks[0]: F.col(id_col), marks[1]: F.unhex(sha)}), "merge"
    most, n = (2, 0) if known is None else known.groupBy(*STAY).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.max("_n"), F.lit(0)), F.count(F.lit(1))).first()
    if most > 1:
        rows = rows.dropDuplicates(marks)
    elif n <= HASHED_ROWS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        how = "shuffle_hash"
    kept = rows.join(stay.hint(how), (F.col(marks[0]) == F.col(STAY[0])) & (F.col(marks[1]) == F.col(STAY[1])), "left_semi").drop(*marks)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
