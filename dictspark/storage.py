"""The folder that the driver and all executors share, and tables in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session (tests) gets one of its own until the process ends; a cluster,
    whose machines would each write to a disk of their own, an error."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="dictspark-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: In file:// folders no file has a second one with checksums beside it, which would cost its writer another process (chmod): Parquet's readers
#: don't need it. Without a cache of file systems, or tasks would take the one that others have opened.
_WRITE = {
    "parquet.page.size.row.check.min": "1",
    "parquet.block.size.row.check.min": "1",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


def stored(df: DataFrame, name: str, files: int | None = None, rows_a_file: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts the lineage and outlives lost executors. Pages and row groups are held
    to their sizes from the first row on; else a page waits for a hundred rows, which takes much memory where a row is large. files: the most
    tasks that write, for tables known to be small. rows_a_file: for tables of any size that are small beside what they are made from; df is
    computed by all its tasks, and then written by one task for so many rows."""
    if rows_a_file is not None:
        made = held(df)
        out = stored(made, name, max(1, made._rows // rows_a_file))
        discard(made)
        return out
    spark = df.sparkSession
    path = new_path(spark, name)
    (df if files is None else df.coalesce(files)).write.options(**_WRITE).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def held(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it on the executors' disks until discard(), without a file in the shared folder, each of which costs a process
    or two of a writer (chmod) on Hadoop's local file system. For tables that are read while their sources stay: the part that a lost executor
    held is computed again."""
    out = df.persist(StorageLevel.DISK_ONLY)
    out._rows = out.count()
    return out


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return bool(fs.exists(at))


def make_folder(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return bool(fs.mkdirs(at))


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a file or a folder with all that is in it; False if there is none."""
    fs, at = _file_system(spark, path)
    return bool(fs.delete(at, True))


def version(spark: SparkSession, path: str) -> tuple[int, int]:
    """When the path was last changed, and its bytes: another pair means other data."""
    fs, at = _file_system(spark, path)
    return fs.getFileStatus(at).getModificationTime(), fs.getContentSummary(at).getLength()


#: Bytes of a table for each task that its rows are dealt out to; tables of less than two of these stay as they are.
DEALT = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a Parquet table for a pass that costs much more than reading. A row group is read by one task; where the table's files have fewer of
    them than there are cores (writers that make one of a million rows do), the rows are dealt out to more tasks as they are read."""
    spark = rows.sparkSession
    files, cores = rows.inputFiles(), spark.sparkContext.defaultParallelism
    if len(files) >= cores:
        return rows
    jvm, conf, groups, size = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0, 0
    for name in files:
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, conf))
        groups += reader.getRowGroups().size()
        size += at.getFileSystem(conf).getFileStatus(at).getLen()
        reader.close()
    if groups >= cores or size < 2 * DEALT:
        return rows
    return rows.withColumn("__at", F.monotonically_increasing_id()).repartition(max(cores, size // DEALT), "__at").drop("__at")


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() or held() made. Only for those that nothing yet to run reads: what was stored after them is complete by itself."""
    for t in tables:
        if "_stored_at" in vars(t):
            remove(t.sparkSession, t._stored_at)
        else:
            t.unpersist()
