"""The commit log of a warehouse: one small file per committed attempt, in order.

``commits/<number>`` holds the batch and attempt that the number committed. A
number is taken by creating its file, which only one writer can do, so of two
writers that work at the same time the second sees that the log has moved and
looks again at what is new before it tries the next number. Nothing is locked,
and a writer that stops leaves no lock behind.

The file system must let only one of two writers create a name: HDFS and local
disks do (rename without overwrite; a hard link). For a store that has neither,
keep one writer per warehouse.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("number", T.LongType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("attempt_id", T.StringType()),
    ]
)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text`` whole and at once; false if it is there already."""
    jvm = spark._jvm
    fs, target = _fs(spark, path)
    parent, name = path.rsplit("/", 1)
    draft = f"{parent}/_draft-{uuid.uuid4().hex}"  # names with an underscore are no data
    write_text(spark, draft, text)
    source = _fs(spark, draft)[1]
    try:
        if fs.getScheme() == "file":
            at = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri())
            jvm.java.nio.file.Files.createLink(at(target), at(source))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration()
            )
            context.rename(source, target, spark._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(source, False)
    return True


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def create(self) -> None:
        fs, p = _fs(self.spark, self.path)
        fs.mkdirs(p)

    def last(self) -> int:
        """The newest number, 0 for an empty log."""
        fs, p = _fs(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def add(self, number: int, batch_id: str, attempt_id: str) -> bool:
        """Commit an attempt as ``number``; false if another writer has it."""
        entry = json.dumps({"number": number, "batch_id": batch_id, "attempt_id": attempt_id})
        return put_if_absent(self.spark, f"{self.path}/{number:012d}", entry + "\n")

    def entries(self, up_to: int | None = None) -> DataFrame:
        """(number, batch_id, attempt_id), as of a number if one is given."""
        found = self.spark.read.schema(ENTRY).json(self.path)
        return found if up_to is None else found.where(F.col("number") <= up_to)
