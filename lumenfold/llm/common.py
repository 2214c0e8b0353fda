"""Helpers shared by the corpus operators."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenfold.session import checkpoint_dir, ensure_checkpoint_dir
from lumenfold.sources.tables import read_table

#: Rows of one fold in five are held out of every model fit.
FOLDS = 5

#: Characters that a Python step holds at once; longer texts form a step alone.
STEP_CHARS = 1_000_000


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once per application.

    Workers then import it by name, so what a module keeps (vocabularies, class
    tables) is built once per worker and not once per task.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.writestr(str(path.relative_to(root.parent)), path.read_bytes())
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{root.name}.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)  # copied to every executor by Spark
    _SHIPPED.add(sc.applicationId)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", columns or ("doc_id", "text"))


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = 0) -> Column:
    """True where crc32(doc_id as text) mod ``folds`` is ``fold`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and read it back.

    Cuts the lineage with a reliable (shared) checkpoint, so a lost executor
    costs a re-read and not the whole history.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete what a query wrote below the checkpoint folder for its own use."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _steps(column: pa.Array, step_chars: int) -> Iterator[tuple[int, int, list]]:
    """(start, end, texts) of consecutive rows with about ``step_chars`` characters together."""
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
    start = 0
    while start < len(sizes):
        end, chars = start, 0
        while end < len(sizes) and (end == start or chars < step_chars):
            chars += sizes[end]
            end += 1
        yield start, end, column.slice(start, end - start).to_pylist()
        start = end


def map_texts(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[[list], dict]],
    text: str = "text",
    keep: tuple[str, ...] = (),
    step_chars: int = STEP_CHARS,
) -> DataFrame:
    """Run a list-of-texts function over ``text`` in steps of bounded size.

    ``make`` is called once per task and returns ``step(texts) -> columns``
    (one list or array per new column, in ``schema`` order). The columns named
    in ``keep`` pass through. Null texts arrive as ``None``. A step holds rows
    up to ``step_chars`` characters, so memory does not follow the number of
    rows in an Arrow batch.
    """
    ship(df.sparkSession)
    source = df.select(*keep, F.col(text).alias("_text"))
    kept = source.select(*keep).schema
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), schema])
    kinds = [f.type for f in to_arrow_schema(StructType.fromDDL(schema))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for start, end, texts in _steps(batch.column(batch.num_columns - 1), step_chars):
                columns = step(texts)
                through = [batch.column(i).slice(start, end - start) for i in range(len(keep))]
                names = [*keep, *columns]
                values = zip(columns.values(), kinds)
                arrays = [*through, *(c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in values)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, out_schema)


def filter_texts(
    df: DataFrame, make: Callable[[], Callable[[list], list]], text: str = "text", step_chars: int = STEP_CHARS
) -> DataFrame:
    """The rows of ``df`` for which ``step(texts)`` gives true, with all columns as they are."""
    ship(df.sparkSession)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for start, end, texts in _steps(batch.column(place), step_chars):
                yield batch.slice(start, end - start).filter(pa.array(step(texts), pa.bool_()))

    return df.mapInArrow(run, df.schema)
