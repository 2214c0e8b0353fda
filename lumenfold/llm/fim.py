"""Fill-in-the-middle transformation of whole texts by displacement scatter.

A text of n code points is cut in prefix, middle and suffix and written as
``<P>`` prefix ``<S>`` suffix ``<M>`` middle (``psm``) or ``<S>`` suffix ``<P>``
prefix ``<M>`` middle (``spm``), or left as it is (``plain``). Four draws per
row, 32-bit groups of SHA-256 of ``<seed>:<id>``, fix cuts and form, so equal
ids get equal cuts whatever the order or number of tasks.

A batch is one array of UTF-8 bytes. A scan of its code point starts turns cuts
into byte places. Every byte of a segment moves by the same number of places, so
a difference array with one change per segment start, summed up, gives each byte
its shift, and one scatter writes all texts of the batch. Restoring finds the
three marks in the output, derives the same shifts from their places and the
form alone, and gathers. Sums run in blocks of ``BLOCK`` bytes with the carry of
the block before, so index arrays stay bounded however long a text is.

Null and empty texts are plain and empty; texts that hold a mark are plain, as
their cuts could not be found again. A null id draws like an empty one. Repeated
rows give repeated results, empty tables empty ones. Only the id and text columns
and those named in ``keep`` enter the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lumenfold.llm.common import STEP_CHARS, ship

MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
MARK_BYTES = 3
#: Bytes whose shifts are held at once.
BLOCK = 1 << 20


def draws(row_id: Column, seed: int = 1) -> Column:
    """array<bigint> of the first four 32-bit groups of SHA-256 of ``<seed>:<id>``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all rows, their edges); null rows are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def _texts(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_string(), len(edges) - 1, buffers).cast(pa.string())


def _marks(data: np.ndarray) -> np.ndarray:
    """Places at which a mark stands."""
    if len(data) < MARK_BYTES:
        return np.zeros(0, np.int64)
    name = data[1:-1]
    is_name = (name == MARKS["P"][1]) | (name == MARKS["S"][1]) | (name == MARKS["M"][1])
    return np.flatnonzero((data[:-2] == MARKS["P"][0]) & is_name & (data[2:] == MARKS["P"][2]))


def _rows_with_marks(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of marks that stand inside one row, the rows)."""
    at = _marks(data)
    row = np.searchsorted(edges, at, "right") - 1
    inside = at + MARK_BYTES <= edges[row + 1]
    return at[inside], row[inside]


def _shifts(starts: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, shift of each place) in blocks, for segments that begin at ``starts`` (ascending)."""
    change = np.diff(shifts, prepend=0)
    carry = 0
    for low in range(0, size, BLOCK):
        high = min(low + BLOCK, size)
        first, last = np.searchsorted(starts, (low, high))
        step = np.zeros(high - low, np.int64)
        np.add.at(step, starts[first:last] - low, change[first:last])
        step[0] += carry
        shift = np.cumsum(step)
        carry = shift[-1]
        yield low, high, shift


def _layout(prefix: np.ndarray, middle: np.ndarray, suffix: np.ndarray, plain: np.ndarray, spm: np.ndarray):
    """Places inside each output of its three segments, and of the marks P, S, M (of plain rows: without marks)."""
    m = np.where(plain, 0, MARK_BYTES)
    of_prefix = np.where(spm, 2 * m + suffix, m)
    of_suffix = np.where(plain, prefix + middle, np.where(spm, m, 2 * m + prefix))
    of_middle = np.where(plain, prefix, 3 * m + prefix + suffix)
    return of_prefix, of_middle, of_suffix, of_prefix - m, of_suffix - m, of_middle - m


def _segments(edges: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Segment starts of all rows in order: prefix, middle, suffix of each."""
    return np.stack([edges[:-1], first, second], axis=1).ravel()


def scatter(data: np.ndarray, edges: np.ndarray, draw: np.ndarray, fim_percent: int, spm_percent: int):
    """(output bytes, output edges, columns n, plain, spm, prefix, middle) of a batch of texts."""
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    points = np.searchsorted(starts[:-1], edges)
    n = np.diff(points)
    plain = (n == 0) | (draw[:, 2] % 100 >= fim_percent)
    plain[_rows_with_marks(data, edges)[1]] = True
    spm = ~plain & (draw[:, 3] % 100 < spm_percent)
    cuts = np.sort(draw[:, :2] % (n + 1)[:, None], axis=1)
    cuts[plain] = 0
    first, second = starts[points[:-1, None] + cuts].T
    prefix, middle, suffix = first - edges[:-1], second - first, edges[1:] - second
    out_edges = np.concatenate([[0], np.cumsum(np.diff(edges) + np.where(plain, 0, 3 * MARK_BYTES))])
    begin = out_edges[:-1]
    at = _layout(prefix, middle, suffix, plain, spm)
    source = _segments(edges, first, second)
    target = np.stack([begin + p for p in at[:3]], axis=1).ravel()
    out = np.empty(out_edges[-1], np.uint8)
    for low, high, shift in _shifts(source, target - source, len(data)):
        out[np.arange(low, high) + shift] = data[low:high]
    for mark, places in zip(MARKS.values(), at[3:]):
        places = (begin + places)[~plain]
        for i, byte in enumerate(mark):
            out[places + i] = byte
    return out, out_edges, n, plain, spm, cuts[:, 0], cuts[:, 1] - cuts[:, 0]


def gather(out: np.ndarray, out_edges: np.ndarray, plain: np.ndarray, spm: np.ndarray):
    """(text bytes, text edges) from outputs and their forms alone."""
    at, row = _rows_with_marks(out, out_edges)
    own = ~plain[row]
    at, row = at[own], row[own]
    if not np.array_equal(row, np.repeat(np.flatnonzero(~plain), 3)):
        raise ValueError("an output that is not plain must hold exactly three marks")
    begin, end = out_edges[:-1], out_edges[1:]
    marks = np.stack([begin, begin, begin], axis=1)
    marks[~plain] = at.reshape(-1, 3)
    # Between the marks stand, in order: prefix and suffix (psm) or suffix and prefix (spm), then the middle.
    one, two = marks[:, 1] - marks[:, 0] - MARK_BYTES, marks[:, 2] - marks[:, 1] - MARK_BYTES
    size = end - begin
    suffix = np.where(plain, 0, np.where(spm, one, two))
    middle = np.where(plain, 0, end - marks[:, 2] - MARK_BYTES)
    prefix = np.where(plain, size, np.where(spm, two, one))
    edges = np.concatenate([[0], np.cumsum(prefix + middle + suffix)])
    places = _layout(prefix, middle, suffix, plain, spm)
    first = edges[:-1] + prefix
    target = _segments(edges, first, first + middle)
    source = np.stack([begin + p for p in places[:3]], axis=1).ravel()
    data = np.empty(edges[-1], np.uint8)
    for low, high, shift in _shifts(target, source - target, len(data)):
        data[low:high] = out[np.arange(low, high) + shift]
    return data, edges


def _steps(batch: pa.RecordBatch, column: int, step_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``step_bytes`` bytes of text each; a longer text stands alone."""
    done = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(done, before + step_bytes, "right")))
        yield batch.slice(start, end - start)
        start, before = end, int(done[end - 1])


FORM_SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def fill_in_middle(
    df: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    seed: int = 1,
    fim_percent: int = 90,
    spm_percent: int = 20,
    step_bytes: int = STEP_CHARS,
) -> DataFrame:
    """``keep`` columns, ``n`` code points, ``form``, lengths of prefix and middle (null if plain) and ``output``.

    ``fim_percent`` of the texts are cut, ``spm_percent`` of those in the form ``spm``.
    """
    ship(df.sparkSession)
    source = df.select(*keep, draws(F.col(row_id), seed).alias("_draws"), F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]), FORM_SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _steps(batch, batch.num_columns - 1, step_bytes):
                draw = part.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
                data, edges = _bytes(part.column(len(keep) + 1))
                out, out_edges, n, plain, spm, prefix, middle = scatter(data, edges, draw, fim_percent, spm_percent)
                form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
                columns = [pa.array(n, pa.int64()), form, *(pa.array(x, pa.int64(), mask=plain) for x in (prefix, middle))]
                names = [*keep, "n", "form", "prefix_chars", "middle_chars", "output"]
                kept = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *columns, _texts(out, out_edges)], names=names)

    return source.mapInArrow(run, schema)


def restore(df: DataFrame, step_bytes: int = STEP_CHARS) -> DataFrame:
    """Add ``restored``, the text rebuilt from the columns ``output`` and ``form`` alone; null where ``output`` is."""
    ship(df.sparkSession)
    form, output = df.columns.index("form"), df.columns.index("output")
    schema = StructType([*df.schema.fields, StructField("restored", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _steps(batch, output, step_bytes):
                out, out_edges = _bytes(part.column(output))
                forms = np.array(part.column(form).to_pylist(), object)
                data, edges = gather(out, out_edges, (forms != "psm") & (forms != "spm"), forms == "spm")
                texts = pc.if_else(part.column(output).is_null(), pa.scalar(None, pa.string()), _texts(data, edges))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=schema.names)

    return df.mapInArrow(run, schema)
