"""Secret scans: fixed patterns, and Markov models of random and ordinary strings.

Two character models are trained from labelled samples: random strings (hashes
of numbers, written in hexadecimal, base 64 and letters and digits) and ordinary
identifiers (words of the documents at hand and of the documentation of PySpark's
own functions, joined as in names, paths and assignments, some with numbers;
fillers, counters and dates). Candidates are the runs of letters, digits and ``+ / _ = -``. A
stretch of a run is a secret if the sum over its character pairs of the log
likelihood ratio, random against ordinary, reaches ``THRESHOLD``; it ends before the
sum falls by ``THRESHOLD`` again, so a run may hold several. Its span reaches to the
next marks or the ends of the run (``=`` at the end of the run included), begins with a
letter or digit and has ``SHORTEST`` or more characters. Of a
secret that holds marks itself, a piece at its end that looks ordinary may stay out.

Everything runs in DataFrame functions. Both samples are bounded (``STRINGS``,
``SAMPLE_DOCS``, ``FILLERS`` and the installed documentation, about 1 MB); scanning covers whole texts of every row. Training collects one
count per character pair.

Null and empty texts have no spans. Spans count code points, with exclusive
ends. Kinds stand in the order assign, access, hex, random; spans of different
kinds may overlap.
"""

from __future__ import annotations

import inspect
import math

from pyspark import sql
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import remove_path, scratch_path
from lumenfold.llm.textops import hold, match_spans, running
from lumenfold.plans.commits import write_text

# The patterns of the base kinds and their shortest values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

#: Shortest span that is reported; the score of shorter ones tells rare words from random strings too badly.
SHORTEST = 12
#: Least log likelihood ratio (natural) of a secret.
THRESHOLD = 12.0
STRINGS = 4000
SAMPLE_DOCS = 200
FILLERS = 2000
#: Every so many ordinary names one has a number in it.
NUMBERED = 18

#: Letters by case, digits and the five marks; a row and a column of the pair table each.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUNS = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}"


def random_strings(spark: SparkSession, count: int = STRINGS) -> DataFrame:
    """(value) random strings of several alphabets, from hashes of 0, 1, 2, ..."""
    n = F.col("id").cast("string")
    raw = F.unhex(F.sha2(F.concat(F.lit("random "), n), 384))
    base64 = F.base64(raw)
    forms = [
        F.sha2(F.concat(F.lit("hex "), n), 256),
        F.upper(F.sha1(F.concat(F.lit("upper "), n).cast("binary"))),
        base64,
        F.regexp_replace(base64, "[+/=]", ""),
        F.translate(base64, "+/", "-_"),
    ]
    return spark.range(0, count, 1, 4).select(F.explode(F.array(*forms)).alias("value"))


def documentation() -> str:
    """The public documentation of the installed PySpark's functions and main classes, one of them a line:
    ordinary English and names."""
    owners = (F, sql.DataFrame, sql.SparkSession, sql.Column, sql.Window, sql.DataFrameReader, sql.DataFrameWriter)
    found = [getattr(o, name, None) for o in owners for name in sorted(dir(o)) if not name.startswith("_")]
    return "\n".join(" ".join((inspect.getdoc(x) or "").split()) for x in found if callable(x))


def ordinary_strings(docs: DataFrame, known: DataFrame, count: int = SAMPLE_DOCS) -> DataFrame:
    """(value) identifiers: words of about ``count`` distinct texts of ``docs`` and of all of ``known``, joined by
    case, mark, number or nothing, and plain fillers."""
    total = docs.count()
    share = max(1, math.ceil(1_000_000 * min(1.0, count / max(total, 1))))
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share).select("text").distinct()
    words = hold(chosen.union(known), "w", F.regexp_extract_all("text", F.lit("[A-Za-z]{2,15}"), F.lit(0))).where("size(w) > 0")
    at = F.sequence(F.lit(1), F.size("w"))
    capital = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 99))

    def joined(i: Column) -> Column:
        three = F.slice("w", i, F.lit(3))
        kind = F.pmod(i, F.lit(7))
        out = F.when(kind == 0, F.concat_ws("", three)).when(kind == 1, F.concat_ws("_", three))
        out = out.when(kind == 2, F.concat_ws("/", three)).when(kind == 3, F.concat_ws("-", three))
        out = out.when(kind == 4, F.concat_ws("", F.transform(three, capital))).when(kind == 5, F.concat_ws("=", three))
        return out.otherwise(F.upper(F.concat_ws("_", three)))

    def numbered(i: Column) -> Column:
        a = F.get("w", i - 1)
        b = F.coalesce(F.get("w", i), a)
        turn = F.floor(i / NUMBERED)
        n = F.when(turn % 2 == 1, turn % 10).otherwise(turn % 128).cast("string")
        kind = F.pmod(turn, F.lit(5))
        out = F.when(kind == 0, F.concat(a, n, F.lit("_"), b)).when(kind == 1, F.upper(F.concat(a, n, F.lit("_"), b)))
        out = out.when(kind == 2, F.concat(a, capital(b), n)).when(kind == 3, F.concat(F.substring(a, 1, 1), n, b))
        return out.otherwise(F.concat(a, n, F.lit("/"), b))

    each = F.transform(at, lambda i: F.when(i % NUMBERED == 1, F.array(joined(i), numbered(i))).otherwise(F.array(joined(i))))
    names = words.select(F.explode(F.flatten(each)).alias("value"))
    # Rules and fillers of one character, counters and dates are ordinary as well.
    fills = F.when(F.col("id") % 40 == 0, F.array(*(F.lit(c * 30) for c in ALPHABET))).otherwise(F.array().cast("array<string>"))
    date = F.date_format(F.timestamp_seconds(F.col("id") * 864_013), "yyyy-MM-dd-HH-mm-ss")
    counter = F.lpad((F.col("id") * 7919).cast("string"), 24, "0")
    plain = docs.sparkSession.range(0, FILLERS, 1, 4).select(F.explode(F.concat(fills, F.array(date, counter))).alias("value"))
    return names.union(plain)


def pair_counts(strings: DataFrame) -> list[list[float]]:
    """Counts of adjacent characters, as rows of the alphabet's size."""
    spots = F.sequence(F.lit(1), F.length("value") - 1)
    pairs = strings.where("length(value) > 1").select(
        F.explode(F.transform(spots, lambda i: F.substring(F.col("value"), i, F.lit(2)))).alias("pair")
    )
    place = {c: i for i, c in enumerate(ALPHABET)}
    table = [[0.0] * len(ALPHABET) for _ in ALPHABET]
    for row in pairs.groupBy("pair").count().collect():
        a, b = (place.get(c) for c in row.pair)
        if a is not None and b is not None:
            table[a][b] += row["count"]
    return table


def log_ratios(random: DataFrame, ordinary: DataFrame, prior: float = 0.5) -> list[float]:
    """Log likelihood ratio of each character pair, row by row."""
    out: list[float] = []
    size = len(ALPHABET)
    for r, o in zip(pair_counts(random), pair_counts(ordinary)):
        r_sum, o_sum = sum(r) + prior * size, sum(o) + prior * size
        out += [math.log((a + prior) / r_sum) - math.log((b + prior) / o_sum) for a, b in zip(r, o)]
    return out


def train(docs: DataFrame) -> list[float]:
    """The pair table learnt from random strings and from words of ``docs`` (text) and of the documentation.

    The documentation is handed over as a file in the shared folder, so no plan holds it.
    """
    spark, docs = docs.sparkSession, docs.where("text is not null").select("text")
    path = scratch_path(spark, "ordinary-texts")
    write_text(spark, path, documentation())
    try:
        known = spark.read.text(path).select(F.col("value").alias("text"))
        return log_ratios(random_strings(spark), ordinary_strings(docs, known))
    finally:
        remove_path(spark, path)


def pair_ratios(value: Column, table: list[float]) -> Column:
    """The pair ratios of a string over ALPHABET (two characters or more), in order."""
    # One constant text, folded to an array when the query is planned.
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    places = F.transform(
        F.sequence(F.lit(1), F.length(value)), lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1))) - 1
    )
    each = lambda p: F.transform(
        F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.get(ratios, F.get(p, i) * len(ALPHABET) + F.get(p, i + 1))
    )
    # The inner array is bound to a name, so that it is built once per string.
    return F.get(F.transform(F.array(places), each), 0)


def greatest_sum(ratios: Column) -> Column:
    """The greatest sum of neighbouring elements (0 for none)."""

    def add(s: Column, r: Column) -> Column:
        total = F.greatest(s.total, F.lit(0.0)) + r
        return F.struct(total.alias("total"), F.greatest(s.best, total).alias("best"))

    return F.aggregate(ratios, F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("best")), add, lambda s: s.best)


def stretches(ratios: Column, threshold: float) -> Column:
    """Stretches whose sum reaches the threshold: array of struct(a, b), in characters, b exclusive.

    A stretch starts where the sum would rise from 0, ends at its greatest sum and
    is closed when the sum has fallen to 0 or by ``threshold``.
    """
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def state(total, best, a, b, i, found) -> Column:
        values = {"total": total, "best": best, "a": a, "b": b, "i": i, "found": found}
        return F.struct(*(v.alias(k) for k, v in values.items()))

    def closed(s: Column) -> Column:
        return F.when(s.best >= threshold, F.concat(s.found, F.array(F.struct(s.a.alias("a"), s.b.alias("b"))))).otherwise(s.found)

    def add(s: Column, r: Column) -> Column:
        total = s.total + r
        risen = total > s.best
        ends = (total <= 0) | (s.best - total >= threshold)
        zero = F.lit(0.0)
        return F.when(ends, state(zero, zero, s.i + 1, s.i + 1, s.i + 1, closed(s))).otherwise(
            state(total, F.greatest(s.best, total), s.a, F.when(risen, s.i + 2).otherwise(s.b), s.i + 1, s.found)
        )

    return F.aggregate(ratios, state(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0), F.lit(0), empty), add, closed)


def random_spans(text: Column, table: list[float], threshold: float) -> Column:
    """The secrets by the models: array of struct(start, stop), null for none."""
    size = lambda x, pattern: F.char_length(F.regexp_extract(x, pattern, 0))

    def spans(run: Column) -> Column:
        def whole(x: Column) -> Column:
            own = F.substring(run.found, x.a + 1, x.b - x.a)
            a, b = x.a + size(own, "^[+/_=-]+"), x.b - size(F.reverse(own), "^[+/_=-]+")
            a -= size(F.reverse(F.substring(run.found, F.lit(1), a)), "^[A-Za-z0-9]+")
            b += size(F.substring(run.found, b + 1, F.char_length(run.found)), "^[A-Za-z0-9]*(=+$)?")
            return F.struct((run.start + a).alias("start"), (run.start + b).alias("stop"))

        spans = F.transform(stretches(pair_ratios(run.found, table), threshold), whole)
        return F.filter(spans, lambda x: x.stop > x.start)

    def join(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.array(F.struct(last.start.alias("start"), x.stop.alias("stop")))
        # Two stretches between the same marks are one span.
        return F.when(x.start < last.stop, F.concat(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(F.concat(done, F.array(x)))

    # Few texts hold a run that reaches the threshold; places are looked up in these alone.
    likely = lambda x: greatest_sum(pair_ratios(x, table)) >= threshold
    found = F.flatten(F.transform(F.filter(match_spans(text, RUNS), lambda run: likely(run.found)), spans))
    joined = F.aggregate(found, F.array().cast("array<struct<start:bigint,stop:bigint>>"), join)
    return F.when(F.exists(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0)), likely), joined)


def _keep(spans: Column, kind: str, test) -> Column:
    rows = F.transform(
        F.filter(spans, test),
        lambda x: F.struct(x.start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x.stop.alias("stop")),
    )
    return F.coalesce(rows, F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>"))


def scan(
    df: DataFrame,
    table: list[float],
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``keep`` columns, ``base`` and ``spans``.

    Both are arrays of struct(start, kind, stop), sorted by start and kind
    (a place in KINDS); ``spans`` adds the spans of the random kind to ``base``.
    """
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = F.col("_t")
    value = lambda x: F.char_length(F.regexp_extract(x.found, ASSIGN, 2))
    length = lambda x: x.stop - x.start
    base = F.concat(
        _keep(match_spans(t, ASSIGN), "assign", lambda x: value(x) >= ASSIGN_VALUE),
        # Runs that are too short hold no longer run, so the length can stand in the pattern.
        _keep(match_spans(t, rf"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}"), "access", lambda x: length(x) >= ACCESS_LENGTH),
        _keep(match_spans(t, rf"(?<![0-9a-f])[0-9a-f]{{{HEX_LENGTH},}}"), "hex", lambda x: length(x) >= HEX_LENGTH),
    )
    found = hold(hold(rows, "base", F.array_sort(base)), "random", random_spans(t, table, threshold))
    found = found.withColumn("added", _keep(F.col("random"), "random", lambda x: length(x) >= SHORTEST))
    return found.select(*keep, "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.get(kinds, x.kind), x.start.cast("string"), x.stop.cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x.kind == KINDS.index(kind))).cast("bigint")


def redact(df: DataFrame, table: list[float], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``mark`` (touching and overlapping spans by one).

    All columns stay; a text without spans, null included, stays as it is.
    """
    # Columns go by place, so no name of theirs can clash.
    names = [f"_c{i}" for i in range(len(df.columns))]
    place = names[df.columns.index(text)]
    found = scan(df.toDF(*names), table, place, tuple(names)).select(*names, "spans")
    t = F.col(place)
    # Up to where the spans before each one reach; the text in between stays.
    reach = running(F.col("spans.stop"), F.greatest, F.lit(0).cast("bigint"))
    starts = F.concat(F.col("spans.start"), F.array(F.char_length(t).cast("bigint")))
    gaps = F.zip_with(starts, "reach", lambda start, stop: F.struct(stop.alias("a"), start.alias("b")))
    last = F.size("spans")
    open_gaps = F.filter(gaps, lambda g, i: (i == 0) | (i == last) | (g.b > g.a))
    kept = F.transform(open_gaps, lambda g: F.substring(t, (g.a + 1).cast("int"), (g.b - g.a).cast("int")))
    clean = F.when(last > 0, F.array_join(kept, mark)).otherwise(t)
    fields = [(clean if n == place else F.col(n)).alias(c) for n, c in zip(names, df.columns)]
    return hold(found, "reach", reach).select(*fields)
