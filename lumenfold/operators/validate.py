"""Line validation and first-failure routing.

Input: ``(batch_id, line_number, raw)`` rows (non-blank lines). Output adds
``reason_code`` (NULL = contract-valid so far), ``details`` and the typed v1
columns. Everything is a projection -- no shuffle -- so it runs at scan
speed; only candidate rows reach the Python JSON helper (see ``privacy``).
Lines whose text alone shows that no rule fails (``_stage_fit``) are read by one
plain parse; every other line takes the whole way.

Routing precedence: invalid_json -> invalid_shape -> privacy_violation ->
contract_violation (duplicate_event is decided later, across the batch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import full_match
from lumenfold.functions.timeutil import late_flag
from lumenfold.operators.privacy import PY_WHITESPACE_CLASS, candidate, inspect_json
from lumenfold.schema import (
    AMOUNT_RANGE,
    CURRENCY_PATTERN,
    ENVELOPE_FIELDS,
    EVENT_ID_PATTERN,
    EVENT_TYPES,
    GAME_VERSION_PATTERN,
    LATE_ARRIVAL_HOURS,
    LEVEL_RANGE,
    PLATFORMS,
    PLAYER_ID_PATTERN,
    PROPERTY_FIELDS,
    REASON_LENGTH,
    SCHEMA_VERSION,
)

LEVEL_EVENTS = ("level_start", "level_complete", "reset")
DUPLICATE_KEYS_CONF = "spark.sql.variant.allowDuplicateKeys"
_INT_TYPES = ("TINYINT", "SMALLINT", "INT", "BIGINT")
_OFFSET = r"(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})\z"
# A whole date and time, which date-only, time-only and one-digit fields are not.
_DATE_TIME = r"\A([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt _]([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?)"
_OFFSET_PARTS = r"([+-])([0-9]{2}):?([0-9]{2})\z"
_NUMERIC_TEXT = r"\A[+-]?[0-9]+(?:\.[0-9]+)?\z"
_INT_TEXT = r"\A[+-]?[0-9]+(?:_[0-9]+)*(?:\.0*)?\z"
_OUTER_SPACE = rf"\A[{PY_WHITESPACE_CLASS}]+|[{PY_WHITESPACE_CLASS}]+\z"
EPOCH_MS_THRESHOLD = 2e10
# Seconds of the first and last instant of the years 1 to 9999.
EPOCH_SECONDS = (-62135596800, 253402300799)


def _with_dup_setting(df: DataFrame, allow: bool, build):
    """Resolve ``build(df)`` with ``allowDuplicateKeys`` set; the setting is
    captured in the analysed plan, so two parses can differ in one query."""
    spark = df.sparkSession
    before = spark.conf.get(DUPLICATE_KEYS_CONF, None)
    spark.conf.set(DUPLICATE_KEYS_CONF, "true" if allow else "false")
    try:
        out = build(df)
        out.schema  # force analysis while the setting is active
        return out
    finally:
        if before is None:
            spark.conf.unset(DUPLICATE_KEYS_CONF)
        else:
            spark.conf.set(DUPLICATE_KEYS_CONF, before)


def _sentinel_parse(raw: Column) -> Column:
    """Whole-line JSON parse that rejects trailing garbage: the line is wrapped
    as ``[line,"<sha256(line)>"]`` and accepted only if element 1 round-trips."""
    tag = F.sha2(raw, 256)
    wrapped = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(',"'), tag, F.lit('"]')))
    ok = F.try_variant_get(wrapped, "$[1]", "string") == tag
    return F.when(ok, F.try_variant_get(wrapped, "$[0]", "variant"))


def parse_lines(lines: DataFrame, strict_duplicates: bool = False) -> DataFrame:
    """Add ``doc_ok`` (the line is exactly one JSON value; duplicate keys
    allowed, last wins) and, when asked, ``dup_free`` (the same with
    duplicate keys refused, at any depth). Only the verdicts are kept: the
    typed fields come from one ``from_json`` pass, and carrying the parsed
    document would make every later row copy (e.g. the Python stage's input
    buffer) pay for it."""

    def verdict(d: DataFrame) -> DataFrame:
        doc = _sentinel_parse(F.col("raw"))
        # ``properties`` comes from this parse, as repeated keys inside it are allowed too.
        return d.withColumns({"doc_ok": doc.isNotNull(), "doc_props": F.try_variant_get(doc, "$.properties", "variant")})

    out = _with_dup_setting(lines, True, verdict)
    if strict_duplicates:
        out = _with_dup_setting(
            out, False, lambda d: d.withColumn("dup_free", _sentinel_parse(F.col("raw")).isNotNull())
        )
    return out


# --- typed extraction, in staged projections --------------------------------
# Each stage only references columns produced by the previous stage, so the
# plan stays linear in the number of rules (no expression is inlined into
# several consumers).

_STR_FIELDS = ("event_id", "player_id", "game_version", "event_type", "platform")
_PROP_INT_FIELDS = ("level", "amount_cents")
_PROP_STR_FIELDS = ("currency", "reason")
_TS_FIELDS = ("event_time", "received_at")


_EXPR_CACHE: dict = {}


def _cached(name: str, build):
    """Rule expressions are unresolved Columns that do not depend on the input
    DataFrame: build them once per SparkContext (thousands of JVM calls) and
    reuse them for every batch."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    key = (id(sc._jsc) if sc is not None else None, name)
    if key not in _EXPR_CACHE:
        _EXPR_CACHE[key] = build()
    return _EXPR_CACHE[key]


_ENVELOPE_VARIANTS = (*_STR_FIELDS, *_TS_FIELDS, "schema_version", "properties")
_ENVELOPE_SCHEMA = ", ".join(f"{name} variant" for name in _ENVELOPE_VARIANTS)


def _stage_types(df: DataFrame) -> DataFrame:
    """One ``from_json`` pass splits the envelope into small per-field VARIANTs
    (duplicate keys: last wins; explicit null -> VOID; absent -> NULL), then a
    type name per field. Navigating small variants is far cheaper than
    path lookups into the whole document."""
    # Parse once into its own column: selecting fields straight out of the
    # from_json call would let the optimiser split it into one pruned parse
    # per field (13 parses of the same line).
    def build():
        names = (*_ENVELOPE_VARIANTS, *_PROP_INT_FIELDS, *_PROP_STR_FIELDS)
        return (
            F.from_json(F.col("raw"), _ENVELOPE_SCHEMA),
            {f"f_{name}": F.col("_env")[name] for name in _ENVELOPE_VARIANTS} | {"f_properties": F.col("doc_props")},
            {
                f"f_{name}": F.try_variant_get(F.col("f_properties"), f"$.{name}", "variant")
                for name in (*_PROP_INT_FIELDS, *_PROP_STR_FIELDS)
            },
            {f"t_{name}": F.schema_of_variant(F.col(f"f_{name}")) for name in names},
        )

    env, fields, props, types = _cached("types", build)
    df = df.withColumn("_env", env)
    df = df.withColumns(fields).drop("_env", "doc_props")
    return df.withColumns(props).withColumns(types)


# A member of a line in plain form: no escapes, no numbers but integers, times in UTC.
_PLAIN_TIME = r'"[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?(?:Z|\+00:00)"'
_PLAIN_INT = r"(?:0|[1-9][0-9]{0,8})"
_PLAIN_PROPERTIES = {
    "level": _PLAIN_INT,
    "amount_cents": _PLAIN_INT,
    "currency": f'"{CURRENCY_PATTERN.strip("^$")}"',
    "reason": rf'"[A-Za-z0-9 _.,:;!?()/+-]{{{REASON_LENGTH[0]},{REASON_LENGTH[1]}}}"',
}


def _members(values: dict[str, str], unique: bool = False) -> str:
    """One of the members and the comma that must follow it, unless the object ends there."""
    again = {name: rf'(?![^}}]*"{name}")' if unique else "" for name in values}
    each = "|".join(f'"{name}": ?{again[name]}{value}' for name, value in values.items())
    return rf"(?:(?:{each})(?:, ?(?=\")|(?=\}})))"


_PLAIN_FIELDS = {
    "event_id": f'"{EVENT_ID_PATTERN.strip("^$")}"',
    "event_time": _PLAIN_TIME,
    "event_type": f'"(?:{"|".join(EVENT_TYPES)})"',
    "game_version": r'"[0-9]{1,2}\.[0-9]+\.[0-9]+"',  # none that could pass for a phone number
    "platform": f'"(?:{"|".join(PLATFORMS)})"',
    "player_id": f'"{PLAYER_ID_PATTERN.strip("^$")}"',
    "properties": rf"\{{{_members({n: f'(?:{v}|null)' for n, v in _PLAIN_PROPERTIES.items()}, unique=True)}*\}}",
    "received_at": _PLAIN_TIME,
    "schema_version": str(SCHEMA_VERSION),
}
_PLAIN_LINE = rf"\A\{{{_members(_PLAIN_FIELDS)}{{{len(_PLAIN_FIELDS)}}}\}}\z"
_RECORD_SCHEMA = (
    "event_id string, event_time string, event_type string, game_version string, platform string, player_id string,"
    " properties struct<level: int, amount_cents: int, currency: string, reason: string>,"
    " received_at string, schema_version int"
)


def _stage_fit(df: DataFrame) -> DataFrame:
    """``_fit``: the line is contract-valid, as one regex and the few rules across fields show; its
    values are in ``_record`` and ``_stamps``, its text in ``_line``. ``raw`` is NULL from here on
    for these lines, so that the stages after this one do no work for them. A line of as many
    members as the contract has fields in which no field is missing repeats none. Of its members
    only a reason can hold what ``candidate`` looks for."""
    record, stamps, fit = _cached("fit", _fit_exprs)
    marked = df.withColumn("_record", record).withColumn("_stamps", stamps).withColumn("_fit", fit)
    return marked.withColumns({"_line": F.col("raw"), "raw": F.when(~F.col("_fit"), F.col("raw"))})


def _fit_exprs() -> tuple[Column, Column, Column]:
    raw, record, stamps = F.col("raw"), F.col("_record"), F.col("_stamps")
    plain = F.when(raw.rlike(_PLAIN_LINE), raw)
    level, amount = record["properties"]["level"], record["properties"]["amount_cents"]
    etype = record["event_type"]
    rules = [record[name].isNotNull() for name in _PLAIN_FIELDS]
    rules += [stamps["received_at"] >= stamps["event_time"]]
    rules += [v.isNull() | v.between(*bounds) for v, bounds in ((level, LEVEL_RANGE), (amount, AMOUNT_RANGE))]
    rules += [~etype.isin(*LEVEL_EVENTS) | level.isNotNull()]
    rules += [(etype != "purchase") | (amount.isNotNull() & record["properties"]["currency"].isNotNull())]
    rules += [record["properties"]["reason"].isNull() | ~candidate(raw)]
    fit = rules[0]
    for rule in rules[1:]:
        fit = fit & rule
    times = F.struct(*(F.try_to_timestamp(record[name]).alias(name) for name in _TS_FIELDS))
    return F.from_json(plain, _RECORD_SCHEMA), times, F.coalesce(fit, F.lit(False))


def _is_number(t: Column) -> Column:
    return t.isin(*_INT_TYPES) | t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT")


def _int_value(v: Column, t: Column) -> Column:
    """Lax integer coercion: integral numbers, booleans and integral numeric
    text are accepted; fractions are not."""
    dbl = v.try_cast("double")
    txt = F.regexp_replace(v.try_cast("string"), _OUTER_SPACE, "")
    digits = F.translate(F.regexp_extract(txt, r"^([+-]?[0-9_]+)", 1), "_", "")
    return (
        F.when(t.isin(*_INT_TYPES), v.try_cast("bigint"))
        .when(
            t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"),
            F.when(dbl == F.floor(dbl), dbl.try_cast("bigint")),
        )
        .when(t == "BOOLEAN", F.when(v.try_cast("boolean"), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
        .when((t == "STRING") & txt.rlike(_INT_TEXT), digits.try_cast("bigint"))
    )


def _epoch_to_ts(seconds_or_ms: Column) -> Column:
    secs = F.when(F.abs(seconds_or_ms) > EPOCH_MS_THRESHOLD, seconds_or_ms / 1000).otherwise(seconds_or_ms)
    return F.when(secs.between(*EPOCH_SECONDS), F.timestamp_micros(F.floor(secs * 1_000_000).try_cast("bigint")))


def _text_parts(name: str) -> dict[str, Column]:
    """What ``_text_to_ts`` needs of a time's text: columns, as each is used several times."""
    txt = F.col(f"x_{name}")
    parts = {f"{part}_{name}": F.regexp_extract(txt, _DATE_TIME, i) for i, part in ((1, "date"), (2, "time"))}
    parts |= {f"{part}_{name}": F.regexp_extract(txt, _OFFSET_PARTS, i) for i, part in ((1, "sign"), (2, "hours"), (3, "minutes"))}
    return parts | {f"numeric_{name}": txt.rlike(_NUMERIC_TEXT), f"offset_{name}": txt.rlike(_OFFSET)}


def _text_to_ts(name: str) -> Column:
    """Whole date and time, taken as UTC, less the offset that is written (under a day)."""
    date, time, sign, hours, minutes = (F.col(f"{part}_{name}") for part in ("date", "time", "sign", "hours", "minutes"))
    full = F.when(F.length(time) == 5, F.concat(time, F.lit(":00"))).otherwise(time)
    local = F.when(date != "", F.try_to_timestamp(F.concat(date, F.lit("T"), full, F.lit("Z"))))
    shift = hours.try_cast("bigint") * 60 + minutes.try_cast("bigint")
    signed = F.when(sign == "-", -shift).when(sign == "+", shift).otherwise(F.lit(0).cast("bigint"))
    small = (sign == "") | ((hours.try_cast("int") < 24) & (minutes.try_cast("int") < 60))
    return F.when(small, F.timestamp_micros(F.unix_micros(local) - signed * 60_000_000))


def _stage_values(df: DataFrame) -> DataFrame:
    """Raw typed values; NULL when absent, null or of the wrong JSON type."""
    return df.withColumns(_cached("values", _values_exprs))


def _values_exprs() -> dict[str, Column]:
    values: dict[str, Column] = {}
    for name in (*_STR_FIELDS, *_PROP_STR_FIELDS):
        values[f"v_{name}"] = F.when(F.col(f"t_{name}") == "STRING", F.col(f"f_{name}").try_cast("string"))
    for name in ("schema_version", *_PROP_INT_FIELDS):
        values[f"v_{name}"] = _int_value(F.col(f"f_{name}"), F.col(f"t_{name}"))
    for name in _TS_FIELDS:
        f = F.col(f"f_{name}")
        values[f"x_{name}"] = F.when(F.col(f"t_{name}") == "STRING", f.try_cast("string"))
        # Casting a time's text to a number would raise and catch an exception per line.
        values[f"n_{name}"] = F.when(_is_number(F.col(f"t_{name}")), f.try_cast("double"))
    # Top-level keys straight from the line (it is valid JSON whenever doc is).
    values["root_keys"] = F.json_object_keys(F.col("raw"))
    values["prop_keys"] = F.json_object_keys(F.to_json(F.col("f_properties")))
    return values


def _stage_timestamps(df: DataFrame) -> DataFrame:
    """Text must carry a UTC offset; epoch numbers (seconds, or milliseconds
    above 2e10) are UTC by definition."""
    parts, stamps, values = _cached("timestamps", _timestamp_exprs)
    return df.withColumns(parts).withColumns(stamps).withColumns(values)


def _timestamp_exprs() -> tuple[dict[str, Column], ...]:
    parts: dict[str, Column] = {}
    stamps: dict[str, Column] = {}
    out: dict[str, Column] = {}
    for name in _TS_FIELDS:
        txt, num = F.col(f"x_{name}"), F.col(f"n_{name}")
        numeric_text, has_offset, stamp = (F.col(f"{part}_{name}") for part in ("numeric", "offset", "stamp"))
        parts |= _text_parts(name)
        stamps[f"stamp_{name}"] = _text_to_ts(name)
        out[f"v_{name}"] = (
            F.when(_is_number(F.col(f"t_{name}")), _epoch_to_ts(num))
            .when(numeric_text, _epoch_to_ts(txt.try_cast("double")))
            .when(has_offset, stamp)
        )
        out[f"naive_{name}"] = ~numeric_text & ~has_offset & stamp.isNotNull()
    return parts, stamps, out


def _present(name: str) -> Column:
    t = F.col(f"t_{name}")
    return t.isNotNull() & (t != "VOID")


def _stage_codes(df: DataFrame) -> DataFrame:
    """Comma-joined list of failed rule codes, in rule order."""
    return df.withColumn("codes", _cached("codes", _codes_expr))


def _codes_expr() -> Column:
    rules: list[tuple[Column, str]] = []
    rules.append((F.size(F.array_except("root_keys", F.array(*[F.lit(k) for k in ENVELOPE_FIELDS]))) > 0, "extra_fields"))
    for name, pattern in (("event_id", EVENT_ID_PATTERN), ("player_id", PLAYER_ID_PATTERN), ("game_version", GAME_VERSION_PATTERN)):
        v = F.col(f"v_{name}")
        rules.append((~_present(name), f"{name}:missing"))
        rules.append((_present(name) & v.isNull(), f"{name}:type"))
        rules.append((v.isNotNull() & ~full_match(v, pattern), f"{name}:pattern"))
    for name, allowed in (("event_type", EVENT_TYPES), ("platform", PLATFORMS)):
        v = F.col(f"v_{name}")
        rules.append((~_present(name), f"{name}:missing"))
        rules.append((_present(name) & (v.isNull() | ~v.isin(*allowed)), f"{name}:enum"))
    sv = F.col("v_schema_version")
    rules.append((F.col("t_schema_version") == "VOID", "schema_version:null"))
    rules.append((_present("schema_version") & (sv.isNull() | (sv != SCHEMA_VERSION)), "schema_version:value"))
    for name in _TS_FIELDS:
        v, naive = F.col(f"v_{name}"), F.coalesce(F.col(f"naive_{name}"), F.lit(False))
        rules.append((~_present(name), f"{name}:missing"))
        rules.append((_present(name) & naive, f"{name}:timezone"))
        rules.append((_present(name) & ~naive & v.isNull(), f"{name}:datetime"))
    rules.append(
        (F.col("v_received_at") < F.col("v_event_time"), "received_at:precedes_event_time")
    )
    pt = F.col("t_properties")
    rules.append((pt.isNotNull() & ~pt.startswith("OBJECT"), "properties:type"))
    rules.append(
        (
            pt.startswith("OBJECT") & (F.size(F.array_except("prop_keys", F.array(*[F.lit(k) for k in PROPERTY_FIELDS]))) > 0),
            "properties:extra_fields",
        )
    )
    for name, (lo, hi) in (("level", LEVEL_RANGE), ("amount_cents", AMOUNT_RANGE)):
        v = F.col(f"v_{name}")
        rules.append((_present(name) & v.isNull(), f"{name}:type"))
        rules.append((v.isNotNull() & ~v.between(lo, hi), f"{name}:range"))
    cur = F.col("v_currency")
    rules.append((_present("currency") & (cur.isNull() | ~full_match(cur, CURRENCY_PATTERN)), "currency:pattern"))
    rsn = F.col("v_reason")
    rules.append((_present("reason") & (rsn.isNull() | ~F.length(rsn).between(*REASON_LENGTH)), "reason:length"))
    etype = F.col("v_event_type")
    rules.append((etype.isin(*LEVEL_EVENTS) & F.col("v_level").isNull(), "level:required"))
    rules.append(
        (
            (etype == "purchase") & (F.col("v_amount_cents").isNull() | F.col("v_currency").isNull()),
            "purchase:amount_and_currency_required",
        )
    )
    # concat_ws skips NULLs and stays inside whole-stage codegen (array_compact
    # is a lambda filter, which is not). Codes hold no commas or quotes.
    return F.concat_ws(",", *[F.when(cond, F.lit(code)) for cond, code in rules])


TYPED_COLUMNS = (
    "event_id",
    "schema_version",
    "player_id",
    "event_type",
    "event_time",
    "received_at",
    "game_version",
    "platform",
    "level",
    "amount_cents",
    "currency",
    "reason",
)


def _verdict_exprs() -> dict:
    doc_ok, fit = F.col("doc_ok"), F.col("_fit")
    insp = F.col("insp")
    needs_python = ~doc_ok | (F.col("object_root") & candidate(F.col("raw")))
    e: dict = {
        "object_root": F.col("raw").rlike(r"\A[ \t\n\r]*\{"),
        "insp": inspect_json(F.when(needs_python, F.col("raw"))),
        "flags": {
            "_parsed": doc_ok | F.coalesce(insp.parsed, F.lit(False)),
            "_object": F.when(doc_ok, F.col("object_root")).otherwise(F.coalesce(insp.is_object, F.lit(False))),
        },
        "privacy": F.when(F.col("_object"), insp.violations),
        "reason": (
            F.when(fit, F.lit(None))
            .when(~F.col("_parsed"), F.lit("invalid_json"))
            .when(~F.col("_object"), F.lit("invalid_shape"))
            .when(F.col("_privacy").isNotNull(), F.lit("privacy_violation"))
            .when(~doc_ok | (F.col("codes") != ""), F.lit("contract_violation"))
        ),
        # Strict input (A11): a line that *is* JSON but has duplicate keys,
        # non-finite numbers or a non-object root refuses the whole input.
        "strict_refused": ~fit
        & ((doc_ok & (~F.col("dup_free") | ~F.col("object_root")))
        | (F.coalesce(insp.parsed, F.lit(False)) & insp.refused.isNotNull())),
    }
    rc = F.col("reason_code")
    details = (
        F.when(rc == "invalid_json", F.lit("line is not one well-formed JSON value"))
        .when(rc == "invalid_shape", F.lit("root must be an object"))
        .when(rc == "privacy_violation", F.col("_privacy"))
        .when(
            rc == "contract_violation",
            F.when(~doc_ok, F.lit('["json:non_finite_or_unsupported_value"]')).otherwise(
                F.concat(F.lit('["'), F.regexp_replace("codes", ",", '","'), F.lit('"]'))
            ),
        )
    )
    typed = {
        "event_id": F.col("v_event_id"),
        "schema_version": F.coalesce(
            F.col("v_schema_version"), F.when(F.col("t_schema_version").isNull(), F.lit(SCHEMA_VERSION))
        ).try_cast("int"),
        "player_id": F.col("v_player_id"),
        "event_type": F.col("v_event_type"),
        "event_time": F.col("v_event_time"),
        "received_at": F.col("v_received_at"),
        "game_version": F.col("v_game_version"),
        "platform": F.col("v_platform"),
        "level": F.col("v_level").try_cast("int"),
        "amount_cents": F.col("v_amount_cents").try_cast("int"),
        "currency": F.col("v_currency"),
        "reason": F.col("v_reason"),
    }
    record = F.col("_record")
    plain = {c: record["properties"][c] if c in PROPERTY_FIELDS else record[c] for c in TYPED_COLUMNS}
    plain |= {c: F.col("_stamps")[c] for c in _TS_FIELDS}
    e["output"] = [
        F.col("batch_id"),
        F.col("line_number"),
        F.col("_line").alias("raw"),
        F.col("reason_code"),
        details.alias("details"),
        *[F.when(fit, plain[c]).otherwise(typed[c]).alias(c) for c in TYPED_COLUMNS],
    ]
    e["is_late"] = F.when(
        F.col("reason_code").isNull(), late_flag("event_time", "received_at", LATE_ARRIVAL_HOURS)
    )
    return e


def validate(lines: DataFrame, strict_duplicates: bool = False, partitions: int | None = None) -> DataFrame:
    """Per-line verdict: ``reason_code``/``details`` for the first failed stage
    (NULL when the line is contract-valid) plus typed columns and ``is_late``.

    ``partitions`` deals the lines round-robin to so many tasks first; by
    default they stay where the scan has them."""
    e = _cached("verdict", _verdict_exprs)
    dealt = _stage_fit(lines if partitions is None else lines.repartition(partitions))
    parsed = parse_lines(dealt, strict_duplicates)
    staged = parsed.withColumn("object_root", e["object_root"]).withColumn("insp", e["insp"])
    staged = _stage_codes(_stage_timestamps(_stage_values(_stage_types(staged))))
    staged = staged.withColumns(e["flags"]).withColumn("_privacy", e["privacy"])
    staged = staged.withColumn("reason_code", e["reason"])
    extra = []
    if strict_duplicates:
        staged = staged.withColumn("strict_refused", e["strict_refused"])
        extra = ["strict_refused"]
    out = staged.select(*e["output"], *extra)
    return out.withColumn("is_late", e["is_late"])
