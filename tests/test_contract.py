"""Single-rule contract, routing and privacy semantics."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import canonical, lines_df
from lumenfold.functions.hashing import hmac_pads, pseudonymize
from lumenfold.operators.ingest import route
from lumenfold.operators.privacy import scan_json
from lumenfold.operators.privacy import candidate
from lumenfold.operators.validate import _stage_fit, validate


def verdicts(spark, raws):
    df = validate(lines_df(spark, raws))
    return {r["line_number"]: (r["reason_code"], r["details"]) for r in df.collect()}


def test_valid_event_passes(spark, make):
    out = verdicts(spark, [canonical(make())])
    assert out == {1: (None, None)}


@pytest.mark.parametrize(
    ("event_type", "properties"),
    [("level_start", {}), ("level_complete", {}), ("reset", {}), ("purchase", {"amount_cents": 199})],
)
def test_event_specific_properties_are_required(spark, make, event_type, properties):
    out = verdicts(spark, [canonical(make(event_type=event_type, properties=properties))])
    assert out[1][0] == "contract_violation"


def test_timezone_and_arrival_order(spark, make):
    naive = make()
    naive["event_time"] = "2026-08-01T12:00:00"
    early = make(arrival_delay=dt.timedelta(seconds=-1))
    out = verdicts(spark, [canonical(naive), canonical(early)])
    assert out[1][0] == "contract_violation" and "event_time:timezone" in out[1][1]
    assert out[2][0] == "contract_violation" and "received_at:precedes_event_time" in out[2][1]


def test_shape_and_json_errors(spark):
    out = verdicts(spark, ["{bad json}", "[1,2,3]", '{"a":1} trailing', '"just a string"'])
    assert out[1][0] == "invalid_json"
    assert out[2][0] == "invalid_shape"
    assert out[3][0] == "invalid_json"
    assert out[4][0] == "invalid_shape"


def test_pattern_anchors_reject_trailing_newline_and_unknown_fields(spark, make):
    bad_id = make()
    bad_id["event_id"] = "evt_0000000000000001\n"
    extra = make()
    extra["surprise"] = 1
    extra_prop = make(properties={"colour": "red"})
    out = verdicts(spark, [json.dumps(bad_id), canonical(extra), canonical(extra_prop)])
    assert out[1][0] == "contract_violation" and "event_id:pattern" in out[1][1]
    assert "extra_fields" in out[2][1]
    assert "properties:extra_fields" in out[3][1]


def test_lax_coercion_and_defaults(spark, make):
    as_text = make(event_type="level_start", properties={"level": "3"})
    as_float = make(event_type="level_start", properties={"level": 3.0})
    fraction = make(event_type="level_start", properties={"level": 3.5})
    no_version = make()
    del no_version["schema_version"]
    null_version = make()
    null_version["schema_version"] = None
    no_props = make()
    del no_props["properties"]
    out = verdicts(
        spark, [canonical(r) for r in (as_text, as_float, fraction, no_version, null_version, no_props)]
    )
    assert out[1] == (None, None) and out[2] == (None, None)
    assert out[3][0] == "contract_violation"
    assert out[4] == (None, None)
    assert out[5][0] == "contract_violation"
    assert out[6] == (None, None)


def test_privacy_precedes_contract_and_reports_paths(spark, make):
    leaky = make()
    leaky["properties"] = {"email": "player@example.test"}
    out = verdicts(spark, [canonical(leaky)])
    assert out[1][0] == "privacy_violation"
    assert out[1][1] == "email-like value at properties.email; sensitive key at properties.email"


def test_privacy_scan_names_every_place_once():
    raw = r'''{"a": [{"": {"x": "mail me: q@w.example"}}, ["Bearer 0123456789abc", 5]], "ApiKey": null, "a": [[], {"tel": "(212) 555-0199"}],
        "k\ud800_token": "\u0071@w.example"}'''
    is_object, found, flaw = scan_json(raw)
    # The first "a" is replaced by the second; the escaped address is one all the same.
    assert is_object and flaw == "repeated key"
    assert found == [
        "email-like value at k\ud800_token", "phone-like value at a[1].tel",
        "sensitive key at ApiKey", "sensitive key at k\ud800_token",
    ]
    assert scan_json('{"": {"x": "q@w.example"}}')[1] == ["email-like value at x"]
    assert scan_json('[{"email": 1}]') == (False, [], "no object") and scan_json('{"n": NaN}')[2] == "NaN"


def test_lines_that_must_not_stop_a_batch(spark, make):
    whole = canonical(make(properties={"note": "@"}))
    lines = [whole.replace('"@"', "9" * 5000 + ', "m": "@"'), whole.replace('"note"', r'"\ud800email"'), canonical(make(schema_version=2**40))]
    assert [v[0] for v in verdicts(spark, lines).values()] == ["invalid_json", "privacy_violation", "contract_violation"]


def test_duplicates_lowest_line_wins(spark, make):
    e = canonical(make(7))
    routed = route(lines_df(spark, [e, canonical(make(8)), e]))
    got = {r["line_number"]: r["reason_code"] for r in routed.collect()}
    assert got == {1: None, 2: None, 3: "duplicate_event"}


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet=st.characters(categories=("L", "N")), min_size=1, max_size=40))
def test_pseudonym_matches_hmac(spark_for_hypothesis, source_id):
    secret = "a-secret-long-enough"
    expected = "ply_" + hmac.new(secret.encode(), source_id.encode(), hashlib.sha256).hexdigest()[:12]
    got = spark_for_hypothesis.range(1).select(pseudonymize(F.lit(source_id), secret).alias("p")).first()["p"]
    assert got == expected


@pytest.fixture(scope="module")
def spark_for_hypothesis(spark):
    return spark


def test_pseudonym_requires_meaningful_secret():
    with pytest.raises(ValueError, match="16 characters"):
        hmac_pads("short")


def test_text_scan_matches_python_rules_on_driver_texts(spark):
    from conftest import SF01
    from lumenfold.operators.privacy import _PY_VALUES, scan_text

    for table, keys in (("documents", ["doc_id"]), ("conversations", ["conv_id", "turn"])):
        df = spark.read.parquet(f"{SF01}/{table}.parquet").select(*keys, "text")
        got = {tuple(r[k] for k in keys): r["violations"] for r in scan_text(df, keys, "text").collect()}
        expected = {}
        for r in df.collect():
            labels = sorted(f"{label} at text" for label, rx in _PY_VALUES if r["text"] and rx.search(r["text"]))
            if labels:
                expected[tuple(r[k] for k in keys)] = "; ".join(labels)
        assert got == expected, table


def plain(make, **changed):
    return canonical(make(event_type="level_start", properties={"level": 3}) | changed)


def test_valid_lines_in_plain_form_skip_the_long_way(spark, make):
    """In any order of the keys; ``raw`` is what the costly stages see."""
    record = json.loads(plain(make))
    lines = [canonical(record), json.dumps(dict(reversed(record.items()))), plain(make, properties={"level": None, "reason": "ok"}, event_type="purchase")]
    seen = {r["line_number"]: r for r in _stage_fit(lines_df(spark, lines)).collect()}
    assert [(seen[n]["_fit"], seen[n]["raw"]) for n in (1, 2, 3)] == [(True, None), (True, None), (False, lines[2])]
    assert [seen[n]["_line"] for n in (1, 2, 3)] == lines
    assert verdicts(spark, lines) == {1: (None, None), 2: (None, None), 3: ("contract_violation", '["purchase:amount_and_currency_required"]')}


def test_lines_that_only_look_plain_take_the_long_way(spark, make):
    line = plain(make)
    odd = [
        line + "x", line[:-1] + ",}", "[" + line + "]", line.replace(":3", ":03"), line.replace(":3", ":1001"), line.replace(":3", ':3,"level":0'),
        line.replace('"platform":"pc"', '"platform":"pc","platform":"mobile"'), line.replace('"platform":"pc"', '"event_type":"reset"'),
        plain(make, event_time="2026-02-30T12:00:00Z"), plain(make, received_at="2020-01-01T00:00:00Z"), plain(make, game_version="123.456.7890"),
        plain(make, properties={"level": 3, "reason": "call 619-555-0101"}), plain(make, properties={"level": 3, "reason": "my token"}),
    ]
    marked = _stage_fit(lines_df(spark, odd)).collect()
    assert [r["_line"] for r in marked if r["_fit"]] == []
    out = verdicts(spark, odd)
    assert [out[n][0] for n in (1, 2, 3)] == ["invalid_json", "invalid_json", "invalid_shape"]
    assert [out[n][0] for n in (11, 12)] == ["privacy_violation"] * 2
    assert [out[n][0] for n in (4, 5, 6, 8, 9, 10)] == ["invalid_json"] + ["contract_violation"] * 5
    assert out[7] == out[13] == (None, None)


def test_no_plain_line_is_a_candidate_for_the_privacy_scan(spark, make):
    reasons = [None, "ok", "a name", "Bearer 123456789012", "619.555.0101", "apikey"]
    lines = [plain(make, properties={"level": 3, "reason": r}, game_version=v) for r in reasons for v in ("12.345.6789", "1.2.3", "1.123.456.7890")]
    marked = _stage_fit(lines_df(spark, lines))
    assert marked.where(F.col("_fit")).count() == 4
    assert marked.where(F.col("_fit") & candidate(F.col("_line"))).count() == 0
