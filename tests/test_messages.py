import pytest

from tabforge.functions.messages import explode_messages, extract_records, parse_messages

CASES = [
    ('{"sensor":"A","value":1.5}', "object"), ("plain text message", "raw"), ("[1,2,3]", "value"),
    ('{"sensor":"B"} trailing', "raw"), ("1] [2", "raw"), ("1,2", "raw"), ("", "raw"), ("5", "value"),
    (' {"sensor":"C"}\n', "object"), ('"text"', "value"), ("null", "value"), ("true", "value"),
    ("{", "raw"), ('{"sensor":"A"}{"sensor":"B"}', "raw"),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, m) for i, (m, _) in enumerate(CASES)], "id int, m string")


def test_kinds_and_fields(frame):
    got = {r.id: r for r in parse_messages(frame, "m", {"sensor": "string", "value": "double"}, prefix="f_").collect()}
    assert [got[i].kind for i in range(len(CASES))] == [k for _, k in CASES]
    assert (got[0].f_sensor, got[0].f_value) == ("A", 1.5)
    assert got[1].raw == "plain text message"
    assert got[2].value == "[1,2,3]"
    assert got[8].f_sensor == "C"
    assert got[9].value == "text"
    assert got[10].value is None


def test_bytes_are_repaired_and_null_stays_null(spark):
    df = spark.createDataFrame([(bytearray(b"\xffabc"),), (None,), (bytearray(b'{"x":1}'),)], "m binary")
    got = [(r.kind, r.x, r.raw) for r in parse_messages(df, "m", {"x": "int"}).collect()]
    assert got == [("raw", None, "\ufffdabc"), ("raw", None, None), ("object", 1, None)]


def test_ill_typed_and_odd_keys(spark):
    df = spark.createDataFrame([('{"a.b":1,"it\'s":2,"n":"x"}',)], "m string")
    r = parse_messages(df, "m", {"a.b": "int", "it's": "int", "n": "int"}).first()
    assert (r["a.b"], r["it's"], r["n"]) == (1, 2, None)


def test_lists_become_rows(spark):
    df = spark.createDataFrame([(1, '[{"v":1},{"v":2},7]'), (2, '{"v":3}'), (3, "oops"), (4, "[]")], "id int, m string")
    got = sorted((r.id, r.position, r.kind, r.v, r.value, r.raw)
                 for r in explode_messages(df, "m", {"v": "int"}).collect())
    assert got == [(1, 0, "object", 1, None, None), (1, 1, "object", 2, None, None), (1, 2, "value", None, "7", None),
                   (2, 0, "object", 3, None, None), (3, 0, "raw", None, None, "oops")]


@pytest.mark.parametrize("payload, path, want", [
    ('[{"a":1},{"a":2}]', "data", [1, 2]),
    ('{"data":[{"a":1},{"a":2}]}', "data", [1, 2]),
    ('{"data":{"a":9}}', "data", [9]),
    ('{"a":4}', "data", [4]),
    ('{"a":4,"data":[]}', "", [4]),
])
def test_records_of_payloads(spark, payload, path, want):
    df = spark.createDataFrame([(payload,)], "p string")
    assert [r.a for r in extract_records(df, "p", {"a": "int"}, path).orderBy("position").collect()] == want


def test_last_of_repeated_keys_and_long_numbers(spark):
    long = "1" * 45
    df = spark.createDataFrame([(1, '{"k": 1, "k": 2}'), (2, f" {long}\n"), (3, f"-{long}")], "id int, m string")
    got = {r.id: r for r in parse_messages(df, "m", {"k": "int"}).collect()}
    assert (got[1].kind, got[1].k) == ("object", 2)
    assert got[2].value == long and got[3].value == f"-{long}"
