"""Canonical JSON of typed columns and of texts."""

import json
import random

from pyspark.sql import functions as F

from attestry.functions import canonical

NUMBERS = [(0.0, "0"), (-0.0, "0"), (1.0, "1"), (-1.5, "-1.5"), (0.1, "0.1"), (100.0, "100"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.25e22, "1.25e+22"), (1e-6, "0.000001"), (1.5e-7, "1.5e-7"), (123456789.125, "123456789.125"), (5e-324, "5e-324"), (0.00012, "0.00012"), (1234567.0, "1234567"), (12345678.9, "12345678.9"), (float("nan"), "null"), (float("inf"), "null"), (None, "null"), (1e7, "10000000"), (-2.5e-3, "-0.0025"), (10.0, "10"), (1010.5, "1010.5")]


def test_numbers(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(NUMBERS)], "i int, x double")
    got = [r[1] for r in sorted(df.select("i", canonical.number(F.col("x"))).collect())]
    java = {5e-324, 1.25e22}  # Java 17 has more digits for some doubles than tell them apart
    assert [g for g, (x, _) in zip(got, NUMBERS) if x not in java] == [w for x, w in NUMBERS if x not in java]
    assert [canonical.script_number(x) for x, _ in NUMBERS if x is not None] == [w for x, w in NUMBERS if x is not None]
    rng = random.Random(1)
    many = [rng.choice([1, -1]) * rng.randrange(1, 10**6) / 10 ** rng.randrange(0, 12) * 10 ** rng.randrange(0, 20) for _ in range(400)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in many], "x double").select(canonical.number(F.col("x"))).collect()]
    assert all(float(g) == x for g, x in zip(got, many)) and sum(g == canonical.script_number(x) for g, x in zip(got, many)) > 390


def test_nested_columns(spark):
    schema = "b int, a struct<z: string, y: array<struct<d: double, c: string>>>, m map<string, map<string, boolean>>, t timestamp_ntz, `é\"k` string, n array<int>"
    rows = [
        (1, ("q\"\\\n\x01é\x1f/", [(2.0, None), (0.5, "x"), None]), {"k2": {"b": True, "a": None}, "k1": None, "": {}}, None, "v", [3, None]),
        (None, None, None, None, None, []),
        (2, (None, None), {}, None, "", None),
    ]
    df = spark.createDataFrame(rows, schema)
    kind = df.schema
    got = [r[0] for r in df.select(canonical.canonical(F.struct("*"), kind)).collect()]

    def value(row):
        b, a, m, t, k, n = row
        return {"b": b, "a": a and {"z": a[0], "y": a[1] and [y and {"d": y[0], "c": y[1]} for y in a[1]]}, "m": m, "t": t, 'é"k': k, "n": n}

    assert got == [canonical.plain(value(r)) for r in rows]
    assert [json.loads(g) for g in got] == [value(r) for r in rows]
    named = [r[0] for r in df.select(canonical.canonical(F.struct("*"), kind, ["y", "a", "d", "k1", "m"])).collect()]
    assert named == [canonical.plain(value(r), keys=["y", "a", "d", "k1", "m"]) for r in rows]
    assert named[0] == '{"a":{"y":[{"d":2},{"d":0.5},null]},"m":{"k1":null}}'


def test_texts(spark):
    texts = ['{"b": 1, "a": {"d": [1.0, {"y": null, "x": "\\u00e9\\u0007"}], "c": 1e21}}', "[]", '"s"', "1.50", "no json", None, '{"type": "t", "details": {"k": 1, "type": 2}}', '{"b":{},"a":1e400}', "12345678901234567890123"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    run = lambda f: [r[1] for r in sorted(df.select("i", f("t")).collect())]
    assert run(canonical.rewritten()) == ['{"a":{"c":1e+21,"d":[1,{"x":"é\\u0007","y":null}]},"b":1}', "[]", '"s"', "1.5", None, None, '{"details":{"k":1,"type":2},"type":"t"}', '{"a":null,"b":{}}', "12345678901234567890123"]
    assert run(canonical.rewritten(keys=["details", "type"]))[6] == '{"details":{"type":2},"type":"t"}'
    assert run(canonical.rewritten(sort=False))[6] == '{"type":"t","details":{"k":1,"type":2}}'
    assert run(canonical.rewritten(spaced=True))[0] == '{"a": {"c": 1e+21, "d": [1.0, {"x": "\\u00e9\\u0007", "y": null}]}, "b": 1}'
