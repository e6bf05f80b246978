"""SQL text gives the rows of the DataFrame calls."""

import pytest
from pyspark.sql import functions as F

from attestry.functions import canonical, checksums, surface
from attestry.operators import phrases

WORDS = ["Ab-12 é", "  محمد  أحمد ", "٠١٢-O5S", "Female", "ذكر", "2001-02-29", "31/12/1999", "kitten", "sitting", "", None, "x" * 600, "<b>rn vv cl</b>", "It's a \"test\" \\d"]


@pytest.fixture(scope="module")
def names(spark):
    return surface.register(spark)


def test_texts_and_numbers(spark, names):
    words = spark.createDataFrame([(i, a, b) for i, a in enumerate(WORDS) for b in WORDS], "i int, x0 string, x1 string")
    words.createOrReplaceTempView("words")
    for name, (function, n) in surface.TEXTS.items():
        arguments = [f"x{k}" for k in range(n)]
        assert name in names
        want = words.select("i", "x0", "x1", function(*[F.col(a) for a in arguments]).alias("y"))
        got = spark.sql(f"select i, x0, x1, {name}({', '.join(arguments)}) y from words")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    values = spark.createDataFrame([(a, b, 10.0, 20.0) for a in (-1.0, 0.0, 0.25, 2.5, None) for b in (0.0, 3.0)], "x0 double, x1 double, x2 double, x3 double")
    values.createOrReplaceTempView("vals")
    for name, (function, n) in surface.NUMBERS.items():
        arguments = [f"x{k}" for k in range(n)]
        want = values.select(function(*[F.col(a) for a in arguments]).alias("y"))
        assert sorted(map(str, spark.sql(f"select {name}({', '.join(arguments)}) y from vals").collect())) == sorted(map(str, want.collect())), name


def test_no_python_in_plans(spark, names):
    plan = spark.sql("select fuzzy_equal(x0, x1) and id_valid('EG', x0) y from words")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "regexp_replace" in plan


def test_ids(spark, names):
    ids = ["29501010123456", "4539578763621486", "123-45-6789", "79927398713", "", None, "12345678Z", "S1234567D", "010185-123M"]
    df = spark.createDataFrame([(c, i) for c in [*checksums.RULES, "XX", "eg", None] for i in ids], "country string, id string")
    df.createOrReplaceTempView("ids")
    want = checksums.validate(df).select("country", "id", "is_valid", "checksum_valid", "birth_year")
    got = spark.sql("select country, id, id_valid(country, id) is_valid, id_checksum(country, id) checksum_valid, id_year(country, id) birth_year from ids")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_json_and_table_function(spark, names):
    texts = spark.createDataFrame([(1, '{"b":1,"a":[1.0,null]}', "الجنسية مصر"), (2, "Name: Jo\nSex M", None), (3, None, None)], "k long, en string, ar string")
    texts.createOrReplaceTempView("texts")
    got = spark.sql("select k, canonical_json(en) j from texts").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, texts.select("k", canonical.rewritten()("en")).collect()))
    got = spark.sql("select * from labelled_fields(table(texts), 'k', 'ar', 'en')")
    assert got.dtypes == [("k", "bigint"), ("field", "string"), ("value", "string"), ("label", "string")]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, phrases.extracted(texts, "k", "ar", "en").collect()))
    with pytest.raises(Exception, match="no column"):
        spark.sql("select * from labelled_fields(table(texts), 'nothing', 'ar', 'en')").collect()
