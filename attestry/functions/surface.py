"""The library's functions for SQL text.

``register`` makes temporary SQL functions of column functions: their bodies are the
analysed expressions themselves, so a query in SQL has the same plan as one in Python,
all of it in the JVM.  ID rules are one function a country and one that chooses among
them.  What needs Python comes as Arrow functions, and as a table function whose
columns follow the table it is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from attestry.functions import canonical, checksums, numbers, text
from attestry.operators import phrases, repair

#: Functions of texts by name, with the number of arguments.
TEXTS: dict[str, tuple[Callable[..., Column], int]] = {
    "digits_only": (text.digits_only, 1),
    "western_digits": (text.western_digits, 1),
    "normalize_arabic": (text.normalize_arabic, 1),
    "normalize_latin": (text.normalize_latin, 1),
    "normalize_gender": (text.normalize_gender, 1),
    "normalize_date": (text.normalize_date, 1),
    "canonical_text": (text.canonical, 1),
    "fuzzy_equal": (text.fuzzy_equal, 2),
    "similarity": (text.similarity, 2),
    "masked": (text.masked, 1),
    "sanitized": (text.sanitize, 1),
    "script": (text.script, 1),
    "fix_ocr_latin": (text.fix_ocr_latin, 1),
    "clean_numeric_id": (text.clean_numeric_id, 1),
    "without_confusions": (lambda s: phrases.without_confusions(F.col(s) if isinstance(s, str) else s), 1),
    "cleaned_id": (lambda s: repair.bare(F.col(s) if isinstance(s, str) else s), 1),
}
NUMBERS: dict[str, tuple[Callable[..., Column], int]] = {
    "clamped": (numbers.clamp, 1),
    "rounded_half_up": (numbers.half_up, 1),
    "ratio": (numbers.ratio, 2),
    "sigmoid": (numbers.sigmoid, 1),
    "haversine_km": (numbers.haversine_km, 4),
}


def body(spark: SparkSession, function: Callable[..., Column], kind: str, n: int) -> tuple[str, str]:
    """SQL of a column function's expression over x0, x1, ..., and its type.

    An expression with lambdas has no SQL text of its own and raises an error.
    """
    names = [f"x{i}" for i in range(n)]
    one = spark.createDataFrame([], ", ".join(f"{x} {kind}" for x in names)).select(function(*[F.col(x) for x in names]).alias("out"))
    sql = one._jdf.queryExecution().analyzed().expressions().head().child().sql()
    if "lambdafunction(" in sql:
        raise ValueError("an expression with lambdas can't be written as SQL")
    return sql, one.schema["out"].dataType.simpleString()


class LabelledFields:
    """``select * from labelled_fields(table(t), 'key', 'arabic', 'english')``: the fields
    that ``phrases.extracted`` finds in each row.  The key's column keeps its name and type."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, arabic: AnalyzeArgument, english: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(rows.dataType, T.StructType):
            raise ValueError("the first argument is a table")
        for given in (key, arabic, english):
            if given.value not in rows.dataType.names:
                raise ValueError(f"the table has no column {given.value}")
        kept = rows.dataType[key.value]
        texts = [T.StructField(n, T.StringType()) for n in ("field", "value", "label")]
        return AnalyzeResult(T.StructType([T.StructField(key.value, kept.dataType), *texts]))

    def eval(self, row, key: str, arabic: str, english: str) -> Iterator[tuple]:
        for field, value, label in phrases.fields_of(row[arabic], row[english]):
            yield row[key], field, value, label


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Registers all functions for this session and returns their names."""
    done = []

    def sql(name: str, arguments: list[str], kind: str, returns: str, expression: str) -> None:
        given = ", ".join(f"{a} {kind}" for a in arguments)
        spark.sql(f"create or replace temporary function {prefix}{name}({given}) returns {returns} return {expression}")
        done.append(prefix + name)

    for table, kind in ((TEXTS, "string"), (NUMBERS, "double")):
        for name, (function, n) in table.items():
            expression, returns = body(spark, function, kind, n)
            sql(name, [f"x{i}" for i in range(n)], kind, returns, expression)
    for country, rule in checksums.RULES.items():
        parts = checksums.rule_sql(country, "c")
        code = country.lower()
        sql(f"id_text_{code}", ["raw"], "string", "string", checksums.cleaned_sql(rule, "raw"))
        for part, returns in (("valid", "boolean"), ("checksum", "boolean"), ("year", "bigint"), ("month", "bigint"), ("day", "bigint"), ("male", "boolean")):
            sql(f"id_{part}_{code}", ["c"], "string", returns, f"cast({parts[part]} as {returns})")
    for part, other in (("valid", "false"), ("checksum", "false"), ("year", "null"), ("male", "null")):
        arms = " ".join(f"when '{c}' then {prefix}id_{part}_{c.lower()}({prefix}id_text_{c.lower()}(raw))" for c in checksums.RULES)
        returns = "bigint" if part == "year" else "boolean"
        whole = f"case upper(country) {arms} end"
        sql(f"id_{part}", ["country", "raw"], "string", returns, f"coalesce({whole}, false)" if other == "false" else whole)
    for name, function in (("canonical_json", canonical.rewritten()), ("python_json", canonical.rewritten(spaced=True))):
        spark.udf.register(prefix + name, function)
        done.append(prefix + name)
    spark.udtf.register(prefix + "labelled_fields", F.udtf(LabelledFields))
    return [*done, prefix + "labelled_fields"]
