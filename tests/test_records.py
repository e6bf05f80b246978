"""Records case by case, with results worked out by hand."""

from datetime import datetime

from pyspark.sql import functions as F

from attestry.operators import records


def test_egyptian_record(spark):
    ids = ["29501010100001", "٢٩٥٠١٠١٠١٠٠٠٠١", "49501010100001", "2950101", "", None]
    rows = spark.createDataFrame(list(enumerate(ids)), "i int, raw string").select("i", records.egyptian_record("raw").alias("r"))
    got = {x.i: x.r for x in rows.collect()}
    # 2*2 + 9*7 + 5*6 + 1*4 + 1*2 + 1*6 = 109, 109 % 11 = 10, so the check digit is 1.
    assert got[0].birth_date == "1995-01-01" and got[0].is_valid and got[0].gender == "Female" and got[0].governorate == 1
    assert got[1] == got[0]
    assert got[2].year is None and got[2].is_valid is False
    assert got[3] is None and got[4] is None and got[5] is None


def test_top_contributor(spark):
    of = "array<struct<modality:string,score:double,weight:double>>"
    rows = spark.createDataFrame([([("a", 0.5, 0.4), ("b", 0.4, 0.5), ("c", 0.1, 0.9)],), ([],)], f"s {of}")
    assert [r.m for r in rows.select(records.top_contributor("s")["modality"].alias("m")).collect()] == ["a", None]


def test_corrected_names(spark):
    latin = spark.createDataFrame([("omar",), ("hassan",)], "e string")
    rows = spark.createDataFrame([(1, " omer  hassan "), (2, "o hasxxn"), (3, None), (4, " "), (5, "omar omar")], "k int, name string")
    got = {r.k: (r.corrected, r.changed) for r in records.corrected_names(rows, "k", "name", latin, "e").collect()}
    assert got == {1: ("omar hassan", True), 2: ("o hasxxn", False), 3: (None, False), 4: (" ", False), 5: ("omar omar", False)}
    arabic = spark.createDataFrame([("أحمد",), ("محمد",)], "e string")
    rows = spark.createDataFrame([(1, "آحمد مخمد")], "k int, name string")
    assert records.corrected_names(rows, "k", "name", arabic, "e", arabic=True).first().corrected == "أحمد محمد"


def test_without_label(spark):
    rows = spark.createDataFrame([("National ID: 295",), ("الاسم： محمد",), ("295",), (None,)], "v string")
    assert [r.v for r in rows.select(records.without_label("v", ["National ID", "الاسم"]).alias("v")).collect()] == ["295", "محمد", "295", None]


def test_graph_of(spark):
    at = datetime(2024, 1, 1)
    later = datetime(2024, 2, 1)
    columns = "id long, user_id long, name_en string, name_ar string, national_id string, doc_type string, document_no string, country string, created_at timestamp, updated_at timestamp"
    rows = [(2, 7, "A B", "x", "12345678901234", "id", "D2", "EG", later, later), (1, 7, "A B", "y", "12345678901234", "id", "D1", "EG", at, later), (3, 7, None, None, None, None, None, None, at, at)]
    nodes, edges = records.graph_of(spark.createDataFrame(rows, columns))
    people = {r.id: r for r in nodes.where("type = 'person'").collect()}
    assert set(people) == {"person:A B|12345678901234", "person:unknown|7"}
    first = people["person:A B|12345678901234"]
    assert first.attributes == {"full_name_en": "A B", "full_name_ar": "y", "national_id": "1234****1234"} and first.first_seen == at
    assert {(r.src, r.dst) for r in edges.collect()} == {("doc:1", first.id), ("doc:2", first.id), ("doc:3", "person:unknown|7")}


def test_face_quality(spark):
    q = records.face_quality(**{n: F.lit(0.5) for n in records.FACE_QUALITY})
    assert spark.range(1).select(q.alias("q")).first().q == (0.5, 0.5, True)
    half = records.face_quality(sharpness=F.lit(1.0))
    assert spark.range(1).select(half.alias("q")).first().q == (0.18, 0.3, False)


def test_reasons(spark):
    factor = "struct<factor:string,weight:double,value:double,contribution:double>"
    rows = spark.createDataFrame([({"ocr": 0.5}, (0.7, "review", ["DOC_PASS", "REVIEW_NEEDED"], [("ocr", 0.02, 0.5, 0.01)]))], f"s map<string,double>, r struct<score:double,decision:string,codes:array<string>,factors:array<{factor}>>")
    lines = rows.select(records.reasons(F.col("s"), F.col("r")).alias("t")).first().t.split("\n")
    assert lines == ["1. Signals", "  ocr = 0.5000", "2. Weights", "  ocr: 0.02", "3. Contributions", "  ocr: 0.5000 x 0.02 = 0.0100", "4. Thresholds: approve 0.80, review 0.60; score 0.7000 lies in review", "5. Decision: REVIEW", "  [POSITIVE] DOC_PASS", "  [WARNING] REVIEW_NEEDED"]
