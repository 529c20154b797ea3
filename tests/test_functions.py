"""Rules on tiny literal tables, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pairloom.functions import arrays as A
from pairloom.functions import dates as D
from pairloom.functions import outcomes as O
from pairloom.functions import text as T
from pairloom.operators import trials as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def nullable(value, kind):
    return F.lit(value).cast(kind)


@pytest.mark.parametrize("text, value", [
    ("<0.001", 0.001), ("p = 0.03", 0.03), ("1E-5", 15.0), ("1.2e-4", 1.24), ("NS", None), ("1.2.3", None),
])
def test_p_value_keeps_digits(spark, text, value):
    assert one(spark, T.p_value(F.lit(text))) == value


def test_p_value_scientific(spark):
    assert one(spark, T.p_value(F.lit("1.2e-4"), "scientific")) == pytest.approx(1.2e-4)
    assert one(spark, T.p_value(F.lit("p<0.001"), "scientific")) == 0.001
    with pytest.raises(ValueError):
        T.p_value(F.lit("x"), "other")


@pytest.mark.parametrize("values, outcome", [
    ([0.05], "success"), ([0.001, 0.09], "success"), ([0.03, 0.15], "success"), ([0.06, 0.08], "unknown"), ([0.2], "unknown"),
    ([0.01, 0.3, 0.4], "unknown"), ([0.3], "fail"), ([0.3, 0.4], "fail"), ([15.0], "fail"), ([0.01, 0.6], None), ([0.01, 1.5], None),
    ([0.6, 0.7, 0.04, 0.01], None), ([], None), (None, None),
])
def test_outcome(spark, values, outcome):
    df = spark.createDataFrame([(values,)], "p array<double>")
    assert R.with_outcome(df, "p").first()["success"] == outcome


@pytest.mark.parametrize("max_phase, tags, last, label", [
    ("4.0", None, "2021", True), ("4.0", [("fail2", 1)], "0000", True), ("3.0", [("success3", 1)], "2021-01", True),
    ("3.0", [("success3", 1), ("fail3", 1), ("success2", 1)], "2019-05", False),
    ("3.0", [("success3", 1), ("fail3", 1), ("success2", 1)], "2021-01", None),
    ("2.0", [("fail2", 1)], "2021-01", False), ("2.0", [("success2", 1)], "2021-01", None), ("3.0", [("unknown3", 1)], "2021-01", None),
    ("2.0", [("successNone", 1)], "2021-01", None), ("2.0", [], "0000", False), ("2.0", None, "0000", False), (None, None, "2020", None),
    ("3.0", [("success3", 5), ("fail3", 2)], "2021", True), ("3.0", [("success3", 4), ("fail3", 2)], "2021", None),
])
def test_pair_label(spark, max_phase, tags, last, label):
    def entry(tag, n):
        digit = tag[-1]
        return (tag, n, tag.removesuffix("None").rstrip("0123456789"), int(digit) if digit.isdigit() else None)

    rows = None if tags is None else [entry(*t) for t in tags]
    df = spark.createDataFrame(
        [(max_phase, rows, last)],
        "max_phase_for_ind string, evidence array<struct<tag:string,n:int,outcome:string,phase:int>>, last_date string",
    )
    assert R.label_pairs(df).first()["overall_success"] == label


@pytest.mark.parametrize("codes, phase", [(["PHASE2", "PHASE3"], 3), (["EARLY_PHASE1"], 1), (["NA"], None), (None, None)])
def test_highest_code(spark, codes, phase):
    assert spark.createDataFrame([(codes,)], "c array<string>").select(A.highest_code("c")).first()[0] == phase


STATUS = '{"statusVerifiedDate":"2015-03","startDateStruct":{"date":"2009-11"},"lastUpdatePostDateStruct":{"date":"2015-04-02","type":"X"},"overallStatus":"COMPLETED"}'


@pytest.mark.parametrize("status, first, last", [
    (STATUS, "2009-11", "2015-04-02"), ('{"overallStatus":"X"}', "9999", "0000"), ('{"startDateStruct":{"type":"X"}}', "9999", "0000"), (None, "9999", "0000"),
])
def test_status_dates(spark, status, first, last):
    dates = D.dates_among(D.open_fields(nullable(status, "string")))
    assert (one(spark, D.earliest_date(dates)), one(spark, D.latest_date(dates))) == (first, last)


@pytest.mark.parametrize("first, year, out", [("9999", 1998.0, "1998"), ("9999", None, "0000"), ("2004-05", 1998.0, "2004-05")])
def test_first_date(spark, first, year, out):
    assert one(spark, D.first_date_or(F.lit(first), D.year_text(nullable(year, "double")))) == out


@pytest.mark.parametrize("date, year", [("2004", 2004), ("2004-05", 2004), ("2004-05-06", 2004), ("9999", None), ("soon", None), (None, None)])
def test_date_year(spark, date, year):
    assert one(spark, D.date_year(nullable(date, "string"))) == year


@pytest.mark.parametrize("date, kept", [("1990", False), ("1990-01", True), ("2019-12-31", True), ("2020", False), ("9999", False), (None, False)])
def test_date_range(spark, date, kept):
    assert one(spark, D.in_date_range(nullable(date, "string"), "1990", "2020")) is kept
    assert one(spark, D.in_date_range(F.lit("9999"), "1990", "2020", keep_missing=True)) is True


def test_references(spark):
    refs = [("ClinicalTrials", "A,B"), ("FDA", "x"), ("ClinicalTrials", "C")]
    df = spark.createDataFrame([(refs,), ([("FDA", "x")],)], "refs array<struct<ref_type:string,ref_id:string>>")
    rows = df.select(A.last_reference("refs", "ClinicalTrials").alias("l"), A.all_references("refs", "ClinicalTrials").alias("a")).collect()
    assert [tuple(r) for r in rows] == [(["C"], ["A", "B", "C"]), (None, [])]


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["b", "c"]), ([], []), (None, ["a"])], "a array<string>, b array<string>")
    rows = df.select(A.jaccard("a", "b"), A.shared_count("a", "b")).collect()
    assert [tuple(r) for r in rows] == [(pytest.approx(1 / 3), 1), (0.0, 0), (0.0, 0)]
    back = df.select(A.jaccard("b", "a")).collect()
    assert [r[0] for r in back] == [r[0] for r in rows]


def test_text_helpers(spark):
    assert one(spark, T.last_part(F.lit("http://x/y/D01"), "/")) == "D01"
    assert one(spark, T.last_word(F.lit("MeSH Unique ID:  D001 "))) == "D001"
    assert one(spark, T.path_depth(F.lit("C20.111.197"))) == 3
    assert one(spark, T.outcome_tag(F.lit("success"), nullable(None, "int"))) == "successNone"
    assert one(spark, T.tag_phase(F.lit("successNone"))) is None
    assert one(spark, T.tag_outcome(F.lit("success3"))) == "success"
    assert one(spark, T.cropped(F.lit("abcdef"), 3)) == "abc..."
    assert one(spark, T.recoded(F.lit(-1), T.CHIRALITY_NAMES)) is None
    assert one(spark, T.flag_number(F.lit("Y"))) == 1
    assert one(spark, T.to_number(F.lit("NS"))) is None
    assert one(spark, T.is_top_category(F.lit("C20.1"), "C")) is False


def test_case_tags(spark):
    rows = spark.createDataFrame([(1, 1), (0, 0), (0, 1), (1, 0)], "y int, z int").select(O.case_tag("y", "z")).collect()
    assert [r[0] for r in rows] == ["TP", "TN", "FP", "FN"]


def test_median_of(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([4.0, 1.0],), ([],), (None,)], "p array<double>")
    assert [r[0] for r in df.select(A.median_of("p")).collect()] == [2.0, 2.5, None, None]
