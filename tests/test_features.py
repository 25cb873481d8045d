import math

from kiln.operators import detect as D
from kiln.operators import features as FE


def test_date_parts_and_weekday(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-02-10",), ("2025-03-15",)], "Join_Date string")
    out, rep = FE.engineer_datetime(df)
    r = {x["Join_Date"]: x for x in out.collect()}
    assert r["2024-01-01"]["Join_Date_DayOfWeek"] == 0  # Monday
    assert r["2024-02-10"]["Join_Date_IsWeekend"] == 1
    assert "Join_Date_Hour" not in out.columns


def test_duration_days(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-15"), ("2024-02-01", "2024-02-11")],
                               "Start_Date string, End_Date string")
    out, _ = FE.engineer_datetime(df)
    assert sorted(r["Start_Date_End_Date_Duration_Days"] for r in out.collect()) == [10.0, 14.0]


def test_word_count_blank_is_zero(spark):
    rows = [("a good product review here",)] * 22 + [(None,), ("",), ("   ",)]
    out, _ = FE.engineer_text(spark.createDataFrame(rows, "Review string"))
    counts = sorted(r["Review_WordCount"] for r in out.collect())
    assert counts[:3] == [0, 0, 0] and counts[-1] == 5


def test_log_feature(spark):
    import random
    rnd = random.Random(42)
    rows = [(math.exp(rnd.gauss(10.5, 1.2)),) for _ in range(200)]
    out, rep = FE.engineer_numeric(spark.createDataFrame(rows, "Salary double"))
    assert "Salary_Log" in out.columns


def test_negative_values_skip_log(spark):
    rows = [(float(-i if i < 25 else i * i),) for i in range(100)]
    out, _ = FE.engineer_numeric(spark.createDataFrame(rows, "Balance double"))
    assert "Balance_Log" not in out.columns


def test_sequential_identifier(spark):
    df = spark.createDataFrame([(1001 + i, float(i % 7)) for i in range(100)], "Customer_No long, x double")
    facts = D.column_facts(df)
    assert facts["Customer_No"].sequential and D.feature_type(facts["Customer_No"]) == "identifier"


def test_validation_drops_duplicate_generated(spark):
    df = spark.createDataFrame([(i, i) for i in range(50)], "A int, A_Copy_Gen int")
    out, rep = FE.validate_features(df, ["A"], ["A_Copy_Gen"])
    assert out.columns == ["A"]


def test_range_checks_flag_only(spark):
    from kiln.operators import features as FE2
    df = spark.createDataFrame([(i, i % 14) for i in range(30)], "A int, A_Month int")
    out, rep = FE2.validate_features(df, ["A"], ["A_Month"])
    assert "A_Month" in out.columns
    assert any(i["issue"] == "out_of_range" and i["count"] == 5 for i in rep.issues)  # 0 x3, 13 x2
