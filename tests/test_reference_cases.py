"""Cases modelled on the reference's own tests, as small frames."""

import math

from kiln.operators import detect as D
from kiln.operators import features as FE
from kiln.operators import impute as I
from kiln.operators import opportunity as OP
from kiln.operators import quality as Q


def test_five_cities_distribution(spark):
    rows = ([("A",)] * 21 + [("B",)] * 20 + [("C",)] * 20 + [("D",)] * 19 + [("E",)] * 20 + [(None,)] * 5)
    df = spark.createDataFrame([(i, c) for i, (c,) in enumerate(rows)], "id long, City string")
    out, log = I.impute_missing(df, key="id")
    assert log[0].details["method"] == "distribution_based"
    assert out.where("City IS NULL").count() == 0


def test_balanced_gender_distribution(spark):
    rows = [("Male",)] * 51 + [("Female",)] * 49 + [(None,)] * 10
    df = spark.createDataFrame([(i, g) for i, (g,) in enumerate(rows)], "id long, Gender string")
    a, log = I.impute_missing(df, key="id")
    b, _ = I.impute_missing(df, key="id")
    assert log[0].details["method"] == "distribution_based"
    assert sorted(a.collect()) == sorted(b.collect())  # reproducible


def test_copied_column_not_a_grouping_feature(spark):
    rows = []
    for i in range(30):
        city = "Paris" if i % 2 else "Lyon"
        gender = None if i % 10 == 0 else ("F" if (i % 2) else "M")
        rows.append((city, city, gender))
    df = spark.createDataFrame(rows, "City string, City_Copy string, Gender string")
    _, log = I.impute_missing(df)
    entry = [e for e in log if e.column == "Gender"][0]
    assert "City_Copy" not in entry.details["grouping_features"].split(",")


def test_duplicate_columns_shifted_nulls_and_keep_first(spark):
    df = spark.createDataFrame([(1, None, 1), (None, 1, None), (2, 2, 2)], "A int, B int, C int")
    assert Q.duplicate_column_map(df) == {"C": "A"}


def test_numeric_detection(spark):
    df = spark.createDataFrame([(25, 50000), (32, 64000), (47, 81000), (51, 72000), (38, 58000)], "Age int, Salary int")
    facts = D.column_facts(df)
    assert D.feature_type(facts["Age"]) == "numerical" and D.feature_type(facts["Salary"]) == "numerical"


def test_review_text_detection(spark):
    reviews = [("This product exceeded my expectations in every possible way, truly great.",),
               ("Terrible experience, the item arrived broken and support never answered.",),
               ("Decent value for the price although the packaging could be much better.",),
               ("I would buy this again, it works exactly as described on the website.",),
               ("Not worth it at all, it stopped working after only two days of use.",)]
    f = D.column_facts(spark.createDataFrame(reviews, "Review string"))["Review"]
    assert D.feature_type(f) == "text" and D.text_kind(f) == "reviews"


def test_near_constant(spark):
    df = spark.createDataFrame([("A", "X")] * 99 + [("B", "X")], "Near_Constant string, Constant_Column string")
    facts = D.column_facts(df)
    assert D.feature_type(facts["Near_Constant"]) == "constant / near-constant"
    assert D.feature_type(facts["Constant_Column"]) == "constant / near-constant"


def test_lognormal_salary_advice(spark):
    import random
    rnd = random.Random(7)
    df = spark.createDataFrame([(math.exp(rnd.gauss(10.5, 1.2)),) for _ in range(200)], "Salary double")
    rep = {r["columns"]: r for r in OP.opportunity_report(df).collect() if r["kind"] == "column"}
    assert rep["Salary"]["opportunity"] == "Possible log / skewness transformation"


def test_same_year_skips_year(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-03-10",), ("2024-07-21",)], "Join_Date string")
    out, rep = FE.engineer_datetime(df)
    assert "Join_Date_Year" not in out.columns and "Join_Date_Month" in out.columns


def test_weekdays_only_skips_weekend(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-03",)], "Join_Date string")
    out, _ = FE.engineer_datetime(df)
    assert "Join_Date_IsWeekend" not in out.columns and "Join_Date_DayOfWeek" in out.columns


def test_invalid_date_text_counted(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-02-10",), ("not a date",), ("2024-03-15",)], "Join_Date string")
    out, rep = FE.engineer_datetime(df)
    assert any(i["issue"] == "invalid_datetime" and i["count"] == 1 for i in rep.issues)
    assert out.count() == 4


def test_midnight_only_no_hour(spark):
    df = spark.createDataFrame([("2024-01-05 00:00:00",), ("2024-02-10 00:00:00",)], "Event_Time string")
    out, _ = FE.engineer_datetime(df)
    assert "Event_Time_Hour" not in out.columns


def test_time_components(spark):
    df = spark.createDataFrame([("2024-01-05 08:15:00",), ("2024-02-10 17:45:00",), ("2024-03-11 12:30:00",)],
                               "Event_Time string")
    out, _ = FE.engineer_datetime(df)
    assert {"Event_Time_Hour", "Event_Time_Minute"} <= set(out.columns)
    assert "Event_Time_Second" not in out.columns


def test_infinite_ratio_handled(spark):
    df = spark.createDataFrame([(1, float("inf")), (2, 3.0)] + [(i, float(i)) for i in range(3, 50)],
                               "A int, Bad_Ratio double")
    out, rep = FE.validate_features(df, ["A"], ["Bad_Ratio"])
    assert out.where("Bad_Ratio IS NULL").count() == 1


def test_selected_empty_is_pass_through(spark):
    df = spark.createDataFrame([("2024-01-05", 1.0)], "Join_Date string, x double")
    out, rep = FE.engineer(df, selected=[])
    assert out.columns == df.columns and not rep.generated


def test_selected_subset_only(spark):
    rows = [("2024-%02d-%02d" % (1 + i % 12, 1 + i % 28), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "Join_Date string, x double")
    out, rep = FE.engineer(df, selected=["Join_Date_Month"])
    assert [c for c in out.columns if c not in df.columns] == ["Join_Date_Month"]
