"""Hand-made frames at the edges of the rules."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tabloom.functions import kinds, scalars
from tabloom.operators import correlation, encoders, profile, quantiles, tally, temporal
from tabloom.plans import ask, heuristics, quality
from tabloom.sources import readers


def one(df):
    return df.first().asDict()


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, x double, s string, t timestamp")
    assert one(profile.shape(df))["n_rows"] == 0
    assert profile.missing(df).count() == 0
    assert one(profile.missing_totals(df)) == {"total_missing": 0, "complete_rows": 0}
    assert one(profile.duplicate_count(df))["n_duplicates"] == 0
    assert profile.outliers(df).count() == 0
    assert one(profile.describe_numeric(df).filter("column = 'x'"))["mean"] is None
    assert temporal.temporal_summary(df).count() == 0
    assert profile.histograms(df).count() == 0
    assert profile.categorical_summary(df).count() == 0
    assert heuristics.id_reasons(df) == {}
    assert one(quality.quality_score(df))["score"] == 100
    assert one(quality.insights(df))["code"] == "clean"
    assert [c.n_unique for c in tally.collect_tally(df).columns] == [0, 0, 0, 0]


def test_nan_and_null_are_both_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert one(profile.missing(df)) == {"position": 0, "column": "x", "n_missing": 2, "ratio": 0.5}
    assert one(profile.describe_numeric(df))["mean"] == 2.0
    assert one(tally.tally_frame(df))["n_unique"] == 2
    assert one(profile.missing_totals(df))["complete_rows"] == 2
    assert one(profile.duplicate_count(df))["n_duplicates"] == 1
    assert rows(profile.class_balance(df, "x"), "n") == [(1,), (1,), (2,)]


def test_constant_and_all_missing_columns(spark):
    df = spark.createDataFrame([(7.0, None, float(i)) for i in range(30)], "c double, m double, x double")
    pairs = {(r.a, r.b): r["corr"] for r in correlation.correlations(df).collect()}
    assert pairs[("c", "x")] is None and pairs[("m", "x")] is None
    pairs = {(r.a, r.b): r["corr"] for r in correlation.correlations(df, wide_above=0).collect()}
    assert pairs[("c", "x")] is None and pairs[("m", "x")] is None
    plan = heuristics.suggest_plan(df)
    assert plan.drop == {"x": "numeric_unique", "c": "constant", "m": "constant"}
    assert profile.constant_columns(tally.collect_tally(df)) == ["c", "m"]
    described = {r["column"]: r for r in profile.describe_numeric(df).collect()}
    assert described["m"]["q50"] is None and described["m"]["count"] == 0
    assert encoders.scaler_values(df, ["c", "m"]) == {"c": (7.0, 1.0), "m": (0.0, 1.0)}


def test_identifier_rules(spark):
    hashes = [("%032x" % (i * 7919), "%06x" % i, f"word {i}", i % 3, i * 1.5) for i in range(300)]
    df = spark.createDataFrame(hashes, "digest string, short string, phrase string, user_id int, amount double")
    found = heuristics.id_reasons(df)
    assert found == {"digest": "hash_like", "amount": "numeric_unique"}
    for name in ("id", "user_id", "ID", "uuid", "orderid", "rownum", "my_id_col", "Invoice_ID"):
        assert heuristics.looks_like_id(name), name
    for name in ("width", "idea", "price", "", "  ", "keyboard"):
        assert not heuristics.looks_like_id(name), name
    nearly = spark.createDataFrame([(min(i, 98),) for i in range(100)], "user_id int")
    assert list(heuristics.id_reasons(nearly).values()) == ["name_and_unique"]


def test_duplicates_treat_null_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, None), (1, None)], "a int, b string")
    assert one(profile.duplicate_count(df))["n_duplicates"] == 2
    unique = spark.range(50).withColumn("x", F.lit(1))
    known = tally.collect_tally(unique)
    assert one(profile.duplicate_count(unique, known))["n_duplicates"] == 0


def test_ties_are_broken_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "bbaaccd"], "s string")
    top = profile.categorical_summary(df, k=3).orderBy("rank").collect()
    assert [(r.value, r.n) for r in top] == [("a", 2), ("b", 2), ("c", 2)]
    assert encoders.mode_values(df, ["s"]) == {"s": "a"}


def test_unseen_categories(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("b", 1.0)], "s string, y double")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "s string")
    levels, shared = encoders.onehot_levels(train, "s")
    assert (levels, shared) == (["a", "b"], False)
    hot = {r.s: (r.s_a, r.s_b) for r in encoders.onehot(test, "s", levels).collect()}
    assert hot == {"a": (1.0, 0.0), "z": (0.0, 0.0), None: (0.0, 0.0)}
    codes = {r.s: r.s_code for r in encoders.ordinal(test, "s", encoders.ordinal_table(train, "s")).collect()}
    assert codes == {"a": 0.0, "z": -1.0, None: -1.0}
    means = encoders.target_mean_table(train, "s", "y", smoothing=0.0)
    coded = {r.s: r.s_mean for r in encoders.target_encode(test, "s", means, 0.25).collect()}
    assert coded == {"a": 1.0, "z": 0.25, None: 0.25}


def test_rare_categories_share_one_output(spark):
    data = [(f"c{i:02d}",) for i in range(25) for _ in range(1 + (i >= 10))]
    levels, shared = encoders.onehot_levels(spark.createDataFrame(data, "s string"), "s", 20)
    # Fifteen frequent ones, and of the rare ones the four with the largest names.
    assert shared and levels == [f"c{i:02d}" for i in range(6, 25)]


def test_zero_divisor_and_broken_dates(spark):
    df = spark.createDataFrame([(1.0, 0.0, "2024-02-30"), (1.0, 4.0, "2024-03-02")], "a double, b double, d string")
    out = df.select(
        scalars.safe_ratio(F.col("a"), F.col("b")).alias("r"),
        scalars.zero_to_null(F.col("b")).alias("z"),
        *scalars.date_parts(scalars.lenient_timestamp(F.col("d")), "d"),
    ).collect()
    assert (out[0].r, out[0].z, out[0].d_year, out[0].d_is_weekend) == (None, None, None, 0)
    assert (out[1].r, out[1].d_dow, out[1].d_is_weekend) == (0.25, 5, 1)


def test_regular_steps(spark):
    start = dt.datetime(2024, 1, 1)
    hourly = spark.createDataFrame([(start + dt.timedelta(hours=i),) for i in range(50)], "t timestamp")
    got = one(temporal.temporal_summary(hourly))
    assert got["median_step_s"] == 3600.0 and got["is_regular"] and got["range_s"] == 49 * 3600.0
    single = spark.createDataFrame([(start,)], "t timestamp")
    got = one(temporal.temporal_summary(single))
    assert got["median_step_s"] is None and not got["is_regular"]
    same = spark.createDataFrame([(start,)] * 5, "t timestamp")
    got = one(temporal.temporal_summary(same))
    assert got["median_step_s"] == 0.0 and got["is_regular"]


def test_booleans_plan_as_numbers_but_are_not_described(spark):
    df = spark.createDataFrame([(i % 2 == 0, float(i % 7)) for i in range(40)], "flag boolean, x double")
    assert [r["column"] for r in profile.describe_numeric(df).collect()] == ["x"]
    assert heuristics.suggest_plan(df, "x").encoders == {"flag": "passthrough"}
    assert heuristics.detect_problem_type(df, "flag") is heuristics.ProblemType.CLASSIFICATION
    assert kinds.plan_numeric_columns(df) == ["flag", "x"]


def test_wide_table_gets_the_variance_rule(spark):
    df = spark.range(600).select(
        *[((F.col("id") * (i + 3)) % (11 + i)).cast("double").alias(f"c{i}") for i in range(60)]
    )
    plan = heuristics.suggest_plan(df)
    assert plan.reduction == "variance" and plan.ratios
    pairs = correlation.correlations(df)
    assert pairs.count() == 60 * 59 // 2
    pandas = df.toPandas().corr()
    for r in pairs.limit(200).collect():
        assert math.isclose(r["corr"], pandas.loc[r.a, r.b], abs_tol=1e-9)


def test_problem_types(spark):
    df = spark.createDataFrame(
        [(i, float(i) / 3, f"k{i % 4}", dt.datetime(2024, 1, 1)) for i in range(100)],
        "n int, x double, s string, t timestamp",
    )
    detect = heuristics.detect_problem_type
    assert detect(df, "s").value == "classification"
    assert detect(df, "x").value == "regression"
    assert detect(df, None).value == "time_series"
    assert detect(df.drop("t"), "absent").value == "clustering"


def test_target_scores(spark):
    df = spark.createDataFrame(
        [(i % 3, float(i), f"w{i}", None if i < 70 else 1) for i in range(100)],
        "class int, x double, word string, gone int",
    )
    found = {s.column: s for s in heuristics.rank_targets(df)}
    assert "gone" not in found and "word" not in {k for k, v in found.items() if v.score > 0.05}
    assert found["class"].score == 0.6 and found["class"].problem_type.value == "classification"
    assert found["x"].score == 0.19
    chosen = heuristics.rank_targets(df, "x")
    assert [(s.column, s.score) for s in chosen] == [("x", 1.0)]


def test_imbalance_costs_points(spark):
    df = spark.createDataFrame([("a" if i % 20 else "b", i % 4) for i in range(200)], "y string, x int")
    lost = {r.code: r.points for r in quality.quality_breakdown(df, "y").collect()}
    assert lost["imbalance"] == 5 and lost["duplicates"] == 10
    assert "imbalance" in [r.code for r in quality.insights(df, "y").collect()]


def test_questions(spark):
    topics = {
        "": "empty",
        "Combien de lignes ?": "rows",
        "Quelles variables sont manquantes ?": "columns",
        "doublons": "duplicates",
        "corrélation": "correlations",
        "Quel est le meilleur modèle ?": "best_model",
        "supprimer une colonne": "drop_columns",
        "supprimer": "unknown",
        "Quelle influence ?": "importance",
    }
    for question, topic in topics.items():
        assert ask.topic_of(question) == topic
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "x int, s string")
    assert rows(ask.ask(df, "combien de colonnes"), "item", "value") == [("columns", 2.0), ("numeric", 1.0)]
    assert rows(ask.ask(df, "supprimer quelle colonne"), "item", "value") == [("s", 0.6667)]
    assert ask.ask(df, "Quelle influence ?").count() == 0
    importance = spark.createDataFrame([("x", 0.7), ("s", 0.9)], "feature string, importance double")
    assert ask.ask(df, "important", importance=importance).first().item == "s"
    board = spark.createDataFrame([(1, "best", 0.9), (2, "next", 0.8)], "rank int, name string, score double")
    assert ask.ask(df, "best model", board=board).first().item == "best"


def test_records_and_formats(spark, tmp_path):
    got = readers.from_records(spark, [{"a": 1, "b": "x"}, {"a": 2}])
    assert rows(got.na.fill("-"), "a", "b") == [(1, "x"), (2, "-")]
    assert readers.from_records(spark, {"a": 1}).count() == 1
    with pytest.raises(ValueError):
        readers.read_table(spark, "table.docx")
    path = tmp_path / "data.JSON"
    path.write_text('[{"a": 1}, {"a": 2}]')
    assert readers.read_table(spark, str(path)).count() == 2


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "p"), (None, "q"), (4.0, "q")], "`a.b` double, `c d` string")
    assert one(profile.missing(df))["column"] == "a.b"
    assert profile.describe_numeric(df).count() == 1
    assert profile.column_info(df).count() == 2
    assert one(profile.class_balance_summary(df, "c d"))["n_classes"] == 2
    assert encoders.impute(df, encoders.median_values(df, ["a.b"])).filter("`a.b` is null").count() == 0


def test_quantile_paths_agree(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 1.25).otherwise(F.pow(F.col("id") % 977, 2.0)).alias("x"),
        F.when(F.col("id") % 4 > 0, F.col("id").cast("double")).alias("gappy"),
    )
    shares = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    at = F.array(*[F.lit(x) for x in shares])
    direct = {c: df.agg(F.percentile(c, at)).first()[0] for c in ("x", "gappy")}
    values = {c: F.col(c) for c in ("x", "gappy")}
    for rank_rows, bins in ((20, 4), (200, 64), (10**6, 8)):
        narrowed = quantiles.narrow_quantiles(df, values, shares, rank_rows, bins)
        for c in direct:
            assert direct[c] == pytest.approx(narrowed[c])


def test_quantiles_of_extreme_values(spark):
    values = [float("inf"), float("-inf"), 1.7e308, -1.7e308, 5e-324, 0.0, 1.0, 2.0, 3.0, 1e300] * 3
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quantiles.order_statistics(df, {"x": F.col("x")}, {"x": range(30)}, rank_rows=2, bins=3)["x"]
    assert [got[i] for i in range(30)] == sorted(values)
