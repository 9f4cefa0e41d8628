"""Specified error behaviours."""

import pytest

from altscore.operators import explain as X
from altscore.sources import io as IO


def test_unknown_sink_format_raises(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(ValueError):
        IO.write(df, str(tmp_path / "out"), "xml")


def test_detect_input_kind(spark):
    nested = spark.createDataFrame([(1, [1, 2])], "applicant_id long, sms_transactions array<int>")
    assert IO.detect_input_kind(nested) == "applications"
    assert IO.detect_input_kind(spark.range(1)) == "features"


def test_dependence_unknown_feature_raises(spark):
    df = spark.createDataFrame([(1, "income_score", 1.0, 0.1, 0.5)],
                               "applicant_id long, feature string, value double, shap double, base_value double")
    with pytest.raises(ValueError):
        X.dependence_points(df, "no_such_feature")
