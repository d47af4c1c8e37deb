import pytest
from pyspark.sql import functions as F

from hydrosift.functions import wqi as W
from hydrosift.functions.text import dms_to_decimal, short_site
from hydrosift.sources.lookups import dms_to_decimal as dms_py


ROWS = [
    {"ph": 7.9, "turbidity": 3.0, "chloride": 120.0, "sulphate": None, "nitrate": 50.0, "fluoride": 0.8, "iron": 0.9},
    {"ph": None, "turbidity": None, "chloride": None, "sulphate": None, "nitrate": None, "fluoride": None,
     "iron": None},
    {"ph": 6.2, "turbidity": 12.0, "chloride": 300.0, "sulphate": 90.0, "nitrate": 3.0, "fluoride": None, "iron": 0.0},
]


def test_bis_wqi_matches_row_formula(spark):
    df = spark.createDataFrame(ROWS, ",".join(f"{k} double" for k in ROWS[0]))
    got = df.select(W.bis_wqi({p: p for p in ROWS[0]}, missing="skip").alias("w")).collect()
    # worked out by hand from the published weights and limits
    assert got[0].w == pytest.approx(243.3948736673093, rel=1e-12)
    assert got[1].w is None
    assert got[2].w == pytest.approx(14.97138091662717, rel=1e-12)


def test_nsf_wqi_matches_row_formula(spark):
    rows = [{"pH": 8.4, "DO": 9.6, "BOD": 1.3, "Turbidity": 2.1666666666666665, "Nitrate": 50.0},
            {"pH": None, "DO": 3.0, "BOD": None, "Turbidity": None, "Nitrate": None},
            {"pH": None, "DO": None, "BOD": None, "Turbidity": None, "Nitrate": None}]
    df = spark.createDataFrame(rows, ",".join(f"`{k}` double" for k in rows[0]))
    got = df.select(W.nsf_wqi({p: p for p in rows[0]}, missing="skip").alias("w")).collect()
    assert got[0].w == pytest.approx(49.99999999999999, rel=1e-12)
    assert got[1].w == pytest.approx(99.99999999999999, rel=1e-12) and got[2].w is None
    # the boundary row of the study's surface formula stays just under 50 (class Poor)
    assert got[0].w < 50


def test_an_unmapped_parameter_is_an_error():
    with pytest.raises(ValueError):
        W.bis_wqi({"ph": "ph"})
    with pytest.raises(ValueError):
        W.nsf_wqi({"pH": "ph"})


def test_classes_and_rules(spark):
    vals = [None, 0.0, 50.0, 50.01, 100.0, 150.5, 200.0, 200.5, 300.0, 301.0]
    df = spark.createDataFrame([(v,) for v in vals], "w double")
    out = df.select("w", W.wqi_class_gw("w").alias("c"), W.wqi_class_gw4("w").alias("c4"),
                    W.risk_gw("w").alias("r"), W.alert_gw("w").alias("a"),
                    W.wqi_class_gw("w", "fallback").alias("cf"), W.alert_gw("w", "fallback").alias("af")).collect()
    m = {r.w: r for r in out}
    assert m[None].c is None and m[None].r is None and m[None].a is None
    assert m[None].cf == "Unsuitable" and m[None].af is False
    assert [m[v].c for v in vals[1:]] == ["Excellent", "Excellent", "Good", "Good", "Poor", "Poor", "Very Poor",
                                          "Very Poor", "Unsuitable"]
    assert m[301.0].c4 == "Very Poor" and m[150.5].r == "Moderate" and m[301.0].r == "High"
    assert m[200.5].a is True and m[200.0].a is False


def test_surface_rules(spark):
    df = spark.createDataFrame([(v,) for v in [95.0, 70.0, 55.0, 30.0, 10.0]], "w double")
    out = df.select(W.wqi_class_sw("w").alias("c"), W.risk_sw("w").alias("r"), W.alert_sw("w").alias("a"),
                    W.hotspot("w").alias("h"), W.priority_sw("w").alias("p")).collect()
    assert [r.c for r in out] == ["Excellent", "Good", "Medium", "Poor", "Very Poor"]
    assert [r.r for r in out] == ["Low", "Low", "Low", "Moderate", "High"]
    assert [r.a for r in out] == ["NORMAL", "NORMAL", "NORMAL", "WARNING", "CRITICAL"]
    assert [r.h for r in out] == [False, False, False, True, True]
    assert out[0].p == pytest.approx(5.0)


def test_text_helpers(spark):
    df = spark.createDataFrame([("Karan Lake (Site 1) (Ground Water)", 29, 44, 62, "N"),
                                ("Agra Canal(Site 1) (Surface Water)", 77, 17, 60, "W")],
                               "s string, d int, m int, sec int, dir string")
    out = df.select(short_site("s").alias("a"), short_site("s", 3).alias("b"),
                    dms_to_decimal("d", "m", "sec", "dir").alias("c")).collect()
    assert [r.a for r in out] == ["Karan", "Agra"] and out[0].b == "Kar"
    assert out[0].c == dms_py(29, 44, 62, "N") and out[1].c == dms_py(77, 17, 60, "W") < 0
    assert W is not None and F is not None
