"""Composed flows over the readings view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrosift.functions import wqi as W
from hydrosift.operators import rank, stats
from hydrosift.sources import views

WORSE = {"ground": "high", "surface": "low"}


def with_index(df: DataFrame, null_mode: str = "null") -> DataFrame:
    """Add ``wqi`` and ``wqi_class``: the ground-water index and class on ground
    rows, the NSF-style index and class on surface rows."""
    gw = F.col("water_type") == "ground"
    idx = F.when(gw, W.bis_wqi(views.GW_PARAM_MAP, missing="skip")).otherwise(W.nsf_wqi(views.SW_PARAM_MAP, missing="skip"))
    df = df.withColumn("wqi", idx)
    cls = F.when(gw, W.wqi_class_gw("wqi", null_mode)).otherwise(W.wqi_class_sw("wqi", null_mode))
    return df.withColumn("wqi_class", cls)


def scored_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_index(views.readings(spark, sf_dir))


def site_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.site_profile(scored_readings(spark, sf_dir), group_cols=["water_type"])


def site_ranking(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """Flagship: readings -> index -> class -> site profile -> ranking with flags."""
    prof = site_profiles(spark, sf_dir)
    return rank.site_ranking(prof, "water_type", "wqi_mean", "site", n, WORSE, group_domain=2)


# ------------------------------------------------------------ cleaning chain

ID_COLS = ["site", "year", "l_orderkey", "l_linenumber"]


def clean_stage1(raw: DataFrame, tokens=None, frac: float | None = None) -> DataFrame:
    """Names, keys, censoring tokens, numeric typing, sparse rows."""
    from hydrosift.operators import clean as C
    from hydrosift.sources.lookups import GW_CENSOR_TOKENS, SPARSE_ROW_FRACTION
    tokens = GW_CENSOR_TOKENS if tokens is None else tokens
    frac = SPARSE_ROW_FRACTION if frac is None else frac
    df = C.normalize_names(raw, "snake")
    df = C.require_columns(df, ["site", "year"])
    df = C.drop_all_null_rows(df)
    df = C.int_key(df, "year")
    df = C.trim_key(df, "site")
    num = [c for c in df.columns if c not in ID_COLS]
    df = C.censored_to_null(df, num, tokens)
    df = C.evaluated(C.try_numeric(df, num))
    return C.drop_sparse_rows(df, num, frac)


#: parameter -> column of the raw sheet, after its names are normalised
SHEET_COLUMN = {"iron": "iron_(ug/l)", "fluoride": "fluorides(ppm)", "nitrate": "nitrate(ppm)", "ph": "ph", "tds": "tds"}


def clean_stage2(df: DataFrame, frac: float | None = None) -> DataFrame:
    """Units, detection floors, domain limits, sparse rows again."""
    from hydrosift.operators import clean as C
    from hydrosift.sources.lookups import DETECTION_LIMITS, DOMAIN_LIMITS, SPARSE_ROW_FRACTION
    frac = SPARSE_ROW_FRACTION if frac is None else frac
    df = C.convert_unit(df, "iron_(ug/l)", 1000.0)
    df = C.detection_floor(df, {SHEET_COLUMN[p]: v for p, v in DETECTION_LIMITS.items()})
    df = C.null_out_of_domain(df, {SHEET_COLUMN[p]: v for p, v in DOMAIN_LIMITS.items()})
    df = C.evaluated(df)
    num = [c for c in df.columns if c not in ID_COLS]
    return C.drop_sparse_rows(df, num, frac)


def cleaned_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_stage2(clean_stage1(views.raw_readings(spark, sf_dir)))


# ------------------------------------------------------------ people

def scored_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hydrosift.operators import survey
    return survey.score_people(views.people(spark, sf_dir))


# ------------------------------------------------------------ ML frame

ML_FEATURES = ["ph", "turbidity", "chloride", "sulphate", "nitrate", "fluoride", "do", "bod", "iron"]


def ml_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (water type, site, year): mean parameters, mean index and
    its class; ``key`` is unique.  Some nitrate / iron means are blanked by a
    keyed hash so imputation has work to do."""
    from hydrosift.operators.common import hash_long
    s = scored_readings(spark, sf_dir)
    f = s.groupBy("water_type", "site", "year").agg(
        *[F.avg(p).alias(p) for p in ML_FEATURES], F.avg("wqi").alias("wqi"))
    f = f.withColumn("key", F.concat_ws("|", "water_type", "site", F.col("year").cast("string")))
    h = hash_long("key", seed="0")
    f = f.withColumns({
        "nitrate": F.when(F.pmod(h, F.lit(7)) == 0, F.lit(None).cast("double")).otherwise(F.col("nitrate")),
        "iron": F.when(F.pmod(h, F.lit(11)) == 0, F.lit(None).cast("double")).otherwise(F.col("iron")),
        "label": F.when(F.col("water_type") == "ground", W.wqi_class_gw("wqi")).otherwise(W.wqi_class_sw("wqi")),
    })
    return f.select("key", "water_type", "site", "year", *ML_FEATURES, "wqi", "label")


def written_ml_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ML frame, computed once and written: splits, folds, medians, scales and
    fits read it many times, in as many parts as its size asks for."""
    from hydrosift.session import stage_table
    return stage_table(ml_frame(spark, sf_dir), "ml")


# ------------------------------------------------------------ predictions for evaluation

EVAL_MODELS = {"drop_nitrate": "nitrate", "drop_turbidity": "turbidity"}


def predictions(spark: SparkSession, sf_dir: str, written: bool = False) -> DataFrame:
    """Rule-based predictors for the evaluation operators: the index recomputed
    without one parameter, scored against the full index and its class.

    One scan: a reading's indices are evaluated once, then it yields a row per
    model from one generator and every score reads their results.  With
    ``written`` the readings' indices are written first, for queries that pass
    over the predictions more than once."""
    gw = F.col("water_type") == "ground"

    def index(without: str | None = None) -> Column:
        gp, sp = ({k: v for k, v in m.items() if v != without} for m in (views.GW_PARAM_MAP, views.SW_PARAM_MAP))
        return F.when(gw, W.bis_wqi(gp, missing="skip")).otherwise(W.nsf_wqi(sp, missing="skip"))

    def cls(c: str) -> Column:
        return F.when(gw, W.wqi_class_gw(c)).otherwise(W.wqi_class_sw(c))
    r = views.readings(spark, sf_dir).select("l_orderkey", "l_linenumber", "water_type", index().alias("actual"),
                                             *[index(drop).alias(f"__p{pos}") for pos, drop in enumerate(EVAL_MODELS.values())])
    if written:
        from hydrosift.session import stage_table
        r = stage_table(r, "predictions")
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(pos).alias("pos"), F.col("actual"), F.col(f"__p{pos}").alias("predicted"))
                     for pos, m in enumerate(EVAL_MODELS)])
    r = r.select("l_orderkey", "l_linenumber", "water_type", F.inline(rows))
    return r.withColumns({"actual_class": cls("actual"), "predicted_class": cls("predicted")})


# ------------------------------------------------------------ model inputs

def model_frames(ml: DataFrame, water_type: str, stratified: bool = False):
    """Split (exact, keyed) of the written ML frame -> median imputation and
    population z-scores learnt on the training part -> (train, test, feature
    names, labels)."""
    from hydrosift.operators import prep
    m = ml.where(F.col("water_type") == water_type)
    m, labels = prep.encode_label(m, "label")
    m = (prep.stratified_split(m, "key", "label", 0.2, 42) if stratified
         else prep.split(m, "key", 0.2, 42))
    tr = m.where(~F.col("is_test"))
    m = prep.median_impute(tr, m, ML_FEATURES)
    tr = m.where(~F.col("is_test"))
    m = prep.standardize(tr, m, ML_FEATURES)
    m = m.withColumn("target", F.col("wqi"))
    # Model fits pass over their input many times: it is written once.
    from hydrosift.session import for_fits
    m = for_fits(m)
    return m.where(~F.col("is_test")), m.where(F.col("is_test")), list(ML_FEATURES), labels


def augmented_frames(ml: DataFrame, water_type: str, classify: bool):
    """The study's augmented training set, from the written ML frame: split -> three noisy copies of the
    training rows -> KNN imputation and z-scores learnt on them -> (for classes)
    SMOTE up to the largest class.

    Returns (train, augmented, balanced, test, features); each frame has key,
    the features as columns, label_idx and target."""
    from hydrosift.operators import knn, prep
    from hydrosift.session import cut_lineage, for_fits
    m, _ = prep.encode_label(ml.where(F.col("water_type") == water_type), "label")
    m = (prep.stratified_split(m, "key", "label", 0.2, 42) if classify else prep.split(m, "key", 0.2, 42))
    m = cut_lineage(m.withColumn("target", F.col("wqi")).select("key", "is_test", "label_idx", "target", *ML_FEATURES))
    train = m.where(~F.col("is_test"))
    noisy = prep.augment_noise(train, "key", ML_FEATURES, 3, 0.01, 42, target=None if classify else "target")
    noisy = cut_lineage(noisy.withColumn("key", F.concat_ws("#", "key", "copy")).drop("copy"))
    both = noisy.unionByName(m.where("is_test"))
    both = prep.standardize(noisy, cut_lineage(knn.knn_impute(noisy, both, ML_FEATURES, "key")), ML_FEATURES)
    both = for_fits(both)
    augmented, test = both.where(~F.col("is_test")), both.where("is_test")
    balanced = augmented
    if classify:
        points = augmented.select("key", "label_idx", F.array(*ML_FEATURES).alias("f"))
        made = knn.smote(points, "key", "f", "label_idx").select(
            F.concat_ws("~", "base_key", "syn_id").alias("key"), F.lit(False).alias("is_test"), "label_idx",
            F.lit(None).cast("double").alias("target"), *[F.get("f", i).alias(c) for i, c in enumerate(ML_FEATURES)])
        balanced = for_fits(augmented.unionByName(made))
    return train, augmented, balanced, test, list(ML_FEATURES)
