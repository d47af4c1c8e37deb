"""Person risk scoring and survey summaries.

The study scores people one at a time in a Python loop; here the whole rule
set is one projection over the people table (after the literal-array site
lookup), and every summary is an aggregate over the scored table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrosift.functions.text import short_site
from hydrosift.operators.lookup import nearest_site_class, reindex
from hydrosift.sources import lookups as L


def truthy(df: DataFrame, col: str) -> Column:
    """Yes-like value: True, 1, or one of yes/Yes/1/true/True (F1)."""
    if col not in df.columns:
        return F.lit(False)
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dt, T.NumericType):
        return F.coalesce(c == 1, F.lit(False))
    return F.coalesce(c.cast("string").isin(L.TRUTHY_STRINGS), F.lit(False))


def _neg(c: Column) -> Column:
    return F.lower(c.cast("string")).isin(L.NEGATIVE_STRINGS)


def symptom_score(df: DataFrame, weights: Sequence[tuple[str, int]] = L.SYMPTOM_WEIGHTS) -> DataFrame:
    """Sum of weights, count and title-case names of the yes-like symptom fields (F1)."""
    arr = F.array(*[F.struct(F.lit(L.symptom_title(n)).alias("name"), F.lit(w).alias("w"),
                             truthy(df, n).alias("on")) for n, w in weights])
    on = F.filter(arr, lambda s: s["on"])
    return df.withColumns({
        "symptom_score": F.aggregate(on, F.lit(0), lambda acc, s: acc + s["w"]),
        "symptom_count": F.size(on),
        "symptoms": F.transform(on, lambda s: s["name"]),
    })


def triggers(df: DataFrame) -> DataFrame:
    """Ordered list of risk triggers (F2); needs ``wqi_class`` and F1 columns."""
    T_ = L.TRIGGER_TEXT
    high = F.col("wqi_class").isin(L.HIGH_RISK_CLASSES)
    site = F.trim(F.coalesce(F.col("nearest_site").cast("string"), F.lit("None")))
    src = F.lower(F.col("drinking_water_source").cast("string"))
    qual = F.lower(F.col("drinking_water_quality").cast("string"))
    site_msg = F.concat(F.lit("Lives near "), F.col("wqi_class"), F.lit(" WQI site ("), site, F.lit(")"))
    sym_msg = F.concat(F.col("symptom_count").cast("string"), F.lit(" health symptoms reported (severity score: "),
                       F.col("symptom_score").cast("string"), F.lit(")"))
    items = F.array(
        F.when(high, site_msg),
        F.when(F.contains(src, F.lit("river")) | F.contains(src, F.lit("well")), F.lit(T_["source"])),
        F.when(F.contains(qual, F.lit("unsatisfactory")) | F.contains(qual, F.lit("unfiltered")),
               F.lit(T_["quality"])),
        F.when(_neg(F.col("has_toilet")), F.lit(T_["toilet"])),
        F.when(_neg(F.col("uses_purifier")) & high, F.lit(T_["purifier"])),
        F.when(F.col("symptom_count") >= L.SYMPTOM_COUNT_THRESHOLD, sym_msg),
    )
    return df.withColumn("triggers", F.array_compact(items))


def risk_level(df: DataFrame) -> DataFrame:
    """CRITICAL / HIGH / MODERATE / LOW from trigger count and symptom score."""
    n = F.size("triggers")
    sc = F.col("symptom_score")
    lvl = (F.when((n >= 3) | (sc >= L.HIGH_RISK_SCORE_THRESHOLD), "CRITICAL")
           .when((n == 2) | (sc >= 4), "HIGH").when(n == 1, "MODERATE").otherwise("LOW"))
    return df.withColumn("risk_level", lvl)


def risk_score(df: DataFrame) -> DataFrame:
    """10 per trigger plus the symptom score."""
    return df.withColumn("risk_score", F.size("triggers") * 10 + F.col("symptom_score"))


def recommendations(df: DataFrame) -> DataFrame:
    """Ordered advice list."""
    R = L.RECOMMENDATIONS
    high = F.col("wqi_class").isin(L.HIGH_RISK_CLASSES)
    sy = F.col("symptoms")

    def has(*names):
        cond = None
        for n in names:
            c = F.array_contains(sy, n)
            cond = c if cond is None else (cond | c)
        return cond

    flagged = F.col("risk_level").isin("CRITICAL", "HIGH")
    items = F.array(
        F.when(high, F.lit(R["avoid_source"])), F.when(high, F.lit(R["purifier"])),
        F.when(_neg(F.col("has_toilet")), F.lit(R["sanitation"])),
        F.when(has("Kidney Disease", "Bone Disease"), F.lit(R["kidney_bone"])),
        F.when(has("Jaundice", "Diarrhea", "Dysentery"), F.lit(R["waterborne"])),
        F.when(has("Anemia", "Weight Loss"), F.lit(R["nutrition"])),
        F.when(flagged, F.lit(R["phc"])), F.when(flagged, F.lit(R["report"])),
        F.lit(R["boil"]), F.lit(R["wash"]))
    return df.withColumn("recommendations", F.array_compact(items))


def sanitation_status(df: DataFrame, key: str = "person_id") -> DataFrame:
    """Per-field Risk / OK, long form (F6).  Quality checks only 'unsatisfactory'."""
    src = F.lower(F.col("drinking_water_source").cast("string"))
    qual = F.lower(F.col("drinking_water_quality").cast("string"))

    def st(cond):
        return F.when(cond, "Risk").otherwise("OK")

    rows = F.array(
        F.struct(F.lit("Drinking Water Source").alias("parameter"),
                 F.col("drinking_water_source").cast("string").alias("value"),
                 st(F.contains(src, F.lit("river")) | F.contains(src, F.lit("well"))).alias("status")),
        F.struct(F.lit("Water Quality").alias("parameter"),
                 F.col("drinking_water_quality").cast("string").alias("value"),
                 st(F.contains(qual, F.lit("unsatisfactory"))).alias("status")),
        F.struct(F.lit("Has Private Toilet").alias("parameter"),
                 F.col("has_toilet").cast("string").alias("value"),
                 st(_neg(F.col("has_toilet"))).alias("status")),
        F.struct(F.lit("Uses Water Purifier").alias("parameter"),
                 F.col("uses_purifier").cast("string").alias("value"),
                 st(_neg(F.col("uses_purifier"))).alias("status")))
    return df.select(key, F.inline(rows))


def score_people(df: DataFrame, classes=None) -> DataFrame:
    """Whole person rule set as one projection (F7): site class lookup, symptom
    score, triggers, level and score."""
    out = nearest_site_class(df, "nearest_site", classes)
    out = symptom_score(out)
    out = triggers(out)
    out = risk_level(out)
    return risk_score(out)


RESULT_COLS = ["person_id", "name", "age", "risk_level", "risk_score", "wqi_class", "nearest_site",
               "symptoms", "triggers"]


def flagged(df: DataFrame) -> DataFrame:
    """People at CRITICAL or HIGH (F8)."""
    return df.where(F.col("risk_level").isin("CRITICAL", "HIGH"))


def flagged_table(df: DataFrame, n: int = 8, order: str = "person_id") -> DataFrame:
    """First ``n`` flagged people in input order with truncated texts."""
    f = flagged(df).orderBy(order).limit(n)
    return f.select(order, F.substring(F.coalesce(F.col("name").cast("string"), F.lit("—")), 1, 14).alias("name"),
                    "risk_level",
                    F.substring(F.coalesce(F.col("nearest_site"), F.lit("—")), 1, 14).alias("site"),
                    F.size("symptoms").alias("n_symptoms"))


def risk_distribution(df: DataFrame) -> DataFrame:
    """Counts in the fixed level order with zeros, and percent share."""
    c = df.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    r = reindex(c, "risk_level", L.RISK_ORDER, "n", 0)
    total = F.sum("n").over(Window.partitionBy())
    return r.withColumn("pct", F.col("n") * 100.0 / total).select("pos", "risk_level", "n", "pct")


def top_symptoms(df: DataFrame, n: int = 10) -> DataFrame:
    """Most reported symptoms (F11): ties by name; the limit is the feature."""
    e = df.select(F.explode("symptoms").alias("symptom"))
    return e.groupBy("symptom").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "symptom").limit(n)


def class_distribution(df: DataFrame) -> DataFrame:
    """People per nearest-site class."""
    return df.groupBy("wqi_class").agg(F.count(F.lit(1)).alias("n"))


def _filled(template: str, **parts) -> Column:
    """A fixed text with its ``{name}`` places taken by columns."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p])


def alert_outbox(df: DataFrame, authority: str = "health-authority") -> DataFrame:
    """One row per message to send for flagged people (F13): the person when
    the e-mail is non-empty, and the health authority always.  Sending is not
    ours; this is the table a mailer consumes."""
    f = recommendations(flagged(df))
    name = F.col("name").cast("string")
    level = F.col("risk_level")
    trig = F.when(F.size("triggers") > 0, F.array_join("triggers", "; ")).otherwise("No critical triggers")
    sym = F.when(F.size("symptoms") > 0, F.array_join("symptoms", ", ")).otherwise("None reported")
    body = F.concat(F.lit("Risk: "), level, F.lit(" (score "), F.col("risk_score").cast("string"),
                    F.lit("). Site: "), F.coalesce(F.col("nearest_site"), F.lit("—")),
                    F.lit(" (WQI class: "), F.col("wqi_class"), F.lit("). Triggers: "), trig,
                    F.lit(". Symptoms: "), sym, F.lit("."))
    site = F.coalesce(F.col("nearest_site"), F.lit("—"))
    person_subj = _filled(L.PERSON_SUBJECT, level=level, name=F.coalesce(name, F.lit("Resident")))
    auth_subj = _filled(L.AUTHORITY_SUBJECT, level=level, name=F.coalesce(name, F.lit("Unknown")), site=site)
    person_body = F.concat(body, F.lit(" Recommendations: "), F.array_join("recommendations", " "))
    mail = F.when(F.col("email") != "", F.col("email"))
    auth_body = F.concat(body, F.lit(" Age: "), F.coalesce(F.col("age").cast("string"), F.lit("—")), F.lit(". Gender: "),
                         F.coalesce(F.col("gender"), F.lit("—")), F.lit(". E-mail: "), F.coalesce(mail, F.lit("—")), F.lit("."))
    has_mail = F.coalesce(F.col("email"), F.lit("")) != ""
    msgs = F.array(
        F.when(has_mail, F.struct(F.lit("person").alias("recipient_kind"), F.col("email").alias("recipient"),
                                  person_subj.alias("subject"), person_body.alias("body"))),
        F.struct(F.lit("authority").alias("recipient_kind"), F.lit(authority).alias("recipient"),
                 auth_subj.alias("subject"), auth_body.alias("body")))
    return f.select("person_id", F.inline(F.array_compact(msgs)))


def symptom_text(df: DataFrame) -> DataFrame:
    """Symptoms joined by ' | ', or a no-symptom sentence; with the count."""
    return df.withColumns({
        "symptom_text": F.when(F.size("symptoms") > 0, F.array_join("symptoms", " | "))
                         .otherwise(F.lit(L.NO_SYMPTOMS_TEXT)),
        "n_symptoms": F.size("symptoms"),
    })


def report_rows(df: DataFrame) -> DataFrame:
    """Fields shown on a flagged person's report, with its file name."""
    f = recommendations(symptom_text(flagged(df)))
    fname = F.concat(F.lit("health_report_"), F.replace(F.coalesce(F.col("name"), F.lit("Unknown")),
                                                        F.lit(" "), F.lit("_")),
                     F.lit("_"), F.col("risk_level"), F.lit(".pdf"))
    return f.select("person_id", "name", "age", "gender", "nearest_site", "email", "risk_level", "risk_score",
                    "wqi_class", "symptom_text", "n_symptoms", F.array_join("triggers", "; ").alias("triggers"),
                    F.array_join("recommendations", " / ").alias("recommendations"), fname.alias("file_name"))


def run_summary(df: DataFrame) -> DataFrame:
    """Total records and flagged count."""
    return df.agg(F.count(F.lit(1)).alias("total_records"),
                  F.count_if(F.col("risk_level").isin("CRITICAL", "HIGH")).alias("flagged"))


def survey_table(df: DataFrame, site_len: int = 22) -> DataFrame:
    """ID, name, age, gender, short site, class, risk, score, "n reported" (F16)."""
    return df.select(
        F.col("person_id").alias("id"), "name", "age", "gender",
        short_site(F.coalesce(F.col("nearest_site"), F.lit("")), site_len, drop_suffixes=False).alias("site_short"),
        "wqi_class", F.col("risk_level").alias("risk"), F.col("risk_score").alias("score"),
        F.concat(F.size("symptoms").cast("string"), F.lit(" reported")).alias("symptom_note"))


def survey_totals(df: DataFrame) -> DataFrame:
    """Respondents, distinct sites, counts by risk and by gender.

    Two-level aggregation: per site first (map-side combined), then totals,
    so distinct sites need no separate pass and no join.
    """
    per_site = df.groupBy("nearest_site").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("risk_level") == lv).alias(f"n_{lv.lower()}") for lv in L.RISK_ORDER],
        F.count_if(F.col("gender") == "Male").alias("n_male"),
        F.count_if(F.col("gender") == "Female").alias("n_female"))
    cols = [f"n_{lv.lower()}" for lv in L.RISK_ORDER] + ["n_male", "n_female"]
    return per_site.agg(F.sum("n").alias("respondents"),
                        F.count("nearest_site").alias("distinct_sites"),
                        *[F.sum(c).alias(c) for c in cols])


def prevalence(df: DataFrame, levels: Sequence[str], predicates: dict[str, Column]) -> DataFrame:
    """Percent of people at the given levels for whom each predicate holds."""
    g = df.where(F.col("risk_level").isin(list(levels)))
    wide = g.agg(*[(F.avg(F.when(p, 1.0).otherwise(0.0)) * 100).alias(k) for k, p in predicates.items()])
    return wide.unpivot([], list(predicates), "measure", "pct")
