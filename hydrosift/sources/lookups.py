"""Constant lookup tables (operator A6).

Everything under a "FIXED VALUES" comment must equal the study's constants for
results to agree; it is stated plainly here, in its natural order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# FIXED VALUES: drinking-water limits for the ground-water index.
# A (low, high) pair is an acceptable range; its high end sets the weight.
BIS_LIMITS = {
    "ph": (6.5, 8.5),
    "turbidity": 5.0,
    "chloride": 250.0,
    "sulphate": 200.0,
    "nitrate": 45.0,
    "fluoride": 1.5,
    "iron": 0.3,
    "conductivity": 2000.0,
}

# FIXED VALUES: limits used for the exceedance-rate summary.
EXCEED_LIMITS = {
    "ph": (6.5, 8.5),
    "turbidity": 5.0,
    "ammonia": 0.5,
    "nitrate": 45.0,
}

# FIXED VALUES: surface-water index parameters (ideal, standard, weight).
NSF_PARAMS = {
    "pH": (7.0, 8.5, 0.11),
    "DO": (14.6, 5.0, 0.17),
    "BOD": (0.0, 3.0, 0.11),
    "Turbidity": (0.0, 5.0, 0.08),
    "Nitrate": (0.0, 45.0, 0.10),
}

# FIXED VALUES: cleaning constants.
GW_CENSOR_TOKENS = ["NO", "ND", "nd", "no", "-"]
SW_CENSOR_TOKENS = ["ND", "-", "<1"]
DETECTION_LIMITS = {"iron": 0.01, "fluoride": 0.1, "nitrate": 0.5}
DOMAIN_LIMITS = {"ph": (6.5, 8.5), "tds": (0.0, 2000.0), "nitrate": (0.0, 100.0)}
SPARSE_ROW_FRACTION = 0.7

# FIXED VALUES: site keyword -> default class used by the health survey.
SITE_WQI_CLASS = [
    ("Kaushalaya Dam", "Good"),
    ("Nada Sahib", "Good"),
    ("Rajpura Road", "Poor"),
    ("Ratia", "Very Poor"),
    ("Ottu Barrage", "Very Poor"),
    ("Yamunanagar", "Poor"),
    ("Panipat", "Poor"),
    ("Sonipat", "Very Poor"),
    ("Faridabad", "Unsuitable"),
    ("Shahabad", "Poor"),
    ("Agra Canal", "Very Poor"),
    ("Teekar Taal", "Good"),
    ("Karan Lake", "Good"),
    ("Brahma Sarovar", "Poor"),
]
HIGH_RISK_CLASSES = ["Poor", "Very Poor", "Unsuitable"]

# FIXED VALUES: symptom field -> risk weight (20 fields, weights sum to 60).
SYMPTOM_WEIGHTS = [
    ("diarrhea", 3),
    ("diarrhea_blood", 5),
    ("kidney_disease", 5),
    ("jaundice", 5),
    ("dysentery", 5),
    ("fever", 2),
    ("anemia", 3),
    ("high_blood_pressure", 3),
    ("vomiting", 2),
    ("abdominal_pain", 2),
    ("nausea", 2),
    ("weight_loss", 2),
    ("painful_skin_lesions", 4),
    ("bone_disease", 4),
    ("malnutrition", 3),
    ("growth_retardation", 3),
    ("gastric_problems", 2),
    ("severe_throat", 2),
    ("depression", 1),
    ("menstrual_problems", 2),
]
HIGH_RISK_SCORE_THRESHOLD = 6
SYMPTOM_COUNT_THRESHOLD = 2
RISK_ORDER = ["CRITICAL", "HIGH", "MODERATE", "LOW"]
TRUTHY_STRINGS = ["yes", "Yes", "1", "true", "True"]
NEGATIVE_STRINGS = ["no", "false", "0"]

# FIXED VALUES: site coordinate keys. Entries given in degrees/minutes/seconds
# are (d, m, s, dir) tuples; the others are decimal degrees.
SITE_COORDS = [
    ("Ghaggar River(Site 1) (Ground Water)", (30, 46, 35, "N"), (76, 54, 51, "E")),
    ("Ghaggar River(Site 2) (Ground Water)", (30, 41, 37, "N"), (76, 52, 52, "E")),
    ("Ghaggar River(Site 3) (Ground Water)", 30.4762, 76.5906),
    ("Ghaggar River(Site 4) (Ground Water)", (29, 41, 1, "N"), (75, 34, 33, "E")),
    ("Ghaggar River(Site 5) (Ground Water)", (29, 29, 21, "N"), (74, 54, 38, "E")),
    ("Yamuna River(Site 1) (Ground Water)", 30.1290, 77.2674),
    ("Yamuna River(Site 2) (Ground Water)", (29, 14, 48, "N"), (77, 21, 5, "E")),
    ("Yamuna River(Site 3) (Ground Water)", 28.993, 77.027),
    ("Yamuna River(Site 4) (Ground Water)", 28.4215, 77.3076),
    ("Markanda River(Site 1) (Ground Water)", 30.1585, 76.8677),
    ("Agra Canal(Site 1) (Ground Water)", (28, 33, 56, "N"), (77, 17, 60, "E")),
    ("Teekar Taal(Site 3) (Ground Water)", 30.6873, 77.0878),
    ("Karan Lake (Site 1) (Ground Water)", (29, 44, 62, "N"), (76, 58, 58, "E")),
    ("Brahma Sarovar(Site 2) (Ground Water)", 29.57, 76.51),
    ("Ghaggar River(Site 1) (Surface Water)", (30, 46, 30, "N"), (76, 54, 50, "E")),
    ("Ghaggar River(Site 2) (Surface Water)", (30, 41, 39, "N"), (76, 52, 53, "E")),
    ("Ghaggar River(Site 3) (Surface Water)", 30.4766, 76.5905),
    ("Ghaggar River(Site 4) (Surface Water)", (29, 41, 0, "N"), (75, 34, 30, "E")),
    ("Ghaggar River(Site 5) (Surface Water)", (29, 29, 21, "N"), (74, 54, 38, "E")),
    ("Yamuna River(Site 1) (Surface Water)", 30.1290, 77.2674),
    ("Yamuna River(Site 2) (Surface Water)", (29, 14, 46, "N"), (77, 21, 3, "E")),
    ("Yamuna River(Site 3) (Surface Water)", 28.990, 77.022),
    ("Yamuna River(Site 4) (Surface Water)", 28.4211, 77.3078),
    ("Markanda River(Site 1) (Surface Water)", 30.1588, 76.8678),
    ("Agra Canal(Site 1) (Surface Water)", (28, 33, 59, "N"), (77, 17, 60, "E")),
    ("Teekar Taal(Site 3) (Surface Water)", 30.6873, 77.0877),
    ("Karan Lake (Site 1) (Surface Water)", (29, 44, 62, "N"), (76, 58, 54, "E")),
    ("Brahma Sarovar(Site 2) (Surface Water)", 29.58, 76.50),
]

# FIXED VALUES: site-name suffixes dropped when shortening a site label.
SHORT_SITE_SUFFIXES = [" River", " Canal", " Lake", " Sarovar", " Taal"]

# FIXED VALUES: per-model constants for the model comparison (defaults 0.5 / 0.8).
MODEL_CONSTANTS = [
    ("KNN", 0.55, 0.87),
    ("Random Forest", 0.60, 0.98),
    ("SVM", 0.45, 0.91),
    ("Gradient Boosting", 0.55, 0.98),
    ("Decision Tree", 0.95, 0.92),
    ("XGBoost", 0.50, 0.87),
    ("K-Means", 0.70, 0.75),
]
# FIXED VALUES: trigger messages of the person risk rules.
TRIGGER_TEXT = {
    "site": "Lives near {cls} WQI site ({site})",
    "source": "Drinking from unprotected water source (river/open well)",
    "quality": "Drinking water quality reported as unsatisfactory/unfiltered",
    "toilet": "No access to private toilet (open defecation)",
    "purifier": "No water purifier used despite living near polluted site",
    "symptoms": "{n} health symptoms reported (severity score: {score})",
}

# FIXED VALUES: recommendation lines, in the order they are given.
RECOMMENDATIONS = {
    "avoid_source": "Avoid using river or open well water for drinking and cooking.",
    "purifier": "Install a certified water purifier (RO/UV) immediately.",
    "sanitation": "Access to sanitation facilities is critical \u2014 contact local Panchayat.",
    "kidney_bone": ("High fluoride/nitrate levels linked to kidney and bone issues \u2014 "
                    "get water tested urgently."),
    "waterborne": "Water-borne disease symptoms detected \u2014 seek medical attention immediately.",
    "nutrition": "Nutritional deficiency suspected \u2014 consult a doctor for blood tests.",
    "phc": "Visit the nearest Primary Health Centre (PHC) as soon as possible.",
    "report": "Report water quality issues to Haryana State Pollution Control Board.",
    "boil": "Boil drinking water for at least 1 minute before consumption.",
    "wash": "Wash hands with soap before eating and after using toilet.",
}

# FIXED VALUES: alert message formats.
PERSON_SUBJECT = "[{level} RISK] Water Quality Health Alert \u2014 {name}"
AUTHORITY_SUBJECT = "[HEALTH ALERT \u2014 {level}] {name} | Site: {site}"
GW_ALERT_SUBJECT = "Groundwater Quality Alert"
GW_ALERT_BODY = "Alert: Groundwater WQI at {site} is {wqi}, indicating high risk."
NO_SYMPTOMS_TEXT = "No symptoms reported."
# ---------------------------------------------------------------------------


def symptom_title(field: str) -> str:
    """Display name of a symptom field: underscores to spaces, title case."""
    return field.replace("_", " ").title()


def dms_to_decimal(d: float, m: float, s: float, direction: str) -> float:
    v = float(d) + float(m) / 60 + float(s) / 3600
    return round(-v if direction in ("S", "W") else v, 6)


def _coord(v) -> float:
    return dms_to_decimal(*v) if isinstance(v, tuple) else float(v)


def site_coords_rows():
    """(pos, key, water_type, lat, lon) with DMS entries converted."""
    rows = []
    for pos, (key, lat, lon) in enumerate(SITE_COORDS):
        wt = "ground" if "(ground water)" in key.lower() else "surface"
        rows.append((pos, key, wt, _coord(lat), _coord(lon)))
    return rows


def model_constants_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        MODEL_CONSTANTS, "model string, interpretability double, cv_stability double")
