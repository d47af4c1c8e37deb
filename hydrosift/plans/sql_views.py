"""The views of ``hydrosift.sources.views`` written in plain SQL for the oracle.

Kept next to each other on purpose: a rule changed in one must change here.
"""

SITE_STEMS_SQL = ("['Ghaggar River', 'Yamuna River', 'Markanda River', 'Agra Canal', "
                  "'Teekar Taal', 'Karan Lake ', 'Brahma Sarovar']")


def site_name_sql(key: str, wt: str) -> str:
    return (f"({SITE_STEMS_SQL})[CAST({key} % 7 AS INTEGER) + 1] || '(Site ' || "
            f"CAST({key} // 7 + 1 AS VARCHAR) || ') (' || "
            f"CASE WHEN {wt} = 'ground' THEN 'Ground Water' ELSE 'Surface Water' END || ')'")


READINGS = f"""
SELECT l_orderkey, l_linenumber,
       {site_name_sql('l_suppkey', "CASE WHEN l_linestatus = 'O' THEN 'ground' ELSE 'surface' END")} AS site,
       CAST(year(l_shipdate) AS INTEGER) AS year,
       CASE WHEN l_linestatus = 'O' THEN 'ground' ELSE 'surface' END AS water_type,
       6 + 30 * abs(l_discount) AS ph,
       l_quantity / 6 AS turbidity,
       l_extendedprice / 250 AS chloride,
       CAST(p_size AS DOUBLE) * 6 AS sulphate,
       nullif(abs(l_tax) * 1000, CAST(80 AS DOUBLE)) AS nitrate,
       CASE WHEN l_linenumber = 2 THEN NULL ELSE (l_partkey % 25) / 10 END AS fluoride,
       2 + p_size / 5 AS "do",
       l_quantity / 10 AS bod,
       (l_orderkey % 80) / 50 AS iron
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

def D(x) -> str:
    """A DOUBLE literal (plain SQL literals like 0.11 would be exact decimals)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def _gw_term(col: str, limit: float) -> str:
    return f"coalesce({D(1 / limit)} * ({col} / {D(limit)} * 100), {D(0)})"


GW_WQI = f"""
(({D(0)} + coalesce({D(1 / 8.5)} * (abs(ph - {D(7.0)}) / {D(8.5 - 7.0)} * 100), {D(0)})
  + {_gw_term('turbidity', 5.0)} + {_gw_term('chloride', 250.0)} + {_gw_term('sulphate', 200.0)}
  + {_gw_term('nitrate', 45.0)} + {_gw_term('fluoride', 1.5)} + {_gw_term('iron', 0.3)})
 / nullif({D(0)} + (CASE WHEN ph IS NOT NULL THEN {D(1 / 8.5)} ELSE {D(0)} END)
  + (CASE WHEN turbidity IS NOT NULL THEN {D(1 / 5.0)} ELSE {D(0)} END)
  + (CASE WHEN chloride IS NOT NULL THEN {D(1 / 250.0)} ELSE {D(0)} END)
  + (CASE WHEN sulphate IS NOT NULL THEN {D(1 / 200.0)} ELSE {D(0)} END)
  + (CASE WHEN nitrate IS NOT NULL THEN {D(1 / 45.0)} ELSE {D(0)} END)
  + (CASE WHEN fluoride IS NOT NULL THEN {D(1 / 1.5)} ELSE {D(0)} END)
  + (CASE WHEN iron IS NOT NULL THEN {D(1 / 0.3)} ELSE {D(0)} END), {D(0)}))
"""


def _nsf_q(col: str, ideal: float, std: float) -> str:
    return (f"(CASE WHEN {col} <= {D(ideal)} THEN {D(100)} "
            f"ELSE greatest({D(0)}, 100 * ({D(std)} - {col}) / {D(std - ideal)}) END)")


def _nsf_t(col, ideal, std, wt):
    return f"coalesce({_nsf_q(col, ideal, std)} * {D(wt)}, {D(0)})"


def _nsf_w(col, wt):
    return f"(CASE WHEN {col} IS NOT NULL THEN {D(wt)} ELSE {D(0)} END)"


SW_WQI = f"""
(({D(0)} + {_nsf_t('ph', 7.0, 8.5, 0.11)} + {_nsf_t('"do"', 14.6, 5.0, 0.17)}
  + {_nsf_t('bod', 0.0, 3.0, 0.11)} + {_nsf_t('turbidity', 0.0, 5.0, 0.08)}
  + {_nsf_t('nitrate', 0.0, 45.0, 0.10)})
 / nullif({D(0)} + {_nsf_w('ph', 0.11)} + {_nsf_w('"do"', 0.17)} + {_nsf_w('bod', 0.11)}
  + {_nsf_w('turbidity', 0.08)} + {_nsf_w('nitrate', 0.10)}, {D(0)}))
"""

GW_TERMS = {"ph": (1 / 8.5, f"(abs(ph - {D(7.0)}) / {D(8.5 - 7.0)} * 100)"),
            "turbidity": (1 / 5.0, f"(turbidity / {D(5.0)} * 100)"),
            "chloride": (1 / 250.0, f"(chloride / {D(250.0)} * 100)"),
            "sulphate": (1 / 200.0, f"(sulphate / {D(200.0)} * 100)"),
            "nitrate": (1 / 45.0, f"(nitrate / {D(45.0)} * 100)"),
            "fluoride": (1 / 1.5, f"(fluoride / {D(1.5)} * 100)"),
            "iron": (1 / 0.3, f"(iron / {D(0.3)} * 100)")}
SW_TERMS = {"ph": (7.0, 8.5, 0.11), '"do"': (14.6, 5.0, 0.17), "bod": (0.0, 3.0, 0.11),
            "turbidity": (0.0, 5.0, 0.08), "nitrate": (0.0, 45.0, 0.10)}


def gw_wqi_sql(params) -> str:
    num = " + ".join(f"coalesce({D(w)} * {q}, {D(0)})" for p, (w, q) in GW_TERMS.items() if p in params)
    den = " + ".join(f"(CASE WHEN {p} IS NOT NULL THEN {D(w)} ELSE {D(0)} END)"
                     for p, (w, q) in GW_TERMS.items() if p in params)
    return f"(({D(0)} + {num}) / nullif({D(0)} + {den}, {D(0)}))"


def sw_wqi_sql(params) -> str:
    num = " + ".join(_nsf_t(p, *v) for p, v in SW_TERMS.items() if p.strip('"') in params)
    den = " + ".join(_nsf_w(p, v[2]) for p, v in SW_TERMS.items() if p.strip('"') in params)
    return f"(({D(0)} + {num}) / nullif({D(0)} + {den}, {D(0)}))"


GW_CLASS = """(CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 50 THEN 'Excellent' WHEN {x} <= 100 THEN 'Good'
 WHEN {x} <= 200 THEN 'Poor' WHEN {x} <= 300 THEN 'Very Poor' ELSE 'Unsuitable' END)"""
SW_CLASS = """(CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 90 THEN 'Excellent' WHEN {x} >= 70 THEN 'Good'
 WHEN {x} >= 50 THEN 'Medium' WHEN {x} >= 25 THEN 'Poor' ELSE 'Very Poor' END)"""

SCORED = f"""
SELECT *, CASE WHEN water_type = 'ground' THEN {GW_CLASS.format(x='wqi')}
               ELSE {SW_CLASS.format(x='wqi')} END AS wqi_class
FROM (SELECT *, CASE WHEN water_type = 'ground' THEN {GW_WQI} ELSE {SW_WQI} END AS wqi
      FROM readings) t
"""

# mode with ties to the smallest label
PROFILE = """
SELECT a.water_type, a.site, a.wqi_mean, m.wqi_class FROM
 (SELECT water_type, site, avg(wqi) AS wqi_mean FROM scored GROUP BY water_type, site) a
 JOIN (SELECT water_type, site, wqi_class FROM
        (SELECT water_type, site, wqi_class,
                row_number() OVER (PARTITION BY water_type, site ORDER BY count(*) DESC, wqi_class) AS rn
         FROM scored WHERE wqi_class IS NOT NULL GROUP BY water_type, site, wqi_class) WHERE rn = 1) m
 USING (water_type, site)
"""

SIGNED = "(CASE WHEN water_type = 'surface' THEN -wqi_mean ELSE wqi_mean END)"


def _tok(cond: str, token: str, expr: str) -> str:
    return f"CASE WHEN {cond} THEN '{token}' ELSE CAST({expr} AS VARCHAR) END"


_SP = "l_orderkey % 31 = 0"
RAW = f"""
SELECT l_orderkey, l_linenumber,
  '  ' || site || ' ' AS "Site",
  {_tok('l_orderkey % 101 = 0', 'n/a', 'year')} AS "Year",
  {_tok(f'{_SP} OR l_orderkey % 17 = 0', 'ND', 'ph')} AS "pH",
  {_tok(f'{_SP} OR l_orderkey % 13 = 0', '-', 'turbidity')} AS "Turbidity",
  {_tok(f'{_SP} OR l_orderkey % 11 = 0', 'nd', 'chloride')} AS "Chloride (ppm)",
  {_tok(f'{_SP} OR l_orderkey % 19 = 0', 'NO', 'sulphate')} AS "Sulphates(ppm)",
  {_tok('l_orderkey % 23 = 0', 'abc', 'nitrate')} AS "Nitrate(ppm)",
  {_tok(_SP, 'no', 'fluoride')} AS "Fluorides(ppm)",
  {_tok('l_linenumber = 7', 'no', 'iron * 1000')} AS "Iron (ug/l)",
  {_tok(f'{_SP} OR l_orderkey % 29 = 0', ' ', '"do"')} AS "DO(ppm)",
  {_tok(_SP, '-', 'bod')} AS "BOD(ppm)",
  CAST(NULL AS VARCHAR) AS "Remarks"
FROM readings
"""

RAW_NUM = {"pH": "ph", "Turbidity": "turbidity", "Chloride (ppm)": "chloride_(ppm)",
           "Sulphates(ppm)": "sulphates(ppm)", "Nitrate(ppm)": "nitrate(ppm)",
           "Fluorides(ppm)": "fluorides(ppm)", "Iron (ug/l)": "iron_(ug/l)",
           "DO(ppm)": "do(ppm)", "BOD(ppm)": "bod(ppm)", "Remarks": "remarks"}
_TOKENS = "('NO', 'ND', 'nd', 'no', '-')"


def _present(cols) -> str:
    return " + ".join(f'(CASE WHEN "{c}" IS NOT NULL THEN 1 ELSE 0 END)' for c in cols)


CLEAN1 = f"""
SELECT * FROM (
  SELECT l_orderkey, l_linenumber, trim("Site") AS site,
         CAST(trunc(TRY_CAST("Year" AS DOUBLE)) AS INTEGER) AS year,
         {", ".join(f'TRY_CAST(CASE WHEN "{r}" IN {_TOKENS} THEN NULL ELSE "{r}" END AS DOUBLE) AS "{n}"'
                    for r, n in RAW_NUM.items())}
  FROM raw WHERE TRY_CAST("Year" AS DOUBLE) IS NOT NULL) t
WHERE {_present(RAW_NUM.values())} >= 7
"""

CLEAN2 = f"""
SELECT * FROM (
  SELECT l_orderkey, l_linenumber, site, year,
    CASE WHEN ph < 6.5 OR ph > 8.5 THEN NULL ELSE ph END AS ph,
    turbidity, "chloride_(ppm)", "sulphates(ppm)",
    CASE WHEN n3 < 0 OR n3 > 100 THEN NULL ELSE n3 END AS "nitrate(ppm)",
    CASE WHEN "fluorides(ppm)" IS NOT NULL THEN greatest("fluorides(ppm)", {D(0.1 / 2)}) END AS "fluorides(ppm)",
    CASE WHEN i1 IS NOT NULL THEN greatest(i1, {D(0.01 / 2)}) END AS "iron_(ug/l)",
    "do(ppm)", "bod(ppm)", remarks
  FROM (SELECT *, "iron_(ug/l)" / {D(1000)} AS i1,
               CASE WHEN "nitrate(ppm)" IS NOT NULL THEN greatest("nitrate(ppm)", {D(0.5 / 2)}) END AS n3
        FROM clean1) a) b
WHERE {_present(RAW_NUM.values())} >= 7
"""


# ------------------------------------------------------------------ people

from hydrosift.sources.lookups import (  # noqa: E402
    HIGH_RISK_CLASSES, RECOMMENDATIONS, SITE_WQI_CLASS, SYMPTOM_WEIGHTS, TRIGGER_TEXT, symptom_title)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_KEYS = "[" + ", ".join(_lit(k) for k, _ in SITE_WQI_CLASS) + "]"
_SOURCES = {"AUTOMOBILE": "River", "BUILDING": "Tube well", "FURNITURE": "Tap water",
            "HOUSEHOLD": "Hand pump", "MACHINERY": "Open well"}

PEOPLE = f"""
SELECT c_custkey AS person_id, c_name AS name, CAST(18 + c_custkey % 60 AS INTEGER) AS age,
  CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'resident' || CAST(c_custkey AS VARCHAR) || '@example.org' END AS email,
  CASE WHEN c_custkey % 53 = 0 THEN NULL
       WHEN c_custkey % 41 = 0 THEN {_KEYS}[CAST((c_nationkey + 5) % 14 AS INTEGER) + 1] || ' / '
            || coalesce({_KEYS}[CAST(c_nationkey % 15 AS INTEGER) + 1], n_name)
       WHEN c_nationkey % 15 < 14 THEN {_KEYS}[CAST(c_nationkey % 15 AS INTEGER) + 1] || ', ' || n_name
       ELSE n_name || ' village' END AS nearest_site,
  CASE {" ".join(f"WHEN c_mktsegment = '{k}' THEN '{v}'" for k, v in _SOURCES.items())} ELSE 'Unknown' END
    AS drinking_water_source,
  CASE WHEN c_acctbal < 0 THEN 'Unsatisfactory' WHEN c_acctbal < 1500 THEN 'Unfiltered' ELSE 'Satisfactory' END
    AS drinking_water_quality,
  CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_acctbal < 0 THEN 'No' ELSE 'Yes' END AS has_toilet,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'no' ELSE 'Yes' END AS uses_purifier,
  CASE WHEN c_acctbal > 5000 THEN 'Yes' ELSE 'No' END AS visited_doctor,
  CAST(2 + c_custkey % 7 AS INTEGER) AS family_size,
  {", ".join(f"list_contains(coalesce(u.sym_ids, []), {i}) AS {n}" for i, (n, _) in enumerate(SYMPTOM_WEIGHTS))}
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, list(DISTINCT CAST(o_orderkey % 20 AS INTEGER)) AS sym_ids FROM orders
           WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) u ON c_custkey = u.o_custkey
"""

_CLASS_CASE = ("CASE " + " ".join(f"WHEN contains(lower(trim(nearest_site)), {_lit(k.lower())}) THEN {_lit(c)}"
                                  for k, c in SITE_WQI_CLASS) + " ELSE 'Unknown' END")
_HIGH = "(" + ", ".join(_lit(c) for c in HIGH_RISK_CLASSES) + ")"
_NEG = "('no', 'false', '0')"

PEOPLE1 = f"""
SELECT *, {_CLASS_CASE} AS wqi_class,
  {" + ".join(f"(CASE WHEN {n} THEN {w} ELSE 0 END)" for n, w in SYMPTOM_WEIGHTS)} AS symptom_score,
  {" + ".join(f"(CASE WHEN {n} THEN 1 ELSE 0 END)" for n, w in SYMPTOM_WEIGHTS)} AS symptom_count,
  list_filter([{", ".join(f"CASE WHEN {n} THEN {_lit(symptom_title(n))} END" for n, _ in SYMPTOM_WEIGHTS)}],
              lambda x: x IS NOT NULL) AS symptoms
FROM people
"""

PEOPLE2 = f"""
SELECT *, list_filter([
  CASE WHEN wqi_class IN {_HIGH} THEN 'Lives near ' || wqi_class || ' WQI site ('
       || trim(coalesce(nearest_site, 'None')) || ')' END,
  CASE WHEN contains(lower(drinking_water_source), 'river') OR contains(lower(drinking_water_source), 'well')
       THEN {_lit(TRIGGER_TEXT["source"])} END,
  CASE WHEN contains(lower(drinking_water_quality), 'unsatisfactory')
         OR contains(lower(drinking_water_quality), 'unfiltered') THEN {_lit(TRIGGER_TEXT["quality"])} END,
  CASE WHEN lower(has_toilet) IN {_NEG} THEN {_lit(TRIGGER_TEXT["toilet"])} END,
  CASE WHEN lower(uses_purifier) IN {_NEG} AND wqi_class IN {_HIGH} THEN {_lit(TRIGGER_TEXT["purifier"])} END,
  CASE WHEN symptom_count >= 2 THEN CAST(symptom_count AS VARCHAR) || ' health symptoms reported (severity score: '
       || CAST(symptom_score AS VARCHAR) || ')' END], lambda x: x IS NOT NULL) AS triggers
FROM people1
"""

SCORED_PEOPLE = """
SELECT *, CASE WHEN len(triggers) >= 3 OR symptom_score >= 6 THEN 'CRITICAL'
               WHEN len(triggers) = 2 OR symptom_score >= 4 THEN 'HIGH'
               WHEN len(triggers) = 1 THEN 'MODERATE' ELSE 'LOW' END AS risk_level,
          CAST(len(triggers) * 10 + symptom_score AS INTEGER) AS risk_score
FROM people2
"""

_R = RECOMMENDATIONS
RECS = f"""list_filter([
  CASE WHEN wqi_class IN {_HIGH} THEN {_lit(_R["avoid_source"])} END,
  CASE WHEN wqi_class IN {_HIGH} THEN {_lit(_R["purifier"])} END,
  CASE WHEN lower(has_toilet) IN {_NEG} THEN {_lit(_R["sanitation"])} END,
  CASE WHEN list_contains(symptoms, 'Kidney Disease') OR list_contains(symptoms, 'Bone Disease')
       THEN {_lit(_R["kidney_bone"])} END,
  CASE WHEN list_contains(symptoms, 'Jaundice') OR list_contains(symptoms, 'Diarrhea')
         OR list_contains(symptoms, 'Dysentery') THEN {_lit(_R["waterborne"])} END,
  CASE WHEN list_contains(symptoms, 'Anemia') OR list_contains(symptoms, 'Weight Loss')
       THEN {_lit(_R["nutrition"])} END,
  CASE WHEN risk_level IN ('CRITICAL', 'HIGH') THEN {_lit(_R["phc"])} END,
  CASE WHEN risk_level IN ('CRITICAL', 'HIGH') THEN {_lit(_R["report"])} END,
  {_lit(_R["boil"])}, {_lit(_R["wash"])}], lambda x: x IS NOT NULL)"""


# ------------------------------------------------------------------ ML frame

ML_FEATURES = ["ph", "turbidity", "chloride", "sulphate", "nitrate", "fluoride", "do", "bod", "iron"]


def hash_long_sql(expr: str, seed: str = "0", offset: int = 1) -> str:
    return f"CAST(('0x' || substr(md5('{seed}|' || {expr}), {offset}, 15)) AS BIGINT)"


def unit_hash_sql(expr: str, seed: str = "42") -> str:
    return f"({hash_long_sql(expr, seed)} / {D(16 ** 15)})"


ML = f"""
SELECT key, water_type, site, year, ph, turbidity, chloride, sulphate,
       CASE WHEN {hash_long_sql('key')} % 7 = 0 THEN NULL ELSE nitrate END AS nitrate,
       fluoride, "do", bod,
       CASE WHEN {hash_long_sql('key')} % 11 = 0 THEN NULL ELSE iron END AS iron,
       wqi, CASE WHEN water_type = 'ground' THEN {GW_CLASS.format(x='wqi')} ELSE {SW_CLASS.format(x='wqi')} END
         AS label
FROM (SELECT water_type || '|' || site || '|' || CAST(year AS VARCHAR) AS key, water_type, site, year,
             {", ".join(f'avg("{p}") AS "{p}"' for p in ML_FEATURES)}, avg(wqi) AS wqi
      FROM scored GROUP BY water_type, site, year) t
"""


# ------------------------------------------------------------------ predictions

EVAL_MODELS = {"drop_nitrate": "nitrate", "drop_turbidity": "turbidity"}
_GW_ALL = list(GW_TERMS)
_SW_ALL = ["ph", "do", "bod", "turbidity", "nitrate"]


def _pred_sql() -> str:
    parts = []
    for pos, (m, drop) in enumerate(EVAL_MODELS.items()):
        gw = gw_wqi_sql([p for p in _GW_ALL if p != drop])
        sw = sw_wqi_sql([p for p in _SW_ALL if p != drop])
        parts.append(
            f"SELECT l_orderkey, l_linenumber, water_type, '{m}' AS model, {pos} AS pos, wqi AS actual, "
            f"CASE WHEN water_type = 'ground' THEN {gw} ELSE {sw} END AS predicted, wqi_class AS actual_class "
            f"FROM scored")
    body = " UNION ALL ".join(parts)
    return (f"SELECT *, CASE WHEN water_type = 'ground' THEN {GW_CLASS.format(x='predicted')} "
            f"ELSE {SW_CLASS.format(x='predicted')} END AS predicted_class FROM ({body}) u")


PRED = _pred_sql()


def with_views(body: str, *names: str, extra: dict | None = None) -> str:
    """Prefix ``body`` with the named views as CTEs (dependencies first)."""
    defs = {"readings": READINGS, "scored": SCORED, "profile": PROFILE, "raw": RAW,
            "clean1": CLEAN1, "clean2": CLEAN2, "people": PEOPLE, "people1": PEOPLE1,
            "people2": PEOPLE2, "sp": SCORED_PEOPLE, "ml": ML, "pred": PRED}
    deps = {"scored": {"readings"}, "profile": {"scored"}, "raw": {"readings"},
            "clean1": {"raw"}, "clean2": {"clean1"}, "people1": {"people"},
            "people2": {"people1"}, "sp": {"people2"}, "ml": {"scored"}, "pred": {"scored"}}
    order = ["readings", "scored", "profile", "raw", "clean1", "clean2", "people", "people1",
             "people2", "sp", "ml", "pred"]
    need = set(names)
    while True:
        more = set().union(*[deps.get(n, set()) for n in need]) - need
        if not more:
            break
        need |= more
    ctes = [f"{n} AS ({defs[n]})" for n in order if n in need]
    ctes += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    b = body.lstrip()
    if b[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + b[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
