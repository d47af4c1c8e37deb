"""The six sample people of the study's form (values computed from its rules)."""

from hydrosift.operators import survey as SV
from hydrosift.sources.lookups import SYMPTOM_WEIGHTS

FIELDS = [n for n, _ in SYMPTOM_WEIGHTS]


def person(pid, site, source, quality, toilet, purifier, symptoms, email="x@example.org"):
    row = {"person_id": pid, "name": f"Person {pid}", "age": 30 + pid, "gender": "Female", "email": email,
           "nearest_site": site, "drinking_water_source": source, "drinking_water_quality": quality,
           "has_toilet": toilet, "uses_purifier": purifier}
    row.update({f: (f in symptoms) for f in FIELDS})
    return row


DROP_21 = {"diarrhea_blood", "kidney_disease", "jaundice", "malnutrition", "fever", "depression"}
PEOPLE = [
    person(1, "Near Ratia town", "Tube well", "Satisfactory", "Yes", "No",
           {"diarrhea", "fever", "anemia", "vomiting", "bone_disease"}),
    person(2, "Faridabad sector 3", "River", "Unsatisfactory", "No", "No", set(FIELDS) - DROP_21),
    person(3, "Karan Lake colony", "Tap water", "Satisfactory", "Yes", "Yes", {"anemia"}),
    person(4, "faridabad", "River", "unfiltered", "yes", "yes",
           {"diarrhea", "kidney_disease", "fever", "vomiting", "nausea", "abdominal_pain", "anemia"}),
    person(5, "FARIDABAD", "river bank", "Unsatisfactory", "Yes", "no", {"fever", "vomiting", "nausea"}),
    person(6, "Somewhere else", "Surface water", "Satisfactory", "Yes", "Yes", set(), email=""),
    # extra edge cases: exactly two triggers with a low score; a single 4-point symptom; one trigger
    person(7, "Unknown place", "River", "Unsatisfactory", "Yes", "Yes", {"depression"}),
    person(8, "Unknown place", "Tap", "Satisfactory", "Yes", "Yes", {"bone_disease"}),
    person(9, "Unknown place", "Tap", "Satisfactory", "No", "Yes", set()),
    person(10, None, None, None, None, None, set()),
    # two keys in one text: the first key in lookup order wins (Kaushalaya Dam -> Good)
    person(11, "Sonipat / Kaushalaya Dam", "Tap", "Satisfactory", "Yes", "Yes", set()),
]


def scored(spark):
    cols = list(PEOPLE[0])
    df = spark.createDataFrame([tuple(p[c] for c in cols) for p in PEOPLE],
                               ", ".join(f"{c} {'int' if c in ('person_id', 'age') else 'boolean' if c in FIELDS else 'string'}"
                                         for c in cols))
    return SV.score_people(df)


def test_sample_people(spark):
    out = {r.person_id: r for r in scored(spark).collect()}
    expect = {1: (4, 5, 14, "CRITICAL", 54), 2: (6, 14, 39, "CRITICAL", 99), 3: (0, 1, 3, "LOW", 3),
              4: (4, 7, 19, "CRITICAL", 59), 5: (5, 3, 6, "CRITICAL", 56), 6: (0, 0, 0, "LOW", 0),
              7: (2, 1, 1, "HIGH", 21), 8: (0, 1, 4, "HIGH", 4), 9: (1, 0, 0, "MODERATE", 10),
              10: (0, 0, 0, "LOW", 0)}
    for pid, (nt, ns, sc, lvl, rs) in expect.items():
        r = out[pid]
        assert (len(r.triggers), r.symptom_count, r.symptom_score, r.risk_level, r.risk_score) == (nt, ns, sc, lvl, rs), pid
    assert out[6].wqi_class == "Unknown" and out[1].wqi_class == "Very Poor"
    assert out[11].wqi_class == "Good"
    assert out[1].triggers[0] == "Lives near Very Poor WQI site (Near Ratia town)"
    assert out[1].symptoms == ["Diarrhea", "Fever", "Anemia", "Vomiting", "Bone Disease"]


def test_summaries(spark):
    s = scored(spark)
    dist = {r.risk_level: r.n for r in SV.risk_distribution(s).collect()}
    assert dist == {"CRITICAL": 4, "HIGH": 2, "MODERATE": 1, "LOW": 4}
    box = SV.alert_outbox(s).collect()
    # 6 flagged people; person emails are all non-empty among the flagged
    assert sum(1 for r in box if r.recipient_kind == "authority") == 6
    assert sum(1 for r in box if r.recipient_kind == "person") == 6
    assert SV.run_summary(s).first().flagged == 6
    ft = SV.flagged_table(s, 8).collect()
    assert [r.person_id for r in ft] == [1, 2, 4, 5, 7, 8]
    tot = SV.survey_totals(s).first()
    assert tot.respondents == 11 and tot.n_critical == 4
    rec = {r.person_id: r.recommendations for r in SV.recommendations(s).collect()}
    assert rec[6] == ["Boil drinking water for at least 1 minute before consumption.",
                      "Wash hands with soap before eating and after using toilet."]
    assert len(rec[2]) == 10
    san = {(r.person_id, r.parameter): r.status for r in SV.sanitation_status(s).collect()}
    assert san[(4, "Water Quality")] == "OK" and san[(2, "Water Quality")] == "Risk"


def test_large_lookup_tables_are_joined(spark, monkeypatch):
    from hydrosift.operators import lookup as LK
    from hydrosift.sources import lookups as L
    coords = spark.createDataFrame(L.site_coords_rows(), "pos int, key string, water_type string, lat double, lon double")
    df = spark.createDataFrame([(r[1] + " x", r[2]) for r in L.site_coords_rows()] + [("nowhere", "ground"), (None, "surface")],
                               "site string, water_type string")
    want = sorted(map(str, LK.match_site(df, coords=coords).collect()))
    monkeypatch.setattr(LK, "MAX_LOOKUP_ROWS", 1)
    assert sorted(map(str, LK.match_site(df, coords=coords).collect())) == want
