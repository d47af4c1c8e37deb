"""Readings, people, points and event views over the driver tables.

The driver tables are a TPC-H-like star schema.  These views give them the
shape the operators expect; every rule is a plain expression of key columns,
so the same views are written once more in SQL for the DuckDB oracle
(``hydrosift.plans.sql_views``).

readings   lineitem JOIN part: one water-quality reading per line item
raw_readings  readings as raw text with censoring tokens and junk injected
people     customer JOIN nation LEFT JOIN (urgent orders -> symptoms)
points     embeddings: 64-d feature vectors with a class label
event_readings  events as timestamped ground-water readings (streaming input)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrosift.sources.lookups import SITE_WQI_CLASS, SYMPTOM_WEIGHTS
from hydrosift.sources.tables import table

# Site-name stems used to label stations (one stem per supplier key modulo 7).
SITE_STEMS = ["Ghaggar River", "Yamuna River", "Markanda River", "Agra Canal",
              "Teekar Taal", "Karan Lake ", "Brahma Sarovar"]
PARAMS = ["ph", "turbidity", "chloride", "sulphate", "nitrate", "fluoride", "do", "bod", "iron"]
GW_PARAM_MAP = {"ph": "ph", "turbidity": "turbidity", "chloride": "chloride",
                "sulphate": "sulphate", "nitrate": "nitrate", "fluoride": "fluoride", "iron": "iron"}
SW_PARAM_MAP = {"pH": "ph", "DO": "do", "BOD": "bod", "Turbidity": "turbidity", "Nitrate": "nitrate"}
WATER_SOURCES = {"AUTOMOBILE": "River", "BUILDING": "Tube well", "FURNITURE": "Tap water",
                 "HOUSEHOLD": "Hand pump", "MACHINERY": "Open well"}


def site_name(station_key: Column, water_type: Column) -> Column:
    stem = F.element_at(F.array(*[F.lit(s) for s in SITE_STEMS]),
                        (F.pmod(station_key, F.lit(7)) + 1).cast("int"))
    n = (F.floor(station_key / 7) + 1).cast("long").cast("string")
    wt = F.when(water_type == "ground", "Ground Water").otherwise("Surface Water")
    return F.concat(stem, F.lit("(Site "), n, F.lit(") ("), wt, F.lit(")"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    j = li.join(part, li.l_partkey == part.p_partkey)
    wt = F.when(F.col("l_linestatus") == "O", "ground").otherwise("surface")
    return j.select(
        "l_orderkey", "l_linenumber",
        site_name(F.col("l_suppkey"), wt).alias("site"),
        F.year("l_shipdate").cast("int").alias("year"),
        wt.alias("water_type"),
        (6 + 30 * F.abs("l_discount")).alias("ph"),
        (F.col("l_quantity") / 6).alias("turbidity"),
        (F.col("l_extendedprice") / 250).alias("chloride"),
        (F.col("p_size") * 6.0).alias("sulphate"),
        F.nullif(F.abs("l_tax") * 1000, F.lit(80.0)).alias("nitrate"),
        F.when(F.col("l_linenumber") == 2, F.lit(None).cast("double"))
         .otherwise(F.pmod("l_partkey", F.lit(25)) / 10).alias("fluoride"),
        (2 + F.col("p_size") / 5).alias("do"),
        (F.col("l_quantity") / 10).alias("bod"),
        (F.pmod("l_orderkey", F.lit(80)) / 50).alias("iron"),
    )


RAW_COLUMNS = ["Site", "Year", "pH", "Turbidity", "Chloride (ppm)", "Sulphates(ppm)",
               "Nitrate(ppm)", "Fluorides(ppm)", "Iron (ug/l)", "DO(ppm)", "BOD(ppm)", "Remarks"]


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as the raw sheet would hold them: all text, mixed-case names,
    padded site names, censoring tokens, junk, blank cells, sparse rows, iron in ug/l
    and an empty column."""
    r = readings(spark, sf_dir)
    k = F.col("l_orderkey")
    sparse = F.pmod(k, F.lit(31)) == 0

    def s(c: str) -> Column:
        return F.col(c).cast("string")

    def tok(cond, token, c):
        return F.when(cond, F.lit(token)).otherwise(c)

    return r.select(
        F.col("l_orderkey"), F.col("l_linenumber"),
        F.concat(F.lit("  "), F.col("site"), F.lit(" ")).alias("Site"),
        tok(F.pmod(k, F.lit(101)) == 0, "n/a", s("year")).alias("Year"),
        tok(sparse | (F.pmod(k, F.lit(17)) == 0), "ND", s("ph")).alias("pH"),
        tok(sparse | (F.pmod(k, F.lit(13)) == 0), "-", s("turbidity")).alias("Turbidity"),
        tok(sparse | (F.pmod(k, F.lit(11)) == 0), "nd", s("chloride")).alias("Chloride (ppm)"),
        tok(sparse | (F.pmod(k, F.lit(19)) == 0), "NO", s("sulphate")).alias("Sulphates(ppm)"),
        tok(F.pmod(k, F.lit(23)) == 0, "abc", s("nitrate")).alias("Nitrate(ppm)"),
        tok(sparse, "no", s("fluoride")).alias("Fluorides(ppm)"),
        tok(F.col("l_linenumber") == 7, "no", (F.col("iron") * 1000).cast("string")).alias("Iron (ug/l)"),
        tok(sparse | (F.pmod(k, F.lit(29)) == 0), " ", s("do")).alias("DO(ppm)"),
        tok(sparse, "-", s("bod")).alias("BOD(ppm)"),
        F.lit(None).cast("string").alias("Remarks"),
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One questionnaire row per customer.

    Site text names a site keyword (or none, or two); water source comes from
    the market segment; quality and toilet from the account balance; each
    urgent order reports the symptom ``pmod(o_orderkey, 20)``.
    """
    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation is a fixed 25-row table: broadcasting it has a proven size bound.
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    urgent = (table(spark, sf_dir, "orders")
              .where(F.col("o_orderpriority") == "1-URGENT")
              .select("o_custkey", F.pmod("o_orderkey", F.lit(20)).cast("int").alias("sym"))
              .groupBy("o_custkey").agg(F.collect_set("sym").alias("sym_ids")))
    keys = F.array(*[F.lit(k) for k, _ in SITE_WQI_CLASS])
    nk = F.col("c_nationkey")
    idx = F.pmod(nk, F.lit(15))
    key_a = F.try_element_at(keys, (idx + 1).cast("int"))
    key_b = F.try_element_at(keys, (F.pmod(nk + 5, F.lit(14)) + 1).cast("int"))
    ck = F.col("c_custkey")
    site = (F.when(F.pmod(ck, F.lit(53)) == 0, F.lit(None).cast("string"))
             .when(F.pmod(ck, F.lit(41)) == 0, F.concat(key_b, F.lit(" / "), F.coalesce(key_a, F.col("n_name"))))
             .when(idx < 14, F.concat(key_a, F.lit(", "), F.col("n_name")))
             .otherwise(F.concat(F.col("n_name"), F.lit(" village"))))
    src = None
    for seg, label in WATER_SOURCES.items():
        src = F.when(F.col("c_mktsegment") == seg, label) if src is None else src.when(
            F.col("c_mktsegment") == seg, label)
    src = src.otherwise("Unknown")
    bal = F.col("c_acctbal")
    sym_ids = F.coalesce(F.col("sym_ids"), F.array().cast("array<int>"))
    symptom_cols = [F.array_contains(sym_ids, i).alias(name)
                    for i, (name, _) in enumerate(SYMPTOM_WEIGHTS)]
    return (cust.join(nation, cust.c_nationkey == nation.n_nationkey)
            .join(urgent, cust.c_custkey == urgent.o_custkey, "left")
            .select(
                ck.alias("person_id"),
                F.col("c_name").alias("name"),
                (18 + F.pmod(ck, F.lit(60))).cast("int").alias("age"),
                F.when(F.pmod(ck, F.lit(2)) == 0, "Male").otherwise("Female").alias("gender"),
                F.when(F.pmod(ck, F.lit(5)) == 0, F.lit(""))
                 .otherwise(F.concat(F.lit("resident"), ck.cast("string"), F.lit("@example.org")))
                 .alias("email"),
                site.alias("nearest_site"),
                src.alias("drinking_water_source"),
                F.when(bal < 0, "Unsatisfactory").when(bal < 1500, "Unfiltered")
                 .otherwise("Satisfactory").alias("drinking_water_quality"),
                F.when(F.pmod(ck, F.lit(37)) == 0, F.lit(None).cast("string"))
                 .when(bal < 0, "No").otherwise("Yes").alias("has_toilet"),
                F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "no")
                 .otherwise("Yes").alias("uses_purifier"),
                F.when(bal > 5000, "Yes").otherwise("No").alias("visited_doctor"),
                (2 + F.pmod(ck, F.lit(7))).cast("int").alias("family_size"),
                *symptom_cols,
            ))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors (array<double>) with an integer class label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("key"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("features"),
                    F.col("label").cast("int").alias("label"))


def event_readings(events: DataFrame) -> DataFrame:
    """Timestamped ground-water readings from an events stream or table."""
    v = F.col("value")
    uid = F.col("user_id")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        site_name(uid, F.lit("ground")).alias("site"),
        (6.5 + v / 250).alias("ph"),
        (v / 10).alias("turbidity"),
        (v * 3).alias("chloride"),
        F.when(F.col("event_type") == "error", v).alias("nitrate"),
        (v / 100).alias("iron"),
    )
