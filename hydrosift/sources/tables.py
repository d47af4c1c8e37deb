"""Scans and sinks (A1-A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a lazy Parquet scan (filters and projections push down)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv_readings(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """CSV readings with every column as string (A1); typing happens in cleaning."""
    return (spark.read.option("header", header).option("inferSchema", False)
            .option("mode", "PERMISSIVE").csv(path))


def read_stage(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a stage written by an earlier step (A2)."""
    return spark.read.format(fmt).option("header", True).load(path)


#: One respondent of the survey form; symptoms are a list of names.
SURVEY_SCHEMA = ("id long, name string, age int, gender string, education string, employment string, family_size int, "
                 "nearest_site string, wqi_class string, water_source string, water_quality string, has_toilet string, "
                 "uses_purifier string, washes_hands string, kitchen_fuel string, uses_disinfectant string, "
                 "health_status string, symptoms array<string>, visited_doctor string, on_medication string, "
                 "risk string, risk_score int, neighborhood_issues string")


def read_survey(spark: SparkSession, path: str) -> DataFrame:
    """Survey responses as JSON lines under the form's schema (A5): absent
    fields are NULL, an absent or NULL symptom list is empty."""
    rows = spark.read.schema(SURVEY_SCHEMA).json(path)
    return survey_form(rows)


def survey_form(df: DataFrame) -> DataFrame:
    """Survey-form columns under the names the survey operators read."""
    none = F.array().cast("array<string>")
    return df.withColumnsRenamed({"id": "person_id", "risk": "risk_level", "water_source": "drinking_water_source",
                                  "water_quality": "drinking_water_quality"}).withColumn(
        "symptoms", F.coalesce("symptoms", none))


def write_stage(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write a stage or metric table (A3, A4)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
