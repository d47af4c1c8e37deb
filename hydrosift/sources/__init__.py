from hydrosift.sources.tables import read_csv_readings, read_stage, table, write_stage  # noqa: F401
