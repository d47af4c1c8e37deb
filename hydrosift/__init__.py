"""hydrosift: water-quality analytics as Spark DataFrame operators.

Layout:
  sources/    table readers, constant lookup tables, views over the driver tables
  functions/  Column -> Column expressions (indices, classes, text helpers)
  operators/  DataFrame -> DataFrame operators (cleaning, statistics, ranking,
              lookups, survey scoring, ML preparation, models, evaluation)
  plans/      composed end-to-end flows and the registry of checked queries
  streaming/  Structured Streaming alert flow
"""

__version__ = "0.1.0"
