"""Cleaning: projections, filters and predicates.

Each operator is ``DataFrame -> DataFrame`` (use with ``df.transform``).
Schema decisions (which columns exist, which are empty) are driver-side
metadata; data-dependent decisions read one aggregated row.
Cell rules are plain conditional expressions, so a chain of them fuses into one
generated expression per column over the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def evaluated(df: DataFrame) -> DataFrame:
    """The same columns, computed once per row from here on.

    A filter on computed columns is otherwise pushed below the projection with
    every expression copied into it.  Producing the row through a one-element
    generator stops that, stays inside generated code and writes nothing."""
    return df.select(F.inline(F.array(F.struct(*[_q(c).alias(c) for c in df.columns]))))


def normalize_name(name: str, style: str = "snake") -> str:
    s = str(name)
    if style == "snake":
        return s.strip().lower().replace(" ", "_")
    if style == "strip":
        return s.strip()
    if style == "lower":
        return s.lower()
    if style == "symbols":
        return s.strip().lower().replace(" ", "_").replace("(", "").replace(")", "").replace("/", "_")
    raise ValueError(f"unknown style {style!r}")


def normalize_names(df: DataFrame, style: str = "snake") -> DataFrame:
    """Rename every column (B1): 'snake' = trim, lower, space->_; also 'strip',
    'lower', 'symbols' (snake plus drop parentheses and '/'->'_')."""
    return df.toDF(*[normalize_name(c, style) for c in df.columns])


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Raise ``ValueError`` if a key column is missing (B2)."""
    for c in cols:
        if c not in df.columns:
            raise ValueError(f"Missing required column: {c}")
    return df


def resolve_column(df: DataFrame, candidates: Sequence[str], tolerant: bool = False) -> str | None:
    """First existing column among spellings (B3); ``tolerant`` ignores case,
    spaces and underscores."""
    for c in candidates:
        if c in df.columns:
            return c
    if tolerant:
        key = {c.lower().replace(" ", "").replace("_", ""): c for c in df.columns}
        for c in candidates:
            hit = key.get(c.lower().replace(" ", "").replace("_", ""))
            if hit:
                return hit
    return None


def drop_all_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with no value at all."""
    return df.na.drop(how="all", subset=list(cols) if cols else None)


def _num(c: Column) -> Column:
    """Text -> double, unparseable -> NULL, NaN -> NULL."""
    x = c.cast("string").try_cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def int_key(df: DataFrame, col: str = "year") -> DataFrame:
    """Coerce to number, drop failures, cast to int."""
    x = _num(_q(col))
    return df.withColumn(col, x).where(_q(col).isNotNull()).withColumn(col, _q(col).cast("int"))


def trim_key(df: DataFrame, col: str = "site") -> DataFrame:
    """String cast and trim."""
    return df.withColumn(col, F.trim(_q(col).cast("string")))


def censored_to_null(df: DataFrame, cols: Sequence[str], tokens: Sequence[str]) -> DataFrame:
    """Exact-match censoring tokens -> NULL."""
    toks = list(tokens)
    return df.withColumns({c: F.when(~_q(c).isin(toks), _q(c)) for c in cols})


def try_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Unparseable -> NULL, as double."""
    return df.withColumns({c: _num(_q(c)) for c in cols})


def drop_sparse_rows(df: DataFrame, cols: Sequence[str], frac: float = 0.7) -> DataFrame:
    """Keep rows with at least ``int(frac * len(cols))`` non-null values."""
    thresh = int(frac * len(cols))
    present = sum((F.when(_q(c).isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    return df.where(present >= thresh)


def convert_unit(df: DataFrame, col: str, divisor: float = 1000.0) -> DataFrame:
    """Divide a column if it exists (B10), e.g. ug/l -> mg/l."""
    return df.withColumn(col, _q(col) / divisor) if col in df.columns else df


def detection_floor(df: DataFrame, floors: Mapping[str, float]) -> DataFrame:
    """Raise values below half the detection limit to ``dl/2``; NULL stays NULL."""
    return df.withColumns({c: F.when(_q(c) < dl / 2, F.lit(dl / 2)).otherwise(_q(c))
                           for c, dl in floors.items() if c in df.columns})


def null_out_of_domain(df: DataFrame, domains: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Values outside ``(lo, hi)`` -> NULL."""
    return df.withColumns({c: F.when((_q(c) >= lo) & (_q(c) <= hi), _q(c))
                           for c, (lo, hi) in domains.items() if c in df.columns})


def drop_empty_columns(df: DataFrame, max_nonnull: int = 0, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop columns with at most ``max_nonnull`` non-null values.

    One aggregation pass produces one row of counts; the drop is a schema change.
    """
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count(_q(c)).alias(c) for c in cols]).first().asDict()
    return df.drop(*[c for c in cols if counts[c] <= max_nonnull])


def drop_leaky_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop named target leaks if present."""
    return df.drop(*[n for n in names if n in df.columns])


def drop_if_correlated(df: DataFrame, col: str, target: str, limit: float = 0.95) -> DataFrame:
    """Drop ``col`` when |corr(col, target)| > limit."""
    if col not in df.columns:
        return df
    r = df.agg(F.corr(_q(col).cast("double"), _q(target).cast("double"))).first()[0]
    return df.drop(col) if r is not None and abs(r) > limit else df


def numeric_features(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """All numeric columns except the target(s)."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Column subset."""
    return df.select(*[_q(c) for c in cols])


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Complete-case filter."""
    return df.na.drop(how="any", subset=list(subset))


def align(df: DataFrame, target: str) -> DataFrame:
    """Keep rows whose target is present (B19): features and target stay in one frame."""
    return df.where(_q(target).isNotNull())


def null_rows(df: DataFrame, col: str) -> DataFrame:
    """Rows where a column is NULL."""
    return df.where(_q(col).isNull())


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns."""
    return df.withColumnsRenamed(dict(mapping))


def bool_to_int(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Boolean -> 0/1."""
    return df.withColumns({c: _q(c).cast("int") for c in cols})


def to_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast to double."""
    return df.withColumns({c: _q(c).cast("double") for c in cols})


def fill_label(df: DataFrame, col: str, value: str = "Unknown") -> DataFrame:
    """NULL label -> constant."""
    return df.withColumn(col, F.coalesce(_q(col), F.lit(value)))


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """First rows for inspection."""
    return df.limit(n)


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns)."""
    return df.count(), len(df.columns)
