"""Shared helpers: size-checked broadcast and stable hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bound on rows we are willing to ship to every executor.
BROADCAST_MAX_ROWS = 200_000


def bounded_rows(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """True when ``df`` holds at most ``max_rows`` rows.

    Reads at most ``max_rows + 1`` rows, so the check itself stays bounded.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def per_group(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """A table of one row per group, computed once (reliably checkpointed) and
    broadcast in later joins if its counted size is bounded; a larger one is
    joined by a shuffle."""
    from hydrosift.session import cut_lineage
    done = cut_lineage(df)
    return F.broadcast(done) if bounded_rows(done, max_rows) else done


def single_key(col: str) -> Column:
    """0 on every row, but not a constant to the optimizer: a join on it stays
    an equality join with the one-row side broadcast, not a cartesian product."""
    return F.pmod(F.hash(col), F.lit(1))


def unit_hash(*cols: Column | str, seed: str = "0") -> Column:
    """Deterministic uniform value in [0, 1) from md5 of the key columns.

    md5 exists in Spark and in SQL engines, so the same draw can be
    re-computed by an independent SQL oracle.  60 bits of the digest are used.
    """
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(c).cast("string") if isinstance(c, str)
                                             else c.cast("string"), F.lit("")) for c in cols]
    h = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long") / F.lit(float(16 ** 15))


def hash_long(*cols: Column | str, seed: str = "0", offset: int = 1) -> Column:
    """60-bit non-negative integer from md5 (hex digits ``offset..offset+14``)."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(c).cast("string") if isinstance(c, str)
                                             else c.cast("string"), F.lit("")) for c in cols]
    h = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(h, offset, 15), 16, 10).cast("long")
