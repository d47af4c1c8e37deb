"""Small text / coordinate helpers as Column expressions (E3, E4, J1 tokens)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrosift.sources.lookups import SHORT_SITE_SUFFIXES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def short_site(site, max_len: int | None = None, drop_suffixes: bool = True) -> Column:
    """Text before the first '(' trimmed; drop the water-body suffix words; cut."""
    s = F.trim(F.substring_index(_c(site).cast("string"), "(", 1))
    if drop_suffixes:
        for suf in SHORT_SITE_SUFFIXES:
            s = F.replace(s, F.lit(suf), F.lit(""))
        s = F.trim(s)
    if max_len is not None:
        s = F.substring(s, 1, max_len)
    return s


def dms_to_decimal(d, m, s, direction) -> Column:
    """degrees + minutes/60 + seconds/3600, negative for S/W, rounded to 6."""
    v = _c(d).cast("double") + _c(m).cast("double") / 60 + _c(s).cast("double") / 3600
    return F.round(F.when(_c(direction).isin("S", "W"), -v).otherwise(v), 6)


def site_tokens(site) -> Column:
    """Distinct lower-case whitespace tokens after removing parentheses."""
    s = F.lower(F.trim(_c(site).cast("string")))
    s = F.translate(s, "()", "")
    return F.array_distinct(F.filter(F.split(s, r"\s+"), lambda t: t != ""))
