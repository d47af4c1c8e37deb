"""Lookups that are joins in substance (J1-J5) and set operations (K1, K2).

A lookup table of checked, bounded size is embedded into the plan as a
literal array of structs; matching is then a per-row expression inside
whole-stage codegen: no join, no shuffle of the big side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrosift.functions.text import site_tokens
from hydrosift.operators.common import bounded_rows, per_group
from hydrosift.session import cut_lineage
from hydrosift.sources import lookups as L

MAX_LOOKUP_ROWS = 10_000


def _rows(table, cols: Sequence[str]) -> list[tuple]:
    """Rows of a small lookup given as a list or a DataFrame of checked size."""
    if isinstance(table, DataFrame):
        if not bounded_rows(table, MAX_LOOKUP_ROWS):
            raise ValueError(f"lookup table exceeds {MAX_LOOKUP_ROWS} rows; join it instead")
        return [tuple(r[c] for c in cols) for r in table.orderBy("pos").collect()]
    return list(table)


def _tokens_py(s: str) -> list[str]:
    out = []
    for t in str(s).lower().strip().replace("(", "").replace(")", "").split():
        if t not in out:
            out.append(t)
    return out


def match_site(df: DataFrame, site: str = "site", water_type: str = "water_type",
               coords=None, min_shared: int = 2) -> DataFrame:
    """Best coordinate key per site by shared lower-case tokens.

    Only keys of the same water type compete; at least ``min_shared`` shared
    tokens are needed; the first key wins ties.  Adds ``matched_key``, ``lat``,
    ``lon`` (NULL when unmatched).
    """
    if isinstance(coords, DataFrame) and not bounded_rows(coords, MAX_LOOKUP_ROWS):
        return _match_by_tokens(df, site, water_type, coords, min_shared)
    rows = _rows(coords, ["pos", "key", "water_type", "lat", "lon"]) if coords is not None \
        else L.site_coords_rows()
    cands = F.array(*[F.struct(F.lit(pos).alias("pos"), F.lit(key).alias("key"),
                               F.lit(wt).alias("wt"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon"),
                               F.array(*[F.lit(t) for t in _tokens_py(key)]).alias("tok"))
                      for pos, key, wt, lat, lon in rows])
    toks = site_tokens(F.col(site))
    scored = F.transform(
        F.filter(cands, lambda c: c["wt"] == F.col(water_type)),
        lambda c: F.struct(F.size(F.array_intersect(c["tok"], toks)).alias("score"),
                           (-c["pos"]).alias("neg_pos"), c["key"].alias("key"),
                           c["lat"].alias("lat"), c["lon"].alias("lon")))
    best = F.array_max(scored)
    ok = best["score"] >= min_shared
    return df.withColumns({
        "matched_key": F.when(ok, best["key"]),
        "lat": F.when(ok, best["lat"]),
        "lon": F.when(ok, best["lon"]),
    })


def _match_by_tokens(df: DataFrame, site: str, water_type: str, coords: DataFrame, min_shared: int) -> DataFrame:
    """``match_site`` for a table of any size: sites and keys meet on their
    tokens, shared tokens are counted, and the best key is joined back."""
    keys = coords.select("pos", "key", "lat", "lon", F.col("water_type").alias("__wt"),
                         F.explode(site_tokens(F.col("key"))).alias("__t"))
    sites = df.select(F.col(site).alias("__s"), F.col(water_type).alias("__wt")).distinct()
    met = sites.select("*", F.explode(site_tokens(F.col("__s"))).alias("__t")).join(keys, ["__wt", "__t"])
    counted = met.groupBy("__s", "__wt", "pos", "key", "lat", "lon").agg(F.count(F.lit(1)).alias("__n"))
    best = counted.where(F.col("__n") >= min_shared).groupBy("__s", "__wt").agg(F.max_by(
        F.struct("key", "lat", "lon"), F.struct(F.col("__n"), -F.col("pos"))).alias("__b"))
    out = df.join(best, (df[site] == best["__s"]) & (df[water_type] == best["__wt"]), "left")
    return out.select(*df.columns, F.col("__b.key").alias("matched_key"), F.col("__b.lat").alias("lat"), F.col("__b.lon").alias("lon"))


def nearest_site_class(df: DataFrame, site: str = "nearest_site", classes=None, default: str = "Unknown",
                       out: str = "wqi_class", max_literal: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """Class of the first key (lookup order) contained, case-insensitively, in
    the site text (J2); ``default`` when none is.  A table of more than
    ``max_literal`` keys is joined instead of embedded, with the same result."""
    if isinstance(classes, DataFrame) and not bounded_rows(classes, max_literal):
        return _class_by_grams(df, site, classes, default, out)
    rows = _rows(classes, ["key", "wqi_class"]) if classes is not None else L.SITE_WQI_CLASS
    cands = F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(c).alias("c")) for k, c in rows if k is not None])
    text = F.lower(F.trim(F.col(site).cast("string")))
    hits = F.filter(cands, lambda c: F.contains(text, c["k"]))
    return df.withColumn(out, F.coalesce(F.try_element_at(hits, F.lit(1))["c"], F.lit(default)))


def _grams(text: Column, n: Column) -> Column:
    """Distinct character n-grams of a text; none of a shorter one."""
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                                                          lambda i: text.substr(i, n)))).otherwise(F.array().cast("array<string>"))


def _class_by_grams(df: DataFrame, site: str, classes: DataFrame, default: str, out: str, size: int = 3) -> DataFrame:
    """``nearest_site_class`` for a table of any size.  Different site texts list
    their grams of 1 to ``size`` characters; a key meets the texts that list its
    rarest gram (a key of fewer characters is its own gram), containment is
    checked, and each text's first key is joined back.  An empty key is
    contained in every text, a NULL key or text matches nothing."""
    rows = df.withColumn("__t", F.lower(F.trim(F.col(site).cast("string"))))
    texts = rows.select("__t").where(F.col("__t").isNotNull()).distinct()
    listed = cut_lineage(texts.select("__t", F.explode(F.concat(*[_grams(F.col("__t"), F.lit(n)) for n in range(1, size + 1)])).alias("__g")))
    keys = classes.select("pos", F.lower("key").alias("__k"), F.col("wqi_class").alias("__c"))
    spread = cut_lineage(listed.groupBy("__g").agg(F.count(F.lit(1)).alias("__n")))
    own = keys.select("*", F.explode(_grams(F.col("__k"), F.least(F.length("__k"), F.lit(size)))).alias("__g")).where("__k <> ''")
    rarest = own.join(spread, "__g", "left").groupBy("pos", "__k", "__c").agg(
        F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__g").alias("g"))).alias("__r"))
    rarest = cut_lineage(rarest.where("__r.n > 0").select("pos", "__k", "__c", F.col("__r.g").alias("__g")))
    met = listed.join(rarest, "__g").where(F.contains("__t", "__k"))
    best = per_group(met.groupBy("__t").agg(F.min(F.struct("pos", F.col("__c").alias("c"))).alias("__b")))
    empty = keys.where("__k = ''").agg(F.min(F.struct("pos", F.col("__c").alias("c"))).alias("b")).first()["b"]
    joined = rows.join(best, "__t", "left")
    found = F.col("__b.c")
    if empty is not None:
        found = F.when(F.col("__t").isNotNull() & (F.col("__b").isNull() | (F.col("__b.pos") > empty["pos"])),
                       F.lit(empty["c"])).otherwise(found)
    return joined.withColumn(out, F.coalesce(found, F.lit(default))).drop("__t", "__b")


def compare_models(gw: DataFrame, sw: DataFrame, constants: DataFrame | None = None,
                   model: str = "model") -> DataFrame:
    """Inner match of ground- and surface-water metric rows by model, plus the
    per-model constants with defaults 0.5 / 0.8 (J3)."""
    g = gw.select(model, *[F.col(c).alias(f"gw_{c}") for c in gw.columns if c != model])
    s = sw.select(model, *[F.col(c).alias(f"sw_{c}") for c in sw.columns if c != model])
    j = g.join(s, model)
    if constants is None:
        constants = L.model_constants_df(gw.sparkSession)
    j = j.join(F.broadcast(constants), model, "left")  # fixed 7-row table
    return j.withColumns({
        "interpretability": F.coalesce("interpretability", F.lit(0.5)),
        "cv_stability": F.coalesce("cv_stability", F.lit(0.8)),
    })


def reindex(df: DataFrame, col: str, order: Sequence[str], value: str = "n",
            fill: int = 0, drop_missing: bool = False) -> DataFrame:
    """Fixed category order; missing categories filled with ``fill``.

    The category list is a literal of known length, so this is a narrow
    projection over an already aggregated table plus a tiny order table.
    """
    spark = df.sparkSession
    ordered = spark.createDataFrame([(i, c) for i, c in enumerate(order)], f"pos int, {col} string")
    j = F.broadcast(ordered).join(df, col, "left")
    j = j.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))
    if drop_missing:
        j = j.where(F.col(value) != fill)
    return j


def append(*dfs: DataFrame) -> DataFrame:
    """Stack frames by column name (K1)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def pool(tagged: dict[str, DataFrame], tag: str = "water_type") -> DataFrame:
    """Both water types' values in one set, tagged (K2)."""
    return append(*[d.withColumn(tag, F.lit(k)) for k, d in tagged.items()])
