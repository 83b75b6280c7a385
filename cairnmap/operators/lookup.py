"""Lookups by key and by similar name, resume, and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .order import places


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``; groups of any size meet in partial aggregates, not in one task."""
    columns = [c for c in rows.columns if c not in (key,)]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(order)).alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in columns))


def pose_of(images: DataFrame, poses: DataFrame, order: str | None = None) -> DataFrame:
    """images (image) with the first pose of its file name, null where there is none.  Poses as flight_metadata() reads them
    have their lines' ``position``; others come in ``order``, or in that of ``num``."""
    order = order or ("position" if "position" in poses.columns else "num")
    unique = first_per_key(poses.where("filename is not null"), "filename", order).drop("position")
    return images.withColumn("filename", F.trim(text.base_name(F.col("image")))).join(unique, "filename", "left")


def pose_required(images: DataFrame, poses: DataFrame, order: str | None = None) -> DataFrame:
    """As pose_of; an image without a pose is an error."""
    known = poses.select("filename", F.lit(True).alias("_known")).distinct()
    found = pose_of(images, poses, order).join(known, "filename", "left")
    fail = F.raise_error(F.concat(F.lit("no pose for "), F.col("image"))).cast("boolean")
    return found.where(F.when(F.col("_known").isNull(), fail).otherwise(True)).drop("_known")


def not_done(images: DataFrame, records: DataFrame, key: str = "image") -> DataFrame:
    """Images that have no record yet."""
    return images.join(records.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def pairs_by_name(images: DataFrame, masks: DataFrame, name: str = "name") -> DataFrame:
    return images.join(masks, name)


def grams(text_: str, size: int):
    """The distinct pieces of ``size`` characters of a column; none if it is shorter."""
    return F.expr(f"if(length(`{text_}`) < {size}, array(), array_distinct(transform(sequence(1, length(`{text_}`) - {size - 1}), i -> substring(`{text_}`, i, {size}))))")


def containing(parts: DataFrame, part: str, wholes: DataFrame, whole: str, order: str, size: int = 3) -> DataFrame:
    """(part, whole): for each distinct text ``part`` the first whole text, by ``order``, that contains it.

    An inverted index of pieces of ``size`` characters: a text has as many as characters.  A part looks up its rarest piece
    only and is compared with the texts that have it; a shorter part is a piece itself, the empty one is in all texts."""
    asked = parts.select(part).where(F.col(part).isNotNull()).distinct()
    texts = wholes.select(whole, F.col(order).alias("_o"))
    short = None
    for n in range(1, size):
        each = texts.select(F.explode(grams(whole, n)).alias(part), whole, "_o")
        short = each if short is None else short.unionByName(each)
    none = texts.select(F.lit("").alias(part), whole, "_o")
    short = (none if short is None else none.unionByName(short)).groupBy(part).agg(F.min_by(whole, "_o").alias(whole))
    index = texts.select(whole, "_o", F.explode(grams(whole, size)).alias("_g"))
    wanted = asked.where(F.length(part) >= size).select(part, F.explode(grams(part, size)).alias("_g"))
    counts = index.groupBy("_g").agg(F.count("*").alias("_c"))
    rarest = wanted.join(counts, "_g", "left").groupBy(part).agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), F.col("_g").alias("g"))).alias("_r"))
    long = rarest.where("_r.c > 0").select(part, F.col("_r.g").alias("_g")).join(index, "_g").where(F.contains(whole, part))
    long = long.groupBy(part).agg(F.min_by(whole, "_o").alias(whole))
    return asked.where(F.length(part) < size).join(short, part).unionByName(long)


def match_bounds(names: DataFrame, bounds: DataFrame, name: str = "name", map_: str = "map", order: str = "pos") -> DataFrame:
    """names with the row of bounds of the most similar map name: equal normal forms (with or without the prefix
    "satellite"), else the same last number, else containment; the first row by ``order`` of the first way that hits.
    All three are equi-joins on a form, a number or a piece of a map name, so no name meets all maps.  No hit: nulls."""
    plain = lambda c: F.regexp_replace(c, "^satellite", "")
    left = names.withColumn("_n", text.normal_name(F.col(name))).withColumn("_p", plain(F.col("_n"))).withColumn("_id", text.numeric_id(F.col("_n")))
    right = bounds.withColumn("_mn", text.normal_name(F.col(map_))).withColumn("_mp", plain(F.col("_mn"))).withColumn("_mid", text.numeric_id(F.col("_mn")))
    # Of equal forms and of equal numbers only the first row of bounds can win, so no group of them is paired.
    row = F.struct(*bounds.columns)
    first = lambda df, key: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, order).alias("_row"), F.min(order).alias(order))
    forms_l = left.select(name, F.explode(F.array_distinct(F.array("_n", "_p"))).alias("_f"))
    forms_r = first(right.select("*", F.explode(F.array_distinct(F.array("_mn", "_mp"))).alias("_f")), "_f")
    tier1 = forms_l.join(forms_r, "_f").select(name, F.lit(1).alias("tier"), order, "_row")
    tier2 = left.join(first(right, "_mid"), F.col("_id") == F.col("_mid")).select(name, F.lit(2).alias("tier"), order, "_row")
    hit = tier1.unionByName(tier2)
    missed = left.join(hit.select(name).distinct(), name, "left_anti")
    maps = first(right, "_mn")
    forms_m = missed.select(name, F.explode(F.array_distinct(F.array("_n", "_p"))).alias("_f"))
    tier3 = forms_m.join(containing(forms_m, "_f", maps, "_mn", order), "_f").select(name, "_mn").distinct().join(maps, "_mn").select(name, F.lit(3).alias("tier"), order, "_row")
    best = hit.unionByName(tier3).groupBy(name).agg(F.min_by("_row", F.struct("tier", order)).alias("_row"), F.min("tier").alias("tier"))
    return names.join(best, name, "left").select(*names.columns, "tier", *(F.col(f"_row.{c}").alias(c) for c in bounds.columns if c not in names.columns))


def first_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each key by ``order``.  Up to 1,000 rows, tasks cut their own before rows move."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def signs(images: DataFrame, key: str, order: str) -> DataFrame:
    """images with sign +1, -1, +1, ... by their position in the key, which may hold any share of the images."""
    placed = places(images.drop("sign"), [key], [order], "_place")
    return placed.withColumn("sign", F.when(F.col("_place") % 2 == 0, 1).otherwise(-1)).drop("_place")


def lot(key, seed: int = 0) -> Column:
    """A lot for each key: md5 of seed and key, the same in every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 0, within: str | None = None) -> DataFrame:
    """n rows (of each ``within``) in the order of their keys' lots."""
    if within is None:
        return rows.orderBy(lot(key, seed), key).limit(n)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(within).orderBy(lot(key, seed), key))).where(F.col("_r") <= n).drop("_r")


def foreground_or_chance(rows: DataFrame, key: str, ratio: Column, least: float, chance: float, seed: int = 0) -> DataFrame:
    """Rows with enough foreground, and by their keys' lots a share of the others."""
    drawn = F.conv(F.substring(lot(key, seed), 1, 8), 16, 10).cast("long") < int(chance * 2**32)
    return rows.where((ratio >= least) | drawn)
