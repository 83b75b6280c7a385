"""Names, ids and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(base_name(name), r"(?<=.)\.[^.]*$", "")


def normal_name(name: Column) -> Column:
    """File stem in lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(stem(name))), "[^a-z0-9]+", "")


def numeric_id(name: Column) -> Column:
    """The last run of digits without leading zeros ("0" for zeros only); null without digits."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+)"))
    return F.when(F.size(runs) > 0, F.regexp_replace(F.element_at(runs, -1), r"^0+(?!$)", ""))


def patch_id(prefix: Column, row: Column, col: Column) -> Column:
    return F.format_string("%s_%04d_%04d", prefix, row.cast("int"), col.cast("int"))


def variant_name(kind: str, amount: float) -> str:
    """Name of an evaluation variant: heading noise in degrees, ground-resolution error in per cent."""
    if kind == "heading_noise":
        return f"heading_noise_{round(amount)}"
    if kind == "gsd_error":
        return f"gsd_error_{round((amount - 1) * 100):+d}"
    raise ValueError(f"unknown variant {kind!r}")


#: Labels of variants in tables (fixed values).
VARIANT_LABELS = {
    "l2_distance": r"Full 5-D CDT, $\ell_2$ distance",
    "top1_no_voting": r"Top-1 match (no voting)",
    "distance_weighted": r"Distance-weighted voting",
    "interior_angles_only": r"Interior angles only ($\alpha_1,\alpha_2$)",
    "mfca_only": r"MFCA only ($e_1,e_2,e_3$)",
}


def variant_label(name: Column) -> Column:
    """A variant's label in TeX; K=5 and Dmax=4 as formulas, other names with escaped underscores."""
    fixed = F.create_map(*(F.lit(x) for pair in VARIANT_LABELS.items() for x in pair))
    value = F.split_part(name, F.lit("="), F.lit(2))
    formula = F.when(name.startswith("K="), F.concat(F.lit("$K="), value, F.lit("$"))).when(name.startswith("Dmax="), F.concat(F.lit(r"Full 5-D CDT, $D_{\max}="), value, F.lit("$")))
    return F.coalesce(F.try_element_at(fixed, name), formula, F.replace(name, F.lit("_"), F.lit(r"\_")))


def number(value: Column, digits: int = 1) -> Column:
    """Fixed digits; --- for null and non-finite values."""
    finite = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) != float("inf"))
    return F.when(finite, F.format_string(f"%.{digits}f", value.cast("double"))).otherwise("---")


def tex(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("_"), F.lit(r"\_")), F.lit("%"), F.lit(r"\%"))
