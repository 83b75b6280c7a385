"""Conversions between map pixels, degrees and metres, and the scalar parts of image preparation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0


def _span(a: Column, b: Column) -> Column:
    return F.when(a == b, F.raise_error(F.lit("map bounds have a zero span")).cast("double")).otherwise(b - a)


def lat_lon_to_pixel(lat, lon, lt_lat, lt_lon, rb_lat, rb_lon, width, height, clip: bool = True) -> tuple[Column, Column]:
    """Pixel (x, y) of a place; halves round to even; ``clip`` keeps it on the map.  A zero span is an error."""
    x = F.rint((lon - lt_lon) / _span(lt_lon, rb_lon) * F.greatest(width - 1, F.lit(1))).cast("int")
    y = F.rint((lat - lt_lat) / _span(lt_lat, rb_lat) * F.greatest(height - 1, F.lit(1))).cast("int")
    if clip:
        x, y = F.greatest(F.lit(0), F.least(x, width - 1)), F.greatest(F.lit(0), F.least(y, height - 1))
    return x, y


def pixel_to_lat_lon(x, y, lt_lat, lt_lon, rb_lat, rb_lon, width, height) -> tuple[Column, Column]:
    return lt_lat + y / F.greatest(height - 1, F.lit(1)) * (rb_lat - lt_lat), lt_lon + x / F.greatest(width - 1, F.lit(1)) * (rb_lon - lt_lon)


def ground_resolution(lt_lat, lt_lon, rb_lat, rb_lon, width, height) -> tuple[Column, Column, Column]:
    """Metres a pixel along x and y, and their mean."""
    m_x = F.abs(F.radians(rb_lon - lt_lon)) * EARTH_RADIUS * F.cos(F.radians((lt_lat + rb_lat) / 2)) / F.greatest(width, F.lit(1))
    m_y = F.abs(F.radians(rb_lat - lt_lat)) * EARTH_RADIUS / F.greatest(height, F.lit(1))
    return m_x, m_y, (m_x + m_y) / 2


def error_metres(dx, dy, m_x, m_y) -> Column:
    return F.hypot(dx * m_x, dy * m_y)


def altitude_band(height: Column) -> Column:
    """[400, 700), [700, 1200), [1200, 2000); unknown without a finite height; other elsewhere."""
    inside = lambda a, b: (height >= a) & (height < b)
    return F.when(height.isNull() | F.isnan(height) | (F.abs(height) == float("inf")), "unknown").when(inside(400, 700), "400-700").when(inside(700, 1200), "700-1200").when(inside(1200, 2000), "1200-2000").otherwise("other")


DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy:MM:dd HH:mm:ss")


def season(date: Column) -> Column:
    """summer for June to August, autumn for September to November, other for other dates, unknown for no date."""
    at = F.coalesce(*(F.try_to_timestamp(date.cast("string"), F.lit(f)) for f in DATE_FORMATS), F.try_to_timestamp(date.cast("string")))
    return season_of_month(F.month(at))


def season_of_month(month: Column) -> Column:
    return F.when(month.isNull(), "unknown").when(month.between(6, 8), "summer").when(month.between(9, 11), "autumn").otherwise("other")


def preparation(height, pitch, roll, yaw, reference: float = 400.0, scale_error: float = 1.0, yaw_noise=0.0, use_heading: bool = True) -> dict[str, Column]:
    """Parameters of a photo's preparation: scale by altitude, crop by pitch, rotation by roll and yaw."""
    none = F.lit(0.0)
    return {
        "scale": reference / F.greatest(height, F.lit(1.0)) * scale_error,
        "pitch_factor": F.when(F.cos(F.radians(F.abs(pitch))) > 0.1, F.cos(F.radians(F.abs(pitch)))).otherwise(1.0),
        "roll_applied": F.when(F.abs(roll) > 0.5, roll).otherwise(none),
        "yaw_applied": (yaw + yaw_noise) if use_heading else none,
    }


def zoom_window(px, py, gx, gy, width, height, zoom: int = 600) -> tuple[Column, Column, Column, Column]:
    """Crop (x0, y0, x1, y1) around two points, on the map."""
    radius = F.greatest(F.lit(float(zoom)), F.ceil(F.hypot(px - gx, py - gy) / 2) + 600)
    mx, my = (px + gx) / 2, (py + gy) / 2
    at = lambda v, top: F.greatest(F.lit(0), F.least(v.cast("int"), F.lit(top) if isinstance(top, int) else top))
    return at(mx - radius, width), at(my - radius, height), at(mx + radius, width), at(my + radius, height)


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1)."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    both, area = side(0, 2) * side(1, 3), lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return both / (area(a) + area(b) - both + 1e-6)
