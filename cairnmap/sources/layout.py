"""Where the files of a site lie."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from .readers import first_existing

#: Names of the sites (fixed values).
SITES = ("01", "02", "03", "04", "05", "06", "07", "08", "09", "10", "11")


@dataclass(frozen=True)
class Site:
    """Input files of a site under a data root."""

    root: str
    name: str

    @property
    def map_image(self) -> str:
        return f"{self.root}/{self.name}/satellite{self.name}.tif"

    @property
    def photos(self) -> str:
        return f"{self.root}/{self.name}/drone"

    @property
    def poses(self) -> str:
        return f"{self.root}/{self.name}/{self.name}.csv"

    @property
    def bounds(self) -> str:
        return f"{self.root}/satellite_coordinates_range.csv"

    def photo(self, file: str) -> str:
        return f"{self.photos}/{file}"


@dataclass(frozen=True)
class Results:
    """Tables under an output root; each holds all sites, partitioned by site."""

    root: str

    def table(self, name: str) -> str:
        if name not in ("descriptors", "polygons", "meta", "image_polygons", "image_descriptors", "records", "report", "index"):
            raise ValueError(f"no table {name!r}")
        return f"{self.root}/{name}"


def present_sites(spark: SparkSession, root: str) -> list[str]:
    """Sites whose map is there, on any file system Spark reads."""
    return [name for name in SITES if first_existing(spark, Site(root, name).map_image)]
