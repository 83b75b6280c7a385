"""Registered queries over records, sources, sinks and flows, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shape, text
from ..operators import detections, knn, lookup, metrics, polygons, tiles
from ..sources import readers, writers
from . import localize
from .registry import _ANGLES, _BOUNDS, _FINE, _FINE_SQL, _PLACES, _POINTS, _RANKED, _SIDES, _bundle_sql, _matches_sql, _near_sql, _opening_sql, _places, _triangle, query, rounded, t

# ---- sources and sinks -----------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS num, 'img_' || c_custkey || '.jpg' AS filename, '2023-06-01' AS date, round(c_acctbal / 100, 6) AS lat, CAST(c_nationkey AS DOUBLE) AS lon,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 400.5 END AS height FROM customer""")
def flight_lines(spark, sf_dir):
    """Lines of flight metadata, apart by blanks or commas; a field that is no number is null."""
    height = F.when(F.col("c_custkey") % 5 == 0, "none").otherwise("400.5")
    fields = [F.col("c_custkey").cast("string"), F.concat(F.lit("img_"), "c_custkey", F.lit(".jpg")), F.lit("2023-06-01"), (F.col("c_acctbal") / 100).cast("string"), F.col("c_nationkey").cast("string"), height]
    blanks, commas = F.concat(F.lit("  "), F.concat_ws("   ", *fields)), F.concat_ws(" , ", *fields)
    lines = t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, blanks).otherwise(commas).alias("value"))
    return rounded(readers.parse_poses(lines).select("c_custkey", "num", "filename", "date", "lat", "lon", "height"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events")
def nan_to_null(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return readers.no_nan(rows)


@query("""SELECT d.doc_id, l.quality AS first, 2 AS n FROM documents d
JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id HAVING min(toxic) = 0) l USING (doc_id)""")
def cached_descriptors(spark, sf_dir):
    """Documents with their cached vectors, by file stem; empty and missing ones drop out."""
    labels = t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    cached = labels.select(F.concat(F.lit("cache/"), "doc_id", F.lit(".npy")).alias("image"), F.when(F.col("toxic") == 0, F.array("quality", "toxic")).otherwise(F.array().cast("array<int>")).alias("descriptors"))
    images = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("photos/"), "doc_id", F.lit(".jpg")).alias("image"))
    return readers.cached_of(images, cached, "descriptors").select("doc_id", F.col("descriptors")[0].alias("first"), F.size("descriptors").alias("n"))


@query("SELECT page_id, page_id || '.tar' AS stem FROM pages")
def file_stems(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", text.stem(F.concat(F.lit("a/b.c/"), "page_id", F.lit(".tar.gz"))).alias("stem"))


@query("""SELECT c_custkey, round(round_even(c_custkey / 7.0, 4), 4) AS t_total, round(round_even(c_custkey / 7.0, 1), 1) AS pred_px_x, round(round_even(c_custkey / 7.0, 2), 2) AS error_m, round(c_custkey / 7.0, 6) AS lat FROM customer""")
def stored_rounding(spark, sf_dir):
    value = F.col("c_custkey") / 7.0
    rows = t(spark, sf_dir, "customer").select("c_custkey", *(value.alias(c) for c in ("t_total", "pred_px_x", "error_m")), F.round(value, 6).alias("lat"))
    return writers.stored(rows)


# Labels of variants, as in functions/text.py (fixed values).
@query(r"""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'Full 5-D CDT, $\ell_2$ distance' WHEN 1 THEN 'Top-1 match (no voting)' WHEN 2 THEN 'Distance-weighted voting' WHEN 3 THEN 'Interior angles only ($\alpha_1,\alpha_2$)'
  WHEN 4 THEN 'MFCA only ($e_1,e_2,e_3$)' WHEN 5 THEN '$K=' || o_custkey || '$' WHEN 6 THEN 'Full 5-D CDT, $D_{\max}=' || o_custkey || '$' ELSE 'heading\_noise\_' || o_custkey END AS label FROM orders""")
def variant_labels(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("l2_distance", "top1_no_voting", "distance_weighted", "interior_angles_only", "mfca_only", "K=", "Dmax=", "heading_noise_")))
    kind = F.get(kinds, (F.col("o_orderkey") % 8).cast("int"))
    name = F.when(F.col("o_orderkey") % 8 < 5, kind).otherwise(F.concat(kind, F.col("o_custkey")))
    return t(spark, sf_dir, "orders").select("o_orderkey", text.variant_label(name).alias("label"))


@query("SELECT DISTINCT o_orderpriority AS variant FROM orders WHERE o_orderpriority IS NOT NULL")
def variants_present(spark, sf_dir):
    return readers.variant_names(t(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "variant"))


@query("""SELECT 'img_' || l_orderkey AS filename, l_linenumber AS seed_triangle_idx, 0 AS vertex_0_idx, 1 AS vertex_1_idx, 2 AS vertex_2_idx, l_quantity AS vertex_0_x, l_discount AS vertex_0_y, l_tax AS vertex_1_x, l_quantity AS vertex_1_y, l_discount AS vertex_2_x, l_tax AS vertex_2_y,
  l_quantity AS ekeland_v0, 0.0 AS ekeland_v1, l_tax AS ekeland_v2, 'Unknown' AS axis_v0, l_returnflag AS axis_v1, 'Unknown' AS axis_v2, round((l_quantity + 0.0 + l_tax) / 3, 9) AS mean_ekeland, l_suppkey AS expansion_steps, l_partkey AS num_triangles_in_region, l_linenumber AS num_boundary_vertices FROM lineitem""")
def expansion_table(spark, sf_dir):
    nested = t(spark, sf_dir, "lineitem").selectExpr("concat('img_', l_orderkey) as filename", "l_linenumber as seed_triangle_idx", "array(0, 1, 2) as vertices", "array(array(l_quantity, l_discount), array(l_tax, l_quantity), array(l_discount, l_tax)) as coordinates",
        "map(0, l_quantity, 2, l_tax) as angles", "map(1, l_returnflag) as axes", "l_suppkey as expansion_steps", "l_partkey as num_triangles_in_region", "l_linenumber as num_boundary_vertices")
    return writers.flat_expansions(nested).withColumn("mean_ekeland", F.round("mean_ekeland", 9))


@query("""SELECT user_id AS image, '{"image":' || user_id || ',"n":' || count(*) || ',"first":' || min(event_id) || '}' AS json FROM events GROUP BY user_id""")
def result_json(spark, sf_dir):
    found = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("image")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return localize.as_json(found)


@query("""SELECT '{' || string_agg('"' || event_type || '":{"n":' || n || ',"most":' || most || '}', ',' ORDER BY event_type) || '}' AS report FROM (SELECT event_type, count(*) AS n, max(user_id) AS most FROM events WHERE event_type IS NOT NULL GROUP BY event_type)""")
def report_json(spark, sf_dir):
    found = t(spark, sf_dir, "events").where("event_type is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.max("user_id").alias("most"))
    return writers.to_report(found, ["event_type"])


# ---- tiles, samples, sets --------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN n_chars <= 500 THEN 1 ELSE CAST(ceil((n_chars - 500) / 100) AS BIGINT) + 1 END AS n, CASE WHEN n_chars <= 500 THEN 0 ELSE CAST(n_chars AS BIGINT) - 500 END AS last FROM documents")
def training_tiles(spark, sf_dir):
    starts = tiles.training_starts(F.col("n_chars").cast("int"), 500, 100)
    return t(spark, sf_dir, "documents").select("doc_id", F.size(starts).cast("long").alias("n"), F.array_max(starts).cast("long").alias("last"))


@query("""WITH d AS (SELECT doc_id, 4 AS rows, greatest(1, CAST(ceil(greatest(n_chars - 500, 0) / 100) AS BIGINT) + 1) AS cols FROM documents) SELECT doc_id, CAST(least(3, rows * cols) AS BIGINT) AS n FROM d""")
def tiles_limited(spark, sf_dir):
    maps = t(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lit(750).alias("h"))
    return tiles.tile_grid(maps, "doc_id", "n_chars", "h", limit=3).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT source, doc_id FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) <= 5")
def sample_by_lot(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select("source", "doc_id").where("source is not null")
    return lookup.hash_sample(rows, "doc_id", 5, 7, "source")


@query("SELECT event_id FROM events WHERE value / 500 >= 0.5 OR CAST('0x' || substr(md5('0:' || event_id), 1, 8) AS BIGINT) < CAST(0.25 * 4294967296 AS BIGINT)")
def foreground_or_chance(spark, sf_dir):
    return lookup.foreground_or_chance(t(spark, sf_dir, "events"), "event_id", F.col("value") / 500, 0.5, 0.25).select("event_id")


@query("""WITH f AS (SELECT user_id AS site, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5), c AS (SELECT site, count(*) AS n FROM f GROUP BY site),
b AS (SELECT site, coalesce(sum(n) OVER (ORDER BY site ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT site, event_id FROM f JOIN b USING (site) WHERE before < 20""")
def query_pool(spark, sf_dir):
    return detections.query_pool(t(spark, sf_dir, "events").select(F.col("user_id").alias("site"), "event_id"), "site", "event_id")


@query("SELECT event_id, value FROM events WHERE value >= 250")
def confident_detections(spark, sf_dir):
    return detections.confident(t(spark, sf_dir, "events").select("event_id", "value"), 250, "value")


@query("SELECT user_id, max(event_id % 10) AS a, max(event_id % 7) AS b, max(event_id % 5) AS c, max(event_id % 3) AS d FROM events GROUP BY user_id")
def combined_masks(spark, sf_dir):
    rows = t(spark, sf_dir, "events").selectExpr("user_id", "array(array(event_id % 10, event_id % 7), array(event_id % 5, event_id % 3)) as mask")
    m = detections.combined_mask(rows, ["user_id"])
    return m.selectExpr("user_id", "mask[0][0] as a", "mask[0][1] as b", "mask[1][0] as c", "mask[1][1] as d")


@query("SELECT event_id, i AS polygon_idx, i + 2 AS points FROM events, (VALUES (1), (2)) v(i)")
def exploded_polygons(spark, sf_dir):
    """Polygons of 2, 3 and 4 points; those under three drop out, numbers stay."""
    point = "array(cast(event_id as double), 1.0D)"
    rows = t(spark, sf_dir, "events").selectExpr("event_id", f"array(array_repeat({point}, 2), array_repeat({point}, 3), array_repeat({point}, 4)) as polygons")
    return polygons.explode_polygons(rows).select("event_id", "polygon_idx", F.size("polygon").alias("points"))


# ---- records and flows -----------------------------------------------------------------------------------------------


@query(f"SELECT {_bundle_sql('value')} FROM events WHERE user_id % 7 > 0 AND user_id % 5 <> 0")
def evaluable_metrics(spark, sf_dir):
    rows = t(spark, sf_dir, "events").selectExpr("value as error_m", "user_id % 7 as n_descriptors", "if(user_id % 5 = 0, null, user_id) as gt_px_x")
    return rounded(metrics.metrics_by(metrics.evaluable(rows, True)))


@query("SELECT user_id AS site, count(*) AS n_triangles, count(DISTINCT event_type) AS n_patches_with_buildings FROM events WHERE event_type IS NOT NULL GROUP BY user_id")
def build_totals(spark, sf_dir):
    return localize.build_totals(t(spark, sf_dir, "events").where("event_type is not null").selectExpr("user_id as site", "event_type as patch"))


@query("""WITH s AS (SELECT label AS site, count(*) AS n, count(DISTINCT vec_id // 10) AS p FROM embeddings GROUP BY label), r AS (SELECT *, row_number() OVER (ORDER BY site) AS place, count(*) OVER () AS total FROM s),
c AS (SELECT DISTINCT least(k, total) AS sites FROM r, (VALUES (1), (3), (1000000)) v(k)) SELECT CAST(sites AS BIGINT) AS sites, CAST(sum(n) AS BIGINT) AS n_descriptors, CAST(sum(p) AS BIGINT) AS n_patches, round(sum(n) * 32 / 1048576.0, 1) AS mb FROM r JOIN c ON place <= sites GROUP BY sites""")
def scalability(spark, sf_dir):
    rows = t(spark, sf_dir, "embeddings").selectExpr("label as site", "vec_id div 10 as patch")
    return localize.scalability(rows).withColumn("sites", F.col("sites").cast("long"))


@query(f"""WITH {_PLACES}, x AS (SELECT *, CAST(greatest(0, least(1999, round_even((lon - 114.0) / (114.06 - 114.0) * 1999, 0))) AS BIGINT) AS gx, CAST(greatest(0, least(1699, round_even((lat - 30.0) / (29.95 - 30.0) * 1699, 0))) AS BIGINT) AS gy, c_custkey % 2000 AS px, c_custkey % 1700 AS py FROM c)
SELECT c_custkey, gx AS gt_px_x, gy AS gt_px_y, round(30.0 + py / 1699.0 * (29.95 - 30.0), 9) AS pred_lat, round(114.0 + px / 1999.0 * (114.06 - 114.0), 9) AS pred_lon, CASE WHEN c_custkey % 2 = 0 THEN 'summer' ELSE 'other' END AS season, '400-700' AS alt_band,
  round(sqrt(((px - gx) * radians(0.06) * 6378137.0 * cos(radians((30.0 + 29.95) / 2)) / 2000) ** 2 + ((py - gy) * radians(0.05) * 6378137.0 / 1700) ** 2), 4) AS error_m FROM x""")
def locate_places(spark, sf_dir):
    """Predicted pixels to degrees, true places to pixels, error, season and band, by the flow that locates images."""
    rows, b = _places(spark, sf_dir)
    names = ("lt_lat", "lt_lon", "rb_lat", "rb_lon", "sat_width", "sat_height")
    sites = spark.range(1).select(F.lit("01").alias("site"), *(F.lit(v).alias(n) for v, n in zip(_BOUNDS, names)))
    results = rows.selectExpr("c_custkey", "'01' as site", "cast(c_custkey as string) as image", "cast(c_custkey % 2000 as double) as pred_px_x", "cast(c_custkey % 1700 as double) as pred_px_y")
    poses = rows.selectExpr("cast(c_custkey as string) as image", "lat", "lon", "450.0D as height", "if(c_custkey % 2 = 0, '2023-07-01', '2023/02/03') as date")
    found = localize.locate(results, sites, poses)
    return found.select("c_custkey", *(F.col(c).cast("long").alias(c) for c in ("gt_px_x", "gt_px_y")), F.round("pred_lat", 9).alias("pred_lat"), F.round("pred_lon", 9).alias("pred_lon"), "season", "alt_band", F.round("error_m", 4).alias("error_m"))


@query(f"""WITH {_matches_sql(_FINE_SQL, rest=True)}, {_RANKED},
w AS (SELECT image, max(CASE WHEN rank = 1 THEN patch END) AS winner, max(votes) AS votes, coalesce(max(CASE WHEN rank = 2 THEN votes END), 0) AS runner_up, CAST(sum(votes) AS BIGINT) AS total_votes, count(*) AS n_voted FROM r GROUP BY image),
a AS (SELECT vec_id // 10 AS patch, avg(CAST(embedding[1] AS DOUBLE)) AS x, avg(CAST(embedding[2] AS DOUBLE)) AS y FROM embeddings WHERE vec_id % 20 <> 0 GROUP BY ALL)
SELECT w.image, winner, votes, runner_up, votes - runner_up AS margin, total_votes, n_voted, round(x, 5) AS pred_px_x, round(y, 5) AS pred_px_y FROM w JOIN a ON a.patch = w.winner""")
def locate_by_votes(spark, sf_dir):
    """The query flow: K nearest descriptors, votes, ranks and the winner's centre, for stated queries against the rest."""
    rows = t(spark, sf_dir, "embeddings").selectExpr("vec_id", "vec_id div 100 as image", f"{_FINE.replace('index_id', 'vec_id')} as patch", "embedding as vec", "double(embedding[0]) as centroid_x", "double(embedding[1]) as centroid_y")
    index = rows.where("vec_id % 20 <> 0").withColumnRenamed("vec_id", "descriptor_id")
    patches = index.groupBy("patch").agg(F.avg("centroid_x").alias("centroid_x"), F.avg("centroid_y").alias("centroid_y"))
    found = localize.query_images(rows.where("vec_id % 20 = 0").selectExpr("image", "vec_id as query_id", "vec"), index.select("descriptor_id", "patch", "vec"), patches)
    return found.select("image", "winner", "votes", "runner_up", "margin", "total_votes", "n_voted", F.round("pred_px_x", 5).alias("pred_px_x"), F.round("pred_px_y", 5).alias("pred_px_y"))


# ---- geometry --------------------------------------------------------------------------------------------------------


@query(f"""WITH {_POINTS}, {_SIDES}, {_ANGLES}, o AS (SELECT *, (x1-x0)*(y2-y0) - (x2-x0)*(y1-y0) AS area2 FROM h),
e AS (SELECT *, CASE WHEN area2 > 0 THEN list_sort([{_opening_sql(2, 0, 1)}, {_opening_sql(0, 1, 2)}, {_opening_sql(1, 2, 0)}]) ELSE list_sort([{_opening_sql(1, 0, 2)}, {_opening_sql(2, 1, 0)}, {_opening_sql(0, 2, 1)}]) END AS e FROM o WHERE area2 <> 0)
SELECT vec_id, 0 AS triangle_idx, round(t[1], 2) AS alpha1, round(t[2], 2) AS alpha2, round(e[1], 2) AS e1, round(e[2], 2) AS e2, round(e[3], 2) AS e3, round((x0+x1+x2)/3, 2) AS centroid_x, round((y0+y1+y2)/3, 2) AS centroid_y FROM e""")
def triangle_polygons(spark, sf_dir):
    """The polygon operator on polygons of three corners, which leave it no choice."""
    df, points = _triangle(spark, sf_dir)
    rows = df.select("vec_id", F.array(*(F.array(x, y) for x, y in points)).alias("polygon"))
    found = polygons.polygon_descriptors(rows, kind="double")
    return found.select("vec_id", "triangle_idx", *(F.round(c, 2).alias(c) for c in ("alpha1", "alpha2", "e1", "e2", "e3", "centroid_x", "centroid_y")))


@query(f"""WITH {_POINTS}, n AS (SELECT *, (y1-y0) / (sqrt((x1-x0)**2+(y1-y0)**2) + 1e-10) AS ax, -(x1-x0) / (sqrt((x1-x0)**2+(y1-y0)**2) + 1e-10) AS ay, (y2-y1) / (sqrt((x2-x1)**2+(y2-y1)**2) + 1e-10) AS bx, -(x2-x1) / (sqrt((x2-x1)**2+(y2-y1)**2) + 1e-10) AS by_ FROM p)
SELECT vec_id, round(CASE WHEN sqrt((ax+bx)**2+(ay+by_)**2) < 1e-6 THEN ax ELSE (ax+bx) / sqrt((ax+bx)**2+(ay+by_)**2) END, 5) AS x, round(CASE WHEN sqrt((ax+bx)**2+(ay+by_)**2) < 1e-6 THEN ay ELSE (ay+by_) / sqrt((ax+bx)**2+(ay+by_)**2) END, 5) AS y FROM n""")
def outward_bisectors(spark, sf_dir):
    df, (p, q, r) = _triangle(spark, sf_dir)
    x, y = shape.outward_bisector(p, q, r)
    return rounded(df.select("vec_id", x.alias("x"), y.alias("y")), 5)


@query("SELECT l_orderkey, l_linenumber, round((0.002 + 0.018 * sqrt(greatest(0.0, least(1.0, l_extendedprice / 50000.0)))) * l_quantity, 6) AS tolerance FROM lineitem")
def adaptive_tolerances(spark, sf_dir):
    value = shape.adaptive_tolerance(F.col("l_extendedprice"), F.lit(50000.0), F.col("l_quantity"))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(value, 6).alias("tolerance"))


@query(f"WITH {_near_sql(1)} SELECT query_id, index_id, round(distance, 6) AS distance FROM m")
def nearest_descriptor(spark, sf_dir):
    rows = t(spark, sf_dir, "embeddings").withColumnsRenamed({"vec_id": "index_id", "embedding": "vec"})
    found = knn.knn_join(rows.where("index_id % 20 = 0").withColumnRenamed("index_id", "query_id"), rows, 1, skip_same_id=True)
    return rounded(found.select("query_id", "index_id", "distance"))
