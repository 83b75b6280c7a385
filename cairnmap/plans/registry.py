"""All registered queries over the test tables, with their DuckDB counterparts.

The tables stand for the engine's own: embeddings for descriptors (label or vec_id div 10 = patch, vec_id div 100 = image;
queries are the rows whose vec_id is divisible by 20, against all other rows), events and orders for evaluation records,
documents for maps, customers for places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance, geo, shape, text
from ..operators import detections, knn, knn_index, lookup, metrics, order, polygons, tiles, vote
from ..sources import readers, shared
from . import localize, surface

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


# ---- retrieval -------------------------------------------------------------------------------------------------------


def _near(spark, sf_dir, k, p=1, dims=None) -> DataFrame:
    rows = t(spark, sf_dir, "embeddings").withColumnsRenamed({"vec_id": "index_id", "embedding": "vec"})
    asked = rows.where("index_id % 20 = 0").withColumnRenamed("index_id", "query_id")
    return knn.knn_join(asked, rows, k, p, dims=dims, carry=("label",), skip_same_id=True)


def _near_sql(k: int, p: int = 1, dims: str = "", rest: bool = False) -> str:
    """The k nearest of the stated queries among all other rows or, with ``rest``, among those that are no queries."""
    term = "abs(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))"
    total = f"list_sum(list_transform(list_zip(q.embedding{dims}, i.embedding{dims}), lambda x: {term if p == 1 else f'{term} * {term}'}))"
    return f"""near AS (SELECT q.vec_id AS query_id, i.vec_id AS index_id, i.label, {total if p == 1 else f'sqrt({total})'} AS distance
  FROM embeddings q JOIN embeddings i ON q.vec_id % 20 = 0 AND {"i.vec_id % 20 <> 0" if rest else "i.vec_id <> q.vec_id"}),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, index_id) AS rank FROM near QUALIFY rank <= {k})"""


def _near_out(k, p=1, dims=""):
    return f"WITH {_near_sql(k, p, dims)} SELECT query_id, index_id, label, round(distance, 6) AS distance, rank FROM m"


def _ids(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("rank", F.col("rank").cast("long")))


@query(_near_out(5))
def knn_l1_k5(spark, sf_dir):
    return _ids(_near(spark, sf_dir, 5))


@query(_near_out(5, 2))
def knn_l2_k5(spark, sf_dir):
    return _ids(_near(spark, sf_dir, 5, 2))


@query(_near_out(20))
def knn_l1_k20(spark, sf_dir):
    return _ids(_near(spark, sf_dir, 20))


@query(_near_out(5, 1, "[1:2]"))
def knn_alpha_slice(spark, sf_dir):
    return _ids(_near(spark, sf_dir, 5, dims=(0, 2)))


@query(_near_out(5, 1, "[3:5]"))
def knn_mfca_slice(spark, sf_dir):
    return _ids(_near(spark, sf_dir, 5, dims=(2, 3)))


def _from_index(spark, sf_dir, k, p=1, dims=None) -> DataFrame:
    """As _near, from an index that is stored first."""
    rows = t(spark, sf_dir, "embeddings").withColumnsRenamed({"vec_id": "index_id", "embedding": "vec"})
    stored = knn_index.build(rows, shared.fresh(spark, "index"), dims=dims, carry=("label",))
    asked = rows.where("index_id % 20 = 0").withColumnRenamed("index_id", "query_id")
    return _ids(knn_index.search(asked, stored, k, p, dims=dims, skip_same_id=True))


_SQL_NEAREST = """SELECT query_id, index_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, index_id) AS rank
FROM nearest(TABLE(SELECT vec_id % 16 AS part, false AS asked, vec_id AS id, embedding AS vec FROM descriptors WHERE vec_id % 20 <> 0
  UNION ALL SELECT part, true, vec_id, embedding FROM descriptors LATERAL VIEW explode(sequence(0, 15)) p AS part WHERE vec_id % 20 = 0) PARTITION BY part ORDER BY (asked DESC), 5, 1)"""


@query(f"WITH {_near_sql(5, rest=True)} SELECT query_id, index_id, round(distance, 6) AS distance, rank FROM m")
def sql_nearest(spark, sf_dir):
    """K-NN as SQL text alone."""
    surface.register(spark)
    t(spark, sf_dir, "embeddings").createOrReplaceTempView("descriptors")
    return _ids(spark.sql(f"SELECT * FROM ({_SQL_NEAREST}) WHERE rank <= 5"))


@query(_near_out(5))
def indexed_knn_l1_k5(spark, sf_dir):
    return _from_index(spark, sf_dir, 5)


@query(_near_out(5, 2))
def indexed_knn_l2_k5(spark, sf_dir):
    return _from_index(spark, sf_dir, 5, 2)


@query(_near_out(20, 1, "[1:5]"))
def indexed_knn_five_components(spark, sf_dir):
    return _from_index(spark, sf_dir, 20, dims=(0, 5))


def _matches(spark, sf_dir, patch: str, k: int = 5) -> DataFrame:
    return _near(spark, sf_dir, k).selectExpr("query_id div 100 as image", f"{patch} as patch", "query_id", "index_id", "distance", "rank")


def _matches_sql(patch: str, k: int = 5, rest: bool = False) -> str:
    return f"{_near_sql(k, rest=rest)}, v AS (SELECT query_id // 100 AS image, {patch} AS patch, query_id, index_id, distance, rank FROM m)"


_FINE, _FINE_SQL = "index_id div 10", "index_id // 10"
_RANKED = """c AS (SELECT image, patch, count(*) AS votes FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY votes DESC, patch) AS rank FROM c)"""
_PLURALITY = _RANKED + """
SELECT image, CAST(max(CASE WHEN rank = 1 THEN patch END) AS BIGINT) AS winner, max(votes) AS votes, coalesce(max(CASE WHEN rank = 2 THEN votes END), 0) AS runner_up,
  CAST(sum(votes) AS BIGINT) AS total_votes, count(*) AS n_voted, max(votes) - coalesce(max(CASE WHEN rank = 2 THEN votes END), 0) AS margin FROM r GROUP BY image"""


@query(f"WITH {_matches_sql('label')}, {_PLURALITY}")
def plurality_vote(spark, sf_dir):
    return vote.plurality(_matches(spark, sf_dir, "cast(label as long)"))


@query(f"WITH {_matches_sql(_FINE_SQL, rest=True)}, {_PLURALITY}")
def sql_votes(spark, sf_dir):
    """K-NN and votes as SQL text alone."""
    surface.register(spark)
    t(spark, sf_dir, "embeddings").createOrReplaceTempView("descriptors")
    return spark.sql(f"SELECT * FROM plurality(TABLE(SELECT query_id div 100 AS image, index_id div 10 AS patch FROM ({_SQL_NEAREST}) WHERE rank <= 5) PARTITION BY image)")


@query(f"WITH {_matches_sql(_FINE_SQL)}, {_PLURALITY}")
def vote_margin(spark, sf_dir):
    return vote.plurality(_matches(spark, sf_dir, _FINE))


@query(f"""WITH {_matches_sql(_FINE_SQL)}, c AS (SELECT image, patch, count(*) AS votes, min(query_id * 100 + rank) AS first FROM v GROUP BY ALL)
SELECT image, arg_max(patch, (votes, -first)) AS winner, max(votes) AS votes FROM c GROUP BY image""")
def plurality_first_match(spark, sf_dir):
    matches = _matches(spark, sf_dir, _FINE).withColumn("ordinal", F.col("query_id") * 100 + F.col("rank"))
    return vote.plurality_first_seen(matches)


@query(f"WITH {_matches_sql(_FINE_SQL)}, c AS (SELECT image, patch, count(*) AS votes FROM v GROUP BY ALL) SELECT image, count(*) AS n_patches, CAST(sum(votes) AS BIGINT) AS votes, max(votes) AS most FROM c GROUP BY image")
def vote_map_size(spark, sf_dir):
    votes = vote.vote_map(_matches(spark, sf_dir, _FINE))
    return votes.select("image", F.size("all_votes").cast("long").alias("n_patches"), F.aggregate(F.map_values("all_votes"), F.lit(0).cast("long"), lambda s, x: s + x).alias("votes"), F.array_max(F.map_values("all_votes")).alias("most"))


@query(f"""WITH {_matches_sql(_FINE_SQL)}, c AS (SELECT image, patch, sum(1 / (1 + distance)) AS weight FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY weight DESC, patch) AS rank FROM c)
SELECT image, max(CASE WHEN rank = 1 THEN patch END) AS winner, round(max(weight), 6) AS weight, round(coalesce(max(CASE WHEN rank = 2 THEN weight END), 0), 6) AS runner_up_weight, CAST(floor(max(weight)) AS BIGINT) AS shown_votes FROM r GROUP BY image""")
def weighted_vote(spark, sf_dir):
    return rounded(vote.weighted(_matches(spark, sf_dir, _FINE)))


@query(f"""WITH {_matches_sql(_FINE_SQL)}, c AS (SELECT image, patch, count(*) AS votes FROM v GROUP BY ALL)
SELECT image, patch, votes, row_number() OVER (PARTITION BY image ORDER BY votes DESC, patch) AS rank FROM c QUALIFY rank <= 10""")
def top_n_patches(spark, sf_dir):
    counts = vote.vote_counts(_matches(spark, sf_dir, _FINE))
    return vote.ranked_votes(counts, n=10).select("image", "patch", "votes", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_matches_sql(_FINE_SQL)}, c AS (SELECT image, patch, count(*) AS votes FROM v GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY image ORDER BY votes DESC) AS gt_rank FROM c), g AS (SELECT DISTINCT vec_id // 100 AS image, vec_id // 100 * 10 AS patch FROM embeddings)
SELECT g.image, g.patch, coalesce(r.votes, 0) AS gt_votes, r.gt_rank FROM g LEFT JOIN r ON r.image = g.image AND r.patch = g.patch""")
def gt_vote_rank(spark, sf_dir):
    truth = t(spark, sf_dir, "embeddings").selectExpr("vec_id div 100 as image", "(vec_id div 100) * 10 as patch").distinct()
    return vote.truth_rank(_matches(spark, sf_dir, _FINE), truth).select("image", "patch", "gt_votes", F.col("gt_rank").cast("long").alias("gt_rank"))


@query(f"WITH {_matches_sql(_FINE_SQL, 1)} SELECT image, arg_min(patch, (distance, query_id, index_id)) AS winner, round(min(distance), 6) AS distance FROM v GROUP BY image")
def top1_no_voting(spark, sf_dir):
    return rounded(vote.top_one(_matches(spark, sf_dir, _FINE, 1)))


@query(f"""WITH {_matches_sql('label', 20)}, w AS (SELECT k, v.* FROM v JOIN (VALUES (1), (3), (5), (10), (20)) s(k) ON v.rank <= s.k),
c AS (SELECT k, image, patch, count(*) AS votes FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k, image ORDER BY votes DESC, patch) AS rank FROM c),
b AS (SELECT k, image, max(CASE WHEN rank = 1 THEN patch END) AS winner FROM r GROUP BY ALL),
l AS (SELECT vec_id // 100 AS image, label, count(*) AS n FROM embeddings GROUP BY ALL), g AS (SELECT image, label FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY n DESC, label) AS o FROM l) WHERE o = 1)
SELECT k, count(*) AS images, round(100 * avg(CASE WHEN winner = label THEN 1 ELSE 0 END), 6) AS accuracy FROM b JOIN g USING (image) GROUP BY k""")
def k_sweep_accuracy(spark, sf_dir):
    found = localize.k_sweep(_matches(spark, sf_dir, "label", 20), (1, 3, 5, 10, 20))
    labels = t(spark, sf_dir, "embeddings").selectExpr("vec_id div 100 as image", "label").groupBy("image", "label").count()
    truth = labels.groupBy("image").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("label"))
    return rounded(found.join(truth, "image").groupBy("k").agg(F.count("*").alias("images"), (100 * F.avg((F.col("winner") == F.col("label")).cast("int"))).alias("accuracy")))


@query("SELECT label AS patch, round(CAST(CAST(avg(CAST(embedding[1] AS DOUBLE)) AS FLOAT) AS DOUBLE), 5) AS centroid_x, round(CAST(CAST(avg(CAST(embedding[2] AS DOUBLE)) AS FLOAT) AS DOUBLE), 5) AS centroid_y, count(*) AS n FROM embeddings GROUP BY label")
def patch_centroids(spark, sf_dir):
    rows = t(spark, sf_dir, "embeddings").select(F.col("label").alias("patch"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    found = vote.patch_centroids(rows)
    return found.select("patch", *(F.round(F.col(c).cast("double"), 5).alias(c) for c in ("centroid_x", "centroid_y")), "n")


@query("""WITH c AS (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS x, avg(CAST(embedding[2] AS DOUBLE)) AS y FROM embeddings GROUP BY label),
p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS px, CAST(embedding[2] AS DOUBLE) AS py FROM embeddings WHERE vec_id % 20 = 0)
SELECT vec_id, arg_min(label, ((px - x) ** 2 + (py - y) ** 2, label)) AS label, round(sqrt(min((px - x) ** 2 + (py - y) ** 2)), 6) AS distance FROM p, c GROUP BY vec_id""")
def nearest_candidate(spark, sf_dir):
    rows = t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("px"), F.col("embedding")[1].cast("double").alias("py"))
    centres = rows.groupBy("label").agg(F.avg("px").alias("cx"), F.avg("py").alias("cy"))
    found = knn.nearest_point(rows.where("vec_id % 20 = 0"), centres, "vec_id", ("px", "py"), "label", ("cx", "cy"))
    return rounded(found.select("vec_id", F.col("label").cast("int").alias("label"), "distance"))


@query(f"WITH {_near_sql(1000)} SELECT query_id, index_id, round(distance, 6) AS score FROM m ORDER BY distance, query_id, index_id LIMIT 1000")
def legacy_topk_pairs(spark, sf_dir):
    rows = t(spark, sf_dir, "embeddings")
    return rounded(knn.top_pairs(rows.where("vec_id % 20 = 0"), rows, 1000, "l1", "vec_id", "vec_id", "embedding", skip_same_id=True))


@query(f"WITH {_near_sql(50, rest=True)} SELECT query_id, index_id, round(distance, 6) AS score FROM near ORDER BY distance, query_id, index_id LIMIT 50")
def top_pairs_l1(spark, sf_dir):
    rows = t(spark, sf_dir, "embeddings")
    return rounded(knn.top_pairs(rows.where("vec_id % 20 = 0"), rows.where("vec_id % 20 <> 0"), 50, "l1", "vec_id", "vec_id", "embedding"))


# ---- distances -------------------------------------------------------------------------------------------------------


def _pair(spark, sf_dir, name: str) -> DataFrame:
    """The first half of each vector against the second, as degrees."""
    half = lambda a: F.transform(F.slice("embedding", a, 32), lambda x: x.cast("double") * 180)
    return rounded(t(spark, sf_dir, "embeddings").select("vec_id", distance.metric(name)(half(1), half(33)).alias("distance")))


def _pair_sql(term: str, after: str = "") -> str:
    """term has x and y for the two components."""
    term = term.replace("{x}", "(CAST(e[1] AS DOUBLE) * 180)").replace("{y}", "(CAST(e[2] AS DOUBLE) * 180)")
    return f"SELECT vec_id, round(list_sum(list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda e: {term})){after}, 6) AS distance FROM embeddings"


_ANGLE = "(CASE WHEN abs({x} - {y}) % 360 <= 180 THEN abs({x} - {y}) % 360 ELSE 360 - abs({x} - {y}) % 360 END)"


@query(_pair_sql("abs({x} - {y})"))
def l1_distance(spark, sf_dir):
    return _pair(spark, sf_dir, "l1")


@query(_pair_sql("({x} - {y}) ** 2").replace("round(list_sum", "round(sqrt(list_sum").replace(")), 6)", "))), 6)", 1))
def l2_distance(spark, sf_dir):
    return _pair(spark, sf_dir, "l2")


@query(_pair_sql(_ANGLE))
def angular_l1(spark, sf_dir):
    return _pair(spark, sf_dir, "angular_l1")


@query(_pair_sql("sqrt(greatest(0.0, 2 * (1 - cos(radians({x} - {y})))))"))
def complex_chord(spark, sf_dir):
    return _pair(spark, sf_dir, "complex_chord")


@query(_pair_sql("1 - cos(radians({x} - {y}))", " / 32"))
def circular_mean(spark, sf_dir):
    return _pair(spark, sf_dir, "circular_mean")


@query(_pair_sql(f"ln(2 * pi() * {distance.bessel_i0(4.0)!r}) - 4 * cos(radians({{x}} - {{y}}))"))
def von_mises(spark, sf_dir):
    return _pair(spark, sf_dir, "von_mises")


# ---- triangles -------------------------------------------------------------------------------------------------------

_POINTS = "p AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * 100 AS {n}" for i, n in enumerate(("x0", "y0", "x1", "y1", "x2", "y2"))) + " FROM embeddings)"
_SIDES = "s AS (SELECT *, sqrt((x1-x2)**2+(y1-y2)**2) AS a, sqrt((x0-x2)**2+(y0-y2)**2) AS b, sqrt((x0-x1)**2+(y0-y1)**2) AS c FROM p)"
_ANGLES = """g AS (SELECT *, degrees(acos(greatest(-1, least(1, (b*b+c*c-a*a)/(2*b*c))))) AS aa, degrees(acos(greatest(-1, least(1, (a*a+c*c-b*b)/(2*a*c))))) AS bb FROM s),
h AS (SELECT *, CASE WHEN a*b*c = 0 THEN [0.0, 0.0, 0.0] ELSE list_sort([aa, bb, 180 - aa - bb]) END AS t FROM g)"""
_OPEN = "least(360 - ((degrees(atan2({b}y-{a}y, {b}x-{a}x)) - degrees(atan2({c}y-{a}y, {c}x-{a}x))) % 360 + 360) % 360, 180)"


def _triangle(spark, sf_dir):
    c = lambda i: F.col("embedding")[i].cast("double") * 100
    return t(spark, sf_dir, "embeddings"), [(c(0), c(1)), (c(2), c(3)), (c(4), c(5))]


@query(f"WITH {_POINTS}, {_SIDES}, {_ANGLES} SELECT vec_id, round(t[1], 6) AS angle_1, round(t[2], 6) AS angle_2, round(t[3], 6) AS angle_3 FROM h")
def interior_angles(spark, sf_dir):
    df, (p, q, r) = _triangle(spark, sf_dir)
    a = shape.interior_angles(p, q, r)
    return rounded(df.select("vec_id", *(F.get(a, i).alias(f"angle_{i + 1}") for i in range(3))))


def _opening_sql(before: int, at: int, after: int) -> str:
    to = lambda i: f"degrees(atan2(y{i} - y{at}, x{i} - x{at}))"
    return f"least(360 - ((({to(before)} - {to(after)}) % 360) + 360) % 360, 180)"


@query(f"WITH {_POINTS} SELECT vec_id, round({_opening_sql(0, 1, 2)}, 6) AS opening FROM p")
def ekeland_formula(spark, sf_dir):
    df, (p, q, r) = _triangle(spark, sf_dir)
    return rounded(df.select("vec_id", shape.opening_angle(p, q, r).alias("opening")))


@query(f"""WITH {_POINTS}, {_SIDES}, {_ANGLES}, o AS (SELECT *, list_sort([{_opening_sql(2, 0, 1)}, {_opening_sql(0, 1, 2)}, {_opening_sql(1, 2, 0)}]) AS e FROM h)
SELECT vec_id, round(t[1], 3) AS alpha1, round(t[2], 3) AS alpha2, round(e[1], 3) AS e1, round(e[2], 3) AS e2, round(e[3], 3) AS e3, round((x0+x1+x2)/3, 3) AS cx, round((y0+y1+y2)/3, 3) AS cy FROM o""")
def triangle_descriptor(spark, sf_dir):
    df, (p, q, r) = _triangle(spark, sf_dir)
    a = shape.interior_angles(p, q, r)
    e = F.array_sort(F.array(shape.opening_angle(r, p, q), shape.opening_angle(p, q, r), shape.opening_angle(q, r, p)))
    cx, cy = shape.centroid(p, q, r)
    return rounded(df.select("vec_id", F.get(a, 0).alias("alpha1"), F.get(a, 1).alias("alpha2"), *(F.get(e, i).alias(f"e{i + 1}") for i in range(3)), cx.alias("cx"), cy.alias("cy")), 3)


@query(f"""WITH {_POINTS}, {_SIDES}, l AS (SELECT *, list_sort([a, b, c]) AS s, (a+b+c)/2 AS h FROM s)
SELECT vec_id, round(s[1]/(s[2]+1e-8), 6) AS ratio_01, round(s[2]/(s[3]+1e-8), 6) AS ratio_12, round(s[1]/(s[3]+1e-8), 6) AS ratio_02,
  round(4*greatest(0, h*(h-a)*(h-b)*(h-c))/(h*a*b*c+1e-8), 6) AS radius_ratio, round(s[3]/(s[1]+1e-8), 6) AS elongation FROM l""")
def shape_features(spark, sf_dir):
    df, (p, q, r) = _triangle(spark, sf_dir)
    return rounded(df.select("vec_id", *(c.alias(n) for n, c in shape.shape_features(p, q, r).items())))


# ---- metrics ---------------------------------------------------------------------------------------------------------

_BUNDLE = "count({e}) AS n, round(avg({e}), 6) AS mean, round(median({e}), 6) AS median, round(sqrt(avg({e} * {e})), 6) AS rmse, " + ", ".join(f"round(100 * avg(CASE WHEN {{e}} <= {r} THEN 1 ELSE 0 END), 6) AS recall_{r}" for r in metrics.RECALL_AT)


def _bundle_sql(e: str) -> str:
    return _BUNDLE.replace("{e}", e)


@query(f"SELECT {_bundle_sql('value')} FROM events")
def metric_bundle(spark, sf_dir):
    return rounded(metrics.metrics_by(t(spark, sf_dir, "events"), error="value"))


@query(f"SELECT event_type AS site, {_bundle_sql('value')}, round(avg(user_id), 6) AS avg_descriptors FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def metrics_by_site(spark, sf_dir):
    rows = t(spark, sf_dir, "events").withColumnRenamed("event_type", "site")
    return rounded(metrics.metrics_by(rows, ["site"], "value", [F.avg("user_id").alias("avg_descriptors")]))


@query(f"""WITH o AS (SELECT o_totalprice AS e, CASE WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'summer' WHEN month(o_orderdate) BETWEEN 9 AND 11 THEN 'autumn' WHEN o_orderdate IS NULL THEN 'unknown' ELSE 'other' END AS season FROM orders)
SELECT season, {_bundle_sql('e')} FROM o GROUP BY season""")
def metrics_by_season(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("e"), geo.season_of_month(F.month("o_orderdate")).alias("season"))
    return rounded(metrics.metrics_by(rows, ["season"], "e"))


@query(f"""WITH o AS (SELECT value AS e, 400 + user_id * 12 AS h FROM events), b AS (SELECT e, CASE WHEN h IS NULL THEN 'unknown' WHEN h >= 400 AND h < 700 THEN '400-700' WHEN h >= 700 AND h < 1200 THEN '700-1200' WHEN h >= 1200 AND h < 2000 THEN '1200-2000' ELSE 'other' END AS alt_band FROM o)
SELECT alt_band, {_bundle_sql('e')} FROM b GROUP BY alt_band""")
def metrics_by_band(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select(F.col("value").alias("e"), geo.altitude_band((400 + F.col("user_id") * 12).cast("double")).alias("alt_band"))
    return rounded(metrics.metrics_by(rows, ["alt_band"], "e"))


@query(f"SELECT coalesce(event_type, 'overall') AS site, {_bundle_sql('value')} FROM events WHERE event_type IS NOT NULL GROUP BY GROUPING SETS ((event_type), ())")
def metrics_overall_and_site(spark, sf_dir):
    return rounded(metrics.metrics_and_total(t(spark, sf_dir, "events").withColumnRenamed("event_type", "site"), "site", "value"))


@query("SELECT event_type AS site, count(*) AS total, count(*) FILTER (user_id % 7 > 0) AS with_descriptors, round(100 * avg(CASE WHEN user_id % 7 > 0 THEN 1 ELSE 0 END), 6) AS coverage_pct, round(avg(user_id % 7), 6) AS avg_descriptors FROM events GROUP BY event_type")
def coverage(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select(F.col("event_type").alias("site"), (F.col("user_id") % 7).alias("n_descriptors"))
    return rounded(metrics.coverage(rows, ["site"]))


@query("""SELECT l_returnflag AS site, round(100 * avg(l_quantity / greatest(l_partkey % 100, 1)), 6) AS inlier_ratio_pct, round(avg(l_suppkey % 50), 6) AS avg_margin, min(l_partkey % 40) AS min_winning_votes,
  round(100 * avg(CASE WHEN l_orderkey % 9 = 0 THEN 0 WHEN l_orderkey % 211 <= 100 THEN 1 ELSE 0 END), 6) AS gt_in_top_100_pct FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def vote_diagnostics(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").selectExpr("l_returnflag as site", "l_quantity as gt_patch_votes", "l_partkey % 100 as total_votes", "l_suppkey % 50 as margin", "l_partkey % 40 as votes", "if(l_orderkey % 9 = 0, null, l_orderkey % 211) as gt_patch_rank")
    return rounded(metrics.vote_diagnostics(rows))


@query(f"SELECT o_orderpriority AS variant, {_bundle_sql('o_totalprice')}, round(avg(o_custkey), 6) AS avg_t_total FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority")
def variant_metrics(spark, sf_dir):
    return rounded(metrics.metrics_by(t(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "variant"), ["variant"], "o_totalprice", [F.avg("o_custkey").alias("avg_t_total")], any_values=True))


@query(f"SELECT {_bundle_sql('v')} FROM (SELECT value / 7 + event_id / 1000003.0 AS v FROM events)")
def metrics_of_any_values(spark, sf_dir):
    """All values are distinct."""
    return rounded(metrics.metrics_by(t(spark, sf_dir, "events").select((F.col("value") / 7 + F.col("event_id") / 1000003.0).alias("v")), error="v", any_values=True))


@query("""SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice / 7, 0.995), 6) AS cap FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag""")
def quantile_by_refinement(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 7).alias("v"))
    return rounded(order.quantile(rows, ["l_returnflag"], "v", 0.995, "cap"))


@query("SELECT round(avg(value), 6) AS avg_t_total, round(avg(value / 2), 6) AS avg_t_query, round(avg(user_id), 6) AS avg_t_segment FROM events")
def mean_runtimes(spark, sf_dir):
    return rounded(metrics.runtimes(t(spark, sf_dir, "events").selectExpr("value as t_total", "value / 2 as t_query", "user_id as t_segment")))


@query("SELECT event_type AS site, value AS error_m, round(row_number() OVER (PARTITION BY event_type ORDER BY value) / count(*) OVER (PARTITION BY event_type), 9) AS fraction FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL")
def error_ecdf(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select(F.col("event_type").alias("site"), F.col("value").alias("error_m"))
    return metrics.ecdf(rows, "site").withColumn("fraction", F.round("fraction", 9))


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels)
SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END, 6) AS iou FROM c""")
def pixel_confusion(spark, sf_dir):
    return rounded(metrics.confusion(t(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1))


@query("""WITH g AS (SELECT l_orderkey, count(l_extendedprice) AS n, quantile_cont(l_extendedprice, 0.995) AS q FROM lineitem GROUP BY l_orderkey),
c AS (SELECT l_orderkey, CASE WHEN n >= 4 THEN least(greatest(q, 1), 76000.0) ELSE 76000.0 END AS cap FROM g)
SELECT l_orderkey, l_linenumber, l_extendedprice, round(cap, 1) AS cap FROM lineitem JOIN c USING (l_orderkey) WHERE l_extendedprice <= cap""")
def quantile_cap(spark, sf_dir):
    kept = metrics.quantile_cap(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", 80000.0)
    return kept.select("l_orderkey", "l_linenumber", "l_extendedprice", F.round("cap", 1).alias("cap"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice < 0.2 * 200000 AND l_extendedprice >= 1000")
def area_filters(spark, sf_dir):
    return polygons.below_share(t(spark, sf_dir, "lineitem"), "l_extendedprice", 200000, least=1000).select("l_orderkey", "l_linenumber")


@query("""WITH b AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
p AS (SELECT l.label AS image, l.vec_id AS left_id, r.vec_id AS right_id, greatest(least(l.x, r.x) + 0.5 - greatest(l.x, r.x), 0) * greatest(least(l.y, r.y) + 0.5 - greatest(l.y, r.y), 0) AS i
  FROM b l JOIN b r ON l.label = r.label AND l.vec_id % 20 = 0 AND r.vec_id <> l.vec_id),
q AS (SELECT *, i / (0.25 + 0.25 - i + 1e-6) AS iou FROM p)
SELECT image, left_id, arg_max(right_id, (iou, -right_id)) AS right_id, round(max(iou), 6) AS iou FROM q GROUP BY image, left_id HAVING max(iou) > 0.5""")
def box_iou_match(spark, sf_dir):
    rows = t(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("image"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    side = lambda df, s: df.select("image", F.col("vec_id").alias(f"{s}_id"), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    box = lambda s: [F.col(f"{s}x"), F.col(f"{s}y"), F.col(f"{s}x") + 0.5, F.col(f"{s}y") + 0.5]
    edges = lambda df, n: df.withColumns({f"{n}x1": F.col(f"{n}x") + 0.5, f"{n}y1": F.col(f"{n}y") + 0.5})
    left, right = edges(side(rows.where("vec_id % 20 = 0"), "left"), "left"), edges(side(rows, "right"), "right")
    names = tuple([f"{n}x", f"{n}y", f"{n}x1", f"{n}y1"] for n in ("left", "right"))
    return rounded(metrics.iou_matches(left, right, "image", "left_id", "right_id", F.when(F.col("left_id") != F.col("right_id"), geo.box_iou(box("left"), box("right"))), boxes=names, cell=0.5))


@query("""WITH e AS (SELECT user_id AS pixel, value / 500 AS v, greatest(0.001, 1 - abs(event_id % 100 - 49.5) / 49.5) AS w FROM events)
SELECT pixel, round(greatest(0.0, least(1.0, sum(w * v) / (sum(w) + 1e-6))), 6) AS blended FROM e GROUP BY pixel""")
def overlap_blend(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select(F.col("user_id").alias("pixel"), (F.col("value") / 500).alias("v"), tiles.blend_weight(F.col("event_id") % 100, 100).alias("w"))
    return rounded(metrics.blended(rows, ["pixel"], "v", "w"))


@query("""WITH e AS (SELECT vec_id // 60 AS image, vec_id % 10 * 6 AS l, vec_id % 60 // 10 * 6 AS t, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT image, t + i // 8 AS y, l + i % 8 AS x, abs(CAST(v AS DOUBLE)) AS v, greatest(0.001, (1 - abs(2 * (i // 8) / 7 - 1)) * (1 - abs(2 * (i % 8) / 7 - 1))) AS w FROM e)
SELECT image, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(greatest(0.0, least(1.0, sum(w * v) / (sum(w) + 1e-6))), 6) AS blended FROM p GROUP BY image, y, x""")
def blended_mask(spark, sf_dir):
    """Each vector is the soft mask of an 8 x 8 tile; 10 x 6 tiles, six pixels apart, cover an image."""
    rows = t(spark, sf_dir, "embeddings")
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.slice("embedding", r * 8 + 1, 8), lambda v: F.abs(v)))
    tiles_ = rows.select((F.expr("vec_id div 60")).alias("image"), (F.col("vec_id") % 10 * 6).alias("left"), (F.expr("vec_id % 60 div 10") * 6).alias("top"), mask.alias("mask"))
    blocks = detections.blended_blocks(tiles_, size=8, cell=2)
    pixel = blocks.select("image", "block_row", "block_col", F.posexplode("values").alias("i", "v"))
    return rounded(pixel.select("image", (F.col("block_row") * 2 + F.expr("i div 2")).cast("long").alias("y"), (F.col("block_col") * 2 + F.col("i") % 2).cast("long").alias("x"), F.col("v").alias("blended")))


# ---- tiles, places, names --------------------------------------------------------------------------------------------

_STARTS = "list_distinct(list_concat(range(0, CAST(greatest({n} - 500, 0) AS BIGINT) + 1, 100), [CAST(greatest({n} - 500, 0) AS BIGINT)]))"


@query(f"""WITH d AS (SELECT doc_id, list_sort({_STARTS.replace('{n}', 'n_chars')}) AS xs, list_sort({_STARTS.replace('{n}', '750')}) AS ys FROM documents),
r AS (SELECT doc_id, xs, unnest(ys) AS top, generate_subscripts(ys, 1) - 1 AS tile_row FROM d), c AS (SELECT doc_id, tile_row, top, unnest(xs) AS left_, generate_subscripts(xs, 1) - 1 AS tile_col FROM r)
SELECT doc_id, CAST(tile_row AS BIGINT) AS tile_row, CAST(tile_col AS BIGINT) AS tile_col, CAST(left_ AS BIGINT) AS "left", CAST(top AS BIGINT) AS top, doc_id || '_' || lpad(CAST(tile_row AS VARCHAR), 4, '0') || '_' || lpad(CAST(tile_col AS VARCHAR), 4, '0') AS patch_id FROM c""")
def tile_grid(spark, sf_dir):
    maps = t(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lit(750).alias("h"))
    grid = tiles.tile_grid(maps, "doc_id", "n_chars", "h")
    return grid.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("tile_row", "tile_col", "left", "top")), "patch_id")


@query("SELECT doc_id, CAST((greatest(1, ceil(greatest(n_chars - 500, 0) / 100) + 1)) * 4 AS BIGINT) AS tiles FROM documents")
def tile_count(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", tiles.tile_count(F.col("n_chars"), F.lit(750)).alias("tiles"))


_PLACES = "c AS (SELECT c_custkey, 30.0 - (c_custkey * 7919 % 10007) / 10007.0 * 0.05 AS lat, 114.0 + (c_custkey * 104729 % 10009) / 10009.0 * 0.06 AS lon FROM customer)"
_BOUNDS = (30.0, 114.0, 29.95, 114.06, 2000, 1700)


def _places(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").selectExpr("c_custkey", "30.0D - (c_custkey * 7919 % 10007) / 10007.0D * 0.05D as lat", "114.0D + (c_custkey * 104729 % 10009) / 10009.0D * 0.06D as lon")
    return rows, [F.lit(b) for b in _BOUNDS]


@query(f"WITH {_PLACES} SELECT c_custkey, CAST(greatest(0, least(1999, round_even((lon - 114.0) / (114.06 - 114.0) * 1999, 0))) AS BIGINT) AS px, CAST(greatest(0, least(1699, round_even((lat - 30.0) / (29.95 - 30.0) * 1699, 0))) AS BIGINT) AS py FROM c")
def latlon_to_pixel(spark, sf_dir):
    rows, b = _places(spark, sf_dir)
    x, y = geo.lat_lon_to_pixel(F.col("lat"), F.col("lon"), *b)
    return rows.select("c_custkey", x.cast("long").alias("px"), y.cast("long").alias("py"))


@query("SELECT c_custkey, round(30.0 + (c_custkey % 1700) / 1699.0 * (29.95 - 30.0), 9) AS lat, round(114.0 + (c_custkey % 2000) / 1999.0 * (114.06 - 114.0), 9) AS lon FROM customer")
def pixel_to_latlon(spark, sf_dir):
    rows, b = _places(spark, sf_dir)
    lat, lon = geo.pixel_to_lat_lon(F.col("c_custkey") % 2000, F.col("c_custkey") % 1700, *b)
    return rounded(rows.select("c_custkey", lat.alias("lat"), lon.alias("lon")), 9)


@query(f"""WITH {_PLACES}, r AS (SELECT *, radians(0.06) * 6378137.0 * cos(radians((30.0 + 29.95) / 2)) / 2000 AS mx, radians(0.05) * 6378137.0 / 1700 AS my FROM c)
SELECT c_custkey, round(mx, 6) AS m_x, round(my, 6) AS m_y, round(sqrt(((c_custkey % 300 - 150) * mx) ** 2 + ((c_custkey % 200 - 100) * my) ** 2), 4) AS error_m FROM r""")
def error_meters(spark, sf_dir):
    rows, b = _places(spark, sf_dir)
    mx, my, _ = geo.ground_resolution(*b)
    return rows.select("c_custkey", F.round(mx, 6).alias("m_x"), F.round(my, 6).alias("m_y"), F.round(geo.error_metres(F.col("c_custkey") % 300 - 150, F.col("c_custkey") % 200 - 100, mx, my), 4).alias("error_m"))


@query("""SELECT event_id, round(400.0 / greatest(400 + user_id * 12.0, 1), 6) AS scale, round(CASE WHEN cos(radians(value / 4)) > 0.1 THEN cos(radians(value / 4)) ELSE 1 END, 6) AS pitch_factor,
  round(CASE WHEN abs(value / 100 - 2) > 0.5 THEN value / 100 - 2 ELSE 0 END, 6) AS roll_applied, round(value + 5, 6) AS yaw_applied FROM events""")
def preparation_parameters(spark, sf_dir):
    v = F.col("value")
    plan = geo.preparation(400 + F.col("user_id") * 12.0, v / 4, v / 100 - 2, v, yaw_noise=5.0)
    return rounded(t(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in plan.items())))


@query("""SELECT event_id, CAST(greatest(0, least(2000, trunc((px + gx) / 2 - r))) AS BIGINT) AS x0, CAST(greatest(0, least(1700, trunc((py + gy) / 2 - r))) AS BIGINT) AS y0, CAST(greatest(0, least(2000, trunc((px + gx) / 2 + r))) AS BIGINT) AS x1, CAST(greatest(0, least(1700, trunc((py + gy) / 2 + r))) AS BIGINT) AS y1
FROM (SELECT *, greatest(600, ceil(sqrt((px - gx) ** 2 + (py - gy) ** 2) / 2) + 600) AS r FROM (SELECT event_id, CAST(event_id % 2000 AS DOUBLE) AS px, CAST(event_id % 1700 AS DOUBLE) AS py, CAST(user_id * 10 AS DOUBLE) AS gx, CAST(user_id * 7 AS DOUBLE) AS gy FROM events))""")
def zoom_window(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    box = geo.zoom_window((e % 2000).cast("double"), (e % 1700).cast("double"), (u * 10).cast("double"), (u * 7).cast("double"), 2000, 1700)
    return t(spark, sf_dir, "events").select("event_id", *(c.cast("long").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), box)))


@query("""WITH s AS (SELECT s_suppkey, s_name, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS n FROM supplier), b AS (SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'satellite' || s_suppkey END AS map FROM supplier WHERE s_suppkey % 2 = 1),
x AS (SELECT *, regexp_replace(lower(map), '[^a-z0-9]+', '', 'g') AS mn FROM b), y AS (SELECT *, regexp_replace(mn, '^satellite', '') AS mp, regexp_replace(regexp_extract(mn, '([0-9]+)[^0-9]*$', 1), '^0+([0-9])', '\\1') AS mid FROM x),
z AS (SELECT *, regexp_replace(n, '^satellite', '') AS p, regexp_replace(regexp_extract(n, '([0-9]+)[^0-9]*$', 1), '^0+([0-9])', '\\1') AS id FROM s),
h AS (SELECT z.s_name, y.pos, y.map, CASE WHEN mn = n OR mn = p OR mp = n OR mp = p THEN 1 WHEN mid = id AND id <> '' THEN 2 WHEN contains(mn, n) OR contains(mn, p) OR contains(mp, p) THEN 3 END AS tier FROM z, y),
k AS (SELECT *, row_number() OVER (PARTITION BY s_name ORDER BY tier, pos) AS o FROM h WHERE tier IS NOT NULL)
SELECT s.s_name, CAST(k.tier AS BIGINT) AS tier, k.pos, k.map FROM s LEFT JOIN k ON k.s_name = s.s_name AND k.o = 1""".replace("\\\\1", "\\1"))
def fuzzy_bounds(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    bounds = s.where("s_suppkey % 2 = 1").selectExpr("s_suppkey as pos", "if(s_suppkey % 3 = 0, s_name, concat('satellite', s_suppkey)) as map")
    return lookup.match_bounds(s.select("s_name"), bounds, "s_name").select("s_name", F.col("tier").cast("long").alias("tier"), "pos", "map")


@query("""WITH s AS (SELECT s_suppkey, s_name, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS n FROM supplier), b AS (SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 3 = 0 THEN substring(s_name, 1, 30) ELSE 'satellite' || s_suppkey || 'map' END AS map FROM supplier),
x AS (SELECT *, regexp_replace(lower(map), '[^a-z0-9]+', '', 'g') AS mn FROM b), y AS (SELECT *, regexp_replace(mn, '^satellite', '') AS mp, regexp_replace(regexp_extract(mn, '([0-9]+)[^0-9]*$', 1), '^0+([0-9])', '\\1') AS mid FROM x),
z AS (SELECT *, regexp_replace(n, '^satellite', '') AS p, regexp_replace(regexp_extract(n, '([0-9]+)[^0-9]*$', 1), '^0+([0-9])', '\\1') AS id FROM s),
h AS (SELECT z.s_name, y.pos, y.map, CASE WHEN mn = n OR mn = p OR mp = n OR mp = p THEN 1 WHEN mid = id AND id <> '' THEN 2 WHEN contains(mn, n) OR contains(mn, p) OR contains(mp, p) THEN 3 END AS tier FROM z, y),
k AS (SELECT *, row_number() OVER (PARTITION BY s_name ORDER BY tier, pos) AS o FROM h WHERE tier IS NOT NULL)
SELECT s.s_name, CAST(k.tier AS BIGINT) AS tier, k.pos, k.map FROM s LEFT JOIN k ON k.s_name = s.s_name AND k.o = 1""".replace("\\\\1", "\\1"))
def fuzzy_bounds_all(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    bounds = s.selectExpr("s_suppkey as pos", "if(s_suppkey % 3 = 0, substring(s_name, 1, 30), concat('satellite', s_suppkey, 'map')) as map")
    return lookup.match_bounds(s.select("s_name"), bounds, "s_name").select("s_name", F.col("tier").cast("long").alias("tier"), "pos", "map")


@query("SELECT p_name, regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '', 'g') AS normal, p_partkey || '_' || lpad(CAST(p_size AS VARCHAR), 4, '0') || '_' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 4, '0') AS patch_id FROM part")
def name_forms(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_name", text.normal_name(F.col("p_name")).alias("normal"), text.patch_id(F.col("p_partkey").cast("string"), F.col("p_size"), F.col("p_partkey") % 1000).alias("patch_id"))


# ---- joins, ranks, sets ----------------------------------------------------------------------------------------------


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, quality, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) = 1) l USING (doc_id)")
def pose_lookup(spark, sf_dir):
    poses = t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("filename"), "quality", "toxic", F.struct("quality", "toxic").alias("num"))
    images = t(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("some/folder/"), "doc_id").alias("image"))
    return lookup.pose_of(images, poses, "num").select("doc_id", "source", "quality", "toxic")


@query("SELECT user_id, CAST(arg_min(event_id % 12, (event_id * 7919 % 10007, event_id)) AS VARCHAR) AS num, round(arg_min(value, (event_id * 7919 % 10007, event_id)), 6) AS lat FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY user_id")
def first_pose_in_file(spark, sf_dir):
    """Poses are written as text lines in an order of their own and read back by several tasks; numbers do not follow it."""
    order = [(F.col("event_id") * 7919 % 10007).alias("o"), "event_id"]
    rows = t(spark, sf_dir, "events").where("user_id is not null and value is not null").select(*order, "user_id", "value")
    line = F.concat_ws(",", F.col("event_id") % 12, F.format_string("u%d.jpg", "user_id"), F.lit("2024-01-01"), "value")
    path = shared.fresh(spark, "poses")
    rows.repartitionByRange(4, "o", "event_id").sortWithinPartitions("o", "event_id").select(line.alias("value")).write.text(path)
    images = rows.select("user_id", F.format_string("photos/u%d.jpg", "user_id").alias("image")).distinct()
    return rounded(lookup.pose_of(images, readers.flight_metadata(spark, path)).select("user_id", "num", "lat"))


@query("SELECT l.doc_id, min(l.quality) AS quality FROM labels l JOIN documents d USING (doc_id) GROUP BY l.doc_id")
def pose_demanded(spark, sf_dir):
    labels = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    poses = labels.select(F.col("doc_id").cast("string").alias("filename"), "quality", F.col("quality").alias("num"))
    images = labels.select("doc_id", F.concat(F.lit("photos/"), "doc_id").alias("image")).distinct()
    return lookup.pose_required(images, poses, "num").select("doc_id", "quality")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return lookup.not_done(t(spark, sf_dir, "documents").select("doc_id", "source"), t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT (SELECT count(*) FROM documents d JOIN labels l USING (doc_id)) AS pairs, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unmatched")
def pair_scan(spark, sf_dir):
    docs, labels = t(spark, sf_dir, "documents").select("doc_id"), t(spark, sf_dir, "labels").select("doc_id")
    pairs = lookup.pairs_by_name(docs, labels, "doc_id").agg(F.count("*").alias("pairs"))
    return pairs.crossJoin(docs.join(labels, "doc_id", "left_anti").agg(F.count("*").alias("unmatched")))


@query("SELECT conv_id, turn, CASE WHEN (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM conversations")
def alternating_signs(spark, sf_dir):
    return lookup.signs(t(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("SELECT click_id, client_id, row_number() OVER (PARTITION BY client_id ORDER BY ts NULLS FIRST, click_id NULLS FIRST) - 1 AS place FROM clicks")
def click_places(spark, sf_dir):
    return order.places(t(spark, sf_dir, "clicks").select("click_id", "client_id", "ts"), ["client_id"], ["ts", "click_id"]).select("click_id", "client_id", "place")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3")
def first_per_site(spark, sf_dir):
    return lookup.first_n(t(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 3)


@query("SELECT 'events' AS origin, event_type AS name, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'orders', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus")
def union_records(spark, sf_dir):
    part = lambda name, c: metrics.codes(t(spark, sf_dir, name), c).select(F.lit(name).alias("origin"), F.col(c).alias("name"), "n")
    return part("events", "event_type").unionByName(part("orders", "o_orderstatus"))


@query("SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code, n FROM (SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type)")
def distinct_codes(spark, sf_dir):
    return metrics.codes(t(spark, sf_dir, "events"), "event_type")


@query("SELECT props, dense_rank() OVER (ORDER BY props) - 1 AS code, n FROM (SELECT props, count(*) AS n FROM clicks WHERE props IS NOT NULL GROUP BY props)")
def distinct_props(spark, sf_dir):
    return metrics.codes(t(spark, sf_dir, "clicks"), "props")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_cache_scan(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT count(*) AS n_descriptors, count(DISTINCT label) AS n_patches, round(count(*) * 32 / 1048576.0, 1) AS mb FROM embeddings")
def index_size(spark, sf_dir):
    return metrics.index_size(t(spark, sf_dir, "embeddings"), "label")


@query("""SELECT event_type, replace(replace(event_type, '_', '\\_'), '%', '\\%') || ' & ' || printf('%.2f', avg(value)) || ' & ' || printf('%.2f', max(value)) || ' \\\\' AS line FROM events GROUP BY event_type""")
def tex_table(spark, sf_dir):
    from ..sources.writers import tex_rows

    return tex_rows(t(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("a"), F.max("value").alias("b")), "event_type", ["a", "b"], digits=2)


# ---- polygons (no SQL form; tested on golden shapes) -------------------------------------------------------------------


def _stars(spark, sf_dir):
    return polygons.star_polygons(t(spark, sf_dir, "embeddings"), "vec_id")


@query(None)
def polygon_descriptors(spark, sf_dir):
    return polygons.polygon_descriptors(_stars(spark, sf_dir))


@query(None)
def dmax_sweep(spark, sf_dir):
    rows = polygons.polygon_descriptors(_stars(spark, sf_dir), cap=(0, 1, 2, 4, 8))
    return rows.groupBy("cap").agg(F.count("*").alias("n"), F.avg("e1").alias("mean_e1"), F.min("e1").alias("min_e1"))


@query(None)
def dp_simplify(spark, sf_dir):
    return polygons.simplify_polygons(_stars(spark, sf_dir), tolerance=4.0).select("vec_id", "polygon_idx", F.size("polygon").alias("n_points"), "polygon")


@query(None)
def locate_images(spark, sf_dir):
    """Build an index of star polygons, locate jittered copies of every twentieth tile's polygons, end to end."""
    stars = _stars(spark, sf_dir).withColumn("patch_id", F.format_string("tile_%04d", "vec_id"))
    tiles_ = stars.groupBy("vec_id", "patch_id").agg(F.sort_array(F.collect_list(F.struct("polygon_idx", "polygon"))).alias("p")).select(F.lit("01").alias("site"), "vec_id", "patch_id", F.array(F.lit(0), F.lit(0)).alias("tl"), F.transform("p", lambda x: x["polygon"]).alias("polygons"))
    index = shared.saved(localize.build_index(tiles_)[0], "index")
    patches = vote.patch_centroids(index, "patch", "centroid_x", "centroid_y")
    jitter = lambda x, y, s: F.round(x + (F.pmod(F.xxhash64(x, y, F.lit(s)), F.lit(1000)) / 1000 - 0.5), 6)
    images = tiles_.where("vec_id % 20 = 0").select(F.col("patch_id").alias("image"), F.transform("polygons", lambda p: F.transform(p, lambda q: F.array(jitter(q[0], q[1], 1), jitter(q[1], q[0], 2)))).alias("polygons"))
    found = localize.query_images(shared.saved(localize.image_descriptors(images), "queries"), index, patches, n=5)
    return found.select("image", "winner", "votes", "runner_up", "margin", "total_votes", "pred_px_x", "pred_px_y")


from . import records  # noqa: E402, F401  registers the queries over records, sources and flows
