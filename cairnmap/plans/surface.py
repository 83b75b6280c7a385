"""The engine in SQL text: scalar functions, and table functions over TABLE arguments.

``register(spark)`` adds them to a session.  The scalar functions say in SQL what the column builders say in Python
(tests hold one against the other).  The table functions take Arrow batches:

* ``nearest(TABLE(rows) PARTITION BY part ORDER BY (asked DESC), k, p)``: rows (part, asked, id, vec).  Of each part the queries
  (asked) come first, then index rows, which stream past in batches; each query's k best of the part come out as (query_id,
  index_id, distance).  A rank over query_id chooses among parts; queries go to all parts.
* ``plurality(TABLE(matches) PARTITION BY image)``: matches (image, patch) -> image, winner, votes, runner_up, margin,
  total_votes, n_voted; on a tie the smallest patch.  Memory follows the number of voted patches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import knn

_SUM = "aggregate(zip_with(cast(a as array<double>), cast(b as array<double>), (x, y) -> {0}), 0.0D, (s, x) -> s + x)"
_TURN = "pmod(abs(x - y), 360.0D)"
_STEM = r"regexp_replace(element_at(split(name, '/'), -1), '(?<=.)\\.[^.]*$', '')"
_AT = "coalesce(" + ", ".join("try_to_timestamp(at, '{}')".format(f.replace("'", r"\'")) for f in geo.DATE_FORMATS) + ", try_to_timestamp(at))"
#: name -> (arguments, result, body).
FUNCTIONS = {
    "l1_distance": ("a array<double>, b array<double>", "double", _SUM.format("abs(x - y)")),
    "l2_distance": ("a array<double>, b array<double>", "double", f"sqrt({_SUM.format('(x - y) * (x - y)')})"),
    "angular_l1": ("a array<double>, b array<double>", "double", _SUM.format(f"least({_TURN}, 360.0D - {_TURN})")),
    "complex_chord": ("a array<double>, b array<double>", "double", _SUM.format("sqrt(greatest(0.0D, 2 * (1 - cos(radians(x - y)))))")),
    "circular_mean": ("a array<double>, b array<double>", "double", f"{_SUM.format('1 - cos(radians(x - y))')} / size(a)"),
    "error_metres": ("dx double, dy double, m_x double, m_y double", "double", "hypot(dx * m_x, dy * m_y)"),
    "altitude_band": ("height double", "string", "case when height is null or isnan(height) or abs(height) = double('infinity') then 'unknown' when height >= 400 and height < 700 then '400-700' when height >= 700 and height < 1200 then '700-1200' when height >= 1200 and height < 2000 then '1200-2000' else 'other' end"),
    "season": ("at string", "string", f"case when {_AT} is null then 'unknown' when month({_AT}) between 6 and 8 then 'summer' when month({_AT}) between 9 and 11 then 'autumn' else 'other' end"),
    "normal_name": ("name string", "string", f"regexp_replace(lower(trim({_STEM})), '[^a-z0-9]+', '')"),
    "numeric_id": ("name string", "string", r"if(size(regexp_extract_all(name, '(\\d+)')) > 0, regexp_replace(element_at(regexp_extract_all(name, '(\\d+)'), -1), '^0+(?!$)', ''), null)"),
}


class Nearest:
    def __init__(self):
        self.ids, self.vectors, self.kept = [], [], []

    def eval(self, rows: pa.RecordBatch, k: pa.Array, p: pa.Array):
        self.k, self.p = k[0].as_py(), p[0].as_py()
        rows = rows.filter(pc.is_valid(rows.column("vec")))
        asked = rows.filter(rows.column("asked"))
        if asked.num_rows:
            self.ids.append(asked.column("id").to_numpy())
            self.vectors.append(knn._matrix(asked.column("vec")))
        index = rows.filter(pc.invert(rows.column("asked")))
        if self.ids and index.num_rows:
            ids, q = np.concatenate(self.ids), np.concatenate(self.vectors)
            own, s = index.column("id").to_numpy(), knn._matrix(index.column("vec"), q.shape[1])
            for a in range(0, len(q), 64):
                for b in range(0, len(s), 1024):
                    d = knn.distances(q[a : a + 64], s[b : b + 1024], self.p)
                    limit = np.partition(d, self.k - 1, axis=1)[:, self.k - 1] if d.shape[1] >= self.k else np.full(len(d), np.inf)
                    r, c = np.nonzero(d <= limit[:, None])
                    self.kept.append((ids[a + r], d[r, c], own[b + c], []))
            self.kept = [knn._best(self.kept, self.k)]
        return iter(())

    def terminate(self):
        if self.kept:
            ids, d, found, _ = self.kept[0]
            yield pa.table({"query_id": pa.array(ids, pa.int64()), "index_id": pa.array(found, pa.int64()), "distance": pa.array(d)})


class Plurality:
    def __init__(self):
        self.image, self.votes = None, {}

    def eval(self, matches: pa.RecordBatch):
        self.image = matches.column("image")[0].as_py()
        for entry in matches.column("patch").value_counts().to_pylist():
            if entry["values"] is not None:
                self.votes[entry["values"]] = self.votes.get(entry["values"], 0) + entry["counts"]
        return iter(())

    def terminate(self):
        if self.votes:
            ranked = sorted(self.votes.items(), key=lambda v: (-v[1], v[0]))
            second = ranked[1][1] if len(ranked) > 1 else 0
            out = (self.image, ranked[0][0], ranked[0][1], second, ranked[0][1] - second, sum(self.votes.values()), len(ranked))
            names = ("image", "winner", "votes", "runner_up", "margin", "total_votes", "n_voted")
            yield pa.table({n: pa.array([v], pa.int64()) for n, v in zip(names, out)})


TABLES = {"nearest": (Nearest, "query_id long, index_id long, distance double"), "plurality": (Plurality, "image long, winner long, votes long, runner_up long, margin long, total_votes long, n_voted long")}


def register(spark: SparkSession) -> None:
    """Adds the functions to the session, in place of temporary ones of the same names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    for name, (cls, schema) in TABLES.items():
        spark.udtf.register(name, F.arrow_udtf(cls, returnType=schema))
