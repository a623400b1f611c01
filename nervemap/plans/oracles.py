"""SQL for DuckDB that gives what the queries give."""

from __future__ import annotations

from nervemap.functions.projection import CauchyProjection, GaussianProjection
from nervemap.functions.vectors import MEASURES
from nervemap.operators.lsh import FAMILIES
from nervemap.plans.queries import CORE, K, LEAF_SIZE, LINK, OVERLAP, PRESENT, SKETCH, SPLITS, _INTERVALS, _lsh

_SUM = "list_reduce({}, lambda x, y: x + y, CAST(0 AS DOUBLE))"
_ZIP = "list_transform(list_zip({a}, {b}), lambda p: {f})"


def _fold(a: str, b: str, f: str) -> str:
    return _SUM.format(_ZIP.format(a=a, b=b, f=f))


def _distance(measure: str, a: str, b: str) -> str:
    dot = lambda x, y: _fold(x, y, "p[1] * p[2]")
    both, either = (_fold(a, b, f"CASE WHEN p[1] <> 0 {w} p[2] <> 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END") for w in ("AND", "OR"))
    return {
        "cosine": f"greatest(CAST(0 AS DOUBLE), 1 - abs({dot(a, b)}) / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))",
        "euclidean": f"sqrt({_fold(a, b, '(p[1] - p[2]) * (p[1] - p[2])')})",
        "manhattan": _fold(a, b, "abs(p[1] - p[2])"),
        "hamming": f"({either} - {both})",
        "jaccard": f"(1 - {both} / {either})",
    }[measure]


def _vectors(measure: str = "euclidean") -> str:
    v = "CAST(embedding AS DOUBLE[])"
    if measure in ("hamming", "jaccard"):
        v = f"list_transform({v}, lambda x: CASE WHEN x > {PRESENT} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
    return f"e AS (SELECT vec_id AS id, {v} AS v, label FROM embeddings)"


def _sides(name: str, source: str, column: str, n: int, ratio: float) -> str:
    """Pieces i of a dimension with widened ends."""
    return f"""{name} AS (
  SELECT i, a - (b - a) * {ratio}::DOUBLE / 2 AS lo, b + (b - a) * {ratio}::DOUBLE / 2 AS hi
  FROM (SELECT i, l + i * ((u - l) / {n}) AS a, l + i * ((u - l) / {n}) + ((u - l) / {n}) AS b
        FROM (SELECT min(CAST({column} AS DOUBLE)) AS l, max(CAST({column} AS DOUBLE)) AS u FROM {source}), (SELECT unnest(range({n})) AS i))
)"""


def _assign_1d(source: str, key: str, column: str, n: int, ratio: float, closed: bool = False) -> str:
    more, less = (">=", "<=") if closed else (">", "<")
    return f"WITH {_sides('s', source, column, n, ratio)}, p AS (SELECT {key} AS id, i FROM {source} JOIN s ON {column} {more} lo AND {column} {less} hi)"


def _assign_2d(source: str, keys: str, c: tuple[str, str], n: int, ratio: float, head: str = "WITH ") -> str:
    return f"""{head}{_sides('s', source, c[0], n, ratio)}, {_sides('t', source, c[1], n, ratio)},
p AS (SELECT {keys}, s.i * {n} + t.i AS i FROM {source} JOIN s ON {c[0]} > s.lo AND {c[0]} < s.hi JOIN t ON {c[1]} > t.lo AND {c[1]} < t.hi)"""


def _listed(key: str, source: str) -> str:
    return f" SELECT o.{key}, coalesce(c.ids, '') AS cover_ids FROM {source} o LEFT JOIN (SELECT id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS ids FROM p GROUP BY id) c ON c.id = o.{key}"


_COUNTED = " SELECT CAST(i AS INTEGER) AS cover_id, count(*) AS n FROM p GROUP BY i"

_MUTUAL = f"""{_vectors()}, x AS (SELECT id, v, label, v[1] AS lens FROM e), {_sides('s', 'x', 'lens', SPLITS, OVERLAP)},
p AS (SELECT id * {SPLITS} + i AS vid, i AS cell, id, v, label, lens FROM x JOIN s ON lens > lo AND lens < hi),
d AS (SELECT a.vid AS i, b.vid AS j, {_distance('euclidean', 'a.v', 'b.v')} AS d FROM p a JOIN p b ON a.cell = b.cell),
knn AS MATERIALIZED (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM d) WHERE n <= {K}),
mutual AS (SELECT k.i, k.j FROM knn k JOIN knn r ON k.i = r.j AND k.j = r.i)"""

_SNN = f"""
WITH RECURSIVE {_MUTUAL},
snn AS (SELECT m.i, m.j, CAST(count(*) AS INTEGER) AS sim FROM mutual m JOIN knn a ON a.i = m.i JOIN knn b ON b.i = m.j AND b.j = a.j GROUP BY m.i, m.j),
density AS (SELECT i, count(*) FILTER (sim > {K} * {LINK}::DOUBLE) AS density FROM snn GROUP BY i),
edges AS (SELECT s.i, s.j FROM snn s JOIN density d ON d.i = s.i WHERE s.sim > {K} * {LINK}::DOUBLE AND d.density > {K} * {CORE}::DOUBLE),
near AS (SELECT i, j FROM edges UNION SELECT j, i FROM edges),
reach AS (SELECT i AS v, i AS l FROM near UNION SELECT n.j, r.l FROM reach r JOIN near n ON n.i = r.v),
labels AS (SELECT v AS vid, min(l) AS label FROM reach GROUP BY v),
members AS (SELECT p.id, CAST(p.cell AS INTEGER) AS cover_id, p.label, p.lens, coalesce(l.label, -(p.cell + 1)) AS cluster_id FROM p LEFT JOIN labels l USING (vid))
"""


def _top_k(pairs: str, k: int) -> str:
    """pairs: (i, j, value) of one direction."""
    return f"""SELECT i, j, value FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY value, j) AS n FROM (SELECT i, j, value FROM ({pairs}) UNION ALL SELECT j, i, value FROM ({pairs}))
) WHERE n <= {k}"""


def _knn(measure: str, where: str = "") -> str:
    pairs = f"SELECT a.id AS i, b.id AS j, {_distance(measure, 'a.v', 'b.v')} AS value FROM e a JOIN e b ON a.id < b.id {where}"
    return f"WITH {_vectors(measure)}, m AS ({pairs}) " + _top_k("SELECT * FROM m", 5)


def _numbers(x) -> str:
    return "[" + ", ".join(f"CAST({float(y)!r} AS DOUBLE)" for y in x) + "]"


def _signature(family: str, table: int) -> str:
    lsh = _lsh(family)
    d = lsh.draws[table]
    if family == "simhash":
        bits = ", ".join(f"CASE WHEN {_fold(_numbers(row), 'v', 'p[1] * p[2]')} > 0 THEN '{i}' END" for i, row in enumerate(d))
        return f"concat_ws(',', {bits})"
    if family == "bitsampling":
        return "concat_ws(',', " + ", ".join(f"CASE WHEN v[{i + 1}] <> 0 THEN '{i}' END" for i in d) + ")"
    if family == "minhash":
        s = "list_filter(range(64), lambda i: v[i + 1] <> 0)"
        mins = [f"list_min(list_transform({s}, lambda i: ((CAST(i AS BIGINT) * {a} + {b}) % {lsh.prime}) % 64))" for a, b in d]
        width = lsh.signature_length // lsh.num_bands
        return "[" + ", ".join("concat_ws(',', " + ", ".join(mins[b * width : (b + 1) * width]) + ")" for b in range(lsh.num_bands)) + "]"
    rows, offsets = d
    return "concat_ws(',', " + ", ".join(f"CAST(floor(({_fold(_numbers(r), 'v', 'p[1] * p[2]')} + CAST({float(b)!r} AS DOUBLE)) / {lsh.bucket_width}::DOUBLE) AS BIGINT)" for r, b in zip(rows, offsets, strict=True)) + ")"


def _buckets(family: str) -> str:
    lsh = _lsh(family)
    rows = []
    for t in range(lsh.num_tables):
        sig = _signature(family, t)
        if family == "minhash":
            rows.append(f"SELECT id, {t} AS tbl, band, sig[band + 1] AS key FROM (SELECT id, {sig} AS sig, unnest(range({lsh.num_bands})) AS band FROM e)")
        else:
            rows.append(f"SELECT id, {t} AS tbl, 0 AS band, {sig} AS key FROM e")
    return f"WITH {_vectors(FAMILIES[family])}, b AS ({' UNION ALL '.join(rows)})"


def _lsh_knn(family: str) -> str:
    d = _distance(FAMILIES[family], "x.v", "y.v")
    return f"""{_buckets(family)}, c AS (SELECT DISTINCT a.id AS i, b.id AS j FROM b a JOIN b USING (tbl, band, key) WHERE a.id < b.id),
m AS (SELECT i, j, {d} AS value FROM c JOIN e x ON x.id = i JOIN e y ON y.id = j) """ + _top_k("SELECT * FROM m", 5)


def _lsh_selectivity(family: str) -> str:
    return f"{_buckets(family)} SELECT (SELECT count(*) FROM (SELECT DISTINCT a.id AS i, b.id AS j FROM b a JOIN b USING (tbl, band, key))) / (CAST(count(*) AS DOUBLE) * count(*)) AS selectivity FROM e"


def _projected(kind) -> str:
    m = kind(64, 3, seed=5).matrix
    return f"WITH {_vectors()} " + " UNION ALL ".join(f"SELECT id, {k} AS k, {_fold(_numbers(row), 'v', 'p[1] * p[2]')} AS value FROM e" for k, row in enumerate(m))


def _predicate(i) -> str:
    parts = []
    if i.lower.end.bounded:
        parts.append(f"s_acctbal {'>=' if i.lower.end.closed else '>'} {i.lower.end.value}")
    if i.upper.end.bounded:
        parts.append(f"s_acctbal {'<=' if i.upper.end.closed else '<'} {i.upper.end.value}")
    return " AND ".join(parts)


_SPARSE = f"e AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN abs(x) > {PRESENT} THEN x ELSE CAST(0 AS DOUBLE) END) AS v, label FROM embeddings)"


_HEAD = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[])[1:3] AS v, label FROM embeddings)"


def _estimates() -> str:
    rows = ", ".join(_fold(_numbers(row), "v", "p[1] * p[2]") for row in CauchyProjection(64, SKETCH, seed=7).matrix)
    return f"""WITH {_vectors()}, s AS MATERIALIZED (SELECT id, v, [{rows}] AS s FROM e)
SELECT a.id AS i, b.id AS j, list_sort(list_transform(list_zip(a.s, b.s), lambda p: abs(p[1] - p[2])))[{(SKETCH + 1) // 2}] AS estimate, {_distance('manhattan', 'a.v', 'b.v')} AS value
FROM s a JOIN s b ON b.id = a.id + 1"""


def _pca(rounds: int = 2000) -> str:
    """The largest eigenvalue of the covariances, by the power method on one vector."""
    return f"""WITH RECURSIVE {_vectors()}, x AS (SELECT id, unnest(range(64)) AS d, unnest(v) AS x FROM e), m AS (SELECT d, avg(x) AS mean, var_samp(x) AS own FROM x GROUP BY d),
c AS (SELECT id, d, x - mean AS x FROM x JOIN m USING (d)),
g AS MATERIALIZED (SELECT a.d AS i, list(s ORDER BY a.d2) AS row FROM (SELECT p.d AS d, q.d AS d2, sum(p.x * q.x) / ((SELECT count(*) FROM e) - 1) AS s FROM c p JOIN c q ON p.id = q.id GROUP BY p.d, q.d) a GROUP BY a.d),
h AS MATERIALIZED (SELECT list(row ORDER BY i) AS rows FROM g),
p AS (SELECT 0 AS n, list_transform(range(64), lambda i: 1.0::DOUBLE + i / 7.0::DOUBLE) AS v, 0::DOUBLE AS size
  UNION ALL SELECT n + 1, list_transform(w, lambda y: y / s), s FROM (
    SELECT n, w, sqrt(list_sum(list_transform(w, lambda y: y * y))) AS s FROM (SELECT n, list_transform(rows, lambda r: list_dot_product(r, v)) AS w FROM p, h WHERE n < {rounds}))
)
SELECT round((SELECT size FROM p WHERE n = {rounds}), 6) AS lens_variance, round((SELECT size FROM p WHERE n = {rounds}), 6) AS variance, round((SELECT sum(own) FROM m), 6) AS total"""


def _leaf_sizes(levels: int = 12) -> str:
    """A vantage-point tree of each label, a level at a time: the first id is the vantage point, a side of more points than a leaf may have is
    split at the median distance, unless that is 0 or nothing is nearer. Sides are named 0 (near) and 1, so that names order leaves."""
    steps = [f"{_vectors()}, l0 AS (SELECT label, id, v, '' AS side, true AS open FROM e)"]
    for i in range(levels):
        steps.append(f"""m{i} AS MATERIALIZED (SELECT p.label, p.id, p.v, p.side, p.open AND q.n > {LEAF_SIZE} AS open, {_distance('euclidean', 'q.first', 'p.v')} AS d
  FROM l{i} p JOIN (SELECT label, side, count(*) AS n, arg_min(v, id) AS first FROM l{i} GROUP BY label, side) q ON q.label = p.label AND q.side = p.side),
c{i} AS (SELECT label, side, list_sort(list(d)) AS s FROM m{i} WHERE open GROUP BY label, side),
h{i} AS (SELECT label, side, (s[(len(s) + 1) // 2] + s[len(s) // 2 + 1]) / 2 AS cut, s[1] AS least FROM c{i}),
l{i + 1} AS MATERIALIZED (SELECT p.label, p.id, p.v, CASE WHEN p.open AND h.cut <> 0 AND h.least < h.cut THEN p.side || CASE WHEN d < h.cut THEN '0' ELSE '1' END ELSE p.side END AS side,
  p.open AND h.cut <> 0 AND h.least < h.cut AS open FROM m{i} p LEFT JOIN h{i} h ON h.label = p.label AND h.side = p.side)""")
    return "WITH " + ", ".join(steps) + f" SELECT label, row_number() OVER (ORDER BY CAST(label AS VARCHAR), side) - 1 AS leaf, n FROM (SELECT label, side, count(*) AS n FROM l{levels} GROUP BY label, side)"


def oracle_sql() -> dict[str, str]:
    cubes_2d = f"WITH {_sides('s', 'lineitem', 'l_quantity', 5, 0.2)}, {_sides('t', 'lineitem', 'l_discount', 5, 0.2)}"
    head = "head AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
    out = {
        "cover_fit_minmax": "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders",
        "cover_cubes_1d": f"WITH {_sides('s', 'orders', 'o_totalprice', 10, 0.1)} SELECT i AS cube_id, 0 AS dim, lo, hi FROM s",
        "cover_cubes_2d": f"{cubes_2d} SELECT s.i * 5 + t.i AS cube_id, d AS dim, CASE d WHEN 0 THEN s.lo ELSE t.lo END AS lo, CASE d WHEN 0 THEN s.hi ELSE t.hi END AS hi FROM s, t, (VALUES (0), (1)) v(d)",
        "cover_assign_array": _assign_1d("orders", "o_orderkey", "o_totalprice", 10, 0.1) + _listed("o_orderkey", "orders"),
        "cover_assign_2d": _assign_2d("part", "p_partkey AS id", ("p_size", "p_retailprice"), 3, 0.5) + _listed("p_partkey", "part"),
        "cover_assign_vector": _assign_2d("head", "id", ("x", "y"), 4, 0.3, f"WITH {head}, ") + _listed("id", "head"),
        "cover_explode_count": _assign_1d("customer", "c_custkey", "c_acctbal", 10, 0.1) + _COUNTED,
        "cover_population_2d": _assign_2d("lineitem", "l_orderkey AS id", ("l_quantity", "l_discount"), 5, 0.2) + _COUNTED,
        "cover_closed": _assign_1d("events", "event_id", "value", 8, 0.25, closed=True) + _COUNTED,
        "interval_contains": "SELECT s_suppkey, " + ", ".join(f"({_predicate(i)}) AS {n}" for n, i in _INTERVALS.items()) + " FROM supplier",
        "interval_intersects": """WITH t AS (SELECT c_nationkey AS k, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1)
SELECT a.k AS i, b.k AS j, (a.lo <= b.lo AND a.hi >= b.hi) AS within FROM t a JOIN t b ON a.k < b.k WHERE a.lo <= b.hi AND b.lo <= a.hi""",
        "cube_intersects": f"WITH {_vectors()} SELECT a.id AS i, b.id AS j FROM e a JOIN e b ON a.id < b.id WHERE " + " AND ".join(
            f"a.v[{d}] - 0.03::DOUBLE < b.v[{d}] + 0.03::DOUBLE AND b.v[{d}] - 0.03::DOUBLE < a.v[{d}] + 0.03::DOUBLE" for d in (1, 2, 3)),
        "cube_contains": f"WITH {_vectors()} SELECT a.id AS i, b.id AS j FROM e a JOIN e b ON a.id <> b.id WHERE " + " AND ".join(
            f"a.v[{d}] - 0.1::DOUBLE < b.v[{d}] - 0.04::DOUBLE AND b.v[{d}] + 0.04::DOUBLE < a.v[{d}] + 0.1::DOUBLE" for d in (1, 2, 3)),
        "index_leaf_sizes": _leaf_sizes(),
        "leaf_partitions": f"SELECT CAST(leaf AS INTEGER) AS part, n, leaf AS first_leaf, leaf AS last_leaf FROM ({_leaf_sizes()})",
        "cover_saved": _assign_1d("orders", "o_orderkey", "o_totalprice", 10, 0.1) + _listed("o_orderkey", "orders"),
        "pipeline_clusters": f"{_SNN} SELECT id, cover_id, cluster_id FROM members",
        "knn_pred": _knn("euclidean", "WHERE a.v[1] * b.v[1] > 0"),
        "knn_sampled": _knn("euclidean", "WHERE (a.id * 2654435761 + 1) % 1000003 < CAST(0.5 AS DOUBLE) * 1000003"),
        "hadamard_transpose": f"""WITH {_vectors()}, n AS (SELECT id AS i, unnest(range(len(v))) AS j, unnest(v) AS value FROM e), z AS (SELECT * FROM n WHERE value <> 0)
SELECT a.i, a.j, a.value * b.value AS value FROM z a JOIN z b ON a.i = b.j AND a.j = b.i""",
        "mutual_knn": f"{_SNN} SELECT i, j FROM mutual",
        "snn_similarity": f"{_SNN} SELECT i, j, sim FROM snn",
        "snn_density": f"{_SNN} SELECT i, density FROM density",
        "core_edges": f"{_SNN} SELECT i, j FROM edges",
        "snn_components": f"{_SNN} SELECT vid, label FROM labels",
        "reeb_clusters": f"{_SNN} SELECT id, cover_id, cluster_id FROM members",
        "reeb_leaf_clusters": f"{_SNN} SELECT id, cover_id, cluster_id FROM members".replace(_vectors(), _HEAD),
        "mapper_nodes": f"""{_SNN} SELECT cluster_id, round((avg(lens) - (SELECT min(lens) FROM members)) / ((SELECT max(lens) FROM members) - (SELECT min(lens) FROM members)), 9) AS lens_mean,
  count(*) AS cardinality FROM members WHERE cluster_id >= 0 GROUP BY cluster_id""",
        "mapper_edges": f"""{_SNN} SELECT a.cluster_id AS src, b.cluster_id AS dst, count(*) AS cardinality FROM members a JOIN members b ON a.id = b.id AND a.cluster_id < b.cluster_id
  WHERE a.cluster_id >= 0 GROUP BY 1, 2""",
        "mapper_labels": f"""{_SNN}, c AS (SELECT cluster_id, label, count(*) AS n FROM members WHERE cluster_id >= 0 GROUP BY 1, 2)
SELECT cluster_id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) AS node_label
FROM (SELECT *, floor(sum(n) OVER (PARTITION BY cluster_id) / count(*) OVER (PARTITION BY cluster_id)) AS least FROM c) WHERE n >= least GROUP BY cluster_id""",
        "remove_noise": f"""{_SNN}, c AS (SELECT cluster_id, count(*) AS n FROM members GROUP BY 1), k AS (
  SELECT cluster_id, dense_rank() OVER (ORDER BY cluster_id) AS r FROM c WHERE n > (SELECT sum(n) FROM c) * CAST(0.02 AS DOUBLE))
SELECT id, cover_id, k.r AS cluster_id FROM members JOIN k USING (cluster_id)""",
        "relabelled": f"{_SNN} SELECT id, cover_id, dense_rank() OVER (ORDER BY greatest(cluster_id, -1)) AS cluster_id FROM members",
        "radius_by_label": f"""WITH {_vectors()}, d AS (SELECT a.label, a.id, {_distance('euclidean', 'a.v', 'b.v')} AS d FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS n FROM d WHERE d > 0)
SELECT label, round(avg(radius), 9) AS radius FROM (SELECT label, id, max(d) AS radius FROM r WHERE n <= 5 GROUP BY 1, 2) GROUP BY label""",
        "buffer_size": f"""WITH {_vectors()}, z AS (SELECT unnest(range(100, 1001, 100)) AS s), c AS (SELECT count(*) AS n FROM e),
p AS (SELECT s, id, v FROM e, z, c WHERE (id * 2654435761 % 1000003 + s * 7919) % 1000003 < s / CAST(n AS DOUBLE) * 1000003),
d AS (SELECT a.s, a.id, {_distance('euclidean', 'a.v', 'b.v')} AS d FROM p a JOIN p b ON a.s = b.s AND a.id <> b.id),
r AS (SELECT s, id, max(d) AS radius FROM (SELECT *, row_number() OVER (PARTITION BY s, id ORDER BY d) AS n FROM d WHERE d > 0) WHERE n <= 5 GROUP BY s, id),
m AS (SELECT ln((SELECT count(*) FROM p WHERE p.s = r.s)) AS x, ln(avg(radius)) AS y FROM r GROUP BY s),
f AS (SELECT regr_slope(y, x) AS b, avg(x) AS ax, avg(y) AS ay, max(y) AS most FROM m)
SELECT round(CASE WHEN b < 0 THEN exp(ay - b * ax + b * ln((SELECT n FROM c))) / sqrt(-1 / b) ELSE exp(most) END, 6) AS buffer FROM f""",
        "snn_join_clusters": f"""WITH RECURSIVE {_vectors()}, m AS (SELECT a.id AS i, b.id AS j, {_distance('euclidean', 'a.v', 'b.v')} AS value FROM e a JOIN e b ON a.id < b.id),
k AS MATERIALIZED ({_top_k("SELECT * FROM m", 5)}),
l AS (SELECT x.i, x.j FROM k x JOIN k a ON a.i = x.i JOIN k b ON b.i = x.j AND b.j = a.j GROUP BY x.i, x.j HAVING count(*) >= 5 * 0.4::DOUBLE),
near AS (SELECT i, j FROM l UNION SELECT j, i FROM l),
reach AS (SELECT i AS v, i AS l FROM near UNION SELECT n.j, r.l FROM reach r JOIN near n ON n.i = r.v)
SELECT v AS vertex, min(l) AS cluster_id FROM reach GROUP BY v""",
        "knn_sparse_euclidean": _knn("euclidean").replace(_vectors(), _SPARSE),
        "basket_knn": """WITH s AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), n AS (SELECT o, count(*) AS c FROM s GROUP BY o),
shared AS MATERIALIZED (SELECT a.o AS i, b.o AS j, count(*) AS common FROM s a JOIN s b ON a.p = b.p AND a.o <> b.o GROUP BY 1, 2),
low AS (SELECT o AS j FROM n ORDER BY o LIMIT 11),
d AS (SELECT i, j, 1 - CAST(common AS DOUBLE) / CAST(x.c + y.c - common AS DOUBLE) AS value FROM shared JOIN n x ON x.o = i JOIN n y ON y.o = j
  UNION ALL SELECT n.o, low.j, CAST(1 AS DOUBLE) FROM n JOIN low ON n.o <> low.j ANTI JOIN shared ON shared.i = n.o AND shared.j = low.j)
SELECT i, j, value FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY value, j) AS n FROM d) WHERE n <= 5""",
        "l1_estimates": _estimates(),
        "pca_variance": _pca(),
        "kmeans_invariants": "SELECT count(*) AS n, 0::BIGINT AS misplaced, 0::BIGINT AS outside FROM embeddings",
        "gmm_invariants": "SELECT count(*) AS n, 0::BIGINT AS unbalanced, 0::BIGINT AS misplaced FROM embeddings",
        "projection_gaussian": _projected(GaussianProjection),
        "projection_cauchy": _projected(CauchyProjection),
    }
    for m in MEASURES:
        out[f"dist_{m}"] = f"WITH {_vectors(m)} SELECT a.id AS i, b.id AS j, {_distance(m, 'a.v', 'b.v')} AS value FROM e a JOIN e b ON b.id = a.id + 1"
        out[f"knn_{m}"] = _knn(m)
        out[f"leaf_knn_{m}"] = _knn(m).replace(_vectors(), _HEAD)
        out[f"dist_sparse_{m}"] = f"WITH {_SPARSE} SELECT a.id AS i, b.id AS j, {_distance(m, 'a.v', 'b.v')} AS value FROM e a JOIN e b ON b.id = a.id + 1"
    for m in ("jaccard", "hamming"):
        out[f"set_knn_{m}"] = _knn(m)
    for f in FAMILIES:
        out[f"lsh_{f}_knn"], out[f"lsh_{f}_selectivity"] = _lsh_knn(f), _lsh_selectivity(f)
    return out
