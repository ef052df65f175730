"""DuckDB SQL twins of the registered queries (tables are pre-registered views)."""

from __future__ import annotations

# --- shared CTE fragments -------------------------------------------------

B1_RAW = """
  SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS id,
         s_nationkey AS archive
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_linestatus = 'O' AND s_nationkey IS NOT NULL
    AND s_nationkey NOT IN (0, 8, 500, 901, 801, 802)"""

B1_REG = """
  SELECT archive, description FROM (
    SELECT n_nationkey AS archive, trim(n_name) AS description,
           row_number() OVER (PARTITION BY n_nationkey
                              ORDER BY n_regionkey IS NOT NULL, n_regionkey, trim(n_name)) AS rn
    FROM nation WHERE n_nationkey IS NOT NULL AND n_nationkey NOT IN (0, 8, 500, 901, 801, 802))
  WHERE rn = 1"""

B2_RAW = """
  SELECT CAST(l_orderkey AS VARCHAR) AS id, p_type AS archive
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE p_type IS NOT NULL"""

B2_REG = """
  SELECT archive, description FROM (
    SELECT p_type AS archive, trim(concat_ws(' ', p_brand, p_name)) AS description,
           row_number() OVER (PARTITION BY p_type
                              ORDER BY p_brand IS NOT NULL, p_brand, p_name IS NOT NULL, p_name,
                                       trim(concat_ws(' ', p_brand, p_name))) AS rn
    FROM part WHERE p_type IS NOT NULL)
  WHERE rn = 1"""


def txt(expr: str) -> str:
    """Array as text ``[a, b]``."""
    return f"('[' || array_to_string({expr}, ', ') || ']')"


def desc(expr: str, m: str = "dm.m") -> str:
    """``[code: text, ...]`` for an array, using the one-row map CTE ``dm``."""
    entry = (f"CASE WHEN {m}[x] IS NULL THEN CAST(x AS VARCHAR) "
             f"ELSE CAST(x AS VARCHAR) || ': ' || {m}[x] END")
    return f"('[' || array_to_string(list_transform({expr}, lambda x: {entry}), ', ') || ']')"


DM = "dm AS (SELECT map_from_entries(list(struct_pack(k := archive, v := description))) AS m FROM reg)"

# frequent itemsets by levels: extend each frequent k-set by a larger code
FI_B2 = f"""
WITH RECURSIVE
m AS (SELECT DISTINCT id, archive FROM ({B2_RAW})),
reg AS ({B2_REG}),
{DM},
n AS (SELECT count(DISTINCT id) AS n FROM m),
tx AS (SELECT id, list_sort(list(archive)) AS a FROM m GROUP BY id),
fi AS (
  SELECT [archive] AS items, count(*) AS freq, 1 AS k FROM m GROUP BY archive
  HAVING count(*) >= ceil({{support}} * (SELECT n FROM n))
  UNION ALL
  SELECT items, freq, k FROM (
    SELECT list_append(f.items, m2.archive) AS items, count(*) AS freq, f.k + 1 AS k
    FROM fi f JOIN tx ON list_has_all(tx.a, f.items)
              JOIN m m2 ON m2.id = tx.id AND m2.archive > f.items[-1]
    GROUP BY f.items, m2.archive, f.k)
  WHERE freq >= ceil({{support}} * (SELECT n FROM n))),
ru AS (
  SELECT list_filter(f.items, lambda x: x <> f.cq) AS ante, f.cq, f.freq / g.freq AS conf
  FROM (SELECT items, freq, k, unnest(items) AS cq FROM fi WHERE k > 1) f
  JOIN fi g ON g.items = list_filter(f.items, lambda x: x <> f.cq)
  WHERE f.freq / g.freq >= {{confidence}}),
pr AS (
  SELECT d.a AS archives, list_sort(list(DISTINCT ru.cq)) AS prediction
  FROM (SELECT DISTINCT a FROM tx) d
  JOIN ru ON list_has_all(d.a, ru.ante) AND NOT list_contains(d.a, ru.cq)
  GROUP BY d.a)
"""


def _fi(support: float = 0.05, confidence: float = 0.5) -> str:
    return FI_B2.format(support=support, confidence=confidence)


B1_ASSIGN = """
  SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS id,
         CAST(o_orderkey % {n} AS INTEGER) AS cluster FROM orders"""
B2_ASSIGN = """
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey % 3 AS INTEGER) AS cluster FROM orders"""

T1_B1 = """
  SELECT a.cluster, m.archive, CAST(count(*) AS INTEGER) AS archive_occurrences{tags}
  FROM ({raw}) m JOIN ({assign}) a USING (id) GROUP BY a.cluster, m.archive"""


def t1(n: int = 3, tags: str = ", 'raw' AS analysis_type, 'rule' AS model_type") -> str:
    return T1_B1.format(raw=B1_RAW, assign=B1_ASSIGN.format(n=n), tags=tags)


OCC_B1 = f"""
WITH m AS ({B1_RAW}), a AS ({B1_ASSIGN.format(n=3)}), reg AS ({B1_REG}), {DM},
it AS (SELECT id, list_sort(list(DISTINCT archive)) AS archives FROM m GROUP BY id),
c AS (SELECT a.cluster, it.archives, CAST(count(*) AS INTEGER) AS occ
      FROM it LEFT JOIN a USING (id) GROUP BY a.cluster, it.archives),
r AS (SELECT *, sum(occ) OVER (PARTITION BY cluster) AS tot,
             row_number() OVER (PARTITION BY cluster ORDER BY occ DESC, archives ASC) AS rk FROM c),
top AS (SELECT cluster, archives, occ, round(occ / tot, 5) AS rf FROM r WHERE rk <= 15),
best AS (SELECT *, max(occ) OVER (PARTITION BY cluster) AS mx, sum(occ) OVER (PARTITION BY cluster) AS tt FROM top)
"""

B2_SETS = f"""
m AS (SELECT DISTINCT id, archive FROM ({B2_RAW})), a AS ({B2_ASSIGN}),
ma AS (SELECT m.id, m.archive, a.cluster FROM m JOIN a USING (id))"""

RULE_VARIANTS = f"""
WITH m AS ({B1_RAW}), reg AS ({B1_REG}), {DM},
it AS (SELECT id, list_sort(list(DISTINCT archive)) AS archives FROM m GROUP BY id),
v AS (SELECT id, archives, 'rule_size' AS model_type, 'raw' AS analysis_type,
             CAST(len(archives) % 3 AS INTEGER) AS cluster FROM it
      UNION ALL
      SELECT id, archives, 'rule_first', 'raw', CAST(archives[1] % 4 AS INTEGER) FROM it),
freq AS (SELECT v.model_type, v.analysis_type, v.cluster, m.archive,
                CAST(count(*) AS INTEGER) AS archive_occurrences
         FROM m JOIN v USING (id) GROUP BY v.model_type, v.analysis_type, v.cluster, m.archive),
c AS (SELECT model_type, analysis_type, cluster, archives, CAST(count(*) AS INTEGER) AS occ
      FROM v GROUP BY model_type, analysis_type, cluster, archives),
r AS (SELECT *, sum(occ) OVER (PARTITION BY model_type, analysis_type, cluster) AS tot,
             row_number() OVER (PARTITION BY model_type, analysis_type, cluster
                                ORDER BY occ DESC, archives ASC) AS rk FROM c),
top AS (SELECT model_type, analysis_type, cluster, archives, occ, round(occ / tot, 5) AS rf FROM r WHERE rk <= 15),
best AS (SELECT *, max(occ) OVER (PARTITION BY model_type, analysis_type, cluster) AS mx,
                sum(occ) OVER (PARTITION BY model_type, analysis_type, cluster) AS tt FROM top)
"""

# fixed values: the part types of the given tables, for columns that SQL must name
B2_CODES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
ONE_HOT = ", ".join(f"""CAST(max(CASE WHEN archive = '{c}' THEN 1 ELSE 0 END) AS INTEGER) AS "{c}\"""" for c in B2_CODES)


def pca(raw: str, reg: str) -> str:
    """CTEs ``comp`` (pc, share, v) and ``codes``: all components of the 0/1 indicators.

    Covariances from pair counts; each component is the limit of repeated
    squaring of the covariance, which is then taken out of it. Signs: the
    largest absolute loading is positive.
    """
    return f"""
WITH RECURSIVE m AS (SELECT DISTINCT id, archive FROM ({raw})), reg AS ({reg}),
n AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM m),
codes AS (SELECT archive, row_number() OVER (ORDER BY archive) - 1 AS i FROM (SELECT DISTINCT archive FROM m)),
d AS (SELECT count(*)::INT AS d FROM codes),
one AS (SELECT archive, count(*)::DOUBLE AS c FROM m GROUP BY archive),
two AS (SELECT x.archive AS a, y.archive AS b, count(*)::DOUBLE AS c FROM m x JOIN m y USING (id) GROUP BY 1, 2),
cov AS (SELECT list((coalesce(two.c, 0) - p.c * q.c / n) / (n - 1) ORDER BY x.i, y.i) AS a
        FROM codes x CROSS JOIN codes y CROSS JOIN n JOIN one p ON p.archive = x.archive JOIN one q ON q.archive = y.archive
        LEFT JOIN two ON two.a = x.archive AND two.b = y.archive),
it AS (
  SELECT 0 AS pc, 0 AS k, a, a AS sq, d, NULL::DOUBLE AS ev, NULL::DOUBLE[] AS v FROM cov, d
  UNION ALL
  SELECT pc, k, a, sq, d, ev, v FROM (
    SELECT CASE WHEN k < 40 THEN pc ELSE pc + 1 END AS pc, CASE WHEN k < 40 THEN k + 1 ELSE 0 END AS k, d,
           CASE WHEN k < 40 THEN a ELSE rest END AS a,
           CASE WHEN k < 40 THEN list_transform(nxt, lambda x: x / tr) ELSE rest END AS sq,
           CASE WHEN k < 40 THEN NULL ELSE lam END AS ev, CASE WHEN k < 40 THEN NULL ELSE u END AS v
    FROM (
      SELECT *, list_sum(list_transform(range(d), lambda i: nxt[i * d + i + 1])) AS tr,
             list_transform(range(d * d), lambda x: a[x + 1] - lam * u[x // d + 1] * u[x % d + 1]) AS rest
      FROM (
        SELECT *, list_transform(range(d * d), lambda x: list_dot_product(
                    sq[(x // d) * d + 1:(x // d) * d + d], sq[(x % d) * d + 1:(x % d) * d + d])) AS nxt,
               list_dot_product(u, list_transform(range(d), lambda i: list_dot_product(a[i * d + 1:i * d + d], u))) AS lam
        FROM (
          SELECT *, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS u
          FROM (
            SELECT *, sq[big * d + 1:big * d + d] AS w
            FROM (SELECT *, list_position(diag, list_max(diag)) - 1 AS big
                  FROM (SELECT *, list_transform(range(d), lambda i: sq[i * d + i + 1]) AS diag FROM it WHERE pc < d)))))))
  WHERE k > 0 OR pc <= d),
comp AS (
  SELECT pc - 1 AS pc, ev / sum(ev) OVER () AS share,
         list_transform(v, lambda x: x * CASE WHEN v[list_position(list_transform(v, lambda y: abs(round(y, 9))),
                        list_max(list_transform(v, lambda y: abs(round(y, 9)))))] < 0 THEN -1 ELSE 1 END) AS v
  FROM it WHERE ev IS NOT NULL),
cum AS (SELECT pc + 1 AS k, sum(share) OVER (ORDER BY pc) AS c FROM comp),
pick AS (
  SELECT 0 AS step, 1 AS lo, d AS hi, 1 AS tried, d = 1 AS done FROM d
  UNION ALL
  SELECT step + 1, CASE WHEN c < 0.8 THEN mid + 1 ELSE lo END, CASE WHEN c > 0.85 THEN mid ELSE hi END, mid, c BETWEEN 0.8 AND 0.85
  FROM (SELECT pick.*, (lo + hi) // 2 AS mid FROM pick WHERE NOT done AND lo < hi) p JOIN cum ON cum.k = p.mid),
chosen AS (SELECT arg_max(tried, step) AS k FROM pick)
"""


def loadings(n: int, where: str) -> str:
    return f"""
, l AS (SELECT comp.pc::INT AS pc, codes.archive, v[i + 1] AS loading,
               row_number() OVER (PARTITION BY pc ORDER BY abs(v[i + 1]) DESC, codes.archive) AS rk
        FROM comp CROSS JOIN codes {where})
SELECT l.archive, l.pc, round(l.loading, 5) AS loading, reg.description AS archive_description
FROM l LEFT JOIN reg USING (archive) WHERE rk <= {n}"""


# nations by number and balance of their suppliers, by region and key; one merge at a time
NATION_TREE = """
WITH RECURSIVE own AS (
  SELECT s_nationkey, count(*)::DOUBLE AS n, sum(round(s_acctbal * 100)::BIGINT) AS cents FROM supplier GROUP BY 1),
pts AS (
  SELECT n_nationkey AS node, [coalesce(n, 0), coalesce(cents / 1e6, 0), n_regionkey::DOUBLE, ln(n_nationkey + 2.0::DOUBLE)] AS v
  FROM nation LEFT JOIN own ON n_nationkey = s_nationkey),
n AS (SELECT count(*)::INT AS n FROM pts),
dist AS (SELECT x.node AS a, y.node AS b, list_distance(x.v, y.v) AS d FROM pts x JOIN pts y ON x.node <> y.node),
st AS (
  SELECT 0 AS step, node AS leaf, node AS rep, NULL::DOUBLE AS h, NULL::INT AS lo, NULL::INT AS hi FROM pts
  UNION ALL
  SELECT s.step + 1, s.leaf, CASE WHEN s.rep = m.hi THEN m.lo ELSE s.rep END, m.d, m.lo, m.hi
  FROM st s CROSS JOIN (
    SELECT x.rep AS lo, y.rep AS hi, max(dist.d) AS d
    FROM st x JOIN dist ON dist.a = x.leaf JOIN st y ON y.leaf = dist.b
    WHERE x.rep < y.rep GROUP BY 1, 2 ORDER BY d, lo, hi LIMIT 1) m),
mg AS (SELECT step - 1 AS step, any_value(h) AS h, any_value(lo) AS lo, any_value(hi) AS hi,
              count(*) FILTER (rep = lo)::INT AS size FROM st WHERE step > 0 GROUP BY step),
ch AS (
  SELECT mg.*, n, coalesce((SELECT max(p.step) FROM mg p WHERE p.step < mg.step AND p.lo = mg.lo) + n, mg.lo) AS ca,
         coalesce((SELECT max(p.step) FROM mg p WHERE p.step < mg.step AND p.lo = mg.hi) + n, mg.hi) AS cb
  FROM mg CROSS JOIN n)
"""

# distinct itemsets of B1 with their subjects, 0/1 rows over all codes and two hash orders (see batch_kmeans.hash_order)
B1_POINTS = f"""
m AS (SELECT DISTINCT id, archive FROM ({B1_RAW})),
dom AS (SELECT list(archive ORDER BY archive) AS codes FROM (SELECT DISTINCT archive FROM m)),
it AS (SELECT a, count(*)::BIGINT AS w, ('0x' || substr(md5('1,' || array_to_string(a, ',')), 1, 8))::BIGINT AS h
       FROM (SELECT id, list_sort(list(archive)) AS a FROM m GROUP BY id) GROUP BY a),
pts AS MATERIALIZED (
  SELECT a, w, list_transform(codes, lambda c: CASE WHEN list_contains(a, c) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS x,
         row_number() OVER (ORDER BY -ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / w, a) - 1 AS sampled,
         row_number() OVER (ORDER BY h, a) - 1 AS hashed
  FROM it, dom)"""


def nearest(points: str, centres: str) -> str:
    """(k, a, w, x, c, d): nearest centre of every point, d its squared distance less |x|^2."""
    return f"""(SELECT k, a, any_value(w) AS w, any_value(x) AS x, arg_min(c, (d, c)) AS c, min(d) AS d
      FROM (SELECT k, c, a, w, x, (list_dot_product(s, s) - 2 * n * list_dot_product(s, x)) / (n * n) AS d
            FROM {points} CROSS JOIN {centres}) GROUP BY k, a)"""


def kmeans(ks: tuple, steps: int) -> str:
    """CTEs ``pts`` and ``found``: the nearest centres after ``steps`` steps from the first k points."""
    out = f"""
WITH {B1_POINTS},
c0 AS (SELECT k, sampled AS c, x AS s, 1.0::DOUBLE AS n FROM pts JOIN (SELECT unnest({list(ks)}) AS k) ON sampled < k)"""
    for i in range(steps):
        out += f""",
a{i} AS MATERIALIZED (SELECT * FROM {nearest('pts', f'c{i}')}),
u{i} AS (SELECT k, c, list(v ORDER BY i) AS s FROM (
  SELECT k, c, i, sum(w * x[i])::DOUBLE AS v FROM (SELECT k, c, w, x, unnest(range(1, len(x) + 1)) AS i FROM a{i}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
z{i} AS (SELECT k, c, sum(w)::DOUBLE AS n FROM a{i} GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT o.k, o.c, coalesce(u.s, o.s) AS s, coalesce(z.n, o.n) AS n
  FROM c{i} o LEFT JOIN u{i} u ON u.k = o.k AND u.c = o.c LEFT JOIN z{i} z ON z.k = o.k AND z.c = o.c)"""
    return out + f""",
found AS (SELECT * FROM {nearest('pts', f'c{steps}')})"""


def given(k: int) -> str:
    """CTEs ``pts``, ``cen`` and ``found``: the nearest of the first k points in plain hash order."""
    return f"""
WITH RECURSIVE {B1_POINTS},
cen AS (SELECT {k} AS k, hashed AS c, x AS s, 1.0::DOUBLE AS n FROM pts WHERE hashed < {k}),
found AS MATERIALIZED (SELECT * FROM {nearest('pts', 'cen')})"""


# one merge of complete linkage at a time, over ``dist`` (a, b, d) of the leaves ``leaves`` (node)
MERGES = """
st AS (
  SELECT 0 AS step, node AS leaf, node AS rep, NULL::DOUBLE AS h FROM leaves
  UNION ALL
  SELECT s.step + 1, s.leaf, CASE WHEN s.rep = m.hi THEN m.lo ELSE s.rep END, m.d
  FROM st s CROSS JOIN (
    SELECT x.rep AS lo, y.rep AS hi, max(dist.d) AS d
    FROM st x JOIN dist ON dist.a = x.leaf JOIN st y ON y.leaf = dist.b
    WHERE x.rep < y.rep GROUP BY 1, 2 ORDER BY d, lo, hi LIMIT 1) m)"""

# subjects and distinct memberships of B1
B1_SIZES = f"""
  SELECT count(DISTINCT id)::BIGINT AS subjects, count(*)::BIGINT AS memberships
  FROM (SELECT DISTINCT id, archive FROM ({B1_RAW}))"""
TYPES = "(SELECT unnest(['raw', 'pca']) AS analysis_type)"

ORACLES: dict[str, str] = {
    "memberships": B1_RAW,
    "registry_first_description": B2_REG,
    "itemsets": f"""
      SELECT id, {txt('list_sort(list(DISTINCT archive))')} AS archives,
             CAST(count(DISTINCT archive) AS INTEGER) AS n_codes
      FROM ({B1_RAW}) GROUP BY id""",
    "subjects": f"""
      SELECT id, {txt('list_transform(list_sort(list(struct_pack(a := archive, n := n))), lambda x: x.a)')} AS archives,
             {txt('list_transform(list_sort(list(struct_pack(a := archive, n := n))), lambda x: x.n)')} AS occurrences
      FROM (SELECT id, archive, CAST(count(*) AS INTEGER) AS n FROM ({B1_RAW}) GROUP BY id, archive)
      GROUP BY id""",
    "describe_code": f"""
      SELECT m.id, m.archive, r.description AS archive_description
      FROM ({B1_RAW}) m LEFT JOIN ({B1_REG}) r ON m.archive = r.archive""",
    "sample_hash": f"""
      SELECT id, archive FROM ({B2_RAW})
      WHERE CAST(('0x' || substr(md5(concat_ws('|', id, archive, '7')), 1, 8)) AS BIGINT)
            < {int(0.05 * 4294967296)}""",
    "run_stats": f"""
      SELECT count(*) AS sample_rows, count(DISTINCT id) AS sample_count,
             count(DISTINCT archive) AS sample_archives_num FROM ({B1_RAW})""",
    "frequent_itemsets": _fi() + f"""
      SELECT {txt('items')} AS item, CAST(freq AS INTEGER) AS freq, {desc('items')} AS item_description
      FROM fi, dm WHERE k > 1""",
    "association_rules": _fi() + f"""
      SELECT {txt('ante')} AS antecedent, {txt('[cq]')} AS consequent, round(conf, 3) AS confidence,
             {desc('ante')} AS antecedent_description, {desc('[cq]')} AS consequent_description
      FROM ru, dm""",
    "predict_missing": _fi() + f"""
      SELECT {txt('archives')} AS archives, {txt('prediction')} AS prediction,
             {desc('archives')} AS archives_description, {desc('prediction')} AS prediction_description
      FROM pr, dm""",
    "code_frequencies": t1(),
    "itemset_occurrences": OCC_B1 + f"""
      SELECT cluster, {txt('archives')} AS archives, occ AS archives_occurrences, rf AS relative_frequency,
             'raw' AS analysis_type, 'rule' AS model_type FROM top""",
    "trend_itemsets": OCC_B1 + f"""
      SELECT cluster, {txt('archives')} AS archives, occ AS archives_occurrences,
             round(occ / tt, 5) AS relative_frequency, {desc('archives')} AS archives_description,
             'raw' AS analysis_type, 'rule' AS model_type FROM best, dm WHERE occ = mx""",
    "one_hot": f"""
      SELECT id, {ONE_HOT}
      FROM ({B2_RAW}) GROUP BY id""",
    "melt_top_n": f"""
      WITH reg AS ({B2_REG}),
      w AS (SELECT p_type AS archive, p_brand AS pc, avg(p_size) - 25.5 AS loading FROM part
            WHERE p_type IS NOT NULL AND p_brand IS NOT NULL GROUP BY p_type, p_brand),
      r AS (SELECT *, row_number() OVER (PARTITION BY pc ORDER BY abs(loading) DESC, archive) AS rk FROM w)
      SELECT r.archive, r.pc, round(r.loading, 5) AS loading, reg.description AS archive_description
      FROM r LEFT JOIN reg USING (archive) WHERE rk <= 3""",
    "relabel": f"""
      SELECT id, CAST(cluster % 2 + 1 AS INTEGER) AS prediction FROM ({B1_ASSIGN.format(n=6)})""",
    "wcss": f"""
      WITH {B2_SETS},
      sz AS (SELECT cluster, count(DISTINCT id) AS size FROM ma GROUP BY cluster),
      y AS (SELECT cluster, archive, count(*) AS s1 FROM ma GROUP BY cluster, archive)
      SELECT cluster, CAST(size AS INTEGER) AS size, round(sum(s1 - s1 * s1 / size), 6) AS wcss
      FROM sz JOIN y USING (cluster) GROUP BY cluster, size""",
    "silhouette": f"""
      WITH {B2_SETS},
      p AS (SELECT id, cluster AS c, count(*) AS q FROM ma GROUP BY id, cluster),
      n AS (SELECT c, count(*) AS n, sum(q) AS psi FROM p GROUP BY c),
      y AS (SELECT cluster AS c, archive, count(*) AS y FROM ma GROUP BY cluster, archive),
      dot AS (SELECT ma.id, y.c, sum(y.y) AS dot FROM ma JOIN y ON ma.archive = y.archive GROUP BY ma.id, y.c),
      s AS (SELECT p.id, p.c AS own, n.c, n.n, p.q * n.n + n.psi - 2 * coalesce(dot.dot, 0) AS s
            FROM p CROSS JOIN n LEFT JOIN dot ON dot.id = p.id AND dot.c = n.c),
      ab AS (SELECT id, max(CASE WHEN c = own THEN s / nullif(n - 1, 0) END) AS a,
                    min(CASE WHEN c <> own THEN s / n END) AS b,
                    max(CASE WHEN c = own THEN n END) AS nown FROM s GROUP BY id)
      SELECT round(avg(CASE WHEN nown <= 1 THEN 0 WHEN a < b THEN 1 - a / b
                            WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS score FROM ab""",
    "cluster_diameter": f"""
      WITH m AS (SELECT DISTINCT id, archive FROM ({B1_RAW})), a AS ({B1_ASSIGN.format(n=3)}),
      it AS (SELECT id, list_sort(list(archive)) AS s FROM m GROUP BY id),
      d AS (SELECT DISTINCT a.cluster, it.s FROM it JOIN a USING (id))
      SELECT x.cluster, round(sqrt(max(len(x.s) + len(y.s) - 2 * len(list_intersect(x.s, y.s)))), 6) AS value
      FROM d x JOIN d y ON x.cluster = y.cluster AND x.s <= y.s GROUP BY x.cluster""",
    "cluster_diameter_vectors": """
      WITH e AS (SELECT DISTINCT label AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
      SELECT x.cluster, round(max(list_distance(x.v, y.v)), 6) AS value
      FROM e x JOIN e y ON x.cluster = y.cluster AND x.v <= y.v GROUP BY x.cluster""",
    "segment_text": """
      SELECT doc_id, CAST(i AS INTEGER) AS index, substr(text, 1 + i * 8000, 8000) AS content
      FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 8000.0) AS BIGINT))) AS i
            FROM documents WHERE length(text) > 0)""",
    "upsert_by_key": """
      SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 3 THEN 'changed' ELSE o_orderstatus END AS value,
             o_totalprice AS amount, CASE WHEN o_orderkey % 10 = 3 THEN o_orderpriority END AS note FROM orders
      UNION ALL SELECT -c_custkey - 1, c_name, NULL, c_mktsegment FROM customer""",
    "orc_round_trip": t1(),
    "rule_variants_frequencies": RULE_VARIANTS + """
      SELECT cluster, archive, archive_occurrences, analysis_type, model_type FROM freq""",
    "rule_variants_occurrences": RULE_VARIANTS + f"""
      SELECT cluster, {txt('archives')} AS archives, occ AS archives_occurrences, rf AS relative_frequency,
             analysis_type, model_type FROM top""",
    "rule_variants_trend": RULE_VARIANTS + f"""
      SELECT cluster, {txt('archives')} AS archives, occ AS archives_occurrences,
             round(occ / tt, 5) AS relative_frequency, {desc('archives')} AS archives_description,
             analysis_type, model_type FROM best, dm WHERE occ = mx""",
    "union_tagged": t1(3, ", 'raw' AS analysis_type, 'rule' AS model_type") + " UNION ALL " +
                    t1(5, ", 'pca' AS analysis_type, 'rule' AS model_type"),
    "feature_vectors": f"""
      SELECT id, {txt(f"list_transform({list(B2_CODES)}, lambda c: CASE WHEN list_contains(a, c) THEN 1 ELSE 0 END)")} AS features
      FROM (SELECT id, list(DISTINCT archive) AS a FROM ({B2_RAW}) GROUP BY id)""",
    "pca_variance": pca(B2_RAW, B2_REG) + "SELECT pc::INT AS pc, round(share, 3) AS explained_variance FROM comp",
    "pca_loadings": pca(B2_RAW, B2_REG) + loadings(len(B2_CODES), ""),
    "pc_explained_variance": pca(B1_RAW, B1_REG) + """
      SELECT pc::INT AS pc, round(share, 3) AS explained_variance FROM comp, chosen WHERE pc < chosen.k""",
    "top_pcs": pca(B1_RAW, B1_REG) + loadings(10, "CROSS JOIN chosen WHERE comp.pc < chosen.k"),
    "sweep_sizes": f"""
      SELECT analysis_type, cluster::INT AS cluster, subjects, memberships, true AS from_zero, true AS below_k
      FROM ({B1_SIZES}), {TYPES}, (SELECT unnest(range(5, 46)) AS cluster)""",
    "two_stage_sizes": f"""
      SELECT analysis_type, t::INT AS t, subjects, memberships, true AS numbered
      FROM ({B1_SIZES}), {TYPES}, (SELECT unnest(range(5, 26)) AS t)""",
    "elbow_error": f"""
      WITH m AS (SELECT DISTINCT id, archive FROM ({B1_RAW})), n AS (SELECT count(DISTINCT id) AS n FROM m),
      w AS (SELECT sum(c - c * c / n) AS w FROM (SELECT archive, count(*) AS c FROM m GROUP BY archive), n)
      SELECT cluster::INT AS cluster, round(w, 4) AS one_cluster, true AS not_below_wcss, true AS below_one_cluster
      FROM w, (SELECT unnest(range(5, 46)) AS cluster)""",
    "variants_code_totals": f"""
      SELECT model_type, analysis_type, archive, occurrences
      FROM (SELECT archive, count(*)::BIGINT AS occurrences FROM ({B1_RAW}) GROUP BY archive), {TYPES},
           (SELECT unnest(['opt_k_kmeans', 'K_kmeans', 'hierarchical']) AS model_type)""",
    "linkage_nations": NATION_TREE + """
      SELECT step::INT AS step, least(ca, cb)::INT AS left, greatest(ca, cb)::INT AS right, round(h, 6) AS height, size
      FROM ch""",
    "cut_tree": NATION_TREE + """
      , t AS (SELECT unnest(range(5, 26))::INT AS t),
      last AS (SELECT t, coalesce((SELECT max(step) + 1 FROM mg WHERE h <=
                 (SELECT h FROM mg WHERE step = n - t - 1)), 0) AS step FROM t, n)
      SELECT t, leaf::INT AS node, (dense_rank() OVER (PARTITION BY t ORDER BY rep))::INT AS cluster
      FROM last JOIN st USING (step)""",
    "kmeans_steps": kmeans((5, 12, 25), 3) + f"""
      SELECT {txt('a')} AS archives, w AS weight, k, c::INT AS prediction FROM found""",
    "kmeans_costs": kmeans((5, 12, 25), 3) + """
      SELECT k AS cluster, round(sum(w * (d + list_dot_product(x, x))), 6) AS cost FROM found GROUP BY k""",
    "assign_nearest": given(80) + f"SELECT {txt('a')} AS archives, c::INT AS prediction FROM found",
    "two_stage_given": given(25) + f""",
      leaves AS (SELECT c::INT AS node, list_append(s, ln(c + 2.0::DOUBLE) / 1000) AS v FROM cen),
      dist AS (SELECT x.node AS a, y.node AS b, list_distance(x.v, y.v) AS d FROM leaves x JOIN leaves y ON x.node <> y.node),
      {MERGES},
      cut AS (SELECT t, max(step) AS step FROM (SELECT unnest([5, 10, 20]) AS t), (SELECT step, count(DISTINCT rep) AS g FROM st GROUP BY step)
              WHERE g >= t GROUP BY t),
      flat AS (SELECT t, leaf, dense_rank() OVER (PARTITION BY t ORDER BY rep) AS cluster FROM cut JOIN st USING (step))
      SELECT t, {txt('a')} AS archives, cluster::INT AS prediction FROM found JOIN flat ON leaf = c""",
    "silhouette_given": f"""
      WITH {B1_POINTS},
      p AS (SELECT m, l, a, w, x, len(a) AS q FROM (
              SELECT *, unnest([0, 1, 2]) AS m, unnest([len(a) % 3, a[1] % 4, (a[1] + a[-1]) % 7]) AS l FROM pts)),
      n AS (SELECT m, l, sum(w) AS n, sum(w * q) AS psi FROM p GROUP BY 1, 2),
      y AS (SELECT m, l, list(v ORDER BY i) AS y FROM (
              SELECT m, l, i, sum(w * x[i])::DOUBLE AS v FROM (SELECT m, l, w, x, unnest(range(1, len(x) + 1)) AS i FROM p)
              GROUP BY 1, 2, 3) GROUP BY 1, 2),
      s AS (SELECT p.m, p.a, p.w, p.l AS own, n.l, n.n, p.q * n.n + n.psi - 2 * list_dot_product(p.x, y.y) AS s
            FROM p JOIN n ON n.m = p.m JOIN y ON y.m = n.m AND y.l = n.l),
      ab AS (SELECT m, a, any_value(w) AS w, max(CASE WHEN l = own THEN s / nullif(n - 1, 0) END) AS near,
                    min(CASE WHEN l <> own THEN s / n END) AS far, max(CASE WHEN l = own THEN n END) AS size FROM s GROUP BY 1, 2)
      SELECT m AS model, round(sum(w * CASE WHEN size <= 1 OR far IS NULL THEN 0 WHEN near < far THEN 1 - near / far
                                       WHEN near > far THEN far / near - 1 ELSE 0 END) / sum(w), 6) AS score FROM ab GROUP BY m""",
    "tree_diameters": NATION_TREE + f"""
      , t AS (SELECT unnest(range(5, 26))::INT AS t),
      last AS (SELECT t, coalesce((SELECT max(step) + 1 FROM mg WHERE h <=
                 (SELECT h FROM mg WHERE step = n - t - 1)), 0) AS step FROM t, n),
      flat AS (SELECT t, leaf, dense_rank() OVER (PARTITION BY t ORDER BY rep) AS cluster FROM last JOIN st USING (step)),
      own_sets AS (SELECT DISTINCT a[1] AS leaf, list_sum(list_transform(a, lambda c: (1::BIGINT << c::INT)))::BIGINT AS bits
                   FROM (SELECT list_sort(list(DISTINCT archive)) AS a FROM ({B1_RAW}) GROUP BY id)),
      apart AS (SELECT x.leaf AS la, y.leaf AS lb, max(bit_count(xor(x.bits, y.bits))) AS d
                FROM own_sets x JOIN own_sets y ON x.bits <= y.bits GROUP BY 1, 2)
      SELECT f.t, f.cluster::INT AS cluster, round(sqrt(max(d)), 6) AS value
      FROM apart JOIN flat f ON f.leaf = la JOIN flat g ON g.leaf = lb AND g.t = f.t AND g.cluster = f.cluster GROUP BY 1, 2""",
    "leaf_order_nations": NATION_TREE + """
      , side AS (SELECT ch.step, st.leaf, (st.rep = ch.lo) <> (ca < cb) AS is_right
                 FROM ch JOIN st ON st.step = ch.step AND st.rep IN (ch.lo, ch.hi)),
      before AS (SELECT step, count(*) FILTER (NOT is_right) AS before FROM side GROUP BY step)
      SELECT leaf::INT AS node, sum(CASE WHEN is_right THEN before ELSE 0 END)::INT AS position
      FROM side JOIN before USING (step) GROUP BY leaf""",
}
