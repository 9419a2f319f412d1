"""Queries of trees, graphs and points, with their SQL. The tree of the supplied tables is that of page paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import distance, text
from lodestrata.operators import batched, blocks, controls, curvature, graphs, paths, probe, riemann, trees
from lodestrata.operators.ordered import running
from lodestrata.plans.registry import query, read, rounded


#: Levels of a tree that are compared one by one; deeper trees compare whole arrays.
LEVELS = 24


def page_paths(spark, sf_dir):
    """host and path of pages: the path's parts."""
    url = F.col("url")
    return read(spark, sf_dir, "pages").select(F.regexp_extract(url, "://([^/?#]*)", 1).alias("host"), text.path_components(F.regexp_extract(url, "://[^/?#]*/([^?#]*)", 1)).alias("parts")).where("host != ''")


PATHS = "p AS (SELECT DISTINCT host, list_filter(string_split(path, '/'), lambda x: x != '') AS parts FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS path FROM pages) WHERE host != '')"
#: The trees of hosts: a node for each prefix of a path, the root the empty one.
NODES = f"{PATHS}, n AS (SELECT DISTINCT host, array_to_string(parts[1:i], '/') AS node, CASE WHEN i > 0 THEN array_to_string(parts[1:i - 1], '/') END AS parent, i AS depth FROM p, range(20) r(i) WHERE i <= len(parts))"


def host_trees(spark, sf_dir):
    """host, node, parent and depth of the tree of all prefixes of each host's paths."""
    prefix = lambda parts, i: F.array_join(F.slice(parts, 1, i), "/")
    steps = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda i: F.struct(prefix(F.col("parts"), i).alias("node"), F.when(i > 0, prefix(F.col("parts"), F.greatest(i - 1, F.lit(0)))).alias("parent"), i.alias("depth")))
    return page_paths(spark, sf_dir).select("host", F.explode(steps).alias("n")).select("host", "n.*").distinct()


@query(f"""WITH {NODES}, c AS (SELECT a.host, a.node, count(b.node) AS c FROM n a LEFT JOIN n b ON a.host = b.host AND b.parent = a.node GROUP BY ALL), l AS (SELECT host, c, count(*) AS n FROM c GROUP BY ALL)
  SELECT host, sum(n) AS nodes, round(sum(n) FILTER (c = 0) / sum(n), 6) AS leaf_fraction, round(coalesce(sum(c * n) / sum(n) FILTER (c > 0), 0), 6) AS mean_branching, max(c) AS max_branching, round(abs(-sum(n / t * log2(n / t))), 6) AS branching_entropy FROM (SELECT *, sum(n) OVER (PARTITION BY host) AS t FROM l) GROUP BY host""")
def host_branching(spark, sf_dir):
    found = curvature.branching(host_trees(spark, sf_dir), "host")
    return rounded(found, 6, "leaf_fraction", "mean_branching").withColumn("branching_entropy", F.abs(F.round("branching_entropy", 6)))


@query(f"""WITH {PATHS}, q AS (SELECT DISTINCT array_to_string(parts, '/') AS path, parts FROM p WHERE len(parts) > 0), u AS (SELECT path, parts, ('0x' || substr(sha256(lower(parts[1])), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE AS first FROM q),
  s AS (SELECT path, parts, CASE lower(parts[1]) WHEN 'src' THEN 0 WHEN 'lib' THEN 1 WHEN 'app' THEN 2 WHEN 'tests' THEN 16 WHEN 'test' THEN 16 WHEN 'docs' THEN 32 WHEN 'doc' THEN 32 WHEN 'config' THEN 48 WHEN 'scripts' THEN 56 ELSE floor(first * 64)::INT % 64 END AS sector FROM u),
  a AS (SELECT path, parts, (sector + 0.5) * (2 * pi() / 64) + coalesce(list_sum(list_transform(range(2, len(parts) + 1), lambda i: (2 * (('0x' || substr(sha256(array_to_string(parts[1:i], '/')), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE) - 1) * pi() / (64 * pow(2, i - 1)))), 0) AS t FROM s)
  SELECT path, round((1 - exp(-0.45 * len(parts))) * 0.999, 6) AS radius, round(t, 6) AS angle FROM a""")
def path_positions(spark, sf_dir):
    paths = page_paths(spark, sf_dir).where(F.size("parts") > 0).select(F.array_join("parts", "/").alias("path"), "parts").distinct()
    return paths.select("path", F.round(distance.path_radius(F.col("parts")), 6).alias("radius"), F.round(distance.path_angle(F.col("parts")), 6).alias("angle"))


def host_edges(spark, sf_dir):
    """The forest of hosts' path trees as edges between names that hold the host."""
    nodes = host_trees(spark, sf_dir).where("parent IS NOT NULL")
    return nodes.select(F.concat_ws(":", "host", "parent").alias("left"), F.concat_ws(":", "host", "node").alias("right"))


@query(f"""WITH {NODES}, e AS (SELECT host || ':' || parent AS l, host || ':' || node AS r FROM n WHERE parent IS NOT NULL), d AS (SELECT x, count(*) AS d FROM (SELECT l AS x FROM e UNION ALL SELECT r FROM e) GROUP BY x)
  SELECT l AS "left", r AS "right", round(-2 * greatest(0, 1 - 1 / a.d - 1 / b.d), 6) + 0 AS curvature FROM e JOIN d a ON a.x = l JOIN d b ON b.x = r""")
def path_curvature(spark, sf_dir):
    found = curvature.ollivier_curvature(host_edges(spark, sf_dir))
    return found.select("left", "right", (F.round("curvature", 6) + 0.0).alias("curvature"))


def split_nodes(spark, sf_dir):
    """host_trees() with each node's parts from the root down."""
    return host_trees(spark, sf_dir).withColumn("parts", F.when(F.col("depth") > 0, F.split("node", "/")).otherwise(F.array().cast("array<string>")))


@query(f"""WITH {NODES}, s AS (SELECT host, count(*) AS nodes, max(depth) AS max_depth FROM n GROUP BY host), x AS (SELECT a.host, max(len(a.parts) + len(b.parts) - 2 * (list_sum([0] || list_transform(range(1, least(len(a.parts), len(b.parts)) + 1), lambda i: (a.parts[1:i] = b.parts[1:i])::INT)))) AS diameter FROM
  (SELECT host, string_split_regex(node, '/') AS parts FROM n WHERE node != '' UNION ALL SELECT host, [] FROM n WHERE node = '') a JOIN (SELECT host, string_split_regex(node, '/') AS parts FROM n WHERE node != '' UNION ALL SELECT host, [] FROM n WHERE node = '') b ON a.host = b.host GROUP BY a.host)
  SELECT host, nodes, nodes - 1 AS edges, max_depth, diameter::DOUBLE AS diameter, 0.0::DOUBLE AS hyperbolicity FROM s JOIN x USING (host)""")
def host_profiles(spark, sf_dir):
    nodes = split_nodes(spark, sf_dir)
    sizes = nodes.groupBy("host").agg(F.count("*").alias("nodes"), (F.count("*") - 1).alias("edges"), F.max("depth").alias("max_depth"))
    return sizes.join(curvature.diameters(nodes, "host"), "host").join(curvature.tree_hyperbolicity(nodes, "host"), "host")


@query(f"""WITH {NODES}, u AS (SELECT host, node, depth, CASE WHEN depth = 0 THEN []::VARCHAR[] ELSE string_split(node, '/') END AS parts FROM n), h AS (SELECT *, lower(parts[1]) AS top FROM u),
  s AS (SELECT *, CASE top WHEN 'src' THEN 0 WHEN 'lib' THEN 1 WHEN 'app' THEN 2 WHEN 'tests' THEN 16 WHEN 'test' THEN 16 WHEN 'docs' THEN 32 WHEN 'doc' THEN 32 WHEN 'config' THEN 48 WHEN 'scripts' THEN 56 ELSE floor(('0x' || substr(sha256(top), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE * 64)::INT % 64 END AS sector FROM h),
  a AS (SELECT host, parts, depth, (1 - exp(-0.45 * depth)) * 0.999 AS r, CASE WHEN depth = 0 THEN 0 ELSE (sector + 0.5) * (2 * pi() / 64) + coalesce(list_sum(list_transform(range(2, depth + 1), lambda i: (2 * (('0x' || substr(sha256(array_to_string(parts[1:i], '/')), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE) - 1) * pi() / (64 * pow(2, i - 1)))), 0) END AS t FROM s),
  q AS (SELECT host, parts, depth, r * cos(t) AS x, r * sin(t) AS y, 1 - r * r AS room FROM a),
  v AS (SELECT a.host, (a.depth + b.depth - 2 * len(list_filter(range(1, least(a.depth, b.depth) + 1), lambda i: a.parts[1:i] = b.parts[1:i])))::DOUBLE AS d, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS f, a.room * b.room AS room FROM q a JOIN q b ON a.host = b.host),
  e AS (SELECT host, d, f, acosh(1 + 2 * f * f / greatest(room, 1e-15)) AS h FROM v), g AS (SELECT host, sum(d * d) / 2 AS d, sum(f * d) / 2 AS fd, sum(f * f) / 2 AS ff, sum(h * d) / 2 AS hd, sum(h * h) / 2 AS hh FROM e GROUP BY host),
  o AS (SELECT host, sqrt(greatest(d - fd * fd / greatest(ff, 1e-12), 0) / greatest(d, 1e-12)) AS f, sqrt(greatest(d - hd * hd / greatest(hh, 1e-12), 0) / greatest(d, 1e-12)) AS h FROM g)
  SELECT host, round(f, 5) AS flat_stress, round(h, 5) AS hyperbolic_stress, round((f - h) / greatest(f, h, 1e-12), 5) AS advantage FROM o""")
def host_distortion(spark, sf_dir):
    return rounded(curvature.stresses(split_nodes(spark, sf_dir), "host"), 5, "flat_stress", "hyperbolic_stress", "advantage")


def numbered(spark, sf_dir):
    """Pairs of leaf paths of a host as arrays of prefixes, root first."""
    rows = host_trees(spark, sf_dir)
    leaf = rows.join(rows.where("parent IS NOT NULL").select("host", F.col("parent").alias("node")).distinct(), ["host", "node"], "left_anti")
    chain = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.col("depth"), F.lit(1))), lambda i: F.array_join(F.slice(F.split("node", "/"), 1, i), "/")))
    return leaf.select("host", "node", "depth", F.when(F.col("depth") > 0, chain).otherwise(F.array(F.lit(""))).alias("ancestors"))


@query(f"""WITH {NODES}, f AS (SELECT * FROM n WHERE (host, node) NOT IN (SELECT host, parent FROM n WHERE parent IS NOT NULL)), a AS (SELECT host, node, depth, [''] || list_transform(range(1, depth + 1), lambda i: array_to_string(string_split(node, '/')[1:i], '/')) AS up FROM f),
  j AS (SELECT x.host, x.node AS l, y.node AS r, x.depth AS dl, y.depth AS dr, len(list_filter(range(1, least(len(x.up), len(y.up)) + 1), lambda i: x.up[i] = y.up[i])) - 1 AS m, x.up AS xu FROM a x JOIN a y ON x.host = y.host AND x.node < y.node)
  SELECT host, l AS "left", r AS "right", xu[m + 1] AS lca, dl + dr - 2 * m AS distance, m::DOUBLE AS meeting FROM j""")
def leaf_meetings(spark, sf_dir):
    leaves = graphs.cut(numbered(spark, sf_dir))
    pairs = trees.pairs_of_groups(leaves, "host", ("left", "dl", "lu"), ("right", "dr", "ru"))
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    # prefixes are alike only where all before them are, so that those alike are counted, one comparison a level
    alike = [F.coalesce(F.get("lu", F.lit(k)) == F.get("ru", F.lit(k)), F.lit(False)).cast("int") for k in range(min(deepest, LEVELS) + 1)]
    pairs = pairs.withColumn("n", sum(alike[1:], alike[0]) if deepest <= LEVELS else distance.common_prefix_length(F.col("lu"), F.col("ru")))
    steps = F.size("lu") + F.size("ru") - 2 * F.col("n")
    return pairs.select("host", "left", "right", F.get("lu", F.col("n") - 1).alias("lca"), steps.alias("distance"), trees.meeting_depth(F.col("dl"), F.col("dr"), steps).cast("double").alias("meeting"))


@query(f"""WITH {NODES} SELECT host, count(*) AS n, count(DISTINCT regexp_extract(node, '[^/]*$')) AS "distinct", count(*) - count(DISTINCT regexp_extract(node, '[^/]*$')) AS colliding, round(1 - count(DISTINCT regexp_extract(node, '[^/]*$')) / count(*), 6) AS rate FROM n GROUP BY host""")
def host_collisions(spark, sf_dir):
    return rounded(trees.collisions(host_trees(spark, sf_dir), ["host"], F.regexp_extract("node", "[^/]*$", 0)), 6, "rate")


@query(f"""WITH {NODES}, r AS (SELECT host, count(*) AS n, count(*) - count(DISTINCT regexp_extract(node, '[^/]*$')) AS c FROM n GROUP BY host) SELECT count(*) AS "groups", round(sum(c) / sum(n), 6) AS micro, round(avg(c / n), 6) AS macro, round(quantile_cont(c / n, 0), 6) AS q000,
  round(quantile_cont(c / n, 0.25), 6) AS q025, round(quantile_cont(c / n, 0.5), 6) AS q050, round(quantile_cont(c / n, 0.75), 6) AS q075, round(quantile_cont(c / n, 1), 6) AS q100 FROM r""")
def collision_rates(spark, sf_dir):
    found = trees.collision_summary(trees.collisions(host_trees(spark, sf_dir), ["host"], F.regexp_extract("node", "[^/]*$", 0)))
    return rounded(found, 6, *[c for c in found.columns if c != "groups"])


@query("""WITH c AS (SELECT c_nationkey AS k, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY ALL), k AS (SELECT DISTINCT k FROM c), g AS (SELECT a.k AS a, b.k AS b, s.s, coalesce(x.n, 0) AS x, coalesce(y.n, 0) AS y FROM k a JOIN k b ON a.k < b.k CROSS JOIN (SELECT DISTINCT s FROM c) s LEFT JOIN c x ON x.k = a.k AND x.s = s.s LEFT JOIN c y ON y.k = b.k AND y.s = s.s)
  SELECT a AS "left", b AS "right", round(1 - sum(least(x, y)) / sum(greatest(x, y)), 6) AS gap FROM g GROUP BY a, b""")
def segment_gaps(spark, sf_dir):
    counts = read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    bags = counts.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("bag"))  # five entries
    x, y = bags.toDF("left", "lb"), bags.toDF("right", "rb")
    return x.join(y, F.col("left") < F.col("right")).select("left", "right", F.round(trees.counter_gap(F.col("lb"), F.col("rb")), 6).alias("gap"))


@query("""WITH c AS (SELECT c_nationkey AS k, avg(c_acctbal) AS b, count(*) AS n FROM customer GROUP BY 1), p AS (SELECT x.k AS anchor, y.k AS item, round(1 / (1 + abs(x.n - y.n)), 6) AS s, round(least(1, abs(x.b - y.b) / 5000), 6) AS g FROM c x JOIN c y ON x.k != y.k),
  r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY (g >= 0.05) DESC, CASE WHEN g >= 0.05 THEN s * g ELSE g END DESC, s DESC, CASE WHEN g >= 0.05 THEN g ELSE 0 END DESC, item DESC) AS n FROM p) SELECT anchor, item, round(s * g, 6) AS score FROM r WHERE n = 1""")
def hardest_nations(spark, sf_dir):
    by = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("b"), F.count("*").alias("n"))
    x, y = by.toDF("anchor", "xb", "xn"), by.toDF("item", "yb", "yn")
    pairs = x.join(y, F.col("anchor") != F.col("item")).select("anchor", "item", F.round(1 / (1 + F.abs(F.col("xn") - F.col("yn"))), 6).alias("similarity"), F.round(F.least(F.lit(1.0), F.abs(F.col("xb") - F.col("yb")) / 5000), 6).alias("gap"))
    return rounded(trees.hard_negatives(pairs), 6, "score")


@query(f"""WITH {PATHS}, q AS (SELECT host, parts, parts[1] AS s, parts[len(parts)] AS e FROM p WHERE len(parts) > 0), v AS (SELECT host, unnest([{{'f': 'lca=' || s, 'w': 0.5}}, {{'f': 'triple=' || least(s, e) || '~' || s || '~' || greatest(s, e), 'w': 2.0}}, {{'f': 'length=' || len(parts), 'w': 1.0}}]) AS x FROM q)
  SELECT host, x.f AS feature, sum(x.w)::DOUBLE AS weight FROM v GROUP BY ALL""")
def host_path_features(spark, sf_dir):
    rows = page_paths(spark, sf_dir).distinct().where(F.size("parts") > 0)
    paths = rows.select("host", F.element_at("parts", 1).alias("start"), F.element_at("parts", -1).alias("end"), F.element_at("parts", 1).alias("lca"), F.size("parts").alias("length"))
    return trees.path_features(paths, "host", {"lca": 0.5, "triple": 2.0, "length": 1.0})


# Paths between leaves of hosts' trees


def host_nodes(spark, sf_dir):
    """The trees of hosts as node tables: host, node (number in preorder), parent, last, depth and parts (from the root down, itself last)."""
    rows = host_trees(spark, sf_dir).select("host", "depth", F.when(F.col("depth") > 0, F.split("node", "/")).otherwise(F.array().cast("array<string>")).alias("parts"))
    placed = running(rows, ["host", "parts"], {"at": F.lit(1)})
    placed = placed.join(placed.groupBy("host").agg(F.min("at").alias("first")), "host").select("host", "depth", "parts", (F.col("at") - F.col("first")).cast("int").alias("node"))
    above = placed.select("host", "depth", F.explode(F.transform(F.sequence(F.lit(0), F.col("depth")), lambda i: F.slice("parts", 1, i))).alias("parts"))
    below = above.groupBy("host", "parts").agg(F.count("*").cast("int").alias("below"))
    parents = placed.select("host", F.col("parts").alias("up"), F.col("node").alias("parent"))
    up = F.when(F.col("depth") > 0, F.slice("parts", 1, F.greatest(F.col("depth") - 1, F.lit(0))))
    found = placed.join(below, ["host", "parts"]).withColumn("up", up).join(parents, ["host", "up"], "left")
    return found.select("host", "node", "parent", (F.col("node") + F.col("below") - 1).alias("last"), "depth", "parts")


NUMBERED = f"""{NODES}, t AS (SELECT host, depth, CASE WHEN depth = 0 THEN []::VARCHAR[] ELSE string_split(node, '/') END AS parts FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY parts) - 1 AS number FROM t),
  z AS (SELECT a.host, a.number, a.depth, a.parts, a.number + count(*) - 1 AS last, count(*) FILTER (b.depth = a.depth + 1) AS children FROM k a JOIN k b ON a.host = b.host AND b.depth >= a.depth AND b.parts[1:a.depth] = a.parts GROUP BY a.host, a.number, a.depth, a.parts),
  w AS (SELECT c.*, q.number AS parent FROM z c LEFT JOIN z q ON q.host = c.host AND q.depth = c.depth - 1 AND q.parts = c.parts[1:c.depth - 1])"""


def drawn_sql(most: int) -> str:
    """SQL of the paths drawn, most a host: d(host, path_index, i, j, lca, lca_depth)."""
    return f"""{NUMBERED}, l AS (SELECT host, number, depth, row_number() OVER (PARTITION BY host ORDER BY number) - 1 AS at FROM z WHERE last = number),
  s AS (SELECT w.host, w.number, w.depth, w.parent, count(*) FILTER (l.number < w.number) AS before, count(*) FILTER (l.number <= w.last) AS upto FROM w JOIN l ON l.host = w.host GROUP BY w.host, w.number, w.depth, w.parent),
  b AS (SELECT c.host, c.depth - 1 AS d, c.number, c.parent AS lca, c.before AS low, c.upto AS high, q.upto - c.upto AS width, (c.upto - c.before) * (q.upto - c.upto) AS size FROM s c JOIN s q ON q.host = c.host AND q.number = c.parent),
  c AS (SELECT *, (sum(size) OVER (PARTITION BY host, d ORDER BY number) - size)::BIGINT AS start, (sum(size) OVER (PARTITION BY host, d))::BIGINT AS total FROM b WHERE size > 0),
  m AS (SELECT host, sum(('0x' || substr(sha256(number || '|' || depth || '||' || children), 1, 12))::BIGINT)::VARCHAR AS mark FROM z GROUP BY host),
  g AS (SELECT DISTINCT host, d, total, sha256('leaf pairs|' || mark || '|' || d) AS h FROM c JOIN m USING (host)),
  f AS (SELECT host, d, total, ('0x' || substr(h, 1, 13))::BIGINT % total AS first, ('0x' || substr(h, 14, 13))::BIGINT % total AS shift FROM g),
  o AS (SELECT *, first + list_filter(range(0, 200), lambda i: gcd(first + i, total) = 1)[1] AS factor, unnest(range(0, least(total, {most}))) AS step FROM f),
  u AS (SELECT host, d, (factor * step + shift) % total AS rank, row_number() OVER (PARTITION BY host ORDER BY step, d) - 1 AS path_index FROM o),
  d AS (SELECT u.host, path_index, x.number AS i, y.number AS j, lca, u.d AS lca_depth, x.depth + y.depth - 2 * u.d AS length FROM u JOIN c ON c.host = u.host AND c.d = u.d AND rank >= start AND rank < start + size
    JOIN l x ON x.host = u.host AND x.at = low + (rank - start) // width JOIN l y ON y.host = u.host AND y.at = high + (rank - start) % width WHERE path_index < {most})"""


@query(f"""WITH {NUMBERED} SELECT host, count(*) AS nodes, sum((last = number)::INT)::BIGINT AS leaves, max(depth) AS depth, round(avg(depth), 6) AS mean_depth, round((count(*) - 1) / greatest(1, sum((last <> number)::INT)), 6) AS branching FROM z GROUP BY host""")
def host_shapes(spark, sf_dir):
    return rounded(trees.shape(host_nodes(spark, sf_dir), "host"), 6, "mean_depth", "branching")


@query(f"""WITH {NUMBERED}, q AS (SELECT c.host, coalesce(p.parts[p.depth][1], '/') AS parent_label, c.parts[c.depth][1] AS child_label FROM w c JOIN z p ON p.host = c.host AND p.number = c.parent), g AS (SELECT host, parent_label, child_label, count(*) AS n FROM q GROUP BY ALL)
  SELECT host, parent_label, child_label, n, round(n / sum(n) OVER (PARTITION BY host, parent_label), 6) AS p FROM g""")
def host_transitions(spark, sf_dir):
    """Steps from a folder to one below by the first letters of their names."""
    label = F.when(F.col("depth") > 0, F.substring(F.element_at("parts", -1), 1, 1)).otherwise("/")
    return rounded(trees.label_transitions(host_nodes(spark, sf_dir).withColumn("label", label), "host"), 6, "p")


@query(f"""WITH {drawn_sql(32)} SELECT host, path_index, i AS "start", j AS "end", lca, lca_depth, length FROM d""")
def host_path_samples(spark, sf_dir):
    return paths.sampled_paths(host_nodes(spark, sf_dir), "host", 32)


def drawn_parts(spark, sf_dir, most):
    """Drawn paths with the parts of their ends."""
    nodes = graphs.cut(host_nodes(spark, sf_dir))
    found = paths.sampled_paths(nodes, "host", most)
    at = lambda name: nodes.select("host", F.col("node").alias(name), F.col("parts").alias(f"{name}_parts"))
    return found.join(at("start"), ["host", "start"]).join(at("end"), ["host", "end"])


@query(f"""WITH {drawn_sql(12)}, p2 AS (SELECT d.host, path_index, lca_depth, x.parts AS sp, y.parts AS ep, list_transform(range(lca_depth + 1, x.depth + 1), lambda q: array_to_string(x.parts[1:q], '/')) || list_transform(range(lca_depth + 1, y.depth + 1), lambda q: array_to_string(y.parts[1:q], '/')) AS edges
    FROM d JOIN z x ON x.host = d.host AND x.number = i JOIN z y ON y.host = d.host AND y.number = j),
  q AS (SELECT a.host, a.path_index AS l, b.path_index AS r, a.lca_depth AS la, b.lca_depth AS lb, len(a.edges) AS na, len(b.edges) AS nb, len(list_intersect(a.edges, b.edges)) AS common,
    list_transform([[a.sp, b.sp], [a.ep, b.ep], [a.sp, b.ep], [a.ep, b.sp], [a.sp[1:a.lca_depth], b.sp[1:b.lca_depth]]], lambda v: len(v[1]) + len(v[2]) - 2 * len(list_filter(range(1, least(len(v[1]), len(v[2])) + 1), lambda i: v[1][1:i] = v[2][1:i]))) AS t FROM p2 a JOIN p2 b ON a.host = b.host AND a.path_index < b.path_index)
  SELECT host, l AS "left", r AS "right", t[1] + t[2] AS oriented, least(t[1] + t[2], t[3] + t[4]) AS unoriented, na + nb - 2 * common AS edge_difference, round(1 - common / (na + nb - common), 6) AS edge_jaccard, abs(la - lb) AS lca_depth_difference,
    round(sqrt(t[5] * t[5] + least(t[1] * t[1] + t[2] * t[2], t[3] * t[3] + t[4] * t[4])), 6) AS anchored, abs(na - nb) AS length_difference, la AS left_lca_depth, lb AS right_lca_depth, na AS left_length, nb AS right_length FROM q""")
def host_path_relations(spark, sf_dir):
    found = drawn_parts(spark, sf_dir, 12).select("host", "path_index", F.col("start_parts").alias("start"), F.col("end_parts").alias("end"), "lca_depth")
    return rounded(paths.path_relations(found, "host"), 6, "edge_jaccard", "anchored")


@query(f"""WITH {NUMBERED}, q AS (SELECT a.host, (b.number <= a.last)::INT AS label, b.depth - a.depth AS gap, a.depth + b.depth - 2 * len(list_filter(range(1, least(a.depth, b.depth) + 1), lambda i: a.parts[1:i] = b.parts[1:i])) AS far, (b.parent IS NOT DISTINCT FROM a.number)::INT AS direct FROM w a JOIN w b ON a.host = b.host AND a.number < b.number)
  SELECT host, label, gap, count(*) AS pairs, sum(far)::BIGINT AS distances, sum(direct)::BIGINT AS direct FROM q GROUP BY ALL""")
def host_order_relations(spark, sf_dir):
    nodes = host_nodes(spark, sf_dir).withColumn("ancestors", F.concat(F.array(F.lit("")), F.col("parts")))
    found = paths.order_relations(nodes, "host", incomparable=True)
    return found.groupBy("host", "label", "gap").agg(F.count("*").alias("pairs"), F.sum("distance").alias("distances"), F.sum(F.col("direct").cast("int")).alias("direct"))


@query(f"""WITH {drawn_sql(32)}, v AS (SELECT host, number, array_to_string(list_transform(parts, lambda x: x[1]), '/') AS sign FROM z), q AS (SELECT d.host, lca, least(i, j) AS a, greatest(i, j) AS b, m.sign AS ms, least(x.sign, y.sign) AS xs, greatest(x.sign, y.sign) AS ys FROM d JOIN v m ON m.host = d.host AND m.number = lca JOIN v x ON x.host = d.host AND x.number = i JOIN v y ON y.host = d.host AND y.number = j),
  q2 AS (SELECT host, count(DISTINCT lca) AS lcas, count(DISTINCT ms) AS lca_signatures, count(DISTINCT (lca, a, b)) AS paths, count(DISTINCT (ms, xs, ys)) AS path_signatures FROM q GROUP BY host), q1 AS (SELECT host, count(*) AS nodes, count(DISTINCT sign) AS node_signatures FROM v GROUP BY host)
  SELECT host, nodes, node_signatures, lcas, lca_signatures, paths, path_signatures, round((nodes - node_signatures) / nodes, 6) AS node_rate, round((lcas - lca_signatures) / lcas, 6) AS lca_rate, round((paths - path_signatures) / paths, 6) AS path_rate FROM q1 JOIN q2 USING (host)""")
def host_identifiability(spark, sf_dir):
    nodes = graphs.cut(host_nodes(spark, sf_dir))
    signed = nodes.select("host", "node", F.array_join(F.transform("parts", lambda p: F.substring(p, 1, 1)), "/").alias("signature"))
    return rounded(paths.identifiability(signed, paths.sampled_paths(nodes, "host", 32), "host"), 6, "node_rate", "lca_rate", "path_rate")


@query(f"""WITH p AS (SELECT page_id, host, list_filter(string_split(path, '/'), lambda x: x != '') AS parts FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS path FROM pages) WHERE host != ''),
  w AS (SELECT host, greatest(max(len(parts)), 1) AS longest FROM p GROUP BY host), q AS (SELECT a.host, a.page_id, len(a.parts) AS n, len(b.parts) AS m, len(list_filter(range(1, least(len(a.parts), len(b.parts)) + 1), lambda i: a.parts[1:i] = b.parts[1:i])) AS s FROM p a JOIN p b ON a.host = b.host AND a.page_id != b.page_id),
  g AS (SELECT host, page_id, avg(n + m - 2 * s) AS mean, max(n + m - 2 * s) AS far, avg(s) AS shared FROM q GROUP BY ALL)
  SELECT p.host, p.page_id, round(len(parts) / longest, 6) AS length, round(coalesce(mean / (2 * longest), 0), 6) AS mean_distance, round(coalesce(far / (2 * longest), 0), 6) AS max_distance, round(coalesce(shared / longest, 0), 6) AS mean_shared FROM p JOIN w USING (host) LEFT JOIN g ON g.host = p.host AND g.page_id = p.page_id""")
def page_contexts(spark, sf_dir):
    url = F.col("url")
    rows = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "://([^/?#]*)", 1).alias("host"), text.path_components(F.regexp_extract(url, "://[^/?#]*/([^?#]*)", 1)).alias("parts")).where("host != ''")
    return rounded(paths.context_features(rows, "host", "page_id", "parts"), 6, "length", "mean_distance", "max_distance", "mean_shared")


@query()
def host_transport(spark, sf_dir):
    """Each host's tree against the next one's under the same top domain, by fused Gromov-Wasserstein of their drawn paths."""
    found = graphs.cut(drawn_parts(spark, sf_dir, 8))
    ends = found.select("host", "path_index", F.col("start_parts").alias("start"), F.col("end_parts").alias("end"), "lca_depth")
    kinds = lambda parts, way: F.transform(parts, lambda x: F.concat(F.lit(way), F.substring(x, 1, 1)))
    tokens = found.select("host", "path_index", F.array_distinct(F.concat(kinds("start_parts", "up:"), kinds("end_parts", "down:"))).alias("tokens"))
    spaces = graphs.cut(batched.path_spaces(paths.path_relations(ends, "host"), tokens, "host", ("unoriented", "anchored", "edge_jaccard")))
    beside = Window.partitionBy(F.regexp_extract("host", "[^.]*$", 0)).orderBy("host")
    pairs = spaces.select("host", "space", F.lead("host").over(beside).alias("next"), F.lead("space").over(beside).alias("next_space")).where("next IS NOT NULL")
    return pairs.select("host", "next", batched.fused_distances("space", "next_space").alias("t")).select("host", "next", *[F.round(f"t.{c}", 5).alias(c) for c in ("objective", "structure", "feature")])


# Points


@query("""WITH v AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS p, embedding[33:64]::DOUBLE[] AS q FROM embeddings), g AS (SELECT x.vec_id AS query, y.vec_id AS item, list_distance(x.p, y.p) ** 2 AS pp, list_distance(x.p, y.q) ** 2 AS pq, list_distance(x.q, y.p) ** 2 AS qp, list_distance(x.q, y.q) ** 2 AS qq, list_distance(x.p, x.q) ** 2 AS xs, list_distance(y.p, y.q) ** 2 AS ys FROM v x, v y WHERE x.vec_id % 20 = 0),
  m AS (SELECT *, 0.5 / (1 + exp(-(pq + qp - pp - qq) / 8)) AS a, 0.5 / (1 + exp(-xs / 4)) AS b, 0.5 / (1 + exp(-ys / 4)) AS c FROM g),
  o AS (SELECT query, item, a * (pp + qq) + (0.5 - a) * (pq + qp) + 8 * (a * ln(greatest(4 * a, 1e-300)) + (0.5 - a) * ln(greatest(4 * (0.5 - a), 1e-300))) AS xy, (1 - 2 * b) * xs + 8 * (b * ln(4 * b) + (0.5 - b) * ln(greatest(4 * (0.5 - b), 1e-300))) AS xx, (1 - 2 * c) * ys + 8 * (c * ln(4 * c) + (0.5 - c) * ln(greatest(4 * (0.5 - c), 1e-300))) AS yy FROM m),
  d AS (SELECT query, item, greatest(xy - (xx + yy) / 2, 0) AS distance FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), item) AS rank FROM d)
  SELECT query, item, round(distance, 5) + 0 AS distance, rank::INT AS rank FROM r WHERE rank <= 10""")
def vector_divergences(spark, sf_dir):
    """Vectors as measures of their two halves: the plan between two such has a closed form."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    found = blocks.nearest(rows.where("id % 20 = 0"), rows, blocks.halves_divergence(4.0), 10, own=True)
    return found.select("query", "item", (F.round("distance", 5) + 0.0).alias("distance"), "rank")


@query("""WITH k AS (SELECT vec_id, label, sha256('control|' || vec_id) AS h FROM embeddings), p AS (SELECT *, row_number() OVER (ORDER BY label, h, vec_id) - 1 AS spot, count(*) OVER () AS n FROM k), g AS (SELECT label, min(spot) AS first, count(*) AS size FROM p GROUP BY label), f AS (SELECT max(size) AS far FROM g)
  SELECT p.vec_id AS id, p.label AS "group", a.vec_id AS other, a.label AS other_group, CASE WHEN size > 1 THEN b.vec_id END AS beside FROM p JOIN g USING (label), f JOIN p a ON TRUE JOIN p b ON TRUE WHERE a.spot = (p.spot + far) % p.n AND b.spot = first + (p.spot - first + 1) % size""")
def vector_controls(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    other = controls.derangement(rows, "vec_id", "label", "control").withColumnsRenamed({"image": "other", "image_group": "other_group"})
    return other.join(controls.shuffled_within(rows, "vec_id", "label", "control").select("id", F.col("image").alias("beside")), "id")


#: Weights of two views.
VIEW_GRID = [(i / 10, 1 - i / 10) for i in range(11)]


@query("""WITH v AS (SELECT vec_id, label, embedding[1:32]::DOUBLE[] AS p, embedding[33:64]::DOUBLE[] AS q, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, count(*) OVER (PARTITION BY label) AS size FROM embeddings WHERE label IS NOT NULL), k AS (SELECT * FROM v WHERE size > 1), f AS (SELECT unnest(range(least(4, (SELECT min(size) FROM k)))) AS fold),
  s AS (SELECT fold, x.vec_id AS query, y.vec_id AS item, x.label = y.label AS same, list_cosine_similarity(x.p, y.p) AS a, list_cosine_similarity(x.q, y.q) AS b FROM f JOIN k x ON x.place != fold JOIN k y ON y.place = fold), g AS (SELECT unnest(range(11))::INT AS choice),
  r AS (SELECT choice, fold, query, same, row_number() OVER (PARTITION BY choice, fold, query ORDER BY round(a * (choice / 10.0::DOUBLE) + b * (1 - choice / 10.0::DOUBLE), 9) DESC, item) AS n FROM s, g), m AS (SELECT choice, round(avg(1 / n), 12) AS mrr FROM (SELECT choice, fold, query, min(n) FILTER (same) AS n FROM r GROUP BY ALL) GROUP BY choice),
  t AS (SELECT first(choice ORDER BY mrr DESC, choice DESC) AS c, max(mrr) AS m, first(choice ORDER BY choice) FILTER (choice = 0) AS z, max(mrr) FILTER (choice = 0) AS zm FROM m)
  SELECT choice, round(mrr, 6) AS mrr, choice = CASE WHEN c > 0 AND m <= zm + 0.001 THEN z ELSE c END AS chosen FROM m, t""")
def view_weights(spark, sf_dir):
    halves = {v: F.transform(F.slice("embedding", i, 32), lambda x: x.cast("double")) for v, i in (("p", 1), ("q", 33))}
    rows = graphs.cut(read(spark, sf_dir, "embeddings").select("vec_id", "label", *[c.alias(v) for v, c in halves.items()]))
    pairs = controls.fold_pairs(rows, "vec_id", "label")
    both = pairs.join(rows.select(F.col("vec_id").alias("query"), F.col("p").alias("xp"), F.col("q").alias("xq")), "query").join(rows.select(F.col("vec_id").alias("item"), F.col("p").alias("yp"), F.col("q").alias("yq")), "item")
    scored = graphs.cut(both.select("fold", "query", "query_label", "item", "item_label", *[distance.cosine(F.col(f"x{v}"), F.col(f"y{v}")).alias(v) for v in ("p", "q")]))
    found = controls.weight_choice(controls.first_positives(scored, ["p", "q"], VIEW_GRID), VIEW_GRID, guard=0, margin=0.001)
    return rounded(found, 6, "mrr")


@query("""WITH d AS (SELECT c_nationkey AS c, c_acctbal AS x, c_custkey::DOUBLE AS y FROM customer), u AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT c FROM d)),
  w AS (SELECT rep, ('0x' || substr(sha256('ranks|' || rep || '|' || j), 1, 8))::BIGINT % n AS i FROM (SELECT max(n) AS n FROM u), range(20) r(rep), range(1000) q(j) WHERE j < n), k AS (SELECT rep, x, y FROM w JOIN u USING (i) JOIN d USING (c)),
  r AS (SELECT rep, rank() OVER (PARTITION BY rep ORDER BY x) + (count(*) OVER (PARTITION BY rep, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY rep ORDER BY y) + (count(*) OVER (PARTITION BY rep, y) - 1) / 2 AS ry FROM k), m AS (SELECT rep, corr(rx, ry) AS m FROM r GROUP BY rep), s AS (SELECT list_sort(list(m)) AS l FROM m)
  SELECT (SELECT max(n) FROM u) AS clusters, round(l[1], 6) AS low, round(l[20], 6) AS high FROM s""")
def rank_resampling(spark, sf_dir):
    return rounded(controls.spearman_bootstrap(read(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", "c_custkey", 20, "ranks"), 6, "low", "high")



@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS l, b.vec_id AS r, a.e AS x, b.e AS y FROM v a JOIN v b ON a.vec_id != b.vec_id),
  s AS (SELECT l, r, list_transform([0, 1, 2, 3], lambda f: list_sum(list_transform(range(1, 17), lambda i: pow(x[f * 16 + i] - y[f * 16 + i], 2)))) AS d, list_transform([0, 1, 2, 3], lambda f: list_sum(list_transform(range(1, 17), lambda i: pow(x[f * 16 + i], 2)))) AS xx, list_transform([0, 1, 2, 3], lambda f: list_sum(list_transform(range(1, 17), lambda i: pow(y[f * 16 + i], 2)))) AS yy FROM p)
  SELECT l AS "left", r AS "right", round(list_sum(list_transform([1, 2, 3, 4], lambda f: pow(2 / sqrt(0.5) * asinh(sqrt(0.5) * sqrt(d[f]) / sqrt((1 - 0.5 * xx[f]) * (1 - 0.5 * yy[f]))), 2))), 5) AS cost FROM s""")
def product_costs(spark, sf_dir):
    """Costs of all pairs of vectors, whose four quarters are places in four balls."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    pairs = blocks.costs(rows, rows, blocks.product(4, 0.5))
    return pairs.select(F.col("query").alias("left"), F.col("item").alias("right"), F.round("distance", 5).alias("cost"))


# Learnt from sums


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT a.vec_id AS l, b.vec_id AS r, list_distance(a.e[1:32], b.e[1:32]) AS p, list_distance(a.e[33:64], b.e[33:64]) AS q, list_distance(a.e, b.e) AS t, ('0x' || substr(sha256('student|' || a.vec_id || '|' || b.vec_id), 1, 13))::BIGINT / 4503599627370496.0 < 0.5 AS train FROM v a JOIN v b ON a.vec_id != b.vec_id),
  m AS (SELECT avg(p) AS mp, avg(q) AS mq, avg(t) AS mt, greatest(stddev_pop(p), 1e-6) AS sp, greatest(stddev_pop(q), 1e-6) AS sq, greatest(stddev_pop(t), 1e-6) AS st, corr(p, q) AS pq, corr(p, t) AS pt, corr(q, t) AS qt FROM d WHERE train),
  w AS (SELECT *, (pt * 1.0001 - qt * pq) / (1.0001 * 1.0001 - pq * pq) AS wp, (qt * 1.0001 - pt * pq) / (1.0001 * 1.0001 - pq * pq) AS wq FROM m), o AS (SELECT wp, wq, (wp * (p - mp) / sp + wq * (q - mq) / sq) * st + mt - t AS off FROM d, w WHERE NOT train)
  SELECT count(*) AS n, round(avg(abs(off)), 6) AS mae, round(sqrt(avg(off * off)), 6) AS rmse, round(any_value(wp), 5) AS first_half, round(any_value(wq), 5) AS second_half FROM o""")
def distance_student(spark, sf_dir):
    """A student of the vectors' distance that sees those of their halves: learnt from one half of all pairs, judged on the other."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    parts = [lambda x, y: blocks.euclidean(x[:, :32], y[:, :32]), lambda x, y: blocks.euclidean(x[:, 32:], y[:, 32:])]
    weights, found = blocks.student(rows, rows, parts, blocks.euclidean, "student")
    return rounded(found, 6, "mae", "rmse").select("*", *[F.lit(round(float(w), 5)).alias(n) for w, n in zip(weights, ("first_half", "second_half"), strict=True)])


@query()
def label_means(spark, sf_dir):
    """The Fréchet mean of each label's vectors, drawn into the ball."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = read(spark, sf_dir, "embeddings").select("label", F.transform(v, lambda x: x / (1 + length)).alias("point"))
    found = riemann.frechet_means(rows, "label", "point", 1.0)
    return found.select("label", "n", F.transform("mean", lambda x: F.round(x, 6)).alias("mean"), F.round("spread", 6).alias("spread"))


@query()
def host_order_probe(spark, sf_dir):
    """Points of hosts' path trees learnt from direct steps, judged by farther ones."""
    nodes = graphs.cut(host_nodes(spark, sf_dir).select("host", "node", "parent", "last", "depth"))
    return rounded(probe.order_probe(nodes, "host", epochs=8), 4, "auc", "positive_energy", "negative_energy")
