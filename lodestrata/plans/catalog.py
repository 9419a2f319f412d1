"""The registered queries of the engine and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import distance, hashing, text
from lodestrata.operators import blocks, corpus, features, graphs, retrieval, sampling, stats, transport, trees
from lodestrata.plans import evaluation, structures  # noqa: F401  register their queries
from lodestrata.plans.registry import BEACON, INNER, ORACLE_SQL, OUTER, QUERIES, hmac_sql, nul_joined, query, read, rounded
from lodestrata.streaming import events as streams

FLAGSHIP = "retrieval_macro"


# Relational reports


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
  round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    out = rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_discount").alias("discount"))
    return rounded(rounded(out, 2, "quantity", "revenue"), 6, "discount")


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, nation
  WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_nationkey = n_nationkey GROUP BY n_name""")
def nation_revenue(spark, sf_dir):
    revenue = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(revenue, F.col("o_orderkey") == F.col("l_orderkey"))
    by_nation = orders.join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    named = by_nation.groupBy("c_nationkey").agg(F.sum("r").alias("r")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS price, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def top_orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", F.round("o_totalprice", 2).alias("price"), "o_orderpriority")


@query("""SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def strict_metadata_join(spark, sf_dir):
    keyed = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_extendedprice")
    joined = corpus.strict_join(keyed, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority"), ["key"])
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(count(*) / count(DISTINCT user_id), 6) AS per_user FROM events GROUP BY event_type""")
def user_cluster_summary(spark, sf_dir):
    by_user = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return by_user.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("user_id").alias("users"), F.round(F.sum("n") / F.count("user_id"), 6).alias("per_user"))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def customers_without_orders(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("""SELECT count(*) FILTER (WHERE l AND r) AS "both", count(*) FILTER (WHERE l AND NOT r) AS left_only, count(*) FILTER (WHERE r AND NOT l) AS right_only FROM (
  SELECT k, bool_or(s = 0) AS l, bool_or(s = 1) AS r FROM (SELECT c_nationkey AS k, 0 AS s FROM customer UNION ALL SELECT s_nationkey, 1 FROM supplier) GROUP BY k)""")
def frame_overlap(spark, sf_dir):
    return corpus.overlap(read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("""SELECT try_cast(props->>'k' AS BIGINT) AS k, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1""")
def event_properties(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), "value")
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("""SELECT c_mktsegment, count(*) FILTER (WHERE r = 'train') AS train, count(*) FILTER (WHERE r = 'query') AS query, count(*) FILTER (WHERE r = 'gallery') AS gallery FROM (
  SELECT c_mktsegment, CASE WHEN n <= 40 THEN 'train' WHEN n <= 50 THEN 'query' ELSE 'gallery' END AS r FROM (
    SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(encode('roles') || '\\x00'::BLOB || encode(c_custkey::VARCHAR)), c_custkey) AS n FROM customer) WHERE n <= 60) GROUP BY ALL""")
def role_counts(spark, sf_dir):
    split = sampling.role_split(read(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", "roles", [("train", 40), ("query", 10), ("gallery", 10)])
    out = split.groupBy("c_mktsegment").pivot("role", ["train", "query", "gallery"]).count()
    return out.na.fill(0)


# Duplicates


@query("""SELECT 'exact-' || substr(sha256(array_to_string(list_sort(list(doc_id::VARCHAR)), chr(10))), 1, 20) AS component_id, min(doc_id) AS canonical, count(*) AS members
  FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1""")
def exact_duplicates(spark, sf_dir):
    return corpus.exact_duplicates(read(spark, sf_dir, "documents").select("doc_id", hashing.sha256(F.col("text")).alias("digest")), "digest", "doc_id")


@query("""SELECT lang, count(*) AS n FROM (SELECT *, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents) WHERE doc_id = first AND n_chars >= 200 GROUP BY lang""")
def retained_documents(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", hashing.sha256(F.col("text")).alias("digest"), (F.col("n_chars") >= 200).alias("ok"))
    return corpus.retained(rows, "digest", "doc_id", "ok").groupBy("lang").agg(F.count("*").alias("n"))


LINES = """WITH lines AS (SELECT DISTINCT source AS g, sha256(l) AS h FROM (SELECT source, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE l IS NOT NULL),
  n AS (SELECT g, count(*) AS n FROM lines GROUP BY g)"""


@query(LINES + """ SELECT x.g AS "left", y.g AS "right", count(*) AS shared, round(count(*) / least(any_value(a.n), any_value(b.n)), 6) AS share
  FROM lines x JOIN lines y ON x.h = y.h AND x.g < y.g JOIN n a ON a.g = x.g JOIN n b ON b.g = y.g GROUP BY 1, 2 HAVING count(*) >= 5 AND count(*) / least(any_value(a.n), any_value(b.n)) >= 0.05""")
def shared_line_edges(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return rounded(corpus.shared_digest_edges(lines.select("source", hashing.sha256(F.col("line")).alias("h")), "h", "source"), 6, "share")


SHINGLES = """WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
  sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM words WHERE len(w) >= 5),
  reps AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM sets GROUP BY s), items AS (SELECT id, n, unnest(s) AS g FROM reps),
  pairs AS (SELECT a.id AS l, b.id AS r, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM items a JOIN items b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)"""


def shingle_sets(spark, sf_dir) -> DataFrame:
    corpus.bound_batches(spark)
    sets = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.token_shingles(F.col("text"), 5).alias("items"))
    return sets.where("size(items) > 0")


@query(SHINGLES + """ SELECT l AS "left", r AS "right", round(j, 6) AS similarity FROM pairs WHERE j + 1e-15 >= 0.9""")
def fuzzy_pairs(spark, sf_dir):
    return rounded(corpus.fuzzy_pairs(shingle_sets(spark, sf_dir), 0.9, 64, 4), 6, "similarity")


@query(SHINGLES + """, links AS (SELECT l, r FROM pairs WHERE j + 1e-15 >= 0.9 UNION ALL SELECT r, l FROM pairs WHERE j + 1e-15 >= 0.9),
  reach(a, b) AS (SELECT id, id FROM reps UNION SELECT reach.a, links.r FROM reach JOIN links ON links.l = reach.b),
  comps AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a) SELECT component, count(*) AS nodes FROM comps GROUP BY component HAVING count(*) > 1""")
def fuzzy_components(spark, sf_dir):
    sets = shingle_sets(spark, sf_dir)
    pairs = corpus.fuzzy_pairs(sets, 0.9, 64, 4).select("left", "right")
    nodes = pairs.select(F.col("left").alias("node")).union(pairs.select("right"))
    return graphs.connected_components(nodes, pairs).groupBy("component").agg(F.count("*").alias("nodes")).where("nodes > 1")


@query()
def page_text_groups(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", hashing.sha256(text.html_visible_text(F.col("html"))).alias("digest"))
    return pages.groupBy("digest").agg(F.count("*").alias("pages"), F.min("page_id").alias("first"))


# Trees and graphs of URL paths

PATHS = """WITH RECURSIVE p AS (SELECT string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/') AS raw FROM pages), parts AS (SELECT list_filter(raw, lambda x: x <> '') AS a FROM p),
  nodes AS (SELECT DISTINCT array_to_string(a[1:i], '/') AS node, CASE WHEN i > 0 THEN array_to_string(a[1:i - 1], '/') END AS parent, i::INTEGER AS depth FROM (SELECT a, unnest(range(0, len(a) + 1)) AS i FROM parts)),
  edges AS (SELECT parent AS l, node AS r FROM nodes WHERE parent IS NOT NULL)"""


def url_tree(spark, sf_dir) -> DataFrame:
    paths = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"))
    return graphs.path_tree(paths)


def tree_edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent IS NOT NULL").select(F.col("parent").alias("left"), F.col("node").alias("right"))


@query(PATHS + " SELECT depth, count(*) AS nodes, count(DISTINCT parent) AS parents FROM nodes GROUP BY depth")
def url_tree_depths(spark, sf_dir):
    return url_tree(spark, sf_dir).groupBy("depth").agg(F.count("*").alias("nodes"), F.countDistinct("parent").alias("parents"))


@query(PATHS + """, ends AS (SELECT l AS node FROM edges UNION ALL SELECT r FROM edges), d AS (SELECT node, count(*) AS d FROM ends GROUP BY node)
  SELECT l AS "left", r AS "right", 4 - a.d - b.d AS curvature FROM edges JOIN d a ON a.node = l JOIN d b ON b.node = r""")
def forman_curvature(spark, sf_dir):
    return graphs.forman_curvature(tree_edges(url_tree(spark, sf_dir)))


@query(PATHS + """, both_ AS (SELECT l, r FROM edges UNION SELECT r, l FROM edges), one AS (SELECT l AS node, l AS at FROM both_ UNION SELECT l, r FROM both_),
  two AS (SELECT * FROM one UNION SELECT one.node, both_.r FROM one JOIN both_ ON one.at = both_.l)
  SELECT node, 1 AS radius, count(*) AS size FROM one GROUP BY node UNION ALL SELECT node, 2, count(*) FROM two GROUP BY node""")
def ball_growth(spark, sf_dir):
    return graphs.forest_ball_sizes(tree_edges(url_tree(spark, sf_dir)), (1, 2))


@query(PATHS + """ SELECT string_split(r, '/')[1] AS component, count(*) AS nodes FROM (SELECT r FROM edges WHERE l <> '' UNION SELECT l FROM edges WHERE l <> '') GROUP BY 1""")
def host_components(spark, sf_dir):
    edges = tree_edges(url_tree(spark, sf_dir)).where("left != ''")
    nodes = edges.select(F.col("left").alias("node")).union(edges.select("right"))
    return graphs.connected_components(nodes, edges).groupBy("component").agg(F.count("*").alias("nodes"))


@query(PATHS + """ SELECT ancestor, count(*) AS descendants, round(avg(gap), 6) AS mean_gap FROM (
  SELECT array_to_string(a[1:i], '/') AS ancestor, len(a) - i AS gap FROM (SELECT DISTINCT string_split(node, '/') AS a FROM nodes WHERE node <> ''), range(1, 20) t(i) WHERE i < len(a)) GROUP BY ancestor""")
def ancestor_pairs(spark, sf_dir):
    nodes = url_tree(spark, sf_dir).where("node != ''").select("node", F.transform(F.sequence(F.lit(1), F.size(F.split("node", "/"))), lambda i: F.array_join(F.slice(F.split("node", "/"), 1, i), "/")).alias("ancestors"))
    return graphs.strict_ancestors(nodes).groupBy("ancestor").agg(F.count("*").alias("descendants"), F.round(F.avg("gap"), 6).alias("mean_gap"))


# Splits and samples


@query("""WITH w AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1), e AS (SELECT nation, 1000 * n / sum(n) OVER () AS x FROM w), f AS (SELECT nation, x, floor(x) AS fl FROM e)
  SELECT nation, (fl + CASE WHEN row_number() OVER (ORDER BY round(x - fl, 9) DESC, nation) <= 1000 - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f""")
def hamilton_quotas(spark, sf_dir):
    weights = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return sampling.hamilton_quotas(weights, "nation", "n", 1000)


@query(f"""SELECT c_custkey, digest, split FROM (SELECT c_custkey, digest, CASE WHEN n <= 60 THEN 'train' WHEN n <= 80 THEN 'validation' WHEN n <= 100 THEN 'test' ELSE 'reserve' END AS split FROM (
  SELECT c_custkey, digest, row_number() OVER (ORDER BY digest, c_custkey) AS n FROM (SELECT c_custkey, {hmac_sql(nul_joined("'r1'", "c_custkey"))} AS digest FROM customer)))""")
def keyed_split(spark, sf_dir):
    return sampling.quota_split(read(spark, sf_dir, "customer"), "c_custkey", BEACON, "r1", [("train", 60), ("validation", 20), ("test", 20)]).select("c_custkey", "digest", "split")


@query(f"""SELECT event_type, user_id, event_id, digest, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY digest, user_id) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY digest, event_id) AS n FROM (SELECT event_type, user_id, event_id, {hmac_sql(nul_joined("'top'", "event_type", "user_id", "event_id"))} AS digest FROM events)) WHERE n = 1) WHERE rank <= 10""")
def keyed_top_users(spark, sf_dir):
    return sampling.keyed_top_k(read(spark, sf_dir, "events"), "event_type", "user_id", "event_id", BEACON, "top", 10)


@query(f"""WITH r AS (SELECT DISTINCT c_nationkey AS g, c_custkey AS i FROM customer), z AS (SELECT g, count(*)::UBIGINT AS size FROM r GROUP BY g), n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY i) - 1 AS n FROM r),
  s AS (SELECT 'same' AS pair_type, x.g AS left_group, x.i AS left_item, y.g AS right_group, y.i AS right_item FROM r x JOIN r y ON x.g = y.g AND x.i < y.i), sd AS (SELECT *, {hmac_sql(nul_joined("'cal'", "'r1'", "'same_cluster_rank'", "left_group", "left_item", "right_item"))} AS digest FROM s),
  t AS (SELECT a.g AS left_group, b.g AS right_group, a.size AS ls, b.size AS rs FROM z a JOIN z b ON a.g < b.g), u AS (SELECT *, ('0x' || substr({hmac_sql(nul_joined("'cal'", "'r1'", "'cross_left_program'", "left_group", "right_group"))}, 1, 16))::UBIGINT % ls AS ln, ('0x' || substr({hmac_sql(nul_joined("'cal'", "'r1'", "'cross_right_program'", "left_group", "right_group"))}, 1, 16))::UBIGINT % rs AS rn FROM t),
  c AS (SELECT 'cross' AS pair_type, left_group, a.i AS left_item, right_group, b.i AS right_item FROM u JOIN n a ON a.g = left_group AND a.n = ln JOIN n b ON b.g = right_group AND b.n = rn), cd AS (SELECT *, {hmac_sql(nul_joined("'cal'", "'r1'", "'cross_cluster_rank'", "left_group", "right_group", "left_item", "right_item"))} AS digest FROM c)
  SELECT * FROM (SELECT * FROM sd ORDER BY digest LIMIT 50) UNION ALL SELECT * FROM (SELECT * FROM cd ORDER BY digest LIMIT 50)""")
def calibration_pairs(spark, sf_dir):
    """The first pairs by digest, of all pairs of customers of one nation and of one pair for every two nations."""
    return sampling.every_calibration_pair(read(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", BEACON, "cal", "r1", 50, 50)


@query()
def every_calibration_pair(spark, sf_dir):
    """Over all pairs of the training rows of a split; held against brute force on a fixture."""
    split = sampling.role_split(read(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "roles", [("train", 200), ("query", 50)])
    return sampling.every_calibration_pair(split.where("role = 'train'"), "c_nationkey", "c_custkey", BEACON, "cal", "r1", 50, 50)


@query("""SELECT candidate::BIGINT AS candidate, sum((n >= candidate)::BIGINT)::BIGINT AS eligible, sum((n >= candidate)::INT) / count(*) >= 0.5 AS feasible
  FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), (VALUES (16), (32), (56), (64)) t(candidate) GROUP BY candidate""")
def sampling_design(spark, sf_dir):
    sizes = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return sampling.design_search(spark, sizes, "n", [16, 32, 56, 64], 0.5)


@query("""SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256(encode('s') || '\\x00'::BLOB || encode(vec_id::VARCHAR)), vec_id) AS n FROM embeddings) WHERE n <= 5""")
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(read(spark, sf_dir, "embeddings"), "label", "vec_id", "s", 5).select("label", "vec_id")


# Retrieval over the embedding gallery; the stated queries are the ids divisible by 20

PAIRS = """WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), pairs AS (SELECT q.id AS query, q.label AS q_label, g.id AS item, {d} AS distance, q.label = g.label AS relevant
  FROM e q JOIN e g ON q.id <> g.id WHERE q.id % 20 = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), item) AS rank FROM pairs),
  cum AS (SELECT *, sum(relevant::INT) OVER (PARTITION BY query ORDER BY rank) / rank AS prec FROM ranked),
  scores AS (SELECT query, q_label, sum(relevant::INT)::BIGINT AS positives, avg(prec) FILTER (WHERE relevant) AS average_precision, 1 / min(rank) FILTER (WHERE relevant) AS reciprocal_rank,
    count(*) FILTER (WHERE relevant AND rank <= 1) AS t1, count(*) FILTER (WHERE relevant AND rank <= 5) AS t5, count(*) FILTER (WHERE relevant AND rank <= 10) AS t10 FROM cum GROUP BY 1, 2 HAVING sum(relevant::INT) > 0)"""
EUCLID = "list_distance(q.v, g.v)"


def vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The stated queries and the whole gallery: id, label and v."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return rows.where("id % 20 = 0"), rows


MEASURES = ["average_precision", "reciprocal_rank", "recall_1", "recall_5", "recall_10"]


@query(PAIRS.format(d=EUCLID) + """ SELECT query, q_label, positives, round(average_precision, 6) AS average_precision, round(reciprocal_rank, 6) AS reciprocal_rank, round(t1 / positives, 6) AS recall_1,
  round(t5 / positives, 6) AS recall_5, round(t10 / positives, 6) AS recall_10, (t1 > 0)::INT AS hit_1, (t5 > 0)::INT AS hit_5, (t10 > 0)::INT AS hit_10 FROM scores""")
def retrieval_scores(spark, sf_dir):
    return rounded(blocks.scores(*vectors(spark, sf_dir), blocks.euclidean), 6, *MEASURES)


@query(PAIRS.format(d=EUCLID) + """, by_label AS (SELECT q_label, avg(average_precision) AS ap, avg(reciprocal_rank) AS rr, avg(t10 / positives) AS r10 FROM scores GROUP BY 1)
  SELECT count(*) AS n_labels, round(avg(ap), 6) AS average_precision, round(avg(rr), 6) AS reciprocal_rank, round(avg(r10), 6) AS recall_10 FROM by_label""")
def retrieval_macro(spark, sf_dir):
    measures = ["average_precision", "reciprocal_rank", "recall_10"]
    return rounded(retrieval.macro(blocks.scores(*vectors(spark, sf_dir), blocks.euclidean), measures), 6, *measures)


@query(PAIRS.format(d=EUCLID) + """ SELECT query, q_label, round(coalesce(sum(prec) FILTER (WHERE relevant AND rank <= 10), 0) / least(10, sum(relevant::INT)), 6) AS map_at_r FROM cum GROUP BY 1, 2 HAVING sum(relevant::INT) > 0""")
def retrieval_map_at_r(spark, sf_dir):
    return rounded(blocks.average_precision_at_r(*vectors(spark, sf_dir), blocks.euclidean, 10), 6, "map_at_r")


@query(PAIRS.format(d=EUCLID) + " SELECT query, item, rank, round(distance, 6) AS distance, relevant FROM ranked WHERE rank <= 10")
def gallery_top_k(spark, sf_dir):
    return rounded(blocks.nearest(*vectors(spark, sf_dir), blocks.euclidean, 10), 6, "distance").select("query", "item", F.col("rank").cast("long").alias("rank"), "distance", "relevant")


@query(PAIRS.format(d="1 - list_cosine_similarity(q.v, g.v)") + " SELECT query, item, rank, round(distance, 6) AS distance FROM ranked WHERE rank <= 10")
def cosine_top_k(spark, sf_dir):
    return rounded(blocks.nearest(*vectors(spark, sf_dir), blocks.cosine, 10), 6, "distance").select("query", "item", F.col("rank").cast("long").alias("rank"), "distance")


POINCARE = "acosh(greatest(1.0, 1 + 2 * pow(list_distance(q.h, g.h), 2) / (greatest(1e-12, 1 - list_dot_product(q.h, q.h)) * greatest(1e-12, 1 - list_dot_product(g.h, g.h)))))"


@query(PAIRS.format(d=POINCARE).replace("embedding::DOUBLE[] AS v", "list_transform(embedding::DOUBLE[], lambda x: x / 2) AS h") + " SELECT query, item, rank, round(distance, 6) AS distance FROM ranked WHERE rank <= 10")
def poincare_top_k(spark, sf_dir):
    return rounded(blocks.nearest(*vectors(spark, sf_dir), lambda x, y: blocks.poincare(x / 2, y / 2), 10), 6, "distance").select("query", "item", F.col("rank").cast("long").alias("rank"), "distance")


@query(PAIRS.format(d=EUCLID) + """ SELECT query, round(min(distance) FILTER (WHERE relevant), 6) AS positive, round(min(distance) FILTER (WHERE NOT relevant), 6) AS negative,
  round(min(distance) FILTER (WHERE NOT relevant) - min(distance) FILTER (WHERE relevant), 6) AS margin FROM pairs GROUP BY query""")
def nearest_negatives(spark, sf_dir):
    return rounded(blocks.nearest_of_both(*vectors(spark, sf_dir), blocks.euclidean), 6, "positive", "negative", "margin")


@query(PAIRS.format(d=EUCLID).replace(", ranked AS", ", cos AS (SELECT q.id AS query, g.id AS item, 1 - list_cosine_similarity(q.v, g.v) AS c FROM e q JOIN e g ON q.id <> g.id WHERE q.id % 20 = 0), mix AS (SELECT query, q_label, item, "
  "0.75 * distance / (SELECT median(distance) FROM pairs WHERE distance > 0) + 0.25 * c / (SELECT median(c) FROM cos WHERE c > 0) AS distance, relevant FROM pairs JOIN cos USING (query, item)), ranked AS").replace("AS rank FROM pairs)", "AS rank FROM mix)")
  + " SELECT query, item, rank, round(distance, 6) AS distance FROM ranked WHERE rank <= 5")
def combined_distance(spark, sf_dir):
    both = vectors(spark, sf_dir)
    return rounded(blocks.nearest(*both, blocks.combined(*both, [(blocks.euclidean, 0.75), (blocks.cosine, 0.25)]), 5), 6, "distance").select("query", "item", F.col("rank").cast("long").alias("rank"), "distance")


# Bags, transitions, vocabularies

BAG = "WITH bag AS (SELECT doc_id, item, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS item FROM documents) GROUP BY 1, 2), total AS (SELECT count(*) AS total_n FROM documents)"


def document_bags(spark, sf_dir) -> DataFrame:
    return features.bag(read(spark, sf_dir, "documents"), "doc_id", text.tokens(F.col("text")))


@query(BAG + " SELECT item, count(*) AS df, round(ln((any_value(total_n) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM bag, total GROUP BY item")
def token_idf(spark, sf_dir):
    return rounded(features.inverse_document_frequency(document_bags(spark, sf_dir), "doc_id", read(spark, sf_dir, "documents")), 6, "idf")


@query(BAG + """, idf AS (SELECT item, ln((any_value(total_n) + 1) / (count(*) + 1)) + 1 AS idf FROM bag, total GROUP BY item), w AS (SELECT doc_id, item, n * idf AS weight FROM bag JOIN idf USING (item)),
  u AS (SELECT doc_id, item, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS w FROM w), c AS (SELECT q.doc_id AS query, g.doc_id AS doc, sum(q.w * g.w) AS cosine FROM u q JOIN u g ON q.item = g.item AND q.doc_id <> g.doc_id WHERE q.doc_id % 20 = 0 GROUP BY 1, 2)
  SELECT query, count(*) AS met, round(max(cosine), 4) AS best, round(avg(cosine), 4) AS mean FROM c GROUP BY query""")
def sparse_cosine(spark, sf_dir):
    return cosines_met(spark, sf_dir, 20)


def cosines_met(spark, sf_dir, step: int) -> DataFrame:
    bags = graphs.cut(document_bags(spark, sf_dir))  # read three times
    idf = features.counted(graphs.cut(features.inverse_document_frequency(bags, "doc_id", read(spark, sf_dir, "documents"))))
    queries = read(spark, sf_dir, "documents").where(F.col("doc_id") % step == 0).select("doc_id")
    found = features.sparse_cosine_sums(queries, features.with_idf(bags, idf), "doc_id")
    graphs.discard(bags)  # what is summed is written
    return found.select("query", "met", F.round("best", 4).alias("best"), F.round(F.col("total") / F.col("met"), 4).alias("mean"))


@query("""WITH c AS (SELECT lang, k, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]')) AS k FROM documents) GROUP BY ALL), p AS (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS p FROM c),
  k AS (SELECT DISTINCT k FROM p), l AS (SELECT DISTINCT lang FROM p), f AS (SELECT x.lang AS a, y.lang AS b, k.k, coalesce(pa.p, 0) AS p, coalesce(pb.p, 0) AS q FROM l x JOIN l y ON x.lang < y.lang CROSS JOIN k LEFT JOIN p pa ON pa.lang = x.lang AND pa.k = k.k LEFT JOIN p pb ON pb.lang = y.lang AND pb.k = k.k)
  SELECT a AS "left", b AS "right", round(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 6) AS divergence FROM f GROUP BY 1, 2""")
def language_divergence(spark, sf_dir):
    letters = read(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9])"), F.lit(1))).alias("k"))
    counts = letters.groupBy("lang", "k").agg(F.count("*").cast("double").alias("n"))
    maps = counts.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("v"))  # 36 keys at most
    pairs = maps.alias("x").join(maps.alias("y"), F.expr("x.lang < y.lang"))
    return pairs.select(F.col("x.lang").alias("left"), F.col("y.lang").alias("right"), F.round(distance.jensen_shannon_divergence(F.col("x.v"), F.col("y.v")), 6).alias("divergence"))


@query("""WITH s AS (SELECT role AS parent, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS child FROM conversations), c AS (SELECT parent, child, count(*) AS n FROM s WHERE child IS NOT NULL GROUP BY ALL)
  SELECT parent, child, n, round(n / sum(n) OVER (PARTITION BY parent), 6) AS p FROM c""")
def role_transitions(spark, sf_dir):
    return rounded(features.transitions(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role"), 6, "p")


@query("""WITH s AS (SELECT event_type AS parent, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS child FROM events), c AS (SELECT parent, child, count(*) AS n FROM s WHERE child IS NOT NULL GROUP BY ALL)
  SELECT parent, child, n, round(n / sum(n) OVER (PARTITION BY parent), 6) AS p FROM c""")
def event_transitions(spark, sf_dir):
    return rounded(features.transitions(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type"), 6, "p")


@query("""WITH s AS (SELECT c_mktsegment < 'G' AS g, s.event_type AS parent, s.child FROM (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS child FROM events) s JOIN customer ON c_custkey = user_id WHERE child IS NOT NULL),
  p AS (SELECT g, parent, child, count(*) / sum(count(*)) OVER (PARTITION BY g, parent) AS p FROM s GROUP BY 1, 2, 3),
  f AS (SELECT parent, child, coalesce(x.p, 0) AS x, coalesce(y.p, 0) AS y FROM (SELECT * FROM p WHERE g) x FULL JOIN (SELECT * FROM p WHERE NOT g) y USING (parent, child)),
  d AS (SELECT parent, sum(CASE WHEN x > 0 THEN x * log2(x / ((x + y) / 2)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / ((x + y) / 2)) ELSE 0 END) / 2 AS d FROM f GROUP BY parent) SELECT count(*) AS parents, round(avg(d), 6) AS jsd FROM d""")
def transition_divergence(spark, sf_dir):
    rows = read(spark, sf_dir, "events").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), "user_id")
    of = lambda half: features.transitions(rows.where(half), ["user_id"], ["ts", "event_id"], "event_type")
    return rounded(features.rowwise_jsd(of("c_mktsegment < 'G'"), of("c_mktsegment >= 'G'")), 6, "jsd")


@query("""WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS item FROM benchmark), r AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS item FROM documents),
  b AS (SELECT doc_id, count(*) AS n, count(k.item) AS k FROM r LEFT JOIN k USING (item) GROUP BY doc_id) SELECT sum(n)::BIGINT AS tokens, sum(k)::BIGINT AS known_tokens, count(*) AS labels, sum((n = k)::INT)::BIGINT AS covered_labels FROM b""")
def vocabulary_coverage(spark, sf_dir):
    known = read(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("item"))
    return features.coverage(read(spark, sf_dir, "documents"), "doc_id", text.tokens(F.col("text")), known)


@query("""SELECT item, n, (row_number() OVER (ORDER BY n DESC, item) + 1)::INT AS id FROM (SELECT item, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS item FROM benchmark) GROUP BY item)""")
def vocabulary(spark, sf_dir):
    return features.vocabulary(read(spark, sf_dir, "benchmark"), text.tokens(F.col("text")))


@query()
def lexical_hash(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(features.lexical_ablation(text.tokens(F.col("text")), "hash"), " ").alias("hashed"))


@query("""SELECT item_id, array_to_string(list_transform(t, lambda x: 'LEX_LOCAL_' || (list_unique(t[1:list_position(t, x)]) - 1)), ' ') AS numbered FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark)""")
def lexical_local(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(features.lexical_ablation(text.tokens(F.col("text")), "local"), " ").alias("numbered"))


@query("SELECT least((count(*) - sum(toxic)) / sum(toxic), 20.0) AS weight FROM labels WHERE toxic IS NOT NULL")
def positive_weights(spark, sf_dir):
    return features.positive_weights(read(spark, sf_dir, "labels"), "toxic", 20.0)


# Statistics


@query("""SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS least, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS median,
  quantile_cont(l_quantity, 0.75) AS p75, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag""")
def describe_quantity(spark, sf_dir):
    return rounded(stats.describe(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity"), 6, "mean", "std")


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS z_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS z_price FROM part")
def zscore_parts(spark, sf_dir):
    out = stats.zscore(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return out.select("p_partkey", F.round("z_p_size", 6).alias("z_size"), F.round("z_p_retailprice", 6).alias("z_price"))


@query("""WITH s AS (SELECT count(*) + 1e-6 AS a, sum(p_size)::DOUBLE AS b, sum(p_size * p_size) + 1e-6 AS d, sum(p_retailprice) AS u, sum(p_size * p_retailprice) AS v FROM part)
  SELECT p_partkey, round(p_retailprice - (d * u - b * v) / (a * d - b * b) - p_size * (a * v - b * u) / (a * d - b * b), 4) AS residual FROM part, s""")
def residual_prices(spark, sf_dir):
    return stats.residuals(read(spark, sf_dir, "part"), "p_retailprice", ["p_size"]).select("p_partkey", F.round("residual", 4).alias("residual"))


@query("""WITH g AS (SELECT c_nationkey, count(*) AS n, sum(c_acctbal) AS s, sum(c_acctbal * c_acctbal) AS q FROM customer GROUP BY 1)
  SELECT count(*) AS n_groups, sum(n)::BIGINT AS n, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)), 6) AS eta_squared FROM g""")
def balance_effect(spark, sf_dir):
    return rounded(stats.eta_squared(read(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey"), 6, "eta_squared")


RANKS = """WITH j AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL),
  r AS (SELECT *, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS a, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS b FROM j)"""


def labelled_lengths(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")


@query(RANKS + " SELECT count(*) AS n, round(corr(a::DOUBLE, b::DOUBLE), 6) AS rho FROM r")
def length_quality_spearman(spark, sf_dir):
    return rounded(stats.spearman(labelled_lengths(spark, sf_dir), "n_chars", "quality"), 6, "rho")


@query(RANKS + """ SELECT count(*) AS n, sum(quality)::BIGINT AS positives, round((sum(a) FILTER (WHERE quality = 1) - sum(quality) * (sum(quality) + 1) / 2)::DOUBLE / (sum(quality) * (count(*) - sum(quality))), 6) AS auc FROM r""")
def length_quality_auc(spark, sf_dir):
    return rounded(stats.binary_auc(labelled_lengths(spark, sf_dir), "n_chars", "quality"), 6, "auc")


P_VALUES = "WITH p AS (SELECT c_nationkey AS k, c_nationkey % 5 AS region, round(count(*) FILTER (WHERE c_acctbal < 0) / count(*) / 4, 6) AS p FROM customer GROUP BY 1)"


def nation_p_values(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.avg((F.col("c_acctbal") < 0).cast("double")) / 4, 6).alias("p"))
    return rows.withColumn("region", F.col("k") % 5)


@query(P_VALUES + """, s AS (SELECT *, (count(*) OVER (PARTITION BY region) - row_number() OVER w + 1) * p AS h, p * count(*) OVER (PARTITION BY region) / row_number() OVER w AS b, row_number() OVER w AS i FROM p WINDOW w AS (PARTITION BY region ORDER BY p, k))
  SELECT k, region, p, round(least(1.0, max(h) OVER (PARTITION BY region ORDER BY i)), 6) AS p_holm, round(least(1.0, min(b) OVER (PARTITION BY region ORDER BY i DESC)), 6) AS q_bh FROM s""")
def corrected_p_values(spark, sf_dir):
    out = stats.benjamini_hochberg(stats.holm(nation_p_values(spark, sf_dir), "p", "k", ["region"]), "p", "k", ["region"])
    return rounded(out, 6, "p_holm", "q_bh").select("k", "region", "p", "p_holm", "q_bh")


@query("""WITH s AS (SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal > 4500) AS pos, count(*) FILTER (WHERE c_acctbal < 4500) AS neg FROM customer GROUP BY 1)
  SELECT c_mktsegment, pos, neg, round(least(1.0, 2 * list_sum(list_transform(range(0, least(pos, neg) + 1), lambda i: exp(lgamma(pos + neg + 1) - lgamma(i + 1) - lgamma(pos + neg - i + 1) - (pos + neg) * ln(2))))), 6) AS p FROM s""")
def balance_sign_test(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.when(F.col("c_acctbal") > 4500, 1)).alias("pos"), F.count(F.when(F.col("c_acctbal") < 4500, 1)).alias("neg"))
    return rows.withColumn("p", F.round(stats.sign_test(F.col("pos"), F.col("neg")), 6))


@query("""WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders), c AS (SELECT v FROM s WHERE i IN (SELECT b * n // 10 FROM (SELECT max(n) AS n FROM s), range(1, 10) t(b)))
  SELECT bin, count(*) AS n, round(min(v), 2) AS least, round(max(v), 2) AS most FROM (SELECT s.v, (SELECT count(*) FROM c WHERE s.v > c.v)::INT AS bin FROM s) GROUP BY bin""")
def price_deciles(spark, sf_dir):
    return stats.quantile_bins(read(spark, sf_dir, "orders"), "o_totalprice", 10).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 2).alias("least"), F.round(F.max("o_totalprice"), 2).alias("most"))


@query("""SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))""")
def pareto_parts(spark, sf_dir):
    return stats.pareto_front(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY user_id""")
def user_entropy(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    return counts.groupBy("user_id").agg(F.collect_list("n").alias("c")).select("user_id", F.round(stats.entropy(F.col("c")), 6).alias("entropy"))  # an element a type


def paired_prices(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    return rows


@query()
def bootstrap_discount(spark, sf_dir):
    return stats.bootstrap_ci(paired_prices(spark, sf_dir), "tax", "discount", "l_suppkey")


@query()
def sign_flip_discount(spark, sf_dir):
    return stats.sign_flip_p(paired_prices(spark, sf_dir), "tax", "discount", "l_suppkey")


# Streams as tables, trees of programs, transport


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def hourly_events(spark, sf_dir):
    return rounded(streams.windowed_counts(read(spark, sf_dir, "events")), 2, "value")


@query("""WITH g AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY user_id, s""")
def user_sessions(spark, sf_dir):
    return streams.sessions(read(spark, sf_dir, "events"))


@query()
def type_transport(spark, sf_dir):
    shares = F.array(*[F.lit(i / 20) for i in range(1, 20)])
    points = read(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile(F.col("value") / 100, shares).alias("q")).select("event_type", F.transform("q", lambda x: F.array(x)).alias("points"))
    pairs = points.alias("x").join(points.alias("y"), F.expr("x.event_type < y.event_type"))
    return pairs.select(F.col("x.event_type").alias("left"), F.col("y.event_type").alias("right"), transport.divergence(F.col("x.points"), F.col("y.points")).alias("divergence"))
