"""Queries of measures, contrasts, gates and joins over groups, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import eligibility, inference, measures
from lodestrata.plans.registry import query, read, rounded

# Predictions: event types of each user, scored by how often they are, true where their mean value is above the table's


def scored_types(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    by = events.groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("score"), F.avg("value").alias("m"))
    return by.join(F.broadcast(events.agg(F.avg("value").alias("all"))), F.lit(True)).select("user_id", "event_type", "score", (F.col("m") > F.col("all")).alias("is_true"))


SCORED = "s AS (SELECT user_id, event_type, count(*)::DOUBLE AS score, avg(value) > (SELECT avg(value) FROM events) AS t FROM events GROUP BY ALL)"


def micro_sql(chosen: str) -> str:
    return f"""WITH {SCORED}, c AS (SELECT user_id, t, {chosen} AS p FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS n, sum(t::INT) OVER (PARTITION BY user_id) AS k FROM s)),
  q AS (SELECT sum((p AND t)::INT) AS h, sum(p::INT) AS a, sum(t::INT) AS b, count(DISTINCT user_id) AS n FROM c)
  SELECT round(h / a, 6) AS precision, round(h / b, 6) AS recall, round(2 * h / (a + b), 6) AS f1, round(a / n, 6) AS predicted_mean FROM q"""


@query(micro_sql("n <= greatest(1, k)"))
def micro_oracle(spark, sf_dir):
    rows = measures.selected(scored_types(spark, sf_dir), "user_id", "score", "event_type", "is_true", "oracle")
    return rounded(measures.micro_measures(rows, "user_id", "is_true"), 6, "precision", "recall", "f1", "predicted_mean")


@query(micro_sql("n <= 2"))
def micro_top(spark, sf_dir):
    rows = measures.selected(scored_types(spark, sf_dir), "user_id", "score", "event_type", "is_true", "top", 2)
    return rounded(measures.micro_measures(rows, "user_id", "is_true"), 6, "precision", "recall", "f1", "predicted_mean")


@query(micro_sql("score >= 2"))
def micro_threshold(spark, sf_dir):
    rows = measures.selected(scored_types(spark, sf_dir), "user_id", "score", "event_type", "is_true", "threshold", threshold=2.0)
    return rounded(measures.micro_measures(rows, "user_id", "is_true"), 6, "precision", "recall", "f1", "predicted_mean")


@query("SELECT round(avg((o_orderstatus = CASE WHEN o_orderdate < TIMESTAMP '1995-06-17' THEN 'F' ELSE 'O' END)::INT), 6) AS accuracy FROM orders")
def status_accuracy(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("guess", F.when(F.col("o_orderdate") < F.lit("1995-06-17").cast("timestamp"), "F").otherwise("O"))
    return rounded(measures.accuracy(rows, "guess", "o_orderstatus"), 6, "accuracy")


# One positive a query: a supplier's first part by key among its others, by price


def supplied(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_discount").alias("d"), F.sum("l_quantity").alias("q"))
    dist = F.round(F.col("d") + F.col("q") / 100, 6)
    first = rows.groupBy("l_suppkey").agg(F.min("l_partkey").alias("first"))
    return rows.join(first, "l_suppkey").select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("item"), dist.alias("distance"), (F.col("l_partkey") == F.col("first")).alias("positive"))


SUPPLIED = """r AS (SELECT l_suppkey AS query, l_partkey AS item, round(min(l_discount) + sum(l_quantity) / 100, 6) AS d FROM lineitem GROUP BY ALL), f AS (SELECT *, item = min(item) OVER (PARTITION BY query) AS positive FROM r),
  k AS (SELECT query, item, d, positive, row_number() OVER (PARTITION BY query ORDER BY d, positive DESC, item) AS rank, min(d) FILTER (WHERE NOT positive) OVER (PARTITION BY query) AS near FROM f)"""


@query(f"""WITH {SUPPLIED} SELECT count(*) AS n, round(avg((rank <= 1)::INT), 6) AS recall_1, round(avg(CASE WHEN rank <= 1 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_1, round(avg((rank <= 3)::INT), 6) AS recall_3,
  round(avg(CASE WHEN rank <= 3 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_3, round(avg((rank <= 5)::INT), 6) AS recall_5, round(avg(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_5,
  round(avg(1 / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank, round(avg(near - d), 6) AS margin_mean, round(min(near - d), 6) AS margin_min FROM k WHERE positive""")
def single_positive(spark, sf_dir):
    found = measures.positive_measures(measures.positive_ranks(supplied(spark, sf_dir), "query", "item", "distance", "positive"))
    return rounded(found, 6, *[c for c in found.columns if c != "n"])


@query("""SELECT event_type, n, round(list_sum(list_transform(range(1, n + 1), lambda i: 1.0 / i)) / n, 6) AS mrr, (n + 1) / 2 AS mean_rank, round(least(1, n) / n, 6) AS recall_1, round(least(5, n) / n, 6) AS recall_5
  FROM (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type)""")
def random_baseline(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n"))
    return rounded(n.select("event_type", "n", *measures.random_expectation(F.col("n"))), 6, "mrr", "recall_1", "recall_5")


# Means over levels and contrasts


@query("""SELECT count(*) AS n, round(avg(m), 6) AS mean FROM (SELECT l_returnflag, avg(m) AS m FROM (SELECT l_returnflag, l_suppkey, avg(m) AS m FROM (SELECT l_returnflag, l_suppkey, l_partkey, avg(l_discount) AS m FROM lineitem GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)""")
def three_level_mean(spark, sf_dir):
    return rounded(measures.level_means(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_suppkey", "l_partkey"], "l_discount"), 6, "mean")


@query("""WITH c AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT o_orderpriority, round(avg(v), 4) AS v FROM c GROUP BY o_orderpriority""")
def averaged_priorities(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    return rounded(measures.averaged_over(rows, "o_orderstatus", "o_orderpriority", "v"), 4, "v")


@query("""WITH c AS (SELECT l_suppkey, l_linestatus, avg(l_discount) AS v FROM lineitem GROUP BY ALL), d AS (SELECT l_suppkey, max(v) FILTER (l_linestatus = 'F') - max(v) FILTER (l_linestatus = 'O') AS delta FROM c GROUP BY 1),
  s AS (SELECT d.*, s_nationkey FROM d JOIN supplier ON s_suppkey = l_suppkey WHERE delta IS NOT NULL)
  SELECT s_nationkey, count(*) AS n, round(avg(delta), 6) AS mean, round(coalesce(stddev_samp(delta), 0), 6) AS std, round(min(delta), 6) AS least, round(max(delta), 6) AS most, sum((p <= 0.05)::INT) AS significant FROM (SELECT *, abs(delta) AS p FROM s) GROUP BY 1""")
def status_deltas(spark, sf_dir):
    cells = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.avg("l_discount").alias("v"))
    deltas = measures.factor_deltas(cells, ["l_suppkey"], "l_linestatus", "F", "O", "v").withColumn("p", F.abs("delta"))
    named = deltas.join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return rounded(measures.delta_summary(named, ["s_nationkey"], "delta", "p"), 6, "mean", "std", "least", "most")


@query("""WITH c AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL), a AS (SELECT user_id, max(v) FILTER (event_type = t.lo) AS x, max(v) FILTER (event_type = t.hi) AS y FROM c, (SELECT min(event_type) AS lo, max(event_type) AS hi FROM events) t GROUP BY user_id)
  SELECT user_id, round(x - y, 6) AS delta FROM a WHERE x IS NOT NULL AND y IS NOT NULL""")
def paired_types(spark, sf_dir):
    cells = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    ends = read(spark, sf_dir, "events").agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))  # one row
    marked = cells.join(F.broadcast(ends), F.lit(True))
    x, y = marked.where("event_type = lo").select("user_id", "v"), marked.where("event_type = hi").select("user_id", "v")
    x, y = x.join(y.select("user_id"), "user_id", "left_semi"), y.join(x.select("user_id"), "user_id", "left_semi")
    return rounded(measures.paired_differences(x, y, "user_id", "v"), 6, "delta")


@query("""WITH m AS (SELECT s_nationkey, avg(s_acctbal) AS m FROM supplier GROUP BY 1) SELECT s_nationkey, round((sum(m) OVER () - m) / (count(*) OVER () - 1), 4) AS mean_without FROM m""")
def leave_one_nation_out(spark, sf_dir):
    return rounded(measures.leave_one_out(read(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal"), 4, "mean_without")


@query("""SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS price_mean, round(stddev_pop(p_retailprice), 4) AS price_std, round(avg(p_size), 4) AS size_mean, round(stddev_pop(p_size), 4) AS size_std FROM part GROUP BY p_brand""")
def aliased_part_means(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")).alias("price"), F.col("p_retailprice").alias("old_price"), F.col("p_size").alias("size"))
    return rounded(measures.aliased_means(rows, "p_brand", {"price": "old_price", "size": None, "weight": "old_weight"}), 4, "price_mean", "price_std", "size_mean", "size_std")


@query("""SELECT c_nationkey, c_custkey, round(c_acctbal, 2) AS balance FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment DESC, c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n = 1""")
def best_customers(spark, sf_dir):
    best = measures.best_by(read(spark, sf_dir, "customer"), ["c_nationkey"], [("c_mktsegment", True), ("c_acctbal", True), ("c_custkey", False)])
    return best.select("c_nationkey", "c_custkey", F.round("c_acctbal", 2).alias("balance"))


@query("""SELECT round(coalesce(quantile_cont(m, 0.5), 1), 6) AS scale FROM (SELECT l_suppkey, quantile_cont(l_tax, 0.5) AS m FROM lineitem WHERE l_tax > 0 GROUP BY l_suppkey)""")
def tax_scale(spark, sf_dir):
    return rounded(measures.positive_median_scale(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_tax"), 6, "scale")


@query("""WITH v AS (SELECT event_type, value - avg(value) OVER () AS d FROM events) SELECT event_type, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(quantile_cont(d, 0.05), 6) AS q05, round(quantile_cont(d, 0.5), 6) AS q50, round(quantile_cont(d, 0.95), 6) AS q95,
  round(avg((d < -5)::INT), 6) AS negative, round(avg((abs(d) <= 5)::INT), 6) AS near_zero, round(avg((d > 5)::INT), 6) AS positive FROM v GROUP BY event_type""")
def signed_values(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    mean = events.agg(F.avg("value").alias("m"))
    rows = events.join(F.broadcast(mean), F.lit(True)).select("event_type", (F.col("value") - F.col("m")).alias("d"))
    found = measures.signed_summary(rows, "d", 5.0, ["event_type"])
    return rounded(found, 6, *[c for c in found.columns if c not in ("event_type", "n")])


# Rankings


@query(f"""WITH {SUPPLIED}, n AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY d, item) AS a, row_number() OVER (PARTITION BY query ORDER BY abs(d - 0.3), item) AS b FROM f)
  SELECT count(*) AS n, round(avg(s), 6) AS overlap FROM (SELECT query, avg((b <= 5)::INT) AS s FROM n WHERE a <= 5 GROUP BY query)""")
def nearest_overlap(spark, sf_dir):
    left = supplied(spark, sf_dir).select("query", "item", "distance")
    return rounded(measures.neighbour_overlap(left, left.withColumn("distance", F.abs(F.col("distance") - 0.3)), 5), 6, "overlap")


@query("""WITH r AS (SELECT p_brand AS query, p_size AS d, count(*) AS ties FROM part GROUP BY ALL), u AS (SELECT *, sum(ties) OVER (PARTITION BY query ORDER BY d) AS upto FROM r) SELECT query, d AS distance, ties FROM u WHERE upto >= 10 AND upto - ties < 10""")
def tenth_size_ties(spark, sf_dir):
    return measures.tie_sizes(read(spark, sf_dir, "part").select(F.col("p_brand").alias("query"), F.col("p_size").alias("distance")), 10)


@query("SELECT p_size, count(*) AS n FROM part GROUP BY p_size ORDER BY n DESC, p_size LIMIT 12")
def common_sizes(spark, sf_dir):
    return measures.common_levels(read(spark, sf_dir, "part"), "p_size")


@query("""WITH s AS (SELECT p_brand, p_size - lag(p_size) OVER w AS t, p_retailprice / 1000 - lag(p_retailprice / 1000) OVER w AS m FROM part WHERE p_size > 0 WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey))
  SELECT p_brand, round(coalesce(avg(greatest(0, 0.05 - m)) FILTER (t > 0), 0), 6) AS loss FROM s GROUP BY p_brand""")
def size_rank_loss(spark, sf_dir):
    rows = read(spark, sf_dir, "part").withColumn("price", F.col("p_retailprice") / 1000)
    return rounded(measures.rank_loss(rows, ["p_brand"], "p_size", "price", "p_partkey"), 6, "loss")


@query("""SELECT p_brand, min(p_size) FILTER (m >= 1500) AS p_size FROM (SELECT p_brand, p_size, avg(p_retailprice) AS m FROM part GROUP BY ALL) GROUP BY p_brand""")
def least_dear_size(spark, sf_dir):
    return measures.least_level(read(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice", 1500.0)


# Gates


def nation_intervals(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg((F.avg("c_acctbal") - 4500).alias("mean"), (F.stddev_samp("c_acctbal") / F.sqrt(F.count("*"))).alias("se"))
    return rows.where("se IS NOT NULL").select("c_nationkey", "c_mktsegment", "mean", (F.col("mean") - F.col("se")).alias("low"), (F.col("mean") + F.col("se")).alias("high"))


INTERVALS = "i AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) - 4500 AS m, stddev_samp(c_acctbal) / sqrt(count(*)) AS se FROM customer GROUP BY ALL HAVING se IS NOT NULL)"


@query(f"""WITH {INTERVALS}, g AS (SELECT 'building' AS gate, c_nationkey AS k, m - se > 0 AND m >= 100 AS ok FROM i WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'any', c_nationkey, (m - se > 0 AND m >= 100) OR (m + se < 0 AND m <= -100) FROM i)
  SELECT gate, count(*) AS "rows", sum(ok::INT) AS supported_cells, count(DISTINCT CASE WHEN ok THEN k END) AS supported_projects,
  CASE WHEN count(DISTINCT CASE WHEN ok THEN k END) >= 2 THEN 'supported' WHEN count(DISTINCT CASE WHEN ok THEN k END) > 0 THEN 'partial' ELSE 'not_supported' END AS decision FROM g GROUP BY gate""")
def balance_gates(spark, sf_dir):
    rows = nation_intervals(spark, sf_dir)
    one = measures.gate(rows, "building", F.col("c_mktsegment") == "BUILDING", "c_nationkey", "mean", "low", "high", practical=100.0)
    return one.union(measures.gate(rows, "any", F.lit(True), "c_nationkey", "mean", "low", "high", practical=100.0, two_sided=True))


@query(f"""WITH {INTERVALS} SELECT c_nationkey, c_mktsegment, CASE WHEN m - se > 0 AND abs(m) >= 100 THEN 'unoriented' WHEN m + se < 0 AND abs(m) >= 100 THEN 'directed' ELSE 'inconclusive' END AS decision FROM i""")
def balance_decisions(spark, sf_dir):
    rows = nation_intervals(spark, sf_dir)
    return rows.select("c_nationkey", "c_mktsegment", measures.interval_decision(F.col("mean"), F.col("low"), F.col("high"), "unoriented", "directed", "inconclusive", 100.0).alias("decision"))


@query("""SELECT p_partkey, round(0.75 * CASE WHEN h1 > l1 THEN (p_retailprice - l1) / (h1 - l1) ELSE 1 END + 0.25 * CASE WHEN h2 > l2 THEN (h2 - p_size) / (h2 - l2) ELSE 1 END, 6) AS utility
  FROM part, (SELECT min(p_retailprice) AS l1, max(p_retailprice) AS h1, min(p_size) AS l2, max(p_size) AS h2 FROM part)""")
def part_utility(spark, sf_dir):
    found = measures.weighted_utility(read(spark, sf_dir, "part"), {"p_retailprice": (True, 3.0), "p_size": (False, 1.0)})
    return found.select("p_partkey", F.round("utility", 6).alias("utility"))


@query("""SELECT f.l_returnflag, s.l_linestatus, n.l_linenumber, count(l.l_orderkey) AS n, round(coalesce(avg(l.l_discount), 0), 6) AS discount FROM (SELECT DISTINCT l_returnflag FROM lineitem) f CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) s CROSS JOIN (SELECT DISTINCT l_linenumber FROM lineitem) n
  LEFT JOIN lineitem l ON l.l_returnflag = f.l_returnflag AND l.l_linestatus = s.l_linestatus AND l.l_linenumber = n.l_linenumber GROUP BY ALL""")
def factor_grid(spark, sf_dir):
    """Every combination of the levels that three factors have, those that no row has too."""
    names, rows = ["l_returnflag", "l_linestatus", "l_linenumber"], read(spark, sf_dir, "lineitem")
    cells = rows.groupBy(*names).agg(F.count("*").alias("n"), F.avg("l_discount").alias("discount"))
    found = measures.level_grid(rows, names).join(cells, names, "left")
    return found.select(*names, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.round(F.coalesce("discount", F.lit(0.0)), 6).alias("discount"))


@query("""SELECT c_custkey, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(encode('folds') || '\\x00'::BLOB || encode(c_custkey::VARCHAR)), c_custkey) - 1) % 5 AS fold FROM customer""")
def customer_folds(spark, sf_dir):
    return measures.folds(read(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 5, "folds").select("c_custkey", "fold")


# Groups


@query("SELECT event_type, list_sort(list(DISTINCT user_id)) AS users FROM events GROUP BY event_type")
def users_of_types(spark, sf_dir):
    by_user = measures.sets_of(read(spark, sf_dir, "events").select("user_id", F.array("event_type").alias("types")), "user_id", "types")
    return measures.inverted(by_user, "user_id", "types").select(F.col("value").alias("event_type"), F.col("keys").alias("users"))


@query("SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def nation_members(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").select("n_name", F.array("n_nationkey").alias("members"))
    rows = measures.members_joined(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")), nations, "n_nationkey", "members")
    return rows.groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT a.n_regionkey AS n_regionkey, a.n_nationkey AS \"left\", b.n_nationkey AS \"right\" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def nations_of_a_region(spark, sf_dir):
    return measures.pairs_within(read(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey")


@query('SELECT a.p_partkey AS "left", b.p_partkey AS "right" FROM part a JOIN part b ON a.p_partkey < b.p_partkey ORDER BY 1, 2 LIMIT 20')
def first_part_pairs(spark, sf_dir):
    return measures.first_pairs(read(spark, sf_dir, "part"), "p_partkey", 20)


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 2000) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def orders_of_whole_customers(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    poor = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return measures.without_clusters(orders, "o_custkey", orders.where("o_totalprice < 2000"), poor).select("o_orderkey", "o_custkey")


@query("""WITH a AS (SELECT l_suppkey, avg(l_discount) AS x, avg(l_tax) AS y, avg(l_quantity) AS z FROM lineitem GROUP BY 1) SELECT round(corr(x, y), 6) AS first_second, round(corr(x, z), 6) AS first_third, count(*) AS n FROM a""")
def aligned_results(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    parts = [rows.groupBy("l_suppkey").agg(F.avg(c).alias("v")) for c in ("l_discount", "l_tax", "l_quantity")]
    both = measures.aligned(parts, ["l_suppkey"], "v")
    return both.agg(F.round(F.corr("v_0", "v_1"), 6).alias("first_second"), F.round(F.corr("v_0", "v_2"), 6).alias("first_third"), F.count("*").alias("n"))


@query(r"""WITH r AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS repo, regexp_replace(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '/+$', '') AS path FROM pages)
  SELECT repo, list_sort(list(DISTINCT path)) AS paths, CAST([] AS VARCHAR[]) AS languages FROM r WHERE repo != '' AND path != '' GROUP BY repo""")
def paths_by_host(spark, sf_dir):
    url = F.col("url")
    path = F.regexp_replace(F.regexp_extract(url, "://[^/?#]*/([^?#]*)", 1), "/+$", "")
    rows = read(spark, sf_dir, "pages").select(F.lit(None).cast("string").alias("repo_name"), F.regexp_extract(url, "://([^/?#]*)", 1).alias("repo"), path.alias("path"), F.lit("").alias("language"))
    return measures.by_repository(rows, ["repo_name", "repo"], F.col("path"), ["language", "lang"])


@query("""SELECT CASE WHEN props->>'k' IS NOT NULL THEN 'keyed' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY ALL""")
def kinds_of_properties(spark, sf_dir):
    document = F.try_parse_json("props")
    kind = measures.kind_of({"k": F.try_variant_get(document, "$.k", "string").isNotNull()}, [(["k"], None, "keyed")], "other")
    return read(spark, sf_dir, "events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, len(regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1)) > 1 AND NOT list_contains(string_split(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '/'), '..') AS safe FROM pages WHERE url IS NOT NULL""")
def safe_page_paths(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").where("url IS NOT NULL")
    return pages.select("page_id", text.is_safe_path(F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1)).alias("safe"))


# Resampling


def taxed(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_tax"), 9).alias("tax"), F.round(F.avg("l_discount"), 9).alias("discount"))


def resample_sql(units: str, seed: str, replicates: int, n: str = "n") -> str:
    """SQL of inference.resampled() over a query of c, n and s."""
    return f"""WITH u AS ({units}), i AS (SELECT row_number() OVER (ORDER BY c) - 1 AS i, n, s FROM u), k AS (SELECT count(*) AS units, sum(s) / sum(n) AS mean FROM i),
  d AS (SELECT rep, ('0x' || substr(sha256('{seed}|' || rep || '|' || j), 1, 8))::BIGINT % units AS i FROM k, range({replicates}) r(rep), range((SELECT units FROM k)) q(j)),
  m AS (SELECT rep, sum(s) / sum(n) AS m FROM d JOIN i USING (i) GROUP BY rep), b AS (SELECT list_sort(list(m)) AS l FROM m)
  SELECT units AS {n}, round(mean, 6) AS mean, round(l[least(floor(0.025 * len(l))::INT + 1, len(l))], 6) AS low, round(l[least(floor(0.975 * len(l))::INT + 1, len(l))], 6) AS high FROM k, b"""


TAXED = "SELECT l_suppkey AS c, 1 AS n, round(avg(l_discount), 9) - round(avg(l_tax), 9) AS s FROM lineitem GROUP BY 1"


@query(resample_sql(TAXED, "pairs", 60))
def paired_resampling(spark, sf_dir):
    return rounded(inference.paired_bootstrap(taxed(spark, sf_dir), "tax", "discount", "l_suppkey", 60, "pairs"), 6, "mean", "low", "high")


@query(resample_sql("SELECT c_nationkey AS c, count(*) AS n, sum(c_acctbal) AS s FROM customer GROUP BY 1", "nations", 200, "clusters"))
def nation_resampling(spark, sf_dir):
    return rounded(inference.cluster_bootstrap(read(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", 200, "nations"), 6, "mean", "low", "high")


@query(f"""WITH d AS ({TAXED}), k AS (SELECT count(*) AS n, avg(s) AS mean FROM d), m AS (SELECT rep, avg(CASE WHEN ('0x' || substr(sha256('flips|' || rep || '|' || c), 1, 8))::BIGINT % 2 = 0 THEN s ELSE -s END) AS m FROM d, range(99) r(rep) GROUP BY rep)
  SELECT n, round(mean, 6) AS mean, CASE WHEN mean > 0 THEN ((SELECT count(*) FROM m WHERE m >= mean - 1e-12) + 1) / 100 ELSE 1 END AS p_value FROM k""")
def sign_flipping(spark, sf_dir):
    return rounded(inference.sign_flips(taxed(spark, sf_dir), "tax", "discount", "l_suppkey", 99, "flips"), 6, "mean")


@query(f"""SELECT *, low > 0 AS statistical, mean >= 0.001 AS practical, low > 0 AND mean >= 0.001 AS success FROM ({resample_sql(TAXED, "contrast", 40)})""")
def discount_contrast(spark, sf_dir):
    deltas = taxed(spark, sf_dir).withColumn("d", F.col("discount") - F.col("tax"))
    return rounded(inference.contrast(deltas, "l_suppkey", "d", 40, "contrast", 0.001), 6, "mean", "low", "high")


@query("""WITH v AS (SELECT n_regionkey AS r, n_nationkey::DOUBLE AS x FROM nation), k AS (SELECT r, list(x ORDER BY x) AS l FROM v GROUP BY r), m AS (SELECT r, l, (l[1 + a] + l[1 + b] + l[1 + c] + l[1 + d] + l[1 + e]) / 5 AS m FROM k, range(5) t1(a), range(5) t2(b), range(5) t3(c), range(5) t4(d), range(5) t5(e))
  SELECT r AS n_regionkey, 5 AS n, round(any_value(list_avg(l)), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY r""")
def exact_region_bounds(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").cast("double").alias("x"))
    return rounded(inference.exact_bounds(rows, ["n_regionkey"], "x"), 6, "mean", "low", "high")


@query("""WITH b AS (SELECT s_suppkey AS k, s_acctbal AS v, n_regionkey AS g, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  d AS (SELECT rep, v, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep = 0 THEN '' ELSE sha256('eta|' || rep || '|' || k) END, k) AS i FROM b, range(100) r(rep)),
  s AS (SELECT rep, g, count(*) AS n, sum(d.v) AS s, sum(d.v * d.v) AS q FROM d JOIN b USING (i) GROUP BY ALL), e AS (SELECT rep, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)) AS e FROM s GROUP BY rep)
  SELECT round(o.e, 6) AS eta_squared, ((SELECT count(*) FROM e WHERE rep > 0 AND e >= o.e - 1e-12) + 1) / 100 AS p_value FROM e o WHERE rep = 0""")
def region_permutations(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    return rounded(inference.permutation_eta(read(spark, sf_dir, "supplier").join(nations, "s_nationkey"), "s_acctbal", "n_regionkey", "s_suppkey", 99, "eta"), 6, "eta_squared")


@query("""WITH b AS (SELECT c_nationkey AS k, round(avg(c_acctbal), 2) AS x, count(*) AS y FROM customer GROUP BY 1), r AS (SELECT o.k AS o, b.k, rank() OVER (PARTITION BY o.k ORDER BY b.x) + (count(*) OVER (PARTITION BY o.k, b.x) - 1) / 2 AS rx, rank() OVER (PARTITION BY o.k ORDER BY b.y) + (count(*) OVER (PARTITION BY o.k, b.y) - 1) / 2 AS ry FROM b, b o WHERE b.k != o.k),
  c AS (SELECT o, corr(rx, ry) AS c FROM r GROUP BY o) SELECT count(*) AS n, round(min(c), 6) AS rho_min, round(max(c), 6) AS rho_max FROM c""")
def balance_without_one(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 2).alias("x"), F.count("*").alias("y"))
    found = inference.leave_one_out(rows, "x", "y", "c_nationkey").agg(F.count("*").alias("n"), F.min("rho").alias("rho_min"), F.max("rho").alias("rho_max"))
    return rounded(found, 6, "rho_min", "rho_max")


@query("""WITH c AS (SELECT user_id % 20 AS c, event_type || floor(value / 20)::BIGINT AS u, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT sim, c, row_number() OVER (PARTITION BY sim ORDER BY sha256('attrition|' || sim || '|' || c), c) AS p FROM (SELECT DISTINCT c FROM c), range(10) r(sim)),
  d AS (SELECT sim, c.c, u, n, CASE WHEN p <= 12 THEN 'train' WHEN p <= 19 THEN 'validation' ELSE 'test' END AS role FROM o JOIN c ON o.c = c.c), g AS (SELECT *, max((role = 'test')::INT) OVER (PARTITION BY sim, u) AS gone FROM d),
  t AS (SELECT sim, c, sum(n) AS n, sum(CASE WHEN gone = 0 THEN n ELSE 0 END) AS kept FROM g WHERE role = 'train' GROUP BY ALL) SELECT sim AS simulation, sum(n) AS programs, sum(kept) AS retained, sum((kept >= 5)::INT) AS "full", min(kept) AS fewest FROM t GROUP BY sim""")
def user_attrition(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("c"), F.concat("event_type", F.floor(F.col("value") / 20).cast("string")).alias("u"))
    return inference.attrition(rows, "c", "u", (12, 7, 1), 10, "attrition", 5)


@query("""SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('sample|' || c_custkey), c_custkey) AS n FROM customer) WHERE n <= 25""")
def sampled_customers(spark, sf_dir):
    return inference.digest_sample(read(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey", 25, "sample").select("c_mktsegment", "c_custkey")


@query("""SELECT item_id, array_to_string(list_sort(list_transform(list_slice(list_sort(list_transform(range(len(t)), lambda i: {'d': sha256(item_id || '|' || i), 'i': i})), 1, 5), lambda x: x.i)), ',') AS places
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark)""")
def sampled_places(spark, sf_dir):
    words = F.transform(text.tokens(F.col("text")), lambda x, i: i)
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(inference.sampled_contexts(words, 5, F.col("item_id")), ",").alias("places"))


# The chain of eligibility, over documents: bytes, words, and the set of words

CHAIN = r"""WITH RECURSIVE d AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS d0, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), k AS (SELECT doc_id, source, len(w) >= 3 AS ok, d0, sha256(array_to_string(w, ' ')) AS d1, sha256(array_to_string(list_sort(list_distinct(w)), ' ')) AS d2 FROM d),
  m AS (SELECT doc_id, unnest(['0' || d0, '1' || d1, '2' || d2]) AS mark FROM k), f AS (SELECT mark, min(doc_id) AS first FROM m GROUP BY mark), e AS (SELECT DISTINCT doc_id AS a, first AS b FROM m JOIN f USING (mark) WHERE doc_id <> first), t AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r(node, other) AS (SELECT doc_id, doc_id FROM k UNION SELECT r.node, t.b FROM r JOIN t ON t.a = r.other), c AS (SELECT node AS doc_id, min(other) AS component FROM r GROUP BY node), x AS (SELECT k.*, component, ok AND k.doc_id = component AS retained FROM k JOIN c USING (doc_id))"""


def document_chain(spark, sf_dir):
    docs, words = read(spark, sf_dir, "documents"), F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]+)"))
    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), words.alias("w"))
    kinds = {"d0": F.sha2("text", 256), "d1": F.sha2(F.array_join("w", " "), 256), "d2": F.sha2(F.array_join(F.array_sort(F.array_distinct("w")), " "), 256)}
    return eligibility.exact_retained(rows.select("doc_id", "source", (F.size("w") >= 3).alias("ok"), *[c.alias(k) for k, c in kinds.items()]), "doc_id", "ok")


@query(CHAIN + """ SELECT source, count(*) AS files, sum(ok::INT)::BIGINT AS parse_ok, round(avg(ok::INT), 6) AS parse_rate, sum((ok AND NOT retained)::INT)::BIGINT AS exact_removed, sum(retained::INT)::BIGINT AS retained FROM x GROUP BY source""")
def source_eligibility(spark, sf_dir):
    return rounded(eligibility.group_summary(document_chain(spark, sf_dir), "source", "ok"), 6, "parse_rate")


@query(CHAIN + """, p AS (SELECT DISTINCT source AS g, d2 AS h FROM x), z AS (SELECT g, count(*) AS n FROM p GROUP BY g), s AS (SELECT a.g AS l, b.g AS r, count(*) AS n FROM p a JOIN p b ON a.h = b.h AND a.g < b.g GROUP BY ALL), l AS (SELECT l, r FROM s JOIN z x1 ON x1.g = l JOIN z y1 ON y1.g = r WHERE s.n >= 2 AND s.n / least(x1.n, y1.n) >= 0.02),
  u AS (SELECT l AS a, r AS b FROM l UNION SELECT r, l FROM l), q(node, other) AS (SELECT g, g FROM z UNION SELECT q.node, u.b FROM q JOIN u ON u.a = q.other), o AS (SELECT node AS source, min(other) AS component FROM q GROUP BY node), n AS (SELECT source, sum(retained::INT)::BIGINT AS retained FROM x GROUP BY source),
  y AS (SELECT component, string_agg(source, '|' ORDER BY source) AS names, count(*) AS group_count, sum(retained)::BIGINT AS retained FROM o JOIN n USING (source) GROUP BY component) SELECT 'problem-' || substr(sha256(names), 1, 20) AS cluster_id, group_count::INT AS group_count, retained, retained >= 64 AS eligible FROM y""")
def source_clusters(spark, sf_dir):
    return eligibility.clusters(document_chain(spark, sf_dir), "source", "d2", "retained", 2, 0.02).drop("groups")
