"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe import functions as X
from cloakframe import sources as S
from cloakframe import streaming
from cloakframe.operators import cluster as C
from cloakframe.operators import evaluate as E
from cloakframe.operators import groups as G
from cloakframe.operators import lattice as L
from cloakframe.operators import migrate as M
from cloakframe.operators import mondrian as P
from cloakframe.operators import rules as R
from cloakframe.operators.keep import kept

QUERIES: dict = {}
ORACLES: dict = {}
QI, K = ["c_nationkey", "c_mktsegment", "band"], 10


def query(sql: str | None = None):
    """Register a function, and the SQL that gives its result."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer")


def banded(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with a band of their balance; the upper two bands are small, so at any scale some classes are unsafe."""
    return customers(spark, sf).withColumn("band", F.when(F.col("c_acctbal") >= 9900, 2).when(F.col("c_acctbal") >= 9000, 1).otherwise(0))


def customer_groups(spark: SparkSession, sf: str) -> DataFrame:
    return G.build_groups(banded(spark, sf), QI, K)


_BANDED = "SELECT *, CASE WHEN c_acctbal >= 9900 THEN 2 WHEN c_acctbal >= 9000 THEN 1 ELSE 0 END AS band FROM customer"
_GROUPS = f"""WITH g AS (SELECT c_nationkey, c_mktsegment, band, count(*) AS n FROM ({_BANDED}) GROUP BY ALL),
h AS (SELECT row_number() OVER (ORDER BY c_nationkey, c_mktsegment, band) - 1 AS gid, * FROM g)"""
_RISK = "CASE WHEN n >= 10 THEN 0 ELSE 20 - n END"


@query(
    f"{_GROUPS} SELECT gid, c_nationkey, c_mktsegment, band, n, n >= 10 AS safe, n < 10 AS unsafe, n <= 5 AS small, CAST({_RISK} AS BIGINT) AS risk FROM h"
)
def equivalence_classes(spark, sf):
    return customer_groups(spark, sf).drop("quasi")


@query(
    f"{_GROUPS} SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (n < 10) AS n_unsafe, round(avg(n) / 10, 6) AS cavg FROM h"
)
def cavg(spark, sf):
    return G.cavg(G.sizes(banded(spark, sf), QI), K)


@query("SELECT event_type, user_id, count(*) AS n, count(*) < 10 AS unsafe, count(*) <= 5 AS small FROM events GROUP BY 1, 2")
def event_classes(spark, sf):
    n = F.col("n")
    return G.sizes(table(spark, sf, "events"), ["event_type", "user_id"]).select(
        "event_type",
        "user_id",
        "n",
        X.is_unsafe(n, 10).alias("unsafe"),
        X.is_small(n, 10).alias("small"),
    )


@query(f"{_GROUPS} SELECT gid, n - 10 AS free FROM h WHERE n > 10")
def free_counts(spark, sf):
    return G.free_counts(customer_groups(spark, sf), K)


@query(
    f"SELECT c_custkey, c_nationkey, c_mktsegment, band FROM (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment, band ORDER BY c_custkey) AS i FROM ({_BANDED}) WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment, band)) WHERE i <= n - 10"
)
def free_tuples(spark, sf):
    rows = banded(spark, sf).withColumn("gid", F.struct(*QI))
    return G.free_tuples(rows, K, "gid", "c_custkey").select("c_custkey", *QI)


@query(f"""{_GROUPS}, need AS (SELECT gid AS dst, 10 - n AS m, sum(10 - n) OVER (ORDER BY n DESC, gid) AS e FROM h WHERE n < 10),
give AS (SELECT gid AS src, n - 10 AS f, sum(n - 10) OVER (ORDER BY gid) AS e FROM h WHERE n > 10)
SELECT dst, src, CAST(least(need.e, give.e) - greatest(need.e - m, give.e - f) AS BIGINT) AS m FROM need JOIN give ON need.e - m < give.e AND give.e - f < need.e WHERE need.e <= (SELECT sum(f) FROM give)""")
def free_matching(spark, sf):
    return G.match_free(customer_groups(spark, sf), K)


@query("SELECT count(DISTINCT p_brand) AS p_brand, count(DISTINCT p_type) AS p_type, count(DISTINCT p_size) AS p_size FROM part")
def quasi_cardinalities(spark, sf):
    return table(spark, sf, "part").agg(*[F.count_distinct(c).alias(c) for c in ("p_brand", "p_type", "p_size")])


@query("""WITH v AS (SELECT 'p_brand' AS attr, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part), c AS (SELECT attr, value, count(*) AS n FROM v GROUP BY 1, 2)
SELECT attr, value, n, round(n / sum(n) OVER (PARTITION BY attr), 6) AS share FROM c""")
def value_frequencies(spark, sf):
    return G.frequencies(table(spark, sf, "part"), ["p_brand", "p_type"]).select("attr", "value", "n", F.round("share", 6).alias("share"))


@query(
    """SELECT p_partkey, round(p_size / 10.0 + (count(*) OVER (PARTITION BY p_brand) + count(*) OVER (PARTITION BY p_type)) / CAST(count(*) OVER () AS DOUBLE), 6) AS grade FROM part"""
)
def tuple_grades(spark, sf):
    part = table(spark, sf, "part")
    n = part.count()
    shares = {c: part.groupBy(F.col(c).alias(f"k_{c}")).agg((F.count("*") / F.lit(n)).alias(f"s_{c}")) for c in ("p_brand", "p_type")}
    for c, s in shares.items():
        part = part.join(s, F.col(c) == F.col(f"k_{c}"))
    return part.select("p_partkey", F.round(X.grade([F.col("p_size")], [F.col("s_p_brand"), F.col("s_p_type")], K), 6).alias("grade"))


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def unknown_filter(spark, sf):
    marked = customers(spark, sf).withColumn(
        "c_mktsegment",
        F.when(F.col("c_mktsegment") == "BUILDING", " ? ").otherwise(F.col("c_mktsegment")),
    )
    return S.clean(S.unknown_to_null(marked, "c_mktsegment"), ["c_custkey", "c_mktsegment", "c_nationkey"])


@query("""WITH r AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
SELECT CAST(least(9, greatest(ceil((p_retailprice - lo) / ((hi - lo) / 10)) - 1, 0)) AS INTEGER) AS bin, count(*) AS n FROM part, r GROUP BY 1""")
def price_bins(spark, sf):
    part = table(spark, sf, "part")
    ends = part.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return part.crossJoin(F.broadcast(ends)).groupBy(
        X.bin_index(F.col("p_retailprice"), F.col("lo"), F.col("hi"), 10).alias("bin")
    ).agg(F.count("*").alias("n"))


def baskets(spark, sf, years: tuple[int, int] | None = None) -> DataFrame:
    """rid, items: the part types of each order, as items type=value."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    if years:
        orders = table(spark, sf, "orders").where(F.year("o_orderdate").between(*years)).select("o_orderkey")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("rid")).agg(
        F.sort_array(F.collect_set(F.concat(F.col("p_type"), F.lit("=y")))).alias("items")
    )


_BASKET = "WITH RECURSIVE x AS (SELECT DISTINCT l_orderkey AS rid, p_type || '=y' AS item FROM lineitem JOIN part ON l_partkey = p_partkey{w})"
_ALL = _BASKET.format(w="")
_N = "(SELECT count(DISTINCT rid) FROM x)"


def _levels(share: float = 0.1, name: str = "") -> str:
    """Itemsets of any size, as a CTE: each basket's subsets, counted. The text before it begins with WITH RECURSIVE."""
    x, n = f"x{name}", f"(SELECT count(DISTINCT rid) FROM x{name})"
    return f""", u{name} AS (SELECT rid, [item] AS items, item AS last FROM {x} UNION ALL SELECT u{name}.rid, list_append(u{name}.items, {x}.item), {x}.item FROM u{name} JOIN {x} ON {x}.rid = u{name}.rid AND {x}.item > u{name}.last),
l{name} AS (SELECT items, count(*) AS freq FROM u{name} GROUP BY items HAVING count(*) >= {share} * {n})"""


@query(f"{_ALL} SELECT item, count(*) AS n FROM x GROUP BY 1")
def item_histogram(spark, sf):
    return R.item_counts(baskets(spark, sf))


@query(_ALL + _levels() + " SELECT array_to_string(items, ',') AS items, freq FROM l")
def frequent_itemsets(spark, sf):
    """Itemsets of any size, by FP-growth."""
    return R.frequent_itemsets(baskets(spark, sf), 0.1).select(F.array_join("items", ",").alias("items"), "freq")


@query(_ALL + _levels() + " SELECT array_to_string(items, ',') AS items, freq FROM l")
def levelwise_itemsets(spark, sf):
    """Itemsets of any size, level by level until one is empty."""
    b = kept(baskets(spark, sf))
    return R.levelwise(b, 0.1 * b.count()).select(F.array_join("items", ",").alias("items"), "freq")


_SAMPLE = "WITH RECURSIVE x AS (SELECT DISTINCT l_orderkey AS rid, p_type || '=y' AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE ('0x' || substr(md5(l_orderkey || '|0'), 1, 8))::BIGINT < 0.6 * 4294967296)"


@query(_SAMPLE + _levels(share=0.06) + " SELECT array_to_string(items, ',') AS items, freq FROM l")
def sampled_itemsets(spark, sf):
    """Itemsets of any size in a sample, with the support lowered by the sample's share."""
    return R.frequent_itemsets(R.sampled(baskets(spark, sf), 0.6), 0.1, sample_factor=0.6).select(
        F.array_join("items", ",").alias("items"),
        "freq",
    )


def _side(items: str) -> str:
    return f"array_to_string([replace(i, '=', ':') FOR i IN list_sort({items})], '')"


def _rules(name: str = "", conf: float = 0.3) -> str:
    return f""", s{name} AS (SELECT items, freq, unnest(range(1, (1 << len(items)) - 1)) AS mask FROM l{name} WHERE len(items) >= 2),
ab{name} AS (SELECT items, freq, [items[i] FOR i IN range(1, len(items) + 1) IF (mask >> (i - 1)) & 1 = 1] AS a, [items[i] FOR i IN range(1, len(items) + 1) IF (mask >> (i - 1)) & 1 = 0] AS b FROM s{name}),
r{name} AS (SELECT md5({_side('a')} || '=>' || {_side('b')}) AS hash, array_to_string(a, ',') AS a, array_to_string(b, ',') AS b, ab{name}.freq AS support, l{name}.freq AS lhs_support, CAST(ab{name}.freq AS DOUBLE) / l{name}.freq AS confidence FROM ab{name} JOIN l{name} ON l{name}.items = ab{name}.a WHERE CAST(ab{name}.freq AS DOUBLE) / l{name}.freq >= {conf})"""


def mined(spark, sf, years=None, conf: float = 0.3, quasi: list[str] | None = None) -> DataFrame:
    b = kept(baskets(spark, sf, years))
    n = b.count()
    return R.rules_of(R.frequent_itemsets(b, 0.1), n, conf, quasi)


def shown(side: str):
    return F.array_join(F.transform(F.array_sort(side), X.item_key), ",").alias(side)


@query(
    _ALL + _levels() + _rules() + f" SELECT hash, a, b, support, lhs_support, round(support / CAST({_N} AS DOUBLE), 6) AS support_share, round(confidence, 6) AS confidence FROM r"
)
def association_rules(spark, sf):
    return mined(spark, sf).select(
        "hash",
        shown("a"),
        shown("b"),
        "support",
        "lhs_support",
        F.round("support_share", 6).alias("support_share"),
        F.round("confidence", 6).alias("confidence"),
    )


@query(_ALL + _levels() + _rules() + " SELECT hash, support FROM r ORDER BY md5(hash || '|3'), hash LIMIT 5")
def random_rules(spark, sf):
    """A sampling operator: five rules in hash order."""
    return X.pick(mined(spark, sf).select("hash", "support"), 5, "hash", seed=3)


@query(_ALL + _levels() + f" SELECT array_to_string(items, ',') AS items, freq FROM l WHERE freq > 0.1 * {_N}")
def strictly_frequent_itemsets(spark, sf):
    """Itemsets above the support, not at it."""
    return R.frequent_itemsets(baskets(spark, sf), 0.1, strict=True).select(F.array_join("items", ",").alias("items"), "freq")


_YEARS = """WITH RECURSIVE o AS (SELECT o_orderkey, year(o_orderdate) AS y FROM orders), xa AS (SELECT DISTINCT l_orderkey AS rid, p_type || '=y' AS item FROM lineitem JOIN part ON l_partkey = p_partkey JOIN o ON l_orderkey = o_orderkey WHERE y BETWEEN 1990 AND 1997),
xb AS (SELECT DISTINCT l_orderkey AS rid, p_type || '=y' AS item FROM lineitem JOIN part ON l_partkey = p_partkey JOIN o ON l_orderkey = o_orderkey WHERE y BETWEEN 1998 AND 2005)"""


@query(_YEARS + _levels(name="a") + _levels(name="b") + _rules("a", 0.45) + _rules("b", 0.45) + """, c AS (SELECT (SELECT count(*) FROM ra) AS n_before, (SELECT count(*) FROM rb) AS n_after, (SELECT count(*) FROM ra WHERE hash NOT IN (SELECT hash FROM rb)) AS n_lost, (SELECT count(*) FROM rb WHERE hash NOT IN (SELECT hash FROM ra)) AS n_new)
SELECT *, round(coalesce(n_lost / nullif(n_before, 0), 0), 6) AS lost, round(coalesce(n_new / nullif(n_before, 0), 0), 6) AS "new", round(coalesce((n_lost + n_new) / nullif(n_before, 0), 0), 6) AS different FROM c""")
def rules_compared(spark, sf):
    """The rules of orders up to 1997 and from 1998 on."""
    return R.compare(mined(spark, sf, (1990, 1997), 0.45), mined(spark, sf, (1998, 2005), 0.45))


@query(
    _ALL + _levels() + _rules() + " SELECT row_number() OVER (ORDER BY hash) AS place, hash, a, b, support FROM r QUALIFY row_number() OVER (ORDER BY hash) <= 10"
)
def first_rules(spark, sf):
    """The first ten rules by hash."""
    return R.first_rules(mined(spark, sf).select("hash", shown("a"), shown("b"), "support"))


@query(
    _ALL + _levels() + _rules() + f" SELECT count(*) FILTER (NOT (support >= 0.15 * {_N} AND confidence >= 0.4)) AS lost, count(*) FILTER (support >= 0.15 * {_N} AND confidence >= 0.4) AS kept FROM r"
)
def rules_surviving(spark, sf):
    """How many rules hold at a higher support and confidence."""
    b = baskets(spark, sf)
    return R.surviving(mined(spark, sf), b.count(), 0.15, 0.4)


@query(_ALL + _levels() + _rules() + """, q AS (SELECT *, CAST(support AS DOUBLE) AS s FROM r), w AS (SELECT *, contains(b, 'PROMO') OR contains(b, 'STANDARD') AS in_b, contains(a, 'PROMO') OR contains(a, 'STANDARD') AS in_a, s * (confidence - 0.3) / confidence AS spare FROM q)
SELECT hash, round(least(s - 0.5, CAST(trunc(CASE WHEN in_b THEN spare ELSE spare * 0.7 END) AS DOUBLE)), 6) AS literal, round(least(s - 0.5, CAST(floor(CASE WHEN in_b THEN spare ELSE spare / 0.7 END) AS DOUBLE)), 6) AS exact FROM w WHERE in_a OR in_b""")
def rule_budgets(spark, sf):
    quasi = _quasi_types(spark, sf)
    care = R.care_rules(mined(spark, sf, quasi=quasi), 0.3, quasi)
    exact = X.rule_budget(F.col("support"), F.col("confidence"), X.contains_quasi(F.col("b"), quasi), 0.3, 0.5, True)
    return care.select("hash", F.round("budget", 6).alias("literal"), F.round(exact, 6).alias("exact"))


def _quasi_types(spark, sf) -> list[str]:
    """The part types that stand for quasi-identifiers here; a dimension of a few values."""
    kinds = table(spark, sf, "part").select("p_type").distinct().where("p_type like '%PROMO%' or p_type like '%STANDARD%'")
    return sorted(r[0] for r in kinds.collect())


@query("""SELECT 'urgent_open' AS rule, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') AS support, count(*) FILTER (o_orderpriority = '1-URGENT') AS lhs_support, round(count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') / count(*), 6) AS support_share, round(coalesce(count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') / nullif(count(*) FILTER (o_orderpriority = '1-URGENT'), 0), 0), 6) AS confidence FROM orders
UNION ALL SELECT 'cheap_done', count(*) FILTER (o_totalprice > 1000 AND o_totalprice <= 100000 AND o_orderstatus = 'F'), count(*) FILTER (o_totalprice > 1000 AND o_totalprice <= 100000), round(count(*) FILTER (o_totalprice > 1000 AND o_totalprice <= 100000 AND o_orderstatus = 'F') / count(*), 6), round(coalesce(count(*) FILTER (o_totalprice > 1000 AND o_totalprice <= 100000 AND o_orderstatus = 'F') / nullif(count(*) FILTER (o_totalprice > 1000 AND o_totalprice <= 100000), 0), 0), 6) FROM orders
UNION ALL SELECT 'none', 0, 0, 0, 0""")
def rule_recount(spark, sf):
    rules = [
        {"name": "urgent_open", "a": [("o_orderpriority", "1-URGENT")], "b": [("o_orderstatus", "O")]},
        {"name": "cheap_done", "a": [("o_totalprice", "(1000-100000]")], "b": [("o_orderstatus", "F")]},
        {"name": "none", "a": [("o_orderstatus", "?")], "b": [("o_orderpriority", "1-URGENT")]},
    ]
    return R.recount(table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice"), rules)


def group_rule_table(spark) -> DataFrame:
    """Three demonstration rules over the customers' quasi-identifiers."""
    rows = [
        ("r1", 2.0, ["c_mktsegment=BUILDING"]),
        ("r2", 0.0, ["c_nationkey=3", "c_mktsegment=MACHINERY"]),
        ("r3", 5.0, ["c_nationkey=7"]),
    ]
    return spark.createDataFrame(rows, "hash string, budget double, quasi array<string>")


_RULES3 = "rq AS (SELECT * FROM (VALUES ('r1', 'c_mktsegment=BUILDING'), ('r2', 'c_nationkey=3'), ('r2', 'c_mktsegment=MACHINERY'), ('r3', 'c_nationkey=7')) t(hash, q))"
_QUASI = "hq AS (SELECT gid, unnest(['c_nationkey=' || c_nationkey, 'c_mktsegment=' || c_mktsegment, 'band=' || band]) AS q FROM h)"


@query(f"{_GROUPS}, {_QUASI}, {_RULES3} SELECT DISTINCT gid, hash FROM hq JOIN rq USING (q)")
def group_rules(spark, sf):
    return R.group_rules(customer_groups(spark, sf), group_rule_table(spark))


_PAIRS = "p AS (SELECT a.gid AS i_gid, b.gid AS j_gid, a.n AS ni, b.n AS nj FROM h a JOIN h b ON a.gid <> b.gid WHERE a.n < 10)"


@query(f"""{_GROUPS}, {_QUASI}, {_RULES3}, {_PAIRS}, gain AS (SELECT i_gid, j_gid, q FROM p JOIN hq ON hq.gid = j_gid WHERE NOT EXISTS (SELECT 1 FROM hq z WHERE z.gid = i_gid AND z.q = hq.q))
SELECT DISTINCT i_gid, j_gid, rq.hash FROM gain JOIN rq USING (q) WHERE EXISTS (SELECT 1 FROM hq z JOIN rq y ON y.q = z.q WHERE z.gid = i_gid AND y.hash = rq.hash)""")
def affected_rules(spark, sf):
    g = kept(customer_groups(spark, sf))
    return R.affected(g.where("unsafe"), g, group_rule_table(spark))


_SCORED = """both_ways AS (SELECT a.gid, a.gid AS i_gid, b.gid AS j_gid, a.n AS ni, b.n AS nj FROM h a JOIN h b ON a.gid <> b.gid WHERE a.n < 10 UNION ALL SELECT a.gid, b.gid, a.gid, b.n, a.n FROM h a JOIN h b ON a.gid <> b.gid WHERE a.n < 10),
moved AS (SELECT *, CASE WHEN ni >= 10 AND nj < 10 THEN least(10 - nj, ni - 10, ni) WHEN ni < 10 AND nj < 10 THEN least(ni, 10 - nj) WHEN ni < 10 THEN ni ELSE 0 END AS m FROM both_ways),
risked AS (SELECT *, (CASE WHEN ni >= 10 THEN 0 ELSE 20 - ni END) + (CASE WHEN nj >= 10 THEN 0 ELSE 20 - nj END) AS before, (CASE WHEN ni - m >= 10 OR ni - m <= 0 THEN 0 ELSE 20 - ni + m END) + (CASE WHEN nj + m >= 10 THEN 0 ELSE 20 - nj - m END) AS after FROM moved WHERE m > 0)"""


@query(f"""{_GROUPS}, {_SCORED} SELECT gid, i_gid, j_gid, CAST(m AS BIGINT) AS m, CAST(before - after AS BIGINT) AS reduction, ni < 10 AND nj < 10 AND after = 0 AS most_useful
FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY before - after DESC, m, i_gid, j_gid) AS k FROM risked) WHERE k = 1""")
def best_migrations(spark, sf):
    return G.best_partners(customer_groups(spark, sf), K)


@query(f"""{_GROUPS}, {_QUASI}, {_RULES3}, {_PAIRS}, zero AS (SELECT * FROM rq WHERE hash = 'r2'),
bad AS (SELECT i_gid, j_gid, count(DISTINCT zero.hash) AS c FROM p JOIN hq ON hq.gid = j_gid JOIN zero ON zero.q = hq.q WHERE NOT EXISTS (SELECT 1 FROM hq z WHERE z.gid = i_gid AND z.q = hq.q) AND EXISTS (SELECT 1 FROM hq z JOIN zero y ON y.q = z.q WHERE z.gid = i_gid) GROUP BY 1, 2)
SELECT i_gid AS gid, j_gid AS dst, overdrawn FROM (SELECT i_gid, p.j_gid, coalesce(c, 0) AS overdrawn, row_number() OVER (PARTITION BY i_gid ORDER BY coalesce(c, 0), p.j_gid) AS k FROM p LEFT JOIN bad USING (i_gid, j_gid) WHERE nj >= 10) WHERE k = 1""")
def dispersal_targets(spark, sf):
    """For each unsafe group the safe group with the fewest overdrawn rules."""
    g, rules = kept(customer_groups(spark, sf)), group_rule_table(spark)
    hit = R.affected(g.where("unsafe"), g.where("safe"), rules.where("budget <= 0")).groupBy(
        F.col("i_gid").alias("gid"),
        F.col("j_gid").alias("dst"),
    ).agg(F.count("*").alias("c"))
    return G.fewest_hits(g.where("unsafe"), g.where("safe"), hit).select("gid", "dst", F.col("hits").alias("overdrawn"))


def nations(spark, sf) -> DataFrame:
    """The hierarchy nation, region, *."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lit("nation").alias("attr"),
        F.col("n_name").alias("leaf"),
        F.array("n_name", "r_name", F.lit("*")).alias("path"),
        "n_nationkey",
    )


_PATHS = "WITH t AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(
    f"{_PATHS} SELECT n_name AS value, 2 AS level, 1 AS leaves FROM t UNION ALL SELECT r_name, 1, count(*) FROM t GROUP BY 1 UNION ALL SELECT '*', 0, count(*) FROM t"
)
def hierarchy_nodes(spark, sf):
    return X.nodes(nations(spark, sf)).select("value", F.col("level").cast("int").alias("level"), "leaves")


@query(
    f"{_PATHS} SELECT a.n_name AS a, b.n_name AS b, CASE WHEN a.n_name = b.n_name THEN a.n_name WHEN a.r_name = b.r_name THEN a.r_name ELSE '*' END AS lca, round(CASE WHEN a.n_name = b.n_name THEN 0 WHEN a.r_name = b.r_name THEN 0.5 ELSE 1 END, 6) AS distance FROM t a, t b"
)
def lca_distances(spark, sf):
    h = nations(spark, sf).select(F.col("leaf").alias("a"), F.col("path").alias("p"))
    o = nations(spark, sf).select(F.col("leaf").alias("b"), F.col("path").alias("q"))
    return h.crossJoin(F.broadcast(o)).select(
        "a",
        "b",
        X.lca(F.col("p"), F.col("q")).alias("lca"),
        F.round(X.depth_distance(F.col("p"), F.col("q"), 2), 6).alias("distance"),
    )


_NCP = f"""{_PATHS}, d AS (SELECT max(c_acctbal) - min(c_acctbal) AS r, (SELECT count(*) FROM nation) AS leaves FROM customer),
c AS (SELECT r_name, c_mktsegment, count(*) AS n, (max(c_acctbal) - min(c_acctbal)) AS w, CASE WHEN count(DISTINCT n_name) = 1 THEN 0 ELSE (SELECT count(*) FROM t z WHERE z.r_name = t.r_name) END AS l FROM customer JOIN t ON c_nationkey = n_nationkey GROUP BY 1, 2),
v AS (SELECT r_name, c_mktsegment, n, round(w / r + CAST(l AS DOUBLE) / leaves, 6) AS ncp FROM c, d)"""


@query(f"{_NCP} SELECT * FROM v")
def class_ncp(spark, sf):
    """The penalty of region by segment classes: account balance ranges and lowest common nodes of their nations."""
    c = customers(spark, sf)
    h = nations(spark, sf)
    up = h.select("n_nationkey", F.posexplode("path").alias("at", "node"))
    nodes = X.nodes(h).select(F.col("value").alias("v"), "level", "leaves")
    dom = c.agg((F.max("c_acctbal") - F.min("c_acctbal")).alias("r"))
    total = h.agg(F.count("*").alias("total"))
    rows = c.join(
        F.broadcast(h.select(F.col("n_nationkey").alias("k"), F.col("path")[1].alias("r_name"))),
        F.col("c_nationkey") == F.col("k"),
    )
    cls = rows.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"), (F.max("c_acctbal") - F.min("c_acctbal")).alias("w"))
    each = rows.select("r_name", "c_mktsegment", "c_nationkey").distinct()
    size = each.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("nations"))
    anc = each.join(
        F.broadcast(up),
        F.col("c_nationkey") == F.col("n_nationkey"),
    ).groupBy("r_name", "c_mktsegment", "node").agg(F.count("*").alias("hits"))
    lca = anc.join(size, ["r_name", "c_mktsegment"]).where("hits = nations").join(F.broadcast(nodes), F.col("node") == F.col("v")).groupBy("r_name", "c_mktsegment").agg(
        F.max_by("leaves", "level").alias("leaves")
    )
    out = cls.join(lca, ["r_name", "c_mktsegment"]).crossJoin(F.broadcast(dom)).crossJoin(F.broadcast(total))
    return out.select(
        "r_name",
        "c_mktsegment",
        "n",
        F.round(F.col("w") / F.col("r") + X.width(F.col("leaves"), F.col("total")), 6).alias("ncp"),
    )


@query(f"{_NCP} SELECT round(100.0 * sum(n * ncp) / sum(n) / 2, 4) AS ncp FROM v")
def total_ncp(spark, sf):
    return class_ncp(spark, sf).agg(F.round(F.lit(100.0) * F.sum(F.col("n") * F.col("ncp")) / F.sum("n") / 2, 4).alias("ncp"))


_DIST = "abs(a.p_size - s.p_size) / 50.0 + CASE WHEN a.p_type = s.p_type THEN 0 ELSE 1 END"


def _distance():
    return F.abs(F.col("p_size") - F.col("s_size")) / F.lit(50.0) + F.when(F.col("p_type") == F.col("s_type"), 0.0).otherwise(1.0)


_KIND = ["p_size", "p_type"]


def _query_set(spark, sf) -> DataFrame:
    """The query set of the searches: the parts whose id is divisible by 50."""
    return table(spark, sf, "part").where("p_partkey % 50 = 0").select(
        F.col("p_partkey").alias("seed"),
        F.col("p_size").alias("s_size"),
        F.col("p_type").alias("s_type"),
    )


def _same_kind():
    return F.col("k_size").eqNullSafe(F.col("s_size")) & F.col("k_type").eqNullSafe(F.col("s_type"))


@query(
    f"SELECT seed, p_partkey, distance, rank FROM (SELECT s.p_partkey AS seed, a.p_partkey, round({_DIST}, 6) AS distance, row_number() OVER (PARTITION BY s.p_partkey ORDER BY round({_DIST}, 6), a.p_partkey) AS rank FROM part a, part s WHERE s.p_partkey % 50 = 0 AND a.p_partkey <> s.p_partkey) WHERE rank <= 9"
)
def nearest_neighbours(spark, sf):
    """The k - 1 rows nearest to each row of the query set, of all rows.

    The distance depends on size and type alone, so of rows that agree in both only the
    first k count, and seeds that agree in both are searched for once; each task keeps the
    first k per search. One more than k - 1 is kept for the seed itself.
    """
    seeds = _query_set(spark, sf)
    near = Window.partitionBy(*_KIND).orderBy("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", *_KIND).withColumn("i", F.row_number().over(near)).where(F.col("i") <= K).drop("i")
    kinds = seeds.select("s_size", "s_type").distinct()
    w = Window.partitionBy("s_size", "s_type").orderBy("distance", "p_partkey")
    first = rows.crossJoin(F.broadcast(kinds)).withColumn("distance", F.round(_distance(), 6)).withColumn("i", F.row_number().over(w)).where(F.col("i") <= K)
    first = first.select(F.col("s_size").alias("k_size"), F.col("s_type").alias("k_type"), "p_partkey", "distance")
    each = seeds.join(first, _same_kind()).where("p_partkey <> seed")
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("distance", "p_partkey"))
    return each.withColumn("rank", rank).where(F.col("rank") < K).select("seed", "p_partkey", "distance", "rank")


@query(
    f"SELECT p_partkey, seed, distance FROM (SELECT a.p_partkey, s.p_partkey AS seed, round({_DIST}, 6) AS distance, row_number() OVER (PARTITION BY a.p_partkey ORDER BY round({_DIST}, 6), s.p_partkey) AS rank FROM part a, part s WHERE s.p_partkey % 50 = 0) WHERE rank = 1"
)
def nearest_seed(spark, sf):
    """Each row's nearest row of the query set; of seeds that agree in size and type the first counts."""
    seeds = _query_set(spark, sf).groupBy("s_size", "s_type").agg(F.min("seed").alias("seed"))
    rows = table(spark, sf, "part").select("p_partkey", *_KIND)
    best = rows.select(*_KIND).distinct().crossJoin(F.broadcast(seeds)).withColumn("distance", F.round(_distance(), 6)).groupBy(*_KIND).agg(
        F.min(F.struct("distance", "seed")).alias("b")
    )
    best = best.select(F.col("p_size").alias("k_size"), F.col("p_type").alias("k_type"), "b")
    return rows.join(best, F.col("k_size").eqNullSafe(F.col("p_size")) & F.col("k_type").eqNullSafe(F.col("p_type"))).select(
        "p_partkey",
        F.col("b.seed").alias("seed"),
        F.col("b.distance").alias("distance"),
    )


@query(
    f"SELECT seed, p_partkey, distance FROM (SELECT s.p_partkey AS seed, a.p_partkey, round({_DIST}, 6) AS distance, row_number() OVER (PARTITION BY s.p_partkey ORDER BY round({_DIST}, 6) DESC, a.p_partkey DESC) AS rank FROM part a, part s WHERE s.p_partkey % 50 = 0) WHERE rank = 1"
)
def furthest_row(spark, sf):
    """The row furthest from each row of the query set; of rows that agree in size and type the last counts."""
    seeds = _query_set(spark, sf)
    rows = table(spark, sf, "part").groupBy(*_KIND).agg(F.max("p_partkey").alias("p_partkey"))
    best = rows.crossJoin(F.broadcast(
        seeds.select("s_size", "s_type").distinct()
    )).withColumn("distance", F.round(_distance(), 6)).groupBy("s_size", "s_type").agg(
        F.max(F.struct("distance", "p_partkey")).alias("b")
    )
    best = best.select(F.col("s_size").alias("k_size"), F.col("s_type").alias("k_type"), "b")
    return seeds.join(best, _same_kind()).select("seed", F.col("b.p_partkey").alias("p_partkey"), F.col("b.distance").alias("distance"))


def _order_parts(spark, sf) -> DataFrame:
    """Orders cut until no valid cut is left."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("rid"), "o_totalprice", "o_orderpriority", "o_orderstatus")
    return P.partition(rows, ["o_totalprice"], ["o_orderpriority"], [P.k_anonymous(K, "rid")])


def _cut(source: str, target: str, test: str) -> str:
    """One round over rows (rid, p, c, e, part): spans of p are shares of its whole range, spans of c shares of all its values.
    test: a condition on a half, of the rows for which {{}} holds."""
    both = lambda side: f"({test.format(side)}) AND ({test.format('NOT ' + side)})"
    return f""", {target}s AS MATERIALIZED (SELECT part, (max(p) - min(p)) / (SELECT max(p) - min(p) FROM x0) AS sp, count(DISTINCT c) / CAST((SELECT count(DISTINCT c) FROM x0) AS DOUBLE) AS sc, median(p) AS m FROM {source} GROUP BY 1),
{target}f AS MATERIALIZED (SELECT part, c, row_number() OVER (PARTITION BY part ORDER BY min(rid)) > floor(count(*) OVER (PARTITION BY part) / 2) AS r FROM {source} GROUP BY 1, 2),
{target}h AS MATERIALIZED (SELECT {source}.*, sp, sc, p >= m AS rp, {target}f.r AS rc FROM {source} JOIN {target}s USING (part) JOIN {target}f USING (part, c)),
{target}v AS MATERIALIZED (SELECT part, {both('rp')} AS vp, {both('rc')} AS vc FROM {target}h GROUP BY 1),
{target} AS MATERIALIZED (SELECT rid, p, c, e, part || CASE WHEN vp AND (sp >= sc OR NOT vc) THEN CASE WHEN rp THEN 'R' ELSE 'L' END WHEN vc THEN CASE WHEN rc THEN 'R' ELSE 'L' END ELSE '' END AS part FROM {target}h JOIN {target}v USING (part))"""


#: More rounds than the partitions of a few million rows have; a round in which nothing can be cut changes nothing.
_ROUNDS = 24
_LAST = f"x{_ROUNDS}"


def _mondrian(rows: str, test: str) -> str:
    return f"WITH x0 AS MATERIALIZED ({rows})" + "".join(_cut(f"x{i}", f"x{i + 1}", test) for i in range(_ROUNDS))


_ORDER_PARTS = _mondrian(
    "SELECT o_orderkey AS rid, o_totalprice AS p, o_orderpriority AS c, o_orderstatus AS e, '' AS part FROM orders",
    "count(*) FILTER ({0}) >= 10",
)


@query(
    _ORDER_PARTS + f" SELECT part, count(*) AS n, round(avg(p), 6) AS mean_price, string_agg(DISTINCT c, '-' ORDER BY c) AS priorities FROM {_LAST} GROUP BY 1"
)
def mondrian_parts(spark, sf):
    """Partitions of orders, cut until no valid cut is left: path, size, mean price and priorities."""
    parts = _order_parts(spark, sf)
    return parts.groupBy("part").agg(
        F.count("*").alias("n"),
        F.round(F.avg("o_totalprice"), 6).alias("mean_price"),
        F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "-").alias("priorities"),
    )


@query(
    _ORDER_PARTS + f", nx AS (SELECT p, coalesce(lead(p) OVER (ORDER BY p), p) AS up FROM (SELECT DISTINCT p FROM x0)), b AS (SELECT part, min(p) AS lo, max(p) AS hi FROM {_LAST} GROUP BY 1) SELECT part, lo AS o_totalprice_lo, up AS o_totalprice_hi FROM b JOIN nx ON nx.p = b.hi"
)
def mondrian_rectangles(spark, sf):
    return P.rectangles(kept(_order_parts(spark, sf)), ["o_totalprice"])


@query(
    _ORDER_PARTS + f", g AS (SELECT part, round(avg(p), 6) AS price, string_agg(DISTINCT c, '-' ORDER BY c) AS pr FROM {_LAST} GROUP BY 1) SELECT part, e AS o_orderstatus, count(*) AS n, price AS o_totalprice, pr AS o_orderpriority FROM {_LAST} JOIN g USING (part) GROUP BY ALL"
)
def mondrian_release(spark, sf):
    return P.anonymized(kept(_order_parts(spark, sf)), ["o_totalprice"], ["o_orderpriority"], "o_orderstatus")


_CUSTOMER_ROWS = "SELECT c_custkey AS rid, c_acctbal AS p, CAST(c_nationkey AS VARCHAR) AS c, c_mktsegment AS e, '' AS part FROM customer"


def _customer_parts(spark, sf, *tests: P.Test) -> DataFrame:
    rows = customers(spark, sf).select(
        F.col("c_custkey").alias("rid"),
        "c_acctbal",
        F.col("c_nationkey").cast("string").alias("nation"),
        "c_mktsegment",
    )
    parts = P.partition(rows, ["c_acctbal"], ["nation"], [P.k_anonymous(K, "rid"), *tests])
    return parts.groupBy("part").agg(
        F.count("*").alias("n"),
        F.min("c_acctbal").alias("lo"),
        F.max("c_acctbal").alias("hi"),
        F.count_distinct("c_mktsegment").alias("diversity"),
    )


_PARTS_SHOWN = f" SELECT part, count(*) AS n, min(p) AS lo, max(p) AS hi, count(DISTINCT e) AS diversity FROM {_LAST} GROUP BY 1"


@query(_mondrian(_CUSTOMER_ROWS, "count(*) FILTER ({0}) >= 10 AND count(DISTINCT e) FILTER ({0}) >= 3") + _PARTS_SHOWN)
def mondrian_diverse(spark, sf):
    """Customers cut as far as classes of 10 with three segments allow."""
    return _customer_parts(spark, sf, P.l_diverse("c_mktsegment", 3))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_CLOSE = " AND ".join(
    f"(count(*) FILTER ({{0}} AND e = '{s}') = 0 OR abs(count(*) FILTER ({{0}} AND e = '{s}') / CAST(count(*) FILTER ({{0}}) AS DOUBLE) - (SELECT count(*) FILTER (e = '{s}') / CAST(count(*) AS DOUBLE) FROM x0)) <= 0.2)"
    for s in _SEGMENTS
)


@query(_mondrian(_CUSTOMER_ROWS, f"count(*) FILTER ({{0}}) >= 10 AND {_CLOSE}") + _PARTS_SHOWN)
def mondrian_close(spark, sf):
    """Customers cut as far as classes of 10 allow whose segments' shares are within 0.2 of those overall."""
    return _customer_parts(spark, sf, P.t_close("c_mktsegment", P.value_shares(customers(spark, sf), "c_mktsegment"), 0.2))


@query("SELECT event_type, user_id, count(*) AS n, count(DISTINCT value > 50) AS diversity FROM events GROUP BY 1, 2")
def l_diversity(spark, sf):
    return G.diversity(table(spark, sf, "events").withColumn("s", F.col("value") > 50), ["event_type", "user_id"], "s")


@query("""WITH j AS (SELECT c_nationkey, c_mktsegment FROM customer), l AS (SELECT c_nationkey, c_mktsegment, count(*) AS c FROM j GROUP BY 1, 2), g AS (SELECT c_mktsegment, count(*) / CAST((SELECT count(*) FROM j) AS DOUBLE) AS q FROM j GROUP BY 1), n AS (SELECT c_nationkey, count(*) AS n FROM j GROUP BY 1)
SELECT c_nationkey, n, round(max(abs(c / CAST(n AS DOUBLE) - q)), 6) AS t FROM l JOIN g USING (c_mktsegment) JOIN n USING (c_nationkey) GROUP BY 1, 2""")
def t_closeness(spark, sf):
    return G.t_closeness(customers(spark, sf), ["c_nationkey"], "c_mktsegment")


def _levels_of_customer(spark, sf) -> tuple[DataFrame, dict]:
    h = nations(spark, sf).select(F.col("n_nationkey").alias("k"), "path")
    rows = customers(spark, sf).join(F.broadcast(h), F.col("c_nationkey") == F.col("k"))
    return rows, {
        "nation": [X.level_of(F.col("path"), i) for i in range(3)],
        "segment": [F.col("c_mktsegment"), X.star(F.col("c_mktsegment"))],
    }


_LATTICE = f"""{_PATHS}, c AS (SELECT n_name AS v0, r_name AS v1, '*' AS v2, c_mktsegment AS s0, '*' AS s1 FROM customer JOIN t ON c_nationkey = n_nationkey),
a AS (SELECT node, loss, x, y, count(*) AS n FROM (""" + " UNION ALL ".join(f"SELECT '{i}-{j}' AS node, {round((i / 2 + j) / 2, 9)} AS loss, v{i} AS x, s{j} AS y FROM c" for i in range(3) for j in range(2)) + """) GROUP BY ALL),
z AS (SELECT node, loss, count(*) AS n_classes, CAST(coalesce(sum(n) FILTER (n < 10), 0) AS BIGINT) AS n_suppressed, CAST(sum(n) AS BIGINT) AS n_rows FROM a GROUP BY 1, 2)"""


@query(_LATTICE + " SELECT node, round(loss, 6) AS loss, n_classes, n_suppressed, n_rows FROM z")
def lattice_nodes(spark, sf):
    rows, levels = _levels_of_customer(spark, sf)
    return L.node_counts(rows, levels, K).withColumn("loss", F.round("loss", 6))


@query(
    _LATTICE + " SELECT node, round(loss, 6) AS loss, n_suppressed FROM z WHERE n_suppressed <= 0.05 * n_rows ORDER BY loss, n_suppressed, node LIMIT 1"
)
def lattice_best(spark, sf):
    rows, levels = _levels_of_customer(spark, sf)
    return L.best_node(L.node_counts(rows, levels, K)).select("node", F.round("loss", 6).alias("loss"), "n_suppressed")


@query(_LATTICE + """, best AS (SELECT node FROM z WHERE n_suppressed <= 0.05 * n_rows ORDER BY round(loss, 9), n_suppressed, node LIMIT 1),
v AS (SELECT c_custkey, CASE node[1] WHEN '0' THEN n_name WHEN '1' THEN r_name ELSE '*' END AS x, CASE node[3] WHEN '0' THEN c_mktsegment ELSE '*' END AS y FROM customer JOIN t ON c_nationkey = n_nationkey, best), w AS (SELECT *, count(*) OVER (PARTITION BY x, y) AS n FROM v)
SELECT c_custkey, CASE WHEN n >= 10 THEN x ELSE '*' END AS nation, CASE WHEN n >= 10 THEN y ELSE '*' END AS segment FROM w""")
def lattice_release(spark, sf):
    """Customers at the best node."""
    rows, levels = _levels_of_customer(spark, sf)
    best = L.best_node(L.node_counts(rows, levels, K)).first()["node"]
    return L.generalize(rows, levels, best, K).select("c_custkey", "nation", "segment")


@query(
    "SELECT c_custkey, CASE WHEN a <= 25 THEN '[0-25]' WHEN a <= 50 THEN '[26-50]' WHEN a <= 75 THEN '[51-75]' WHEN a <= 100 THEN '[76-100]' ELSE '[101-)' END AS age FROM (SELECT c_custkey, c_custkey % 110 AS a FROM customer)"
)
def age_levels(spark, sf):
    return customers(spark, sf).select("c_custkey", X.generalize_age(F.col("c_custkey") % 110).alias("age"))


@query("""WITH u AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1), c AS (SELECT o_custkey, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS codes FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT u.o_custkey, o.o_orderpriority, o.o_orderstatus, codes FROM u JOIN orders o ON o.o_orderkey = u.k JOIN c ON c.o_custkey = u.o_custkey""")
def users_with_conditions(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    codes = orders.select("o_custkey", "o_orderkey").join(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(
        table(spark, sf, "part").select("p_partkey", "p_type"),
        F.col("p_partkey") == F.col("l_partkey"),
    ).select("o_custkey", "p_type")
    return S.users_with_conditions(orders, codes, "o_custkey", "o_orderkey", "p_type").select(
        "o_custkey",
        "o_orderpriority",
        "o_orderstatus",
        F.array_join("codes", ",").alias("codes"),
    )


@query(
    "SELECT 'p_size' AS attr, CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi, CAST(max(p_size) - min(p_size) AS DOUBLE) AS range, count(DISTINCT p_size) AS n_values FROM part UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice), max(p_retailprice) - min(p_retailprice), count(DISTINCT p_retailprice) FROM part"
)
def numeric_domains(spark, sf):
    return S.numeric_domain(table(spark, sf, "part"), "p_size", "p_retailprice")


@query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY md5(c_custkey || '|7'), c_custkey LIMIT 100")
def hash_sample(spark, sf):
    """A sampling operator: 100 customers in hash order."""
    return X.pick(customers(spark, sf).select("c_custkey", "c_mktsegment"), 100, "c_custkey", seed=7)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, count(*) < 5 AS unsafe FROM events GROUP BY 1, 2")
def unsafe_event_windows(spark, sf):
    return streaming.unsafe_windows(table(spark, sf, "events"), "ts", ["event_type"], 5)


def clustered(method: str, spark, sf, block: str | None = "block") -> DataFrame:
    rows = customers(spark, sf).join(F.broadcast(nations(spark, sf)), F.col("c_nationkey") == F.col("n_nationkey"))
    paths = {r["leaf"]: list(r["path"]) for r in nations(spark, sf).collect()}
    rows = rows.select(
        F.col("c_custkey").alias("rid"),
        "c_acctbal",
        F.col("leaf").alias("nation"),
        F.concat_ws("/", F.col("path")[1], F.col("c_mktsegment")).alias("block"),
    )
    return C.anonymize(rows, method, K, ["c_acctbal"], {"nation": paths}, block=block)


def _cluster_query(method: str):
    def f(spark, sf):
        return clustered(method, spark, sf)

    f.__name__ = f"anonymize_{method}"
    f.__doc__ = f"Customers clustered by {method}, in blocks of region and segment."
    return query()(f)


for _m in C.METHODS:
    _cluster_query(_m)


def migrated(variant: str, spark, sf, block: str | None = "c_nationkey") -> DataFrame:
    rules = [(r["budget"], list(r["quasi"])) for r in group_rule_table(spark).collect()]
    return M.migrate(banded(spark, sf).select("c_custkey", *QI), QI, K, rules, variant, "c_custkey", block=block)


def _migrate_query(variant: str):
    def f(spark, sf):
        return migrated(variant, spark, sf)

    f.__name__ = f"migrate_{variant}"
    f.__doc__ = f"Customers migrated between the classes of their nation, variant {variant}."
    return query()(f)


for _v in M.VARIANTS:
    _migrate_query(_v)


@query()
def release_report(spark, sf):
    """What the migration variants leave: classes, unsafe ones, mean class size over k, and the rules lost and new when the release is mined again."""
    rows = kept(banded(spark, sf).select("c_custkey", *QI))
    out = None
    for v in M.VARIANTS:
        release = kept(QUERIES[f"migrate_{v}"](spark, sf))
        one = E.evaluate(
            rows,
            release.where("not suppressed").select("c_custkey", *QI),
            QI,
            K,
            0.01,
            0.1,
            "c_custkey",
        ).select(F.lit(v).alias("variant"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_KS, _SHARES = (5, 10, 15, 20, 25, 30), (0.2, 0.4, 0.6, 0.8, 1.0)
_SIZES = "count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (n < {k}) AS n_unsafe, round(avg(n) / {k}, 6) AS cavg"


@query(
    " UNION ALL ".join(
        f"SELECT {k} AS k, {_SIZES.format(k=k)} FROM (SELECT count(*) AS n FROM ({_BANDED}) GROUP BY c_nationkey, c_mktsegment, band)"
        for k in _KS
    )
)
def sweep_k(spark, sf):
    """Classes of customers for several k, from one count of their sizes."""
    return E.sweep_k(G.sizes(banded(spark, sf), QI), _KS)


@query(
    " UNION ALL ".join(
        f"SELECT {i} AS n_qi, {_SIZES.format(k=K)} FROM (SELECT count(*) AS n FROM ({_BANDED}) GROUP BY {', '.join(QI[:i])})"
        for i in (1, 2, 3)
    )
)
def sweep_qi(spark, sf):
    """Classes of customers by the first one, two and three quasi-identifiers, from one count."""
    return E.sweep_qi(G.sizes(banded(spark, sf), QI), QI, K)


@query(
    " UNION ALL ".join(
        f"SELECT {p} AS share, {_SIZES.format(k=K)} FROM (SELECT count(*) AS n FROM ({_BANDED}) WHERE ('0x' || substr(md5(c_custkey || '|0'), 1, 8))::BIGINT < {p} * 4294967296 GROUP BY c_nationkey, c_mktsegment, band)"
        for p in _SHARES
    )
)
def sweep_size(spark, sf):
    """Classes of growing samples of customers, in one pass."""
    return E.sweep_size(banded(spark, sf), QI, K, _SHARES, "c_custkey")


# ---- sources and sinks: written, read back ----


def _written(spark, name: str) -> str:
    return f"{S.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "SELECT CAST(c_custkey % 90 AS INTEGER) AS age, c_mktsegment AS workclass, n_name AS \"native-country\" FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING'"
)
def census_scan(spark, sf):
    """A census file, written with unknown values and read back: rows that know all of three columns."""
    path, names = _written(spark, "census"), ["age", "workclass", "native-country"]
    rows = customers(spark, sf).join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    workclass = F.concat(F.lit(" "), F.when(F.col("c_mktsegment") == "BUILDING", "?").otherwise(F.col("c_mktsegment")))
    S.write_dataset(
        rows.select(
            (F.col("c_custkey") % 90).alias("age"),
            workclass.alias("workclass"),
            F.col("n_name").alias("native-country"),
            F.lit("surplus").alias("label"),
        ),
        path,
        [*names, "label"],
    )
    return S.clean(S.read_census(spark, path, names), names)


@query(
    "WITH t AS (SELECT DISTINCT l_orderkey, l_linestatus || '_0' AS a, l_returnflag || '_1' AS b FROM lineitem) SELECT item, count(*) AS n FROM (SELECT a AS item FROM t UNION ALL SELECT b FROM t) GROUP BY 1"
)
def transaction_scan(spark, sf):
    """Lines of transactions, written and read back: each value with its position, and how often it stands."""
    path = _written(spark, "transactions")
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.concat_ws(", ", "l_linestatus", "l_returnflag").alias("value")).distinct()
    lines.select("value").write.text(path)
    return R.item_counts(S.read_transactions(spark, path))


@query(f"{_PATHS} SELECT 'nation' AS attr, n_name AS leaf, n_name || '>' || r_name || '>*' AS path FROM t")
def hierarchy_scan(spark, sf):
    """A hierarchy's file, written and read back."""
    path = _written(spark, "hierarchy")
    nations(spark, sf).select(F.array_join("path", ";").alias("value")).write.text(path)
    return S.read_hierarchy(spark, path, "nation").select("attr", "leaf", F.array_join("path", ">").alias("path"))


@query(_ALL + _levels() + _rules() + " SELECT hash, support FROM r")
def rules_file(spark, sf):
    """Rules, written and read back."""
    path = _written(spark, "rules")
    S.write_rules(mined(spark, sf), path)
    return S.read_rules(spark, path).select("hash", "support")


@query("""WITH r AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), b AS (SELECT p_partkey, least(9, greatest(ceil((p_retailprice - lo) / ((hi - lo) / 10)) - 1, 0)) AS i, lo, (hi - lo) / 10 AS w FROM part, r)
SELECT p_partkey, '(' || round(lo + w * i, 3) || '-' || round(lo + w * (i + 1), 3) || ']' AS p_retailprice FROM b""")
def price_labels(spark, sf):
    """Prices as labels of ten bins over their range."""
    return X.binned(
        table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("p_retailprice")),
        ["p_retailprice"],
        10,
    )
