"""Every registered query of the library against its SQL, on the smallest tables."""

import hashlib
from collections import Counter
from datetime import date
from itertools import combinations
from pathlib import Path
from statistics import median

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloakframe.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    rows = [tuple("null" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False)]
    return [list(df.columns), sorted(rows)]


@pytest.mark.skipif(not Path(DIR).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, DIR).toPandas()) == plain(duck.sql(catalog.ORACLES[name]).df())


def itemsets(rows, least):
    """Itemsets of any size in plain Python."""
    counts = Counter(c for b in rows for n in range(1, len(b) + 1) for c in combinations(sorted(b), n))
    return {",".join(c): k for c, k in counts.items() if k >= least}


@pytest.fixture(scope="module")
def bought(duck):
    """The item lists of orders."""
    return dict(duck.sql("SELECT l_orderkey, list(DISTINCT p_type || '=y') FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1").fetchall())


@pytest.mark.skipif(not Path(DIR).exists(), reason="no tables")
def test_itemsets_of_any_size(spark, bought):
    share = lambda k: int(hashlib.md5(f"{k}|0".encode()).hexdigest()[:8], 16) / 2**32
    sample = [b for k, b in bought.items() if share(k) < 0.6]
    want = itemsets(sample, 0.06 * len(sample))
    assert dict(map(tuple, catalog.QUERIES["sampled_itemsets"](spark, DIR).collect())) == want
    want = itemsets(bought.values(), 0.1 * len(bought))
    for name in ("frequent_itemsets", "levelwise_itemsets"):
        assert dict(map(tuple, catalog.QUERIES[name](spark, DIR).collect())) == want


@pytest.mark.skipif(not Path(DIR).exists(), reason="no tables")
def test_both_sides_of_a_comparison_have_rules(spark):
    got = catalog.QUERIES["rules_compared"](spark, DIR).first()
    assert min(got["n_before"], got["n_after"], got["n_lost"]) > 0


@pytest.fixture(scope="module")
def bundles(spark, tmp_path_factory):
    """Tables in which four part types are always bought together."""
    d = str(tmp_path_factory.mktemp("bundles"))
    spark.createDataFrame([(o, p) for o in range(20) for p in ([1, 2, 3, 4] if o < 15 else [5])], "l_orderkey long, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(("PROMO A", "B", "C", "D", "E"), 1)], "p_partkey long, p_type string").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(o, date(1996 + 3 * (o % 2), 1, 1)) for o in range(20)], "o_orderkey long, o_orderdate date").write.parquet(f"{d}/orders.parquet")
    return d


def test_rules_from_itemsets_of_any_size(spark, bundles):
    """Four items give 14 + 4 * 6 + 6 * 2 = 50 rules; all but those without the quasi-identifier have a budget."""
    for name in ("frequent_itemsets", "levelwise_itemsets"):
        assert catalog.QUERIES[name](spark, bundles).count() == 16
    rules = catalog.QUERIES["association_rules"](spark, bundles).collect()
    assert len(rules) == 50 and max(len(f"{r['a']},{r['b']}".split(",")) for r in rules) == 4
    assert catalog.QUERIES["rule_budgets"](spark, bundles).count() == 50 - 12
    assert catalog.QUERIES["rules_compared"](spark, bundles).first()["n_before"] == 50


@pytest.mark.skipif(not Path(DIR).exists(), reason="no tables")
@pytest.mark.parametrize("few", [False, True])
def test_searches_of_the_whole_query_set(spark, tmp_path, few):
    """Every part whose id is divisible by 50 against all parts; also with many parts of one size and type."""
    d = DIR
    if few:
        d = str(tmp_path)
        spark.range(1, 801).select(F.col("id").alias("p_partkey"), (F.col("id") % 3).cast("int").alias("p_size"), F.when(F.col("id") % 7 < 3, "a").otherwise("b").alias("p_type")).write.parquet(f"{d}/part.parquet")
    parts = [tuple(r) for r in spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", "p_type").collect()]
    seeds = [p for p in parts if p[0] % 50 == 0]
    assert len(seeds) == (16 if few else 4)
    far = {(s[0], p[0]): round(abs(p[1] - s[1]) / 50 + (p[2] != s[2]), 6) for s in seeds for p in parts}
    near = {s[0]: sorted((far[s[0], p[0]], p[0]) for p in parts if p[0] != s[0])[:9] for s in seeds}
    got = catalog.QUERIES["nearest_neighbours"](spark, d).select("seed", "p_partkey", "distance", "rank").collect()
    assert sorted(map(tuple, got)) == sorted((s, p, x, i) for s, v in near.items() for i, (x, p) in enumerate(v, 1))
    got = catalog.QUERIES["nearest_seed"](spark, d).select("p_partkey", "distance", "seed").collect()
    assert sorted(map(tuple, got)) == sorted((p[0], *min((far[s[0], p[0]], s[0]) for s in seeds)) for p in parts)
    got = catalog.QUERIES["furthest_row"](spark, d).select("seed", "distance", "p_partkey").collect()
    assert sorted(map(tuple, got)) == sorted((s[0], *max((far[s[0], p[0]], p[0]) for p in parts)) for s in seeds)


def mondrian(rows, all_rows, k=10, part=""):
    """Partitions of (id, price, priority, status) rows, cut one at a time until no valid cut is left."""
    def width(x):
        prices = [r[1] for r in x]
        return max(prices) - min(prices), len({r[2] for r in x})

    middle = median(r[1] for r in rows)
    first = sorted({r[2] for r in rows}, key=lambda c: min(r[0] for r in rows if r[2] == c))
    right = set(first[len(first) // 2 :])
    sides = [[r[1] >= middle for r in rows], [r[2] in right for r in rows]]
    shares = [a / b for a, b in zip(width(rows), width(all_rows), strict=True)]
    for i in sorted((0, 1), key=lambda i: -shares[i]):
        if k <= sum(sides[i]) <= len(rows) - k:
            halves = [[r for r, s in zip(rows, sides[i], strict=True) if s == side] for side in (False, True)]
            return {**mondrian(halves[0], all_rows, k, part + "L"), **mondrian(halves[1], all_rows, k, part + "R")}
    return {part: rows}


@pytest.mark.skipif(not Path(DIR).exists(), reason="no tables")
def test_mondrian_until_no_cut_is_left(spark, tmp_path):
    """The first 200 orders of the table: the finished partitioning's rectangles and release."""
    d = str(tmp_path)
    spark.read.parquet(f"{DIR}/orders.parquet").orderBy("o_orderkey").limit(200).write.parquet(f"{d}/orders.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_totalprice").cast("double"), "o_orderpriority", "o_orderstatus").collect()]
    parts = mondrian(rows, rows)
    assert len(parts) > 8 and all(len(p) >= 10 for p in parts.values())
    prices = sorted({r[1] for r in rows})
    after = dict(zip(prices, [*prices[1:], prices[-1]], strict=True))
    got = catalog.QUERIES["mondrian_rectangles"](spark, d).collect()
    assert {r["part"]: (r["o_totalprice_lo"], r["o_totalprice_hi"]) for r in got} == {k: (min(r[1] for r in p), after[max(r[1] for r in p)]) for k, p in parts.items()}
    got = catalog.QUERIES["mondrian_release"](spark, d).collect()
    assert {(r["part"], r["o_orderstatus"]): (r["n"], r["o_orderpriority"]) for r in got} == {(k, s): (n, "-".join(sorted({r[2] for r in p}))) for k, p in parts.items() for s, n in Counter(r[3] for r in p).items()}
    assert all(abs(r["o_totalprice"] - sum(x[1] for x in parts[r["part"]]) / len(parts[r["part"]])) < 0.001 for r in got)


def test_entry_survives_a_missing_library(monkeypatch):
    """Without a library that the text operators need, theirs are left out and the others stay."""
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("cloakframe.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "pyarrow", None)
    assert set(__spark_entry__.queries()) == set(catalog.QUERIES) and set(__spark_entry__.oracle_sql()) == set(catalog.ORACLES)


def test_entry_survives_without_text_operators():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())
