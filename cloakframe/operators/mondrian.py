"""Multidimensional partitioning.

A partition splits on its widest column whose halves both pass all tests, until none does.
Partitions are independent of each other, so the order in which they are taken doesn't
matter. Those of over `local_rows` rows are split a depth at a time, all of a depth in one
round: a histogram of values per partition gives spans and exact cuts, and one aggregation
tests both halves of all columns. Smaller ones are finished by one task each.

Numbers are cut at the median (below it: left); categories at half of their values in order
of first appearance. The columns to cut on must not be null; rows may repeat.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keep import kept, running_sum


@dataclass(frozen=True)
class Test:
    """A condition on a partition, as an aggregate and on values at hand (a function from column names to arrays)."""

    column: Callable[[], Column]
    local: Callable[[Callable[[str], np.ndarray]], bool]


def k_anonymous(k: int, any_column: str) -> Test:
    return Test(lambda: F.count("*") >= k, lambda get: len(get(any_column)) >= k)


def l_diverse(sensitive: str, l: int) -> Test:  # noqa: E741
    return Test(lambda: F.count_distinct(sensitive) >= l, lambda get: len(set(get(sensitive).tolist()) - {None}) >= l)


def value_shares(df: DataFrame, column: str, most: int = 200) -> dict[str, float]:
    """The share of each value of a column with few values; more than `most` are refused."""
    rows = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).count().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has over {most} values")
    n = sum(r["count"] for r in rows)
    return {r["v"]: r["count"] / n for r in sorted(rows)}


def t_close(sensitive: str, shares: dict[str, float], p: float = 0.2) -> Test:
    """No value that is there has a share that differs by more than p from its share overall."""
    def column() -> Column:
        own = lambda v: F.count_if(F.col(sensitive).cast("string") == v)
        gaps = [F.when(own(v) > 0, F.abs(own(v) / F.count(sensitive) - F.lit(q))).otherwise(0.0) for v, q in shares.items()]
        return F.greatest(F.lit(0.0), F.lit(0.0), *gaps) <= p

    def local(get) -> bool:
        values = [str(v) for v in get(sensitive).tolist() if v is not None]
        return all(abs(values.count(v) / len(values) - q) <= p for v, q in shares.items() if v in values)

    return Test(column, local)


def _spans(df: DataFrame, numeric: list[str], categorical: list[str]) -> list[Column]:
    return [
        *[(F.max(c) - F.min(c)).cast("double").alias(f"span_{c}") for c in numeric],
        *[F.count_distinct(c).cast("double").alias(f"span_{c}") for c in categorical],
    ]


def _at_ranks(values: DataFrame, part: str, value: str, weight: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per part, the values at ranks (from 0, each from the part's sum of weights) in a table of distinct (part, value)."""
    run = running_sum(values, [part, value], F.col(weight), "__end")
    ends = run.groupBy(F.col(part).alias("__whole")).agg(
        F.min(F.col("__end") - F.col(weight)).alias("__start"),
        F.max("__end").alias("__stop"),
    )
    joined = run.join(ends, F.col(part) == F.col("__whole"))
    first, past, n = F.col("__end") - F.col(weight) - F.col("__start"), F.col("__end") - F.col("__start"), F.col("__stop") - F.col("__start")
    picked = [F.min(F.when((first <= r(n)) & (r(n) < past), F.col(value))).alias(name) for name, r in ranks.items()]
    return joined.groupBy(part).agg(*picked)


def medians(df: DataFrame, part: str, column: str) -> DataFrame:
    """part, median: exact, from a histogram in which equal values count together; no task sees a whole partition."""
    values = df.groupBy(part, F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    at = _at_ranks(values, part, "__v", "__n", {"__lo": lambda n: F.floor((n - 1) / 2), "__hi": lambda n: F.floor(n / 2)})
    return at.select(part, ((F.col("__lo") + F.col("__hi")) / 2).alias("median"))


def _sides(active: DataFrame, numeric: list[str], categorical: list[str], order: str) -> DataFrame:
    """active with right_c for each column: whether the row goes right when its partition is cut there."""
    out = active
    for c in numeric:
        cut = medians(active, "part", c).select(F.col("part").alias("__p"), F.col("median").alias("__m"))
        out = out.join(cut, F.col("part") == F.col("__p")).withColumn(f"right_{c}", F.col(c) >= F.col("__m")).drop("__p", "__m")
    for c in categorical:
        first = kept(active.groupBy(F.col("part").alias("__p"), F.col(c).alias("__v")).agg(F.min(order).alias("__f")))
        last = _at_ranks(first.withColumn("__one", F.lit(1)), "__p", "__f", "__one", {"__last": lambda n: F.floor(n / 2) - 1})
        sides = first.join(last.select(F.col("__p").alias("__q"), "__last"), F.col("__p") == F.col("__q")).select(
            "__p",
            "__v",
            (F.col("__f") > F.coalesce("__last", F.col("__f") - 1)).alias(f"right_{c}"),
        )
        out = out.join(sides, (F.col("part") == F.col("__p")) & F.col(c).eqNullSafe(F.col("__v"))).drop("__p", "__v")
    return out


def _round(active: DataFrame, numeric: list[str], categorical: list[str], valid: list[Test], total: dict, order: str) -> DataFrame:
    """active with __side: L or R of the cut its partition takes, null if it takes none."""
    columns = [*numeric, *categorical]
    sided = kept(_sides(active, numeric, categorical, order))
    each = sided.withColumn(
        "__x",
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"right_{c}").alias("right")) for i, c in enumerate(columns)])),
    )
    ok = F.lit(True)
    for t in valid:
        ok = ok & t.column()
    tested = each.groupBy("part", "__x").agg(ok.alias("ok")).groupBy("part", F.col("__x.i").alias("i")).agg(
        ((F.count("*") == 2) & F.bool_and("ok")).alias("good")
    ).where("good")
    good = tested.groupBy("part").agg(F.collect_set("i").alias("good")).select(F.col("part").alias("__g"), "good")
    spans = active.groupBy("part").agg(*_spans(active, numeric, categorical))
    shares = F.array(
        *[F.struct((-F.col(f"span_{c}") / F.lit(total[c] or 1.0)).alias("s"), F.lit(i).alias("i")) for i, c in enumerate(columns)]
    )
    best = F.try_element_at(F.filter(F.array_sort(shares), lambda x: F.array_contains("good", x["i"])), F.lit(1))["i"]
    choice = spans.join(good, F.col("part") == F.col("__g")).select(F.col("part").alias("__q"), best.alias("__c"))
    right = F.element_at(F.array(*[F.col(f"right_{c}") for c in columns]), F.col("__c") + 1)
    side = F.when(F.col("__c").isNotNull(), F.when(right, "R").otherwise("L"))
    return sided.join(choice, F.col("part") == F.col("__q"), "left").withColumn("__side", side).drop(
        "__q",
        "__c",
        *[f"right_{c}" for c in columns],
    )


def _finish(
    data: dict[str, np.ndarray],
    numeric: list[str],
    categorical: list[str],
    valid: list[Test],
    total: dict,
    order: str,
    part: str,
) -> np.ndarray:
    """The parts of the rows of one partition, which is cut until no valid cut is left."""
    out = np.empty(len(data[order]), object)
    todo = [(part, np.arange(len(out)))]
    while todo:
        name, own = todo.pop()
        options = []
        for i, c in enumerate([*numeric, *categorical]):
            x = data[c][own]
            if c in numeric:
                x = x.astype(float)
                span, right = x.max() - x.min(), x >= np.median(x)
            else:
                values, at = np.unique(x, return_inverse=True)
                first = np.full(len(values), data[order][own].max())
                np.minimum.at(first, at, data[order][own])
                rank = np.empty(len(values), int)
                rank[np.argsort(first, kind="stable")] = np.arange(len(values))
                span, right = float(len(values)), rank[at] >= len(values) // 2
            options.append((-span / (total[c] or 1.0), i, right))
        for _, _, right in sorted(options, key=lambda o: o[:2]):
            halves = own[~right], own[right]
            if all(len(h) and all(t.local(lambda c, h=h: data[c][h]) for t in valid) for h in halves):
                todo += [(name + "L", halves[0]), (name + "R", halves[1])]
                break
        else:
            out[own] = name
    return out


def partition(
    df: DataFrame,
    numeric: list[str],
    categorical: list[str],
    valid: list[Test],
    order: str = "rid",
    local_rows: int = 50_000,
) -> DataFrame:
    """df with part: the path of its partition (L and R), when no valid cut is left. local_rows: up to so many rows one task finishes a partition."""
    total = df.agg(*_spans(df, numeric, categorical)).first().asDict()
    total = {c.removeprefix("span_"): v for c, v in total.items()}
    schema = df.withColumn("part", F.lit(""))
    active, done = kept(schema), []
    small = []
    while True:
        sizes = active.groupBy("part").agg(F.count("*").alias("__n")).select(
            F.col("part").alias("__p"),
            (F.col("__n") > local_rows).alias("__large"),
        )
        sized = kept(active.join(sizes, F.col("part") == F.col("__p")).drop("__p"))
        small.append(sized.where("not __large").drop("__large"))
        active = sized.where("__large").drop("__large")
        if active.isEmpty():
            break
        cut = kept(_round(active, numeric, categorical, valid, total, order))
        done.append(cut.where("__side is null").drop("__side"))
        active = kept(cut.where("__side is not null").withColumn("part", F.concat("part", "__side")).drop("__side"))
        if active.isEmpty():
            break
    names = schema.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        pdf["part"] = _finish({c: pdf[c].to_numpy() for c in names}, numeric, categorical, valid, total, order, pdf["part"].iloc[0])
        return pdf[names]

    out = small[0]
    for x in small[1:]:
        out = out.unionByName(x)
    out = out.groupBy("part").applyInPandas(run, schema.schema)
    for x in done:
        out = out.unionByName(x.select(*names))
    return out


def rectangles(parts: DataFrame, columns: list[str], part: str = "part") -> DataFrame:
    """Bounding boxes: per partition the least value, and the next larger value of all data after the largest."""
    out = None
    for c in columns:
        places = kept(running_sum(parts.select(F.col(c).alias("__v")).distinct(), ["__v"], F.lit(1), "__at"))
        after = places.select(F.col("__v").alias("__next"), (F.col("__at") - 1).alias("__before"))
        nxt = places.join(after, F.col("__at") == F.col("__before"), "left").select("__v", F.coalesce("__next", "__v").alias("__next"))
        box = parts.groupBy(part).agg(F.min(c).alias(f"{c}_lo"), F.max(c).alias("__hi")).join(nxt, F.col("__hi") == F.col("__v")).select(
            F.col(part).alias(f"__{c}"),
            f"{c}_lo",
            F.col("__next").alias(f"{c}_hi"),
        )
        out = box if out is None else out.join(box, F.col(out.columns[0]) == F.col(f"__{c}")).drop(f"__{c}")
    return out.withColumnRenamed(out.columns[0], part)


def anonymized(parts: DataFrame, numeric: list[str], categorical: list[str], sensitive: str, part: str = "part") -> DataFrame:
    """Per partition and sensitive value: generalised columns and the count."""
    general = parts.groupBy(F.col(part).alias("__p")).agg(
        *[F.round(F.avg(c), 6).alias(c) for c in numeric],
        *[F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), "-").alias(c) for c in categorical],
    )
    counts = parts.groupBy(part, sensitive).agg(F.count("*").alias("n"))
    return counts.join(general, F.col(part) == F.col("__p")).drop("__p")
