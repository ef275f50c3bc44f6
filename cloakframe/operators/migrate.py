"""Migration of rows between equivalence classes, under budgets of rules.

Works on the summary of the groups: sequential inside a block of groups, as each move
changes what the next may do; blocks run side by side with shares of the budgets. Moves
name intervals of row numbers of their source group, and a join replays them on the rows.

Policies: an unsafe group that has received does not give, one that has given does not
receive; a move takes at least one row; all rules it affects have budget left, and lose one.
A group goes on until it is safe, empty or without an allowed move; if its partner is left
unsafe, that is next. Groups without an allowed move leave the pool of partners and disperse
at the end: rows that they have received return to where they came from, which gives the
budget back, and a group that this leaves with one row disperses too; their own rows go, one
at a time, to the safe group with the fewest overdrawn rules, the one that was safe first.

Variants: ``m3ar`` takes unsafe groups in hashed order and the best partner of all;
``big_small`` takes the smallest first and looks at big (or, for a group that isn't small, at
small) unsafe partners, then the other unsafe ones, then safe ones, and stops at a partner
with whom all risk goes; ``free_first`` fills unsafe groups, largest first, from the free
rows of safe ones while all rules have budget, whole or not at all, then goes on as
``big_small``.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import groups as G
from .keep import kept, running_sum

VARIANTS = ("m3ar", "big_small", "free_first")


def _risk(n, k, empty):
    return np.where((n >= k) | (empty & (n <= 0)), 0, 2 * k - n)


class _Board:
    """Groups of a block: sizes, their own rows that are left, and rows received, all as intervals of row numbers."""

    def __init__(self, gids: np.ndarray, n: np.ndarray, quasi: list, rules: list[tuple[float, list[str]]], k: int):
        self.gid, self.n, self.k = gids, n.copy(), k
        self.own, self.size0 = n.copy(), n.copy()
        self.received = np.zeros(len(n), np.int64)
        self.pool = [deque([(1, int(x))]) for x in n]
        self.got: list[list[tuple[int, int, int]]] = [[] for _ in n]  # (source, first, last)
        words = {w: i for i, w in enumerate(sorted({w for q in quasi for w in q} | {w for _, q in rules for w in q}))}
        self.has = np.zeros((len(n), len(words)), bool)
        for i, q in enumerate(quasi):
            self.has[i, [words[w] for w in q]] = True
        self.rule = np.zeros((len(rules), len(words)), bool)
        for i, (_, q) in enumerate(rules):
            self.rule[i, [words[w] for w in q]] = True
        self.budget = np.array([b for b, _ in rules], float)
        self.rules_of = (self.has.astype(np.int32) @ self.rule.T.astype(np.int32)) > 0

    def affected(self, i, j) -> np.ndarray:
        """(pairs, rules): rules of giver i with a value that j has and i hasn't."""
        i, j = np.atleast_1d(i), np.atleast_1d(j)
        gained = self.has[j] & ~self.has[i]
        return ((gained.astype(np.int32) @ self.rule.T.astype(np.int32)) > 0) & self.rules_of[i]

    def score(self, i: np.ndarray, j: np.ndarray):
        """Rows to move, risk reduction, whether the policies allow it, and whether all risk goes, per pair."""
        k, ni, nj = self.k, self.n[i], self.n[j]
        m = np.where(
            (ni >= k) & (nj < k),
            np.minimum(np.minimum(k - nj, ni - k), self.own[i]),
            np.where((ni < k) & (nj < k), np.minimum(ni, k - nj), np.where((ni < k) & (nj >= k), ni, 0)),
        )
        m = np.minimum(m, self.own[i])
        before = _risk(ni, k, False) + _risk(nj, k, False)
        gain = before - _risk(ni - m, k, True) - _risk(nj + m, k, True)
        ok = (m > 0) & (ni > 0) & (nj > 0) & (i != j) & (gain > 0)
        ok &= ~((ni < k) & (self.received[i] > 0)) & ~((nj < k) & (self.own[j] < self.size0[j]))
        if len(self.budget):
            ok &= ~(self.affected(i, j) & (self.budget <= 0)).any(1)
        return m, gain, ok, (ni < k) & (nj < k) & (gain == before)

    def move(self, i: int, j: int, m: int) -> None:
        """The first m of i's own rows go to j."""
        self.own[i] -= m
        self.n[i] -= m
        self.n[j] += m
        self.received[j] += m
        while m:
            a, b = self.pool[i].popleft()
            take = min(m, b - a + 1)
            self.got[j].append((i, a, a + take - 1))
            if a + take <= b:
                self.pool[i].appendleft((a + take, b))
            m -= take

    def give_back(self, s: int) -> list[int]:
        """All that s has received returns; the sources, in order of return, each as often as it had one row after it."""
        alone = []
        for i, a, b in self.got[s]:
            m = b - a + 1
            self.pool[i].append((a, b))
            if self.n[i] == 0:
                alone.append(i)
            self.own[i] += m
            self.n[i] += m
            self.n[s] -= m
            if len(self.budget):
                self.budget += m * self.affected(i, s)[0]
        self.got[s], self.received[s] = [], 0
        return alone

    def best(self, s: int, partners: list[int], first_useful: bool):
        """The allowed move between s and a partner, either way, with the most risk reduction, then the fewest rows; ties go by the partners' order, with first_useful, else by gid."""
        if not partners:
            return None
        p = np.array(partners)
        i, j = np.stack([np.full(len(p), s), p], 1).ravel(), np.stack([p, np.full(len(p), s)], 1).ravel()
        m, gain, ok, useful = self.score(i, j)
        at = np.flatnonzero(ok)
        if not len(at):
            return None
        if first_useful:
            at = at[useful[at]][:1] if useful[at].any() else at[np.lexsort((m[at], -gain[at]))]
        else:
            at = at[np.lexsort((self.gid[j[at]], self.gid[i[at]], m[at], -gain[at]))]
        return int(i[at[0]]), int(j[at[0]]), int(m[at[0]])

    def disperse(self, s: int, safe: list[int]) -> list[int]:
        """Everything leaves s; groups that have one row again and must disperse too."""
        alone = self.give_back(s)
        if safe:
            where = np.array(safe)
            touched = self.affected(np.full(len(where), s), where)
            while self.own[s]:
                over = (touched & (self.budget < 0)).sum(1)
                k = int(np.argmin(over))
                self.move(s, int(where[k]), 1)
                if len(self.budget):
                    self.budget -= touched[k]
        return alone


def _fill_from_free(board: _Board, unsafe: list[int], safe: list[int]) -> None:
    """Whole groups become safe by free rows of groups that were safe from the start."""
    free = {i: int(board.n[i] - board.k) for i in safe}
    for s in sorted(unsafe, key=lambda x: (-board.n[x], board.gid[x])):
        if not any(free.values()) or len(board.budget) and (board.budget <= 0).any():
            break
        need, plan, before = int(board.k - board.n[s]), [], board.budget.copy()
        for i in safe:
            own = board.affected(i, s)[0] if len(board.budget) else np.zeros(0, bool)
            room = min((int(np.ceil(b)) for b in board.budget[own]), default=need)
            m = max(0, min(free[i], need, room))
            if m:
                plan.append((i, m))
                board.budget[own] -= m
                need -= m
            if not need:
                break
        if need:
            board.budget = before
            continue
        for i, m in plan:
            board.move(i, s, m)
            free[i] -= m
        unsafe.remove(s)
        safe.append(s)
        free[s] = 0


def _run(board: _Board, variant: str, seed: int) -> None:
    k, n = board.k, board.n
    by_gid = [int(x) for x in np.argsort(board.gid, kind="stable")]
    safe, unsafe = [x for x in by_gid if n[x] >= k], [x for x in by_gid if 0 < n[x] < k]
    if variant == "free_first":
        _fill_from_free(board, unsafe, safe)
        unsafe.sort(key=lambda x: board.gid[x])
    small, big = [x for x in unsafe if n[x] <= k / 2], [x for x in unsafe if n[x] > k / 2]
    if variant == "m3ar":
        rank = np.random.default_rng(seed).permutation(len(n))
        unsafe.sort(key=lambda x: rank[x])
    else:
        unsafe.sort(key=lambda x: (n[x], board.gid[x]))
    stuck: list[int] = []

    def leaves(x: int) -> None:
        for group in (unsafe, small, big):
            if x in group:
                group.remove(x)

    s = None
    while unsafe or s is not None:
        if s is None:
            s = unsafe[0]
            leaves(s)
        if variant == "m3ar":
            found = board.best(s, unsafe + safe, False)
        else:
            found = board.best(s, (big + small if n[s] <= k / 2 else small + big) + safe, True)
        if found is None:
            stuck.append(s)
            s = None
            continue
        g = found[1] if found[0] == s else found[0]
        board.move(*found)
        if len(board.budget):
            board.budget -= board.affected(*found[:2])[0]
        for x in (s, g):
            if n[x] >= k and x not in safe:
                safe.append(x)
            if n[x] >= k or not n[x]:
                leaves(x)
        if 0 < n[s] < k:
            continue
        s = g if 0 < n[g] < k else None
        if s is not None:
            leaves(s)
    while stuck:
        s = stuck.pop(0)
        if n[s] > 0:
            stuck += board.disperse(s, [x for x in safe if x != s])


def plan_moves(
    summary: DataFrame,
    k: int,
    rules: list[tuple[float, list[str]]] | None = None,
    variant: str = "m3ar",
    block: str | None = None,
    seed: int = 0,
) -> DataFrame:
    """src, first, last, dst: rows first to last of group src end in group dst.

    summary: gid, n, quasi (attr=value texts), and the block column if given. rules: budget and
    quasi texts of each; a bounded list, which goes to every task.
    """
    if variant not in VARIANTS:
        raise ValueError(f"no variant {variant}")
    rules = rules or []
    total = summary.agg(F.sum("n")).first()[0] or 0
    rows = summary.select("gid", "n", "quasi", (F.col(block).cast("string") if block else F.lit("")).alias("block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gid").reset_index(drop=True)
        share = pdf["n"].sum() / max(1, total)
        board = _Board(
            pdf["gid"].to_numpy(np.int64),
            pdf["n"].to_numpy(np.int64),
            [list(q) for q in pdf["quasi"]],
            [(np.floor(b * share), q) for b, q in rules],
            k,
        )
        _run(board, variant, seed)
        out = [(board.gid[i], a, b, board.gid[j]) for j, own in enumerate(board.got) for i, a, b in own]
        return pd.DataFrame(out, columns=["src", "first", "last", "dst"])

    return rows.groupBy("block").applyInPandas(run, "src long, first long, last long, dst long")


def migrate(
    df: DataFrame,
    qi: list[str],
    k: int,
    rules: list[tuple[float, list[str]]] | None = None,
    variant: str = "m3ar",
    rid: str = "rid",
    block: str | None = None,
    seed: int = 0,
) -> DataFrame:
    """df with src_gid and gid, and the quasi-identifiers of the group each row ends in.

    Groups that stay below k (no safe group in their block) have suppressed = true and null
    quasi-identifiers. block: one of the quasi-identifiers. rid must differ from row to row.
    A row's number in its group is its place among all rows less its group's, so that no task
    orders a group.
    """
    summary = kept(G.build_groups(df, qi, k))
    moves = plan_moves(summary, k, rules, variant, block, seed)
    rows = G.assigned(G.known(df, qi), summary, qi).withColumnRenamed("gid", "src_gid")
    one = F.lit(1).cast("long")
    starts = running_sum(summary.select(F.col("gid").alias("s_gid"), F.col("n").alias("s_n")), ["s_gid"], F.col("s_n"), "s_end")
    rows = running_sum(rows, ["src_gid", rid], one, "__i").join(starts, F.col("src_gid") == F.col("s_gid"))
    rows = rows.withColumn("__i", F.col("__i") - (F.col("s_end") - F.col("s_n"))).drop("s_gid", "s_n", "s_end")
    moved = rows.join(moves, (F.col("src_gid") == F.col("src")) & F.col("__i").between(F.col("first"), F.col("last")), "left")
    moved = moved.withColumn("gid", F.coalesce("dst", "src_gid")).drop("src", "first", "last", "dst", "__i")
    final = moved.groupBy(F.col("gid").alias("f_gid")).agg(F.count("*").alias("size"))
    target = summary.select(F.col("gid").alias("t_gid"), *[F.col(c).alias(f"__{c}") for c in qi])
    out = moved.drop(*qi).join(target, F.col("gid") == F.col("t_gid")).join(final, F.col("gid") == F.col("f_gid")).withColumn(
        "suppressed",
        F.col("size") < k,
    )
    return out.withColumns({c: F.when(~F.col("suppressed"), F.col(f"__{c}")) for c in qi}).drop("t_gid", "f_gid", *[f"__{c}" for c in qi])
