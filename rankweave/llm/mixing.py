"""Mixing sources to target weights by fitting subset sums.

Every document may be taken at most `REPEATS` times. A source's budget is first spent on
whole rounds of all its documents. For the rest, its documents are counted by exact length;
each length gives its even share, rounded down, and what remains of the budget is fitted by
a bounded-knapsack dynamic program over the lengths still to be had. The plan is one number
for each source and length. The documents of a length are then taken in the order of a seeded
hash, so a rerun takes the same ones.

The program runs once for each source over its lengths, whose number grows with the longest
document, not with the rows. It reaches `REACH` words or, where that is more, `LONGEST` times
the longest document; longer remainders are first shortened by the longest documents. Where
few documents are left, all their sums are tried, however long they are.

A null or empty text has size 0 and is never taken. A null source is a source of its own,
last in order. Rows that repeat an id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.session import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
REACH = 1 << 16
#: times the longest document that the program reaches at least
LONGEST = 4
#: items of which all sums are tried
FEW = 18
#: parts into which the documents of one source and length are ranked
PARTS = 1024
_WORD = "[^\\x20\\x09-\\x0D]+"


def with_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                 repeats: int = REPEATS) -> DataFrame:
    """`sources` (named, key, source_size) with the words to take from each.

    Sources in order of code point, null last, get the weights in turn. No target is above
    `repeats` times its source's size; the excess goes to the others by weight, round by
    round, until none is above. The order is found by ranges, so no task sees all sources.
    """
    by = [F.col("named").desc(), F.col("key").asc()]
    ranged = written(sources.repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "sources")
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*by)) - 1
    turn = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(place, F.lit(len(weights))).cast("int"))
    ranked = ranged.join(counts, "range").withColumn("weight", turn)
    ranked = written(ranked.withColumn("most", F.lit(float(repeats)) * F.col("source_size")), "weights")
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    left, total, seen = budget, ranked.agg(F.sum("weight")).first()[0] or 0.0, -1
    while total:
        above = F.lit(left) * F.col("weight") / F.lit(total) > F.col("most")
        full, spent, open_ = ranked.agg(F.count_if(above), F.sum(F.when(above, F.col("most"))),
                                        F.sum(F.when(~above, F.col("weight")))).first()
        if full == seen or not full:
            break
        seen, left, total = full, budget - spent, open_ or 0.0
    goal = F.least(F.lit(left) * F.col("weight") / F.lit(total), F.col("most")) if total else F.col("most")
    return ranked.select("named", "key", "source_size", goal.alias("target"))


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take for the largest sum within `budget`.

    Item k of a length with c copies is split into 1, 2, 4, ... copies. `first[s]` is the
    item that first reached the sum s, so walking back from the best sum gives the choice.
    """
    items = []
    for k in np.flatnonzero((lengths <= budget) & (counts > 0)).tolist():
        left, step = min(int(counts[k]), budget // int(lengths[k])), 1
        while left > 0:
            many = min(step, left)
            items.append((k, many, many * int(lengths[k])))
            left -= many
            step *= 2
    taken = np.zeros(len(lengths), np.int64)
    if len(items) <= FEW:
        sums, sets = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for number, (_, _, size) in enumerate(items):
            fits = sums <= budget - size
            sums, at = np.unique(np.concatenate([sums, sums[fits] + size]), return_index=True)
            sets = np.concatenate([sets, sets[fits] | 1 << number])[at]
        for number, (k, many, _) in enumerate(items):
            taken[k] += many * (int(sets[-1]) >> number & 1)
        return taken
    first = np.full(budget + 1, -1, np.int32)
    first[0] = 0
    for number, (_, _, size) in enumerate(items, 1):
        if size <= budget:
            new = np.flatnonzero((first[size:] < 0) & (first[:budget + 1 - size] >= 0))
            first[new + size] = number
        if first[budget] >= 0:
            break
    at = int(np.flatnonzero(first >= 0)[-1])
    while at:
        k, many, size = items[first[at] - 1]
        taken[k] += many
        at -= size
    return taken


def plan(lengths: np.ndarray, counts: np.ndarray, target: float, repeats: int = REPEATS, reach: int = REACH) -> np.ndarray:
    """Total times that documents of each length are taken; sums near `target`, never above its rounding."""
    total = int((lengths * counts).sum())
    taken = np.zeros(len(lengths), np.int64)
    if not total or target <= 0:
        return taken
    budget = min(int(round(target)), repeats * total)
    rounds = min(budget // total, repeats)
    taken += rounds * counts
    budget -= rounds * total
    if rounds < repeats and budget:
        share = budget / total
        part = np.floor(counts * share).astype(np.int64)
        budget -= int((part * lengths).sum())
        left = counts - part
        fit = (left > 0) & (lengths > 0) & (lengths <= budget)
        reach = max(reach, LONGEST * int(lengths[fit].max(initial=0)))
        items = np.where(fit, np.ceil(np.log2(np.maximum(left, 0) + 1)), 0)
        few = items.sum()
        for k in np.argsort(-lengths).tolist():
            if budget <= reach or few <= FEW:
                break
            if not fit[k]:
                continue
            few -= items[k]
            more = min(int(left[k]), max(0, (budget - reach // 2) // int(lengths[k])))
            part[k] += more
            left[k] -= more
            budget -= more * int(lengths[k])
        part += knapsack(lengths, left, budget)
        taken += part
    return taken


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
          seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every row of `docs`."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long").alias("size"))
    rows = rows.withColumns({"drawn": F.xxhash64("id", F.lit(seed)), "named": F.col("source").isNotNull(),
                             "key": F.coalesce("source", F.lit(""))})
    rows = written(rows.withColumn("part", F.pmod(F.col("drawn"), F.lit(PARTS)).cast("int")), "sizes")
    parts = rows.groupBy("named", "key", "size", "part").agg(F.count("*").alias("n"))
    lengths = parts.groupBy("named", "key", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("named", "key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = with_targets(sources, weights, share, repeats)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        times = plan(pdf["size"].to_numpy(), np.where(pdf["size"] > 0, pdf["n"], 0), float(pdf["target"].iat[0]), repeats)
        return pdf.assign(times=times)[["named", "key", "size", "source_size", "target", "n", "times"]]

    plans = lengths.join(goals, ["named", "key"]).groupBy("named", "key").applyInPandas(
        fitted, "named boolean, key string, size long, source_size long, target double, n long, times long")
    before = Window.partitionBy("named", "key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ahead = ahead.join(plans, ["named", "key", "size"])
    # a place in line: the documents of earlier parts, then the rank within the part
    rank = Window.partitionBy("named", "key", "size", "part").orderBy("drawn", "id")
    ranked = rows.withColumn("rank", F.row_number().over(rank)).join(ahead, ["named", "key", "size", "part"])
    whole, more = F.floor(F.col("times") / F.greatest("n", F.lit(1))), F.col("times") % F.greatest("n", F.lit(1))
    copies = (whole + (F.col("ahead") + F.col("rank") <= more).cast("long")).cast("long")
    return ranked.select("id", F.when(F.col("named"), F.col("key")).alias("source"), "size", "source_size", "target",
                         copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
        seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs` that are taken, with size, source_size, target, copies and taken.

    A new column whose name `docs` already has gets an underscore. Rows that share id, source
    and size are taken alike, as often as the one of them that is taken most.
    """
    found = mixed(docs, weights, share, repeats, seed, id_col, text_col, source_col)
    values = ["source_size", "target", "copies", "taken"]
    found = found.groupBy("id", "source", "size").agg(*(F.max(c).alias(c) for c in values)).where("copies > 0")
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(_WORD)), F.lit(0)).cast("long")
    same = (docs[id_col].eqNullSafe(found["id"]) & docs[source_col].cast("string").eqNullSafe(found["source"])
            & (size == found["size"]))
    used, added = {c.lower() for c in docs.columns}, []
    for name in ("size", *values):                       # Spark tells names apart without their case
        new = name
        while new in used:
            new += "_"
        used.add(new)
        added.append((new, found[name]))
    return docs.join(found, same).select(*(docs[c] for c in docs.columns), *(c.alias(n) for n, c in added))
