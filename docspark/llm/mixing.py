"""Mixing sources to target weights: an exact fit of word budgets by document lengths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST_REPEATS, SEED = 1.5, 2, 20
FIT_WIDTH = 1 << 16
DEALS = 256


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in order of code points, null last, get the weights in turn. They share `share` of all sizes by weight;
    no target exceeds `most` times its source's size and the excess is shared anew. That has one solution, a level:
    every target is the lesser of its bound and weight times level. Sources sorted by bound over weight reach their
    bounds in that order, so running sums give the level. One row a source, so the windows are small.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    by_turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(turn, F.lit(len(weights))) + 1)
    ranked = sources.withColumn("__w", by_turn).withColumn("__bound", F.col("source_size").cast("double") * most)
    order = W.orderBy(F.col("__bound") / F.col("__w"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    ranked = (
        ranked.withColumn("__full", F.coalesce(F.sum("__bound").over(before), F.lit(0.0)))
        .withColumn("__left", F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
        .withColumn("__budget", F.sum(F.col("source_size").cast("double")).over(whole) * share)
        .withColumn("__rank", F.row_number().over(order))
    )
    level = (F.col("__budget") - F.col("__full")) / F.col("__left")
    reached = F.col("__w") * level >= F.col("__bound")
    # the first source that stays below its bound fixes the level for all after it
    ranked = ranked.withColumn("__level", F.min(F.when(~reached, F.struct("__rank", level.alias("level")))).over(whole)["level"])
    target = F.coalesce(F.least(F.col("__bound"), F.col("__w") * F.col("__level")), F.col("__bound"))
    return ranked.select("source", "source_size", target.alias("target"))


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their lengths add up as near to the budget as can be found.

    Lengths ascend and are positive. Each length first gives its even share and the longest fill up; some of that is
    given back, so that a last part of the budget, of some FIT_WIDTH, is free. It is fitted by a bounded knapsack over
    reachable sums, kept as bit sets.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    taken = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    room = max(FIT_WIDTH, 2 * (lengths[-1] if lengths else 0))
    for i in range(len(lengths) - 1, -1, -1):
        if left > room:
            more = min(counts[i] - taken[i], (left - room) // lengths[i])
            taken[i] += more
            left -= more * lengths[i]
    for i, n in enumerate(lengths):
        back = min(taken[i], max(0, -(-(min(budget, FIT_WIDTH // 2) - left) // n)))
        taken[i] -= back
        left += back * n
    wide = (1 << (left + 1)) - 1
    sums, steps = 1, []
    for i, n in enumerate(lengths):
        free = min(counts[i] - taken[i], left // n)
        part = 1
        while free > 0 and not sums >> left & 1:  # bounded counts as powers of two
            part = min(part, free)
            grown = (sums | sums << (part * n)) & wide
            if grown != sums:
                steps.append((i, part, sums))
                sums = grown
            free -= part
            part *= 2
    at = sums.bit_length() - 1
    for i, part, earlier in reversed(steps):
        if not earlier >> at & 1:
            taken[i] += part
            at -= part * lengths[i]
    return taken


def mix(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (how often the mix takes the document) of all rows.

    Null text has size 0; a null source is a source, last in order; documents of size 0 are never taken. Of equal
    lengths in a source the seeded hash of doc_id decides; rows that agree in it are alike, so reruns agree but for
    which of such twins is taken. An empty table gives no rows; columns named in `carry` come along. Texts are read once; then only ids and sizes move.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    deal = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(DEALS))
    rows = cut(docs.select("doc_id", "source", size.alias("size"), *carry).withColumn("__deal", deal))
    lengths = rows.groupBy("source", "size", "__deal").agg(F.count(F.lit(1)).alias("n"))
    counted = lengths.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goal = targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    known = pa.schema([("source", pa.string()), ("size", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), ("whole", pa.int64()), ("more", pa.int64())])

    def plan(group: pa.Table) -> pa.Table:
        r = sorted(group.to_pylist(), key=lambda x: x["size"])
        total, target = r[0]["source_size"], r[0]["target"]
        positive = [x for x in r if x["size"] > 0]
        fitted = fit([x["size"] for x in positive], [most * x["n"] for x in positive], round(target))
        took = dict(zip([x["size"] for x in positive], fitted, strict=True))
        out = []
        for x in r:
            whole, more = divmod(took.get(x["size"], 0), x["n"])
            out.append({"source": x["source"], "size": x["size"], "source_size": total, "target": target, "whole": whole, "more": more})
        return pa.Table.from_pylist(out, schema=known)

    # a row for each length of a source: no more than the longest text has words
    joined = counted.alias("c").join(goal.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
    joined = joined.select("c.source", "size", "n", "source_size", "target")
    plans = joined.groupBy("source").applyInArrow(plan, "source string, size long, source_size long, target double, whole long, more long")
    # documents of one length are taken by deals of their seeded hash; only one deal is ranked row by row
    upto = F.sum("n").over(W.partitionBy("source", "size").orderBy("__deal").rowsBetween(W.unboundedPreceding, -1))
    deals = lengths.withColumn("__before", F.coalesce(upto, F.lit(0))).alias("d")
    deals = deals.join(plans.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")))
    quota = F.greatest(F.lit(0), F.least(F.col("n"), F.col("more") - F.col("__before")))
    deals = deals.select("d.source", "d.size", "d.__deal", "source_size", "target", "whole", "n", quota.alias("quota")).alias("d")
    out = rows.alias("r").join(deals, F.col("r.source").eqNullSafe(F.col("d.source")) & (F.col("r.size") == F.col("d.size")) & (F.col("r.__deal") == F.col("d.__deal")))
    out = out.select("r.doc_id", "r.source", "r.size", "r.__deal", *[f"r.{c}" for c in carry], "source_size", "target", "whole", "n", "quota")
    rank = F.row_number().over(W.partitionBy("source", "size", "__deal").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id"))
    split = (F.col("quota") > 0) & (F.col("quota") < F.col("n"))
    some = out.filter(split).withColumn("__rank", rank).withColumn("extra", (F.col("__rank") <= F.col("quota")).cast("long")).drop("__rank")
    rest = out.filter(~split).withColumn("extra", (F.col("quota") > 0).cast("long"))
    return some.unionByName(rest).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"), *carry)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, as often as the mix takes them, with all columns, whatever their names; see `mix`.

    Rows that agree in doc_id, source and text share what the mix takes of them evenly. Null and empty texts are never
    taken; an empty table gives no rows.
    """
    row, copies, n, turn, times, copy = fresh(docs, "row_key", "row_copies", "row_count", "row_turn", "row_times", "row_copy")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "source", F.md5("text")))
    size = keyed.select("doc_id", "source", "text", row)
    taken = mix(size, carry=(row,), **options).groupBy(row).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(n))
    rows = keyed.join(taken.filter(F.col(copies) > 0), row)
    rows = rows.withColumn(turn, F.row_number().over(W.partitionBy(row).orderBy(row)))
    share = F.floor(F.col(copies) / F.col(n)) + (F.col(turn) <= F.col(copies) % F.col(n)).cast("long")
    rows = rows.withColumn(times, share).filter(F.col(times) > 0)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark, sf_dir):
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
