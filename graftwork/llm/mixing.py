"""Mixing sources to target weights: temperature mixing, realised as budgeted permutations of blocks.

A source with a share p of the tokens gets the weight p ** a / sum of p ** a.
The exponent a in [0, 1] is bisected: it is the largest for which the weights'
entropy reaches `entropy` of the most possible (ln of the number of sources), and no
less than the smallest for which no source is repeated more than `repeats`
times. Budgets are the weights times the total, rounded down, by default of as
many tokens as there are.

A source's documents fall into blocks by a hash; a block's place in an epoch's
permutation is another hash of it and the epoch. A budget takes whole epochs, then, of one
more, the blocks in that order that fit, and of the block that the budget's end falls in the
documents in the order of a hash until one exceeds it, but one document at least of each source whose budget isn't 0. So only one number for each
block is accumulated, however large a source, and within one block of each source
one for each document; no text moves. `position` in [0, 1) interleaves the
sources evenly: sorting by it gives the mixed order.

A row's tokens are its runs of other than white space. Defined results: null
and empty texts have no tokens and are dropped, and so are sources
without tokens; a null source is a source of its own; rows with equal id and text
are in or out together (so the end of a budget may be exceeded by their
number); where there is one source its weight is 1. Columns stay as they are; epoch, block and position
are added (with underscores after their names if these are taken).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftwork.llm.rows import BROADCAST_KEYS, key_id, key_text
from graftwork.storage import cut

ENTROPY, REPEATS = 0.95, 4.0
#: Blocks of a source; their permutation is what mixes its documents.
BLOCKS = 4096
STEPS = 60


def weights(tokens: dict[object, int], entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> tuple[float, dict[object, float]]:
    """The exponent and the weight of each source with tokens."""
    tokens = {s: n for s, n in tokens.items() if n > 0}
    total = sum(tokens.values())
    if not total:
        return 1.0, {}
    names = sorted(tokens, key=lambda s: (s is None, str(s)))
    logs = [math.log(tokens[s] / total) for s in names]

    def at(a: float) -> list[float]:
        raw = [math.exp(a * x) for x in logs]
        whole = math.fsum(raw)
        return [x / whole for x in raw]

    def even(a: float) -> bool:
        w = at(a)
        return -math.fsum(x * math.log(x) for x in w if x > 0) >= entropy * math.log(len(w)) - 1e-12

    def calm(a: float) -> bool:
        return all(w * (budget or total) <= repeats * tokens[s] for w, s in zip(at(a), names))

    # entropy falls as the exponent rises, and so do repetitions
    def bisect(good_low: bool, test) -> float:
        low, high = 0.0, 1.0
        if test(1.0 if good_low else 0.0):
            return 1.0 if good_low else 0.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (mid, high) if test(mid) == good_low else (low, mid)
        return low if good_low else high

    a = max(bisect(True, even), bisect(False, calm))
    return a, dict(zip(names, at(a)))


def _hash(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"\S+")).cast("long")


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, blocks: int = BLOCKS, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mixture; one that an epoch repeats is there once for each."""
    marks = docs.select(docs[source_col].cast("string").alias("source"), key_id(docs[id_col]).alias("i"), key_text(docs[text_col]).alias("t"), tokens_of(docs[text_col]).alias("n"))
    marks = marks.where("n > 0").withColumn("block", F.pmod(_hash(F.lit(seed), "i", "t"), F.lit(blocks)).cast("int")).withColumn("order", _hash(F.lit(seed + 1), "i", "t"))
    by_block = cut(marks.groupBy("source", "block").agg(F.sum("n").alias("n")), "block-tokens")
    tokens = {r.source: int(r.n) for r in by_block.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    total = sum(tokens.values())
    _, weight = weights(tokens, entropy, repeats, budget)
    budgets = [(s, int(w * (budget or total)), tokens[s]) for s, w in weight.items()]
    plan = docs.sparkSession.createDataFrame(budgets, "of string, budget long, whole long")
    plan = plan.withColumn("epochs", F.expr("budget div whole")).withColumn("rest", F.col("budget") % F.col("whole"))
    # what is left for one more epoch: blocks in its permutation, with the tokens before each
    ranked = by_block.join(_few(plan, len(budgets)), F.col("source").eqNullSafe(F.col("of")))
    ranked = ranked.withColumn("turn", F.struct(_hash(F.lit(seed + 2), "source", "block", "epochs").alias("h"), "block"))
    ranked = ranked.withColumn("before", F.sum("n").over(Window.partitionBy("of").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"])
    fits = F.col("before") + F.col("n") <= F.col("rest")
    ends = ~fits & (F.col("before") < F.col("rest"))
    # a row for each source: its last whole block, and the one in which its budget ends, with the tokens left there
    known = ranked.groupBy("of", "epochs", "whole", "budget").agg(F.max(F.when(fits, F.col("turn"))).alias("full"), F.max(F.when(ends, F.col("turn"))).alias("border"), F.max(F.when(ends, F.col("rest") - F.col("before"))).alias("room"))
    known = cut(known, "sources")
    border = known.where("border IS NOT NULL").select("of", F.col("border.block").alias("at"), "room")
    inner = marks.join(_few(border, len(budgets)), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    inner = inner.groupBy("of", "order", "room").agg(F.sum("n").alias("n"))
    inner = inner.withColumn("before", F.sum("n").over(Window.partitionBy("of").orderBy("order").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"])
    limits = inner.groupBy("of").agg(F.max(F.when(F.col("before") + F.col("n") <= F.col("room"), F.col("order"))).alias("limit"), F.min("order").alias("least"))
    known = known.join(limits.withColumnRenamed("of", "of_l"), F.col("of").eqNullSafe(F.col("of_l")), "left")
    nothing = (F.col("epochs") == 0) & F.col("full").isNull()
    known = known.withColumn("limit", F.coalesce("limit", F.when(nothing, F.col("least"))))
    own = "_p"  # begins the names of our own columns beside the caller's
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    known = cut(known.select(F.struct("of", "epochs", "full", "border", "limit", (F.col("whole") / F.col("budget")).alias("share")).alias(own)), "sources")
    source, i, t = docs[source_col].cast("string"), key_id(docs[id_col]), key_text(docs[text_col])
    block = F.pmod(_hash(F.lit(seed), i, t), F.lit(blocks)).cast("int")
    rows = docs.where(docs[text_col].rlike(r"\S")).join(_few(known, len(budgets)), source.eqNullSafe(F.col(f"{own}.of")))
    turn = F.struct(_hash(F.lit(seed + 2), source, block, F.col(f"{own}.epochs")).alias("h"), block.alias("block"))
    last = F.coalesce(turn <= F.col(f"{own}.full"), F.lit(False)) | F.coalesce((turn == F.col(f"{own}.border")) & (_hash(F.lit(seed + 1), i, t) <= F.col(f"{own}.limit")), F.lit(False))
    times = F.col(f"{own}.epochs") + F.when(last, 1).otherwise(0)
    names = docs.columns
    added = []
    for name in ("epoch", "block", "position"):
        while name in {*names, *added}:
            name += "_"
        added.append(name)
    rows = rows.where(times > 0).select(*(docs[c] for c in names), block.alias(added[1]), i.alias(own + "_i"), t.alias(own + "_t"), source.alias(own + "_s"), F.col(f"{own}.share").alias(own + "_share"), F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias(added[0]))
    # a place in the epoch for each block, then within it for each document
    place = _unit(_hash(F.lit(seed + 2), F.col(own + "_s"), F.col(added[1]), F.col(added[0])))
    within = _unit(_hash(F.lit(seed + 3), F.col(own + "_i"), F.col(own + "_t"), F.col(added[0]))) / blocks
    top = F.lit(1 - 1e-12)
    position = F.least((F.col(added[0]) + F.least(place + within, top)) * F.col(own + "_share"), top)
    return rows.select(*names, F.col(added[0]), F.col(added[1]), position.alias(added[2]))


def _unit(h: Column) -> Column:
    return h / F.lit(2.0**64) + 0.5


def _few(table: DataFrame, count: int) -> DataFrame:
    """One row for each source: broadcast, unless there are very many."""
    return F.broadcast(table) if count <= BROADCAST_KEYS else table
