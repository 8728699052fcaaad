"""Scores of change as columns: similarity, penalty, intensity, histograms, data-flow tags, classes of commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRUCTURE_WEIGHT, TOKEN_WEIGHT = 0.6, 0.4


def complexity_factor(old: Column, new: Column) -> Column:
    """1 - |new - old| / (old + new), at least 0; 1 where both are 0."""
    return F.when(old + new == 0, F.lit(1.0)).otherwise(1.0 - F.least(F.lit(1.0), F.abs(new - old) / (old + new)))


def intensity(percent: Column) -> Column:
    return F.when(percent >= 80, "low").when(percent >= 50, "medium").otherwise("high")


def composite(structure: Column, token: Column) -> Column:
    return structure * STRUCTURE_WEIGHT + token * TOKEN_WEIGHT


def bin_of(token: Column, bins: int) -> Column:
    """Bin of a token by the first byte of its digest; the same in any engine."""
    return F.conv(F.substring(F.md5(token), 1, 2), 16, 10).cast("long") % bins


def histogram(tokens: DataFrame, key: str, token: str, bins: int = 16) -> DataFrame:
    """Rows (key, bin, n): tokens by bin, saturated at 255."""
    return tokens.groupBy(key, bin_of(F.col(token), bins).alias("bin")).agg(F.least(F.lit(255), F.count("*")).cast("long").alias("n"))


def positional_penalty(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, penalty) of old and new(key, pos, token): 0 unless both have as many tokens; else 0.2 x displacement of k-th occurrences / n^2."""
    w = Window.partitionBy("key", "token").orderBy("pos")
    a = old.withColumn("k", F.row_number().over(w)).withColumnRenamed("pos", "i")
    b = new.withColumn("k", F.row_number().over(w)).withColumnRenamed("pos", "j")
    n = old.groupBy("key").agg(F.count("*").alias("n")).join(new.groupBy("key").agg(F.count("*").alias("m")), "key").where("n = m")
    moved = a.join(b, ["key", "token", "k"]).groupBy("key").agg(F.sum(F.abs(F.col("i") - F.col("j"))).alias("moved"))
    return n.join(moved, "key", "left").select("key", F.least(F.lit(0.2), F.lit(0.2) * F.coalesce("moved", F.lit(0)) / (F.col("n") * F.col("n"))).alias("penalty"))


def data_flow_tag(same_content: Column, same_shape: Column, same_vars: Column, same_returns: Column) -> Column:
    return F.when(same_content, "UNCHANGED").when(same_shape & ~same_vars, "COSMETIC_LOCAL_RENAME").when(same_vars & same_returns, "PURE_CONTROL_FLOW").otherwise("DATA_FLOW_MUTATED")


CLASSES = ("refactor", "feature", "bug_fix", "cleanup")


def classify(m: DataFrame) -> DataFrame:
    """Adds primary_class and confidence to rows of counts.

    Takes files, moves, renames, inserts, deletes, modifies, patterns, symbols, flow_changes, avg_similarity, avg_delta.
    Four additive scores; the best wins, the earlier of equals; a lead under 0.1 is mixed.
    """
    c = F.col
    total = c("moves") + c("renames") + c("inserts") + c("deletes") + c("modifies")

    def points(*terms: tuple[float, Column]) -> Column:
        out = F.lit(0.0)
        for p, when in terms:
            out = out + F.when(when, F.lit(p)).otherwise(F.lit(0.0))
        return out

    share = lambda x: F.when(total > 0, c(x) / total).otherwise(F.lit(0.0))
    calm = F.abs("avg_delta") <= 2
    score = {
        "refactor": points((0.30, c("renames") > c("inserts")), (0.25, c("avg_similarity") > 0.8), (0.15, calm), (0.15, c("moves") > 0), (0.15, c("patterns") > 0)),
        "feature": points((0.40, share("inserts") > 0.5), (0.15, (share("inserts") <= 0.5) & (c("inserts") > 0)), (0.35, c("symbols") > 0), (0.15, c("inserts") > c("deletes") * 2), (0.10, (c("modifies") > 0) & (c("inserts") > c("modifies")))),
        "bug_fix": points((0.30, share("modifies") >= 0.6), (0.20, (c("files") <= 3) & (total <= 10)), (0.25, c("flow_changes") > 0), (0.15, c("inserts") == 0), (0.10, (c("avg_similarity") > 0.5) & (c("avg_similarity") < 0.8))),
        "cleanup": points((0.30, share("deletes") > 0.5), (0.25, c("avg_similarity") > 0.9), (0.15, c("symbols") == 0), (0.15, c("flow_changes") == 0), (0.15, calm)),
    }
    m = m.withColumn("_s", F.array_sort(F.array(*[F.struct((-F.round(score[k], 6)).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(CLASSES)])))
    best, second = -c("_s")[0]["s"], -c("_s")[1]["s"]
    mixed = (F.round(best - second, 6) < 0.1) & (best > 0)
    return m.withColumn("primary_class", F.when(total == 0, "formatting_only").when(mixed, "mixed").otherwise(c("_s")[0]["k"])).withColumn("confidence", F.round(F.when(total == 0, F.lit(1.0)).when(mixed, best * 0.8).otherwise(best), 6)).drop("_s")


LABELS = (
    ("GUARD_CLAUSE_ADDED", ("guard", "null check", "bounds")),
    ("TYPE_SIGNATURE_CHANGED", ("signature", "param", "return type")),
    ("RESOURCE_CLEANUP_ADDED", ("close", "drop", "cleanup", "free")),
)


def intent_labels(ops: DataFrame, group: str, seq: str, details: str) -> DataFrame:
    """(group, labels): labels whose words occur in lower-cased details, in order of first sight, then of the list above."""
    low = F.lower(F.col(details))
    found = [F.when(_any(low, words), F.struct(F.lit(i).alias("i"), F.lit(name).alias("label"))) for i, (name, words) in enumerate(LABELS)]
    each = ops.select(group, seq, F.explode(F.array(*found)).alias("x")).where("x is not null").groupBy(group, "x.i", "x.label").agg(F.min(seq).alias("first"))
    return each.groupBy(group).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("first", "i", "label"))), lambda x: x["label"])).alias("labels"))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def granularity(events: Column, patterns: Column, moves: Column, changed_files: Column, ops: Column) -> Column:
    return F.when((events > 0) | (patterns > 0) | (moves > 0) | (changed_files > 2) | (ops > 3), "standard").otherwise("micro_compact")
