"""Mixing sources to target weights, in DataFrame functions only.

Each source gets a share of all words by its weight, held to a multiple of its own size, the excess reshared by weight
(water filling). A source takes as many complete passes over its documents as fit its target, then a fraction of one more:
documents come in Efraimidis-Spirakis order (ascending -ln(u) / quality weight with a reproducible u) and are taken until the
running sum of words meets the remaining budget; of the last one only the words that fit are counted. As texts stay whole, mixed()
takes that one whole or not at all, whichever is nearer to the target.

The order needs no sort of a whole source: the key maps monotonically onto a grid of 2**24 cells, words are summed by cell
prefix (two levels of 4096), and only the cell on the boundary is put in order. So a source that holds a third of all rows
spreads like any other.

Edge cases: a null text has no words and none are taken from it; null sources form one source, last in order; rows with the same id
are told apart by their text's digest, identical rows share one key and are taken in any order, which is the same result; an
empty table gives an empty result; the targets of an all-blank corpus are zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_dimension, let, materialize, words

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
SEED = 17
_LEVEL = 4096


def quality_weight(text: Column) -> Column:
    """Between 0.5 and 1: one half plus half the share of ASCII letters, digits and blanks among the text's code points."""
    n = F.length(text)
    plain = F.length(F.regexp_replace(text, r"[^A-Za-z0-9 ]+", ""))
    return F.when(n > 0, 0.5 + 0.5 * plain / n).otherwise(F.lit(0.5))


def uniform(identity: Column, seed: int) -> Column:
    """In (0, 1), from the first 13 hex digits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), identity)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def sizes(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """__key, __source, size, __digest, __cell, __order: what the mix needs of each row, without its text."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = let(df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{source}`").alias("__source"), t.alias("__text")), F.md5(F.col("__text")).alias("__digest"))
    identity = F.concat_ws(":", F.coalesce(F.col("__key").cast("string"), F.lit("null")), F.col("__digest"))
    df = let(df, F.size(words(F.col("__text"))).cast("bigint").alias("size"), uniform(identity, SEED).alias("__u"), quality_weight(F.col("__text")).alias("__w"))
    # exp(-key) = u ** (1 / w): uniform for w = 1, so the cells fill evenly within a factor of two
    cell = F.floor((1 - F.pow("__u", 1 / F.col("__w"))) * float(_LEVEL * _LEVEL))
    cell = F.when(cell < 0, 0).when(cell >= _LEVEL * _LEVEL, _LEVEL * _LEVEL - 1).otherwise(cell)
    return df.select("__key", "__source", "size", "__digest", cell.cast("bigint").alias("__cell"), (-F.log("__u") / F.col("__w")).alias("__order"))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: float = MAX_PASSES) -> DataFrame:
    """__source, source_size, target. by_source: a small table of one row for each source.

    The level x solves sum(min(x * weight, max_passes * size)) = sum(size); it is raised until no more sources stop.
    """
    position = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(position, F.lit(len(weights))) + 1)
    src = by_source.select("__source", "source_size", weight.alias("__weight"), (F.col("source_size") * float(max_passes)).alias("__cap"))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    full, level = -1, 0.0
    while True:
        stop = F.col("__cap") <= level * F.col("__weight")
        r = src.agg(F.sum(stop.cast("int")).alias("n"), F.sum(F.when(stop, F.col("__cap")).otherwise(0.0)).alias("used"), F.sum(F.when(stop, 0.0).otherwise(F.col("__weight"))).alias("left")).first()
        if r.n is None or r.n == full or not r.left:
            break
        full, level = r.n, (total - r.used) / r.left
    # the comparison with the cap stays a null-safe minimum: both sides are never null
    return src.select("__source", "source_size", F.least(F.col("__cap"), level * F.col("__weight")).alias("target"))


def plan(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """__key, __source, __digest, size, source_size, target, taken: one row for each row of df."""
    base = materialize(sizes(df, key, text, source), "mix-sizes")
    by_source = materialize(base.groupBy("__source").agg(F.sum("size").alias("source_size")), "mix-sources")
    goal = materialize(targets(by_source, weights), "mix-targets")
    n = goal.count()
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("__passes", passes.cast("bigint")).withColumn("__budget", F.floor(F.col("target") + 0.5).cast("bigint") - F.col("__passes") * F.col("source_size"))
    grid = base.groupBy("__source", F.shiftright("__cell", 12).alias("__hi")).agg(F.sum("size").alias("__words"))
    first = materialize(_boundary(join_dimension(grid, goal.select("__source", "__budget"), ["__source"], n), "__hi", ["__source"]), "mix-level1")
    goal = join_dimension(goal, first, ["__source"], n)
    within = join_dimension(base, first.select("__source", "__hi", F.col("__left").alias("__left1")), ["__source"], n).filter(F.shiftright("__cell", 12) == F.col("__hi"))
    fine = within.groupBy("__source", (F.col("__cell") % _LEVEL).alias("__lo")).agg(F.sum("size").alias("__words"), F.first("__left1").alias("__budget"))
    second = materialize(_boundary(fine, "__lo", ["__source"]).withColumnRenamed("__left", "__left2"), "mix-level2")
    goal = join_dimension(goal, second, ["__source"], n)
    rows = join_dimension(base, goal, ["__source"], n)
    edge = F.col("__hi") * _LEVEL + F.col("__lo")
    # a cell of the grid holds a 2**24th of a source, so this window sees a few rows
    ordered = Window.partitionBy("__source").orderBy("__order", "__key", "__digest").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = rows.filter(F.col("__cell") == edge).withColumn("__before", F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("__left2") - F.col("__before")))
    others = rows.filter(~F.coalesce(F.col("__cell") == edge, F.lit(False))).withColumn("__part", F.when(F.col("__cell") < edge, F.col("size")).otherwise(0))
    done = others.unionByName(at_edge.withColumn("__part", part).drop("__before"))
    taken = F.col("__passes") * F.col("size") + F.col("__part")
    return done.select("__key", "__source", "__digest", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def _boundary(grid: DataFrame, cell: str, keys: list[str]) -> DataFrame:
    """The cell of each source in which the budget ends, and what is left of the budget there. grid: at most 4096 rows a source."""
    run = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("__before", F.coalesce(F.sum("__words").over(run), F.lit(0)))
    at = grid.filter(F.col("__before") <= F.col("__budget"))
    return at.groupBy(*keys).agg(F.max(cell).alias(cell), F.max_by(F.col("__budget") - F.col("__before"), F.col(cell)).alias("__left"))


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of df as often as the mix takes them, with the columns of df. Texts are whole: of a fractional copy half its words or more make one, fewer none."""
    names = {c: f"__col{i}" for i, c in enumerate(df.columns)}
    safe = df.select(*[df[f"`{c}`"].alias(a) for c, a in names.items()])
    decided = plan(safe, names[key], names[text], names[source], weights).filter("taken > 0").groupBy("__key", "__source", "__digest").agg(F.max("size").alias("__size"), F.collect_list("taken").alias("__taken"))
    t = F.coalesce(F.col(names[text]), F.lit(""))
    on = F.col(names[key]).eqNullSafe(F.col("__key")) & F.col(names[source]).eqNullSafe(F.col("__source")) & (F.md5(t) == F.col("__digest"))
    rank = F.row_number().over(Window.partitionBy("__key", "__source", "__digest").orderBy(F.lit(0)))
    # rows that equal each other in key, source and text get one of the group's decisions each
    rows = safe.join(decided, on, "inner").withColumn("__rank", F.when(F.size("__taken") > 1, F.lit(None)).otherwise(F.lit(1)))
    single = rows.filter("__rank = 1").drop("__rank")
    several = rows.filter("__rank is null").drop("__rank").withColumn("__rank", rank)
    several = several.withColumn("__taken", F.when(F.col("__rank") <= F.size("__taken"), F.array(F.get("__taken", F.col("__rank") - 1))).otherwise(F.array().cast("array<bigint>"))).filter("size(__taken) > 0").drop("__rank")
    out = single.unionByName(several).withColumn("__words", F.get("__taken", F.lit(0)))
    whole = F.floor(F.col("__words") / F.col("__size")).cast("int")
    rest = F.col("__words") - whole * F.col("__size")
    out = out.withColumn("__copy", F.explode(F.array_repeat(F.col(names[text]), whole + (2 * rest >= F.col("__size")).cast("int"))))
    return out.select(*[F.col("__copy" if c == text else a).alias(c) for c, a in names.items()])
