"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions alone."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from correspond.llm.common import SPACES, materialise, sent_if_small, table
from correspond.operators.series import running_total

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Copies that one range of virtual time holds, on average, with 8 ranges at least.
ROWS_A_RANGE = 50_000


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACES, -1), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, epochs: int = 2, weights=WEIGHTS) -> DataFrame:
    """sizes(source, source_size), a row a source -> the same with sid, target.

    Level L such that the sum of min(epochs * size, L * weight) is the budget, which
    resharing the excess by weight comes to: with sources in the order in which they
    reach their limit, L follows from running sums. One task orders the sources'
    totals, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1).cast("int")
    ranked = sizes.select("source", "source_size", turn.alias("sid"), F.get(F.array(*map(F.lit, weights)), F.pmod(turn, F.lit(len(weights)))).cast("double").alias("weight"))
    limit = F.lit(float(epochs)) * F.col("source_size")
    order = Window.orderBy("ratio", "sid")
    everything, rest = Window.partitionBy(F.lit(0)), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight")).select(
        "*", ((F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))) / F.sum("weight").over(rest)).alias("level")
    )
    chosen = level.select("*", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(everything).getField("level").alias("final"))
    return chosen.select("source", "source_size", "sid", F.coalesce(F.least(F.col("limit"), F.col("final") * F.col("weight")), F.col("limit")).alias("target"))


def mix(docs: DataFrame, keep: list[str], share: float = 1.5, epochs: int = 2, weights=WEIGHTS, seed: int = 7) -> DataFrame:
    """docs(doc_id, text, source, ...) -> columns `keep` and size, source_size, target, taken, a row for each row of docs.

    Each source is shuffled by a hash of doc_id and text and read up to `epochs` times; a copy
    of a document finishes at virtual time (the source's words up to its end, earlier
    rounds included) / target. Copies are put in ranges of that time, the ranges that
    fit the budget are taken whole, and the range at the limit is sorted and cut. In
    each source and round that takes all up to one hash, by which rows are chosen: texts
    are never shuffled. `taken` is the words of the copies taken.

    A hot source, and rows that share an id or have none, are spread over ranges of
    the hash with running totals, so no task holds a source; rows that are equal in id
    and text are taken alike. Null text has size 0 and takes nothing; texts of any
    length are counted whole; null source is a source; an empty table gives none; input
    columns of the result's names are replaced.
    """
    names = {"size", "source_size", "target", "taken"}
    keep = [c for c in keep if c not in names]
    sized = docs.select(*dict.fromkeys([*keep, "source"]), word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_r"))
    light = "text" not in keep  # then the rows themselves are written once and read again
    small = materialise(sized if light else sized.select("source", "size", "_r"), "sizes")
    sums = small.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sums = materialise(sums, "sums")
    n, whole = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    ranges = max(1, -(-n // ROWS_A_RANGE)) * 8
    targets = materialise(source_targets(sums.select("source", "source_size"), share, epochs, weights), "targets").withColumnsRenamed({"source": "_source", "sid": "_sid"})
    of_source = F.col("source").eqNullSafe(F.col("_source"))
    placed = running_total(small.select("source", "size", "_r"), ["source"], "size", "_end", "_r", "size").where("size > 0")
    copies = placed.join(sent_if_small(targets), of_source).where("target > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    copies = copies.withColumn("time", (F.col("epoch") * F.col("source_size") + F.col("_end")) / F.col("target"))
    # At time 1 every source has its target, so nearly all of the budget is used up; what finishes after time 2 is one range.
    copies = materialise(copies.select("time", F.least(F.floor(F.col("time") * ranges), F.lit(2 * ranges)).alias("range"), F.col("_sid").alias("sid"), F.col("_r").alias("r"), "epoch", "size"), "copies")
    budget = int(share * whole)
    upto = copies.groupBy("range").agg(F.sum("size").alias("in_range")).select("range", "in_range", F.sum("in_range").over(Window.orderBy("range")).alias("upto"))
    limit = upto.where(F.col("upto") > budget).orderBy("range").select("range", F.col("upto") - F.col("in_range")).first()
    taken = copies
    if limit is not None:
        key, row = ("time", "sid", "r"), Window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        at_limit = copies.where(F.col("range") == limit[0]).select(F.struct(*key).alias("key"), (F.sum("size").over(row.orderBy(*key, "size")) + limit[1]).alias("upto"))
        last = at_limit.where(F.col("upto") <= budget).agg(F.max("key")).first()[0]
        taken = copies.where(F.col("range") < limit[0])
        if last is not None:
            taken = taken.unionByName(copies.where((F.col("range") == limit[0]) & (F.struct(*key) <= F.struct(F.lit(last.time).alias("time"), F.lit(last.sid).alias("sid"), F.lit(last.r).alias("r")))))
    cuts = taken.groupBy("sid").agg(*(F.max(F.when(F.col("epoch") == e, F.col("r"))).alias(f"_cut{e}") for e in range(epochs)))
    chosen = targets.join(cuts, F.col("_sid") == F.col("sid"), "left").drop("sid")
    out = (small if light else sized).join(sent_if_small(materialise(chosen, "chosen")), of_source)
    words = sum((F.when(F.col("_r") <= F.col(f"_cut{e}"), F.col("size")).otherwise(F.lit(0)) for e in range(epochs)), F.lit(0))
    return out.select(*keep, "size", "source_size", "target", words.cast("long").alias("taken"))


def op7_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), ["doc_id"])
