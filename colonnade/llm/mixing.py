"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame functions only).

The mix is a sequence of slots of ``block`` words.  Slot n goes to the source
whose share of the interval [0, 1) holds the n-th golden-ratio point
frac(n / phi), so every stretch of the schedule is close to the target weights.
The k-th slot of a source takes the k-th block of that source's documents, which
stand in a shuffled order, end to end, and begin anew when all are used.  A
source that the points give too few slots (its share may hold none of them) gets
the missing ones behind the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.ranks import running_sum
from colonnade.llm.work import cut

#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
#: No source gives more than this many times its own words.
MOST_REPEATS = 3
#: Words of a block at most; small mixes use shorter blocks, for SLOTS_EACH slots a source.
BLOCK_WORDS, SLOTS_EACH = 4096, 1024
#: The golden ratio's conjugate, sqrt(5)/2 - 1/2, in units of 2**-64: points are whole numbers, exact for any slot.
GOLDEN, UNIT = 11400714819323198485, 1 << 64
#: Cells of a running sum, and cells of [0, 1) in the join of points and shares.
CELLS, SHARE_CELLS = 1024, 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source (columns _null, _key): source_size, rank, and target words.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share all
    words.  A target ends at three times the source's words and the excess is
    shared anew by weight.  In closed form: with sources by rising cap over
    weight, the level is the largest of (total - caps before) / (weights from
    here on), and a target is the smaller of the cap and weight times level.
    """
    per = sizes.groupBy("_null", "_key").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("_rank", F.row_number().over(Window.orderBy("_null", "_key")))
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("_rank") - 1) % len(WEIGHTS))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(MOST_REPEATS))
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    return (
        ranked.withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(everything))
        .select(
            "_null", "_key", "source_size", F.col("_rank").alias("source_rank"),
            F.least("_cap", F.col("_w") * F.col("_level")).alias("target"),
        )
    )


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """Slots (source_rank, block, slot): ``block`` counts each source's slots from 0, ``slot`` those of all.

    ``targets`` has source_rank and target.  Every source has the slots that its
    target needs, and most a few more; the last ones of a source stay unused.
    """
    spark = targets.sparkSession
    sums = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count(F.lit(1))).first()
    slots = 0 if not sums[0] else int(1.01 * sums[0] / block) + 8 * sums[1] + 16
    so_far = F.sum("target").over(
        Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    shares = (
        targets.withColumn("_to", so_far / (sums[0] or 1.0))
        .withColumn("_from", F.col("_to") - F.col("target") / (sums[0] or 1.0))
        .filter("target > 0")
        # The last share is open upwards: sums of doubles may end below 1.
        .withColumn("_last", F.col("source_rank") == F.max("source_rank").over(Window.partitionBy()))
        .select("source_rank", "_from", F.when(F.col("_last"), 1.5).otherwise(F.col("_to")).alias("_to"))
        .withColumn("_from", F.when(F.col("_from") < 1e-12, 0.0).otherwise(F.col("_from")))
    )
    # Each share's end is the next one's beginning, exactly.
    ordered = Window.orderBy("source_rank")
    shares = shares.withColumn("_from", F.coalesce(F.lag("_to").over(ordered), F.lit(0.0)))
    last_cell = SHARE_CELLS - 1
    cell = lambda c: F.least(F.floor(F.col(c) * SHARE_CELLS), F.lit(last_cell)).cast("int")
    shares = shares.withColumn("_cell", F.explode(F.sequence(cell("_from"), cell("_to"))))
    turned = f"(cast(id as decimal(17,0)) * {GOLDEN}BD + {UNIT // 2}BD) % {UNIT}BD"
    points = spark.range(slots).select("id", (F.expr(turned).cast("double") / float(UNIT)).alias("_at"))
    points = points.withColumn("_cell", cell("_at"))
    taken = points.join(shares, "_cell").filter("_at >= _from and _at < _to")
    taken = taken.select(
        "source_rank", "id", F.lit(1).cast("long").alias("_one"),
        F.expr(f"id * {CELLS} div {max(slots, 1)}").alias("_part"),
    )
    dealt = running_sum(taken, ["source_rank"], ["_part"], ["id"], "_one", "block").select(
        "source_rank", "block", F.col("id").alias("slot")
    )
    held = taken.groupBy("source_rank").agg(F.count(F.lit(1)).alias("_have"))
    short = targets.join(held, "source_rank", "left")
    have = F.coalesce("_have", F.lit(0)).cast("long")
    need = F.expr(f"(cast(floor(target) as long) + {block - 1}) div {block}")
    missing = short.filter(have < need).select("source_rank", F.explode(F.sequence(have, need - 1)).alias("block"))
    # Behind all points, source by source in turn.
    behind = F.lit(slots) + F.col("block") * sums[1] + F.col("source_rank") - 1
    return dealt.union(missing.select("*", behind.cast("long").alias("slot")))


def mix_sources(docs: DataFrame, seed: int = 0) -> DataFrame:
    """How many words the mix takes of every document.

    Returns a row for each row: doc_id, size, source_size, target, taken, source,
    first_slot (the first slot of the schedule that takes words of it, null if
    none does), n_slots (how many do), text_hash.
    Null texts have size 0 and are taken 0 times; null sources are a source;
    sources without words have target 0; repeated rows are documents of their
    own; an empty table gives an empty result.  Other columns are ignored.
    """
    narrow = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNull().alias("_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_key"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("text_hash"),
    )
    sizes = cut(narrow, "mix-sizes")  # the texts are read once
    targets = cut(source_targets(sizes), "mix-targets")
    whole = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count(F.lit(1))).first()
    block = int(max(1, min(BLOCK_WORDS, whole[0] // (SLOTS_EACH * max(1, whole[1])))))
    slots = schedule(targets, block)

    by_source = sizes.join(targets, ["_null", "_key"])
    by_source = by_source.withColumn("_mix", F.xxhash64("doc_id", "text_hash", F.lit(seed)))
    by_source = by_source.withColumn("_part", F.pmod("_mix", F.lit(CELLS)))
    placed = running_sum(
        by_source, ["source_rank"], ["_part"], ["_mix", "doc_id", "_row"], "size", "_at"
    )
    words = F.floor("target").cast("long")
    passes = placed.withColumn("_words", words).withColumn(
        "_from",
        F.explode_outer(
            F.filter(
                F.transform(
                    F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)),
                    lambda k: k.cast("long") * F.col("source_size") + F.col("_at"),
                ),
                lambda a: (a < F.col("_words")) & (F.col("size") > 0),
            )
        ),
    )
    pieces = passes.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("_words")))
    pieces = pieces.withColumn(
        "block",
        F.explode_outer(F.expr(f"sequence(_from div {block}, (_to - 1) div {block})")),
    )
    overlap = F.least("_to", (F.col("block") + 1) * block) - F.greatest(
        F.col("_from"), F.col("block") * block
    )
    used = pieces.join(slots, ["source_rank", "block"], "left")
    keys = ["_row", "doc_id", "size", "source_size", "target", "_null", "_key", "text_hash"]
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), overlap)), F.lit(0)).alias("taken")
    return (
        used.groupBy(*keys)
        .agg(taken, F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots"))
        .select(
            "doc_id", "size", "source_size", "target", "taken",
            F.when(~F.col("_null"), F.col("_key")).alias("source"), "first_slot", "n_slots", "text_hash",
        )
    )
