"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import settled, unused

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words that all targets share, as a multiple of all words; the most a source is repeated.
SHARE, MOST = 1.5, 2.0
#: Words in a block of the schedule.
BLOCK = 256
_GOLDEN = (math.isqrt(5 << 240) - (1 << 120)) / (1 << 121)
#: The fraction of 2**20 golden sections, so that far slots keep their precision.
_GOLDEN_20 = (((math.isqrt(5 << 240) - (1 << 120)) << 19) % (1 << 120)) / (1 << 120)
_BINS = 1024
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(s, source, source_size, target): one row per source; s is its place in code point order, null last.

    The budget is share times all words. A source gets at most most times its words; what it
    can't take is shared again by weight until none is above. Sorted by cap for each unit of
    weight, the full sources are a prefix, which gives the fixed point without iterating.
    The windows run over one row per source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    t = by.withColumn("s", s).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), "s")
    everything = Window.partitionBy()
    t = t.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("full", F.col("cap") <= F.col("w") * F.col("level"))
    open_level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * open_level)).select("s", "source", "source_size", "target")


def _golden_point(k) -> F.Column:
    far, near = F.floor(k / F.lit(1 << 20)), k % (1 << 20)
    x = far * F.lit(_GOLDEN_20) + near * F.lit(_GOLDEN)
    return x - F.floor(x)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = 7):
    """Plans the mix. Returns (documents, pieces).

    Slot k of the schedule belongs to the source whose stretch of the cumulative target
    weights holds the fraction of k golden sections; slots are ranked within their source.
    The documents of a source are laid on a line of words in a shuffled order, over and over,
    and cut into blocks of equal words: slot r of a source takes block r. A source takes the
    whole number of words below its target, the last block in part; the few slots by which
    the schedule misses a source's blocks are appended at its end.

    documents: doc_id, size, source_size, target, taken, and where the schedule has it: first_slot, last_slot (null if nothing is
    taken) and n_blocks, the number of blocks that hold some of it; one row per input row with an id. Rows that repeat an id each
    have a stretch of their own on the line, but for equal ones at one place, which are alike.
    pieces: slot, doc_id, first (word of the document), words.
    Null text has no words, a null source is a source of its own (the last), rows with a null
    id are left out. Runs over the same rows agree. Running sums and ranks are taken within
    hashed or numbered bands, so no task holds a whole source; there are about as many bands as a band has rows, so neither grows
    faster than the root of the table.
    """
    sized = settled(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long").alias("size")))
    t = settled(targets(sized, weights, share, most))
    sources = t.withColumn("take", F.floor("target").cast("long"))
    # documents on the line of their source
    bits = max(12, math.ceil(math.log2(max(sized.count(), 1)) / 2))
    lined = sized.join(sources, sized.source.eqNullSafe(sources.source)).select("doc_id", "s", "size", "source_size", "target", "take", F.xxhash64(F.lit(seed), "doc_id").alias("h")).withColumn("band", F.shiftrightunsigned("h", 64 - bits))
    before = Window.unboundedPreceding, -1
    bands = lined.groupBy("s", "band").agg(F.sum("size").alias("n"))
    bands = bands.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("band").rowsBetween(*before)), F.lit(0))).drop("n")
    lined = lined.withColumn("inner", F.coalesce(F.sum("size").over(Window.partitionBy("s", "band").orderBy("h", "doc_id", "size").rowsBetween(*before)), F.lit(0)))
    lined = settled(lined.join(bands, ["s", "band"]).withColumn("start", F.col("base") + F.col("inner")).drop("h", "band", "base", "inner"))
    # slots of the schedule
    total = t.agg(F.sum("target")).first()[0] or 0.0
    n_slots = int(-(-total // block))
    up_to = F.sum("target").over(Window.orderBy("s"))
    stretch = t.withColumn("hi", up_to / F.lit(total or 1.0)).withColumn("lo", (up_to - F.col("target")) / F.lit(total or 1.0)).where("target > 0")
    stretch = stretch.select("s", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * _BINS), F.least(F.floor(F.col("hi") * _BINS), F.lit(_BINS - 1)))).alias("bin"))
    session, wide = docs.sparkSession, 1 << max(16, math.ceil(math.log2(max(n_slots, 1)) / 2))
    slots = session.range(n_slots).withColumnRenamed("id", "k").withColumn("u", _golden_point(F.col("k"))).withColumn("bin", F.floor(F.col("u") * _BINS))
    slots = slots.join(stretch, "bin").where("lo <= u and u < hi").select("k", "s", F.floor(F.col("k") / wide).alias("kb"))
    kbs = slots.groupBy("s", "kb").agg(F.count("*").alias("n"))
    kbs = kbs.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("kb").rowsBetween(*before)), F.lit(0)))
    ranked = slots.withColumn("i", F.row_number().over(Window.partitionBy("s", "kb").orderBy("k"))).join(kbs.select("s", "kb", "base"), ["s", "kb"]).select("k", "s", (F.col("base") + F.col("i") - 1).alias("r"))
    need = sources.withColumn("need", F.ceil(F.col("take") / F.lit(block)).cast("long")).select("s", "need").where("need > 0")
    have = kbs.groupBy("s").agg(F.sum("n").alias("have"))
    missing = need.join(have, "s", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need").select((F.lit(n_slots) + F.col("s")).alias("k"), "s", F.explode(F.expr("sequence(have, need - 1)")).alias("r"))
    ranked = ranked.unionByName(missing)
    # blocks: the stretches of documents in each block of the repeated line
    passes = lined.where("size > 0 and take > 0").withColumn("turn", F.explode(F.expr("sequence(0, cast(floor((take - 1 - least(start, take - 1)) / source_size) as long))")))
    passes = passes.withColumn("from", F.col("start") + F.col("turn") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("take"))).where("from < to")
    blocks = passes.withColumn("r", F.explode(F.expr(f"sequence(cast(floor(from / {block}) as long), cast(floor((to - 1) / {block}) as long))")))
    first, last = F.greatest(F.col("from"), F.col("r") * block), F.least(F.col("to"), (F.col("r") + 1) * block)
    pieces = blocks.select("s", "r", "doc_id", "start", "size", (first - F.col("from")).alias("first"), (last - first).alias("words")).join(ranked, ["s", "r"])
    taken = pieces.groupBy("s", "start", "doc_id").agg(F.sum("words").alias("got"), F.min("k").alias("first_slot"), F.max("k").alias("last_slot"), F.count_distinct("r").alias("n_blocks"))
    # rows without words share their start with others, and take nothing
    out = lined.join(taken, ["s", "start", "doc_id"], "left").select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("got", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"), *[F.when(F.col("size") > 0, F.col(c)).alias(c) for c in ("first_slot", "last_slot")], F.when(F.col("size") > 0, F.coalesce("n_blocks", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_blocks"))
    return out, pieces.select(F.col("k").alias("slot"), "doc_id", "first", "words")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix in whole documents, with the columns of docs, in the order of the schedule: each as often as the words
    taken of it make copies, rounded, and its copies at its first slot, its last and evenly between. Only the one
    document of a source at which its last round stops is taken in part, so each source's words are within half
    a document of its target; a source that is one document may go wholly or be taken whole.

    Documents without words stay once, at the end: they cost nothing. Rows with a null id or of which
    nothing is taken go. Repeated rows of one id are each taken alike. Columns of docs may have any names.
    """
    mix_id, copies, copy, slot = unused(docs, "mix_id", "copies", "copy", "slot")
    digest, pieces = mixture(docs, id_col, **options)
    digest = digest.groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    slots = pieces.groupBy("doc_id").agg(F.min("slot").alias("first"), F.max("slot").alias("last"))
    whole = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5)).cast("int")
    plan = digest.select("doc_id", whole.alias("copies")).where("copies > 0").join(slots, "doc_id", "left")
    plan = plan.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = F.col("first") + F.floor((F.col("last") - F.col("first")) * F.col("copy") / F.greatest(F.col("copies") - 1, F.lit(1)))
    plan = plan.select(F.col("doc_id").alias(mix_id), F.col("copy").alias(copy), at.alias(slot))
    mixed = docs.join(plan, F.col(f"`{id_col}`") == F.col(mix_id))
    return mixed.orderBy(F.col(slot).asc_nulls_last(), mix_id, copy).select(*[F.col(f"`{c}`") for c in docs.columns])
