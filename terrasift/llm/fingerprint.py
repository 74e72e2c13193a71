"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import discard, scratch, settled, stored

#: Cells in each of the three parts of a block; a digest has one cell in each part.
PART = 8
_PARTS = 3
#: Rows of a range of ids, and the most ranges.
RANGE_ROWS, MOST_RANGES = 256, 1 << 16
#: By how often a block is halved at the most: after that its digests differ in no bit that deals them out.
_MOST_LEVEL = 60
_LONG = "bigint"


def digests(text: Column) -> Column:
    """The distinct 60-bit digests of the paragraphs (lines that aren't empty) of a text, as an array."""
    lines = F.filter(F.split(text, "\n"), lambda line: line != "")
    return F.array_distinct(F.transform(lines, lambda line: F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast(_LONG)))


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(key: Column, level: Column) -> Column:
    """60 bits that follow from a digest and the level: 9 for each of its three cells, and all of them to check it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", level.cast("string"), key.cast("string"))), 1, 15), 16, 10).cast(_LONG)


def _mask(places: Column) -> Column:
    """A bit for each cell of a digest."""
    bits = [F.call_function("shiftleft", F.lit(1), (F.shiftright(places, 9 * j).bitwiseAND(PART - 1) + j * PART).cast("int")) for j in range(_PARTS)]
    return bits[0] + bits[1] + bits[2]


def _in_cell(mask: Column, i: Column) -> Column:
    return F.getbit(mask, i) == 1


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.cast(_LONG).alias("n"), key.cast(_LONG).alias("k"), check.cast(_LONG).alias("c"))


def sketch(keys: Column, level: Column) -> Column:
    """The cells of a set of digests: each has the number of its digests and their keys and checks, combined by exclusive or."""
    placed = F.transform(keys, lambda k: _let(_places(k, level), lambda c: F.struct(k.alias("k"), c.alias("c"), _mask(c).alias("m"))))
    empty = _cell(F.lit(0), F.lit(0), F.lit(0))
    add = lambda a, x: _cell(a["n"] + 1, a["k"].bitwiseXOR(x["k"]), a["c"].bitwiseXOR(x["c"]))
    cells = lambda p: F.transform(F.sequence(F.lit(0), F.lit(_PARTS * PART - 1)), lambda i: F.aggregate(F.filter(p, lambda x: _in_cell(x["m"], i)), empty, add))
    return _let(placed, cells)


def fingerprint(keys: Column) -> Column:
    """The sketch of level 0 as text: for each cell that isn't empty its place, key, check and number in hexadecimal digits."""
    wide = lambda x, n: F.lower(F.lpad(F.hex(x), n, "0"))
    text = lambda c, i: F.concat(wide(i, 2), wide(c["k"], 15), wide(F.shiftright(c["c"], 28), 8), F.lower(F.hex(c["n"])))
    return F.array_join(F.transform(sketch(keys, F.lit(0)), lambda c, i: F.when(c["n"] > 0, text(c, i))), ",")


def subtract(a: Column, b: Column) -> Column:
    """Cells of what only one of two sketches of one level holds."""
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def peel(cells: Column, level: Column) -> Column:
    """Struct of done, more and less: whether all cells were emptied, and how many digests only the first or only the second set had.

    A cell that holds a single digest, which its check tells, gives it away; taken from its three
    cells, it may leave others with a single one. Each round takes all of those at once.
    """
    single = lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _places(c["k"], level))
    take = lambda c, x: _cell(c["n"] - x["n"], c["k"].bitwiseXOR(x["k"]), c["c"].bitwiseXOR(x["c"]))

    def after(state: Column, found: Column) -> Column:
        left = F.transform(state["cells"], lambda c, i: F.aggregate(F.filter(found, lambda x: _in_cell(x["m"], i)), c, take))
        plus = F.size(F.filter(found, lambda x: x["n"] > 0))
        return F.struct(left.alias("cells"), (state["more"] + plus).alias("more"), (state["less"] + F.size(found) - plus).alias("less"), (F.size(found) > 0).alias("on"))

    def step(state: Column, _: Column) -> Column:
        found = F.transform(F.array_distinct(F.filter(state["cells"], single)), lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"), c["c"].alias("c"), _mask(c["c"]).alias("m")))
        return F.when(state["on"], _let(found, lambda f: after(state, f))).otherwise(state)

    start = F.struct(cells.alias("cells"), F.lit(0).alias("more"), F.lit(0).alias("less"), F.lit(True).alias("on"))
    clear = lambda s: F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0))
    end = lambda s: F.struct(clear(s).alias("done"), s["more"].cast(_LONG).alias("more"), s["less"].cast(_LONG).alias("less"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_PARTS * PART)), start, step, end)


def differences(pairs: DataFrame, name: str = "sketches") -> DataFrame:
    """row, side, more, less: how many digests only a or only b has, for each row of pairs (row, side, a, b: arrays of digests).

    Both sets are sketched, one sketch is taken from the other, and the rest is peeled. Where that
    fails, the sketches are made again at twice the size: a sketch of level r has 2**r blocks
    of cells, and a digest's block follows from its last r bits, so blocks that were already
    emptied stay so and only the others are halved. No array is longer than a set of a pair,
    and pairs that fail get fewer with each round; a table of them is written for each.
    """
    spark, sums, used = pairs.sparkSession, [], []
    # few bytes, much work: dealt to a number of tasks of its own, not to as few as the bytes would take
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo = pairs.withColumn("level", F.lit(0))
    while True:
        level, todo = F.col("level"), todo.repartition(tasks, "row", "side")
        rest = subtract(sketch(F.col("a"), level), sketch(F.col("b"), level))
        used.append(scratch(spark, name))
        tried = stored(todo.withColumn("p", peel(rest, level)).select("row", "side", "level", "p", F.when(~F.col("p.done"), F.col("a")).alias("a"), F.when(~F.col("p.done"), F.col("b")).alias("b")), used[-1])
        sums.append(tried.where("p.done").select("row", "side", "p.more", "p.less"))
        failed = tried.where("not p.done")
        if failed.isEmpty():
            break
        own = lambda k: F.call_function("shiftright", k, level).bitwiseAND(1) == F.col("half")
        halves = failed.select("row", "side", "level", "a", "b", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
        todo = halves.select("row", "side", (level + 1).alias("level"), F.filter("a", own).alias("a"), F.filter("b", own).alias("b"))
        if len(sums) > _MOST_LEVEL:
            raise RuntimeError("sketches that hold next to nothing can't be peeled")
    out = settled(reduce(DataFrame.unionByName, sums).groupBy("row", "side").agg(F.sum("more").alias("more"), F.sum("less").alias("less")))
    for path in used:
        discard(spark, path)
    return out


def likeness(pairs: DataFrame) -> DataFrame:
    """row, side, near: the digests that both sets of a pair hold among those that either holds (1 if both are empty).

    Found from the sizes of the sets and from what peeling their sketches recovers.
    """
    sizes = pairs.select("row", "side", F.size("a").alias("n"))
    both = sizes.join(differences(pairs), ["row", "side"])
    either = F.col("n") + F.col("less")
    return both.select("row", "side", F.when(either == 0, 1.0).otherwise((F.col("n") - F.col("more")) / either).alias("near"))


def _bounds(rows: DataFrame) -> list[int]:
    """Ids that part the rows into ranges of about RANGE_ROWS rows, MOST_RANGES at the most; the last is the largest id."""
    n = rows.count()
    if not n:
        return []
    k = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    at = ", ".join(f"{i / k}D" for i in range(1, k + 1))
    found, last = rows.agg(F.expr(f"percentile_approx(doc_id, array({at}), {max(10000, 4 * k)})"), F.max("doc_id")).first()
    return sorted({*found, last})


def with_next(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with next_text: the text of the row that follows in descending order of ids, for the last that of the first.

    Rows of one id follow one another by text. Ranges of ids are ordered each on its own; the rows
    of each range's largest id go to the range above too, as what follows its last row, so texts are
    shuffled once.
    """
    bounds = _bounds(rows)
    if not bounds:
        return rows.withColumn("next_text", F.col("text"))
    parts = [bounds[i : i + 256] for i in range(0, len(bounds), 256)]
    array = lambda values: f"array({', '.join(f'{v}L' if v > -(1 << 63) else 'bigint(-9223372036854775808)' for v in values)})"
    placed = rows.withColumn("part", F.expr(f"size(filter({array([p[-1] for p in parts])}, b -> b < doc_id))"))
    placed = placed.withColumn("own", F.expr(f"element_at(array({', '.join(map(array, parts))}), part + 1)"))
    placed = placed.withColumn("at", F.expr("size(filter(own, b -> b < doc_id))"))
    placed = placed.select("doc_id", "text", (F.col("part") * 256 + F.col("at")).alias("range"), (F.expr("element_at(own, at + 1)") == F.col("doc_id")).alias("top"))
    home = lambda r, guest: F.struct(r.alias("range"), F.lit(guest).alias("guest"))
    here, above = home(F.col("range"), False), home((F.col("range") + 1) % len(bounds), True)
    placed = placed.select("doc_id", "text", F.inline(F.when(F.col("top"), F.array(here, above)).otherwise(F.array(here))))
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc(), "text")
    return placed.select("doc_id", "text", "guest", F.lead("text").over(order).alias("next_text")).where("not guest").drop("guest")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row with an id.

    The edited text has the text's last half (of its code points, rounded down) replaced by as many
    of the first of the next row's text, in descending order of ids, after the last the first.
    Paragraphs are lines that aren't empty. A fingerprint is the sketch of the distinct paragraphs of
    a text, so texts with the same paragraphs have equal ones; near_edited and near_next are the
    shares of paragraphs in common that subtracting and peeling sketches gives (1: all, or none
    on either side). Null text counts as empty. A row that is alone is its own next. Rows that
    share an id follow one another by text; empty tables give none; other columns aren't
    looked at, so they may have any names.
    """
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    known = with_next(rows).select("doc_id", "text", "next_text", edited.alias("edited"))
    known = known.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("new"), digests(F.col("next_text")).alias("next"),
    )
    known = stored(known, scratch(docs.sparkSession, "fingerprints"))
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col("own").alias("a"), F.col(name).alias("b"))
    near = likeness(known.select("row", F.inline(F.array(side("new"), side("next")))))
    near = near.groupBy("row").agg(*[F.max(F.when(F.col("side") == s, F.col("near"))).alias(f"near_{name}") for s, name in (("new", "edited"), ("next", "next"))])
    return known.join(near, "row").select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("new")).alias("edited_fingerprint"), "near_edited", "near_next")
