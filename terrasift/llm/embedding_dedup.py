"""Embedding near-dedup by spherical-cap filters.

1. Each distinct vector is decoded to all filters that it passes, by two product codes with rotations of their own.
2. Filters are joined on ids and sketches: the parts of a vector, a byte each. A sketch tells the distance of two vectors but for
   a known small error, so vectors of one filter are connected only if they reach the wanted cosine or nearly so, and
   a candidate group is little more than what links connect. A dense topic without links makes no group.
3. Vectors go once to their group (a large one to pairs of blocks), where all pairs are verified in double precision.

A filter with many vectors is dealt to blocks. There, leaders stand for all within a radius of them; only the leaders
of different blocks meet, with both radii added to the distance wanted, so near copies of one vector cost
their number, not its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import block_pairs, connected_components, roots, settled, whole_groups

COSINE = 0.95
#: Share of pairs at exactly the cosine that share a filter of one code; codes, each with a rotation of its own; blocks of a product code.
RECALL, CODES, BLOCKS = 0.93, 2, 2
#: Rows of a filter, and of a candidate group, that one block takes, whatever the table.
FILTER_ROWS, GROUP_ROWS = 4096, 4096
#: So many numbers of blocks, of some tens of bytes each, are broadcast.
BROADCAST_KEYS = 100_000
#: Leaders of a block stand for sketches within this distance of them.
RADIUS = 0.1
_STRIP = 512


def _directions(rng: np.random.Generator, words: int, dim: int) -> np.ndarray:
    """Unit codewords: random orthonormal bases and their opposites, which cover all directions evenly."""
    bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-words // (2 * dim)))]
    return np.concatenate([x for b in bases for x in (b, -b)])[:words]


class CapCode:
    """A product code of random directions.

    Vectors are turned by a random rotation and cut into blocks; each block has its own random
    unit codewords. A filter is one codeword per block, and a vector passes all filters for which
    the sum of its block products is at least the threshold. There are about as many filters as
    vectors, so buckets keep their size as tables grow. The threshold is the quantile of the best
    filter that simulated pairs at exactly the wanted cosine have in common, so it follows the
    number of filters and the recall does not fall with the size of the table.
    """

    def __init__(self, dim: int, rows: int, cosine: float = COSINE, recall: float = RECALL, blocks: int = BLOCKS, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        blocks = min(blocks, dim)
        self.words = max(8, math.ceil(max(rows, 1) ** (1 / blocks)))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.array_split(np.arange(dim), blocks)
        self.codes = [_directions(rng, self.words, len(cut)) for cut in self.cuts]
        best = [self._best_common(rng, dim, min(cosine, 1.0)) for _ in range(600)]
        self.threshold = float(np.quantile(best, 1 - recall))

    def _best_common(self, rng: np.random.Generator, dim: int, cosine: float) -> float:
        """The highest threshold at which a random pair of that cosine shares a filter, by the 48 best codewords of each block."""
        x, y = rng.standard_normal((2, dim))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y = cosine * x + math.sqrt(1 - cosine**2) * y / max(np.linalg.norm(y), 1e-12)
        sums = np.zeros((2, 1))
        for cut, code in zip(self.cuts, self.codes, strict=True):
            s = np.stack([x[cut], y[cut]]) @ code.T
            s = s[:, np.argsort(-s.sum(axis=0))[:48]]
            sums = (sums[:, :, None] + s[:, None, :]).reshape(2, -1)
        return float(sums.min(axis=0).max())

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that rows pass, found block by block: what can't reach the
        threshold with the best of the later blocks is dropped."""
        turned = unit @ self.rotation.T
        scores = [turned[:, cut] @ code.T for cut, code in zip(self.cuts, self.codes, strict=True)]
        rest = np.cumsum([s.max(axis=1) for s in scores[::-1]], axis=0)[::-1]
        row, key, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for b, s in enumerate(scores):
            sums = total[:, None] + s[row]
            later = rest[b + 1][row] if b + 1 < len(scores) else 0.0
            i, w = np.nonzero(sums >= (self.threshold - later)[:, None] if b + 1 < len(scores) else sums >= self.threshold)
            row, key, total = row[i], key[i] * self.words + w, sums[i, w]
        # beyond that many filters some are one bucket, which only makes buckets larger
        return row, key % (2**31 - 1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest part first, so that no square runs over."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _sketch(turned: np.ndarray) -> np.ndarray:
    """Each row as signed bytes after their unit, a 4-byte float. Turned rows have no large part, so units and errors are small."""
    unit = (np.abs(turned).max(axis=1) / 127 + 1e-12).astype("<f4")
    values = np.rint(turned / unit[:, None].astype(float)).clip(-127, 127).astype(np.int8)
    return np.hstack([unit[:, None].view(np.uint8), values.view(np.uint8)])


def _unsketch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sketches as a matrix, and by how much each row may be off in distance."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    unit = np.ascontiguousarray(raw[:, :4]).view("<f4").astype(np.float64)
    x = raw[:, 4:].view(np.int8) * unit
    return x, unit[:, 0] * (0.5 * math.sqrt(x.shape[1])) + 1e-9


@lru_cache(maxsize=8)
def _codes(dim: int, rows: int, cosine: float, recall: float) -> tuple[CapCode, ...]:
    """The codes for vectors of a length, made once in each worker: they follow from these numbers alone."""
    return tuple(CapCode(dim, rows, cosine, recall, seed=11 + i) for i in range(CODES))


def _filter_rows(batches: Iterator[pa.RecordBatch], cosine: float, recall: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims, rows = batch["dim"].to_numpy(), batch["rows"].to_numpy()
        for dim in np.unique(dims).tolist():
            own = batch.filter(pa.array(dims == dim))
            codes = _codes(dim, int(rows[dims == dim][0]), cosine, recall)
            step = max(1, min(128, (1 << 23) // codes[0].words ** 2))
            for lo in range(0, own.num_rows, step):
                part = own.slice(lo, step)
                unit = _unit(_matrix(part["v"], dim))
                passed = [(row, (key * len(codes) + i) % (2**31 - 1)) for i, code in enumerate(codes) for row, key in [code.decode(unit)]]
                pairs = np.unique(np.concatenate([row << 31 | key for row, key in passed]))
                bounds = np.searchsorted(pairs >> 31, np.arange(part.num_rows + 1)).astype(np.int32)
                filters = pa.array((pairs & (2**31 - 1)).astype(np.int32))
                sketch = pa.array([r.tobytes() for r in _sketch(unit @ codes[0].rotation.T)], pa.binary())
                yield pa.RecordBatch.from_arrays([part["id"], part["dim"], sketch, pa.ListArray.from_arrays(pa.array(bounds), filters)], ["id", "dim", "q", "filters"])


def _groups(table: pa.Table, keys: list[str]) -> Iterator[tuple[int, int]]:
    """The stretches of rows with equal keys."""
    new = np.zeros(table.num_rows + 1, bool)
    new[[0, -1]] = True
    for k in keys:
        c = table[k].to_numpy()
        new[1:-1] |= c[1:] != c[:-1]
    edges = np.flatnonzero(new)
    yield from zip(edges[:-1], edges[1:], strict=True)


def _leaders(x: np.ndarray, off: np.ndarray, radius: float) -> np.ndarray:
    """Indices of rows so that each row is within the radius of one of them; of rows near a leader, none leads."""
    found, left = [], np.arange(len(x))
    while len(left):
        i = left[0]
        found.append(i)
        d = np.sqrt(((x[left] - x[i]) ** 2).sum(1)) + off[left] + off[i]
        left = left[(d > radius) & (left != i)]
    return np.array(found)


def _near(table: pa.Table, keys: list[str], reach: float, radius: float | None) -> Iterator[pa.RecordBatch]:
    """(id, root, dim, f, q): a connection of each row to the smallest index of those that it is near to in any filter of the table;
    with a radius, also the leaders of the blocks of filters with several, which have their dim, f and q."""
    table = table.combine_chunks()
    ids, dim, f = (table[c].to_numpy() for c in ("id", "dim", "f"))
    sketches = table["q"].combine_chunks() if isinstance(table["q"], pa.ChunkedArray) else table["q"]
    blocks = table["blocks"].to_numpy()
    known, at = np.unique(ids, return_inverse=True)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    lead: list[np.ndarray] = []
    for s, e in _groups(table, keys):
        if e - s < 2 and blocks[s] < 2:
            continue
        y, o = _unsketch(sketches.slice(s, e - s))
        norm = (y * y).sum(1)
        for lo in range(0, e - s, _STRIP):
            z = slice(lo, lo + _STRIP)
            d2 = norm[z, None] + norm[None, lo:] - 2 * (y[z] @ y[lo:].T)
            a, b = np.nonzero(d2 <= (reach + o[z, None] + o[None, lo:]) ** 2)
            up = a < b
            found.append((at[a[up] + s + lo], at[b[up] + s + lo]))
        if radius is not None and blocks[s] > 1:
            lead.append(_leaders(y, o, radius) + s)
    names = ["id", "root", "dim", "f", "q"]
    if found:
        root = roots(len(known), *(np.concatenate(p) for p in zip(*found, strict=True)))
        i = np.flatnonzero(root != np.arange(len(known)))
        yield pa.RecordBatch.from_arrays([pa.array(known[i]), pa.array(known[root[i]]), *(pa.nulls(len(i), t) for t in (pa.int32(), pa.int32(), pa.binary()))], names)
    if lead:
        i = np.concatenate(lead)
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[i]), pa.array(dim[i]), pa.array(f[i]), sketches.take(pa.array(i))], names)


def _links(table: pa.Table, cosine: float) -> Iterator[pa.RecordBatch]:
    """(id, n, root): for each group and pair of blocks, how many vectors each row links to and the smallest index that it is connected with."""
    table = table.combine_chunks()
    ids, copies, own = (table[c].to_numpy() for c in ("id", "copies", "own"))
    vectors = table["v"].combine_chunks() if isinstance(table["v"], pa.ChunkedArray) else table["v"]
    n, found = np.zeros(len(ids)), []
    for s, e in _groups(table, ["cluster", "lo", "hi"]):
        part = vectors.slice(s, e - s)
        x = _unit(_matrix(part, len(part[0])))
        one = two = np.arange(e - s)
        crossed = table["lo"][s] != table["hi"][s]
        if crossed:
            one, two = one[own[s:e] == own[s]], two[own[s:e] != own[s]]
        weight = copies[s:e].astype(np.float64)
        for lo in range(0, len(one), _STRIP):
            strip = one[lo : lo + _STRIP]
            close = x[strip] @ x[two].T >= cosine
            if not crossed:
                close &= strip[:, None] != two[None]
            n[s + strip] += close @ weight[two]
            a, b = np.nonzero(close)
            if crossed:
                n[s + two] += weight[strip] @ close
            else:
                up = a + lo < b
                a, b = a[up], b[up]
            found.append((s + strip[a], s + two[b]))
    touched = np.flatnonzero(n)
    if len(touched):
        root = roots(len(ids), *(np.concatenate(p) for p in zip(*found, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[touched]), pa.array(n[touched].astype(np.int64)), pa.array(ids[root[touched]])], ["id", "n", "root"])


def _in_blocks(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Adds blocks: into how many a key's rows are cut, 1 for most. Those that are cut are counted; up to BROADCAST_KEYS numbers are broadcast, so
    that the rows needn't be shuffled for them; more are joined by a shuffle that the adaptive planner may split."""
    hot = df.groupBy(*keys).count().where(F.col("count") > rows).select(*keys, F.ceil(F.col("count") / rows).cast("int").alias("blocks"))
    hot = settled(hot)
    few = hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(hot) if few else hot, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def _candidates(passed: DataFrame, cosine: float) -> DataFrame:
    """(node, component): groups of ids that hold all pairs which share a filter and have at least the cosine."""
    reach = math.sqrt(max(2 - 2 * cosine, 0.0)) + 1e-9
    schema, filters = "id long, root long, dim int, f int, q binary", ["dim", "f"]
    dealt = _in_blocks(passed.select("id", "dim", "q", F.explode("filters").alias("f")), filters, FILTER_ROWS)
    own = [*filters, "own"]
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")).repartition(*own).sortWithinPartitions(*own)
    near = settled(dealt.mapInArrow(lambda b: whole_groups(b, own, lambda t: _near(t, own, reach, RADIUS), 8192), schema))
    edges = near.where("f is null").select("id", "root")
    leaders = _in_blocks(near.where("f is not null").select("id", "dim", "q", "f"), filters, FILTER_ROWS)
    keys, wide = [*filters, "lo", "hi"], reach + 2 * RADIUS
    dealt = block_pairs(leaders, "blocks", "id").withColumn("blocks", F.lit(1)).repartition(*keys).sortWithinPartitions(*keys)
    edges = edges.unionByName(dealt.mapInArrow(lambda b: whole_groups(b, keys, lambda t: _near(t, keys, wide, None), 8192), schema).select("id", "root"))
    return connected_components(edges.select(F.col("id").alias("a"), F.col("root").alias("b")))


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per input row with an id.

    Equal vectors become one row with a number of copies. Of pairs at exactly the cosine about `recall` share
    a filter of one code, of closer ones more; what one code misses, as in a direction that it covers badly, the other with
    its own rotation finds but for about (1 - recall)². All pairs of a candidate group are compared, so
    many of the rest are found there. Links below the cosine are never made. A task returns counts and one
    connection per row, never its pairs.

    The vectors that links connect into one group are all compared, in blocks: that is the square of such a group, but of
    nothing else. Vectors of any length, and any number of lengths, go the same way.

    Vectors that are null, empty, zero or hold null or non-finite parts link with nothing, nor do
    vectors of different length; a cosine of exactly the bound links, as far as doubles tell. Rows with a null id are left out; rows that repeat an id link as copies do.
    Other columns aren't looked at.
    """
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(fit)
    groups = settled(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    counts = groups.select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("root"))
    # vectors of all lengths go the same way, each by the codes of its length, so the driver holds none of them
    sized = groups.withColumn("dim", F.size("v"))
    sized = sized.join(sized.groupBy("dim").agg(F.count("*").alias("rows")), "dim")
    passed = settled(sized.select("id", "v", "dim", "rows").mapInArrow(lambda b: _filter_rows(b, cosine, recall), "id long, dim int, q binary, filters array<int>"))
    candidates = settled(_candidates(passed, cosine).select(F.col("node").alias("id"), F.col("component").alias("cluster")))
    dealt = block_pairs(_in_blocks(candidates, ["cluster"], GROUP_ROWS), "blocks", "id").drop("blocks").join(groups, "id")
    dealt = dealt.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    links = dealt.mapInArrow(lambda b: whole_groups(b, ["cluster", "lo", "hi"], lambda t: _links(t, cosine), 4096), "id long, n long, root long")
    counts = counts.unionByName(links)
    counts = settled(counts)
    component = connected_components(counts.select(F.col("id").alias("a"), F.col("root").alias("b")))
    summed = counts.groupBy("id").agg(F.sum("n").alias("n"))
    per = groups.join(summed, "id").join(component, F.col("id") == F.col("node"), "left").select("v", (F.col("n") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = good.join(per, "v").select("vec_id", "n_links", "component_id")
    rest = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
