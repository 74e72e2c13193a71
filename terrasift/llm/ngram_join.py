"""N-gram Jaccard join by tries of globally ordered shingle sets.

1. Every text becomes its set of word shingles, ordered by their hashes, the same order everywhere.
2. Candidates: a class of set sizes fixes how many shingles two linked sets can differ in. The
   order is cut into more stretches than that, so linked sets agree in as many whole stretches as
   there are spare ones. All but that many of a set's stretches, the most frequent ones left out,
   meet in an aggregated minimum, which joins the sets to candidate groups: passages that
   many texts share make few of a set's stretches, and those are frequent.
3. Each candidate group is joined by tries of its ordered sets: every set walks the trie of those
   after it, sets with a common start share the overlap counted so far, and subtrees go whose
   remaining length can't reach the wanted similarity.

A group larger than a block is joined in three rounds. First each block by itself; near copies of one text
become one part of each block. Then the parts' centres, the sets with the most links, which mostly makes
one part of them all. Last, whatever lies in different parts: blocks of one part don't meet any more, so
a large group of near copies costs its size, not the square of its blocks. Tasks return one connection
per set, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import block_pairs, connected_components, discard, roots, scratch, settled, unused, whole_groups
from .text import mix, ragged, shingle_sets, slices, utf8

WIDTH = 3
#: Least similarity in hundredths.
PERCENT = 90
#: Shingles in a block of a candidate group.
BLOCK_SHINGLES = 1 << 17
#: A stretch's class of sizes and how many must agree travel in one number, so many classes apart.
_CLASSES = 64
_SEED = np.uint64(0xA0761D6478BD642F)


def size_classes(percent: int, most: int = 1 << 31) -> np.ndarray:
    """Lower bounds of the classes of set sizes: wide enough that linked sets lie in one class or in neighbours."""
    grow = max(1.5, 1.2 * 100 / percent)
    bounds = [1]
    while bounds[-1] < most:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * grow)))
    return np.array(bounds, np.int64)


def stretches(top: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(differences, stretches) of a class whose largest size is top, its sets being compared with ones of up to top * 100 / percent."""
    differ = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
    # the lower the similarity, the shorter the stretches, and the more of them must agree
    return differ, differ + 2 + (differ + 1) // 64 + differ * max(0, 90 - percent) // 30


def stretch_hashes(tokens: np.ndarray, offsets: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, ...]:
    """(hash, row, class, least): the stretches of each row's set by which a set that links with it can be met.

    Sets that link in a class have at least `least` hashes in common, counted from either. Empty stretches
    that may be among those that agree lower it; where they could be all of them, they are passed on too.
    """
    bounds = size_classes(percent)
    n = np.diff(offsets)
    full = np.flatnonzero(n)
    own = np.searchsorted(bounds, n[full], "right") - 1
    lower = own > 0
    below = bounds[own] - 1
    lower &= n[full] * percent <= below * 100
    row = np.r_[full, full[lower]]
    cls = np.r_[own, own[lower] - 1]
    differ, k = stretches(bounds[cls + 1] - 1, percent)
    counts = n[row]
    at = ragged(offsets[row], counts)
    if not len(at):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    which = np.repeat(np.arange(len(row)), counts)
    value = tokens[at]
    seg = ((value >> np.uint64(32)) * k[which].astype(np.uint64)) >> np.uint64(32)
    new = np.r_[True, (which[1:] != which[:-1]) | (seg[1:] != seg[:-1])]
    first = np.flatnonzero(new)
    total = np.add.reduceat(mix(value ^ _SEED), first)
    place = (cls[which[first]].astype(np.uint64) << np.uint64(40)) | seg[first]
    out, emission = mix(total + mix(place)), which[first]
    empty = k - np.bincount(emission, minlength=len(row))
    least = k - differ - empty
    for i in np.flatnonzero(least < 1):
        there = seg[first[emission[: len(first)] == i]].astype(np.int64)
        gaps = np.setdiff1d(np.arange(k[i]), there).astype(np.uint64)
        out = np.r_[out, mix(mix((np.uint64(cls[i]) << np.uint64(40)) | gaps) + _SEED)]
        emission = np.r_[emission, np.full(len(gaps), i)]
    return out, row[emission], cls[emission], np.maximum(least, 1)[emission]


def _set_hash(tokens: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = mix(np.add.reduceat(mix(tokens ^ np.uint64(seed)), offsets[full]))
    return out


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in slices(*utf8(batch["text"])):
            tokens, at = shingle_sets(data, off, width)
            cols = [pa.array(np.diff(at)), *(pa.array(_set_hash(tokens, at, s).view(np.int64)) for s in (1, 2))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), *cols], ["doc_id", "n", "a", "b"])


def _stretch_rows(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for _, _, data, off in slices(*utf8(batch["text"])):
            tokens, at = shingle_sets(data, off, width)
            node = _set_hash(tokens, at, 1)
            # equal sets that this task has passed on already add nothing
            fresh = np.zeros(len(node), bool)
            fresh[np.unique(node, return_index=True)[1]] = True
            fresh &= np.array([x not in seen for x in node.tolist()], bool)
            if len(seen) > 1 << 20:
                seen.clear()
            seen.update(node[fresh].tolist())
            h, row, cls, least = stretch_hashes(tokens, at, percent)
            keep = fresh[row]
            part = (least * _CLASSES + cls)[keep].astype(np.int32)
            columns = [h[keep].view(np.int64), node[row[keep]].view(np.int64), part]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "a", "part"])


def trie_links(tokens: np.ndarray, offsets: np.ndarray, group: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose sets are at least that similar.

    tokens: each row's set in ascending order; rows of a group are adjacent. The rows of a group are
    sorted as sequences, so that a trie node is a range of rows with a common start. All walks
    go down one level at a time together; a step is one addition per (set, node) for all sets
    below the node.
    """
    n = len(offsets) - 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < 2:
        return none
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    big = rank.astype(">u4")
    order = sorted(range(n), key=lambda i: (group[i], big[offsets[i] : offsets[i + 1]].tobytes()))
    order = np.array(order)
    size = np.diff(offsets)[order]
    group = group[order]
    rank = rank[ragged(offsets[:-1][order], size)]
    off = np.r_[0, np.cumsum(size)]
    keys = (np.repeat(np.arange(n, dtype=np.int64), size) << 32) | rank
    # length of the common start with the row before, -1 where a group begins
    common = np.full(n, -1, np.int64)
    for i in range(1, n):
        if group[i] == group[i - 1]:
            m = min(size[i], size[i - 1])
            differ = rank[off[i] : off[i] + m] != rank[off[i - 1] : off[i - 1] + m]
            common[i] = differ.argmax() if differ.any() else m
    by_depth = np.argsort(common, kind="stable")
    depth_at = common[by_depth]
    # least and largest size in any range of rows
    small, large = [size], [size]
    while (1 << len(small)) <= n:
        half = 1 << (len(small) - 1)
        small.append(np.minimum(small[-1][:-half], small[-1][half:]))
        large.append(np.maximum(large[-1][:-half], large[-1][half:]))

    def extreme(tables: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, pick) -> np.ndarray:
        out = np.empty(len(lo), np.int64)
        level = np.log2(hi - lo).astype(np.int64)
        for v in np.unique(level):
            i = level == v
            out[i] = pick(tables[v][lo[i]], tables[v][hi[i] - (1 << v)])
        return out

    ends = np.r_[np.flatnonzero(common == -1)[1:], n]
    stop = ends[np.cumsum(common == -1) - 1]
    probe = np.flatnonzero(np.arange(n) + 1 < stop)
    lo, hi = probe + 1, stop[probe]
    overlap = np.zeros(len(probe), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    depth, total = 0, 100 + percent
    while len(probe):
        # rows that end here lie first in their range
        over = size[lo] == depth
        while over.any():
            i = np.flatnonzero(over)
            linked = total * overlap[i] >= percent * (size[probe[i]] + depth)
            found.append((probe[i[linked]], lo[i[linked]]))
            lo = lo + over
            left = lo < hi
            probe, lo, hi, overlap = probe[left], lo[left], hi[left], overlap[left]
            over = size[lo] == depth
        if not len(probe):
            break
        # children: the range splits where the common start is as long as the node is deep
        a, b = np.searchsorted(depth_at, [depth, depth + 1])
        splits = by_depth[a:b]
        first, last = np.searchsorted(splits, lo + 1), np.searchsorted(splits, hi)
        more = last - first
        if more.any():
            parent = np.repeat(np.arange(len(probe)), more + 1)
            start = np.cumsum(more + 1) - more - 1
            begin = lo[parent]
            rest = np.ones(len(parent), bool)
            rest[start] = False
            begin[rest] = splits[ragged(first, more)]
            finish = np.r_[begin[1:], 0]
            finish[start + more] = hi
            probe, lo, hi, overlap = probe[parent], begin, finish, overlap[parent]
        token = rank[off[lo] + depth]
        want = (probe << 32) | token
        at = np.searchsorted(keys, want)
        hit = keys[np.minimum(at, len(keys) - 1)] == want
        overlap = overlap + hit
        depth += 1
        ahead = off[probe + 1] - at - hit
        best = (total * (overlap + ahead) >= percent * (size[probe] + extreme(small, lo, hi, np.minimum))) & (total * (overlap - depth) + 100 * extreme(large, lo, hi, np.maximum) >= percent * size[probe])
        probe, lo, hi, overlap = probe[best], lo[best], hi[best], overlap[best]
    if not found:
        return none
    a, b = (order[np.concatenate(p)] for p in zip(*found, strict=True))
    return a, b


def _join(table: pa.Table, width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b): each set that has a link in its group, and the set with the most links among all that it is connected with there."""
    table = table.combine_chunks()
    ids, cluster, lo, hi = (table[c].to_numpy() for c in ("doc_id", "cluster", "lo", "hi"))
    group = np.cumsum(np.r_[0, (cluster[1:] != cluster[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    parts, sizes = [], []
    for _, _, data, off in slices(*utf8(table["text"])):
        t, at = shingle_sets(data, off, width)
        parts.append(t)
        sizes.append(np.diff(at))
    tokens, offsets = np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(sizes))]
    a, b = trie_links(tokens, offsets, group, percent)
    if len(a):
        root = roots(len(ids), a, b)
        links = np.bincount(np.r_[a, b], minlength=len(ids))
        linked = np.flatnonzero(links)
        # of the sets with one root, the first in this order has the most links; of equals, the smallest id
        order = linked[np.lexsort((ids[linked], -links[linked], root[linked]))]
        first = np.r_[True, root[order][1:] != root[order][:-1]]
        centre = np.zeros(len(ids), ids.dtype)
        centre[root[order[first]]] = ids[order[first]]
        i = linked[ids[linked] != centre[root[linked]]]
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(centre[root[i]])], ["a", "b"])


def _candidates(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component): the candidate group of each set that has candidates.

    The stretches are made twice, once to count them and once to pick a set's own; a table of them would be
    larger than the texts, and so would one shuffle more of the texts be than the few copies that it would
    leave out. Copies of a set in one task make its stretches once; of those in several tasks, equal rows
    collapse again where a set's are gathered, so no array is longer than one set has stretches.
    """
    met = rows.mapInArrow(lambda b: _stretch_rows(b, width, percent), "h long, a long, part int")
    common = met.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    least = F.floor(F.col("part") / _CLASSES).cast("int")
    stretch = F.struct("df", "h")
    # of a set's stretches, as many as a document is long, all but the least - 1 most frequent
    own = met.join(common, "h").groupBy("a", "part").agg(F.array_sort(F.collect_set(stretch)).alias("t")).where(F.size("t") >= least)
    kept = settled(own.select("a", F.explode(F.slice("t", F.lit(1), F.size("t") - least + 1)).alias("x")).select("a", "x.h"))
    hubs = kept.groupBy("h").agg(F.min("a").alias("b"), F.max("a").alias("hi")).where("b < hi").select("h", "b")
    edges = kept.join(hubs, "h").where("a != b").select("a", "b")
    return connected_components(edges.distinct())


def _links(rows: DataFrame, members: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """(a, b): connections between the sets of each cluster that make the same components as all its links.

    members: (doc_id, cluster, n), one row per distinct set.
    """
    path = scratch(rows.sparkSession, "candidates")
    size = members.groupBy("cluster").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"), F.count("*").alias("m"))
    members = members.join(size.where("m > 1").drop("m"), "cluster")
    rows.join(members, "doc_id").select("doc_id", "text", "cluster", "n", "blocks").write.parquet(path, compression="zstd")
    texts = rows.sparkSession.read.parquet(path)

    def joined(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("doc_id", "text", "n", "cluster", "lo", "hi").repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
        work = lambda t: _join(t, width, percent)
        return settled(dealt.mapInArrow(lambda b: whole_groups(b, ["cluster", "lo", "hi"], work, 1024, "n", 1 << 20), "a long, b long"))

    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long")).cast("int")
    links = joined(texts.withColumn("lo", own).withColumn("hi", own))
    # what is left: clusters of several blocks, in more than one part
    large = texts.where("blocks > 1").select("doc_id", "cluster", "n")
    parted = settled(large.join(links, F.col("doc_id") == F.col("a"), "left").select("doc_id", "cluster", "n", F.coalesce("b", "doc_id").alias("part")))
    several = parted.where("doc_id = part").groupBy("cluster").count().where("count > 1").select("cluster")
    parted = settled(parted.join(several, "cluster", "left_semi"))
    if not parted.isEmpty():
        centres = parted.where("doc_id = part").select("doc_id", "cluster", "n")
        blocks = centres.groupBy("cluster").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
        dealt = block_pairs(centres.join(blocks, "cluster"), "blocks", "doc_id").select("doc_id", "lo", "hi")
        met = joined(texts.join(dealt, "doc_id"))
        merged = connected_components(met).select(F.col("node").alias("part"), "component")
        parted = settled(parted.join(merged, "part", "left").select("doc_id", "cluster", "n", F.coalesce("component", "part").alias("part")))
        rest = joined(texts.join(_different_parts(parted, block), ["doc_id", "cluster"]))
        links = settled(links.unionByName(met).unionByName(rest))
    discard(rows.sparkSession, path)
    return links


def _different_parts(parted: DataFrame, block: int) -> DataFrame:
    """(doc_id, cluster, lo, hi): deals rows (doc_id, cluster, n, part) to pairs of blocks in which any two of
    different parts of a cluster meet. A part over half a block has blocks of its own, which don't meet each other."""
    sizes = parted.groupBy("cluster", "part").agg(F.sum("n").alias("size")).withColumn("whole", F.col("size") * 2 > block)
    of = F.when(F.col("whole"), F.col("part"))
    blocks = sizes.groupBy("cluster", "whole", of.alias("of")).agg(F.ceil(F.sum("size") / block).cast("long").alias("blocks"), F.count("*").alias("parts"))
    # a cluster that is one part has nothing to compare
    some = sizes.groupBy("cluster").count().where("count > 1").select("cluster")
    blocks = blocks.join(some, "cluster", "left_semi")
    cut = blocks.select("cluster", "whole", "of", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("cut"))
    # one row per block of a cluster
    numbered = settled(cut.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("whole", "of", "cut"))))
    one, two = numbered.alias("x"), numbered.alias("y")
    apart = (F.col("x.k") <= F.col("y.k")) & ~(F.col("x.whole") & F.col("y.whole") & (F.col("x.of") == F.col("y.of")))
    pairs = one.join(two, F.col("x.cluster") == F.col("y.cluster")).where(F.coalesce(apart, F.col("x.k") <= F.col("y.k")))
    pairs = settled(pairs.select(F.col("x.cluster").alias("cluster"), F.col("x.k").alias("lo"), F.col("y.k").alias("hi")))
    ends = pairs.withColumn("k", F.col("lo")).unionByName(pairs.where("lo != hi").withColumn("k", F.col("hi")))
    rows = parted.join(sizes.drop("size"), ["cluster", "part"]).withColumn("of", of)
    rows = rows.join(blocks.select("cluster", "whole", F.col("of").alias("its"), "blocks"), ["cluster", "whole"]).where(F.col("of").eqNullSafe(F.col("its")))
    salt = F.when(F.col("whole"), F.xxhash64("doc_id")).otherwise(F.xxhash64("part"))
    rows = rows.withColumn("cut", F.pmod(salt, F.col("blocks"))).select("doc_id", "cluster", "whole", "of", "cut")
    at = numbered.select("cluster", "whole", F.col("of").alias("its"), "cut", "k")
    rows = rows.join(at, ["cluster", "whole", "cut"]).where(F.col("of").eqNullSafe(F.col("its")))
    return rows.select("doc_id", "cluster", "k").join(ends, ["cluster", "k"]).select("doc_id", "cluster", "lo", "hi")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id of each row with an id.

    Words are runs of bytes other than space and U+0009 to U+000D, A to Z in lower case. Two rows link when the
    Jaccard similarity of their sets of distinct shingles is at least percent / 100. component_id is the
    smallest doc_id that links lead to, the row's own included. Rows without words (null and empty
    texts too) have no shingles and are linked with nothing; one or two words make one shingle. Texts of any
    length count whole. Rows that repeat an id are one document, linked by any of their texts; each is returned. Other columns
    aren't looked at. All links between different sets are found, but for chance equalities of 64-bit hashes.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = settled(rows.mapInArrow(lambda b: _sets(b, width), "doc_id long, n long, a long, b long"))
    firsts = sets.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("first"))
    groups = _candidates(rows, width, percent)
    members = settled(firsts.join(groups, F.col("a") == F.col("node")).select(F.col("first").alias("doc_id"), F.col("component").alias("cluster"), "n"))
    components = connected_components(_links(rows, members, width, percent, block_shingles))
    named = firsts.join(components, F.col("first") == F.col("node"), "left").select("n", "a", "b", F.coalesce("component", "first").alias("component_id"))
    full = sets.where("n > 0").join(named, ["n", "a", "b"])
    empty = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs with all their columns, but of each component only the document with the smallest id.

    Rows with a null id, without words, or of equal ids stay together with what stays of their component.
    """
    (gone_id,) = unused(docs, "gone_id")
    found = ngram_join(docs, id_col, **options)
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(gone_id), "left_anti")
