"""Pairs at exactly the cosine share a filter, also in a direction that one code covers badly."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrasift.llm import embedding_dedup


def pairs_at(rng, n, cosine, dim=64):
    """Two matrices, the rows of which have that cosine."""
    x, y = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)


def test_pairs_at_the_cosine_are_linked(spark):
    x, y = pairs_at(np.random.default_rng(21), 1500, 0.9501)
    rows = [(2 * i + j, v.tolist()) for i, pair in enumerate(zip(x, y, strict=True)) for j, v in enumerate(pair)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    # of even pairs one code finds about 97 in 100
    assert got.where(F.col("n_links") > 0).count() >= 0.99 * len(rows)


@pytest.mark.parametrize("rows", [20_000, 1_000_000])
def test_codes_of_large_tables(rows):
    """Of pairs at the cosine, each code has a filter in common for about its recall, both codes for nearly all."""
    x, y = pairs_at(np.random.default_rng(4), 400, 0.9501)
    met = []
    for seed in (11, 12):
        code = embedding_dedup.CapCode(64, rows, seed=seed)
        (r, f), (s, g) = code.decode(x), code.decode(y)
        common = np.intersect1d(r * (code.words**2 + 1) + f, s * (code.words**2 + 1) + g)
        met.append(np.isin(np.arange(len(x)), common // (code.words**2 + 1)))
    assert min(m.mean() for m in met) > embedding_dedup.RECALL - 0.05
    assert (met[0] | met[1]).mean() >= 0.97


def test_sketches_never_part_near_vectors():
    x, y = pairs_at(np.random.default_rng(5), 500, 0.95)
    turn = np.linalg.qr(np.random.default_rng(6).standard_normal((64, 64)))[0]
    sketches = [embedding_dedup._unsketch(pa.array([r.tobytes() for r in embedding_dedup._sketch(v @ turn)], pa.binary())) for v in (x, y)]
    (a, off_a), (b, off_b) = sketches
    assert (np.linalg.norm(a - b, axis=1) <= np.sqrt(2 - 2 * 0.95) + off_a + off_b + 1e-9).all()


def test_hot_cluster_in_blocks(spark, monkeypatch):
    """A third of all vectors near one another, dealt to blocks in every filter and in their group; all counts exact."""
    monkeypatch.setattr(embedding_dedup, "FILTER_ROWS", 40)
    monkeypatch.setattr(embedding_dedup, "GROUP_ROWS", 50)
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(64)
    x = np.vstack([centre + 0.12 * rng.standard_normal((300, 64)), rng.standard_normal((600, 64))])
    x = x[rng.permutation(len(x))]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    got = embedding_dedup.embedding_dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    by = {r.vec_id: r for r in got.collect()}
    assert [by[i].n_links for i in range(len(x))] == close.sum(1).tolist() and close.sum() > 50_000
    hot = np.flatnonzero(close.any(1))
    assert {by[i].component_id for i in hot.tolist()} == {int(hot[0])}


@pytest.mark.parametrize("inner", [0.85, 0.9])
def test_dense_topics_make_no_groups(spark, monkeypatch, inner):
    """Topics whose vectors are near, but hardly any of them linked: what is verified stays next to what is linked."""
    groups = []
    keep = embedding_dedup._candidates
    monkeypatch.setattr(embedding_dedup, "_candidates", lambda *a: groups.append(keep(*a)) or groups[-1])
    rng = np.random.default_rng(11)
    x = []
    for _ in range(4):
        centre = rng.standard_normal(64)
        centre /= np.linalg.norm(centre)
        off = rng.standard_normal((400, 64))
        off -= np.outer(off @ centre, centre)
        x.append(np.sqrt(inner) * centre + np.sqrt(1 - inner) * off / np.linalg.norm(off, axis=1, keepdims=True))
    x = np.vstack(x)
    close = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    nearly = ((x @ x.T >= 0.935) & ~np.eye(len(x), dtype=bool)).any(1).sum()
    got = embedding_dedup.embedding_dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert [r.n_links for r in got.orderBy("vec_id").collect()] == close.sum(1).tolist()
    sizes = [r["count"] for r in groups[0].groupBy("component").count().collect()]
    assert sum(sizes) <= nearly and max(sizes, default=0) <= 40
    if inner < 0.9:
        assert close.sum() == 0


@pytest.mark.parametrize("keys", [2, 100])
def test_filters_are_cut_by_rows_alone(spark, monkeypatch, keys):
    """The rows of a block have one bound, however large the table is and however many keys are cut."""
    monkeypatch.setattr(embedding_dedup, "BROADCAST_KEYS", keys)
    df = spark.range(100_000).select((F.col("id") % 7).alias("k"))
    blocks = {r.k: r.blocks for r in embedding_dedup._in_blocks(df, ["k"], 4096).distinct().collect()}
    assert set(blocks.values()) == {4} and len(blocks) == 7


def test_many_lengths_at_once(spark):
    """Vectors of sixty lengths, three of each, two of which are linked; very long ones among them."""
    rng = np.random.default_rng(12)
    rows = []
    for k in [*range(1, 59), 2000, 5000]:
        v = rng.standard_normal(k)
        rows += [(3 * k, v.tolist()), (3 * k + 1, (v * 2 + 1e-3).tolist()), (3 * k + 2, (-v).tolist())]
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    for k in [*range(2, 59), 2000, 5000]:
        assert [got[3 * k + i].n_links for i in range(3)] == [1, 1, 0] and got[3 * k + 1].component_id == 3 * k
