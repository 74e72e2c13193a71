"""Extra columns with the names that operators use inside, long texts, repeated rows and ties; classifiers against plain NumPy; the pipeline stage by stage."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrasift.llm import bpe, cluster, line_dedup, linear, mixing, ngram_join, quality, suffix_dedup, token_records, toxicity

from .test_operators import RANKS, WORD, components, corpus, frame, labelled, repeats, shingles

NAMES = ["n_removed", "gone_id", "gone_key", "gone", "lines", "_gone", "_lines", "mix_id", "copies", "copy", "slot", "_copies", "label_id", "y0", "id", "size", "p", "toxic", "p_toxic", "text_", "cluster", "lo", "hi", "r", "suffix", "a", "b", "h"]


def clashing(spark, rows):
    """(doc_id, text, source) and columns of all those names, each with its number and the row's id."""
    docs = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
    return docs.select("*", *[(F.col("doc_id") * 100 + k).alias(n) for k, n in enumerate(NAMES)])


def extras(rows, names):
    for r in rows:
        for n in names:
            assert r[n] == r.doc_id * 100 + NAMES.index(n), n


def test_extra_columns_stay(spark):
    rows = [r for r in corpus(12, 40) if r[1]]
    docs = clashing(spark, rows)
    got = line_dedup.line_dedup(docs)
    assert sorted(got.columns) == sorted(docs.columns)
    extras(got.collect(), [n for n in NAMES if n != "n_removed"])
    for kept in (ngram_join.keep_one_of_each(docs), mixing.mix_documents(docs)):
        assert kept.columns == docs.columns
        extras(kept.collect(), NAMES)
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i, _, _ in rows], "doc_id long, quality int, toxic int").withColumn("id", F.lit(1)).withColumn("text", F.lit("x"))
    scored = toxicity.toxicity(docs, labels, ["quality", "toxic"], decide_by="toxic")
    assert len(set(scored.columns)) == len(scored.columns)
    extras(scored.collect(), [n for n in NAMES if n not in ("toxic", "p_toxic")])
    same = quality.quality(docs, labels, F.col("source"), F.col("source")).collect()
    plain = quality.quality(docs.select("doc_id", "text", "source"), labels, F.col("source"), F.col("source")).collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, plain))


def test_long_texts_repeated_ids_and_ties(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(3000)]
    long = " ".join(rng.choices(vocab, k=20_000))
    lines = "\n".join(" ".join(rng.choices(vocab, k=6)) for _ in range(4000))
    rows = [(1, long, "a"), (2, long + " end", "a"), (3, lines, "b"), (4, lines, "b"), (5, "one two three four", "a"), (5, "one two three four", "a"), (6, "one two three four", None)]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.component_id, r.n_shingles) for r in ngram_join.ngram_join(docs).collect()}
    n = {i: len(shingles(t, 3)) for i, t, _ in rows}
    assert got == {(1, 1, n[1]), (2, 1, n[2]), (3, 3, n[3]), (4, 3, n[4]), (5, 5, 2), (6, 5, 2)}
    assert ngram_join.ngram_join(docs).count() == len(rows)
    cut = line_dedup.line_dedup(docs).collect()
    assert sorted((r.doc_id, r.n_removed) for r in cut) == [(1, 0), (2, 0), (3, 0), (4, 4000), (5, 0), (5, 0), (6, 0)]
    # brute force over long texts is too slow here, but these cases are plain
    gone = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert {(i, b, g) for i, b, g in gone if i < 5} == {(1, len(long), len(long)), (2, len(long) + 4, len(long)), (3, len(lines), len(lines)), (4, len(lines), len(lines))}
    enc = bpe.encoder(RANKS, corpus_pipeline.public_tokenizers.PATTERN)[1]
    assert len(long) > 3 * bpe.CHUNK  # so the default chunk is stitched
    tokens = sorted((r.doc_id, r.n_tokens) for r in bpe.bpe_digest(docs, RANKS, corpus_pipeline.public_tokenizers.PATTERN).collect())
    assert tokens == sorted((i, len(enc.encode_ordinary(t))) for i, t, _ in rows)
    out = cluster.scratch(spark, "records")
    token_records.write_token_records(docs, out, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    read = token_records.token_record_digest(spark, out).orderBy("start").collect()
    assert [r.doc_id for r in read] == [1, 2, 3, 4, 5, 5, 6] and all(b.start == a.start + a.n_tokens for a, b in zip(read, read[1:], strict=False))


def test_classifiers_take_repeated_and_missing_ids(spark):
    rows, labels = labelled(5, 300)
    known = spark.createDataFrame([*labels, *[(10_000 + i, 1, 1) for i in range(500)]], "doc_id long, quality int, toxic int")
    once = linear.labelled_sample(frame(spark, rows), known, "doc_id", "text", ["quality", "toxic"], bound=200)
    assert len(once) == 200  # labels of other corpora take no place
    again = linear.labelled_sample(frame(spark, rows + rows[:50] * 3).repartition(5), known, "doc_id", "text", ["quality", "toxic"], bound=200)
    assert (once.index == again.index).all() and (once.y["toxic"] == again.y["toxic"]).all()
    small = linear.labelled_sample(frame(spark, rows), known, "doc_id", "text", ["quality", "toxic"], bound=200, most_bytes=5000)
    assert 0 < len(small) < 60
    scored = toxicity.toxicity(frame(spark, rows + rows[:5]), known, ["quality", "toxic"], decide_by="toxic")
    assert scored.count() == len(rows) + 5


def plain_fit(x, tells, value, dense, y, steps=300, rate=0.3, l2=1e-5):
    """Logistic regression by Adam on dense columns: words scaled by their evidence, then the dense columns, then 1."""
    mean, scale = dense.mean(0), np.maximum(dense.std(0), 1e-6)
    design = np.hstack([x[:, tells] * value, (dense - mean) / scale, np.ones((len(y), 1))])
    theta = np.zeros(design.shape[1])
    theta[-1] = math.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        g = design.T @ (1 / (1 + np.exp(-np.clip(design @ theta, -30, 30))) - y) / len(y)
        g[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)

    def predict(x, dense):
        design = np.hstack([x[:, tells] * value, (dense - mean) / scale, np.ones((len(x), 1))])
        return 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))

    return predict


def plain_model(x, dense, y):
    n, share = len(y), y.mean()
    have = x.sum(0)
    evidence = np.abs(x.T @ y - have * share) / np.sqrt(np.maximum(have * share * (1 - share) * (1 - have / n), 0.25))
    tells = evidence >= linear.LEAST_EVIDENCE
    return plain_fit(x, tells, evidence[tells] / evidence[tells].max(initial=1.0), dense, y)


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def test_toxicity_is_a_plain_chain(spark):
    """The same features and folds, but dense matrices and one model after the other."""
    rows, labels = labelled(6, 240)
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known, ["quality", "toxic"], decide_by="toxic").collect()}
    data = [t.encode() for _, t, _ in rows]
    at, index, shapes = linear.features(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(b) for b in data])])
    used, column = np.unique(index, return_inverse=True)
    x = np.zeros((len(rows), len(used)))
    x[np.repeat(np.arange(len(rows)), np.diff(at)), column] = 1
    q, t = (np.array([y[k] for y in labels], float) for k in (1, 2))
    fold = np.arange(len(rows)) % toxicity.FOLDS  # rows are in the order of their ids
    held_out = np.zeros(len(rows))
    for f in range(toxicity.FOLDS):
        held_out[fold == f] = plain_model(x[fold != f], shapes[fold != f], q[fold != f])(x[fold == f], shapes[fold == f])
    first = plain_model(x, shapes, q)(x, shapes)
    second = plain_model(x, np.column_stack([shapes, logit(held_out)]), t)(x, np.column_stack([shapes, logit(first)]))
    ids = [i for i, _, _ in rows]
    assert [got[i].p_quality for i in ids] == pytest.approx(first.tolist(), abs=1e-5)
    assert [got[i].p_toxic for i in ids] == pytest.approx(second.tolist(), abs=1e-5)
    assert [got[i].toxic for i in ids] == (second >= toxicity.THRESHOLD).tolist()


def test_quality_by_hand_with_sparse_sites(spark):
    """All scores from the classifier's by plain Python; two sites have one document, and stay near the level above."""
    rows, labels = labelled(7, 300)
    rows = [(i, t, s if i not in (5, 9) else f"lone{i}") for i, t, s in rows]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "fr").otherwise("en"))
    got = {r.doc_id: r for r in quality.quality(docs, known, F.col("source"), F.concat_ws("/", "source", "lang")).collect()}
    host = {i: s for i, _, s in rows}
    path = {i: f"{s}/{'fr' if i % 7 == 0 else 'en'}" for i, _, s in rows}
    p = {i: got[i].doc_score for i in host}
    sums = [{}, {}]
    for of, where in zip(sums, (host, path), strict=True):
        for i, s in where.items():
            n, total = of.get(s, (0, 0.0))
            of[s] = n + 1, total + p[i]
    mean = sum(p.values()) / len(p)

    def strength(spread, inverse):
        inside = mean * (1 - mean)
        return min(max(inside / max(spread - inside * inverse, 1e-9) - 1, quality.LEAST_STRENGTH), quality.MOST_STRENGTH)

    hosts = list(sums[0].values())
    host_strength = strength(np.mean([(t / n - mean) ** 2 for n, t in hosts]), np.mean([1 / n for n, _ in hosts]))
    above = {path[i]: sums[0][host[i]] for i in host}
    paths = [(n, t / n - above[s][1] / above[s][0]) for s, (n, t) in sums[1].items()]
    path_strength = strength(np.mean([d * d for _, d in paths]), np.mean([1 / n for n, _ in paths]))
    for i, r in got.items():
        n, total = sums[0][host[i]]
        h = (total - p[i] + host_strength * mean) / (n - 1 + host_strength)
        n, total = sums[1][path[i]]
        q = (total - p[i] + path_strength * h) / (n - 1 + path_strength)
        z = logit(p[i]) + logit(q) - logit(mean)
        assert (r.host_score, r.path_score, r.score) == pytest.approx((h, q, 1 / (1 + math.exp(-z))), abs=1e-9)
        assert r.keep == (r.score >= quality.KEEP_AT)
    for i in (5, 9):  # nothing else is known of their sites
        assert got[i].host_score == pytest.approx(mean) and got[i].path_score == pytest.approx(mean)


def test_pipeline_stage_by_stage(spark, tmp_path):
    rows, labels = labelled(8, 160)
    base = rows[0][1]
    rows += [(1000, base, "src0"), (1001, base + " more", None), (1002, None, "src1"), (1003, "", "src1"), (1004, "\n".join("abcdefg"), "src2"), (1005, "\n".join("abcdefg"), "src2")]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").withColumn("slot", F.lit(7))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    here = docs
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram join", "mixing", "byte-level BPE"]
    toxic = {i for i, _, t in labels if t}
    for name, stage in corpus_pipeline.STAGES:
        out = cluster.settled(stage(spark, here, str(tmp_path)))
        if name != "byte-level BPE":
            assert out.columns == docs.columns
        ids = Counter(r.doc_id for r in out.collect())
        if name == "toxicity":
            gone = {r.doc_id for r in here.collect()} - set(ids)
            assert len(gone ^ toxic) <= 0.03 * len(rows) and not gone & {1002, 1003, 1004}
        if name == "line dedup":
            by = {r.doc_id: r for r in out.collect()}
            assert by[1005].text == "" and by[1005].n_chars == 0 and by[1004].text == "\n".join("abcdefg")
            assert set(by) == {r.doc_id for r in here.collect()}
        if name == "n-gram join":
            texts = {r.doc_id: shingles(r.text, 5) for r in here.collect()}
            linked = [(a, b) for a in texts for b in texts if a < b and texts[a] and texts[b] and 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b])]
            assert set(ids) == {i for i, c in components(texts, linked).items() if i == c}
        if name == "mixing":
            assert set(ids) <= {r.doc_id for r in here.collect()} and max(ids.values()) <= 2
            words = lambda df: sum(len(WORD.findall(r.text or "")) for r in df.collect())
            assert words(out) == pytest.approx(1.5 * words(here), rel=0.1)
        if name == "byte-level BPE":
            assert sorted(ids.elements()) == sorted(r.doc_id for r in here.collect())
        here = out
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, here.collect()))


def test_pipeline_of_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_suffix_dedup_of_repeated_ids(spark):
    rows = corpus(3, 30)
    rows = [*rows, (rows[0][0], rows[3][1], "x"), rows[4]]
    want = sorted(v for v in repeats([(k, t, s) for k, (_, t, s) in enumerate(rows)], 60).values())
    got = suffix_dedup.suffix_dedup(frame(spark, rows), length=60, key_bytes=20).collect()
    assert sorted(tuple(r)[1:] for r in got) == want
