"""The operators against brute force, on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.llm import bpe, cluster, embedding_dedup, exact_dedup, line_dedup, mixing, ngram_join, quality, suffix_dedup, token_records, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, part int, n int, s int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def frame(spark, rows):
    """rows: (doc_id, text, source); the other columns clash with names used inside the operators."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, 3, 4) for i, t, s in rows], DOCS)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(80)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    base, passage = say(120), say(70)
    lines = [say(5) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            t = base
        elif kind in (1, 2):
            w = base.split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        elif kind == 3:
            t = say(30) + " " + passage + " " + say(20)
        elif kind == 4:
            t = say(8) + "\n" + "\n".join(lines[rng.randint(0, 2):]) + "\n" + say(8)
        else:
            t = say(rng.randint(1, 200)).capitalize()
        rows.append((i, t, ["src1", "src0", None][i % 3] if i % 2 else "src1"))
    rows += [(n, None, "src0"), (n + 1, "", None), (n + 2, " \n\t ", "src0"), (n + 3, "one", "x"), (n + 4, "One", "x"), (n + 5, "a" * 700, "x"), (n + 6, "é" * 300 + " end", None), (n + 7, (say(900) + "\n") * 2, "src1")]
    return rows


def components(n, pairs):
    root = {i: i for i in n}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (7, 7)]
    got = dict(map(tuple, cluster.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    want = components({x for p in pairs for x in p if p[0] != p[1]}, pairs)
    assert got == want
    assert cluster.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


@pytest.mark.parametrize("width, percent, block", [(3, 90, 1 << 18), (3, 90, 300), (5, 80, 500), (2, 60, 1 << 18)])
def test_ngram_join(spark, width, percent, block):
    rows = corpus(2, 120)
    sets = {i: shingles(t, width) for i, t, _ in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert len(linked) > 50
    want = components(sets, linked)
    got = ngram_join.ngram_join(frame(spark, [*rows, (None, "x y z", "s")]), width=width, percent=percent, block_shingles=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}
    assert len(got) == len(rows)
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0


def test_ngram_join_keeps_one(spark):
    rows = corpus(2, 40)
    want = components([r[0] for r in rows], [(r.doc_id, r.component_id) for r in ngram_join.ngram_join(frame(spark, rows)).collect()])
    kept = ngram_join.keep_one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}


def repeats(rows, length):
    """Brute force: doc_id to (n_bytes, n_removed, n_spans, sha256)."""
    seen = Counter()
    for _, t, _ in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = {}
    for d, t, _ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()
    return out


@pytest.mark.parametrize("length, k, group_rows", [(200, 50, 2048), (60, 20, 2048), (60, 20, 4)])
def test_suffix_dedup(spark, length, k, group_rows):
    rows = corpus(3, 80)
    want = repeats(rows, length)
    assert sum(w[1] > 0 for w in want.values()) > 20 and any(0 < w[1] < w[0] for w in want.values())
    got = suffix_dedup.suffix_dedup(frame(spark, [*rows, (None, rows[0][1], "s")]), length=length, key_bytes=k, group_rows=group_rows).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0


def test_suffix_dedup_long_rows_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 97)
    data = np.frombuffer((corpus(4)[3][1] * 3).encode(), np.uint8)
    whole = list(suffix_dedup._entries(_text_batch([data.tobytes().decode()]), 60, 20))
    flat = lambda bs: sorted((g, s + i) for b in bs for g, s, n in zip(b["suffix"].to_pylist(), b["start"].to_pylist(), b["n"].to_pylist(), strict=True) for i in range(n))
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 1 << 20)
    assert flat(whole) == flat(suffix_dedup._entries(_text_batch([data.tobytes().decode()]), 60, 20))


def _text_batch(texts):
    import pyarrow as pa

    return [pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int32()), pa.array(texts)], ["doc_id", "key", "text"])]


def test_suffix_dedup_scans_its_levels(spark, monkeypatch):
    """The operator itself: five batches leave a level of four and one of one, and repeats between both come from the notes of the scan."""
    made = []

    class Seen(suffix_dedup.SuffixIndex):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

        def repeated(self):
            self.before = [(x[0], x[1]) for x in self.levels]
            self.found = self.noted().count() if self.notes else 0
            return super().repeated()

    monkeypatch.setattr(suffix_dedup, "SuffixIndex", Seen)
    rows = corpus(4, 80)
    got = {r.doc_id: (r.n_removed, r.kept) for r in suffix_dedup.suffix_dedup(frame(spark, rows), length=60, key_bytes=20, texts=True).collect()}
    index = made[0]
    assert index.before == [(0, 3), (4, 4)] and len(index.notes) == 2 and index.found > 0
    for i, t, _ in rows:
        assert got[i][0] == len((t or "").encode()) - len(got[i][1])
    # without the scan, what only the last batch repeats would be missed
    monkeypatch.setattr(Seen, "noted", lambda self: spark.createDataFrame([], "s long"))
    less = suffix_dedup.suffix_dedup(frame(spark, rows), length=60, key_bytes=20).agg(F.sum("n_removed")).first()[0]
    assert less < sum(n for n, _ in got.values())


def test_suffix_index_is_kept_and_grows(spark):
    """Batches added in several calls, the index opened again between them; arrays in the order of the suffixes."""
    rows = corpus(11, 70)
    docs = frame(spark, rows).selectExpr("doc_id", "hash(coalesce(text, '')) as key", "coalesce(text, '') as text")
    path = cluster.scratch(spark, "index")
    sizes = []
    for i in range(5):
        index = suffix_dedup.SuffixIndex(spark, path, 60, 20)
        index.add(docs.where(f"doc_id % 5 = {i}"))
        sizes.append([b - a + 1 for a, b, _ in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    index = suffix_dedup.SuffixIndex(spark, path, 60, 20)
    cuts = suffix_dedup.repeated_bytes(docs, index, cluster.scratch(spark, "cuts")).collect()
    gone = {}
    for c in cuts:
        gone.setdefault(c.doc_id, set()).update(range(c.start, c.stop))
    want = repeats(rows, 60)
    assert {i: len(gone.get(i, ())) for i in want} == {i: w[1] for i, w in want.items()}
    array = spark.read.parquet(f"{path}/{index.levels[0][2]}").where("lcp is not null").collect()
    known = {(r.suffix, r.doc_id, r.key, r.start) for r in array}
    assert len(known) == len(array) > 100 and all(len(r.suffix) == 20 and 0 <= r.lcp <= 20 for r in array)
    inner = sorted((r.suffix for r in array))
    shared = {b: max(sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a, b, strict=True))), 0) for a, b in itertools.pairwise(inner) if a != b}
    assert sum(r.lcp in (20, shared.get(bytes(r.suffix), r.lcp)) for r in array) >= 0.9 * len(array)


def test_suffix_windows_are_compared_by_bytes():
    data = np.frombuffer(b"abcdefgh--abcdefgh--abcdxfgh", np.uint8)
    p, q = np.array([0, 1, 0, 1, 4, 0]), np.array([10, 11, 20, 21, 14, 1])
    assert suffix_dedup._equal(data, p, q, 4).tolist() == [True, True, True, False, True, False]
    assert suffix_dedup._equal(data, p, q, 4, most=3).tolist() == [True, True, True, False, True, False]


def test_exact_dedup(spark):
    rows = [*corpus(5, 40), (500, "é" * 300 + " end", "x"), (None, "one", "x")]
    for keep, pick in (("largest", max), ("smallest", min)):
        groups = {}
        for i, t, _ in rows:
            if i is not None:
                groups.setdefault(t or "", []).append(i)
        want = {i: (pick(g), len(g), i == pick(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
        got = exact_dedup.exact_dedup(frame(spark, rows), keep=keep).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert exact_dedup.drop_exact_copies(frame(spark, rows)).where("doc_id is not null").count() == len(groups)
    repeated = exact_dedup.drop_exact_copies(frame(spark, [(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (None, "a", "x")]))
    assert sorted((r.doc_id or 0, r.text) for r in repeated.collect()) == [(0, "a"), (1, "b"), (2, "a")]
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    twice = exact_dedup.exact_dedup(frame(spark, [(1, "a", "s"), (1, "a", "s")])).collect()
    assert [(r.group_size, r.kept) for r in twice] == [(2, True), (2, True)]


def test_line_dedup(spark):
    rows = [*corpus(6, 80), (900, "a\nb\nc\nd", "s"), (901, "x\na\nb\nc\ny\na\nb\nc", "s"), (902, "\n\n\n\n", "s"), (903, "\n\n\n\n", "s")]
    seen, want = set(), {}
    for i, t, _ in sorted(rows):
        lines = t.split("\n") if t is not None else []
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not "".join(w).strip(" "):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        want[i] = (None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone))
    got = line_dedup.line_dedup(frame(spark, [*rows, (None, rows[4][1], "s")])).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in got if r.doc_id is not None} == want
    assert [r.text for r in got if r.doc_id is None] == [rows[4][1]]
    assert want[901] == ("x\ny", 6) and sum(w[1] > 0 for w in want.values()) > 5
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = (budget - sum(full.values())) / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if w[s] * level > 2 * sizes[s]]
        if not over:
            return full | {s: w[s] * level for s in rest}
        full |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark):
    rows = [*corpus(7, 150), *((300 + i, "w " * (i % 50), f"tiny{i % 4}") for i in range(20)), (None, "w w", "src0")]
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows if i is not None}
    source = {i: s for i, _, s in rows if i is not None}
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    want = targets(sizes)
    out, pieces = mixing.mixture(frame(spark, rows), block=16)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == out.count() == len(size)
    taken = Counter()
    for i, r in got.items():
        assert (r["size"], r.source_size) == (size[i], sizes[source[i]]) and r.target == pytest.approx(want[source[i]])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source[i]] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) < 1.001, s
    slots = pieces.groupBy("slot").agg(F.sum("words").alias("n")).collect()
    assert max(r.n for r in slots) <= 16 and sum(r.n for r in slots) == sum(taken.values())
    again = {r.doc_id: r.taken for r in mixing.mixture(frame(spark, rows[::-1]).repartition(3), block=16)[0].collect()}
    assert again == {i: r.taken for i, r in got.items()}
    assert mixing.mixture(frame(spark, []))[0].count() == 0 and mixing.mix_documents(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mixture(frame(spark, [(1, None, None), (2, "", "a")]))[0].collect()] == [0, 0]


def test_mix_documents(spark):
    rows = corpus(8, 100)
    mixed = mixing.mix_documents(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns
    words, sizes, longest = Counter(), Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
        longest[s] = max(longest[s], len(WORD.findall(t or "")))
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    for s, t in targets(sizes).items():
        assert abs(words[s] - t) <= longest[s] / 2 + 1


def test_token_records(spark):
    from tokenizers import Tokenizer

    rows = [*corpus(9, 50), (700, "a<|endoftext|> b  \n c\x1c d e f \n  g", "s"), (701, "x\n\n y\t\n z  ", "s"), (None, "gone", "s")]
    out = cluster.scratch(spark, "records")
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_records.write_token_records(frame(spark, rows).repartition(5), out, path)
    t, start, want = Tokenizer.from_file(path), 0, {}
    for i, text, _ in sorted(r for r in rows if r[0] is not None):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] = start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    got = token_records.token_record_digest(spark, out).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    one = token_records.read_token_records(spark, out, spark.read.parquet(out + "/index").where("doc_id = 700")).collect()
    assert one[0].ids == [*t.encode(rows[-3][1], add_special_tokens=False).ids, 2]
    empty = cluster.scratch(spark, "records")
    assert token_records.write_token_records(frame(spark, []), empty, path).count() == 0
    assert token_records.token_record_digest(spark, empty).count() == 0


def test_record_frames():
    record = token_records.frame(b"abc")
    assert token_records.unframe(record) == b"abc"
    for i in range(len(record)):
        with pytest.raises(ValueError):
            token_records.unframe(record[:i] + bytes([record[i] ^ 1]) + record[i + 1 :])
    with pytest.raises(ValueError):
        token_records.unframe(record[:5])


@pytest.mark.parametrize("chunk, overlap", [(32768, 1024), (64, 24), (40, 8)])
def test_bpe(spark, chunk, overlap):
    rows = [*corpus(10, 40), (700, "a\x1c d e f \n  g 'll don't 12345" * 9, "s"), (701, "x\n\n y\t\n z  " * 30, "s"), (702, " " * 400, "s"), (703, "!" * 90 + "\n" * 200 + "end", "s"), (704, "日本語" * 60, "s"), (703, "!" * 90 + "\n" * 200 + "end", "s"), (None, "gone", "s")]
    enc = bpe.encoder(RANKS, public_tokenizers.PATTERN)[1]
    want = []
    for i, t, _ in rows:
        if i is not None:
            ids = enc.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.bpe_digest(frame(spark, rows), RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert bpe.bpe_digest(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, 64))
    rows = [c + rng.standard_normal(64) * s for c in centres for s in (0.0, 0.1, 0.2, 0.3, 0.35)]
    rows += [rows[0]] * 30 + list(rows[5] + rng.standard_normal((80, 64)) * 0.02)
    data = [(i, [float(x) for x in r.astype(np.float32)]) for i, r in enumerate(rows)]
    return data + [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [1.0] * 8), (1004, [2.0] * 8), (1005, []), (1006, [None] + [1.0] * 63), (1007, [float("inf")] + [0.0] * 63)]


@pytest.mark.parametrize("block", [512, 20])
def test_embedding_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "FILTER_ROWS", block)
    monkeypatch.setattr(embedding_dedup, "GROUP_ROWS", block)
    data = vectors()
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("v", T.IntegerType())])
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame([(i, v, 0) for i, v in [*data, (None, [1.0] * 64)]], schema)).collect()}
    assert len(got) == len(data)
    x = np.array([v for _, v in data[: len(data) - 8]], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= close.sum(axis=1)).all() and n.sum() >= 0.97 * close.sum()
    want = components(range(len(x)), zip(*np.nonzero(close), strict=True))
    assert np.mean([got[i].component_id == want[i] for i in range(len(x))]) > 0.97
    assert [got[i].n_links for i in range(1000, 1008)] == [0, 0, 0, 1, 1, 0, 0, 0]
    assert [got[i].kept for i in range(1000, 1008)] == [True, True, True, True, False, True, True, True]
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], schema)).count() == 0


def labelled(seed=0, n=600):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic, good = rng.random() < 0.15, rng.random() < (0.9 if i % 4 else 0.4)
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vile", "Rotten,", "nasty!"])
        if not good:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), f"src{i % 4}"))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled()
    known = spark.createDataFrame([*labels[:400], (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [*rows, (700, None, "s"), (701, "", "s"), (None, "vile rotten nasty", "s")])
    got = toxicity.toxicity(docs, known, ["quality", "toxic"], decide_by="toxic")
    assert got.columns == [*docs.columns, "p_quality", "p_toxic", "toxic"]
    by = {r.doc_id: r for r in got.collect()}
    held_out = labels[400:]
    assert np.mean([by[i].toxic == bool(t) for i, _, t in held_out]) > 0.97
    assert np.mean([(by[i].p_quality > 0.5) == bool(q) for i, q, _ in held_out]) > 0.95
    assert not by[700].toxic and not by[701].toxic
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, none, ["quality", "toxic"], decide_by="toxic").where("toxic").count() == 0
    assert toxicity.toxicity(frame(spark, []), known, ["quality", "toxic"], decide_by="toxic").count() == 0


def test_quality(spark):
    rows, labels = labelled(1)
    known = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    docs = frame(spark, [*rows, (700, None, None), (701, "", "src0"), (None, "x", "s")])
    site = {"host": F.col("source"), "path": F.concat_ws("/", "source", "lang")}
    by = {r.doc_id: r for r in quality.quality(docs, known, **site).collect()}
    assert len(by) == len(rows) + 2
    assert np.mean([by[i].keep == bool(q) for i, q, _ in labels[400:]]) > 0.95
    # hosts of more bad text are below the others, and all scores are probabilities
    assert np.mean([by[i].host_score for i in range(0, 600, 4)]) < np.mean([by[i].host_score for i in range(1, 600, 4)]) - 0.2
    assert all(0 <= x <= 1 for r in by.values() for x in (r.doc_score, r.host_score, r.path_score, r.score))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, none, **site).count() == len(by)
    assert quality.quality(frame(spark, []), known, **site).count() == 0


def test_site_posteriors_by_hand(spark):
    rows = [("a", "a/x", 0.9), ("a", "a/x", 0.7), ("a", "a/y", 0.2), ("b", "b/x", 0.5)]
    sites, mean, host_strength, path_strength = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    assert mean == pytest.approx(0.575)
    spread = ((0.6 - 0.575) ** 2 + (0.5 - 0.575) ** 2) / 2
    inside = 0.575 * 0.425
    assert host_strength == pytest.approx(min(max(inside / max(spread - inside * (1 / 3 + 1) / 2, 1e-9) - 1, 2), 1000))
    assert {(r.path, r.path_n, r.host_n) for r in sites.collect()} == {("a/x", 2, 3), ("a/y", 1, 3), ("b/x", 1, 1)}


def test_pieces_have_the_ids_of_the_whole_text():
    from terrasift.llm.token_records import _encoder
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    whole, (pieces, _) = Tokenizer.from_file(file), _encoder(file, 2)
    texts = ["", "x", " ", "\n", "\n\n", "it's O'Brien's, I'll. a\n b \n\n c", "foo\r\nbar", "a.\nb", "word,\n\n next", "é à naïve, Ça; ÿ!", "a1b2 c3,d", "ab!? c", "a:\n b", "a\x1cb", "'s 't", "x 's\n's a", "z" * 100 + " " + "z" * 100]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in [*texts, " ".join(texts)]]
    assert list(pieces.encode([*texts, " ".join(texts)])) == want
    assert list(pieces.encode([*texts, " ".join(texts)])) == want
    assert all(len(p) <= 64 for p in pieces)


def test_random_texts_have_the_ids_of_both_libraries():
    import random

    from terrasift.llm.bpe import encoder
    from terrasift.llm.token_records import _encoder
    from tokenizers import Tokenizer

    blanks = [" ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", *map(chr, (0x85, 0xA0, 0x1680, 0x180E, 0x2003, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000, 0xFEFF))]
    others = ["a", "Zed", "é", "×", "÷", "ß", "ж", "中文", "、", "é", "😀", "’", "…", "1", "½", ".", ",", "&&&", "-", "_", '"', "'", "'ll", "<|endoftext|>", "|", "\x00", "\x7f"]
    r = random.Random(5)
    texts = ["".join(r.choice(blanks + others) for _ in range(r.randrange(30))) for _ in range(5000)]
    file = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(file).encode_batch(texts, add_special_tokens=False)
    assert list(_encoder(file, 2)[0].encode(texts)) == [np.array(x.ids, "<u2").tobytes() for x in whole]
    pieces, enc = encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert list(pieces.encode(texts)) == [np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert list(pieces.encode([])) == [] and list(pieces.encode(["", ""])) == [b"", b""]


def test_bpe_of_a_text_of_many_chunks(spark):
    """20,000 chunks in one text, and their digest in about four times the time of 5,000: hashes go on from piece to piece."""
    import time

    said = corpus(9, 40)
    long = " ".join(t for _, t, _ in said if t)
    long = (long * (20_000 * 48 // len(long) + 1))[: 20_000 * 48]
    took = []
    for n in (5_000, 20_000):
        text, start = long[: n * 48], time.time()
        got = bpe.bpe_digest(frame(spark, [(1, text, None)]), RANKS, public_tokenizers.PATTERN, chunk=48, overlap=24).first()
        took.append(time.time() - start)
        assert got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    want = bpe.bpe_digest(frame(spark, [(1, long, None)]), RANKS, public_tokenizers.PATTERN).first()
    assert tuple(got) == tuple(want)
    assert took[1] < 8 * took[0] + 5


def test_mixing_slots_against_a_plain_schedule(spark):
    """Each source's blocks lie at the slots whose golden points fall into its stretch, in order, those beyond at the end."""
    rng = random.Random(13)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "c", None])) for i in range(120)]
    got = {r.doc_id: r for r in mixing.mixture(frame(spark, rows), block=16)[0].collect()}
    pieces = [tuple(r) for r in mixing.mixture(frame(spark, rows), block=16)[1].collect()]
    target = {}
    for i, _, s in rows:
        target[s] = got[i].target
    names = sorted([s for s in target if s is not None]) + [None]
    total = sum(target.values())
    n_slots, up, stretch = -(-int(np.ceil(total)) // 16) if total == int(total) else int(-(-total // 16)), 0.0, []
    for s in names:
        stretch.append((up / total, (up + target[s]) / total))
        up += target[s]
    golden = (5**0.5 - 1) / 2
    slots = {s: [] for s in names}
    for k in range(n_slots):
        u = k * golden % 1.0
        for s, (lo, hi) in zip(names, stretch, strict=True):
            if lo <= u < hi:
                slots[s].append(k)
    source = {i: s for i, _, s in rows}
    used = {s: sorted({p[0] for p in pieces if source[p[1]] == s}) for s in names}
    for place, s in enumerate(names):
        need = -(-int(target[s]) // 16)
        own = slots[s][:need]
        assert used[s][: len(own)] == own and all(k >= n_slots for k in used[s][len(own) :]) and len(used[s]) == (need if need <= len(own) else len(used[s])), place
    for i, _, _ in rows:
        own = [p for p in pieces if p[1] == i]
        at = sorted({p[0] for p in own})
        assert (got[i].first_slot, got[i].last_slot, got[i].n_blocks) == ((at[0], at[-1], len(at)) if at else (None, None, 0))
        assert got[i].taken == sum(p[3] for p in own)


def test_another_schedule_changes_the_result(spark, monkeypatch):
    rows = [(i, "w " * (5 + i % 7), "ab"[i % 2]) for i in range(60)]
    slots = lambda: sorted((r.doc_id, r.first_slot, r.last_slot) for r in mixing.mixture(frame(spark, rows), block=16)[0].collect())
    before = slots()
    monkeypatch.setattr(mixing, "_GOLDEN", 0.123456)
    assert slots() != before
