"""Fingerprints, fill-in-middle and periodic runs against plain code, with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import pathlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.llm import fill_in_middle as fim
from terrasift.llm import fingerprint as fp
from terrasift.llm import periodic, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """rows: (doc_id, text); the other columns have names used inside the operators."""
    extra = "row long, side string, a int, b int, level int, `range` int, guest boolean, words string, form string, h1 long, runs int, k long, n int, `te.xt` string"
    return spark.createDataFrame([(i, t, 1, "x", 1, 1, 1, 1, True, "w", "f", 1, 1, 1, 1, "y") for i, t in rows], f"doc_id long, text string, {extra}")


ODD = [(9, None), (8, ""), (7, "\n\n"), (6, "one"), (5, "a\nb\na\n"), (5, "a\nb\na\n"), (5, "c"), (4, "é" * 7 + "\n" + "𝒳" * 6), (-3, "z\n" * 50), (2**62, "big\nid")]


@pytest.mark.parametrize("name", ["op11_document_fingerprints", "op12_fill_in_middle"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


# fingerprints


def near(a, b):
    a, b = ({x for x in t.split("\n") if x} for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def edits(rows):
    rows = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: (-r[0], r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), near(t, new), near(t, after)))
    return sorted(out)


@pytest.mark.parametrize("ranges", [2, 1 << 16])
def test_fingerprint_edits(spark, monkeypatch, ranges):
    rng = random.Random(3)
    lines = ["".join(rng.choices("abcé ", k=rng.randint(1, 9))) for _ in range(400)]
    rows = ODD + [(None, "no id")] + [(rng.randint(0, 10**6), "\n".join(rng.choices(lines, k=rng.randint(1, 40)))) for _ in range(150)]
    rows += [(100 + k, "\n".join(lines[:200 + k])) for k in range(3)] + [(k, rows[-1][1]) for k in (2000, 3000, 3001)]
    monkeypatch.setattr(fp, "RANGE_ROWS", 1)
    monkeypatch.setattr(fp, "MOST_RANGES", ranges)
    got = fp.fingerprint_edits(frame(spark, rows).repartition(3)).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == edits(rows)
    text = {i: t or "" for i, t in rows}
    prints = {}
    for r in got:
        if r.doc_id != 5:
            assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert prints[""] == "" and len(set(prints.values())) > 120


def test_two_levels_of_bounds(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 1)
    rows = [(7 * k, f"t{k}") for k in range(600)]
    got = {r.doc_id: r.next_text for r in fp.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {7 * k: f"t{(k - 1) % 600}" for k in range(600)}


def test_alone_and_empty(spark):
    one = fp.fingerprint_edits(frame(spark, [(1, "ab\ncd")])).first()
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(b"ab\nab").hexdigest())
    assert fp.fingerprint_edits(frame(spark, [])).collect() == []
    assert fp.fingerprint_edits(frame(spark, [(None, "x")])).collect() == []


def test_large_differences_are_retried(spark):
    """Thousands of digests on either side: many rounds, and still the exact numbers."""
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 60, 9000).tolist()
    pairs = [(0, "s", keys[:5000], keys[2000:]), (1, "s", keys[:30], keys[:30]), (2, "t", [], keys[:70]), (3, "s", keys[:1], []), (4, "s", [], [])]
    got = fp.differences(spark.createDataFrame(pairs, "row long, side string, a array<long>, b array<long>")).collect()
    assert {r.row: (r.more, r.less) for r in got} == {0: (2000, 4000), 1: (0, 0), 2: (0, 70), 3: (1, 0), 4: (0, 0)}


def test_a_block_that_cannot_be_peeled_says_so(spark):
    """Twice the same digests in one cell cancel, three times they don't: no peeling, so no wrong number."""
    three = F.array(*[F.lit(5).cast("long")] * 3)
    row = spark.range(1).select(fp.peel(fp.sketch(three, F.lit(0)), F.lit(0)).alias("p")).first()
    assert not row.p.done


def test_native(spark):
    plan = fp.likeness(spark.createDataFrame([(1, "s", [1], [2])], "row long, side string, a array<long>, b array<long>"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# fill in middle


def plain_cut(doc, text, cut=100):
    text = text or ""
    h = hashlib.sha256(f"7:{doc}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(fim.LINES, text)
    n = len(units)
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= cut:
        return (doc, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return (doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("cut", [100, 40])
def test_fill_in_middle(spark, cut):
    rng = random.Random(5)
    rows = ODD + [(20, "has <M> in it"), (21, "<P"), (22, ">\n<S"), (23, "é\r\n x\n\n")] + [(k, "".join(rng.choices("<PSM>\né x", k=rng.randint(0, 60)))) for k in range(100, 500)]
    rows.append((600, "line é\n" * 100_000))
    done = fim.fill_in_middle(frame(spark, [*rows, (None, "x")]), cut=cut)
    got = done.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(repr(plain_cut(i, t, cut)) for i, t in rows)
    text = sorted((i, t or "") for i, t in rows)
    assert sorted((r.doc_id, r.back) for r in got) == text
    forms = {r.form for r in got}
    assert forms == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(frame(spark, [])).collect() == []


def test_other_units_and_marks(spark):
    rows = [(k, f"a1 b22 c333 d{k}") for k in range(30)]
    marks = ("[pre]", "[suf]", "[mid]")
    done = fim.fill_in_middle(frame(spark, rows), pattern=r"\w+", marks=marks)
    got = done.withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {(r.doc_id, r.back) for r in got} == set(rows) and {r.n for r in got} == {4}
    with pytest.raises(ValueError):
        fim.fill_in_middle(frame(spark, rows), marks=("aa", "ba", "c"))


def test_matches_are_walked_lazily():
    """Neither pass holds matches: of those handed out, no more than two are alive at a time."""
    alive = most = 0

    class Match:
        def __init__(self, end):
            nonlocal alive, most
            alive += 1
            most = max(most, alive)
            self.at = end

        def __del__(self):
            nonlocal alive
            alive -= 1

        def end(self):
            return self.at

    assert fim.ends(lambda _: (Match(k + 1) for k in range(1000)), "", 300, 900) == (300, 900)
    assert most <= 3
    assert fim.ends(lambda _: iter(()), "", 0, 0) == (0, 0)


# periodic runs


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc, text, plant=True):
    w = WORD.findall(text or "")
    n = len(w)
    if plant:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    top = min(((-length, s, q) for s, length, q in runs), default=None)
    four = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def repeats(seed, n):
    """Texts of few words, with planted periods, periods within periods, near misses and runs side by side."""
    rng = random.Random(seed)
    for _ in range(n):
        letters = "abcdefghij"[: rng.choice([1, 2, 3, 10])]
        w = []
        while len(w) < rng.randint(0, 150):
            kind = rng.randint(0, 3)
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
            if kind == 0:
                unit = (unit[:2] * 3 + unit[:1]) * 2
            part = unit * rng.randint(1, 7)
            w += part[: len(part) - rng.randint(0, len(unit))] if kind else part
            if kind == 3 and w:
                w[rng.randrange(len(w))] = "!"
        yield " ".join(w)


def test_runs_against_all_periods(spark):
    rows = list(enumerate(repeats(1, 400))) + [(1000, None), (1001, ""), (1002, "\x0b \x0c"), (1003, "x x " * 9), (1003, "x x " * 9), (1004, "a " * 6), (1005, "a " * 5), (1006, "a b " * 4), (1007, "a b " * 3 + "a")]
    got = periodic.periodic_runs(frame(spark, [*rows, (None, "a " * 9)])).collect()
    want = {i: plain_runs(WORD.findall(t or "")) for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(x) for x in r.runs] == want[r.doc_id], (r.doc_id, dict(rows)[r.doc_id])
        w = WORD.findall(dict(rows)[r.doc_id] or "")
        gone = {k for s, length, q in want[r.doc_id] for k in range(s + q, s + length)}
        assert r.collapsed == " ".join(x for k, x in enumerate(w) if k not in gone) and r.n_words == len(w)
    assert sum(map(len, want.values())) > 300
    assert periodic.periodic_runs(frame(spark, [])).collect() == []


def test_query_of_runs(spark):
    docs = duckdb.sql(f"select doc_id, text from read_parquet('{SF}/documents.parquet')").fetchall()
    got = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in queries.op13_periodic_runs(spark, SF).collect()]
    want = [plain_digest(i, t) for i, t in docs if len(t or "") < 20_000]
    assert set(want) <= set(got) and len(got) == len(docs)
    assert sum(x[1] > 0 for x in want) > 5


def test_planting(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(repeats(2, 300))] + [(1000 + k, None) for k in range(40)]
    (tmp_path / "t").mkdir()
    frame(spark, rows).select("doc_id", "text").write.parquet(f"file://{tmp_path}/t/documents.parquet")
    got = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in queries.op13_periodic_runs(spark, f"{pathlib.Path(tmp_path)}/t").collect()]
    assert sorted(got, key=str) == sorted((plain_digest(i, t) for i, t in rows), key=str)


def test_long_runs_take_linear_work(monkeypatch):
    """A word, a pair and a square of pairs, very often: few extensions, and few keyed blocks."""
    calls = []
    keep = periodic._same
    monkeypatch.setattr(periodic, "_same", lambda w, a, b: calls.append(1) or keep(w, a, b))
    for unit in ([0], [0, 1], [0, 1, 2, 0, 1, 3] * 3):
        q = len(unit) // (3 if len(unit) > 2 else 1)
        w = np.array(unit * (200_000 // len(unit)) + [9])
        n = len(w) - 1
        places = periodic._places(w, np.array([0, len(w)]), 4, 6)
        assert periodic.runs_of(w, places[0]) == [(0, n, q)]
    assert len(calls) < 500


def test_only_four_periods_or_more(spark):
    with pytest.raises(ValueError):
        periodic.periodic_runs(frame(spark, []), times=3)
    got = periodic.periodic_runs(frame(spark, [(1, "a b " * 5 + "c " * 7)]), times=5, least=8).first()
    assert [tuple(r) for r in got.runs] == [(0, 10, 2)]
