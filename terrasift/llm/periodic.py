"""Periodic runs of words, found by aligned power-of-two blocks that occur again at a distance of their scale."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run holds its period that often, and has that many words.
TIMES, LEAST = 4, 6
#: Words whose documents a task looks at together.
_WORDS = 1 << 19
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _same(w: np.ndarray, a: int, b: int) -> int:
    """How many words from a on equal those from b on (a < b), looked at in stretches that double."""
    n, step, done = len(w) - b, 64, 0
    while done < n:
        k = min(step, n - done)
        differ = w[a + done : a + done + k] != w[b + done : b + done + k]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + k, step * 2
    return n


def _same_before(w: np.ndarray, a: int, b: int) -> int:
    """How many words before a equal those before b (a < b)."""
    step, done = 64, 0
    while done < a:
        k = min(step, a - done)
        differ = (w[a - done - k : a - done] != w[b - done - k : b - done])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + k, step * 2
    return a


def _block_seeds(w: np.ndarray, s: int, blocks: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """(start of a block, distance) for each occurrence of an aligned block of s words at a distance of s to 2 * s - 1 after it.

    All blocks of a scale are keys of one automaton over word numbers. An occurrence is that
    far behind just one aligned position, so it gives one seed at most.
    """
    keys: dict[tuple[int, ...], int] = {}
    key_of = {}
    for b in blocks.tolist():
        key_of[b] = keys.setdefault(tuple(w[b : b + s].tolist()), len(keys))
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for key, value in keys.items():
        machine.add_word(key, value)
    machine.make_automaton()
    for end, key in machine.iter(tuple(w[lo:hi].tolist())):
        at = lo + end - s + 1
        b = (at - s) // s * s
        if key_of.get(b) == key:
            yield b, at - b


def runs_of(w: np.ndarray, places: dict[int, list[tuple[int, int]]], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the words w, by start, then period.

    places: for each scale s (a power of two), the stretches in which a run with a period of s to
    2 * s - 1 may start. Such a run holds an aligned block of s words that occurs again one period
    later; from there it is extended both ways, word by word. Seeds within a stretch that has a
    smaller period are left alone, as their distance is a multiple of it.
    """
    n, found = len(w), []
    cover = np.zeros(n + 1, np.int64)  # the end of the farthest stretch with a smaller period over a word
    for s in sorted(places):
        fresh = []
        until: dict[int, int] = {}  # by distance: the end of the last stretch
        for lo, hi in places[s]:
            blocks = np.arange(-(-lo // s) * s, hi - s + 1, s)
            blocks = blocks[cover[blocks] < blocks + 3 * s - 1]
            if not len(blocks):
                continue
            for b, d in _block_seeds(w, s, blocks, int(blocks[0]), min(int(blocks[-1]) + 3 * s, n)):
                if b + d + s <= max(cover[b], until.get(d, 0)):
                    continue
                start = b - _same_before(w, b, b + d)
                end = b + d + _same(w, b, b + d)
                until[d] = end
                if end - start >= 2 * d:
                    fresh.append((start, end))
                if end - start >= max(least, times * d):
                    found.append((start, end - start, d))
        for start, end in fresh:
            cover[start:end] = np.maximum(cover[start:end], end)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _places(w: np.ndarray, offsets: np.ndarray, times: int, least: int) -> dict[int, dict[int, list[tuple[int, int]]]]:
    """For documents whose word numbers differ, one after another: those that may hold runs, with their places by scale.

    In a run of period q all words but the last q occur again within q words. So it is only looked
    for where enough consecutive words do so; a word that doesn't come again soon parts two places.
    """
    again = np.full(len(w), len(w) + 1, np.int64)
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    out: dict[int, dict[int, list[tuple[int, int]]]] = {}
    longest = int(np.diff(offsets).max(initial=0))
    s = 1
    while times * s <= longest:
        parts = np.concatenate([[-1], np.flatnonzero(again >= 2 * s)])  # a document's last word is always one
        wide = np.flatnonzero(np.diff(parts) > max(least - 2 * s + 1, (times - 1) * s))
        for lo, hi in zip((parts[wide] + 1).tolist(), parts[wide + 1].tolist(), strict=True):
            d = int(np.searchsorted(offsets, lo, "right")) - 1
            base = int(offsets[d])
            out.setdefault(d, {}).setdefault(s, []).append((lo - base, hi - base))
        s *= 2
    return out


def _find(batches: Iterator[pa.RecordBatch], times: int, least: int) -> Iterator[pa.RecordBatch]:
    def result(docs: list[tuple[int, list[bytes]]], w: list[int]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(words) for _, words in docs])])
        numbers = np.array(w, np.int64)
        places = _places(numbers, offsets, times, least)
        runs, texts = [], []
        for i, (_, words) in enumerate(docs):
            own = runs_of(numbers[offsets[i] : offsets[i + 1]] - offsets[i], places[i], times, least) if i in places else []
            if own:
                gone = np.zeros(len(words), bool)
                for start, length, period in own:
                    gone[start + period : start + length] = True
                words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
            runs.append([{"start": a, "length": b, "period": c} for a, b, c in own])
            texts.append(b" ".join(words).decode())
        n = pa.array(np.diff(offsets), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), n, pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.large_string())], ["doc_id", "n_words", "runs", "collapsed"])

    docs: list[tuple[int, list[bytes]]] = []
    w: list[int] = []
    for batch in batches:
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            words = text.as_py().encode().split()  # bytes are split at 0x20 and 0x09 to 0x0D
            number: dict[bytes, int] = {}
            base = len(w)
            docs.append((doc.as_py(), words))
            w += [base + number.setdefault(x, len(number)) for x in words]
            if len(w) >= _WORDS or len(docs) >= 4096:
                yield result(docs, w)
                docs, w = [], []
    if docs:
        yield result(docs, w)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs, collapsed: one row for each row with an id.

    runs: start, length and period of each run, by start, then period. A run is a stretch of
    consecutive words in which words a period apart are the same, with the smallest such period,
    of at least times periods and least words, that no neighbouring word extends. collapsed: the
    words, with a space between them, without those that a run holds after its first period.

    Words are what lies between spaces and U+0009 to U+000D. Null text counts as empty: no words, no
    runs. Repeated ids are rows like others; empty tables give none; other columns aren't looked
    at, so they may have any names. A text is handled by one task, in memory and time about
    linear in its words (times the number of scales), however periodic it is.
    """
    if times < 4:
        raise ValueError("blocks are sure to meet in runs of four periods or more")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(lambda b: _find(b, times, least), schema)
