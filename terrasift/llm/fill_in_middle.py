"""Fill-in-middle: documents cut at two units, their parts put in another order between marks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line with its end, or what follows the last end.
LINES = r"[^\n]*\n|[^\n]+"
#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of the documents, in hundredths: those that are cut, and of these those with the suffix first.
CUT, SUFFIX_FIRST = 100, 50
SEED = 7
#: Rows and characters of texts that a task holds twice.
_ROWS, _CHARS = 256, 1 << 22


def ends(find, text: str, low: int, high: int) -> tuple[int, int]:
    """Where the units of those ranks end (rank 0: at the start), by one lazy walk over the matches."""
    matches, at, out = find(text), 0, []
    for steps in (low, high - low):
        if steps:
            at = next(islice(matches, steps - 1, None)).end()
        out.append(at)
    return out[0], out[1]


def _cut(batches: Iterator[pa.RecordBatch], pattern: str, marks: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    find, names = re.compile(pattern).finditer, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for b in batches:
        for doc, text, form, h1, h2 in zip(*(b[c] for c in ("doc_id", "text", "form", "h1", "h2")), strict=True):
            text, form = text.as_py(), form.as_py()
            n = sum(1 for _ in find(text))
            if form == "plain":
                rows.append((doc.as_py(), n, form, None, None, text))
            else:
                low, high = ends(find, text, *sorted((h1.as_py() % (n + 1), h2.as_py() % (n + 1))))
                prefix, middle, suffix = text[:low], text[low:high], text[high:]
                p, s, m = marks
                parts = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
                rows.append((doc.as_py(), n, form, low, high - low, "".join(parts)))
            held += len(text)
            if len(rows) >= _ROWS or held >= _CHARS:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


def draws(id_col: str, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 that follow from the seed and the decimal id alone."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    return [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = LINES, marks: tuple[str, str, str] = MARKS, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row for each row with an id.

    A text is cut into n units, the matches of pattern. Prefix and middle end after two drawn ranks
    of units. The form is plain (output is the text, the two lengths are null) for empty texts,
    texts that hold a mark, and those that the draw leaves out; else psm or spm, by the order of
    prefix, suffix and middle. Null text counts as empty. Draws follow from the seed and the id, so
    rows that share an id are drawn alike, each with its own text; reruns agree. Empty tables give
    none. Other columns aren't looked at, so they may have any names.

    The matches of a text are walked twice, lazily: once to count them and once to the two ranks.
    No list of units is made, so a text of any length takes the memory of its characters only.
    A pattern whose matches leave gaps puts each gap before the unit that follows it.
    """
    if len(set(marks)) < 3 or any(not m or m[0] in other[1:] for m in marks for other in marks):
        raise ValueError("three marks, whose first characters are nowhere else in them, so that each is found where it was put")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    h1, h2, h3, h4 = draws("doc_id", seed)
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= cut)
    rows = rows.select("doc_id", "text", F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm").alias("form"), h1.alias("h1"), h2.alias("h2"))
    return rows.mapInArrow(lambda b: _cut(b, pattern, marks), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of that form was made of. A cut text holds no mark, so each mark is there once."""
    p, s, m = marks
    front, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    first = lambda mark, other: F.substr(F.substring_index(front, other, 1), F.lit(len(mark) + 1))
    psm = F.concat(first(p, s), middle, F.substring_index(front, s, -1))
    spm = F.concat(F.substring_index(front, p, -1), middle, first(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
