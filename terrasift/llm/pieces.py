"""Exact, cached tokenising for byte-level BPE vocabularies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .text import ragged, slices, utf8

#: Bytes of text whose pieces are looked up together; a longer row is one such slice.
PART_BYTES = 2 << 20
#: Words that don't fill a pre-token together with a line end.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]?")
#: Kinds of bytes: white space, what may stand before a cut at white space, letters, punctuation, beyond ASCII.
_SPACE, _SOLID, _LETTER, _MARK, _HIGH = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[0x21:0x7F] = _SOLID
_KIND[[*range(65, 91), *range(97, 123)]] |= _LETTER
#: All ASCII punctuation but the apostrophe, as in "it's", and what special tokens are written with.
_KIND[[ord(c) for c in '!"#$%&()*+,-./:;=?@[\\]^_`{}~']] |= _MARK
_KIND[0x80:] = _HIGH


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of rows of UTF-8 start.

    Every row starts one. So do white space after anything else, punctuation after a Latin letter, and a letter
    after a line end that stands alone. No pre-token of a byte-level BPE pattern spans such a place, and none looks
    back over it, so the tokens of the pieces are the text's.
    """
    kind = _KIND[data]
    at = np.zeros(len(data), bool)
    before, here = kind[:-1], kind[1:]
    at[1:] = ((here & _SPACE != 0) & (before & _SOLID != 0)) | ((here & _MARK != 0) & (before & _LETTER != 0))
    # after characters of several bytes: none after white space, and punctuation only after letters of Latin-1
    far = np.flatnonzero((before & _HIGH != 0) & (here & (_SPACE | _MARK) != 0)) + 1
    last, lead, third = data[far - 1], data[far - 2], data[np.maximum(far - 3, 0)]
    blank = (lead == 0xC2) & ((last == 0x85) | (last == 0xA0))
    blank |= (third == 0xE1) & (((lead == 0x9A) & (last == 0x80)) | ((lead == 0xA0) & (last == 0x8E)))
    blank |= (third == 0xE2) & (((lead == 0x80) & ((last <= 0x8B) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))) | ((lead == 0x81) & (last == 0x9F)))
    blank |= (third == 0xE3) & (lead == 0x80) & (last == 0x80)
    latin = (lead == 0xC3) & (last != 0x97) & (last != 0xB7)
    at[far] = np.where(kind[far] & _SPACE != 0, ~blank, latin)
    at[offsets[:-1][np.diff(offsets) > 0]] = True
    at[1:] |= at[:-1] & (data[:-1] == 10) & (here & _LETTER != 0)
    return np.flatnonzero(at)


class PieceEncoder(dict):
    """Maps pieces of text to their ids as bytes; holds about most_bytes of them.

    encode_many gives the ids of a list of pieces, each as width bytes. One encoder is kept in each worker process,
    so later tasks find the words of earlier ones.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], width: int, most_bytes: int = 160 << 20):
        super().__init__()
        self._encode_many, self._unit, self._most, self._held = encode_many, f"<u{width}", most_bytes, 0

    def encode(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """The ids of each text in turn."""
        for _, _, data, offsets in slices(*utf8(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts), PART_BYTES):
            starts = cuts(data, offsets) if len(data) else np.zeros(0, np.int64)
            ends = np.append(starts, len(data))
            pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
            flat, first, count = self._ids(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
            which = pieces.indices.to_numpy()
            ids = flat[ragged(first[which], count[which])]
            stops = np.concatenate([[0], np.cumsum(count[which])])[np.searchsorted(starts, offsets)]
            for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
                yield ids[a:b].tobytes()

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct pieces in one array, where each one's start, and how many there are."""
        if self._held > self._most:
            self.clear()
            self._held = 0
        found = list(map(self.get, pieces))
        at = [i for i, x in enumerate(found) if x is None]
        new = [pieces[i] for i in at]
        for i, piece, ids in zip(at, new, self._encode_many(new) if new else [], strict=True):
            found[i] = ids
            # words recur, long pieces hardly do
            if len(piece) <= 64:
                self[piece] = ids
                self._held += 200 + len(piece) + len(ids)
        flat = np.frombuffer(b"".join(found), self._unit)
        count = np.fromiter(map(len, found), np.int64, len(found)) // flat.itemsize
        return flat, np.cumsum(count) - count, count


def joined(encode: Callable[[str], np.ndarray], line_end: int) -> Callable[[list[str]], list[bytes]]:
    """encode_many by calls for a thousand words at a time: lines of one text, where line_end is the id of the line
    end between them. Only plain words, with or without one space before, go that way; no pre-token of them
    holds the line end. Other pieces are encoded on their own."""

    def many(pieces: list[str]) -> list[bytes]:
        out = [b""] * len(pieces)
        plain = []
        for i, p in enumerate(pieces):
            if _PLAIN.fullmatch(p):
                plain.append(i)
            else:
                out[i] = encode(p).tobytes()
        for lo in range(0, len(plain), 1000):
            part = plain[lo : lo + 1000]
            ids = encode("\n".join([pieces[i] for i in part]))
            width, data = ids.itemsize, ids.tobytes()
            start = 0
            for i, stop in zip(part, [*(np.flatnonzero(ids == line_end) * width).tolist(), len(data)], strict=True):
                out[i] = data[start:stop]
                start = stop + width
        return out

    return many
