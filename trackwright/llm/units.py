"""Cutting texts into small units whose tokens do not depend on what stands around them.

Both tokenizers here never let a token reach from a letter to a following non-letter, or from a non-space to a following space.
A text can therefore be cut there, and the ids of units that come again are taken from a cache instead of being computed again.
The cut is only made where it is certain: in texts of Latin-1 characters with no white space other than space and line feed.
Others take the tokenizer's plain way. Texts are cut, and equal units found, by Arrow's functions for a whole slice of texts, so
that Python sees each distinct unit of a slice once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters among the first 256 code points: fixed by Unicode.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
#: White space there, and separators that some libraries count as such; NUL marks the cuts.
_ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\0"

#: Characters handled at once in a task, and entries of the cache in a Python worker.
CHARS_AT_ONCE, CACHE_ENTRIES = 1_000_000, 150_000


def is_plain(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(c in text for c in _ODD)


def with_space(texts: pa.Array) -> pa.ListArray:
    """The units of plain texts, each with the white space before it."""
    cut = pc.replace_substring_regex(texts, f"([{LETTERS}])([^{LETTERS}])", "\\1\0\\2")
    return pc.split_pattern(pc.replace_substring_regex(cut, f"([^{LETTERS} \n\0])([ \n])", "\\1\0\\2"), "\0")


def without_space(texts: pa.Array) -> pa.ListArray:
    """The units of plain texts for a tokenizer to which all white space is alike; some are empty."""
    spaced = pc.replace_substring(texts, "\n", " ")
    return pc.split_pattern(pc.replace_substring_regex(spaced, f"([{LETTERS}])([^{LETTERS} ])", "\\1 \\2"), " ")


class Cache:
    """unit -> ids as little-endian unsigned 32-bit integers. When it is full, only what the last slice used stays."""

    def __init__(self, encode_new: Callable[[list[str]], Iterable[bytes]], limit: int = CACHE_ENTRIES):
        self.encode_new, self.limit, self.known = encode_new, limit, {}

    def _of(self, units: list[str]) -> list[bytes]:
        new = [u for u in units if u not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known = {u: self.known[u] for u in units if u in self.known}
        self.known.update(zip(new, self.encode_new(new), strict=True))
        return [self.known[u] for u in units]

    def ids(self, units: pa.ListArray) -> list[bytes]:
        """The ids of each text, given its units."""
        found = units.flatten().dictionary_encode()
        each = self._of(found.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(each), "<u4")
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        unit = found.indices.to_numpy()
        count = size[unit]
        end = np.cumsum(count)
        # Place i of the result takes the unit's first id, and as many more as i is past the unit's first place.
        ids = flat[np.repeat((np.cumsum(size) - size)[unit] - (end - count), count) + np.arange(end[-1] if len(end) else 0)]
        offsets = units.offsets.to_numpy()
        cuts = np.concatenate([[0], end])[offsets - offsets[0]].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encode_texts(
    texts: list[str], cut: Callable[[pa.Array], pa.ListArray], cache: Cache, whole: Callable[[list[str]], list[bytes]], plain: Callable[[str], bool] = is_plain
) -> list[bytes]:
    """The ids of each text: plain ones by their units, others by the tokenizer's plain way."""
    is_cut = list(map(plain, texts))
    some = [t for t, p in zip(texts, is_cut, strict=True) if p]
    by_units = iter(cache.ids(cut(pa.array(some, pa.string()))) if some else ())
    rest = iter(whole([t for t, p in zip(texts, is_cut, strict=True) if not p]))
    return [next(by_units if p else rest) for p in is_cut]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = CHARS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each slice holds about most bytes of column, and one row at least."""
    for batch in batches:
        first, size = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > first and size + n > most:
                yield batch.slice(first, i - first)
                first, size = i, 0
            size += n
        if batch.num_rows > first:
            yield batch.slice(first)
