"""Token ids of public tokenizers, by pieces, with a bounded cache of them.

The tokenizers library merges within the pieces that its pre-tokenizer cuts, so a text's ids are the ids of its
pieces, one after the other. Arrow cuts the texts before spaces that go with what follows, and around contractions and
punctuation, and numbers the different parts; each that isn't cached is cut on (letters from digits) by the same rule
written for Python's `re`, and encoded by the library's model. Texts with characters or white space that the two might
treat differently (separators, fractions and superscripts, all from U+0250 on, where combining marks begin, and runs
of white space other than one or two line ends) are encoded by the library as a whole, and so are texts that hold an
added token's string (such as a special token's), which the library takes out before it cuts.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.llm.base import strings

#: Parts that one worker keeps. When there are more, those of the texts at hand stay.
CACHE_PARTS = 600_000
#: Texts that go to the library whole: by their characters, and for the byte-level rule by their white space; added
#: tokens come to them.
_RARE = r"[\x1c-\x1f\x{85}\x{a0}²³¹¼½¾İ\x{250}-\x{10ffff}]"
_SPACED = r"\A\s|\n\n(\n|\z)|  |\n | \n| \z|[\t\r\x0b\x0c]"
#: The byte-level rule: a space goes with what follows it. The word rule: no white space, single digits.
_BYTE_LEVEL = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_WORD_LEVEL = re.compile(r"[^\W\d_]+|'(?:[stmd]|re|ve|ll)|\d|(?:[^\s\w]|_)+")
#: Contractions and punctuation; before and after them a piece ends. MARK stands between parts.
_MARK = "\x1f"
_PUNCTUATION = r"'(?:[stmd]|re|ve|ll)|{}[^\s\pL\pN]+"
_MADE: dict[tuple[str, str], PieceEncoder] = {}


def _byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class PieceEncoder:
    """encode(column) gives the ids of all its texts in one array of `dtype`, and how many each text has."""

    def __init__(self, path: str, dtype: str = "<u4") -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.dtype = np.dtype(dtype)
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.lower = self.lib.normalizer is not None
        self.split = _WORD_LEVEL if self.lower else _BYTE_LEVEL
        added = [re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values() if t.content]
        self.whole = "|".join([_RARE, *([] if self.lower else [_SPACED]), *(f"(?i:{t})" for t in added)])
        self.letters = _byte_letters()
        self.cache: dict[str, bytes] = {}

    @classmethod
    def shared(cls, path: str, dtype: str = "<u4") -> PieceEncoder:
        """One for each worker process."""
        if (path, dtype) not in _MADE:
            _MADE[path, dtype] = cls(path, dtype)
        return _MADE[path, dtype]

    def _part(self, part: str) -> bytes:
        pieces = [part] if part.isalpha() or part[:1] == " " and part[1:].isalpha() else self.split.findall(part)
        letters = [p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        return array(self.code, [t.id for x in letters for t in self.model.tokenize(x)]).tobytes()

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """Parts of each text; some are empty."""
        if self.lower:
            return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _PUNCTUATION.format(""), r" \0 "))
        apart = pc.replace_substring_regex(texts, _PUNCTUATION.format(" ?"), f"{_MARK}\\0{_MARK}")
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(apart, " ", _MARK + " "), "\n", f"{_MARK}\n{_MARK}"), _MARK)

    def _common(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = self._cut(texts)
        numbered = lists.flatten().dictionary_encode()
        names = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.cache.get, names))
        if None in found:
            new = [k for k, ids in enumerate(found) if ids is None]
            for k in new:
                found[k] = self._part(names[k])
            if len(self.cache) + len(new) > CACHE_PARTS:
                self.cache = dict(zip(names, found, strict=True))
            else:
                self.cache.update((names[k], found[k]) for k in new)
        wide = self.dtype.itemsize
        size = np.fromiter(map(len, found), np.int64, len(found)) // wide
        flat, begin = np.frombuffer(b"".join(found), self.dtype), np.cumsum(size) - size
        part = numbered.indices.to_numpy(zero_copy_only=False)
        n = size[part]
        ends = np.cumsum(n)
        ids = flat[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n - begin[part], n)]
        through = np.concatenate([[0], ends])[lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()]
        return ids, np.diff(through)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Null texts are empty."""
        texts = strings(texts)
        whole = pc.match_substring_regex(texts, self.whole)
        if not pc.any(whole).as_py():
            return self._common(texts)
        ids, n = self._common(texts.filter(pc.invert(whole)))
        common = iter(np.split(ids, np.cumsum(n)[:-1]))
        parts = [np.array(self.lib.encode(t.as_py(), add_special_tokens=False).ids, self.dtype) if w else next(common) for t, w in zip(texts, whole.to_pylist(), strict=True)]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def ended(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each text's."""
    return np.insert(ids, np.cumsum(n), end_id), n + 1


def blobs(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive stretches of data as a binary column, without a copy for each."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * data.itemsize
    if ends[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.array([data[a:b].tobytes() for a, b in zip(ends // data.itemsize, ends[1:] // data.itemsize, strict=False)], pa.binary())
