"""Token ids of whole texts by a public tokenizer file, with a cache of the ids of words.

A text is cut at places where the tokenizer's own splitting always cuts: before a single space between two
non-space characters, and around a single line feed between them. Each such chunk is encoded once and
kept (little-endian unsigned 32-bit ids); a text with any other white space is encoded as one piece.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Most words kept, about 200 bytes each; a task ends by forgetting its words.
_CACHE = 600_000
#: What sends a text through the whole tokenizer: any Unicode white space but a blank or line feed, one of these beside another or at an end, and NUL.
_OTHER_SPACE = r"[\x00\t\x0B\x0C\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
#: Marks behind a word: every tokenizer here cuts between a letter and these.
_MARKS = ".,;:!?&%#$*|"
_LETTER = frozenset(c for c in map(chr, range(0x100)) if re.match("[A-Za-zÀ-ÖØ-öø-ÿ]", c))
#: One word of plain letters, with or without the space before it: the tokenizer's model takes it in one piece.
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


_BYTE_LETTERS = _byte_letters()


class Encoder:
    """encode() gives the ids of each text as little-endian unsigned 32-bit integers.

    spaced: the vocabulary keeps the space before a word (byte-level), so a chunk keeps its leading space; otherwise white space is dropped.
    """

    def __init__(self, path: str, spaced: bool):
        self.tokenizer, self.spaced, self.cache = Tokenizer.from_file(path), spaced, {}

    def _ids(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _chunks(self, texts: pa.Array) -> pa.ListArray:
        """The chunks of texts in which single blanks and line feeds, and nothing else, part words."""
        if not self.spaced:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 "), "\0")

    def _learn(self, fresh: set[str]) -> None:
        """Take words into the cache. Words of plain letters go to the tokenizer's model as they are, all else through the whole tokenizer."""
        cache, marked, plain = self.cache, [], set()
        for c in fresh:
            word = c.rstrip(_MARKS)
            if len(word) < len(c) and word and word[-1] in _LETTER:
                marked.append((c, word, c[len(word) :]))
                plain.update(x for x in marked[-1][1:] if x not in cache)
            else:
                plain.add(c)
        tokenize, odd = self.tokenizer.model.tokenize, []
        for c in plain:
            if _LETTERS.fullmatch(c):
                c_ = c if self.spaced else c.lower()
                letters = c_.replace(" ", _BYTE_LETTERS[0x20]) if c_.isascii() else c_.encode().decode("latin-1").translate(_BYTE_LETTERS)
                cache[c] = array("I", [t.id for t in tokenize(letters)]).tobytes()
            else:
                odd.append(c)
        for at in range(0, len(odd), 10_000):
            cache.update(zip(odd[at : at + 10_000], self._ids(odd[at : at + 10_000])))
        for c, word, marks in marked:
            cache[c] = cache[word] + cache[marks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Chunks are numbered and their ids gathered as whole arrays; only distinct chunks of the batch become Python objects."""
        whole = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(whole, _OTHER_SPACE).to_numpy(zero_copy_only=False)
        plain = ~odd & (pc.binary_length(whole).to_numpy(zero_copy_only=False) > 0)
        out = [b""] * len(texts)
        for i in np.flatnonzero(odd):  # one at a time: such a text may be long
            out[i] = self._ids([texts[i]])[0]
        if not plain.any():
            return out
        cache = self.cache
        if len(cache) > _CACHE:
            cache.clear()
        lists = self._chunks(whole.filter(pa.array(plain)))
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        self._learn(set(names).difference(cache))
        known = [cache[c] for c in names]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool, starts = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[at]
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = pool[np.repeat(starts[at] - ends[:-1], counts) + np.arange(ends[-1])]
        bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        for i, low, high in zip(np.flatnonzero(plain), bounds[:-1], bounds[1:]):
            out[i] = ids[low:high].tobytes()
        return out


_HELD: dict = {}


@contextmanager
def encoder(path: str, spaced: bool) -> Iterator[Encoder]:
    """One encoder for each Python worker and file; what it has learned goes at the end, so that a worker's memory does not grow from task to task."""
    held = _HELD.get((path, spaced)) or _HELD.setdefault((path, spaced), Encoder(path, spaced))
    try:
        yield held
    finally:
        held.cache.clear()
        pa.default_memory_pool().release_unused()
