"""Counts over the characters and words of many texts at once.

A batch of texts becomes one array of code points; a table gives each its classes, and every count is a sum over
positions. The rules are those of the patterns named with them. A slice of texts holds about ``SLICE`` bytes, or one text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from modlens.functions import patterns as P

SLICE = 1 << 20
SPACE, END, PUNCT, UPPER, DIGIT, VOWEL = (1 << i for i in range(6))
SPACES = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85"
VOWELS = "aeiouy" + "".join(map(chr, (*range(0xE0, 0xE7), *range(0xE8, 0xF0), *range(0xF2, 0xF7), *range(0xF9, 0xFE))))


@cache
def classes() -> np.ndarray:
    """The classes of every code point, as bits: ``P.SPACE``, ``P.SENTENCE_END``, ``P.PUNCT``, Lu, Nd, ``P.VOWELS``."""
    kinds = [unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)]
    bit = {"Zs": SPACE, "Zl": SPACE, "Zp": SPACE, "Lu": UPPER, "Nd": DIGIT}
    table = np.array([bit.get(k, 0) for k in kinds], dtype=np.uint8)
    for chars, flag in ((SPACES, SPACE), (".!?", END), (P.PUNCT_CHARS, PUNCT), (VOWELS, VOWEL)):
        table[[ord(c) for c in chars]] |= flag
    return table


def slices(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Runs of rows of about ``SLICE`` bytes in the first column."""
    size = np.cumsum(pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(size):
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + SLICE, side="right")))
        yield tuple(c.slice(start, end - start) for c in columns)
        start = end


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, one after another, and where each text ends."""
    rows = [b.decode("utf-8", "replace") for b in texts.cast(pa.binary()).to_pylist()]
    ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
    return np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), ends


def per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flagged positions of each text."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return np.diff(total[np.concatenate(([0], ends))])


def firsts(ends: np.ndarray, n: int) -> np.ndarray:
    """Flags of the first position of each text that is not empty."""
    first = np.zeros(n + 1, dtype=bool)
    first[0] = True
    first[ends] = True
    return first[:n]


def after(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the position before, in the same text, is flagged; false at the first one."""
    out = np.zeros(len(flags), dtype=bool)
    out[1:] = flags[:-1]
    return out & ~first


def counted(columns: list[pa.Array], count: Callable, names: list[str]) -> pa.StructArray:
    """``count`` of each slice of the columns, as a struct of longs."""
    parts = [count(*s) for s in slices(*columns)]
    fields = [np.concatenate(f) if parts else np.zeros(0, np.int64) for f in (zip(*parts, strict=True) if parts else [()] * len(names))]
    return pa.StructArray.from_arrays([pa.array(f.astype(np.int64)) for f in fields], names)


def lexical_counts(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Sentence ends, punctuation, upper-case letters and digits of each text."""
    c, ends = code_points(texts)
    kind = classes()[c]
    end = kind & END > 0
    marks = end & ~after(end, firsts(ends, len(c)))
    return tuple(per_text(f, ends) for f in (marks, kind & PUNCT > 0, kind & UPPER > 0, kind & DIGIT > 0))


def word_counts(tokens: pa.Array) -> tuple[np.ndarray, ...]:
    """Tokens of letters only (``P.LETTERS``) of each list: their number, the distinct ones, their characters."""
    encoded = tokens.flatten().dictionary_encode()
    words = encoded.dictionary.to_pylist()
    letters = np.array([w.isalpha() for w in words], dtype=bool)
    length = np.array([len(w) for w in words], dtype=np.int64)
    word = encoded.indices.to_numpy(zero_copy_only=False)
    sizes = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    kept = letters[word] if len(words) else np.zeros(0, bool)
    doc, word = doc[kept], word[kept].astype(np.int64)
    distinct = np.unique(doc * max(len(words), 1) + word) // max(len(words), 1)
    counts = np.bincount(doc, minlength=len(sizes)), np.bincount(distinct, minlength=len(sizes))
    return *counts, np.bincount(doc, length[word] if len(words) else None, minlength=len(sizes)).astype(np.int64)


def sentence_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sentences (``P.SENTENCE``) of more than two words, and characters that are no spaces, of each text."""
    c, ends = code_points(texts)
    kind, first = classes()[c], firsts(ends, len(c))
    space, end = kind & SPACE > 0, kind & END > 0
    # What stands before the first sentence are marks without a space: one word, so it is never counted.
    start = first | (~end & after(end, first))
    word = ~space & (start | after(space, first))
    sentence = np.cumsum(start) - 1
    long = np.zeros(len(c), dtype=bool)
    long[np.flatnonzero(start)[np.bincount(sentence[word], minlength=int(start.sum())) > 2]] = True
    return per_text(long, ends), per_text(~space, ends)


def syllable_counts(lowered: pa.Array) -> tuple[np.ndarray, ...]:
    """Words of each text without its punctuation, their characters, their syllables, and words of three or more."""
    c, ends = code_points(lowered)
    kind = classes()[c]
    kept = kind & PUNCT == 0
    ends = np.cumsum(per_text(kept, ends))
    c, kind = c[kept], kind[kept]
    first, space = firsts(ends, len(c)), kind & SPACE > 0
    start = ~space & (first | after(space, first))
    words, letters = per_text(start, ends), per_text(~space, ends)
    c, vowel, start = c[~space], (kind & VOWEL > 0)[~space], start[~space]
    last = np.concatenate((start[1:], [True]))[: len(c)]

    def follows(excluded: str) -> np.ndarray:
        """After a character of the same word that is no vowel and not among these."""
        return after(~vowel & ~np.isin(c, [ord(x) for x in excluded]), start)

    # ``P.SILENT``: a final e, ed or es.
    e = c == ord("e")
    silent = e & last & follows("l")
    for final, excluded in (("d", "td"), ("s", "szxchg")):
        closes = (c == ord(final)) & last & ~start
        silent[:-1] |= closes[1:] & e[:-1] & follows(excluded)[:-1]
    group = vowel & ~silent & ~after(vowel, start)
    at = np.flatnonzero(start)
    groups = np.add.reduceat(group, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
    word_ends = np.cumsum(words)
    syllables = np.concatenate(([0], np.cumsum(np.maximum(groups, 1))))
    return words, letters, np.diff(syllables[np.concatenate(([0], word_ends))]), per_text(groups >= 3, word_ends)
