"""Histograms and statistics of documents, computed for a slice of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import buffers, hash_of, word_hashes

#: Classes of characters: ASCII by kind, the others by script. A multi-byte character counts once, by its first byte.
CLASSES = ("lower", "upper", "digit", "blank", "mark", "symbol", "latin", "greek_cyrillic", "semitic", "indic", "kana", "han", "hangul", "other")
MARKS = ".,;:'\"!?()-"

#: Common words of four languages.
COMMON = {
    "en": "the of and to a in is it that was for on are with as be by this from at or an which not have but had he they you",
    "de": "der die das und in zu den von mit ist des im für auf ein eine nicht als auch es an werden aus er hat dass sie nach wird bei",
    "fr": "de la le et les des en un une du que est pour qui dans par sur au pas plus ne se il ce avec ou son aux être elle",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
}

_TABLE = np.full(256, CLASSES.index("other"), np.int64)
_TABLE[33:127] = 5
_TABLE[[*range(97, 123)]] = 0
_TABLE[[*range(65, 91)]] = 1
_TABLE[[*range(48, 58)]] = 2
_TABLE[[9, 10, 11, 12, 13, 32]] = 3
_TABLE[[ord(x) for x in MARKS]] = 4
for _name, _first, _last in (("symbol", 0xC2, 0xC2), ("latin", 0xC3, 0xCC), ("greek_cyrillic", 0xCD, 0xD4), ("semitic", 0xD6, 0xDF), ("indic", 0xE0, 0xE0), ("symbol", 0xE2, 0xE2), ("kana", 0xE3, 0xE3), ("han", 0xE4, 0xE9), ("hangul", 0xEA, 0xED)):
    _TABLE[_first : _last + 1] = CLASSES.index(_name)
_TABLE[128:192] = len(CLASSES)  # within a character


def class_counts(texts: pa.Array) -> np.ndarray:
    """Characters of each class, a row for each text."""
    data, offsets = buffers(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    width = len(CLASSES) + 1
    return np.bincount(row * width + _TABLE[data], minlength=width * len(texts)).reshape(-1, width)[:, :-1]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes() of the lower-cased texts."""
    return word_hashes(*buffers(pc.utf8_lower(texts)))


_COMMON: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def common_words(lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the language's common words, and each one's place in the list."""
    if lang not in _COMMON:
        h = np.array([hash_of(w) for w in COMMON.get(lang, "").split()], np.uint64)
        _COMMON[lang] = (np.sort(h), np.argsort(h))
    return _COMMON[lang]


def word_counts(found: tuple[np.ndarray, np.ndarray, np.ndarray], langs: list[str], learned: dict[str, list[int]] | None = None) -> np.ndarray:
    """Occurrences of each common word of the text's language, then those of all other words; a row for each text.

    learned: hashes of the common words of languages that COMMON doesn't have, 30 at most.
    """
    h, row, _ = found
    out = np.zeros((len(langs), 31), np.int64)
    of = np.array(langs, object)
    for lang in {*langs}:
        keys, place = common_words(lang)
        if not len(keys) and learned and learned.get(lang):
            keys = np.array(learned[lang], np.int64).view(np.uint64)
            place = np.argsort(keys)
            keys = keys[place]
        mine = (of == lang)[row]
        w, r = h[mine], row[mine]
        at = np.full(len(w), 30)
        if len(keys):
            i = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
            at = np.where(keys[i] == w, place[i], 30)
        out += np.bincount(r * 31 + at, minlength=31 * len(langs)).reshape(-1, 31)
    return out


FEATURES = (*(f"share_{c}" for c in CLASSES), "log_chars", "log_words", "word_bytes", "unique_words", "top_word", "same_as_last", "common_words", "lines", "words_a_line", "marks_a_word", "symbols_a_word")


def features(texts: pa.Array, langs: list[str]) -> np.ndarray:
    """The classifier's document statistics, a row for each text; empty texts have zeros."""
    n, classes, found = len(texts), class_counts(texts), words(texts)
    h, row, size = found
    chars, count = np.maximum(classes.sum(1), 1), np.bincount(row, minlength=n)
    some = np.maximum(count, 1)
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    begins = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, rs[begins], np.diff(begins, append=len(hs)))
    last = np.zeros(len(h), bool)
    last[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    lines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False) + 1
    usual = count - word_counts(found, langs)[:, 30]
    return np.column_stack([
        classes / chars[:, None], np.log1p(classes.sum(1)), np.log1p(count), np.bincount(row, size, minlength=n) / some, np.bincount(rs[begins], minlength=n) / some,
        top / some, np.bincount(row[last], minlength=n) / some, usual / some, np.log1p(lines), count / lines, classes[:, 4] / some, classes[:, 5] / some,
    ])
