"""Per-text counts used by the rules and by the quality classifier."""

from __future__ import annotations

import numpy as np

from . import textkit as tk

#: `[#*$%&|<>]`
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
UPPER, LOWERCASE, DIGIT, PUNCT = (np.zeros(256, dtype=bool) for _ in range(4))
UPPER[0x41:0x5B] = True
LOWERCASE[0x61:0x7B] = True
DIGIT[0x30:0x3A] = True
PUNCT[[ord(c) for c in ".,;:!?'\"()-"]] = True
REPEAT_WINDOW = 8


def base_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    starts, ends, first = tk.words(data, at, tk.SPACE_WORDS)
    sums = tk.byte_sums(data)
    point = (data & 0xC0) != 0x80
    out = {
        "n_words": np.diff(first),
        "word_chars": tk.per_text(point & tk.SPACE_WORDS[data], at),
        "n_symbols": tk.per_text(SYMBOLS[data], at),
    }
    out["n_dup_lines"], out["n_lines"] = _duplicate_lines(data, at, starts, sums)
    hashes = tk.string_hash(data, sums, starts, ends)
    begin = tk.window_starts(first, REPEAT_WINDOW)
    text = tk.owner(first)
    keys = tk.mix(tk.word_window_hash(hashes, begin, REPEAT_WINDOW) + text[begin].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = begin[counts[back] > 1]
    out["n_repeat_words"] = tk.per_text(tk.cover(len(starts), twice, twice + REPEAT_WINDOW), first)
    word_keys = tk.mix(hashes + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, seen = np.unique(word_keys, return_index=True)
    out["n_distinct_words"] = np.bincount(text[seen], minlength=len(at) - 1)
    return out


def _duplicate_lines(data, at, word_starts, sums) -> tuple[np.ndarray, np.ndarray]:
    n = len(at) - 1
    if not len(data):
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.union1d(at[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    ends = np.concatenate([starts[1:], [len(data)]])
    ends = ends - (data[ends - 1] == 0x0A)
    filled = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[filled], ends[filled]
    text = np.searchsorted(at, starts, side="right") - 1
    keys = tk.mix(tk.string_hash(data, sums, starts, ends) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, seen = np.unique(keys, return_index=True)
    lines = np.bincount(text, minlength=n)
    return lines - np.bincount(text[seen], minlength=n), lines


def classifier_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """base_counts plus the counts that only the classifier reads."""
    out = base_counts(data, at)
    point = (data & 0xC0) != 0x80
    out["n_chars"] = tk.per_text(point, at)
    for name, kind in (("n_upper", UPPER), ("n_lower", LOWERCASE), ("n_digit", DIGIT), ("n_punct", PUNCT)):
        out[name] = tk.per_text(kind[data], at)
    return out
