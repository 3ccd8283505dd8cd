"""Sequences of consecutive words that occur again within one text."""

from __future__ import annotations

import numpy as np


def number_words(words: list[bytes]) -> np.ndarray:
    """Each word's number, in order of first occurrence."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def window_numbers(words: np.ndarray, size: int) -> np.ndarray:
    """For every sequence of `size` words a number that only equal sequences share."""
    numbers, width = words, 1
    while width < size and len(numbers):
        step = min(width, size - width)
        pairs = numbers[: len(numbers) - step] * (int(numbers.max()) + 1) + numbers[step:]
        numbers, width = np.unique(pairs, return_inverse=True)[1], width + step
    return numbers


def in_repeats(words: np.ndarray, size: int) -> np.ndarray:
    """For every word whether it stands in a sequence of `size` words that the text has twice or more."""
    change = np.zeros(len(words) + 1, np.int64)
    if len(words) >= size:
        numbers = window_numbers(words, size)
        places = np.flatnonzero(np.bincount(numbers)[numbers] > 1)
        change[places] += 1
        change[places + size] -= 1
    return np.cumsum(change[:-1]) > 0
