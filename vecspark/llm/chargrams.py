"""Hashed character n-grams of texts, with numpy inside tasks."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)

#: Simple lower-case forms of the first 1,536 code points.
LOWER_FORMS = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x600)], np.uint32)
IS_LETTER = np.array([chr(c).isalpha() for c in range(0x600)])


def characters(data: np.ndarray, offsets: np.ndarray, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of concatenated UTF-8 texts and each text's first one (one more at the end).

    With ``letters_only`` all that is no letter becomes a space.
    """
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    low = codes < len(LOWER_FORMS)
    small = np.where(low, codes, 0)
    codes = np.where(low, LOWER_FORMS[small], codes)
    if letters_only:
        codes = np.where(low & ~IS_LETTER[small], 32, codes)
    return codes, begins[offsets]


def hashed_grams(codes: np.ndarray, first: np.ndarray, sizes: tuple[int, ...], bits: int):
    """For each n-gram size (text number, bucket) of all n-grams that lie inside one text."""
    values = (codes.astype(np.uint64) + np.uint64(1)) * _SPREAD
    values ^= values >> np.uint64(29)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(len(codes))
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    rolling = np.zeros(len(codes), np.uint64)
    for n in range(1, max(sizes) + 1):
        rolling = rolling[: len(codes) - n + 1] * _STEP + values[n - 1 :]
        if n in sizes and len(rolling):
            whole = room[: len(rolling)] >= n
            bucket = ((rolling ^ (rolling >> np.uint64(32))) * _SPREAD >> np.uint64(64 - bits)).astype(np.int32)
            yield doc[: len(rolling)][whole], bucket[whole]
