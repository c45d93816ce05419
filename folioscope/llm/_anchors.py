"""Content-defined anchors of byte strings: every window of ``width`` bytes gets one, the same wherever it stands."""

from __future__ import annotations

import numpy as np

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_BITS = 15
#: Bytes looked at at once, few enough for a core's cache; positions in a block take _BITS bits of a key.
BLOCK = 1 << _BITS
_PLACES = np.arange(BLOCK, dtype=np.uint32)
_LOW = np.uint32(BLOCK - 1)


def words(data: bytes) -> np.ndarray:
    """The eight bytes from each place of data on, as a number; a view."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def hashed(word: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes, at least 8, from each of begin on."""
    h = np.zeros(len(begin), np.uint64)
    for at in (*range(0, size - 7, 8), *([size - 8] if size % 8 else [])):
        h = (h ^ word[begin + at]) * _M[1]
        h ^= h >> np.uint64(32)
    h *= _M[2]
    return h ^ (h >> np.uint64(29))


def contents(word: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Hash of the size bytes from each of begin on, size between width and 2 * width - gram."""
    h, end = hashed(word, begin, width) ^ size.astype(np.uint64), begin + size
    for back in range(8, width - gram + 8, 8):  # words counted from the end hold what is beyond the first width bytes
        h = (h ^ word[end - back]) * _M[1]
        h ^= h >> np.uint64(32)
    return h


def ranges(width: int, gram: int) -> list[tuple[int, int]]:
    """Four ranges, both ends included, of the number of bytes that may stand before the anchor in its window."""
    step = -(-(width - gram + 1) // 4)
    return [(low, min(low + step - 1, width - gram)) for low in range(0, width - gram + 1, step)]


def keys(word: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Of each run four hashes of 16 bits, one a range: of the bytes that all windows of the range have, 0 if the run has no such window.

    Two runs of one anchor that hold an equal window have it in the same range, and so an equal hash that is not 0.
    """
    out = np.zeros(len(begin), np.uint64)
    most, least = place - begin, place - begin - size + width
    for k, (low, high) in enumerate(ranges(width, gram)):
        some = np.flatnonzero((most >= low) & (least <= high))
        h = hashed(word, place[some] - low, width - high + low) >> np.uint64(48)
        out[some] |= np.maximum(h, np.uint64(1)) << np.uint64(16 * k)
    return out


def anchors(texts: list[bytes], width: int, gram: int):
    """(text index, first window, bytes, place, anchor) of each run of windows with one anchor, as arrays.

    A window's anchor is its gram whose first eight bytes have the smallest hash, the first of equals; place is where it
    begins, anchor a hash of it. The windows first .. first + bytes - width share it. Texts longer than a block are cut
    between windows, which splits a run but loses none.
    """
    out: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []  # text, offset, piece
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - width + 1), BLOCK - width):
            piece = text[at : at + BLOCK - 1]
            if len(piece) < width:
                continue
            if size + len(piece) > BLOCK:
                out.append(_block(held, width, gram))
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        out.append(_block(held, width, gram))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _block(held, width: int, gram: int):
    data = b"".join(p for _, _, p in held)
    lens = np.array([len(p) for _, _, p in held])
    ends = np.cumsum(lens)
    word = words(data).copy()
    key = ((word[: len(data) - gram + 1] * _M[0]) >> np.uint64(32)).astype(np.uint32)
    key &= ~_LOW
    key |= _PLACES[: len(key)]
    have, w = 1, width - gram + 1
    while have < w:  # least key of the grams of each window, by doubling
        step = min(have, w - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    key &= _LOW
    fits = np.zeros(len(key) + 1, bool)
    for s, e in zip((ends - lens).tolist(), ends.tolist()):
        fits[s : e - width + 1] = True
    new = np.ones(len(key) + 1, bool)  # the window's anchor is not that of the one before
    np.not_equal(key[1:], key[:-1], out=new[1:-1])
    before = np.concatenate((np.zeros(1, bool), fits[:-1]))
    begin = np.flatnonzero(fits & (new | ~before))
    end = np.flatnonzero(before & (new | ~fits)) - 1
    place = key[begin].astype(np.int64)
    piece = np.searchsorted(ends, begin, "right")
    text, shift = np.array([t for t, _, _ in held])[piece], np.array([o for _, o, _ in held])[piece] - (ends - lens)[piece]
    return text, begin + shift, end + width - begin, place + shift, hashed(word, place, gram)
