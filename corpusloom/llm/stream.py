"""Skip-and-fold streams: texts as arrays of folded symbols, whole Arrow batches at a time.

A lookup table over code points says for each character what it folds to: 0 is skipped, SPACE parts words, any
other value is the symbol. Rows with a character that one table entry cannot fold (a combining accent, a
ligature, a Greek or Cyrillic letter that may be a look-alike) are marked SPECIAL and folded by the exact
per-text form first. No canonical string is built for any other row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from corpusloom.llm import forms

SPACE, SPECIAL = 32, -1
TOP = 0x32400  # letters and digits end below this code point
P1, P2 = np.uint64(2147483647), np.uint64(2147483629)  # primes below 2**31
B1, B2 = 911382323, 972663749


@lru_cache(maxsize=2)
def table(words: bool) -> np.ndarray:
    """Code point -> symbol for letters and digits (``words``: separators give SPACE instead of being skipped)."""
    first, second, _ = forms.tables()
    out = np.full(0x110000, SPACE if words else 0, np.int32)
    for cp in range(TOP):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if forms.DROPPED.match(c) or cp in (0x600, 0x601):
            out[cp] = 0
            continue
        if unicodedata.category(c) in ("Mn", "Mc", "Me") or (0x370 <= cp < 0x530 and c.isalnum()):
            out[cp] = SPECIAL
            continue
        f = (first.get(cp, c) or "").translate(second).replace(forms.ZWNJ, "").lower()
        if f == "" or f == "...":
            out[cp] = 0 if f == "" or not words else SPACE
        elif len(f) > 1:
            out[cp] = SPECIAL
        elif f.isalnum():
            out[cp] = ord(f)
    return out


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and where each text starts (one more entry than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def fold(texts: list[str | None], words: bool = False, exact: Callable[[str], str] = forms.shape) -> tuple[np.ndarray, np.ndarray]:
    """(symbols without the skipped ones, where each text starts among them). Null folds like an empty text."""
    texts = ["" if t is None else t for t in texts]
    lut = table(words)
    raw, starts = codes(texts)
    sym = lut[raw]
    special = np.flatnonzero(sym == SPECIAL)
    if len(special):
        for r in np.unique(np.searchsorted(starts, special, "right") - 1):
            texts[r] = exact(texts[r])
        raw, starts = codes(texts)
        sym = lut[raw]
        left = sym == SPECIAL  # letters that stay what they are; combining marks alone are no letters
        if left.any():
            alone = np.array([ord(chr(c).lower()[0]) if chr(c).isalnum() else (SPACE if words else 0) for c in raw[left]], np.int32)
            sym[left] = alone
    keep = sym != 0
    before = np.zeros(len(sym) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return sym[keep], before[starts]


def _powers(base: int, p: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, np.uint64(base)
    while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step % p
        step = step * step % p
        done += take
    return out


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each segment [starts[i], starts[i+1]); 0 for empty ones."""
    n = len(starts) - 1
    out = np.zeros(n, values.dtype)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full])
    return out


def hashes(sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 62-bit polynomial hash of every segment, rolled over its symbols (two primes); equal segments, equal hashes."""
    sizes = starts[1:] - starts[:-1]
    if not len(sizes):
        return np.zeros(0, np.int64)
    longest = int(sizes.max())
    at = np.arange(len(sym), dtype=np.int64) - np.repeat(starts[:-1], sizes)
    s = sym.astype(np.uint64)
    out = np.zeros(len(sizes), np.uint64)
    for base, p in ((B1, P1), (B2, P2)):
        h = segment_sums(s * _powers(base, p, longest)[at] % p, starts) % p
        out = (out << np.uint64(31)) | h
    return out.astype(np.int64)


def equal_streams(left: list[str], right: list[str], exact: Callable[[str], str] = forms.shape) -> np.ndarray:
    """Whether both texts of each pair give the same symbols: two pointers that skip what the table skips,
    advanced over all pairs of the batch at once."""
    a, sa = fold(left, exact=exact)
    b, sb = fold(right, exact=exact)
    na, nb = sa[1:] - sa[:-1], sb[1:] - sb[:-1]
    same = na == nb
    if same.any():
        mine, other = a[np.repeat(same, na)], b[np.repeat(same, nb)]
        starts = np.zeros(int(same.sum()) + 1, np.int64)
        np.cumsum(na[same], out=starts[1:])
        same[same] = segment_sums((mine != other).astype(np.int64), starts) == 0
    return same
