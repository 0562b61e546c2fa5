"""Hashed character n-grams of whole texts, in numpy."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
SPREAD = 0xD6E8FEB86659FD93
PART = 1 << 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


#: Marks of other scripts and what each stands for.
STANDS_FOR = {c: ord(to) for to, marks in {".": "。．｡।॥۔።។။།", ",": "，、､،፣", "!": "！", "?": "？؟", ";": "；؛", ":": "："}.items() for c in marks}
#: Marks of typography, not of sentences, though Unicode has them among punctuation.
ODD_MARKS = frozenset("§¶†‡•‣※⁂⁎⁑")


@lru_cache(maxsize=1)
def categories() -> np.ndarray:
    """The first letter of each code point's Unicode category."""
    return np.fromiter((ord(unicodedata.category(chr(i))[0]) for i in range(0x110000)), np.uint8, 0x110000)


@lru_cache(maxsize=1)
def written() -> np.ndarray:
    """Whether a code point is a letter, a mark upon letters, a joiner of them or, beyond ASCII, a digit or a mark of sentences."""
    out = np.isin(categories(), [ord("L"), ord("M")]) | letters()
    out[128:] |= categories()[128:] == ord("P")
    out[[i for i in range(128, 0x110000) if chr(i).isdecimal()]] = True
    out[[0x200C, 0x200D]] = True
    out[[ord(c) for c in ODD_MARKS]] = False
    out[ord("’")] = False  # counted with the ASCII ones
    return out


@lru_cache(maxsize=1)
def upon_letters() -> dict[int, None]:
    """Marks upon letters and their joiners, as a table that str.translate deletes."""
    return dict.fromkeys([*np.flatnonzero(categories() == ord("M")).tolist(), 0x200C, 0x200D])


@lru_cache(maxsize=1)
def shapes() -> np.ndarray:
    """What each code point counts as by its kind: A and a for letters by case, 0 for digits, stops as ASCII has them, others as themselves."""
    out = np.arange(0x110000, dtype=np.uint32)
    out[letters() | (categories() == ord("M"))] = ord("a")
    out[[i for i in range(128, 0x110000) if chr(i).isdecimal()]] = ord("0")
    out[[ord(c) for c in STANDS_FOR]] = list(STANDS_FOR.values())
    out[np.fromiter((chr(i).isupper() for i in range(0x110000)), bool, 0x110000)] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


@lru_cache(maxsize=1)
def cased() -> np.ndarray:
    """Whether each code point is a letter that has case."""
    return np.fromiter((chr(i).isupper() or chr(i).islower() for i in range(0x110000)), bool, 0x110000)


def gram_counts(symbols: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """How often each bucket of 2**bits is hit by the n-grams of ``symbols``; long texts go in parts that overlap.

    The hash of an n-gram goes on from that of its first n-1 symbols.
    """
    out = np.zeros(1 << bits, np.int64)
    longest = max(orders)
    for at in range(0, max(1, len(symbols)), PART):
        part = symbols[at : at + PART + longest - 1].astype(np.uint64)
        own = min(PART, len(symbols) - at)
        h = np.zeros(own, np.uint64)
        for k in range(longest):
            size = min(own, len(part) - k)
            if size <= 0:
                break
            h = (h[:size] ^ part[k : k + size]) * np.uint64(MULTIPLIERS[k])
            h ^= h >> np.uint64(29)
            if k + 1 in orders:
                out += np.bincount((h * np.uint64(SPREAD) >> np.uint64(64 - bits)).view(np.int64), minlength=1 << bits)
    return out
