"""Words and word hashes of whole batches of texts."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"[̀-ͯ]+")
_ids: dict[str, int] = {}


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text))


def folded_words(text: str | None) -> list[str]:
    return WORD.findall(fold(text)) if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hash of each word, the same in every process."""
    if len(_ids) > 400_000:
        _ids.clear()
    out = list(map(_ids.get, words))
    if None in out:
        for w in set(words).difference(_ids):
            _ids[w] = xxhash.xxh64_intdigest(w)
        out = [_ids[w] for w in words]
    return np.array(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; empty where there are fewer."""
    if len(w) < k:
        return np.empty(0, np.uint64)
    n, out = len(w) - k + 1, np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    return out
