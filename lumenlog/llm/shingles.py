"""Word-shingle sets as 64-bit hashes, computed a block of documents at a time."""

from __future__ import annotations

import numpy as np
import xxhash

from lumenlog.llm.common import encode_words, mix64, words_of

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; fewer words: the whole sequence as one; none: empty."""
    flat, counts = words_of(texts)
    words, codes = encode_words(flat)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
    h = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            rolled = (rolled * _STEP) ^ h[i : i + len(rolled)]
            rolled = mix64(rolled + np.uint64(i + 1))
        out, at = [], 0
        for n in counts.tolist():
            if n >= k:
                out.append(np.unique(rolled[at : at + n - k + 1]))
            elif n:
                whole = np.uint64(n)
                for x in h[at : at + n]:
                    whole = mix64(np.array([whole * _STEP ^ x], np.uint64))[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out
