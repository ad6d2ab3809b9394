"""Word shingles of whole texts as 64-bit hashes, for a batch of texts at once in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from archivelens.llm import words
from archivelens.llm.words import mix

#: Words in a shingle.
WORDS = 5
_PLACE = np.random.default_rng(20_240_501).integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the batch in order, and each text's number of words.

    Words are told apart by their bytes, and each distinct one has its keyed hash, so no two words that a text
    could be made of on purpose share one.
    """
    own = words.split(texts, words.SPACES)
    hashes, counts = words.hashes(own.distinct)[own.code], own.counts
    del own
    words.settle()
    return hashes, counts


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text on end, and their number for each text.

    Fewer than ``WORDS`` words give one shingle of them all; no words give none.
    """
    each, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    if not len(each):
        return each, counts
    whole = np.zeros(len(each), np.uint64)
    for k in range(min(WORDS, len(each))):
        whole[: len(each) - k] += each[k:] * _PLACE[k]
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
        if b - a >= WORDS:
            own = np.sort(mix(whole[a : b - WORDS + 1]))
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            own = mix(np.array([(each[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out), sizes


def fingerprint(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()
