"""Sets of hashed word shingles, computed with numpy for many texts at once."""

from __future__ import annotations

import numpy as np

BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A-Z in lower case; white space of common.SPACE as spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def slices(texts: list, most: int = 300_000) -> list[tuple[int, int]]:
    """Runs of texts of about `most` characters in all, so that arrays over them stay small."""
    cuts, n = [0], 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            cuts.append(i)
            n = 0
        n += len(t)
    return list(zip(cuts, [*cuts[1:], len(texts)], strict=True)) if texts else []


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """As _shingle_sets(), some texts at a time."""
    values, starts, at = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for a, b in slices(texts):
        some, start = _shingle_sets(texts[a:b], words)
        values.append(some)
        starts.append(start[1:] + at)
        at += len(some)
    return np.concatenate(values), np.concatenate(starts)


def _shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles, as 64-bit hashes in ascending order text by text, and each text's
    start (one more than there are texts).

    A word's hash is a polynomial of its bytes, from one pass of prefix sums; a shingle's is chained
    from its words'. A text with fewer words than a shingle has is one shingle; one without words
    has none.
    """
    coded = [t.encode().translate(FOLD) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in coded])]).astype(np.int64)
    data = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    blank = data == 32
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:], dtype=np.uint64)
    h = mix((sums[end] - sums[begin]) * powers(INVERSE, len(data) + 1)[begin] + (end - begin).astype(np.uint64) * BASE)
    owner = np.searchsorted(starts, begin, "right") - 1
    n_words = np.bincount(owner, minlength=len(texts))
    last = max(0, len(h) - words + 1)
    chain = np.zeros(last, np.uint64)
    for k in range(words):
        chain = mix(chain * BASE + h[k : k + last] + np.uint64(k + 1))
    whole = owner[:last] == owner[words - 1 :][:last] if last else np.zeros(0, bool)
    values, owners = [chain[whole]], [owner[:last][whole]]
    first = np.concatenate([[0], np.cumsum(n_words)])
    few = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(few):
        short = [mix(np.uint64(n_words[i]) + np.bitwise_xor.reduce(mix(h[first[i] : first[i + 1]] + np.arange(n_words[i], dtype=np.uint64) * BASE)).reshape(1))[0] for i in few]
        values.append(np.array(short, np.uint64))
        owners.append(few)
    value, own = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[new], own[new]
    return value, np.searchsorted(own, np.arange(len(texts) + 1))
