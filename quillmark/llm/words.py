"""Words as 64-bit hashes, in tasks."""

from __future__ import annotations


class Hasher(dict):
    """Word (bytes) to hash, remembering up to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        from xxhash import xxh3_64_intdigest

        super().__init__()
        self.limit, self.digest = limit, xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.limit:
            self.clear()
        found = self[word] = self.digest(word)
        return found


def split_words(text: str | None, lower: bool = True) -> list[bytes]:
    """Runs of anything but ASCII white space, with A to Z lower-cased if asked; bytes methods touch ASCII only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(text: str | None, hasher: Hasher, lower: bool = True):
    """Hashes of the words of a text in order, as a uint64 array."""
    import numpy as np

    words = split_words(text, lower)
    return np.fromiter(map(hasher.__getitem__, words), np.uint64, len(words))


def mix(x):
    """Scramble 64-bit numbers one to one."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
