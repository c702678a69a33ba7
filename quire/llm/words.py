"""Words of a text as numbers, for functions that run in Python workers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
#: Distinct words that one worker remembers before it starts anew.
REMEMBERED = 400_000
#: The same for functions that run one after the other in a worker, which keeps most of the memory that it once took.
NUMBERED = 100_000


def crc(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


class WordIds(dict):
    """Word -> running number; `hashes` holds each number's hash. Numbers hold until the next call of fresh()."""

    def __init__(self, hash_of: Callable[[str], int] = crc):
        self.hash_of = hash_of
        self.hashes = np.zeros(1024, np.uint64)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
        self.hashes[n] = self.hash_of(word)
        self[word] = n
        return n

    def fresh(self) -> None:
        if len(self) > NUMBERED:
            self.clear()

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashes_of(self, numbers: np.ndarray) -> np.ndarray:
        return self.hashes[numbers]
