"""Tokens of many texts at once: split, lower-cased and numbered by Arrow."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Stands for the end of a text; no word is a separator.
END = b"\n"


class Tokens:
    """The tokens of texts: each as a number in `words`, lower-cased and split by Arrow, an end after each text."""

    def __init__(self, texts: pa.Array):
        if texts.offset:  # the splitting kernel takes no account of it
            texts = texts.take(pa.array(np.arange(len(texts))))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
        flat, edges = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        edges = edges - edges[0]
        full = pc.binary_length(flat).to_numpy() > 0
        if not full.all():
            edges = np.concatenate(([0], np.cumsum(full)))[edges]
            flat = flat.filter(pa.array(full))
        coded = flat.dictionary_encode()
        self.words: list[bytes] = [*coded.dictionary.cast(pa.large_binary()).to_pylist(), END]
        self.sizes = np.diff(edges) + 1
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.index = np.full(int(self.sizes.sum()), len(self.words) - 1, np.int32)
        inner = np.ones(len(self.index), bool)
        inner[self.firsts + self.sizes - 1] = False
        self.index[inner] = coded.indices.to_numpy()

    @cached_property
    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))

    def counts(self) -> np.ndarray:
        return np.bincount(self.index, minlength=len(self.words))
