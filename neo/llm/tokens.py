"""Token ids of texts, as pieces of a bounded number of tokens."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Every document ends with this id (fixed by the query's contract).
END_ID = 2

VOCABULARY = "byte_bpe_50k.json"


@cache
def _encoders(path: str, ranks: str | None):
    exact = Tokenizer.from_file(path)
    special = sorted(exact.get_added_tokens_decoder().values(), key=str)
    fast = None
    if ranks:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return exact, fast, [t.content for t in special]


class Encoder:
    """Ids as ``tokenizers`` gives them for ``path`` without special tokens added.

    ``ranks`` may name the same vocabulary for ``tiktoken``, which gives the same ids several
    times faster; texts that hold the string of a special token, which ``tokenizers`` turns
    into that token, are left to it."""

    def __init__(self, path: str, ranks: str | None = None, end_id: int = END_ID):
        self.exact, self.fast, self.special = _encoders(path, ranks)
        self.end_id = end_id

    @classmethod
    def named(cls, name: str = VOCABULARY, end_id: int = END_ID) -> Encoder:
        path = public_tokenizers.path(name)
        ranks = public_tokenizers.path("byte_bpe_50k.tiktoken") if name == VOCABULARY else None
        return cls(path, ranks, end_id)

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.fast is None or any(s in text for s in self.special):
            ids = np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        return np.append(ids, np.uint32(self.end_id)).astype("<u4", copy=False)


def encoded(texts, encoder: Encoder) -> Iterator[np.ndarray]:
    """Ids of each text of a batch; texts that repeat in the batch are encoded once."""
    seen: dict[str, np.ndarray] = {}
    for text in texts:
        text = text.as_py() or ""
        ids = seen.get(text)
        if ids is None:
            ids = seen[text] = encoder(text)
        yield ids


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """``start, length`` of the pieces of ``n`` ids: whole ones of ``size``, the first may be shorter."""
    first = n % size or min(n, size)
    return [(0, first), *((a, size) for a in range(first, n, size))]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
