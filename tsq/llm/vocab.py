"""Public byte-level BPE vocabularies as small literal tables.

A vocabulary is a file of ``base64-piece rank`` lines; its path is always a
parameter.  Everything here is bounded by the vocabulary (50 thousand pieces)
and independent of the corpus.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The pre-tokenisation pattern of the vocabulary, white space spelled
# out because Java's \s is ASCII only.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRETOKEN = (
    "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+"
    f"| ?[^{SPACE}\\p{{L}}\\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

PAIR_BASE = 1 << 16  # ids are less
NO_PAIR = 1 << 40


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Pieces of a rank file and their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def pieces(path: str) -> list[bytes]:
    """The piece of each id; an id without a piece is empty."""
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


@lru_cache(maxsize=4)
def byte_ids(path: str) -> list[int]:
    """The id of each single byte."""
    ranks = load_ranks(path)
    return [ranks[bytes([b])] for b in range(256)]


@lru_cache(maxsize=4)
def joinable(path: str) -> bytes:
    """One flag for each pair of bytes (first * 256 + second): 1 where some piece
    holds them side by side.  No merge ever crosses a pair with flag 0, so a word
    may be cut there without changing its encoding."""
    flags = np.zeros(65536, np.uint8)
    for piece in load_ranks(path):
        a = np.frombuffer(piece, np.uint8).astype(np.int64)
        flags[a[:-1] * 256 + a[1:]] = 1
    return flags.tobytes()


@lru_cache(maxsize=4)
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ranks of all pairs as one sparse matrix whose rows overlap.

    Returns (offsets, slots).  The pair of ids a and b has the slot ``offsets[a] + b``,
    which holds ``a * PAIR_BASE + rank`` if they may merge, and something with another
    row than a if not.  Every cut of a piece into two pieces is a pair, which is the
    rule of the rank file: two neighbours may merge when their concatenation has a
    rank."""
    ranks = load_ranks(path)
    size = max(ranks.values()) + 1
    rows: dict[int, dict[int, int]] = {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                rows.setdefault(a, {})[b] = rank
    offsets = np.zeros(size, np.int64)
    slots, used = np.full(size, NO_PAIR, np.int64), np.zeros(size, bool)
    begin, step = 0, 256
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        columns = np.array(list(row))
        at = begin  # rows get shorter, so the next one is looked for from the last place
        while True:
            if at + step + size > len(slots):
                slots, used = np.append(slots, np.full(size, NO_PAIR)), np.append(used, np.zeros(size, bool))
            free = ~used[at + np.arange(step)[:, None] + columns].any(axis=1)
            if free.any():
                break
            at += step
        begin = at
        offsets[a] = at + int(free.argmax())
        slots[offsets[a] + columns] = a * PAIR_BASE + np.array(list(row.values()))
        used[offsets[a] + columns] = True
    slots = np.append(slots, np.full(size, NO_PAIR))
    return offsets, slots[: int(offsets.max()) + size]


@lru_cache(maxsize=4)
def merges_in_order(path: str) -> bool:
    """Whether lowest-first merging makes each piece of its bytes by merges of rank at
    most its own.  Then a merge of rank r never makes a pair of rank r or less: such a
    pair would join to a piece whose parts had merged before."""
    ranks = load_ranks(path)
    for piece, rank in ranks.items():
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            pairs = [ranks.get(a + b, len(ranks) * 2) for a, b in zip(parts, parts[1:])]
            least = min(pairs)
            if least > rank:
                return False
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True
