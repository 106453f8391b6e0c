"""Token ids of whole texts, by a public byte-level BPE tokenizer.

The tokenizer first splits a text where white space begins after other
characters, and never joins anything over such a place. So a text's ids are
those of its chunks between these places, one after the other, and a chunk that
was met before need not be encoded again. Chunks are found with numpy in the
bytes of a block of texts, told apart by a 64-bit hash, and only new ones go to
the tokenizer. A worker keeps what it has encoded, up to ``KEEP`` chunks or as
many as it is told.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np

from opinionlake.llm import bytesio as B

TOKENIZER = "byte_bpe_50k.json"
END = 0
KEEP = 1_000_000
BLOCK = 1 << 20
_RECENT = 100_000

_ASCII = B.byte_table((0x21, 0x7E))
_LETTER = B.byte_table((0x41, 0x5A), (0x61, 0x7A))
_TWO = B.byte_table((0xC3, 0xDF))
_THREE = B.byte_table((0xE4, 0xEF))
_STOP = B.byte_table((0x2E, 0x2E), (0x2C, 0x2C))


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """For each byte, whether a new chunk may begin there (judged by the bytes before it).

    White space after a character that is none; a full stop or comma after a letter. Characters whose kind the bytes
    do not tell at once (white space outside ASCII among them) just make a chunk longer.
    """
    n = len(data)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    white, stop = B.WHITE[data], _STOP[data]
    at = np.flatnonzero(white | stop)
    at = at[at > 0]
    one = data[at - 1]
    two = data[np.maximum(at - 2, 0)]
    three = data[np.maximum(at - 3, 0)]
    latin = (one >= 0x80) & (two == 0xC3) & (one != 0x97) & (one != 0xB7)
    other = (one >= 0x80) & (_TWO[two] | ((two >= 0x80) & _THREE[three]))
    after_white = white[at] & (_ASCII[one] | other)
    after_letter = stop[at] & (_LETTER[one] | latin)
    out[at[after_white | after_letter]] = True
    return out


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts, with a bounded memory of encoded chunks."""

    def __init__(self, path: str, keep: int | None = None) -> None:
        self.path, self.keep = path, keep or KEEP
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.stores = [[np.zeros(0, np.uint64), none, none], [np.zeros(0, np.uint64), none, none]]
        self.flat = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, ids per chunk)."""
        tokenizer = _tokenizer(self.path)
        simple = [i for i, c in enumerate(chunks) if c[0] == " " and c[1:].isalpha()]
        mixed = sorted(set(range(len(chunks))).difference(simple))
        # A space and letters are one piece to the tokenizer, so many of them can be encoded as one text.
        groups = [simple[i : i + 200] for i in range(0, len(simple), 200)]
        joined = tokenizer.encode_batch(["".join([chunks[i] for i in g]) for g in groups], add_special_tokens=False)
        alone = tokenizer.encode_batch_fast([chunks[i] for i in mixed], add_special_tokens=False)
        ids = [np.array(e.ids, np.uint32) for e in joined] + [np.array(e.ids, np.uint32) for e in alone]
        per = [np.bincount(e.word_ids, minlength=len(g)) for e, g in zip(joined, groups, strict=True)]
        n = np.concatenate([*per, np.fromiter(map(len, ids[len(groups) :]), np.int64, len(alone))])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        # Back to the order of the chunks.
        source = np.empty(len(chunks), np.int64)
        source[np.array(simple + mixed, np.int64)] = np.arange(len(chunks))
        first = (np.cumsum(n) - n)[source]
        n = n[source]
        at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        return flat[at], n.astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, place, length) of each key in the stores."""
        known = np.zeros(len(keys), bool)
        place, length = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k, p, n in self.stores:
            if not len(k):
                continue
            slot = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            hit = k[slot] == keys
            place[hit], length[hit] = p[slot[hit]], n[slot[hit]]
            known |= hit
        return known, place, length

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place, length) of the new keys."""
        if len(self.stores[0][0]) + len(self.stores[1][0]) + len(keys) > self.keep:
            self._clear()
        new, n = self._encode_new(chunks)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used : self.used + len(new)] = new
        place = self.used + np.cumsum(n) - n
        self.used += len(new)
        merge = 0 if len(self.stores[1][0]) + len(keys) > _RECENT else 1
        parts = [self.stores[1], [keys, place, n]] if merge else [*self.stores, [keys, place, n]]
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.argsort(joined[0], kind="stable")
        self.stores[merge] = [x[order] for x in joined]
        if not merge:
            none = np.zeros(0, np.int64)
            self.stores[1] = [np.zeros(0, np.uint64), none, none]
        return place, n

    def block(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, ids per segment)."""
        data = block.data
        full = block.ends > block.starts
        begin = chunk_starts(data)
        begin[block.starts[full]] = True
        starts = np.flatnonzero(begin)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(block.rows), np.int64)
        ends = np.append(starts[1:], len(data))
        hashes = B.range_hash(B.prefix_sums(data), starts, ends) + (ends - starts).astype(np.uint64)
        # As np.unique would, but any place of a chunk will do, so the sort need not be stable.
        order = np.argsort(hashes)
        in_order = hashes[order]
        edge = np.ones(len(order), bool)
        edge[1:] = in_order[1:] != in_order[:-1]
        keys, first = in_order[edge], order[edge]
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(edge) - 1
        known, place, length = self._find(keys)
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            at = first[new]
            chunks = [raw[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            cleared = len(self.stores[0][0]) + len(self.stores[1][0]) + len(new) > self.keep
            if cleared:
                # The memory starts anew, with all chunks of this block.
                self._clear()
                at = first
                new = np.arange(len(keys))
                chunks = [raw[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            place[new], length[new] = self._learn(keys[new], chunks)
        n = length[back]
        total = np.cumsum(n)
        at = np.arange(int(total[-1])) + np.repeat(place[back] - (total - n), n)
        segment = np.searchsorted(block.starts, starts, side="right") - 1
        per = np.bincount(segment, weights=n, minlength=len(block.rows)).astype(np.int64)
        return self.flat[at], per

    def column(self, col) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, ids of these rows, ids per row) of an Arrow string column, whole texts only, in order."""
        held_row, held = -1, []
        for block in B.blocks(col, chunk_starts, BLOCK):
            ids, per = self.block(block)
            alone = len(block.rows) == 1
            if held and not (alone and block.rows[0] == held_row):
                yield np.array([held_row]), np.concatenate(held), np.array([sum(map(len, held))])
                held = []
            if alone:
                held_row = int(block.rows[0])
                held.append(ids)
            else:
                yield block.rows, ids, per
        if held:
            yield np.array([held_row]), np.concatenate(held), np.array([sum(map(len, held))])


@cache
def encoder(path: str, keep: int | None = None) -> Encoder:
    """The encoder of this worker for a vocabulary file."""
    return Encoder(path, keep)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def crc32(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
