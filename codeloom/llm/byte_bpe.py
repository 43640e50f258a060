"""Byte-level BPE encoding and decoding with padded numpy matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import KEPT, LONGEST, per_batch
from .pretokens import chunks, pieces

#: Cells of a matrix; pieces of more bytes than LONG are encoded one at a time, by a heap of their pairs.
CELLS, LONG = 1 << 19, 256
NONE = np.int64(1 << 40)


class Ranks:
    """A rank file: each line a token in base64 and its rank, which is its id."""

    def __init__(self, file: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        self.token = {r: t for t, r in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        left, right, made = [], [], []
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(r)
        self._hash(np.array(left, np.int64), np.array(right, np.int64), np.array(made, np.int64))

    def _hash(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        """An open table of pairs: each has its place by a product hash, or one of the next free ones."""
        self.bits = max(4, int(np.ceil(np.log2(8 * len(left) + 1))))
        key = (left << 32) | right
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE)
        at, rest, self.probes = self._place(key), np.arange(len(key)), 0
        while len(rest):
            self.probes += 1
            free = rest[self.keys[at[rest]] == -1]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = key[put], made[put]
            rest = np.setdiff1d(rest, put)
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        mixed = (key ^ (key >> np.int64(29))).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).view(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, NONE where it doesn't; a negative id is no token."""
        key = (left << np.int64(32)) | right
        at = self._place(key)
        out = np.where(self.keys[at] == key, self.values[at], NONE)
        open_ = (self.keys[at] != key) & (self.keys[at] != -1) & (left >= 0) & (right >= 0)
        out[(left < 0) | (right < 0)] = NONE
        index = np.flatnonzero(open_.ravel())
        if len(index):
            k, a, o = key.ravel()[index], at.ravel()[index], out.reshape(-1)
            for _ in range(self.probes):
                a = (a + 1) & ((1 << self.bits) - 1)
                hit = self.keys[a] == k
                o[index[hit]] = self.values[a[hit]]
                going = ~hit & (self.keys[a] != -1)
                index, k, a = index[going], k[going], a[going]
                if not len(index):
                    break
        return out

    def encode(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece. Pieces go to buckets by length, a power of two, each a padded matrix with a row for
        each piece; each round merges every row's leftmost pair of least rank and closes the gap; rows without a pair
        to merge are done and leave the matrix."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(parts)
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        for i in np.flatnonzero(length > LONG).tolist():
            out[i] = self._long(parts[i])
        width = 1
        while width <= LONG:
            held = np.flatnonzero((length > width // 2) & (length <= width))
            for at in range(0, len(held), max(1, CELLS // width)):
                self._bucket(parts, held[at : at + max(1, CELLS // width)], width, out)
            width *= 2
        return out

    def _bucket(self, parts: list[bytes], rows: np.ndarray, width: int, out: list[np.ndarray]) -> None:
        raw = np.frombuffer(b"".join(parts[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
        size = np.array([len(parts[i]) for i in rows], np.int64)
        ids = np.full((len(rows), width + 1), np.int64(-1))
        ids[:, :width] = np.where(np.arange(width) < size[:, None], self.byte[raw], -1)
        rank, column = self.pair(ids[:, :-1], ids[:, 1:]), np.arange(width + 1)
        while len(rows):
            at = rank.argmin(1)
            line = np.arange(len(rows))
            best = rank[line, at]
            done = best == NONE
            if done.any():
                for r, row, n in zip(rows[done].tolist(), ids[done].astype(np.uint32), size[done].tolist(), strict=True):
                    out[r] = row[:n]
                live = ~done
                rows, ids, rank, size, at, best = rows[live], ids[live], rank[live], size[live], at[live], best[live]
                if not len(rows):
                    return
                most = int(size.max())
                ids, rank, column = ids[:, : most + 1], rank[:, :most], column[: most + 1]
                line = np.arange(len(rows))
            ids = np.take_along_axis(ids, np.minimum(column + (column > at[:, None]), len(column) - 1), 1)
            ids[:, -1] = -1
            ids[line, at] = best
            size = size - 1
            rank = np.take_along_axis(rank, np.minimum(column[:-1] + (column[:-1] > at[:, None]), len(column) - 2), 1)
            rank[line, at] = self.pair(best, ids[line, at + 1])
            back = np.maximum(at - 1, 0)
            rank[line, back] = np.where(at > 0, self.pair(ids[line, back], best), rank[line, back])
            rank[:, -1] = NONE

    def _long(self, part: bytes) -> np.ndarray:
        """One long piece. A heap gives the leftmost pair of least rank; its two parts are linked to their neighbours, so
        that a merge touches the two pairs beside it alone, and the whole costs n log n steps."""
        ids = self.byte[np.frombuffer(part, np.uint8)]
        rank = self.pair(ids[:-1], ids[1:])
        at = np.flatnonzero(rank != NONE)
        shift = len(part).bit_length()
        heap = ((rank[at] << shift) | at).tolist()
        heapq.heapify(heap)
        ids, after, before = ids.tolist(), list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        end, mask, token, known = len(part), (1 << shift) - 1, self.token, self.rank.get
        while heap:
            entry = heapq.heappop(heap)
            i, made = entry & mask, entry >> shift
            j = after[i]
            if ids[i] < 0 or j == end or known(token[ids[i]] + token[ids[j]]) != made:
                continue  # a merge beside it has changed the pair
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (r := known(token[made] + token[ids[k]])) is not None:
                    heapq.heappush(heap, (r << shift) | i)
            if (h := before[i]) >= 0 and (r := known(token[ids[h]] + token[made])) is not None:
                heapq.heappush(heap, (r << shift) | h)
        return np.array([x for x in ids if x >= 0], np.uint32)


class Codec:
    def __init__(self, file: bytes):
        self.ranks = Ranks(file)
        self.parts: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.bytes_of = self.ranks.token.__getitem__

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. What texts hold between blanks is split into
        pieces once; pieces that are new to the worker are encoded together. Those of up to LONGEST characters are kept."""
        for cache in (self.parts, self.known):
            if len(cache) > KEPT:
                cache.clear()
        plans, new, missing = [], {}, {}
        for text in texts:
            parted = chunks(text) if text else ("", [])
            first, rest = (text, ()) if parted is None else parted
            found = pieces(first)
            plans.append((found, rest))
            missing.update(dict.fromkeys(p for p in found if p not in self.known))
            for c in rest:
                if c not in self.parts and c not in new:
                    new[c] = found = pieces(" " + c)
                    missing.update(dict.fromkeys(p for p in found if p not in self.known))
        order = list(missing)
        made = dict(zip(order, (x.astype("<u4").tobytes() for x in self.ranks.encode([p.encode() for p in order])), strict=True))
        known = self.known.get
        ids_of = lambda p: known(p) or made[p]
        joined = {c: b"".join(map(ids_of, found)) for c, found in new.items()}
        part = self.parts.get
        out = [b"".join(map(ids_of, first)) + b"".join([part(c) or joined[c] for c in rest]) for first, rest in plans]
        self.known.update((p, x) for p, x in made.items() if len(p) <= LONGEST)
        self.parts.update((c, x) for c, x in joined.items() if len(c) <= LONGEST)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``: the whole text is encoded by the ranks
    of the file ``path``, which the driver reads and broadcasts, without special tokens, and its ids are decoded again.
    ``ids``: the columns of ``docs`` but text, n_tokens and the ids, an array of integers, each, in front of the hashes;
    columns of ``docs`` with these names give way. Null and empty texts have no ids, and the hashes are those of no bytes;
    repeated rows are encoded each."""
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    ready: list[Codec] = []
    made = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"} if ids else {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    kept = [c for c in docs.columns if c.lower() not in (*made, "text")] if ids else ["doc_id"]

    def run(b: dict):
        if not ready:
            ready.append(Codec(shared.value))
        codec, texts, at, size = ready[0], b["text"], 0, 0
        for end in range(1, len(texts) + 1):
            size += len(texts[end - 1] or "")
            if size > 1 << 22 or end == len(texts):
                found = codec.encode_all(texts[at:end])
                out = {c: b[c][at:end] for c in kept} | {
                    "n_tokens": [len(x) // 4 for x in found], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in found], "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in found],
                }
                if ids:
                    ends = np.cumsum([0, *out["n_tokens"]]).astype(np.int32)
                    out["ids"] = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(found), "<u4").astype(np.int32))
                yield out
                at, size = end, 0

    kinds = dict(docs.dtypes)
    return per_batch(docs.select(*kept, "text"), ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"{c} {k}" for c, k in made.items())]), run)
