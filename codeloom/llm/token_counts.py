"""Token counts: a broadcast table of frequent pre-tokens' lengths, then the workers' own caches; no pre-token moves."""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, LONGEST, per_batch
from .pretokens import chunks, pieces

#: Pre-tokens in the broadcast table at most, and the documents of the sample that they are taken from, about. Both
#: only bear on speed.
FREQUENT, SAMPLED = 1 << 16, 2000


class Lengths:
    """Counts tokens. Parts of texts between blanks that were met before cost one look-up; others are split into
    pre-tokens, whose lengths are in the table, in the cache, or found by the library."""

    def __init__(self, file: bytes, table: dict[str, int], special: tuple[str, ...]):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(file)
        self.table, self.special = table, re.compile("|".join(map(re.escape, special))) if special else None
        self.missed: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def piece(self, p: str) -> int:
        n = self.table.get(p) or self.missed.get(p)
        if n is None:
            n = len(self.library.encode(p, add_special_tokens=False).ids)
            if len(p) <= LONGEST:
                if len(self.missed) > KEPT:
                    self.missed.clear()
                self.missed[p] = n
        return n

    def plain(self, text: str) -> int:
        if not text:
            return 0
        parted = chunks(text)
        if parted is None:
            return sum(map(self.piece, pieces(text)))
        if len(self.parts) > KEPT:
            self.parts.clear()
        first, rest = parted
        total = sum(map(self.piece, pieces(first)))
        found = list(map(self.parts.get, rest))
        if None in found:
            for i, n in enumerate(found):
                if n is None:
                    found[i] = sum(map(self.piece, pieces(" " + rest[i])))
                    if len(rest[i]) <= LONGEST:
                        self.parts[rest[i]] = found[i]
        return total + sum(found)

    def text(self, text: str | None) -> int:
        """The library takes the strings of special tokens out of a text first, each as one token."""
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(map(self.plain, parts))


def frequent_lengths(docs: DataFrame, file: bytes, most: int = FREQUENT, sampled: int = SAMPLED) -> dict[str, int]:
    """The lengths of the pre-tokens that stand most often in about ``sampled`` documents, chosen by a hash of doc_id and
    counted in one task: no pre-token is shuffled."""
    step = max(1, docs.count() // sampled)
    few = docs.select("text").where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).repartition(1)

    def count(batches):
        from tokenizers import Tokenizer

        c: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                c.update(pieces(text or ""))
            if len(c) > 8 * most:
                c = Counter(dict(c.most_common(4 * most)))
        top = [p for p, _ in c.most_common(most)]
        lengths = [len(e.ids) for e in Tokenizer.from_buffer(file).encode_batch(top, add_special_tokens=False)]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array(lengths, pa.int32())], ["piece", "n"])

    return {r.piece: r.n for r in few.mapInArrow(count, "piece string, n int").collect()}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``, as the library of the vocabulary file ``path``
    counts whole texts, without begin or end tokens. The file is read on the driver and broadcast. Null and empty texts
    have no tokens; repeated rows are counted each."""
    with open(path, "rb") as f:
        file = f.read()
    special = tuple(t["content"] for t in json.loads(file)["added_tokens"])
    shared = docs.sparkSession.sparkContext.broadcast((file, frequent_lengths(docs, file), special))
    ready: list[Lengths] = []

    def run(b: dict) -> dict:
        if not ready:
            ready.append(Lengths(*shared.value))
        n = np.array([ready[0].text(t) for t in b["text"]], np.int64)
        return {"doc_id": b["doc_id"], "n_bytes": [len(t.encode()) if t else 0 for t in b["text"]], "n_tokens": n, "over_limit": n > limit}

    return per_batch(docs.select("doc_id", "text"), f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean", run)
