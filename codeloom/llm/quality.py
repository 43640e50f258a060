"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, LONGEST, LOWER, cut, in_one_task, labelled_ids, per_batch, slices, within

#: Features: one for each residue of a hash.
SPACE = 1 << 18
#: Labelled documents that training reads at most, in order of a hash of their ids.
LABELLED = 4_000
#: Bytes of their features that reach the task that trains at most.
BYTES = 1 << 28
REPEATED, CAPITALS = 0, 1
_stems: dict[bytes, int] = {}


def _hashes(word: bytes) -> int:
    """The hash of a word's letters and digits, and below it that of the marks that end it."""
    stem, marks = re.match(r"(?s)(.*?)([^\w\s]*)$", word.decode()).groups()
    return (zlib.crc32(stem.encode()) << 32) | (zlib.crc32(marks.encode()) if marks else 0)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashed features of a whole text and their values: words, the marks that end them, pairs of neighbours, and
    one feature for a word that repeats the one before. Root counts, of length one together; none for a wordless text."""
    raw = text.encode() if text else b""
    w = raw.translate(LOWER).split()
    if not w:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    if len(_stems) > KEPT:
        _stems.clear()
    got = [_stems.get(x) for x in w]
    if None in got:
        for i, x in enumerate(got):
            if x is None:
                got[i] = _hashes(w[i])
                if len(w[i]) <= LONGEST:
                    _stems[w[i]] = got[i]
    both = np.array(got, np.uint64)
    stem, marks = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    pairs = stem[:-1] * np.uint64(0x9E3779B1) + stem[1:] * np.uint64(0x85EBCA77)
    upper = sum(raw.count(bytes([c])) for c in range(65, 91))
    index = np.concatenate([stem % np.uint64(SPACE), marks[marks > 0] % np.uint64(SPACE), (pairs >> np.uint64(13)) % np.uint64(SPACE), np.full(int((stem[1:] == stem[:-1]).sum()), REPEATED, np.uint64), np.full(upper // 8, CAPITALS, np.uint64)])
    found, n = np.unique(index.astype(np.int32), return_counts=True)
    value = np.sqrt(n)
    return found, (value / np.sqrt((value**2).sum())).astype(np.float32)


@dataclass
class Weights:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        made = np.zeros(SPACE, np.float32)
        made[self.index] = self.weight
        return made


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 3) -> Weights:
    """Per-coordinate FTRL-proximal on the logistic loss. Without rows of both labels, the weights stay zero."""
    z, n, order = np.zeros(SPACE), np.zeros(SPACE), np.random.default_rng(seed)
    zb = nb = bias = 0.0

    def weight(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = weight(at)
            g0 = 1 / (1 + np.exp(-np.clip(4 * (w @ x) + bias, -30, 30))) - y
            g = 4 * g0 * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            zb += g0 - (np.sqrt(nb + g0 * g0) - np.sqrt(nb)) / alpha * bias
            nb += g0 * g0
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
    w = weight(slice(None))
    at = np.flatnonzero(w)
    return Weights(at.astype(np.int32), (4 * w[at]).astype(np.float32), float(bias))


def learnt(rows: pa.Table) -> dict:
    """The parts of the weights that rows (doc_id, label, at, x) teach, in order of ids and labels."""
    keys = list(zip(rows["doc_id"].to_pylist(), rows["label"].to_pylist(), strict=True))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    at, x = (rows[c].combine_chunks() for c in ("at", "x"))
    w = train([(np.frombuffer(at[i].as_buffer(), np.int32), np.frombuffer(x[i].as_buffer(), np.float32), keys[i][1]) for i in order])
    return {"index": w.index.tobytes(), "weight": w.weight.tobytes(), "bias": w.bias}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", of: int = 5, held: int = 0, bound: int = LABELLED) -> Weights:
    """Learns from at most ``bound`` labelled rows outside the held-out fold (crc32(doc_id as text) mod ``of`` is
    ``held``), as many as BYTES of their features hold. A row is a label and a text: where documents share a doc_id, each
    learns its label. Null and wordless texts have no features and bear on the bias alone."""
    ids = labelled_ids(labels, label, of, held, bound)

    def made(b: dict) -> dict:
        found = [features(t) for t in b["text"]]
        return {"doc_id": b["doc_id"], "label": b["label"], "at": [at.tobytes() for at, _ in found], "x": [x.tobytes() for _, x in found]}

    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # bounded by ``bound``
    rows = cut(per_batch(chosen, f"doc_id {dict(chosen.dtypes)['doc_id']}, label int, at binary, x binary", made))
    rows = within(rows, F.octet_length("at") + F.octet_length("x"), BYTES)  # in one partition
    made = in_one_task(rows, "index binary, weight binary, bias double", learnt)
    return Weights(np.frombuffer(made["index"], np.int32), np.frombuffer(made["weight"], np.float32), made["bias"]) if made else train([])


def score_texts(texts: list[str | None], dense: np.ndarray, bias: float) -> np.ndarray:
    made = np.array([float(dense[at] @ x) for at, x in map(features, texts)], float)
    return 1 / (1 + np.exp(-(made + bias)))


def score(docs: DataFrame, weights: Weights, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``: score is the probability of label 1 given the whole text.
    Null, empty and wordless texts have no features and get the prior that the bias holds; repeated rows are scored each,
    other columns are ignored, and of a long text every word counts."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    dense: list = []

    def run(b: dict) -> dict:
        if not dense:
            dense.append(shared.value.dense())
        s = score_texts(b["text"], dense[0], shared.value.bias)
        return {"doc_id": b["doc_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return per_batch(docs.select("doc_id", "text"), f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int", run)


def keep(docs: DataFrame, weights: Weights, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns, whatever their names, in one pass
    over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    dense: list = []

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            if not dense:
                dense.append(shared.value.dense())
            yield batch.filter(pa.array(score_texts(batch.column("text").to_pylist(), dense[0], shared.value.bias) >= threshold))

    return docs.mapInArrow(run, docs.schema)
