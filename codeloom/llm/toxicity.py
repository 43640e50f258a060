"""Toxicity: a factorization machine over hashed terms, so that pairs of terms weigh more than their sum."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, LONGEST, cut, in_one_task, labelled_ids, per_batch, slices, within, words

#: Hashed terms, and how many of those whose presence tells about the label the machine keeps at most.
SPACE, TERMS = 1 << 24, 1536
#: The least log likelihood ratio of a term that is kept; by chance one term in some thousands reaches it.
LEAST_GAIN = 5.0
#: Frequent terms that are tried in pairs, with each other and with those that tell alone, and the least log likelihood
#: ratio of a pair over what its two terms tell; by chance no pair of millions reaches it.
PAIRED, LEAST_PAIR = 1024, 30.0
#: Labelled documents that training reads at most, in order of a hash of their ids, and terms of theirs.
LABELLED, ENTRIES = 12_000, 1 << 24
#: A word stands for itself and, where it is longer, for its first letters.
PREFIXES = (3, 4, 5, 7)


def terms(word: bytes) -> tuple[int, ...]:
    """The hashed terms of a word: itself without marks at its ends, and its prefixes."""
    w = re.sub(r"^[\W_]+|[\W_]+$", "", word.decode())
    if not w:
        return ()
    made = [zlib.crc32(w.encode()) % SPACE]
    made += [zlib.crc32(f"{w[:k]}*".encode()) % SPACE for k in PREFIXES if len(w) >= k]
    return tuple(made)


@dataclass
class Machine:
    """score = sigmoid(bias + w . x + the sum over pairs i < j of (v_i . v_j) x_i x_j), x of a text's kept terms."""

    term: np.ndarray  # sorted
    weight: np.ndarray
    factor: np.ndarray
    bias: float

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        if not len(at):
            return self.bias
        xv = self.factor[at] * x[:, None]
        total = xv.sum(0)
        return self.bias + float(self.weight[at] @ x + 0.5 * (total @ total - (xv * xv).sum()))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], term: np.ndarray, dim: int = 6, rounds: int = 60, batch: int = 128, rate: float = 0.1, decay: float = 2e-5, seed: int = 5) -> Machine:
    """Fits the machine with AdaGrad on the logistic loss. rows: places in ``term``, values, label. Without both labels
    the machine gives the smoothed share of label 1."""
    rng, k = np.random.default_rng(seed), len(term)
    y = np.array([r[2] for r in rows], np.float32)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    w, v, b = np.zeros(k, np.float32), rng.normal(0, 0.02, (k, dim)).astype(np.float32), float(np.log(prior / (1 - prior)))
    if not 0 < y.sum() < len(y):
        return Machine(term, w, v * 0, b)
    sw, sv, sb = np.full(k, 1e-2, np.float32), np.full((k, dim), 1e-2, np.float32), 1e-2
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x = np.zeros((len(part), k), np.float32)
            for i, r in enumerate(part):
                x[i, rows[r][0]] = rows[r][1]
            xv = x @ v
            margin = b + x @ w + 0.5 * ((xv**2).sum(1) - (x**2 @ (v**2)).sum(1))
            g = (1 / (1 + np.exp(-margin.clip(-30, 30))) - y[part]) / len(part)
            gw = x.T @ g + decay * w
            gv = x.T @ (g[:, None] * xv) - v * ((x**2).T @ g)[:, None] + decay * v
            gb = float(g.sum())
            sw, sv, sb = sw + gw**2, sv + gv**2, sb + gb**2
            w, v, b = w - rate * gw / np.sqrt(sw), v - rate * gv / np.sqrt(sv), b - rate * gb / sb**0.5
    return Machine(term, w, v, b)


def telling_pairs(held: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which columns of ``held`` (documents x terms, presence in bytes) stand in a pair that tells about the label what its
    two terms don't tell alone: documents with both have label 1 unlike the sum of both terms' log odds. The counts of all
    pairs are products of the presence matrix, a slice of documents at a time."""
    terms = held.shape[1]
    both, both_pos = np.zeros((terms, terms), np.float32), np.zeros((terms, terms), np.float32)
    for at in range(0, len(held), 1024):
        part, marked = held[at : at + 1024].astype(np.float32), held[at : at + 1024][label[at : at + 1024] > 0].astype(np.float32)
        both += part.T @ part
        both_pos += marked.T @ marked
    n, pos = both.diagonal().copy(), both_pos.diagonal().copy()
    prior = min(max(float(label.mean()), 1e-3), 1 - 1e-3) if len(label) else 0.5
    odds = lambda s: np.log(s / (1 - s))
    own = odds((pos + prior) / (n + 1))
    out = np.zeros(terms, bool)
    for at in range(0, terms, 256):
        some = slice(at, at + 256)
        due = 1 / (1 + np.exp(-(own[some, None] + own[None, :] - odds(prior)).clip(-6.9, 6.9)))
        neg = both[some] - both_pos[some]
        gain = both_pos[some] * np.log(np.maximum(both_pos[some], 1e-9) / np.maximum(both[some] * due, 1e-9)) + neg * np.log(np.maximum(neg, 1e-9) / np.maximum(both[some] * (1 - due), 1e-9))
        # Terms that stand in the same documents are one to the label.
        found = (gain >= LEAST_PAIR) & (both[some] < 0.9 * np.minimum(n[some, None], n[None, :]))
        out[some] |= found.any(1)
        out |= found.any(0)
    return out


def among(tried: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, term, n) of rows (doc_id, label, found): of what they have found, the terms in ``tried``."""
    for batch in (part for whole in batches for part in slices(whole)):
        found = batch.column("found")
        entries = found.flatten()
        term, n = (entries.field(k).to_numpy(zero_copy_only=False) for k in ("term", "n"))
        inside = np.isin(term, tried)
        ends = np.append(0, np.cumsum(inside))[np.append(0, np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False)))]
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v[inside], pa.int32())) for v in (term, n)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], names=["doc_id", "label", "term", "n"])


def learnt(tried: np.ndarray, alone: np.ndarray, rows: pa.Table) -> dict:
    """The parts of the machine that ordered rows (label, term, n) teach, their terms in ``tried``."""
    label_of = rows["label"].to_numpy().astype(np.float32)
    lists = rows["term"].combine_chunks()
    place = np.searchsorted(tried, lists.flatten().to_numpy())
    count = rows["n"].combine_chunks().flatten().to_numpy()
    size_of = lists.value_lengths().to_numpy()
    presence = np.zeros((len(label_of), len(tried)), np.uint8)
    presence[np.repeat(np.arange(len(label_of)), size_of), place] = 1
    kept = np.isin(tried, alone) | telling_pairs(presence, label_of)
    new = np.cumsum(kept) - 1
    ends, out = np.cumsum(np.append(0, size_of)), []
    for i, y in enumerate(label_of):
        at, x = place[ends[i] : ends[i + 1]], count[ends[i] : ends[i + 1]]
        held_in = kept[at]
        out.append((new[at[held_in]], np.log1p(x[held_in].astype(np.float32)), int(y)))
    m = train(out, tried[kept])
    return {"term": m.term.tobytes(), "weight": m.weight.tobytes(), "factor": m.factor.tobytes(), "bias": float(m.bias)}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", of: int = 3, held: int = 1, bound: int = LABELLED) -> Machine:
    """Learns from at most ``bound`` labelled rows outside the held-out fold (crc32(doc_id as text) mod ``of`` is
    ``held``), as many as ENTRIES of their terms hold. A row is a label and a text: where documents share a doc_id, each
    learns its label.

    The machine gets two kinds of terms. Those that stand with label 1 more than by chance, by the likelihood ratio of
    their presence and the label, the TERMS best. And those that tell in pairs alone (``telling_pairs``), among the former
    and the PAIRED most frequent others: a mention that is harmless by itself."""
    ids = labelled_ids(labels, label, of, held, bound)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # bounded by ``bound``

    def made(b: dict) -> dict:
        cache: dict[bytes, tuple[int, ...]] = {}
        out = []
        for text in b["text"]:
            found: dict[int, int] = {}
            for w in words(text):
                got = cache.get(w)
                if got is None:
                    got = cache[w] = terms(w)
                for t in got:
                    found[t] = found.get(t, 0) + 1
            out.append([{"term": t, "n": n} for t, n in found.items()])
        return {"doc_id": b["doc_id"], "label": b["label"], "found": out}

    rows = cut(per_batch(chosen, f"doc_id {dict(chosen.dtypes)['doc_id']}, label int, found array<struct<term: int, n: int>>", made))
    rows = cut(within(rows, F.size("found").cast("long"), ENTRIES))
    size = rows.agg(F.count(F.lit(1)), F.sum(F.col("label").cast("long"))).first()
    all_n, all_pos = float(size[0]), float(size[1] or 0)
    seen = rows.select("label", F.inline("found")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("pos")).where("n >= 3")
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    share, rest = max(all_pos / max(all_n, 1), 1e-9), max(1 - all_pos / max(all_n, 1), 1e-9)
    gain = part(pos, n * share) + part(n - pos, n * rest) + part(all_pos - pos, (all_n - n + 1e-9) * share) + part(all_n - n - all_pos + pos, (all_n - n + 1e-9) * rest)
    seen = cut(seen.withColumn("gain", F.when(pos > n * share, gain).otherwise(0.0)))
    alone = [r.term for r in seen.where(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "term").limit(TERMS).collect()]
    # Lists of terms go to the workers: as literals of a plan they would be thousands of nodes in the driver.
    frequent, own = seen.orderBy(F.desc("n"), "term").limit(PAIRED + len(alone)).select("term").collect(), set(alone)
    others = [r.term for r in frequent if r.term not in own][:PAIRED]
    tried = np.sort(np.array(alone + others, np.int32))
    kind = dict(rows.dtypes)["doc_id"]
    narrow = rows.select("doc_id", "label", "found").mapInArrow(partial(among, tried), f"doc_id {kind}, label int, term array<int>, n array<int>")
    narrow = narrow.repartition(1).sortWithinPartitions("doc_id", "label").select("label", "term", "n")
    made = in_one_task(narrow, "term binary, weight binary, factor binary, bias double", partial(learnt, tried, np.array(alone, np.int32)))
    if not made:
        return train([], tried)
    term, weight, factor = (np.frombuffer(made[k], kind) for k, kind in (("term", np.int32), ("weight", np.float32), ("factor", np.float32)))
    return Machine(term, weight, factor.reshape(len(term), -1) if len(term) else np.zeros((0, 1), np.float32), made["bias"])


class Scorer:
    def __init__(self, machine: Machine):
        self.machine, self.place, self.seen = machine, {int(t): i for i, t in enumerate(machine.term)}, {}

    def score(self, text: str | None) -> float:
        if len(self.seen) > KEPT:
            self.seen.clear()
        found: dict[int, int] = {}
        get = self.seen.get
        for w in words(text):
            got = get(w)
            if got is None:
                got = tuple(self.place[t] for t in terms(w) if t in self.place)
                if len(w) <= LONGEST:
                    self.seen[w] = got
            for t in got:
                found[t] = found.get(t, 0) + 1
        at = np.fromiter(found, np.int64, len(found))
        margin = self.machine.margin(at, np.log1p(np.fromiter(found.values(), np.float32, len(found))))
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def _scorer(shared, ready: list) -> Scorer:
    if not ready:
        ready.append(Scorer(shared.value))
    return ready[0]


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``: score is the probability that the whole text is toxic.
    Null, empty and wordless texts have no terms and get what the bias says; repeated rows are scored each, other columns
    are ignored, and of a long text every word counts."""
    shared, ready = docs.sparkSession.sparkContext.broadcast(machine), []

    def run(b: dict) -> dict:
        s = np.array([_scorer(shared, ready).score(t) for t in b["text"]], float)
        return {"doc_id": b["doc_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return per_batch(docs.select("doc_id", "text"), f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int", run)


def keep(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score less than ``threshold``, with all their columns, whatever their names, in one pass
    over the texts."""
    shared, ready = docs.sparkSession.sparkContext.broadcast(machine), []

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            yield batch.filter(pa.array([_scorer(shared, ready).score(t) < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
