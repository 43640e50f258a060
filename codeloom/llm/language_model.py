"""LM scoring: a log-bilinear model over word classes, trained with noise-contrastive estimation."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEPT, LONGEST, cut, per_batch, slices, trimmed, words

#: Classes of the model: the most frequent words, one each; the other words by their ending; the end of a text.
FREQUENT, ENDINGS = 111, 48
CLASSES = FREQUENT + ENDINGS + 1
END = CLASSES - 1
#: Words whose counts every worker holds. Counts of all others are joined in.
HELD = 1 << 16
#: Width of the vectors by which a word's share of its class follows the class before it, their prior's precision, and the
#: occurrences from which a word has one: with fewer the prior leaves next to nothing of it.
WIDTH, PRECISION, LEAST = 12, 10.0, 4
#: Bits of a held word's place.
PLACE = HELD.bit_length()
#: Steps of training for a corpus of up to TOKENS, and again for each doubling beyond.
STEPS, TOKENS = 1200, 1 << 26
#: Keys that a worker gathers before it counts them, and characters of the texts that it lays out at once.
GATHERED, LAID = 1 << 22, 1 << 19
#: Held words whose counts after each class make a slot of keys, and the slots' width: a key's place in one takes 16 bits.
PLACES = 400
WIDE = PLACES * CLASSES
TRIPLES = CLASSES**3 // WIDE  # slots of three classes' counts, which come first


def ending_class(word: bytes) -> int:
    end = word[-2:]
    return FREQUENT + zlib.crc32(end if end.isascii() else word.decode()[-2:].encode()) % ENDINGS


def _ending_class(word: Column) -> Column:
    return F.lit(FREQUENT) + F.pmod(F.crc32(F.substring(word, -2, 2).cast("binary")), F.lit(ENDINGS))


@dataclass
class LogBilinear:
    """q(u, v) = context[0][u] + context[1][v]; a class w follows u, v with probability softmax(q . target[w] + bias[w])."""

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    before: np.ndarray | None = None  # of each class as the one before, its vector in words' shares of their classes
    log_shares: np.ndarray | None = None  # of each class and the one before it, the log of the shares' sum

    def log_normalisers(self) -> np.ndarray:
        """The natural log of the softmax's denominator for every context, by batched matrix products."""
        made = np.empty((CLASSES, CLASSES), np.float32)
        for u in range(CLASSES):
            s = (self.context[0][u] + self.context[1]) @ self.target.T + self.bias
            top = s.max(1)
            made[u] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return made

    def log_probabilities(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, normalisers: np.ndarray) -> np.ndarray:
        first, second = (c @ self.target.T for c in self.context)
        return first[u, w] + second[v, w] + self.bias[w] - normalisers[u, v]


def train(cells: np.ndarray, counts: np.ndarray, dim: int = 24, steps: int = STEPS, batch: int = 4096, noise: int = 48, rate: float = 0.12, seed: int = 11) -> LogBilinear:
    """Fits the model to the counts of (u, v, w) cells, numbered (u * CLASSES + v) * CLASSES + w, of a whole corpus.

    Each step draws a batch of cells by their counts and one set of noise classes from the smoothed class frequencies,
    and takes an AdaGrad step on the noise-contrastive objective. No cells: the uniform model."""
    rng = np.random.default_rng(seed)
    model = LogBilinear(rng.normal(0, 0.1, (2, CLASSES, dim)).astype(np.float32), rng.normal(0, 0.1, (CLASSES, dim)).astype(np.float32), np.zeros(CLASSES, np.float32))
    if not len(cells):
        model.context[:] = 0
        return model
    unigram = np.bincount(cells % CLASSES, counts, CLASSES) + 1.0
    unigram /= unigram.sum()
    model.bias[:] = np.log(unigram)
    noisy = unigram**0.75 / (unigram**0.75).sum()
    shift = np.log(noise * noisy).astype(np.float32)
    reach = np.cumsum(counts, dtype=np.float64)
    squares = [np.full_like(a, 1e-3) for a in (model.context, model.target, model.bias)]

    def step(k: int, a: np.ndarray, gradient: np.ndarray) -> None:
        squares[k] += gradient**2
        a += rate * gradient / np.sqrt(squares[k])

    for _ in range(steps):
        drawn = cells[np.searchsorted(reach, rng.random(batch) * reach[-1], "right").clip(0, len(cells) - 1)]
        u, v, w = drawn // CLASSES**2, drawn // CLASSES % CLASSES, drawn % CLASSES
        n = rng.choice(CLASSES, noise, p=noisy)
        q = model.context[0][u] + model.context[1][v]
        own = np.einsum("ij,ij->i", q, model.target[w]) + model.bias[w] - shift[w]
        other = q @ model.target[n].T + model.bias[n] - shift[n]
        g = 1 / (1 + np.exp(own.clip(-30, 30)))
        h = -1 / (1 + np.exp(-other.clip(-30, 30)))
        dq = g[:, None] * model.target[w] + h @ model.target[n]
        target, bias, context = np.zeros_like(model.target), np.zeros_like(model.bias), np.zeros_like(model.context)
        np.add.at(target, w, g[:, None] * q)
        np.add.at(target, n, h.T @ q)
        bias += np.bincount(w, g, CLASSES).astype(np.float32) + np.bincount(n, h.sum(0), CLASSES).astype(np.float32)
        np.add.at(context[0], u, dq)
        np.add.at(context[1], v, dq)
        for k, (a, d) in enumerate(((model.context, context), (model.target, target), (model.bias, bias))):
            step(k, a, d / batch)
    return model


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): the count of each word in all texts, and under '' that of the ends, one for each text."""

    def count(b: dict) -> Iterator[dict]:
        c: Counter = Counter()
        c[b""] = len(b["text"])
        for text in b["text"]:
            c.update(words(text))
            if len(c) > KEPT:
                yield {"word": [w.decode() for w in c], "c": list(c.values())}
                c.clear()
        yield {"word": [w.decode() for w in c], "c": list(c.values())}

    return per_batch(docs.select("text"), "word string, c long", count).groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


def frequent(counts: DataFrame, most: int) -> pa.Table:
    """(word, c): the words from the least count on from which there are ``most`` or fewer, by sixteenths of a power of
    two. Only a histogram of the counts and these words reach the driver."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 16)
    held, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        held += r.n
        if held > most:
            break
        least = r.step
    return counts.where(step >= least if least is not None else F.lit(False)).select("word", "c", *(["vector"] if "vector" in counts.columns else [])).toArrow()


@dataclass
class Lexicon:
    """What every worker holds of the counts; its size is bounded by HELD and CLASSES."""

    held: dict[bytes, int]  # (count * CLASSES + class) * 2 * HELD + place of its vector
    vectors: np.ndarray
    total: int
    distinct: int
    in_class: np.ndarray  # of each class, the counts and the number of words that stand in it

    @classmethod
    def of(cls, counts: DataFrame) -> Lexicon:
        rows = frequent(counts.where("word <> ''"), HELD)
        top = sorted(zip(rows["word"].to_pylist(), rows["c"].to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
        first = {w.encode(): k for k, (w, _) in enumerate(top[:FREQUENT])}
        held = {w.encode(): c * CLASSES + first.get(w.encode(), -1) for w, c in top}
        held = {w: ((x if w in first else x + 1 + ending_class(w)) << PLACE) + k for k, (w, x) in enumerate(held.items())}
        vectors = np.zeros((len(top), WIDTH), np.float32)
        if "vector" in rows.column_names:
            at = {w: k for k, (w, _) in enumerate(top)}
            for w, v in zip(rows["word"].to_pylist(), rows["vector"].to_pylist(), strict=True):
                if v is not None:
                    vectors[at[w]] = v
        grouped = counts.where(~F.col("word").isin("", *(w.decode() for w in first))).groupBy(_ending_class(F.col("word")).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
        in_class = np.zeros((2, CLASSES))
        for r in grouped:
            in_class[:, r.k] = r.c, r.n
        total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
        return cls(held, vectors, total[0] or 0, total[1], in_class)


class _Classes(dict):
    """Packed counts, classes and places of words in a worker. A word that the lexicon lacks is
    -1 - (number * CLASSES + class), its number being its place in ``missed``; ``forget`` drops these when they are many."""

    def __init__(self, lexicon: Lexicon):
        super().__init__(lexicon.held)
        self.held, self.missed, self.size = lexicon.held, [], 0

    def __missing__(self, word: bytes) -> int:
        self[word] = packed = -1 - (len(self.missed) * CLASSES + ending_class(word))
        self.missed.append(word)
        self.size += len(word)
        return packed

    def of(self, w: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, w), np.int64, len(w))

    @property
    def full(self) -> bool:
        return len(self.missed) > KEPT or self.size > KEPT * LONGEST

    def forget(self) -> None:
        self.clear()
        self.update(self.held)
        self.missed, self.size = [], 0

    def names(self, numbers: np.ndarray) -> pa.Array:
        """The missed words of these numbers."""
        each, at = np.unique(numbers, return_inverse=True)
        return pa.array([self.missed[i].decode() for i in each.tolist()], pa.string()).take(pa.array(at))


@dataclass
class _Laid:
    """Texts in one row of classes, each after two ends and before one: the words of all texts, packed, and where they stand."""

    packed: np.ndarray
    text: np.ndarray  # of each word, the text that it is from
    size: np.ndarray  # of each text
    row: np.ndarray
    at: np.ndarray  # of each word, its place in the row
    ends: np.ndarray  # of each text's end

    @classmethod
    def of(cls, texts: list[str | None], classes: _Classes) -> _Laid:
        parts = [words(t) for t in texts]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        w = list(chain.from_iterable(parts))
        packed, text = classes.of(w), np.repeat(np.arange(len(parts)), size)
        at = np.arange(len(w)) + 3 * text + 2
        row = np.full(len(w) + 3 * len(parts), END, np.int64)
        row[at] = np.where(packed < 0, -1 - packed, packed >> PLACE) % CLASSES
        return cls(packed, text, size, row, at, np.cumsum(size) + 3 * np.arange(len(parts)) + 2)


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of LAID characters, about; a longer text is one of its own."""
    at = held = 0
    for k, t in enumerate(texts):
        held += len(t or "") + 1
        if held > LAID or k + 1 == len(texts):
            yield at, k + 1
            at, held = k + 1, 0


def gathered(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(slot, at, n, word, x), from one pass over all texts; parts of a count are summed by those who read it. A key below
    CLASSES cubed is a class after two others, a text being preceded by two ends; keys beyond are a held word's place and
    the class before it. Keys are counted by slots of WIDE: at and n hold a slot's keys, without its first, and their
    counts as 16 and 32 bits. With a word, which is one that workers don't hold, x is n * CLASSES + the class before it.
    Words that are classes of their own have only keys of classes."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def count(batches):
        classes, keys, rare, held = _Classes(shared.value), [], [], 0
        schema = pa.schema([("slot", pa.int32()), ("at", pa.binary()), ("n", pa.binary()), ("word", pa.string()), ("x", pa.int64())])

        def slots() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
            slot, key = key // WIDE, (key % WIDE).astype(np.uint16)
            starts = np.flatnonzero(np.diff(slot, prepend=-1))
            ends = np.append(starts, len(key)).tolist()
            parts = [slice(*x) for x in zip(ends[:-1], ends[1:], strict=True)]
            keys.clear()
            out = [pa.array(slot[starts], pa.int32()), *(pa.array([a[x].tobytes() for x in parts], pa.binary()) for a in (key, n.astype(np.uint32)))]
            return pa.RecordBatch.from_arrays([*out, pa.nulls(len(parts), pa.string()), pa.nulls(len(parts), pa.int64())], schema=schema)

        def missed() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate([np.zeros(0, np.int64), *rare]), return_counts=True)
            rare.clear()
            none = [pa.nulls(len(key), f.type) for f in list(schema)[:3]]
            return pa.RecordBatch.from_arrays([*none, classes.names(key // CLASSES), pa.array(n * CLASSES + key % CLASSES)], schema=schema)

        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column(0).to_pylist()
            for a, b in _parts(texts):
                laid = _Laid.of(texts[a:b], classes)
                p, k, before = np.append(laid.at, laid.ends), laid.row[laid.at], laid.row[laid.at - 1]
                own, lacked = (k >= FREQUENT) & (laid.packed >= 0), laid.packed < 0
                keys.append((laid.row[p - 2] * CLASSES + laid.row[p - 1]) * CLASSES + laid.row[p])
                keys.append(CLASSES**3 + (laid.packed[own] & ((1 << PLACE) - 1)) * CLASSES + before[own])
                rare.append((-1 - laid.packed[lacked]) // CLASSES * CLASSES + before[lacked])
                held += len(keys[-1]) + len(keys[-2])
                if held > GATHERED:
                    yield slots()
                    held = 0
                if classes.full or sum(map(len, rare)) > GATHERED:
                    yield missed()
                    classes.forget()
        yield slots()
        yield missed()

    return docs.select("text").mapInArrow(count, "slot int, at binary, n binary, word string, x long")


def summed(found: DataFrame) -> DataFrame:
    """(slot, at, n) of what ``gathered`` found, a row for each slot, with counts of 64 bits."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slot not in held:
                    held[slot] = np.zeros(WIDE, np.int64)
                held[slot][np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
        for slot, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([n[at].tobytes()], pa.binary())], ["slot", "at", "n"])

    return found.where("slot is not null").select("slot", "at", "n").repartition("slot").mapInArrow(trimmed(add), "slot int, at binary, n binary")


def word_vectors(found: DataFrame, slots: DataFrame, lexicon: Lexicon, before: np.ndarray, expected: np.ndarray) -> DataFrame:
    """(word, vector) for every word that shares its class and occurs LEAST times in what ``gathered`` and ``summed`` found:
    the vector r under which the word's share of its class changes by exp(r . before[v]) after class v. It maximises the
    Poisson likelihood of how often the word follows each class, of which ``expected`` is the share of each v in its class,
    with a normal prior; each word is a convex problem of its own, solved by Newton's steps."""
    outer = (before[:, :, None] * before[:, None, :]).reshape(CLASSES, -1)
    shared = found.sparkSession.sparkContext.broadcast(list(lexicon.held))

    def solved(w: list[bytes], n: np.ndarray) -> pa.RecordBatch:
        due = n.sum(1)[:, None] * expected[[ending_class(x) for x in w]]
        r = np.zeros((len(w), WIDTH))
        for _ in range(5):
            rate = due * np.exp((r @ before.T).clip(-8, 8))
            slope = (n - rate) @ before - PRECISION * r
            curve = (rate @ outer).reshape(-1, WIDTH, WIDTH) + PRECISION * np.eye(WIDTH)
            r += np.linalg.solve(curve, slope[:, :, None])[:, :, 0].clip(-1, 1)
        vectors = pa.ListArray.from_arrays(np.arange(0, r.size + 1, WIDTH, dtype=np.int32), pa.array(r.ravel().astype(np.float32)))
        return pa.RecordBatch.from_arrays([pa.array([x.decode() for x in w], pa.string()), vectors], ["word", "vector"])

    def of_slots(batches):
        for batch in batches:
            for slot, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.zeros(WIDE)
                counts[np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.int64)
                rows = np.flatnonzero((counts := counts.reshape(PLACES, CLASSES)).sum(1) >= LEAST)
                if len(rows):
                    yield solved([shared.value[(slot - TRIPLES) * PLACES + i] for i in rows.tolist()], counts[rows])

    def of_words(batches):
        for batch in batches:
            for part in (batch.slice(at, 2048) for at in range(0, batch.num_rows, 2048)):
                after = part.column(1)
                x, row = after.flatten().to_numpy(), np.repeat(np.arange(part.num_rows), after.value_lengths().to_numpy())
                n = np.bincount(row * CLASSES + x % CLASSES, x // CLASSES, part.num_rows * CLASSES).reshape(-1, CLASSES)
                yield solved([w.encode() for w in part.column(0).to_pylist()], n)

    rare = found.where("word is not null").groupBy("word").agg(F.collect_list("x").alias("after"), F.sum(F.floor(F.col("x") / CLASSES)).alias("all")).where(F.col("all") >= LEAST)
    made = "word string, vector array<float>"
    return slots.where(F.col("slot") >= TRIPLES).mapInArrow(trimmed(of_slots), made).union(rare.select("word", "after").mapInArrow(trimmed(of_words), made))


def log_shares(counts: DataFrame, before: np.ndarray, in_class: np.ndarray) -> np.ndarray:
    """The log of the sum, over the words of each class, of their shares after each class. Words without a vector, and what
    no text of training has, which stands for one word, are not changed by the class before them."""

    def add(b: dict) -> dict:
        more = np.zeros((CLASSES, CLASSES))
        for at in range(0, len(b["word"]), 4096):
            r = np.array(b["vector"][at : at + 4096], np.float32).reshape(-1, WIDTH)
            k = np.array([ending_class(x.encode()) for x in b["word"][at : at + 4096]], np.int64)
            order = np.argsort(k, kind="stable")
            starts = np.flatnonzero(np.diff(k[order], prepend=-1))
            e = (np.array(b["c"][at : at + 4096])[:, None] + 1.0) * np.expm1(r.astype(float) @ before.T)
            if len(k):
                more[k[order][starts]] += np.add.reduceat(e[order], starts)
        return {"k": np.arange(CLASSES), "more": more.tolist()}

    parts = per_batch(counts.where("vector is not null").select("word", "c", "vector"), "k int, more array<double>", add)
    summed = parts.select("k", F.posexplode("more").alias("v", "x")).groupBy("k", "v").agg(F.sum("x").alias("x")).toArrow()
    whole = in_class.sum(0) + 1
    total = np.repeat(whole[:, None], CLASSES, 1)
    np.add.at(total, (summed["k"].to_numpy(), summed["v"].to_numpy()), summed["x"].to_numpy())
    made = np.log(total) - np.log(whole)[:, None]
    made[:FREQUENT] = made[END] = 0
    return made


def fit(training: DataFrame, **settings) -> tuple[DataFrame, Lexicon, LogBilinear]:
    """Counts all words of ``training``, then all class contexts and the class before each word, and trains the model on
    the class contexts: at most CLASSES cubed numbers reach the driver, whatever the size of the corpus. Every word that
    shares its class and occurs LEAST times then gets a vector, a row of the counts, from all its occurrences: the vectors
    are as many as those words and stay with the workers."""
    counts = cut(word_counts(training))
    lexicon = Lexicon.of(counts)
    found = cut(gathered(training, lexicon))
    slots = cut(summed(found))
    rows = slots.where(F.col("slot") < TRIPLES).toArrow().to_pylist()
    cells = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["at"], np.uint16).astype(np.int64) + r["slot"] * WIDE for r in rows)])
    n = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["n"], np.int64) for r in rows)])
    order = np.argsort(cells)
    steps = settings.pop("steps", int(STEPS * (1 + np.log2(max(1.0, lexicon.total / TOKENS)))))
    model = train(cells[order], n[order].astype(np.float64), steps=steps, **settings)
    seen = np.zeros((CLASSES, CLASSES))  # class, class before it
    np.add.at(seen, (cells % CLASSES, cells // CLASSES % CLASSES), n)
    # The vectors of the classes before, without their mean and of unit variance, in their widest directions.
    weight = seen[FREQUENT:END].sum(0) / max(1.0, seen[FREQUENT:END].sum())
    centred = model.context[1] - weight @ model.context[1]
    _, size, axes = np.linalg.svd(centred * np.sqrt(weight)[:, None], full_matrices=False)
    model.before = centred @ axes[:WIDTH].T / np.maximum(size[:WIDTH], 1e-3)
    model.before = model.before / np.maximum(1.0, np.linalg.norm(model.before, axis=1, keepdims=True) / np.sqrt(4 * WIDTH))
    vectors = word_vectors(found, slots, lexicon, model.before, seen / np.maximum(1.0, seen.sum(1, keepdims=True)))
    counts = cut(counts.join(vectors, "word", "left"))
    model.log_shares = log_shares(counts, model.before, lexicon.in_class)
    return counts, Lexicon.of(counts), model


def score(docs: DataFrame, counts: DataFrame, lexicon: Lexicon, model: LogBilinear) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    base_score is the add-one unigram log10 probability. score is the model's: of each token's class after the two
    classes before it, times the share of the word in its class, add-one over the class's words and one for all words
    that training lacks, as the word's vector changes it after the class before. Counts and vectors that the workers don't hold are joined by word; those words are rare, so that no join
    key is hot. Null and empty texts are one end. Without training tokens, base_score is 0 and the model uniform.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, model, {r.word: r.c for r in counts.where("word = ''").collect()}.get("", 0)))
    base_all = float(np.log10(lexicon.total + lexicon.distinct + 1))
    ready: list = []

    def run(b: dict) -> Iterator[dict]:
        lexicon, model, ends = shared.value
        if not ready:
            ready.extend((_Classes(lexicon), model.log_normalisers(), np.log10(lexicon.in_class.sum(0) + 1)))
        classes, normalisers, shares = ready
        for a, z in _parts(b["text"]):
            laid = _Laid.of(b["text"][a:z], classes)
            of, size, packed = laid.text, laid.size, laid.packed
            k, v = laid.row[laid.at], laid.row[laid.at - 1]
            c = np.where(packed < 0, 0, (packed >> PLACE) // CLASSES)
            logs, each = np.log10(c + 1.0), lambda x, at=slice(None): np.bincount(of[at], x, len(size))  # noqa: B023
            p = each(model.log_probabilities(laid.row[laid.at - 2], v, k, normalisers))
            p += model.log_probabilities(laid.row[laid.ends - 2], laid.row[laid.ends - 1], np.full(len(size), END), normalisers)
            tail = (k >= FREQUENT) & (k < END)
            known = tail & (packed >= 0)
            p -= each(model.log_shares[k[tail], v[tail]], tail)
            p += each(np.einsum("ij,ij->i", lexicon.vectors[packed[known] & ((1 << PLACE) - 1)], model.before[v[known]]), known)
            missed, of_all = np.flatnonzero(packed < 0), max(1, len(classes.missed))
            key, n = np.unique((of[missed] * of_all + (-1 - packed[missed]) // CLASSES) * CLASSES + v[missed], return_counts=True)
            held = pa.StructArray.from_arrays([classes.names(key // CLASSES % of_all), pa.array(key % CLASSES, pa.int32()), pa.array(n, pa.int64())], ["word", "v", "n"])
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(key // (of_all * CLASSES), np.arange(len(size) + 1)), pa.int32()), held)
            if classes.full:
                classes.forget()
            yield {
                "doc_id": b["doc_id"][a:z], "n": size + 1, "known": np.bincount(of[c > 0], minlength=len(size)) + (ends > 0), "base": each(logs) + np.log10(ends + 1.0) - (size + 1) * base_all,
                "model": p / np.log(10) + each(logs[tail], tail) - each(shares[k[tail]], tail), "rare": rare,
            }

    passed = cut(
        per_batch(docs.select("doc_id", "text"), f"doc_id {dict(docs.dtypes)['doc_id']}, n long, known long, base double, model double, rare array<struct<word: string, v: int, n: long>>", run)
        .withColumn("row", F.monotonically_increasing_id())
    )
    before = docs.sparkSession.createDataFrame([(v, x) for v, x in enumerate(model.before.astype(float).tolist())], "v int, x array<double>")
    rare = passed.select("row", F.inline("rare")).join(counts, "word").join(F.broadcast(before), "v")
    bent = sum((F.col("vector")[i] * F.col("x")[i] for i in range(WIDTH)), F.lit(0.0))
    rare = rare.groupBy("row").agg(
        F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("gain"), F.sum(F.col("n") * F.coalesce(bent, F.lit(0.0)) / float(np.log(10))).alias("bent")
    )
    gain, more, bent = F.coalesce("gain", F.lit(0.0)), F.coalesce("more", F.lit(0)), F.coalesce("bent", F.lit(0.0))
    return passed.drop("rare").join(rare, "row", "left").select(
        "doc_id", F.col("n").alias("n_tokens"), (F.col("known") + more).alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"), (F.col("model") + gain + bent).alias("score"),
    )
