"""SimHash near-duplicates: popcount embedding, grid range join under Manhattan distance, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut as written
from .common import fresh, per_batch, trimmed, words

#: Cells with more members than this are split into cells of single bits.
DENSE = 24

#: Bands and their least hashes, the members of a bucket that one forest takes, and those of a part of a fuller bucket.
#: A pair at a similarity of 0.8 shares no band with probability (1 - 0.8^5)^32, three in a million; above far less.
BANDS, ROWS, BUCKET = 32, 5, 64
PARTS = 8  # times BUCKET
#: Members of either side of a block in which a full bucket's components are compared, and bytes of their shingles' hashes.
SIDE, SIDE_BYTES = 2048, 1 << 23


def cut(df: DataFrame) -> DataFrame:
    return written(df, large=True)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits, each set if set in over half the XXH64 of the shingles, repeats included. Null and wordless texts: 0."""
    w, h = words(text), xxhash.xxh64_intdigest
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = w[at : at + (1 << 16) + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle)), strict=False) if len(w) >= shingle else [part]
        hashes = np.fromiter((h(b" ".join(g), seed) for g in grams), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, bits): bits holds the fingerprint as a signed long."""
    return per_batch(
        docs.select(F.col("doc_id"), F.col("text")), f"doc_id {dict(docs.dtypes)['doc_id']}, bits long",
        lambda b: {"doc_id": b["doc_id"], "bits": np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64).view(np.int64)},
    )


def _counts(x: str) -> str:
    """SQL: the bit counts of the 16 four-bit segments of x, four bits each. No step can leave the range of a long."""
    half = f"shiftrightunsigned({x}, 1)"
    pairs = f"((({x} ^ {half}) & 6148914691236517205L) | shiftleft({x} & {half} & 6148914691236517205L, 1))"
    return f"(({pairs} & 3689348814741910323L) + (shiftrightunsigned({pairs}, 2) & 3689348814741910323L))"


def _verified(batches):
    """Members of a cell, as lists: the edges of a spanning forest over its pairs at two bits or fewer."""
    for batch in batches:
        u, v = [], []
        for members in batch.column("members").to_pylist():
            m = sorted(set(members))
            a = np.array(m, np.int64).view(np.uint64)
            near = np.argwhere(np.bitwise_count(a[:, None] ^ a[None, :]) <= 2)
            root = list(range(len(m)))

            def find(i, root=root):
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            for i, j in near.tolist():
                if i > j and (x := find(i)) != (y := find(j)):
                    root[max(x, y)] = min(x, y)
                    u.append(m[i])
                    v.append(m[j])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u > v) whose components are those of all pairs of ``distinct.bits`` at two bits or fewer.

    A fingerprint maps to the bit counts of its 16 segments, and the Manhattan distance of two such vectors never
    exceeds the Hamming distance. Two fingerprints two bits apart share a midpoint one bit from each, so both stand in
    the midpoint's grid cell: each fingerprint enters its own cell and those one step away, 33 at most. Cells of up to
    DENSE members are verified by exact distance. Members of fuller cells enter cells of a finer grid, whose segments
    are single bits: there the cell is the midpoint itself, has 65 members at most, and all of them are verified the
    same way. Work grows with the number of fingerprints, whatever the size of their groups.
    """
    step = "shiftleft(1L, 4 * i)"
    at = "(shiftrightunsigned(own, 4 * i) & 15)"
    cells = f"filter(concat(array(own), transform(sequence(0, 15), i -> if({at} < 4, own + {step}, null)), transform(sequence(0, 15), i -> if({at} > 0, own - {step}, null))), c -> c is not null)"
    entered = distinct.select("bits", F.expr(_counts("bits")).alias("own")).select("bits", F.explode(F.expr(cells)).alias("cell"))
    held = entered.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    both = entered.join(held, "cell")
    flips = f"filter(concat(array(bits), transform(sequence(0, 63), i -> bits ^ shiftleft(1L, i))), m -> {_counts('m')} = cell)"
    keyed = both.select("bits", F.explode(F.when(F.col("n") > DENSE, F.expr(flips)).otherwise(F.array("cell"))).alias("key"), (F.col("n") > DENSE).alias("fine"))
    members = keyed.groupBy("fine", "key").agg(F.collect_set("bits").alias("members")).where("size(members) > 1")
    return members.select("members").mapInArrow(trimmed(_verified), "u long, v long").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (u > v): root is the smallest node reachable. Alternates the large-star
    and small-star steps; hubs are reduced by pre-aggregated minima and joins that split, never gathered."""
    edges, before = cut(edges), None
    for _ in range(most):
        mark = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.expr("inline(array(struct(u as u, m as v), struct(v as u, m as v)))")).where("u > v")
        edges = cut(small.distinct())
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints two bits apart or fewer are linked; component_id is the smallest doc_id reachable. Null, empty and
    wordless texts share the fingerprint zero. A row without doc_id takes part; its component's id is the smallest that
    is not null, or null. Repeated rows are returned each.
    """
    own = cut(fingerprints(docs, shingle))
    distinct = cut(own.groupBy("bits").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct.bits == roots.node, "left").select("bits", "first", F.coalesce("root", "bits").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(rooted.join(smallest, "root").select("bits", "component_id"))
    return own.join(named, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """64-bit hashes of the shingles of a text in order, repeats included; fewer words make one shingle, none make none."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    reach = min(shingle, len(w))
    mixed = np.full(len(w) - reach + 1, reach, np.uint64)
    for k in range(reach):
        mixed = (mixed ^ h[k : len(h) - reach + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct hashes; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sketched(batch: dict, shingle: int) -> dict:
    """Of every text: the set's identity and size, its fingerprint, the hashes of its bands and eight bits of each least hash."""
    factors = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(BANDS * ROWS)], np.uint64)
    out = {"doc_id": batch["doc_id"], "text_id": batch["text_id"], "key": [], "grams": [], "bits": [], "bands": [], "sketch": []}
    for text in batch["text"]:
        grams = shingle_hashes(text, shingle)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(grams), 1 << 14):
            ones += np.unpackbits(grams[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        held = np.unique(grams)
        least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(held), 2048):
            least = np.minimum(least, (held[at : at + 2048, None] * factors).min(0))
        out["key"].append(xxhash.xxh3_128_digest(held.tobytes()))
        out["grams"].append(len(held))
        out["bits"].append(np.packbits(ones * 2 > max(1, len(grams)), bitorder="little").view(np.int64)[0])
        out["bands"].append([int(np.int64(np.uint64(xxhash.xxh64_intdigest(b.tobytes())))) for b in least.reshape(BANDS, ROWS)] if len(held) else [])
        out["sketch"].append(((least * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(56)).astype(np.uint8).tobytes())
    return out


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the sketch bytes agree, of each row of ``a`` with each of ``b``."""
    made = np.zeros((len(a), len(b)), np.uint8)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        made += x[:, None] == y[None, :]
    return made


def _sketches(members: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(r["sketch"] for r in members), np.uint8).reshape(len(members), BANDS * ROWS)


def _forest(least: float):
    """Members of a bucket, as lists of (id, sketch): a spanning forest of the likeliest pairs by their sketches,
    without those below ``least``."""

    def run(batches):
        for batch in batches:
            u, v = [], []
            for members in batch.column("members"):  # one bucket's rows at a time
                m = sorted(members.as_py(), key=lambda r: r["id"])
                s = _sketches(m)
                alike = _agreement(s, s) / s.shape[1]
                # Prim's method, from each tree's first member.
                best, by, out = np.full(len(m), -1.0), np.zeros(len(m), int), np.ones(len(m), bool)
                for _ in range(len(m)):
                    at = int(np.argmax(np.where(out, best, -2.0)))
                    if best[at] >= least and at != by[at]:
                        u.append(max(m[at]["id"], m[by[at]]["id"]))
                        v.append(min(m[at]["id"], m[by[at]]["id"]))
                    out[at] = False
                    nearer = alike[at] > best
                    best[nearer], by[nearer] = alike[at][nearer], at
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _across(least: float):
    """Blocks of two parts, as lists of (id, sketch, component, part): their members that agree in ``least`` of their
    sketches with one of another component across the parts."""

    def run(batches):
        for batch in batches:
            out = []
            for band, value, one, other, members in zip(*(batch.column(k).to_pylist() for k in ("band", "value", "a", "b")), batch.column("members"), strict=True):
                m = members.as_py()
                left, right = ([r for r in m if r["part"] == part] for part in (one, other))
                if not left or not right:
                    continue
                roots = [np.array([r["component"] for r in side], np.int64) for side in (left, right)]
                s, t = _sketches(left), _sketches(right)
                near = [np.zeros(len(s), bool), np.zeros(len(t), bool)]
                for at in range(0, len(left), 256):
                    some = slice(at, at + 256)
                    alike = (_agreement(s[some], t) >= least * s.shape[1]) & (roots[0][some, None] != roots[1][None, :])
                    near[0][some] = alike.any(1)
                    near[1] |= alike.any(0)
                found = {r["id"]: r for side, held in zip((left, right), near, strict=True) for r, one_of in zip(side, held, strict=True) if one_of}
                out += [(band, value, one, other, r["id"], r["component"], r["part"]) for r in found.values()]
            yield pa.RecordBatch.from_pylist([dict(zip(_NEAR.names, r, strict=True)) for r in out], schema=_NEAR)

    return run


_NEAR = pa.schema([("band", pa.int32()), *((k, pa.int64()) for k in ("value", "a", "b", "id", "component", "part"))])


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each of the ``left`` sets shares with each of the ``right``, by products of a few columns each;
    elements of one set alone are left out."""
    made = np.zeros((len(left), len(right)))
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[held[column] > 1]
    column = (np.cumsum(held > 1) - 1)[column[held[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    width = min(max(1, (1 << 22) // len(sets)), max(1, columns))
    for at in range(0, columns, width):
        some = slice(*np.searchsorted(column, (at, at + width)))
        block = np.zeros((len(sets), width), np.float32)
        block[row[some], column[some] - at] = 1
        made += block[left] @ block[right].T
    return made


def _joined(similarity: float):
    """Blocks of two parts, as lists of (id, grams, component, part): pairs across the parts at ``similarity`` or more, by
    all their shingles, that connect the components which any such pairs of the block connect."""

    def run(batches):
        for batch in batches:
            u, v = [], []
            for one, other, members in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("members"), strict=True):
                m = sorted(members.as_py(), key=lambda r: r["id"])
                left, right = (np.flatnonzero([r["part"] == part for r in m]) for part in (one, other))
                if not len(left) or not len(right):
                    continue
                sets = [np.frombuffer(r["grams"], np.uint64) for r in m]
                size, root = np.array([len(x) for x in sets]), np.array([r["component"] for r in m], np.int64)
                both = _shared(sets, left, right)
                alike = both / np.maximum(size[left][:, None] + size[right][None, :] - both, 1) >= similarity
                for i in np.flatnonzero(alike.any(1)).tolist():
                    at = right[alike[i]]
                    roots, first = np.unique(root[at], return_index=True)
                    for j in at[first[roots != root[left[i]]]].tolist():
                        u.append(max(m[left[i]]["id"], m[j]["id"]))
                        v.append(min(m[left[i]]["id"], m[j]["id"]))
                    root[np.isin(root, roots)] = root[left[i]]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _buckets(sets: DataFrame, near: DataFrame) -> DataFrame:
    """(band, value, id, grams, n): the buckets of least hashes that agree in a band, and under band -1 those of fingerprints
    that ``near`` connects or that are equal, with their n members, two at least. The entries move once: a window counts
    a bucket where it lies, and spills what a full one holds."""
    grid = sets.join(components(near), F.col("bits") == F.col("node"), "left").select("id", "grams", F.lit(-1).alias("band"), F.coalesce("root", "bits").alias("value"))
    entered = sets.select("id", "grams", F.posexplode("bands").alias("band", "value")).union(grid)
    return cut(entered.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("band", "value"))).where("n > 1"))


def _candidates(sets: DataFrame, near: DataFrame, buckets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u > v) of ``sets`` to begin with: fingerprints within two bits, and of each bucket, or each part of a
    fuller one, a forest."""
    firsts = sets.groupBy("bits").agg(F.min("id").alias("first"))
    alike = sets.join(firsts, "bits").where("id > first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    near = near.join(firsts.toDF("u", "a"), "u").join(firsts.toDF("v", "b"), "v")
    near = near.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    parts = F.when(F.col("n") > BUCKET, F.ceil(F.col("n") / (PARTS * BUCKET))).otherwise(1)
    dealt = buckets.withColumn("part", F.pmod(F.xxhash64("id", "band"), parts))
    # Few rows share a bucket: the sketches travel with those alone.
    members = dealt.join(sets.select("id", "sketch"), "id").groupBy("band", "value", "part").agg(F.collect_list(F.struct("id", "sketch")).alias("members"))
    return alike.union(near).union(members.select("members").mapInArrow(trimmed(_forest(similarity - 0.15)), "u long, v long")).distinct()


def _open(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``buckets`` that hold more than one component, with each row's component, the bucket's largest, and the
    numbers of sides (see SIDE) that this and the other members fill."""
    rooted = buckets.join(roots, buckets.id == roots.node, "left").select(*buckets.columns, F.coalesce("root", "id").alias("component"))
    sizes = rooted.groupBy("band", "value", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("grams").alias("grams"))
    main = sizes.groupBy("band", "value").agg(F.max(F.struct("size", "component", "grams")).alias("main"), F.sum("size").alias("all"), F.sum("grams").alias("of"), F.count(F.lit(1)).alias("held")).where("held > 1")
    sides = lambda members, grams: F.ceil(F.greatest(members / SIDE, grams * 8 / SIDE_BYTES))
    few, many = sides(F.col("all") - F.col("main.size"), F.col("of") - F.col("main.grams")), sides(F.col("main.size"), F.col("main.grams"))
    return cut(rooted.join(main.select("band", "value", F.col("main.component").alias("main"), few.alias("few"), many.alias("many")), ["band", "value"]).select(*rooted.columns, "main", "few", "many"))


def _hubs(opened: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (u > v): each member of a bucket with that of the most links, where their components differ."""
    degrees = edges.select("u").union(edges.select("v")).groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    most = opened.join(degrees, opened.id == degrees.u).groupBy("band", "value").agg(F.max(F.struct("degree", "id", "component")).alias("hub"))
    held = opened.join(most, ["band", "value"]).where("component <> hub.component")
    return held.select(F.greatest("id", "hub.id").alias("u"), F.least("id", "hub.id").alias("v")).distinct()


def _unlinked(opened: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(band, value, a, b, id, component, part): of a bucket's unlike components, by blocks of parts a and b, the members
    that agree in ``least`` of their sketches with one of another component. The members outside the bucket's largest
    component, in parts, meet one another and that component's parts; those of the largest never meet among themselves."""
    turn = lambda of: F.pmod(F.xxhash64("id", "band"), of)
    sided = opened.withColumn("part", F.when(F.col("component") == F.col("main"), -1 - turn(F.col("many"))).otherwise(turn(F.col("few"))))
    blocks = F.expr("""if(part < 0, transform(sequence(0L, few - 1), i -> struct(i as a, part as b)),
        concat(transform(sequence(1L, many), k -> struct(part as a, -k as b)), transform(sequence(0L, few - 1), j -> struct(least(part, j) as a, greatest(part, j) as b))))""")
    dealt = sided.join(sets.select("id", "sketch"), "id").select("band", "value", "id", "sketch", "component", "part", F.inline(blocks))
    members = dealt.groupBy("band", "value", "a", "b").agg(F.collect_list(F.struct("id", "sketch", "component", "part")).alias("members"))
    return members.mapInArrow(trimmed(_across(least)), "band int, value long, a long, b long, id long, component long, part long")


def _confirmed(shingle: int, similarity: float):
    def run(batches):
        for batch in batches:
            u, v, known = [], [], (None, None)
            for one, other, a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                if known[0] != other:
                    known = (other, np.unique(shingle_hashes(b.as_py(), shingle)))
                if jaccard(np.unique(shingle_hashes(a.as_py(), shingle)), known[1]) >= similarity:
                    u.append(one)
                    v.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _text_id(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _grouped(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(own, sets) of the rows with a doc_id: own (doc_id, text_id, key), one for each row, and sets (key, first), one for
    each distinct set of shingles, with the smallest (doc_id, text_id) of its component.

    A row is told by doc_id and text: rows that share the former alone are rows of their own. What is linked are distinct
    sets, under numbers that they are given when they are written."""
    texts = docs.where("doc_id is not null").select("doc_id", "text", _text_id(F.col("text")).alias("text_id"))
    kind = dict(docs.dtypes)["doc_id"]
    own = cut(per_batch(texts, f"doc_id {kind}, text_id string, key binary, grams long, bits long, bands array<long>, sketch binary", lambda b: _sketched(b, shingle)))
    each = own.groupBy("key").agg(F.min_by(F.struct("doc_id", "text_id", "grams", "bits", "bands", "sketch"), F.struct("doc_id", "text_id")).alias("s"))
    sets = cut(each.select(F.monotonically_increasing_id().alias("id"), "key", "s.*"))

    def whole(ids: DataFrame) -> DataFrame:
        names = sets.join(ids.distinct(), "id", "left_semi").select("id", "doc_id", "text_id")
        return texts.join(names, ["doc_id", "text_id"]).dropDuplicates(["doc_id", "text_id"]).select("id", "text")

    def verified(pairs: DataFrame) -> DataFrame:
        both = cut(whole(pairs.select(F.col("u").alias("id")).union(pairs.select("v"))))
        told = pairs.join(both.toDF("u", "a"), "u").join(both.toDF("v", "b"), "v")
        return cut(told.mapInArrow(trimmed(_confirmed(shingle, similarity)), "u long, v long").distinct())

    def joined(near: DataFrame) -> DataFrame:
        hashes = lambda b: {"id": b["id"], "grams": [np.unique(shingle_hashes(t, shingle)).tobytes() for t in b["text"]]}
        held = near.join(cut(per_batch(whole(near.select("id")), "id long, grams binary", hashes)), "id")
        members = held.groupBy("band", "value", "a", "b").agg(F.collect_list(F.struct("id", "grams", "component", "part")).alias("members"))
        return cut(members.select("a", "b", "members").mapInArrow(trimmed(_joined(similarity)), "u long, v long").distinct())

    near = cut(links(sets.select("bits").distinct()))
    buckets = _buckets(sets, near)
    tried = cut(_candidates(sets, near, buckets, similarity))
    edges = verified(tried)
    roots = cut(components(edges))
    opened = _open(buckets, roots)
    pairs = cut(_hubs(opened, edges).join(tried, ["u", "v"], "left_anti"))
    if not pairs.isEmpty() and not (found := verified(pairs)).isEmpty():
        edges = edges.union(found)
        roots = cut(components(edges))
        opened = _open(opened.select(buckets.columns), roots)
    unlike = cut(_unlinked(opened, sets, similarity - 0.15))
    if not unlike.isEmpty() and not (found := joined(unlike)).isEmpty():
        roots = cut(components(edges.union(found)))
    rooted = sets.join(roots, sets.id == roots.node, "left").select("key", F.struct("doc_id", "text_id").alias("own"), F.coalesce("root", "id").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("own").alias("first"))
    return own.select("doc_id", "text_id", "key"), rooted.join(firsts, "root").select("key", "first")


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs`` with a doc_id of any type: rows whose sets of word shingles have a
    Jaccard similarity of ``similarity`` or more are linked; component_id is the smallest doc_id reachable.

    Rows of equal sets are one from the start. Candidates are the pairs of fingerprints (of the same shingles) within two
    bits, by ``links``, and, as a fingerprint of two texts at 0.8 differs in some seven bits, the pairs whose least
    hashes agree in one of BANDS bands of ROWS. Each candidate is verified on the whole texts. Buckets of up to BUCKET
    members, and parts of fuller ones, begin with a spanning forest by sketches of their least hashes. Of buckets that
    still hold several components, every member then meets the one with the most links. Last, in blocks of a bucket's
    members, all pairs of different components that the sketches allow (65 % agreement of 160 bytes, at 0.8 nearly five
    standard deviations below what is expected) are told by products of their sets of shingles, and only pairs that connect
    components leave a block: neither a bucket's size nor a forest's choice takes a pair away, and no row is made for each
    pair. Fingerprints that are equal or connected make buckets as well.
    Null and wordless texts are alike; fewer words than ``shingle`` are one shingle. Repeated rows are returned each, and
    rows that share a doc_id but not a text are each judged by their own.
    """
    own, sets = _grouped(docs, shingle, similarity)
    return own.join(sets, "key").select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component of ``similar`` the row with its smallest doc_id stays,
    once; of rows that share that doc_id, the one whose text has the least MD5. Of different texts that share a doc_id and
    are not alike, each stays. Rows without a doc_id have no name to be dropped by; they stay."""
    _, sets = _grouped(docs, shingle, similarity)
    kept = sets.select("first.doc_id", F.col("first.text_id").alias(fresh(docs, "text_id"))).distinct()
    named = docs.where("doc_id is not null").withColumn(fresh(docs, "text_id"), _text_id(F.col("text")))
    once = named.join(kept, ["doc_id", fresh(docs, "text_id")], "left_semi").dropDuplicates(["doc_id", fresh(docs, "text_id")])
    return once.select(docs.columns).unionByName(docs.where("doc_id is null"))
