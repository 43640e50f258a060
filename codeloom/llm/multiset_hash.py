"""Document fingerprints: a homomorphic multiset hash over paragraphs, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lanes that decide equality and lanes that show likeness, all sums modulo 2^32.
EXACT, LIKE, BITS = 8, 64, 32
#: What ends a piece of a paragraph. Each piece adds +1 or -1 to every likeness lane.
PIECE = r"[.!?,;:|\n]+"
#: Range buckets for each shuffle partition.
BUCKETS = 4
LOW = (1 << BITS) - 1


def _adds(of: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda total, x: total + of(x)


def lanes(text: Column) -> tuple[Column, Column]:
    """(exact, pieces): the exact lanes as an array of longs, and the hashes of the pieces. Lane i takes the low half of a
    paragraph's hash under a seed of its own, the hash of i: paragraphs that collide in one lane don't in the others."""
    paragraphs = F.split(text, "\n")
    low = F.lit(LOW)
    exact = [F.aggregate(paragraphs, F.lit(0).cast("long"), _adds(lambda p, i=i: F.xxhash64(F.lit(i), p).bitwiseAND(low)), lambda a: a.bitwiseAND(low)) for i in range(EXACT)]
    pieces = F.transform(F.filter(F.transform(F.split(text, PIECE), lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.xxhash64(p))
    return F.array(*exact), pieces


def likeness_lanes(pieces: Column) -> Column:
    """For each of 64 bits, how many pieces have it set less how many have not, modulo 2^32, which no text's number of
    pieces reaches. Two bits are counted at a time, 32 apart in a long: no sum can run into its neighbour."""
    two = F.lit((1 << 32) | 1)
    packed = [F.aggregate(pieces, F.lit(0).cast("long"), _adds(lambda h, j=j: F.shiftrightunsigned(h, j).bitwiseAND(two))) for j in range(LIKE // 2)]
    count = F.size(pieces).cast("long")
    signed = lambda n: (n * 2 - count).bitwiseAND(F.lit(LOW))
    sums = F.array(*packed)
    return F.concat(F.transform(sums, lambda s: signed(s.bitwiseAND(F.lit(LOW)))), F.transform(sums, lambda s: signed(F.shiftrightunsigned(s, 32))))


def to_hex(exact: Column, like: Column) -> Column:
    return F.array_join(F.transform(F.concat(exact, like), lambda v: F.lpad(F.lower(F.hex(v)), BITS // 4, "0")), "")


def insert(a: Column, b: Column, bits: int = BITS) -> Column:
    """The lanes of two multisets together: what appending paragraphs does to a fingerprint."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit((1 << bits) - 1)))


def delete(a: Column, b: Column, bits: int = BITS) -> Column:
    """The lanes of a without the paragraphs of b."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit((1 << bits) - 1)))


def likeness(exact_a: Column, like_a: Column, exact_b: Column, like_b: Column) -> Column:
    """0 to 1, from two fingerprints alone: 1 if they are equal, else one less the squared distance of their likeness
    lanes over the sum of their squared lengths. That estimates the share of pieces that two texts have in common."""
    signed = lambda x: F.when(x >= 1 << (BITS - 1), x - (1 << BITS)).otherwise(x).cast("double")
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + signed(x) * signed(x))
    apart, whole = square(delete(like_a, like_b)), square(like_a) + square(like_b)
    near = F.when(whole > 0, F.greatest(F.lit(0.0), 1 - apart / whole)).otherwise(0.0)
    return F.when((exact_a == exact_b) & (like_a == like_b), 1.0).otherwise(F.least(near, F.lit(1.0)))


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """Adds ``bucket``: ranges of doc_id of about equal size, and copies the first row of each range to the end of the
    range before it (``ghost``), that of the first to the end of the last (``wrap``). The limits are doc_ids, at most
    ``buckets`` of them; they are looked up in two steps, so that a row meets about twice their square root."""
    found = docs.agg(F.min("order_id").alias("low"), F.percentile_approx("order_id", [k / buckets for k in range(1, buckets)], 10_000 + 10 * buckets).alias("cuts")).first()
    limits = sorted({found.low, *(found.cuts or ())}) if found.low is not None else [0]
    width = max(1, int(len(limits) ** 0.5))
    groups = [limits[k : k + width] for k in range(0, len(limits), width)]
    array = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    at = F.col("order_id")
    below = lambda a: F.size(F.filter(a, lambda s: s <= at))
    coarse = docs.withColumn("_group", below(array([g[0] for g in groups])))
    fine = F.element_at(F.array(*(array(g) for g in groups)), F.col("_group"))
    placed = coarse.withColumn("_inside", below(fine)).withColumn("_first", F.element_at(fine, F.col("_inside")) == at)
    placed = placed.withColumn("bucket", (F.col("_group") - 1) * width + F.col("_inside") - 1)
    before = F.when(F.col("bucket") > 0, F.col("bucket") - 1).otherwise(len(limits) - 1)
    place = lambda b, ghost, wrap: F.struct(b.cast("int").alias("bucket"), ghost.alias("ghost"), wrap.alias("wrap"))
    own, copy = place(F.col("bucket"), F.lit(False), F.lit(False)), place(before, F.lit(True), F.col("bucket") == 0)
    return placed.select("doc_id", "order_id", "text", F.inline(F.when(F.col("_first"), F.array(own, copy)).otherwise(F.array(own))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    A fingerprint is the sum, lane by lane and modulo powers of two, of wide vectors hashed from the paragraphs (lines)
    of a text, in hex: EXACT lanes of whole paragraphs, then LIKE lanes of their pieces. It does not depend on the order
    of paragraphs, and ``insert`` and ``delete`` update it. The edited text has its last floor(n_chars / 4) code points
    replaced by the first as many, or all, of the next document in order of doc_id, the first after the last.

    Null texts count as empty ones. Rows without doc_id, or with one that is no number, come after all others; rows with the same doc_id follow each
    other in order of their texts. A single row is its own next. Other columns are ignored.
    """
    spark = docs.sparkSession
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.expr("try_cast(doc_id AS long)"), F.lit(2**63 - 1)).alias("order_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _bucketed(rows, buckets)
    following = Window.partitionBy("bucket").orderBy("wrap", "order_id", "ghost", "text")
    exact, pieces = lanes(F.col("text"))
    rows = rows.withColumns({"exact": exact, "pieces": pieces}).withColumn("like", likeness_lanes(F.col("pieces"))).drop("pieces")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(following) for c in ("text", "exact", "like")}).where("not ghost")
    n = F.char_length("text")
    out = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - _out)"), F.expr("substring(next_text, 1, _out)"))
    rows = rows.withColumn("_out", out).withColumn("edited", edited)
    exact, pieces = lanes(F.col("edited"))
    rows = rows.withColumns({"e_exact": exact, "e_pieces": pieces}).withColumn("e_like", likeness_lanes(F.col("e_pieces")))
    c = F.col
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(c("edited").cast("binary"), 256).alias("edited_sha256"), to_hex(c("exact"), c("like")).alias("fingerprint"), to_hex(c("e_exact"), c("e_like")).alias("edited_fingerprint"),
        likeness(c("exact"), c("like"), c("e_exact"), c("e_like")).alias("near_edited"), likeness(c("exact"), c("like"), c("next_exact"), c("next_like")).alias("near_next"),
    )
