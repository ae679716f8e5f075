"""Components of similar sets from buckets of candidates, without the pairs of a bucket.

Whoever shares a bucket may be similar and is to be compared. In a group of thousands of near copies that would be millions
of pairs, nearly all between sets that other links connect already, and sets that share a frequent passage meet in
buckets without being similar. Hence four measures, none of which loses a link:

* An outline of 512 bits goes with each set: every element flips one bit. Two outlines differ in no more bits than the sets in
  elements, so a pair whose outlines differ too much is not similar. This is a condition of the join that would make
  the pair, and only pairs that pass leave it.
* Signatures that the same ids have are one bucket: two near copies share most of theirs, and would meet in each.
* A pair meets once, though both may be in hundreds of the same buckets: each id brings its LEAST smallest signatures, and
  the smallest that both bring is the only one under which the pair is made. Pairs without such a one are made under each.
* Pairs are tried in rounds. Each round takes some pivots of every bucket, compares each later member of another component
  with the nearest of them by outline, merges the components of what is similar, and leaves out buckets that lie in one
  component. At last all members that are left are pivots. Of those pairs the nearest of each member is compared first, then what
  still lies in two components.

At the end any two members of any bucket are in one component or were found not to be similar, as if all pairs had been
compared. What passes the outlines is compared exactly, on whole bodies. Buckets, links and components are written
tables; the driver sees counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.llm.components import connected
from tillmark.llm.words import frees
from tillmark.sources.shared import discard, written

#: Bits of the filter that spares a join most rows without a partner. It is broadcast and never larger than this.
FILTER_BITS = 1 << 25
#: 64-bit words of an outline; the last pivot of each round but the last, which has all; pivots of a bucket that one task takes. Rounds
#: after the first are left out while no bucket has more members than that.
WORDS, PIVOTS, BLOCK = 8, (4, 64, 512), 2048
#: Signatures that an id brings, so that a pair meets under one of those in common only.
LEAST = 8
#: Signatures are dealt to 2 ** BUCKET_BITS buckets; so many rows are packed at once, or looked through for repeats.
BUCKET_BITS, PACKED = 12, 1 << 19
#: Bytes of a row in a block: of the id, and of the signature those after the bits of its bucket. Signatures that differ in the rest only
#: are one, which makes more candidates, no more. So do ids that are hashes; of those 40 bits are enough, beside 44 of a signature.
ROW, HASHED = (8, 5), (5, 4)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    out = x >> np.uint64(30)
    out ^= x
    out *= _M1
    out ^= out >> np.uint64(27)
    out *= _M2
    out ^= out >> np.uint64(31)
    return out


def maybe_among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose 64-bit ``column`` may be in the first column of ``wanted``: all that are, and few others while
    ``wanted`` is small. A bitmap of FILTER_BITS in parts of 4 KB is all that is broadcast."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = wanted.select(place(F.col(wanted.columns[0])).alias("_place")).distinct()
    bits = bits.groupBy(F.bitmap_bucket_number("_place").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    at = rows.withColumn("_place", place(F.col(column)))
    joined = at.join(F.broadcast(bits), F.bitmap_bucket_number("_place") == F.col("_part"))
    byte = "cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_place) div 8 as int) + 1, 1)), 16, 10) as int)"
    return joined.filter(f"(shiftright({byte}, cast(bitmap_bit_position(_place) % 8 as int)) & 1) = 1").select(*rows.columns)


def short(column: str) -> Column:
    """What a block of HASHED rows carries of an id."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * HASHED[0]) - 1))


def in_blocks(run: Callable[[Iterator], Iterator], row: tuple[int, int] = ROW) -> Callable[[Iterator], Iterator]:
    """``run``, which gives batches (sig, id), with its rows packed: (bucket, pairs) by the first BUCKET_BITS of the signature. Tens
    of signatures a set would cost the shuffle more as rows than as blocks of bytes."""
    of_id, of_sig = row

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sig, own = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (sig.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        pairs = np.empty((len(order), of_id + of_sig), np.uint8)
        pairs[:, :of_id] = own[order].astype("<i8", copy=False).view(np.uint8).reshape(-1, 8)[:, :of_id]
        pairs[:, of_id:] = (sig.view(np.uint64)[order] << np.uint64(BUCKET_BITS)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :of_sig]
        kinds, starts = np.unique(bucket[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        blocks = [pairs[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(blocks, pa.binary())], names=["bucket", "pairs"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in run(batches):
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= PACKED:
                yield packed(held)
                held, rows = [], 0
        if rows:
            yield packed(held)

    return own


def shared_buckets(blocks: DataFrame, row: tuple[int, int] = ROW) -> DataFrame:
    """The ids that share a signature, from blocks (bucket, pairs), as rows (sig, id), each once. Nearly all signatures stand alone; a
    task sorts one bucket at a time. ``sig`` is a hash of all ids that have the signature, so that signatures of the same ids come
    out as one; should other ids have that hash by chance, they are more candidates, no more."""

    of_id, of_sig = row

    def several(blocks: list[bytes]) -> np.ndarray:
        pairs = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, of_id + of_sig)
        sig, own = np.zeros((2, len(pairs), 8), np.uint8)
        sig[:, :of_sig], own[:, :of_id] = pairs[:, of_id:], pairs[:, :of_id]
        sig, own = sig.view("<i8").ravel(), own.view("<i8").ravel()
        order = np.argsort(sig)
        sig = sig[order]
        same = sig[1:] == sig[:-1]
        wanted = np.append(same, False) | np.append(False, same)
        sig, own = sig[wanted], own[order[wanted]]
        order = np.lexsort((own, sig))  # what is left may still be one id several times
        sig, own = sig[order], own[order]
        new = np.append(True, (sig[1:] != sig[:-1]) | (own[1:] != own[:-1]))[: len(sig)]
        sig, own = sig[new], own[new]
        same = sig[1:] == sig[:-1]
        wanted = np.append(same, False) | np.append(False, same) if len(sig) else np.zeros(0, bool)
        sig, own = sig[wanted], own[wanted]
        if not len(sig):
            return np.empty((0, 2), np.int64)
        starts = np.append(0, np.flatnonzero(sig[1:] != sig[:-1]) + 1)
        alike = mixed(np.add.reduceat(mixed(own.view(np.uint64)), starts)).view(np.int64)
        return np.stack([np.repeat(alike, np.diff(np.append(starts, len(sig)))), own], 1)

    def once(found: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        return rows[np.append(True, (rows[1:] != rows[:-1]).any(1))[: len(rows)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in once(found).T], names=["sig", "id"])

        last, held, found, rows = None, [], [], 0
        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != last and held:
                    found.append(several(held))
                    rows += len(found[-1])
                    held = []
                    if rows >= PACKED:
                        yield out(found)
                        found, rows = [], 0
                last = bucket
                held.append(block)
        if held:
            found.append(several(held))
        if found:
            yield out(found)

    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(frees(run), "sig long, id long").distinct()


def _numbered(buckets: DataFrame) -> DataFrame:
    """sig, id, first and place of rows (sig, id), each there once, in buckets of two ids or more."""
    order = Window.partitionBy("sig").orderBy("id")
    placed = buckets.select(
        "sig", "id", F.first("id").over(order).alias("first"), F.row_number().over(order).alias("place"), F.lead("id").over(order).alias("_after")
    )
    return placed.filter("place > 1 or _after is not null").drop("_after")


def outline(places: np.ndarray) -> np.ndarray:
    """WORDS 64-bit words in which each element, a number below 64 * WORDS, flips a bit."""
    odd = np.bincount(places, minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def outline_fields() -> list[str]:
    return [f"bits{i}" for i in range(WORDS)]


def _differ(a: str, b: str) -> Column:
    """The bits in which two outlines differ."""
    return sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in outline_fields()), F.lit(0))


def _may(a: str, b: str, percent: int) -> Column:
    """Neither the sizes nor the outlines of two sets rule out the similarity."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    return (_differ(a, b) * (100 + percent) <= (x + y) * (100 - percent)) & (x * 100 >= y * percent) & (y * 100 >= x * percent)


def _compared(pairs: DataFrame, bodies_of: Callable[[DataFrame], DataFrame], similar: Callable[[Column, Column], Column]) -> DataFrame:
    """a, b, similar. A body of ``b`` goes straight to each ``a`` that it is compared with, and that of ``a`` goes there once: bodies are by
    far the largest part of a pair, so they are neither stored nor gathered by id first."""
    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs.withColumn("similar", F.lit(False))
    firsts = bodies_of(pairs.select(F.col("a").alias("id")).distinct())
    seconds = bodies_of(pairs.select(F.col("b").alias("id"), "a"))
    left = firsts.groupBy(F.col("id").alias("a")).agg(F.min("body").alias("_a"))
    both = seconds.select(F.col("id").alias("b"), "a", F.col("body").alias("_b")).join(left, "a")
    compared = written(both.select("a", "b", similar(F.col("_a"), F.col("_b")).alias("similar")), "compared")
    discard(pairs, firsts, seconds)
    return compared


def _with_least(rows: DataFrame, high: int | None) -> DataFrame:
    """``rows`` (sig, id, place, ...) with ``least``, the LEAST smallest signatures of the id, and ``led``, those of the buckets where it is
    a pivot, which is up to the place ``high`` or anywhere."""
    own, order = Window.partitionBy("id"), Window.partitionBy("id").orderBy("sig")
    leads = F.lit(True) if high is None else F.col("place") <= high
    ranked = rows.withColumn("_rank", F.row_number().over(order)).withColumn("_led", F.sum(leads.cast("int")).over(order))
    least = F.collect_list(F.when(F.col("_rank") <= LEAST, F.col("sig"))).over(own)
    led = least if high is None else F.collect_list(F.when(leads & (F.col("_led") <= LEAST), F.col("sig"))).over(own)
    return ranked.withColumn("least", least).withColumn("led", led).drop("_rank", "_led")


def _met_before(x: str, y: str) -> Column:
    """The two ids bring a smaller signature in common, so that they meet there."""
    return F.array_min(F.array_intersect(F.col(f"{x}.led"), F.col(f"{y}.least"))) < F.col(f"{y}.sig")


def _meetings(active: DataFrame, percent: int, high: int | None, large: int) -> DataFrame:
    """a, b, differ: the pairs of a pivot and a later member of one bucket in two components, which may be similar; from (sig, id, place,
    component, size, outline, least, led). ``large`` is no less than the members of the largest bucket."""
    # The work of a large bucket is cut into blocks of pivots; the members travel to each of them.
    block = F.floor((F.col("place") - 1) / BLOCK)
    pivots = (active if high is None else active.filter(F.col("place") <= high)).drop("least").withColumn("block", block)
    members = active.drop("led")
    if large > BLOCK and high is None:
        blocks = pivots.groupBy("sig").agg(F.max("block").alias("_blocks"))
        members = members.join(blocks, "sig").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_blocks"), F.greatest(block, F.lit(0))))))
    else:  # all pivots are in the first block
        members = members.withColumn("block", F.lit(0).cast("long"))
    once = ~F.coalesce(_met_before("x", "y"), F.lit(False))
    apart = (F.col("y.place") > F.col("x.place")) & (F.col("x.component") != F.col("y.component"))
    met = members.alias("y").join(pivots.alias("x"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.block") == F.col("y.block")) & apart & _may("x", "y", percent) & once)
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), _differ("x", "y").alias("differ"))


def _in_two(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose ids lie in two components."""
    named = pairs.join(labels.select(F.col("id").alias("a"), F.col("component").alias("_a")), "a", "left")
    named = named.join(labels.select(F.col("id").alias("b"), F.col("component").alias("_b")), "b", "left")
    return named.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).drop("_a", "_b")


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b, differ) of each b that with the nearest a by outline."""
    return pairs.groupBy("b").agg(F.min(F.struct("differ", "a")).alias("best")).select("best.a", "b")


def similar_components(
    buckets: DataFrame, outlines: DataFrame, percent: int, bodies_of: Callable[[DataFrame], DataFrame], similar: Callable[[Column, Column], Column]
) -> DataFrame | None:
    """id, component (its smallest id) of every id that is similar to a smaller one, a written table; None if there is none.

    ``buckets`` has rows (sig, id) and ``outlines`` (id, size, bits0, ...) of all their ids; ``bodies_of`` adds the body
    to a table with a column id; rows that have the same body may come several times. ``similar`` compares two bodies exactly.
    """
    active = written(_numbered(buckets), "buckets")
    # Before the rounds, each id is compared with the smallest id that opens one of its buckets.
    pairs = active.filter("first < id").groupBy("id").agg(F.min("first").alias("a")).select("a", F.col("id").alias("b"))
    met = pairs.alias("p").join(outlines.alias("x"), F.col("p.a") == F.col("x.id")).join(outlines.alias("y"), F.col("p.b") == F.col("y.id"))
    rounds = [_compared(met.filter(_may("x", "y", percent)).select("a", "b"), bodies_of, similar)]
    # Places are those of the first numbering, so that the last one in a bucket bounds its members.
    large = active.agg(F.max("place")).head()[0] or 0
    labels = None

    def joined() -> DataFrame:
        discard(labels)
        return connected(reduce(DataFrame.union, rounds).filter("similar").select("a", "b"), roots=False)

    for high in (PIVOTS[0], *(x for x in PIVOTS[1:] if large > BLOCK), None):
        labels = joined()
        current = active.select("sig", "id", "place").join(labels, "id", "left").select("sig", "id", "place", F.coalesce("component", "id").alias("component"))
        spread = current.groupBy("sig").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
        mixed = spread.filter(F.col("_low") != F.col("_high")).select("sig")
        last, active = active, written(_with_least(current.join(mixed, "sig"), high).join(outlines, "id"), "buckets")
        discard(last)
        if active.isEmpty():
            break
        pairs = _meetings(active, percent, high, large)
        tried = reduce(DataFrame.union, rounds).select("a", "b")
        if high is not None:  # of all pivots that may be similar to it, the nearest by outline
            rounds.append(_compared(_nearest(pairs).join(tried, ["a", "b"], "left_anti"), bodies_of, similar))
            continue
        pairs = written(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "all-pairs")
        rounds.append(_compared(_nearest(pairs), bodies_of, similar))
        labels = joined()
        left = _in_two(pairs, labels).select("a", "b").join(rounds[-1].select("a", "b"), ["a", "b"], "left_anti")
        rounds.append(_compared(left, bodies_of, similar))
        labels = joined()
        discard(pairs)
    discard(active, *rounds)
    return None if labels.isEmpty() else labels
