"""Fuzzy line deduplication.

A document's lines are what stands between its line feeds. Lines are compared in lower case with runs of white space as one
space, by the sets of their character 5-grams; a line of fewer characters is one gram. Lines that are equal then are one class. MinHash signatures by one permutation
(one hash a 5-gram, the least of each of BANDS x ROWS bins, empty bins filled from others by a fixed order of probes) are
cut into bands. At a Jaccard similarity of 0.8 a pair shares a band with a probability of over 0.99, at 0.85 of over 0.999.
Candidates are compared on their whole sets, and a distributed union-find joins what is similar; see ``similar``. Of
each component the first line stays, by document id and place, and the others are dropped.

Cases: every line takes part, however short, but blank ones, which stay. A
null text stays null and an empty one empty; a document may lose all of its lines and then has an empty text. Null ids
come first. Rows that repeat id and text are one document and keep the same lines. All columns of ``docs`` stay, whatever
their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.similar import HASHED, WORDS, in_blocks, maybe_among, mixed, outline_fields, shared_buckets, short, similar_components
from tillmark.llm.words import frees, slices
from tillmark.sources.shared import discard, written

GRAM, PERCENT = 5, 80
BANDS, ROWS = 22, 7
BINS = BANDS * ROWS
#: Characters of lines that are hashed at once, and classes that a task remembers.
AT_ONCE, REMEMBERED = 60_000, 300_000
_EMPTY = np.uint32(0xFFFFFFFF)
#: So many that even a line of one gram fills nearly all bins by them; the bins of long lines are full after a few.
_PROBES = np.random.default_rng(7).integers(0, BINS, (1024, BINS)).astype(np.int32)


def normal(line: str) -> str:
    if line.isprintable() and "  " not in line:  # no white space but single spaces
        return line.strip(" ").lower()
    return " ".join(line.lower().split())


def long_lines(text: str) -> list[tuple[int, str]]:
    """Place and normal form of the lines that take part: all that are not blank."""
    return [(i, n) for i, line in enumerate(text.split("\n")) if (n := normal(line))]


def grams(line: str) -> set[str]:
    return {line[i : i + GRAM] for i in range(max(1, len(line) - GRAM + 1))}


def gram_hashes(lines: list[str]) -> np.ndarray:
    """64-bit hashes of the 5-grams of all lines, len(line) - GRAM + 1 each, in their order."""
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = code[: len(code) - GRAM + 1].copy()
    for i in range(1, GRAM):
        h *= np.uint64(0x100000001B3)
        h += code[i : len(code) - GRAM + 1 + i]
    inside = np.ones(len(code), bool)  # not the 5-grams that reach into the next line
    ends = np.cumsum([len(x) for x in lines])
    for i in range(1, GRAM):
        inside[ends - i] = False
    return mixed(h)[inside[: len(h)]]


def bins_of(lines: list[str]) -> np.ndarray:
    """One row of BINS least hashes for each line of at least GRAM characters."""
    h, lengths = gram_hashes(lines), np.array([len(x) for x in lines])
    row = np.repeat(np.arange(len(lines)), lengths - GRAM + 1)
    least = np.full(len(lines) * BINS, _EMPTY)
    place = row * BINS + (((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(least, place, h.astype(np.uint32) >> np.uint32(1))  # never the empty mark
    filled = least.copy()
    open_ = np.flatnonzero(least == _EMPTY)
    line, own = np.divmod(open_.astype(np.int32), np.int32(BINS))
    line *= BINS
    for probe in _PROBES:
        if not len(open_):
            break
        found = least[line + probe[own]]
        there = found != _EMPTY
        filled[open_[there]] = found[there]
        empty = ~there
        open_, line, own = open_[empty], line[empty], own[empty]
    if len(open_):  # no probe met a full bin: the least of the line
        filled[open_] = least.reshape(-1, BINS).min(1)[open_ // BINS]
    return filled.reshape(-1, BINS)


def bands_of(lines: list[str]) -> np.ndarray:
    """BANDS signatures for each line."""
    bins = bins_of(lines).reshape(-1, BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32), bins.shape[:2]).copy()
    for i in range(ROWS):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += bins[:, :, i]
    return mixed(out)


def digest(line: str) -> int:
    return xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))


def halves(digests: list[int]) -> list[pa.Array]:
    """The upper and the lower half of 128-bit numbers, as signed 64-bit columns."""
    raw = np.frombuffer(b"".join(d.to_bytes(16, "big") for d in digests), ">i8").reshape(-1, 2).astype(np.int64)
    return [pa.array(raw[:, 0]), pa.array(raw[:, 1])]


def line_digests(rows: DataFrame) -> DataFrame:
    """doc, mark, place, high, low: every line that takes part, with 128 bits of its normal form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = [long_lines(t) for t in texts]
            counts = [len(x) for x in found]
            prints = [digest(n) for x in found for _, n in x]
            owners = pa.array(np.repeat(np.arange(len(found)), counts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(owners),
                    batch.column(1).take(owners),
                    pa.array([i for x in found for i, _ in x], pa.int32()),
                    *halves(prints),
                ],
                names=["doc", "mark", "place", "high", "low"],
            )

    return rows.mapInArrow(frees(run), "doc long, mark long, place int, high long, low long")


def _fresh(texts: list[str], seen: set[int]) -> Iterator[tuple[int, str]]:
    """Lines that this task has not met yet, as far as it remembers."""
    for text in texts:
        for _, line in long_lines(text):
            mark = digest(line)
            if mark not in seen:
                if len(seen) < REMEMBERED:
                    seen.add(mark)
                yield mark, line


def line_signatures(rows: DataFrame) -> DataFrame:
    """Blocks of (sig, id): the bands of each line under the lower half of its digest. A line of under GRAM characters is similar to its
    equals only, which are one class, and has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0

        def signed() -> pa.RecordBatch:
            bands = bands_of([line for _, line in held]).view(np.int64).ravel()
            ids = np.repeat(halves([mark for mark, _ in held])[1].to_numpy(), BANDS)
            return pa.RecordBatch.from_arrays([pa.array(bands), pa.array(ids)], names=["sig", "id"])

        for _, texts in slices(batches):
            for mark, line in _fresh(texts, seen):
                if len(line) < GRAM:
                    continue
                held.append((mark, line))
                size += len(line)
                if size >= AT_ONCE:
                    yield signed()
                    held, size = [], 0
        if held:
            yield signed()

    return rows.mapInArrow(frees(in_blocks(run, HASHED)), "bucket int, pairs binary")


def line_texts(rows: DataFrame) -> DataFrame:
    """high, low, line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in slices(batches):
            found = list(_fresh(texts, seen))
            yield pa.RecordBatch.from_arrays([*halves([m for m, _ in found]), pa.array([x for _, x in found], pa.string())], names=["high", "low", "line"])

    return rows.mapInArrow(frees(run), "high long, low long, line string")


def line_outlines(texts: DataFrame) -> DataFrame:
    """id, body, size and outline of each line's set of 5-grams."""

    def outlined(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        hashes = gram_hashes(lines)
        ends = np.cumsum([len(x) - GRAM + 1 for x in lines])
        new = np.ones(len(hashes), bool)
        start = 0
        for end in ends.tolist():
            own = hashes[start:end]
            own.sort()
            np.not_equal(own[1:], own[:-1], out=new[start + 1 : end])
            start = end
        owner = np.repeat(np.arange(len(lines)), np.diff(ends, prepend=0))[new]
        places = owner * (64 * WORDS) + (hashes[new] & np.uint64(64 * WORDS - 1)).astype(np.int64)
        odd = np.bincount(places, minlength=len(lines) * 64 * WORDS).astype(np.uint8) & np.uint8(1)
        return np.bincount(owner, minlength=len(lines)), np.packbits(odd).view("<i8").reshape(-1, WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lines in slices(batches, "body", AT_ONCE):
            sizes, outlines = outlined(lines)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), *map(pa.array, outlines.T)], names=["id", "body", "size", *outline_fields()])

    return texts.select("id", "body").mapInArrow(frees(run), "id long, body string, size long, " + ", ".join(f"{w} long" for w in outline_fields()))


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """doc, mark (the text's 64-bit hash) and places: the lines to drop of each document that has any, a written table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"), F.col("text"))
    lines = written(line_digests(rows), "line-digests")
    first = F.min(F.struct("doc", "mark", "place")).alias("first")
    counted = lines.groupBy("high", "low").agg(first, F.count("*").alias("n"))
    classes = written(counted.withColumn("cls", F.monotonically_increasing_id()), "line-classes")
    shared = written(shared_buckets(line_signatures(rows), HASHED), "line-signatures")
    # A part of a digest stands for a line until here; lines that share it by chance are more candidates, no more. Most classes are
    # one line without a bucket, and only those with a bucket or with several lines are moved from here on.
    ids = shared.select("id").distinct()
    near = maybe_among(classes.withColumn("_id", short("low")), "_id", ids).join(ids.withColumnRenamed("id", "_id"), "_id")
    wanted = written(near.select("low", "high", "first", F.col("cls").alias("id")), "line-candidates")
    buckets = written(shared.join(wanted.select(short("low").alias("_low"), F.col("id").alias("cls")), F.col("id") == F.col("_low")).select("sig", F.col("cls").alias("id")), "line-buckets")
    discard(shared)
    # Only the texts are read again in which a wanted line stands first.
    owners = maybe_among(rows, "mark", wanted.select("first.mark"))
    texts = maybe_among(line_texts(owners), "low", wanted.select("low")).join(wanted.drop("first"), ["high", "low"])
    candidates = written(line_outlines(texts.groupBy("id").agg(F.min("line").alias("body"))), "line-bodies")

    @F.arrow_udf("boolean")
    @frees
    def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, held = None, set()
        for left, right in batches:
            out = []
            for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
                if a != last:
                    last, held = a, grams(a)
                other = grams(b)
                both = len(held & other)
                out.append(100 * both >= PERCENT * (len(held) + len(other) - both))
            yield pa.array(out, pa.bool_())

    found = similar_components(buckets, candidates.drop("body"), PERCENT, lambda own: candidates.select("id", "body").join(own, "id"), similar)
    firsts = classes.filter("n > 1").select("high", "low", "first", "cls")
    near = None
    if found is not None:
        members = found.select("id", "component").union(found.select("component", "component").distinct())
        placed = wanted.join(members, "id")
        least = placed.groupBy("component").agg(F.min("first").alias("least"))
        near = written(placed.join(least, "component").select("high", "low", F.col("least").alias("first"), F.col("id").alias("cls")), "line-components")
        firsts = firsts.join(near.select("cls"), "cls", "left_anti").select(*near.columns).union(near)
    firsts = written(firsts.drop("cls"), "line-firsts")
    discard(buckets, wanted, candidates, classes, found, near)
    kept = F.struct(F.col("doc"), F.col("mark"), F.col("place"))
    dropped = maybe_among(lines, "low", firsts.select("low")).join(firsts, ["high", "low"]).filter(~kept.eqNullSafe(F.col("first")))
    places = written(dropped.groupBy("doc", "mark").agg(F.collect_set("place").alias("places")), "dropped-lines")
    discard(lines, firsts)
    return places


def drop_duplicate_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the text that is left, and its columns ``_lines`` and ``_dropped`` packed apart: (row, lines, dropped)."""

    @F.arrow_udf("string")
    @frees
    def without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, places in batches:
            out = []
            for text, gone in zip(texts, places, strict=True):  # one text at a time is a Python string
                text, gone = text.as_py(), gone.as_py()
                if text is None or not gone:
                    out.append(text)
                    continue
                away = set(gone)
                out.append("\n".join([line for i, line in enumerate(text.split("\n")) if i not in away]))
            yield pa.array(out, pa.string())

    gone = duplicate_lines(docs)
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_mark"))
    joined = packed.join(gone, F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_mark") == F.col("mark")), "left")
    # Only texts that lose a line are sent to Python.
    loses = F.col("places").isNotNull()
    text = F.when(loses, without(F.when(loses, F.col("row.text")), F.col("places"))).otherwise(F.col("row.text"))
    feeds = F.octet_length("row.text") - F.octet_length(F.replace(F.col("row.text"), F.lit("\n"), F.lit("")))
    lines = F.when(F.col("row.text").isNull(), 0).otherwise(feeds + 1)
    return joined.select("row", text.alias("text"), lines.alias("lines"), F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).alias("dropped"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with the first line of each component only, same columns."""
    found = drop_duplicate_lines(docs)
    return found.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept, text: every document and what is left of it."""
    found = drop_duplicate_lines(docs)
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("lines").cast("long").alias("n_lines"), (F.col("lines") - F.col("dropped")).cast("long").alias("n_kept"), "text")
