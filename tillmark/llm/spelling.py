"""Spelling variants of words: words one edit apart, grouped under the much more frequent form.

Words are counted once in the tasks that read the texts, so only distinct words are shuffled. Near words are found by
asymmetric q-chunks: of two words that differ by one edit, the shorter (of equal ones, the first) contributes two disjoint chunks
of half its length, one from its start and one up to its end, and the other its positional grams of that length. One edit touches
one chunk at most, so the other one stands in the longer word as a gram within a shift of one: at the same place from the
start, or at the same place from the end. Grams at other places can't meet a chunk, so they are not written out. What is left
of both words without chunk and gram differs by that edit too, so the same rule halves it once more, and both pieces are one
join key: a syllable that a third of the words share does not make a group. Every candidate is verified by its distance.

The largest near word of a word is its form if it is DOMINANT times as frequent; counts grow by that factor from form to form, so
chains are short and are followed by doubling. A word has at most some thousand near words (length times alphabet), so no
key of these joins is hot.

Cases: a null or empty text has no words; a null id counts as the empty string. Texts are read whole, in slices of bytes.
Repeated rows count as often as they stand there; ties between near words go to the first in code-point order. An empty table
gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.sources.shared import discard, written

SHORTEST, LEAST, DOMINANT, TYPO = 7, 2, 10, 31
#: Distinct words that a task holds before it hands them on, and bytes of a text that it cuts into words at once.
HELD, SLICE = 200_000, 1 << 22

# Fixed value: letters of a word, as Latin-1 bytes.
_LETTERS = bytes([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])
_LONG = re.compile(rb"[a-z\xc0-\xff]{%d,}" % SHORTEST)


def runs(text: str) -> Counter[bytes]:
    """How often each maximal run of letters of SHORTEST code points or more stands in the text, A-Z lower-cased. Latin-1 has a byte
    for every letter of a run; all else becomes a question mark."""
    found: Counter[bytes] = Counter()
    rest = b""
    for at in range(0, len(text), SLICE):
        data = rest + text[at : at + SLICE].encode("latin-1", "replace").lower()
        if at + SLICE < len(text):
            cut = len(data.rstrip(_LETTERS))  # a run that the slice cuts waits for its end
            data, rest = data[:cut], data[cut:]
        found.update(_LONG.findall(data))
    return found


def mistyped(run: bytes, seed: int, every: int = TYPO) -> bytes:
    """The run, without one code point if ``every`` divides the checksum that ``seed`` begins."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    return run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]


def occurrences(docs: DataFrame, held: int = HELD) -> DataFrame:
    """word, n: the distinct words of all texts with their number, LEAST at least. A task holds ``held`` distinct words at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in counts]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if not (text := text.as_py()):
                    continue
                seed = crc32(f"{doc_id.as_py() or ''}:".encode())
                for word, n in runs(text).items():
                    word = mistyped(word, seed)
                    if len(word) >= SHORTEST:
                        counts[word] += n
                if len(counts) >= held:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def keys(word: Column, length: Column, base: Column) -> Column:
    """The four join keys of a word for chunks of words of ``base`` code points: one of the two halves, with one of the two halves
    of what is left without it."""
    q = F.floor(base / 2).cast("int")
    sub = F.floor((base - q) / 2).cast("int")
    sides = [
        (F.substring(word, F.lit(1), q), F.substring(word, q + 1, length - q)),
        (F.substring(word, length - q + 1, q), F.substring(word, F.lit(1), length - q)),
    ]
    out = []
    for side, (chunk, rest) in enumerate(sides):
        for place, piece in enumerate([F.substring(rest, F.lit(1), sub), F.substring(rest, length - q - sub + 1, sub)]):
            out.append(F.xxhash64(F.lit(2 * side + place), base, chunk, piece))
    return F.array(*out)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n of each two ``words`` (word, n) that one inserted, deleted or replaced code point tells apart, once."""
    sized = words.withColumn("size", F.char_length("word"))
    size = F.col("size")
    chunks = sized.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("size").alias("a_size"), F.explode(keys(F.col("word"), size, size)).alias("key"))
    shorter = F.when(size > SHORTEST, keys(F.col("word"), size, size - 1)).otherwise(F.array().cast("array<bigint>"))
    grams = sized.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("size").alias("b_size"), F.explode(F.concat(keys(F.col("word"), size, size), shorter)).alias("key"))
    ordered = (F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a") < F.col("b")))
    met = chunks.join(grams, "key").filter(ordered & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain of ``forms`` (word, form) ends, by doubling. Forms must not run in circles."""
    steps = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        discard(steps)
        steps = longer
        if not steps.filter("moved").limit(1).count():
            return steps.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = written(occurrences(docs), "words")
    pairs = written(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    around = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    likely = F.col("best.minus") <= -DOMINANT * F.col("n")
    judged = words.join(around, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(likely, F.col("best.form")).alias("form"),
        F.when(likely, -F.col("best.minus")).alias("form_n"),
    )
    judged = written(judged, "judged-words")
    discard(words, pairs)
    ends = roots(judged.filter("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
