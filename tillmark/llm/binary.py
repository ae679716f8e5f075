"""Token ids in a compact binary form, written in ascending document order and read back.

A dataset is a folder with ``dictionary`` (one row: the zstandard dictionary and its SHA-256) and ``shards``. A shard holds
up to SHARD_DOCS documents or SHARD_BYTES of ids, whatever is reached first:

    8 bytes   magic
    4 bytes   bytes of an id (2 or 4)          4 bytes   documents n
    32 bytes  SHA-256 of the dictionary
    n entries of 29 bytes: id known (1), id (8), ids before it in the shard (8), frame's place (8), ids (4)
    the frames, one for each document, each compressed on its own with the shared dictionary

So one short document is read by its index entry and its frame alone. Spark's writer commits the shards, hence a lost
executor leaves no half of one. ``part`` and ``seq`` give the order of the shards.

Cases: a null text is empty, and an empty text has the end id only. Repeated ids stay, ordered by their text; a null id
comes first. An empty table gives a dataset without shards. Columns other than the id and the text are not read.
The dictionary is trained on a bounded sample, SAMPLE documents with the lowest hash of their id and SAMPLE_IDS ids of
each; the ids that are written are always whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillmark.llm.words import Encoder, frees, loose_chunks, slices

SHARD_DOCS, SHARD_BYTES = 4096, 4 << 20
SAMPLE, SAMPLE_IDS, DICTIONARY_BYTES, LEVEL = 1000, 16_384, 64 << 10, 3
MAGIC = b"TMIDS\x00\x00\x01"
HEAD = np.dtype([("magic", "S8"), ("width", "<u4"), ("docs", "<u4"), ("dictionary", "V32")])
ENTRY = np.dtype([("known", "u1"), ("doc", "<i8"), ("before", "<u8"), ("place", "<u8"), ("ids", "<u4")])


#: A word of letters and the signs after it, which the tokenizer's pattern cuts apart; signs of its own tokens are not among them.
_ENDED = re.compile(r"([a-zà-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]+)")


@cache
def _encoder(path: str) -> Encoder:
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # chunks hold no special token: texts with one are encoded whole
    return Encoder(made, loose_chunks, " ", remembered=700_000, tails=_ENDED)


@cache
def _whole(path: str) -> tuple[object, re.Pattern | None]:
    """The plain tokenizer, and what the strings of its special tokens look like in any case."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    names = [re.escape(t.content) for t in made.get_added_tokens_decoder().values()]
    return made, re.compile("|".join(names), re.IGNORECASE) if names else None


def encoded(path: str, texts: list[str]) -> list[bytes]:
    """The ids of whole texts as the library gives them without adding special tokens. The string of a special token in a text is
    that token, as the library has it; such a text is encoded at once."""
    plain, special = _whole(path)
    odd = [i for i, t in enumerate(texts) if special is not None and special.search(t)]
    ids = _encoder(path).ids(["" if i in odd else t for i, t in enumerate(texts)] if odd else texts)
    for i in odd:
        ids[i] = np.array(plain.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
    return ids


@cache
def _width(path: str) -> int:
    return 2 if _encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """Trained on the driver from the ids of a bounded sample; without enough of them, plain content."""
    lowest = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    chosen = [r[0] for r in lowest.collect()]
    texts = docs.filter(F.col("doc_id").isin(chosen)).select(F.substring("text", 1, 4 * SAMPLE_IDS)).limit(SAMPLE)
    end, width = np.array([end_id], "<u4").tobytes(), f"<u{_width(path)}"
    samples = [
        np.frombuffer(ids + end, "<u4")[:SAMPLE_IDS].astype(width).tobytes()
        for ids in (encoded(path, [r[0] or ""])[0] for r in texts.toLocalIterator())
    ]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 4)), samples).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\x00" * 8


def _pack(entries: list[tuple], frames: list[bytes], width: int, digest: bytes) -> bytes:
    head = np.zeros(1, HEAD)
    head["magic"], head["width"], head["docs"], head["dictionary"] = MAGIC, width, len(entries), np.void(digest)
    return b"".join([head.tobytes(), np.array(entries, ENTRY).tobytes(), *frames])


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = 1) -> None:
    """Encodes every whole text of ``docs`` (doc_id, text) with the tokenizer file at ``path`` and writes the dataset."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, end_id)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(bytearray(digest), bytearray(dictionary))], "digest binary, content binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        width, end = _width(path), np.array([end_id], "<u4").tobytes()
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress
        part, seq = TaskContext.get().partitionId(), 0
        entries, frames, before, size, raw = [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            blob = _pack(entries, frames, width, digest)
            known = [e[1] for e in entries if e[0]]
            values = [part, seq, known[0] if known else None, known[-1] if known else None, len(entries), before, blob]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch, texts in slices(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(path, texts), strict=True):
                got = np.frombuffer(ids + end, "<u4").astype(f"<u{width}").tobytes()
                frame = squeeze(got)
                entries.append((doc is not None, doc or 0, before, size, len(got) // width))
                frames.append(frame)
                before, size, raw = before + len(got) // width, size + len(frame), raw + len(got)
                if len(entries) >= SHARD_DOCS or raw >= SHARD_BYTES:
                    yield shard()
                    seq += 1
                    entries, frames, before, size, raw = [], [], 0, 0, 0
        if entries:
            yield shard()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())])
    fields = "part int, seq int, first_doc long, last_doc long, n_docs long, n_tokens long, blob binary"
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    rows.mapInArrow(frees(run), fields).write.parquet(f"{folder}/shards")


def _unpack(blob: bytes, dictionary: bytes) -> tuple[np.ndarray, np.ndarray, memoryview, object, str]:
    head = np.frombuffer(blob, HEAD, 1)[0]
    if blob[:8] != MAGIC:
        raise ValueError("not a shard of token ids")
    if bytes(head["dictionary"]) != hashlib.sha256(dictionary).digest():
        raise ValueError("the shard was written with another dictionary")
    n = int(head["docs"])
    index = np.frombuffer(blob, ENTRY, n, HEAD.itemsize)
    body = memoryview(blob)[HEAD.itemsize + n * ENTRY.itemsize :]
    ends = np.append(index["place"][1:], len(body)).astype(np.int64)
    grow = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress
    return index, ends, body, grow, f"<u{head['width']}"


def _dictionary(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").head()["content"])


def read_ids(spark: SparkSession, folder: str, doc_id: int | None = None) -> DataFrame:
    """part, seq, doc_id, before (ids of the shard's documents before it), ids. With ``doc_id``, only its shards and
    frames are opened."""
    dictionary = _dictionary(spark, folder)
    shards = spark.read.parquet(f"{folder}/shards")
    if doc_id is not None:
        shards = shards.filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    fields = "part int, seq int, doc_id long, before long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index, ends, body, grow, kind = _unpack(row["blob"], dictionary)
                wanted = range(len(index)) if doc_id is None else np.flatnonzero((index["doc"] == doc_id) & (index["known"] == 1)).tolist()
                for at in range(0, len(wanted), 256):
                    some = wanted[at : at + 256]
                    ids = [np.frombuffer(grow(body[int(index["place"][i]) : int(ends[i])]), kind).astype("<u4").tobytes() for i in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["part"]] * len(some), pa.int32()),
                            pa.array([row["seq"]] * len(some), pa.int32()),
                            pa.array([int(index["doc"][i]) if index["known"][i] else None for i in some], pa.int64()),
                            pa.array([int(index["before"][i]) for i in some], pa.int64()),
                            pa.array(ids, pa.binary()),
                        ],
                        names=["part", "seq", "doc_id", "before", "ids"],
                    )

    return shards.select("part", "seq", "blob").mapInArrow(frees(run), fields)


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """part, seq, start: the ids before each shard. One row per part meets in one task, nothing larger."""
    index = spark.read.parquet(f"{folder}/shards").select("part", "seq", "n_tokens")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(before([], "part")), F.lit(0)).alias("part_start"))
    own = index.withColumn("own", F.coalesce(F.sum("n_tokens").over(before(["part"], "seq")), F.lit(0)))
    return own.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("own")).alias("start"))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            sums = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *sums], names=[*batch.schema.names[:4], "n_tokens", "ids_crc32"])

    found = read_ids(spark, folder).mapInArrow(frees(run), "part int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return found.join(shard_starts(spark, folder), ["part", "seq"]).select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
