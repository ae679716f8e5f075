"""Byte-level BPE: texts to ids and back, with the tokenizers library over Arrow batches.

The vocabulary is a rank file (``base64 token, rank`` per line). Its merges follow from the ranks: each token of two
bytes or more is what the last merge of its own bytes joins. Bytes stand for characters of the library's byte table, so a
token may hold a part of a character; ``decode`` reverses the table and returns bytes, which are valid text again once
all tokens of a document are joined.

Cases: a null or empty text has no ids and decodes to no bytes. Repeated rows stay, each with its own result. Columns
other than the id and the text are not read. White space, controls and long words are encoded like everything else; there
are no special tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.words import Encoder, frees, slices, spaced_chunks


@cache
def byte_characters() -> list[str]:
    """The character of each byte: printable bytes stand for themselves, the others for code points from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that the ranks below the token's own leave of its bytes."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, len(ranks) * 2), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= ranks[token]:
            raise ValueError(f"no merges lead to {token!r}")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@cache
def tokenizer(path: str, pattern: str):
    """The library's tokenizer for the rank file; one per Python worker."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, table = read_ranks(path), byte_characters()
    spell = lambda token: "".join(table[b] for b in token)
    merges = [tuple(map(spell, _last_merge(t, ranks))) for t in sorted(ranks, key=ranks.__getitem__) if len(t) > 1]
    made = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False),
        ]
    )
    return made


@cache
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(tokenizer(path, pattern), spaced_chunks, "")


@cache
def _spelling(path: str) -> list[bytes]:
    """Bytes of each id, read off the library's vocabulary by the reversed byte table."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocab = tokenizer_vocabulary(path)
    spelled = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        spelled[i] = bytes(back[c] for c in token)
    return spelled


def tokenizer_vocabulary(path: str) -> dict[str, int]:
    table = byte_characters()
    return {"".join(table[b] for b in token): rank for token, rank in read_ranks(path).items()}


def character_starts(text: str, lengths: np.ndarray) -> np.ndarray:
    """For tokens of so many bytes each, the character of the text in which each begins."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, dtype=np.int64)
    return character[first.astype(np.int64)].astype(np.int32) if len(lengths) else np.zeros(0, dtype=np.int32)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """``key``, ``ids`` and, on request, ``starts``: the character of the text in which each id begins."""
    kind = docs.schema[key].dataType.simpleString()
    fields = f"`{key}` {kind}, ids array<int>" + ", starts array<int>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes = _encoder(path, pattern), np.array([len(s) for s in _spelling(path)]) if offsets else None
        for batch, texts in slices(batches):
            found = encoder.ids(texts)
            flat = np.frombuffer(b"".join(found), dtype="<i4")
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32))
            columns = [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))]
            if offsets:
                starts = [character_starts(t, sizes[np.frombuffer(x, dtype="<i4")]) for t, x in zip(texts, found, strict=True)]
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(starts))))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "starts"][: len(columns)])
        encoder.forget()

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(frees(run), fields)


def spelled_bytes(ids: Iterable[int], path: str) -> bytes:
    spelled = _spelling(path)
    return b"".join([spelled[i] for i in ids])


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of each row's ids (null ids: no bytes)."""
    kept = [f for f in encoded.schema.fields if f.name in (key, "ids")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                out = [spelled_bytes(row.values.to_pylist(), path) if row.is_valid else b"" for row in batch.column("ids")]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.select(*(F.col(f.name) for f in kept)).mapInArrow(frees(run), fields)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the decimal ids joined by commas and of the bytes that the ids decode to. Both ways
    are one pass of the Python workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch, texts in slices(batches):
            found = [np.frombuffer(x, dtype="<i4") for x in encoder.ids(texts)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))
            decoded = pa.array([spelled_bytes(x.tolist(), path) for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], names=["doc_id", "ids", "decoded"])
        encoder.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = docs.select("doc_id", "text").mapInArrow(frees(run), f"doc_id {kind}, ids array<int>, decoded binary")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
