"""Encoding whole texts with the tokenizers library, one distinct chunk at a time.

A corpus repeats its words. Each Python worker therefore cuts a text where the tokenizer always cuts too, and asks the
library only for chunks that it has not met; the rest come from a dictionary of bounded size. The library encodes the
new chunks joined to one string, and its offsets say which ids belong to which chunk.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Chunks that a worker remembers, and the characters that are encoded at once.
REMEMBERED = 100_000
JOINED = 100_000
#: Characters of the texts that are cut up at once.
SLICE = 500_000

_BESIDE = re.compile(r"\s | \s|^ | $")


def loose_chunks(text: str) -> list[str]:
    """Chunks for a tokenizer that drops white space and case: what stands between spaces and line ends, empty between
    two of them. Texts of Latin-1 characters are put in lower case, which the tokenizer would do alike, so that more chunks
    are the same."""
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return text.replace("\n", " ").split(" ")


def spaced_chunks(text: str) -> list[str]:
    """Chunks for a pattern whose words take one space before them: cut before each lone space inside the text."""
    if not _BESIDE.search(text):
        first, *rest = text.split(" ")
        return [first, *(" " + c for c in rest)] if first else []
    return [c for c in re.split(r"(?<=\S)(?= \S)", text) if c]


class Encoder:
    """ids(texts): the ids of each text as unsigned 32-bit little-endian bytes, as the library encodes whole texts."""

    def __init__(
        self, tokenizer, chunks: Callable[[str], list[str]], between: str, remembered: int = REMEMBERED, tails: re.Pattern | None = None
    ):
        """``tails`` matches chunks whose end the tokenizer cuts off: two groups, the word and its end."""
        self.tokenizer, self.chunks, self.between, self.remembered, self.tails = tokenizer, chunks, between, remembered, tails
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """``between`` joins chunks without a new id: nothing where chunks bring their space, else a space."""
        lengths = np.fromiter(map(len, new), np.int64, len(new)) + len(self.between)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        got = self.tokenizer.encode(self.between.join(new), add_special_tokens=False)
        ids = np.array(got.ids, dtype="<u4")
        begins = np.fromiter((a for a, _ in got.offsets), np.int64, len(ids))
        cuts = (4 * np.append(np.searchsorted(begins, starts), len(ids))).tolist()
        self.known.update(zip(new, map(ids.tobytes().__getitem__, map(slice, cuts, cuts[1:])), strict=False))

    def _alone(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def forget(self) -> None:
        """At a task's end: a worker lives on for tasks that need its memory for other things."""
        self.known, self.older = {"": b""}, {}

    def _grow_old(self) -> None:
        """Half of what is remembered is kept aside; what is met again comes back, so that frequent chunks are never lost."""
        self.known, self.older = {"": b""}, self.known

    def ids(self, texts: list[str]) -> list[bytes]:
        if 2 * len(self.known) > self.remembered:
            self._grow_old()
        known = self.known
        cut = [self.chunks(t) for t in texts]
        fresh = set().union(*cut).difference(known)
        self._come_back(fresh)
        ended = {c: found.groups() for c in fresh if (found := self.tails.fullmatch(c))} if self.tails else {}
        fresh.difference_update(ended)
        parts = {part for pair in ended.values() for part in pair}.difference(known)
        self._come_back(parts)
        new: list[str] = []
        size = 0
        if self.between:  # no more characters than the texts have
            new, fresh, parts = list(fresh | parts), set(), set()
        for c in fresh | parts:
            if c[0] == " " and not c[1:2].isspace() and not c[-1].isspace():
                new.append(c)
                size += len(c)
            else:
                known[c] = self._alone(c)
            if size > JOINED:
                self._learn(new)
                new, size = [], 0
        if new:
            self._learn(new)
        for c, (word, end) in ended.items():
            known[c] = known[word] + known[end]
        return [b"".join(map(known.__getitem__, cs)) for cs in cut]

    def _come_back(self, wanted: set[str]) -> None:
        """Takes from ``wanted`` what was kept aside."""
        older = self.older
        again = [c for c in wanted if c in older]
        self.known.update((c, older[c]) for c in again)
        wanted.difference_update(again)


def frees(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a worker that lives on: what a task has used goes back to the system at its end, so that the workers of
    earlier stages do not add up beside the executor's heap."""

    @wraps(run)
    def own(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return own


def slices(batches: Iterator[pa.RecordBatch], field: str = "text", most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with their texts (null: empty), of ``most`` characters or one row; only one part's texts are
    Python strings at a time."""
    for batch in batches:
        column = batch.column(field)
        texts: list[str] = []
        at = size = 0
        for i in range(batch.num_rows):
            text = column[i].as_py() or ""
            if size and size + len(text) > most:
                yield batch.slice(at, i - at), texts
                at, size, texts = i, 0, []
            texts.append(text)
            size += len(text)
        if texts:
            yield batch.slice(at), texts
