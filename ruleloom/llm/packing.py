"""Sum-of-squares online packing of tokenised documents into windows of a fixed length.

A window that holds ``h`` tokens is at fill level ``h``.  ``count[h]`` is the number of open
windows at level ``h``, and an item of ``s`` tokens goes to the level whose choice leaves the sum
of the squared counts smallest (an empty window is level 0, a full one leaves the array).  Moving
a window from ``h`` to ``h + s`` changes that sum by ``2 (count[h+s] - count[h]) + 2`` where both
levels are partial, so one vector expression over the level array finds the place.

Each task packs its own rows in a single pass without a shuffle; a document longer than a window is cut
into full windows and a remainder.  At the end of a task the windows that are still open are
drained: the emptiest are dissolved to fill the others, and the last one is split into parts whose
lengths are powers of two.  What is kept in memory is the token ids of open windows only.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ruleloom.llm.common import small_batches

CAPACITY = 2048
END_ID = 1
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class ByteTokenizer:
    """Ids of a byte-level BPE vocabulary as little-endian unsigned 32-bit bytes.

    A text that holds a special token's string goes through ``tokenizers`` itself.  All others are
    encoded from the ranks of the same vocabulary, which gives the same ids several times faster
    (the tests compare the two).
    """

    def __init__(self, path: str, ranks_path: str) -> None:
        import base64

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return array("I", ids).tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str, ranks_path: str) -> ByteTokenizer:
    return ByteTokenizer(path, ranks_path)


class Packer:
    """The online rule for one task; ``rows`` collects finished pieces."""

    def __init__(self, capacity: int, first_sequence: int) -> None:
        self.capacity, self.next = capacity, first_sequence
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}  # level: windows, each a list of (doc, start, ids, total)
        self.rows: list[tuple] = []

    def _close(self, window: list) -> None:
        at = 0
        for doc, start, ids, total in window:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def place(self, doc, start: int, ids: bytes, total: int) -> None:
        size = len(ids) // 4
        if size == self.capacity:
            self._close([(doc, start, ids, total)])
            return
        c = self.count
        gain = 2 * (c[size:] - c[: self.capacity - size + 1])  # at level h: the change of the sum less 2
        gain = np.where(c[: len(gain)] > 0, gain, np.iinfo(np.int64).max)
        gain[-1] = -2 * c[self.capacity - size] - 1 if c[self.capacity - size] > 0 else np.iinfo(np.int64).max
        gain[0] = 2 * c[size] - 1  # a new window
        # of equal choices the fullest window
        level = len(gain) - 1 - int(np.argmin(gain[::-1]))
        window = self.open[level].pop() if level else []
        if level:
            c[level] -= 1
        window.append((doc, start, ids, total))
        if level + size == self.capacity:
            self._close(window)
        else:
            self.open.setdefault(level + size, []).append(window)
            c[level + size] += 1

    def add(self, doc, ids: bytes) -> None:
        total, step = len(ids) // 4, self.capacity
        for start in range(0, total, step):
            self.place(doc, start, ids[4 * start : 4 * (start + step)], total)

    def drain(self) -> None:
        """Fill the fuller open windows with cut pieces of the emptier ones, then split the last."""
        windows = [w for level in sorted(self.open) for w in self.open[level]]
        low, high = 0, len(windows) - 1
        spare: list = []
        while low < high or (spare and low <= high):
            target = windows[high]
            room = self.capacity - sum(len(p[2]) // 4 for p in target)
            while room:
                if not spare:
                    if low >= high:
                        break
                    spare, low = windows[low][::-1], low + 1
                doc, start, ids, total = spare.pop()
                take = min(room, len(ids) // 4)
                target.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    spare.append((doc, start + take, ids[4 * take :], total))
                room -= take
            if room:
                break
            self._close(target)
            high -= 1
        rest = spare[::-1] + [p for w in windows[low : high + 1] for p in w]
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            size, part = min(self.capacity, 1 << (left.bit_length() - 1)), []
            left -= size
            while size:
                doc, start, ids, total = rest.pop(0)
                take = min(size, len(ids) // 4)
                part.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    rest.insert(0, (doc, start + take, ids[4 * take :], total))
                size -= take
            self._close(part)
        self.open, self.count[:] = {}, 0

    def batch(self, names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in names]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document (see SCHEMA); every id lies in exactly one piece.

    ``docs`` needs ``doc_id`` and ``text``; other columns, whatever their names, are ignored.  A null or
    empty text is one token, ``end_id``; a text of any length is cut into full windows and a remainder.  Rows are packed one by one, repeated rows and null ids included.  An empty
    table gives no rows.  ``sequence_id`` is the task's number times 2^32 plus a running number.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = [f.split()[0] for f in SCHEMA.split(", ")]
        encoder, packer = tokenizer(tokenizer_path, ranks_path), Packer(capacity, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packer.add(doc, encoder.encode(text or "") + end)
            yield packer.batch(names)
        packer.drain()
        yield packer.batch(names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
