"""Sum-of-squares online packing of token ids into fixed windows, with the open windows counted by fill level."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import in_slices, relieved, text_or_empty
from pagewright.llm.tokens import KEPT, encoder, vocabulary_path

WINDOW = 2048
#: Open windows that a lane holds before they are closed by cutting; bounds its memory to this many windows of ids.
MAX_OPEN = 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Places pieces into windows of one lane.

    `level[h]` counts the open windows that are filled to h. A piece of s ids goes where the sum of the squares of
    these counts becomes least: into a window at level h (which moves to h + s, or closes when full) or into a new one.
    Whole windows of a long document close at once. When the lane ends, or holds MAX_OPEN open windows, the emptiest
    windows' pieces are cut to fill the fullest; what then remains of the last one is cut at powers of two, which need
    no padding.
    """

    def __init__(self, emit, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.emit, self.window, self.max_open = emit, window, max_open
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.count = 0

    def add(self, doc, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        whole = n - n % w
        for at in range(0, whole, w):
            self.emit([(doc, at, ids[at : at + w], n)])
        if whole == n:
            return
        piece, s = (doc, whole, ids[whole:].copy(), n), n - whole
        below, above = self.level[1 : w - s + 1], self.level[1 + s : w + 1]
        best, place = 2 * self.level[s] + 1, 0  # a new window
        if len(below):
            change = 2 * (above - below) + 2
            change[-1] -= 1  # a window that becomes full leaves the levels
            change[below == 0] = np.iinfo(np.int64).max
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= best:
                place = at + 1
        pieces = self.open[place].pop() if place else []
        self.level[place] -= place > 0
        pieces.append(piece)
        fill = place + s
        if fill == w:
            self.count -= place > 0
            self.emit(pieces)
            return
        self.count += place == 0
        self.open[fill].append(pieces)
        self.level[fill] += 1
        if self.count >= self.max_open:
            self.settle()

    def settle(self) -> None:
        """Closes all open windows but one, cutting pieces of the emptiest to fill the fullest."""
        windows = [pieces for fill in range(self.window, 0, -1) for pieces in self.open[fill]]
        fills = [fill for fill in range(self.window, 0, -1) for _ in self.open[fill]]
        self.open = [[] for _ in range(self.window + 1)]
        self.level[:] = 0
        i, j = 0, len(windows) - 1
        while i < j:
            doc, start, ids, n = windows[j].pop()
            take = min(self.window - fills[i], len(ids))
            windows[i].append((doc, start, ids[:take], n))
            fills[i] += take
            fills[j] -= take
            if take < len(ids):
                windows[j].append((doc, start + take, ids[take:], n))
            if fills[i] == self.window:
                self.emit(windows[i])
                i += 1
            if fills[j] == 0:
                j -= 1
        self.count = 0
        if i == j and fills[i]:
            if fills[i] == self.window:
                self.emit(windows[i])
            else:
                self.open[fills[i]].append(windows[i])
                self.level[fills[i]] = 1
                self.count = 1

    def close(self) -> None:
        self.settle()
        for fill in range(1, self.window):
            for pieces in self.open[fill]:
                for bit in range(fill.bit_length() - 1, -1, -1):
                    if fill >> bit & 1:
                        room, part = 1 << bit, []
                        while room:
                            doc, start, ids, n = pieces.pop(0)
                            part.append((doc, start, ids[:room], n))
                            if len(ids) > room:
                                pieces.insert(0, (doc, start + room, ids[room:], n))
                            room -= min(room, len(ids))
                        self.emit(part)


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", max_open: int = MAX_OPEN, kept_words: int = KEPT) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    Each input partition is a lane of its own, packed as it streams by: nothing is shuffled, and a lane holds at most
    max_open windows. The encoder remembers at most kept_words words between slices. A sequence_id is the lane's number times 2^32 plus a count. Null text is empty (its only id is the
    end id), null doc_ids stay null, repeated rows are packed as often as they occur; an empty table gives no rows.
    Columns other than id and text are ignored.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lane = encoder(path, kept_words), TaskContext.get().partitionId() << 32
        rows, made = [], [0]

        def emit(pieces: list) -> None:
            offset = 0
            for doc, start, ids, n in pieces:
                raw = ids.astype("<u4", copy=False).tobytes()
                rows.append((doc, start, len(ids), zlib.crc32(raw), n, lane + made[0], offset, raw))
                offset += len(ids)
            made[0] += 1

        def drained() -> pa.RecordBatch:
            kinds = (*[pa.int64()] * 7, pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 8
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])
            rows.clear()
            return batch

        packer = Packer(emit, window, max_open)
        for batch in batches:
            for cut in in_slices(batch, "text", max_bytes=4 << 20):
                ids, starts = coder.encode(cut.column("text"))
                for k, doc in enumerate(cut.column("doc_id").to_pylist()):
                    packer.add(doc, np.append(ids[starts[k] : starts[k + 1]], np.uint32(end_id)))
                    if len(rows) >= 8192:
                        yield drained()
        packer.close()
        yield drained()

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(relieved(run), PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("ids")
