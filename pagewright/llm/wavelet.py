"""Token ids in wavelet matrices: succinct bit planes with rank and select, one compressed image per shard."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import in_slices, relieved, text_or_empty
from pagewright.llm.tokens import encoder, vocabulary_path
from pagewright.storage import shared_path

MAGIC = b"PWWM0001"
#: Bits of a plane that are compressed together; a rank is kept for the start of each such block.
BLOCK_BITS = 1 << 16
SHARD_TOKENS = 1 << 20


def _packed(level: int, data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def build(ids: np.ndarray, doc_ids: list, lengths: list, level: int = 1) -> bytes:
    """The image of a shard: documents' ids and lengths, then one bit plane per bit, from the highest down.

    Layout: magic; tokens, documents and planes as three u64; the compressed tables of document ids, their null flags and
    lengths, each with its u64 size; for each plane: number of zeros and of blocks (u64), the ranks before the blocks
    (u64 each), the blocks' ends (u64 each), the blocks. All numbers are little-endian.
    """
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    current = ids.astype("<u2" if width <= 16 else "<u4")
    out = [MAGIC, struct.pack("<QQQ", len(ids), len(doc_ids), width)]
    numbers = np.array([d or 0 for d in doc_ids], dtype="<i8")
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    for table in (numbers, nulls, np.array(lengths, dtype="<u8")):
        raw = _packed(level, table.tobytes())
        out += [struct.pack("<Q", len(raw)), raw]
    for bit in range(width - 1, -1, -1):
        ones = (current >> np.array(bit, current.dtype)) & np.array(1, current.dtype)
        ones = ones.astype(bool)
        plane = np.packbits(ones, bitorder="little")
        blocks = [_packed(level, plane[a : a + BLOCK_BITS // 8].tobytes()) for a in range(0, len(plane), BLOCK_BITS // 8)]
        counts = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK_BITS), dtype=np.int64) if len(ones) else np.empty(0, np.int64)
        ranks = np.concatenate(([0], np.cumsum(counts)))[:-1].astype("<u8") if len(counts) else np.empty(0, "<u8")
        ends = np.cumsum([len(b) for b in blocks], dtype=np.int64).astype("<u8")
        out += [struct.pack("<QQ", len(ones) - int(ones.sum()), len(blocks)), ranks.tobytes(), ends.tobytes(), *blocks]
        current = np.concatenate((current[~ones], current[ones]))
    return b"".join(out)


class WaveletMatrix:
    """Reads an image. Single look-ups decompress only the blocks they touch."""

    def __init__(self, image: bytes):
        if image[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix image")
        self.image = image
        self.n, self.documents, self.width = struct.unpack_from("<QQQ", image, 8)
        at, tables = 32, []
        for kind in ("<i8", "u1", "<u8"):
            (size,) = struct.unpack_from("<Q", image, at)
            tables.append(np.frombuffer(zstandard.decompress(image[at + 8 : at + 8 + size]), dtype=kind) if self.documents else np.empty(0, kind))
            at += 8 + size
        self.doc_ids = [None if null else int(d) for d, null in zip(tables[0], tables[1], strict=True)]
        self.lengths = tables[2].astype(np.int64)
        self.planes = []
        for _ in range(self.width):
            zeros, blocks = struct.unpack_from("<QQ", image, at)
            ranks = np.frombuffer(image, "<u8", blocks, at + 16).astype(np.int64)
            ends = np.frombuffer(image, "<u8", blocks, at + 16 + 8 * blocks).astype(np.int64)
            at += 16 + 16 * blocks
            self.planes.append((zeros, ranks, ends, at))
            at += int(ends[-1]) if blocks else 0
        self._cache: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bits, and the ones before each of its bytes: a rank reads one of these and at most seven bits."""
        if (plane, block) not in self._cache:
            if len(self._cache) >= 64:
                self._cache.clear()
            _, _, ends, at = self.planes[plane]
            begin = at + (int(ends[block - 1]) if block else 0)
            raw = zstandard.decompress(self.image[begin : at + int(ends[block])])
            packed = np.frombuffer(raw, np.uint8)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self._cache[plane, block] = np.unpackbits(packed, bitorder="little"), before
        return self._cache[plane, block]

    def _bit(self, plane: int, i: int) -> int:
        return int(self._block(plane, i // BLOCK_BITS)[0][i % BLOCK_BITS])

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        zeros, ranks, _, _ = self.planes[plane]
        if i >= self.n:
            return self.n - zeros
        block, at = i // BLOCK_BITS, i % BLOCK_BITS
        bits, before = self._block(plane, block)
        return int(ranks[block]) + int(before[at // 8]) + int(bits[at - at % 8 : at].sum())

    def _select(self, plane: int, k: int, bit: int) -> int:
        """Where the k-th (from 0) one or zero of a plane stands."""
        _, ranks, _, _ = self.planes[plane]
        before = ranks if bit else np.arange(len(ranks)) * BLOCK_BITS - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        rest = k - int(before[block])
        bits, ones = self._block(plane, block)
        held = ones if bit else np.arange(len(ones)) * 8 - ones
        byte = int(np.searchsorted(held, rest, side="right")) - 1
        return block * BLOCK_BITS + 8 * byte + int(np.flatnonzero(bits[8 * byte : 8 * byte + 8] == bit)[rest - int(held[byte])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane, (zeros, *_) in enumerate(self.planes):
            bit = self._bit(plane, i)
            ones = self._rank1(plane, i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        begin, end = 0, i
        for plane, (zeros, *_) in enumerate(self.planes):
            a, b = self._rank1(plane, begin), self._rank1(plane, end)
            begin, end = (zeros + a, zeros + b) if token >> (self.width - 1 - plane) & 1 else (begin - a, end - b)
        return begin, end

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token among the first `end` ones (all, if None)."""
        if token >> self.width:
            return 0
        begin, stop = self._range(token, self.n if end is None else end)
        return stop - begin

    def find(self, token: int, k: int) -> int:
        """Where the k-th (from 0) occurrence of a token stands."""
        if token >> self.width or not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, 0)[0] + k
        for plane in range(self.width - 1, -1, -1):
            zeros = self.planes[plane][0]
            bit = token >> (self.width - 1 - plane) & 1
            at = self._select(plane, at - zeros if bit else at, bit)
        return at

    def decode(self) -> np.ndarray:
        """All tokens: from the last plane up, each one's bits say how the sequence below was dealt."""
        values = np.zeros(self.n, "<u2" if self.width <= 16 else "<u4")
        unpack = zstandard.ZstdDecompressor()
        for plane in range(self.width - 1, -1, -1):
            zeros, _, ends, at = self.planes[plane]
            begins = [0, *ends[:-1].tolist()] if len(ends) else []
            raw = b"".join(unpack.decompress(self.image[at + a : at + b]) for a, b in zip(begins, ends.tolist(), strict=True))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").astype(bool)
            dealt = np.empty_like(values)
            dealt[~ones] = values[:zeros]
            dealt[ones] = values[zeros:] | np.array(1 << (self.width - 1 - plane), values.dtype)
            values = dealt
        return values


SHARDS = "part int, shard int, first_token long, tokens long, image binary"


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes docs in ascending order of the id and writes a wavelet-matrix image per shard below path.

    Documents are dealt by ranges of the id, ordered within each range (nulls first; equal ids by text), and cut into
    shards of about shard_tokens ids, each holding whole documents. The images lie in Parquet files, one to a row, so
    Spark's committed writes hold for them on any store: a lost executor leaves no half-written shard.
    """
    coder_path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(coder_path), TaskContext.get().partitionId()
        shard, before, pending, docs_in, lengths, held = 0, 0, [], [], [], 0

        def image() -> pa.RecordBatch:
            ids = np.concatenate(pending) if pending else np.empty(0, np.uint32)
            row = [[part], [shard], [before], [len(ids)], [build(ids, docs_in, lengths)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=["part", "shard", "first_token", "tokens", "image"])

        for batch in batches:
            for cut in in_slices(batch, "text"):
                ids, starts = coder.encode(cut.column("text"))
                for k, doc in enumerate(cut.column("doc_id").to_pylist()):
                    own = np.append(ids[starts[k] : starts[k + 1]], np.uint32(end_id))
                    pending.append(own)
                    docs_in.append(doc)
                    lengths.append(len(own))
                    held += len(own)
                    if held >= shard_tokens:
                        yield image()
                        shard, before = shard + 1, before + held
                        pending, docs_in, lengths, held = [], [], [], 0
        if docs_in:
            yield image()

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(relieved(run), SHARDS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A row per document, from the images alone: doc_id, start, n_tokens, ids_crc32, ids (little-endian uint32).

    start counts the ids of all documents before it: those of earlier ranges (a row per range: as many as there were
    write tasks), of earlier shards of its range, and of earlier documents of its shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, image in zip(batch.column("part").to_pylist(), batch.column("first_token").to_pylist(), batch.column("image"), strict=True):
                matrix = WaveletMatrix(image.as_py())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(matrix.lengths)
                raws = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), matrix.lengths.tolist(), strict=True)]
                columns = [matrix.doc_ids, np.full(len(raws), part), first + ends - matrix.lengths, matrix.lengths, [zlib.crc32(r) for r in raws], raws]
                kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "part", "local", "n_tokens", "ids_crc32", "ids"])

    images = spark.read.schema(SHARDS).parquet(path)
    sums = sorted((r.part, r.n) for r in images.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    offsets, total = [], 0
    for part, n in sums:
        offsets.append((part, total))
        total += n
    before = spark.createDataFrame(offsets, "part int, before long")
    rows = images.select("part", "first_token", "image").mapInArrow(run, "doc_id long, part int, local long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text counts as empty; a null doc_id comes first; repeated rows stay; an empty table gives no rows."""
    path = shared_path(spark, "wavelet")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return read_tokens(spark, path).drop("ids")
