"""Token-id files: the ids of many documents in one array, document ends in an Elias-Fano code.

An image (one segment) is: the magic LGEF, then seven little-endian unsigned 32-bit numbers (version, bytes of an id, documents,
ids, low bits, bytes of low bits, bytes of high bits), low bits, high bits, select samples (the place of every 64th set bit),
ids. Document k ends at select(k); no table of 64-bit offsets is kept.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import id_text, slices, table, work_path
from loomgraph.llm.tokens import pieces, vocabulary

MAGIC, HEAD, EVERY = b"LGEF", struct.Struct("<4s7I"), 64
#: A segment is closed at about so many ids (2 MB of 2-byte ids) and at so many documents.
SEGMENT_IDS, SEGMENT_DOCS = 1_000_000, 100_000
SEGMENTS = "part int, inside long, n_docs long, n_ids long, doc_ids array<bigint>, image binary"
RESULT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def pack(ends: np.ndarray, ids: np.ndarray) -> bytes:
    """ends: after which id each document ends, not decreasing. ids: all ids, in the type that the file keeps."""
    n, total = len(ends), len(ids)
    low = max(0, (total // max(n, 1)).bit_length() - 1)
    ends = ends.astype(np.int64)
    low_bits = np.packbits(((ends[:, None] >> np.arange(low)) & 1).astype(np.uint8), bitorder="little")
    places = (ends >> low) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    high[places] = 1
    high_bits = np.packbits(high, bitorder="little")
    head = HEAD.pack(MAGIC, 1, ids.itemsize, n, total, low, len(low_bits), len(high_bits))
    return b"".join([head, low_bits.tobytes(), high_bits.tobytes(), places[::EVERY].astype("<u4").tobytes(), ids.tobytes()])


class Segment:
    """Reads an image."""

    def __init__(self, image: bytes):
        magic, version, width, self.n, self.total, self.low, n_low, n_high = HEAD.unpack_from(image)
        if magic != MAGIC or version != 1 or width not in (2, 4):
            raise ValueError("not a token-id segment")
        at = HEAD.size
        self.low_bits = np.frombuffer(image, np.uint8, n_low, at)
        self.high_bits = np.frombuffer(image, np.uint8, n_high, at := at + n_low)
        samples = -(-self.n // EVERY)
        self.samples = np.frombuffer(image, "<u4", samples, at := at + n_high)
        self.ids = np.frombuffer(image, f"<u{width}", self.total, at := at + 4 * samples)
        if at + width * self.total != len(image):
            raise ValueError("a token-id segment has another length than its head says")

    def _low(self, k: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(k), np.int64)
        bits = np.unpackbits(self.low_bits, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        return bits[k].astype(np.int64) @ (1 << np.arange(self.low))

    def ends(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high_bits, bitorder="little"))
        return ((places - np.arange(self.n)) << self.low) + self._low(np.arange(self.n))

    def select(self, k: int) -> int:
        """Where document k ends: set bits are counted from the sample before it, and no further than to the next one."""
        place, after = int(self.samples[k // EVERY]), k // EVERY + 1
        stop = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high_bits)
        bits = np.unpackbits(self.high_bits[place // 8 : stop // 8 + 1], bitorder="little")
        high = place + int(np.flatnonzero(bits[place % 8 :])[k % EVERY]) - k
        low = 0
        for i in range(self.low):
            bit = k * self.low + i
            low |= (int(self.low_bits[bit // 8]) >> bit % 8 & 1) << i
        return high << self.low | low

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.select(k - 1) if k else 0 : self.select(k)]


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> None:
    """Encodes whole texts (null: empty), each followed by end_id, into segments below path in ascending order of id.

    Null ids come first; equal ids stay together, in the table's order, but may fill many parts; every row is kept. An empty table gives no segment.
    Spark's committer writes the segments, so a lost executor's task is simply run again.
    """
    rows = id_text(df, id_col, text_col).withColumn("at", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at")

    def run(batches):
        coder, part, inside = pieces(tokenizer, special_as_text), TaskContext.get().partitionId(), 0
        wide = coder.tokenizer.get_vocab_size() > 1 << 16
        end = np.array([end_id], "<u4").tobytes()
        docs, held, lengths, n = [], [], [], 0

        def row():
            ids = np.frombuffer(b"".join(held), "<u4").astype("<u4" if wide else "<u2")
            image = pack(np.cumsum(lengths), ids)
            columns = [[part], [inside], [len(docs)], [len(ids)], [docs], [image]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "inside", "n_docs", "n_ids", "doc_ids", "image"])

        for b in batches:
            for i, j in slices(b.column(1)):
                names, texts = b.column(0).slice(i, j - i).to_pylist(), b.column(1).slice(i, j - i).to_pylist()
                for name, ids in zip(names, coder.ids([t or "" for t in texts])):
                    docs.append(name)
                    held += (ids, end)
                    lengths.append(len(ids) // 4 + 1)
                    n += lengths[-1]
                    if n >= SEGMENT_IDS or len(docs) >= SEGMENT_DOCS:
                        yield row()
                        docs, held, lengths, n, inside = [], [], [], 0, inside + n
        if docs:
            yield row()

    ordered.mapInArrow(run, SEGMENTS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the segments below path: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A segment holds how many ids its own part has before it; only one number for each written part passes the driver, as in
    zipWithIndex, and no image is shuffled.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    starts, total = {}, 0
    for part, n in sorted(segments.groupBy("part").agg(F.sum("n_ids")).collect()):
        starts[part] = total
        total += n
    sent = spark.sparkContext.broadcast(starts)

    def run(batches):
        for b in batches:
            for part, inside, docs, image in zip(*b.columns):
                s, base = Segment(image.as_py()), sent.value[part.as_py()] + inside.as_py()
                ends = np.array([s.select(k) for k in range(s.n)], np.int64)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                crcs = [zlib.crc32(s.ids[i:j].astype("<u4").tobytes()) for i, j in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs.as_py(), pa.int64()), pa.array(starts + base, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("part", "inside", "doc_ids", "image").mapInArrow(run, RESULT)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return read_token_files(spark, path)
