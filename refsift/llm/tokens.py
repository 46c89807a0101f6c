"""Token files: ids of whole documents, entropy-coded by a static range asymmetric numeral system.

One table of frequencies, counted over all documents, serves all files. A file
holds blocks of whole documents. Within a block, up to LANES coders take the ids in
turn and share one stream of 32-bit words. A block is independent of all others,
and every CHECKPOINT steps it notes the state of its coders, the place in the
stream and a checksum of the ids and words up to the next one. So segments of one block
are decoded at the same time: side by side in one task, by several tasks
(read_segments()), or only those that hold what is asked for (ids_between()).

File: magic, then blocks. Block, little-endian: magic, length of the block,
documents, ids, lanes, steps of a segment (all u32); doc_ids (i64) and whether they are
null (u8); ids of each document (u64); for each segment: word offset (u32),
checksum (u32), states (u64 a lane); the stream (u32).
"""
from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import long_rows, release, shared_dir, stored, whole

#: Frequencies add up to two to the SCALE.
SCALE = 20
LANES = 2048
#: Steps between checkpoints.
CHECKPOINT = 64
#: Ids after which a block ends with the current document.
BLOCK = 1 << 19
#: Ids after which a file ends.
FILE = 1 << 24
END = 0
#: Segments that a task decodes side by side.
TOGETHER = 4
MAGIC, BLOCK_MAGIC = b"RSTOKEN2", 0x4B4C4252
_LOW = np.uint64(1 << 31)


class Table:
    """Quantised frequencies of the ids; every id that occurs has one of 1 at least."""

    def __init__(self, counts: dict[int, int]):
        self.size = max(counts, default=END) + 1
        self.freq = np.zeros(self.size, np.uint64)
        used = np.array(sorted(i for i, n in counts.items() if n > 0) or [END])
        n = np.array([counts.get(i, 1) for i in used.tolist()], object)
        share = (n * ((1 << SCALE) - len(used))) // int(n.sum()) + 1
        share[int(np.argmax(n))] += (1 << SCALE) - int(share.sum())
        self.freq[used] = share.astype(np.uint64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(self.size, dtype=np.uint32), self.freq.astype(np.int64))


def lanes_of(n: int) -> int:
    """How many coders share n ids: fewer for few ids, so that their states stay a small part of the block."""
    return min(LANES, max(16, 1 << (n // CHECKPOINT).bit_length()))


def encode_ids(ids: np.ndarray, table: Table, lanes: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """The stream of ids and its checkpoints (word offset, checksum, states), one for each segment."""
    steps = -(-len(ids) // lanes)
    grid = np.full(steps * lanes, ids[-1] if len(ids) else END, np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(steps, lanes)
    x = np.full(lanes, _LOW)
    scale, shift = np.uint64(SCALE), np.uint64(63 - SCALE)
    words, marks, total = [], [], 0
    for t in range(steps - 1, -1, -1):
        f, c = table.freq[grid[t]], table.cum[grid[t]]
        full = x >= f << shift
        out = x[full].astype(np.uint32)
        if len(out):
            words.append(out)
            total += len(out)
            x[full] >>= np.uint64(32)
        q = x // f
        x = (q << scale) + (x - q * f) + c
        if t % CHECKPOINT == 0:
            marks.append((total, zlib.crc32(grid[t : t + CHECKPOINT].astype("<u4").tobytes()), x.copy()))
    words.reverse()
    stream = np.concatenate(words) if words else np.zeros(0, np.uint32)
    marks = [(total - at, crc, state) for at, crc, state in reversed(marks)]
    ends = [at for at, _, _ in marks[1:]] + [total]
    # The checksum also covers the words of a segment: the last ones change no id, only states.
    return stream, [(at, zlib.crc32(stream[at:end].astype("<u4").tobytes(), crc), state) for (at, crc, state), end in zip(marks, ends)]


Mark = tuple[int, int, np.ndarray]


def decode_segments(stream: np.ndarray, marks: list[Mark], steps: int, table: Table) -> np.ndarray:
    """The ids of segments of so many steps each, decoded side by side."""
    at, x = np.array([m[0] for m in marks]), np.stack([m[2].astype(np.uint64) for m in marks])
    out = np.empty((steps, *x.shape), np.uint32)
    mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for t in range(steps):
        slot = x & mask
        s = table.symbol[slot]
        out[t] = s
        x = table.freq[s] * (x >> scale) + slot - table.cum[s]
        need = x < _LOW
        n = np.count_nonzero(need, axis=1)
        # The words of a segment follow each other, those of all segments are taken row by row.
        words = np.concatenate([stream[a : a + k] for a, k in zip(at.tolist(), n.tolist())])
        if len(words):
            x[need] = x[need] << np.uint64(32) | words
            at += n
    out = out.transpose(1, 0, 2).reshape(len(marks), -1)
    for ids, end, m in zip(out, at.tolist(), marks):
        if zlib.crc32(stream[m[0] : end].tobytes(), zlib.crc32(ids.tobytes())) != m[1]:
            raise ValueError("token segment fails its checksum")
    return out.ravel()


def pack_block(doc_ids: list[int | None], parts: list[np.ndarray], table: Table) -> bytes:
    ids = np.concatenate(parts)
    lanes = lanes_of(len(ids))
    stream, marks = encode_ids(ids, table, lanes)
    body = [
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([len(p) for p in parts], "<u8").tobytes(),
        *(np.array([at, crc], "<u4").tobytes() + state.astype("<u8").tobytes() for at, crc, state in marks),
        stream.astype("<u4").tobytes(),
    ]
    size = 24 + sum(map(len, body))
    return b"".join([np.array([BLOCK_MAGIC, size, len(doc_ids), len(ids), lanes, CHECKPOINT], "<u4").tobytes(), *body])


class Block:
    """A block that is opened but not decoded: doc_ids, lengths (ids of each document), n (ids), marks and stream."""

    def __init__(self, raw: memoryview):
        magic, _, docs, self.n, self.lanes, self.checkpoint = np.frombuffer(raw, "<u4", 6).tolist()
        if magic != BLOCK_MAGIC:
            raise ValueError("not a token block")
        at = 24 + 17 * docs
        null = np.frombuffer(raw, np.uint8, docs, 24 + 8 * docs).tolist()
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(raw, "<i8", docs, 24).tolist(), null)]
        self.lengths = np.frombuffer(raw, "<u8", docs, 24 + 9 * docs).tolist()
        self.steps = -(-self.n // self.lanes)
        self.marks: list[Mark] = []
        for _ in range(-(-self.steps // self.checkpoint)):
            place, crc = np.frombuffer(raw, "<u4", 2, at).tolist()
            self.marks.append((place, crc, np.frombuffer(raw, "<u8", self.lanes, at + 8)))
            at += 8 + 8 * self.lanes
        self.stream = np.frombuffer(raw, "<u4", offset=at)

    def steps_of(self, segment: int) -> int:
        return min(self.checkpoint, self.steps - segment * self.checkpoint)

    def ids_between(self, low: int, high: int, table: Table) -> np.ndarray:
        """Ids number low to high (exclusive) of the block; no segment is decoded that has none of them."""
        span = self.checkpoint * self.lanes
        first, last = low // span, -(-min(high, self.n) // span)
        if low >= min(high, self.n):
            return np.zeros(0, np.uint32)
        whole = [i for i in range(first, last) if self.steps_of(i) == self.checkpoint]
        # Some at a time, so that a long block needs no more memory than a short one besides its ids.
        found = [decode_segments(self.stream, [self.marks[i] for i in whole[k : k + TOGETHER]], self.checkpoint, table) for k in range(0, len(whole), TOGETHER)]
        found += [decode_segments(self.stream, [self.marks[i]], self.steps_of(i), table) for i in range(first + len(whole), last)]
        return np.concatenate(found)[low - first * span : min(high, self.n) - first * span]


def unpack_block(raw: memoryview, table: Table) -> tuple[list[int | None], list[int], np.ndarray]:
    """doc_ids, number of ids of each document, and the ids, of one block."""
    block = Block(raw)
    return block.doc_ids, block.lengths, block.ids_between(0, block.n, table)


def ids_of(block: Block, document: int, table: Table) -> np.ndarray:
    """The ids of one document of a block, by its number there."""
    begin = sum(block.lengths[:document])
    return block.ids_between(begin, begin + block.lengths[document], table)


def blocks(raw: bytes) -> Iterator[memoryview]:
    view = memoryview(raw)
    if bytes(view[:8]) != MAGIC:
        raise ValueError("not a token file")
    at = 8
    while at < len(view):
        size = int(np.frombuffer(view, "<u4", 1, at + 4)[0])
        yield view[at : at + size]
        at += size


class Coder:
    """Encodes texts as the tokenizers library does.

    That library takes over 1.5 times the seconds that a run may have, so its
    vocabulary is run by tiktoken, which gives the same ids: ranks are ids, and
    every piece of the splitting pattern is merged by them. Texts with special
    tokens, or with characters newer than the library's tables, go to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        vocabulary = bpe.Vocabulary(path)
        ranks = {b: i for i, b in vocabulary.bytes_of.items() if i not in vocabulary.special.values()}
        self.fast = tiktoken.Encoding("shipped", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = list(vocabulary.special)

    def encode(self, text: str) -> np.ndarray:
        if not any(x in text for x in self.special) and not bpe.unusual(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # white space beyond what its splitter can go back over
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(2)
def coder(path: str) -> Coder:
    """The coder of a worker process; it lasts over tasks."""
    return Coder(path)


def tokenise(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """part, seq, doc_id and ids of every row, in ascending order of doc_id by part, then seq.

    ids is binary, 16 bits each if the vocabulary allows, and 32 bits if not; id END ends each document.
    """
    spark = long_rows(docs.sparkSession)
    model = bpe.ship(spark, tokenizer_path)
    kind = id_type(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(SparkFiles.get(model)).encode
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            found = [np.append(encode(t.as_py()), END).astype(kind).tobytes() for t in batch.column(1)]
            numbers = np.arange(seq, seq + len(found))
            seq += len(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), part)), pa.array(numbers), batch.column(0), pa.array(found, pa.binary())], ["part", "seq", "doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "part long, seq long, doc_id long, ids binary")


def id_type(tokenizer_path: str) -> str:
    return "<u2" if max(bpe.Vocabulary(tokenizer_path).bytes_of) < 1 << 16 else "<u4"


def count_ids(tokens: DataFrame, kind: str) -> dict[int, int]:
    """How often each id occurs in all documents; as many rows as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in batch.column(0)]))
            if len(got) > len(total):
                total = np.pad(total, (0, len(got) - len(total)))
            total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in rows.collect()}


class _File:
    """A token file that is written under a name of its own and then renamed, so a task that runs again leaves the same file."""

    def __init__(self, system, folder: str, part: int, seq: int, table: Table):
        self.system, self.table, self.part, self.seq = system, table, part, seq
        self.name, self.draft = f"{folder}/{part:08d}-{seq:012d}.rans", f"{folder}/.{uuid.uuid4().hex}"
        self.out = system.open_output_stream(self.draft)
        self.out.write(MAGIC)
        self.doc_ids, self.parts, self.size, self.docs, self.ids = [], [], 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.parts.append(ids)
        self.size += len(ids)
        if self.size >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.parts:
            self.out.write(pack_block(self.doc_ids, self.parts, self.table))
            self.docs, self.ids = self.docs + len(self.doc_ids), self.ids + self.size
            self.doc_ids, self.parts, self.size = [], [], 0

    def close(self) -> tuple[int, int, int, int]:
        self.flush()
        self.out.close()
        self.system.move(self.draft, self.name)
        return self.part, self.seq, self.docs, self.ids


def write(tokens: DataFrame, where: str, table: Table, kind: str) -> list:
    """Write a table of tokenise() as token files below where; returns part, seq (of the first document), documents and ids of each.

    A file holds documents that follow each other; its name begins with their place.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(table)  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(where)
        done, file, follows = [], None, None
        for batch in batches:
            for part, seq, doc_id, x in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
                if (part, seq) != follows or file.ids >= FILE:
                    done += [file.close()] if file else []
                    file = _File(system, folder, part, seq, shared.value)
                file.add(doc_id, np.frombuffer(x.as_buffer(), kind).astype(np.uint32))
                follows = (part, seq + 1)
        done += [file.close()] if file else []
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(4)], ["part", "seq", "documents", "ids"])

    return tokens.mapInArrow(run, "part long, seq long, documents long, ids long").collect()


def read(spark: SparkSession, where: str, table: Table, index: list) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from the files below where."""
    starts, at = {}, 0
    for r in sorted(index, key=lambda r: (r["part"], r["seq"])):
        starts[f"{r['part']:08d}-{r['seq']:012d}.rans"] = at
        at += r["ids"]
    shared = spark.sparkContext.broadcast((table, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, starts = shared.value
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = starts[path.rpartition("/")[2]]
                for block in blocks(raw.as_buffer()):
                    doc_ids, lengths, ids = unpack_block(block, table)
                    ends = np.cumsum(lengths)
                    begins = ends - lengths
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, pa.int64()), pa.array(begins + start), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    start += len(ids)

    if not index:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return _files(spark, where).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _files(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.rans").load(where).select("path", "content")


def read_segments(spark: SparkSession, where: str, table: Table) -> DataFrame:
    """part, seq (of the file), block, segment and ids (32 bits each) of every segment below where, each decoded by itself in any task.

    A file, and a block however long, is thus decoded by as many tasks as the session's shuffle has partitions. The ids of a
    block are those of its segments, in order. The folder holds one file at least.
    """
    shared = spark.sparkContext.broadcast(table)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "seq", "block", "segment", "n", "steps", "crc", "states", "stream"]
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                part, seq = map(int, path.rpartition("/")[2].removesuffix(".rans").split("-"))
                for k, block in enumerate(map(Block, blocks(raw.as_buffer()))):
                    ends, span = [m[0] for m in block.marks[1:]] + [len(block.stream)], block.checkpoint * block.lanes
                    for i, (at, crc, states) in enumerate(block.marks):
                        row = [part, seq, k, i, min(span, block.n - i * span), block.steps_of(i), crc, states.tobytes(), block.stream[at : ends[i]].tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for n, steps, crc, states, stream in zip(*[batch.column(i).to_pylist() for i in range(4, 9)]):
                mark = (0, crc, np.frombuffer(states, "<u8"))
                ids.append(decode_segments(np.frombuffer(stream, "<u4"), [mark], steps, shared.value)[:n].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(ids, pa.binary())], ["part", "seq", "block", "segment", "ids"])

    found = _files(spark, where).mapInArrow(cut_up, "part long, seq long, block long, segment long, n long, steps long, crc long, states binary, stream binary")
    return found.repartition("part", "seq", "block", "segment").mapInArrow(decode, "part long, seq long, block long, segment long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str | None = None, where: str | None = None) -> DataFrame:
    """Encode every whole text of docs (doc_id, text), write token files, and read them back.

    Returns, per document and from the files, doc_id, start (ids of all
    documents before it), n_tokens (its closing id included) and ids_crc32. A
    null or empty text is the closing id alone. Documents are in ascending order
    of doc_id, null first; rows with equal doc_id follow each other by content.
    An empty table writes no file and gives an empty result. A block ends with a
    document, so a very long text makes a longer block. Other columns are
    ignored. where: the folder of the files, by default a new shared one.
    """
    spark = docs.sparkSession
    where = where or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    tokenizer_path = bpe.tokenizer(tokenizer_path)
    kind = id_type(tokenizer_path)
    tokens = stored(tokenise(docs, tokenizer_path), "ids", compression="zstd")
    release(spark)
    table = Table(count_ids(tokens, kind))
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return read(spark, where, table, write(tokens, where, table, kind))
