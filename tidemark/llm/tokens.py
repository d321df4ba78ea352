"""Token-id files: ids in fixed-size chunks of bit or byte planes, each plane compressed, with a chunk index.

A file holds the documents of one stretch of the id order:

    magic (8 bytes)
    chunks: for each the planes of up to CHUNK ids, lowest first, each a zstandard frame; planes above the largest id are left out
    index: zstandard frame of an array store: chunk offsets, ids and crc32 of each chunk, sizes of all planes, number of
           planes of each chunk; ids (and whether known) and token counts of the documents; chunk size; plane kind
    footer (24 bytes): offset and size of the index, magic

A chunk can be read alone, and a document by the chunks its ids lie in. Documents are sorted into files by range, so the files
in order hold them by ascending id. Files are named by attempt and only those that a finished task reports count, so lost
executors and repeated tasks do no harm.

Defined cases: a null text is empty; an empty text is its end id alone; null ids come before all others; rows of one id are
ordered by text, and each is a document; long texts are encoded whole and may span chunks; an empty table makes no file.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, partitions, stash
from tidemark.llm.files import from_planes, open_fs, pack_arrays, to_planes, unpack_arrays

MAGIC = b"TMTOKEN1"
CHUNK = 1 << 16
#: Ids of a file, and bytes of text encoded at once.
FILE_IDS, BATCH_BYTES = 1 << 25, 1 << 18
#: Bytes of input, as the plan tells them, of a range of ids.
RANGE_BYTES = 1 << 27
_FOOTER = "<QQ8s"


class FileWriter:
    """Writes one file; ids may come in pieces of any length."""

    def __init__(self, uri: str, chunk: int = CHUNK, bits: bool = False, level: int = 1):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.at, self.chunk, self.bits, self.zip = len(MAGIC), chunk, bits, zstandard.ZstdCompressor(level)
        self.held: list[np.ndarray] = []
        self.have = self.total = 0
        self.offset, self.count, self.crc, self.planes, self.size = [], [], [], [], []
        self.doc_id, self.known, self.tokens = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_id.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.tokens.append(len(ids))
        self.held.append(ids)
        self.have += len(ids)
        self.total += len(ids)
        if self.have >= self.chunk:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        for a in range(0, len(ids) if last else len(ids) - self.chunk + 1, self.chunk):
            part = np.ascontiguousarray(ids[a : a + self.chunk])
            planes = [self.zip.compress(p) for p in to_planes(part, self.bits)]
            self.offset.append(self.at)
            self.count.append(len(part))
            self.crc.append(zlib.crc32(part))
            self.planes.append(len(planes))
            self.size += map(len, planes)
            for p in planes:
                self.out.write(p)
                self.at += len(p)
        rest = np.zeros(0, "<u4") if last else ids[len(ids) - len(ids) % self.chunk :]
        self.held, self.have = [rest], len(rest)

    def close(self) -> None:
        self._flush(True)
        array = lambda x, t: np.array(x, t)
        index = pack_arrays(offset=array(self.offset, "<u8"), count=array(self.count, "<u4"), crc=array(self.crc, "<u4"), planes=array(self.planes, "u1"), size=array(self.size, "<u4"), doc_id=array(self.doc_id, "<i8"), known=array(self.known, bool), tokens=array(self.tokens, "<u8"), chunk=array([self.chunk], "<u4"), bits=array([self.bits], bool))
        self.out.write(index)
        self.out.write(struct.pack(_FOOTER, self.at, len(index), MAGIC))
        self.out.close()


class FileReader:
    """Reads a file's index at once and its chunks as they are asked for."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        at, size, magic = struct.unpack(_FOOTER, self.file.read_at(struct.calcsize(_FOOTER), end - struct.calcsize(_FOOTER)))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        z = unpack_arrays(self.file.read_at(size, at))
        self.doc_id, self.known, self.tokens = z["doc_id"], z["known"], z["tokens"].astype(np.int64)
        self.offset, self.count, self.crc, self.size, self.bits = z["offset"], z["count"], z["crc"], z["size"], bool(z["bits"][0])
        self.first = np.r_[0, np.cumsum(z["planes"].astype(np.int64))]

    def read_chunk(self, k: int) -> np.ndarray:
        sizes = self.size[self.first[k] : self.first[k + 1]].tolist()
        raw, planes, at = self.file.read_at(sum(sizes), int(self.offset[k])), [], 0
        unzip = zstandard.ZstdDecompressor()
        for s in sizes:
            planes.append(unzip.decompress(raw[at : at + s]))
            at += s
        ids = from_planes(planes, int(self.count[k]), np.dtype("<u4"), self.bits)
        if zlib.crc32(ids) != self.crc[k]:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(doc_id, start in the file, pieces of its ids) in order, holding one chunk and one document at a time."""
        at, k, chunk, used = 0, -1, np.zeros(0, "<u4"), 0
        for i, known, n in zip(self.doc_id.tolist(), self.known.tolist(), self.tokens.tolist()):
            pieces, need = [], n
            while need:
                if used == len(chunk):
                    k, used = k + 1, 0
                    chunk = self.read_chunk(k)
                pieces.append(chunk[used : used + need])
                used += len(pieces[-1])
                need -= len(pieces[-1])
            yield (i if known else None), at, pieces
            at += n


class Encoder:
    """Encodes texts with a tokenizer of the tokenizers library, to little-endian unsigned 32-bit ids.

    by_word: for tokenizers that lower case and drop white space, and split off punctuation, so that a text's ids are those of
    its lower-cased words in order, and a word's those of its letters and of the marks behind them. Every distinct word is
    then encoded once for as long as it is remembered: plain letters by the library's model alone, the others together through
    the whole tokenizer, with a mark between them. Texts that hold the mark or might hold special tokens are encoded whole.
    """

    MARK, MOST, LONG, TOGETHER, TAIL = "\x01", 1_200_000, 64, 256, b".,!?;:$%&*#|()-\""

    def __init__(self, tokenizer, by_word: bool):
        self.tokenizer, self.by_word = tokenizer, by_word
        added = {a.content.encode().lower() for a in tokenizer.get_added_tokens_decoder().values()} - {b""}
        self.special = re.compile(b"|".join(map(re.escape, sorted({*added, b"\x01"}))))  # as the tokenizer has them, in any case
        mark = self._ids([self.MARK])[0]
        self.mark, self.by_word = mark[:1], by_word and len(mark) == 1
        self.known: dict[bytes, bytes] = {b"": b""}
        self.tails: dict[bytes, bytes] = {b"": b""}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        known, tokenize, tails, mark = self.known, self.tokenizer.model.tokenize, self.tails, self.TAIL
        odd, ended = set(), []
        for w in words:
            core = w.rstrip(mark)
            if core.isalpha():  # of bytes: ASCII letters only
                ids = known.get(core)
                if ids is None:
                    t = tokenize(core.decode())
                    ids = known[core] = struct.pack(f"<{len(t)}I", *[x.id for x in t])
                if len(core) != len(w):
                    tail = w[len(core) :]
                    if tail not in tails:
                        tails[tail] = self._ids([tail.decode()])[0].tobytes()
                    known[w] = ids + tails[tail]
            elif len(core) != len(w) and core and core.decode()[-1].isalpha():
                ended.append((w, core, w[len(core) :]))
                if core not in known:
                    odd.add(core)
            else:
                odd.add(w)
        self._learn_odd(list(odd))
        for w, core, tail in ended:
            if tail not in tails:
                tails[tail] = self._ids([tail.decode()])[0].tobytes()
            known[w] = known[core] + tails[tail]
        if len(tails) > self.LONG << 10:
            self.tails = {b"": b""}

    def _learn_odd(self, words: list[bytes]) -> None:
        for at in range(0, len(words), self.TOGETHER):
            part = words[at : at + self.TOGETHER]
            ids = self._ids([f" {self.MARK} ".join([w.decode() for w in part])])[0]
            cut = np.r_[-1, np.flatnonzero(ids == self.mark), len(ids)].tolist()
            raw = ids.tobytes()
            for w, a, b in zip(part, cut, cut[1:]):
                self.known[w] = raw[4 * a + 4 : 4 * b]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts."""
        if not self.by_word:
            return [x.tobytes() for x in self._ids([t.decode() for t in texts])]
        split: list[list[bytes] | None] = []
        for t in texts:
            raw = t.lower()  # A-Z only
            split.append(None if self.special.search(raw) else raw.translate(_BLANK).split(b" "))
        if len(self.known) > self.MOST:
            self.known = {b"": b""}
        new = set().union(*filter(None, split)).difference(self.known)
        self._learn(new)
        look = self.known.__getitem__
        out = [self._ids([t.decode()])[0].tobytes() if words is None else b"".join(map(look, words)) for t, words in zip(texts, split)]
        for w in new:
            if len(w) > self.LONG:
                del self.known[w]
        return out


def worker_encoder(vocabulary: str, by_word: bool) -> Encoder:
    """The worker process's encoder for a tokenizer: later tasks of the process find the words of earlier ones."""
    from tokenizers import Tokenizer

    held = sys.modules.setdefault("tidemark_worker", types.ModuleType("tidemark_worker")).__dict__
    key = (zlib.crc32(vocabulary.encode()), by_word)
    if held.get("key") != key:
        held["key"], held["encoder"] = key, Encoder(Tokenizer.from_str(vocabulary), by_word)
    return held["encoder"]


_BLANK = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")


def ranges(docs: DataFrame) -> int:
    """Ranges of ids to encode: as many as the session shuffles into, and more for larger inputs, by the size that the plan tells without a job."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(docs.sparkSession), size // RANGE_BYTES if size < 1 << 58 else 0)  # a plan that knows no size says a huge one


def write(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, by_word: bool = False, bits: bool = False, chunk: int = CHUNK, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text and write the files; returns the written table of files (part, serial, path, documents, ids, start)."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # the tokenizer's file, whatever the input
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.repartitionByRange(ranges(docs), "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, out, serial, part, last = None, None, 0, TaskContext.get().partitionId(), struct.pack("<I", end_id)
        for b in batches:
            encode = encode or worker_encoder(vocabulary.value, by_word)
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and size < BATCH_BYTES:
                    size += len(texts[stop])
                    stop += 1
                for i, e in zip(ids[at:stop], encode(texts[at:stop])):
                    if out is None:
                        path = f"{folder}/{part}-{serial}-{uuid.uuid4().hex}.tok"
                        out = FileWriter(path, chunk, bits)
                    out.add(i, np.frombuffer(e + last, "<u4"))
                    if out.total >= file_ids:
                        yield finish(out, part, serial, path)
                        out, serial = None, serial + 1
                at = stop
        if out is not None:
            yield finish(out, part, serial, path)

    def finish(out: FileWriter, part: int, serial: int, path: str) -> pa.RecordBatch:
        out.close()
        return pa.record_batch([pa.array([x], t) for x, t in ((part, pa.int64()), (serial, pa.int64()), (path, pa.string()), (len(out.tokens), pa.int64()), (out.total, pa.int64()))], names=["part", "serial", "path", "documents", "ids"])

    made = stash(rows.mapInArrow(run, "part long, serial long, path string, documents long, ids long"), "token-index")
    before = F.coalesce(F.sum("ids").over(W.orderBy("part", "serial").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return made.withColumn("start", before)  # one row per file


def read(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): every document as the files hold it; ids are little-endian bytes, or null."""
    spark: SparkSession = files.sparkSession
    dealt = stash(files, "token-files").repartition(partitions(spark), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                rows: list[tuple] = []
                for i, at, pieces in FileReader(path).documents():
                    crc = 0
                    for p in pieces:
                        crc = zlib.crc32(np.ascontiguousarray(p), crc)
                    rows.append((i, start + at, sum(map(len, pieces)), crc, b"".join(p.tobytes() for p in pieces) if with_ids else None))
                    if len(rows) == 4096:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
