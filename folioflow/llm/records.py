"""Token ids of prompts in length-delimited binary records with masked checksums, and an offset index beside them.

A folder holds record files, one index file for each, and ``_records.json``, which lists them in order. A record is

    length of the payload   8 bytes
    masked CRC-32C of that  4 bytes
    payload
    masked CRC-32C of it    4 bytes

and its payload is the bytes per id (1 byte), the length of the key's text (4 bytes, all ones for null), that text
in UTF-8, and the ids. Numbers are little-endian and unsigned. The index has 16 bytes for each record of its file:
where the record begins, and how many ids the records before it hold. Ids take two bytes where the vocabulary allows it.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DataType

from .bpe import byte_letters

# fixed values: CRC-32C polynomial (reflected) and the constant of masked checksums
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
# fixed value: how the byte-level vocabulary cuts a text into words; [^\W\d_] stands for letters
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: letters beyond these may be classed otherwise by the library; texts with such go to it whole
ODD = re.compile("[^\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]")

CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
#: a word and one of these are two words of the split
MARKS = frozenset(",.;:!?")

MANIFEST = "_records.json"
NULL_KEY = 0xFFFFFFFF
_BLOCK = 1024


def _tables() -> np.ndarray:
    """What a byte at each place of a block adds to the block's checksum (without start and end values)."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
    rows = [one]
    for _ in range(_BLOCK - 1):
        rows.append(one[rows[-1] & 255] ^ (rows[-1] >> 8))
    return np.concatenate(rows[::-1])


_ADDED = _tables()
_PLACE = np.arange(_BLOCK, dtype=np.int32) * 256
_HEAD = [[int(x) for x in _ADDED[256 * i:256 * i + 256]] for i in range(4)]


def _of_rows(rows: np.ndarray) -> np.ndarray:
    """Checksums, started from zero, of equally long rows of at most a block."""
    return np.bitwise_xor.reduce(_ADDED.take(rows + _PLACE[_BLOCK - rows.shape[1]:]), axis=1)


def crc32c(data: bytes) -> int:
    """CRC-32C of the bytes; the checksum is linear, so blocks are summed apart and carried over one another."""
    first = len(data) % _BLOCK or min(len(data), _BLOCK)
    d = np.frombuffer(data, np.uint8)
    crc, head = 0xFFFFFFFF, d[:first].astype(np.int32)
    for i, b in enumerate(head[:4]):
        head[i] = b ^ (crc >> 8 * i & 255)
    crc = int(_of_rows(head[None])[0]) if first else crc
    if 0 < first < 4:
        crc ^= 0xFFFFFFFF >> 8 * first
    for at in range(first, len(d), 1 << 20):  # whole blocks, a bounded number at a time
        for s in _of_rows(d[at:at + (1 << 20)].reshape(-1, _BLOCK)).tolist():
            crc = s ^ _HEAD[0][crc & 255] ^ _HEAD[1][crc >> 8 & 255] ^ _HEAD[2][crc >> 16 & 255] ^ _HEAD[3][crc >> 24]
    return crc ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    """The checksum turned and moved, so that checksums of data that hold checksums stay apart."""
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked(crc32c(head)).to_bytes(4, "little"), payload, masked(crc32c(payload)).to_bytes(4, "little")))


def unframe(stream) -> bytes:
    """The payload of the record at the stream's place; an error if a length or a checksum does not fit."""
    head = stream.read(12)
    if len(head) < 12 or masked(crc32c(head[:8])) != int.from_bytes(head[8:], "little"):
        raise ValueError("damaged record length")
    size = int.from_bytes(head[:8], "little")
    body = stream.read(size + 4)
    if len(body) < size + 4 or masked(crc32c(body[:size])) != int.from_bytes(body[size:], "little"):
        raise ValueError("damaged record")
    return body[:size]


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    records: int
    ids: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, width: int):
        self.folder, self.width = folder, width

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _store(self.folder)
        fs.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        index, at, ids = array("Q"), 0, 0
        with fs.open_output_stream(f"{folder}/{name}.records") as out:
            for b in batches:
                for key, data in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
                    text = b"" if key is None else key.encode()
                    size = NULL_KEY if key is None else len(text)
                    record = frame(b"".join((bytes([self.width]), size.to_bytes(4, "little"), text, data)))
                    out.write(record)
                    index.extend((at, ids))
                    at += len(record)
                    ids += len(data) // self.width
        with fs.open_output_stream(f"{folder}/{name}.index") as out:
            out.write(np.array(index, "<u8").tobytes())
        return Written(part, name, len(index) // 2, ids)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m), key=lambda m: m.part)
        fs, folder = _store(self.folder)
        fs.create_dir(folder, recursive=True)
        files, base = [], 0
        for m in done:
            files.append({"name": m.name, "records": m.records, "base": base})
            base += m.ids
        with fs.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"ids": base, "files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files that no list names are never read, so what a failed write leaves does no harm."""


@dataclass
class _Stretch(InputPartition):
    name: str
    base: int
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, folder: str, stretch: int, seed: int | None):
        self.folder, self.stretch, self.seed = folder, stretch, seed

    def partitions(self) -> list[_Stretch]:
        fs, folder = _store(self.folder)
        with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
            files = json.loads(f.read())["files"]
        out = [_Stretch(x["name"], x["base"], i, min(i + self.stretch, x["records"])) for x in files for i in range(0, x["records"], self.stretch)]
        if self.seed is not None:
            out = [out[i] for i in np.random.default_rng(self.seed).permutation(len(out))]
        return out

    def read(self, part: _Stretch) -> Iterator[pa.RecordBatch]:
        if part is None:  # a folder without records
            return
        fs, folder = _store(self.folder)
        n = part.last - part.first
        with fs.open_input_file(f"{folder}/{part.name}.index") as f:
            f.seek(16 * part.first)
            index = np.frombuffer(f.read(16 * n), "<u8").reshape(n, 2)
        order = np.arange(n) if self.seed is None else np.random.default_rng([self.seed, part.base, part.first]).permutation(n)
        # in order the file is read through a buffer, in shuffled order record by record
        with fs.open_input_file(f"{folder}/{part.name}.records") as f:
            if n:
                f.seek(int(index[0, 0]))
            source = pa.BufferedInputStream(f, 1 << 20) if self.seed is None else f
            keys, ids, starts, size = [], [], [], 0
            for i in order.tolist():
                if self.seed is not None:
                    f.seek(int(index[i, 0]))
                p = unframe(source)
                k = int.from_bytes(p[1:5], "little")
                at = 5 if k == NULL_KEY else 5 + k
                keys.append(None if k == NULL_KEY else p[5:at].decode())
                ids.append(np.frombuffer(p[at:], f"<u{p[0]}").astype("<u4").tobytes())
                starts.append(part.base + int(index[i, 1]))
                size += len(ids[-1])
                if size > 8 << 20:
                    yield _batch(keys, ids, starts)
                    keys, ids, starts, size = [], [], [], 0
            if keys:
                yield _batch(keys, ids, starts)


def _batch(keys: list, ids: list, starts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.binary()), pa.array(starts, pa.int64())], names=["key", "ids", "start"])


class TokenRecords(DataSource):
    """Spark source and sink ``token_records``. Options: ``width`` (bytes per id, writing), ``stretch`` (records per
    task, reading), ``seed`` (read in an order shuffled by it)."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> str:
        return "key string, ids binary, start long"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("width", 4)))

    def reader(self, schema) -> _Reader:
        seed = self.options.get("seed")
        return _Reader(self.options["path"], int(self.options.get("stretch", 1 << 16)), None if seed is None else int(seed))


class _Kept(dict):
    """What a function gives for each text, kept for ``room`` texts and for those asked for among the ``room`` before."""

    def __init__(self, make: Callable[[str], bytes | None], room: int):
        super().__init__()
        self.make, self.room, self.old = make, room, {}

    def __missing__(self, text: str) -> bytes | None:
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        out = self.old[text] if text in self.old else self.make(text)
        self[text] = out
        return out


class ByteCoder:
    """Whole texts to ids of the tokenizers library, whose model is asked once for each word as long as it is kept.

    A blank before a word always begins a new word of the vocabulary's split, so a text falls into chunks at its
    blanks. Where white space meets white space over a blank, or letters are uncommon, the text is not cut.
    """

    def __init__(self, spec: str, room: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = dict(enumerate(byte_letters()))
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words = _Kept(self.word, room)
        self.chunks = _Kept(self.chunk, room)

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def word(self, word: str) -> bytes:
        return self.packed([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))])

    def chunk(self, chunk: str) -> bytes | None:
        """Ids of a blank and a chunk; None if white space at its ends or odd letters need the whole text."""
        if chunk.isalpha() and (chunk.isascii() or not ODD.search(chunk)):
            return self.word(" " + chunk)
        if chunk[-1:] in MARKS and chunk[:-1].isalpha() and (chunk.isascii() or not ODD.search(chunk)):
            return self.chunks[chunk[:-1]] + self.words[chunk[-1]]
        if not chunk or chunk[0].isspace() or chunk[-1].isspace() or self.odd(chunk):
            return None
        first, *more = SPLIT.findall(" " + chunk)
        if not more:
            return self.word(first)
        return self.chunks[first[1:]] + b"".join(map(self.words.__getitem__, more))

    def odd(self, text: str) -> bool:
        if not text.isascii() and ODD.search(text):
            return True
        for s in self.special:
            if s in text:
                return True
        return text.isascii() and CONTROL.search(text) is not None

    def whole(self, text: str) -> bytes:
        if self.odd(text):
            return self.packed(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, SPLIT.findall(text)))

    def encode(self, text: str) -> bytes:
        first, *more = text.split(" ")
        if not first[-1:].isspace():
            try:
                return self.whole(first) + b"".join(map(self.chunks.__getitem__, more))
            except TypeError:  # a chunk that is None
                pass
        return self.whole(text)


@lru_cache(maxsize=1)
def coder(spec: str) -> ByteCoder:
    """One coder per worker process, so that later tasks find the words of earlier ones."""
    return ByteCoder(spec)


def write_prompt_records(
    prompts: DataFrame, vocabulary: str, folder: str, key: str = "panel", positive: str = "positive", end: int = 0,
) -> None:
    """Write the token ids of whole prompts, each with the id ``end`` behind it, as records in ascending order of ``key``.

    ``vocabulary`` is the path of a byte-level BPE file of the tokenizers library, ``folder`` a new folder that
    executors share (an address that pyarrow can open). Rows are dealt by ranges of the key and the text's hash and
    sorted inside a range; each task encodes its range and writes one record file with its index. Only the names
    and sizes of files come to the driver. A task that runs twice writes a new file, and only one is listed.

    Ids equal those of the library with ``add_special_tokens=False``; special tokens inside a text keep their ids.
    Null and empty prompts are a record of one id. Null keys come first; rows of one key are records of their own,
    in the order of their texts' hashes. An empty table gives a folder without records. Other columns are not read.
    """
    spark = prompts.sparkSession
    spark.dataSource.register(TokenRecords)
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    held = spark.sparkContext.broadcast(spec)  # the vocabulary file bounds its size
    width = array(ByteCoder(spec).code).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(held.value)
        last = c.packed([end])
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [c.encode(t or "") + last for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])

    rows = prompts.select(F.col(key).alias("k"), F.col(positive).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h").select(F.col("k").cast("string").alias("key"), "t")
    rows.mapInArrow(run, "key string, ids binary").write.format("token_records").option("width", width).mode("append").save(folder)


def read_prompt_records(
    spark: SparkSession, folder: str, key: str = "panel", kind: DataType | str = "string", seed: int | None = None, stretch: int = 1 << 16,
) -> DataFrame:
    """The records of a folder: ``key`` (as ``kind``), ``start`` (ids of all records before it) and ``ids``
    (binary, little-endian unsigned 32-bit integers).

    A task reads at most ``stretch`` records of one file, found by the index. With ``seed``, the stretches and the
    records of each come in an order drawn from it, each record read at its offset. Lengths and checksums
    are tested; damage is an error. A folder without records gives no rows.
    """
    spark.dataSource.register(TokenRecords)
    reader = spark.read.format("token_records").option("stretch", stretch)
    if seed is not None:
        reader = reader.option("seed", seed)
    return reader.load(folder).select(F.col("key").cast(kind).alias(key), "start", "ids")
