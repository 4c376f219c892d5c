"""Operator 4: token ids in independent zstandard frames with a seek table.

File layout (little endian throughout), readable by any zstandard decoder:

* frames: each holds the ids of consecutive documents as unsigned 32-bit integers, is
  compressed on its own and carries zstandard's content checksum;
* an index in a skippable frame (magic 0x184D2A50): the number of ids of every document and
  the number of documents of every frame;
* the seek table of the public zstandard seekable format in a last skippable frame (magic
  0x184D2A5E): compressed size, decompressed size and checksum (low 32 bits of xxh64) of every
  frame, then the frame count, a descriptor byte and the magic 0x8F92EAB1.

A reader takes the footer, then the tables, then only the frames that hold requested documents.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPLIT, Workspace, small_batches

# fixed values of the public formats
INDEX_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

FRAME_IDS = 1 << 16
LEVEL = 1
CACHE_ENTRIES = 400_000
END_ID = 0
ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
SAFE_CUT = re.compile(r"(?<=[a-z]) (?=[a-z])")
PIECE_CHARS = 1 << 15

#: A word of Latin letters after at most one space or line feed, then ASCII marks but the apostrophe: two or three pieces of the pre-tokenizer.
PLAIN = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")

_encoders: dict[str, Encoder] = {}


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints in Latin-1, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Encoder:
    """Byte-level BPE through the tokenizers library, which sees each distinct word once.

    The byte-level pre-tokenizer never lets a piece reach across the start of a run of white
    space, so a text is cut before every run of spaces and line feeds and the parts are looked up
    or encoded alone. Texts with other white space are encoded whole, in parts cut between two
    letters, where a boundary is certain. The memory for words is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}

    def raw(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """A string that the pre-tokenizer leaves whole goes straight to the BPE model."""
        got = self.known.get(piece)
        if got is None:
            got = array("I", [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, piece.encode())))]).tobytes()
            self.keep(piece, got)
        return got

    def keep(self, part: str, got: bytes) -> None:
        if len(self.known) < CACHE_ENTRIES and len(part) < 64:
            self.known[part] = got

    def part(self, part: str) -> bytes:
        """The ids of a run of white space and the word after it."""
        got = self.known.get(part)
        if got is None:
            m = PLAIN.fullmatch(part)
            if m is None:
                got = self.raw(part)
                self.keep(part, got)
            else:
                old = m[2] in self.known  # a word met before is worth an entry with its marks too
                got = b"".join([self.piece(x) for x in m.groups() if x])
                if old:
                    self.keep(part, got)
        return got

    def ids(self, text: str | None) -> bytes:
        """The ids of a text and the end id, as little-endian unsigned 32-bit integers."""
        if not text:
            return b"\0\0\0\0"
        if ODD_SPACE.search(text):
            out, at = [], 0
            while at < len(text):
                cut = SAFE_CUT.search(text, at + PIECE_CHARS) if at + PIECE_CHARS < len(text) else None
                end = cut.start() if cut else len(text)
                out.append(self.raw(text[at:end]))
                at = end
            return b"".join([*out, b"\0\0\0\0"])
        if "  " in text or "\n" in text and ("\n\n" in text or " \n" in text or "\n " in text) or "\0" in text:
            parts = SPLIT.findall(text)
        else:
            parts = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
            if not parts[0]:
                del parts[0]
        try:
            out = list(map(self.known.__getitem__, parts))
        except KeyError:
            out = [self.part(p) for p in parts]
        out.append(b"\0\0\0\0")
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def filesystem(path: str):
    """(file system, path in it) of a shared folder's URI: local, hdfs, s3 and so on."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes documents, already in order, as frames; close() adds index and seek table."""

    def __init__(self, out):
        self.out = out
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.held: list[bytes] = []
        self.size = 0
        self.lengths: list[int] = []
        self.per_frame: list[int] = []
        self.table: list[tuple[int, int, int]] = []

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.lengths.append(len(ids) // 4)
        self.size += len(ids)
        if self.size >= 4 * FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.compressor.compress(raw)
            self.out.write(packed)
            self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.per_frame.append(len(self.held))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = np.array([len(self.lengths), len(self.per_frame)], "<u4").tobytes() + np.array(self.per_frame, "<u4").tobytes() + np.array(self.lengths, "<u4").tobytes()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class Reader:
    """Random access to a file of Writer: frames are read and decompressed one by one, on request."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        start = size - 9 - 12 * count
        self.table = np.frombuffer(self._at(start, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        magic, length = struct.unpack("<II", self._at(int(self.begin[-1]), 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index before the seek table")
        index = np.frombuffer(self._at(int(self.begin[-1]) + 8, length), "<u4").astype(np.int64)
        self.per_frame, self.lengths = index[2 : 2 + index[1]], index[2 + index[1] :]
        self.first = np.concatenate([[0], np.cumsum(self.per_frame)])

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def __len__(self) -> int:
        return len(self.lengths)

    def frame(self, k: int) -> bytes:
        packed, length, check = self.table[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.begin[k]), int(packed)), max_output_size=int(length))
        if len(raw) != length or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} does not match its checksum")
        return raw

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(document, its ids as bytes) for ascending document numbers of this file; all by default."""
        held, raw = -1, b""
        for n in range(len(self)) if wanted is None else sorted(set(wanted)):
            k = int(np.searchsorted(self.first, n, "right")) - 1
            if k != held:
                held, raw = k, self.frame(k)
                ends = np.cumsum(self.lengths[self.first[k] : self.first[k + 1]])
            i = n - int(self.first[k])
            yield n, raw[4 * int(ends[i] - self.lengths[n]) : 4 * int(ends[i])]


def write_tokens(df: DataFrame, tokenizer: str, out: str, id_col: str = "doc_id", text_col: str = "text", ws: Workspace | None = None) -> DataFrame:
    """Encodes every document and writes token files below ``out``; returns the manifest.

    Files follow one another in ascending id (nulls first; repeats of one id in the order of
    their text hash). One row a file: part int, path, n_docs long, n_tokens long. A task writes
    under a name of its own attempt and only names in the manifest count, so retries leave no
    half files behind it. Null texts are empty and have the end id alone. An empty table gives
    an empty manifest; extra columns are ignored.
    """
    spark = df.sparkSession
    ws = ws or Workspace(spark, "tokens")
    small_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("h"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h")

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, writer, sink, ids, total = encoder(tokenizer), None, None, [], 0
        part = TaskContext.get().partitionId()
        fs, base = filesystem(out)
        path = f"{base}/part-{part:05d}-{uuid.uuid4().hex}.tok.zst"
        for f in frames:
            for doc, text in zip(f.doc_id, f.text, strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(path, compression=None)
                    writer = Writer(sink)
                got = enc.ids(text)
                writer.add(got)
                ids.append(None if pd.isna(doc) else int(doc))
                total += len(got) // 4
        if writer is not None:
            writer.close()
            sink.close()
            yield pd.DataFrame({"part": [part], "path": [path], "ids": [ids], "n_docs": [len(ids)], "n_tokens": [total]})

    return ws.write(rows.mapInPandas(save, "part int, path string, ids array<long>, n_docs long, n_tokens long"), "manifest")


def read_tokens(manifest: DataFrame, out: str) -> DataFrame:
    """One row a document, from the files: doc_id, start long (ids of all documents before it), n_tokens long, ids_crc32 long.

    Every frame is checked against both checksums. Files are read in parallel, one frame at a time.
    """
    at = F.sum("n_tokens").over(W.orderBy("part")) - F.col("n_tokens")  # a row a file
    files = manifest.withColumn("start", at)
    files = files.repartition(max(1, manifest.count()), "part")

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = filesystem(out)
        for f in frames:
            for path, ids, start in zip(f.path, f.ids, f.start, strict=True):
                with fs.open_input_file(path) as source:
                    reader, got = Reader(source), []
                    for n, raw in reader.documents():
                        got.append((None if pd.isna(ids[n]) else int(ids[n]), start, len(raw) // 4, zlib.crc32(raw)))
                        start += len(raw) // 4
                        if len(got) == 10_000:
                            yield pd.DataFrame(got, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})
                            got = []
                    if got:
                        yield pd.DataFrame(got, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    return files.select("path", "ids", "start").mapInPandas(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(df: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the token files of df and reads every document back from them."""
    ws = Workspace(df.sparkSession, "tokens")
    out = ws.path("files")
    return read_tokens(write_tokens(df, tokenizer, out, ws=ws), out)
