"""Token-ID output as Arrow files of fixed-size-list batches, and their zero-copy reader.

Documents are range-partitioned by doc_id and sorted; each task encodes its texts, appends the end id and writes one
Arrow IPC file to the shared folder: record batches of equal-length sequences (tokens: fixed_size_list of unsigned
integers, mask: fixed_size_list of booleans, false only in the padding of a file's last sequence), uncompressed, so a
memory-mapped sequence is a view of the file. A second Arrow file beside it lists doc_id, first id and id count of each
document. Files are named by an attempt of their own; only those of committed tasks reach the manifest, so a lost
executor leaves no duplicate. Ids are stored in 16 bits where the vocabulary allows it.

Defined cases: null text is empty and yields just the end id; rows with equal doc_id are ordered by their text, rows without one come first; an
empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import CachedEncoder, default_vocabulary, documents, scratch_path, slices, stash, text_or_empty

SEQUENCE = 2048
BATCH = 128
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def file_schema(width: int, length: int) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(pa.uint16() if width == 2 else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])


class TokenFileWriter:
    """Appends id arrays; keeps at most one record batch and one document in memory."""

    def __init__(self, fs: pafs.FileSystem, path: str, width: int, length: int = SEQUENCE, batch: int = BATCH):
        self.schema, self.length, self.room = file_schema(width, length), length, length * batch
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        self.out = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.held: list[np.ndarray] = []
        self.n = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= self.room:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.room * self.room
            for i in range(0, whole, self.room):
                self._write(flat[i : i + self.room], self.room)
            self.held, self.n = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, real: int) -> None:
        tokens = pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(flat)) < real), self.length)
        self.file.write_batch(pa.record_batch([tokens, mask], schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        if len(flat):
            self._write(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.file.close()
        self.out.close()


class TokenFile:
    """Random access to a written file. On a local file system every view points into the mapped file."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        local = isinstance(fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("tokens").type.list_size
        self.per_batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.at, self.batch = -1, None

    def _batch(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.batch = k, self.file.get_batch(k)
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence i of the file."""
        b, r = self._batch(i // self.per_batch), i % self.per_batch
        flat = b.column(0).values.to_numpy(zero_copy_only=True)
        return flat[r * self.length : (r + 1) * self.length], b.column(1).values.slice(r * self.length, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from position start of the file's stream."""
        room, parts = self.per_batch * self.length, []
        while n > 0:
            k, at = divmod(start, room)
            part = self._batch(k).column(0).values.to_numpy(zero_copy_only=True)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint16)])


def write_token_files(df: DataFrame, folder: str, vocabulary: Callable[[], str], end_id: int, length: int = SEQUENCE) -> DataFrame:
    """Writes the files of df's texts and returns the manifest: path, first_doc, n_docs, n_ids (a row a file)."""
    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name = f"{base}/part-{uuid.uuid4().hex}"
        encoder = CachedEncoder.of(vocabulary())
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        tokens = index = None
        first = docs = 0
        for b in slices(batches):
            if tokens is None:
                fs.create_dir(base, recursive=True)
                tokens, out = TokenFileWriter(fs, f"{name}.arrow", width, length), fs.open_output_stream(f"{name}.index.arrow")
                index, first = pa.ipc.new_file(out, INDEX), b.column(0)[0].as_py()
            starts, counts = [], []
            for raw in encoder.encode_all(b.column(1).to_pylist()):
                ids = np.append(np.frombuffer(raw, dtype="<u4"), np.uint32(end_id))
                starts.append(tokens.total)
                counts.append(len(ids))
                tokens.add(ids)
            index.write_batch(pa.record_batch([b.column(0).cast(pa.int64()), pa.array(starts), pa.array(counts)], schema=INDEX))
            docs += b.num_rows
        if tokens is not None:
            tokens.close()
            index.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([v], pa.int64()) for v in (first, docs, tokens.total))], names=["path", "first_doc", "n_docs", "n_ids"])

    ordered = text_or_empty(df).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stash(ordered.mapInArrow(write, "path string, first_doc long, n_docs long, n_ids long"), "manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = manifest.count()
    placed = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("first_doc", "path").rowsBetween(Window.unboundedPreceding, -1)))  # a row a file
    placed = placed.select("path", F.coalesce("base", F.lit(0)).cast("long").alias("base")).repartition(max(1, files))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(folder)[0]
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = TokenFile(fs, f"{path}.arrow")
                with fs.open_input_file(f"{path}.index.arrow") as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        crc = [zlib.crc32(tokens.ids(s, n).astype("<u4").tobytes()) for s, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                        start = pa.array(part.column(1).to_numpy() + base)
                        yield pa.RecordBatch.from_arrays([part.column(0), start, part.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    manifest = write_token_files(documents(spark, sf_dir), folder, default_vocabulary("word_bpe_49k.json"), end_id=2)
    return read_token_files(manifest, folder)
