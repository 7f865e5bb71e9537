"""Shared helpers: scratch tables in the cluster's shared folder, Arrow streaming, cached tokenisation."""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, where neither PYTHONPATH nor the working folder gives it to them."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    inherited = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.path.realpath(os.getcwd())]
    if any(os.path.exists(os.path.join(p, "tidemark", "llm", "common.py")) for p in inherited) or _SHIPPED.get(spark.sparkContext.applicationId):
        return
    _SHIPPED[spark.sparkContext.applicationId] = True
    folder = tempfile.mkdtemp(prefix="tidemark-")  # the driver serves the file from here while the session lasts
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "tidemark"), "zip", root, "tidemark"))


_SHIPPED: dict[str, bool] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one is set only where that is unset (tests)."""
    ship(spark)
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back. Survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def forget(*stashed: DataFrame | None) -> None:
    """Delete stashed tables that nothing will read any more."""
    for df in stashed:
        if path := getattr(df, "_stashed_at", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: At most so many keys can each hold more than one in HOT of all rows: the proven bound of a broadcast of hot keys.
HOT = 1024


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined with groups (one row a key, with its number of rows in `size`). Keys that hold more than one in HOT of
    all rows are at most HOT keys: they are broadcast, so that their rows stay where they are; all others meet by shuffle."""
    line = max(1, total // HOT)
    hot, plain = groups.where(F.col(size) > line), groups.where(F.col(size) <= line)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(plain.hint("merge"), keys))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(df: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty strings; every other column is left behind."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def ascii_lower(c):
    """Lower-case A-Z only. lower() is the same for pure ASCII and much faster; translate() keeps other letters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small zero-copy slices, so that only a few texts are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of equal key in a stream that is sorted by key; a run may cross batches."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.asarray(b.column(b.schema.get_field_index(key)))
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and k[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = k[lo]
    if held:
        yield pa.Table.from_batches(held)


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


_ENCODERS: dict[str, "CachedEncoder"] = {}


#: Fixed value: the word pattern of public word_bpe files, for which plain chunks can be cut without the library.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
#: ASCII but for <, which can begin a special token, and the letters of Latin-1, which no normal form changes.
PLAIN_TEXT = re.compile("[ \\t\\n\\r!-;=-~À-ÖØ-öø-ÿ]*")


class CachedEncoder:
    """Ids of a tokenizers-library file, computed once per white-space chunk.

    The tokenizers handled here drop white space and never join tokens across it, so the ids of a text are those of
    its chunks in order. Only space and newline are cut at, which every such tokenizer counts as white space. Where the
    file's own pattern shows how words are cut (texts of ASCII and Latin-1 letters, lower-cased by the file), texts are cut
    into words at once. Words and chunks not met yet go to the library, many in one call. Those longer than max_len
    are encoded without being kept; the tables are emptied when they hold max_entries.
    """

    def __init__(self, path: str, max_entries: int = 300_000, max_len: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_entries, self.max_len = max_entries, max_len
        self.known: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        patterns = [p["pattern"].get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        lowers = any(n["type"] == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        specials = all(t["content"].startswith("<") for t in spec.get("added_tokens", []))
        suffix = spec["model"].get("end_of_word_suffix")
        self.word_end = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        if suffix:
            self.word_end[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
        self.cuts_words = lowers and bool(suffix) and specials and patterns == [WORD_PATTERN]

    @classmethod
    def of(cls, path: str) -> "CachedEncoder":
        """One per worker process and file, kept between tasks."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def fresh(self, parts: list[str], single: bool = False) -> list[bytes]:
        """Ids of each part, from the library. single: each part is one word of the file's pattern, which its last piece ends."""
        import numpy as np

        out: list[bytes] = []
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            ends = np.zeros(0)
            if single:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
                ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(some):
                e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
                ids = np.array(e.ids, dtype="<u4")
                ends = np.searchsorted(np.array(e.word_ids, dtype=np.float64), np.arange(1, len(some) + 1))
            raw, ends = ids.tobytes(), [0, *(ends * 4).tolist()]
            out += [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The same for many texts; words and chunks not met yet are looked up together."""
        tables = (self.words, self.known)
        for t in tables:
            if len(t) > 2 * self.max_entries:
                t.clear()
        self.known[""] = b""
        held, missing = [], (set(), set())
        for t in texts:
            kind = 0 if self.cuts_words and PLAIN_TEXT.fullmatch(t) else 1
            split = t.replace("\n", " ").split(" ") if kind else PLAIN_WORDS.findall(t.lower())
            parts = list(map(tables[kind].get, split))
            gaps = [k for k, p in enumerate(parts) if p is None] if None in parts else []
            own = [split[k] for k in gaps]
            missing[kind].update(own)
            held.append((parts, gaps, own, kind))
        fresh = []
        for kind, (table, new) in enumerate(zip(tables, map(list, missing), strict=True)):
            got = dict(zip(new, self.fresh(new, single=kind == 0), strict=True))
            table.update((c, b) for c, b in got.items() if len(c) <= self.max_len)
            fresh.append(got)
        out = []
        for parts, gaps, own, kind in held:
            for k, c in zip(gaps, own, strict=True):
                parts[k] = fresh[kind][c]
            out.append(b"".join(parts))
        return out


def default_vocabulary(name: str) -> Callable[[], str]:
    """Path of a public vocabulary file; asked for on the machine that reads it."""

    def path() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return path
