"""SentencePiece encoding and decoding by a streaming Viterbi search.

The segmentation of a text is the sequence of vocabulary pieces with the largest sum of piece scores. Characters that no
piece covers cost ten below the smallest score and become byte pieces. The search goes from end to end: an automaton of
all pieces names those that end at a character, and the best of them continues a path that ends where it starts. Pieces to
come start no further back than the longest piece; the ids before a boundary are committed as soon as the backpointer
paths of all positions from there on run through it. So the window holds what follows the last such boundary, and four times
the longest piece beside that; a text on which paths never converge would keep its window open, as any exact search must.
Ties go to the earliest start, the longest last piece.

Every id comes from this search. Where no piece of the vocabulary can cross a place (before a space that follows another
character, around a newline, between two characters that no piece has side by side), all paths converge whatever the scores;
a text is cut there, each such stretch is fed to the search once, and its ids are kept in a bounded table.

For model files of the BPE kind, whose scores are merge ranks, sums of scores say nothing: there a path is scored by its
transitions, 0 where merging the two neighbours' characters by rank gives those two pieces again and minus infinity
elsewhere. Merging leaves a sequence of pieces alone exactly if it leaves each neighbouring pair alone, so one path
survives to each position and it spells the library's own ids (MergeSearch; tests compare both kinds with the library).
Decoding gives the text back exactly, including the character U+2581, which is spelt in bytes here.

Defined cases: null text is empty and has no ids; an empty text has none; an empty table gives no rows; rows with equal
doc_id are answered each; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from operator import add, itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import default_vocabulary, documents, slices

UNKNOWN_PENALTY = 10.0
SPACE = "▁"


class Pieces:
    """Pieces by text, with spaces in place of U+2581, and an automaton that finds them: (text, score, id, length)."""

    def __init__(self, pieces: list[tuple[str, float, int]], bytes_: dict[int, int], size: int):
        self.at = {text: (score, i) for text, score, i in pieces}
        self.ending = ahocorasick.Automaton()
        for text, score, i in pieces:
            self.ending.add_word(text, (text, score, i, len(text)))
        self.ending.make_automaton()
        self.single = {t for t in self.at if len(t) == 1}
        long = [t for t, _, _ in pieces if len(t) > 1]
        self.longest = max(len(t) for t, _, _ in pieces)
        self.unknown = min(s for _, s, _ in pieces) - UNKNOWN_PENALTY
        self.byte_id = bytes_
        self.spell: list[bytes] = [b""] * size
        for text, _, i in pieces:
            self.spell[i] = text.encode()
        for b, i in bytes_.items():
            self.spell[i] = bytes([b])
        self.pairs = {t[i : i + 2] for t in long for i in range(len(t) - 1)}
        self.cut_spaces = not any(" " in t.lstrip(" ") for t in long)
        self.cut_lines = not any("\n" in t for t in long)

    def found(self, text: str, start: int) -> Iterable[tuple[int, tuple[str, float, int, int]]]:
        """Pieces in text from start on by last character, long ones first; characters that are no piece, with id -1, too."""
        own = self.ending.iter(text, start)
        if self.single.issuperset(text):
            return own
        lone = [(k, (text[k], self.unknown, -1, 1)) for k in range(start, len(text)) if text[k] not in self.single]
        return heapq.merge(own, lone, key=itemgetter(0))

    @classmethod
    def load(cls, path: str) -> "Pieces":
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        plain = [(m.id_to_piece(i).replace(SPACE, " "), m.get_score(i), i) for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        return cls(plain, {int(m.id_to_piece(i)[1:-1], 16): i for i in range(n) if m.is_byte(i)}, n)


class StreamingViterbi:
    """feed() characters, get committed ids; finish() gives the rest.

    Lists over the open window, by position in it: how the best path that ends there stands (its score), and where and with
    which id its last piece begins (None where no path ends).
    """

    ORIGIN: float | str = 0.0

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.peak = 0
        self.start()

    def start(self) -> None:
        self.text = ""  # the open window: what follows the last committed boundary
        self.pos = 0  # ends up to here are settled
        self.stand: list = [self.ORIGIN]
        self.begin: list[int | None] = [0]
        self.ident = [0]

    def _take(self, text: str) -> None:
        self.text += text
        more = [None] * len(text)
        self.stand += more
        self.begin += more
        self.ident += more

    def _path(self, end: int) -> list[int]:
        """Ids of the path that ends at a position of the window; characters without a piece are spelt in bytes."""
        out: list[int] = []
        begin, ident, spelt = self.begin, self.ident, self.pieces.byte_id
        while end:
            start, i = begin[end], ident[end]
            out += [i] if i >= 0 else [spelt[b] for b in reversed(self.text[start:end].encode("utf-8", "surrogatepass"))]
            end = start
        return out[::-1]

    def _open(self) -> list[int]:
        """Positions whose paths may still be lengthened: a piece that ends later starts no further back."""
        return [e for e in range(max(0, self.pos - self.pieces.longest + 1), self.pos + 1) if self.begin[e] is not None]

    def _meeting(self) -> int:
        """Last boundary that the paths of all open positions run through."""
        open_ = set(self._open())
        while len(open_) > 1:
            far = max(open_)
            open_.discard(far)
            open_.add(self.begin[far])
        return open_.pop()

    def _advance(self) -> None:
        score, begin, ident, settled = self.stand, self.begin, self.ident, self.pos
        for k, (_, own, i, size) in self.pieces.found(self.text, max(0, settled - self.pieces.longest + 1)):
            e = k + 1
            if e > settled and score[e - size] is not None:
                v = score[e - size] + own
                if score[e] is None or v > score[e]:
                    score[e], begin[e], ident[e] = v, e - size, i
        self.pos = len(self.text)

    def feed(self, text: str) -> list[int]:
        """Takes text in portions as long as the open window (4 longest pieces at least): while paths meet, windows stay
        short; should they not, the window doubles, so the work on it stays in proportion to the text."""
        out: list[int] = []
        least, at = 4 * self.pieces.longest, 0
        while at < len(text):
            size = max(least, len(self.text))
            self._take(text[at : at + size])
            at += size
            self._advance()
            if self.pos >= least:
                self.peak = max(self.peak, self.pos)
                out += self._commit(self._meeting())
        return out

    def _commit(self, meet: int) -> list[int]:
        """Ids up to the meeting, which is the start of the window from now on."""
        if not meet:
            return []
        out = self._path(meet)
        self._cut(meet)
        self.begin = [0, *(None if b is None else b - meet for b in self.begin[meet + 1 :])]
        del self.ident[:meet]
        self.text, self.pos = self.text[meet:], self.pos - meet
        return out

    def _cut(self, meet: int) -> None:
        low = self.stand[meet]
        self.stand = [None if v is None else v - low for v in self.stand[meet:]]

    def finish(self) -> list[int]:
        out = self._path(len(self.text))
        self.start()
        return out

    def encode(self, text: str) -> list[int]:
        if self.text:  # left by feed(); finish() leaves nothing
            self.start()
        out = self.feed(text)
        out += self.finish()
        return out

    def stretches(self, text: str) -> list[str]:
        """text cut wherever no piece has the two neighbouring characters side by side: every path has a boundary there."""
        pairs, out, at = self.pieces.pairs, [], 0
        if pairs.issuperset(map(add, text, text[1:])):
            return [text]
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in pairs:
                out.append(text[at:i])
                at = i
        out.append(text[at:])
        return out


class MergeSearch(StreamingViterbi):
    """The same search with the transition scores of a merge vocabulary. A path stands by its last piece; where the window
    begins, that is the committed one."""

    ORIGIN = ""

    def __init__(self, pieces: Pieces, max_pairs: int = 500_000):
        self.max_pairs, self.n_pairs = max_pairs, 0
        self.stable: dict[str, dict[str, bool]] = {}  # by left piece, then right piece
        super().__init__(pieces)

    def _cut(self, meet: int) -> None:
        del self.stand[:meet]

    def merged(self, text: str) -> list[str]:
        """Characters merged by rank, leftmost first among equals."""
        at, parts = self.pieces.at, list(text)
        while len(parts) > 1:
            best, k = None, -1
            for i in range(len(parts) - 1):
                hit = at.get(parts[i] + parts[i + 1])
                if hit is not None and (best is None or hit[0] > best):
                    best, k = hit[0], i
            if best is None:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _row(self, one: str) -> dict[str, bool]:
        """What is known of the pieces that can follow one."""
        if self.n_pairs >= self.max_pairs:
            self.stable.clear()
            self.n_pairs = 0
        return self.stable.setdefault(one, {})

    def _test(self, one: str, two: str) -> bool:
        row = self._row(one)
        self.n_pairs += 1
        row[two] = ok = self.merged(one + two) == ([one, two] if one else [two])
        return ok

    def _advance(self) -> None:
        last, begin, ident, settled, nothing = self.stand, self.begin, self.ident, self.pos, {}
        known = self.stable.get
        for k, (piece, _, i, size) in self.pieces.found(self.text, max(0, settled - self.pieces.longest + 1)):
            e = k + 1
            if last[e] is None and e > settled:
                one = last[e - size]
                if one is not None:
                    ok = known(one, nothing).get(piece)
                    if ok is None:
                        ok = self._test(one, piece)
                    if ok:
                        last[e], begin[e], ident[e] = piece, e - size, i
        self.pos = len(self.text)


class Recent:
    """Values of the keys met lately. A full table becomes the older one, and what is still asked for moves back."""

    def __init__(self, max_entries: int):
        self.max_entries = max_entries
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def age(self) -> None:
        if len(self.table) > self.max_entries:
            self.older, self.table = self.table, {}

    def get(self, key: str) -> bytes | None:
        got = self.table.get(key)
        if got is None:
            got = self.older.get(key)
            if got is not None:
                self.table[key] = got
        return got


class Encoder:
    """Whole texts to ids and back. kind: of the model file, bpe or unigram."""

    known_files: dict[str, "Encoder"] = {}

    def __init__(self, pieces: Pieces, kind: str = "bpe", max_entries: int = 250_000, max_len: int = 48):
        self.pieces, self.search = pieces, (MergeSearch if kind == "bpe" else StreamingViterbi)(pieces)
        self.max_len = max_len
        self.known, self.parts = Recent(max_entries), Recent(max_entries)
        self.stretches = re.compile("\n| *[^ \n]+| +") if pieces.cut_spaces and pieces.cut_lines else None

    @classmethod
    def of(cls, path: str, kind: str = "bpe") -> "Encoder":
        key = f"{kind}:{path}"
        if key not in cls.known_files:
            cls.known_files[key] = cls(Pieces.load(path), kind)
        return cls.known_files[key]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; a space is put before a text that is not empty."""
        if not text:
            return b""
        if self.stretches is None:
            return np.array(self.search.encode(" " + text), dtype="<u4").tobytes()
        parts = self.stretches.findall(" " + text)
        known = self.known
        known.age()
        got = list(map(known.table.get, parts))
        if None in got:
            for k, p in enumerate(parts):
                if got[k] is None:
                    got[k] = known.get(p)
                    if got[k] is None:
                        got[k] = self.fresh(p)
                        if len(p) <= self.max_len:
                            known.table[p] = got[k]
        return b"".join(got)

    def fresh(self, stretch: str) -> bytes:
        """Ids of a stretch not met lately, from its shorter stretches."""
        out = []
        self.parts.age()
        for p in self.search.stretches(stretch):
            ids = self.parts.get(p)
            if ids is None:
                ids = array("I", self.search.encode(p))
                if sys.byteorder == "big":
                    ids.byteswap()
                ids = ids.tobytes()
                if len(p) <= self.max_len:
                    self.parts.table[p] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        spell = self.pieces.spell
        raw = b"".join([spell[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        return raw.decode("utf-8", "surrogatepass")[1:]


def encode_documents(df: DataFrame, vocabulary: Callable[[], str] | None = None, kind: str = "bpe") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit)."""
    vocabulary = vocabulary or default_vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary(), kind)
        for b in slices(batches):
            ids = [encoder.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode_documents(df: DataFrame, vocabulary: Callable[[], str] | None = None, kind: str = "bpe") -> DataFrame:
    """doc_id, text of encoded documents (doc_id, ids)."""
    vocabulary = vocabulary or default_vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary(), kind)
        for b in slices(batches):
            texts = [encoder.decode(i) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(df: DataFrame, vocabulary: Callable[[], str] | None = None, kind: str = "bpe") -> DataFrame:
    """Per document: n_tokens, crc32 of the ids, sha256 of the decoded text, whether it is the text again."""
    vocabulary = vocabulary or default_vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        encoder = Encoder.of(vocabulary(), kind)
        for b in slices(batches):
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "")
                back = encoder.decode(ids)
                out.append((doc, len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (text or "")))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"), map(list, zip(*out, strict=True)), strict=True)))

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
