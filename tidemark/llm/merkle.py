"""Document fingerprints: a Merkle tree over sections and paragraphs, with phrases below.

A paragraph is a line, its node the 128-bit hash of the line as it stands; a section is a run of paragraphs that ends with
a blank line or where the paragraph's own node says so (one in SECTION_EVERY), so an insertion moves no later border; its
node is the hash of its paragraphs' nodes, and the root the hash of the sections' nodes. Nothing of the text is left out:
roots are equal exactly if texts are. Below a paragraph lie its phrases, runs of words with the white space after them, as
32-bit codes that only say where inside a paragraph two texts differ. A phrase ends after a word whose own code says so
(in a paragraph of few words, after each), so its borders too depend on nearby text alone; words over LONG_WORD
characters are cut.

A fingerprint spells the tree: the root in hex, then each paragraph's node and phrases, with `/` between sections and `,`
between paragraphs. edits() compares two fingerprints from the root down: equal sections at both ends are passed over,
paragraphs are aligned by their nodes in order, and only in those that differ are phrases aligned; it returns every insertion,
deletion and replacement with its place in both trees, and nothing exactly if roots are equal. likeness() also goes
down from the root: the share of phrases that lie in equal sections, else in equal paragraphs, else are equal themselves
(half for a phrase that follows another one than it did); texts that differ are never quite 1.

Defined cases: null text is empty; an empty text has a root and one blank paragraph, and texts without phrases are alike if
equal; rows with equal doc_id are taken in the order of their texts; rows without doc_id come first,
and the last document is followed by the first that has one; a table of one document has itself as the next;
an empty table gives no rows; other columns are ignored.

The next document is found without a global sort: doc_ids are cut into ranges at approximate quantiles, each range goes
to one task, and the first row of every range is sent to the range before it as well. Texts cross the network once.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import NamedTuple
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch_of, documents, slices, text_or_empty

SECTION_EVERY = 8
SHORT_LINE = 16
LONG_WORD = 32
LONG_RUN = 16
NODE = 16  # bytes
WORD = re.compile(r"\s*\S+\s*|\s+")


class Paragraph(NamedTuple):
    node: bytes
    phrases: tuple[int, ...]


class Section(NamedTuple):
    node: bytes
    paragraphs: list[Paragraph]


class Tree(NamedTuple):
    root: bytes
    sections: list[Section]

    def phrases(self) -> int:
        return sum(len(p.phrases) for s in self.sections for p in s.paragraphs)

    def spelt(self) -> str:
        spell = lambda p: p.node.hex() + "".join([f"{x:08x}" for x in p.phrases])
        return self.root.hex() + ":" + "/".join([",".join([spell(p) for p in s.paragraphs]) for s in self.sections])


def node(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=NODE).digest()


def phrases(line: str) -> tuple[int, ...]:
    """Phrase codes of a paragraph: of each word if it has few, else of runs that end at every fourth word or so.

    Runs hold LONG_RUN words at most: words that repeat without an end of a run among them would else be one phrase.
    """
    words: list[bytes] = []
    for w in WORD.findall(line):
        words += [w.encode("utf-8", "surrogatepass")] if len(w) <= LONG_WORD else [w[i : i + 16].encode("utf-8", "surrogatepass") for i in range(0, len(w), 16)]
    if len(words) <= SHORT_LINE:
        return tuple(map(crc32, words))
    out, run, held = [], 0, 0
    for w in words:
        run = crc32(w, run)  # over the words of the run
        held += 1
        if held == LONG_RUN or not crc32(w) & 3:
            out.append(run)
            run = held = 0
    if held:
        out.append(run)
    return tuple(out)


class Printer:
    """Trees of texts that follow each other; paragraphs seen lately are not hashed again."""

    def __init__(self, keep: int = 4096):
        self.keep = keep
        self.seen: dict[str, tuple[Paragraph, bool]] = {}

    def paragraph(self, line: str) -> tuple[Paragraph, bool]:
        """The paragraph, and whether a section ends with it."""
        if line not in self.seen:
            if len(self.seen) >= self.keep:
                self.seen.clear()
            top = node(line.encode("utf-8", "surrogatepass"))
            blank = not line or line.isspace()
            self.seen[line] = Paragraph(top, () if not line else phrases(line)), blank or top[0] % SECTION_EVERY == 0
        return self.seen[line]

    def tree(self, text: str) -> Tree:
        sections, own = [], []
        for line in text.split("\n"):
            p, ends = self.paragraph(line)
            own.append(p)
            if ends:
                sections.append(own)
                own = []
        if own:
            sections.append(own)
        done = [Section(node(b"".join([p.node for p in s])), s) for s in sections]
        return Tree(node(b"".join([s.node for s in done])), done)


def fingerprint(text: str) -> str:
    return Printer().tree(text).spelt()


def parse(print_: str) -> Tree:
    """The tree that a fingerprint spells. The nodes of sections follow from those of paragraphs."""
    root, _, body = print_.partition(":")

    def paragraph(p: str) -> Paragraph:
        return Paragraph(bytes.fromhex(p[: 2 * NODE]), tuple(int(p[i : i + 8], 16) for i in range(2 * NODE, len(p), 8)))

    sections = [[paragraph(p) for p in s.split(",")] for s in body.split("/")]
    return Tree(bytes.fromhex(root), [Section(node(b"".join(p.node for p in s)), s) for s in sections])


def _unlike(one: list, two: list) -> tuple[list, list, int]:
    """What is left of two lists of nodes without their common members (as multisets), and the phrases in those, of both."""
    left = Counter([x.node for x in two])
    same = Counter([x.node for x in one]) & left
    size = lambda x: len(x.phrases) if isinstance(x, Paragraph) else sum(len(p.phrases) for p in x.paragraphs)
    rest, shared = [], 0
    for side in (one, two):
        count, own = same.copy(), []
        for x in side:
            if count[x.node] > 0:
                count[x.node] -= 1
                shared += size(x)
            else:
                own.append(x)
        rest.append(own)
    return rest[0], rest[1], shared


def likeness(one: Tree, two: Tree) -> float:
    """Share of phrases in equal branches of two trees, 0 to 1."""
    if one.root == two.root:
        return 1.0
    total = one.phrases() + two.phrases()
    if not total:
        return 0.0
    a, b, shared = _unlike(one.sections, two.sections)
    a, b, more = _unlike([p for s in a for p in s.paragraphs], [p for s in b for p in s.paragraphs])
    x, y = [v for p in a for v in p.phrases], [v for p in b for v in p.phrases]
    plain = (Counter(x) & Counter(y)).total()
    follow = lambda v: Counter([i << 32 | j for i, j in zip([0, *v], v, strict=False)])
    kept = (follow(x) & follow(y)).total()
    return min((shared + more + plain + kept) / total, 1 - 1 / (total + 1))


class Edit(NamedTuple):
    """kind: insert, delete or replace; (section, paragraph, first phrase, phrase after the last) in either tree, None where it has nothing there."""

    kind: str
    one: tuple[int, int, int, int] | None
    two: tuple[int, int, int, int] | None


def edits(one: str, two: str) -> list[Edit]:
    """Where two fingerprints differ, descending into differing branches only. Empty exactly if roots are equal."""
    a, b = parse(one), parse(two)
    if a.root == b.root:
        return []
    m, n = [s.node for s in a.sections], [s.node for s in b.sections]
    head = next((k for k, (x, y) in enumerate(zip(m, n, strict=False)) if x != y), min(len(m), len(n)))
    tail = next((k for k, (x, y) in enumerate(zip(m[head:][::-1], n[head:][::-1], strict=False)) if x != y), min(len(m), len(n)) - head)
    flat = lambda t: [(i, j, p) for i, s in enumerate(t.sections[head : len(t.sections) - tail], head) for j, p in enumerate(s.paragraphs)]
    x, y = flat(a), flat(b)
    out: list[Edit] = []
    whole = lambda at: (at[0], at[1], 0, len(at[2].phrases))
    for kind, i0, i1, j0, j1 in SequenceMatcher(None, [p.node for *_, p in x], [p.node for *_, p in y], autojunk=False).get_opcodes():
        if kind == "equal":
            continue
        pairs = min(i1 - i0, j1 - j0)
        for k in range(pairs):
            (s, p, own), (t, q, other) = x[i0 + k], y[j0 + k]
            inside = SequenceMatcher(None, own.phrases, other.phrases, autojunk=False).get_opcodes()
            out += [Edit(how, (s, p, f0, f1) if f1 > f0 else None, (t, q, g0, g1) if g1 > g0 else None) for how, f0, f1, g0, g1 in inside if how != "equal"]
        out += [Edit("delete", whole(at), None) for at in x[i0 + pairs : i1]]
        out += [Edit("insert", None, whole(at)) for at in y[j0 + pairs : j1]]
    return out


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
OUT = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (f.split() for f in FIELDS.split(", "))])


def in_ranges(df: DataFrame, ranges: int) -> DataFrame:
    """df with `range` (an int that rises with doc_id) and `ahead` (true for a copy of the next range's first row)."""
    spark = df.sparkSession
    ids = df.select("doc_id")
    cuts = ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    cuts = sorted({int(c) for c in cuts})
    here = F.lit(0)
    if cuts:
        from pyspark.ml.feature import Bucketizer

        splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
        cut = lambda d: Bucketizer(splits=splits, inputCol="__at", outputCol="__range").transform(d.withColumn("__at", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))).drop("__at")
        df, ids = cut(df), cut(ids)
        here = F.coalesce(F.col("__range").cast("int"), F.lit(0))
    firsts = sorted((r.range, r.first) for r in ids.groupBy(here.alias("range")).agg(F.min("doc_id").alias("first")).where("first IS NOT NULL").collect())  # a row a range
    if not firsts:  # no rows, or none with a doc_id
        return df.select(F.lit(0).alias("range"), F.lit(False).alias("ahead"), "doc_id", "text")
    before = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]  # the last range is followed by the first row of all
    borders = spark.createDataFrame(before, "doc_id long, back int")
    own = df.select(here.alias("range"), "doc_id", "text")
    both = own.join(F.broadcast(borders), "doc_id", "left")  # as many rows as ranges
    to = F.when(F.col("back").isNull(), F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ahead")))).otherwise(
        F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ahead")), F.struct(F.col("back").alias("range"), F.lit(True).alias("ahead")))
    )
    return both.select(F.explode(to).alias("to"), "doc_id", "text").select("to.range", "to.ahead", "doc_id", "text")


def fingerprints(df: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likenesses."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one range after another; in each its own rows in order, then the copies of the next range's first row
        held = start = None
        closed = True
        printer = Printer()

        def row(one: tuple, two: tuple) -> tuple:
            doc, text, own = one
            new = edited(text, two[1])
            other = printer.tree(new)
            return doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.spelt(), other.spelt(), likeness(own, other), likeness(own, two[2])

        names = [f.split()[0] for f in FIELDS.split(", ")]
        for b in slices(batches):
            out = []
            for ahead, doc, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("ahead", "doc_id", "text")), strict=True):
                if ahead and closed:
                    continue
                now = (doc, text, printer.tree(text))
                if held is not None and not closed:
                    out.append(row(held, now))
                held, closed, start = now, ahead, start or now
            if out:
                yield batch_of(OUT, dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))
        if held is not None and not closed:  # only rows without doc_id: they follow each other in a ring
            yield batch_of(OUT, {n: [v] for n, v in zip(names, row(held, start), strict=True)})

    dealt = in_ranges(text_or_empty(df), ranges).repartitionByRange(ranges, "range").sortWithinPartitions("range", "ahead", "doc_id", "text")
    return dealt.mapInArrow(run, FIELDS)


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
