"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

Documents are encoded where they lie; only those longer than a sequence are cut. Pieces are dealt by hash into districts
of about district_rows pieces, and each district is packed by several islands. An individual is a grouping of the
district's pieces into bins. Crossover takes the best-filled bins of a second parent whole, removes from the first
parent every bin that shares a piece with them, and puts the pieces so displaced back: a piece of a bin is exchanged for a
longer displaced one that fills it better, and what is left is best-fitted, longest first; mutation
dissolves the worst-filled bins and a few others and puts their pieces back alike. An individual is better if it has fewer bins
and, among equals, if its free room lies in fewer of them. Every island runs all its generations unless its best bins are all
full but one; after each epoch its elite moves to the next island of its district.

Of a district's winner the emptiest bins are dissolved, as many as it takes to leave little free room in the others (SLACK of
a sequence each on average) but with half of its pieces at most; their pieces go on to fewer districts until one is
left. So the waste at district borders vanishes, a level has at most half the pieces of the one before, and the more the
search gathers the free room in a few bins, the fewer pieces go on.

Defined cases: null text is empty (just the end id); repeated rows are packed each on their own; an empty table gives
no rows; other columns are ignored. Ties are broken by piece order, so results repeat.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import CachedEncoder, batch_of, default_vocabulary, documents, forget, slices, sorted_groups, stash, text_or_empty

Bins = list[list[int]]

PIECE = pa.schema([(n, pa.int64()) for n in ("row", "doc_id", "piece", "start", "length", "ids_crc32")])
GENE = pa.schema([(n, pa.int64()) for n in ("district", "island", "individual", "key", "length", "bin", "stays")])
#: Free room, as a share of a sequence, that the bins which stay may have on average.
SLACK = 0.0005


def pieces_of(df: DataFrame, vocabulary: Callable[[], str], end_id: int, capacity: int) -> DataFrame:
    """key, doc_id, piece, start, length, ids_crc32 of every piece; key is unique to the piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CachedEncoder.of(vocabulary())
        for b in slices(batches):
            out: list[list[int]] = [[] for _ in PIECE]
            for row, (doc, raw) in enumerate(zip(b.column(0).to_pylist(), encoder.encode_all(b.column(1).to_pylist()), strict=True)):
                ids = raw + end_id.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for col, v in zip(out, (row, doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            yield batch_of(PIECE, dict(zip(PIECE.names, out, strict=True)))

    cut_up = text_or_empty(df).mapInArrow(cut, "row long, doc_id long, piece long, start long, length long, ids_crc32 long")
    return stash(cut_up.withColumn("key", F.monotonically_increasing_id()).drop("row"), "pieces")


class Levels:
    """Open bins by free room: best fit in a few machine operations, whatever the number of bins."""

    def __init__(self, capacity: int):
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0

    def put(self, room: int, which: int) -> None:
        self.at[room].append(which)
        self.some |= 1 << room

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of the fullest bin that has the room."""
        left = self.some >> need
        if not left:
            return None
        room = need + (left & -left).bit_length() - 1
        which = self.at[room].pop()
        if not self.at[room]:
            self.some &= ~(1 << room)
        return room, which


def best_fit(bins: Bins, items: list[int], length: list[int], capacity: int) -> Bins:
    """Puts items, longest first, into the fullest bin that takes them, or a new one."""
    levels = Levels(capacity)
    for k, b in enumerate(bins):
        if room := capacity - sum(map(length.__getitem__, b)):
            levels.put(room, k)
    for i in sorted(items, key=lambda i: (-length[i], i)):
        if got := levels.take(length[i]):
            room, k = got
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if room > length[i]:
            levels.put(room - length[i], k)
    return bins


def exchange(bins: Bins, items: list[int], length: list[int], capacity: int) -> list[int]:
    """Fills the room of bins by exchanging a piece for a longer one of the items that just fits best; returns the items left."""
    rest = sorted((length[i], i) for i in items)
    for b in bins:
        room = capacity - sum(map(length.__getitem__, b))
        if not room or not rest:
            continue
        best, at = 0, None
        for k, i in enumerate(b):
            j = bisect_right(rest, (length[i] + room, len(length))) - 1
            if j >= 0 and rest[j][0] - length[i] > best:
                best, at = rest[j][0] - length[i], (k, j)
        if at:
            k, j = at
            out, b[k] = b[k], rest.pop(j)[1]
            insort(rest, (length[out], out))
    return [i for _, i in rest]


def refill(bins: Bins, items: list[int], length: list[int], capacity: int) -> Bins:
    """Displaced pieces go back: by exchange first, then by best fit."""
    return best_fit(bins, exchange(bins, items, length, capacity), length, capacity)


def fitness(bins: Bins, length: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then fuller bins beside emptier ones rather than all alike."""
    return -len(bins), sum((sum(map(length.__getitem__, b)) / capacity) ** 2 for b in bins)


def crossover(one: Bins, two: Bins, length: list[int], capacity: int, rng: np.random.Generator, share: float = 0.05) -> Bins:
    """Injects some of the best-filled bins of `two` whole; what they displace in `one` is best-fitted again."""
    fill = [sum(map(length.__getitem__, b)) for b in two]
    good = sorted(range(len(two)), key=lambda k: (-fill[k], k))[: max(1, len(two) // 2)]
    chosen = [two[k] for k in sorted(rng.choice(good, max(1, int(len(two) * share)), replace=False).tolist())] if len(two) * share > 1 else [two[good[0]]]
    injected = {i for b in chosen for i in b}
    kept, displaced = [], []
    for b in one:
        if injected.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in injected]
    return refill([list(b) for b in chosen] + kept, displaced, length, capacity)


def mutate(bins: Bins, length: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Dissolves the worst-filled bins and a few others."""
    fill = [sum(map(length.__getitem__, b)) for b in bins]
    out = set(sorted(range(len(bins)), key=lambda k: (fill[k], k))[: max(1, len(bins) // 50)]) | set(rng.integers(0, len(bins), max(1, len(bins) // 50)).tolist())
    return refill([list(b) for k, b in enumerate(bins) if k not in out], [i for k in sorted(out) for i in bins[k]], length, capacity)


def perfect(bins: Bins, length: list[int], capacity: int) -> bool:
    """All bins are full but one at most: no packing is better."""
    return sum(sum(map(length.__getitem__, b)) < capacity for b in bins) <= 1


def evolve(population: list[Bins], length: list[int], capacity: int, generations: int, rng: np.random.Generator) -> list[Bins]:
    """Best first."""
    ranked = sorted(((fitness(b, length, capacity), b) for b in population), key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if perfect(ranked[0][1], length, capacity):
            break
        a, b = rng.choice(len(ranked), 2, replace=len(ranked) < 2).tolist()
        child = mutate(crossover(ranked[min(a, b)][1], ranked[max(a, b)][1], length, capacity, rng), length, capacity, rng)
        ranked = sorted([*ranked, (fitness(child, length, capacity), child)], key=lambda x: x[0], reverse=True)[: len(population)]
    return [b for _, b in ranked]


def staying(bins: Bins, length: list[int], capacity: int) -> list[bool]:
    """Which bins stay when the emptiest ones go on to another district."""
    fill = [sum(map(length.__getitem__, b)) for b in bins]
    out, free, pieces = [True] * len(bins), sum(capacity - f for f in fill), 0
    left = len(bins)
    for k in sorted(range(len(bins)), key=lambda k: (fill[k], k)):
        pieces += len(bins[k])
        if free <= SLACK * capacity * left or 2 * pieces > len(length):
            break
        out[k] = False
        free, left = free - (capacity - fill[k]), left - 1
    return out


def first_population(length: list[int], capacity: int, size: int, rng: np.random.Generator) -> list[Bins]:
    """One best-fit-decreasing packing and others from orders that are shuffled a little."""
    n = len(length)
    out = [best_fit([], list(range(n)), length, capacity)]
    for _ in range(size - 1):
        some = rng.random(n) < 0.3
        bins = best_fit([], np.flatnonzero(~some).tolist(), length, capacity)
        out.append(best_fit(bins, np.flatnonzero(some).tolist(), length, capacity))
    return out


def epoch(genes: DataFrame, capacity: int, population: int, generations: int, seed: int, number: int) -> DataFrame:
    """One epoch on every island; returns each island's elite. genes: pieces with bin -1, and migrants with their bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, "group"):
            district, island = t.column("district")[0].as_py(), t.column("island")[0].as_py()
            a = {c: t.column(c).to_numpy() for c in ("individual", "key", "length", "bin")}
            keys, first = np.unique(a["key"], return_index=True)
            length = a["length"][first].tolist()
            rng = np.random.default_rng([seed, number, district, island])
            own: list[Bins] = []
            for who in np.unique(a["individual"][a["bin"] >= 0]):
                m = a["individual"] == who
                at, which = np.searchsorted(keys, a["key"][m]), a["bin"][m]
                bins: Bins = [[] for _ in range(int(which.max()) + 1)]
                for i, k in zip(at.tolist(), which.tolist(), strict=True):
                    bins[k].append(i)
                own.append(bins)
            if len(own) < population:
                own += first_population(length, capacity, population - len(own), rng)
            best = evolve(own, length, capacity, generations, rng)[0]
            which, stays = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64)
            for k, (b, s) in enumerate(zip(best, staying(best, length, capacity), strict=True)):
                which[b], stays[b] = k, s
            n = len(keys)
            yield batch_of(GENE, {"district": np.full(n, district), "island": np.full(n, island), "individual": np.full(n, island), "key": keys, "length": np.array(length, dtype=np.int64), "bin": which, "stays": stays})

    grouped = genes.withColumn("group", F.xxhash64("district", "island"))
    dealt = grouped.repartition("group").sortWithinPartitions("group", "individual", "key")
    return stash(dealt.mapInArrow(run, ", ".join(f"{n} long" for n in GENE.names)), "elite")


def winners(elite: DataFrame) -> DataFrame:
    """The genes of each district's best island: fewest bins, then fewest pieces that go on."""
    bins = elite.groupBy("district", "island").agg((F.max("bin") + 1).alias("bins"), F.sum(1 - F.col("stays")).alias("on"))
    best = bins.groupBy("district").agg(F.min(F.struct("bins", "on", "island")).alias("b")).select("district", F.col("b.island").alias("island"))
    return elite.join(best, ["district", "island"])


def pack(pieces: DataFrame, capacity: int = 4096, islands: int = 2, epochs: int = 2, population: int = 3, generations: int = 4, district_rows: int = 2048, seed: int = 7) -> DataFrame:
    """key, sequence_id, offset. pieces: key, length."""
    spark = pieces.sparkSession
    rest, n, level = pieces.select("key", "length"), pieces.count(), 0
    done: list[DataFrame] = []
    zero = F.lit(-1).cast("long")
    while n:
        districts = max(1, -(-n // district_rows))
        one = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(districts)).cast("long").alias("district")
        base = rest.select(one, "key", "length").withColumn("island", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(islands - 1).cast("long"))))
        elite = epoch(base.select("district", "island", zero.alias("individual"), "key", "length", zero.alias("bin"), zero.alias("stays")), capacity, population, generations, seed, level * 100)
        for e in range(1, epochs):
            moved = elite.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))
            before, elite = elite, epoch(elite.unionByName(moved), capacity, population, generations, seed, level * 100 + e)
            forget(before)
        stays = F.lit(True) if districts == 1 else F.col("stays") == 1
        won = stash(winners(elite).select("key", "length", "district", "bin", stays.alias("stays"), F.lit(level).alias("level")), "packed")
        forget(elite)
        done.append(won.where("stays"))
        rest, left = won.where("not stays").select("key", "length"), won.where("not stays").count()
        n, level = left, level + 1
    if not done:
        return spark.createDataFrame([], "key long, sequence_id long, offset long")
    packed = done[0]
    for d in done[1:]:
        packed = packed.unionByName(d)
    # levels at least halve, so there are far fewer than 128; a district has far fewer than 2**24 bins
    bits = F.shiftleft(F.col("level").cast("long"), 56) + F.shiftleft(F.col("district"), 24) + F.col("bin")
    placed = packed.select("key", "length", bits.alias("sequence_id"))
    before = Window.partitionBy("sequence_id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("key", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def pack_documents(df: DataFrame, vocabulary: Callable[[], str] | None = None, end_id: int = 1, capacity: int = 4096, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = pieces_of(df, vocabulary or default_vocabulary("word_bpe_49k.json"), end_id, capacity)
    placed = pack(pieces, capacity, **options)
    return pieces.join(placed, "key").select("doc_id", F.col("piece").cast(T.IntegerType()).alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
