"""MinHash near-dedup with an LSH forest.

1. A document's set: the 64-bit hashes of its distinct five-word shingles (words after lower-casing A-Z; fewer words: the
   whole sequence). Documents with equal sets are one class; classes are numbered, and only one representative a class
   goes on, so exact copies cost one row each however many there are.
2. Forest: each tree is an order of the signature's minima, and sorts the signatures by it. A region is a run of a tree's
   sorted order whose members have a longest common prefix of `depth` minima or more; a depth has as many trees as keep the
   chance that a pair at the threshold meets in no tree under MISS. Regions that hold more than `most` are sorted by
   their trees' further minima, whatever their size (a range sort over many tasks), and cut where neighbours have the
   shortest common prefix into runs of at most `most`; that joins their bulk. What it misses is found in step 6.
3. In each region, signatures are compared and documents whose estimated similarity to any other is under a bound are left
   out; what is left falls into clusters. A cluster that several trees find is taken once. Clusters whose sets exceed
   CELL_BYTES are cut into blocks, and every two blocks meet in a cell of their own.
4. The full sets of each cluster's documents are brought together and compared exactly; what is reported is a spanning
   forest of the links, never all pairs.
5. Components by alternating minimum propagation and pointer jumping, a written table a round.
6. Then the regions that were too large are looked at again. One whose members are of one component is done. One with at
   most `most` members outside its largest component is gone through whole: each of these meets every other member in
   some cell (a block of the former beside a block of all), and so has no more to be compared with than in a region
   that fits. The members of all others go on to the next of DEPTHS, which parts texts that are less alike; from the
   last one, every region is gone through whole. From the second round on only pairs of different components are compared,
   and regions of one component are left out.

So a link at the threshold is lost with a probability of about MISS, in dense regions and elsewhere; a component only falls
apart if all its joining links are. A group of near copies costs rows in proportion to its size: one a tree at the first
depth, and one to four more a tree where it is gone through. Cost in proportion to the square of a region's size arises only
where more than `most` texts share the last depth's minima without being linked.

Defined cases: null or blank texts have empty sets, size 0, and are linked with nothing; repeated rows are answered once
a row; rows of equal doc_id and different texts are told apart by their texts, each answered for its own text; rows without
doc_id join the class of their text and name none; an empty table gives no rows; other columns are ignored; ties do not
occur (components are named by their smallest doc_id).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, forget, join_hot, scratch_dir, slices, sorted_groups, stash, text_or_empty

WORDS = 5
MINIMA = 128
DEPTHS = (3, 6, 12)
#: Chance that a pair at the threshold meets in no tree of a depth.
MISS = 1e-6
#: Bytes of shingle sets that one comparison holds (a pair of longer texts is compared all the same).
CELL_BYTES = 64 << 20


def trees_for(depth: int, percent: int) -> int:
    """Trees that keep the chance to miss a pair of similarity percent / 100 under MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** depth)))


class WordHashes(dict):
    """64-bit hashes of words, kept while there is room."""

    room = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.room:
            self[word] = value
        return value


_HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    if len(_HASHES) >= _HASHES.room:
        _HASHES.clear()
    h = np.array(list(map(_HASHES.__getitem__, found)), dtype=np.uint64)
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(h) if len(h) < words else words, dtype=np.uint64)
    for k in range(min(words, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


_A = np.random.default_rng(97).integers(1, 1 << 32, MINIMA, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(98).integers(0, 1 << 62, MINIMA, dtype=np.uint64)


def signature(values: np.ndarray) -> np.ndarray:
    """MINIMA 32-bit minima, in blocks so that a long text needs no more memory than a short one."""
    best = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(values), 2048):
            v = values[i : i + 2048]
            low = v & np.uint64(0xFFFFFFFF)
            np.minimum(best, ((low[None, :] * _A[:, None] + (v ^ (v >> np.uint64(29)))[None, :] * _B[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1), out=best)
    return best


def orders(trees: int) -> np.ndarray:
    """The order in which each tree reads the minima."""
    rng = np.random.default_rng(41)
    return np.array([rng.permutation(MINIMA) for _ in range(trees)])


def set_name(values: bytes) -> bytes | None:
    """128-bit digest of a set; none for the empty one."""
    return hashlib.blake2b(values, digest_size=16).digest() if values else None


def text_id(text: Column) -> Column:
    """Tells apart the texts of rows with equal doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sketches(df: DataFrame) -> DataFrame:
    """doc_id, text_id (64-bit hash of the text), n_shingles, set_id (128-bit digest of the set; null if empty), minima (binary; null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, ident, minima = [], [], []
            with np.errstate(over="ignore"):
                for text in b.column(1).to_pylist():
                    s = shingle_set(text)
                    n.append(len(s))
                    ident.append(set_name(s.tobytes()))
                    minima.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(ident, pa.binary()), pa.array(minima, pa.binary())], names=["doc_id", "text_id", "n_shingles", "set_id", "minima"])

    return text_or_empty(df).withColumn("text_id", text_id(F.col("text"))).mapInArrow(run, "doc_id long, text_id long, n_shingles long, set_id binary, minima binary")


def prefix_hashes(reps: DataFrame, depth: int, trees: int) -> DataFrame:
    """rep, tree, region: a hash of the first depth minima of each tree's order; and component, where reps have it."""
    order = orders(trees)[:, :depth]
    more = ["component"] if "component" in reps.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(-1, MINIMA).astype(np.uint64)
            rep = b.column(0).to_numpy()
            with np.errstate(over="ignore"):
                for t in range(len(order)):
                    h = np.full(len(m), t * 1_000_003 + depth, dtype=np.uint64)
                    for k in order[t]:
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, k])
                    yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.full(len(m), t, dtype=np.int32)), pa.array(h.view(np.int64)), *b.columns[2:]], names=["rep", "tree", "region", *more])

    return reps.select("rep", "minima", *more).mapInArrow(run, ", ".join(["rep long, tree int, region long", *(f"{c} long" for c in more)]))


def in_tree_order(large: DataFrame, reps: DataFrame, depth: int, trees: int, most: int, further: int = 16) -> DataFrame:
    """rep, region: each too large region sorted by its tree's further minima and cut into runs of at most `most`."""
    order = orders(trees)[:, depth : depth + further]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint32).reshape(-1, MINIMA)
                keys = np.take_along_axis(m, order[b.column(1).to_numpy()], axis=1).astype(">u4").tobytes()
                spelt = [keys[i : i + 4 * further] for i in range(0, len(keys), 4 * further)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(spelt, pa.binary())], names=["rep", "region", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for t in sorted_groups(batches, "region"):
            keys = np.frombuffer(b"".join(t.column("key").to_pylist()), dtype=">u4").reshape(-1, further)
            common = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(axis=1)  # longest common prefix of neighbours
            at, run = 0, np.zeros(len(keys), dtype=np.int64)
            while len(keys) - at > most:
                low = at + most // 2
                at = low + int(np.argmin(common[low - 1 : at + most - 1]))
                run[at:] += 1
            names = [hash((t.column("region")[0].as_py(), part, r)) for r in range(int(run[-1]) + 1)]
            yield pa.RecordBatch.from_arrays([t.column("rep").combine_chunks(), pa.array(np.array(names, dtype=np.int64)[run])], names=["rep", "region"])

    spelt = large.join(reps.select("rep", "minima"), "rep").select("rep", "tree", "region", "minima").mapInArrow(spell, "rep long, region long, key binary")
    return spelt.repartitionByRange("region", "key", "rep").sortWithinPartitions("region", "key", "rep").mapInArrow(cut, "rep long, region long")


def regions(open_: DataFrame, depth: int, percent: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """rep, region (and component, where given): regions of 2 to `most` at a depth, and the runs of those that hold more; and rep, region of the latter, if any.

    Where representatives have a component, regions of one component are left out.
    """
    trees = trees_for(depth, percent)
    more = ["component"] if "component" in open_.columns else []
    keyed = prefix_hashes(open_, depth, trees)
    sizes = keyed.groupBy("region").agg(F.count("*").alias("n"), *(f(c).alias(f.__name__) for c in more for f in (F.min, F.max))).where("n > 1")
    if more:
        sizes = sizes.where("min < max").select("region", "n")
    placed = stash(keyed.join(sizes, "region").select("rep", "tree", "region", "n", *more), f"regions-{depth}")
    fit = placed.where(F.col("n") <= most).select("rep", "region", *more)
    large = placed.where(F.col("n") > most)
    if large.isEmpty():
        return fit, None
    runs = in_tree_order(large, open_, depth, trees, most)
    if more:
        runs = runs.join(open_.select("rep", *more), "rep").select("rep", "region", *more)
    return fit.unionByName(runs), large.select("rep", "region")


def unsettled(large: DataFrame, joined: DataFrame, reps: DataFrame, most: int, last: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """Of regions that were too large: cells of those to be gone through whole, if any (rep, region, component), and the representatives, with their components, of the others, if any."""
    named = joined.select(F.col("node").alias("rep"), "component")
    placed = stash(large.join(named, "rep", "left").select("rep", "region", F.coalesce("component", "rep").alias("component")), "crossed")
    sizes = placed.groupBy("region", "component").agg(F.count("*").alias("n"))
    plan = sizes.groupBy("region").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"))
    plan = plan.select("region", F.col("top.component").alias("top"), F.col("n"), (F.col("n") - F.col("top.n")).alias("rest")).where("rest > 0")
    plan = stash(plan, "unsettled")
    whole, deeper = (plan, None) if last else (plan.where(F.col("rest") <= most), plan.where(F.col("rest") > most))
    if deeper is not None:
        deeper = None if deeper.isEmpty() else stash(reps.join(placed.join(deeper, "region", "left_semi").select("rep", "component").distinct(), "rep"), "dense")
    return None if whole.isEmpty() else crossings(placed, whole, most), deeper


def crossings(placed: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """rep, region, component: cells of at most about `most` members in which all pairs of different components of a region meet."""
    block = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(most / 2))).cast("int")
    at = placed.join(plan.select("region", "top", block(F.col("n")).alias("all"), block(F.col("rest")).alias("few")), "region")
    own = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks).cast("long")).cast("int")
    here = at.select("rep", "region", "component", F.posexplode(F.sequence(F.lit(1), F.col("few"))).alias("i", "_"), own("all").alias("j"))
    rest = at.where(F.col("component") != F.col("top"))
    there = rest.select("rep", "region", "component", own("few").alias("i"), F.posexplode(F.sequence(F.lit(1), F.col("all"))).alias("j", "_"))
    cells = here.select("rep", "region", "component", "i", "j").unionByName(there.select("rep", "region", "component", "i", "j"))
    return cells.select("rep", F.xxhash64("region", "i", "j").alias("region"), "component").distinct()


def groups_of(linked: np.ndarray) -> np.ndarray:
    """Component number of each index of a symmetric boolean matrix."""
    n = len(linked)
    comp = np.full(n, -1)
    for i in range(n):
        if comp[i] < 0:
            comp[i] = i
            todo = np.array([i])
            while len(todo):
                todo = np.flatnonzero(linked[todo].any(axis=0) & (comp < 0))
                comp[todo] = i
    return comp


def estimates(m: np.ndarray) -> np.ndarray:
    """Equal minima of each pair of signatures, a block of rows at a time."""
    out = np.zeros((len(m), len(m)), dtype=np.int16)
    for i in range(0, len(m), 64):
        part = out[i : i + 64]
        for k in range(m.shape[1]):
            part += m[i : i + 64, k, None] == m[None, :, k]
    return out


def cells(own: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """A cluster's members as they are compared: all together, or every two blocks of them where their sets are too large for that."""
    block = (np.cumsum(size) * 16 // CELL_BYTES).astype(np.int64)  # eight bytes a shingle, two blocks a cell
    if block[-1] < 2:
        yield own
        return
    parts = [own[block == k] for k in np.unique(block)]
    for i, one in enumerate(parts):
        for two in parts[i + 1 :]:
            yield np.concatenate([one, two])


def clusters(members: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """cluster, rep: groups within a region that estimates join; the same group from several trees has the same name.

    Where members have a component, only pairs of different components are joined.
    """
    crossing = "component" in members.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids = [], []
        for t in sorted_groups(batches, "region"):
            if t.num_rows < 2:
                continue
            rep, size = t.column("rep").to_numpy(), t.column("n_shingles").to_numpy()
            m = np.frombuffer(b"".join(t.column("minima").to_pylist()), dtype=np.uint32).reshape(-1, MINIMA)
            if len(m) == 2:
                near = np.full((2, 2), (m[0] == m[1]).sum() >= least * MINIMA)
            else:
                near = estimates(m) >= least * MINIMA
            if crossing:
                c = t.column("component").to_numpy()
                near &= c[:, None] != c[None, :]
            comp = groups_of(near)
            for c in np.unique(comp):
                own = np.flatnonzero(comp == c)
                own = own[np.argsort(rep[own])]
                for cell in cells(own, size[own]) if len(own) > 1 else ():
                    who = rep[cell]
                    name = int.from_bytes(hashlib.blake2b(who.tobytes(), digest_size=8).digest(), "little", signed=True)
                    names += [name] * len(who)
                    ids += who.tolist()
            if len(ids) > 20_000:
                yield pa.RecordBatch.from_pydict({"cluster": names, "rep": ids})
                names, ids = [], []
        if ids:
            yield pa.RecordBatch.from_pydict({"cluster": names, "rep": ids})

    joined = members.join(reps.select("rep", "n_shingles", "minima"), "rep")
    found = joined.repartition("region").sortWithinPartitions("region").mapInArrow(run, "cluster long, rep long")
    return stash(found.distinct(), "clusters")


def shingle_sets(df: DataFrame) -> DataFrame:
    """set_id and the set, as bytes, of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in slices(batches):
                sets = [shingle_set(t).tobytes() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["set_id", "values"])

    return df.mapInArrow(run, "set_id binary, values binary")


def exact_links(sets: list[np.ndarray], percent: int, width: int = 4096) -> list[tuple[int, int]]:
    """Spanning forest of the pairs with 100 * intersection >= percent * union."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (size.sum() - both) else []
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, at, count = np.unique(values, return_inverse=True, return_counts=True)
    keep = count[at] > 1  # a shingle of one document is in no intersection
    at, owner = at[keep], owner[keep]
    both = np.zeros((n, n), dtype=np.float32)  # counts under 2**24 are exact
    if len(at):
        order = np.argsort(at, kind="stable")
        _, at = np.unique(at[order], return_inverse=True)
        owner = owner[order]
        for lo in range(0, int(at[-1]) + 1, width):
            a, b = np.searchsorted(at, [lo, lo + width])
            block = np.zeros((n, width), dtype=np.float32)
            block[owner[a:b], at[a:b] - lo] = 1
            both += block @ block.T
    union = size[:, None] + size[None, :] - both
    linked = 100 * both >= percent * union
    np.fill_diagonal(linked, False)
    out, seen = [], np.zeros(n, dtype=bool)
    for i in range(n):
        if not seen[i]:
            seen[i] = True
            todo = [i]
            while todo:
                k = todo.pop()
                new = np.flatnonzero(linked[k] & ~seen)
                seen[new] = True
                out += [(k, int(j)) for j in new]
                todo += new.tolist()
    return out


def confirmed(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: verified links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in sorted_groups(batches, "cluster"):
            rep = t.column("rep").to_numpy()
            sets_ = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in t.column("values")]
            for i, j in exact_links(sets_, percent):
                a.append(int(rep[i]))
                b.append(int(rep[j]))
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    joined = found.join(sets, "rep").select("cluster", "rep", "values")
    links = joined.repartition("cluster").sortWithinPartitions("cluster", "rep").mapInArrow(run, "a long, b long")
    return stash(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """node, component: smallest node that links reach, for every node of a link."""
    both = stash(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both-ways")
    label = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        around = both.join(label.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component")
        low = around.unionByName(label).groupBy("node").agg(F.min("component").alias("component"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = low.join(jump, "component").select("node", F.least("component", "further").alias("component"))
        new = stash(new, "labels")
        changed = new.join(label.withColumnRenamed("component", "old"), "node").where("component != old")
        over = changed.isEmpty()
        forget(label)
        if over:
            forget(both)
            return new
        label = new


def links_within(docs: DataFrame, classes: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """a, b: verified links of the clusters found."""
    wanted = stash(classes.join(found.select("rep").distinct(), "rep").select("rep", "set_id", "first"), "wanted")
    # grows with the input: never broadcast, the same plan at every size
    own = docs.join(wanted.select(F.col("first").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    sets = shingle_sets(own).join(wanted.select("rep", "set_id"), "set_id").dropDuplicates(["rep"]).select("rep", "values")
    sets = stash(sets, "sets", "none")
    links = confirmed(found, sets, percent)
    forget(sets, wanted)
    return links


def near_dedup(df: DataFrame, percent: int = 85, most: int = 1024, least: float | None = None) -> DataFrame:
    """One row per input row: doc_id, text_id, n_shingles, component_id, kept.

    least: estimated similarity under which a pair is not compared; with 128 minima, the default of 0.15 under the
    threshold is 4.2 (at 80 percent) to 4.8 (at 85 percent) standard deviations.
    """
    spark = df.sparkSession
    scratch_dir(spark)
    least = percent / 100 - 0.15 if least is None else least
    docs = text_or_empty(df)
    sketch = stash(sketches(docs), "sketches")
    full = sketch.where(F.col("set_id").isNotNull())
    classes = full.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.first("n_shingles").alias("n_shingles"))
    classes = stash(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # written once: numbers stay
    firsts = classes.select("set_id", "rep", F.col("first").alias("doc_id"))
    reps = full.join(firsts, ["set_id", "doc_id"]).select("rep", "n_shingles", "minima").dropDuplicates(["rep"])
    reps = stash(reps, "reps")
    open_, crossed, links = reps, None, None
    for depth in (*DEPTHS, None):  # after the last depth, only cells are left
        members, large = regions(open_, depth, percent, most) if open_ is not None else (None, None)
        if crossed is not None:
            members = crossed if members is None else members.unionByName(crossed)
        if members is None:
            break
        found = clusters(members, reps, least)
        if links is None:
            links = links_within(docs, classes, found, percent)
            joined = components(links)
        elif not found.isEmpty():
            more = links_within(docs, classes, found, percent)
            if not more.isEmpty():
                old = joined, links, more
                links = stash(links.unionByName(more).distinct(), "links")
                joined = components(links)
                forget(*old)
        forget(found)
        crossed, open_ = (None, None) if large is None else unsettled(large, joined, reps, most, depth == DEPTHS[-1])
    named = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", "first", "rows", F.coalesce("component", "rep").alias("component"))
    named = stash(named, "named")
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    answers = stash(named.join(names, "component").select("set_id", "rows", "component_id"), "answers")
    forget(links, reps, classes, joined, named)
    alone = sketch.where(F.col("set_id").isNull()).select("doc_id", "text_id", "n_shingles", F.col("doc_id").alias("component_id"))
    answered = join_hot(full.select("doc_id", "text_id", "n_shingles", "set_id"), answers, ["set_id"], "rows", full.count()).select("doc_id", "text_id", "n_shingles", "component_id")
    return answered.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir)).drop("text_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS node, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
),
s AS (
  SELECT node, doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w
),
c AS (SELECT min(node) AS class, min(doc_id) AS first, shingles, len(shingles) AS n FROM (SELECT node, doc_id, list_sort(shingles) AS shingles FROM s) WHERE len(shingles) > 0 GROUP BY shingles),
e AS MATERIALIZED (SELECT class, n, hash(unnest(shingles)) AS h FROM c),
links AS MATERIALIZED (
  SELECT a.class AS a, b.class AS b FROM e a JOIN e b ON a.h = b.h AND a.class <> b.class AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
r(a, b) AS (SELECT class, class FROM c UNION SELECT r.a, links.b FROM r JOIN links ON links.a = r.b),
named AS (SELECT r.a AS class, min(c.first) AS component_id FROM r JOIN c ON c.class = r.b GROUP BY 1),
cls AS (SELECT shingles, class FROM c)
SELECT s.doc_id, len(s.shingles) AS n_shingles, coalesce(named.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(named.component_id, s.doc_id) AS kept
FROM s LEFT JOIN cls ON cls.shingles = list_sort(s.shingles) LEFT JOIN named ON named.class = cls.class
"""
