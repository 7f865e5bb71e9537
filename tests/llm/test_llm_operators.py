"""The ten operators and the pipeline: edge cases, brute force, exact round trips, held-out accuracy."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, language_id, lm_score, merkle, near_dedup, packing, quality, sharding, token_files, viterbi
from tidemark.llm.common import CachedEncoder, scratch_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, norm string, shard int, score double, range int, component_id long, file string"
PLAIN = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again today"


def messy_rows():
    texts = {0: None, 1: "", 2: "   \n\t ", 3: PLAIN, 4: PLAIN.upper(), 5: PLAIN, 6: "one two", 7: "é 日本語 🙂 ▁x\n\n1234 <|endoftext|> !!", 8: "word " * 9000, 9: "7 7 7 7", 10: "ab" * 3000}
    rows = [(i, t, "en" if i % 3 else None, None if i == 4 else "src0", None if t is None else len(t), 1, "n", 2, 0.5, 3, 4, "f") for i, t in texts.items()]
    return [*rows, rows[3], rows[0]]  # repeated rows


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def vocabulary(name):
    import public_tokenizers

    return lambda: public_tokenizers.path(name)


# 1 Merkle
def slow_root(text):
    """The root, straight from its definition."""
    h = lambda b: hashlib.blake2b(b, digest_size=16).digest()
    sections, own = [], b""
    for line in text.split("\n"):
        own += h(line.encode())
        if not line.strip() or h(line.encode())[0] % merkle.SECTION_EVERY == 0:
            sections.append(h(own))
            own = b""
    return h(b"".join(sections) + (h(own) if own else b"")).hex()


def brute_merkle(rows):
    rows = sorted((i, t or "") for i, t in rows)
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), slow_root(t), slow_root(e)))
    return sorted(out)


def roots(r):
    return r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint.partition(":")[0], r.edited_fingerprint.partition(":")[0]


@pytest.mark.parametrize("ranges", [1, 5])
def test_merkle_messy(messy, empty, ranges):
    got = merkle.fingerprints(messy, ranges).collect()
    want = brute_merkle([r[:2] for r in messy_rows()])
    assert sorted(map(roots, got)) == want
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert merkle.fingerprints(empty, ranges).count() == 0


def test_merkle_documents(docs, texts):
    got = merkle.fingerprints(docs, 7).collect()
    assert sorted(map(roots, got)) == brute_merkle(texts.items())
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.95
    for r in got[:20]:
        assert merkle.parse(r.fingerprint) == merkle.Printer().tree(texts[r.doc_id])
        assert r.near_edited == merkle.likeness(merkle.parse(r.fingerprint), merkle.parse(r.edited_fingerprint))
    print_of = {}
    for r in got:
        assert print_of.setdefault(r.fingerprint, texts[r.doc_id]) == texts[r.doc_id]


def line_of(print_, at):
    """Number of the line that a place in a tree names."""
    return sum(len(s.paragraphs) for s in merkle.parse(print_).sections[: at[0]]) + at[1]


def test_merkle_locates_edits():
    lines = [f"line {k} has some words that are its own and {k * k} more of them" for k in range(60)]
    other = lines.copy()
    other[30] = other[30].replace("words", "swords")
    one, two = merkle.fingerprint("\n".join(lines)), merkle.fingerprint("\n".join(other))
    (e,) = merkle.edits(one, two)
    assert e.kind == "replace" and line_of(one, e.one) == line_of(two, e.two) == 30 and e.one[2:] == (4, 5)
    near = lambda a, b: merkle.likeness(merkle.parse(a), merkle.parse(b))
    assert 0.95 < near(one, two) < 1 and near(one, one) == 1.0 and merkle.edits(one, one) == []
    cut = merkle.fingerprint("\n".join(lines[:20] + lines[25:]))
    assert [(e.kind, line_of(one, e.one)) for e in merkle.edits(one, cut)] == [("delete", k) for k in range(20, 25)]
    assert [(e.kind, line_of(one, e.two)) for e in merkle.edits(cut, one)] == [("insert", k) for k in range(20, 25)]


@pytest.mark.parametrize("a, b", [("a b c d", "a b c"), ("x y z", "z y x"), ("a  b c", "a b c"), ("p one\nq two", "q two\np one"), ("a a b", "a b"), ("t\n", "t"), ("", " "), ("x\n\ny", "x\ny")])
def test_merkle_sees_every_difference(a, b):
    one, two = merkle.fingerprint(a), merkle.fingerprint(b)
    assert one != two and merkle.edits(one, two) and merkle.edits(two, one)
    assert merkle.likeness(merkle.parse(one), merkle.parse(two)) < 1


# 2 sharding
def check_shards(rows, n):
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and (not n or max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1)
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


@pytest.mark.parametrize("word", ["a", "word ", "a b ", "日本語"])
def test_merkle_of_repeated_words(word):
    """The kept half is seen, though it has fewer phrases than the other half, whose runs end more often."""
    text = word * 6000
    half = merkle.parse(merkle.fingerprint(text[: len(text) // 2] + "".join(chr(97 + k * k % 23) for k in range(len(text) // 2))))
    assert 0.1 < merkle.likeness(merkle.parse(merkle.fingerprint(text)), half) < 0.9


def test_sharding(messy, empty, docs, texts):
    got = sharding.shard_documents(docs, block_rows=5).collect()
    check_shards(got, len(texts))
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert [r.slot for r in sorted(got, key=lambda r: r.doc_id)] == [r.slot for r in sorted(sharding.shard_documents(docs, block_rows=5).collect(), key=lambda r: r.doc_id)]
    check_shards(sharding.shard_documents(messy).collect(), 13)
    assert sharding.shard_documents(empty).count() == 0
    assert {"shard", "slot", "file"} <= set(sharding.shuffle_into_shards(messy).columns)


def test_sharding_moves_whole_documents(messy, docs, texts, monkeypatch):
    moved, plans = [], []
    shuffle, plan = sharding.shuffle_into_shards, sharding.block_plan
    monkeypatch.setattr(sharding, "shuffle_into_shards", lambda df, *a, **b: moved.append(df.columns) or shuffle(df, *a, **b))
    monkeypatch.setattr(sharding, "block_plan", lambda *a: plans.append(plan(*a)) or plans[-1])
    mean = sum(len(t.encode()) for t in texts.values()) / len(texts)
    got = sharding.shard_documents(docs, block_bytes=int(3 * mean)).collect()
    check_shards(got, len(texts))
    assert moved[-1] == docs.columns and plans[-1][0].max() <= 3
    rows = sharding.shuffle_into_shards(messy, block_bytes=1).collect()
    check_shards(rows, 13)
    plain = lambda r: tuple(str(r[c]) for c in messy.columns if c != "shard")
    assert Counter(map(plain, rows)) == Counter(map(plain, messy.collect()))


def test_sharding_with_names_of_its_own(messy):
    clash = messy.withColumns({"__block": F.lit(1), "__FROM": F.lit("x"), "___at": F.lit(2)})
    got = sharding.shuffle_into_shards(clash, 4)
    assert got.columns == [*(c for c in clash.columns if c != "shard"), "shard", "slot"]
    assert {(r["__block"], r["__FROM"], r["___at"]) for r in got.collect()} == {(1, "x", 2)} and got.count() == 13
    own = sorted((r.shard, r.slot) for r in got.collect())
    assert [slot for s in range(4) for shard, slot in own if shard == s] == [k for s in range(4) for k in range(13 // 4 + (s < 13 % 4))]


def test_communication_matrix():
    sizes, blocks = [5, 0, 40, 7], np.array([13, 13, 13, 13])
    m = np.array([sharding.matrix_row(sizes, blocks, k, 3) for k in range(4)])
    assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).tolist() == blocks.tolist()
    big = sharding.draw(np.random.default_rng(1), np.array([3 * 10**9, 10**9]), 10**6)
    assert big.sum() == 10**6 and abs(big[0] - 750_000) < 5_000
    mean = np.mean([sharding.draw_one(np.random.default_rng(k), 30, 70, 20) for k in range(400)])
    assert 5.5 < mean < 6.5


# 3 near-dedup
def words(t):
    return t.encode().lower().split()


def shingles(t):
    w = words(t or "")
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    name = {i: i for i in sets}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = [i for i in sets if sets[i]]
    for a in ids:
        for b in ids:
            if a < b:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    name[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(base=220, copies=40):
    rng = np.random.default_rng(5)
    out = []
    for g in range(4):
        w = [f"w{x}" for x in rng.integers(0, 10_000, base)]
        for c in range(copies):
            v = list(w)
            for p in rng.integers(0, base, c % 7):
                v[p] = f"x{rng.integers(0, 10_000)}"
            out.append((1000 * g + c, " ".join(v)))
    return out


@pytest.mark.parametrize("most", [1024, 16])  # regions of 16 force greater depths
def test_near_dedup_against_brute_force(spark, most):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_dedup(df, most=most).collect()
    want = brute_components(rows)
    assert {r.doc_id: r.n_shingles for r in got} == {i: v[0] for i, v in want.items()}
    wrong = sum(r.component_id != want[r.doc_id][1] for r in got)
    assert wrong == 0, wrong
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_fringe_of_a_cloud(spark):
    """Texts with one link each to a cloud of near copies that is too large for a region at any depth, and unlinked texts beside them."""
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.permutation(400)]

    def edited(text, n):
        out = list(text)
        for p in rng.choice(np.arange(6, 390, 6), n, replace=False):
            out[p] = f"x{rng.integers(0, 1 << 40)}"
        return out

    cloud = [edited(base, 2) for _ in range(3000)]
    fringe = [edited(cloud[50 * k], 6) for k in range(60)]
    far = [edited(base, 10) for _ in range(20)]
    texts = [" ".join(t) for t in [*cloud, *fringe, *far]]
    sets = [set(map(hash, shingles(t))) for t in texts]
    linked = lambda a, b: 100 * (k := len(a & b)) >= 85 * (len(a) + len(b) - k)
    assert all(linked(sets[0], s) for s in sets[:3000])
    links = [sum(linked(f, s) for s in sets[:3000]) for f in sets[3000:]]
    assert min(links[:60]) == 1 and np.median(links[:60]) == 1 and max(links[60:]) == 0
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(df, most=256).collect()}
    assert sum(got[i] != 0 for i in range(3060)) == 0
    assert all(got[i] == i for i in range(3060, 3080))


def test_near_dedup_of_a_template(spark):
    """1,500 pages from one template and 30 pages at the threshold to every one of them, at production parameters."""
    base = [f"w{k}" for k in range(400)]
    pages = [" ".join([*base[:-1], f"own{k}"]) for k in range(1500)]
    fringe = [" ".join([*base[:370], *(f"f{k}x{i}" for i in range(30))]) for k in range(30)]
    rows = list(enumerate([*pages, *fringe]))
    assert brute_components([rows[0], rows[1], rows[1500], rows[1501]])[1500][1] == 0
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1530 and {r.component_id for r in got} == {0}


def test_near_dedup_rows_grow_with_a_group_not_faster(spark, monkeypatch):
    """A group of near copies that is too large for a region at any depth costs a few rows a member and tree of the first depth."""
    met, clusters = [], near_dedup.clusters
    monkeypatch.setattr(near_dedup, "clusters", lambda members, *more: met.append(members.count()) or clusters(members, *more))
    base, made = [f"w{k}" for k in range(200)], {}
    for n in (300, 600):
        pages = [" ".join([*base[:-1], f"own{k}"]) for k in range(n)]
        fringe = [" ".join([*base[:187], *(f"f{k}x{i}" for i in range(13))]) for k in range(10)]
        far = [" ".join([*base[:180], *(f"g{k}x{i}" for i in range(20))]) for k in range(10)]
        rows = list(enumerate([*pages, *fringe, *far]))
        met.clear()
        got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), most=64).collect()}
        assert got == {i: v[1] for i, v in brute_components(rows).items()}
        assert {got[i] for i in range(n + 10)} == {0} and all(got[i] == i for i in range(n + 10, n + 20))
        made[n] = sum(met)
        assert made[n] <= 5 * near_dedup.trees_for(near_dedup.DEPTHS[0], 85) * len(rows), made
    assert made[600] <= 2.5 * made[300], made


def test_near_dedup_of_families_that_share_regions(spark):
    """Two groups, each too large for a region, that share minima without a link; and two more that only one link joins."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(240)]
    put = lambda text, at: [f"x{rng.integers(0, 1 << 40)}" if k in at else w for k, w in enumerate(text)]
    heads = [base, put(base, set(range(0, 27))), put(base, set(range(200, 216)))]
    heads.append(put(heads[2], set(range(40, 52))))
    rows = []
    for head in heads:
        rows += [" ".join(put(head, {int(rng.integers(60, 190))})) for _ in range(90)]
    rows = [*enumerate(rows), (1000, " ".join(put(heads[2], set(range(40, 46)))))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), most=32).collect()}
    want = {i: v[1] for i, v in brute_components(rows).items()}
    assert got == want and len(set(want.values())) > 1


def test_near_dedup_compares_large_sets_in_cells(spark, monkeypatch):
    rows = near_copies(copies=12)
    want = brute_components(rows)
    own, size = np.arange(7), np.array([10, 900, 5, 5, 2000, 1, 300])
    monkeypatch.setattr(near_dedup, "CELL_BYTES", 16_000)
    met = {(a, b) for c in near_dedup.cells(own, size) for a in c.tolist() for b in c.tolist()}
    assert len(met) == 49
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    sets = {i: shingles(t) for i, t in rows}
    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            assert got[a] == got[b] or 100 * k < 80 * (len(sets[a]) + len(sets[b]) - k)
    assert all(got[i] <= v[1] for i, v in want.items())


def test_near_dedup_of_one_doc_id_with_several_texts(spark):
    other = "a wholly different text of some words that share nothing with any other one here"
    rows = [(1, PLAIN), (1, other), (3, other + " ok"), (2, PLAIN + " now"), (0, "x y z a b c d e f g")]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1)]


def test_near_dedup_messy(messy, empty):
    got = near_dedup.near_dedup(messy).collect()
    want = brute_components([r[:2] for r in messy_rows()])
    assert len(got) == 13 and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    assert near_dedup.near_dedup(empty).count() == 0


# 4 SentencePiece
def test_viterbi_is_the_library(docs, texts, spark, messy, empty):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = viterbi.Encoder.of(path)
    more = ["  a   b ", "日本語 🙂", "a" * 300, "\n", " ", "x\n\ny  \n z", "==== //// ----"]
    for t in [*list(texts.values())[:80], *more]:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t)
        assert encoder.decode(encoder.encode(t)) == t
    got = viterbi.digest(messy).collect()
    assert len(got) == 13 and all(r.round_trip for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[0] == 0
    assert viterbi.digest(empty).count() == viterbi.encode_documents(empty).count() == 0
    back = viterbi.decode_documents(viterbi.encode_documents(docs)).collect()
    assert {r.doc_id: r.text for r in back} == texts


def test_viterbi_streams(texts):
    """Windows stay small on a text without spaces, and scores of a unigram vocabulary give the best path."""
    path = vocabulary("piece_bpe_32k.model")()
    search = viterbi.MergeSearch(viterbi.Pieces.load(path))
    text = "supercalifragilistic" * 400
    out = []
    for i in range(0, len(text), 100):
        out += search.feed(text[i : i + 100])
    assert out + search.finish() == viterbi.Encoder.of(path).search.encode(text)
    assert search.peak < 400
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for t in [*(x[:3000] for x in texts.values() if len(x) > 500)][:25]:  # whole texts through the window, without cuts or tables
        assert search.encode(" " + t) == library.encode(t)
    pieces = viterbi.Pieces([("a", -1.0, 0), ("b", -1.0, 1), ("ab", -1.5, 2), ("ba", -0.5, 3), ("aba", -2.2, 4)], {b: 10 + b for b in range(256)}, 300)

    def best(t):
        if not t:
            return 0.0, []
        return max(((pieces.at[t[:k]][0] + s, [pieces.at[t[:k]][1], *p]) for k in range(1, 4) if pieces.at.get(t[:k]) for s, p in [best(t[k:])]), key=lambda x: x[0])

    score = {0: -1.0, 1: -1.0, 2: -1.5, 3: -0.5, 4: -2.2}
    for t in ("abab", "bbaab", "ababababba"):
        assert sum(score[i] for i in viterbi.StreamingViterbi(pieces).encode(t)) == pytest.approx(best(t)[0])


@pytest.mark.parametrize("text", ["a" * 100_000, "\n" * 100_000, " " * 100_000, "".join(chr(97 + (k * k + k // 7) % 10) for k in range(100_000))])
def test_viterbi_of_one_long_stretch(text, monkeypatch):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")()
    widest, take = [], viterbi.StreamingViterbi._take
    monkeypatch.setattr(viterbi.StreamingViterbi, "_take", lambda self, t: (take(self, t), widest.append(len(self.text)))[0])
    encoder = viterbi.Encoder(viterbi.Pieces.load(path))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == sentencepiece.SentencePieceProcessor(model_file=path).encode(text)
    assert max(widest) < 20 * encoder.pieces.longest


# 5 token files and the encoder
def test_encoder_is_the_library(texts):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")()
    library, own = Tokenizer.from_file(path), CachedEncoder(path, max_entries=2000)
    hard = ["It's we'll I'VE a\tb\x1cc É İ ΑΣ. <|endoftext|> x<|startoftext|>y 12345 日本語 🙂 ﬁ Å\r\n x", "", " ", "ét é", "À×y÷ª ß ÿŸ", "a" * 500]
    for t in [*texts.values(), *hard]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_token_files(spark, messy, empty, texts, docs):
    from tokenizers import Tokenizer

    vocab = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(vocab())
    for df, rows in ((messy, [r[:2] for r in messy_rows()]), (docs, list(texts.items()))):
        folder = scratch_path(spark, "test")
        manifest = token_files.write_token_files(df, folder, vocab, 2, length=64)
        got = sorted(tuple(r) for r in token_files.read_token_files(manifest, folder).collect())
        at, want = 0, []
        for i, t in sorted((i, t or "") for i, t in rows):
            ids = [*library.encode(t, add_special_tokens=False).ids, 2]
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert got == want
    first = manifest.first()
    import pyarrow.fs as pafs

    file = token_files.TokenFile(pafs.LocalFileSystem(), f"{first.path}.arrow")
    ids, mask = file.sequence(0)
    assert len(ids) == 64 and not ids.flags.owndata and len(mask) == 64 and np.array_equal(file.ids(0, 64), ids)
    folder = scratch_path(spark, "test")
    assert token_files.read_token_files(token_files.write_token_files(empty, folder, vocab, 2), folder).count() == 0


# 6 exact dedup
def test_exact_dedup(messy, empty):
    got = exact_dedup.exact_dedup(messy).collect()
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    groups = Counter(lower(r[1]) for r in messy_rows())
    last = {}
    for r in messy_rows():
        last[lower(r[1])] = max(r[0], last.get(lower(r[1]), -1))
    text = {r[0]: lower(r[1]) for r in messy_rows()}
    assert len(got) == 13
    for r in got:
        t = text[r.doc_id]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (last[t], groups[t], r.doc_id == last[t], hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_directory_doubling(docs, spark):
    assert exact_dedup.split({0: 5, 1: 1, 2: 1, 3: 1}, (0, 0), 2, 4) == ([(2, 1), (1, 1)], [(2, 0)])
    assert exact_dedup.slots_of([(2, 1), (1, 1), (2, 0)]) == (2, [(0, 0, 2), (1, 1, 2), (2, 2, 1), (3, 2, 1)])
    crowded = spark.createDataFrame([(k << 40,) for k in range(50)], "key long")  # all keys begin alike: split as deep as it takes
    depth, slots = exact_dedup.directory(crowded, 4)
    routed = crowded.join(slots, exact_dedup.prefix(F.col("key"), depth) == F.col("slot")).groupBy("bucket").count()
    assert depth > exact_dedup.FIRST and routed.agg(F.max("count"), F.sum("count")).first()[:] == (4, 50)
    cut = exact_dedup.exact_dedup(docs, capacity=8)
    assert cut.groupBy("bucket").agg(F.countDistinct("text_sha256").alias("n")).agg(F.max("n")).first()[0] <= 8
    one = exact_dedup.exact_dedup(docs)
    assert one.select("bucket").distinct().count() == 1 and cut.select("bucket").distinct().count() > 8
    same = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert cut.select(same).exceptAll(one.select(same)).count() == 0


def test_exact_dedup_routes_by_bucket(docs, monkeypatch):
    """Every bucket lies in one file; hot texts, combined before they move, give the same answers."""
    from tidemark.llm import common

    digests = common.stash(exact_dedup.normalised(docs).select("doc_id", "key", F.unhex(F.sha2(F.col("norm"), 256)).alias("sha")), "digests")
    index = exact_dedup.build_index(docs, digests, digests.count(), 8)
    files = index.select("bucket", F.input_file_name().alias("file")).distinct().groupBy("bucket").agg(F.count("*").alias("n"))
    assert files.agg(F.max("n")).first()[0] == 1 and files.count() > 8
    usual = exact_dedup.exact_dedup(docs).collect()
    monkeypatch.setattr(exact_dedup, "HOT", 10**9)  # every repeated text is hot
    monkeypatch.setattr(common, "HOT", 10**9)
    assert sorted(exact_dedup.exact_dedup(docs).collect()) == sorted(usual)


def test_exact_dedup_is_native(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 7 language ID
def test_language_id(spark, messy, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, net = language_id.learn(docs)
    got = language_id.identify(docs.where(language_id.held_out(F.col("doc_id"))), langs, net).collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    m = {r.doc_id: r for r in language_id.identify(messy, langs, net).collect()}
    assert len(m) == 11 and all(m[i].lang_pred == "und" and m[i].score == 0 for i in (0, 1, 2, 9))
    assert m[3].lang_pred in langs and 0 < m[3].score <= 1
    assert language_id.identify(empty, langs, net).count() == 0
    assert language_id.learn(empty)[0] == []
    assert {r.lang_pred for r in language_id.identify(messy, [], {}).collect()} == {"und"}


def test_gru_gradients():
    net = language_id.BiGru(3, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y, mask = rng.integers(97, 105, (5, 4)), np.array([0, 1, 2, 1]), np.ones((5, 4))
    _, g = net.step(x, y, mask)
    for k in ("uf", "wb", "v"):
        i = tuple(np.argwhere(np.abs(g[k]) > 1e-4)[0])
        old, eps = net.p[k][i], 1e-3
        net.p[k][i] = old + eps
        up = net.step(x, y, mask)[0]
        net.p[k][i] = old - eps
        down = net.step(x, y, mask)[0]
        net.p[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=1e-4)


# 8 quality
def test_quality(spark, messy, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.learn(docs, labels, labelled=600, pool=600)
    assert all(n > 0 for n in model["given"])  # each view taught the other
    held = docs.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    rows = quality.score(held, model).collect()
    assert np.mean([(r.score >= quality.REJECT) == (r.quality == 1) for r in rows]) > 0.96
    assert np.mean([r.score >= quality.REJECT for r in rows if r.quality == 1]) > 0.98
    m = {r.doc_id: r.score for r in quality.score(messy, model).collect()}
    assert len(m) == 11 and m[0] == m[1] == 0 and all(0 <= s <= 1 for s in m.values())
    assert quality.score(empty, model).count() == 0
    assert quality.learn(empty, labels) is None and quality.learn(docs, labels.where("quality = 1")) is None


def test_co_training_gives_new_documents_each_round():
    rng = np.random.default_rng(4)
    y = np.repeat([0.0, 1.0], 40)
    views = [np.c_[y * 4 - 2 + rng.normal(0, 0.2, 80), np.ones(80)] for _ in range(2)]
    truth = rng.integers(0, 2, 200) * 4.0 - 2
    pool = [np.c_[truth + rng.normal(0, 0.2, 200), np.ones(200)] for _ in range(2)]
    counts = [quality.co_train(views, y, pool, rounds, 20, 0.6)[1] for rounds in (1, 2, 3, 4)]
    assert counts == [[20 * r, 20 * r] for r in (1, 2, 3, 4)]


# 9 packing
def check_packing(rows, texts, library, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want[(i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert pieces == want
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_packing(messy, empty, docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json")())
    check_packing(packing.pack_documents(messy, capacity=512).collect(), [r[:2] for r in messy_rows()], library, 512)
    n, bound = check_packing(packing.pack_documents(docs, capacity=1024, district_rows=64).collect(), list(texts.items()), library, 1024)
    assert n <= bound * 1.01 + 1
    assert packing.pack_documents(empty).count() == 0


def test_genetic_steps():
    rng = np.random.default_rng(2)
    length = rng.integers(1, 70, 120).tolist()
    first = packing.first_population(length, 100, 3, rng)
    child = packing.crossover(first[0], first[1], length, 100, rng)
    for bins in (*first, child, packing.mutate(child, length, 100, rng)):
        assert sorted(i for b in bins for i in b) == list(range(120)) and max(sum(length[i] for i in b) for b in bins) <= 100
    best = packing.evolve(first, length, 100, 20, rng)
    assert packing.fitness(best[0], length, 100) >= max(packing.fitness(b, length, 100) for b in first)


def test_genetic_search_beats_best_fit():
    """Where best-fit decreasing leaves room, the search saves bins: triples that fill a bin exactly."""
    rng = np.random.default_rng(1)
    length = []
    for _ in range(40):
        a = int(rng.integers(260, 480))
        b = int(rng.integers(260, 1000 - a - 250))
        length += [a, b, 1000 - a - b]
    first = packing.first_population(length, 1000, 3, rng)
    plain = packing.best_fit([], list(range(len(length))), length, 1000)
    best = packing.evolve(first, length, 1000, 600, rng)[0]
    assert packing.fitness(best, length, 1000) > packing.fitness(plain, length, 1000) and len(best) < len(plain)
    assert sorted(i for b in best for i in b) == list(range(len(length)))


def test_bins_that_stay():
    length = [10] * 30
    bins = [list(range(0, 10)), list(range(10, 20)), list(range(20, 25)), list(range(25, 30))]
    assert packing.staying(bins, length, 100) == [True, True, False, False]
    assert packing.perfect(bins[:3], length, 100) and not packing.perfect(bins, length, 100)
    assert any(packing.staying([[i] for i in range(30)], length, 100))  # half of the pieces stay at least


# 10 LM scoring
def slow_score(net, data):
    """Every token on its own, from its surroundings as they are read off the text."""
    out = 0.0
    for k in range(len(data)):
        around = [data[k + s] if 0 <= k + s < len(data) else lm_score.PAD for s in range(-lm_score.SIDE, lm_score.SIDE + 1) if s]
        out += float(net.log_probability(np.array(around)[:, None], np.array([data[k]]))[0])
    return out


@pytest.fixture(scope="module")
def lm_weights(docs):
    return lm_score.learn(docs)


def test_lm_score(messy, empty, docs, texts, lm_weights):
    net = lm_score.Window.of(lm_weights)
    got = {r.doc_id: r for r in lm_score.score(docs, lm_weights).collect()}
    short = sorted(texts, key=lambda i: len(texts[i]))[:60]
    for i in short[::6]:
        assert got[i].sum_log_prob == pytest.approx(slow_score(net, texts[i].encode()), rel=1e-4)
    everything = np.array([[40], [50], [97], [98], [99], [255]])
    assert sum(np.exp(float(net.log_probability(everything, np.array([v]))[0])) for v in range(256)) == pytest.approx(1, abs=1e-4)
    counts = Counter(b for t in texts.values() for b in t.encode())
    total = sum(counts.values())
    unigram = sum(n * np.log(n / total) for n in counts.values()) / total
    assert np.mean([r.mean_log_prob for r in got.values()]) > unigram + 1
    m = {r.doc_id: r for r in lm_score.score(messy, lm_weights).collect()}
    assert len(m) == 11 and m[0].n_tokens == 0 and m[1].sum_log_prob == 0
    assert lm_score.score(empty, lm_weights).count() == 0 and len(lm_score.learn(empty)) == len(lm_weights)


def test_lm_scores_over_chunks(monkeypatch, lm_weights, texts):
    net = lm_score.Window.of(lm_weights)
    some = [t.encode() for t in list(texts.values())[:12]] + [b"", b"x", "é".encode()]
    whole = lm_score.batch_scores(net, some)
    monkeypatch.setattr(lm_score, "CHUNK", 150)
    monkeypatch.setattr(lm_score, "BLOCK", 37)
    assert lm_score.batch_scores(net, some) == pytest.approx(whole, rel=1e-5)
    short = min(some[:12], key=len)
    assert len(short) > 0 and lm_score.batch_scores(net, [short])[0] == pytest.approx(slow_score(net, short), rel=1e-4)


def test_lm_weights_do_not_depend_on_the_split(docs, lm_weights):
    assert np.abs(lm_score.learn(docs.repartition(7, "lang", "doc_id")) - lm_weights).max() < 1e-4


def test_lm_any_doc_id(spark):
    rows = [(2**62, PLAIN), (-(2**63), PLAIN), (2**63 - 1, "other"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.sum_log_prob for r in lm_score.score(df, lm_score.learn(df)).collect()}
    assert len(got) == 4 and got[2**62] == got[-(2**63)]


@pytest.mark.parametrize("different", [3_000_000, 50])
def test_lm_training_covers_every_position(monkeypatch, different):
    monkeypatch.setattr(lm_score, "CHUNK", 4000)
    monkeypatch.setattr(lm_score, "DIFFERENT", different)
    data = [bytes(97 + (k * k + k // 7) % 23 for k in range(n)) for n in (1, 5, 31, 32, 257, 30_007)]
    got = Counter()
    monkeypatch.setattr(lm_score.Window, "step", lambda self, x, y, w, rate, memory: [got.update({(*a, b): int(c)}) for a, b, c in zip(x.T.tolist(), y.tolist(), w, strict=True)] and 0.0)
    trainer = lm_score.Trainer(lm_score.Window(np.ones(256)))
    for d in data:
        trainer.add(d)
    trainer.run()
    want = Counter()
    for d in data:
        p = bytes([255] * 3) + d + bytes([255] * 3)
        want.update((*p[k : k + 3], *p[k + 4 : k + 7], p[k + 3]) for k in range(len(d)))
    assert got == want and trainer.seen == sum(map(len, data))


# the pipeline
def test_pipeline(spark, messy, tmp_path):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["language", "quality", "exact_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(0.1)).withColumn("kept", F.lit(False))
    for name, stage in c.STAGES:
        new = stage(spark, docs, SF)
        if name != "packing":
            assert new.columns == docs.columns
            assert new.count() <= docs.count() and new.exceptAll(docs).count() == 0
            new.write.parquet(str(tmp_path / name))
            new = spark.read.parquet(str(tmp_path / name))
        if name == "exact_dedup":
            left = [r.text.lower() if r.text.isascii() else r.text for r in new.collect()]
            assert len(left) == len(set(left))
        if name == "near_dedup":
            want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 80)
            assert {r.doc_id for r in new.collect()} == {i for i, v in want.items() if i == v[1]}
        docs = new
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)
    for name, stage in c.STAGES[2:]:
        stage(spark, messy, SF).count()
    kept = c.keep_one_exact_copy(spark, messy, SF).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 5, 6, 7, 8, 9, 10]


def test_pipeline_tells_rows_apart_by_text(spark, empty):
    import corpus_pipeline as c

    other, third = "an unrelated other text of its own", "and a third one that is like nothing else here"
    rows = [(1, PLAIN), (2, PLAIN), (1, other), (None, PLAIN), (None, third), (None, third), (2, PLAIN), (7, third + " ok so")]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    order = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=str)
    exact = c.keep_one_exact_copy(spark, df, SF)
    assert order(exact.collect()) == sorted([(2, PLAIN), (1, other), (None, third), (7, third + " ok so")], key=str)
    assert exact.columns == df.columns
    near = [(5, PLAIN + " a b c d e f g"), (5, other), (3, PLAIN + " a b c d e f h"), (None, PLAIN + " a b c d e f h")]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in near], df.schema)
    assert order(c.keep_one_near_copy(spark, df, SF).collect()) == sorted([near[1], near[2]], key=str)
    for name, stage in c.STAGES[2:]:
        assert stage(spark, empty, SF).count() == 0, name


def test_rows_without_doc_id(spark, texts):
    """Every operator answers them; see each docstring for how."""
    rows = [(None, PLAIN), (None, None), (None, "other text here"), (4, PLAIN), (5, "one more")]
    some = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, text string, lang string, source string")
    none = some.where("doc_id IS NULL")
    for df in (some, none):
        n = df.count()
        assert merkle.fingerprints(df, 3).count() == n
        assert sharding.shard_documents(df).count() == n
        near = near_dedup.near_dedup(df).collect()
        assert len(near) == n
        assert viterbi.digest(df).count() == n
        folder = scratch_path(spark, "test")
        assert token_files.read_token_files(token_files.write_token_files(df, folder, vocabulary("word_bpe_49k.json"), 2), folder).count() == n
        exact = exact_dedup.exact_dedup(df).collect()
        assert len(exact) == n and all(r.kept is not None for r in exact)
        assert language_id.identify(df, *language_id.learn(df)).count() == n
        assert quality.score(df, None).count() == n
        assert packing.pack_documents(df).count() == n
        assert lm_score.score(df, lm_score.learn(df)).count() == n
    assert {r.component_id for r in near_dedup.near_dedup(some).collect() if r.n_shingles > 10} == {4}


# every registered query
def test_oracles(spark):
    """The queries that SQL can express, against DuckDB on whole tables."""
    import duckdb

    from tidemark.llm import registry

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in registry.ORACLES.items():
        df, out = registry.QUERIES[name](spark, SF), con.sql(sql)
        names = sorted(out.columns)
        assert sorted(df.columns) == names
        at = [out.columns.index(c) for c in names]
        assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(tuple(r[k] for k in at) for r in out.fetchall()), name


#: Columns of the queries, as their contracts name them.
COLUMNS = {
    "op1_merkle": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op5_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op7_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
}


def test_registered_queries(spark, texts):
    from tidemark.llm import registry

    assert len(registry.QUERIES) == 11
    for name, run in registry.QUERIES.items():
        df = run(spark, SF)
        kinds = dict(df.dtypes)
        for part in COLUMNS.get(name, "doc_id bigint").split(", "):
            column, kind = part.split()
            assert kinds[column] == kind, (name, column)
        ids = {r.doc_id for r in df.select("doc_id").collect()}
        assert ids == set(texts) if name != "pipeline" else ids < set(texts), name
