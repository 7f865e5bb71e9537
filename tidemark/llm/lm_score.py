"""LM scoring by masked pseudo-likelihood: a bidirectional window network over byte tokens, trained in numpy.

Every token (byte) of a document is predicted from the SIDE tokens before it and the SIDE after it; the score is the sum
of the log-probabilities of all tokens given their surroundings, and its mean. The network adds one embedding for each
of the 2 * SIDE positions, passes the sum through tanh, and predicts the token in two steps, its high and its low four
bits: the low half sees the high half through a gate, so the product is a proper distribution over all 256 values.
Prior log-odds come from the token counts of the whole corpus.

Training covers every position of every document: in a SPAN of text, equal windows (a token with its surroundings)
are counted, and each different window is one example whose weight is its count, so the gradient of a pass is that of all
its positions. Documents are dealt by a hash of id and text to trainers, whose number follows from the corpus' bytes
alone, and read in the order of their ids; so weights do not depend on how the input is split. Trainers start from common
weights and step sizes, reached in one task on about START_BYTES of documents; their weights are averaged by positions seen,
in a distributed sum. Then every token of every document is scored, each different window of a chunk once.

A model of so short a window does not remember documents: those that occur twice do not score apart from others.

Defined cases: null text is empty; an empty text has no tokens, sum 0 and mean 0; rows with equal or no doc_id are scored each;
any doc_id that a long holds will do; lone surrogates are read as question marks; an empty table gives no rows; other
columns are ignored. Long texts are read in chunks with their surroundings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, slices, text_or_empty

SIDE = 3
HIDDEN = 24
#: Bytes of text whose windows are looked at together; of a span, whose windows are counted together, unless more than
#: DIFFERENT different ones turn up before; of the sample on which the common start is trained.
CHUNK = 4 << 20
SPAN = 32 << 20
DIFFERENT = 3_000_000
START_BYTES = 2 << 20
#: Text of a trainer, and the most trainers (the number of weight vectors to add up, not of documents).
TRAINER_BYTES = 32 << 20
TRAINERS = (8, 4096)
BATCH = 2048
BLOCK = 8_192
PAD = 255  # the value beyond either end of a document; UTF-8 has no such byte
TOKENS = 256


class Window:
    """Parameters by name, all 32-bit floats; features come first so that memory is contiguous."""

    def __init__(self, counts: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        c = counts.reshape(16, 16) + 0.05
        self.p = {
            "e": rng.normal(0, 0.15, (2 * SIDE, TOKENS, HIDDEN)).astype(np.float32),
            "hi": np.zeros((16, HIDDEN), np.float32),
            "hi0": np.log(c.sum(axis=1) / c.sum()).astype(np.float32),
            "gate": np.ones((16, HIDDEN), np.float32),
            "lo": rng.normal(0, 0.05, (16, HIDDEN)).astype(np.float32),
            "lo0": np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32),
        }
        self.p["hi"] = rng.normal(0, 0.05, (16, HIDDEN)).astype(np.float32)

    @classmethod
    def of(cls, flat: np.ndarray) -> "Window":
        out, at = cls(np.ones(256)), 0
        for k, v in out.p.items():
            out.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return out

    def flat(self) -> np.ndarray:
        return self.spell(self.p)

    @staticmethod
    def spell(named: dict) -> np.ndarray:
        return np.concatenate([v.ravel() for v in named.values()])

    def log_probability(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """around: (2 * SIDE, n) tokens; token: (n)."""
        p = self.p
        h = np.tanh(self._sum(around))
        hi, lo = token >> 4, token & 15
        a = p["hi"] @ h
        a += p["hi0"][:, None]
        h *= p["gate"].T[:, hi]
        b = p["lo"] @ h
        b += p["lo0"].T[:, hi]
        at = np.arange(len(token))
        out = a[hi, at] + b[lo, at]
        for z in (a, b):  # logits stay small: tanh and weight decay bound them
            np.exp(z, out=z)
            out -= np.log(z.sum(axis=0))
        return out

    def _sum(self, around: np.ndarray) -> np.ndarray:
        e = self.tables()
        h = np.take(e[0], around[0], axis=1)
        part = np.empty_like(h)
        for k in range(1, len(around)):
            np.take(e[k], around[k], axis=1, out=part, mode="clip")
            h += part
        return h

    def tables(self) -> list[np.ndarray]:
        if not hasattr(self, "_t"):
            self._t = [np.ascontiguousarray(e.T) for e in self.p["e"]]
        return self._t

    def step(self, around: np.ndarray, token: np.ndarray, weight: np.ndarray, rate: float, memory: dict) -> float:
        """One Adagrad step on weighted windows; returns their mean loss."""
        p, n = self.p, len(token)
        h = np.take(p["e"][0], around[0], axis=0)  # a row a window: whole rows are fast to gather and to add up
        part = np.empty_like(h)
        for k in range(1, len(around)):
            h += np.take(p["e"][k], around[k], axis=0, out=part, mode="clip")
        np.tanh(h, out=h)
        w = (weight / weight.sum()).astype(np.float32)
        hi, lo, at = (token >> 4).astype(np.intp), (token & 15).astype(np.intp), np.arange(n)

        def chances(z: np.ndarray, own: np.ndarray) -> np.ndarray:  # logits stay small: tanh and weight decay bound them
            nonlocal loss
            np.exp(z, out=z)
            z /= z.sum(axis=0)
            flat = own * n + at
            hit = z.ravel()
            loss -= float(w @ np.log(hit[flat] + 1e-12))
            hit[flat] -= 1
            z *= w
            return z

        loss = 0.0
        a = chances(p["hi"] @ h.T + p["hi0"][:, None], hi)
        g = np.take(p["gate"], hi, axis=0)
        hg = h * g
        b = p["lo"] @ hg.T
        b += np.take(p["lo0"], hi, axis=0).T
        b = chances(b, lo)
        dhg = b.T @ p["lo"]
        d = {"hi": a @ h, "hi0": a.sum(axis=1), "lo": b @ hg}
        by = np.argsort(token, kind="stable")  # sorted by the high half as well
        own = hi[by]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        d["lo0"], d["gate"] = np.zeros((16, 16), np.float32), np.zeros((16, HIDDEN), np.float32)
        d["lo0"][own[first]] = np.add.reduceat(b.T[by], first, axis=0)
        g *= dhg
        dhg *= h
        d["gate"][own[first]] = np.add.reduceat(dhg[by], first, axis=0)
        ds = a.T @ p["hi"]
        ds += g
        h *= h
        ds *= 1 - h
        for k in range(len(around)):
            order = np.argsort(around[k], kind="stable")
            own = around[k][order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            ids = own[first]
            sums = np.add.reduceat(np.take(ds, order, axis=0, out=part, mode="clip"), first, axis=0)
            m = memory["e"][k]
            m[ids] += sums * sums
            p["e"][k][ids] -= rate * sums / np.sqrt(m[ids] + 1e-8)
        for k, v in d.items():
            v = v + 1e-6 * p[k] if k not in ("hi0", "lo0") else v
            memory[k] += v * v
            p[k] -= rate * v / np.sqrt(memory[k] + 1e-8)
        return loss

    def memory(self) -> dict:
        return {k: np.full_like(v, 1e-6) for k, v in self.p.items()}


def windows(texts: list[bytes]) -> np.ndarray:
    """One number for every token of the texts: its SIDE neighbours, itself, its SIDE other neighbours, a byte each."""
    gap = bytes([PAD]) * SIDE
    a = np.frombuffer(gap + gap.join(texts) + gap, dtype=np.uint8)
    return spelt(a)[a[SIDE : len(a) - SIDE] != PAD]


def spelt(a: np.ndarray) -> np.ndarray:
    """The windows of bytes that have their surroundings at both ends."""
    n = len(a) - 2 * SIDE
    long = np.concatenate([a, np.zeros(8, np.uint8)])
    out = np.empty(n, dtype="<u8")
    for k in range(min(8, n)):
        own = len(out[k::8])
        out[k::8] = long[k : k + 8 * own].view("<u8")
    return out & np.uint64((1 << 8 * (2 * SIDE + 1)) - 1)


def in_chunks(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Of every CHUNK bytes or so: which texts, how many tokens of each, their windows. A longer text comes in several chunks."""
    held: list[int] = []
    room = 0
    flush = lambda: (held, np.array([len(texts[i]) for i in held]), windows([texts[i] for i in held]))
    for i, t in enumerate(texts):
        if held and room + len(t) > CHUNK:
            yield flush()
            held, room = [], 0
        if len(t) > CHUNK:
            a = np.pad(np.frombuffer(t, dtype=np.uint8), SIDE, constant_values=PAD)
            for at in range(0, len(t), CHUNK):
                w = spelt(a[at : at + CHUNK + 2 * SIDE])
                yield [i], np.array([len(w)]), w
        elif t:
            held.append(i)
            room += len(t)
    if held:
        yield flush()


def parts(different: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2 * SIDE, n) surroundings and (n) tokens of windows."""
    b = np.ascontiguousarray(different.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return np.delete(b[: 2 * SIDE + 1], SIDE, axis=0), b[SIDE]


class Trainer:
    """Counts the windows of documents and takes steps on the different ones of each span, in a seeded order."""

    def __init__(self, net: Window, rate: float = 0.05, passes: int = 1, memory: dict | None = None):
        self.net, self.rate, self.passes = net, rate, passes
        self.memory, self.seen, self.loss = memory or net.memory(), 0, []
        self.texts: list[bytes] = []
        self.n = self.span = 0
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, data: bytes) -> None:
        self.texts.append(data)
        self.n += len(data)
        if self.n >= CHUNK:
            self.count()

    def count(self) -> None:
        """Windows of the texts held, and their counts; what was found before is merged in now and then."""
        for _, _, w in in_chunks(self.texts):
            which, different = pd.factorize(w)
            self.found.append((different, np.bincount(which, minlength=len(different))))
            self.span += len(w)
            if sum(len(d) for d, _ in self.found) > DIFFERENT:
                self.merge()
                if len(self.found[0][0]) > DIFFERENT:
                    self.learn()
            if self.span >= SPAN:
                self.learn()
        self.texts, self.n = [], 0

    def merge(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.found = [(keys[first], np.add.reduceat(counts, first))]

    def learn(self) -> None:
        if not self.span:
            return
        self.merge()
        (different, weight), self.found = self.found[0], []
        x, y = parts(different)
        for k in range(self.passes):
            order = np.random.default_rng([self.seen, k]).permutation(len(y))
            for i in range(0, len(y), BATCH):
                own = order[i : i + BATCH]
                self.loss.append(self.net.step(x[:, own], y[own], weight[own], self.rate * (len(own) / BATCH) ** 0.5, self.memory))
        self.seen, self.span = self.seen + self.span, 0

    def run(self) -> None:
        self.count()
        self.learn()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def corpus_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of each byte value in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for b in slices(batches):
            total += np.bincount(np.frombuffer("".join(b.column(1).to_pylist()).encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
        yield pa.RecordBatch.from_pydict({"token": np.arange(256), "n": total})

    out = np.zeros(256)
    for r in texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():  # 256 rows
        out[r.token] = r.n
    return out


def trained(texts: DataFrame, start: np.ndarray, rate: float, passes: int) -> DataFrame:
    """entry, weight, seen: what a trainer reaches on each `trainer`'s texts, in the order of their ids, times the positions it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, which = None, None

        def out() -> pa.RecordBatch:
            trainer.run()
            flat = np.concatenate([trainer.net.flat(), Window.spell(trainer.memory)]).astype(np.float64) * trainer.seen
            return pa.RecordBatch.from_pydict({"entry": np.arange(len(flat)), "weight": flat, "seen": np.full(len(flat), trainer.seen)})

        for b in slices(batches):
            for own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own != which:
                    if trainer:
                        yield out()
                    half = len(start) // 2
                    trainer, which = Trainer(Window.of(start[:half]), rate, passes, Window.of(start[half:]).p), own
                trainer.add(utf8(text))
        if trainer:
            yield out()

    return texts.select("trainer", "text").mapInArrow(run, "entry long, weight double, seen long")


def mean_weights(found: DataFrame, start: np.ndarray) -> np.ndarray:
    """Mean of the trainers' weights by positions seen; those of `start` where nothing was seen."""
    sums = found.where("seen > 0").groupBy("entry").agg(F.sum("weight").alias("w"), F.sum("seen").alias("n"))
    out = start.astype(np.float64)
    for r in sums.select("entry", (F.col("w") / F.col("n")).alias("w")).collect():  # a row a parameter
        out[r.entry] = r.w
    return out.astype(np.float32)


def learn(df: DataFrame, start_bytes: int = START_BYTES, trainer_bytes: int = TRAINER_BYTES) -> np.ndarray:
    """Weights of the network. The same for every split of the input, but for the rounding of sums."""
    texts = text_or_empty(df).where("text <> ''")
    counts = corpus_counts(texts)
    total = int(counts.sum())
    net = Window(counts)
    common = np.concatenate([net.flat(), Window.spell(net.memory())])
    if not total:
        return net.flat()
    mark = F.xxhash64("doc_id", "text")
    drawn = texts.where(F.pmod(mark, F.lit(1 << 30)) <= int(min(1.0, start_bytes / total) * (1 << 30)))
    first = drawn.withColumn("trainer", F.lit(0)).repartition(1).sortWithinPartitions("doc_id", "text")
    common = mean_weights(trained(first, common, 0.05, 4), common)
    n = max(TRAINERS[0], min(TRAINERS[1], -(-total // trainer_bytes)))
    dealt = texts.withColumn("trainer", F.pmod(F.xxhash64(mark, F.lit("trainer")), F.lit(n)).cast("int"))
    dealt = dealt.repartition(n, "trainer").sortWithinPartitions("trainer", "doc_id", "text")
    return mean_weights(trained(dealt, common, 0.05, 1), common)[: len(common) // 2]


def log_probabilities(net: Window, w: np.ndarray) -> np.ndarray:
    """Of every window; each different one is worked out once."""
    which, different = pd.factorize(w)
    x, y = parts(different)
    lp = np.empty(len(y))
    for i in range(0, len(y), BLOCK):
        lp[i : i + BLOCK] = net.log_probability(x[:, i : i + BLOCK], y[i : i + BLOCK])
    return lp[which]


def batch_scores(net: Window, texts: list[bytes]) -> np.ndarray:
    """Sum of the log-probabilities of all tokens of each text."""
    out = np.zeros(len(texts))
    for held, lengths, w in in_chunks(texts):
        sums = np.concatenate([[0.0], np.cumsum(log_probabilities(net, w))])[np.concatenate([[0], np.cumsum(lengths)])]
        out[held] += np.diff(sums)
    return out


def score(df: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, sum_log_prob, mean_log_prob."""

    def scored(net: Window, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        n, s = np.array([len(t) for t in texts], dtype=np.int64), batch_scores(net, texts)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(s), pa.array(s / np.maximum(n, 1))], names=["doc_id", "n_tokens", "sum_log_prob", "mean_log_prob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, ids, texts, room = Window.of(weights), [], [], 0
        for b in slices(batches):
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(utf8(text))
                room += len(texts[-1])
            if room >= CHUNK or len(ids) >= 20_000:
                yield scored(net, ids, texts)
                ids, texts, room = [], [], 0
        if ids:
            yield scored(net, ids, texts)

    return text_or_empty(df).mapInArrow(run, "doc_id long, n_tokens long, sum_log_prob double, mean_log_prob double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learn(docs))
