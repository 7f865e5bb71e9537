"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network reads UTF-8 bytes in windows of WINDOW bytes, forwards and backwards, and gives every byte position a
distribution over the learned languages. A document's distribution is the mean over all its letter positions (of all
windows: whole texts are read); the prediction is its largest entry and the score that entry. Training uses a bounded
sample: at most `per_language` documents of each language (fewer if there are many languages), chosen by a hash of
doc_id, and `windows` windows of each, at places chosen by the same hash. Only text and lang of rows outside the held-out
fold are learned from; a prediction depends on the text alone.

Defined cases: null text or a text without letters gives `und` with score 0; so does every text where nothing could be
learned (no labelled row); rows with equal doc_id are answered each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, slices

WINDOW = 96
HIDDEN = 8
#: Byte values that count for a document's mean: ASCII letters and all bytes of other characters.
COUNTS = np.array([chr(b).isalpha() or b >= 128 if b < 128 else True for b in range(256)], dtype=np.float32)


def held_out(doc_id) -> F.Column:
    """True for the fold that is never learned from: crc32 of doc_id as text is divisible by 5 (or there is no doc_id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


class BiGru:
    """Parameters by name. Gate inputs come from a table by byte value; gate order: update, reset, candidate."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        h = hidden
        self.h, self.classes = h, classes
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
        self.p["v"] = rng.normal(0, 0.3, (2 * h, classes)).astype(np.float32)
        self.p["c"] = np.zeros(classes, np.float32)

    def run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States after each step of x (time, batch), and what the backward pass needs."""
        w, u, h = self.p[f"w{d}"], self.p[f"u{d}"], self.h
        state = np.zeros((x.shape[1], h), np.float32)
        states, tape = np.empty((*x.shape, h), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a, g = w[x[t]], state @ u
            zr = 0.5 + 0.5 * np.tanh(0.5 * (a[:, : 2 * h] + g[:, : 2 * h]))
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(a[:, 2 * h :] + r * g[:, 2 * h :])
            tape.append((t, state, z, r, n, g[:, 2 * h :]))
            state = n + z * (state - n)
            states[t] = state
        return states, tape

    def back(self, x: np.ndarray, d: str, tape: list, grad: np.ndarray, out: dict) -> None:
        """Backpropagation through time; grad: of the loss by each state."""
        u, h = self.p[f"u{d}"], self.h
        gw, gu = np.zeros_like(self.p[f"w{d}"]), np.zeros_like(u)
        carry = np.zeros((x.shape[1], h), np.float32)
        for t, state, z, r, n, gn in reversed(tape):
            s = carry + grad[t]
            dz, dn = s * (state - n) * z * (1 - z), s * (1 - z) * (1 - n * n)
            dr = dn * gn * r * (1 - r)
            da = np.concatenate([dz, dr, dn], axis=1)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            np.add.at(gw, x[t], da)
            gu += state.T @ dg
            carry = s * z + dg @ u.T
        out[f"w{d}"], out[f"u{d}"] = gw, gu

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Loss over all positions of a batch (time, batch) with labels y (batch), and its gradients."""
        f, ft = self.run(x, "f")
        b, bt = self.run(x, "b")
        both = np.concatenate([f, b], axis=2)
        logit = both @ self.p["v"] + self.p["c"]
        e = np.exp(logit - logit.max(axis=2, keepdims=True))
        prob = e / e.sum(axis=2, keepdims=True)
        n = max(1.0, float(mask.sum()))
        at = np.arange(len(y))
        loss = -float((np.log(prob[:, at, y] + 1e-9) * mask).sum()) / n
        d = prob
        d[:, at, y] -= 1
        d *= (mask / n)[:, :, None]
        out = {"v": np.einsum("tbh,tbc->hc", both, d), "c": d.sum(axis=(0, 1))}
        gh = d @ self.p["v"].T
        self.back(x, "f", ft, gh[:, :, : self.h], out)
        self.back(x, "b", bt, gh[:, :, self.h :], out)
        return loss, out

    def fit(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, steps: int, batch: int, seed: int, rate: float = 0.02) -> float:
        """Adam over `steps` batches that hold all classes alike. x: (windows, WINDOW) bytes."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(self.classes)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = 0.0
        for i in range(1, steps + 1):
            own = np.concatenate([rng.choice(w, max(1, batch // self.classes)) for w in by if len(w)])
            mask = (np.arange(x.shape[1])[:, None] < lengths[own][None, :]).astype(np.float32)
            loss, g = self.step(x[own].T, y[own], mask)
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            lr = rate * min(1.0, 3 * (1 - i / (steps + 1)))
            for k, v in g.items():
                v = v * min(1.0, 1 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                self.p[k] -= (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-6)).astype(np.float32)
        return loss

    def fast(self) -> dict:
        """Parameters for reading alone: halves folded into the gate weights."""
        h, out = self.h, {"v": self.p["v"], "c": self.p["c"]}
        for d in "fb":
            for k in "wu":
                out[k + d] = self.p[k + d].copy()
                out[k + d][:, : 2 * h] *= 0.5
        return out


def read_states(q: dict, x: np.ndarray, d: str) -> np.ndarray:
    """States of all windows, (time, hidden, batch), for x of shape (time, batch); features come first, so every operation runs over contiguous memory."""
    w, u = np.ascontiguousarray(q[f"w{d}"].T), np.ascontiguousarray(q[f"u{d}"].T)
    h, n = u.shape[1], x.shape[1]
    states = np.empty((len(x), h, n), np.float32)
    state = np.zeros((h, n), np.float32)
    a, g = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
    zr, c = a[: 2 * h], a[2 * h :]
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        np.take(w, x[t], axis=1, out=a, mode="clip")
        np.matmul(u, state, out=g)
        zr += g[: 2 * h]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        g[2 * h :] *= zr[h:]
        c += g[2 * h :]
        np.tanh(c, out=c)
        new = states[t]
        np.subtract(state, c, out=new)
        new *= zr[:h]
        new += c
        state = new
    return states


def position_probabilities(q: dict, x: np.ndarray) -> np.ndarray:
    """(time, class, batch) for x of shape (time, batch)."""
    h = q["uf"].shape[0]
    v = np.ascontiguousarray(q["v"].T)
    logit = np.matmul(v[:, :h], read_states(q, x, "f"))
    logit += np.matmul(v[:, h:], read_states(q, x, "b"))
    logit += q["c"][:, None]
    logit -= logit.max(axis=1, keepdims=True)
    np.exp(logit, out=logit)
    logit /= logit.sum(axis=1, keepdims=True)
    return logit


def pooled(q: dict, texts: list[bytes], rows: int = 512) -> np.ndarray:
    """Mean distribution of each text over its letter positions; rows: windows read at once."""
    classes = len(q["c"])
    total, weight = np.zeros((len(texts), classes)), np.zeros(len(texts))
    counts = [-(-len(t) // WINDOW) for t in texts]
    owner = np.repeat(np.arange(len(texts)), counts)
    flat = np.frombuffer(b"".join(t + bytes(-len(t) % WINDOW) for t in texts), dtype=np.uint8).reshape(-1, WINDOW)
    for i in range(0, len(flat), rows):
        x = np.ascontiguousarray(flat[i : i + rows].T)
        w = COUNTS[x]
        p = position_probabilities(q, x)
        p *= w[:, None, :]
        np.add.at(total, owner[i : i + rows], p.sum(axis=0).T)
        np.add.at(weight, owner[i : i + rows], w.sum(axis=0))
    return total / np.maximum(weight, 1)[:, None]


def training_windows(df: DataFrame, per_language: int, windows: int, most: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, windows, labels, lengths. At most `most` windows reach the driver."""
    known = df.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), np.zeros(0, int)
    each = max(1, min(per_language, most // (windows * len(langs))))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.25 * each / n + 0.0)).cast("double")) for k, n in sizes.items()])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_000)) / 1e6
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    cuts = F.array(*[F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(k)), room.cast("long")) + 1).cast("int"), F.lit(WINDOW)) for k in range(windows)])
    rows = known.where(draw < share).select("doc_id", "lang", cuts.alias("cuts"), draw.alias("draw")).orderBy("draw", "doc_id").limit(2 * each * len(langs)).collect()
    used: dict[str, int] = dict.fromkeys(langs, 0)
    data, label = [], []
    for r in rows:
        if used[r.lang] < each:
            used[r.lang] += 1
            for c in r.cuts:
                raw = c.encode("utf-8", "replace")[:WINDOW]
                if len(raw) >= 4:
                    data.append(raw)
                    label.append(langs.index(r.lang))
    x = np.frombuffer(b"".join(t.ljust(WINDOW, b"\0") for t in data), dtype=np.uint8).reshape(-1, WINDOW)
    return langs, x, np.array(label, dtype=int), np.array([len(t) for t in data], dtype=int)


def learn(df: DataFrame, per_language: int = 600, windows: int = 4, most: int = 24_000, steps: int = 260, batch: int = 96, seed: int = 5) -> tuple[list[str], dict]:
    """Languages and network for reading."""
    langs, x, y, lengths = training_windows(df, per_language, windows, most)
    if not len(x):
        return [], {}
    net = BiGru(len(langs))
    if len(langs) > 1:
        net.fit(x, y, lengths, steps, batch, seed)
    return langs, net.fast()


def identify(df: DataFrame, langs: list[str], q: dict, prefix: str = "") -> DataFrame:
    """df's columns with lang_pred and score (after prefix; columns of df that have these names are replaced)."""
    new = [f"{prefix}lang_pred", f"{prefix}score"]
    df = df.drop(*new)
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            texts = [t if t is not None and any(map(str.isalpha, t)) else None for t in b.column(at).to_pylist()] if langs else [None] * b.num_rows
            some = [k for k, t in enumerate(texts) if t is not None]
            p = pooled(q, [texts[k].encode("utf-8", "replace") for k in some]) if some else np.zeros((0, 1))
            pred, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            for k, row in zip(some, p, strict=True):
                pred[k], score[k] = langs[int(row.argmax())], min(1.0, float(row.max()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*b.schema.names, *new])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    langs, net = learn(docs)
    got = identify(docs.select("doc_id", "text"), langs, net)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
