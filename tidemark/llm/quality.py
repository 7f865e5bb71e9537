"""Quality classifier by co-training of a text-content view and a page-metadata view.

Content view: the text's hashed byte trigrams (log counts, unit length) and how much its words repeat. Metadata view: what a crawl keeps about a page
beside its words: length, line count and lengths, shares of letters, capitals, digits, punctuation and white space,
repeated lines, language and source (hashed). Each view has a logistic regression, trained in numpy on a bounded sample
of labelled documents. In each round, each view labels the unlabelled pool (also a bounded sample) and hands the other
the documents it is surest of, as many of each class as the labelled rows suggest, if their probability is beyond
`sure`; then both are trained again. Both views are calibrated on labelled documents kept from training (Platt), the
calibrated log-odds are averaged with weights by each view's calibration loss, and every document is scored whole.

Bounds (parameters): `labelled` rows of each class and `pool` unlabelled rows reach the driver, as feature vectors.
Held out: documents whose crc32(doc_id as text) mod 5 is 0 are never learned from; tests measure on them.

Defined cases: null text is empty; a text without characters scores 0; null lang or source is a value of its own; where
no label of both classes can be learned from, every other document scores 1 (nothing is known against it); a document with
contradictory labels counts as unlabelled; rows with equal doc_id are scored each; an empty table gives no rows; other
columns are ignored, or kept where `score` is called with them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import documents, slices

TRIGRAMS = 1024
CONTENT = TRIGRAMS + 3
LITTLE = 80
#: Byte-class shares of usual prose, added as LITTLE bytes so that a few characters decide nothing.
USUAL = np.array([0, 0.78, 0.03, 0, 0.16, 0.03, 0])
REJECT = 0.4
HASHED = 32
META = 14 + HASHED
#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 punctuation, 6 beyond ASCII.
CLASSES = np.array([6 if b >= 128 else 1 if chr(b).islower() else 2 if chr(b).isupper() else 3 if chr(b).isdigit() else 4 if chr(b).isspace() else 5 if 33 <= b < 127 else 0 for b in range(256)], dtype=np.uint8)


def content(text: str) -> np.ndarray:
    """Unit vector of log trigram counts, shortened for texts that say little, and how much words repeat."""
    b = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        b = np.pad(b, (0, 3 - len(b)))
    h = ((b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA77 + b[2:] * 0xC2B2AE3D) >> np.uint32(16)) % TRIGRAMS
    v = np.log1p(np.bincount(h, minlength=TRIGRAMS)).astype(np.float32)
    words = text.split()
    n = max(1, len(words))
    sure = min(1.0, len(b) / LITTLE)
    again = sum(map(eq, words, words[1:])) / n
    return np.append(v * (sure / np.sqrt((v * v).sum())), np.array([again, min(again, 0.2) * 3, 1 - len(set(words)) / n], np.float32))


def metadata(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """Length, layout and origin of a page."""
    out = np.zeros(META, dtype=np.float32)
    b = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    lines = text.split("\n")
    share = (np.bincount(CLASSES[b], minlength=7) + USUAL * LITTLE) / (len(b) + LITTLE)
    out[:7] = share
    out[7] = min(1.0, share[5] * 5)
    out[8] = np.log1p(max(LITTLE, len(text))) / 12
    out[9] = np.log1p(len(lines)) / 8
    out[10] = np.log1p(max(LITTLE, len(text)) / len(lines)) / 8
    out[11] = len(set(lines)) / len(lines)
    out[12] = share[2] / max(1e-3, share[1] + share[2])
    out[13] = 1
    for k, v in ((0, lang), (1, source)):
        out[14 + k * HASHED // 2 + zlib.crc32((v or "").encode()) % (HASHED // 2)] = 1
    return out


class Logistic:
    """Logistic regression with an L2 penalty, by Adam steps of falling size on all rows."""

    def __init__(self, width: int, penalty: float):
        self.w, self.penalty = np.zeros(width + 1), penalty

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, rate: float = 0.3) -> None:
        m, s = np.zeros_like(self.w), np.zeros_like(self.w)
        total = weight.sum()
        for i in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))
            d = weight * (p - y) / total
            g = np.append(d @ x, d.sum()) + self.penalty * np.append(self.w[:-1], 0)
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            self.w -= rate * (1 - i / (steps + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-8)


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights under which both classes count alike."""
    pos = max(1, int(y.sum()))
    neg = max(1, len(y) - pos)
    return np.where(y == 1, 0.5 / pos, 0.5 / neg) * len(y)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, offset, and mean log loss of the calibrated log-odds; targets are smoothed."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-6, float(np.abs(z).max()))
    one = Logistic(1, 1e-4)
    one.fit(z[:, None] / scale, target, np.ones(len(z)), steps=400, rate=0.5)
    a, b = max(0.0, float(one.w[0]) / scale), float(one.w[1])
    p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
    return a, b, -float((target * np.log(p + 1e-9) + (1 - target) * np.log(1 - p + 1e-9)).mean())


def co_train(views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int, grow: int, sure: float) -> tuple[list[Logistic], list[int]]:
    """One model a view, and how many pseudo-labels each was given by the other."""
    models = [Logistic(v.shape[1], 1e-4 if v.shape[1] > 100 else 1e-5) for v in views]
    given: list[dict[int, int]] = [{}, {}]
    rate = float(y.mean())
    for r in range(rounds + 1):
        for k, model in enumerate(models):
            own = np.array(sorted(given[k]), dtype=int)
            x = np.concatenate([views[k], pool[k][own]])
            t = np.concatenate([y, np.array([given[k][i] for i in own.tolist()], dtype=float)])
            w = balanced(t) * np.concatenate([np.ones(len(y)), np.full(len(own), 0.5)])
            model.fit(x, t, w)
        if r == rounds or not len(pool[0]):
            break
        for k, model in enumerate(models):
            p = 1 / (1 + np.exp(-np.clip(model.logit(pool[k]), -30, 30)))
            order = np.argsort(-p)
            order = order[[i not in given[1 - k] for i in order.tolist()]]  # only what the other view has not been given
            good = [i for i in order[: max(1, int(grow * rate))].tolist() if p[i] >= sure]
            bad = [i for i in order[::-1][: max(1, int(grow * (1 - rate)))].tolist() if p[i] <= 1 - sure]
            for i, label in [*((i, 1) for i in good), *((i, 0) for i in bad)]:
                given[1 - k].setdefault(i, label)
    return models, [len(g) for g in given]


def features(df: DataFrame) -> DataFrame:
    """doc_id, quality (null for the pool), both views as 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([r["quality"] for r in rows], pa.int32()),
                    pa.array([content(r["text"]).tobytes() for r in rows], pa.binary()),
                    pa.array([metadata(r["text"], r["lang"], r["source"]).tobytes() for r in rows], pa.binary()),
                ],
                names=["doc_id", "quality", "content", "metadata"],
            )

    return df.select("doc_id", "quality", "text", "lang", "source").mapInArrow(run, "doc_id long, quality int, content binary, metadata binary")


def sample(docs: DataFrame, labels: DataFrame, labelled: int, pool: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels (-1: pool), content, metadata of the training rows; at most 2 * labelled + pool of them, by hash order."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    draw = lambda name: F.pmod(F.xxhash64("doc_id", F.lit(name)), F.lit(1 << 30))
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & fold).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max("quality").cast("int").alias("quality"), F.min("quality").alias("least")).where(F.col("quality") == F.col("least")).drop("least")
    parts = [known.where(F.col("quality") == q).withColumn("draw", draw("quality")).orderBy("draw", "doc_id").limit(labelled).select("doc_id", "quality") for q in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * labelled rows: small enough to broadcast
    plain = docs.where(F.col("text").isNotNull() & (F.length("text") > 0)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    n = plain.select("doc_id").count()
    share = min(1.0, 1.3 * pool / max(1, n))
    loose = plain.where(fold & (draw("pool") < int(share * (1 << 30)))).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    # rows of one doc_id beyond the bound: those with the lowest text hashes are taken, whatever their order
    first = lambda df, most: df.orderBy(draw("pool"), "doc_id", F.xxhash64("text")).limit(most)
    with_label = first(plain.join(F.broadcast(chosen), "doc_id"), 2 * labelled)
    loose = first(loose.withColumn("quality", F.lit(None).cast("int")), pool)
    rows = features(with_label.unionByName(loose.select(with_label.columns))).collect()
    rows.sort(key=lambda r: (r.doc_id, r.content))
    y = np.array([-1 if r.quality is None else r.quality for r in rows], dtype=int)
    unpack = lambda name, width: np.frombuffer(b"".join(r[name] for r in rows), dtype=np.float32).reshape(-1, width)
    return np.array([r.doc_id for r in rows], dtype=np.int64), y, unpack("content", CONTENT), unpack("metadata", META)


def learn(docs: DataFrame, labels: DataFrame, labelled: int = 1500, pool: int = 1500, rounds: int = 4, grow: int = 200, sure: float = 0.9) -> dict | None:
    """Weights, calibrations and view weights; None where one class is missing."""
    ids, y, text, meta = sample(docs, labels, labelled, pool)
    known = np.flatnonzero(y >= 0)
    if len(set(y[known].tolist())) < 2 or len(known) < 10:
        return None
    held = np.array([zlib.crc32(f"calibrate {i}".encode()) % 4 == 0 for i in ids[known].tolist()])
    if len(set(y[known][held].tolist())) < 2 or len(set(y[known][~held].tolist())) < 2:
        held[:] = np.arange(len(known)) % 4 == 0
    train, cal, loose = known[~held], known[held], np.flatnonzero(y < 0)
    models, given = co_train([text[train], meta[train]], y[train].astype(float), [text[loose], meta[loose]], rounds, grow, sure)
    scale = [platt(m.logit(v[cal]), y[cal].astype(float)) for m, v in zip(models, (text, meta), strict=True)]
    inverse = [1 / (s[2] + 1e-3) for s in scale]
    return {"w": [m.w.astype(np.float32) for m in models], "scale": [s[:2] for s in scale], "share": [i / sum(inverse) for i in inverse], "given": given}


def view_odds(model: dict, text: str, lang: str | None, source: str | None) -> tuple[float, float]:
    """Calibrated log-odds of good quality by each view."""
    out = []
    for x, w, (a, b) in zip((content(text), metadata(text, lang, source)), model["w"], model["scale"], strict=True):
        out.append(a * float(x @ w[:-1] + w[-1]) + b)
    return out[0], out[1]


def score(df: DataFrame, model: dict | None, prefix: str = "") -> DataFrame:
    """df's columns with p_content, p_metadata and score (0 to 1; after prefix, columns of df with these names are replaced)."""
    new = [f"{prefix}{n}" for n in ("p_content", "p_metadata", "score")]
    df = df.drop(*new)
    at = {c: df.columns.index(c) for c in ("text", "lang", "source")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for b in slices(batches):
            out = np.zeros((3, b.num_rows))
            for k, (text, lang, source) in enumerate(zip(*(b.column(at[c]).to_pylist() for c in ("text", "lang", "source")), strict=True)):
                if not text:
                    continue
                if model is None:
                    out[:, k] = 1
                    continue
                z = view_odds(model, text, lang, source)
                out[:, k] = p(z[0]), p(z[1]), p(model["share"][0] * z[0] + model["share"][1] * z[1])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(o) for o in out)], names=[*b.schema.names, *new])

    more = [T.StructField(n, T.DoubleType()) for n in new]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *more]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source"), model)
    return got.select("doc_id", "p_content", "p_metadata", "score", (F.col("score") >= REJECT).alias("kept"))
