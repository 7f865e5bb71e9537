"""Feature schema: model, JSON, inference, validation, layout; parsing of target and cap specifications."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Timestamp feature ids of the four known domains; ids of the two sample-time features.
KNOWN_TS_FIDS = {"seq_a": 39, "seq_b": 67, "seq_c": 27, "seq_d": 26}
WEEKDAY_FID, HOUR_FID = 900001, 900002
DEFAULT_CAPS = {"seq_a": 256, "seq_b": 256, "seq_c": 512, "seq_d": 512}


@dataclass
class Domain:
    prefix: str
    ts_fid: int | None
    features: dict[int, int]  # fid -> vocab

    def column(self, fid: int) -> str:
        return f"{self.prefix}_{fid}"


@dataclass
class FeatureSchema:
    user_int: list[tuple[int, int, int]] = field(default_factory=list)
    item_int: list[tuple[int, int, int]] = field(default_factory=list)
    user_dense: list[tuple[int, int]] = field(default_factory=list)
    seq: dict[str, Domain] = field(default_factory=dict)

    @classmethod
    def parse(cls, spec: dict) -> "FeatureSchema":
        seq = {d: Domain(c["prefix"], c.get("ts_fid"), {int(f): int(v) for f, v in c["features"]}) for d, c in spec.get("seq", {}).items()}
        return cls(*([tuple(x) for x in spec.get(k, [])] for k in ("user_int", "item_int", "user_dense")), seq)

    @classmethod
    def read(cls, path: str) -> "FeatureSchema":
        with open(path, encoding="utf-8") as f:
            return cls.parse(json.load(f))

    def spec(self) -> dict:
        seq = {d: {"prefix": c.prefix, "ts_fid": c.ts_fid, "features": [[f, v] for f, v in c.features.items()]} for d, c in self.seq.items()}
        return {"user_int": [list(x) for x in self.user_int], "item_int": [list(x) for x in self.item_int], "user_dense": [list(x) for x in self.user_dense], "seq": seq}

    def write(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.spec(), f, indent=2)

    def with_sample_time(self) -> "FeatureSchema":
        """The weekday and hour of the sample as two more user features (8 and 25 ids)."""
        return FeatureSchema([*self.user_int, (WEEKDAY_FID, 8, 1), (HOUR_FID, 25, 1)], self.item_int, self.user_dense, self.seq)

    def columns(self) -> list[str]:
        flat = [f"user_int_feats_{f}" for f, *_ in self.user_int if f < WEEKDAY_FID] + [f"item_int_feats_{f}" for f, *_ in self.item_int] + [f"user_dense_feats_{f}" for f, _ in self.user_dense]
        return flat + [c.column(f) for c in self.seq.values() for f in c.features]


def layout(entries: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(fid, offset, length) of features that lie side by side."""
    out, at = [], 0
    for fid, length in entries:
        out.append((fid, at, length))
        at += length
    return out


def slice_vocab(entries: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(largest vocabulary, offset, length) by feature, from (fid, vocab, dim)."""
    return [(v, at, n) for (_, v, _), (_, at, n) in zip(entries, layout([(f, d) for f, _, d in entries]), strict=True)]


def group_indices(groups: dict[str, list[int]], entries: list[tuple[int, int, int]], extra: tuple[int, ...] = ()) -> list[list[int]]:
    """Groups of fids as groups of positions; each id of `extra` that is there becomes a group of its own."""
    at = {f: k for k, (f, *_) in enumerate(entries)}
    missing = sorted({f for g in groups.values() for f in g} - set(at))
    if missing:
        raise ValueError(f"groups name unknown features {missing}")
    return [[at[f] for f in g] for g in groups.values()] + [[at[f]] for f in extra if f in at]


def chunk_layout(total: int, tokens: int) -> tuple[int, int]:
    """Width of each of `tokens` equal chunks, and the padding that fills the last."""
    width = -(-total // tokens)
    return width, width * tokens - total


def chunk_audit(entries: list[tuple[int, int, int]], tokens: int, emb_dim: int, wide: int = 16) -> tuple[list[tuple], list[tuple]]:
    """Which features an equal split of their embeddings mixes: a row a feature, and a row a chunk.

    entries: (fid, vocab, length), in order; each is embedded into emb_dim numbers. Features: (fid, offset, length, vocab,
    first chunk, last chunk). Chunks: (chunk, numbers that are not padding, fids, whether a feature longer than `wide`
    runs over one of its borders).
    """
    total = len(entries) * emb_dim
    width, _ = chunk_layout(total, tokens)
    features = []
    for k, ((fid, vocab, length), (_, at, _)) in enumerate(zip(entries, layout([(f, n) for f, _, n in entries]), strict=True)):
        features.append((fid, at, length, vocab, k * emb_dim // width, ((k + 1) * emb_dim - 1) // width))
    chunks = []
    for c in range(tokens):
        inside = [f for f in features if f[4] <= c <= f[5]]
        chunks.append((c, max(0, min(width, total - c * width)), [f[0] for f in inside], any(f[2] > wide and f[4] < f[5] for f in inside)))
    return features, chunks


def token_mixing(tokens: int, width: int) -> list[tuple[int, int]]:
    """Where entry (token, offset) of a tokens x width block goes when heads are regrouped: a list over the new flat order."""
    if width % tokens:
        raise ValueError("the width must be a multiple of the number of tokens")
    head = width // tokens
    return [(t, h * head + k) for h in range(tokens) for t in range(tokens) for k in range(head)]


def check_columns(df: DataFrame, wanted: list[str], strict: bool = True) -> list[str]:
    """Top-level columns that are missing; an error with a preview if strict."""
    missing = [c for c in wanted if c not in df.columns]
    if missing and strict:
        raise ValueError(f"{len(missing)} columns are missing: {', '.join(missing[:8])}; there are {', '.join(df.columns[:8])} ...")
    return missing


def ts_column(domain: str, spec: Domain, columns: list[str]) -> str | None:
    """The physical timestamp column of a domain, or None.

    The id is the schema's, else the known one if it is a feature, else the only feature with a vocabulary of 10**9 or
    more. The name is prefix_id, domain_id or seq_domain_id, else the only column with that suffix (and, of several, the
    only one that has the last part of the domain's name).
    """
    fid = spec.ts_fid
    if fid is None and KNOWN_TS_FIDS.get(domain) in spec.features:
        fid = KNOWN_TS_FIDS[domain]
    if fid is None:
        large = [f for f, v in spec.features.items() if v >= 10**9]
        fid = large[0] if len(large) == 1 else None
    if fid is None:
        return None
    for name in ([f"{spec.prefix}_{fid}"] if spec.prefix else []) + [f"{domain}_{fid}", f"seq_{domain}_{fid}"]:
        if name in columns:
            return name
    ends = [c for c in columns if c.endswith(f"_{fid}")]
    if len(ends) > 1:
        ends = [c for c in ends if domain.rsplit("_", 1)[-1] in c]
    return ends[0] if len(ends) == 1 else None


def parse_targets(text: str) -> list[tuple[str, int, int | None]]:
    """`domain:fid` or `domain:fid:k`, separated by commas or spaces."""
    out = []
    for part in text.replace(",", " ").split():
        bits = part.split(":")
        if len(bits) not in (2, 3):
            raise ValueError(f"not domain:fid or domain:fid:k: {part!r}")
        out.append((bits[0], int(bits[1]), int(bits[2]) if len(bits) == 3 else None))
    return out


def parse_caps(text: str) -> dict[str, int]:
    """`domain:cap,domain:cap`."""
    return {d.strip(): int(c) for d, _, c in (p.partition(":") for p in text.split(",") if p.strip())}


def check_targets(targets: list[tuple[str, int, int | None]], schema: FeatureSchema) -> None:
    """An error that names every target which the schema's sequences do not have."""
    unknown = [f"{d}:{f}" for d, f, _ in targets if d not in schema.seq or f not in schema.seq[d].features]
    if unknown:
        raise ValueError(f"the schema has no {', '.join(unknown)}")


def infer_columns(df: DataFrame) -> DataFrame:
    """column, kind, vocab (largest value + 1, at least 1), width (longest list; 1 for scalars): one pass, one row a column."""
    aggregates, kinds = [], {}
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            dense = isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType))
            kinds[f.name] = "dense" if dense else "int_list"
            aggregates += [F.max(F.lit(None) if dense else F.array_max(c)).cast("long").alias(f"v_{f.name}"), F.max(F.size(c)).alias(f"w_{f.name}")]
        elif isinstance(f.dataType, T.NumericType):
            kinds[f.name] = "int"
            aggregates += [F.max(c).cast("long").alias(f"v_{f.name}"), F.lit(1).alias(f"w_{f.name}")]
    one = df.agg(*aggregates)
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(k).alias("kind"), F.greatest(F.lit(1), F.coalesce(F.col(f"v_{n}") + 1, F.lit(1))).cast("long").alias("vocab"), F.greatest(F.lit(1), F.coalesce(F.col(f"w_{n}"), F.lit(1))).cast("long").alias("width")) for n, k in kinds.items()])
    return one.select(F.explode(rows).alias("r")).select("r.*")
