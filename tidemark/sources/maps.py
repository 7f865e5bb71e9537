"""Vocabulary maps and reports as files: JSON maps, Parquet maps, Markdown tables, prediction output."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def map_document(map_: DataFrame, fids: dict[str, int], vocab: dict[str, int] | None = None) -> dict:
    """The exchange form of a map: ids in rank order by `domain:fid`. For maps that a driver can hold; larger ones stay tables."""
    targets: dict[str, dict] = {}
    for r in map_.orderBy("domain", "rank").toLocalIterator():
        key = f"{r.domain}:{fids[r.domain]}"
        t = targets.setdefault(key, {"domain": r.domain, "fid": fids[r.domain], "vocab_size": (vocab or {}).get(r.domain, 0), "padding_id": 0, "ids": []})
        t["ids"].append(r.token)
    for t in targets.values():
        t |= {"k": len(t["ids"]), "actual_k": len(t["ids"]), "default_id": len(t["ids"]) + 1}
    return {"version": 1, "format": "topk_map", "targets": targets, "warnings": []}


def write_map(path: str, document: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f)


def read_map(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """domain, token, rank. Ids must be positive and distinct; a wanted target that is missing is an error."""
    with open(path, encoding="utf-8") as f:
        targets = json.load(f)["targets"]
    missing = sorted(set(wanted or []) - set(targets))
    if missing:
        raise ValueError(f"the map lacks {missing}")
    rows = []
    for key, t in targets.items():
        if wanted is None or key in wanted:
            ids = t["ids"]
            if len(set(ids)) != len(ids) or any(i <= 0 for i in ids):
                raise ValueError(f"{key}: ids must be positive and distinct")
            rows += [(t["domain"], int(i), k) for k, i in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "domain string, token long, rank int")


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most + 1).collect()
    more = ["", f"There are more rows than the {most} shown."] if len(rows) > most else []
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows[:most]] + more)


def one_line(prefix: str, df: DataFrame, most: int = 200) -> str:
    rows = [r.asDict() for r in df.limit(most + 1).collect()]
    return f"{prefix} {json.dumps(rows[:most], default=str)}" + (f" and more than these {most}" if len(rows) > most else "")


def write_predictions(df: DataFrame, path: str) -> None:
    """JSON lines of user and probability, one a user."""
    df.write.mode("overwrite").json(path)


def write_prediction_object(df: DataFrame, path: str, user: str, value: str) -> int:
    """One JSON object of user to probability, written a user at a time; returns how many. For results that one file can hold."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"predictions": {')
        for r in df.select(user, value).toLocalIterator():
            f.write(("" if not n else ", ") + json.dumps(str(r[0])) + ": " + json.dumps(r[1]))
            n += 1
        f.write("}}")
    return n


def write_report(df: DataFrame, path: str) -> None:
    """A report of a row a feature (such as values out of bounds) as a JSON list."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump([r.asDict() for r in df.toLocalIterator()], f, default=str)


def write_parquet(df: DataFrame, path: str, block_bytes: int = 128 << 20) -> None:
    df.write.mode("overwrite").option("parquet.block.size", block_bytes).parquet(path)
