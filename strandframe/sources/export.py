"""Writers of single files, provenance and manifests. Files are written from sorted rows that the driver streams."""

from __future__ import annotations

import datetime
import hashlib
import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.sources.text import COV_COLUMNS, smart_open


def format_score(score: float) -> str:
    """Nine significant digits without trailing zeros."""
    return f"{score:.9g}"


def write_rows(df: DataFrame, path: str | Path, columns: list[str], sep: str = "\t", header: bool = False) -> int:
    """Stream the rows, in the frame's order, to one text file; returns how many. The driver holds one partition at a time."""
    n = 0
    with smart_open(path, "wt") as f:
        if header:
            f.write(sep.join(columns) + "\n")
        for r in df.select(*columns).toLocalIterator():
            f.write(sep.join("" if v is None else format_score(v) if isinstance(v, float) else str(v) for v in r) + "\n")
            n += 1
    return n


def write_bed3(df: DataFrame, path: str | Path) -> int:
    return write_rows(df.orderBy("chrom", "start", "end"), path, ["chrom", "start", "end"])


def write_cov(df: DataFrame, path: str | Path) -> int:
    return write_rows(df.orderBy("st_chrom", "el_start", "el_end", "st_start", "st_end", "fiber_id", "fire_score"), path, list(COV_COLUMNS))


def write_csv(df: DataFrame, path: str | Path) -> int:
    return write_rows(df, path, df.columns, ",", True)


def write_cov_object(objects: DataFrame, path: str | Path) -> int:
    """The nested objects as one JSON list, a region at a time."""
    n = 0
    with smart_open(path, "wt") as f:
        f.write("[")
        for r in objects.orderBy("seId").select(F.to_json(F.struct("seId", "enhs"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            f.write((",\n" if n else "\n") + r.j)
            n += 1
        f.write("\n]\n")
    return n


def write_npz(matrices: DataFrame, vector: str, path: str | Path) -> int:
    """A vector column as a matrix with the region ids; for a set of regions that fits the driver."""
    rows = matrices.select("region_id", vector).collect()
    values = [np.array([np.nan if x is None else x for x in r[1]], np.float64) for r in rows]
    np.savez_compressed(path, matrix=np.vstack(values) if values else np.zeros((0, 0)), region_ids=np.array([r[0] for r in rows]))
    return len(rows)


def sha256_file(path: str | Path, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def provenance(path: str | Path) -> dict[str, object]:
    p = Path(path)
    return {"path": str(p), "size_bytes": p.stat().st_size, "sha256": sha256_file(p)}


def write_manifest(folder: str | Path, data: dict, name: str = "manifest.json") -> Path:
    out = Path(folder) / name
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(json.dumps({"created": datetime.datetime.now(datetime.UTC).isoformat(), **data}, indent=2, default=str))
    return out


def folder_inventory(folder: str | Path) -> dict[str, int]:
    """Files of a folder with their sizes."""
    return {str(p.relative_to(folder)): p.stat().st_size for p in sorted(Path(folder).rglob("*")) if p.is_file()}
