"""The store: a folder of Parquet tables partitioned by sample and chromosome, and a metadata file."""

from __future__ import annotations

import datetime
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.config import BuildPlan
from strandframe.operators import access, annotate, features
from strandframe.operators.ordering import numbered_within
from strandframe.schemas import LAYERS, SCHEMA_VERSION, layer
from strandframe.sources import text

PARTITIONS = ["sample", "chrom"]


def _universe(nucleosomes: DataFrame) -> DataFrame:
    """Fibers with their span and a dense number in order of the read id, per chromosome."""
    spans = nucleosomes.groupBy("chrom", "fiber_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return numbered_within(spans, ["chrom"], ["fiber_id"], "fiber_int_id")


def _layer_inputs(spark: SparkSession, files: dict[str, Path], plan: BuildPlan) -> dict[str, DataFrame]:
    out = {"nucleosomes": text.nucleosome_csv(spark, files["nucleosomes"])}
    threshold = F.lit(plan.threshold).cast("float")
    tables: dict[Path, DataFrame] = {}
    for name, code in (("5mC", "m"), ("5hmC", "h")):
        if name in files:
            if files[name] not in tables:
                tables[files[name]] = text.modkit_tsv(spark, files[name])
            rows = tables[files[name]].where(F.col("code") == code)
            # the threshold is compared as a float, as the probabilities are
            out[name] = rows.select("chrom", "fiber_id", "pos", "prob", (F.col("prob") >= threshold).alias("is_methylated"), "ord")
    if "6mA" in files:
        out["6mA"] = text.bed12_single_base(spark, files["6mA"])
    if "msp" in files:
        out["msp"] = text.bed12_intervals(spark, files["msp"], plan.min_msp)
    if "fire_accessibility" in files:
        out["fire_accessibility"] = text.fire_bed(spark, files["fire_accessibility"])
    return out


def build_store(spark: SparkSession, plan: BuildPlan, samples: list[str] | None = None) -> Path:
    """Build the store of a configuration, replacing what is there; returns its folder.

    Calls on fibers without nucleosomes are left out. Each table is sorted by fiber within its partition, so that a look-up reads
    few row groups. All missing inputs are named in one error, an unknown sample raises KeyError.
    """
    plan = plan.only(samples)
    if missing := plan.absent_files():
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))
    root = plan.store
    meta: dict[str, object] = {"schema_version": SCHEMA_VERSION, "genome_version": "unknown", "created": datetime.datetime.now(datetime.UTC).isoformat(), "samples": list(plan.layers)}
    meta |= {"methylation_threshold": plan.threshold, "min_msp_size": plan.min_msp, "max_fiber_span": 100_000}
    meta |= {"coordinate_system": "0-based half-open", "id_encoding": "dense number in order of the read id, per sample and chromosome"}
    meta["layer_sources"] = {s: {layer_: str(p) for layer_, p in files.items()} for s, files in plan.layers.items()}
    for k, (sample, files) in enumerate(plan.layers.items()):
        mode = "append" if k else "overwrite"
        inputs = _layer_inputs(spark, files, plan)
        fibers = _universe(inputs["nucleosomes"]).withColumn("sample", F.lit(sample)).select("sample", "chrom", "fiber_int_id", "fiber_id", "start", "end")
        _write(fibers, root / "fibers", ["fiber_int_id"], mode)
        stored = spark.read.parquet(str(root / "fibers")).where(F.col("sample") == sample).select("chrom", "fiber_id", "fiber_int_id")
        meta[f"n_fibers_{sample}"] = stored.count()
        for name in LAYERS:
            rows = inputs.get(name)
            path = root / layer(name).table
            if rows is None:
                if not k and path.exists():
                    _remove(path)
                continue
            numbered = rows.join(stored, ["chrom", "fiber_id"]).drop("fiber_id").withColumn("sample", F.lit(sample))
            _write(numbered, path, ["fiber_int_id", "ord"], mode if not k or path.exists() else "overwrite")
    if "master" in plan.annotations:
        text.annotation_bed(spark, plan.annotations["master"]).orderBy("ord").write.mode("overwrite").parquet(str(root / "annotations"))
    elif (root / "annotations").exists():
        _remove(root / "annotations")
    (root / "metadata.json").write_text(json.dumps(meta, indent=2))
    return root


def _write(rows: DataFrame, path: Path, order: list[str], mode: str) -> None:
    # a chromosome that holds much is written by several tasks, each a range of its fibers
    rows.repartitionByRange(*PARTITIONS, order[0]).sortWithinPartitions(*PARTITIONS, *order).write.mode(mode).partitionBy(*PARTITIONS).option("compression", "zstd").parquet(str(path))


def _remove(path: Path) -> None:
    import shutil

    shutil.rmtree(path)


class Store:
    """An opened store; its tables are lazy and are pruned by sample and chromosome."""

    def __init__(self, spark: SparkSession, root: str | Path) -> None:
        self.root = Path(root)
        if not (self.root / "fibers").exists():
            raise FileNotFoundError(f"no store at {self.root}")
        self.spark = spark
        self.fibers = spark.read.parquet(str(self.root / "fibers"))
        meta = self.root / "metadata.json"
        self.metadata = json.loads(meta.read_text()) if meta.exists() else {}
        self.layers = {n: spark.read.parquet(str(p)) for n, x in LAYERS.items() if (p := self.root / x.table).exists()}
        notes = self.root / "annotations"
        empty = "annotation string, chrom string, start long, end long, id string, ord long"
        self.annotations = spark.read.parquet(str(notes)) if notes.exists() else spark.createDataFrame([], empty)

    @property
    def samples(self) -> list[str]:
        return sorted(r[0] for r in self.fibers.select("sample").distinct().collect())

    @property
    def default_sample(self) -> str:
        return self.fibers.agg(F.min("sample")).first()[0]

    def chromosomes(self, sample: str) -> list[str]:
        return sorted(r.chrom for r in access.chromosomes(self.fibers).where(F.col("sample") == sample).collect())

    def summary(self) -> dict:
        per = {r.sample: r.n for r in self.fibers.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {"metadata": self.metadata, "fibers": per, "annotations": {r.annotation: r.n_regions for r in access.annotation_types(self.annotations).collect()}, "layers": sorted(self.layers)}

    def fibers_at(self, chrom: str, start: int, end: int, sample: str | None = None) -> DataFrame:
        return access.fibers_at(self.fibers, chrom, start, end, sample or self.default_sample)

    def calls(self, layer_name: str, fiber_id: str, chrom: str, sample: str | None = None) -> DataFrame:
        """Calls of a layer on a fiber, in input order; none where the layer isn't stored."""
        known = layer(layer_name)
        if layer_name not in self.layers:
            return self.spark.createDataFrame([], f"{known.fields}, sample string, chrom string")
        return access.calls_of_fiber(self.layers[layer_name], self.fibers, fiber_id, chrom, sample or self.default_sample)

    def fiber_chromosome(self, fiber_id: str, sample: str | None = None) -> str | None:
        row = access.fiber_lookup(self.fibers.where((F.col("fiber_id") == fiber_id) & (F.col("sample") == (sample or self.default_sample)))).first()
        return row.chrom if row else None

    def chromosome_data(self, sample: str, chrom: str, layer_names: list[str] | None = None) -> dict[str, DataFrame] | None:
        """Fibers and layers of a chromosome, cached for repeated use; null where it has no fibers."""
        here = lambda t: t.where((F.col("sample") == sample) & (F.col("chrom") == chrom))
        if here(self.fibers).isEmpty():
            return None
        names = layer_names or ["nucleosomes"]
        return {"fibers": annotate.sane_fibers(here(self.fibers)).cache()} | {n: here(self.layers[n]).cache() for n in names if n in self.layers}

    def query_annotation(self, annotation: str, sample: str | None = None, feature_types: list[str] | None = None, max_regions: int | None = None) -> DataFrame:
        return annotate.query_annotation(self.annotations, self.fibers, self.layers, annotation, sample or self.default_sample, feature_types, max_regions)

    def query_by_id(self, region_id: str, sample: str | None = None, feature_types: list[str] | None = None) -> DataFrame:
        return annotate.query_by_id(self.annotations, self.fibers, self.layers, region_id, sample or self.default_sample, feature_types)

    def compare_samples(self, annotation: str, feature_types: list[str] | None = None, max_regions: int | None = None) -> DataFrame:
        return annotate.compare_samples(self.annotations, self.fibers, self.layers, annotation, feature_types, max_regions)

    def feature_fractions(self, samples: list[str] | None = None, max_fibers_per_chrom: int | None = None) -> DataFrame:
        if samples and (unknown := sorted(set(samples) - set(self.samples))):
            raise ValueError(f"unknown samples {unknown}")
        f = self.fibers.where(F.col("sample").isin(samples)) if samples else self.fibers
        return features.fiber_fractions(f, self.layers, max_fibers_per_chrom)

    def record_counts(self) -> DataFrame:
        return features.record_counts(self.fibers, self.layers, self.annotations)
