"""Command line: build, info, query, annotate, features, coaccess, normalize."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandframe.config import load_config
from strandframe.operators import coaccess, validate
from strandframe.operators.intervals import contained_pairs
from strandframe.session import local_session, ship_modules
from strandframe.sources import export, text
from strandframe.sources.normalize import all_to_modkit, nucleosome_csv_rows, raw_file
from strandframe.sources.rawlines import load_raw_lines
from strandframe.sources.store import Store, build_store


def _session() -> SparkSession:
    spark = SparkSession.getActiveSession() or local_session()
    ship_modules(spark)
    return spark


def _build(a: argparse.Namespace) -> None:
    plan = load_config(a.config)
    given = {"store": a.output and Path(a.output), "threshold": a.methylation_threshold, "min_msp": a.min_msp_size}
    print(build_store(_session(), replace(plan, **{k: v for k, v in given.items() if v is not None}), a.sample or None))


def _info(a: argparse.Namespace) -> None:
    import json

    print(json.dumps(Store(_session(), a.store).summary(), indent=2, default=str))


def _query(a: argparse.Namespace) -> None:
    """Prints how many fibers there are; their ids go to a file where one is named."""
    found = Store(_session(), a.store).fibers_at(*text.parse_region(a.region), a.sample).select("fiber_id")
    print(export.write_rows(found.orderBy("fiber_id"), a.out, ["fiber_id"]) if a.out else found.count())


def _annotate(a: argparse.Namespace) -> None:
    print(export.write_csv(Store(_session(), a.store).query_annotation(a.annotation, a.sample, a.layer or None, a.max_regions), a.out))


def _features(a: argparse.Namespace) -> None:
    print(export.write_csv(Store(_session(), a.store).feature_fractions(a.sample or None, a.max_fibers), a.out))


def _prepare(a: argparse.Namespace) -> None:
    spark, out = _session(), Path(a.outdir)
    out.mkdir(parents=True, exist_ok=True)
    sizes = text.chrom_sizes(spark, a.sizes)
    genes, peaks = text.gff_genes(spark, a.genes, sizes, not a.legacy_coordinates), text.bed3(spark, a.peaks)
    kept, stitched = coaccess.prepare_regions(peaks, genes, sizes, a.promoter_size, a.stitch_distance)
    counts = {"peaks": peaks.count(), "genes": genes.count(), "intergenic": export.write_bed3(kept, out / "intergenic_peaks.bed"), "stitched": export.write_bed3(stitched, out / "stitched_regions.bed")}
    export.write_manifest(out, counts | {"inputs": [export.provenance(p) for p in (a.peaks, a.genes, a.sizes)]})
    print(counts)


def _cov(a: argparse.Namespace) -> None:
    spark = _session()
    store = Store(spark, a.store)
    sample = a.sample or store.default_sample
    if sample not in store.samples:
        raise ValueError(f"unknown sample {sample!r}")
    pairs = contained_pairs(text.bed3(spark, a.stitched), text.bed3(spark, a.peaks))
    fire = store.layers["fire_accessibility"].where(F.col("sample") == sample)
    print(export.write_cov(coaccess.coverage(pairs, fire, store.fibers), a.out))


def _object(a: argparse.Namespace) -> None:
    print(export.write_cov_object(coaccess.object_rows(text.cov_bed(_session(), a.cov)), a.out))


def _rank(a: argparse.Namespace) -> None:
    out = Path(a.outdir)
    out.mkdir(parents=True, exist_ok=True)
    pairs, clusters = coaccess.rank_pairs(text.cov_bed(_session(), a.cov), a.threshold, not a.no_distance_correction)
    label = F.when(F.col("is_super"), "Super").otherwise("Typical")
    columns = ["element_a", "element_b", "stitched_id", "corrected", "rank", "status", "n_both", "n_only_b", "n_only_a", "n_neither"]
    print(export.write_rows(pairs.withColumn("status", label).orderBy("rank"), out / "pairs.tsv", columns))
    print(export.write_rows(clusters.withColumn("status", label).orderBy("rank"), out / "clusters.tsv", ["stitched_id", "corrected", "rank", "status", "elements", "element_a", "element_b", "n_both", "n_only_b", "n_only_a", "n_neither"]))


def _validate(a: argparse.Namespace) -> None:
    import json

    spark = _session()
    out = Path(a.outdir)
    out.mkdir(parents=True, exist_ok=True)
    cov = (text.read_lines(spark, a.old_cov), text.read_lines(spark, a.new_cov)) if a.old_cov and a.new_cov else None
    found = validate.validation(
        (text.pair_ranks(spark, a.old_pairs), text.pair_ranks(spark, a.new_pairs)),
        (text.cluster_ranks(spark, a.old_clusters), text.cluster_ranks(spark, a.new_clusters)),
        cov,
        text.read_lines(spark, a.cov_difference) if a.cov_difference else None,
    )
    for name, rows in found.pop("tables").items():
        export.write_rows(rows.orderBy(*rows.columns), out / f"{name}.tsv", rows.columns, header=True)
    (out / "validation_summary.json").write_text(json.dumps(found, indent=2, default=str) + "\n")


def _normalize(a: argparse.Namespace) -> None:
    spark = _session()
    if a.kind == "nucleosomes":
        print(export.write_csv(nucleosome_csv_rows(spark, a.input), a.out))
        return
    loaded = load_raw_lines(raw_file(spark, a.input, "all_tsv"))
    rows = all_to_modkit(loaded)
    print(export.write_rows(rows, a.out, rows.columns, header=True))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("strandframe", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *, to=sub) -> argparse.ArgumentParser:  # noqa: ANN001
        c = to.add_parser(name)
        c.set_defaults(run=run)
        return c

    c = command("build", _build)
    c.add_argument("--config", required=True)
    c.add_argument("--sample", action="append")
    c.add_argument("--output", help="store to write, instead of the configured one")
    c.add_argument("--methylation-threshold", type=float)
    c.add_argument("--min-msp-size", type=int)
    c = command("info", _info)
    c.add_argument("store")
    c = command("query", _query)
    c.add_argument("store")
    c.add_argument("region")
    c.add_argument("--sample")
    c.add_argument("--out")
    c = command("annotate", _annotate)
    for name in ("store", "annotation", "out"):
        c.add_argument(name)
    c.add_argument("--sample")
    c.add_argument("--layer", action="append")
    c.add_argument("--max-regions", type=int)
    c = command("features", _features)
    c.add_argument("store")
    c.add_argument("out")
    c.add_argument("--sample", action="append")
    c.add_argument("--max-fibers", type=int)
    c = command("normalize", _normalize)
    c.add_argument("kind", choices=("nucleosomes", "all"))
    c.add_argument("input")
    c.add_argument("out")
    co = sub.add_parser("coaccess").add_subparsers(required=True)
    c = command("prepare", _prepare, to=co)
    for name in ("peaks", "genes", "sizes", "outdir"):
        c.add_argument(f"--{name}", required=True)
    c.add_argument("--promoter-size", type=int, default=coaccess.PROMOTER_BP)
    c.add_argument("--stitch-distance", type=int, default=coaccess.STITCH_BP)
    c.add_argument("--legacy-coordinates", action="store_true")
    c = command("cov", _cov, to=co)
    for name in ("store", "stitched", "peaks", "out"):
        c.add_argument(f"--{name}", required=True)
    c.add_argument("--sample")
    c = command("object", _object, to=co)
    c.add_argument("--cov", required=True)
    c.add_argument("--out", required=True)
    c = command("rank", _rank, to=co)
    c.add_argument("--cov", required=True)
    c.add_argument("--outdir", required=True)
    c.add_argument("--threshold", type=float, default=coaccess.THRESHOLD)
    c.add_argument("--no-distance-correction", action="store_true")
    c = command("validate", _validate, to=co)
    for name in ("old-pairs", "new-pairs", "old-clusters", "new-clusters", "outdir"):
        c.add_argument(f"--{name}", required=True)
    for name in ("old-cov", "new-cov", "cov-difference"):
        c.add_argument(f"--{name}")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        a.run(a)
    except (ValueError, KeyError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
