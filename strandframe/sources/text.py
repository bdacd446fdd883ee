"""Readers of the text formats; each gives a DataFrame in the schemas of the store.

Spark picks a codec by the file's suffix, so a reader first looks at the first two bytes of a file
(on the driver) and reads a file whose suffix lies by its content.
"""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.schemas import MISSING_LINKER
from strandframe.session import broadcast_if_small

_GZIP = b"\x1f\x8b"


def is_gzip(path: str | Path) -> bool:
    with open(path, "rb") as f:
        return f.read(2) == _GZIP


def smart_open(path: str | Path, mode: str = "rt"):  # noqa: ANN201
    """Open text on the driver: gzip by magic bytes when reading, by suffix when writing."""
    write = "w" in mode or "a" in mode
    packed = str(path).endswith(".gz") if write else is_gzip(path)
    return gzip.open(path, mode) if packed else open(path, mode)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0).to_pylist():
            text = gzip.decompress(content) if content[:2] == _GZIP else content
            lines = text.decode().splitlines()
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])


def read_lines(spark: SparkSession, path: str | Path) -> DataFrame:
    """Lines of a text file (``value``), whatever its suffix says of its compression.

    A file whose suffix is honest is split over tasks (plain) or streamed (gzip) by Spark. A mislabelled one is read whole by one
    task: gzip can't be split in any case.
    """
    p = Path(path)
    if p.is_file() and is_gzip(p) != p.name.endswith(".gz"):
        return spark.read.format("binaryFile").load(str(p)).select("content").mapInArrow(_unpacked, "value string")
    return spark.read.text(str(path))


def _tabs(lines: DataFrame) -> DataFrame:
    return lines.select(F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t").alias("c"))


def _at(i: int) -> Column:
    return F.get("c", F.lit(i))


def _long(c: Column) -> Column:
    return c.try_cast("long")


def nucleosome_csv(spark: SparkSession, path: str | Path) -> DataFrame:
    """chrom, fiber_id, start, end, width, linker (-1 where missing) of a nucleosome CSV with a header."""
    lines = read_lines(spark, path)
    head = lines.first()
    if head is None:
        raise ValueError(f"{path} is empty")
    names = head[0].strip().split(",")
    rows = lines.where(F.col("value") != head[0]).select(F.split("value", ",").alias("c"))
    col = lambda n: _at(names.index(n)) if n in names else F.lit(None)
    linker = F.when(F.lower(F.trim(col("linker_dist"))) != "nan", col("linker_dist")).try_cast("float") if "linker_dist" in names else F.lit(None).cast("float")
    out = rows.select(col("chrom").alias("chrom"), col("read_id").alias("fiber_id"), _long(col("nuc_start")).alias("start"), _long(col("nuc_end")).alias("end"), _long(col("width")).alias("width"), F.coalesce(linker, F.lit(MISSING_LINKER).cast("float")).alias("linker"))
    return out.where("start is not null and end is not null").withColumn("ord", F.monotonically_increasing_id())


def modkit_tsv(spark: SparkSession, path: str | Path) -> DataFrame:
    """chrom, fiber_id, pos, prob, code of a modkit table; short or broken rows and negative positions are left out."""
    rows = _tabs(read_lines(spark, path)).where(F.size("c") >= 14)
    out = rows.select(_at(3).alias("chrom"), _at(0).alias("fiber_id"), _long(_at(2)).alias("pos"), _at(12).try_cast("float").alias("prob"), F.rtrim(_at(13)).alias("code"))
    return out.where("pos >= 0 and prob is not null and not isnan(prob) and code in ('m', 'h')").withColumn("ord", F.monotonically_increasing_id())


def _blocks(spark: SparkSession, path: str | Path) -> DataFrame:
    numbers = lambda i: F.transform(F.split(F.regexp_replace(_at(i), ",$", ""), ","), lambda x: x.try_cast("long"))
    rows = _tabs(read_lines(spark, path)).where(F.size("c") >= 12)
    rows = rows.select(_at(0).alias("chrom"), _long(_at(1)).alias("first"), _at(3).alias("fiber_id"), numbers(10).alias("sizes"), numbers(11).alias("offsets"))
    return rows.where("first is not null").withColumn("ord", F.monotonically_increasing_id())


def bed12_single_base(spark: SparkSession, path: str | Path) -> DataFrame:
    """chrom, fiber_id, pos of the inner blocks (the first and last are boundaries); sizes are ignored."""
    inner = F.slice("offsets", 2, F.greatest(F.size("offsets") - 2, F.lit(0)))
    return _blocks(spark, path).select("chrom", "fiber_id", "ord", "first", F.explode(inner).alias("o")).where("o is not null").select("chrom", "fiber_id", (F.col("first") + F.col("o")).alias("pos"), "ord")


def inner_blocks(rows: DataFrame, min_size: int = 0) -> DataFrame:
    """start, end and width of the blocks but the first and last of each row's ``sizes`` and ``offsets`` from ``first``; its other columns stay."""
    inner = F.slice(F.arrays_zip("sizes", "offsets"), 2, F.greatest(F.least(F.size("sizes"), F.size("offsets")) - 2, F.lit(0)))
    others = [c for c in rows.columns if c not in ("sizes", "offsets", "first")]
    out = rows.select(*others, "first", F.inline(inner)).where((F.col("sizes") >= min_size) & F.col("offsets").isNotNull())
    start = F.col("first") + F.col("offsets")
    return out.select(*others, start.alias("start"), (start + F.col("sizes")).alias("end"), F.col("sizes").alias("width"))


def bed12_intervals(spark: SparkSession, path: str | Path, min_size: int = 0) -> DataFrame:
    """chrom, fiber_id, start, end, width of the inner blocks of at least ``min_size`` bases."""
    return inner_blocks(_blocks(spark, path), min_size).select("chrom", "fiber_id", "start", "end", "width", "ord")


def fire_bed(spark: SparkSession, path: str | Path) -> DataFrame:
    """chrom, fiber_id, start, end, width, score, haplotype; blank, comment, short and broken rows are left out."""
    rows = read_lines(spark, path).where("trim(value) <> '' and not startswith(ltrim(value), '#')").select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("c")).where(F.size("c") >= 10)
    out = rows.select(_at(0).alias("chrom"), _at(3).alias("fiber_id"), _long(_at(1)).alias("start"), _long(_at(2)).alias("end"), _at(9).try_cast("double").alias("score"), F.coalesce(_at(10), F.lit("UNK")).alias("haplotype"))
    return out.where("start is not null and end >= start and score is not null").withColumn("width", F.col("end") - F.col("start")).withColumn("ord", F.monotonically_increasing_id())


def annotation_type(ident: Column) -> Column:
    """An id without its trailing number."""
    return F.regexp_replace(ident, "_[0-9]+$", "")


def annotation_bed(spark: SparkSession, path: str | Path) -> DataFrame:
    """annotation, chrom, start, end, id, ord of a BED4 file, in file order."""
    rows = _tabs(read_lines(spark, path)).withColumn("ord", F.monotonically_increasing_id()).where(F.size("c") >= 4)
    out = rows.select(annotation_type(_at(3)).alias("annotation"), _at(0).alias("chrom"), _long(_at(1)).alias("start"), _long(_at(2)).alias("end"), _at(3).alias("id"), "ord")
    return out.where("start is not null and end is not null")


def _strict(rows: DataFrame, ok: Column, what: str, path: str | Path) -> DataFrame:
    """The rows, raising with the line where one is not ``ok``."""
    bad = F.raise_error(F.concat(F.lit(f"{path}: {what}: "), F.coalesce(F.concat_ws("\t", "c"), F.lit(""))))
    return rows.withColumn("c", F.when(F.coalesce(ok, F.lit(False)), F.col("c")).otherwise(bad.cast("array<string>")))


def bed3(spark: SparkSession, path: str | Path) -> DataFrame:
    """chrom, start, end, sorted; blank and comment lines are skipped, a broken line raises. Repeated rows are kept."""
    rows = _tabs(read_lines(spark, path).where("trim(value) <> '' and not startswith(value, '#')"))
    ok = (F.size("c") >= 3) & _long(_at(1)).isNotNull() & (_long(_at(2)) >= _long(_at(1)))
    rows = _strict(rows, ok, "not a BED3 line", path)
    return rows.select(_at(0).alias("chrom"), _at(1).cast("long").alias("start"), _at(2).cast("long").alias("end")).orderBy("chrom", "start", "end")


def chrom_sizes(spark: SparkSession, path: str | Path) -> DataFrame:
    """chrom and size; of a chromosome listed twice the later line holds. Raises on a broken line or an empty file."""
    rows = read_lines(spark, path).where("trim(value) <> ''").withColumn("ord", F.monotonically_increasing_id()).select(F.split(F.trim("value"), r"\s+").alias("c"), "ord")
    rows = _strict(rows, (F.size("c") >= 2) & (_long(_at(1)) > 0), "not a chromosome size", path)
    out = rows.select(_at(0).alias("chrom"), _at(1).cast("long").alias("size"), "ord").groupBy("chrom").agg(F.max_by("size", "ord").alias("size"))
    if out.isEmpty():
        raise ValueError(f"{path} names no chromosome")
    return out


def gff_attributes(text: Column) -> Column:
    """Attributes of GFF3 (k=v;) and GTF (k "v";) text as a map; of a repeated key the last holds."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    pair = lambda x: F.struct(F.regexp_extract(x, r"^([^=\s]+)", 1).alias("k"), F.trim(F.regexp_replace(F.regexp_replace(x, r"^[^=\s]+(\s*=\s*|\s+)?", ""), r'^"|"$', "")).alias("v"))
    pairs = F.transform(parts, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def gff_genes(spark: SparkSession, path: str | Path, sizes: DataFrame, one_based: bool = True) -> DataFrame:
    """Blocking genes: chrom, start, end, strand, gene_type, gene_name, cut to their chromosome; empty ones are left out.

    Rows of nine columns whose feature is a gene on a known chromosome; lncRNA and pseudogenes don't block. With
    ``one_based`` false the start is taken as it stands (the legacy mode).
    """
    rows = _tabs(read_lines(spark, path).where("not startswith(value, '#')")).where((F.size("c") == 9) & (_at(2) == "gene"))
    rows = rows.select(_at(0).alias("chrom"), _long(_at(3)).alias("a"), _long(_at(4)).alias("b"), _at(6).alias("strand"), gff_attributes(_at(8)).alias("m")).join(broadcast_if_small(sizes, ["chrom"]), "chrom")
    kind = F.coalesce(F.col("m")["gene_type"], F.col("m")["gene_biotype"], F.lit(""))
    rows = rows.withColumn("gene_type", kind).withColumn("gene_name", F.col("m")["gene_name"]).where((F.col("gene_type") != "lncRNA") & ~F.lower("gene_type").endswith("pseudogene"))
    start = F.greatest(F.col("a") - (1 if one_based else 0), F.lit(0))
    return rows.select("chrom", start.alias("start"), F.least("b", "size").alias("end"), "strand", "gene_type", "gene_name").where("end > start")


def strand_bed(spark: SparkSession, path: str | Path) -> DataFrame:
    """chrom, start, end, id, strand (1, -1, 0), tss (-1 where unread), gene of a BED file of six or more columns."""
    rows = _tabs(read_lines(spark, path)).where(F.size("c") >= 6)
    strand = F.when(_at(5).isin("+", "1"), 1).when(_at(5).isin("-", "-1"), -1).otherwise(0)
    out = rows.select(_at(0).alias("chrom"), _long(_at(1)).alias("start"), _long(_at(2)).alias("end"), _at(3).alias("id"), strand.alias("strand"), F.coalesce(_long(_at(6)), F.lit(-1)).alias("tss"), F.coalesce(_at(7), F.lit(".")).alias("gene"))
    return out.where("start is not null and end is not null")


def all_header(path: str | Path) -> list[str]:
    """Column names of an "all" table, without the leading '#'."""
    with smart_open(path) as f:
        return [c.removeprefix("#") for c in f.readline().rstrip("\r\n").split("\t")]


COV_COLUMNS = ("el_chrom", "el_start", "el_end", "st_chrom", "st_start", "st_end", "fiber_id", "fire_score", "overlap_bp")


def cov_bed(spark: SparkSession, path: str | Path) -> DataFrame:
    """The nine coverage columns; a line of another width or with broken numbers raises."""
    rows = _tabs(read_lines(spark, path).where("trim(value) <> ''"))
    kinds = ("string", "long", "long", "string", "long", "long", "string", "double", "long")
    numbers = [_at(i).try_cast(k).isNotNull() for i, k in enumerate(kinds) if k != "string"]
    ok = F.size("c") == 9
    for n in numbers:
        ok = ok & n
    rows = _strict(rows, ok, "not a coverage line", path)
    return rows.select(*[_at(i).try_cast(k).alias(n) for i, (k, n) in enumerate(zip(kinds, COV_COLUMNS, strict=True))])


def pair_ranks(spark: SparkSession, path: str | Path) -> DataFrame:
    """element_a, element_b, stitched_id, score, rank, is_super of a ranked pair table with a header; short lines are left out."""
    rows = _tabs(read_lines(spark, path)).where(F.size("c") >= 5)
    out = rows.select(_at(0).alias("element_a"), _at(1).alias("element_b"), _at(2).alias("stitched_id"), _at(3).try_cast("double").alias("score"), _long(_at(4)).alias("rank"), (F.coalesce(_at(5), F.lit("")) == "Super").alias("is_super"))
    return out.where("score is not null and rank is not null").withColumn("ord", F.monotonically_increasing_id())


def cluster_ranks(spark: SparkSession, path: str | Path) -> DataFrame:
    """stitched_id, score, rank, is_super and the four counts where given; a region listed twice raises."""
    rows = _tabs(read_lines(spark, path)).where(F.size("c") >= 4)
    counts = [_long(_at(6 + i)).alias(n) for i, n in enumerate(("n_both", "n_only_b", "n_only_a", "n_neither"))]
    out = rows.select(_at(0).alias("stitched_id"), _at(1).try_cast("double").alias("score"), _long(_at(2)).alias("rank"), (_at(3) == "Super").alias("is_super"), *counts).where("score is not null")
    per = out.groupBy("stitched_id").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*[c for c in out.columns if c != "stitched_id"])).alias("r"))
    once = F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("listed twice: "), F.col("stitched_id"))).cast("boolean"))
    return per.where(once).select("stitched_id", "r.*")


OBJECT_SCHEMA = "seId string, enhs array<struct<enhId string, fibers array<double>>>"


def cov_object(spark: SparkSession, path: str | Path) -> DataFrame:
    """Nested coverage objects of a JSON file."""
    return spark.read.schema(OBJECT_SCHEMA).json(str(path), multiLine=True)


def parse_gnu_time(path: str | Path) -> dict[str, int | float | str]:
    """Entries of a GNU time -v report; numbers as numbers."""
    out: dict[str, int | float | str] = {}
    for line in Path(path).read_text().splitlines():
        key, sep, value = line.strip().partition(": ")
        if not sep:
            continue
        for kind in (int, float):
            try:
                out[key] = kind(value)
                break
            except ValueError:
                continue
        else:
            out[key] = value
    return out


def parse_region(text: str) -> tuple[str, int, int]:
    """chrom:start-end, with or without commas in the numbers."""
    m = re.fullmatch(r"\s*([^:\s]+):([\d,]+)-([\d,]+)\s*", text)
    if not m:
        raise ValueError(f"not a region: {text!r}")
    return m[1], int(m[2].replace(",", "")), int(m[3].replace(",", ""))


def read_json(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())
