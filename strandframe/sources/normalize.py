"""Normalisers of caller outputs: nucleosome blocks, block BED, "all" tables, and header checks of alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.sources.rawlines import load_raw_lines
from strandframe.sources.text import all_header, read_lines

#: Share of inner blocks of a row that may be other than one base in single-base files (fixed value).
SINGLE_BASE_SLACK = 0.05
ALL_REQUIRED = ("ct", "st", "en", "fiber", "strand", "ref_msp_starts", "ref_msp_lengths", "fire", "ref_m6a", "m6a_qual", "ref_5mC", "5mC_qual")


def flatten_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks of records as rows with the gap to the block before: key, chrom, fiber_id, start, end, width, linker.

    ``blocks`` has ``key`` (one value an input line), chrom, fiber_id, start, sizes, starts. Blocks of no size are skipped; the first
    block of a line has no linker. The gap is taken within the line's own array, without a shuffle.
    """
    zipped = F.filter(F.arrays_zip(F.col("sizes").alias("w"), F.col("starts").alias("o")), lambda b: b["w"] != 0)
    rows = blocks.select(key, "chrom", "fiber_id", F.col("start").alias("_s"), zipped.alias("b"))
    before = lambda b, i: F.when(i > 0, F.element_at("b", i)["o"] + F.element_at("b", i)["w"])
    linked = F.transform("b", lambda b, i: F.struct(b["o"].alias("o"), b["w"].alias("w"), (b["o"] - before(b, i)).alias("linker")))
    rows = rows.select(key, "chrom", "fiber_id", "_s", F.inline(linked))
    start = F.col("_s") + F.col("o")
    return rows.select(key, "chrom", "fiber_id", start.alias("start"), (start + F.col("w")).alias("end"), F.col("w").alias("width"), "linker")


def raw_file(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Lines of one file in the shape of the raw-line loader: line numbers follow the file's order."""
    lines = read_lines(spark, path).withColumn("_o", F.monotonically_increasing_id())
    # the order of lines is that of partitions; numbers are dense within a file
    numbered = lines.withColumn("line_no", F.row_number().over(Window.orderBy("_o")).cast("long"))
    return numbered.select(F.col("line_no").alias("rec_id"), F.lit(fmt).alias("fmt"), F.lit(str(path)).alias("file_name"), "line_no", F.col("value").alias("line"))


def valid_or_raise(loaded: DataFrame) -> DataFrame:
    """The loaded rows; reading an invalid one raises with its file, line and reason."""
    why = F.concat(F.col("file_name"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), F.col("reason"))
    # as a filter, so that no pruning of columns takes the check away
    return loaded.where(F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(why).cast("boolean")))


def nucleosome_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the nucleosome CSV from a BED12 file of nucleosome blocks; an invalid line raises."""
    loaded = valid_or_raise(load_raw_lines(raw_file(spark, path, "block_bed")))
    flat = flatten_blocks(loaded.withColumnRenamed("name", "fiber_id"), "rec_id")
    return flat.select("chrom", F.col("fiber_id").alias("read_id"), F.col("start").alias("nuc_start"), F.col("end").alias("nuc_end"), "width", F.col("linker").alias("linker_dist"))


def normalized_block_bed(loaded: DataFrame, expected: str = "intervals") -> DataFrame:
    """Valid block records as BED12 columns, whichever of the three widths they came in.

    With ``expected`` 'single_base' a record raises whose inner blocks are other than one base long in more than 5 %. Inner blocks are all
    but the first and last of more than two.
    """
    if expected not in ("intervals", "single_base"):
        raise ValueError("expected is 'intervals' or 'single_base'")
    rows = loaded.where("reason is null and fmt = 'block_bed'")
    inner = F.when(F.size("sizes") > 2, F.slice("sizes", 2, F.size("sizes") - 2)).otherwise(F.col("sizes"))
    if expected == "single_base":
        other = F.size(F.filter(inner, lambda x: x != 1))
        ok = other <= SINGLE_BASE_SLACK * F.size(inner)
        rows = rows.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("not single bases: line "), F.col("line_no").cast("string"))).cast("boolean")))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("chrom", "start", "end", "name", "score", "strand", "thick_start", "thick_end", F.coalesce("rgb", F.lit("0")).alias("rgb"), F.size("sizes").alias("block_count"), joined("sizes").alias("sizes"), joined("starts").alias("starts"))


def block_bed_report(loaded: DataFrame) -> DataFrame:
    """Counts of a load: records, valid, invalid, blocks, inner blocks and inner single-base blocks."""
    inner = F.when(F.size("sizes") > 2, F.slice("sizes", 2, F.size("sizes") - 2)).otherwise(F.col("sizes"))
    n = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    ok = F.col("reason").isNull()
    return loaded.where("fmt = 'block_bed'").agg(
        F.count(F.lit(1)).alias("records"), n(ok.cast("long"), "valid"), n((~ok).cast("long"), "invalid"),
        n(F.when(ok, F.size("sizes")), "blocks"), n(F.when(ok, F.size(inner)), "inner_blocks"), n(F.when(ok, F.size(F.filter(inner, lambda x: x == 1))), "inner_single_base"),
    )


def inspect_all(path: str, loaded: DataFrame, max_records: int | None = 1000) -> dict[str, int]:
    """Counts over the first records of an "all" file; raises where a required column is missing, or a record is invalid."""
    if missing := [c for c in ALL_REQUIRED if c not in all_header(path)]:
        raise ValueError(f"{path} lacks the columns {missing}")
    rows = loaded.where("fmt = 'all_tsv'").orderBy("line_no")
    rows = valid_or_raise(rows if max_records is None else rows.limit(max_records))
    n = lambda c: F.coalesce(F.sum(F.size(F.filter(c, lambda x: x.isNotNull() & (x >= 0)))), F.lit(0)).cast("long")
    agg = rows.agg(F.count("rec_id").alias("records"), n("ref_m5c").alias("m5c_calls"), n("ref_m6a").alias("m6a_calls"), n("ref_msp_starts").alias("msp"), n("fire").alias("fire_scores"))
    return agg.first().asDict()


def all_to_modkit(loaded: DataFrame) -> DataFrame:
    """5mC calls of valid "all" records as columns of the modkit table: read, position, chromosome, probability text, code.

    Positions that are missing or negative are skipped. The probability is the byte over 255, printed to six decimals.
    """
    pairs = F.arrays_zip(F.col("ref_m5c").alias("p"), F.col("m5c_qual").alias("q"))
    rows = loaded.where("reason is null and fmt = 'all_tsv'").select("chrom", F.col("name").alias("read_id"), F.col("strand").alias("strand"), F.inline(pairs)).where("p >= 0 and q is not null")
    return rows.select("read_id", F.col("p").alias("ref_position"), "chrom", F.format_string("%.6f", F.col("q") / 255.0).alias("prob"), F.lit("m").alias("code"))


def check_sam(lines: DataFrame, max_records: int = 1000) -> dict[str, bool]:
    """Rules on SAM text (``value``, in order): coordinate order, chr contigs, and MM and ML tags among the first records."""
    head = lines.where("startswith(value, '@')").agg(
        F.max(F.col("value").rlike(r"^@HD\t.*SO:coordinate")).alias("sorted"), F.max(F.col("value").rlike(r"^@SQ\t.*SN:chr")).alias("chr_contigs")
    ).first()
    records = lines.where("not startswith(value, '@') and value <> ''").limit(max_records)
    tags = records.agg(F.max(F.col("value").rlike(r"\tMM:Z:")).alias("mm"), F.max(F.col("value").rlike(r"\tML:B:C")).alias("ml")).first()
    return {"coordinate_sorted": bool(head.sorted), "chr_contigs": bool(head.chr_contigs), "mm_tags": bool(tags.mm), "ml_tags": bool(tags.ml)}
