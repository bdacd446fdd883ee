"""The store's tables (fibers, layers, annotations, genes), derived from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.session import table


def spans(spark: SparkSession, d: str, name: str, order: str, linker: bool) -> DataFrame:
    t = table(spark, d, name).where("starts is not null and ends is not null and ends > starts")
    extra = [F.col("linkers").cast("float").alias("linker")] if linker else []
    return t.select("sample", "chrom", "fiber_int_id", F.col("starts").alias("start"), F.col("ends").alias("end"), (F.col("ends") - F.col("starts")).alias("width"), *extra, F.col(order).alias("ord"))


def fiber_spans(spark: SparkSession, d: str) -> DataFrame:
    n = spans(spark, d, "nucleosomes", "nuc_id", True)
    return n.groupBy("sample", "chrom", "fiber_int_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def fibers(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "fiber_id_table").groupBy("sample", "chrom", "fiber_int_id").agg(F.min(F.trim("fiber_id")).alias("fiber_id"))
    name = F.coalesce("fiber_id", F.concat(F.lit("fiber_"), F.col("fiber_int_id").cast("string")))
    return fiber_spans(spark, d).join(ids, ["sample", "chrom", "fiber_int_id"], "left").select("sample", "chrom", "fiber_int_id", name.alias("fiber_id"), "start", "end")


def _record_fibers(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "fiber_id_table").select("sample", F.col("chrom").alias("ct"), F.trim("fiber_id").alias("fiber"), "fiber_int_id").distinct()
    return table(spark, d, "all_records").join(ids, ["sample", "ct", "fiber"])


def _ints(c: str) -> Column:
    return F.transform(F.split(c, ","), lambda x: x.try_cast("long"))


def layers(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    r = _record_fibers(spark, d)
    m6a = r.select("sample", F.col("ct").alias("chrom"), "fiber_int_id", F.explode(_ints("ref_m6a")).alias("pos"), F.col("all_id").alias("ord")).where("pos >= 0")
    scores = F.transform(F.split("fire", ","), lambda x: F.when(F.lower(x) != "nan", x.try_cast("double")))
    blocks = F.arrays_zip(_ints("ref_msp_starts").alias("start"), _ints("ref_msp_lengths").alias("width"), scores.alias("score"))
    fire = r.select("sample", F.col("ct").alias("chrom"), "fiber_int_id", F.col("hp").alias("haplotype"), F.inline(blocks), F.col("all_id").alias("ord"))
    fire = fire.where("start >= 0 and width >= 0 and score is not null").withColumn("end", F.col("start") + F.col("width"))
    return {
        "nucleosomes": spans(spark, d, "nucleosomes", "nuc_id", True),
        "5mC": table(spark, d, "m5c").select("sample", "chrom", "fiber_int_id", "pos", "is_methylated", F.col("call_id").alias("ord")),
        "6mA": m6a,
        "msp": spans(spark, d, "msp", "msp_id", False),
        "fire_accessibility": fire,
    }


def annotations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cov_bed")
    both = c.select(F.lit("Stitched").alias("annotation"), F.col("st_chrom").alias("chrom"), F.col("st_start").alias("start"), F.col("st_end").alias("end"))
    both = both.unionByName(c.select(F.lit("Element").alias("annotation"), F.col("el_chrom").alias("chrom"), F.col("el_start").alias("start"), F.col("el_end").alias("end")))
    w = Window.partitionBy("annotation").orderBy("chrom", "start", "end")
    k = F.row_number().over(w).cast("long")
    out = both.where("chrom is not null and start is not null and end is not null").distinct().withColumn("k", k)
    ident = F.concat(F.col("annotation"), F.lit("_"), F.col("k").cast("string"))
    return out.select("annotation", "chrom", "start", "end", ident.alias("id"), (2 * F.col("k") + F.when(F.col("annotation") == "Element", 1).otherwise(0)).cast("long").alias("ord"))


def peaks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cov_bed")
    return c.select(F.col("el_chrom").alias("chrom"), F.col("el_start").alias("start"), F.col("el_end").alias("end")).distinct()


def genes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    start = (F.col("s_suppkey") * 150131) % 9_000_000
    return s.select(
        F.concat(F.lit("chr"), (F.col("s_suppkey") % 6 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + 1200).alias("end"), F.when(F.col("s_nationkey") % 2 == 0, "+").otherwise("-").alias("strand")
    ).where("s_suppkey % 7 <> 0")


def chrom_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Each chromosome with the last end that an element or a region has on it."""
    c = table(spark, d, "cov_bed")
    ends = c.select(F.col("el_chrom").alias("chrom"), F.col("el_end").alias("e")).unionByName(c.select(F.col("st_chrom").alias("chrom"), F.col("st_end").alias("e")))
    return ends.where("chrom is not null").groupBy("chrom").agg(F.max("e").alias("size"))


CTES = {
    "nuc": "nuc as (select sample, chrom, fiber_int_id, starts s, ends e, ends - starts w, linkers::float linker from nucleosomes where ends > starts)",
    "mspl": "mspl as (select sample, chrom, fiber_int_id, starts s, ends e, ends - starts w from msp where ends > starts)",
    "span": "span as (select sample, chrom, fiber_int_id, min(s) fs, max(e) fe from nuc group by 1, 2, 3)",
    "fib": "fib as (select sample, chrom, fiber_int_id, coalesce(fiber_id, 'fiber_' || fiber_int_id) fiber_id, fs, fe from span left join (select sample, chrom, fiber_int_id, min(trim(fiber_id)) fiber_id from fiber_id_table group by 1, 2, 3) using (sample, chrom, fiber_int_id))",
    "sane": "sane as (select * from fib where fe - fs between 0 and 100000)",
    "rec": "rec as (select r.*, i.fiber_int_id from all_records r join (select distinct sample, chrom, trim(fiber_id) fiber, fiber_int_id from fiber_id_table) i on i.sample = r.sample and i.chrom = r.ct and i.fiber = r.fiber)",
    "m6": "m6 as (select sample, ct chrom, fiber_int_id, pos from (select *, try_cast(unnest(string_split(ref_m6a, ',')) as bigint) pos from rec) where pos >= 0)",
    "fire": "firel as (select sample, ct chrom, fiber_int_id, s, s + w e, w, score from (select sample, ct, fiber_int_id, try_cast(unnest(string_split(ref_msp_starts, ',')) as bigint) s, try_cast(unnest(string_split(ref_msp_lengths, ',')) as bigint) w, try_cast(nullif(lower(unnest(string_split(fire, ','))), 'nan') as double) score from rec) where s >= 0 and w >= 0 and score is not null)",
    "reg": """ann as (select distinct 'Stitched' annotation, st_chrom chrom, st_start rs, st_end re from cov_bed union select distinct 'Element', el_chrom, el_start, el_end from cov_bed),
reg as (select annotation, chrom, rs, re, annotation || '_' || k id, 2 * k + case annotation when 'Element' then 1 else 0 end ord
  from (select *, row_number() over (partition by annotation order by chrom, rs, re) k from ann where chrom is not null and rs is not null and re is not null))""",
    "peak": "peak as (select distinct el_chrom chrom, el_start s, el_end e from cov_bed)",
    "size": "csize as (select chrom, max(e) size from (select el_chrom chrom, el_end e from cov_bed union all select st_chrom, st_end from cov_bed) where chrom is not null group by 1)",
    "gene": "gene as (select 'chr' || (s_suppkey % 6 + 1) chrom, (s_suppkey * 150131) % 9000000 s, (s_suppkey * 150131) % 9000000 + 1200 e, case when s_nationkey % 2 = 0 then '+' else '-' end strand from supplier where s_suppkey % 7 <> 0)",
}


def with_(*names: str) -> str:
    """A WITH clause of the named tables."""
    return "with " + ",\n".join(CTES[n] for n in names)
