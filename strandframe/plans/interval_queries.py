"""Queries of the interval operators over the whole test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators import access, annotate, coaccess, features, intervals, signal, validate
from strandframe.operators.intervals import Overlap
from strandframe.plans import interval_tables as t
from strandframe.plans.interval_tables import with_
from strandframe.session import table

QUERIES, ORACLES = {}, {}
ONE_REGION = ("chr1", 3_000_000, 3_050_000)


def query(sql: str | None = None):
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str, digits: int = 5) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


@query(with_("nuc", "span") + "select sample, chrom, fiber_int_id, fs as start, fe as \"end\" from span")
def fiber_spans(spark: SparkSession, d: str) -> DataFrame:
    return t.fiber_spans(spark, d)


@query("select sample, chrom, fiber_id, row_number() over (partition by sample, chrom order by fiber_id) - 1 fiber_int_id from (select distinct sample, chrom, trim(fiber_id) fiber_id from fiber_id_table)")
def fiber_int_ids(spark: SparkSession, d: str) -> DataFrame:
    return access.fiber_int_ids(table(spark, d, "fiber_id_table").select("sample", "chrom", F.trim("fiber_id").alias("fiber_id")))


@query("select sample, trim(fiber_id) fiber_id, max(chrom) chrom from fiber_id_table group by 1, 2")
def fiber_lookup(spark: SparkSession, d: str) -> DataFrame:
    return access.fiber_lookup(table(spark, d, "fiber_id_table").select("sample", "chrom", F.trim("fiber_id").alias("fiber_id")))


@query(with_("nuc", "span", "fib", "sane", "reg") + "select ord, sample, fiber_int_id from sane join reg on reg.chrom = sane.chrom and fe > rs and fs < re")
def region_lookup_strict(spark: SparkSession, d: str) -> DataFrame:
    return access.overlapping_fibers(t.fibers(spark, d), t.annotations(spark, d), Overlap.STRICT).select("ord", "sample", "fiber_int_id")


@query(with_("nuc", "span", "fib", "sane", "reg") + "select ord, sample, fiber_int_id from sane join reg on reg.chrom = sane.chrom and fe >= rs and fs <= re")
def region_overlap_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return access.overlapping_fibers(t.fibers(spark, d), t.annotations(spark, d)).select("ord", "sample", "fiber_int_id")


@query(with_("nuc", "span", "fib", "sane", "reg") + "select ord, sample, fiber_int_id from sane join reg on reg.chrom = sane.chrom and fe >= rs and fs <= re")
def region_overlap_binned(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs by the bin join, which large region tables take."""
    f = annotate.sane_fibers(t.fibers(spark, d)).select("sample", "chrom", "fiber_int_id", F.col("start").alias("fs"), F.col("end").alias("fe"))
    r = t.annotations(spark, d).select("chrom", "ord", F.col("start").alias("rs"), F.col("end").alias("re"))
    return intervals.range_join(f, r, ["chrom"], Overlap.INCLUSIVE, broadcast=False).select("ord", "sample", "fiber_int_id")


@query(
    with_("nuc", "span", "fib", "sane", "reg")
    + "select ord, sample, fiber_int_id, round(coverage, 6) coverage from (select *, (least(fe, re) - greatest(fs, rs))::double / (re - rs) coverage from sane join reg on reg.chrom = sane.chrom and fe >= rs and fs <= re and re > rs) where coverage >= 0.8"
)
def region_spanning_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(access.spanning_fibers(t.fibers(spark, d), t.annotations(spark, d)).select("ord", "sample", "fiber_int_id", "coverage"), "coverage", digits=6)


@query(with_("nuc", "span", "fib", "sane") + f"select fiber_id from sane where sample = (select min(sample) from fib) and chrom = '{ONE_REGION[0]}' and fe > {ONE_REGION[1]} and fs < {ONE_REGION[2]}")
def fibers_at(spark: SparkSession, d: str) -> DataFrame:
    return access.fibers_at(t.fibers(spark, d), *ONE_REGION).select("fiber_id")


_CAND = ", cand as (select ord, annotation, id, reg.chrom, rs, re, sample, fiber_int_id, fiber_id from sane join reg on reg.chrom = sane.chrom and fe >= rs and fs <= re)"
_NUC_M = """n as (select ord, c.sample, c.fiber_int_id, count(n.s) n_nucleosomes, avg(n.w) mean_nuc_width, avg(n.linker::double) filter (where n.linker >= 0) mean_linker
  from cand c left join nuc n on n.sample = c.sample and n.chrom = c.chrom and n.fiber_int_id = c.fiber_int_id and n.s >= rs and n.e <= re group by 1, 2, 3)"""
_M5_M = """m as (select ord, c.sample, c.fiber_int_id, case when bool_or(p.chrom is not null) then count(m.pos) end n_cpg, 100 * avg(m.is_methylated::int) pct_methylated
  from cand c left join m5c m on m.sample = c.sample and m.chrom = c.chrom and m.fiber_int_id = c.fiber_int_id and m.pos between rs and re
  left join (select distinct sample, chrom from m5c) p on p.sample = c.sample and p.chrom = c.chrom group by 1, 2, 3)"""
_REST_M = """a as (select ord, c.sample, c.fiber_int_id, case when bool_or(p.chrom is not null) then count(m.pos) end "n_6mA"
  from cand c left join m6 m on m.sample = c.sample and m.chrom = c.chrom and m.fiber_int_id = c.fiber_int_id and m.pos between rs and re
  left join (select distinct sample, chrom from m6) p on p.sample = c.sample and p.chrom = c.chrom group by 1, 2, 3),
s as (select ord, c.sample, c.fiber_int_id, case when bool_or(p.chrom is not null) then count(m.s) end n_msp, avg(m.w) mean_msp_width
  from cand c left join mspl m on m.sample = c.sample and m.chrom = c.chrom and m.fiber_int_id = c.fiber_int_id and m.s >= rs and m.e <= re
  left join (select distinct sample, chrom from mspl) p on p.sample = c.sample and p.chrom = c.chrom group by 1, 2, 3),
f as (select ord, c.sample, c.fiber_int_id, case when bool_or(p.chrom is not null) then count(m.s) end n_fire_accessibility, min(score) min_fire_score, avg(score) mean_fire_score, (sum(greatest(least(m.e, re) - greatest(m.s, rs), 0)) filter (where m.s is not null))::double fire_overlap_bp
  from cand c left join firel m on m.sample = c.sample and m.chrom = c.chrom and m.fiber_int_id = c.fiber_int_id and m.e >= rs and m.s <= re
  left join (select distinct sample, chrom from firel) p on p.sample = c.sample and p.chrom = c.chrom group by 1, 2, 3)"""
_HEAD = "ord, annotation, c.sample, fiber_id, c.chrom || ':' || rs || '-' || re region_id"
_USING = "using (ord, sample, fiber_int_id)"
_NUC_OUT = "n_nucleosomes, round(mean_nuc_width, 5) mean_nuc_width, round(mean_linker, 5) mean_linker, round(mean_nuc_width + mean_linker, 5) mean_repeat_length"
_M5_OUT = "n_cpg, round(pct_methylated, 5) pct_methylated"


@query(with_("nuc", "span", "fib", "sane", "reg") + _CAND + f", {_NUC_M} select {_HEAD}, {_NUC_OUT} from cand c join n {_USING}")
def annotate_nucleosomes(spark: SparkSession, d: str) -> DataFrame:
    out = annotate.query_annotation(t.annotations(spark, d), t.fibers(spark, d), t.layers(spark, d), None, None, ["nucleosomes"])
    return _rounded(out, "mean_nuc_width", "mean_linker", "mean_repeat_length")


@query(with_("nuc", "span", "fib", "sane", "reg") + _CAND + f", {_M5_M} select {_HEAD}, {_M5_OUT} from cand c join m {_USING} where annotation = 'Stitched'")
def annotate_methylation(spark: SparkSession, d: str) -> DataFrame:
    out = annotate.query_annotation(t.annotations(spark, d), t.fibers(spark, d), t.layers(spark, d), "Stitched", None, ["5mC"])
    return _rounded(out, "pct_methylated")


@query(
    with_("nuc", "mspl", "span", "fib", "sane", "rec", "m6", "fire", "reg")
    + _CAND
    + f""", {_NUC_M}, {_M5_M}, {_REST_M}
select {_HEAD}, {_NUC_OUT}, {_M5_OUT}, "n_6mA", n_msp, round(mean_msp_width, 5) mean_msp_width, n_fire_accessibility, round(min_fire_score, 5) min_fire_score, round(mean_fire_score, 5) mean_fire_score, fire_overlap_bp
from cand c join n {_USING} join m {_USING} join a {_USING} join s {_USING} join f {_USING}"""
)
def annotate_all_layers(spark: SparkSession, d: str) -> DataFrame:
    names = ["nucleosomes", "5mC", "5hmC", "6mA", "msp", "fire_accessibility"]
    out = annotate.query_annotation(t.annotations(spark, d), t.fibers(spark, d), t.layers(spark, d), None, None, names)
    return _rounded(out, "mean_nuc_width", "mean_linker", "mean_repeat_length", "pct_methylated", "mean_msp_width", "min_fire_score", "mean_fire_score", "fire_overlap_bp")


@query(with_("nuc", "span", "fib", "sane", "reg") + _CAND + f", {_NUC_M} select {_HEAD}, {_NUC_OUT} from cand c join n {_USING} where ord in (select ord from reg where annotation = 'Stitched' order by ord limit 50)")
def annotate_first_n_regions(spark: SparkSession, d: str) -> DataFrame:
    """The published benchmark's query: the first 50 regions of a type."""
    out = annotate.query_annotation(t.annotations(spark, d), t.fibers(spark, d), t.layers(spark, d), "Stitched", None, ["nucleosomes"], 50)
    return _rounded(out, "mean_nuc_width", "mean_linker", "mean_repeat_length")


@query(with_("nuc", "span", "fib", "sane", "reg") + _CAND + f", {_NUC_M} select {_HEAD}, {_NUC_OUT} from cand c join n {_USING} where annotation = 'Element'")
def compare_samples(spark: SparkSession, d: str) -> DataFrame:
    out = annotate.compare_samples(t.annotations(spark, d), t.fibers(spark, d), t.layers(spark, d), "Element", ["nucleosomes"])
    return _rounded(out, "mean_nuc_width", "mean_linker", "mean_repeat_length")


@query(
    with_("nuc", "mspl", "span", "fib", "sane", "reg")
    + """, cand as (select ord, id, reg.chrom, rs, re, sample, fiber_int_id, fiber_id from sane join reg on reg.chrom = sane.chrom and fe > rs and fs < re where id = 'Stitched_12' and sample = 'd0'),
n as (select sample, fiber_int_id, count(n.s) n_nucleosomes, avg(n.w) mean_nuc_width from cand c left join nuc n using (sample, chrom, fiber_int_id) where n.s is null or (n.s >= rs and n.e <= re) group by 1, 2),
s as (select sample, fiber_int_id, count(m.s) n_msp from cand c join mspl m using (sample, chrom, fiber_int_id) where m.s >= rs and m.e <= re group by 1, 2)
select id region_id, c.sample, fiber_id, coalesce(n_nucleosomes, 0) n_nucleosomes, round(mean_nuc_width, 5) mean_nuc_width, coalesce(n_msp, 0) n_msp from cand c left join n using (sample, fiber_int_id) left join s using (sample, fiber_int_id)"""
)
def query_one_region(spark: SparkSession, d: str) -> DataFrame:
    f = t.fibers(spark, d)
    out = annotate.query_by_id(t.annotations(spark, d), f, t.layers(spark, d), "Stitched_12", "d0", ["nucleosomes", "msp"])
    return _rounded(out, "mean_nuc_width")


@query(
    "with p as (select sample, chrom, fiber_int_id, count(*) n from m5c group by 1, 2, 3), u as (select *, sum(n) over (partition by sample, chrom order by fiber_int_id rows unbounded preceding) e from p) "
    "select sample, chrom, fiber_int_id, (e - n)::bigint start_row, e::bigint end_row from u"
)
def layer_slices(spark: SparkSession, d: str) -> DataFrame:
    return access.layer_slices(t.layers(spark, d)["5mC"])


@query(with_("reg") + "select annotation, count(*) n_regions from reg group by 1")
def annotation_types(spark: SparkSession, d: str) -> DataFrame:
    return access.annotation_types(t.annotations(spark, d))


@query(with_("reg") + "select regexp_replace(id, '_[0-9]+$', '') kind, count(*) n from reg group by 1")
def annotation_type_of_id(spark: SparkSession, d: str) -> DataFrame:
    from strandframe.sources.text import annotation_type

    return t.annotations(spark, d).groupBy(annotation_type(F.col("id")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(with_("reg") + "select annotation, chrom, rs as start, re as \"end\", id, ord from reg where id = 'Element_3'")
def annotation_by_id(spark: SparkSession, d: str) -> DataFrame:
    return access.annotation_by_id(t.annotations(spark, d), "Element_3")


@query(with_("nuc", "span", "fib") + "select sample, chrom, count(*) n_fibers from fib where chrom like 'chr%' group by 1, 2")
def chromosomes(spark: SparkSession, d: str) -> DataFrame:
    return access.chromosomes(t.fibers(spark, d))


@query(
    with_("nuc", "mspl", "span", "fib", "sane", "rec", "m6")
    + """, f as (select *, fe - fs len from sane),
n as (select sample, chrom, fiber_int_id, sum(greatest(least(e, fe) - greatest(s, fs), 0)) bp from f join nuc using (sample, chrom, fiber_int_id) group by 1, 2, 3),
s as (select sample, chrom, fiber_int_id, sum(greatest(least(e, fe) - greatest(s, fs), 0)) bp from f join mspl using (sample, chrom, fiber_int_id) group by 1, 2, 3),
m as (select sample, chrom, fiber_int_id, count(*) n, avg(is_methylated::int) share from f join m5c using (sample, chrom, fiber_int_id) where pos >= fs and pos < fe group by 1, 2, 3),
a as (select sample, chrom, fiber_int_id, count(*) n from f join m6 using (sample, chrom, fiber_int_id) where pos >= fs and pos < fe group by 1, 2, 3)
select sample, chrom, fiber_id, fs fiber_start, fe fiber_end, len fiber_length,
  round(case when len > 0 then coalesce(n.bp, 0)::double / len else 0 end, 6) frac_nuc_coverage, round(case when len > 0 then coalesce(s.bp, 0)::double / len else 0 end, 6) frac_msp_coverage,
  coalesce(m.n, 0) "n_5mC", 0::bigint "n_5hmC", coalesce(a.n, 0) "n_6mA",
  round(case when len > 0 then coalesce(m.n, 0)::double / len else 0 end, 6) "frac_5mC_coverage", 0.0::double "frac_5hmC_coverage", round(case when len > 0 then coalesce(a.n, 0)::double / len else 0 end, 6) "frac_6mA_coverage",
  round(share, 6) "frac_5mC_among_cpg", null::double "frac_5hmC_among_cpg", round(case when len > 0 then coalesce(a.n, 0)::double / len else 0 end, 6) "frac_6mA_among_A"
from f left join n using (sample, chrom, fiber_int_id) left join s using (sample, chrom, fiber_int_id) left join m using (sample, chrom, fiber_int_id) left join a using (sample, chrom, fiber_int_id)"""
)
def fiber_feature_fractions(spark: SparkSession, d: str) -> DataFrame:
    out = features.fiber_fractions(t.fibers(spark, d), t.layers(spark, d))
    return _rounded(out, *[c for c in out.columns if c.startswith("frac_")], digits=6)


@query(
    "with v as (select sample, frac_5mc_coverage x from features where frac_5mc_coverage is not null and not isnan(frac_5mc_coverage)) "
    "select sample, x, round(row_number() over (partition by sample order by x)::double / count(*) over (partition by sample), 9) y from v "
    "union all select sample, unnest([0.0, 1.0]), unnest([0.0, 1.0]) from (select distinct sample from v)"
)
def feature_ecdf(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(features.ecdf(table(spark, d, "features"), ["sample"], "frac_5mc_coverage"), "y", digits=9)


@query(
    with_("nuc", "mspl", "span", "fib", "rec", "m6", "fire", "reg")
    + """, per as (select sample, chrom, 'fibers' layer, count(*) records from fib group by 1, 2 union all select sample, chrom, 'nucleosomes', count(*) from nuc group by 1, 2
  union all select sample, chrom, '5mC', count(*) from m5c group by 1, 2 union all select sample, chrom, '6mA', count(*) from m6 group by 1, 2 union all select sample, chrom, 'msp', count(*) from mspl group by 1, 2
  union all select sample, chrom, 'fire_accessibility', count(*) from firel group by 1, 2)
select * from per union all select null, null, layer, coalesce(sum(records), 0)::bigint from (select unnest(['fibers', 'nucleosomes', '5mC', '5hmC', '6mA', 'msp', 'fire_accessibility']) layer) left join per using (layer) group by layer
union all select null, null, 'annotations', count(*) from reg"""
)
def record_counts(spark: SparkSession, d: str) -> DataFrame:
    return features.record_counts(t.fibers(spark, d), t.layers(spark, d), t.annotations(spark, d))


_STATS = "round(quantile_cont(v, 0.5), 9) median, round(quantile_cont(v, 0.25), 9) q25, round(quantile_cont(v, 0.75), 9) q75, round(quantile_cont(v, 0.95), 9) p95, min(v) least, max(v) largest, count(v) n"


@query(f"select event_type, {_STATS} from (select event_type, value v from events) group by 1")
def summary_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(features.summary_statistics(table(spark, d, "events"), ["event_type"], "value"), "median", "q25", "q75", "p95", digits=9)


@query(f"select sample, {_STATS} from (select sample, frac_nuc_coverage v from features where fiber_length < 10000 and not isnan(frac_nuc_coverage)) group by 1")
def trimmed_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "features").where("not isnan(frac_nuc_coverage)")
    return _rounded(features.trimmed_summary(rows, ["sample"], "frac_nuc_coverage", "fiber_length"), "median", "q25", "q75", "p95", digits=9)


_GROWN = ", grown as (select chrom, case when strand = '+' then greatest(s - 500, 0) else s end s, case when strand = '-' then e + 500 else e end e from gene)"
_KEPT = ", kept as (select p.* from peak p join csize on csize.chrom = p.chrom where s >= 0 and e <= size and e > s and not exists (select 1 from grown g where g.chrom = p.chrom and g.e > p.s and g.s < p.e))"
_ISLANDS = """, r as (select *, max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) reach from kept),
b as (select *, case when reach is null or s - reach > 12500 or exists (select 1 from gene g where g.chrom = r.chrom and g.s < r.s and g.e > r.reach) then 1 else 0 end opens from r),
i as (select *, sum(opens) over (partition by chrom order by s, e rows unbounded preceding) island from b),
st as (select chrom, min(s) s, max(e) e from i group by chrom, island)"""


@query(with_("gene") + _GROWN + " select chrom, s as start, e as \"end\" from grown")
def gene_blocks(spark: SparkSession, d: str) -> DataFrame:
    return coaccess.expand_genes(t.genes(spark, d), coaccess.PROMOTER_BP)


@query(with_("peak", "size", "gene") + _GROWN + _KEPT + " select chrom, s as start, e as \"end\" from kept")
def intergenic_peaks(spark: SparkSession, d: str) -> DataFrame:
    return coaccess.intergenic_peaks(t.peaks(spark, d), coaccess.expand_genes(t.genes(spark, d), coaccess.PROMOTER_BP), t.chrom_sizes(spark, d))


@query(with_("peak", "size", "gene") + _GROWN + _KEPT + _ISLANDS + " select chrom, s as start, e as \"end\" from st")
def stitched_regions(spark: SparkSession, d: str) -> DataFrame:
    return coaccess.prepare_regions(t.peaks(spark, d), t.genes(spark, d), t.chrom_sizes(spark, d))[1]


@query(with_("peak", "size", "gene") + _GROWN + _KEPT + _ISLANDS + " select p.chrom, p.s es, p.e ee, st.s ss, st.e se from peak p join st on st.chrom = p.chrom and p.s >= st.s and p.e <= st.e and st.e > p.s")
def contained_pairs(spark: SparkSession, d: str) -> DataFrame:
    _, stitched = coaccess.prepare_regions(t.peaks(spark, d), t.genes(spark, d), t.chrom_sizes(spark, d))
    return intervals.contained_pairs(stitched, t.peaks(spark, d))


@query(
    with_("nuc", "span", "fib", "rec", "fire")
    + """select f.sample, el_chrom, el_start, el_end, st_chrom, st_start, st_end, fiber_id, score fire_score, least(f.e, el_end) - greatest(f.s, el_start) overlap_bp
from (select distinct el_chrom, el_start, el_end, st_chrom, st_start, st_end from cov_bed where el_chrom = st_chrom and el_start >= st_start and el_end <= st_end) p
join firel f on f.chrom = el_chrom and f.e > el_start and f.s < el_end and least(f.e, el_end) > greatest(f.s, el_start) join fib using (sample, chrom, fiber_int_id)"""
)
def coaccess_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cov_bed").where("el_chrom = st_chrom and el_start >= st_start and el_end <= st_end")
    pairs = c.select(F.col("el_chrom").alias("chrom"), F.col("el_start").alias("es"), F.col("el_end").alias("ee"), F.col("st_start").alias("ss"), F.col("st_end").alias("se")).distinct()
    return coaccess.coverage(pairs, t.layers(spark, d)["fire_accessibility"], t.fibers(spark, d))


_CELLS = """with c0 as (select st_chrom || ':' || st_start || '-' || st_end g, el_chrom || ':' || el_start || '-' || el_end e, el_start es, el_end ee, fiber_id f, min(fire_score) best, sum(overlap_bp)::bigint bp
  from cov_bed where fiber_id is not null and fire_score is not null group by 1, 2, 3, 4, 5),
cell as (select *, case when best < 0.1 or bp = ee - es then best end c from c0)"""
_PAIRS = (
    _CELLS
    + """, k as (select * from cell where c is not null),
pr as (select a.g, a.e ea, b.e eb, any_value(a.es) sa, any_value(a.ee) na, any_value(b.es) sb, any_value(b.ee) nb,
  count(*) filter (where a.c < 0.1 and b.c < 0.1) n_both, count(*) filter (where a.c >= 0.1 and b.c < 0.1) n_only_b, count(*) filter (where a.c < 0.1 and b.c >= 0.1) n_only_a, count(*) filter (where a.c >= 0.1 and b.c >= 0.1) n_neither
  from k a join k b on a.g = b.g and a.f = b.f and (a.es, a.ee, a.e) < (b.es, b.ee, b.e) group by 1, 2, 3),
sc as (select g stitched_id, ea element_a, eb element_b, n_both, n_only_b, n_only_a, n_neither, n_both * n_both / pow((n_only_b + n_only_a) / 2.0, 2) score, case when na > nb then sa - nb else sb - na end distance_bp
  from pr where n_both + n_only_b + n_only_a + n_neither >= 10 and n_only_b + n_only_a > 0 and n_both > 0)"""
)


@query(_CELLS + " select g stitched_id, e element_id, f fiber_id, best, bp, c cell from cell")
def coaccess_cells(spark: SparkSession, d: str) -> DataFrame:
    return coaccess.cells(table(spark, d, "cov_bed")).select("stitched_id", "element_id", "fiber_id", "best", "bp", "cell")


_SCORE_COLUMNS = ["stitched_id", "element_a", "element_b", "n_both", "n_only_b", "n_only_a", "n_neither", "score", "distance_bp"]


@query(_PAIRS + " select stitched_id, element_a, element_b, n_both, n_only_b, n_only_a, n_neither, round(score, 6) score, distance_bp from sc")
def coaccess_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(coaccess.pair_scores(table(spark, d, "cov_bed")).select(*_SCORE_COLUMNS), "score", digits=6)


@query(_PAIRS + " select stitched_id, element_a, element_b, row_number() over (order by score desc, stitched_id, element_a, element_b) rank from sc")
def coaccess_pair_rank(spark: SparkSession, d: str) -> DataFrame:
    ranked, _ = coaccess.rank_by(coaccess.pair_scores(table(spark, d, "cov_bed")), "score", ["stitched_id", "element_a", "element_b"])
    return ranked.select("stitched_id", "element_a", "element_b", "rank")


@query(
    _PAIRS
    + """, el as (select stitched_id, string_agg(e, ',' order by e) elements from (select distinct stitched_id, unnest([element_a, element_b]) e from sc) group by 1)
select stitched_id, element_a, element_b, round(score, 6) score, elements from (select *, row_number() over (partition by stitched_id order by score desc, element_a, element_b) k from sc) join el using (stitched_id) where k = 1"""
)
def coaccess_cluster_best(spark: SparkSession, d: str) -> DataFrame:
    best = coaccess.best_pairs(coaccess.pair_scores(table(spark, d, "cov_bed")), "score")
    return _rounded(best.select("stitched_id", "element_a", "element_b", "score", "elements"), "score", digits=6)


@query(
    _PAIRS
    + """, o as (select *, (row_number() over (order by distance_bp, stitched_id, element_a, element_b) - 1) // 100 chunk from sc where distance_bp > 0 and score > 0)
select chunk::bigint chunk, round(median(distance_bp), 6) distance, round(median(score), 6) score from o group by 1 having count(*) = 100"""
)
def coaccess_distance_bins(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(coaccess.distance_chunks(coaccess.pair_scores(table(spark, d, "cov_bed")), rows=100), "distance", "score", digits=6)


_ELBOW = """, ev as (select *, row_number() over (order by score) - 1 i from sc), ep as (select count(*) n, (max(score) - min(score)) / count(*) slope, median(score) med, avg(score) mean from sc),
ec as (select a.i, any_value(a.score) v, count(*) k from ev a, ep, ev b where b.score <= slope * (b.i + 1) + (a.score - slope * a.i) group by a.i), cut as (select v from ec order by k, i limit 1)"""


@query(_PAIRS + _ELBOW + " select stitched_id, element_a, element_b, row_number() over (order by score desc, stitched_id, element_a, element_b) rank, score >= (select v from cut) is_super from sc")
def coaccess_super_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs ranked by the score as it is, with the elbow's class."""
    return coaccess.ranked_pairs(coaccess.corrected_scores(table(spark, d, "cov_bed"), distance_correct=False)).select("stitched_id", "element_a", "element_b", "rank", "is_super")


@query(_PAIRS + _ELBOW + " select n - row_number() over (order by score desc, stitched_id, element_a, element_b) + 1 x, round(score, 6) y, score >= v above, round(v / med, 6) fold_over_median, round(v / mean, 6) fold_over_mean from sc, ep, cut")
def coaccess_elbow_rows(spark: SparkSession, d: str) -> DataFrame:
    ranked, cutoff = coaccess.rank_by(coaccess.pair_scores(table(spark, d, "cov_bed")), "score", ["stitched_id", "element_a", "element_b"])
    return _rounded(coaccess.elbow_rows(ranked, "score", cutoff), "y", "fold_over_median", "fold_over_mean", digits=6)


@query()
def coaccess_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Pairs ranked by the distance-corrected score with the elbow's class."""
    return coaccess.ranked_pairs(coaccess.corrected_scores(table(spark, d, "cov_bed")))


@query(
    _CELLS
    + """, per as (select g, e, count(*) filter (where c is not null) seen, count(*) filter (where c < 0.1) "on" from cell group by 1, 2), n as (select g, count(distinct f) nf from cell group by 1)
select (select count(*) from n) regions, count(*) elements, sum(nf)::bigint cells, sum(seen)::bigint observed, sum("on")::bigint accessible from per join n using (g)"""
)
def coaccess_object_summary(spark: SparkSession, d: str) -> DataFrame:
    return coaccess.object_summary(coaccess.object_rows(table(spark, d, "cov_bed")))


def _earlier(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "pair_scores").where("score is not null and not isnan(score)")
    keyed = s.select("stitched_id", F.least("element_a", "element_b").alias("key_a"), F.greatest("element_a", "element_b").alias("key_b"), "score", "status")
    return keyed.groupBy("stitched_id", "key_a", "key_b").agg(F.max("score").alias("old_score"), F.max("status").alias("old_status"))


def _new(spark: SparkSession, d: str) -> DataFrame:
    s = coaccess.pair_scores(table(spark, d, "cov_bed"))
    return s.select("stitched_id", F.least("element_a", "element_b").alias("key_a"), F.greatest("element_a", "element_b").alias("key_b"), F.col("score").alias("new_score"))


_BOTH = _PAIRS + """, old as (select stitched_id, least(element_a, element_b) key_a, greatest(element_a, element_b) key_b, max(score) old_score, max(status) old_status from pair_scores where score is not null and not isnan(score) group by 1, 2, 3),
new as (select stitched_id, least(element_a, element_b) key_a, greatest(element_a, element_b) key_b, score new_score from sc)"""
_PAIR_KEY = ["stitched_id", "key_a", "key_b"]


@query(_BOTH + " select stitched_id, key_a, key_b, case when old_score is null then 'right_only' when new_score is null then 'left_only' else 'shared' end status from old full join new using (stitched_id, key_a, key_b)")
def rank_membership(spark: SparkSession, d: str) -> DataFrame:
    return validate.membership(_earlier(spark, d), _new(spark, d), _PAIR_KEY)


@query(
    _BOTH
    + """, j as (select old_score x, new_score y from old join new using (stitched_id, key_a, key_b)),
rk as (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 ry from j)
select count(*) n, round(corr(x, y), 6) pearson, round(corr(rx, ry), 6) spearman from rk"""
)
def rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    both = _earlier(spark, d).join(_new(spark, d), _PAIR_KEY)
    return _rounded(validate.correlations(both, "old_score", "new_score"), "pearson", "spearman", digits=6)


@query(
    _BOTH
    + """, j as (select old_status = 'Super' a, new_score >= 1 b from old join new using (stitched_id, key_a, key_b)),
c as (select count(*) filter (where a and b) "both", count(*) filter (where a and not b) left_only, count(*) filter (where not a and b) right_only, count(*) filter (where not a and not b) neither from j)
select *, round(("both" + neither) / ("both" + left_only + right_only + neither)::double, 6) agreement from c"""
)
def rank_confusion(spark: SparkSession, d: str) -> DataFrame:
    both = _earlier(spark, d).join(_new(spark, d), _PAIR_KEY).withColumns({"a": F.col("old_status") == "Super", "b": F.col("new_score") >= 1})
    return _rounded(validate.confusion(both, "a", "b"), "agreement", digits=6)


@query(
    _BOTH
    + """, f as (select *, old_score is not null l, new_score is not null r from old full join new using (stitched_id, key_a, key_b)), j as (select *, old_score x, new_score y from f where l and r),
rk as (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 ry from j)
select count(*) filter (where l) left_rows, count(*) filter (where r) right_rows, count(*) filter (where l and r) shared, count(*) filter (where l and not r) left_only, count(*) filter (where r and not l) right_only,
  (select round(corr(x, y), 6) from rk) score_pearson, (select round(corr(rx, ry), 6) from rk) score_spearman,
  (select count(*) from j where old_status = 'Super' and new_score >= 1) super_both, (select count(*) from j where (old_status = 'Super') <> (new_score >= 1)) super_differ from f"""
)
def rank_validation(spark: SparkSession, d: str) -> DataFrame:
    old = _earlier(spark, d).select(*_PAIR_KEY, F.col("old_score").alias("score"), F.lit(0).alias("rank"), (F.col("old_status") == "Super").alias("is_super"))
    new = _new(spark, d).select(*_PAIR_KEY, F.col("new_score").alias("score"), F.lit(0).alias("rank"), (F.col("new_score") >= 1).alias("is_super"))
    out = validate.agreement(old, new, _PAIR_KEY).withColumn("super_differ", F.col("super_left_only") + F.col("super_right_only"))
    return _rounded(out.select("left_rows", "right_rows", "shared", "left_only", "right_only", "score_pearson", "score_spearman", "super_both", "super_differ"), "score_pearson", "score_spearman", digits=6)


@query(with_("reg") + """ select chrom, string_agg(rs || '-' || re || ':' || id, ',' order by rs, re, id) regions from reg group by 1""")
def regions_by_chromosome(spark: SparkSession, d: str) -> DataFrame:
    one = lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"), F.lit(":"), r["id"])
    return access.regions_by_chromosome(t.annotations(spark, d)).select("chrom", F.array_join(F.transform("regions", one), ",").alias("regions"))


@query(
    _BOTH
    + """, l as (select *, row_number() over (order by old_score desc, stitched_id, key_a, key_b) r from old), n as (select *, row_number() over (order by new_score desc, stitched_id, key_a, key_b) r from new),
ks as (select k::bigint k, least(k, (select count(*) from l), (select count(*) from n))::bigint used_k from (select unnest([10, 50, 100, 500, 1000, 5000, 10000, 50000]) k))
select k, used_k, (select count(*) from l join n using (stitched_id, key_a, key_b) where l.r <= used_k and n.r <= used_k) overlap,
  round((select count(*) from l join n using (stitched_id, key_a, key_b) where l.r <= used_k and n.r <= used_k)::double / used_k, 6) share from ks"""
)
def rank_top_k(spark: SparkSession, d: str) -> DataFrame:
    old, _ = coaccess.rank_by(_earlier(spark, d), "old_score", _PAIR_KEY)
    new, _ = coaccess.rank_by(_new(spark, d), "new_score", _PAIR_KEY)
    return _rounded(validate.top_k_overlap(old, new, _PAIR_KEY, "rank"), "share", digits=6)


@query()
def multiset_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    t_ = table(spark, d, "cov_bed")
    return validate.fingerprint(t_, t_.columns)


@query(
    with_("nuc", "span", "fib", "sane", "reg")
    + """, pr as (select ord, sample, chrom, fiber_int_id, rs, re from (select ord, sample, reg.chrom, fiber_int_id, rs, re, fs, fe from sane join reg on reg.chrom = sane.chrom and fe >= rs and fs <= re and re > rs) where (least(fe, re) - greatest(fs, rs))::double / (re - rs) >= 0),
h as (select ord, sample, fiber_int_id, greatest(s, rs) - rs lo, least(e, re) - rs hi from pr join nuc using (sample, chrom, fiber_int_id) where e > rs and s < re),
b as (select distinct ord, sample, fiber_int_id, unnest(generate_series(lo, hi - 1)) place from h where hi > lo)
select ord, place, count(*) covered from b group by 1, 2"""
)
def occupancy_profile(spark: SparkSession, d: str) -> DataFrame:
    return signal.occupancy_profile(t.annotations(spark, d), t.fibers(spark, d), t.layers(spark, d)["nucleosomes"])


@query(
    with_("nuc", "span", "fib", "sane", "reg")
    + """, pr as (select ord, sample, reg.chrom, fiber_int_id, rs, re, fs, fe from sane join reg on reg.chrom = sane.chrom and fe >= rs and fs <= re and re > rs where (least(fe, re) - greatest(fs, rs))::double / (re - rs) >= 0),
v as (select ord, sample, fiber_int_id, (pos - rs) // 50 bin, avg(is_methylated::int) v from pr join m5c using (sample, chrom, fiber_int_id) where pos >= rs and pos < re and pos >= fs and pos < fe and is_methylated is not null group by 1, 2, 3, 4)
select ord, bin, round(avg(v), 6) mean_methylation from v group by 1, 2"""
)
def methylation_bins(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.methylation_bins(t.annotations(spark, d), t.fibers(spark, d), t.layers(spark, d)["5mC"]), "mean_methylation", digits=6)


@query()
def annotation_matrices(spark: SparkSession, d: str) -> DataFrame:
    return signal.annotation_matrices(t.annotations(spark, d), t.fibers(spark, d), t.layers(spark, d), ["Element"], min_fibers=1)


@query()
def centered_matrices(spark: SparkSession, d: str) -> DataFrame:
    return signal.centered_matrices(t.annotations(spark, d), t.fibers(spark, d), t.layers(spark, d), ["Element"], min_fibers=1, extension={"Element": 1000})


@query()
def centered_metaplot(spark: SparkSession, d: str) -> DataFrame:
    m = signal.centered_matrices(t.annotations(spark, d), t.fibers(spark, d), t.layers(spark, d), ["Element"], min_fibers=1, extension={"Element": 1000})
    return signal.metaplot(m, ["annotation", "sample"], "met_binned")
