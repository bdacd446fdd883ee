"""Queries of the general data operators (broken rows, units, periods, orphan references) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.quantities import fractions, recorded_units
from strandframe.operators.orphans import orphan_references, reference_key
from strandframe.operators.periods import merged_periods
from strandframe.session import table
from strandframe.sources.normalize import all_to_modkit, flatten_blocks
from strandframe.sources.rawlines import load_raw_lines
from strandframe.sources.text import inner_blocks


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return load_raw_lines(table(spark, d, "raw_lines")).where("reason is not null").select("rec_id")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = load_raw_lines(table(spark, d, "raw_lines"))
    return rows.groupBy("fmt", F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def p1_loaded_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = load_raw_lines(table(spark, d, "raw_lines")).where("reason is null and fmt = 'block_bed'")
    return rows.select("rec_id", "chrom", "start", "end", "name", "strand", F.size("sizes").cast("long").alias("n_blocks"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("block_bp"))


def _recorded(spark: SparkSession, d: str) -> DataFrame:
    return recorded_units(table(spark, d, "m5c"), table(spark, d, "all_records"), table(spark, d, "runs"))


def _loaded_blocks(spark: SparkSession, d: str) -> DataFrame:
    return load_raw_lines(table(spark, d, "raw_lines")).where("reason is null and fmt = 'block_bed'").withColumnRenamed("name", "fiber_id")


def flatten_linkers(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of valid block BED records as rows with the gap to the block before."""
    return flatten_blocks(_loaded_blocks(spark, d), "rec_id")


def bed12_blocks_expand(spark: SparkSession, d: str) -> DataFrame:
    """Inner blocks of at least ten bases of valid block BED records."""
    rows = _loaded_blocks(spark, d).select("rec_id", "chrom", "fiber_id", F.col("start").alias("first"), "sizes", F.col("starts").alias("offsets"))
    return inner_blocks(rows, 10)


def all_tsv_explode(spark: SparkSession, d: str) -> DataFrame:
    """5mC calls of valid "all" records in the columns of the call table."""
    return all_to_modkit(load_raw_lines(table(spark, d, "raw_lines")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _recorded(spark, d).where("unit <> own").select("src_table", "row_id", "field", "unit").distinct()


def p2_mean_fraction(spark: SparkSession, d: str) -> DataFrame:
    v = fractions(_recorded(spark, d)).where("fraction is not null")
    return v.groupBy("src_table", "field", "unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fraction"), 6).alias("mean_fraction"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    cols = ["sample", "chrom", "fiber_int_id", "starts", "ends"]
    spans = table(spark, d, "nucleosomes").select(cols).unionByName(table(spark, d, "msp").select(cols))
    return merged_periods(spans, cols[:3], "starts", "ends")


def references(spark: SparkSession, d: str) -> DataFrame:
    """References to fibers of the three referring tables, with the key trimmed."""
    parts = []
    for name, row_id, chrom, ref in (("fiber_meta", "meta_id", "chrom", "read_id"), ("cov_bed", "cov_id", "el_chrom", "fiber_id"), ("features", "feat_id", "chrom", "fiber_id")):
        t = table(spark, d, name)
        parts.append(t.select(F.lit(name).alias("ref_table"), F.col(row_id).alias("row_id"), "sample", F.col(chrom).alias("chrom"), reference_key(ref).alias("ref"), "loaded_at"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "fiber_id_table").select("sample", "chrom", reference_key("fiber_id").alias("ref"), "created_at", "deleted_at")
    found = orphan_references(references(spark, d), parents, ["sample", "chrom", "ref"], "loaded_at", "created_at", "deleted_at", carry=["ref_table", "row_id", "loaded_at"])
    return found.withColumn("ref_month", F.date_format("loaded_at", "yyyy-MM"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_month", "row_id", "kind")


def p6_per_month(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy("ref_table", "ref_month", "kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_loaded_blocks, flatten_linkers, bed12_blocks_expand, all_tsv_explode, p2_found, p2_mean_fraction, p4_found, p6_found, p6_per_month)}

_FIELD = r"""("([^"]|"")*"|[^"\t][^\t]*|)"""
_FIELDS = r"""[case when x like '"%' then replace(x[2:len(x) - 1], '""', '"') else x end for x in regexp_extract_all(L || chr(9), '("(?:[^"]|"")*"|[^\t]*)\t', 1)]"""
_ENTRY, _NUMBER = r"(-?[0-9]+|\.|NA|NaN|nan)?", r"([-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?|\.|NA|NaN|nan)?"
_ALL_LISTS = ("ref_nuc_starts", "ref_nuc_lengths", "ref_msp_starts", "ref_msp_lengths", "ref_m6a", "m6a_qual", "ref_5mC", "5mC_qual")
_LINES = rf"""
with raw as (select rec_id, fmt, file_name, line_no, regexp_replace(line, '\r$', '') l from raw_lines),
recs as (select * from raw where trim(replace(l, chr(9), ' ')) <> '' and l not like '#%' and not (fmt = 'all_tsv' and line_no = 1)),
heads as (select file_name, [regexp_replace(x, '^#', '') for x in {_FIELDS.replace("L ||", "h ||")}] hc from (select file_name, regexp_replace(min(line), '\r$', '') h from raw_lines where fmt = 'all_tsv' and line_no = 1 group by 1)),
parsed as (select *, regexp_full_match(l, '{_FIELD}(\t{_FIELD})*') quotes, {_FIELDS.replace("L ||", "l ||")} c from recs),
bed as (select *, [try_cast(x as bigint) for x in string_split(regexp_replace(c[len(c) - 1], ',$', ''), ',')] sz, [try_cast(x as bigint) for x in string_split(regexp_replace(c[len(c)], ',$', ''), ',')] st from parsed where fmt = 'block_bed'),
bed_ok as (select rec_id, c, sz, quotes and len(c) in (10, 11, 12) and regexp_full_match(c[2], '-?[0-9]+') and regexp_full_match(c[3], '-?[0-9]+') and regexp_full_match(c[7], '-?[0-9]+') and regexp_full_match(c[8], '-?[0-9]+')
  and try_cast(c[2] as bigint) <= try_cast(c[3] as bigint) and try_cast(c[7] as bigint) <= try_cast(c[8] as bigint) and c[6] in ('+', '-', '.')
  and regexp_full_match(c[len(c) - 1], '-?[0-9]+(,-?[0-9]+)*,?') and regexp_full_match(c[len(c)], '-?[0-9]+(,-?[0-9]+)*,?') and len(sz) = len(st) and list_min(sz) >= 0 and list_min(st) >= 0
  and list_max(st) <= try_cast(c[3] as bigint) - try_cast(c[2] as bigint) and (len(c) <> 12 or regexp_full_match(c[10], '-?[0-9]+') and try_cast(c[10] as bigint) = len(sz)) ok from bed),
cells as (select rec_id, quotes and hc is not null and len(c) = len(hc) shaped, {", ".join(f"c[list_position(hc, '{n}')] c_{n}" for n in ("ct", "st", "en", "fiber", "strand", *_ALL_LISTS, "fire"))} from parsed left join heads using (file_name) where fmt = 'all_tsv'),
lens as (select *, {", ".join(f"len(string_split(regexp_replace(c_{n}, ',$', ''), ',')) n_{n}" for n in (*_ALL_LISTS, "fire"))} from cells),
all_ok as (select rec_id, shaped and {" and ".join(f"c_{n} <> ''" for n in ("ct", "st", "en", "fiber", "strand"))} and regexp_full_match(c_st, '-?[0-9]+') and regexp_full_match(c_en, '-?[0-9]+')
  and {" and ".join(f"regexp_full_match(c_{n}, '{_ENTRY}(,{_ENTRY})*')" for n in _ALL_LISTS)} and regexp_full_match(c_fire, '{_NUMBER}(,{_NUMBER})*')
  and n_ref_nuc_starts = n_ref_nuc_lengths and n_ref_msp_starts = n_ref_msp_lengths and n_ref_msp_starts = n_fire and n_ref_m6a = n_m6a_qual and n_ref_5mC = n_5mC_qual
  and {" and ".join(f"len([x for x in list_zip(string_split(c_{p}, ','), string_split(c_{q}, ',')) if try_cast(x[1] as bigint) >= 0 and not coalesce(try_cast(x[2] as bigint) between 0 and 255, false)]) = 0" for p, q in (("ref_m6a", "m6a_qual"), ("ref_5mC", "5mC_qual")))} ok from lens)
"""


def _bed_reason() -> str:
    """The first rule that a block BED line breaks, in the order of the strict parser."""
    bad = lambda x: f"not regexp_full_match({x}, '-?[0-9]+')"
    big = lambda x: f"try_cast({x} as bigint) is null"
    steps = [("len(c) not in (10, 11, 12)", "column_count")]
    for x, name in (("c[2]", "start"), ("c[3]", "end"), ("c[7]", "thick_start"), ("c[8]", "thick_end")):
        steps += [(bad(x), f"not_an_integer:{name}"), (big(x), f"integer_out_of_range:{name}")]
    steps += [("c[2]::bigint > c[3]::bigint", "start_after_end"), ("c[7]::bigint > c[8]::bigint", "thick_start_after_end"), ("c[6] not in ('+', '-', '.')", "strand")]
    for x, v, name in (("c[len(c) - 1]", "sz", "sizes"), ("c[len(c)]", "st", "starts")):
        steps += [(f"not regexp_full_match({x}, '-?[0-9]+(,-?[0-9]+)*,?')", f"not_an_integer:{name}"), (f"len({v}) <> len([y for y in {v} if y is not null])", f"integer_out_of_range:{name}")]
    steps += [("len(sz) <> len(st)", "list_lengths_differ:sizes,starts"), ("list_min(sz) < 0 or list_min(st) < 0", "negative_entry"), ("list_max(st) > c[3]::bigint - c[2]::bigint", "start_beyond_record")]
    steps += [(f"len(c) = 12 and {bad('c[10]')}", "not_an_integer:block_count"), ("len(c) = 12 and try_cast(c[10] as bigint) is distinct from len(sz)", "block_count")]
    return " ".join(f"when {test} then '{why}'" for test, why in steps)


def _all_reason() -> str:
    steps = [("not hc_known", "no_header"), ("not counted", "column_count")]
    steps += [(f"coalesce(c_{n}, '') = ''", f"empty:{n}") for n in ("ct", "st", "en", "fiber", "strand")]
    steps += [(f"not regexp_full_match(c_{n}, '-?[0-9]+')", f"not_an_integer:{n}") for n in ("st", "en")]
    steps += [(f"not regexp_full_match(c_{n}, '{_ENTRY}(,{_ENTRY})*')", f"not_an_integer:{n}") for n in _ALL_LISTS]
    steps += [(f"not regexp_full_match(c_fire, '{_NUMBER}(,{_NUMBER})*')", "not_a_number:fire")]
    for names in (("ref_nuc_starts", "ref_nuc_lengths"), ("ref_msp_starts", "ref_msp_lengths", "fire"), ("ref_m6a", "m6a_qual"), ("ref_5mC", "5mC_qual")):
        steps.append((" or ".join(f"n_{names[0]} <> n_{n}" for n in names[1:]), "list_lengths_differ:" + ",".join(names)))
    for p, q in (("ref_m6a", "m6a_qual"), ("ref_5mC", "5mC_qual")):
        steps.append((f"len([x for x in list_zip(string_split(c_{p}, ','), string_split(c_{q}, ',')) if try_cast(x[1] as bigint) >= 0 and not coalesce(try_cast(x[2] as bigint) between 0 and 255, false)]) > 0", f"quality_range:{q}"))
    return " ".join(f"when {test} then '{why}'" for test, why in steps)


_QUOTE_REASON = f"""case when not quotes then case when regexp_matches(regexp_replace(l, '^({_FIELD}\t)*', ''), '^"([^"]|"")*$') then 'unclosed_quote' else 'text_after_quote' end """
_REASONS = (
    _LINES
    + f""", bed_why as (select 'block_bed' fmt, {_QUOTE_REASON} {_bed_reason()} else 'valid' end reason from bed),
why as (select p.rec_id, p.l, p.quotes, hc is not null hc_known, len(p.c) = len(hc) counted, lens.* exclude (rec_id)
  from parsed p left join heads using (file_name) join lens on lens.rec_id = p.rec_id where p.fmt = 'all_tsv'),
all_why as (select 'all_tsv' fmt, {_QUOTE_REASON} {_all_reason()} else 'valid' end reason from why)
select fmt, reason, count(*) n from (select * from bed_why union all select * from all_why) group by 1, 2"""
)

_P4 = """
with spans as (
  select sample, chrom, fiber_int_id, starts s, ends e from nucleosomes union all
  select sample, chrom, fiber_int_id, starts, ends from msp),
good as (select * from spans where e > s and sample is not null and chrom is not null and fiber_int_id is not null),
reach as (select *, max(e) over (partition by sample, chrom, fiber_int_id order by s, e rows between unbounded preceding and 1 preceding) r from good),
grp as (select *, sum(case when r is null or s > r then 1 else 0 end) over (partition by sample, chrom, fiber_int_id order by s, e rows unbounded preceding) g from reach),
periods as (select sample, chrom, fiber_int_id, g, min(s) from_pos, max(e) to_pos from grp group by all),
gaps as (select sample, chrom, fiber_int_id, to_pos from_pos, lead(from_pos) over (partition by sample, chrom, fiber_int_id order by from_pos) to_pos from periods)
select 'period' kind, sample, chrom, fiber_int_id, from_pos, to_pos from periods
union all select 'gap', sample, chrom, fiber_int_id, from_pos, to_pos from gaps where to_pos is not null
"""

_ORPHANS = r"""
refs as (
  select 'fiber_meta' ref_table, meta_id row_id, sample, chrom, read_id ref, loaded_at from fiber_meta union all
  select 'cov_bed', cov_id, sample, el_chrom, fiber_id, loaded_at from cov_bed union all
  select 'features', feat_id, sample, chrom, fiber_id, loaded_at from features),
keyed as (select * exclude (ref), regexp_replace(ref, '^\s+|\s+$', '', 'g') ref from refs),
r as (select * from keyed where ref is not null and ref <> '' and ref <> '.' and sample is not null and chrom is not null),
p as (select sample, chrom, regexp_replace(fiber_id, '^\s+|\s+$', '', 'g') ref, created_at, deleted_at from fiber_id_table),
judged as (
  select r.ref_table, r.row_id, any_value(strftime(r.loaded_at, '%Y-%m')) ref_month, count(p.ref) n_parents,
    count(*) filter (where p.created_at <= r.loaded_at and (p.deleted_at is null or p.deleted_at > r.loaded_at)) n_live,
    count(*) filter (where p.created_at > r.loaded_at) n_later
  from r left join p on p.sample = r.sample and p.chrom = r.chrom and p.ref = r.ref group by 1, 2),
found as (
  select ref_table, ref_month, row_id, case when n_parents = 0 then 'missing' when n_later = n_parents then 'late' else 'deleted' end kind
  from judged where n_live = 0)
"""

_NOTES = r"""
note as (select run_id run, lower(min(scale_note)) t from runs where scale_note is not null group by 1),
clause as (select run, unnest(string_split(replace(t, ';', ','), ',')) c, t from note),
said as (
  select run, c, t,
    case when c like '%not%divided by 255%' then 'byte' when c like '%divided by 255%' then 'fraction'
      when c like '%phred%' or c like '%log10%' then 'phred'
      when c like '%mille%' or c like '%0-1000%' then 'permille'
      when c like '%percent%' or c like '%per cent%' or c like '%\%%' escape '\' or c like '%x100%' then 'percent'
      when c like '%byte%' or c like '%255%' then 'byte' when c like '%0-1%' or c like '%0..1%' or c like '%[0%' then 'fraction'
      when c like '%untouched%' then 'byte' end u,
    case when regexp_matches(c, '(^| )all ') then 'all' when regexp_matches(trim(c), '^(call )?(prob)') then 'prob' else 'lists' end f
  from (select run, case when t like '%[0,1]%' then replace(t, ',', '-') else c end c, t from clause)),
noted as (
  select run, 'prob' field, 'fraction' noted from note where t like '%fractions / bytes%' union all
  select run, unnest(['m5c_qual', 'm6a_qual']), 'byte' from note where t like '%fractions / bytes%' union all
  select run, unnest(case f when 'all' then ['prob', 'm5c_qual', 'm6a_qual'] when 'prob' then ['prob'] else ['m5c_qual', 'm6a_qual'] end), u
  from (select distinct run, f, u from said where u is not null and t not like '%fractions / bytes%')),
"""
_UNITS = (
    "with"
    + _NOTES
    + r"""
cells as (
  select 'm5c' src_table, call_id row_id, coalesce(run_id, '') run, 'prob' field, prob cell from m5c union all
  select 'all_records', all_id, coalesce(run_id, ''), 'm5c_qual', m5c_qual from all_records union all
  select 'all_records', all_id, coalesce(run_id, ''), 'm6a_qual', m6a_qual from all_records),
kept as (select * from cells where regexp_matches(cell, '[0-9]')),
entries as (
  select run, field, try_cast(case when field = 'prob' then replace(e, ',', '.') else e end as double) v
  from (select run, field, unnest(case when field = 'prob' then [cell] else string_split(cell, ',') end) e from kept
        where not regexp_matches(regexp_replace(lower(cell), '(^|,)(nan|na|\.)', ',', 'g'), '[^-+0-9.,eE \t]'))),
seen as (
  select run, field, count(v) n, count(*) filter (where v > 1) a0, count(*) filter (where v > 45) a1,
    count(*) filter (where v > 100) a2, count(*) filter (where v > 255) a3
  from entries where v is null or not isnan(v) group by 1, 2),
fitted as (
  select run, field, case when a3 > greatest(0.02 * n, 0.5) then 'permille' when a2 > greatest(0.02 * n, 0.5) then 'byte'
    when a1 > greatest(0.02 * n, 0.5) then 'percent' when a0 > greatest(0.02 * n, 0.5) then 'phred' else 'fraction' end fit
  from seen where n > 0),
units as (
  select src_table, row_id, kept.field, cell,
    coalesce(case when cell like '%Q%' then 'phred' when cell like '%\%%' escape '\' or cell like '%pct%' or cell like '%percent%' then 'percent'
      when cell like '%‰%' then 'permille' when cell like '%/%' then 'byte' when cell like '%p=%' then 'fraction' end, noted, fit) unit,
    case kept.field when 'prob' then 'fraction' else 'byte' end own
  from kept left join noted on noted.run = kept.run and noted.field = kept.field left join fitted on fitted.run = kept.run and fitted.field = kept.field)
"""
)

ORACLES = {
    "p1_found": _LINES + "select rec_id from (select rec_id, ok from bed_ok union all select rec_id, ok from all_ok) where not coalesce(ok, false)",
    "p1_reasons": _REASONS,
    "p1_loaded_blocks": _LINES
    + """select rec_id, c[1] chrom, c[2]::bigint as start, c[3]::bigint as "end", c[4] "name", c[6] strand, len(sz) n_blocks, list_sum(sz)::bigint block_bp from bed_ok where ok""",
    "flatten_linkers": _LINES
    + """, b as (select rec_id, c[1] chrom, c[4] fiber_id, c[2]::bigint s0, unnest(sz) w, unnest(st) o, generate_subscripts(sz, 1) i from (select b.*, bed.st from bed_ok b join bed using (rec_id) where ok))
select rec_id, chrom, fiber_id, s0 + o as start, s0 + o + w as "end", w width, o - lag(o + w) over (partition by rec_id order by i) linker from b where w <> 0""",
    "bed12_blocks_expand": _LINES
    + """, b as (select rec_id, c[1] chrom, c[4] fiber_id, c[2]::bigint s0, unnest(sz[2:len(sz) - 1]) w, unnest(st[2:len(st) - 1]) o from (select b.*, bed.st from bed_ok b join bed using (rec_id) where ok))
select rec_id, chrom, fiber_id, s0 + o as start, s0 + o + w as "end", w width from b where w >= 10""",
    "all_tsv_explode": _LINES
    + """, v as (select c_fiber, c_ct, unnest(string_split(c_ref_5mC, ',')) p, unnest(string_split(c_5mC_qual, ',')) q from all_ok join cells using (rec_id) where ok)
select c_fiber read_id, p::bigint ref_position, c_ct chrom, printf('%.6f', q::double / 255.0) prob, 'm' code from v where try_cast(p as bigint) >= 0 and try_cast(q as bigint) is not null""",
    "p2_found": _UNITS + "select distinct src_table, row_id, field, unit from units where unit <> own",
    "p2_mean_fraction": _UNITS
    + r""", vals as (
  select src_table, field, unit, try_cast(regexp_extract(case when field = 'prob' then replace(e, ',', '.') else e end, '[-+]?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?') as double) v
  from (select src_table, field, unit, unnest(case when field = 'prob' then [cell] else string_split(cell, ',') end) e from units)),
frac as (select *, case unit when 'percent' then v / 100.0 when 'permille' then v / 1000.0 when 'byte' then v / 255.0 when 'phred' then 1 - pow(10, -v / 10.0) else v end f from vals)
select src_table, field, unit, count(*) n, round(avg(f), 6) mean_fraction from frac where f >= 0 and f <= 1 group by 1, 2, 3""",
    "p4_found": _P4,
    "p6_found": "with " + _ORPHANS + " select ref_table, ref_month, row_id, kind from found",
    "p6_per_month": "with " + _ORPHANS + " select ref_table, ref_month, kind, count(*) n from found group by 1, 2, 3",
}
