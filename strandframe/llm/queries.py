"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.cooccurrence import pair_counts
from strandframe.llm.leakage import leaked_items
from strandframe.llm.mixing import mix, shares, token_counts
from strandframe.llm.quantiles import RANK_ERROR, build_sketches, merge_sketches, quantiles
from strandframe.llm.truncation import rate_per_source, truncated
from strandframe.session import table

PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _measures(spark: SparkSession, d: str) -> DataFrame:
    both = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in ("frac_5mc_coverage", "frac_nuc_coverage")])
    return table(spark, d, "features").select("sample", "calc_day", F.inline(both))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per sample over all days, from the sketches of single days."""
    days = build_sketches(_measures(spark, d), ["sample", "measure", "calc_day"], "v")
    return quantiles(merge_sketches(days, ["sample", "measure"]), ["sample", "measure"], PERCENTILES)


def p3_monthly_medians(spark: SparkSession, d: str) -> DataFrame:
    days = build_sketches(_measures(spark, d), ["sample", "measure", "calc_day"], "v")
    months = days.withColumn("month", F.date_format("calc_day", "yyyy-MM"))
    keys = ["sample", "measure", "month"]
    return quantiles(merge_sketches(months, keys), keys, [0.5])


def p3_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Each percentile's rank in the rows themselves, held against the stated bound."""
    got = p3_percentiles(spark, d)
    rows = _measures(spark, d).where("v is not null and not isnan(v)").withColumnRenamed("sample", "s").withColumnRenamed("measure", "m")
    # the code keeps 20 bits of the fraction: values of the same code count as equal
    low, high = F.col("value") - F.abs("value") * 2e-6, F.col("value") + F.abs("value") * 2e-6
    counted = got.join(rows, (F.col("sample").eqNullSafe(F.col("s"))) & (F.col("measure") == F.col("m")))
    ranks = counted.groupBy("sample", "measure", "share", "n").agg(F.sum((F.col("v") < low).cast("long")).alias("below"), F.sum((F.col("v") <= high).cast("long")).alias("upto"))
    slack = F.lit(RANK_ERROR) * F.col("n") + 1
    ok = (F.col("below") <= F.col("share") * F.col("n") + slack) & (F.col("upto") >= F.col("share") * F.col("n") - slack)
    return ranks.select("sample", "measure", "share", "n", ok.alias("within_bound"))


def _element_rows(spark: SparkSession, d: str) -> DataFrame:
    name = lambda p: F.concat(F.col(f"{p}_chrom"), F.lit(":"), F.col(f"{p}_start").cast("string"), F.lit("-"), F.col(f"{p}_end").cast("string"))
    return table(spark, d, "cov_bed").select(name("st").alias("grp"), name("el").alias("item"), F.col("fiber_id").alias("basket"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = pair_counts(_element_rows(spark, d)).where("n_ab >= 10 and n_ab * n >= 2 * n_a * n_b")
    return pairs.select(F.col("grp").alias("stitched_id"), F.col("item_a").alias("element_a"), F.col("item_b").alias("element_b"))


def p5_pair_ratios(spark: SparkSession, d: str) -> DataFrame:
    pairs = pair_counts(_element_rows(spark, d))
    return pairs.select(
        F.col("grp").alias("stitched_id"), F.col("item_a").alias("element_a"), F.col("item_b").alias("element_b"), "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("odds_ratio", 6).alias("odds_ratio")
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_leaks_per_item(spark: SparkSession, d: str) -> DataFrame:
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p7_as_written(spark: SparkSession, d: str) -> DataFrame:
    """Leaks among the ASCII letters and digits of whole texts, markup taken as text like any other."""
    plain = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]+", " ").alias(c)
    return leaked_items(table(spark, d, "documents").select("doc_id", plain("text")), table(spark, d, "eval_items").select("item_id", plain("item_text")))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(token_counts(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return shares(mix(token_counts(table(spark, d, "documents")), targets), targets)


def p8_within_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source with a target and documents keeps its cap, and its share within one document's tokens."""
    targets = table(spark, d, "mix_targets")
    counts = token_counts(table(spark, d, "documents"))
    mixed = mix(counts, targets)
    most = counts.agg(F.max("n_tokens").alias("largest"))
    caps = targets.groupBy(F.col("source").alias("s")).agg(F.min("max_repeats").alias("cap"), F.max("target_share").alias("target"))
    per = mixed.groupBy("source").agg(F.max("copies").alias("copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    per = per.join(F.broadcast(caps), F.col("source") == F.col("s"))  # a row a configured source
    total = per.agg(F.sum("tokens").alias("all_tokens"), F.sum("target").alias("all_target"))
    off = F.abs(F.col("tokens") - F.col("all_tokens") * F.col("target") / F.col("all_target"))
    # the total may be off by a document of each source as well
    return per.join(total).join(most).select("source", (F.col("copies") <= F.col("cap")).alias("within_cap"), (off <= 2 * F.col("largest")).alias("within_share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(table(spark, d, "documents")).select("doc_id")


def p9_rate_per_source(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return rate_per_source(docs, truncated(docs))


QUERIES = {f.__name__: f for f in (p3_percentiles, p3_monthly_medians, p3_within_bound, p5_found, p5_pair_ratios, p7_found, p7_leaks_per_item, p7_as_written, p8_mixture, p8_shares, p8_within_bounds, p9_found, p9_rate_per_source)}

_PAIRS = """
with b as (
  select distinct st_chrom || ':' || st_start || '-' || st_end g, el_chrom || ':' || el_start || '-' || el_end e, fiber_id f
  from cov_bed where fiber_id is not null and st_chrom is not null and st_start is not null and st_end is not null
    and el_chrom is not null and el_start is not null and el_end is not null),
n as (select g, count(distinct f) n from b group by 1),
s as (select g, e, count(*) n_e from b group by 1, 2),
p as (select x.g, x.e a, y.e b, count(*) n_ab from b x join b y on x.g = y.g and x.f = y.f and x.e < y.e group by 1, 2, 3),
r as (select p.g stitched_id, p.a element_a, p.b element_b, n_ab, sa.n_e n_a, sb.n_e n_b, n.n from p join n using (g)
  join s sa on sa.g = p.g and sa.e = p.a join s sb on sb.g = p.g and sb.e = p.b)
"""
_VALUES = """
with v as (select sample, 'frac_5mc_coverage' measure, frac_5mc_coverage v from features union all select sample, 'frac_nuc_coverage', frac_nuc_coverage from features),
n as (select sample, measure, count(*) n from v where v is not null and not isnan(v) group by 1, 2)
"""

_GRAMS = """{t} as (select {i} i, string_split(trim(regexp_replace(lower(regexp_replace({c}, '[^A-Za-z0-9]+', ' ', 'g')), ' +', ' ', 'g')), ' ') w from {f} where {c} is not null),
{t}_grams as (select distinct i, array_to_string(w[k:k + 11], ' ') g from (select i, w, unnest(range(1, len(w) - 10)) k from {t}))"""

ORACLES = {
    "p7_as_written": "with " + _GRAMS.format(t="d", i="doc_id", c="text", f="documents") + ",\n" + _GRAMS.format(t="q", i="item_id", c="item_text", f="eval_items")
    + "\nselect distinct d_grams.i doc_id, q_grams.i item_id from d_grams join q_grams using (g)",
    "p3_within_bound": _VALUES + f"select sample, measure, s.share, n, true within_bound from n, (select unnest({PERCENTILES})::double share) s",
    "p8_within_bounds": "select source, true within_cap, true within_share from mix_targets where target_share > 0 and max_repeats > 0 and source in (select source from documents where text <> '')",
    "p5_found": _PAIRS + "select stitched_id, element_a, element_b from r where n_ab >= 10 and n_ab * n >= 2 * n_a * n_b",
    "p5_pair_ratios": _PAIRS
    + """select *, round(n_ab * n / (n_a * n_b)::double, 6) lift,
  round((n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5)::double / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5))::double, 6) odds_ratio from r""",
}
