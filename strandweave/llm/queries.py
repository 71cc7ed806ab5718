"""Queries of the numbered problems over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import bpe, cooccur, distinct, frequency, heavy, overlap, packing, quality

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _signed_round(column: str, digits: int) -> Column:
    """round() by magnitude that keeps the sign, also of what becomes zero: -0.0 still tells a pair seen less often than by chance."""
    size = F.round(F.abs(column), digits)
    return F.when(F.col(column).cast("string").startswith("-"), -size).otherwise(size)


def queries() -> dict[str, Query]:
    k = lambda s, d: _table(s, d, "kmer_t")
    return {
        "p1_found": lambda s, d: distinct.repeated_days(k(s, d)),
        "p1_distinct": lambda s, d: distinct.distinct_rollup(k(s, d), sample_days=True),
        "p1_intervals": lambda s, d: distinct.interval_check(k(s, d)).withColumn("count_day", F.date_format("count_day", "yyyy-MM-dd")),
        "p2_found": lambda s, d: overlap.sample_overlaps(k(s, d), 48).select("s1", "s2"),
        "p2_overlap": lambda s, d: overlap.sample_overlaps(k(s, d)),
        "p3_found": lambda s, d: cooccur.more_than_chance(cooccur.sample_cooccurrence(k(s, d))).select("s1", "s2"),
        "p3_cooccur": lambda s, d: cooccur.sample_cooccurrence(k(s, d)).withColumns({"lift": F.round("lift", 6), "llr": _signed_round("llr", 4), "p_value": F.round("p_value", 6)}),
        "p4_found": lambda s, d: frequency.kmer_frequencies(k(s, d)).where("mark is not null").select("kmer", "mark"),
        "p4_frequency": lambda s, d: frequency.kmer_frequencies(k(s, d)),
        "p5_found": lambda s, d: heavy.heaviest_kmers(k(s, d)).select("kmer"),
        "p5_heavy": lambda s, d: heavy.heaviest_kmers(k(s, d)),
        "p5_totals": lambda s, d: heavy.heaviest_kmers(k(s, d)).select("kmer", "total"),
        "p7_ids": lambda s, d: bpe.encode_texts(_table(s, d, "documents"), "doc_id", "text"),
        "p8_found": lambda s, d: packing.divided(packing.pack_documents(_table(s, d, "documents"))),
        "p8_packing": lambda s, d: packing.pack_documents(_table(s, d, "documents")),
        "p8_coverage": lambda s, d: packing.coverage(packing.pack_documents(_table(s, d, "documents")), packing.token_counts(_table(s, d, "documents"), "doc_id", "text")),
        "p8_fullness": lambda s, d: packing.fullness(packing.pack_documents(_table(s, d, "documents"))).select((F.col("containers") <= F.ceil(F.col("least") * 1.02)).alias("tight"), "over"),
        "p9_found": lambda s, d: quality.page_quality(_table(s, d, "documents"), _table(s, d, "common_words")).where(quality.is_boilerplate()).select("doc_id"),
        "p9_quality": lambda s, d: quality.page_quality(_table(s, d, "documents"), _table(s, d, "common_words")),
        "p9_statistics": lambda s, d: quality.page_quality(_table(s, d, "documents"), _table(s, d, "common_words")).select("doc_id", "n_words", *[F.round(c, 9).alias(c) for c in quality.STATISTICS[1:7]]),
    }


_USABLE = """u as (select distinct rec_id, panel, sample, cnt, count_day, least(upper(kmer), reverse(translate(upper(kmer), 'ACGT', 'TGCA'))) as kmer
  from kmer_t where sample is not null and regexp_full_match(upper(kmer), '[ACGT]{21}'))"""
_PAIRS = f"""{_USABLE}, k as (select distinct sample, kmer from u), n as (select sample, count(*) as n from k group by sample),
p as (select a.sample as s1, b.sample as s2, count(*) as shared from k a join k b on a.kmer = b.kmer and a.sample < b.sample group by 1, 2),
q as (select s1, s2, shared, x.n as n1, y.n as n2 from p join n x on s1 = x.sample join n y on s2 = y.sample)"""
_TOGETHER = f"""{_USABLE}, k as (select distinct panel, sample, kmer from u where panel is not null),
n as (select panel, sample, count(*) as n from k group by panel, sample), t as (select panel, count(distinct kmer) as n from k group by panel),
p as (select a.panel, a.sample as s1, b.sample as s2, count(*) as n12 from k a join k b on a.panel = b.panel and a.kmer = b.kmer and a.sample < b.sample group by 1, 2, 3),
q as (select p.panel, s1, s2, n12, x.n as n1, y.n as n2, t.n as n from p join n x on p.panel = x.panel and s1 = x.sample join n y on p.panel = y.panel and s2 = y.sample join t on t.panel = p.panel)"""
_TERM = "case when {k} > 0 then {k} * ln({k}::double * n / ({r}::double * {c})) else 0 end"
_G2 = "greatest(0, 2 * (" + " + ".join(_TERM.format(k=k, r=r, c=c) for k, r, c in (("n12", "n1", "n2"), ("(n1 - n12)", "n1", "(n - n2)"), ("(n2 - n12)", "(n - n1)", "n2"), ("(n - n1 - n2 + n12)", "(n - n1)", "(n - n2)"))) + "))"
_T = "(1 / (1 + sqrt(g / 2) / 2))"
_P = f"{_T} * exp(" + "".join(f"{c} + {_T} * (" for c in cooccur.ERFC[:-1]) + f"{cooccur.ERFC[-1]}" + ")" * (len(cooccur.ERFC) - 1) + " - g / 2)"
_FREQUENCY = f"""{_USABLE}, f as (select kmer, coalesce(sum(cnt), 0)::bigint as occurrences, count(distinct sample) as records from u group by kmer),
m as (select *, case when records = 1 and occurrences <= 1 then 'rare' when records * 2 >= (select count(distinct sample) from u) then 'common' end as mark from f)"""


_LEVELS = " union all ".join(
    f"select '{level}' as level, " + ", ".join(f"{c if c in keys else f'null::{t}'} as {c}" for c, t in (("count_day", "date"), ("panel", "varchar"), ("sample", "varchar"))) + f", count(distinct kmer) as n, true as inside from u where {' and '.join([f'{k} is not null' for k in keys] or ['true'])} group by all having count(*) > 0"
    for level, keys in distinct.LEVELS.items()
)
_SPACE = r"\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
_QUALITY = rf"""d as (select doc_id, coalesce(text, '') as t from documents),
l as (select doc_id, t, [x for x in [regexp_replace(regexp_replace(y, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '') for y in regexp_split_to_array(t, '{_BREAK}')] if x <> ''] as ls,
  [x for x in [regexp_replace(regexp_replace(y, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '') for y in regexp_split_to_array(t, '\n[{_SPACE}]*\n')] if x <> ''] as ps,
  [lower(w) for w in regexp_extract_all(t, '[\p{{L}}\p{{Nl}}\p{{No}}]+')] as ws, length(regexp_replace(t, '[{_SPACE}]+', '', 'g')) as solid, length(regexp_replace(t, '[^\p{{L}}\p{{N}}]+', '', 'g')) as alnum from d),
c as (select list(distinct lower(word)) as cs from common_words where word is not null)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_intervals": f"with {_USABLE}, e as ({_LEVELS}) select * replace (count_day::varchar as count_day) from e",
        "p5_totals": f"with {_USABLE} select kmer, coalesce(sum(cnt), 0)::bigint as total from u group by kmer order by total desc, kmer limit 20",
        "p8_coverage": "select doc_id, true as covered from documents",
        "p8_fullness": "select true as tight, 0::bigint as over",
        "p9_statistics": rf"""with {_QUALITY} select doc_id, len(ws) as n_words, round(case when len(ws) > 0 then list_sum([length(w) for w in ws]) / len(ws) else 0 end, 9) as mean_word_length,
round(case when solid > 0 then (solid - alnum) / solid else 0 end, 9) as symbol_share,
round(case when len(ls) > 0 then len([x for x in ls if regexp_matches(x, '[.!?:;,…]["''”’»)]*$')]) / len(ls) else 0 end, 9) as punctuated_line_share,
round(case when len(ws) > 0 then len([w for w in ws if list_contains(cs, w)]) / len(ws) else 0 end, 9) as common_word_share,
round(case when len(ls) > 0 then 1 - len(list_distinct(ls)) / len(ls) else 0 end, 9) as repeated_line_share, round(case when len(ps) > 0 then 1 - len(list_distinct(ps)) / len(ps) else 0 end, 9) as repeated_paragraph_share from l, c""",
        "p1_found": f"""with {_USABLE}, d as (select distinct sample, count_day, kmer from u where count_day is not null),
o as (select sample, count_day, coalesce(count_day - lag(count_day) over (partition by sample, kmer order by count_day) <= 30, false) as old from d)
select strftime(count_day, '%Y-%m-%d') as count_day, sample from o group by 1, 2 having count(*) filter (where not old) * 2 < count(*)""",
        "p2_found": f"with {_PAIRS} select s1, s2 from q where shared * 100 >= least(n1, n2) * 48",
        "p2_overlap": f"with {_PAIRS} select s1, s2, shared, n1, n2, shared / least(n1, n2) as share from q",
        "p3_found": f"with {_TOGETHER} select s1, s2 from q where n12::hugeint * n * 100 >= n1::hugeint * n2 * 175",
        "p3_cooccur": f"with {_TOGETHER}, r as (select *, n12::double * n / (n1::double * n2) as l, {_G2} as g from q) select panel, s1, s2, n12, n1, n2, n, round(l, 6) as lift, round(case when l < 1 then -g else g end, 4) as llr, round({_P}, 6) as p_value, l >= 1 and g >= {cooccur.critical_value(cooccur.LEVEL)!r} as significant from r",
        "p4_found": f"with {_FREQUENCY} select kmer, mark from m where mark is not null",
        "p4_frequency": f"with {_FREQUENCY} select kmer, occurrences, records, mark from m",
        "p5_found": f"with {_USABLE} select kmer from u group by kmer order by coalesce(sum(cnt), 0) desc, kmer limit 20",
    }
