"""Evolutionary formulas as column expressions. k: k-mer length, r: read length, c: coverage, e: error rate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int

#: Smallest distance of a fit's weight, and the standard error's correction factor
LEAST_DISTANCE, CORRECTION = 1e-6, 2.0


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def distance(nshare: Column, n1: Column, n2: Column, k: int) -> Column:
    """-ln(nshare / least(n1, n2)) / k; 1 where nothing is shared."""
    return F.when(nshare == 0, F.lit(1.0)).otherwise(-F.log(nshare / F.least(n1, n2)) / k)


def fit_weight(d: Column, k: int) -> Column:
    """Weight of a distance in a tree fit: e^-kd / (1 - e^-kd), distances below LEAST_DISTANCE raised to it."""
    x = F.exp(-k * F.greatest(d, F.lit(LEAST_DISTANCE)))
    return x / (1 - x)


def kmer_coverage(c: Number, r: Number, k: int) -> Column:
    """Expected occurrences of a genome's k-mer."""
    return _c(c) / _c(r) * (_c(r) - k + 1)


def p_present(c: Number, r: Number, k: int, filtered: bool = False) -> Column:
    """Probability that a k-mer occurs at all, or at least twice."""
    x = kmer_coverage(c, r, k)
    return 1 - (1 + x) * F.exp(-x) if filtered else 1 - F.exp(-x)


def p_correct(c: Number, r: Number, e: Number, k: int, filtered: bool = False) -> Column:
    """Probability that an occurring k-mer also occurs without error (at least twice if filtered)."""
    x, q = kmer_coverage(c, r, k), F.pow(1 - _c(e), F.lit(k))
    if not filtered:
        return 1 - (F.exp(-x * q) - F.exp(-x)) / (1 - F.exp(-x))
    base = 1 - (1 + x) * F.exp(-x)
    return 1 - (F.exp(-x * q) - (1 + x) * F.exp(-x)) / base - q * x * F.exp(-x * q) / base


def p_artefact(c: Number, r: Number, e: Number, k: int) -> Column:
    """Expected erroneous k-mers for each k-mer of the genome."""
    return kmer_coverage(c, r, k) * (1 - F.pow(1 - _c(e), F.lit(k)))


def tip_length(c: Number, r: Number, e: Number, k: int, filtered: bool = False) -> Column:
    """Length that incomplete coverage and sequencing errors add to a tip."""
    p = p_present(c, r, k, filtered) * p_correct(c, r, e, k, filtered)
    return 0.5 / k * F.log(1 / p if filtered else (p + p_artefact(c, r, e, k)) / (p * p))


def genome_size(total_bp: Number, total_kmers: Number, distinct_kmers: Number, r: Number, k: int) -> Column:
    """Bases over the coverage that the k-mers' mean count implies."""
    return _c(total_bp) / (_c(total_kmers) / _c(distinct_kmers) * _c(r) / (_c(r) - k + 1))


def overlap_weight(r: Number, k: int) -> Column:
    """Sum over m = 1 … k-1 of m/k * greatest(0, 2 (r - 2k + m + 1) / (r - k + 1)): correlation of a read's erroneous k-mers."""
    terms = [F.lit(m / k) * F.greatest(F.lit(0.0), 2 * (_c(r) - 2 * k + m + 1) / (_c(r) - k + 1)) for m in range(1, k)]
    return reduce(lambda a, b: a + b, terms)


def distance_error(d: Column, n: Column, a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], k: int, filtered: bool = False) -> Column:
    """Standard error of a distance d. n and a = (c, r, e) are those of the sample with fewer k-mers, b the other's."""
    (ca, ra, ea), (cb, rb, eb) = a, b
    pa = p_present(ca, ra, k, filtered) * p_correct(ca, ra, ea, k, filtered)
    pb = p_present(cb, rb, k, filtered) * p_correct(cb, rb, eb, k, filtered)
    both, kept, cover = pa * pb, n * F.exp(-k * d), kmer_coverage(ca, ra, k)
    more = F.lit(0.0) if filtered else cover * (1 - F.pow(1 - ea / 3, k * d))
    art = F.lit(0.0) if filtered else p_artefact(ca, ra, ea, k)
    mean_s, var_s = kept * (both + more), kept * (both * (1 - both) + more)
    mean_t = n * (pa + art)
    var_t = n * (pa * (1 - pa) * (1 + (ra - k) / cover) + art * (1 + overlap_weight(ra, k)))
    return CORRECTION * F.sqrt(F.log(1 + var_s / (mean_s * mean_s)) + F.log(1 + var_t / (mean_t * mean_t))) / k
