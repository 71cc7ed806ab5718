"""K-mers as column expressions: everything here stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq: Column | str) -> Column:
    """Reverse complement of upper-case text; U pairs with A, letters other than ACGTU stay as they are. Null gives null."""
    return F.reverse(F.translate(as_column(seq), "ACGTU", "TGCAA"))


def canonical(kmer: Column | str) -> Column:
    """The smaller, as a string, of a k-mer and its reverse complement. A<C<G<T, so this is also the smaller 2-bit code."""
    k = as_column(kmer)
    return F.least(k, reverse_complement(k))


def encode_2bit(kmer: Column | str) -> Column:
    """2-bit code (A=0 … T=3) of an upper-case ACGT k-mer of at most 31 letters as BIGINT; order is that of the strings."""
    return F.conv(F.translate(as_column(kmer), "ACGT", "0123"), 4, 10).cast("bigint")


def decode_2bit(code: Column | str, k: int) -> Column:
    """Inverse of encode_2bit for k-mers of k letters."""
    return F.translate(F.lpad(F.conv(as_column(code).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def usable_kmers(kmer_t: DataFrame, *keep: str, k: int = 21) -> DataFrame:
    """Usable rows of a k-mer table: sample isn't null and upper(kmer) is k letters of A, C, G and T.

    Returns the columns `keep` and `kmer`, the canonical k-mer. Rows aren't deduplicated. A null k-mer, a damaged one or one of another
    length is dropped; an empty table gives an empty one. Columns not asked for never leave the scan.
    """
    u = F.upper("kmer")
    rows = kmer_t.where(F.col("sample").isNotNull()).select(*[c for c in keep if c != "kmer"], u.alias("kmer"))
    return rows.where((F.length("kmer") == k) & F.col("kmer").rlike(f"^[ACGT]{{{k}}}")).withColumn("kmer", canonical("kmer"))


def reverse_complement_code(code: Column | str, k: int) -> Column:
    """reverse_complement() of a 2-bit code of k letters, by bits: complements are inverted bits, and letters change places by halves, quarters and so on."""
    x = F.bitwise_not(as_column(code))
    for n, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = F.shiftrightunsigned(x, n).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), n))
    return F.shiftrightunsigned(F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32)), 64 - 2 * k)


def usable_codes(kmer_t: DataFrame, *keep: str, k: int = 21) -> DataFrame:
    """usable_kmers() with the canonical k-mer as its 2-bit code: the columns `keep` and `code` BIGINT, in the order of the strings. k of at most 31.

    No text is made but that of the code's digits, so this costs less than usable_kmers() and what is shuffled is 8 bytes a k-mer. A filter on something derived from `code` is
    pushed below its expression, which is then made over and over: filter in Arrow batches, or after an aggregation or a shuffle."""
    ok = F.col("sample").isNotNull() & (F.length("kmer") == k) & F.col("kmer").rlike(f"^[ACGTacgt]{{{k}}}")
    rows = kmer_t.where(ok).select(*keep, F.conv(F.translate("kmer", "ACGTacgt", "01230123"), 4, 10).cast("bigint").alias("_code"))
    return rows.select(*keep, F.least("_code", reverse_complement_code("_code", k)).alias("code"))


def acgt_runs(seq: Column | str) -> Column:
    """Maximal runs of A, C, G, T (either letter case, upper-cased): every other character breaks a run, as in any text that isn't ASCII. Null gives null."""
    return F.split(F.translate(as_column(seq), "acgt", "ACGT"), "[^ACGT]+")


#: K-mers that one row of a run is exploded to at most; longer runs are cut into overlapping stretches first.
STRETCH = 1 << 16


def explode_kmers(reads: DataFrame, seq: str, k: int, *keep: str) -> DataFrame:
    """(keep, kmer): the canonical k-mers of every read, one row an occurrence. Null, empty and short reads give no row; sequences may be as long as a row can be.

    Windows are cut from bytes, where a position costs nothing to find, and the other strand is made once a stretch: its windows mirror those of the first.
    """
    runs = reads.select(*keep, F.explode(acgt_runs(seq)).alias("_run")).where(F.length("_run") >= k).select(*keep, F.col("_run").cast("binary").alias("_run"))
    n = F.length("_run")
    parts = runs.select(*keep, "_run", F.explode(F.sequence(F.lit(0), ((n - k) / STRETCH).cast("int"))).alias("_at"))
    cut = parts.select(*keep, F.substring("_run", F.col("_at") * STRETCH + 1, F.lit(STRETCH + k - 1)).alias("_run"))
    both = cut.select(*keep, "_run", F.reverse(F.translate(F.col("_run").cast("string"), "ACGT", "TGCA")).cast("binary").alias("_rc"))
    each = both.select(*keep, "_run", "_rc", F.explode(F.sequence(F.lit(1), n - (k - 1))).alias("_i"))
    w = F.least(F.substring("_run", F.col("_i"), F.lit(k)), F.substring("_rc", F.length("_rc") - (k - 2) - F.col("_i"), F.lit(k)))
    return each.select(*keep, w.cast("string").alias("kmer"))


def well_mixed(kmer: Column | str, k: int) -> Column:
    """Special filter: every base at least twice, none in more than half of the k-mer, no run of five or more."""
    x = as_column(kmer)
    each = [F.length(x) - F.length(F.replace(x, F.lit(b), F.lit(""))) for b in "ACGT"]
    ok = ~x.rlike("A{5}|C{5}|G{5}|T{5}")
    for n in each:
        ok = ok & (n >= 2) & (n * 2 <= k)
    return ok


def complexity(kmer: Column | str, k: int) -> Column:
    """Number of distinct non-empty substrings of a k-mer."""
    x = as_column(kmer)
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda n: F.transform(F.sequence(F.lit(1), F.lit(k) - n + 1), lambda i: F.substring(x, i, n))))
    return F.size(F.array_distinct(every))
