"""Text tables around the k-mer pipeline, read into long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, cnt, complexity) of tab-separated per-sample tables, plain or compressed."""
    return spark.read.csv(path, sep="\t", schema="kmer string, cnt int, complexity int")


def write_counts(counts: DataFrame, path: str) -> None:
    """Tab-separated k-mers and counts in k-mer order, a folder a sample, compressed. A sample of many k-mers is several files, each a range of them, so that no task writes a whole hot sample."""
    counts.repartitionByRange("sample", "kmer").sortWithinPartitions("sample", "kmer").write.mode("overwrite").partitionBy("sample").csv(path, sep="\t", compression="gzip")


def read_header(spark: SparkSession, path: str) -> dict:
    """k, n and the samples of a matrix's header in either dialect: `#sampleN: name` lines, or a line `kmer`, tab, names. Header lines are found by how they begin, however many there are;
    as many as samples reach the driver. Samples are in the order of their numbers."""
    lines = spark.read.text(path)
    is_head = F.col("value").startswith("#") | F.col("value").startswith("kmer\t")
    number = F.regexp_extract("value", r"^#sample(\d+)", 1).try_cast("int")
    head = [r[0] for r in lines.where(is_head).orderBy(F.asc_nulls_first(number)).collect()] + [r[0] for r in lines.where(~is_head).limit(1).collect()]
    out: dict = {"k": None, "n": None, "samples": [], "kmers": False}
    for x in head:
        if x.startswith("#-k"):
            out["k"] = int(x[3:])
        elif x.startswith("#-n"):
            out["n"] = int(x[3:])
        elif x.startswith("#sample"):
            out["samples"].append(x.split(":", 1)[1].strip())
        elif x.startswith("kmer\t"):
            out["samples"] = x.split("\t")[1:]
        else:
            out["kmers"] = bool(x) and not x.split("\t")[0].lstrip("-").isdigit()
            break
    return out


def read_matrix(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """Long table (row, kmer, sample, cnt) of a matrix's non-zero cells; kmer is null if the file has none. ValueError if its k isn't the expected one or a row has another number of cells."""
    h = read_header(spark, path)
    if k is not None and h["k"] not in (None, k):
        raise ValueError(f"the table was made with k = {h['k']}")
    names = h["samples"]
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & ~F.col("value").startswith("kmer\t"))
    cells = F.split("value", "\t")
    at = int(h["kmers"])
    checked = F.when(F.size(cells) != len(names) + at, F.raise_error(F.lit("a row has another number of cells than there are samples"))).otherwise(cells)
    t = rows.select(F.monotonically_increasing_id().alias("row"), checked.alias("c"))
    kmer = F.col("c")[0] if at else F.lit(None).cast("string")
    pairs = F.arrays_zip(F.array(*map(F.lit, names)).alias("sample"), F.transform(F.slice("c", at + 1, len(names)), lambda x: x.cast("int")).alias("cnt"))
    return t.select("row", kmer.alias("kmer"), F.explode(pairs).alias("p")).select("row", "kmer", F.col("p.sample").alias("sample"), F.col("p.cnt").alias("cnt")).where("cnt <> 0")


def matrix_text(counts: DataFrame, samples: list[str], k: int, least: int = 1) -> DataFrame:
    """(value): lines of the matrix of a table (sample, kmer, cnt) for a text sink, the header first and then a line a k-mer in order: read_matrix()'s second dialect."""
    cells = [F.coalesce(F.max(F.when(F.col("sample") == s, F.col("cnt"))), F.lit(0)).cast("string") for s in samples]
    rows = counts.where(F.col("sample").isin(samples)).groupBy("kmer").agg(F.concat_ws("\t", *cells).alias("cells")).select(F.lit(1).alias("_part"), "kmer", F.concat_ws("\t", "kmer", "cells").alias("value"))
    head = counts.sparkSession.createDataFrame([(0, str(i), x) for i, x in enumerate([f"#-k {k}", f"#-n {least}", "kmer\t" + "\t".join(samples)])], "_part int, kmer string, value string")
    return head.unionByName(rows).orderBy("_part", "kmer").select("value")


def share_csv_text(matrix: DataFrame, columns: list[str], group: str = "panel", order: str = "sample") -> DataFrame:
    """(group, text): each group's share matrix as read_share_csv() takes it, from rows (group, order, columns); rows in the order of the columns' names in `order`'s last part."""
    place = F.array_position(F.array(*map(F.lit, columns)), F.element_at(F.split(order, r"\."), -1))
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    lines = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), line.alias("x")))), lambda r: r["x"])
    return matrix.where(place > 0).groupBy(group).agg(F.concat(F.lit(",".join(columns) + "\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def read_diversity(spark: SparkSession, path: str) -> DataFrame:
    """(label, ntotal BIGINT) of lines `Total: n kmers` or `sample: n`."""
    t = spark.read.text(path)
    return t.select(F.regexp_extract("value", r"^(.*?):?\s+\d+", 1).alias("label"), F.regexp_extract("value", r"\s(\d+)", 1).try_cast("bigint").alias("ntotal")).where("ntotal is not null")


def read_tip_info(spark: SparkSession, path: str) -> DataFrame:
    """(spname, coverage, readlength, errorrate) whatever the line ends and white space between; a line of another number of fields is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\r\n|\r|\n")).alias("x")).where("trim(x) <> '' and not startswith(ltrim(x), 'spname')")
    c = F.split(F.trim("x"), r"\s+")
    ok = F.when(F.size(c) != 4, F.raise_error(F.lit("a line of tip information hasn't four fields"))).otherwise(c)
    return lines.select(ok.alias("c")).select(F.col("c")[0].alias("spname"), *[F.col("c")[i + 1].cast("double").alias(n) for i, n in enumerate(("coverage", "readlength", "errorrate"))])


def read_share_csv(spark: SparkSession, path: str) -> DataFrame:
    """(s1, s2, nshare DOUBLE) of a matrix with a header of names and no row labels."""
    names = [x.strip() for x in spark.read.text(path).first()[0].split(",")]
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "x")).where("i > 0 and trim(x) <> ''")
    return rows.select(F.get(F.array(*map(F.lit, names)), F.col("i") - 1).alias("s1"), F.posexplode(F.split("x", ",")).alias("j", "v")).select("s1", F.get(F.array(*map(F.lit, names)), F.col("j")).alias("s2"), F.col("v").cast("double").alias("nshare"))


def read_phylip(spark: SparkSession, path: str, form: str = "square", replicates: bool = False) -> DataFrame:
    """(s1, s2, i, j, d, reps) of PHYLIP distance matrices: square, lower- or upper-triangular; with replicates every distance is followed by their number.

    A file is one matrix of some thousand samples and is read by one task; several files by several. A square matrix must be symmetric within 1e-9, its diagonal 0."""
    from collections.abc import Iterator

    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for text in p.value:
                yield pd.DataFrame(parse_phylip(text, form, replicates), columns=["s1", "s2", "i", "j", "d", "reps"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "s1 string, s2 string, i int, j int, d double, reps double")


def parse_phylip(text: str, form: str = "square", replicates: bool = False) -> list[tuple]:
    words = text.split()
    n, at, step = int(words[0]), 1, 2 if replicates else 1
    if len(words) > 1 and words[1].isdigit() and int(words[1]) == n and form == "square" and len(words) >= 2 + n * (1 + n * step):
        at = 2
    names, cells = [], {}
    for i in range(n):
        name = words[at]
        if any(c in name for c in "():,;[]"):
            raise ValueError(f"a name may not hold brackets or ( ) : , ; — {name}")
        names.append(name)
        at += 1
        for j in {"square": range(n), "lower": range(i), "upper": range(i + 1, n)}[form]:
            cells[i, j] = (float(words[at]), float(words[at + 1]) if replicates else 1.0)
            at += step
    for (i, j), (d, _) in cells.items():
        if i == j and abs(d) > 1e-9 or abs(d - cells.get((j, i), (d,))[0]) > 1e-9:
            raise ValueError(f"the matrix isn't symmetric with a diagonal of 0 at {names[i]}, {names[j]}")
    return [(names[i], names[j], i, j, *v) for (i, j), v in cells.items()]


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(tree_id BIGINT, newick) of files of trees, each ended by a semicolon, also over several lines; what follows the last semicolon is left out if it is blank."""
    t = spark.read.text(path, lineSep=";").select(F.monotonically_increasing_id().alias("tree_id"), F.trim(F.regexp_replace("value", r"[\r\n]+", "")).alias("newick"))
    return t.where("newick <> ''").withColumn("newick", F.concat("newick", F.lit(";")))


def write_trees(trees: DataFrame, path: str) -> None:
    """A tree a line."""
    trees.select(F.col("newick").alias("value")).where("value is not null").write.mode("overwrite").text(path)


def short_names(names: list[str], width: int = 10) -> dict[str, str]:
    """Names of at most `width` characters, told apart by numbers at the end."""
    out: dict[str, str] = {}
    used: set[str] = set()
    for n in names:
        s, i = n[:width], 1
        while s in used:
            s = n[: width - len(str(i))] + str(i)
            i += 1
        used.add(s)
        out[n] = s
    return out


def phylip_lines(distances: DataFrame, group: str = "panel", pad: bool = True) -> DataFrame:
    """(group, text): each group's square matrix from (group, s1, s2, d), each pair once or in both orders; names padded and cut to 10 characters, or whole."""
    import pandas as pd

    def run(p: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*p.s1, *p.s2})
        d = {(a, b): x for a, b, x in zip(p.s1, p.s2, p.d, strict=True)}
        short = short_names(names) if pad else {n: n for n in names}
        cell = lambda a, b: 0.0 if a == b else d.get((a, b), d.get((b, a), 1.0))
        lines = [f"{len(names)} {len(names)}", *[(short[a].ljust(10) if pad else a) + "\t" + "\t".join(f"{cell(a, b):.7f}" for b in names) for a in names]]
        return pd.DataFrame([(p[group].iloc[0], "\n".join(lines) + "\n")], columns=[group, "text"])

    return distances.select(group, "s1", "s2", "d").groupBy(group).applyInPandas(run, f"{group} string, text string")


def fasta_text(reads: DataFrame) -> DataFrame:
    """(value): a FASTA record a read, for a text sink; reads without a sequence are left out."""
    comment: Column = F.when(F.coalesce(F.col("comment"), F.lit("")) != "", F.concat(F.lit(" "), "comment")).otherwise("")
    return reads.where("seq is not null and seq <> ''").select(F.concat(F.lit(">"), F.coalesce("name", F.lit("")), comment, F.lit("\n"), "seq").alias("value"))
