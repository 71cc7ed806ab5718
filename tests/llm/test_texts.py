"""Encoding against a public library, packing, and page quality."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import bpe, packing, quality
from strandweave.llm.queries import queries

ALPHABET = "aAbé ’'s\t\n\r\x0b\x1c\x1d\x85\xa0　٣1½!?<|endoftext|>😀中ß ​'ll've"
SCHEMA = "doc_id bigint, text string, ids string, n string, piece string, container string, words string"


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    e = bpe.encoder()
    plain = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=plain, mergeable_ranks=e.ranks, special_tokens={})


def texts():
    rnd = random.Random(2)
    some = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    long = ["a" * 30_000, "ab" * 20_000, " " * 4000, "\n" * 3000 + "x", "".join(rnd.choice("abcdefghij") for _ in range(100_000)), "the " * 9000, "<|endoftext|>", "\x00\x01"]
    return [*some, *long, "", None]


def frame(spark, xs):
    return spark.createDataFrame([(i, x, "", "", "", "", "") for i, x in enumerate(xs)], SCHEMA).repartition(5)


def test_ids_are_the_librarys(spark, reference):
    xs = texts()
    got = {r.doc_id: r.ids for r in bpe.encode_texts(frame(spark, xs), "doc_id", "text").collect()}
    assert len(got) == len(xs)
    assert not [x for i, x in enumerate(xs) if got[i] != reference.encode_ordinary(x or "")]


def test_memory_that_overflows_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 20)
    e, xs = bpe.Encoder(), texts()[:600]
    for i in range(0, len(xs), 50):
        for x, ids in zip(xs[i : i + 50], e.encode(xs[i : i + 50]), strict=True):
            assert np.frombuffer(ids, np.int32).tolist() == reference.encode_ordinary(x or "")
    assert e.merge([]) == []


def test_ranks_come_out_in_order():
    rnd = random.Random(1)
    q, want = bpe.Ranks(300_000), []
    for _ in range(2000):
        r = rnd.choice([0, 5, 299_999, rnd.randrange(300_000)])
        q.put(r, len(want))
        want.append((r, len(want)))
    got = []
    while (r := q.first()) >= 0:
        got += [(r, p) for p in sorted(q.buckets[r])]
        q.clear(r)
    assert got == sorted(want)


def test_empty_table_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a"), (1, "a"), (2, None)], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), len(r.ids)) for r in bpe.encode_texts(df, "doc_id", "text").collect()) == [("1", 1), ("1", 1), ("2", 0), ("None", 2)]
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0


# --- packing


def packed(spark, sizes, parts=4, **more):
    df = spark.createDataFrame([(i, s, "") for i, s in enumerate(sizes)], "k bigint, s bigint, window string").repartition(parts)
    return packing.pack(df, "k", "s", **more)


def check(rows, sizes, capacity=2048):
    fill, got = {}, {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.n
        got.setdefault(r.k, []).append((r.piece, r.first, r.n))
    assert max(fill.values()) <= capacity
    for k, s in enumerate(sizes):
        at = 0
        for i, (piece, first, n) in enumerate(sorted(got[k])):
            assert (piece, first) == (i, at)
            at += n
        assert at == max(s or 0, 0)
        assert len(got[k]) == max(1, -(-(s or 0) // capacity))
    return fill


def test_packing_is_whole_and_tight(spark):
    rnd = random.Random(5)
    sizes = [rnd.choice([0, None, -3, 1, 2047, 2048, 2049, 4096, 9000, rnd.randint(1, 900), rnd.randint(1, 900), rnd.randint(100, 2000)]) for _ in range(4000)]
    fill = check(packed(spark, sizes).collect(), sizes)
    assert sum(fill.values()) / 2048 / len([f for f in fill.values() if f]) > 0.97


def test_packing_small_cases(spark):
    assert packed(spark, []).count() == 0
    check(packed(spark, [0, 0, None]).collect(), [0, 0, None])
    check(packed(spark, [2048] * 50).collect(), [2048] * 50)
    check(packed(spark, [1] * 3000, windows=1).collect(), [1] * 3000)
    assert packing.divided(packed(spark, [2048, 2049, 10_000, 5])).select("k").collect() == packed(spark, [2048, 2049, 10_000, 5]).where("piece = 1").select("k").collect()
    assert {r.k for r in packing.divided(packed(spark, [2048, 2049, 10_000, 5])).collect()} == {1, 2}


def test_leftovers_are_merged(spark):
    sizes = [100] * 400
    rows = packed(spark, sizes, parts=40).collect()
    assert len({r.container for r in rows}) <= 400 // 20 + 2


def test_open_windows_are_bounded():
    w = packing.Windows(100, 3, iter(range(1000)))
    for s in [60, 61, 62, 63, 64, 40, 39, 100, 0]:
        w.place(s)
        assert len(w.open) <= 3


def test_documents_are_sized_in_tokens(spark, reference):
    xs = ["the " * 3000, "a", "", None, "harbour courier " * 500]
    rows = packing.pack_documents(frame(spark, xs)).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    assert {r.doc_id: r.n for r in rows} == {i: len(reference.encode_ordinary(x or "")) for i, x in enumerate(xs)}


# --- quality

ARTICLE = "On the 5th the severe church attended the petition early,\nbut they were not received. The quiet letter had not\nbeen praised for 18 years; he had it from the servant\nin the engine at Ardwenwen."
NOISY = ARTICLE.replace("church", "chnrch").replace("petition", "petiti0n").replace("servant", "ser=\nvant")
LIST = "LIST OF JURORS\n1. Selcasard, G., joiner\n2. Wickley, R., grocer\n3. Wickselcas, J., joiner\n4. Selgarton, W., carter"
TABLE = "STOCKS\npont .............. 7¼ .. 43½\nfermier ........ 12¼ .. —\nmoulin\t19 3\t54 0"
SHUFFLED = "no eht h5t eht erevse hcruhc dednetta eht noititep\ntub yeht erew ton deviecer eht teiuq rettel dah ton\nneeb desiarp rof 81 sraey eh dah ti morf eht tnavres"
MARKS = ">^>».■/\n[»°[^[|\nH\nn\nı"


def pages(spark):
    rnd = random.Random(3)
    words = ARTICLE.replace("\n", " ").split()
    xs = [ARTICLE] * 30 + [" ".join(rnd.sample(words, len(words))) for _ in range(30)] + [NOISY, LIST, TABLE, SHUFFLED, MARKS, "", None, " \r\n ", ARTICLE.replace("\n", "\r\n"), ARTICLE + "\n" + LIST.replace("1.", "0.") + "\n" + TABLE, "THE SEVERE CHURCH"]
    common = spark.createDataFrame([("en", w) for w in "the of and to a in that it was he for on they but were not had been from".split()] + [(None, None)], "lang string, word string")
    return xs, frame(spark, xs), common


def test_articles_lists_tables_and_debris(spark):
    xs, df, common = pages(spark)
    got = {r.doc_id: r.not_running_share for r in quality.page_quality(df, common).collect()}
    assert len(got) == len(xs)
    off = {i for i, s in got.items() if s > 0.5}
    assert off == {xs.index(LIST), xs.index(TABLE), xs.index(SHUFFLED), xs.index(MARKS), len(xs) - 2}


def test_statistics(spark):
    _, df, common = pages(spark)
    text = "The end. The end.\nThe end. The end.\n\nOne's 12!\n\nOne's 12!"
    row = quality.page_quality(df.where("doc_id < 60").unionByName(frame(spark, [text]).withColumn("doc_id", F.lit(99))), common).where("doc_id = 99").first()
    assert row.n_words == 12
    assert row.mean_word_length == pytest.approx((8 * 3 + 2 * 4) / 12)
    assert row.symbol_share == pytest.approx(8 / 44)
    assert row.punctuated_line_share == 1.0
    assert row.common_word_share == pytest.approx(4 / 12)
    assert row.repeated_line_share == 0.5
    assert row.repeated_paragraph_share == pytest.approx(1 / 3)
    assert row.dominant_run_share == pytest.approx(24 / 32)


def test_nothing(spark):
    _, df, common = pages(spark)
    assert quality.page_quality(df.limit(0), common).count() == 0
    rows = quality.page_quality(frame(spark, [None, "", " \n"]), common.limit(0)).collect()
    assert {tuple(r)[1:] for r in rows} == {(0, *[0.0] * 8)}


def test_no_common_word_is_left_out(spark, monkeypatch):
    _, df, common = pages(spark)
    with monkeypatch.context() as m:
        m.setattr(quality, "MOST_COMMON", 18)
        with pytest.raises(ValueError, match="more than 18"):
            quality.page_quality(df, common)
    twice = common.unionByName(common.select("lang", F.upper("word").alias("word")))
    row = {r.doc_id: r.common_word_share for r in quality.page_quality(df, twice).collect()}
    assert row == {r.doc_id: r.common_word_share for r in quality.page_quality(df, common).collect()}
    assert row[0] > 0.3


def test_known_words_are_not_rearrangements(spark):
    df = frame(spark, ["the church"] * 40 + ["hte chruch"] * 4 + ["unique"] + ["iii rnrn"] * 9)
    assert quality.known_words(df, "text") == {"the", "church", "unique", "chruch"} - {"chruch"} or quality.known_words(df, "text") >= {"the", "church"}
    assert not quality.known_words(df, "text") & {"hte", "iii", "rnrn", "chruch"}


def test_pages_whose_only_sign_is_repetition(spark, tmp_path):
    line = "the quiet letter had not been received early"
    other = ARTICLE.replace("\n", " ")
    repeated = [f"{line}\n" * 5 + "they were praised for it", f"{line}\n\n" * 4 + "he had it", "they were not received " * 9, "\n".join(x for i in range(5) for x in (line, f"they attended the church {'abcde'[i]}"))]
    xs = [ARTICLE] * 30 + repeated + [f"{ARTICLE}\n{ARTICLE}", other, LIST]
    frame(spark, xs).write.parquet(str(tmp_path / "documents.parquet"))
    pages(spark)[2].write.parquet(str(tmp_path / "common_words.parquet"))
    off = {r.doc_id for r in queries()["p9_found"](spark, str(tmp_path)).collect()}
    assert off == {30, 31, 32, len(xs) - 1}
    shares = {r.doc_id: r.not_running_share for r in queries()["p9_quality"](spark, str(tmp_path)).collect()}
    assert max(shares[i] for i in (30, 31, 32)) <= 0.5


def test_dominant_runs_against_plain_counting():
    from collections import Counter

    def plain(words):
        most = 0
        for n in (2, 3, 4):
            k = Counter(zip(*(words[i:] for i in range(n)), strict=False))
            begins = {}
            for i in range(len(words) - n + 1):
                begins.setdefault(tuple(words[i : i + n]), i)
            often = [r for r in k if k[r] > 1]
            if often:
                run = min(often, key=lambda r: (-k[r] * sum(map(len, r)), begins[r]))
                inside = {j for i in range(len(words) - n + 1) if tuple(words[i : i + n]) == run for j in range(i, i + n)}
                most = max(most, sum(len(words[j]) for j in inside))
        return most

    rnd = random.Random(8)
    pages = [[rnd.choice(["a", "bb", "ccc", "dddd", "eeeee"][: rnd.randint(1, 5)]) for _ in range(rnd.randint(0, 30))] for _ in range(400)] + [[], ["x"], ["a"] * 500]
    assert quality.dominant_runs(pages) == [plain(p) for p in pages]
    assert quality.dominant_runs([]) == []
    assert quality.dominant_runs([[], []]) == [0, 0]


# --- 260 invented pages with their labels

COMMON = "the of and to a in that it was he for on they but were not had been from with his at by which as be is this her would their all one we there".split()


class Invented:
    """Pages made at random from invented words; what a page is, is known."""

    def __init__(self, seed):
        self.r = random.Random(seed)
        self.words = [self.word() for _ in range(350)]
        self.names = [self.word().capitalize() for _ in range(200)]

    def word(self):
        return "".join(self.r.choice("bdfglmnprstvk") + self.r.choice("aeiou") + self.r.choice(["", "", "n", "r", "st"]) for _ in range(self.r.randint(1, 3)))

    def misread(self, w):
        i = self.r.randrange(len(w))
        return w[:i] + self.r.choice("crnliq1") + w[i + 1 :]

    def sentence(self):
        ws = [self.r.choice(COMMON) if self.r.random() < 0.5 else self.r.choice(self.words) for _ in range(self.r.randint(7, 20))]
        ws = [self.misread(w) if self.r.random() < 0.06 else self.r.choice(self.names) if self.r.random() < 0.04 else w for w in ws]
        return ws[0].capitalize() + " " + " ".join(ws[1:]) + "."

    def prose(self, lines):
        text, out = " ".join(self.sentence() for _ in range(lines)), []
        while text and len(out) < lines:
            cut = text.rfind(" ", 0, self.r.randint(44, 58))
            out.append(text[:cut])
            text = text[cut + 1 :]
        return out

    def listing(self, lines):
        entry = lambda i: f"{i + 1}. {self.r.choice(self.names)}, {self.r.choice('ABGJW')}., {self.r.choice(self.words)}"
        return ["LIST OF NAMES", *[entry(i) for i in range(lines)]]

    def table(self, lines):
        row = lambda: f"{self.r.choice(self.words)} {'.' * self.r.randint(4, 14)} {self.r.randint(1, 90)}{self.r.choice('¼½¾ ')} .. {self.r.randint(1, 90)}"
        return [row() for _ in range(lines)]

    def debris(self, lines):
        letter = lambda: "".join(self.r.choice("bcdfghjklmnpqrstvwxz>^»■/°[|~*") for _ in range(self.r.randint(1, 6)))
        return [" ".join(letter() for _ in range(self.r.randint(1, 7))) for _ in range(lines)]

    def boilerplate(self, lines):
        one = self.prose(1)[0]
        return [one] * lines + self.prose(2)


def invented_pages():
    v, out = Invented(11), []
    for i in range(260):
        n = v.r.randint(8, 30)
        kind = ["prose", "prose", "prose", "listing", "table", "debris", "boilerplate", "mostly", "partly"][i % 9]
        if kind == "mostly":  # a table inside of an article
            text = v.prose(2 * n) + v.table(n // 2) + v.prose(n)
        elif kind == "partly":  # a few sentences over a list
            text = v.prose(n // 4) + v.listing(n)
        else:
            text = getattr(v, kind)(n)
        out.append(("\r\n" if v.r.random() < 0.1 else "\n", text, kind not in ("prose", "mostly")))
    return [(end.join(text), off) for end, text, off in out]


def test_labelled_pages(spark):
    labelled = invented_pages()
    common = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    found = {r.doc_id for r in quality.page_quality(frame(spark, [t for t, _ in labelled]), common).where(quality.is_boilerplate()).collect()}
    true = {i for i, (_, off) in enumerate(labelled) if off}
    assert len(found & true) >= 0.99 * len(true), [labelled[i][0][:300] for i in sorted(true - found)[:3]]
    assert len(found & true) >= 0.99 * len(found), [labelled[i][0][:300] for i in sorted(found - true)[:3]]


def test_small_tables_are_spread_and_others_stay(spark, tmp_path, monkeypatch):
    frame(spark, texts()[:200]).coalesce(1).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d")).select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    assert bpe.spread(d, d).rdd.getNumPartitions() == cores
    few = sorted(map(str, bpe.encode_texts(d, "doc_id", "text").collect()))
    monkeypatch.setattr(bpe, "SMALL", 1)
    assert bpe.spread(d, d).rdd.getNumPartitions() == d.rdd.getNumPartitions()
    assert sorted(map(str, bpe.encode_texts(d, "doc_id", "text").collect())) == few
