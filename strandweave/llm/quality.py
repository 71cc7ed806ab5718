"""Per-document text quality: word, symbol, punctuation, common-word and repetition statistics, and the kind of every line.

A line is told to be running text or not by combined rules: its shape (leaders, tabs, columns of numbers, bullets, page references), its words, and
its neighbours. Words are held against the corpus: a word is known if it occurs in a given share of all pages and no rearrangement of its
letters is much more frequent, so that misread words of real text, which are rare forms, and shuffled or mirrored letters, which are rearrangements of
frequent words, are told apart without a dictionary.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.bpe import _groups
from strandweave.llm.bpe import spread as spread_out
from strandweave.plans.durable import durable

#: A known word occurs in this share of the pages with text, so there are at most (mean distinct words a page) / KNOWN of them, whatever the corpus' size.
KNOWN = 0.002
#: Times a rearrangement of a word's letters must be as frequent for the word to count as disordered.
DISORDER = 3
#: Share of a page above which it consists of something.
MOST = 0.5
#: Distinct words that a task counts before it hands its counts on.
HELD = 400_000

_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"(?<!\S)(?:£?\d[\d.,:/]*[¼½¾]?|[¼½¾]|[—–-])(?!\S)")
_LEADER = re.compile(r"\.\.|(?:\. ){3}|\bp\. ?\d+\W*$")
_BULLET = re.compile(r"\s*(?:\(\w{1,3}\)|\d{1,3}[.)](?=\s)|[•*+·▪◦]|[—–-](?=\s*[^\W\d_]))")
_VOWEL = re.compile("[aeiouyäöüáéíóúàèìòùâêîôûëïœæ]")
_COLUMN = re.compile(r"\S {3,}(?=\S)")
_PARAGRAPH = re.compile(r"\n\s*\n")
# Characters that end a sentence or clause, also before closing quotation marks
_ENDS = tuple(".!?:;,…")
_CLOSING = "\"'”’»)"


def document_frequencies(documents: DataFrame, text: str) -> DataFrame:
    """(word, pages BIGINT): pages that hold a lower-case word of at least two letters; the null word holds the number of pages with words. Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str | None] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                words = set(_WORD.findall(t))
                if words:
                    held[None] += 1
                    held.update(w for w in words if len(w) > 1 and w.islower())
                if len(held) > HELD:
                    yield _counts(held)
                    held.clear()
        if held:
            yield _counts(held)

    return spread_out(documents.select(F.col(text)).where(F.col(text).isNotNull()), documents).mapInArrow(run, "word string, pages bigint").groupBy("word").agg(F.sum("pages").alias("pages"))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "pages"])


def known_words(documents: DataFrame, text: str) -> frozenset[str]:
    """Words of at least KNOWN of the pages that aren't disordered. Only these, of which the share bounds the number, reach the driver."""
    f = durable(document_frequencies(documents, text))
    pages = f.where("word is null").first()
    found = f.where((F.col("word").isNotNull()) & (F.col("pages") >= KNOWN * (pages[1] if pages else 0))).collect()
    most: dict[str, int] = {}
    for w, n in found:
        key = "".join(sorted(w))
        most[key] = max(n, most.get(key, 0))
    return frozenset(w for w, n in found if n * DISORDER >= most["".join(sorted(w))] and _VOWEL.search(w) and len(set(w)) > 1)


class Words(dict):
    """What each word is: 2 common, 1 known, -1 neither, 0 capitalised. Kept for words that have come up, up to HELD of them."""

    def __init__(self, known: frozenset[str], common: frozenset[str]) -> None:
        self.known, self.common = known, common

    def __missing__(self, w: str) -> int:
        v = w.lower()
        c = (2 if w in self.common else 1) if w in self.known else 0 if w[0] != v[0] and w[1:] == v[1:] else -1
        if len(self) > HELD:
            self.clear()
        self[w] = c
        return c


def line_kinds(text: str, words_of: Words) -> tuple[list[str], list[str]]:
    """Kind of each line with content: prose, marks, table, list or nowords; and the text's words in order.

    Evidence of a line are its words of at least two letters, but for capitalised ones (they may be names; the first word may be a common word). A line
    without evidence goes with the two lines on either side, and one with little evidence leans on them.
    """
    kinds: list[str] = []
    score: list[tuple[int, int]] = []
    leads: list[bool] = []
    heads: list[bool] = []
    every: list[str] = []
    for x in text.splitlines():
        words = _WORD.findall(x)
        every += words
        if not words:
            if x.strip():
                kinds.append("marks")
                score.append((0, 0))
                leads.append(False)
                heads.append(False)
            continue
        letters, solid = sum(map(len, words)), len("".join(x.split()))
        long = [w for w in words if len(w) > 1]
        lead = bool(_LEADER.search(x))
        numbers = len(_NUMBER.findall(x)) if letters < solid else 0
        columns = len(_COLUMN.findall(x)) if "   " in x else 0
        upper = x.isupper()
        codes = [words_of[w.lower()] for w in long] if upper else [words_of[w] for w in long]
        if not upper and codes and not codes[0] and long[0] is words[0] and long[0].lower() in words_of.common:
            codes[0] = 2
        usual, bad, caps = codes.count(2), codes.count(-1), codes.count(0)
        good = usual + codes.count(1)
        if not long or letters * 2 < solid:
            kind = "marks"
        elif lead or "\t" in x.strip() or numbers >= 2 and numbers >= len(long) or x.count("|") > 1 and numbers or not usual and (columns > 1 or columns and numbers):
            kind = "table"
        elif _BULLET.match(x) and usual * 4 < len(long):
            kind = "list"
        else:
            kind = "words"
        kinds.append(kind)
        # without common words, mostly capitalised words tell nothing: an entry of a list of names, or the end of a sentence
        names = not usual and 2 * caps >= len(long)
        score.append((good, bad) if kind == "words" and not names else (0, 0))
        leads.append(lead)
        heads.append(kind == "words" and x.lstrip()[:1].isupper() and not x.rstrip().endswith((".", "!", "?", "-")))
    out = []
    for i, kind in enumerate(kinds):
        if kind == "words":
            good, bad = score[i]
            near = range(max(0, i - 2), min(len(kinds), i + 3))
            if heads[i] and 5 * sum(leads[j] for j in near) >= 2 * len(near):
                kind = "list"  # an entry whose leader or number is missing
            else:
                g, b = sum(score[j][0] for j in near), sum(score[j][1] for j in near)
                fits = 2 * good + g > 1.2 * (2 * bad + b) if good + bad > 1 else g > 1.2 * b
                kind = "prose" if fits and g + b > 0 else "nowords" if b else "list"
        out.append(kind)
    return out, every


def _repeated(xs: list[str]) -> float:
    """Share that repeats an earlier one."""
    return 1 - len(set(xs)) / len(xs) if xs else 0.0


def dominant_runs(pages: list[list[str]]) -> list[int]:
    """For each page's words the letters that the occurrences of its weightiest run of 2, 3 or 4 words cover, 0 if no run comes twice.

    A run's weight is its occurrences times its letters, of equal ones that which begins first counts; occurrences may overlap. All pages are counted together: a run of n + 1 words
    can only come twice where the run of its first n words does, so after the pairs few places are left."""
    number: dict[str, int] = {}
    counts = [len(p) for p in pages]
    ids = np.array([number.setdefault(w, len(number)) for p in pages for w in p], np.int64)
    page = np.repeat(np.arange(len(pages)), counts)
    length = np.array([len(w) for w in number], np.int64)[ids] if len(ids) else ids
    before = np.r_[0, np.cumsum(length)]
    end = np.cumsum(counts)[page] if len(ids) else ids
    most = np.zeros(len(pages), np.int64)
    at = np.arange(len(ids))
    code = np.unique(page * len(number) + ids, return_inverse=True)[1] if len(ids) else ids  # of a page and its run of words so far
    for n in (2, 3, 4):
        stay = at + n <= end[at]
        at, code = at[stay], code[stay]
        _, code, k = np.unique(code * max(1, len(number)) + ids[at + n - 1], return_inverse=True, return_counts=True)
        stay = k[code] > 1
        at, code = at[stay], code[stay]
        if not len(at):
            break
        order = np.argsort(code, kind="stable")  # occurrences of a run side by side, in order
        where, run = at[order], code[order]
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        begin = where.copy()
        begin[1:] = np.where(run[1:] == run[:-1], np.maximum(where[1:], where[:-1] + n), where[1:])
        covered = np.add.reduceat(before[where + n] - before[begin], first)
        head = where[first]
        weight = k[run[first]] * (before[head + n] - before[head])
        best = np.lexsort((head, -weight, page[head]))
        best = best[np.r_[True, page[head][best][1:] != page[head][best][:-1]]]
        np.maximum.at(most, page[head][best], covered[best])
    return most.tolist()


def page_statistics(text: str | None, words_of: Words) -> tuple[list, list[str], int]:
    """words, mean word length, share of symbols, of lines that end in punctuation, of common words, of repeated lines, of repeated paragraphs, and of lines that
    aren't running text; the words in lower case; and the number of their letters. Shares of nothing are 0; a null text is an empty one."""
    text = text or ""
    kinds, words = line_kinds(text, words_of)
    words = "\n".join(words).lower().split("\n") if words else words
    lines = [x for y in text.splitlines() if (x := y.strip())]
    solid = sum(map(len, "".join(lines).split()))
    symbols = solid - sum(map(str.isalnum, text))
    ends = sum(x.rstrip(_CLOSING).endswith(_ENDS) for x in lines)
    n, letters, common = len(words), sum(map(len, words)), words_of.common
    paragraphs = [p.strip() for p in _PARAGRAPH.split(text) if p.strip()]
    shares = [n, letters / n if n else 0.0, symbols / solid if solid else 0.0, ends / len(lines) if lines else 0.0, sum(w in common for w in words) / n if n else 0.0, _repeated(lines), _repeated(paragraphs), _off(kinds)]
    return shares, words, letters


def _off(kinds: list[str]) -> float:
    return sum(k != "prose" for k in kinds) / len(kinds) if kinds else 0.0


def is_boilerplate() -> Column:
    """Of rows of page_quality(): more than half of a page's lines aren't running text, or more than half of its lines or paragraphs repeat earlier ones, or the
    occurrences of one run of words cover more than half of its letters. A page of the same text twice has a share of one half only."""
    return reduce(Column.__or__, [F.col(c) > MOST for c in ("not_running_share", "repeated_line_share", "repeated_paragraph_share", "dominant_run_share")])


STATISTICS = ("n_words", "mean_word_length", "symbol_share", "punctuated_line_share", "common_word_share", "repeated_line_share", "repeated_paragraph_share", "dominant_run_share", "not_running_share")


def page_quality(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, STATISTICS) of every row; not_running_share is the share of its lines with content that aren't running text.

    The whole corpus' document frequencies are counted first (see known_words); then pages are taken where they lie, without a shuffle. Null, empty and
    blank texts have 0 everywhere. Common words of all languages count, since a page's `lang` may be missing or wrong. An empty table gives no row. More than
    MOST_COMMON common words are refused with a ValueError: none is left out.
    """
    known = known_words(documents, text)
    listed = common_words.select(F.lower("word").alias("word")).where("word is not null").distinct().limit(MOST_COMMON + 1).collect()
    if len(listed) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} common words")
    common = frozenset(r[0] for r in listed)
    schema = documents.select(key).schema
    for n in STATISTICS:
        schema = schema.add(n, "long" if n == "n_words" else "double")
    spread = documents.sparkSession.sparkContext.broadcast((known, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = Words(*spread.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _groups(texts):
                rows, words, letters = zip(*[page_statistics(t, words_of) for t in texts[i:j]], strict=True)
                runs = [c / n if n else 0.0 for c, n in zip(dominant_runs(list(words)), letters, strict=True)]
                *most, last = zip(*rows, strict=True)
                columns = [pa.array(np.array(c, np.int64 if n == "n_words" else np.float64)) for n, c in zip(STATISTICS, (*most, runs, last), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *columns], [key, *STATISTICS])

    return spread_out(documents.select(key, F.col(text)), documents).mapInArrow(run, schema)


#: The list of common words is a fixed list of a few hundred words; a longer one is an error of the caller's and refused.
MOST_COMMON = 100_000
