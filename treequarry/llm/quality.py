"""Quality rules as a short-circuit cascade (operator 8).

Base counts come first and are exact. A document that passes them goes through the further rules one after
another until one rejects it. Before that, a small sample is timed: each rule's cost and the share that it
rejects are measured, and the rules run in order of rejections per second. The order changes only the time that
the cascade takes, never a verdict, since a document is kept only if every rule passes it.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treequarry.llm.common import heads, small_batches, with_text

SYMBOLS = "#*$%&|<>"
WHITE = "\t\n\x0b\x0c\r "
CAPITALS, SMALL = bytes(range(65, 91)), bytes(range(97, 123))
LETTERS = CAPITALS + SMALL + bytes(range(128, 256))

BASE_TYPE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass
class Doc:
    """A text with its words and base counts."""

    text: str
    words: list[bytes]
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int


@dataclass(frozen=True)
class Rule:
    """`rejects` is true for documents that go."""

    name: str
    rejects: Callable[[Doc], bool]


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of `width` words that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, total, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += i + width - max(i, end)
            end = i + width
    return total


def measure(text: str | None) -> Doc:
    """Base counts of a text; null has no words and no lines."""
    text = text or ""
    words = text.encode("utf-8").split()  # on ASCII white space alone, as bytes
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return Doc(text, words, len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines))


def base_failed(doc: Doc) -> bool:
    return len(doc.words) < 10 or 100 * doc.n_repeat_words > 20 * len(doc.words)


def many_symbols(doc: Doc) -> bool:
    return doc.n_symbols > 0.2 * len(doc.words)


def repeated_lines(doc: Doc) -> bool:
    return 100 * doc.n_dup_lines > 40 * doc.n_lines


def odd_word_length(doc: Doc) -> bool:
    return not 1.5 <= doc.word_chars / max(1, len(doc.words)) <= 20


def shouting(doc: Doc) -> bool:
    """Over nine tenths of the ASCII letters are capitals."""
    joined = b"".join(doc.words)
    upper, lower = (len(joined) - len(joined.translate(None, x)) for x in (CAPITALS, SMALL))
    return upper > 9 * lower


def few_letters(doc: Doc) -> bool:
    """Letters, with every byte outside ASCII taken for one, are under four tenths of the words' bytes."""
    joined = b"".join(doc.words)
    return len(joined) - len(joined.translate(None, LETTERS)) < 0.4 * len(joined)


#: The production rules beside the base ones.
RULES = (
    Rule("many_symbols", many_symbols),
    Rule("repeated_lines", repeated_lines),
    Rule("odd_word_length", odd_word_length),
    Rule("shouting", shouting),
    Rule("few_letters", few_letters),
)


def cascade_order(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> list[str]:
    """Names of the rules by rejections per second, measured on the first of about `sample_rows` documents in a few partitions.

    Only times and counts per rule come back to the driver. An empty table leaves the given order.
    """
    small_batches(documents.sparkSession)
    head = heads(documents, sample_rows)

    def timed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent, rejected = Counter(), Counter()
        for batch in head(batches):
            for text in batch["text"]:
                doc = measure(text)
                if base_failed(doc):
                    continue
                for rule in rules:
                    began = time.perf_counter()
                    rejected[rule.name] += rule.rejects(doc)
                    spent[rule.name] += time.perf_counter() - began
        yield pd.DataFrame([(r.name, spent[r.name], int(rejected[r.name])) for r in rules], columns=["rule", "seconds", "rejected"])

    found = documents.select("text").mapInPandas(timed, "rule string, seconds double, rejected long")
    rate = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in found.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()}
    return sorted((r.name for r in rules), key=lambda name: -rate.get(name, 0.0))


def verdict_column(rules: tuple[Rule, ...], order: list[str]):
    """A Pandas UDF of a text: its base counts and both verdicts."""
    by_name = {r.name: r for r in rules}
    cascade = [by_name[name].rejects for name in order]

    @F.pandas_udf(f"{BASE_TYPE}, base_failed boolean, kept boolean")
    def verdict(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            doc = measure(text)
            failed = base_failed(doc)
            rows.append((len(doc.words), doc.word_chars, doc.n_symbols, doc.n_dup_lines, doc.n_repeat_words, failed, not failed and not any(rejects(doc) for rejects in cascade)))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return verdict


def quality(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """One row per input row: doc_id, base counts, base_failed, kept.

    A null or empty text has no words and fails. Rows that repeat are judged alike and all stay rows. Columns of
    the input beside doc_id and text play no part, whatever their names. An empty table gives an empty result.
    """
    with_text(documents)
    small_batches(documents.sparkSession)
    verdict = verdict_column(rules, cascade_order(documents, rules, sample_rows))
    return documents.select("doc_id", verdict("text").alias("v")).select("doc_id", "v.*")


def keep_good(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The input's rows, with its columns, that `quality` keeps."""
    with_text(documents)
    small_batches(documents.sparkSession)
    verdict = verdict_column(rules, cascade_order(documents, rules, sample_rows))
    return documents.filter(verdict("text")["kept"])
