"""Alignment of two tokenizers over the same bytes (operator 12).

Tokens of either side end at byte offsets; where both end, a group ends. Two pointers run over the ends of both sides and
emit the groups, and each group links every token of one side with every token of the other. Links are kept as
different pairs of ids with how often they occur, never one by one.

A text in which no white space stands beside white space is cut at line ends and spaces, if neither vocabulary joins
across them: both sides end there, so each part is aligned for itself, and parts that repeat come from a bounded cache.

Spark counts in how many documents a pair is linked, and joins the counts back. Frequent pairs, of a bounded number, are
broadcast, and their share of a document is summed where it is read. The others are joined by shuffle; none of them
occurs in as many documents as the broadcast ones, so no key is hot.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treequarry.llm.common import shared_folder, small_batches, with_text
from treequarry.llm.tokens import BYTE_SIGNS, byte_level, tokenizer_path
from treequarry.llm.units import CUT, Units, single_spaced

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs in the broadcast table at most.
BROADCAST_PAIRS = 200_000
#: Links of a group that are written out before they are counted.
FEW_LINKS = 64
#: The sign of a space in pieces.
SPACE = "▁"


class SideA:
    """A byte-level vocabulary of the tokenizers library. It gets the text with a space before it."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cuts = byte_level(path)
        of_sign = {s: b for b, s in BYTE_SIGNS.items()}
        self.bytes = {i: bytes(of_sign[s] for s in t) if all(s in of_sign for s in t) else t.encode() for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class SideB:
    """A model of the sentencepiece library, which puts the space before a text itself."""

    def __init__(self, name: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {i: bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)}
        self.line_end = model.encode("\n")
        own_line_end = [self.bytes[i] for i in self.line_end] == [b" ", b"\n"]
        joins = any(SPACE in p.lstrip(SPACE) or "\n" in p or " " in p for p in pieces)
        changes = any(b"".join(map(self.bytes.__getitem__, model.encode(t))).decode() != " " + t for t in ("ﬁ", "½", "Å", "Ａ"))
        self.cuts = own_line_end and not joins and not changes

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Each text as if it stood at the start of a line: with a space before it, or, after a line end, without."""
        after_space = [t[1:] if t[:1] == " " else "\n" + t for t in texts]
        found = self.model.encode(after_space, num_threads=1)
        return [ids if t[:1] == " " else ids[len(self.line_end) :] for t, ids in zip(texts, found, strict=True)]


def merged_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two pointers over ascending token ends of either side: the places in `a` and in `b` of each end that both have.

    A step of the pointers is a step through both sides merged in order; equal ends stand beside each other there.
    """
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")  # of two ascending runs: one merge
    met = np.flatnonzero(both[order[1:]] == both[order[:-1]])
    return order[met], order[met + 1] - len(a)


@dataclass
class Aligned:
    """The alignment of a text: its groups as text, numbers of tokens, groups and links, pairs and how often each is linked."""

    groups: str
    numbers: tuple[int, int, int, int]
    pairs: np.ndarray
    times: np.ndarray


class Aligner:
    def __init__(self, side_a: str, side_b: str, limit: int = 500_000):
        self.a, self.b = SideA(side_a), SideB(side_b)
        self.cuts = self.a.cuts and self.b.cuts
        self.bytes_a, self.bytes_b = self.a.bytes, self.b.bytes
        #: of each part: n_a, n_b, n_groups, n_links, and whether the bytes of both sides are its own
        self.known = Units(limit, numbers=np.int64, pairs=np.int64, times=np.int64)

    def parts(self, text: str) -> list[str]:
        """What is aligned for itself; together they are the text with a space before it."""
        return CUT(" " + text) if self.cuts and single_spaced(text) else [" " + text]

    def learn(self, parts: list[str]) -> None:
        """Align parts, all at once: their tokens stand one after another on both sides."""
        ids_a, ids_b = self.a.encode(parts), self.b.encode(parts)
        for k, part in enumerate(parts):
            own = part.encode("utf-8")
            if b"".join([self.bytes_a[i] for i in ids_a[k]]) != own or b"".join([self.bytes_b[i] for i in ids_b[k]]) != own:
                ids_a[k] = ids_b[k] = ()
        counts_a, counts_b = np.array([len(x) for x in ids_a]), np.array([len(x) for x in ids_b])
        a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = (np.cumsum(np.fromiter((len(of[i]) for i in ids.tolist()), np.int64, len(ids))) for of, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        last_a, last_b = merged_ends(ends_a, ends_b)
        sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        first_a, first_b = last_a + 1 - sizes_a, last_b + 1 - sizes_b
        part_of = np.searchsorted(np.cumsum(counts_a), last_a, "right")
        pairs, times, pair_part = self._links(a, b, first_a, first_b, sizes_a, sizes_b, part_of)
        n_groups = np.bincount(part_of, minlength=len(parts))
        n_links = np.zeros(len(parts), np.int64)
        np.add.at(n_links, part_of, sizes_a * sizes_b)
        right = np.array([len(x) > 0 for x in ids_a])
        numbers = np.stack([counts_a, counts_b, n_groups, n_links, right], axis=1)
        per_part = np.bincount(pair_part, minlength=len(parts))
        self.known.add(parts, self._shown(a, b, last_a, last_b, first_a, first_b, counts_a + counts_b), numbers=(numbers.ravel(), [5] * len(parts)), pairs=(pairs, per_part), times=(times, per_part))

    @staticmethod
    def _links(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, part_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs with their times and parts, in the order of the parts. Groups of few links give each; others count ids first."""
        sizes = sizes_a * sizes_b
        few = np.flatnonzero(sizes <= FEW_LINKS)
        total = np.cumsum(sizes[few])
        group = np.repeat(few, sizes[few])
        nth = np.arange(total[-1] if len(few) else 0) - np.repeat(total - sizes[few], sizes[few])
        x, y = a[first_a[group] + nth // sizes_b[group]], b[first_b[group] + nth % sizes_b[group]]
        pairs, times, parts = [x << 32 | y], [np.ones(len(x), np.int64)], [part_of[group]]
        for g in np.flatnonzero(sizes > FEW_LINKS).tolist():
            x, n = np.unique(a[first_a[g] : first_a[g] + sizes_a[g]], return_counts=True)
            y, m = np.unique(b[first_b[g] : first_b[g] + sizes_b[g]], return_counts=True)
            pairs.append((x[:, None] << 32 | y).ravel())
            times.append((n[:, None] * m).ravel())
            parts.append(np.full(len(x) * len(y), part_of[g]))
        part = np.concatenate(parts)
        order = np.argsort(part, kind="stable")
        return np.concatenate(pairs)[order], np.concatenate(times)[order], part[order]

    @staticmethod
    def _shown(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, tokens: np.ndarray) -> list[str]:
        """The groups of each part as text, each with its end sign. In a group the tokens of A come before those of B."""
        place_a = np.arange(len(a)) + first_b[np.searchsorted(last_a, np.arange(len(a)))] if len(a) else a
        place_b = np.arange(len(b)) + last_a[np.searchsorted(last_b, np.arange(len(b)))] + 1 if len(b) else b
        signs = np.empty(len(a) + len(b), object)
        sign_a, sign_b = np.full(len(a), ","), np.full(len(b), ",")
        sign_a[last_a], sign_b[last_b] = "|", ";"
        signs[place_a] = [f"{i}{s}" for i, s in zip(a.tolist(), sign_a.tolist(), strict=True)]
        signs[place_b] = [f"{i}{s}" for i, s in zip(b.tolist(), sign_b.tolist(), strict=True)]
        flat, ends = signs.tolist(), np.cumsum(tokens).tolist()
        return ["".join(flat[end - n : end]) for end, n in zip(ends, tokens.tolist(), strict=True)]

    def many(self, texts: list[str | None]) -> list[Aligned | None]:
        """Of each text its alignment; None where it is null or empty, or where the bytes of a side are not the text's."""
        known = self.known
        cut = [self.parts(t) if t else [] for t in texts]
        new = known.missing(cut)
        if new:
            self.learn(new)
        return [self.joined(numbers) if len(numbers) else None for numbers in known.of(cut)]

    def joined(self, parts: np.ndarray) -> Aligned | None:
        arrays = self.known.arrays
        numbers = arrays["numbers"].of(parts)[0].reshape(-1, 5)
        if not numbers[:, 4].all():
            return None
        pairs, times = arrays["pairs"].of(parts)[0], arrays["times"].of(parts)[0]
        order = np.argsort(pairs, kind="stable")
        pairs, times = pairs[order], times[order]
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        groups = "".join(map(self.known.shown.__getitem__, parts.tolist()))
        return Aligned(groups[:-1], tuple(numbers[:, :4].sum(axis=0).tolist()), pairs[first], np.add.reduceat(times, first))


@lru_cache(maxsize=1)
def aligner(side_a: str, side_b: str) -> Aligner:
    """One for all tasks of a worker, so that what it has kept goes on being of use."""
    return Aligner(side_a, side_b)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def alignments(documents: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, groups: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pair array<long> (id of A above 32 bits of
    the id of B, ascending), times array<long>, and, where asked for, groups (`a1,a2|b1;a3|b2,b3`).

    A text that is null, empty, or of which the bytes of a side differ from those of a space and the text has no tokens:
    zeros, empty arrays, '' for the groups and their digest. A text of any length is aligned whole, in one task.
    """
    with_text(documents)
    small_batches(documents.sparkSession)
    none = Aligned("", (0, 0, 0, 0), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [x or none for x in aligner(side_a, side_b).many(list(batch["text"]))]
            out = pd.DataFrame({"doc_id": batch["doc_id"].array} | {name: [x.numbers[k] for x in found] for k, name in enumerate(NUMBERS)})
            out["groups_sha256"] = [hashlib.sha256(x.groups.encode("ascii")).hexdigest() if x.groups else "" for x in found]
            out["pair"], out["times"] = [x.pairs for x in found], [x.times for x in found]
            if groups:
                out["groups"] = [x.groups for x in found]
            yield out

    kind = dict(documents.dtypes)["doc_id"]
    texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # nulls in whole numbers would make pandas floats of them
    schema = "doc_id string, " + "".join(f"{n} long, " for n in NUMBERS) + "groups_sha256 string, pair array<long>, times array<long>" + ", groups string" * groups
    return texts.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a, n_docs (documents that hold it linked), best (whether no pair of the same a has more)."""
    folder = shared_folder(aligned.sparkSession, "pair_counts")
    counted = aligned.select(F.explode("pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counted.withColumn("a", F.shiftright("pair", 32).cast("int")).write.parquet(folder)
    counts = counted.sparkSession.read.parquet(folder)
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("pair", "a", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least power of two that at most `most` pairs reach in documents."""
    sizes = {r["width"]: r["n"] for r in counts.groupBy(F.length(F.bin("n_docs")).alias("width")).agg(F.count("*").alias("n")).collect()}
    total, width = 0, 64
    while width > 1 and total + sizes.get(width - 1, 0) <= most:
        width -= 1
        total += sizes.get(width, 0)
    return 1 << (width - 1)


def token_alignment(documents: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    `count_sum` adds up, over the links of a document, in how many documents their pair of ids is linked; `n_best` counts the
    links whose pair has the highest count of its id of A, ties included. See `alignments` for texts without tokens.
    Repeated rows count as documents of their own; a null doc_id stays null; an empty table gives an empty result;
    columns beside doc_id and text play no part.
    """
    spark = documents.sparkSession
    folder = shared_folder(spark, "token_alignment")
    found = alignments(documents, side_a, side_b, groups=False)
    found.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/aligned")
    aligned = spark.read.parquet(f"{folder}/aligned")
    pair_counts(aligned).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    frequent = frequent_from(counts, broadcast_pairs)
    links = aligned.select("row", F.inline(F.arrays_zip("pair", "times")))
    hot = F.broadcast(counts.filter(F.col("n_docs") >= frequent))
    rare = counts.filter(F.col("n_docs") < frequent)
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    by_row = links.join(hot, "pair").groupBy("row").agg(*sums).unionByName(links.join(hot, "pair", "left_anti").join(rare, "pair").groupBy("row").agg(*sums))
    by_row = by_row.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_best", "count_sum")))
    whole = aligned.drop("pair", "times").join(by_row, "row", "left")
    return whole.select("doc_id", *NUMBERS, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
