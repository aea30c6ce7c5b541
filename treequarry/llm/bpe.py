"""Byte-level BPE by recursive queries in each partition (operator 11).

A text is cut by the vocabulary's pattern, and a piece that is a token as a whole is its id. Of the others each byte is
a row (piece, position, id). A step of the recursive query joins the rows, each with the id that follows it, with the
table of merges, and contracts each piece's leftmost pair of the lowest rank; a piece leaves when none of its pairs
merges. Decoding joins ids with the vocabulary and puts the bytes together by an ordered aggregate.

Pieces repeat, so the ids of texts between spaces are kept in a bounded cache of each worker (`units`); what is new in a
batch goes into one query. Pieces of many bytes go into a query of their own that contracts every copy of a piece's lowest
pair at once, where no contraction of it can make a lower one: then the order of contractions is the same, and the
steps follow the number of different pairs, not the length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treequarry.llm.common import small_batches, with_text
from treequarry.llm.tokens import tokenizer_path
from treequarry.llm.units import CUT, Units, single_spaced

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Longer pieces, in bytes, go into the query for long ones.
LONG_PIECE = 64
#: Tokens decoded by one query; one document of any length is decoded whole.
DECODE_TOKENS = 1_000_000

#: A row's key is the piece's number above 32 bits of position. `done` rows are the result; the others take the next step.
SHORT_STEPS = """
WITH RECURSIVE step AS (
  SELECT key, id, false AS done FROM start
  UNION ALL (
    WITH neighbours AS (SELECT key, id, lead(key) OVER o AS next_key, lead(id) OVER o AS next_id, lag(key) OVER o AS before_key FROM step WHERE NOT done WINDOW o AS (ORDER BY key)),
    pairs AS (SELECT key, id, before_key, merged FROM neighbours LEFT JOIN merges ON both_ids = CASE WHEN next_key >> 32 = key >> 32 THEN id::BIGINT << 32 | next_id END),
    lowest AS (SELECT key >> 32 AS piece, min(merged::BIGINT << 32 | (key & 4294967295)) AS pair FROM pairs GROUP BY piece)
    SELECT key, CASE WHEN pair & 4294967295 = key & 4294967295 THEN merged ELSE id END, pair IS NULL
    FROM pairs JOIN lowest ON piece = key >> 32
    WHERE pair IS NULL OR before_key IS NULL OR before_key >> 32 <> piece OR pair & 4294967295 <> before_key & 4294967295))
SELECT key, id FROM step WHERE done ORDER BY key
"""
#: Overlapping copies of a pair (in a run of one id) are taken from the left, every other one. Steps replace rows by their key.
LONG_STEPS = """
WITH RECURSIVE step(key, id, done) USING KEY (key) AS (
  SELECT key, id, false AS done FROM start
  UNION ALL (
    WITH neighbours AS (SELECT key, id, lead(key) OVER o AS next_key, lead(id) OVER o AS next_id, row_number() OVER o AS nth FROM recurring.step WHERE NOT done AND id >= 0 WINDOW o AS (ORDER BY key)),
    pairs AS (SELECT key, next_key, nth, merged, calm FROM neighbours LEFT JOIN merges ON both_ids = CASE WHEN next_key >> 32 = key >> 32 THEN id::BIGINT << 32 | next_id END),
    lowest AS (SELECT key >> 32 AS piece, min(merged) AS pair FROM pairs GROUP BY piece),
    copies AS (SELECT key, next_key, merged, calm, nth, row_number() OVER (PARTITION BY piece ORDER BY key) AS copy, piece FROM pairs JOIN lowest ON piece = key >> 32 WHERE merged = pair),
    chosen AS (SELECT key, next_key, merged FROM (SELECT *, row_number() OVER (PARTITION BY piece, nth - copy ORDER BY key) AS in_run FROM copies) WHERE CASE WHEN calm THEN in_run % 2 = 1 ELSE copy = 1 END)
    SELECT key, merged, false FROM chosen UNION ALL SELECT next_key, -1, false FROM chosen))
SELECT key, id FROM step WHERE id >= 0 ORDER BY key
"""
DECODED = "SELECT doc, string_agg(bytes, '' ORDER BY place) AS bytes FROM ids JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc"


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, from a file of lines `base64 rank`."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Each pair of tokens that make a token: both_ids (the first above 32 bits of the second), merged; `calm` where no pair with `merged` in it has a lower rank."""
    pairs = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    a, b, merged = (np.array(x, np.int32) for x in (zip(*pairs, strict=True) if pairs else ([], [], [])))
    wild = np.unique(np.concatenate([a[merged < a], b[merged < b]]))
    return pa.table({"both_ids": (a.astype(np.int64) << 32) + b, "merged": merged, "calm": ~np.isin(merged, wild)})


class Coder:
    """Encodes and decodes by queries; a connection of its own, in memory, with one thread."""

    def __init__(self, name: str):
        import duckdb

        self.ranks = ranks_of(tokenizer_path(name))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        for table, rows in (("merges", merge_table(self.ranks)), ("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in self.ranks]}))):
            self.sql.register("given", rows)
            self.sql.execute(f"CREATE TABLE {table} AS SELECT * FROM given")
            self.sql.unregister("given")

    def _run(self, query: str, **tables: pa.Table) -> pa.Table:
        for name, rows in tables.items():
            self.sql.register(name, rows)
        found = self.sql.sql(query).to_arrow_table()
        for name in tables:
            self.sql.unregister(name)
        return found

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece; pieces do not influence each other."""
        out = [np.array([self.ranks[p]], np.int32) if p in self.ranks else None for p in pieces]
        for query, wanted in ((SHORT_STEPS, lambda n: n <= LONG_PIECE), (LONG_STEPS, lambda n: n > LONG_PIECE)):
            todo = [k for k, p in enumerate(pieces) if out[k] is None and wanted(len(p))]
            if not todo:
                continue
            raw = np.frombuffer(b"".join(pieces[k] for k in todo), np.uint8)
            lengths = np.array([len(pieces[k]) for k in todo])
            piece = np.repeat(np.arange(len(todo)), lengths)
            key = (piece << 32) + np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            found = self._run(query, start=pa.table({"key": key, "id": self.byte_ids[raw]}))
            ends = np.searchsorted(found["key"].to_numpy() >> 32, np.arange(len(todo) + 1))
            ids = found["id"].to_numpy()
            for k, i, j in zip(todo, ends[:-1], ends[1:], strict=True):
                out[k] = ids[i:j]
        return out

    def decode(self, documents: list[np.ndarray]) -> list[bytes]:
        """The bytes of each document's ids; of unknown ids, none."""
        out = [b""] * len(documents)
        lengths = np.array([len(d) for d in documents], np.int64)
        begin = 0
        while begin < len(documents):
            end = max(begin + 1, int(np.searchsorted(np.cumsum(lengths[begin:]), DECODE_TOKENS, "right")) + begin)
            ids = np.concatenate(documents[begin:end]).astype(np.int32, copy=False)
            table = pa.table({"doc": np.repeat(np.arange(begin, end), lengths[begin:end]), "place": np.arange(len(ids)), "id": ids})
            found = self._run(DECODED, ids=table)
            for doc, signs in zip(found["doc"].to_pylist(), found["bytes"].to_pylist(), strict=True):
                out[doc] = signs.encode("latin-1")
            begin = end
        return out


class TextCoder:
    """Ids of whole texts, by units where a text may be cut into them; any other text goes to the pattern whole."""

    def __init__(self, name: str, limit: int = 1_000_000):
        import public_tokenizers
        import regex

        self.coder = Coder(name)
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.units = Units(limit, ids=np.int32)

    def many(self, texts: list[str | None]) -> list[tuple[np.ndarray, str]]:
        """Of each text its ids, and the same as decimal numbers with commas; null counts as empty."""
        units = self.units
        cut = [[] if not t else CUT(t) if single_spaced(t) else self.pieces(t) for t in texts]
        new = units.missing(cut)
        pieces = [self.pieces(u) for u in new]
        distinct = list(set().union(*pieces))
        of_piece = dict(zip(distinct, self.coder.encode([p.encode("utf-8") for p in distinct]), strict=True))
        ids = [of_piece[ps[0]] if len(ps) == 1 else np.concatenate([of_piece[p] for p in ps]) for ps in pieces]
        if new:
            flat, lengths = np.concatenate(ids), [len(x) for x in ids]
            signs, ends = list(map(str, flat.tolist())), np.cumsum(lengths).tolist()
            units.add(new, [",".join(signs[end - n : end]) for end, n in zip(ends, lengths, strict=True)], ids=(flat, lengths))
        return [(units.arrays["ids"].of(numbers)[0], ",".join(map(units.shown.__getitem__, numbers.tolist()))) for numbers in units.of(cut)]


@lru_cache(maxsize=1)
def text_coder(name: str) -> TextCoder:
    """One for all tasks of a worker, so that what it has kept goes on being of use."""
    return TextCoder(name)


def encoded(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """One row per input row: doc_id, ids array<int>. A null or empty text has no ids."""
    with_text(documents)
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(ranks)
        for batch in batches:
            found = coder.many(batch.column("text").to_pylist())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": pa.array([ids for ids, _ in found], pa.list_(pa.int32()))})

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, ids array<int>")


def decoded(tokens: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Rows (doc_id, ids) to doc_id, bytes. Null ids count as none, and ids outside of the vocabulary have no bytes."""
    small_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(ranks).coder
        for batch in batches:
            ids = [np.array([] if x is None else [i for i in x if i is not None], np.int32) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "bytes": pa.array(coder.decode(ids), pa.binary())})

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, bytes binary")


def round_trip(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256.

    Texts are encoded, and the ids are decoded, as in `encoded` and `decoded`, in one pass. A null text counts as empty: no
    ids, and digests of nothing. A text of any length is encoded whole, in one task. Repeated rows each get their row,
    an empty table gives an empty result, and columns beside doc_id and text play no part.
    """
    with_text(documents)
    small_batches(documents.sparkSession)
    digest = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(ranks)
        for batch in batches:
            found = coder.many(batch.column("text").to_pylist())
            texts = coder.coder.decode([ids for ids, _ in found])
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(ids) for ids, _ in found], pa.int64()),
                "ids_sha256": [digest(shown.encode("ascii")) for _, shown in found],
                "decoded_sha256": [digest(t) for t in texts],
            })

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
