"""Product codes of vectors by partial-distance search (operator 13).

A vector of whole numbers is cut into equal parts, and each part is coded by the nearest entry of its codebook. Books
are fitted in rounds: tasks assign the parts of their rows and send sums and counts of each entry, which Spark adds
up; the driver sees one row for each number of the books, whatever the input. The search takes the dimensions in
descending variance of the codebook, so that most entries are out of reach after one or two of them: a mask over all
rows of a batch drops an entry as soon as its distance so far strictly exceeds the best complete one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treequarry.llm.common import shared_folder, small_batches

#: Up to so many labels their sums are broadcast; beyond, the join is by shuffle, and a label's rows are dealt among SALTS.
BROADCAST_LABELS, SALTS = 100_000, 32


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of `parts` (int64) the index of the nearest entry of `book`, ties to the lower, and the squared distance."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    # the first complete distance is that of the entry nearest in the widest dimension
    index = np.abs(parts[:, order[0], None] - book[None, :, order[0]]).argmin(axis=1)
    first, best = index.copy(), ((parts - book[index]) ** 2).sum(axis=1)
    for entry in range(len(book)):
        rows = np.flatnonzero(first != entry)
        distance = np.zeros(len(rows), np.int64)
        for k in order:
            distance += (parts[rows, k] - book[entry, k]) ** 2
            alive = distance <= best[rows]
            rows, distance = rows[alive], distance[alive]
        better = (distance < best[rows]) | (entry < index[rows])
        index[rows[better]], best[rows[better]] = entry, distance[better]
    return index, best


def whole_vectors(embeddings: DataFrame, scale: int = 4096, n_parts: int = 8, column: str = "embedding") -> DataFrame:
    """The rows that can be coded, with `whole`: floor(scale * x) of each component, filled with zeros to equal parts.

    Left out are rows whose vector is null, empty, or holds null, NaN or infinite components; and, since a sum of squares
    must fit in a long, rows with a component beyond 2^30 / sqrt(dimensions) after scaling. Of vectors of several lengths
    those of the commonest stay (of equally common ones, the shortest).
    """
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = embeddings.filter(x.isNotNull() & (F.size(x) > 0)).filter(finite)
    length = usable.groupBy(F.size(x).alias("length")).count().orderBy(F.desc("count"), "length").first()
    dimensions = length["length"] if length else n_parts
    padded = -(-dimensions // n_parts) * n_parts
    most = (1 << 30) / math.sqrt(padded) / scale
    usable = usable.filter((F.size(x) == dimensions) & F.forall(x, lambda v: F.abs(v) <= most))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int"))
    if padded > dimensions:
        whole = F.concat(whole, F.array_repeat(F.lit(0), padded - dimensions))
    return usable.withColumn(column, whole)


def _rows(column: pa.Array, n_parts: int) -> np.ndarray:
    """A batch of vectors as an array of rows, parts and positions."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), n_parts, -1)


def fitted_books(vectors: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    """Books (part, entry, position) after `rounds` rounds over the column `whole`, from `first`.

    A round replaces each entry by floor(sum / count) of the parts that are nearest to it; unused entries stay.
    """
    books = first
    for _ in range(rounds):

        def summed(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                x = _rows(batch.column(0), len(books))
                for part, book in enumerate(books):
                    index, _ = nearest(x[:, part], book)
                    np.add.at(sums[part], index, x[:, part])
                    counts[part] += np.bincount(index, minlength=len(book))
            part, entry, position = np.nonzero(np.broadcast_to(counts[:, :, None] > 0, books.shape))
            yield pa.record_batch({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "position": pa.array(position, pa.int32()), "total": sums[part, entry, position], "n": counts[part, entry]})

        partial = vectors.select("whole").mapInArrow(summed, "part int, entry int, position int, total long, n long")
        books = books.copy()
        for r in partial.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _label_errors(coded: DataFrame) -> DataFrame:
    """`coded` with the sum of errors over equal labels, nulls together."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    same: Column = F.col("label").eqNullSafe(F.col("of_label"))
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), same).drop("of_label")
    dealt = coded.withColumn("own_salt", F.pmod(F.xxhash64("code", "error"), F.lit(SALTS)))
    laid_out = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(laid_out, same & (F.col("own_salt") == F.col("salt"))).drop("of_label", "own_salt", "salt")


def vector_codes(embeddings: DataFrame, n_parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """One row per row that can be coded (see `whole_vectors`): vec_id, code, error, label_error, codebooks_sha256.

    `code` has an index of two hex digits for each part, `error` is the squared distance over all parts, `label_error`
    its sum over equal labels (null labels together). Books start from the parts of the rows of the `entries` smallest
    vec_ids (null ids last, equal ids by their vectors); of fewer rows all are taken. Repeated rows each get their row, an
    empty table or one without usable vectors gives an empty result, and other columns play no part.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits")
    spark = embeddings.sparkSession
    small_batches(spark)
    folder = shared_folder(spark, "vector_codes")
    narrow = embeddings.select("vec_id", "label", F.col("embedding").alias("whole"))
    whole_vectors(narrow, scale, n_parts, "whole").write.parquet(f"{folder}/whole")
    vectors = spark.read.parquet(f"{folder}/whole")
    first = [r["whole"] for r in vectors.orderBy(F.asc_nulls_last("vec_id"), "whole").limit(entries).collect()]
    if not first:
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    start = np.array(first, np.int64).reshape(len(first), n_parts, -1).transpose(1, 0, 2)
    books = fitted_books(vectors, start, rounds)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column("whole"), n_parts)
            found = [nearest(x[:, part], book) for part, book in enumerate(books)]
            index = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": pa.array([row.tobytes().hex() for row in index], pa.string()), "error": error})

    kinds = dict(vectors.dtypes)
    vectors.mapInArrow(coded, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long").write.parquet(f"{folder}/coded")
    found = _label_errors(spark.read.parquet(f"{folder}/coded"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle(n_parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """DuckDB SQL for vectors of one length that is a multiple of `n_parts`: all rounds written out, every distance complete."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT row, part, arg_min(entry, (distance, entry)) AS entry, min(distance) AS distance FROM (SELECT row, part, entry, sum((x - y) * (x - y))::BIGINT AS distance FROM c JOIN b{k} USING (part, position) GROUP BY ALL) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT part, entry, position, coalesce((total - ((total % n) + n) % n) // n, y)::BIGINT AS y FROM b{k} LEFT JOIN (SELECT part, entry, position, sum(x) AS total, count(*) AS n FROM c JOIN d{k} USING (row, part) GROUP BY ALL) USING (part, entry, position))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, embedding FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS MATERIALIZED (SELECT row, (i - 1) // (n // {n_parts}) AS part, (i - 1) % (n // {n_parts}) AS position, floor({scale} * x::DOUBLE)::BIGINT AS x FROM (SELECT row, len(embedding) AS n, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM v)),
b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, position, x AS y FROM c WHERE row <= {entries}),
{", ".join(steps)},
coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM d{rounds} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, position)) FROM b{rounds}) AS codebooks_sha256 FROM v JOIN coded USING (row)
"""
