"""Token ids as raw binary shards with a minimal perfect hash index over document keys (operator 2).

Documents are dealt by ranges of doc_id, so that tasks encode them in ascending order and append their ids to
shards of bounded size. A shard is nothing but ids, little-endian, 16 bits each where the vocabulary allows it and
32 otherwise. Each attempt of a task writes files of its own, and only those that its committed rows name belong to
the dataset, so lost executors and repeated attempts do no harm.

The index maps a key (doc_id and, for repeated ids, the occurrence) to shard, offset and length. Keys fall into
buckets of about `bucket_keys` by their first hash. A bucket holds a hash-and-displace function: keys are grouped,
each group of several keys has the displacement that sends all of them to free slots, and a group of one key names
its slot. There are as many slots as keys. A slot keeps a 32-bit fingerprint beside the place, so that a key that was
never stored is found out. A look-up reads one bucket, one displacement and one slot: constant time.
"""

from __future__ import annotations

import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treequarry.llm import tokens
from treequarry.llm.common import shared_folder, small_batches, with_text

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2

SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])
PLACES = "doc_id long, occurrence long, shard string, offset long, n_tokens long"


@dataclass(frozen=True)
class TokenFiles:
    """Where a dataset lies, and the bytes of an id in it."""

    folder: str
    id_bytes: int

    @property
    def places(self) -> str:
        return f"{self.folder}/places"

    @property
    def shards(self) -> str:
        return f"{self.folder}/shards"

    @property
    def index(self) -> str:
        return f"{self.folder}/index"


def file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def write_shards(documents: DataFrame, folder: str, tokenizer: str, end_id: int, id_bytes: int, shard_bytes: int) -> DataFrame:
    """Encode in ascending doc_id order and write shards; the rows say where each document went."""
    kind = {2: "H", 4: "I"}[id_bytes]

    def packed(ids: list[int]) -> bytes:
        words = array(kind, ids)
        if sys.byteorder == "big":
            words.byteswap()
        return words.tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.PreTokens(tokenizer, packed, b"".join)
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        stem, end = f"part-{TaskContext.get().partitionId():07d}", packed([end_id])
        attempt, number, out, name, offset = uuid.uuid4().hex[:8], 0, None, "", 0
        last, occurrence = object(), 0
        for batch in batches:
            rows = []
            for doc_id, encoded in zip(batch.column(0).to_pylist(), encode.many(batch.column(1).to_pylist()), strict=True):
                if out is None or offset * id_bytes >= shard_bytes:
                    if out is not None:
                        out.close()
                    name, number, offset = f"{stem}-{number:05d}-{attempt}.ids", number + 1, 0
                    out = fs.open_output_stream(f"{root}/{name}")
                ids = encoded + end
                occurrence = occurrence + 1 if doc_id == last else 0
                last = doc_id
                out.write(ids)
                rows.append((doc_id, occurrence, name, offset, len(ids) // id_bytes))
                offset += len(ids) // id_bytes
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "occurrence", "shard", "offset", "n_tokens"])
        if out is not None:
            out.close()

    ordered = documents.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, PLACES)


def mixed(x: np.ndarray, y: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """A 64-bit mix of two hashes and a number (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = x + (y | np.uint64(1)) * (np.uint64(2) * np.asarray(salt).astype(np.uint64) + np.uint64(1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def n_groups(n_keys: int) -> int:
    return n_keys // 2 + 1


def displacements(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash of n distinct pairs of hashes: its displacements, and each key's slot below n.

    A displacement d > 0 is the salt of its group; d < 0 is the slot -d - 1 of a group of one key. Groups of one size
    are placed together, the largest first: with each salt those stay whose slots are free and whom no other group
    disturbs.
    """
    n = len(x)
    group = (mixed(x, y, 0) % np.uint64(n_groups(n))).astype(np.int64)
    d, slot, free = np.zeros(n_groups(n), np.int64), np.full(n, -1, np.int64), np.ones(n, bool)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=n_groups(n))
    first = np.cumsum(sizes) - sizes
    for size in range(int(sizes.max(initial=0)), 1, -1):
        todo = np.flatnonzero(sizes == size)
        salt = 0
        while len(todo):
            salt += 1
            keys = order[first[todo][:, None] + np.arange(size)]
            at = (mixed(x[keys], y[keys], salt) % np.uint64(n)).astype(np.int64)
            taker = np.full(n, -1, np.int64)
            rows = np.repeat(np.arange(len(todo)), size)
            taker[at.ravel()[::-1]] = rows[::-1]
            sole = np.sort(at, axis=1)
            fits = free[at].all(axis=1) & (taker[at] == np.arange(len(todo))[:, None]).all(axis=1) & (sole[:, 1:] != sole[:, :-1]).all(axis=1)
            slot[keys[fits]], d[todo[fits]] = at[fits], salt
            free[at[fits].ravel()] = False
            todo = todo[~fits]
    alone = order[first[sizes == 1]]
    slot[alone] = np.flatnonzero(free)[: len(alone)]
    d[group[alone]] = -slot[alone] - 1
    return d, slot


def slots_of(x: np.ndarray, y: np.ndarray, d: np.ndarray, n_keys: int) -> np.ndarray:
    """The slot of each key."""
    own = d[(mixed(x, y, 0) % np.uint64(n_groups(n_keys))).astype(np.int64)]
    return np.where(own < 0, -own - 1, (mixed(x, y, np.maximum(own, 0)) % np.uint64(n_keys)).astype(np.int64))


def with_hashes(keys: DataFrame, n_buckets: int) -> DataFrame:
    hashed = keys.withColumn("x", F.xxhash64(F.lit(1), "doc_id", "occurrence")).withColumn("y", F.xxhash64(F.lit(2), "doc_id", "occurrence"))
    return hashed.withColumn("bucket", F.pmod("x", F.lit(n_buckets)))


def build_index(places: DataFrame, shards: DataFrame, bucket_keys: int) -> DataFrame:
    """One row per bucket: its displacements and slots as bytes."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = (rows[c].to_numpy().view(np.uint64) for c in ("x", "y"))
        d, slot = displacements(x, y)
        table = np.zeros(len(rows), SLOT)
        table["fingerprint"][slot] = (y & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for c, name in (("shard", "number"), ("offset", "offset"), ("length", "n_tokens")):
            table[c][slot] = rows[name].to_numpy()
        return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "n_keys": [len(rows)], "displacements": [d.astype("<i8").tobytes()], "slots": [table.tobytes()]})

    n_buckets = max(1, -(-places.count() // bucket_keys))
    keyed = with_hashes(places.join(shards.select("shard", "number"), "shard").drop("shard"), n_buckets)
    built = keyed.groupBy("bucket").applyInPandas(build, "bucket long, n_keys long, displacements binary, slots binary")
    return built.withColumn("n_buckets", F.lit(n_buckets).cast("long"))


def write_token_files(documents: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_bytes: int = 32 << 20, bucket_keys: int = 2048) -> TokenFiles:
    """Write shards, the list of shards and the index below `folder`; return the dataset.

    A null text has no ids but the end id, as an empty one. Repeated rows, and different rows of one doc_id, follow
    one another and are told apart by their occurrence. A null doc_id is a key like any other and comes first. An
    empty table gives a dataset without shards. Columns beside doc_id and text play no part.
    """
    with_text(documents)
    spark = documents.sparkSession
    small_batches(spark)
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(tokens.tokenizer_path(tokenizer)).get_vocab_size(), end_id + 1)
    files = TokenFiles(folder, 2 if size <= 1 << 16 else 4)
    write_shards(documents, f"{folder}/ids", tokenizer, end_id, files.id_bytes, shard_bytes).write.parquet(files.places)
    places = spark.read.parquet(files.places)
    totals = places.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    # one row per shard of tens of MB, so this window is small whatever the corpus
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = totals.select("shard", "n_tokens", (F.row_number().over(Window.orderBy("shard")) - 1).cast("long").alias("number"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start"))
    numbered.write.parquet(files.shards)
    build_index(places, spark.read.parquet(files.shards), bucket_keys).write.parquet(files.index)
    return files


def look_up(keys: DataFrame, files: TokenFiles) -> DataFrame:
    """Places (shard number, offset, length) of keys (doc_id, occurrence); keys that were never stored have no row.

    Keys meet their bucket's index in one task each; a bucket is small.
    """
    spark = keys.sparkSession
    index = spark.read.parquet(files.index)

    def find(rows: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series(dtype="bool" if c == "none" else "int64") for c in ("id", "none", "occurrence", "number", "offset", "n_tokens")})
        if not len(rows) or not len(bucket):
            return empty
        n, d, table = int(bucket["n_keys"].iloc[0]), np.frombuffer(bucket["displacements"].iloc[0], "<i8"), np.frombuffer(bucket["slots"].iloc[0], SLOT)
        x, y = (rows[c].to_numpy().view(np.uint64) for c in ("x", "y"))
        at = slots_of(x, y, d, n)
        own = (at >= 0) & (at < n)
        found = table[np.where(own, at, 0)]
        own &= found["fingerprint"] == (y & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out = rows.loc[own, ["id", "none", "occurrence"]]
        return out.assign(number=found["shard"][own].astype(np.int64), offset=found["offset"][own].astype(np.int64), n_tokens=found["length"][own].astype(np.int64))

    hashed = with_hashes(keys, index.agg(F.coalesce(F.max("n_buckets"), F.lit(1)).alias("n")).first()["n"])
    # pandas would turn a column of numbers with a null among them into floats
    apart = hashed.select("bucket", "x", "y", "occurrence", F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("none"))
    found = apart.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, "id long, none boolean, occurrence long, number long, offset long, n_tokens long")
    return found.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "occurrence", "number", "offset", "n_tokens")


def read_back(keys: DataFrame, files: TokenFiles) -> DataFrame:
    """For keys (doc_id, occurrence): start (ids of all documents before), n_tokens, ids_crc32, read from the shards.

    Look-ups are dealt by shard and read in file order.
    """
    spark = keys.sparkSession
    shards = spark.read.parquet(files.shards).select("number", "shard", "shard_start")
    folder, kind, width = f"{files.folder}/ids", f"<u{files.id_bytes}", files.id_bytes

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, file = None, None
        for batch in batches:
            sums = []
            for shard, offset, n in zip(*(batch.column(i).to_pylist() for i in (4, 1, 2)), strict=True):
                if shard != name:
                    name, file = shard, fs.open_input_file(f"{root}/{shard}")
                ids = np.frombuffer(file.read_at(n * width, offset * width), kind)
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.record_batch([batch.column(0), batch.column(3), batch.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = look_up(keys, files).join(shards, "number")
    ordered = placed.select("doc_id", "offset", "n_tokens", (F.col("shard_start") + F.col("offset")).alias("start"), "shard").repartition("shard").sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def keys_of(documents: DataFrame) -> DataFrame:
    """The keys of a table: doc_id and, for its repeats, the occurrence from 0."""
    counted = documents.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count()
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("occurrence"))


def token_files(documents: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write the whole table and read every document back through the index; see `write_token_files`, `read_back`."""
    files = write_token_files(documents, shared_folder(documents.sparkSession, "token-files"), tokenizer, end_id)
    return read_back(keys_of(documents), files)
