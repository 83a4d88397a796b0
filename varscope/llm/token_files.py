"""Token ids of whole texts in a compact file format.

Ids are renamed to their rank by frequency over the whole corpus, so that common ids are
small numbers, and ranks are coded in one to four bytes. The lengths stand apart from the
bytes: two bits a token, four tokens in each control byte (first token lowest), then the data
bytes, low byte first. A reader looks control bytes up in a table of 256 x 4 lengths, so both
directions are numpy array operations.

A set of files is a folder of Parquet files: ``files`` has a row a document (``shard``,
``shard_start``: ids of the shard before it, ``doc_id``, ``n_tokens``, ``control``, ``data``),
in ascending order of doc_id within a shard and from shard to shard; ``ranks`` has the id of
each rank. Written by Spark, so a lost task is written again and half a file is never seen.

Defined results: null text is an empty text and gives the end id alone; a null doc_id sorts
first; rows of equal doc_id follow each other in the order of their ids, equal rows alike;
an empty table gives files without rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import batch, binaries, raw, shared_path, slices, shuffle_partitions, written
from .tokens import codec

END_ID = 2
#: Bytes of text a shard is planned for.
SHARD_BYTES = 64 << 20
_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
LENGTHS = (_CODES + 1).astype(np.uint8)


def encode_ranks(ranks: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of documents whose ranks end at ``ends``, each with offsets."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    data_off = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])]
    n = np.diff(ends, prepend=0)
    ctl_off = np.concatenate([[0], np.cumsum((n + 3) // 4)])
    slot = np.arange(len(ranks)) + np.repeat(ctl_off[:-1] * 4 - (ends - n), n)   # each document starts a control byte
    codes = np.zeros(ctl_off[-1] * 4, np.uint8)
    codes[slot] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control, ctl_off, data, data_off


def decode_ranks(control: np.ndarray, ctl_off: np.ndarray, data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranks of documents of ``n`` tokens, one after the other."""
    ends = np.cumsum(n)
    slot = np.arange(ends[-1] if len(ends) else 0) + np.repeat(ctl_off[:-1] * 4 - (ends - n), n)
    size = LENGTHS[control].reshape(-1)[slot].astype(np.int64)
    at = np.cumsum(size) - size
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        out |= np.where(size > k, padded[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


@dataclass
class TokenFiles:
    path: str
    vocabulary: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("shard int, shard_start long, doc_id long, n_tokens long, control binary, data binary"
                                 ).parquet(f"{self.path}/files")

    def id_of_rank(self, spark: SparkSession) -> np.ndarray:
        """At most one row for each id of the vocabulary."""
        rows = spark.read.schema("rank int, id long").parquet(f"{self.path}/ranks").collect()
        out = np.zeros(self.vocabulary, np.uint32)
        for r in rows:
            out[r["rank"]] = r["id"]
        return out


def tokenize(docs: DataFrame, tokenizer: str, cut: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian, two bytes each if the vocabulary allows) of whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(tokenizer, cut)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in slices(batches, "text"):
            ids = [x + end for x in enc.encode([t or "" for t in b.column("text").to_pylist()])]
            n = np.array([len(x) for x in ids], np.int64) // enc.dtype.itemsize
            yield batch(["doc_id", "n_tokens", "ids"], [b.column("doc_id"), n, pa.array(ids, pa.binary())])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def write_token_files(docs: DataFrame, tokenizer: str, cut: str, end_id: int = END_ID) -> TokenFiles:
    spark = docs.sparkSession
    enc = codec(tokenizer, cut)
    wide, vocabulary = enc.dtype.str, max(enc.tok.get_vocab_size(), end_id + 1)
    ids = written(tokenize(docs, tokenizer, cut, end_id), "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in slices(batches, "ids"):
            total += np.bincount(raw(b.column("ids"))[0].view(wide), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield batch(["id", "n"], [used, total[used]])

    counts = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = sorted((-r["n"], r["id"]) for r in counts.collect())   # at most one row an id of the vocabulary
    rank_of = np.zeros(vocabulary, np.uint32)
    for k, (_, i) in enumerate(order):
        rank_of[i] = k

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        for b in slices(batches, "ids"):
            values, off = raw(b.column("ids"))
            n = np.diff(off) // np.dtype(wide).itemsize
            control, ctl_off, data, data_off = encode_ranks(rank_of[values.view(wide)], np.cumsum(n))
            yield batch(["shard", "shard_start", "doc_id", "n_tokens", "control", "data"],
                        [np.full(len(n), shard, np.int32), start + np.cumsum(n) - n, b.column("doc_id"), n,
                         binaries(control, ctl_off), binaries(data, data_off)])
            start += int(n.sum())

    path = shared_path(spark, "token-files")
    shards = max(shuffle_partitions(spark), -(-sum(-k for k, _ in order) * enc.dtype.itemsize // SHARD_BYTES))
    (ids.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
        .mapInArrow(code, "shard int, shard_start long, doc_id long, n_tokens long, control binary, data binary")
        .write.option("compression", "zstd").parquet(f"{path}/files"))
    spark.createDataFrame([(k, i) for k, (_, i) in enumerate(order)], "rank int, id long").coalesce(1).write.parquet(f"{path}/ranks")
    return TokenFiles(path, vocabulary)


def read_token_files(spark: SparkSession, files: TokenFiles, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids (array)."""
    id_of = files.id_of_rank(spark)
    rows = files.rows(spark)
    before = (rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))   # a row a shard
              .withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("shard")
                                                                .rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
              .select(F.col("shard").alias("_s"), "before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data"):
            control, ctl_off = raw(b.column("control"))
            data, _ = raw(b.column("data"))
            n = b.column("n_tokens").to_numpy()
            ends = np.cumsum(n)
            values = id_of[decode_ranks(control, ctl_off, data, n)].astype("<u4")
            crc = [zlib.crc32(values[e - k:e]) for e, k in zip(ends, n)]
            cols = [b.column("shard"), b.column("shard_start"), b.column("doc_id"), n, pa.array(crc, pa.int64())]
            names = ["shard", "shard_start", "doc_id", "n_tokens", "ids_crc32"]
            if ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values.view("<i4"))))
                names.append("ids")
            yield batch(names, cols)

    out = rows.mapInArrow(run, "shard int, shard_start long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    return (out.join(before, out["shard"] == before["_s"])
            .select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids))
