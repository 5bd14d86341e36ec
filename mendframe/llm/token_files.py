"""Token ids in ORC files: run-length encoded integer lists, row indexes, and Bloom filters on document ids.

Rows (doc_id, tokens, block, place) lie in ascending doc_id order over the files of a folder: block is the file's
number, place the row's number in it. Readers split files at stripes; a filter on doc_id skips stripes and row groups
by their minimum and maximum and by the Bloom filter. Where a document starts in the whole token stream follows from
sums of blocks and a running sum within each block, so no task sees all documents.

Tokens come from the tokenizers library. Each distinct word of a batch is encoded once: a vocabulary whose
pre-tokenizer drops white space and parts letters from signs, and whose normalizer works character by character or by
canonical composition, gives the same ids for a text as for its words one after the other; the constructor checks that
the vocabulary is one.

Defined cases: null and empty texts have the end id alone; rows without doc_id come first; rows that tie in doc_id are ordered by a hash of the text;
equal rows are adjacent; an empty table gives an empty folder and an empty result; extra columns are not written.
"""
from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendframe.llm.pieces import gather, split_pieces
from mendframe.llm.shared import estimated_bytes, materialise, small_batches, tidied

STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 1000
BLOOM_RATE = 0.01
SCHEMA = "doc_id bigint, tokens array<int>, block int, place bigint"
CACHED_WORDS = 600_000
ENCODED_AT_ONCE = 5_000
JOINED = 500
FILE_BYTES = 256 << 20
BATCH_BYTES = 8 << 20


class PieceEncoder:
    """Encodes distinct words with the library; a store of bounded size keeps their ids between batches."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each core has a worker of its own
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]] if spec["normalizer"] else [])
        splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        inner = any(p["behavior"] == "Removed" and p["invert"] and " " not in p["pattern"]["Regex"] for p in splits)
        marks = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and " " not in t["content"] for t in spec["added_tokens"])
        if not inner or not marks or {s["type"] for s in steps} - {"NFC", "Replace", "Lowercase"} or spec["post_processor"]:
            raise ValueError(f"{path} may join tokens over blanks; encode whole texts instead")
        self.lowers = any(s["type"] == "Lowercase" for s in steps)
        suffix = spec["model"].get("end_of_word_suffix")
        self.ending = np.zeros(max(spec["model"]["vocab"].values()) + 1 + len(spec["added_tokens"]), bool)
        if suffix:
            self.ending[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has.

        Words are given to the library as one text where its ids show as many ends of words as there are words, each of
        which is at least one; otherwise one by one.
        """
        joined = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        ids = np.array(joined, np.int32)
        ends = np.flatnonzero(self.ending[ids])
        if len(ends) == len(words):
            return ids, np.diff(ends, prepend=-1)
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(lists), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))

    def _known(self, words: list[str], plain: np.ndarray) -> np.ndarray:
        """Rows of the store for distinct words; the library encodes new ones. plain: words of letters alone."""
        rows = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(rows < 0)
        for group, at_once in ((new[plain[new]], JOINED), (new[~plain[new]], ENCODED_AT_ONCE)):
            ids, lengths = [self.ids], []
            for i in range(0, len(group), at_once):
                some = [words[k] for k in group[i : i + at_once].tolist()]
                if at_once == JOINED:
                    own, n = self._encoded(some)
                else:
                    lists = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                    own, n = np.fromiter(chain.from_iterable(lists), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))
                ids.append(own)
                lengths.append(n)
            if lengths:
                first = len(self.starts) - 1
                self.ids = np.concatenate(ids)
                self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(lengths))])
                rows[group] = first + np.arange(len(group))
                self.rows.update(zip([words[k] for k in group.tolist()], rows[group].tolist(), strict=True))
        return rows

    def encode_batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by end_id, and where each text begins (one more at the end)."""
        if len(self.rows) > CACHED_WORDS:
            self._forget()
        # the normalizer turns white space to a blank and the pre-tokenizer drops it
        pieces, codes, offsets = split_pieces(pc.replace_substring(texts, "\n", " "))
        # letters and signs are never in one token, so a comma or full stop behind letters is a word of its own
        tail = pc.utf8_slice_codeunits(pieces, -1)
        stem = pc.utf8_slice_codeunits(pieces, 0, -1)
        cut = pc.and_(pc.or_(pc.equal(tail, ","), pc.equal(tail, ".")), pc.utf8_is_alpha(stem))
        word = pc.if_else(cut, stem, pieces)
        plain = pc.utf8_is_alpha(word)
        if self.lowers:
            word = pc.if_else(pc.and_(plain, pc.string_is_ascii(word)), pc.ascii_lower(word), word)
        coded = pc.dictionary_encode(word)
        letters = np.zeros(len(coded.dictionary), bool)
        index = np.asarray(coded.indices).astype(np.int64)
        letters[index] = np.asarray(plain)
        signs = self._known([",", "."], np.zeros(2, bool))
        rows = self._known(coded.dictionary.to_pylist(), letters)[index]
        cut = np.asarray(cut)
        count = 1 + cut
        ends = np.concatenate([[0], np.cumsum(count)])
        words = np.empty(ends[-1], np.int64)
        words[ends[:-1]] = rows
        words[ends[1:][cut] - 1] = np.where(np.asarray(pc.equal(tail, ","))[cut], signs[0], signs[1])
        piece_ids, word_ends = gather(self.ids, self.starts, words)
        ids, ends_of = gather(piece_ids, word_ends[ends], codes)
        starts = ends_of[offsets]
        return np.insert(ids, starts[1:], end_id), starts + np.arange(len(starts))


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int) -> None:
    """Encodes documents and writes them to folder as ORC in ascending doc_id order."""
    small_batches(docs.sparkSession, BATCH_BYTES)  # larger ones repeat fewer pieces
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), estimated_bytes(rows) // FILE_BYTES)
    placed = rows.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, starts = encoder(path).encode_batch(batch.column(1), end_id)
            n = batch.num_rows
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.array(np.full(n, block), pa.int32()), pa.array(place + np.arange(n), pa.int64())],
                names=["doc_id", "tokens", "block", "place"],
            )
            place += n

    writer = placed.mapInArrow(tidied(run), SCHEMA).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_RATE)
    writer.option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", ROW_INDEX_STRIDE).option("orc.create.index", "true").option("compression", "zstd").orc(folder)


def read_tokens(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of write_tokens(); doc_ids become a filter that ORC pushes down to stripes and row groups."""
    rows = spark.read.schema(SCHEMA).orc(folder)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_places(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of the files."""
    small_batches(spark, BATCH_BYTES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            starts = np.asarray(lists.offsets).astype(np.int64)
            little = memoryview(np.ascontiguousarray(lists.values).astype("<u4")).cast("B")
            sums = [zlib.crc32(little[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(starts), pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "block", "place", "n_tokens", "ids_crc32"],
            )

    rows = read_tokens(spark, folder).mapInArrow(run, "doc_id long, block int, place long, n_tokens long, ids_crc32 long")
    kept = materialise(rows, "places")
    earlier = W.partitionBy(F.lit(0)).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = kept.groupBy("block").agg(F.sum("n_tokens").alias("n")).select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = W.partitionBy("block").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    return (
        kept.withColumn("start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(F.broadcast(blocks), "block")  # a row a file
        .select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
    )
