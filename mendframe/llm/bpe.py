"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

A vocabulary file gives ids of byte strings and ranked merges of id pairs. The symbols of many words stand in one flat
array; in each round every word merges all places of its lowest-rank pair, which a binary search over sorted pair keys
finds. Words come from the usual pattern for byte-level BPE, after special tokens are cut out of the text.

Each distinct blank-separated piece of a batch is encoded once: a pattern match never runs from a non-space character
into white space, so a piece that neither begins nor ends with white space is encoded alone as it is in its text; texts
with other pieces are encoded as a whole. A bounded cache keeps pieces between batches.

Defined cases: null and empty texts have no ids and decode to ""; a null doc_id stays null; words of any length take
time in proportion to it, but for a logarithm; repeated and tied rows are separate rows; an empty
table gives an empty result; extra columns stay out of the way, as only id and text columns are read.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from mendframe.llm.pieces import gather, split_pieces
from mendframe.llm.shared import slices, small_batches, tidied

# fixed values of byte-level BPE: the word pattern
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NO_PAIR = np.iinfo(np.int64).max
CACHED_WORDS = 300_000
LONG_WORD = 1000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself, or the next free one from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(own))}
    return [others.get(b, chr(b)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        self.byte_ids = np.array([vocab[s] for s in symbols], np.int64)
        value = {s: b for b, s in enumerate(symbols)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        pairs = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in merges], np.int64).reshape(-1, 3)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.ranks, self.merged = keys[order], order.astype(np.int64), pairs[order, 2]
        self.merged_of_rank = pairs[:, 2]
        texts = {i: bytes(value[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        pieces = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.token_starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.token_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.rank_of: dict[int, int] | None = None  # made for the first long word
        self.pattern = regex.compile(WORDS)
        self.cuts = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._forget()

    def _pair_ranks(self, ids: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each symbol, NO_PAIR where there is none; the last symbol of a word has none."""
        rank = np.full(len(ids), NO_PAIR)
        if len(ids) > 1 and len(self.pair_keys):
            keys = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            rank[:-1] = np.where((self.pair_keys[at] == keys) & (word[:-1] == word[1:]), self.ranks[at], NO_PAIR)
        return rank

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word begins (one more at the end).

        A round costs the length of what is still open, so the few words of over LONG_WORD bytes, which would keep rounds
        open for long, are merged place by place instead.
        """
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        if not long:
            return self._merge_rounds(words)
        ids, starts = self._merge_rounds([w if len(w) <= LONG_WORD else b"" for w in words])
        parts = [ids[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        for i in long:
            parts[i] = self._merge_places(words[i])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _merge_places(self, word: bytes) -> np.ndarray:
        """Ids of one word: its places by rank from a heap, each merge with the symbols around it as they then are."""
        if self.rank_of is None:
            self.rank_of = dict(zip(self.pair_keys.tolist(), self.ranks.tolist(), strict=True))
        ids, rank_of = self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), self.rank_of
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank_of[k], i) for i in range(n - 1) if (k := ids[i] << 32 | ids[i + 1]) in rank_of]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of.get(ids[i] << 32 | ids[j]) != rank:
                continue  # one of the two has gone into another symbol
            ids[i], ids[j], after[i] = int(self.merged_of_rank[rank]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (k := ids[a] << 32 | ids[b]) in rank_of:
                    heappush(heap, (rank_of[k], a))
        return np.array([x for x in ids if x >= 0], np.int64)

    def _merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids = self.byte_ids[flat]
        word = np.repeat(np.arange(len(words), dtype=np.int64), [len(w) for w in words])
        done_ids, done_word = [], []
        while len(ids):
            rank = self._pair_ranks(ids, word)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            open_ = np.repeat(lowest != NO_PAIR, size)
            done_ids.append(ids[~open_])
            done_word.append(word[~open_])
            ids, word, rank = ids[open_], word[open_], rank[open_]
            if not len(ids):
                break
            best = np.repeat(lowest[lowest != NO_PAIR], size[lowest != NO_PAIR])
            hit = rank == best
            # of touching places (a pair of equal symbols) every second one merges, from the left
            run_start = hit & ~np.concatenate([[False], hit[:-1]])
            at = np.arange(len(hit))
            since = at - np.maximum.accumulate(np.where(run_start, at, -1))
            hit &= since % 2 == 0
            ids[hit] = self.merged_of_rank[best[hit]]
            keep = ~np.concatenate([[False], hit[:-1]])
            ids, word = ids[keep], word[keep]
        ids, word = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (done_ids, done_word))
        order = np.argsort(word, kind="stable")
        return ids[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def _words(self, text: str, out: list[bytes | int]) -> None:
        """Appends the words of a text, and ids of special tokens between them."""
        at = 0
        for cut in self.cuts.finditer(text) if self.cuts else ():
            if cut.start() > at:
                out += [w.encode() for w in self.pattern.findall(text[at : cut.start()])]
            out.append(self.special[cut[0]])
            at = cut.end()
        out += [w.encode() for w in self.pattern.findall(text[at:] if at else text)]

    def _known(self, words: list[bytes | int]) -> np.ndarray:
        """Rows of the store for words; new ones are merged in one go. The caller keeps the store from growing too far."""
        rows = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = list(dict.fromkeys(words[i] for i in missing.tolist()))
            merged = [w for w in new if isinstance(w, bytes)]
            ids, starts = self.merge_words(merged)
            special = np.array([w for w in new if not isinstance(w, bytes)], np.int64)
            base, n = len(self.store_ids), len(self.store_starts) - 1
            self.store_ids = np.concatenate([self.store_ids, ids, special])
            ends = np.concatenate([starts[1:], len(ids) + 1 + np.arange(len(special))])
            self.store_starts = np.concatenate([self.store_starts, base + ends])
            self.rows.update(zip(merged + special.tolist(), range(n, n + len(new)), strict=True))
            rows[missing] = np.fromiter((self.rows[words[i]] for i in missing.tolist()), np.int64, len(missing))
        return rows

    def _piece_rows(self, pieces: pa.Array, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the store for the words of pieces, led by a blank where `blank` says so, and where each piece begins.

        Letters alone are one word, and so are a comma or full stop behind them; other pieces go through the pattern.
        """
        tail, stem = pc.utf8_slice_codeunits(pieces, -1), pc.utf8_slice_codeunits(pieces, 0, -1)
        comma = pc.equal(tail, ",")
        cut = pc.and_(pc.or_(comma, pc.equal(tail, ".")), pc.utf8_is_alpha(stem))
        lead = pc.if_else(pa.array(blank), " ", "").cast(pieces.type)
        whole = pc.binary_join_element_wise(lead, pc.if_else(cut, stem, pieces), pa.scalar("", pieces.type))
        plain = np.asarray(pc.or_(cut, pc.utf8_is_alpha(pieces)))
        cut, comma = np.asarray(cut), np.asarray(comma)
        coded = pc.dictionary_encode(whole.filter(pa.array(plain)))
        own = self._known(coded.dictionary.cast(pa.large_binary()).to_pylist())[np.asarray(coded.indices).astype(np.int64)]
        signs = self._known([b",", b"."])
        hard: list[bytes | int] = []
        sizes = [0]
        for text in whole.filter(pa.array(~plain)).to_pylist():
            self._words(text, hard)
            sizes.append(len(hard))
        count = (1 + cut).astype(np.int64)
        count[~plain] = np.diff(sizes)
        ends = np.concatenate([[0], np.cumsum(count)])
        rows = np.empty(ends[-1], np.int64)
        of_plain = np.repeat(plain, count)
        rows[~of_plain] = self._known(hard)
        rows[ends[:-1][plain]] = own
        rows[ends[1:][cut] - 1] = np.where(comma[cut], signs[0], signs[1])
        return rows, ends

    def _forget(self) -> None:
        self.rows: dict[bytes | int, int] = {}
        self.store_ids, self.store_starts = np.empty(0, np.int64), np.zeros(1, np.int64)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins (one more at the end)."""
        if not len(texts):
            return np.empty(0, np.int64), np.zeros(1, np.int64)
        if len(self.rows) > CACHED_WORDS:
            self._forget()
        pieces, codes, offsets = split_pieces(texts)
        n, sizes = len(pieces), np.diff(offsets)
        loose = blanks(pc.utf8_slice_codeunits(pieces, 0, 1)) | blanks(pc.utf8_slice_codeunits(pieces, -1))
        whole = np.add.reduceat(loose[codes].astype(np.int64), offsets[:-1]) > 0
        # codes from n on are pieces at the start of a text; the others have their blank before them
        leads = np.zeros(len(codes), np.int64)
        leads[offsets[:-1]] = n
        shifted = (codes + leads)[~np.repeat(whole, sizes)]
        used = np.flatnonzero(np.bincount(shifted, minlength=2 * n))
        place = np.zeros(2 * n, np.int64)
        place[used] = np.arange(len(used))
        rows, word_starts = self._piece_rows(pieces.take(pa.array(used % n)), used < n)
        words: list[bytes | int] = []
        ends = []
        for i in np.flatnonzero(whole).tolist():
            self._words(texts[i].as_py() or "", words)
            ends.append(len(rows) + len(words))
        rows = np.concatenate([rows, self._known(words)])
        word_starts = np.concatenate([word_starts, np.array(ends, np.int64)])
        order = np.empty(len(shifted) + int(whole.sum()), np.int64)
        begins = np.concatenate([[0], np.cumsum(np.where(whole, 1, sizes))])
        single = np.zeros(len(order), bool)
        single[begins[:-1][whole]] = True
        order[~single] = place[shifted]
        order[single] = len(used) + np.arange(int(whole.sum()))
        # ids of each distinct piece, then of all pieces in the order of the texts
        piece_ids, word_ends = gather(self.store_ids, self.store_starts, rows)
        ids, piece_ends = gather(piece_ids, word_ends[word_starts], order)
        return ids, piece_ends[begins]

    def decode_batch(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """Texts of ids; bytes that are no UTF-8 give U+FFFD."""
        data, ends = gather(self.token_bytes, self.token_starts, ids)
        raw = data.tobytes()
        at = ends[starts].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def blanks(characters: pa.Array) -> np.ndarray:
    """Which of the characters are blank, or missing."""
    coded = pc.dictionary_encode(characters)
    return np.array([not c or c.isspace() for c in coded.dictionary.to_pylist()], bool)[np.asarray(coded.indices)]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and tokens array<int> of documents."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids, starts = codec(path).encode_batch(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "tokens"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(tidied(run), "doc_id long, tokens array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of encode()."""
    small_batches(tokens.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            starts = np.asarray(lists.offsets).astype(np.int64)
            texts = codec(path).decode_batch(np.asarray(lists.values).astype(np.int64)[starts[0] : starts[-1]], starts - starts[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "tokens").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode and decode in one pass, without ids between two stages."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids, starts = own.encode_batch(batch.column(1))
            little = memoryview(ids.astype("<u4")).cast("B")
            at = starts.tolist()
            spans = list(zip(at[:-1], at[1:], strict=True))
            digests = [hashlib.sha256(little[4 * a : 4 * b]).hexdigest() for a, b in spans]
            texts = [hashlib.sha256(t.encode()).hexdigest() for t in own.decode_batch(ids, starts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(starts), pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
