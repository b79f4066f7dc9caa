"""Byte-pair encoding and decoding of whole texts with a SentencePiece vocabulary.

Segments (words) are encoded together: one flat numpy array holds the symbols of all
of them, and each round takes the least pair rank of every word, merges its leftmost
occurrences at once and compacts the array, until no pair is left. Occurrences merge
at once only where that equals one-by-one merging: for ranks whose merge could create a
pair of the same or a better rank, only up to the first occurrence that does.

Words of more than BATCHED symbols have rounds of their own, which differ in one thing
only: pairs wait in lots by rank, so that a round touches the occurrences of its rank and
not the whole word, and dead symbols are compacted away at the end. BATCHED bounds how
long a word may be that holds up the rounds of others; both ways give the same ids.

Defined results: null and empty texts give the end id alone and decode to an empty
text; characters outside the vocabulary become byte pieces; repeated rows are encoded
alike, once each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilis.llm.common import small_batches
from profilis.llm.pieces import SPACE, Pieces, Segmenter, WordCache, built, read_pieces

BATCHED = 256
#: Bytes that a worker's kept words may take, about.
CACHE_BYTES = 64 << 20
#: Words that are looked up and encoded together.
LOT = 100_000
NONE = np.int32(2**31 - 1)


class BpeCodec:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.segmenter = Segmenter(pieces)
        ids = pieces.ids
        self.n = len(pieces.names)
        self.by_point = np.arange(0x110000, dtype=np.int32) + np.int32(self.n)
        for p, i in ids.items():
            if len(p) == 1:
                self.by_point[ord(p)] = i
        self.decimal = [str(i) for i in range(self.n)]
        ascii_bytes = {i: chr(b) for b, i in enumerate(pieces.bytes_at) if b < 128}
        #: Text of each id that means the same whatever stands beside it, else None.
        self.plain: list[str | None] = [ascii_bytes.get(i) for i in range(self.n)]
        for i in pieces.normal:
            self.plain[i] = pieces.names[i].replace(SPACE, " ")
        order = {s: r for r, s in enumerate(sorted({pieces.scores[i] for i in pieces.normal}, reverse=True))}
        rank = {i: order[pieces.scores[i]] for i in pieces.normal}
        pairs: dict[int, int] = {}
        shared = np.zeros(len(order), dtype=np.int32)
        single = np.zeros(len(order), dtype=bool)
        for whole, i in ids.items():
            if len(whole) > 1:
                shared[rank[i]] += 1
            for k in range(1, len(whole)):
                a, b = ids.get(whole[:k]), ids.get(whole[k:])
                if a is None or b is None:
                    continue
                pairs[a * self.n + b] = i
                for part in (a, b):
                    if len(pieces.names[part]) > 1 and rank[part] >= rank[i]:
                        single[rank[part]] = True
        self.pairs = pairs
        self.rank = rank
        self.one_by_one = single | (shared > 1)
        # pairs by open addressing, so that numpy can look many up at once
        self.slots = 1 << max(10, (8 * len(pairs)).bit_length())
        self.slot_keys = np.full(self.slots, -1, dtype=np.int64)
        self.slot_ids = np.zeros(self.slots, dtype=np.int32)
        self.slot_ranks = np.full(self.slots, NONE, dtype=np.int32)
        for key, i in pairs.items():
            at = self._slot(key)
            while self.slot_keys[at] >= 0:
                at = (at + 1) % self.slots
            self.slot_keys[at], self.slot_ids[at], self.slot_ranks[at] = key, i, rank[i]
        self.words = WordCache(CACHE_BYTES)

    # -- symbols ---------------------------------------------------------------
    def _symbols(self, joined: str) -> np.ndarray:
        """Ids of single characters; those outside the vocabulary stand as n + code point."""
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        return self.by_point[points]

    def _final(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of characters outside the vocabulary."""
        odd = np.flatnonzero(flat >= self.n)
        if not len(odd):
            return flat, size
        put = [[self.pieces.bytes_at[b] for b in chr(s - self.n).encode()] for s in flat[odd].tolist()]
        width = np.ones(len(flat), dtype=np.int64)
        width[odd] = [len(x) for x in put]
        out = np.repeat(flat, width)
        at = np.cumsum(width) - width
        for i, ids in zip(at[odd].tolist(), put, strict=True):
            out[i : i + len(ids)] = ids
        ends = np.concatenate([[0], np.cumsum(width)])
        bounds = np.concatenate([[0], np.cumsum(size)])
        return out, np.diff(ends[bounds])

    # -- encoding --------------------------------------------------------------
    def _slot(self, key):
        return (key * 0x9E3779B1 >> 15) & (self.slots - 1)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of each pair; NONE where the vocabulary has no such piece."""
        key = a.astype(np.int64) * self.n + b
        key[(a >= self.n) | (b >= self.n)] = -2
        at = self._slot(key)
        there = self.slot_keys[at]
        left = np.flatnonzero((there != key) & (there != -1))
        while len(left):
            at[left] = (at[left] + 1) % self.slots
            there = self.slot_keys[at[left]]
            left = left[(there != key[left]) & (there != -1)]
        return self.slot_ranks[at], self.slot_ids[at]  # an empty slot has rank NONE

    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym = self._symbols("".join(words))
        alone = length > BATCHED
        short = np.flatnonzero(~alone & (length > 0))
        at = np.cumsum(length) - length
        long = [(k, self._long_by_rounds(sym[at[k] : at[k] + length[k]])) for k in np.flatnonzero(alone).tolist()]
        flat, owner = self._by_rounds(sym[~np.repeat(alone, length)] if long else sym, length[short])
        owner = short[owner]
        if long:
            flat = np.concatenate([flat, *(x for _, x in long)])
            owner = np.concatenate([owner, *(np.full(len(x), k) for k, x in long)])
            order = np.argsort(owner, kind="stable")
            flat, owner = flat[order], owner[order]
        return self._final(flat, np.bincount(owner, minlength=len(words)))

    def _by_rounds(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, word by word, and the word of each."""
        if not len(sym):
            return sym, np.zeros(0, dtype=np.int64)
        sym = sym.copy()
        who = np.arange(len(size))
        word = np.repeat(np.arange(len(size), dtype=np.int32), size)
        rank, made = np.full(len(sym), NONE, dtype=np.int32), np.zeros(len(sym), dtype=np.int32)
        rank[:-1], made[:-1] = self._pair(sym[:-1], sym[1:])
        rank[np.cumsum(size) - 1] = NONE  # a word's last symbol has no right neighbour
        ready: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        while True:
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            done = least == NONE
            if done.any():
                keep = ~done[word]
                ready.append(sym[~keep])
                owner.append(who[word[~keep]])
                sym, rank, made = sym[keep], rank[keep], made[keep]
                size, who, least = size[~done], who[~done], least[~done]
                if not len(sym):
                    flat, of = np.concatenate(ready), np.concatenate(owner)
                    order = np.argsort(of, kind="stable")
                    return flat[order], of[order]
                word = np.repeat(np.arange(len(size), dtype=np.int32), size)
            hit = np.flatnonzero(rank == least[word])
            w = word[hit]
            first = np.concatenate([[True], w[1:] != w[:-1]])
            run = np.concatenate([[True], np.diff(hit) != 1]) | first
            since = hit - hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]
            take = hit[np.where(self.one_by_one[least[w]], first, since % 2 == 0)]
            sym[take] = made[take]
            keep = np.ones(len(sym), dtype=bool)
            keep[take + 1] = False
            now = np.cumsum(keep)[take] - 1  # where the merged symbols stand after compaction
            size = size - np.bincount(word[take], minlength=len(size))
            sym, rank, made, word = sym[keep], rank[keep], made[keep], word[keep]
            for i in (now[now > 0] - 1, now):  # only pairs beside a merged symbol change
                j = np.minimum(i + 1, len(sym) - 1)
                rank[i], made[i] = self._pair(sym[i], sym[j])
                rank[i[(j == i) | (word[i] != word[j])]] = NONE

    def _long_by_rounds(self, sym: np.ndarray) -> np.ndarray:
        """The same for one long word; symbols are linked, pairs wait in lots by rank."""
        n = len(sym)
        sym = np.append(sym, np.int32(2**31 - 1))  # a last symbol that pairs with nothing
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank, made = np.full(n + 1, NONE, dtype=np.int32), np.zeros(n + 1, dtype=np.int32)
        rank[: n - 1], made[: n - 1] = self._pair(sym[: n - 1], sym[1:n])
        alive = np.ones(n + 1, dtype=bool)
        lots: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(places: np.ndarray) -> None:
            of = rank[places]
            places, of = places[of != NONE], of[of != NONE]
            order = np.argsort(of, kind="stable")
            places, of = places[order], of[order]
            for some in np.split(places, np.flatnonzero(of[1:] != of[:-1]) + 1) if len(places) else []:
                r = int(rank[some[0]])
                if r not in lots:
                    lots[r] = []
                    heapq.heappush(queue, r)
                lots[r].append(some)

        wait(np.arange(n - 1))
        while queue:
            r = heapq.heappop(queue)
            hit = np.concatenate(lots.pop(r))
            hit = np.unique(hit[rank[hit] == r])  # places whose pair has changed since are stale
            if not len(hit):
                continue
            run = np.concatenate([[True], after[hit[:-1]] != hit[1:]])
            since = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            take = hit[since % 2 == 0]  # the leftmost of overlapping occurrences
            gone = after[take]
            if self.one_by_one[r]:
                # merged up to the first that creates a pair as good: what stands left is merged, what stands right isn't
                left, right = before[take], after[gone]
                beside = np.concatenate([[False], gone[:-1] == left[1:]])
                left_sym = np.where(beside, np.concatenate([[0], made[take[:-1]]]), sym[left]).astype(np.int32)
                best = np.minimum(np.where(left >= 0, self._pair(left_sym, made[take])[0], NONE), self._pair(made[take], sym[right])[0])
                good = np.flatnonzero(best <= r)
                if len(good):
                    take, gone = take[: good[0] + 1], gone[: good[0] + 1]
            sym[take] = made[take]
            rank[gone], alive[gone] = NONE, False
            after[take] = after[gone]
            before[after[gone]] = take
            alter = np.concatenate([take, before[take]])
            alter = np.unique(alter[alter >= 0])
            rank[alter], made[alter] = self._pair(sym[alter], sym[after[alter]])
            left = hit[rank[hit] == r]
            wait(np.concatenate([alter, np.setdiff1d(left, alter, assume_unique=True)]))
        return sym[:n][alive[:n]]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, with the end id."""
        return [*self.encode_flat(self.segmenter.cut(text or ""))[0].tolist(), self.pieces.end_id]

    # -- decoding --------------------------------------------------------------
    def _joined(self, ids: list[int]) -> str:
        at = {i: b for b, i in enumerate(self.pieces.bytes_at)}
        out: list[str] = []
        raw = bytearray()
        normal = set(self.pieces.normal)
        for i in ids:
            if i in at:
                raw.append(at[i])
                continue
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
            out.append(self.pieces.names[i] if i in normal else "")
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the mark that encoding put first is taken off again."""
        return self._joined(ids).removeprefix(" ")

    # -- digests of many texts -------------------------------------------------
    def learn(self, words: set[str]) -> None:
        """Results of these words are in the cache, where room for them has been made."""
        fresh = [w for w in words if w not in self.words]
        if self.words.held > self.words.room:
            self.words.trim()
            fresh = list(words)
        flat, size = self.encode_flat(fresh)
        ids = flat.tolist()
        shown = list(map(self.decimal.__getitem__, ids))
        read = list(map(self.plain.__getitem__, ids))
        at = 0
        for word, n in zip(fresh, size.tolist(), strict=True):
            to = at + n
            text = read[at:to]
            self.words.keep(word, (n, " ".join(shown[at:to]), self._joined(ids[at:to]) if None in text else "".join(text)))
            at = to

    def digests(self, texts: list[str | None], keep_ids: bool = False) -> list[tuple[int, str, str, list[int] | None]]:
        """Of each text: number of ids, digests of ids and decoded text, and the ids if kept.

        Words are looked up in lots of about LOT, so that neither a long text nor many
        texts hold more at a time.
        """
        end = str(self.pieces.end_id)
        out: list[tuple[int, str, str, list[int] | None]] = []
        lot: list[list[str]] = []
        size = 0
        for text in texts:
            words = self.segmenter.segments(text or "")
            some = list(islice(words, LOT))
            if len(some) < LOT:
                lot.append(some)
                size += len(some)
            if len(some) == LOT or size >= LOT:
                out += self._of_lot(lot, end, keep_ids)
                lot, size = [], 0
            if len(some) == LOT:
                out.append(self._of_parts(chain([some], iter(lambda: list(islice(words, LOT)), [])), end, keep_ids))
        return out + self._of_lot(lot, end, keep_ids)

    def _of_lot(self, lot: list[list[str]], end: str, keep_ids: bool) -> list[tuple[int, str, str, list[int] | None]]:
        self.learn({w for words in lot for w in words})
        return [self._of_parts([words], end, keep_ids, known=True) for words in lot]

    def _of_parts(self, parts: Iterable[list[str]], end: str, keep_ids: bool, known: bool = False) -> tuple[int, str, str, list[int] | None]:
        n, first = 1, True
        of_ids, of_text = hashlib.sha256(), hashlib.sha256()
        ids: list[int] | None = [] if keep_ids else None
        for words in parts:
            if not known:
                self.learn(set(words))
            found = [self.words[w] for w in words]
            n += sum(f[0] for f in found)
            joined = " ".join([f[1] for f in found])
            of_ids.update(f"{joined} ".encode() if found else b"")
            text = "".join([f[2] for f in found])
            of_text.update((text[1:] if first else text).encode())  # the mark that encoding put first
            first = first and not found
            if ids is not None and found:
                ids += map(int, joined.split(" "))
        of_ids.update(end.encode())
        return n, of_ids.hexdigest(), of_text.hexdigest(), None if ids is None else [*ids, int(end)]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: its number of ids and digests of ids and decoded text.

    keep_ids adds ``ids`` (array<int>); keep names other columns to carry. Rows stay where
    they are: no shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(read_pieces(model_path))
    kept = [id_col, *(c for c in keep if c != id_col)]
    picked = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = built(BpeCodec, shipped.value)
        for batch in batches:
            found = codec.digests(batch.column(len(kept)).to_pylist(), keep_ids)
            columns = [*batch.columns[: len(kept)], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())]
            names = [*kept, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array([f[3] for f in found], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return picked.mapInArrow(run, f"{schema}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{', ids array<int>' if keep_ids else ''}")
