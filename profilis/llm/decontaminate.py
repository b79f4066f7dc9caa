"""Benchmark decontamination by pigeonhole edit matching.

A test item of L characters with an error budget of k edits is split into k + 1 pieces
(one more if that is odd): wherever the item occurs with at most k edits, one of the
pairs of neighbouring pieces has at most one edit, so one piece of it stands unharmed
and the other differs by one edit at most. All eight-byte windows of a text are looked
up at once in a table of the pieces' beginnings; a true piece hit whose neighbour fits
fixes where the item would lie, a q-gram count dismisses chance hits, and Myers'
bit-parallel distance decides.

Items that share a pair of pieces (a common opening, say) share one look at a hit, and the
q-grams of all of them are counted at once; items with the same text are one. The tables
are flat arrays, made once in a Python worker; what verification needs of an item is made
when it is first met and given up beyond KEPT_BYTES.

Texts and items are compared in lower case, with ASCII punctuation and white space as
single spaces. The budget is a tenth of the item, less where pieces would be shorter
than eight characters.

Items go out in passes whose tables take at most about BUILT_BYTES, the proven bound of
what is broadcast.

Defined results: null and empty texts or items match nothing; items of fewer than eight
bytes must occur exactly, as whole words; repeated rows give repeated results; an empty
table of documents or items gives an empty result, and drops nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilis.llm.common import arrow_kind, by_ids, cut, parts, small_batches

ERROR_SHARE = 0.1
#: What one pass of items may take in a worker; an item takes ITEM_COST and BYTE_COST a byte, about.
BUILT_BYTES, ITEM_COST, BYTE_COST = 256 << 20, 500, 16
#: What a worker keeps for the verification of items it has met, about.
KEPT_BYTES = 48 << 20
WINDOW, GRAM, HALF = 8, 4, 4
#: Hits and pairs looked at together.
LOT = 1 << 18
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_TABLE).split())


def myers(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to any stretch of the text."""
    m = len(pattern)
    if not m:
        return 0
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        at[c] |= 1 << i
    return _myers(dict(at), m, text)


def _myers(at: dict[str, int], m: int, text: str) -> int:
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = mask, 0, m, m
    get = at.get
    for c in text:
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & mask)
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        plus = mh | (~(xv | ph) & mask)
        minus = ph & xv
    return best


def budget_of(n):
    """Edits allowed in an item of n characters (numbers or arrays of them)."""
    return np.maximum(0, np.minimum((n * ERROR_SHARE).astype(np.int64) if isinstance(n, np.ndarray) else int(n * ERROR_SHARE), n // WINDOW - 2))


def gram_codes(text: str) -> np.ndarray:
    """16-bit hashes of a text's q-grams; equal grams have equal codes."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    n = len(points) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint16)
    code = np.zeros(n, dtype=np.uint32)
    for i in range(GRAM):
        code = code * np.uint32(0x9E3779B1) + points[i : i + n]
    return ((code * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)


class Item:
    """What verification needs of an item."""

    def __init__(self, item_id, text: str | None, raw: bytes | None = None):
        self.id = item_id
        self.raw = normalised(text) if raw is None else raw
        self.text = self.raw.decode("utf-8", "replace")
        self.budget = int(budget_of(len(self.text)))
        self.grams = gram_codes(self.text)
        self.needed = len(self.grams) - GRAM * self.budget
        masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(self.text):
            masks[c] |= 1 << i
        self.masks = dict(masks)

    @property
    def cost(self) -> int:
        return 600 + len(self.text) * (8 + len(self.masks) // 8) + 100 * len(self.masks)

    def distance(self, around: str) -> int:
        """Distance to the nearest stretch, or more than the budget."""
        if self.needed > 0:
            have = np.zeros(1 << 16, dtype=bool)
            have[gram_codes(around)] = True
            if int(have[self.grams].sum()) < self.needed:
                return self.budget + 1
        return _myers(self.masks, len(self.text), around)


class Matcher:
    """Finds items in texts; ``rows`` are (id, text), results name items by their row."""

    def __init__(self, texts: list[str | None]):
        import xxhash

        at: dict[bytes, int] = {}
        rows, which = [], []
        for row, text in enumerate(texts):
            if raw := normalised(text):
                rows.append(row)
                which.append(at.setdefault(raw, len(at)))
        raws = list(at)
        del at
        order = np.argsort(which, kind="stable")
        self.rows = np.array(rows, dtype=np.int64)[order]
        self.first_row = np.searchsorted(np.array(which, dtype=np.int64)[order], np.arange(len(raws) + 1))
        #: Short items by their number of words.
        self.short: dict[int, dict[bytes, int]] = defaultdict(dict)
        for i, raw in enumerate(raws):
            if len(raw) < WINDOW:
                self.short[raw.count(b" ") + 1][raw] = i
        self.blob = b"".join(raws)
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in raws], dtype=np.int64)]) if raws else np.zeros(1, dtype=np.int64)
        del raws
        self._pieces(xxhash.xxh3_64_intdigest)
        self.kept: dict[int, Item] = {}
        self.kept_cost = 0
        self.group_grams: dict[int, tuple] = {}

    def raw(self, i: int) -> bytes:
        return self.blob[self.at[i] : self.at[i + 1]]

    def item(self, i: int) -> Item:
        found = self.kept.get(i)
        if found is None:
            self._make_room()
            found = self.kept[i] = Item(i, None, self.raw(i))
            self.kept_cost += found.cost
        return found

    def _make_room(self) -> None:
        if self.kept_cost > KEPT_BYTES:
            self.kept.clear()
            self.group_grams.clear()
            self.kept_cost = 0

    # -- tables ------------------------------------------------------------------
    def _pieces(self, digest) -> None:
        """Flat arrays of all pieces of items that aren't short, sorted by window and by pair."""
        size = np.diff(self.at)
        whole = np.flatnonzero(size >= WINDOW)
        flat = np.frombuffer(self.blob, dtype=np.uint8)
        # places where characters begin; in ASCII blobs these are all places
        plain = bool((flat < 128).all())
        begins = None if plain else np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(flat)).astype(np.int32)
        base = self.at[whole] if plain else np.searchsorted(begins, self.at[whole])
        chars = size[whole] if plain else np.searchsorted(begins, self.at[whole + 1]) - base
        budget = budget_of(chars)
        count = np.where(budget > 0, budget + 1 + (budget + 1) % 2, 1)
        self.budget = np.zeros(len(size), dtype=np.int32)
        self.budget[whole] = budget
        owner = np.repeat(np.arange(len(whole)), count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        place = lambda k: base[owner] + chars[owner] * k // count[owner]
        self.begin, self.end = ((place(number + d) if plain else begins[place(number + d)]).astype(np.int32) for d in (0, 1))
        #: The other piece of a pair, -1 where there is none; whether it stands before.
        self.other = np.where(count[owner] > 1, np.arange(len(owner)) + np.where(number % 2, -1, 1), -1).astype(np.int32)
        self.before = (number % 2).astype(bool)
        self.of_item = whole[owner].astype(np.int32)
        del owner, number, begins
        windows = _windows(self.blob)
        key = windows[self.begin]
        blob = self.blob
        own = np.fromiter((digest(blob[a:b]) for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True)), dtype=np.uint64, count=len(self.begin))
        pair = own * np.uint64(0x9E3779B97F4A7C15) + np.where(self.other >= 0, own[self.other], np.uint64(0)) * np.uint64(3) + self.before.astype(np.uint64)
        order = np.lexsort((pair, key))
        self.piece = order.astype(np.int32)  # pieces by group
        key, pair = key[order], pair[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]) if len(key) else np.zeros(0, dtype=bool)
        self.first_piece = np.append(np.flatnonzero(new), len(key)).astype(np.int32)  # of each group
        group_key = key[new]
        new = np.concatenate([[True], group_key[1:] != group_key[:-1]]) if len(group_key) else np.zeros(0, dtype=bool)
        self.keys = group_key[new]
        self.first_group = np.append(np.flatnonzero(new), len(group_key)).astype(np.int32)  # of each key
        one = self.piece[self.first_piece[:-1]]  # a piece that stands for its group
        self.g_size = (self.end - self.begin)[one]
        self.g_last = windows[self.end[one] - WINDOW]
        there = self.other[one] >= 0
        other = np.where(there, self.other[one], 0)
        self.g_there, self.g_before = there, self.before[one]
        self.g_other_size = (self.end - self.begin)[other] if len(self.begin) else np.zeros(0, dtype=np.int32)
        halves = _windows(self.blob, 4)
        near, far = (self.begin[other], self.end[other] - HALF) if len(self.begin) else (np.zeros(0, np.int32),) * 2
        near, far = np.where(self.g_before, far, near), np.where(self.g_before, near, far)
        self.g_near, self.g_far = (halves[near], halves[far]) if len(one) else (np.zeros(0, np.uint32),) * 2
        self.shift = np.uint64(64 - max(16, min(26, (64 * len(self.keys)).bit_length())))
        self.marked = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.marked[self._slot(self.keys)] = True

    def _slot(self, windows: np.ndarray) -> np.ndarray:
        return (windows * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    # -- hits --------------------------------------------------------------------
    def hits(self, buffer: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, groups) at which a pair's piece stands, as far as windows can tell."""
        if not len(self.keys) or len(buffer) < WINDOW:
            return
        windows, halves = _windows(buffer), _windows(buffer, 4)
        for a in range(0, len(buffer) - WINDOW + 1, 1 << 20):
            part = windows[a : min(a + (1 << 20), len(buffer) - WINDOW + 1)].copy()
            near = np.flatnonzero(self.marked[self._slot(part)])
            at = np.searchsorted(self.keys, part[near])
            at[at == len(self.keys)] = 0
            true = self.keys[at] == part[near]
            places, keys = near[true] + a, at[true]
            many = self.first_group[keys + 1] - self.first_group[keys]
            upto = np.cumsum(many)
            i = 0
            while i < len(places):  # lots of about LOT pairs of a place and a group
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + LOT, "right")))
                n = many[i:j]
                place = np.repeat(places[i:j], n)
                group = np.repeat(self.first_group[keys[i:j]], n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
                fits = self._fits(windows, halves, place, group)
                yield place[fits], group[fits]
                i = j

    def _fits(self, windows: np.ndarray, halves: np.ndarray, place: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Whether the piece ends as it should and one half of its neighbour stands where it could.

        With one edit at most in the neighbour, the half beside the piece is unharmed, or the
        far half is, and a character that came, went or changed moves it by up to four bytes.
        """
        top = len(halves) - 1
        size, other = self.g_size[group], self.g_other_size[group]
        end = place + size
        ok = windows[np.minimum(end - WINDOW, len(windows) - 1)] == self.g_last[group]
        before, alone = self.g_before[group], ~self.g_there[group]
        look = lambda x: halves[np.clip(x, 0, top)]
        beside = look(np.where(before, place - HALF, end)) == self.g_near[group]
        far = np.where(before, place - other, end + other - HALF)
        todo = np.flatnonzero(ok & ~alone & ~beside)
        reached = np.zeros(len(todo), dtype=bool)
        for s in range(-4, 5):
            reached |= look(far[todo] + s) == self.g_far[group[todo]]
        beside[todo] = reached
        return ok & (alone | beside)

    # -- matches -----------------------------------------------------------------
    def match(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """For each text the rows of items that occur in it, with their least distance."""
        raws = [normalised(t) for t in texts]
        gap = b"\0" * (WINDOW + 1)
        buffer = gap.join(raws)
        begins = np.cumsum([0, *(len(r) + len(gap) for r in raws)])
        found: dict[tuple[int, int], list[int]] = defaultdict(list)
        for places, groups in self.hits(buffer):
            docs = np.searchsorted(begins, places, "right") - 1
            for place, group, doc in zip(places.tolist(), groups.tolist(), docs.tolist(), strict=True):
                one = self.piece[self.first_piece[group]]
                if buffer.startswith(self.blob[self.begin[one] : self.end[one]], place) and self._beside(buffer, place, one):
                    start = int(begins[doc])
                    for i, offset in self._likely(raws[doc], place - start, group):
                        found[doc, i].append(place - start - offset)
        out: list[list[tuple[int, int]]] = [[] for _ in raws]
        for (doc, i), starts in sorted(found.items()):
            raw, own = raws[doc], self.raw(i)
            budget = int(self.budget[i])
            best = 0 if any(s >= 0 and raw.startswith(own, s) for s in starts) else budget + 1
            if best and budget:
                item = self.item(i)
                for a, b in _stretches(sorted(starts), 4 * budget):
                    around = raw[max(0, a - 4 * budget) : b + len(own) + 4 * budget].decode("utf-8", "ignore")
                    best = min(best, item.distance(around))
            if best <= budget:
                out[doc] += [(row, best) for row in self.rows[self.first_row[i] : self.first_row[i + 1]].tolist()]
        for n, items in self.short.items():
            for doc, raw in enumerate(raws):
                words = raw.split(b" ")
                grams = words if n == 1 else map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False))
                for hit in sorted({items[g] for g in grams if g in items}):
                    out[doc] += [(row, 0) for row in self.rows[self.first_row[hit] : self.first_row[hit + 1]].tolist()]
        return out

    def _beside(self, buffer: bytes, place: int, piece: int) -> bool:
        other = int(self.other[piece])
        if other < 0:
            return True
        text = self.blob[self.begin[other] : self.end[other]].decode("utf-8", "replace")
        return _beside(buffer, place, int(self.end[piece] - self.begin[piece]), text, bool(self.before[piece]))

    def _likely(self, raw: bytes, place: int, group: int) -> list[tuple[int, int]]:
        """(item, offset of its piece) of a group's items that could lie around a place.

        The q-grams of a stretch that holds every item's own are counted for all items at once.
        """
        pieces = self.piece[self.first_piece[group] : self.first_piece[group + 1]]
        if len(pieces) < 8:
            items = self.of_item[pieces]
            return list(zip(items.tolist(), (self.begin[pieces] - self.at[items]).tolist(), strict=True))
        if group not in self.group_grams:
            self._make_room()
            items = self.of_item[pieces]
            offsets = self.begin[pieces] - self.at[items]
            grams = [gram_codes(self.raw(i).decode("utf-8", "replace")) for i in items.tolist()]
            sizes = np.array([len(g) for g in grams])
            entry = (items, offsets, np.concatenate(grams), np.cumsum(sizes) - sizes, sizes - GRAM * self.budget[items], 4 * self.budget[items], np.diff(self.at)[items])
            self.group_grams[group] = entry
            self.kept_cost += sum(x.nbytes for x in entry)
        items, offsets, grams, first, needed, reach, size = self.group_grams[group]
        low, high = place - int((offsets + reach).max()), place + int((size + reach - offsets).max())
        have = np.zeros(1 << 16, dtype=bool)
        have[gram_codes(raw[max(0, low) : high].decode("utf-8", "ignore"))] = True
        enough = np.flatnonzero(np.add.reduceat(have[grams], first, dtype=np.int64) >= needed)
        return list(zip(items[enough].tolist(), offsets[enough].tolist(), strict=True))


def _windows(buffer: bytes, size: int = WINDOW) -> np.ndarray:
    """The integers of all windows of a buffer; windows at the end run into zeros."""
    padded = buffer + b"\0" * size
    return np.ndarray(shape=(len(buffer),), dtype=f"<u{size}", buffer=padded, strides=(1,))


def _beside(buffer: bytes, place: int, size: int, other: str, before: bool) -> bool:
    """Whether the pair's other piece stands beside a hit with at most one edit."""
    if not other:
        return True
    reach = len(other.encode()) + 8
    if before:
        return one_edit(other[::-1], buffer[max(0, place - reach) : place].decode("utf-8", "ignore")[::-1])
    return one_edit(other, buffer[place + size : place + size + reach].decode("utf-8", "ignore"))


def one_edit(pattern: str, text: str) -> bool:
    """Whether the text begins with the pattern but for one edit at most."""
    n, i = len(pattern), 0
    for a, b in zip(pattern, text, strict=False):
        if a != b:
            break
        i += 1
    if i >= n - 1:
        return True
    rest = pattern[i + 1 :]
    return text.startswith(rest, i + 1) or text.startswith(rest, i) or text.startswith(pattern[i:], i + 1)


def _stretches(starts: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """Runs of starts that lie within reach of one another, each of bounded length."""
    a = b = starts[0]
    for s in starts[1:]:
        if s - a > reach:
            yield a, b
            a = s
        b = s
    yield a, b


_MATCHERS: dict[str, Matcher] = {}


def matcher_of(mark: str, texts: pa.Array) -> Matcher:
    """The matcher of a pass, made once in a Python worker and kept between its tasks."""
    if mark not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[mark] = Matcher(texts.to_pylist())
    return _MATCHERS[mark]


def _item_passes(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[str, pa.Table, int]]:
    """(a mark of its own, ids and texts, number of passes) of each pass."""
    import hashlib

    there = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cost = F.octet_length("text").cast("bigint") * BYTE_COST + ITEM_COST
    passes = parts(int(there.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0]), BUILT_BYTES)
    for p in range(passes):
        block = there.where(F.pmod(F.xxhash64("text", "id"), F.lit(passes)) == p).toArrow()  # at most about BUILT_BYTES / BYTE_COST
        digest = hashlib.sha256()
        for chunk in block["text"].chunks:
            for buffer in chunk.buffers():
                digest.update(buffer or b"")
        yield f"{digest.hexdigest()} {block.num_rows}", block, passes


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that occurs in it, with the edit distance; no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    kinds = [docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()]
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, distance int"
    item_kind = arrow_kind(items, item_col)
    out = None
    for mark, block, _ in _item_passes(items, item_col, item_text_col):
        shipped = spark.sparkContext.broadcast((mark, block))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            mark, block = shipped.value
            matcher, ids = matcher_of(mark, block["text"]), block["id"].combine_chunks().cast(item_kind)
            for batch in batches:
                rows = [(i, item, d) for i, of in enumerate(matcher.match(batch.column(1).to_pylist())) for item, d in of]
                table = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), ids.take(pa.array([r[1] for r in rows], pa.int64())), pa.array([r[2] for r in rows], pa.int32())]
                yield pa.RecordBatch.from_arrays(table, names=[id_col, item_col, "distance"])

        part = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs in which no item occurs, with all their columns.

    One pass of items is a scan without a shuffle. More passes look at the texts one pass at
    a time, so that a worker holds one pass's tables only, and give digests of the texts to
    drop, which are joined away.
    """
    spark = docs.sparkSession
    small_batches(spark)
    at, gone = docs.columns.index(text_col), None
    for mark, block, passes in _item_passes(items, item_col, item_text_col):
        shipped = spark.sparkContext.broadcast((mark, block.select(["text"])))

        def clean(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            mark, block = shipped.value
            matcher = matcher_of(mark, block["text"])
            for batch in batches:
                yield batch.filter(pa.array([not of for of in matcher.match(batch.column(at).to_pylist())], pa.bool_()))

        def hit(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            mark, block = shipped.value
            matcher = matcher_of(mark, block["text"])
            for batch in batches:
                yield batch.select([0]).filter(pa.array([bool(of) for of in matcher.match(batch.column(1).to_pylist())], pa.bool_()))

        if passes == 1:
            return docs.mapInArrow(clean, docs.schema)
        part = docs.select(F.sha2(text_col, 256).alias("__digest"), F.col(f"`{text_col}`")).mapInArrow(hit, "__digest string")
        gone = part if gone is None else gone.unionByName(part)
    marked = docs.withColumn("__digest", F.sha2(text_col, 256))
    return by_ids(marked, cut(gone.distinct()), "__digest", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
