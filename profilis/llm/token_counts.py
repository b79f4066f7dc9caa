"""Token counts of whole texts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton gives all pieces that end at a position; dynamic programming
carries the best score and the number of pieces up to it. Ties are those of the public
unigram tokenizers: a later start replaces an earlier one only with a strictly greater
score, so among equals the longest last piece stays. A character that no one-character
piece covers counts as its UTF-8 bytes (byte fallback) at the least score less ten.
Scores are summed in double precision; with integer scores sums are exact, so segments
that no piece crosses are scored alone and kept by word.

Defined results: null and empty texts have 0 tokens and score 0; repeated rows count
alike, once each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from profilis.llm.common import small_batches
from profilis.llm.pieces import Pieces, Segmenter, WordCache, built, read_pieces

UNKNOWN_PENALTY = 10.0
#: Bytes that a worker's kept words may take, about.
CACHE_BYTES = 128 << 20
#: Characters from which on a segment isn't kept.
RARE = 64
NEVER = float("-inf")


class UnigramCounter:
    def __init__(self, pieces: Pieces):
        import ahocorasick

        self.segmenter = Segmenter(pieces)
        self.automaton = ahocorasick.Automaton()
        for i in pieces.normal:
            self.automaton.add_word(pieces.names[i], (len(pieces.names[i]), pieces.scores[i]))
        self.automaton.make_automaton()
        self.unknown = min(pieces.scores[i] for i in pieces.normal) - UNKNOWN_PENALTY
        self.words = WordCache(CACHE_BYTES)

    def count(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best cut of one segment."""
        n = len(word)
        best = [0.0] * (n + 1)
        pieces = [0] * (n + 1)
        upto = 0  # best and pieces hold up to here
        one = True  # whether a one-character piece ends at upto
        for at, (size, score) in self.automaton.iter(word):
            e = at + 1
            if e != upto:
                if not one:
                    self._bytes(word, best, pieces, upto)
                while upto + 1 < e:  # no piece ends at these
                    upto += 1
                    best[upto], pieces[upto] = NEVER, 0
                    self._bytes(word, best, pieces, upto)
                upto, one = e, False
                best[e] = NEVER
            x = best[e - size] + score
            if x > best[e]:  # longest first, so that an equal shorter one doesn't replace it
                best[e], pieces[e] = x, pieces[e - size] + 1
            if size == 1:
                one = True
        if not one:
            self._bytes(word, best, pieces, upto)
        while upto < n:
            upto += 1
            best[upto], pieces[upto] = NEVER, 0
            self._bytes(word, best, pieces, upto)
        return pieces[n], best[n]

    def _bytes(self, word: str, best: list[float], pieces: list[int], e: int) -> None:
        if (x := best[e - 1] + self.unknown) > best[e]:
            best[e], pieces[e] = x, pieces[e - 1] + len(word[e - 1].encode())

    def text(self, text: str | None) -> tuple[int, float]:
        known = self.words
        n, score = 0, 0.0
        for word in self.segmenter.segments(text or ""):
            found = known.get(word)
            if found is None:
                found = self.count(word)
                if len(word) < RARE:
                    known.trim()
                    known.keep(word, found)
            n += found[0]
            score += found[1]
        return n, score


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_tokens and the score of its best cut. No shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(read_pieces(model_path))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = built(UnigramCounter, shipped.value)
        for batch in batches:
            found = [counter.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64())],
                names=[id_col, "n_tokens", "score"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, n_tokens bigint, score double")
