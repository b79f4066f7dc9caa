"""Vocabularies of sub-word pieces, read from a public model file on the driver."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

SPACE = "▁"  # stands for a space inside pieces


@dataclass(frozen=True)
class Pieces:
    """What encoders need of a model file; about 1 MB, bounded by the vocabulary."""

    names: list[str]
    scores: list[float]
    normal: list[int]
    bytes_at: list[int]
    end_id: int
    digest: str

    @property
    def ids(self) -> dict[str, int]:
        return {self.names[i]: i for i in self.normal}


def read_pieces(model_path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = model.get_piece_size()
    skip = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
    return Pieces(
        names=[model.id_to_piece(i) for i in range(n)],
        scores=[model.get_score(i) for i in range(n)],
        normal=[i for i in range(n) if not skip(i)],
        bytes_at=[model.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
        end_id=model.eos_id(),
        digest=hashlib.sha256(model.serialized_model_proto()).hexdigest(),
    )


_BUILT: dict[tuple[str, str], object] = {}


def built(kind: Callable, pieces: Pieces):
    """kind(pieces), made once in a Python worker, which keeps its word cache between tasks."""
    key = (kind.__name__, pieces.digest)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = kind(pieces)
    return _BUILT[key]


class Segmenter:
    """Cuts a text where no piece can reach across, so that segments encode alone.

    A cut stands before each run of space marks and around line feeds, which holds
    as long as no piece has a space mark after another character or a line feed
    beside one; otherwise the whole text is one segment. Segments of more than LONG
    characters are cut again between any two characters that no piece holds side by side,
    so that scripts without spaces come in short segments too.
    """

    #: Characters up to which a segment isn't looked at again; any value gives the same ids.
    LONG = 24

    def __init__(self, pieces: Pieces):
        names = [pieces.names[i] for i in pieces.normal]
        at_spaces = not any(SPACE in x.lstrip(SPACE) for x in names)
        at_lines = not any("\n" in x and len(x) > 1 for x in names)
        self.pattern = None
        if at_spaces:
            stop = f"{SPACE}\n" if at_lines else SPACE
            self.pattern = re.compile(("\n|" if at_lines else "") + f"{SPACE}*[^{stop}]+|{SPACE}+")
        beside = sorted({(ord(x[i]) << 21) | ord(x[i + 1]) for x in names for i in range(len(x) - 1)})
        self.beside = np.array(beside, dtype=np.int64)

    def cut(self, text: str) -> list[str]:
        return list(self.segments(text))

    def segments(self, text: str) -> Iterator[str]:
        """The segments in order; only one of them is held at a time."""
        if not text:
            return
        marked = SPACE + text.replace(" ", SPACE)
        if self.pattern is None:
            yield from self._apart(marked)
            return
        for found in self.pattern.findall(marked) if len(marked) < WHOLE else (m[0] for m in self.pattern.finditer(marked)):
            if len(found) > self.LONG:
                yield from self._apart(found)
            else:
                yield found

    def _apart(self, word: str) -> Iterator[str]:
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        codes = (points[:-1] << 21) | points[1:]
        at = np.searchsorted(self.beside, codes)
        at[at == len(self.beside)] = 0
        joined = self.beside[at] == codes if len(self.beside) else np.zeros(len(codes), dtype=bool)
        start = 0
        for stop in (np.flatnonzero(~joined) + 1).tolist():
            yield word[start:stop]
            start = stop
        yield word[start:]


#: Characters from which on a text's segments are found one by one.
WHOLE = 1 << 20


class WordCache(dict):
    """Results by word; emptied once they take more than about ``room`` bytes.

    A word costs about as many bytes as its result and itself, an entry ENTRY more.
    """

    ENTRY = 300

    def __init__(self, room: int):
        super().__init__()
        self.room, self.held = room, 0

    def keep(self, word: str, result) -> None:
        self[word] = result
        self.held += self.ENTRY + 12 * len(word)

    def trim(self) -> None:
        if self.held > self.room:
            self.clear()
            self.held = 0
