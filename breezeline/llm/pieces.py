"""Exact SentencePiece merge encoding by backtracking over longest matches, and decoding.

A text's pieces are found from left to right: take the longest piece at a position, accept it if it is compatible
with the piece before (merging the two pieces' characters gives just these two back), else a shorter one, else step
back; positions from which no encoding goes on are struck out in a bit field, so no position is tried twice."""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breezeline.llm.common import sent_by_value, ship

ship(__name__)

SPACE = "▁"  # fixed value: how the model writes a space
UNKNOWN_TEXT = " ⁇ "  # fixed value: how the library decodes the unknown piece
_MOST_CACHED = 300_000


def _one_mark_per_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


class Pieces:
    """The vocabulary of a merge model; travels as plain lists, its search structures are built where they are used."""

    def __init__(self, model: bytes):
        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(m.get_piece_size())
        self.names = [m.id_to_piece(i) for i in ids]
        self.scores = [m.get_score(i) for i in ids]
        self.begin, self.end, self.unknown = m.bos_id(), m.eos_id(), m.unk_id()
        self.bytes = {int(self.names[i][3:5], 16): i for i in ids if m.is_byte(i)}
        self.silent = {i for i in ids if m.is_control(i)}
        if any(m.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces are not supported")
        self.plain = [i for i in ids if not (i in self.silent or m.is_byte(i) or i == self.unknown)]
        probe = m.encode("  a ﬁ")
        if m.decode(probe) != "  a ﬁ" or m.encode("") or self.names[m.encode("a")[0]][:1] != SPACE:
            raise ValueError("only models that keep texts as they are and add a space in front are supported")
        mixed = [n for n in (self.names[i] for i in self.plain) if SPACE in n[1:] and n.strip(SPACE)]
        ranks = [self.scores[i] for i in self.plain if self.names[i].strip(SPACE)]
        if mixed or len(set(ranks)) < len(ranks):
            raise ValueError("pieces must hold a space only in front, or spaces only, and have scores of their own")
        lowest = min(ranks)
        if any(self.scores[i] >= lowest for i in self.plain if not self.names[i].strip(SPACE)):
            raise ValueError("pieces of spaces must merge last")

    def encoder(self) -> Encoder:
        if not hasattr(self, "_encoder"):
            self._encoder = Encoder(self)
        return self._encoder

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_encoder"}


class _Words(dict):
    """Ids of words, as little-endian bytes; emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _MOST_CACHED:
            self.clear()
        # long strings are not worth keeping
        out = self.make(word)
        if len(word) <= 64:
            self[word] = out
        return out


class Encoder:
    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.id_of = {pieces.names[i]: i for i in pieces.plain}
        self.rank_of = {name: -pieces.scores[i] for name, i in self.id_of.items()}
        self.never = float("inf")
        self.chars = {c for name in self.id_of for c in name}
        self.automaton = ahocorasick.Automaton()
        for name in self.id_of:
            self.automaton.add_word(name, len(name))
        self.automaton.make_automaton()
        self.shorter: dict[str, str] = {}
        self.sound: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.words = _Words(self._word)
        self.bare = _Words(self._stretch)
        self.codes = _Words(self._code)
        self.blanks = _Words(lambda text: self._ids(self.merge(text)))
        # a line feed that no piece holds parts a word
        self.line_end = None if "\n" in self.chars else self._code("\n")
        self.start = np.array([pieces.begin], "<u4").tobytes()
        self.stop = np.array([pieces.end], "<u4").tobytes()
        shown = []
        octet = {i: b for b, i in pieces.bytes.items()}
        for i, name in enumerate(pieces.names):
            if i in pieces.silent:
                shown.append("")
            elif i == pieces.unknown:
                shown.append(UNKNOWN_TEXT)
            elif i in octet:
                shown.append(chr(octet[i]) if octet[i] < 128 else chr(0xDC00 + octet[i]))
            else:
                shown.append(name.replace(SPACE, " "))
        self.shown = shown
        codecs.register_error("one-mark-per-byte", _one_mark_per_byte)

    # merging by score, the definition of the encoding

    def merge(self, text: str) -> list[str]:
        """Merge neighbours of the best score, leftmost first, until no neighbours form a piece."""
        if len(text) <= 48:
            return self._merge_short(text)
        part = list(text)
        n = len(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list = []

        def offer(i: int, j: int) -> None:
            whole = self.id_of.get(part[i] + part[j])
            if whole is not None:
                heapq.heappush(queue, (-self.p.scores[whole], i, j, len(part[i]), len(part[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, a, b = heapq.heappop(queue)
            if len(part[i]) != a or len(part[j]) != b or after[i] != j:
                continue
            part[i] += part[j]
            part[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in part if x]

    def _merge_short(self, text: str) -> list[str]:
        """The same without a queue."""
        part, rank = list(text), self.rank_of
        never = self.never
        best = [rank.get(a + b, never) for a, b in zip(part, part[1:])]
        while best:
            low = min(best)
            if low == never:
                break
            i = best.index(low)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del best[i]
            if i < len(best):
                best[i] = rank.get(part[i] + part[i + 1], never)
            if i:
                best[i - 1] = rank.get(part[i - 1] + part[i], never)
        return part

    # backtracking

    def _is_sound(self, piece: str) -> bool:
        """Whether merging a piece's characters gives the piece."""
        if len(self.sound) >= _MOST_CACHED:
            self.sound.clear()
        known = self.sound[piece] = len(piece) == 1 or self.merge(piece) == [piece]
        return known

    def _compatible(self, pair: tuple[str, str]) -> bool:
        """Whether merging two pieces' characters gives the two pieces."""
        if len(self.fits) >= _MOST_CACHED:
            self.fits.clear()
        known = self.fits[pair] = self.merge(pair[0] + pair[1]) == list(pair)
        return known

    def _shorter(self, piece: str) -> str:
        """The longest piece that is a proper prefix; at last a single character, then nothing."""
        short = piece[:-1]
        while len(short) > 1 and short not in self.id_of:
            short = short[:-1]
        self.shorter[piece] = short
        return short

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters occur in pieces."""
        n = len(text)
        matches = self.automaton.iter_long
        sound, fits, shorter = self.sound, self.fits, self.shorter
        open_ = (1 << (n + 1)) - 1
        taken: list[str] = []
        pos, left, piece = 0, "", None
        while pos < n:
            if piece is None:
                # the first longest match from here on begins here, or this character is no piece of its own
                end, size = next(matches(text, pos), (-1, 0))
                piece = text[pos : pos + size] if end - size + 1 == pos else text[pos]
            while piece:
                good = sound.get(piece)
                if (self._is_sound(piece) if good is None else good) and open_ >> (pos + len(piece)) & 1:
                    good = fits.get((left, piece)) if left else True
                    if self._compatible((left, piece)) if good is None else good:
                        break
                piece = shorter[piece] if piece in shorter else self._shorter(piece)
            if piece:
                taken.append(piece)
                pos, left, piece = pos + len(piece), piece, None
            else:
                # nothing fits here: strike the position out and shorten the piece before it
                open_ &= ~(1 << pos)
                last = taken.pop()
                pos -= len(last)
                left = taken[-1] if taken else ""
                piece = shorter[last] if last in shorter else self._shorter(last)
        return taken

    def _ids(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.codes.__getitem__, pieces))

    def _code(self, piece: str) -> bytes:
        """Ids of a piece; of anything else its bytes' pieces, or the unknown piece."""
        i = self.id_of.get(piece)
        if i is not None:
            ids = [i]
        elif self.p.bytes:
            ids = [self.p.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        else:
            ids = [self.p.unknown]
        return np.array(ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one space and what follows it up to the next."""
        if self.line_end and "\n" in word:
            first, *rest = word.split("\n")
            return self.line_end.join([self.words[first] if first else self.codes[SPACE], *map(self.bare.__getitem__, rest)])
        return self._stretch(SPACE + word)

    def _stretch(self, text: str) -> bytes:
        """Ids of a text without inner spaces; characters that no piece holds stand alone."""
        if len(text) < 256 and self.chars.issuperset(text):
            return self._ids(self.backtrack(text))
        out, run = [], []
        for c in text:
            if c in self.chars:
                run.append(c)
                continue
            out += self._run(run)
            out.append(c)
            run = []
        return self._ids(out + self._run(run))

    def _run(self, run: list[str]) -> list[str]:
        """Backtracking in stretches, so that the bit field stays short: a stretch ends where no two characters merge."""
        out: list[str] = []
        at = 0
        for i in range(1, len(run) + 1):
            if i == len(run) or (i - at >= 256 and not self._may_join(run, i)):
                out += self.backtrack("".join(run[at:i]))
                at = i
        return out

    def _may_join(self, run: list[str], i: int) -> bool:
        """Whether some piece holds these two characters side by side."""
        if not hasattr(self, "pairs"):
            self.pairs = {name[k : k + 2] for name in self.id_of for k in range(len(name) - 1)}
        return run[i - 1] + run[i] in self.pairs

    def encode(self, text: str) -> bytes:
        """All ids, with begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return self.start + self.stop
        words = text.replace(SPACE, " ").split(" ")
        words_get = self.words.__getitem__
        if "" not in words:
            return self.start + b"".join(map(words_get, words)) + self.stop
        out, blanks = [self.start], 0
        alone = self.codes[SPACE]
        for word in words:
            if not word:
                blanks += 1
                continue
            ids = words_get(word)
            if blanks:
                # a space that joined no character of the word goes with the spaces before it
                if ids[:4] == alone:
                    blanks, ids = blanks + 1, ids[4:]
                out.append(self.blanks[SPACE * blanks])
                blanks = 0
            out.append(ids)
        if blanks:
            out.append(self.blanks[SPACE * blanks])
        return b"".join(out) + self.stop

    def decode(self, ids: bytes) -> str:
        """The text of ids as the library's decode gives it: control pieces are silent, byte pieces are put together,
        wrong bytes become U+FFFD one by one, and the space in front that encoding added goes."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        text = "".join(map(self.shown.__getitem__, numbers))
        if not text.isascii():
            try:
                text.encode()
            except UnicodeEncodeError:
                text = self._with_bytes(numbers)
        first = next((i for i in numbers if i not in self.p.silent), None)
        return text[1:] if first is not None and self.p.names[first][:1] == SPACE else text

    def _with_bytes(self, numbers: list[int]) -> str:
        """Byte pieces are put together between control pieces."""
        out, run = [], []
        for i in [*numbers, None]:
            if i is None or i in self.p.silent:
                part = "".join(run).encode("utf-8", "surrogateescape")
                out.append(part.decode("utf-8", "one-mark-per-byte"))
                run = []
            else:
                run.append(self.shown[i])
        return "".join(out)


def encode(docs: DataFrame, model: bytes, *keep: Column, text_col: str = "text", least_cut: int = 8 << 20) -> DataFrame:
    """The ``keep`` columns of every row with ``ids`` (binary: little-endian unsigned 32-bit, begin and end included).

    ``model`` is the content of a merge model file; its vocabulary (of fixed size) is broadcast. Whole texts are
    encoded; null and empty texts give the begin and end ids only. Words are remembered in bounded tables. Results
    leave a task in pieces of about ``least_cut`` bytes."""
    narrow = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    return _mapped(narrow, model, {"ids": "binary"}, lambda work, t: (work.encode(t or ""),), least_cut)


def decode(rows: DataFrame, model: bytes, *keep: Column, ids_col: str = "ids", least_cut: int = 8 << 20) -> DataFrame:
    """The ``keep`` columns of every row with ``decoded``, the text of its ids; null ids give an empty text."""
    narrow = rows.select(*keep, F.col(ids_col).alias("_ids"))
    return _mapped(narrow, model, {"decoded": "string"}, lambda work, ids: (work.decode(ids or b""),), least_cut)


def encode_and_decode(
    docs: DataFrame, model: bytes, *keep: Column, text_col: str = "text", least_cut: int = 8 << 20
) -> DataFrame:
    """The ``keep`` columns of every row with ``ids`` as from ``encode`` and ``decoded``, the text that ``decode``
    gives for these ids. Both are made in one pass, so a task holds one Python worker and one vocabulary, not two."""

    def both(work: Encoder, text: str | None) -> tuple[bytes, str]:
        ids = work.encode(text or "")
        return ids, work.decode(ids)

    narrow = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    return _mapped(narrow, model, {"ids": "binary", "decoded": "string"}, both, least_cut)


def _mapped(narrow: DataFrame, model: bytes, made: dict[str, str], make, least_cut: int) -> DataFrame:
    """Replace the last column by the columns that ``make`` gives for its values."""
    shared = sent_by_value(narrow.sparkSession, Pieces(model))
    kinds = {"binary": pa.binary(), "string": pa.string()}
    columns = {name: kinds[kind] for name, kind in made.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = shared().encoder()
        for batch in batches:
            yield from _cut(batch, columns, lambda cell: make(work, cell), least_cut)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]]
    return narrow.mapInArrow(run, ", ".join([*kept, *(f"{name} {kind}" for name, kind in made.items())]))


def _cut(batch: pa.RecordBatch, columns: dict[str, pa.DataType], make, least: int) -> Iterator[pa.RecordBatch]:
    """Replace the last column by what ``make`` gives for it, in batches of a bounded size."""
    names = [*batch.schema.names[:-1], *columns]
    values, first, size = [], 0, 0
    for i, cell in enumerate(batch.column(batch.num_columns - 1)):
        values.append(make(cell.as_py()))
        size += sum(map(len, values[-1]))
        if size >= least or i == batch.num_rows - 1:
            kept = [c.slice(first, len(values)) for c in batch.columns[:-1]]
            new = [pa.array(v, kind) for v, kind in zip(zip(*values), columns.values())]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=names)
            values, first, size = [], i + 1, 0


def read_model(spark: SparkSession, path: str) -> bytes:
    """A model file by any path that Spark reads; a plain local path is read by the driver."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
