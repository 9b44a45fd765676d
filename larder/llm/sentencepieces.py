"""Encoding and decoding with a SentencePiece model of merges, by a prefix table.

The library merges neighbouring symbols, best score first, until no neighbours make a piece. A sequence of pieces is what
it returns for their text exactly if it is for each two neighbours: a merge across a border would also happen with the two alone. So every
prefix of a text has one last piece: the one that ends there and that is compatible with the last piece of the prefix before it. An automaton gives the
pieces that end at each place, a table keeps the one that is compatible, and the ids are read off from the end.

Nothing merges across a space that follows something else, nor with a character that no longer piece holds, so texts are parted
there and each distinct part is solved once a worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches
from .packing import _Lists

SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "


class Pieces:
    """A model's pieces with what encoding and decoding need. Only the vocabulary is read from the library; it must be one of merges with byte pieces, a leading space and no other normalisation."""

    #: Parts and pairs are kept up to so many, then anew: what is kept only saves work. Longer parts than LONG aren't kept.
    PARTS, PAIRS, LONG = 1_000_000, 2_000_000, 48

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        names = model.id_to_piece(list(ids))
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.is_byte = np.array([model.is_byte(i) for i in ids])
        normal = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids]
        self.ids = {names[i]: i for i in ids if normal[i]}
        self.names, self.score = names, {n: model.get_score(i) for n, i in self.ids.items()}
        self.size = [len(n) for n in names]
        self.of_byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self._check_chars()

        plain = [n.replace(SPACE, " ").encode() if normal[i] else bytes([int(n[3:5], 16)]) if self.is_byte[i] else UNKNOWN_TEXT.encode() if model.is_unknown(i) else b"" for i, n in enumerate(names)]
        self.plain = _Lists(np.uint8)
        self.plain.add(np.frombuffer(b"".join(plain), np.uint8), np.array([len(x) for x in plain]))
        self.opens = np.array([normal[i] and names[i].startswith(SPACE) for i in ids])

        self.part = self._parting()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for name, i in self.ids.items():
            if self.merged(name) == [name]:
                self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.clear()
        for text in ("  A b\n\té　ﬁ① 12", SPACE, "ÅÅ \x00\U0001f600"):
            if self.encode([text])[0].tolist() != model.encode(text):
                raise ValueError(f"{path} isn't a model of merges with byte pieces, a leading space and no other normalisation")

    def _check_chars(self) -> None:
        if min(self.of_byte) < 0 or not all(self.is_byte[self.of_byte]) or any(c not in self.ids for n in self.ids for c in n):
            raise ValueError("the model lacks a piece for each byte or for a character of its pieces")

    def _parting(self) -> re.Pattern:
        """Parts of a text that no piece crosses: spaces with a word or with signs, and single characters that nothing merges with.

        Signs are all characters that pieces join to a full stop, directly or over others; no piece holds one of them beside any other character.
        """
        if any(SPACE in n.lstrip(SPACE) for n in self.ids):
            return re.compile(".+", re.S)
        beside: dict[str, set[str]] = {}
        for n in self.ids:
            for a, b in zip(n, n[1:], strict=False):
                if SPACE not in (a, b):
                    beside.setdefault(a, set()).add(b)
                    beside.setdefault(b, set()).add(a)
        signs, more = {"."}, {"."}
        while more := set().union(*(beside.get(c, ()) for c in more)) - signs:
            signs |= more
        lone = {c for c in map(chr, range(128)) if c not in beside} - signs - {" "}
        sign, alone = (re.escape("".join(sorted(x))) for x in (signs, lone))
        return re.compile(f"{SPACE}*(?:[^{SPACE}{sign}{alone}]+|[{sign}]+)|{SPACE}+|[{alone}]", re.S)

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.lists = _Lists()

    def merged(self, text: str) -> list[str]:
        """What merging gives, by definition: best score first, leftmost of equals. For short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the texts of two pieces, joined, are merged to the same two pieces."""
        if len(self.pairs) >= self.PAIRS:
            self.pairs.clear()
        fine = self.pairs[a << 32 | b] = self.merged(self.names[a] + self.names[b]) == [self.names[a], self.names[b]]
        return fine

    def solve(self, part: str) -> list[int]:
        """The ids of a part, by its table of last pieces; -1 stands for the start and for characters of no piece, beside which all pieces can stand."""
        last, pairs, size = [-1] * (len(part) + 1), self.pairs, self.size
        for end, i in self.automaton.iter(part):
            end += 1
            if last[end] < 0:
                before = last[end - size[i]]
                if before >= 0:
                    fine = pairs.get(before << 32 | i)
                    if not (self.compatible(before, i) if fine is None else fine):
                        continue
                last[end] = i
        ids, at = [], len(part)
        while at:
            i = last[at]
            if i < 0:
                at -= 1
                ids += [self.of_byte[b] for b in reversed(part[at].encode())]
            else:
                at -= size[i]
                ids.append(i)
        ids.reverse()
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text, without begin and end."""
        if len(self.known) > self.PARTS:
            self.clear()
        parts = [self.part.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = set().union(*parts).difference(self.known)
        once = {p for p in fresh if len(p) > self.LONG}
        fresh -= once
        solved = [self.solve(p) for p in fresh]
        self.lists.add(np.fromiter(chain.from_iterable(solved), np.uint32), np.fromiter(map(len, solved), np.int64, len(solved)))
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        if not once:
            return [self._joined(p) for p in parts]
        out = []
        for p in parts:
            pieces, at = [], 0
            for k, x in enumerate(p):
                if x in once:
                    pieces += [self._joined(p[at:k]), np.array(self.solve(x), np.uint32)]
                    at = k + 1
            out.append(np.concatenate([*pieces, self._joined(p[at:])]))
        return out

    def _joined(self, parts: list[str]) -> np.ndarray:
        return self.lists.join(np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts)))[0]

    def framed(self, texts: list[str]) -> list[np.ndarray]:
        """Ids with those of begin and end."""
        ends = np.array([self.begin, self.end], np.uint32)
        return [np.concatenate([ends[:1], ids, ends[1:]]) for ids in self.encode(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text of ids. One space before the first piece goes; bytes that make no character become U+FFFD each; ids of begin and end are empty."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.names)):
            raise ValueError("an id is outside the vocabulary")
        flat, ends = self.plain.join(ids)
        shown = np.nonzero(np.diff(ends, prepend=0))[0]
        text, byte = flat.tobytes(), self.is_byte[ids]
        if byte.any():
            apart = len(shown) and len(shown) <= shown[-1] - shown[0]  # an empty piece between others parts a run of bytes
            try:
                text.decode()
            except UnicodeDecodeError:
                apart = True
            if apart:
                bounds = [0, *np.nonzero(np.diff(byte))[0] + 1, len(ids)]
                text = b"".join(_mended(x) if byte[a] else x for a, b in zip(bounds, bounds[1:], strict=False) for x in [self.plain.join(ids[a:b])[0].tobytes()])
        return text[1:] if len(shown) and self.opens[ids[shown[0]]] else text


def _mended(run: bytes) -> bytes:
    """A run of byte pieces with U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                run[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            break
        else:
            size = 0
        out.append(run[at : at + size] or "�".encode())
        at += max(size, 1)
    return b"".join(out)


def pieces_of(path: str) -> Pieces:
    held = caches.of("sentencepieces")
    if path not in held:
        held[path] = Pieces(path)
    return held[path]


def _mapped(df: DataFrame, model: str, id_col: str, value_col: str, kind: str, work, schema: str) -> DataFrame:
    """(id, ...): ``work`` of lists of values, 256 rows at a time."""
    id_kind = df.schema[id_col].dataType.simpleString()

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces_of(model)
        for whole in found:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([batch.column(0), *work(coder, batch.column(1).to_pylist())], ["id", *(x.split()[0] for x in schema.split(","))])

    rows = df.select(F.col(id_col).alias("id"), F.col(value_col).cast(kind).alias("value"))
    return rows.mapInArrow(batches, f"id {id_kind}, {schema}").withColumnRenamed("id", id_col)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each text's ids as little-endian unsigned 32-bit integers, those of begin and end included.

    ``model``: path of a SentencePiece model that every executor has. One row for each row, equal rows included; a null or empty text has only
    the ids of begin and end. Texts are whole, whatever their length. An empty table gives no rows.
    """

    def work(coder: Pieces, texts: list) -> list[pa.Array]:
        return [pa.array([ids.astype("<u4").tobytes() for ids in coder.framed([t or "" for t in texts])], pa.binary())]

    return _mapped(df, model, id_col, text_col, "string", work, "ids binary")


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of ids as ``encode`` returns them; null ids are none and have an empty text, ids outside the vocabulary are an error."""

    def work(coder: Pieces, ids: list) -> list[pa.Array]:
        return [pa.array([coder.decode(np.frombuffer(x or b"", "<u4")) for x in ids], pa.binary()).cast(pa.string())]

    return _mapped(df, model, id_col, ids_col, "binary", work, "text string")


def round_trip(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): ``encode`` and ``decode`` of it in one pass."""

    def work(coder: Pieces, texts: list) -> list[pa.Array]:
        found = coder.framed([t or "" for t in texts])
        return [pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()), pa.array([coder.decode(x) for x in found], pa.binary()).cast(pa.string())]

    return _mapped(df, model, id_col, text_col, "string", work, "ids binary, decoded string")
