"""Token ids of whole texts by the tokenizers library.

A text is cut at white space, line feeds between words included, where no token of these vocabularies spans the cut, and the ids of the
different pieces of a span of texts are looked up in a bounded table that the worker keeps. Pieces not in the table are encoded by
the library, so every id comes from it and equals that of encoding the text at once.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: most pieces that a worker remembers (about 30 bytes each), and the longest remembered piece
REMEMBERED = 700_000
#: marks of pieces met before, a power of two; past half of its room a worker remembers only what it meets in a second span
MET = 1 << 22
LONGEST = 48
#: characters of text cut into pieces at a time
SPAN_CHARS = 8_000_000

#: fixed: the Unicode white space characters
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: fixed: white space other than blank and line feed
_RARE = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: marks that are tokens of their own after a letter, at the end of a piece
_MARKS = ".,!?;:"


#: fixed by the vocabularies: how they write a blank before a word, and the end of a word
_BLANK, _WORD_END = "\u0120", "</w>"
#: words encoded side by side, and pieces in one call
JOINED = 64
CALL = 2048
#: unknown pieces held as Python strings at a time
LEARNED = 16_384


#: what an even text does not have: other white space, white space next to another or at the end; each blank or line feed is a cut of its own
_UNEVEN = f"[{_RARE}]|  | \n|\n |\n\n|[ \n]$"
#: a mark at the end of a piece, after a letter
_MARKED = rf"\pL[{_MARKS}]$"


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The pieces of any texts, each with the white space before it, as they stand; and the places of the texts in them."""
    found = [pa.array(_PIECE.findall(text.as_py()), pa.string()) for text in texts]
    pieces = pa.concat_arrays(found)
    return pieces, np.ones(len(pieces), bool), np.cumsum([0, *map(len, found)])


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Pieces:
    """Remembered pieces and their ids, as Arrow arrays: about 30 bytes a piece, where a dict takes ten times that."""

    def __init__(self):
        self.pieces, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def add(self, pieces: pa.Array, ids: pa.Array) -> None:
        if len(pieces):
            self.pieces, self.ids = pa.concat_arrays([self.pieces, pieces]), pa.concat_arrays([self.ids, ids])


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids; one per worker and vocabulary file."""

    def __init__(self, path: str, remembered: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        #: ids of each mark, and nothing for a piece without one
        self.marks = pa.array([*(_packed(self.tokenizer.encode(m, add_special_tokens=False).ids) for m in _MARKS), b""], pa.large_binary())
        #: tokens that begin a word after a blank, and tokens that end a word; a vocabulary has one kind or the other
        vocabulary = self.tokenizer.get_vocab()
        self.largest = max(vocabulary.values())
        self.begins, self.ends = np.zeros(self.largest + 1, bool), np.zeros(self.largest + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith(_BLANK)]] = True
        self.ends[[i for t, i in vocabulary.items() if t.endswith(_WORD_END)]] = True
        #: whether the vocabulary has no capitals
        self.folds = self.tokenizer.encode("A").ids == self.tokenizer.encode("a").ids
        #: pieces as they stand in a text, and pieces without the blank before them
        self.plain, self.after = Pieces(), Pieces()
        self.remembered = REMEMBERED if remembered is None else remembered
        self.met = bytearray(MET)

    @property
    def known(self) -> tuple[list[str], list[str]]:
        """The remembered pieces: as they stand in a text, and without the blank before them."""
        return self.plain.pieces.to_pylist(), self.after.pieces.to_pylist()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text. Texts are drawn a few at a time, so a batch is never held twice."""
        held: list[str] = []
        chars = 0
        for text in texts:
            if held and chars + len(text) > SPAN_CHARS:
                yield from self._span(held)
                held, chars = [], 0
            held.append(text)
            chars += len(text)
        if held:
            yield from self._span(held)

    def _span(self, texts: list[str]) -> Iterator[bytes]:
        ids, ends = self.encode_array(pa.array(texts, pa.string()))
        data, at = memoryview(ids.tobytes()), (4 * ends).tolist()
        return (bytes(data[a:b]) for a, b in zip([0, *at], at))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where those of each text end. The array is taken as one span."""
        texts = texts.cast(pa.string())
        odd = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
        ids, ends = self._even(texts.filter(pa.array(~odd)))
        if not odd.any():
            return ids, ends
        more, more_ends = self._joined(*_cut(texts.filter(pa.array(odd))))
        both = [np.split(x, at[:-1]) for x, at in ((ids, ends), (more, more_ends)) if len(at)]
        place = np.empty(len(odd), int)
        place[~odd], place[odd] = np.arange(len(ends)), len(ends) + np.arange(len(more_ends))
        every = [x for part in both for x in part]
        found = [every[i] for i in place]
        return np.concatenate(found), np.cumsum([len(x) for x in found])

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in which each blank is a cut of its own; line feeds become pieces of their own."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        pieces, bounds = parts.flatten(), parts.offsets.to_numpy()
        bounds = bounds - (bounds[0] if len(bounds) else 0)
        line_end = pc.equal(pieces, "\n").to_numpy(zero_copy_only=False)
        # nothing stands before the first piece of a line but its line feed
        head = line_end.copy()
        head[1:] |= line_end[:-1]
        head[bounds[:-1]] = True
        return self._joined(pieces, head, bounds)

    def _joined(self, pieces: pa.Array, head: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, those of ``head`` as they stand and the others after a blank; ``bounds`` has the places of the texts in them."""
        if not len(pieces):
            return np.empty(0, "<u4"), np.zeros(len(bounds) - 1, np.int64)
        coded = pieces.dictionary_encode()
        codes = 2 * coded.indices.to_numpy() + head
        used = np.zeros(2 * len(coded.dictionary), bool)
        used[codes] = True
        rows, ids, seen = np.zeros(len(used), np.int32), [], 0
        for table, before, one in ((self.plain, "", 1), (self.after, " ", 0)):
            own = np.flatnonzero(used[one::2])
            rows[2 * own + one] = seen + np.arange(len(own))
            ids.append(self._ids_of(table, coded.dictionary.take(pa.array(own)), before))
            seen += len(own)
            # else the pool keeps what each lookup took, far more than the pieces
            pa.default_memory_pool().release_unused()
        flat = pa.concat_arrays(ids).take(pa.array(rows[codes]))
        offsets = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, 8 * flat.offset)
        data = np.frombuffer(flat.buffers()[2], "<u4", offsets[-1] // 4) if offsets[-1] else np.empty(0, "<u4")
        return data[offsets[0] // 4:], (offsets[bounds[1:]] - offsets[0]) // 4

    def _ids_of(self, table: Pieces, pieces: pa.Array, before: str) -> pa.Array:
        """The ids of each piece. A mark after a word adds its own id, so a word is looked up without it."""
        marked = pc.match_substring_regex(pieces, _MARKED)
        coded = pc.if_else(marked, pc.utf8_slice_codeunits(pieces, 0, -1), pieces).dictionary_encode()
        words = coded.dictionary
        at = pc.index_in(words, value_set=table.pieces)
        unknown = pc.is_null(at)
        found, new = table.ids.take(at), words.filter(unknown)
        if len(new):
            parts = [new.slice(i, LEARNED) for i in range(0, len(new), LEARNED)]
            found = pc.replace_with_mask(found, unknown, pa.concat_arrays([self._learned(table, part, before) for part in parts]))
        found = found.take(coded.indices)
        mark = pc.index_in(pc.if_else(marked, pc.utf8_slice_codeunits(pieces, -1), ""), value_set=pa.array([*_MARKS, ""]))
        return pc.binary_join_element_wise(found, self.marks.take(mark), pa.scalar(b"", pa.large_binary()))

    def _learned(self, table: Pieces, pieces: pa.Array, before: str) -> pa.Array:
        """The ids of pieces not in the table, which remembers some of them."""
        new = pieces.to_pylist()
        ids = pa.array(self._encoded(new, before), pa.large_binary())
        keep = pa.array(self._worth(new), pa.int32())
        table.add(pieces.take(keep), ids.take(keep))
        return ids

    def _worth(self, new: list[str]) -> list[int]:
        """The places of those pieces that a table is to remember."""
        # frequent pieces are met early; most of the others never come again, and a full table stays as it is
        room = self.remembered - len(self.plain.pieces) - len(self.after.pieces)
        keep = []
        for i, p in enumerate(new):
            at = hash(p) & (MET - 1)
            if room > 0 and len(p) <= LONGEST and p != "\n" and (2 * room > self.remembered or self.met[at]):
                room -= 1
                keep.append(i)
            self.met[at] = 1
        return keep

    def _encoded(self, pieces: list[str], before: str) -> list[bytes]:
        """The ids of pieces by the library."""
        # capitals change nothing where the vocabulary has none
        low = {p: p.lower() for p in pieces if self.folds and p.isascii() and p.isalpha()}
        table: dict[str, bytes] = {}
        whole = list(dict.fromkeys(low.get(p, p) for p in pieces))
        if before:
            # words of letters are encoded many to a call, which saves most of its cost
            self._learn_joined(table, [p for p in whole if p.isalpha()], before)
            whole = [p for p in whole if p not in table]
        for i in range(0, len(whole), CALL):
            found = self.tokenizer.encode_batch_fast([before + p for p in whole[i:i + CALL]], add_special_tokens=False)
            table.update((p, _packed(e.ids)) for p, e in zip(whole[i:i + CALL], found, strict=True))
        return [table[low.get(p, p)] for p in pieces]

    def _learn_joined(self, table: dict[str, bytes], words: list[str], before: str) -> None:
        """Encode words side by side and part their ids at the tokens that begin or end a word; where the parts
        are not as many as the words, none of them is learned here."""
        for i in range(0, len(words), JOINED):
            run = words[i:i + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([before + before.join(run)], add_special_tokens=False)[0].ids, "<u4")
            if self.ends.any():
                bounds = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            else:
                bounds = [*(4 * np.flatnonzero(self.begins[ids])).tolist(), 4 * len(ids)]
            if len(bounds) == len(run) + 1 and bounds[0] == 0 and bounds[-1] == 4 * len(ids):
                raw = ids.tobytes()
                table.update((p, raw[a:b]) for p, a, b in zip(run, bounds[:-1], bounds[1:], strict=True))


_WORKER: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, remembered: int | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file, which every executor has at this path."""
    if (path, remembered) not in _WORKER:
        _WORKER[path, remembered] = Encoder(path, remembered)
    return _WORKER[path, remembered]


def forget() -> None:
    """Let go of the worker's encoders, where what follows needs none and others share its memory."""
    _WORKER.clear()
