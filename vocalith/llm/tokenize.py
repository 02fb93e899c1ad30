"""Exact token ids by a public tokenizer file, at the cost of its distinct units.

Both vocabularies split a text at white space before they merge bytes, so the ids of a text are the ids of its units
one after another: a word with the white space before it.  Units repeat: a slice of texts is cut into units, each
distinct unit is encoded once, and the ids are put together again, all on arrays.

Plain units (Latin-1 characters behind at most one ASCII white space) are joined with a separator and merged by tiktoken
in one call, with the vocabulary's own ranks and pattern.  Any other unit goes through the tokenizers library, and so
does the whole of a text with special tokens, control characters or white space beyond ASCII.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

import numpy as np

#: Bytes of texts whose units are encoded together.
SLICE_BYTES = 6 << 20
SEPARATOR = "\x01"
#: Bytes that can start what needs the library: control characters, U+0085 and U+00A0, wider white space, special tokens.
ODD = r"[\x00-\x08\x0e-\x1f\x7f]|\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8d\xa8-\xaf]|\xe2\x81[\x9f-\xaf]|\xe3\x80\x80|\xef\xbb\xbf|<\|"
#: Units for the library: first bytes of characters beyond Latin-1; more than one white space in front, or nothing behind.
RARE = r"[\xc4-\xff]|^[\t-\r ]{2}|^[\t-\r ]*$"
#: The vocabularies' patterns for pieces, fixed values; no piece has white space but in front.
BYTE_PIECES = r"\x01|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+"
#: As plain units have them: letters and numbers of Latin-1.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: A piece with the sign of its end; a unit's end.
ENDED_PIECES = r"[^\x01\n]+\x01|\n"


@dataclass(frozen=True)
class Vocabulary:
    file: str
    #: Whether the vocabulary drops white space and case, and marks the ends of pieces.
    bare: bool


BYTE_BPE = Vocabulary("byte_bpe_50k.json", False)
WORD_BPE = Vocabulary("word_bpe_49k.json", True)

_open: dict[Vocabulary, UnitTokenizer] = {}


def tokenizer(vocabulary: Vocabulary) -> UnitTokenizer:
    """One for each vocabulary and worker process."""
    if vocabulary not in _open:
        _open[vocabulary] = UnitTokenizer(vocabulary)
    return _open[vocabulary]


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the others for those from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b if b in own else next(rest)): b for b in range(256)}


def ranks_of(path: str, bare: bool) -> dict[bytes, int]:
    """Tokens as bytes, with their ids; the sign of a piece's end is the separator."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    letters = byte_letters()
    special = {x["content"] for x in vocabulary.get("added_tokens", ())}
    found = {}
    for token, i in vocabulary["model"]["vocab"].items():
        if token in special:
            continue
        ended = bare and token.endswith("</w>")
        word = token.removesuffix("</w>") if ended else token
        found[bytes(letters[c] for c in word) + (SEPARATOR.encode() if ended else b"")] = i
    return found


SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes in lower case.
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


class UnitTokenizer:
    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = vocabulary.file if os.path.isabs(vocabulary.file) else public_tokenizers.path(vocabulary.file)
        self.library = Tokenizer.from_file(path)
        self.bare = vocabulary.bare
        ranks = ranks_of(path, self.bare)
        pattern = ENDED_PIECES if self.bare else BYTE_PIECES
        self.merger = tiktoken.Encoding(vocabulary.file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
        self.between = ranks[b"\n" if self.bare else SEPARATOR.encode()]

    def ids(self, text: bytes) -> np.ndarray:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[bytes]) -> list[np.ndarray]:
        """uint16 ids of each text, without special tokens."""
        out, at = [], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= SLICE_BYTES):
                size += len(texts[stop])
                stop += 1
            out += self._slice(texts[at:stop])
            at = stop
        return out

    def _slice(self, texts: list[bytes]) -> list[np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(pa.array(texts, pa.binary()), ODD).to_numpy(zero_copy_only=False)
        plain = [b"" if o else t for t, o in zip(texts, odd.tolist(), strict=True)]
        n = np.fromiter(map(len, plain), np.int64, len(plain))
        starts = np.cumsum(n) - n
        data = np.frombuffer(b"".join(plain), np.uint8)
        if not len(data):
            found = [np.zeros(0, np.uint16)] * len(texts)
        else:
            space = SPACES[data]
            turn = np.append(True, space[1:] != space[:-1])
            turn[starts[n > 0]] = True
            if self.bare:  # the words alone, in lower case
                edges, data = np.flatnonzero(turn & ~space), SMALL[data[~space]]
                offsets = np.append((np.cumsum(~space) - 1)[edges], len(data)).astype(np.int32)
            else:
                first = turn & space
                first[starts[n > 0]] = True
                edges = np.flatnonzero(first)
                offsets = np.append(edges, len(data)).astype(np.int32)
            units = pa.BinaryArray.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
            taken = self._encoded(units.dictionary).take(units.indices)
            ends = np.frombuffer(taken.buffers()[1], np.int32, len(edges) + 1, taken.offset * 4) // 2
            ids = np.frombuffer(taken.buffers()[2], np.uint16) if ends[-1] else np.zeros(0, np.uint16)
            cuts = ends[np.searchsorted(edges, np.append(starts, len(space)))].tolist()
            found = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero(odd).tolist():
            found[i] = self._whole([texts[i]])[0]
        return found

    def _encoded(self, units):
        """A binary array of the units' ids."""
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.invert(pc.match_substring_regex(units, RARE))
        mask = plain.to_numpy(zero_copy_only=False)
        easy = units.filter(plain)
        ids, n = self._merged(easy) if len(easy) else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
        ends = np.append(0, np.cumsum(n)).astype(np.int32) * 2
        quick = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids))])
        if mask.all():
            return quick
        slow = self._whole(units.filter(pc.invert(plain)).to_pylist())
        both = pa.concat_arrays([quick, pa.array([x.tobytes() for x in slow], pa.binary())])
        place = np.empty(len(mask), np.int64)
        place[mask], place[~mask] = np.arange(len(n)), len(n) + np.arange(len(slow))
        return both.take(pa.array(place))

    def _merged(self, units) -> tuple[np.ndarray, np.ndarray]:
        """ids of plain units one after another, and their number for each unit."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.bare:
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(units)], pc.utf8_lower(units.cast(pa.string()))), "\n")[0].as_py()
            text = WORD_PIECES.sub(rf"\g<0>{SEPARATOR}", joined) + "\n"
        else:
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(units)], units.cast(pa.string())), SEPARATOR)[0].as_py() + SEPARATOR
        ids = self.merger.encode_to_numpy(text)
        ends = np.flatnonzero(ids == self.between)
        if len(ends) != len(units):
            raise AssertionError("units and separators differ in number")
        return np.delete(ids, ends).astype(np.uint16), np.diff(ends, prepend=-1) - 1

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(x.ids, np.uint16) for x in found]
