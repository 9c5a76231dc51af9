"""Token ids of whole texts, by the ``tokenizers`` library, as packed little-endian integers.

Most of a corpus are words seen before.  The texts of a batch are cut where no token can reach over
the cut, pyarrow finds the distinct units, and each of them goes through the library once, end to end:
units of a byte-level file as they are, those of a word-level one as distinct pieces, where a bounded
cache keeps what is frequent.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import runs

#: Entries from which on the cache starts anew, and the longest one, in bytes.
CACHE, CACHED_BYTES = 400_000, 80
#: Bytes of text that are cut and encoded at once.
RUN = 8_000_000
#: Bytes of units that go through the library as one string.
JOINED = 1_000

#: White space as Unicode's White_Space property has it.
_WHITE = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: A blank between white space: the one place before a blank where a byte-level token may reach over.
_AMID = f"[{_WHITE}] [{_WHITE}]"
#: A blank before a character begins a token in any surroundings.
_BEGIN = f"^ [^{_WHITE}]"
#: What marks the cuts: code points that are no characters; one that no text of a batch holds is taken.
_MARKS = [chr(c) for c in range(0xFDD0, 0xFDF0)]

#: Word-level units without these are lower-cased and cut here as the library does it; they are composed already.
_NOT_PLAIN = r"[^\x00-\x{12F}\x{131}-\x{24F}]"
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: The ends that the word-level file knows as words.
_CLITICS = ("s", "t", "re", "ve", "m", "ll", "d")


def _kinds() -> np.ndarray:
    """The kind of each character below U+0250."""
    kinds = np.full(0x250, _OTHER, np.uint8)
    for kind, ranges in (_LETTER, "AZazªªµµººÀÖØöøɏ"), (_NUMBER, "09²³¹¹¼¾"), (_SPACE, "\t\r  \x85\x85\xa0\xa0"):
        for a, b in zip(ranges[::2], ranges[1::2], strict=True):
            kinds[ord(a) : ord(b) + 1] = kind
    return kinds


_KINDS = _kinds()
#: Bytes before which word-level texts are cut.
_CUTS = np.isin(np.arange(256), list(b"\t\n\v\f\r "))


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level files write for each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()
#: The same within lines.
_LINE_LETTERS = _BYTE_LETTERS | {ord("\n"): "\n"}


def _strings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer]:
    """The bytes of all texts end to end, each text's place in them, and the buffer that holds them."""
    _, offsets, data = texts.buffers()
    stops = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    data = data or pa.py_buffer(b"")
    return np.frombuffer(data, np.uint8)[stops[0] : stops[-1]], stops, data


def _flat(found: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of large binary values end to end, and their places."""
    _, offsets, data = found.buffers()
    return data or pa.py_buffer(b""), np.frombuffer(offsets, np.int64, len(found) + 1) if len(found) else np.zeros(1, np.int64)


def _merged(mask: pa.Array, first: pa.Array, rest: pa.Array) -> pa.Array:
    """The values of ``first`` where ``mask`` holds and those of ``rest`` elsewhere, each in order."""
    mask, place = mask.to_numpy(zero_copy_only=False), np.empty(len(mask), np.int64)
    place[mask], place[~mask] = np.arange(len(first)), np.arange(len(first), len(mask))
    return pa.concat_arrays([first, rest]).take(pa.array(place))


def _cut(texts: pa.Array, whole: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Word-level texts cut before white space of one byte, and each text's first unit; ``whole`` ones are one unit."""
    letters, stops, data = _strings(texts)
    places = stops - stops[0]
    begin = _CUTS[letters]
    for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
        begin[places[i] : places[i + 1]] = False
    begin[places[places < len(letters)]] = True
    starts = np.flatnonzero(begin)
    offsets = np.append(starts, len(letters)).astype(np.int32) + stops[0]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), data), np.searchsorted(starts, places)


def _pieces(units: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased units of characters below U+0250 cut as the word-level file does it, and each unit's first piece.

    A piece is a run of letters, a number, a clitic or a run of other characters; white space is in none.
    """
    letters, stops, data = _strings(units)
    places = stops - stops[0]
    kinds = _KINDS[letters]
    lead = np.flatnonzero(letters >= 0xC2)  # characters of two bytes
    kinds[lead] = kinds[lead + 1] = _KINDS[(letters[lead] & 0x1F).astype(np.int32) << 6 | letters[lead + 1] & 0x3F]
    begin = kinds == _NUMBER
    begin[1:] |= kinds[1:] != kinds[:-1]
    begin[lead + 1] = False
    first = np.zeros(len(letters), bool)
    first[places[places < len(letters)]] = True
    begin |= first
    quotes = np.flatnonzero(begin & (letters == ord("'")))
    for end in _CLITICS:
        at = quotes[quotes + len(end) < len(letters)]
        for i, c in enumerate(end.encode(), 1):
            at = at[(letters[at + i] == c) & ~first[at + i]]
        begin[at + 1] = False
        after = at + len(end) + 1
        after = after[after < len(letters)]
        begin[after] |= kinds[after] == _LETTER
    starts = np.flatnonzero(begin)
    offsets = np.append(starts, len(letters)).astype(np.int32) + stops[0]
    solid = kinds[starts] != _SPACE
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), data).filter(pa.array(solid))
    return pieces, np.cumsum(np.append(0, solid))[np.searchsorted(starts, places)]


class Encoder:
    """Encodes batches of texts with a tokenizer file.

    ``kind`` "byte": a byte-level file, where a token may begin with the blank before a word;
    "word": a word-level one, where tokens hold no white space.
    """

    def __init__(self, path: str, kind: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the strings of added tokens in a text are these tokens, as the library has it by default
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.sign = os.path.commonprefix(self.added)
        self.kind = kind
        # how many bytes of text each id of a byte-level file stands for
        vocabulary = self.tokenizer.get_vocab() if kind == "byte" else {}
        self.widths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token.encode() if token in self.added else token)
        if kind == "word":  # the file's model alone, for pieces on lines of their own
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
            # which ids end a piece
            vocabulary, suffix = self.model.get_vocab(), self.model.model.end_of_word_suffix
            self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.parts, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())  # the cache

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as unsigned 32-bit little-endian bytes; none for null or empty."""
        return next(self.batches(pa.array([text], pa.string())))[0]

    def batches(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """The ids of all texts in order, a few megabytes of text at a time."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for a, b in runs(sizes, RUN):
            yield self._batch(pc.fill_null(texts.slice(a, b - a), ""))

    def _batch(self, texts: pa.Array) -> list[bytes]:
        # texts that may hold an added token are one unit each
        hit = pc.match_substring(texts, self.sign) if self.added else pa.array(np.zeros(len(texts), bool))
        if self.kind == "word":
            units, starts = _cut(texts, hit)
        else:
            mark = next((m for m in _MARKS if not pc.any(pc.match_substring(texts, m)).as_py()), None)
            if mark is None:
                return self._library(texts.to_pylist())
            cut = pc.replace_substring(texts, " ", f"{mark} ")
            cut = pc.if_else(pc.match_substring_regex(texts, _AMID), texts, cut)  # and so are those of such blanks
            if pc.any(hit).as_py():
                cut = pc.if_else(hit, texts, cut)
            split = pc.split_pattern(cut, mark)
            units, starts = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        named = units.dictionary_encode()
        ids = self._joined(named.dictionary) if self.kind == "byte" else self._pieced(named.dictionary)
        data, ends = _flat(ids.take(named.indices))
        stops, out = ends[starts].tolist(), memoryview(data)
        return [bytes(out[a:b]) for a, b in zip(stops, stops[1:])]

    def _known(self, parts: pa.Array, encode: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """The ids of distinct strings; those that the cache doesn't hold go to ``encode``."""
        place = np.full(len(parts), -1)
        if len(self.parts):
            place = pc.fill_null(pc.index_in(parts, value_set=self.parts), -1).to_numpy().astype(np.int64)
        missing = place < 0
        new = parts.filter(pa.array(missing))
        place[missing] = np.arange(len(self.parts), len(self.parts) + len(new))
        coded = encode(new)
        out = pa.concat_arrays([self.ids, coded]).take(pa.array(place))
        if anew := len(self.parts) + len(new) > CACHE:  # with what this batch holds: the frequent ones are among it
            new, coded = parts, out
        short = pc.less_equal(pc.binary_length(new), CACHED_BYTES)
        new, coded = new.filter(short).slice(0, CACHE), coded.filter(short).slice(0, CACHE)
        self.parts = new if anew else pa.concat_arrays([self.parts, new])
        self.ids = coded if anew else pa.concat_arrays([self.ids, coded])
        return out

    def _library(self, units: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _joined(self, units: pa.Array) -> pa.Array:
        """Ids of units of a byte-level file: those that begin with a blank before a character go through the library end to
        end, since no token reaches over such a blank, and are told apart by the bytes that their ids stand for."""
        plain = pc.match_substring_regex(units, _BEGIN)
        chosen, others = units.filter(plain), units.filter(pc.invert(plain))
        _, offsets, data = chosen.buffers()
        stops = np.frombuffer(offsets, np.int32, len(chosen) + 1).astype(np.int64) if len(chosen) else np.zeros(1, np.int64)
        texts, i = [], 0
        while i < len(chosen):
            j = max(i + 1, int(np.searchsorted(stops, stops[i] + JOINED, "right")) - 1)
            texts.append(str(memoryview(data)[stops[i] : stops[j]], "utf-8"))
            i = j
        coded = [np.zeros(0, "<u4")]
        for k in range(0, len(texts), 64):  # the library's results are large
            coded += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts[k : k + 64], add_special_tokens=False)]
        ids = np.concatenate(coded)
        reached = np.cumsum(np.append(0, self.widths[ids]))
        ends = np.searchsorted(reached, stops)
        if reached[-1] == stops[-1] and (reached[ends] == stops).all():
            first = pa.Array.from_buffers(pa.large_binary(), len(chosen), [None, pa.py_buffer(4 * ends), pa.py_buffer(ids)])
        else:  # some bytes have no id
            first = pa.array(self._library(chosen.to_pylist()), pa.large_binary())
        rest = pa.array(self._library(others.to_pylist()), pa.large_binary())
        return _merged(plain, first, rest)

    def _pieced(self, units: pa.Array) -> pa.Array:
        """Ids of units of a word-level file: those of plain letters are lower-cased and cut, and their distinct pieces go to
        the model; others go through the library whole."""
        low = pc.utf8_lower(units)
        other = pc.or_(pc.match_substring_regex(units, _NOT_PLAIN), pc.match_substring_regex(low, _NOT_PLAIN))
        if self.added:
            other = pc.or_(other, pc.match_substring(units, self.sign))
        plain = pc.invert(other)
        pieces, starts = _pieces(low.filter(plain))
        named = pieces.dictionary_encode()
        data, ends = _flat(self._known(named.dictionary, self._modelled).take(named.indices))
        first = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(ends[starts]), data])
        if len(first) == len(units):
            return first
        return _merged(plain, first, self._known(units.filter(other), self._whole))

    def _whole(self, units: pa.Array) -> pa.Array:
        texts, sizes = units.to_numpy(zero_copy_only=False).tolist(), pc.binary_length(units).to_numpy().tolist()
        return pa.array([ids for a, b in runs(sizes, 64 * JOINED) for ids in self._library(texts[a:b])], pa.large_binary())

    def _modelled(self, pieces: pa.Array) -> pa.Array:
        """Ids of pieces, which go through the model end to end and are told apart by the ids that end one."""
        parts = pieces.to_numpy(zero_copy_only=False).tolist()
        texts = ["\n".join(parts[a:b]) for a, b in runs(pc.binary_length(pieces).to_numpy().tolist(), JOINED)]
        texts = [t.encode().decode("latin-1").translate(_LINE_LETTERS) for t in texts]
        coded = [np.zeros(0, "<u4")]
        for k in range(0, len(texts), 64):  # the library's results are large
            coded += [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts[k : k + 64], add_special_tokens=False)]
        ids = np.concatenate(coded)
        stops = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        if len(stops) == len(pieces) + 1 and stops[-1] == len(ids):
            return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(4 * stops), pa.py_buffer(ids)])
        letters = [p.encode().decode("latin-1").translate(_BYTE_LETTERS) for p in parts]  # some have no id
        return pa.array([array("I", [t.id for t in self.tokenizer.model.tokenize(p)]).tobytes() for p in letters], pa.large_binary())


@lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> Encoder:
    """One encoder per worker process and tokenizer file; ``kind``: "word" or "byte"."""
    return Encoder(path, kind)
