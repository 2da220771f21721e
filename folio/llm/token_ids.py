"""Token ids of whole texts with the tokenizers library.

``Encoder`` gives the ids that encoding the whole text gives, but lets the library see each
distinct word of a batch once. The byte-level pre-tokenizer always breaks between a character
that is not white space and white space that follows it, so a text is cut there into segments
(white space and the word after it) that are encoded on their own. Letters with punctuation
after them are two pieces for it, so these are encoded apart as well, the letters by the
library's model alone. Cutting, numbering and putting together is Arrow's work; no word becomes
a Python string unless it is neither letters nor letters with punctuation.

Texts with a character that only some Unicode versions count as white space go to the library
whole, and so does everything if the vocabulary file has another pre-tokenizer, a normalizer or
special tokens that could stand in a word of that kind. Words of letters and their ids are kept
from batch to batch, as Arrow arrays up to a bound.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNSURE = re.compile(r"[\x1c-\x1f\u180e\u200b\ufeff]")
#: Texts that are more than words with one space or line feed between them (Arrow's dialect).
_UNEVEN = r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_SEGMENT = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_WORD = re.compile(f"[^{_WHITE}]")
#: Latin letters, then ASCII punctuation; before them the mark of a text's first word or of a line feed.
_LETTERS, _MARKS = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}", r"!-/:-@\[-`{-~"
_SIMPLE = f"^[\r\n]?[{_LETTERS}]+[{_MARKS}]*$"
_ALL_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
_ALL_LETTERS = "".join(chr(c) for c in range(0x250) if chr(c).isalpha())


def _byte_letters() -> np.ndarray:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = itertools.count(0x100)
    return np.array([b if b in plain else next(others) for b in range(256)], dtype="<u2")


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Ids, and the n + 1 places where each value's begin, as n binary values."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype("<i8") * 4), pa.py_buffer(data.astype("<u4", copy=False))])


class Encoder:
    """encode(texts): the ids of all texts in a row, and where each text's begin."""

    def __init__(self, vocabulary: str, most_words: int = 10_000, most_kept: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        spec = json.loads(self.tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        added = [t["content"] for t in spec["added_tokens"]]
        in_words = any(re.search(r"\s", t) for t in added) or pc.any(pc.match_substring_regex(pa.array(added, pa.large_string()), _SIMPLE)).as_py()
        self.by_segment = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec["normalizer"] and not in_words
        self.alphabet = _byte_letters()
        self.letters = Tokenizer(self.tokenizer.model)  # sees words of letters as the pieces they are
        self.letters.pre_tokenizer = pre_tokenizers.Split(chr(self.alphabet[10]), "isolated")
        if hasattr(self.letters.model, "_resize_cache"):
            self.letters.model._resize_cache(0)  # no word comes twice
        self.most_words, self.most_kept = most_words, most_kept  # words that the library gets at a time, that are kept
        self.known, self.known_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.feed = self.whole(["\n"])[0]

    @property
    def vocabulary_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def ids(self, texts: Sequence[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        ids, at = self.encode(pa.array(texts, pa.large_string()))
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in itertools.pairwise(at.tolist())]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the n + 1 places where they begin; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_segment:
            return self._joined(self.whole(texts.to_pylist()))
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        if not pc.any(uneven).as_py():
            return self._even(texts)
        uneven = uneven.to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        rest = np.flatnonzero(~uneven)
        ids, at = self._even(texts.take(pa.array(rest)))
        for i, (a, b) in zip(rest.tolist(), itertools.pairwise(at.tolist()), strict=True):
            out[i] = ids[a:b].tobytes()
        at_odd = np.flatnonzero(uneven).tolist()
        odd = [texts[i].as_py() for i in at_odd]
        unsure = [bool(_UNSURE.search(text)) for text in odd]
        cut = [[] if skip else [self._key(s) for s in _SEGMENT.findall(text)] for text, skip in zip(odd, unsure, strict=True)]
        ids, at = self._words(pa.array(itertools.chain.from_iterable(cut), pa.large_string()))
        at = at[np.cumsum([0, *map(len, cut)])].tolist()
        for i, text, skip, (a, b) in zip(at_odd, odd, unsure, itertools.pairwise(at), strict=True):
            out[i] = self.whole([text])[0] if skip else ids[a:b].tobytes()
        return self._joined(out)

    @staticmethod
    def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)))
        return np.frombuffer(b"".join(parts), "<u4"), at

    @staticmethod
    def _key(segment: str) -> str:
        """A segment's name: the word alone if one space stands before it, the segment itself if it
        begins with a line feed, else the segment after a return."""
        if segment[0] == "\n":
            return segment
        if segment[0] == " " and _WORD.match(segment, 1):
            return segment[1:]
        return "\r" + segment

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts in which words have one space or line feed between them."""
        nothing = pc.equal(pc.binary_length(texts), 0)
        marked = pc.binary_join_element_wise(pa.scalar("\r", pa.large_string()), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", pa.large_string()))
        words = pc.split_pattern(pc.if_else(nothing, pa.scalar("\r", pa.large_string()), marked), " ")
        ids, at = self._words(words.flatten())
        return ids, at[words.offsets.to_numpy() - words.offsets[0].as_py()]

    def _words(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of named segments one after the other, and where each one's begin."""
        coded = pc.dictionary_encode(names)
        each = self._distinct(coded.dictionary).take(coded.indices)
        if not len(each):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        at = np.frombuffer(each.buffers()[1], "<i8", len(each) + 1, 8 * each.offset)
        ids = np.frombuffer(each.buffers()[2], "<u4", int(at[-1] - at[0]) // 4, int(at[0])) if at[-1] > at[0] else np.zeros(0, "<u4")
        return ids, (at - at[0]) // 4

    def _distinct(self, names: pa.Array) -> pa.Array:
        """Ids of distinct named segments, as binary values."""
        simple = pc.match_substring_regex(names, _SIMPLE).to_numpy(zero_copy_only=False)
        one, other = np.flatnonzero(simple), np.flatnonzero(~simple)
        rest = [s[1:] if s[:1] == "\r" else s if s[0] == "\n" else " " + s for s in names.take(pa.array(other)).to_pylist()]
        found = [pa.array(self.whole(rest), pa.large_binary())]
        if len(one):
            words = names.take(pa.array(one))
            first = pc.starts_with(words, "\r")
            fed = pc.starts_with(words, "\n")
            marks = pc.dictionary_encode(pc.utf8_ltrim(words, characters="\r\n" + _ALL_LETTERS))
            stems = pc.utf8_rtrim(words, characters=_ALL_MARKS)
            spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), stems, pa.scalar("", pa.large_string()))
            pieces = pc.dictionary_encode(pc.if_else(pc.or_(first, fed), pc.utf8_ltrim(stems, characters="\r\n"), spaced))
            before = pc.if_else(fed, pa.scalar(self.feed, pa.large_binary()), pa.scalar(b"", pa.large_binary()))
            after = pa.array(self.whole(marks.dictionary.to_pylist()), pa.large_binary()).take(marks.indices)
            found.insert(0, pc.binary_join_element_wise(before, self._kept(pieces.dictionary).take(pieces.indices), after, pa.scalar(b"", pa.large_binary())))
            one = np.concatenate((one, other))
        else:
            one = other
        place = np.empty(len(one), np.int64)
        place[one] = np.arange(len(one))
        return pa.concat_arrays(found).take(pa.array(place))

    def _kept(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words of Latin letters, some after a space; the library sees the unknown ones."""
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(at))
        if len(new):
            ids = pa.concat_arrays([self.known_ids, *[self._pieces(new.slice(a, self.most_words)) for a in range(0, len(new), self.most_words)]])
            unknown = pc.is_null(at).to_numpy(zero_copy_only=False)
            place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            place[unknown] = len(self.known) + np.arange(len(new))
            found = ids.take(pa.array(place))
            # what was kept is forgotten when it grows too much, but for this batch's words
            self.known, self.known_ids = (pa.concat_arrays([self.known, new]), ids) if len(ids) <= self.most_kept else (words, found)
            return found
        return self.known_ids.take(at)

    def _pieces(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words of Latin letters, some after a space, which the pre-tokenizer leaves whole."""
        lines = pc.binary_join_element_wise(words, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
        raw = np.frombuffer(lines.buffers()[2], np.uint8, pc.sum(pc.binary_length(lines)).as_py())  # a new array, from its start
        mapped = self.alphabet[raw[:-1]].tobytes().decode("utf-16-le")
        ids = np.array(self.letters.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(ids == np.frombuffer(self.feed, "<u4")[0])
        if len(ends) != len(words) - 1:
            raise ValueError("the vocabulary does not keep line feeds apart")
        at = np.concatenate((np.zeros(1, np.int64), ends - np.arange(len(ends)), [len(ids) - len(ends)]))
        return _binary(np.delete(ids, ends), at)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """This process's encoder for a vocabulary file; kept from task to task."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def documents(coder: Encoder, texts: pa.Array, end_id: int | None) -> list[np.ndarray]:
    """Each text's ids with the end id after them."""
    ids, at = coder.encode(texts)
    if end_id is not None:
        ids, at = np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
    return [ids[a:b] for a, b in itertools.pairwise(at.tolist())]
