"""Exact, memoised encoding with the public tokenizers.

Encoding a text is the concatenation of encoding its pre-tokens, so a text may be cut wherever the tokenizer
itself always cuts, and each distinct piece need be encoded only once per worker:

* ``word_bpe_49k`` lowers text and drops white space, so every space, line end and end of a run of letters before ASCII
  punctuation is a cut, and A-Z may be lowered before;
* ``byte_bpe_50k`` attaches one space to the word after it, so a space between two non-space characters is a cut.
  Other white-space runs stay inside their piece.

A piece that is one run of Latin letters is one pre-token, so it goes to the tokenizer's model as it is; others pass
through the whole tokenizer. A text in which a special token's string stands is encoded as one piece, by the file's own
rules: such a string is the special token, or ordinary text with ``special_as_text``.

The memo is bounded (``MEMO_PIECES``): once full it keeps what it has, which are the frequent pieces; others, and
pieces longer than ``MEMO_CHARS``, are encoded afresh.

Any text may be given: a null one is empty; surrogates cannot occur in a column of strings; a very long text is handled
like others, within memory of a few times its size.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_PIECES = 700_000
MEMO_CHARS = 48
_ENCODERS: dict[tuple, "Encoder"] = {}
#: Letters each of which is one letter in lower case too (U+0130 isn't) and which no normalisation changes.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: Apostrophes are left out, as contractions differ.
_MARKS = r".,;:!?%*$#&()\[\]\"/@+=<>-"
_WORD = re.compile(rf"[{_LETTERS}]+")
#: Letters, marks and perhaps a line end, letters: cuts of both tokenizers.
_COMPOUND = re.compile(rf"([{_LETTERS}]+)([{_MARKS}]+\n?|\n)([{_LETTERS}]+)?")
#: A space beside other white space, or at an end.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNEVEN = rf"^ | $| {_WHITE}|{_WHITE} "
_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


class Encoder:
    """``encode(texts)`` gives one little-endian uint32 byte string for each text (null counts as empty)."""

    def __init__(self, path: str, keep_space: bool, memo_pieces: int = MEMO_PIECES, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.specials = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.lead = " " if keep_space else ""
        self.memo: dict[str, bytes] = {}
        self.bound = memo_pieces
        self.bare: dict[str, bytes] = {}
        letters = [c for c in map(chr, range(0xC0, 0x250)) if _WORD.fullmatch(c)]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: What the model sees of letters beyond ASCII, and of a space.
        self.shown = {ord(c): level.pre_tokenize_str(c)[0][0] for c in [" ", *letters]}
        if not keep_space:
            self.memo[""] = b""

    def _cut(self, text: str) -> tuple[str, list[str]]:
        """The first piece, and those after a space, without that space."""
        first, *rest = text.split(" ")
        if not any(" " + c in text or c + " " in text for c in _SPACES if c in text) and first and (not rest or rest[-1]):
            return first, rest
        glued, held = [], first  # a space beside other white space, or at an end, is not a cut
        for p in rest:
            if held and p and not held[-1].isspace() and not p[0].isspace():
                glued.append(held)
                held = p
            else:
                held += " " + p
        glued.append(held)
        return glued[0], glued[1:]

    def _fresh(self, pieces: Iterable[str], lead: str) -> dict[str, bytes]:
        """Encodings of pieces, each after ``lead``. Those of letters alone go to the model."""
        out, order, tokenize, shown = {}, [], self.model.tokenize, self.shown
        front, lower = lead.translate(shown), None if self.lead else str.lower
        for p in pieces:
            if p.isascii():
                if not p.isalpha():
                    order.append(p)
                    continue
                w = p if lower is None else lower(p)
            elif _WORD.fullmatch(p):
                w = (p if lower is None else lower(p)).translate(shown)
            else:
                order.append(p)
                continue
            out[p] = array("I", [t.id for t in tokenize(front + w)]).tobytes()
        for k in range(0, len(order), 2048):
            part = order[k : k + 2048]
            for p, e in zip(part, self.tokenizer.encode_batch_fast([lead + p for p in part] if lead else part, add_special_tokens=False)):
                out[p] = array("I", e.ids).tobytes()
        return out

    def _resolve(self, pieces: set[str]) -> dict[str, bytes]:
        """Encodings of pieces that the memo lacks. A word with punctuation is put together from its parts."""
        memo, lead = self.memo, self.lead
        split = {p: m.groups("") for p in pieces if not p.isalpha() and (m := _COMPOUND.fullmatch(p))}
        heads, tails = {m[0] for m in split.values()}, {x for m in split.values() for x in m[1:] if x}
        words = {p for p in pieces if p not in split} | {h for h in heads if h not in memo}
        if not lead:  # this tokenizer lowers text and drops white space, so a part has one encoding wherever it stands
            words |= {t for t in tails if t not in memo}
            bare = memo
        else:
            bare = self.bare
            bare.update(self._fresh({t for t in tails if t not in bare}, ""))
            if len(bare) > self.bound // 4:
                self.bare = {}
        fresh = self._fresh(words, lead)
        word = lambda x: b if (b := fresh.get(x)) is not None else memo[x]
        part = word if bare is memo else bare.__getitem__
        for p, (head, mark, tail) in split.items():
            fresh[p] = word(head) + part(mark) + (part(tail) if tail else b"")
        return fresh

    def _known(self, words: list[str]) -> list[bytes]:
        """Encodings of words, each after its space; new ones go to the memo while there is room."""
        memo = self.memo
        row = list(map(memo.get, words))
        gaps = [i for i, b in enumerate(row) if b is None] if None in row else ()
        if gaps:
            fresh = self._resolve({words[i] for i in gaps})
            for i in gaps:
                row[i] = fresh[words[i]]
            if len(memo) < self.bound:
                memo.update(fresh if max(map(len, fresh)) <= MEMO_CHARS else {p: b for p, b in fresh.items() if len(p) <= MEMO_CHARS})
        return row

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _glued(self, text: str) -> bytes:
        """A text in which a space stands beside other white space, or at an end."""
        first, rest = self._cut(text)
        return (self._fresh({first}, "")[first] if first else b"") + b"".join(self._known(rest))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Words are cut and numbered by Arrow, so Python sees each distinct word of a batch once."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        found = lambda mask: np.flatnonzero(mask.to_numpy(zero_copy_only=False)).tolist()
        low = column if self.lead else pc.ascii_lower(column)
        out = {i: self._whole(column[i].as_py()) for s in self.specials for i in found(pc.match_substring(low, s if self.lead else s.lower()))}
        if self.lead:
            out |= {i: self._glued(column[i].as_py()) for i in found(pc.match_substring_regex(column, _UNEVEN)) if i not in out}
        else:
            low = pc.replace_substring_regex(pc.replace_substring(low, "\n", " "), rf"([a-z])([{_MARKS}])", r"\1 \2")
        plain = [i for i in range(len(column)) if i not in out]
        lists = pc.split_pattern(low.take(pa.array(plain, pa.int64())) if out else low, " ")
        numbered = lists.flatten().dictionary_encode()
        word = numbered.indices.to_numpy().astype(np.int64)
        ends = lists.offsets.to_numpy().astype(np.int64)
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = self._known(distinct)
        if self.lead:  # the first word of a text has no space before it
            firsts = [distinct[k] for k in word[ends[:-1]].tolist()]
            bare = self._fresh({w for w in firsts if w}, "") | {"": b""}
            word[ends[:-1]] = len(codes) + np.arange(len(firsts))
            codes = codes + [bare[w] for w in firsts]
        size = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // 4
        pool = np.frombuffer(b"".join(codes), dtype="<u4")
        start, n = np.cumsum(size) - size, size[word]
        reach = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(start[word] - reach[:-1], n) + np.arange(reach[-1])]
        data, at = ids.tobytes(), (4 * reach[ends]).tolist()
        for k, i in enumerate(plain):
            out[i] = data[at[k] : at[k + 1]]
        return [out[i] for i in range(len(column))]


def encoder(path: str, keep_space: bool, memo_pieces: int = MEMO_PIECES, special_as_text: bool = False) -> Encoder:
    """One encoder per Python worker: loading a vocabulary costs more than most tasks. A new one replaces the last."""
    key = (path, keep_space, memo_pieces, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, keep_space, memo_pieces, special_as_text)
    return _ENCODERS[key]


def slices(batch: pa.RecordBatch, text: int = 1, most_rows: int = 1024, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded text; a longer text is a part of its own."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and (held + n > most_bytes or i - at >= most_rows):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def trim() -> None:
    """Give freed memory back at the end of a task: executors may keep more idle workers than they have cores."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
