"""Encoding of whole text columns with the tokenizers library, at the cost of the distinct words.

A vocabulary's pre-tokenizer never lets a token cross certain white space, so a text is cut there, equal
pieces are encoded once, and the ids are gathered back.  The result is the tokenizer's own ids of the
whole text; the tests hold both against each other.  Where nothing is normalized, pieces are joined by a
special token, at which the library cuts before anything else; texts that hold such a token's string go
through it whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces that a worker keeps before it starts anew; bounds its memory (some 60 bytes each).
KEPT_PIECES = 1_500_000
#: Pieces longer than this are encoded but not kept.
KEPT_LENGTH = 64
#: Pieces that go through the library at once.
JOINED = 256

#: Plain layout: words one space or one line feed apart, and no other white space.
_PLAIN = r"^[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}]+([ \n][^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}]+)*$"
_INNER_SPACE = re.compile(r"(?<=\S)(?= \S)")
_EMPTY, _BLANK, _FEED = (pa.scalar(x, pa.large_string()) for x in ("", " ", "\n"))
_WORD_AND_MARKS = r"^(?P<word>[ \n]?\p{L}+)(?P<marks>[.,;:!?#$%&*()]+)$"


def public_path(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[first : first + size], one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int32 if max(total, len(flat)) < 1 << 31 else np.int64)
    at += np.repeat((first - (ends - size)).astype(at.dtype), size)
    return flat[at]


class _Table:
    """Pieces with their ids: names, one flat array of ids, and where each piece's run begins."""

    def __init__(self) -> None:
        self.names = pa.array([], pa.large_string())
        self.flat, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, names: pa.Array, flat: np.ndarray, size: np.ndarray) -> _Table:
        """A table with some more pieces behind its own."""
        out = _Table()
        out.names = pa.concat_arrays([self.names, names])
        out.flat = np.concatenate([self.flat, flat])
        out.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        out.size = np.concatenate([self.size, size])
        return out


class ColumnEncoder:
    """Encodes string columns; built once in each Python worker (see :func:`encoder`)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = "add_prefix_space" in str(self.tokenizer.pre_tokenizer) and "Split" not in str(self.tokenizer.pre_tokenizer)
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        plain = [(t.content, i) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        # Joining doesn't pay where each cut is normalized on its own.
        self.between = plain[0] if plain and self.tokenizer.normalizer is None else None
        self.kept = _Table()

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one piece after the other, and how many each has."""
        flat, size = [], []
        for lo in range(0, len(pieces), JOINED):
            part = pieces[lo : lo + JOINED]
            cuts = ()
            if self.between is not None:
                ids = np.array(self.tokenizer.encode_batch_fast([self.between[0].join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
                cuts = np.flatnonzero(ids == self.between[1])
            if len(cuts) == len(part) - 1 and self.between is not None:
                size.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
                flat.append(np.delete(ids, cuts))
                continue
            each = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            size.append(np.fromiter(map(len, each), np.int64, len(each)))
            flat.append(np.fromiter((i for e in each for i in e), np.uint32, int(size[-1].sum())))
        return np.concatenate([np.zeros(0, np.uint32), *flat]), np.concatenate([np.zeros(0, np.int64), *size])

    def _looked_up(self, words: pa.Array) -> tuple[_Table, np.ndarray]:
        """A table that has all of some words, and their places in it."""
        at = pc.index_in(words, value_set=self.kept.names) if len(self.kept.names) else pa.nulls(len(words), pa.int32())
        new = words.filter(pc.is_null(at)).unique()
        if not len(new):
            return self.kept, at.to_numpy(zero_copy_only=False)
        if len(self.kept.names) + len(new) > KEPT_PIECES and len(self.kept.names):
            self.kept = _Table()
            return self._looked_up(words)
        short = pc.less_equal(pc.utf8_length(new), KEPT_LENGTH)
        some, long = new.filter(short), new.filter(pc.invert(short))
        self.kept = table = self.kept.add(some, *self._encode_new(some.to_pylist()))
        if len(long):
            table = table.add(long, *self._encode_new(long.to_pylist()))
        return table, pc.index_in(words, value_set=table.names).to_numpy(zero_copy_only=False)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some distinct pieces: a flat array, and each piece's first place and size."""
        parts = pc.extract_regex(pieces, _WORD_AND_MARKS)
        split = pc.is_valid(parts)
        words = pc.if_else(split, parts.field(0), pieces)
        marks = parts.filter(split).field(1)
        table, at = self._looked_up(pa.concat_arrays([words, marks]))
        # Each piece is its word's run and, if it has one, its marks' run.
        own = np.concatenate([np.arange(len(words)), np.flatnonzero(split.to_numpy(zero_copy_only=False))])
        order = np.argsort(own, kind="stable")
        own, at = own[order], at[order]
        n = table.size[at]
        size = np.bincount(own, weights=n, minlength=len(pieces)).astype(np.int64)
        return _gather(table.flat, table.first[at], n), np.cumsum(size) - size, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts as uint32, one text after the other, and each text's first place (one more than texts).

        Null and empty texts have no ids.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = np.zeros(len(texts), bool)
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._encode_pieces(texts)
        ids, at = self._encode_pieces(pc.if_else(pa.array(whole), _EMPTY, texts))
        runs = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        held = np.flatnonzero(whole).tolist()
        for i in held:
            runs[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
        return np.concatenate(runs), np.concatenate([[0], np.cumsum([len(r) for r in runs])])

    def _encode_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.spaced:
            plain = pc.match_substring_regex(texts, _PLAIN)
            # A plain text gets a line feed in front, so that each piece begins with the space or line feed before its word.
            marked = pc.if_else(plain, pc.replace_substring(pc.binary_join_element_wise(_EMPTY, texts, _FEED), "\n", " \n"), _EMPTY)
            lists = pc.split_pattern(marked, " ")
        else:
            plain = None
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        pieces = lists.flatten()
        counts = np.diff(lists.offsets.to_numpy())
        rows = np.repeat(np.arange(len(texts)), counts)
        code = pieces.dictionary_encode()
        names, code = code.dictionary, code.indices.to_numpy()
        if self.spaced:
            started = pc.starts_with(names, "\n")
            names = pc.if_else(pc.or_(started, pc.equal(names, _EMPTY)), names, pc.binary_join_element_wise(_BLANK, names, _EMPTY))
            odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False) & (pc.binary_length(texts).to_numpy() > 0))
            if len(odd):
                extra = [_INNER_SPACE.split(texts[int(i)].as_py()) for i in odd]
                more = pa.array([p for x in extra for p in x], pa.large_string()).dictionary_encode()
                rows = np.concatenate([rows, np.repeat(odd, [len(x) for x in extra])])
                code = np.concatenate([code, more.indices.to_numpy() + len(names)])
                order = np.argsort(rows, kind="stable")
                rows, code = rows[order], code[order]
                names = pa.concat_arrays([names, more.dictionary])
        flat, first, size = self._pieces(names)
        n = size[code]
        ids = _gather(flat, first[code], n)
        per_text = np.bincount(rows, weights=n, minlength=len(texts)).astype(np.int64)
        if self.spaced:  # drop the line feed that was put in front
            drop = np.where(plain.to_numpy(zero_copy_only=False), len(self.line_feed), 0)
            starts = np.cumsum(per_text) - per_text
            keep = np.ones(len(ids), bool)
            for k in range(len(self.line_feed)):
                keep[starts[drop > k] + k] = False
            ids, per_text = ids[keep], per_text - drop
        return ids, np.concatenate([[0], np.cumsum(per_text)])


_BUILT: dict[str, ColumnEncoder] = {}


def encoder(path: str) -> ColumnEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _BUILT:
        _BUILT[path] = ColumnEncoder(path)
    return _BUILT[path]
