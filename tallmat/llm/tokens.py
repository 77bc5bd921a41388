"""Token ids of whole texts by a public tokenizer, computed once per distinct stretch of text.

Texts are cut at single spaces, where neither tokenizer here ever joins tokens: the byte-level one takes a space as the
first character of the next stretch, the other drops white space. Each distinct stretch of a task is encoded once by
the library, many joined in one call; ids are then gathered with numpy. A text in which a cut could matter (white space next to white space) is
encoded as a whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text cut at once, and stretches remembered within a task (about 40 bytes each).
TOKEN_SLICE = 4 << 20
MAX_KNOWN = 1 << 20
_JOINED = 512
_MARK = "\x01"
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[*range(9, 14), *range(28, 33), *sorted({chr(c).encode()[0] for c in range(128, 0x3001) if chr(c).isspace()})]] = True


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _blank_first(strings: pa.Array) -> np.ndarray:
    """Whether each string is empty or begins with white space."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"\0", np.uint8)
    out = offsets[1:] == offsets[:-1]
    first = np.where(out, 0, data[np.minimum(offsets[:-1], len(data) - 1)])
    # beyond ASCII, white space begins with one of four bytes, as other characters do
    some = np.flatnonzero(_MAYBE_SPACE[first])
    out[some] = [s[0].isspace() for s in strings.take(pa.array(some)).to_pylist()]
    return out


class _Known:
    """Ids of the strings met so far."""

    def __init__(self) -> None:
        self.strings = pa.array([], pa.large_string())
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int32)
        self.length = np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.strings)

    def numbers(self, strings: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The number of each of these distinct strings; `encode` gives ids and their numbers of those not met before."""
        found = pc.index_in(strings, value_set=self.strings)
        numbers = found.fill_null(0).to_numpy().copy()
        if found.null_count:
            new = found.is_null()
            numbers[new.to_numpy(zero_copy_only=False)] = len(self) + np.arange(found.null_count)
            new = strings.filter(new)
            ids, lengths = encode(new)
            self.strings = pa.concat_arrays([self.strings, new])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
            self.flat, self.length = np.concatenate([self.flat, ids]), np.concatenate([self.length, lengths])
        return numbers


def _gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the strings with these numbers, one after the other, and their numbers."""
    if not len(at):
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    lengths = length[at]
    ends = np.cumsum(lengths, dtype=np.int64)
    return flat[np.arange(ends[-1]) + np.repeat(start[at] - (ends - lengths), lengths)], lengths


class Encoder:
    """Encodes with the `tokenizers` file at `path`; `spaces` tells whether a space belongs to the token after it."""

    def __init__(self, path: str, spaces: bool, max_known: int = MAX_KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaces, self.max_known = spaces, max_known
        size = self.tokenizer.get_vocab_size()
        if spaces:
            names = (self.tokenizer.id_to_token(i) or "" for i in range(size))
            self.opens = np.fromiter((n.startswith("\u0120") for n in names), bool, size)
        self.mark = self._whole([_MARK])[0]
        self._forget()

    def _forget(self) -> None:
        self.known = _Known()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._whole(texts)
        return np.array([t for x in ids for t in x], np.uint32), np.fromiter(map(len, ids), np.int32, len(ids))

    def _together(self, strings: pa.Array, before: str, between: str, after: str, split: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings joined in calls of many; `split` parts the ids of a call, or gives None where they can't be told apart."""
        offsets = np.append(np.arange(0, len(strings), _JOINED), len(strings))
        rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), strings)
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for i, text in enumerate(pc.binary_join(rows, pa.scalar(between, pa.large_string()))):
            part = strings[offsets[i] : offsets[i + 1]]
            found = split(np.array(self._whole([before + text.as_py() + after])[0], np.uint32), len(part))
            ids, n = found or self._each([before + s for s in part.to_pylist()])
            flat.append(ids)
            lengths.append(n.astype(np.int32))
        return np.concatenate(flat), np.concatenate(lengths)

    def _at_openings(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        first = np.flatnonzero(self.opens[ids])
        return (ids, np.diff(np.append(first, len(ids)))) if len(first) == n and not first[0] else None

    def _at_marks(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        last = np.flatnonzero(ids == self.mark[0])
        if len(self.mark) != 1 or len(last) != n:
            return None
        return np.delete(ids, last), np.diff(np.concatenate([[-1], last])) - 1

    def _new_ids(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.spaces:
            return self._together(stretches, "", f" {_MARK} ", f" {_MARK}", self._at_marks)
        return self._together(stretches, " ", " ", "", self._at_openings)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids per text."""
        if len(self.known) > self.max_known or self.known.strings.nbytes > 64 * self.max_known:
            self._forget()
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.spaces:
            texts = pc.replace_substring(texts, "\n", " ")
        cut = pc.split_pattern(texts, " ")
        offsets = np.asarray(cut.offsets)
        offsets = offsets - offsets[0]
        values = cut.flatten().dictionary_encode()
        codes, distinct = values.indices.to_numpy(), values.dictionary
        odd = np.zeros(len(texts), bool)
        if self.spaces:
            inner = np.ones(len(codes), bool)
            inner[offsets[:-1]] = False
            risky = _blank_first(distinct)
            odd[np.searchsorted(offsets, np.flatnonzero(risky[codes] & inner), side="right") - 1] = True
            needed = np.zeros(len(distinct), bool)
            needed[codes[inner]] = True
            needed &= ~risky
            numbers = np.zeros(len(distinct), np.int32)
            numbers[needed] = self.known.numbers(distinct.filter(pa.array(needed)), self._new_ids)
            # stretches that open a text follow no space, so they are kept apart
            opening = np.unique(codes[offsets[:-1]])
            own, own_length = self._each(distinct.take(pa.array(opening)).to_pylist())
            known = self.known
            start = np.concatenate([known.start, len(known.flat) + np.cumsum(own_length) - own_length])
            at = numbers[codes]
            at[offsets[:-1]] = len(known) + np.searchsorted(opening, codes[offsets[:-1]])
            ids, lengths = _gathered(np.concatenate([known.flat, own]), start, np.concatenate([known.length, own_length]), at)
        else:
            at = self.known.numbers(distinct, self._new_ids)[codes]
            ids, lengths = _gathered(self.known.flat, self.known.start, self.known.length, at)
        counts = np.diff(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[offsets])
        if odd.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            rows = np.flatnonzero(odd).tolist()
            for i, own in zip(rows, self._whole([texts[i].as_py() for i in rows])):
                parts[i] = np.array(own, np.uint32)
            counts = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
        return ids, counts


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end` after each text, and the new counts."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(counts + 1) - 1] = False
    out[inside] = ids
    return out, counts + 1


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
