"""Token ids of whole texts, by the tokenizers library, with the ids of frequent words kept."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker keeps, in arrays.
KEPT_WORDS = 300_000
#: Texts that are cut and looked up together have about so many bytes; a longer text is by itself.
BLOCK = 4 << 20
#: Stands between the pieces of a text that keeps its spaces; a text that has it is encoded whole.
CUT = "\x01"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts, `dtype` wide, the same as encoding each text by itself.

    A text is cut where the tokenizer's own pre-tokenizer always cuts, and each distinct piece of a block is
    encoded once. `spaces`: "lead" if a word begins with the space before it (byte-level BPE), "drop" if
    white space never reaches the model, which lower-cases. Texts that can't be cut safely are encoded whole.
    """

    def __init__(self, path: str, spaces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.lead = Tokenizer.from_file(path), spaces == "lead"
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        # kept words, all their ids, where each word's ids begin and the last ones end, and the words that _is_odd
        self.kept, self.pool, self.ends, self.odd = pa.array([], pa.string()), np.zeros(0, self.dtype), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=bool)
        # tokens that begin with a space, or end a word: every word of a text has just one
        own = [i for t, i in self.tokenizer.get_vocab().items() if (t.startswith("\u0120") if self.lead else t.endswith("</w>"))]
        self.edge = np.zeros(size + 1, dtype=bool)
        self.edge[own] = True
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = line[0] if len(line) == 1 else -1
        self.one_word = re.compile(r" [^\s<]+").fullmatch if self.lead else str.isalpha
        self.one_line = re.compile(r"[^\s<]+")

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str], joint: str, starts) -> list[bytes]:
        """Ids of words that are encoded as one text; starts: ids -> where each word's ids begin, and where the last ones end."""
        out: list[bytes] = []
        for part in (words[a : a + 1000] for a in range(0, len(words), 1000)):
            ids = np.array(self.tokenizer.encode_batch_fast([joint.join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            first, end = starts(ids)
            if len(first) != len(part) or len(end) != len(part):  # never seen, but then each by itself
                out += self.whole(part)
                continue
            data, size = ids.tobytes(), self.dtype.itemsize
            out += [data[a:b] for a, b in zip((first * size).tolist(), (end * size).tolist())]
        return out

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        found: dict[str, bytes] = {}
        words = [w for w in new if self.one_word(w)]
        if self.lead:
            found.update(zip(words, self._together(words, "", lambda ids: (at := np.flatnonzero(self.edge[ids]), np.append(at[1:], len(ids))))))
        else:
            found.update(zip(words, self._together(words, " ", lambda ids: (np.append(0, (at := np.flatnonzero(self.edge[ids]) + 1)[:-1]), at))))
        rest = [w for w in new if w not in found]
        if self.lead and self.line_end >= 0:
            words = [w for w in rest if self.one_line.fullmatch(w)]
            found.update(zip(words, self._together(words, "\n", lambda ids: (np.append(0, (at := np.flatnonzero(ids == self.line_end)) + 1), np.append(at, len(ids))))))
            rest = [w for w in rest if w not in found]
        found.update(zip(rest, self.whole(rest)))
        return [found[w] for w in new]

    def _is_odd(self, piece: str) -> bool:
        """Only a whole text says how more spaces in a row are cut."""
        return self.lead and piece[:1] == " " and (len(piece) == 1 or piece[1].isspace())

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of pieces: each one's number, and by number the ids, where each one's begin and the last ones end, and is it odd?"""
        if pieces.type != self.kept.type:
            self.kept = self.kept.cast(pieces.type)
        at = pc.index_in(pieces, value_set=self.kept)
        missing = at.is_null()
        new = pieces.filter(missing).dictionary_encode()
        number = at.fill_null(0).to_numpy().astype(np.int64)
        number[missing.to_numpy(zero_copy_only=False)] = new.indices.to_numpy().astype(np.int64) + len(self.kept)
        words = new.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self._learn(words)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // self.dtype.itemsize
        pool = np.concatenate((self.pool, np.frombuffer(b"".join(ids), dtype=self.dtype)))
        ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(size)))
        odd = np.concatenate((self.odd, np.fromiter(map(self._is_odd, words), dtype=bool, count=len(words))))
        if words and len(odd) <= KEPT_WORDS:  # what came first stays: frequent words come early
            self.kept, self.pool, self.ends, self.odd = pa.concat_arrays([self.kept, new.dictionary]), pool, ends, odd
        return number, pool, ends, odd

    def _cut(self, column: pa.Array) -> pa.Array:
        """Lists of pieces: cuts lie between a letter (one that neither NFC nor lower case takes apart) and a mark, and at white space."""
        if not self.lead:
            return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(column), "([a-zÀ-ÖØ-öø-ÿ])([.,!?;:])", r"\1 \2"))
        column = pc.replace_substring(column, " ", f"{CUT} ")
        column = pc.replace_substring_regex(column, "([A-Za-z])([.,])", rf"\1{CUT}\2")
        return pc.split_pattern(pc.replace_substring_regex(column, "([.,A-Za-z])\n([A-Za-z])", f"\\1\n{CUT}\\2"), CUT)

    def _block(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = self._cut(column)
        at = lists.offsets.to_numpy().astype(np.int64)
        number, pool, ends, is_odd = self._ids(lists.flatten())
        at = at - at[0]
        each = np.diff(ends)[number]
        upto = np.concatenate(([0], np.cumsum(each)))
        out, offsets = pool[np.repeat(ends[number] - upto[:-1], each) + np.arange(upto[-1])], upto[at]
        if self.lead:
            odd = np.diff(np.concatenate(([0], np.cumsum(is_odd[number])))[at]) > 0
            odd |= pc.match_substring(column, CUT).to_numpy(zero_copy_only=False)
            if odd.any():
                parts = [out[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                hit = np.flatnonzero(odd)
                for i, x in zip(hit.tolist(), self.whole(column.take(pa.array(hit)).to_pylist())):
                    parts[i] = np.frombuffer(x, dtype=self.dtype)
                out, offsets = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return out, offsets

    def blocks(self, column: pa.Array):
        """(first text, end text, ids of these texts, where each text's ids begin and the last ones end) of an Arrow column without nulls."""
        size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, a = np.cumsum(size), 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] - size[a] + BLOCK, side="right")))
            yield a, b, *self._block(column.slice(a, b - a))
            a = b

    def encode(self, texts: list[str]) -> list[bytes]:
        return [ids[s:e].tobytes() for _, _, ids, at in self.blocks(pa.array(texts, pa.string())) for s, e in zip(at[:-1], at[1:])]

    def ended(self, column: pa.Array, end_id: int):
        """blocks() with end_id behind each text's ids."""
        for a, b, ids, at in self.blocks(column):
            out = np.empty(len(ids) + b - a, dtype=self.dtype)
            place = np.arange(len(ids)) + np.repeat(np.arange(b - a), np.diff(at))
            out[place], out[at[1:] + np.arange(b - a)] = ids, end_id
            yield a, b, out, at + np.arange(b - a + 1)

    def counts(self, column: pa.Array) -> np.ndarray:
        """Ids of each text."""
        parts = [np.diff(at) for _, _, _, at in self.blocks(column)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def as_binary(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Arrow binary column of the ids in each range."""
    offsets = at * ids.dtype.itemsize
    kind, wide = (pa.large_binary(), np.int64) if offsets[-1] >= 1 << 31 else (pa.binary(), np.int32)
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(offsets.astype(wide).tobytes()), pa.py_buffer(ids.tobytes())])


@lru_cache(maxsize=1)
def encoder(path: str, spaces: str) -> WordEncoder:
    """One for each worker process, which keeps its words from task to task."""
    return WordEncoder(path, spaces)
