"""Token ids of whole texts, a piece at a time.

A byte-level BPE never merges across its pre-tokens, and a pre-token never
starts inside a word nor swallows a single space or line end before one.  So a
text without two white-space characters in a row is the concatenation of its
lines' words (each with its leading space) and line ends, and each distinct
piece needs to be encoded once per worker.  Texts with such runs go to the
tokenizer whole, and so do texts that hold the string of one of its added tokens
("<|endoftext|>"), unless these are to be read as ordinary text.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUNS = r"[\s\x0b\x{85}\p{Z}]{2}"
MARKS = ".,;:!?%&$*#|\"')]}"
TAIL = "(?P<tail>[" + re.escape(MARKS) + "]+)$"
KEPT_PIECES = 300_000  # pieces a worker remembers at most
KEPT_IDS = 1 << 23  # ids of pieces and of the marked words of single batches
_encoders: dict[tuple, "Encoder"] = {}


def encoder(path: str, end: int, ordinary: bool = False) -> "Encoder":
    """The worker's encoder for a tokenizer file and an end-of-document id.

    ``ordinary``: the strings of added tokens in a text are text like any other, so
    that no id of a text can be taken for a mark.
    """
    if (path, end, ordinary) not in _encoders:
        _encoders[path, end, ordinary] = Encoder(path, end, ordinary)
    return _encoders[path, end, ordinary]


class Encoder:
    def __init__(self, path: str, end: int, ordinary: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (ordinary and t.special)]
        self.added = "|".join(re.escape(t) for t in added if t)
        self.end = end
        self.newline = self._whole(["\n"])[0]
        self._clear()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat = np.empty(1 << 20, np.uint32)
        self.start = np.empty(1 << 18, np.int64)
        self.length = np.empty(1 << 18, np.int64)
        self.used = 0
        self.n = 0
        first = [[], self.newline, [self.end]]  # no piece, a line end, a document's end
        self._append(np.array(sum(first, []), np.uint32), np.array([len(x) for x in first]))
        self.rows[""] = 0

    def _forget(self) -> None:
        """Keep the half of the pieces that was learned first: frequent words come early."""
        kept = dict(islice(self.rows.items(), KEPT_PIECES // 2))
        self.n = max(3, max(kept.values()) + 1)
        self.used = int(self.start[self.n - 1] + self.length[self.n - 1])
        if self.used > KEPT_IDS // 2:
            self._clear()
        else:
            self.rows = kept

    def _append(self, ids: np.ndarray, length: np.ndarray, gap: int = 0) -> np.ndarray:
        """New rows of so many ids each, ``gap`` ids apart; returns their numbers."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(length) > len(self.start):
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.length = np.concatenate([self.length, np.empty_like(self.length)])
        at = np.arange(self.n, self.n + len(length))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[at] = self.used + np.cumsum(length + gap) - length - gap
        self.length[at] = length
        self.used += len(ids)
        self.n += len(length)
        return at

    def _ids(self, rows: np.ndarray) -> np.ndarray:
        """The ids of rows, one after the other."""
        size = self.length[rows]
        upto = np.cumsum(size)
        return self.flat[np.repeat(self.start[rows] - (upto - size), size) + np.arange(upto[-1])]

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces not seen before, joined by line ends, and remember them."""
        odd = [p for p in pieces if p[-1].isspace()]
        plain = [p for p in pieces if not p[-1].isspace()]
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids = np.array(self._whole(["\n".join(part) + "\n"])[0], np.uint32)
            cuts = np.flatnonzero(ids == self.newline[-1])
            if len(self.newline) == 1 and len(cuts) == len(part):
                at = self._append(ids, np.diff(cuts, prepend=-1) - 1, gap=1)
                self.rows.update(zip(part, at.tolist(), strict=True))
            else:
                odd += part
        if odd:
            each = self._whole(odd)
            at = self._append(np.array(sum(each, []), np.uint32), np.array([len(x) for x in each]))
            self.rows.update(zip(odd, at.tolist(), strict=True))

    def _rows(self, pieces: list[str]) -> np.ndarray:
        """The rows of distinct pieces; new ones are learned."""
        get = self.rows.get
        out = np.array([get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(out < 0).tolist()
        if new:
            self._learn([pieces[i] for i in new])
            out[new] = [self.rows[pieces[i]] for i in new]
        return out

    def _lookup(self, words: pa.Array, lead: str) -> np.ndarray:
        """The rows of distinct words, each with ``lead`` before it.  A word and the marks after it are two pre-tokens, remembered apart."""
        base = pc.utf8_rtrim(words, characters=MARKS)
        base = pc.if_else(pc.match_substring_regex(base, r"[\p{L}\p{N}]$"), base, words)
        coded = base.dictionary_encode()
        out = self._rows([lead + w for w in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
        marked = np.flatnonzero(pc.binary_length(words).to_numpy() > pc.binary_length(base).to_numpy())
        if len(marked):  # rows for this batch alone
            at = pa.array(marked)
            tails = pc.struct_field(pc.extract_regex(words.take(at), TAIL), "tail").dictionary_encode()
            both = np.stack([out[marked], self._rows(tails.dictionary.to_pylist())[tails.indices.to_numpy()]], 1)
            out[marked] = self._append(self._ids(both.ravel()), self.length[both].sum(1))
        return out

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lines = pc.split_pattern(texts, "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        per_doc = pc.list_value_length(lines).to_numpy().astype(np.int64)
        per_line = pc.list_value_length(words).to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        if len(self.rows) > KEPT_PIECES or self.used > KEPT_IDS:
            self._forget()
        ends = np.cumsum(per_line)
        begins = ends - per_line  # every line has a first word, maybe empty: it has no leading space
        inner = np.ones(len(codes), bool)
        inner[begins] = False
        rows = np.empty(len(codes), np.int64)
        for mask, lead in ((inner, " "), (~inner, "")):
            here = np.zeros(len(distinct), bool)
            here[codes[mask]] = True
            which = np.flatnonzero(here)
            table = np.zeros(len(distinct), np.int64)
            table[which] = self._lookup(distinct.take(pa.array(which)), lead)
            rows[mask] = table[codes[mask]]
        # words in order, each line closed by its line end or the document's end
        line = np.arange(len(per_line))
        seq = np.empty(len(codes) + len(line), np.int64)
        seq[np.arange(len(codes)) + np.repeat(line, per_line)] = rows
        close = np.ones(len(line), np.int64)
        last = np.cumsum(per_doc) - 1
        close[last] = 2
        closes = ends + line
        seq[closes] = close
        upto = np.cumsum(self.length[seq])
        return self._ids(seq), np.diff(upto[closes[last]], prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id, and the number of ids of each text."""
        if len(texts) == 0:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        whole = pc.match_substring_regex(texts, f"{RUNS}|{self.added}" if self.added else RUNS).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._by_pieces(texts)
        parts: list = [None] * len(texts)
        at = np.flatnonzero(whole)
        for i, ids in zip(at, self._whole(texts.take(pa.array(at)).to_pylist()), strict=True):
            parts[i] = np.array([*ids, self.end], np.uint32)
        rest = np.flatnonzero(~whole)
        if len(rest):
            ids, n = self._by_pieces(texts.take(pa.array(rest)))
            for i, x in zip(rest, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                parts[i] = x
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
