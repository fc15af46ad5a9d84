"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

A word is encoded left to right. An Aho-Corasick automaton over all tokens gives the longest token that
starts at each place. It is taken if it may stand behind the token before it: two tokens fit if merging
their joint text keeps the cut between them, which is decided by taking both apart along the merges and kept
in a table. If it doesn't fit, the next shorter token that is its prefix is tried, and if none fits the token
before it is given up and its end marked, so every place is left at most once. The result is that of the
merges applied by rank, in time linear in the word.

Normal form and word split are those of the tokenizer file. Texts of ASCII and Latin-1 letters are split by
an equal pattern; others go through the file's own normalizer and splitter. Added tokens are cut out first.

Memory of a task: the tables, the remembered words, and a text with its ids; rows leave in batches of
bounded size. A null text counts as empty, repeated rows get equal answers, an empty table an empty one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Words whose ids one worker remembers, with and without the marks at them (about 250 bytes each), their longest
#: length, and token pairs in the table of pairs.
REMEMBERED, LONGEST, PAIRS = 240_000, 64, 500_000
#: Bytes of values after which a batch leaves the task.
BATCH = 4 << 20
#: Stands for the end of a word; no byte of a text is written so.
END = "\n"

_WORKER: dict[str, Encoder] = {}


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


class PairTable:
    """Which tokens may follow which. Tokens are numbered: letters first, then merges by rank."""

    def __init__(self, left: list[int], right: list[int], merged: dict[tuple[int, int], int]) -> None:
        self.left, self.right, self.merged, self.known = left, right, merged, {}

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            found = self.known[key] = self.cut_stays(a, b, len(self.left) + 1)
        return found

    def cut_stays(self, a: int, b: int, undone: int) -> bool:
        """Whether no merge across the cut of a and b comes before the merges that made the tokens at it.

        The later of the two last merges is undone first. A merge over the cut wins if its rank is lower
        than what was undone, at first ``undone``; of one rank the one further left is made first, so right
        parts count one more.
        """
        while self.merged.get((a, b), undone) >= undone:
            inner, outer = self.right[a], self.left[b]
            if inner == a and outer == b:
                return True
            if inner != a and (a > b or outer == b):
                undone, a = a, inner
            else:
                undone, b = b + 1, outer
        return False


class OffsetTable:
    """Texts of numbers in one block of bytes; numbers are decoded by copying their slices."""

    def __init__(self, texts: list[bytes | None]) -> None:
        self.size = np.array([len(t) if t is not None else 0 for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.block = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
        self.known = np.array([t is not None for t in texts], bool)

    def concat(self, ids: np.ndarray) -> bytes:
        """The texts of ``ids`` one after another; numbers without a text are left out."""
        out = []
        for lo in range(0, len(ids), 1 << 18):
            part = ids[lo : lo + (1 << 18)]
            part = part[(part >= 0) & (part < len(self.size))]
            part = part[self.known[part]]
            size = self.size[part]
            first = np.cumsum(size) - size
            out.append(self.block[np.arange(size.sum()) + np.repeat(self.start[part] - first, size)].tobytes())
        return b"".join(out)


class _Memory(dict):
    """Ids of words met lately: what isn't met again between two turns is forgotten at the second."""

    older: dict[str, bytes] = {}

    def at(self, key: str, make: Callable[[str], bytes]) -> bytes:
        found = self.get(key) or self.older.get(key)
        if found is None:
            found = make(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Encoder and decoder of one tokenizer file with word ends and a byte-level alphabet."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        suffix, self.ids = model["end_of_word_suffix"] or "", model["vocab"]
        if not suffix or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("expects plain BPE with word ends")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("expects added tokens that are matched as they stand")
        whole = Tokenizer.from_file(path)
        self.normalize, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.letters = byte_letters()
        self.added = {t["content"]: t["id"] for t in added}
        # of added tokens that open alike the longest is read
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.odd = re.compile(r"[^\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]").search
        self.words = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+").findall
        self._build(suffix, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        texts: list[bytes | None] = [None] * (max([*self.ids.values(), *self.added.values()], default=-1) + 1)
        for t, i in (self.ids | self.added).items():
            texts[i] = t.encode() + b" "
        self.texts = OffsetTable(texts)
        self.known, self.pieces = _Memory(), _Memory()

    def _build(self, suffix: str, merges: list[tuple[str, str]]) -> None:
        made = {a + b for a, b in merges}
        number: dict[str, int] = {}
        forms: list[str] = []
        for t in (t for c in self.letters for t in (c, c + suffix)):
            if t not in self.ids or t in made:
                raise ValueError("expects a token for every byte, inside and at the end of a word")
            number[t] = len(forms)
            forms.append(t if len(t) == 1 else t[0] + END)
        left, right, merged = list(range(len(forms))), list(range(len(forms))), {}
        for a, b in merges:
            if a + b in number:
                raise ValueError("expects one merge for each token")
            merged[number[a], number[b]] = number[a + b] = len(forms)
            left.append(number[a])
            right.append(number[b])
            forms.append(forms[number[a]] + forms[number[b]])
        self.pairs = PairTable(left, right, merged)
        # a token whose own text is merged into others never comes out; its halves then don't fit
        alive: list[bool] = []
        for t in range(len(forms)):
            a, b = left[t], right[t]
            alive.append(a == t or alive[a] and alive[b] and self.pairs.cut_stays(a, b, t))
        self.id_of = np.array([self.ids[t] for t in number], "<u4")
        self.size = [len(f) for f in forms]
        at = {f: t for t, f in enumerate(forms) if alive[t]}
        self.shorter = [next((at[f[:k]] for k in range(len(f) - 1, 0, -1) if f[:k] in at), -1) for f in forms]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for f, t in at.items():
            self.automaton.add_word(f, t)
        self.automaton.make_automaton()

    def word(self, form: str) -> list[int]:
        """Token numbers of one word, given in byte letters with END behind it.

        The automaton runs on along its longest matches, and anew from a place where another token was taken.
        """
        size, shorter, pairs, search = self.size, self.shorter, self.pairs, self.automaton.iter_long
        known, fits, n = pairs.known, pairs.fits, len(form)
        dead = bytearray(n + 1)
        dead[n - 1] = 1  # END isn't a token of its own
        out, at, last = [], 0, -1
        longest = search(form)
        token = next(longest)[1]
        while True:
            first = token
            while token >= 0:
                if not dead[at + size[token]]:
                    fit = last < 0 or known.get(last << 32 | token)
                    if fit or fit is None and fits(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                last = token
                if at == n:
                    return out
                if token != first or longest is None:
                    longest = search(form, at)
                token = next(longest)[1]
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                longest = None

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        out = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                out += self._plain(part)
        return b"".join(out)

    def _plain(self, text: str) -> list[bytes]:
        if self.odd(text):
            return [self._ids(p) for p, _ in self.split(self.normalize(text))]
        words = text.lower().split()  # no piece holds a blank
        ids = list(map(self.known.get, words))
        if None in ids:
            for i, x in enumerate(ids):
                if x is None:
                    ids[i] = self.known.at(words[i], self._spelled)
        return ids

    def _spelled(self, word: str) -> bytes:
        """Ids of a word with the marks at it."""
        return b"".join([self.pieces.at(p, self._piece) for p in self.words(word)])

    def _piece(self, piece: str) -> bytes:
        # printable ASCII letters stand for themselves
        return self._ids(piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()]))

    def _ids(self, form: str) -> bytes:
        """Ids of a piece in byte letters."""
        return self.id_of[self.word(form + END)].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids; the file names no decoder, so tokens are joined by blanks. Unknown ids are left out."""
        return self.texts.concat(ids)[:-1]


def encoder(path: str) -> Encoder:
    """The encoder of this worker process; built once."""
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` without ``text``, with the ids (array<int>) of the whole text instead; a null text has none.

    With ``decoded`` a column of that name holds the text that the ids decode to, made in the same pass.
    ``tokenizer_path`` must be readable on the executors. Columns already named so are replaced.
    """
    added = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    kept = [c for c in docs.columns if c not in (text, out, decoded)]

    def values(tok: Encoder, column: pa.Array) -> Iterator[tuple[int, tuple]]:
        for t in column:
            ids = np.frombuffer(tok.encode(t.as_py() or ""), "<i4")
            row = (ids, tok.decode(ids).decode()) if decoded else (ids,)
            yield ids.nbytes + len(row[-1]), row

    return _mapped(docs.select(*kept, docs[text].alias(text)), values, added, kept, tokenizer_path)


def decode(rows: DataFrame, tokenizer_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids`` added; null or no ids give an empty text."""
    kept = [c for c in rows.columns if c not in (ids, out)]

    def values(tok: Encoder, column: pa.Array) -> Iterator[tuple[int, tuple]]:
        for x in column:
            text = tok.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b""
            yield len(text), (text.decode(),)

    return _mapped(rows.select(*kept, ids), values, [T.StructField(out, T.StringType())], [*kept, ids], tokenizer_path)


def _mapped(rows: DataFrame, values: Callable, added: list[T.StructField], kept: list[str], tokenizer_path: str) -> DataFrame:
    """Columns ``kept`` of ``rows`` and those that ``values`` makes of the last column; batches are cut where these grow large."""
    kinds = [to_arrow_type(f.dataType) for f in added]
    names = [*kept, *(f.name for f in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer_path)
        for b in batches:
            lo, held, weight = 0, [], 0
            for size, row in values(tok, b.column(b.num_columns - 1)):
                held.append(row)
                weight += size
                if weight >= BATCH or lo + len(held) == b.num_rows:
                    columns = [pa.array(c, k) for c, k in zip(zip(*held), kinds)]
                    yield pa.RecordBatch.from_arrays([*b.select(kept).slice(lo, len(held)).columns, *columns], names=names)
                    lo, held, weight = lo + len(held), [], 0

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), *added]))
