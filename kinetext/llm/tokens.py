"""Exact tokenisation at the speed of a dictionary: texts are cut at places that no token crosses, and each distinct piece is encoded once."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from kinetext.llm.common import caches, runs_of_rows, texts_of
from kinetext.llm.merges import LONGEST, SHOWN, merges_of

#: Pieces kept per Python worker before the cache starts anew (about 200 bytes each).
CACHE = 900_000
#: Runs of letters that are merged as one pre-token where that changes nothing.
RUNS = 32
#: Bytes of text that are cut and numbered at a time for byte-level vocabularies.
AT_ONCE = 4 << 20


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=8)
def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


#: Line feeds stay, to part runs.
_SHOWN = SHOWN | {10: "\n"}


@lru_cache(maxsize=8)
def bare_tokenizer(path: str):
    """The vocabulary's merges alone, on runs parted by line feeds; a control character's form that no longer token holds; its id."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    t = load(path)
    bare = Tokenizer(t.model)
    bare.pre_tokenizer = CharDelimiterSplit("\n")
    if hasattr(bare.model, "_resize_cache"):  # runs come once: the library's cache of words only costs time
        bare.model._resize_cache(0)
    vocab = t.get_vocab()
    for b in [0x7F, *range(1, 9), *range(14, 28)]:
        shown = _SHOWN[b]
        ids = bare.encode(shown, add_special_tokens=False).ids
        if len(ids) == 1 and all(n in (shown, shown + "</w>") for n in vocab if shown in n):
            return bare, shown, ids[0]
    raise ValueError("the vocabulary has no separate control character")


class _Index(dict):
    """Numbers pieces in the order of their first sight; new ones wait in ``pending``."""

    pending: list[str]

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.pending.append(piece)
        return n


class PieceEncoder:
    """Gives the ids of a text as little-endian bytes, equal to encoding the whole text at once.

    ``kind`` "word" is for vocabularies whose pre-tokenizer drops white space: any space parts two independent pieces.
    ``kind`` "byte" is for byte-level ones, whose texts are cut as UTF-8 bytes where ``_cuts`` says; Arrow's hash table finds
    the distinct pieces of ``AT_ONCE`` bytes, so that only these are looked up one by one.

    A worker keeps the pieces that it has met (about ``most``) as numbers into one array of ids.
    """

    def __init__(self, path: str, kind: str, width: str = "<u4", most: int = CACHE):
        self.most = most
        self.path, self.tok, self.kind, self.width = path, load(path), kind, width
        self.kept = caches.setdefault((path, kind, width), {})
        if not self.kept:
            self._empty()

    def _empty(self) -> None:
        index = _Index()
        index.pending = []
        self.kept |= {"index": index, "ids": np.zeros(0, self.width), "starts": np.zeros(0, np.int64), "sizes": np.zeros(0, np.int32)}

    def pieces(self, text: str) -> list[str]:
        try:  # lower-casing Latin-1 is what the tokenizer does to it; fewer distinct pieces
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return text.replace("\n", " ").split(" ")

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return self._resting(self._encode_many, texts) if self.kind == "word" else self.encode_column(pa.array(texts, pa.large_string()))

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """As ``encode_many``, of a column of strings; nulls are empty."""
        if self.kind == "word":
            return self.encode_many([t or "" for t in column.to_pylist()])
        buf, off = texts_of(column)
        out: list[bytes] = []
        for i, j in runs_of_rows(off, AT_ONCE):
            out += self._resting(self._encode_rows, buf[off[i] : off[j]], off[i : j + 1] - off[i])
        return out

    @staticmethod
    def _resting(encode: Callable[..., list[bytes]], *args) -> list[bytes]:
        on = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and each collection walks through all pieces
        try:
            return encode(*args)
        finally:
            if on:
                gc.enable()

    def _encode_many(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        numbers: list[np.ndarray] = []
        size = 0
        if len(self.kept["index"]) > self.most:
            self._empty()
        get = self.kept["index"].__getitem__
        for t in texts:
            p = self.pieces(t) if t else []
            numbers.append(np.fromiter(map(get, p), np.int64, len(p)))
            size += len(p)
            if size > 400_000:
                out += self._flush(numbers)
                numbers, size = [], 0
                if len(self.kept["index"]) > self.most:
                    self._empty()
                    get = self.kept["index"].__getitem__
        return out + self._flush(numbers)

    def _encode_rows(self, raw: np.ndarray, off: np.ndarray) -> list[bytes]:
        if not len(raw):
            return [b""] * (len(off) - 1)
        if len(self.kept["index"]) > self.most or len(self.kept["ids"]) > 16 * self.most:
            self._empty()
        at = _cuts(raw, off)
        found = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
        words = found.dictionary.to_pylist()
        index = self.kept["index"]
        number = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        if index.pending:
            self._learn_bytes(index.pending)
            index.pending = []
        return self._ids(number, found.indices.to_numpy(), np.searchsorted(at, off))

    def _flush(self, numbers: list[np.ndarray]) -> list[bytes]:
        if not numbers:
            return []
        index = self.kept["index"]
        if index.pending:
            self._learn(index.pending)
            index.pending = []
        at = np.concatenate(numbers)
        return self._ids(at, slice(None), np.concatenate([[0], np.cumsum([len(x) for x in numbers])]))

    def _ids(self, number: np.ndarray, which: np.ndarray | slice, parts: np.ndarray) -> list[bytes]:
        """The ids of the pieces ``number[which]``, parted at the places ``parts`` among these."""
        n = self.kept["sizes"][number][which]
        ends = np.cumsum(n, dtype=np.int64)
        place = np.repeat((self.kept["starts"][number][which] - ends + n).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        data = self.kept["ids"][place].tobytes()
        width = self.kept["ids"].itemsize
        first = np.concatenate([[0], ends])[parts] * width
        return [data[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def _learn(self, pieces: list[str]) -> None:
        """Encodes unknown pieces. Most are a run of letters, with punctuation behind it: each of these is parted
        from the others by the pre-tokenizer, and here; the run goes straight to the vocabulary's merges, many at a time.
        All other pieces take the whole way."""
        k, old = self.kept, len(self.kept["starts"])
        have = k["index"].get
        got: dict[str, bytes] = {}
        cores: dict[str, None] = {}
        marks: dict[str, None] = {}
        parted, alone = [], []
        for p in pieces:
            run = p.rstrip(".,!?;:")
            tail = p[len(run) :]
            if run.isalpha() and len(run) < 200 and run.islower() and (run.isascii() or max(run) < "\u0250"):
                at = have(run, old) if tail else old
                if at < old:
                    got[run] = k["ids"][k["starts"][at] : k["starts"][at] + k["sizes"][at]].tobytes()
                else:
                    cores[run] = None
                if tail:
                    parted.append((p, run, tail))
                    marks[tail] = None
            else:
                alone.append(p)
        self._whole(alone, got)
        self._whole([m for m in marks if m not in got], got)
        self._merge(list(cores), got)
        for p, run, tail in parted:
            got[p] = got[run] + got[tail]
        self._add([got[p] for p in pieces])

    def _learn_bytes(self, pieces: list[bytes]) -> None:
        """As ``_learn``: short runs of letters, with a space before them or not, are merged side by side, all else takes the whole way."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes) - sizes
        other = _classes(raw) != _LETTER
        other[starts[(raw[starts] == 32) & (sizes > 1)]] = False
        merges = merges_of(self.path)
        run = (np.add.reduceat(other, starts, dtype=np.int64) == 0) & (sizes <= LONGEST) & (merges is not None)
        rest, own = np.flatnonzero(~run), np.flatnonzero(run)
        texts = [pieces[k].decode() for k in rest.tolist()]
        got: dict[str, bytes] = {}
        self._whole(texts, got)
        if not len(own):
            self._add([got[t] for t in texts])
            return
        order, n, ids = merges.ids(raw, starts[own], sizes[own])
        places = np.argsort(np.concatenate([rest, own[order]]))
        self._add([got[t] for t in texts], n, ids, places)

    def _add(self, new: list[bytes], n: np.ndarray | None = None, ids: np.ndarray | None = None, places: np.ndarray | slice = slice(None)) -> None:
        """Appends the ids of new pieces, those of ``new`` and then the ``n`` each of ``ids``; ``places``: where the pieces are among these."""
        k = self.kept
        sizes = np.fromiter(map(len, new), np.int64, len(new)) // k["ids"].itemsize
        parts = [k["ids"], np.frombuffer(b"".join(new), self.width)]
        if n is not None:
            sizes = np.concatenate([sizes, n])
            parts.append(ids.astype(self.width))
        k["starts"] = np.concatenate([k["starts"], (len(k["ids"]) + np.cumsum(sizes) - sizes)[places]])
        k["sizes"] = np.concatenate([k["sizes"], sizes[places].astype(np.int32)])
        k["ids"] = np.concatenate(parts)

    def _whole(self, pieces: list[str], got: dict[str, bytes]) -> None:
        for a in range(0, len(pieces), 20000):
            part = pieces[a : a + 20000]
            for p, enc in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                got[p] = np.asarray(enc.ids, self.width).tobytes()

    def _merge(self, runs: list[str], got: dict[str, bytes]) -> None:
        """Runs of letters, joined by a mark that no merge touches and parted again at its id. Where the vocabulary treats the ends of a
        pre-token like its middle, several runs make one, as merges on either side of a mark don't see each other; else each run is one."""
        bare, mark, mark_id = bare_tokenizer(self.path)
        m = bare.model
        many = 1 if m.end_of_word_suffix or m.continuing_subword_prefix or m.ignore_merges or m.dropout else RUNS
        parting = f"\n{mark}\n" if many == 1 else f"{mark}\n"
        for a in range(0, len(runs), 4000):
            part = runs[a : a + 4000]
            shown = "\n".join(part).encode().decode("latin-1").translate(_SHOWN).split("\n")
            shown = shown if many == 1 else [mark.join(shown[b : b + many]) for b in range(0, len(shown), many)]
            ids = np.asarray(bare.encode_batch_fast([parting.join(shown)], add_special_tokens=False)[0].ids, self.width)
            ends = np.append(np.flatnonzero(ids == mark_id), len(ids))
            size, data, at = ids.itemsize, ids.tobytes(), 0
            for p, end in zip(part, ends.tolist(), strict=True):
                got[p] = data[at * size : end * size]
                at = end + 1


_SPACE, _LETTER, _DIGIT, _MARK, _UNSURE = range(5)
#: What a byte of UTF-8 belongs to. Two bytes from C3 on are letters up to U+023F, but for two signs; what else isn't ASCII, and control
#: characters, stay unsure.
_CLASS = np.full(256, _UNSURE, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[32, 10]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = _LETTER


def _classes(raw: np.ndarray) -> np.ndarray:
    out = _CLASS[raw]
    if raw.max() >= 0x80:
        signs = np.flatnonzero(raw[:-1] == 0xC3)
        signs = signs[(raw[signs + 1] == 0x97) | (raw[signs + 1] == 0xB7)]
        out[signs] = out[signs + 1] = _UNSURE
        lead = np.flatnonzero((out == _UNSURE) & (raw > 0xC0))  # the bytes that follow belong to it
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            at = lead[raw[lead] >= least] + k
            at = at[at < len(raw)]
            out[at[raw[at] & 0xC0 == 0x80]] = _UNSURE
    return out


def _cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where the byte-level pre-tokenizer parts texts, whatever stands before and behind; the texts' own bounds are among them.

    Its pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Letters, digits, marks and white space
    are parted from what follows if that is of another class, but for white space, which may lead a token, and an apostrophe before a letter.
    A line feed alone between others is parted from both. No cut touches a character whose class is unsure.
    """
    kind = _classes(raw)
    a, b = kind[:-1], kind[1:]
    cut = np.ones(len(raw) + 1, bool)
    inner = cut[1:-1]
    np.not_equal(a, b, out=inner)
    inner &= (a != _SPACE) & (a != _UNSURE) & (b != _UNSURE)
    inner &= (raw[:-1] != 39) | (b != _LETTER)
    alone = (raw[:-1] == 10) & (b != _SPACE) & (b != _UNSURE)
    alone[1:] &= (kind[:-2] != _SPACE) & (kind[:-2] != _UNSURE)
    inner |= alone
    cut[starts] = True
    return np.flatnonzero(cut)
