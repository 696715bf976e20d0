"""Token counts by a compiled finite-state transducer.

A byte-pair encoding of a prefix ends in one token, and which token that is depends only on the last
tokens of shorter prefixes within reach of the longest token (Berglund and van der Merwe, "Formalizing BPE
tokenization"). So a word is read symbol by symbol by a finite machine: a state holds the longest suffix
read so far that begins some token, with the last token and the relative token count at each cut of it. A
transition carries the change of the token count; the sum along a text is its number of tokens. Symbols
are bytes, doubled to tell a word's last byte. States and transitions are compiled when first met.

A pass over many texts is one stream of symbols in chunks of equal length. Every chunk's state map is
"run the symbols before the first word start from whatever state comes in; then a fixed exit state", as
each word starts anew. All fixed parts are run side by side, one numpy step per column; then a scan over
the chunks composes the maps, feeding each exit state into the next chunk's head.

A very long word (over LONG symbols, such as base64) has no fixed parts and brings out a new state at nearly every
symbol. It is read by the same recurrence without compiled states: the state is the window of last tokens in reach.
All chunks of it run side by side, each from the state that the WARM symbols before it lead to, as such states soon
coincide. Then the maps are composed: where a chunk's entry isn't its predecessor's exit, the chunk runs again from
that, all such chunks at once, until the chain holds; what a chunk has run from is kept, so none runs twice from one state.

What a code point is (white space, letter, number or other), and which code points Python normalises as the tokenizer's own library
does, is asked of that library, once in the driver. A text with any other code point, such as one that is newer than the worker's Python, is
normalised by the library.

Texts: null counts as empty and has no tokens. Any length of text or word is taken whole. Rows that repeat
are counted alike each time. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from procloom.llm import shared

CHUNK = 512
#: Symbols from which a word is read without compiled states, its symbols at a time, and the symbols that a chunk reads ahead of its own.
LONG, BLOCK, WARM = 4096, 1 << 20, 64
#: Cells (states times symbols) after which a worker's table starts afresh, which bounds its memory to about 400 MB.
MOST_CELLS = 1 << 25
#: Pairs of tokens after which what is known of pairs starts afresh (some 16 MB, and as much again for the compiled states).
MOST_FITS = 1 << 20
_END = "\0"
_OTHER, _SPACE, _LETTER, _NUMBER = range(4)


def byte_symbols() -> list[str]:
    """The printable stand-ins that byte-level vocabularies use, by byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@cache
def classes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """By code point: its kind, and whether the tokenizer must normalise texts that hold it, as the library has it."""
    from tokenizers import Regex, Tokenizer, normalizers

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    text = points.tobytes().decode("utf-32-le")
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern, mark in ((_NUMBER, r"\p{N}", "1"), (_LETTER, r"\p{L}", "a"), (_SPACE, r"\s", " ")):
        marked = normalizers.Replace(Regex(pattern), mark).normalize_str(text)
        kinds[points[np.frombuffer(marked.encode("utf-32-le"), np.uint32) == ord(mark)]] = kind
    odd = np.zeros(0x110000, bool)
    own = Tokenizer.from_file(path).normalizer.normalize_str("|".join(text.replace("|", "")))
    for c, found in zip(text.replace("|", ""), own.split("|"), strict=True):
        odd[ord(c)] = found != normal(c) and kinds[ord(c)] != _SPACE or unicodedata.category(c) == "Cn"
    return kinds, odd


def normal(text: str) -> str:
    """Python's composition and small letters, without a rule for a sigma at a word's end."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


class Transducer:
    """The machine for one vocabulary of byte pairs with word ends."""

    def __init__(self, path: str, told: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        from tokenizers import Tokenizer

        self.kinds, self.odd = told or classes(path)
        self.normalizer = Tokenizer.from_file(path).normalizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        end = spec["model"]["end_of_word_suffix"]
        plain = lambda t: t[: -len(end)] + _END if t.endswith(end) else t
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.token = {plain(t): i for t, i in spec["model"]["vocab"].items()}
        self.text = {i: t for t, i in self.token.items()}
        self.rank = {(plain(a), plain(b)): k for k, (a, b) in enumerate(spec["model"]["merges"])}
        self.begins = {t[:k] for t in self.token for k in range(1, len(t))}
        self.symbols = byte_symbols()
        byte = {c: b for b, c in enumerate(self.symbols)}
        self.length = np.array([len(self.text.get(i, "").replace(_END, "")) for i in range(max(self.text) + 1)])
        self.longest = int(self.length.max())
        self.final = {bytes(byte[c] for c in t[:-1]): i for t, i in self.token.items() if t.endswith(_END) and all(c in byte for c in t[:-1])}
        inner: dict[int, list[tuple[bytes, int]]] = {}
        for t, i in self.token.items():
            if not t.endswith(_END) and all(c in byte for c in t):
                inner.setdefault(len(t), []).append((bytes(byte[c] for c in t), i))
        self.inner = {}  # by length: hashes of tokens within a word, ascending, and their ids
        for n, found in inner.items():
            h = shared.hashes(np.frombuffer(b"".join(b for b, _ in found), np.uint8), np.arange(0, n * len(found), n), np.arange(n, n * len(found) + 1, n))
            order = np.argsort(h)
            self.inner[n] = h[order], np.array([i for _, i in found], np.int32)[order]
        self.reset()

    def reset(self) -> None:
        """Only the start state; column 0 of the tables is the symbol that changes nothing."""
        self.column = np.full(512, -1, np.int64)
        self.meaning = [""]
        self.next, self.delta = np.full((1024, 64), -1, np.int32), np.zeros((1024, 64), np.int16)
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.forget()
        self.state(("", (-1,), (0,)))

    def state(self, key: tuple) -> int:
        if key not in self.number:
            k = self.number[key] = len(self.states)
            self.states.append(key)
            if k == len(self.next):
                self.next = np.vstack([self.next, np.full_like(self.next, -1)])
                self.delta = np.vstack([self.delta, np.zeros_like(self.delta)])
            self.next[k, 0] = k
        return self.number[key]

    def merged(self, parts: list[str]) -> list[str]:
        """Byte-pair merging, lowest rank first and leftmost of equals."""
        while len(parts) > 1:
            rank, at = min((self.rank.get(pair, 1 << 60), k) for k, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def forget(self) -> None:
        """Nothing is known of pairs of tokens; column 0 of the table is a pair that isn't."""
        self.fits: dict[tuple[int, int], bool] = {}
        self.pairs, self.pair_fits = np.full(1, -1, np.int64), np.zeros(1, bool)

    def fit(self, before: int, token: int) -> bool:
        """Whether the two tokens stay as they are when they meet; -1 is a word's start."""
        key = (before, token)
        if key not in self.fits:
            whole = [self.text[t] for t in key if t >= 0]
            parts = [c for t in whole for c in t.replace(_END, "")]
            parts[-1] += _END * whole[-1].endswith(_END)
            self.fits[key] = self.merged(parts) == whole
        return self.fits[key]

    def fit_all(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """fit() of many pairs, from a sorted table of pairs."""
        key = (before.astype(np.int64) + 1) << 32 | token.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        new = np.unique(key[self.pairs[at] != key])
        if len(new):
            good = np.array([self.fit((k >> 32) - 1, k & 0xFFFFFFFF) for k in new.tolist()])
            spot = np.searchsorted(self.pairs, new)
            self.pairs, self.pair_fits = np.insert(self.pairs, spot, new), np.insert(self.pair_fits, spot, good)
            at = np.searchsorted(self.pairs, key)
        return self.pair_fits[at]

    def compile(self, state: int, column: int) -> None:
        seen, last, count = self.states[state]
        symbol = self.meaning[column]
        for k in range(len(seen) + 1):
            token = self.token.get(seen[k:] + symbol)
            if token is not None and last[k] > -2 and self.fit(last[k], token):
                break
        else:
            raise ValueError(f"the vocabulary has no token for {symbol!r}")
        delta = count[k] + 1
        if symbol.endswith(_END):
            target = 0
        else:
            seen, last, count = seen + symbol, (*last, token), (*(c - delta for c in count), 0)
            keep = next(n for n in range(len(seen), -1, -1) if not n or seen[-n:] in self.begins)
            seen, last, count = seen[len(seen) - keep :], last[len(last) - keep - 1 :], count[len(count) - keep - 1 :]
            used = [k == keep or seen[k:] in self.begins for k in range(keep + 1)]  # a cut where no token can begin tells nothing
            target = self.state((seen, tuple(t if u else -2 for t, u in zip(last, used)), tuple(c if u else 0 for c, u in zip(count, used))))
        self.next[state, column], self.delta[state, column] = target, delta

    def columns(self, stream: np.ndarray) -> np.ndarray:
        """Table columns of symbols (a byte, plus 256 if it ends a word)."""
        for s in np.flatnonzero(np.bincount(stream, minlength=512) * (self.column < 0)):
            self.column[s] = len(self.meaning)
            self.meaning.append(self.symbols[s & 255] + _END * (s >> 8))
            if len(self.meaning) > self.next.shape[1]:
                self.next = np.hstack([self.next, np.full_like(self.next, -1)])
                self.delta = np.hstack([self.delta, np.zeros_like(self.delta)])
        return self.column[stream]

    def run(self, steps: np.ndarray, states: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Read steps (one row per step, one column per lane) from the given states; counts go to out; the exit states."""
        for step, row in zip(steps, out):
            after = self.next[states, step]
            if (after < 0).any():
                miss = np.flatnonzero(after < 0)
                for s, c in np.unique(np.stack([states[miss], step[miss]]), axis=1).T.tolist():
                    self.compile(s, c)
                after = self.next[states, step]
            row[:] = self.delta[states, step]
            states = after
        return states

    def candidates(self, data: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(length, token that ends at each position or -1), longest first, for lengths of which some token is in data."""
        out = []
        for n in sorted(self.inner, reverse=True):
            h, ids = self.inner[n]
            if n <= len(data):
                own = shared.hashes(data, np.arange(len(data) - n + 1), np.arange(n, len(data) + 1))
                at = np.minimum(np.searchsorted(h, own), len(h) - 1)
                hit = h[at] == own
                if hit.any():
                    told = np.full(len(data), -1, np.int32)
                    told[n - 1 :][hit] = ids[at[hit]]
                    out.append((n, told))
        return out

    def follow(self, choices: list[tuple[int, np.ndarray]], starts: np.ndarray, steps: int, window: np.ndarray, size: int) -> np.ndarray:
        """Last tokens at each of so many positions from starts on, one row a lane, behind its window of last tokens (-1 is a word's start, -2 nothing)."""
        w = window.shape[1]
        last = np.hstack([window, np.full((len(starts), steps), -2, np.int32)])
        for j in range(steps):
            here = starts + j
            open_ = np.flatnonzero(here < size)
            for n, told in choices:
                token, before = told[here[open_]], last[open_, w + j - n] if n <= w + j else np.full(len(open_), -2)
                may = np.flatnonzero((token >= 0) & (before > -2))
                if len(may):
                    good = may[self.fit_all(before[may], token[may])]
                    last[open_[good], w + j] = token[good]
                    open_ = np.delete(open_, good)
                    if not len(open_):
                        break
            if (here[open_] < size).any():
                raise ValueError("the vocabulary lacks a token for a byte")
        return last

    def long_word(self, data: np.ndarray, chunk: int = CHUNK, block: int = BLOCK) -> int:
        """Number of tokens of one word, given by its bytes."""
        w, n = self.longest, len(data)
        tokens = np.zeros(n, np.int32)
        carry = np.full((1, w), -2, np.int32)
        carry[0, -1] = -1
        for base in range(0, n - 1, block):  # all but the word's last byte, whose token bears the end
            stop = min(n - 1, base + block)
            if len(self.fits) > MOST_FITS:
                self.forget()
            lead = min(base, w)  # tokens may begin before the block
            choices = [(k, told[lead:]) for k, told in self.candidates(data[base - lead : stop])]
            size, warm = stop - base, max(WARM, w)
            lanes = -(-size // chunk)
            choices = [(k, np.r_[told, np.full(lanes * chunk - size, -1, np.int32)]) for k, told in choices]  # lanes of one length; what is past the end is cut off
            starts = np.arange(lanes) * chunk
            entry = np.full((lanes, w), -2, np.int32)  # as if a word began there
            entry[:, -1], entry[0] = -1, carry[0]
            late = np.flatnonzero(starts >= warm)
            if len(late):
                entry[late] = self.follow(choices, starts[late] - warm, warm, entry[late], size)[:, -w:]
            known: list[dict[bytes, np.ndarray]] = [{} for _ in range(lanes)]
            todo = np.arange(lanes)
            run = np.zeros((lanes, chunk), np.int32)
            while len(todo):
                new = np.array([k for k in todo.tolist() if entry[k].tobytes() not in known[k]], np.int64)
                if len(new):
                    for k, row in zip(new.tolist(), self.follow(choices, starts[new], chunk, entry[new], size)[:, w:]):
                        known[k][entry[k].tobytes()] = row
                for k in todo.tolist():
                    run[k] = known[k][entry[k].tobytes()]
                exits = np.hstack([entry, run])[:, -w:]
                todo = 1 + np.flatnonzero((entry[1:] != exits[:-1]).any(1))
                entry[todo] = exits[todo - 1]
            tokens[base:stop] = run.reshape(-1)[:size]
            carry = np.hstack([entry, run]).reshape(lanes, -1)[-1:, : w + size - (lanes - 1) * chunk][:, -w:]
        raw = data.tobytes()
        for k in range(min(n, w), 0, -1):
            token = self.final.get(raw[n - k :])
            if token is not None and self.fit(int(tokens[n - k - 1]) if n > k else -1, token):
                break
        else:
            raise ValueError("the vocabulary lacks a token for a last byte")
        count, at, size = 1, n - k, self.length[tokens].tolist()
        while at > 0:
            count, at = count + 1, at - size[at - 1]
        return count

    def counts(self, stream: np.ndarray, chunk: int = CHUNK, long: int = LONG) -> np.ndarray:
        """Change of the token count at each symbol of a stream; that of a long word is told at its last."""
        ends = np.flatnonzero(stream >= 256)
        sizes = np.diff(ends, prepend=-1)
        large = np.flatnonzero(sizes > long)
        if len(large):
            out, rest = np.zeros(len(stream), np.int64), np.ones(len(stream), bool)
            for end, size in zip(ends[large].tolist(), sizes[large].tolist()):
                out[end] = self.long_word((stream[end + 1 - size : end + 1] & 255).astype(np.uint8), chunk)
                rest[end + 1 - size : end + 1] = False
            out[rest] = self.counts(stream[rest], chunk, long)
            return out
        n = len(stream)
        if not n:
            return np.zeros(0, np.int64)
        if len(self.states) * self.next.shape[1] > MOST_CELLS:
            self.reset()
        lanes = -(-n // chunk)
        columns = np.zeros(lanes * chunk, np.int64)
        columns[:n] = self.columns(stream)
        fresh = np.ones(lanes * chunk, bool)  # positions where a word starts
        fresh[1:n] = stream[: n - 1] >= 256
        fresh = fresh.reshape(lanes, chunk)
        head = np.where(fresh.any(1), fresh.argmax(1), chunk)
        at = np.arange(chunk)[:, None]
        steps = np.ascontiguousarray(columns.reshape(lanes, chunk).T)
        out = np.zeros((chunk, lanes), np.int32)
        exits = self.run(np.where(at >= head, steps, 0), np.zeros(lanes, np.int64), out)
        wait = np.flatnonzero(head > 0)
        known = head < chunk
        while len(wait):  # each round composes every map whose predecessor's exit state is known
            now = wait[known[wait - 1]]
            depth = int(head[now].max())
            part = np.zeros((depth, len(now)), np.int32)
            left = self.run(np.where(at[:depth] < head[now], steps[:depth, now], 0), exits[now - 1].astype(np.int64), part)
            out[:depth, now] += part
            whole = head[now] == chunk
            exits[now[whole]] = left[whole]
            known[now] = True
            wait = wait[~np.isin(wait, now)]
        return out.T.reshape(-1)[:n].astype(np.int64)

    def normal(self, text: str, odd: bool) -> str:
        if odd and self.odd[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
            return self.normalizer.normalize_str(text)
        return normal(text)

    def symbols_of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of normalised text, and the code point that each belongs to. White space gives none."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[points]
        start = np.ones(len(points), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        quote = np.flatnonzero((points == 39) & start)  # a contraction only at the start of a run
        after = np.zeros((2, len(points)), np.uint32)
        after[0, :-1], after[1, :-2] = points[1:], points[2:]
        one = quote[np.isin(after[0, quote], [ord(c) for c in "stmd"])]
        pair = after[0, quote].astype(np.int64) << 32 | after[1, quote]
        two = quote[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
        start[np.r_[one, two] + 1] = False
        for found, length in ((one, 2), (two, 3)):
            start[(found + length)[found + length < len(points)]] = True
        ends = np.ones(len(points), bool)
        ends[:-1] = start[1:]
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        lead = (data & 0xC0) != 0x80
        point = np.cumsum(lead) - 1
        final = np.ones(len(data), bool)
        final[:-1] = lead[1:]
        keep = kind[point] != _SPACE
        return (data + 256 * (ends[point] & final).astype(np.int64))[keep], point[keep]

    def tokens(self, texts: list[str], chunk: int = CHUNK, long: int = LONG) -> np.ndarray:
        """Number of tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        odd = any(self.odd[np.frombuffer(t.encode("utf-32-le"), np.uint32)].any() for t in texts if not t.isascii())
        parts: list[str] = []
        of: list[int] = []
        for k, text in enumerate(texts):
            pieces = [text]
            for s in self.special:  # special strings are found in the text as it is
                if s in text:
                    extra[k] += text.count(s)
                    pieces = [p for piece in pieces for p in piece.split(s)]
            parts += [self.normal(p, odd) for p in pieces]
            of += [k] * len(pieces)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        stream, point = self.symbols_of("\n".join(parts))
        total = np.r_[0, np.cumsum(self.counts(stream, chunk, long))]
        cut = np.searchsorted(point, np.r_[0, np.cumsum(lengths)])
        return extra + np.bincount(of, total[cut[1:]] - total[cut[:-1]], len(texts)).astype(np.int64)


_machines: dict[str, Transducer] = {}


def machine(path: str, told: tuple[np.ndarray, np.ndarray] | None = None) -> Transducer:
    """The worker's machine for a vocabulary (told: classes() of it, if known); later tasks go on with what it has compiled."""
    if path not in _machines:
        _machines[path] = Transducer(path, told)
    return _machines[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of each row of docs. vocabulary: path of the tokenizer's json, the same on all executors."""
    shared.ship(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(classes(vocabulary))  # 2 MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(vocabulary, told.value)
        for rows, data, offsets in shared.passes(batches):
            n = m.tokens(rows.column("text").fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
