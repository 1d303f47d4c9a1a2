"""Byte-pair encoding of whole texts, cached by space-delimited chunk.

The splitting pattern always has a boundary before a space that follows a non-space, so a text is
the concatenation of chunks ``word``, `` word``, `` word`` ... that encode independently. A text where
white space precedes a space is taken as one chunk. Distinct chunks are encoded once per worker.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken

from . import common

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct chunks a worker remembers; the common ones come early, later ones are made anew (speed only).
CACHE = 200_000
#: The same for the regex module, whose own \\s also takes the four separators 1C to 1F.
_FIND = PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s+", r"\p{White_Space}+")
_SPACE = regex.compile(r"\p{White_Space}+")
_SPACES = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "


@functools.cache
def encoding(path: str = DEFAULT_VOCAB) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Chunks:
    """Chunks of a batch: ``codes`` index ``vocab`` (chunks in full, with their leading space)."""

    def __init__(self, text: pa.Array) -> None:
        text = text.cast(pa.large_string())
        parts = pc.split_pattern(text, " ")
        offsets = np.asarray(parts.offsets).astype(np.int64)
        flat = pc.dictionary_encode(parts.values.slice(offsets[0], offsets[-1] - offsets[0]))
        bounds, codes = offsets - offsets[0], np.asarray(flat.indices).astype(np.int64)
        n = len(flat.dictionary)
        codes[:] += n  # " word"
        first = bounds[:-1][np.diff(bounds) > 0]
        codes[first] -= n  # the first chunk has no space before it
        words = flat.dictionary.to_pylist()
        seen = np.zeros(2 * n, bool)
        seen[codes] = True
        used, codes = np.flatnonzero(seen), (np.cumsum(seen) - 1)[codes]
        self.vocab = [words[i] if i < n else " " + words[i - n] for i in used.tolist()]
        odd = np.asarray(pc.match_substring_regex(text, _SPACES).to_numpy(zero_copy_only=False), bool)
        if odd.any():
            keep, rows = np.ones(len(codes), bool), np.flatnonzero(odd)
            whole = text.take(pa.array(rows)).to_pylist()
            for i, r in enumerate(rows):
                keep[bounds[r] + 1 : bounds[r + 1]] = False
                codes[bounds[r]] = len(self.vocab) + i
            self.vocab += whole
            bounds, codes = np.concatenate([[0], np.cumsum(keep)])[bounds], codes[keep]
        self.bounds, self.codes = bounds, codes


class Cache:
    """``of(vocab)``: what ``make`` gives for each chunk; remembered between batches."""

    def __init__(self, make: Callable[[str], object], most: int = CACHE) -> None:
        self.make, self.most, self.kept = make, most, {}

    def of(self, vocab: list[str]) -> list:
        kept, make, most = self.kept, self.make, self.most
        out = []
        for w in vocab:
            v = kept.get(w)
            if v is None:
                v = make(w)
                if len(kept) < most and len(w) < 200:
                    kept[w] = v
            out.append(v)
        return out


@functools.cache
def counter(path: str) -> Cache:
    enc = encoding(path).encode_ordinary
    return Cache(lambda w: len(enc(w)))


@functools.cache
def coder(path: str) -> tuple[Cache, np.dtype]:
    enc = encoding(path)
    kind = "H" if enc.max_token_value < 0xFFFF else "I"
    return Cache(lambda w, e=enc.encode_ordinary: array(kind, e(w)).tobytes()), np.dtype(np.uint16 if kind == "H" else np.uint32)


def token_counts(text: pa.Array, path: str = DEFAULT_VOCAB) -> np.ndarray:
    """Number of tokens of each text."""
    c = Chunks(text)
    per = np.asarray(counter(path).of(c.vocab), np.int64)
    run = np.concatenate([[0], np.cumsum(per[c.codes])]) if len(c.codes) else np.zeros(1, np.int64)
    return np.diff(run[c.bounds])


def token_ids(text: pa.Array, path: str = DEFAULT_VOCAB) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the batch in order, and the bounds of each text's slice."""
    from .common import ragged

    c = Chunks(text)
    cache, kind = coder(path)
    parts = cache.of(c.vocab)
    flat = np.frombuffer(b"".join(parts), kind)
    lens = np.fromiter(map(len, parts), np.int64, len(parts)) // kind.itemsize
    starts = np.cumsum(lens) - lens
    if not len(c.codes):
        return flat[:0], np.zeros(len(c.bounds), np.int64)
    each = lens[c.codes]
    run = np.concatenate([[0], np.cumsum(each)])
    return flat[ragged(starts[c.codes], each)], run[c.bounds]


class PrefixTable:
    """Exact token counts of every prefix of a text, by dynamic programming over prefixes.

    The last token of a prefix's encoding is the one token that ends there and is compatible with
    the last token of what precedes it (two tokens are compatible if their joined bytes encode to just
    these two); the count is one more than the count there. ``deltas(text)`` has, for each character,
    how the count changes when the prefix takes it in, as signed bytes.
    """

    def __init__(self, path: str = DEFAULT_VOCAB) -> None:
        enc = encoding(path)
        self.rank = enc._mergeable_ranks
        self.bytes_of = {v: k for k, v in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.piece = enc._encode_single_piece
        self.pairs: dict[int, bool] = {}
        self.find = regex.compile(_FIND).findall
        self.states: dict[bytes, int] = {}
        self.words = Cache(self._word, 300_000)
        self.chunks = Cache(self._chunk, 600_000)

    def _fits(self, a: int, b: int) -> bool:
        """Whether token b can follow token a (-1: begin a piece) in an encoding."""
        ok = self.piece(self.bytes_of[b]) == [b] if a < 0 else self.piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        if len(self.pairs) < 1_000_000:
            self.pairs[a << 32 | b] = ok
        return ok

    def _counts(self, raw: bytes) -> list[int]:
        """Tokens of raw[:i] for i = 0 .. len(raw); raw is one piece that no pattern splits.

        Prefixes that pieces share are solved once: ``states`` has the last token and the count of a prefix.
        """
        get, pair, longest, states = self.rank.get, self.pairs.get, self.longest, self.states
        last, count = [-1], [0]
        for end in range(1, len(raw) + 1):
            head = raw[:end] if end <= 24 else None
            known = states.get(head) if head is not None else None
            if known is not None:
                last.append(known >> 8)
                count.append(known & 255)
                continue
            for begin in range(end - 1, max(0, end - longest) - 1, -1):
                t = get(raw[begin:end])
                if t is None:
                    continue
                fits = pair(last[begin] << 32 | t)
                if fits or fits is None and self._fits(last[begin], t):
                    last.append(t)
                    count.append(count[begin] + 1)
                    if head is not None and len(states) < 1_000_000:
                        states[head] = t << 8 | count[end]
                    break
            else:
                raise ValueError("the vocabulary does not cover every byte")
        return count

    def _word(self, word: str) -> list[int]:
        """Tokens of word[:j] for j = 1 .. len(word); word is one match of the pattern, or white space."""
        if word in ("'re", "'ve", "'ll"):  # cut in its middle, the pattern sees two pieces
            return [1, len(self.piece(b"'")) + len(self.piece(word[1].encode())), self._counts(word.encode())[-1]]
        raw = word.encode()
        count = self._counts(raw)
        if len(raw) == len(word):
            return count[1:]
        at, out = 0, []
        for c in word:
            at += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
            out.append(count[at])
        return out

    def _chunk(self, chunk: str) -> bytes:
        words, of, out, before = self.find(chunk), self.words.of, [], 0
        if len(words) == 1 or not _SPACE.search(chunk, 1):  # no white space but a leading one: pieces simply add up
            for counts in of(words):
                before = 0
                for c in counts:
                    out.append(c - before & 255 if -128 <= c - before < 128 else self._wide(c - before))
                    before = c
            return bytes(out)
        at, base, space = 0, 0, _SPACE.fullmatch
        run_at, run_base = -1, 0
        for word in words:
            if space(word[0]):
                if run_at < 0:
                    run_at, run_base = at, base
            else:
                run_at = -1
            mine = of([word])[0]
            if run_at >= 0 and run_at < at:  # white space went before: up to the next other character they are one run
                stop = at + (len(word) if space(word) else 1)
                run = self._word(chunk[run_at:stop])
                n = stop - at
                out += [run_base + c for c in run[-n:]] + [base + c for c in mine[n:]]
            else:
                out += [base + c for c in mine]
            if not space(word):
                run_at = -1
            at, base = at + len(word), base + mine[-1]
        steps = np.diff(np.asarray(out, np.int64), prepend=0)
        if len(steps) and (steps.min() < -128 or steps.max() > 127):
            self._wide(int(steps.max()))
        return steps.astype(np.int8).tobytes()

    @staticmethod
    def _wide(step: int) -> int:
        raise ValueError(f"a token joins more than 128 others: {step}")

    def deltas(self, text: pa.Array) -> list[bytes]:
        c = Chunks(text)
        parts = self.chunks.of(c.vocab)
        codes, bounds = c.codes.tolist(), c.bounds.tolist()
        return [b"".join([parts[k] for k in codes[a:b]]) for a, b in zip(bounds[:-1], bounds[1:])]


@functools.cache
def prefix_table(path: str) -> PrefixTable:
    return PrefixTable(path)


for _kept in (encoding, counter, coder, prefix_table):
    common.remembers(_kept.cache_clear)
