"""Secrets: plain patterns, and a linear-chain conditional random field over tokens."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from math import log2
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineside.llm.spans import Span, digest, joined, ordered
from lineside.llm.tables import per_batch, sampled, texts

KINDS = ("assign", "access", "hex", "crf")
OUTSIDE, BEGIN, INSIDE = range(3)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")

#: A token: a run that a secret could be made of, or one other sign.
_TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+(?:={1,2}(?![A-Za-z0-9=]))?|[^\sA-Za-z0-9+/_.-]")
_PIECE = re.compile(rf"\s+|{_TOKEN.pattern}")
_RUN_DIGIT = re.compile(r"[0-9]")
#: Tokens before one that its features are made of.
_BEFORE = 3
BUCKETS = 1 << 13


def plain_secrets(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans of the plain patterns, and of the secrets themselves (the value of an assignment)."""
    spans, values = [], []
    low = text.lower()
    if any(h in low for h in _HINTS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                spans.append(("assign", *m.span()))
                values.append(m.span(2))
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        if kind == "hex" or "AKIA" in text:
            for m in pattern.finditer(text):
                spans.append((kind, *m.span()))
                values.append(m.span())
    return spans, values


_KINDS = str.maketrans({c: "0" if c.isdigit() else "a" if c.islower() else "A" for c in map(chr, range(128)) if c.isalnum()})
_HEX_RUN = re.compile(r"[0-9a-f]+")


def _kinds(token: str) -> str:
    return token.translate(_KINDS) if token.isascii() else "".join("0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in token)


def _shape(token: str) -> str:
    """Which kinds of characters occur, and how often the kind changes, in steps of four."""
    kinds = _kinds(token)
    return f"{''.join(sorted(set(kinds)))}{min(sum(map(ne, kinds, kinds[1:])) // 4, 4)}"


def _entropy(token: str) -> float:
    return -sum(n / len(token) * log2(n / len(token)) for n in sorted(map(token.count, set(token))))


_PRIME = 16777619


def _sum(feature: str) -> int:
    value = 2166136261
    for byte in feature.encode():
        value = ((value ^ byte) * _PRIME) & 0xFFFFFFFF
    return value


def _folded(feature: str) -> int:
    value = _sum(feature)
    return (value ^ value >> 13) % BUCKETS


_folded_short = lru_cache(1 << 17)(_folded)


def _bucket(feature: str) -> int:
    return _folded_short(feature) if len(feature) < 64 else _folded(feature)


def file_features(text: str) -> list[str]:
    """What kind of file a text is: how many lines assign something, whether it has brackets or markup."""
    lines = text.count("\n") + 1
    assigned = text.count("=") + text.count(":")
    return [f"file:assign{min(3, 4 * assigned // (lines + 1))}", f"file:brace{'{' in text}", f"file:tag{'</' in text}", f"file:table{'|' in text}"]


def _like(word: str) -> bool:
    return len(word) >= 8 and _RUN_DIGIT.search(word) is not None


def sequences(text: str) -> Iterator[tuple[list[tuple[int, int]], list[bool]]]:
    """The whole text as one chain: the spans of all its tokens, and which of them look like a secret (eight characters or more, a digit among them).

    Every token is scored and may be tagged, whatever it looks like; a text without tokens has no chain.
    """
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if spans:
        yield spans, [_like(text[a:b]) for a, b in spans]


def _looks(word: str, like: bool) -> tuple:
    """What a token is like by itself, but for how it begins."""
    kinds = _kinds(word)
    letters = kinds.count("a") + kinds.count("A") if word.isascii() else sum(c.isalpha() for c in word)
    return (like, f"{''.join(sorted(set(kinds)))}{min(sum(map(ne, kinds, kinds[1:])) // 4, 4)}", min(len(word) // 4, 12), int(2 * _entropy(word)),
            _HEX_RUN.fullmatch(word) is not None, 4 * letters // len(word), "." in word)


@lru_cache(1 << 16)
def _looks_buckets(looks: tuple) -> list[int]:
    return [_bucket("bias"), *(_bucket(f"{name}:{value}") for name, value in zip(("like", "shape", "len", "entropy", "hex", "letters", "dots"), looks))]


def _own_buckets(word: str, like: bool) -> list[int]:
    """Feature buckets of a token by itself."""
    return [*_looks_buckets(_looks(word, like)), _bucket(f"head:{word[:4]}")]


def _short(word: str) -> str:
    """How a lower-case word shows among the words before a token."""
    return word if len(word) < 16 else _shape(word)


#: Bytes of a word as ``_short`` shows it, at most: 15 plain signs, or the lower form of one other.
_SHORT = 16


def _flat(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(_SHORT, b"\0")[:_SHORT] for w in words), np.uint8).reshape(-1, _SHORT)


def _sums(prefix: str, flat: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """``_sum`` of a prefix and the first bytes of each row."""
    return _go_on(np.full(len(flat), _sum(prefix), np.uint32), flat, n_bytes)


def _fold(value: np.ndarray) -> np.ndarray:
    return (value ^ (value >> np.uint32(13))) % np.uint32(BUCKETS)


class _Near:
    """What different lower-case words add to the features of tokens around them: buckets as the word after and as one before, sums for two words."""

    def __init__(self, low: list[str]):
        shorts = [_short(w).encode() for w in low]
        self.flat, self.n_bytes = _flat(shorts), np.array([len(x) for x in shorts])
        self.after = _fold(_sums("after:", self.flat, self.n_bytes))
        for i, w in enumerate(low):
            if len(w) >= _SHORT:
                self.after[i] = _bucket(f"after:{w}")
        self.before = [_fold(_sums(f"before{j}:", self.flat, self.n_bytes)) for j in range(_BEFORE)]
        first = _sums("before:", self.flat, self.n_bytes)  # of the feature of two words: after the first and, with a blank, before the second
        self.state = np.column_stack([first, (first ^ np.uint32(32)) * np.uint32(_PRIME)])


def _go_on(value: np.ndarray, flat: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """``value`` after these bytes too."""
    columns = flat.T.copy()
    for k in range(min(int(n_bytes.max(initial=0)), _SHORT)):
        value = np.where(n_bytes > k, (value ^ columns[k]) * np.uint32(_PRIME), value)
    return value


def token_features(text: str, spans: list[tuple[int, int]], possible: list[bool], of_file: list[str], reach: int = _BEFORE) -> list[list[int]]:
    """Feature buckets of every token: its shape and whether it looks like a secret, ``reach`` words before and one after, its file."""
    words = [text[a:b] for a, b in spans]
    rows: dict[str, int] = {}
    at = np.array([rows.setdefault(w, len(rows)) for w in words], np.int64)
    near = _Near([w.lower() for w in rows])
    own = {pair: _own_buckets(*pair) for pair in set(zip(words, possible))}
    shared, n = [_bucket(f) for f in of_file], len(words)
    after = [*near.after[at[1:]].tolist(), _bucket("after:<end>")]
    befores = [[0] * min(j + 1, n) + near.before[j][at[:max(0, n - 1 - j)]].tolist() for j in range(reach)]
    together = np.full(n, _sum("before:"), np.uint32)
    if reach > 0:
        together[1:] = near.state[at[:-1], 0]
    if reach > 1:
        together[2:] = _go_on(near.state[at[:-2], 1], near.flat[at[1:-1]], near.n_bytes[at[1:-1]])
    touches = [_bucket("touch:False"), _bucket("touch:True")]
    out = []
    for i, (pair, next_, both) in enumerate(zip(zip(words, possible), after, _fold(together).tolist())):
        touch = touches[i > 0 and spans[i - 1][1] == spans[i][0]]
        out.append([*own[pair], *shared, next_, *(column[i] for column in befores[:i]), both, touch])
    return out


def _steps(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of chains of these sizes lie when those of one place in their chains are put together, longest chains first; where each place begins."""
    rank = np.empty(len(size), np.int64)
    rank[np.argsort(-size, kind="stable")] = np.arange(len(size))
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    begins = np.r_[0, np.cumsum(np.bincount(place))]
    return begins[place] + np.repeat(rank, size), begins


#: With fewer chains at a place, these are gone through one by one.
_ABREAST = 12


def best_paths(emit: np.ndarray, size: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best state of each token, by Viterbi over every chain; ``emit`` has the tokens of the chains one after another."""
    at, begins = _steps(size)
    wide = np.diff(begins)
    scores = np.empty((3, len(emit)))
    scores[:, at] = emit.T
    back, best = np.zeros((3, len(emit)), np.int8), np.zeros(len(emit), np.int8)
    together = max(1, int((wide >= _ABREAST).sum()))
    score = scores[:, :wide[0]]
    for t in range(together):
        a, b = begins[t], begins[t + 1]
        if t:
            total = score[:, None, :b - a] + move[:, :, None]
            back[:, a:b] = total.argmax(axis=0)
            score = total.max(axis=0) + scores[:, a:b]
        ended = wide[t + 1] if t + 1 < len(wide) else 0
        best[a + ended:b] = score[:, ended:].argmax(axis=0)
    rows = move.T.tolist()
    for r in range(wide[together] if together < len(wide) else 0):
        where = begins[together:-1][wide[together:] > r] + r
        last, choices = score[:, r].tolist(), []
        for gain in scores[:, where].T.tolist():
            new, choice = [], []
            for (x, y, z), g in zip(rows, gain):
                x, y, z = last[0] + x, last[1] + y, last[2] + z
                k = (0 if x >= z else 2) if x >= y else (1 if y >= z else 2)
                choice.append(k)
                new.append((x, y, z)[k] + g)
            choices.append(choice)
            last = new
        state = last.index(max(last))
        for i in range(len(where) - 1, -1, -1):
            best[where[i]] = state
            state = choices[i][state]
        best[begins[together - 1] + r] = state
    for t in range(together - 1, 0, -1):
        a, b = begins[t], begins[t + 1]
        best[begins[t - 1]:begins[t - 1] + b - a] = back[best[a:b], np.arange(a, b)]
    return best[at]


class Field:
    """A linear chain over outside, begin, inside: emission and transition weights."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((BUCKETS, 3)) if emit is None else emit
        self.move = np.zeros((3, 3)) if move is None else move

    def emissions(self, feats: list[list[int]]) -> np.ndarray:
        """Scores by token and state; a token without features can only be outside."""
        out = np.full((len(feats), 3), -1e9)
        out[:, OUTSIDE] = 0
        for i, f in enumerate(feats):
            if f:
                out[i] = self.emit[f].sum(axis=0)
        out[0, INSIDE] = -1e9
        return out

    def transitions(self) -> np.ndarray:
        """From row to column; inside never follows outside."""
        move = self.move.copy()
        move[OUTSIDE, INSIDE] = -1e9
        return move

    def viterbi(self, feats: list[list[int]]) -> list[int]:
        return best_paths(self.emissions(feats), np.array([len(feats)]), self.transitions()).tolist()


#: Tokens that a chain is cut into for its sums; what a block does to the sums before it is a matrix.
_BLOCK = 64


def _shares(values: np.ndarray) -> np.ndarray:
    return values / values.sum(axis=tuple(range(1, values.ndim)), keepdims=True)


def _both_ways(x: np.ndarray, size: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward sums of each token, each row up to a factor; ``x`` has the tokens of the chains one after another.

    Blocks of all chains go on together, so a long chain takes as many steps as it has blocks.
    """
    blocks = -(-size // _BLOCK)
    chain = np.repeat(np.arange(len(size)), blocks)
    place = np.arange(len(chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    length = np.minimum(_BLOCK, size[chain] - place * _BLOCK)
    at, begins = _steps(length)
    rank = at[np.cumsum(length) - length]
    opens = np.empty(len(chain), bool)
    opens[rank] = place == 0
    x_at = np.empty_like(x)
    x_at[at] = x
    steps = list(zip(begins.tolist(), begins[1:].tolist()))
    does = np.where(opens[:, None, None], np.eye(3), move)
    for t, (a, b) in enumerate(steps):
        does[:b - a] = _shares((does[:b - a] @ move if t else does[:b - a]) * x_at[a:b, None, :])
    # from block to block
    by_chain, starts = _steps(blocks)
    matrix, comes, goes = np.empty_like(does), np.ones((len(chain), 3)), np.ones((len(chain), 3))
    matrix[by_chain] = does[rank]
    hops = list(zip(starts.tolist(), starts[1:].tolist(), starts[2:].tolist()))
    for a, b, c in hops:
        comes[b:c] = _shares((comes[a:a + c - b, None, :] @ matrix[a:a + c - b])[:, 0])
    for a, b, c in hops[::-1]:
        goes[a:a + c - b] = _shares((matrix[b:c] @ goes[b:c, :, None])[:, :, 0])
    # within the blocks
    fore, aft, last = np.empty_like(x), np.empty_like(x), np.empty((len(chain), 3))
    before = np.empty((len(chain), 3))
    before[rank], last[rank] = comes[by_chain], goes[by_chain]
    before = np.where(opens[:, None], 1.0, before @ move)
    for a, b in steps:
        fore[a:b] = _shares(before[:b - a] * x_at[a:b])
        before = fore[a:b] @ move
    for a, b in steps[::-1]:
        aft[a:b] = last[:b - a]
        last[:b - a] = _shares((x_at[a:b] * last[:b - a]) @ move.T)
    return fore[at], aft[at]


def fit_field(data: list[tuple[list[list[int]], list[int]]], steps: int = 20, ridge: float = 0.02) -> Field:
    """Maximum likelihood with a ridge, by steps that adapt to each weight; all chains are summed over at once, forward and backward."""
    field = Field()
    data = [(feats, tags) for feats, tags in data if feats]
    if not data:
        return field
    size = np.array([len(feats) for feats, _ in data])
    most = max(len(f) for feats, _ in data for f in feats)
    feats = np.array([[*f, *[BUCKETS] * (most - len(f))] for chain, _ in data for f in chain], np.int16).T.astype(np.int64)
    tags = np.concatenate([tags for _, tags in data])
    n, first = len(tags), np.cumsum(size) - size
    has = feats[0] < BUCKETS
    follows = np.delete(np.arange(n), first)
    taken, seen = np.empty((n, 3)), np.zeros((3, 3))
    np.add.at(seen, (tags[follows - 1], tags[follows]), 1)
    speed_e, speed_m = np.full_like(field.emit, 1e-6), np.full_like(field.move, 1e-6)
    for _ in range(steps):
        weights = np.vstack([field.emit, np.zeros((1, 3))])
        emit = np.zeros((n, 3))
        for column in feats:
            np.add(emit, weights.take(column, axis=0, out=taken, mode="clip"), out=emit)
        emit[~has, 1:] = -1e9
        emit[first, INSIDE] = -1e9
        move = np.exp(field.transitions())
        x = np.exp(emit - emit.max(axis=1, keepdims=True))
        fore, aft = _both_ways(x, size, move)
        after = x * aft
        expected = fore * aft
        gap = -expected / expected.sum(axis=1, keepdims=True)
        gap[np.arange(n), tags] += 1
        gap[~has] = 0
        d_emit = -ridge * field.emit
        gaps = gap.T.copy()
        for column in feats:
            for state in range(3):
                d_emit[:, state] += np.bincount(column, gaps[state], BUCKETS + 1)[:BUCKETS]
        left, right = fore[follows - 1], after[follows]
        share = ((left @ move) * right).sum(axis=1, keepdims=True)
        d_move = -ridge * field.move + seen - move * ((left / share).T @ right)
        speed_e += d_emit ** 2
        speed_m += d_move ** 2
        field.emit += 0.5 * d_emit / np.sqrt(speed_e)
        field.move += 0.5 * d_move / np.sqrt(speed_m)
    return field


class _Words(dict):
    """Row of each different piece of text: of white space, of a token. Row 0 stands for no token."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[tuple[str, bool]] = [("", True)]
        self.begun = False

    def __missing__(self, piece: str) -> int:
        self[piece] = row = len(self) + 1
        self.new.append((piece, piece.isspace()))
        return row


class Decoder:
    """Tags of whole texts by a field. What a word adds to the scores around it is looked up once for many texts."""

    def __init__(self, field: Field, most: int = 1 << 19):
        self.field, self.most = field, most
        self.move = field.transitions()
        self._forget()

    def _forget(self) -> None:
        self.words, self.chars, self.looks = _Words(), 0, {}
        self.length, self.space = np.empty(0, np.int64), np.empty(0, bool)
        self.scores = np.empty((0, 2 + _BEFORE, 3))  # own, as the word after, as one before
        self.state, self.bytes, self.n_bytes = np.empty((0, 2), np.uint32), np.empty((0, _SHORT), np.uint8), np.empty(0, np.int64)

    def _look_up(self) -> None:
        """Adds the rows of new words."""
        new, emit = self.words.new, self.field.emit
        if not new:
            return
        space = np.array([s for _, s in new])
        near = _Near([w.lower() for w, _ in new])
        heads = [w[:4].encode() for w, _ in new]
        scores, kinds, rows = np.zeros((len(new), 2 + _BEFORE, 3)), self.looks, []
        for word, white in new:
            looks = None if white else _looks(word, _like(word))
            if looks not in kinds:
                kinds[looks] = np.zeros(3) if white else emit[_looks_buckets(looks)].sum(axis=0)
            rows.append(kinds[looks])
        scores[:, 0] = np.array(rows) + emit[_fold(_sums("head:", _flat(heads), np.array([len(x) for x in heads])))]
        for j, buckets in enumerate((near.after, *near.before), 1):
            scores[:, j] = emit[buckets]
        scores[space] = 0
        if not self.words.begun:  # row 0
            scores[0, 1] = emit[_bucket("after:<end>")]
            near.state[0, 0] = _sum("before:")
            self.words.begun = True
        flat, n_bytes, state = near.flat, near.n_bytes, near.state
        for name, more in (("scores", scores), ("state", state), ("bytes", flat), ("n_bytes", n_bytes), ("space", space), ("length", np.array([len(w) for w, _ in new]))):
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        self.chars += int(self.length[-len(new):].sum())
        new.clear()

    def tags(self, some: list[str]) -> Iterator[list[tuple[int, int]]]:
        """Spans from a begin to its last inside, for each text."""
        row = self.words.__getitem__
        pieces = [np.array([row(p) for p in _PIECE.findall(text)], np.int64) for text in some]
        self._look_up()
        size = np.array([len(p) for p in pieces])
        words = np.concatenate([np.empty(0, np.int64), *pieces])
        of = np.repeat(np.arange(len(some)), size)
        end = np.cumsum(self.length[words])
        end -= np.r_[0, end][(np.cumsum(size) - size)][of]
        start = end - self.length[words]
        touch = np.r_[False, ~self.space[words[:-1]] & (of[1:] == of[:-1])] if len(words) else np.empty(0, bool)
        token = np.flatnonzero(~self.space[words])
        words, of, start, end, touch = (c[token] for c in (words, of, start, end, touch))
        found: list[list[tuple[int, int]]] = [[] for _ in some]
        if len(words):
            size = np.bincount(of, minlength=len(some))
            begins = size[size > 0]
            path = best_paths(self._emissions(words, of, touch, some), begins, self.move)
            inside = np.r_[(path[1:] == INSIDE) & (of[1:] == of[:-1]), False]
            stops = np.flatnonzero(~inside)
            first = np.flatnonzero(path == BEGIN)
            for i, k in zip(first.tolist(), stops[np.searchsorted(stops, first)].tolist()):
                found[of[i]].append((int(start[i]), int(end[k])))
        if len(self.words) > self.most or self.chars > 64 * self.most:
            self._forget()
        return found

    def _emissions(self, words: np.ndarray, of: np.ndarray, touch: np.ndarray, some: list[str]) -> np.ndarray:
        emit, n = self.field.emit, len(words)
        out = self.scores[words, 0]
        near = []
        for j in range(1, _BEFORE + 1):
            other = np.zeros(n, np.int64)
            other[j:] = np.where(of[j:] == of[:-j], words[:-j], 0)
            out += self.scores[other, 1 + j]  # row 0 adds nothing
            near.append(other)
        after = np.zeros(n, np.int64)
        after[:-1] = np.where(of[1:] == of[:-1], words[1:], 0)
        out += self.scores[after, 1]
        # the words before that are named together: the sum goes on from the first word over the bytes of the second
        one, two = near[:2]
        value = np.where(two > 0, self.state[two, 1], self.state[one, 0])
        out += emit[_fold(_go_on(value, self.bytes[one], np.where(two > 0, self.n_bytes[one], 0)))]
        out += emit[[_bucket("touch:False"), _bucket("touch:True")]][touch.astype(int)]
        files = np.zeros((len(some), 3))
        for i in np.unique(of).tolist():
            files[i] = emit[[_bucket(f) for f in file_features(some[i])]].sum(axis=0)
        out += files[of]
        out[np.r_[True, of[1:] != of[:-1]], INSIDE] = -1e9
        return out


def training_sequences(text: str, reaches: tuple[int, ...] = (_BEFORE, 0, 1)) -> list[tuple[list[list[int]], list[int]]]:
    """The whole text as a chain tagged by the plain patterns; one with a secret also with fewer words before each token, so that shape must do."""
    values = plain_secrets(text)[1]
    of_file, out = file_features(text), []
    for spans, possible in sequences(text):
        starts, ends = [a for a, _ in spans], [b for _, b in spans]
        inside = [None] * len(spans)
        for x, y in values[::-1]:
            for i in range(bisect_right(ends, x), bisect_left(starts, y)):
                inside[i] = (x, y)
        tags = [OUTSIDE if not this else INSIDE if this == last else BEGIN for this, last in zip(inside, [None, *inside])]
        out += [(token_features(text, spans, possible, of_file, reach), tags) for reach in reaches if reach == _BEFORE or BEGIN in tags]
    return out


def learn(docs: DataFrame, sample: int = 20_000, most: int = 800) -> Field:
    """A field from the tagged chains of about ``sample`` documents, at most ``most`` of each kind.

    The chains are taken by a hash of their text and fitted in one task.
    """
    schema = pa.schema([("hit", pa.bool_()), ("text", pa.string()), ("reach", pa.int32())])

    def lay(batch: pa.RecordBatch) -> dict[str, list]:
        rows = []
        for text in batch.column("text").to_pylist():
            hit = bool(plain_secrets(text or "")[1])
            if hit or _TOKEN.search(text or ""):
                rows += [(hit, text, reach) for reach in ((_BEFORE, 0, 1) if hit else (_BEFORE,))]
        return dict(zip(schema.names, zip(*rows) if rows else ([], [], [])))

    laid = sampled(docs.where(F.col("doc_id").isNotNull()), sample, 5).select("text").mapInArrow(
        per_batch(schema, lay), "hit boolean, text string, reach int")
    taken = [laid.where(F.col("hit") == hit).orderBy(F.xxhash64("text", "reach"), "text", "reach").limit(most) for hit in (True, False)]
    model = pa.schema([("emit", pa.list_(pa.float64())), ("move", pa.list_(pa.float64()))])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("text", "reach"))))
        field = fit_field([chain for text, reach in rows for chain in training_sequences(text, (reach,))])
        yield pa.RecordBatch.from_pydict({"emit": [field.emit.ravel().tolist()], "move": [field.move.ravel().tolist()]}, schema=model)

    got = (taken[0].union(taken[1]).select("text", "reach").repartition(1)
           .mapInArrow(solve, "emit array<double>, move array<double>").first())
    return Field(np.array(got.emit).reshape(BUCKETS, 3), np.array(got.move).reshape(3, 3)) if got else Field()


def _apart(spans: list[tuple[int, int]], base: list[Span]) -> list[Span]:
    """Tagged spans that overlap no plain span."""
    starts = sorted(a for _, a, _ in base)
    ends = list(accumulate((b for _, _, b in sorted(base, key=lambda s: s[1])), max))  # of the spans up to each start
    return [("crf", x, y) for x, y in spans if not (k := bisect_left(starts, y)) or ends[k - 1] <= x]


def tagged_secrets(text: str, field: Field, base: list[Span]) -> list[Span]:
    """Spans from a begin to its last inside that overlap no plain span."""
    return _apart(Decoder(field).tags([text])[0], base)


def find_secrets(docs: DataFrame, sample: int = 20_000) -> DataFrame:
    """Secrets in every whole text.

    Returns a row for each row of ``docs``: ``doc_id``, the counts of plain matches ``n_assign,
    n_access, n_hex``, ``base_sha256``, ``spans`` (plain ones and those that the field adds, kind
    ``crf``; code points, end exclusive) and ``n_added``. The field learns from the plain matches
    in whole texts of a bounded sample of documents, with and without the words before them. Every token of every whole text is
    scored and decoded by Viterbi in one chain. Spans that it finds are added where they overlap no plain one.

    A null text counts as empty; repeated rows are each returned; an empty table gives no rows;
    other columns are not read.
    """
    rows = texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows, sample))
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()),
                        ("spans", pa.string()), ("n_added", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in schema.names}
            out["doc_id"] = batch.column("doc_id").to_pylist()
            read = [text or "" for text in batch.column("text").to_pylist()]
            for text, tagged in zip(read, decoder.tags(read)):
                base = ordered(plain_secrets(text)[0], KINDS)
                added = _apart(tagged, base)
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                out["base_sha256"].append(digest(base))
                out["spans"].append(joined(ordered(base + added, KINDS)))
                out["n_added"].append(len(added))
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    kinds = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)
    return rows.mapInArrow(work, kinds)
