"""Secrets in text: fixed patterns, and spans tagged by a linear-chain CRF.

Tokens are tagged as begin, inside or outside of a secret from their shape, their
neighbours and features of the file; Viterbi decodes each line. The field is trained on
windows of documents, labelled by the values that the patterns find.
"""

from __future__ import annotations

import functools
import operator
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.columns import Aside
from notemill.llm.scratch import Scratch

#: At most so many documents with, and as many without, a pattern's match are learned from.
FIT_DOCS = 1500
#: At most so many windows of ``WINDOW`` tokens with a value, and as many without, from each of them.
DOC_WINDOWS = 2
#: So many disguises with another key, and as many without a key, of each window with a value.
DISGUISES = 1
WINDOW = 24

KINDS = ("assign", "access", "hex", "crf")

# The patterns of the base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_CUES = ("passw", "secret", "token", "api")
_ASSIGN_ANY, _ACCESS_ANY, _HEX_ANY = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}"

FINDINGS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)

TOKEN = re.compile(r"\w[\w+/-]*|[^\w\s]|\n")
TABLE = 1 << 16
SLOTS = 5  # the token itself, the one before, the one before that, the next one, the file
_FAR = -1e4
#: Texts are tagged together until they have so many tokens; a longer one on its own.
AT_ONCE = 16_384


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the fixed patterns, in code points."""
    out = []
    low = text.lower()
    if any(c in low for c in _CUES):
        for m in ASSIGN.finditer(text):
            if len(m.group(2)) >= 6:
                out.append(("assign", m.start(), m.end(), m.start(2)))
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run is longest from its first place, so asking for 24 at once finds the same runs.
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_SHAPES = str.maketrans(
    "".join(map(chr, range(65, 91))) + "".join(map(chr, range(97, 123))) + "0123456789", "A" * 26 + "a" * 26 + "9" * 10
)
_RUNS = re.compile(r"(.)\1+")
_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint64)


_HEX_DIGITS = frozenset("0123456789abcdef")
_WORD = zlib.crc32(b"w")


@functools.lru_cache(1 << 16)
def _kind_features(shape: str, size: int, mixed: int, rich: int, kind: str, digits: int) -> tuple[int, ...]:
    names = (f"s{shape}", f"n{size}", f"m{mixed}{rich}", f"k{kind}{digits}")
    return tuple(zlib.crc32(x.encode()) for x in names)


def _traits(token: str) -> tuple[tuple, str]:
    """What ``_kind_features`` takes of a token, and the word itself (``#`` for a long one or one with digits)."""
    n = len(token)
    kind, digits, mixed = "x", 0, 0
    if token.isalpha():
        if not token.isascii():
            shape = _RUNS.sub(r"\1", token.translate(_SHAPES)) if n <= 64 else "long"
        elif token.islower():
            shape = "a"
        elif token.isupper():
            shape = "A"
        else:
            shape = "Aa" if token.istitle() else _RUNS.sub(r"\1", token.translate(_SHAPES))
    else:
        digits = sum(map(str.isdigit, token))
        shape = _RUNS.sub(r"\1", token.translate(_SHAPES)) if n <= 64 else "long"
        mixed = 0 if not digits else 1 + min(3, len(shape) // 4)
        if n >= 8 and digits and _HEX_DIGITS.issuperset(token):
            kind = "hex"
    if kind != "hex" and token.isupper():
        kind = "up"
    rich = len(set(token)) * 4 // n if n >= 8 else 9
    return (shape[:8], min(n, 44) // 4, mixed, rich, kind, min(digits, 12) // 3), token.lower() if n <= 12 and not digits else "#"


def token_features(token: str) -> tuple[int, ...]:
    """Hashes of a token's shape, length, letters and, of a short word, itself."""
    own, word = _traits(token)
    return (*_kind_features(*own), zlib.crc32(word.encode(), _WORD))


def file_features(text: str, tokens: int) -> list[int]:
    """Hashes of a file's size and its share of signs that code has."""
    signs = sum(text.count(c) for c in "={}();\"'_")
    share = min(6, int(100 * signs / max(len(text), 1)))
    return [zlib.crc32(f"f{share}".encode()), zlib.crc32(f"z{min(7, max(tokens, 1).bit_length() // 2)}".encode())]


def _slot(features: np.ndarray, slot: int) -> np.ndarray:
    return ((features * _MULTIPLY[slot]) >> np.uint64(13)).astype(np.int64) % TABLE


@dataclass
class Field:
    weights: np.ndarray  # TABLE x 3: begin, inside, outside
    moves: np.ndarray  # from x to


def _window_features(tokens: list[str], file: list[int]) -> list[np.ndarray]:
    own = [np.array(token_features(t), np.uint64) for t in tokens]
    end = np.array([zlib.crc32(b"end")], np.uint64)
    at = lambda i: own[i] if 0 <= i < len(own) else end
    whole = _slot(np.array(file, np.uint64), 4)
    return [
        np.concatenate([_slot(own[i], 0), _slot(at(i - 1), 1), _slot(at(i - 2), 2), _slot(at(i + 1), 3), whole])
        for i in range(len(own))
    ]


def fit(windows: list[tuple[list[str], list[int], list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Fit by the likelihood's gradient (forward-backward), AdaGrad on batches of windows.

    A window is (tokens, states, file features). Without windows nothing is ever tagged.
    """
    weights, moves = np.zeros((TABLE, 3)), np.zeros((3, 3))
    moves[2, 1] = _FAR
    if not windows:
        weights[:, 2] = 1.0
        return Field(weights, moves)
    gw, gm = np.full((TABLE, 3), 1e-3), np.full((3, 3), 1e-3)
    coded = [(_window_features(t, f), np.array(s)) for t, s, f in windows]
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(coded)), max(1, len(coded) // 64)):
            sizes = np.array([len(coded[i][1]) for i in batch])
            top, n = int(sizes.max()), len(batch)
            flat = [x for i in batch for x in coded[i][0]]
            index = np.concatenate(flat)
            token = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
            row = np.repeat(np.arange(n), sizes)
            col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            scores = np.zeros((len(flat), 3))
            np.add.at(scores, token, weights[index])
            emit = np.zeros((n, top, 3))
            emit[row, col] = scores
            alive = np.arange(top)[None] < sizes[:, None]
            forward, backward = np.zeros((n, top, 3)), np.zeros((n, top, 3))
            start = moves[2]
            forward[:, 0] = emit[:, 0] + start
            for t in range(1, top):
                step = forward[:, t - 1, :, None] + moves
                peak = step.max(axis=1)
                new = emit[:, t] + peak + np.log(np.exp(step - peak[:, None]).sum(axis=1))
                forward[:, t] = np.where(alive[:, t, None], new, forward[:, t - 1])
            final = forward[:, -1]
            whole = final.max(axis=1) + np.log(np.exp(final - final.max(axis=1, keepdims=True)).sum(axis=1))
            for t in range(top - 2, -1, -1):
                step = moves[None] + (emit[:, t + 1] + backward[:, t + 1])[:, None, :]
                peak = step.max(axis=2)
                new = peak + np.log(np.exp(step - peak[:, :, None]).sum(axis=2))
                backward[:, t] = np.where(alive[:, t + 1, None], new, 0)
            share = np.exp(forward + backward - whole[:, None, None])
            truth = np.concatenate([coded[i][1] for i in batch])
            error = share[row, col]
            error[np.arange(len(truth)), truth] -= 1
            grad_moves = np.zeros((3, 3))
            grad_moves[2] += (share[:, 0] - np.eye(3)[[coded[i][1][0] for i in batch]]).sum(axis=0)
            for t in range(1, top):
                both = forward[:, t - 1, :, None] + moves + (emit[:, t] + backward[:, t])[:, None, :] - whole[:, None, None]
                grad_moves += (np.exp(both) * alive[:, t, None, None]).sum(axis=0)
            follow = col > 0
            np.subtract.at(grad_moves, (truth[np.flatnonzero(follow) - 1], truth[follow]), 1)
            used, back = np.unique(index, return_inverse=True)
            grad = np.zeros((len(used), 3))
            np.add.at(grad, back, error[token])
            grad = grad / n + decay * weights[used]
            grad_moves = grad_moves / n
            grad_moves[2, 1] = 0
            gw[used] += grad * grad
            gm += grad_moves * grad_moves
            weights[used] -= rate * grad / np.sqrt(gw[used])
            moves -= rate * grad_moves / np.sqrt(gm)
    return Field(weights, moves)


def viterbi(emit: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best states of one line; before its first token lies an outside one."""
    score = emit[0] + moves[2]
    back = []
    for row in emit[1:]:
        step = score[:, None] + moves
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + row
    state = int(score.argmax())
    path = [state]
    for b in reversed(back):
        state = int(b[state])
        path.append(state)
    return path[::-1]


class _Rows(dict):
    """Numbers from 0 on for what is asked for; ``new`` lists what was first asked for since it was last emptied."""

    def __init__(self):
        self.new = []

    def __missing__(self, item):
        row = self[item] = len(self)
        self.new.append(item)
        return row


def _longer(table: np.ndarray, size: int) -> np.ndarray:
    return table if size <= len(table) else np.concatenate([table, np.zeros((max(size - len(table), len(table)), table.shape[1]))])


class Tagger:
    """Tags texts, some at once; what a token contributes in each slot is kept per distinct token, and per kind of token."""

    def __init__(self, field: Field, cache: int = 150_000):
        self.field, self.cache = field, cache
        self.known, self.own = np.zeros((4096, 12)), np.zeros((1024, 12))
        self.files: dict[tuple[int, ...], np.ndarray] = {}
        edge = np.array([zlib.crc32(b"end")], np.uint64)
        for slot in range(1, 4):
            self.known[0, 3 * slot : 3 * slot + 3] = field.weights[_slot(edge, slot)].sum(axis=0)
        self._forget()
        m = field.moves
        stay = m[2, 2]
        leave = np.maximum(0, m[:2, 2] - stay)
        #: More than a begin or inside token can gain from moves, against an outside one.
        self.bonus = m[:, :2].max(axis=0) - stay + leave

    def _forget(self) -> None:
        self.index, self.kinds = _Rows(), _Rows()
        self.index[None] = 0  # what lies before the first token and after the last

    def _learn(self) -> None:
        """Add what new tokens contribute in each slot: their kind's share, summed once a kind, and their word's."""
        kinds, words = [], []
        for token in self.index.new:
            own, word = _traits(token)
            kinds.append(self.kinds[own])
            words.append(zlib.crc32(word.encode(), _WORD))
        weights = self.field.weights
        if self.kinds.new:
            features = np.array([_kind_features(*own) for own in self.kinds.new], np.uint64)
            self.own = _longer(self.own, len(self.kinds))
            for slot in range(4):
                self.own[len(self.kinds) - len(features) : len(self.kinds), 3 * slot : 3 * slot + 3] = weights[_slot(features, slot)].sum(axis=1)
            self.kinds.new.clear()
        self.known = _longer(self.known, len(self.index))
        added = self.known[len(self.index) - len(words) : len(self.index)]
        added[:] = self.own[kinds]
        features = np.array(words, np.uint64)
        for slot in range(4):
            added[:, 3 * slot : 3 * slot + 3] += weights[_slot(features, slot)]
        self.index.new.clear()

    def _file(self, features: list[int]) -> np.ndarray:
        key = tuple(features)
        if key not in self.files:
            self.files[key] = self.field.weights[_slot(np.array(features, np.uint64), 4)].sum(axis=0)
        return self.files[key]

    def _emissions(self, texts: list[list[str]], files: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Of all tokens of some texts, two places apart from text to text, and the place of each text's first one."""
        if len(self.index) > self.cache:
            self._forget()
        sizes = np.array([len(t) + 2 for t in texts])
        flat = [None, None]
        for tokens in texts:
            flat += tokens
            flat += (None, None)
        rows = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        if self.index.new:
            self._learn()
        found = self.known[rows]
        out = found[2:-1, :3] + np.repeat([self._file(f) for f in files], sizes, axis=0)[:-1]
        out += found[1:-2, 3:6]
        out += found[:-3, 6:9]
        out += found[3:, 9:12]
        return out, np.cumsum(sizes) - sizes

    def emissions(self, tokens: list[str], file: list[int]) -> np.ndarray:
        return self._emissions([tokens], [file])[0][: len(tokens)]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Tagged spans. A line where no token can gain anything is outside throughout."""
        return next(self.spans_of([text]))

    def spans_of(self, texts: Iterable[str]) -> Iterator[list[tuple[int, int]]]:
        """The tagged spans of each text in turn, looked at some texts at a time."""
        held, n = [], 0
        for text in texts:
            held.append((text, TOKEN.findall(text)))
            n += len(held[-1][1])
            if n >= AT_ONCE:
                yield from self._tagged(held)
                held, n = [], 0
        if held:
            yield from self._tagged(held)

    def _tagged(self, held: list[tuple[str, list[str]]]) -> Iterator[list[tuple[int, int]]]:
        emit, firsts = self._emissions([tokens for _, tokens in held], [file_features(text, len(tokens)) for text, tokens in held])
        gain = (emit[:, :2] - emit[:, 2:] + self.bonus).max(axis=1)
        hot = np.flatnonzero(gain > 0)
        bounds = np.searchsorted(hot, np.append(firsts, len(emit))).tolist()
        for k, (text, tokens) in enumerate(held):
            first = int(firsts[k])
            mine = hot[bounds[k] : bounds[k + 1]] - first
            mine = mine[mine < len(tokens)]  # the two places behind a text are no tokens
            yield self._decoded(text, tokens, emit[first : first + len(tokens)], mine) if len(mine) else []

    def _decoded(self, text: str, tokens: list[str], emit: np.ndarray, hot: np.ndarray) -> list[tuple[int, int]]:
        breaks = np.array([i for i, t in enumerate(tokens) if t == "\n"], np.int64)
        lines = np.unique(np.searchsorted(breaks, hot, side="right"))
        edges = np.concatenate([[-1], breaks, [len(tokens)]])
        places = [m.span() for m in TOKEN.finditer(text)]
        out = []
        for line in lines.tolist():
            a, b = int(edges[line]) + 1, int(edges[line + 1])
            if a >= b:
                continue
            for i, state in enumerate(viterbi(emit[a:b], self.field.moves)):
                if state == 0:
                    out.append(places[a + i])
                elif state == 1:
                    out[-1] = (out[-1][0], places[a + i][1])
        return out


def find(tagger: Tagger, text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind: those of the patterns, and tagged ones not inside one of them."""
    return next(find_all(tagger, [text]))


def find_all(tagger: Tagger, texts: list[str]) -> Iterator[list[tuple[str, int, int]]]:
    """``find`` of each text in turn."""
    for text, tagged in zip(texts, tagger.spans_of(texts)):
        base = [(k, a, b) for k, a, b, _ in base_spans(text)]
        added = [("crf", a, b) for a, b in tagged if not any(x <= a and b <= y for _, x, y in base)]
        yield sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]))) if base or added else []


def _doubtful(token: str) -> bool:
    """Whether a token looks like a value: what the patterns leave out of these may be a secret or not."""
    return len(token) >= 8 and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789_", "ABCDEFGHabcdefghijkmnpqrstuvwxyz23456789-", "ABCDEFGHabcdefghijkmnpqrstuvwxyz23456789/+")


def _drawn(rng: random.Random) -> str:
    """A value of another length and alphabet, with a letter and a digit in it."""
    letters = rng.choice(_ALPHABETS)
    value = "".join(rng.choices(letters, k=rng.randint(8, 44)))
    return rng.choice("abcxyzAKT") + value + rng.choice("0123456789")


def _disguised(tokens: list[str], states: list[int], seed: int) -> list[tuple[list[str], list[int]]]:
    """A window with its values drawn anew, once under other key names and once without any key.

    The patterns' own matches name the windows, so a field that sees the key words would only learn to repeat the patterns.
    """
    rng = random.Random(seed)
    plain = [t for t, s in zip(tokens, states) if s == 2 and t.isalpha() and not any(c in t.lower() for c in _CUES)] or ["key"]
    keyed, bare, bare_states = [], [], []
    signs = ("=", ":", '"', "'")
    for k, (t, s) in enumerate(zip(tokens, states)):
        if s != 2:
            if s == 0:
                value = _drawn(rng)
                keyed.append((value, 0))
                bare.append(value)
                bare_states.append(0)
            continue
        near = 0 in states[k + 1 : k + 5]
        cue = near and any(c in t.lower() for c in _CUES)
        keyed.append(((rng.choice(plain) + rng.choice(["", "_", "-"]) + rng.choice(plain)[:3] if rng.random() < 0.5 else rng.choice(plain)) if cue else t, 2))
        if not cue and not (near and t in signs):
            bare.append(t)
            bare_states.append(2)
    return [([t for t, _ in keyed], [s for _, s in keyed]), (bare, bare_states)]


def _planted(tokens: list[str], seed: int) -> tuple[list[str], list[int]]:
    """A window without a value, with a drawn one put into it: bare, after a prefix, or behind words and signs of its own kind."""
    rng = random.Random(seed)
    plain = [t for t in tokens if t.isalpha()] or ["key"]
    value = _drawn(rng)
    form = rng.randrange(6)
    key = rng.choice(plain) + rng.choice(["", "_" + rng.choice(plain)[:4], "-" + rng.choice(plain)[:3]])
    before, after = [[], ["=", '"'], [":"], ["="], [rng.choice(plain)], []][form], ['"'] if form == 1 else []
    before = [key, *before] if 0 < form < 5 else before
    if form == 5:
        value = rng.choice(plain)[:3] + "_" + value
    at = rng.randint(0, len(tokens))
    out = [*tokens[:at], *before, value, *after, *tokens[at:]]
    states = [2] * len(out)
    states[at + len(before)] = 0
    return out, states


def _windows(text: str, most: int) -> list[tuple[list[str], list[int]]]:
    """At most ``most`` windows around the patterns' values and as many without any, by hash over the whole text.

    Those with a value come also in disguise, those without also with a value planted in them. A window with a doubtful token that no pattern names is not learned from.
    """
    found = list(TOKEN.finditer(text))
    if not found:
        return []
    begin = np.array([m.start() for m in found])
    end = np.array([m.end() for m in found])
    states = np.full(len(found), 2)
    centres = []
    for _, _, b, value in base_spans(text):
        inside = np.flatnonzero((begin < b) & (end > value))
        if len(inside):
            states[inside], states[inside[0]] = 1, 0
            centres.append(int(inside[0]))
    seed = zlib.crc32(text.encode())

    def chosen(places):
        taken = []
        for c in sorted(set(places), key=lambda c: (zlib.crc32(f"{seed}:{c}".encode()), c)):
            if len(taken) == most:
                break
            a = max(0, c - WINDOW // 2)
            part = states[a : a + WINDOW].tolist()
            tokens = [m.group() for m in found[a : a + WINDOW]]
            if not part or any(s == 2 and _doubtful(t) for s, t in zip(part, tokens)):
                continue
            if part[0] == 1:
                part[0] = 0
            taken.append((tokens, part))
        return taken

    grid = [c for c in range(WINDOW // 2, len(found) + WINDOW // 2, WINDOW) if (states[max(0, c - WINDOW // 2) : c + WINDOW // 2] == 2).all()]
    valued = chosen(centres)
    more = [w for k, (t, s) in enumerate(valued) for d in range(DISGUISES) for w in _disguised(t, s, seed + DISGUISES * k + d)]
    # Long numbers look most like values: as many windows with one again, where there are any.
    numbers = np.array([m.group().isdigit() and len(m.group()) >= 8 for m in found])
    harder = [c for c in grid if numbers[max(0, c - WINDOW // 2) : c + WINDOW // 2].any()]
    empty = list({tuple(t): (t, s) for t, s in chosen(harder) + chosen(grid)}.values())
    return valued + [w for w in more if w[0]] + empty + [_planted(t, seed ^ zlib.crc32(f"{k}".encode())) for k, (t, _) in enumerate(empty)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_DOCS, windows: int = DOC_WINDOWS) -> Field:
    """Fit on at most ``rows`` documents with a pattern's match and as many without, the least by hashed id.

    Of each document at most ``windows`` windows with a value, as many without and as many with a long number are taken, by hash over its whole
    text; the former come also in disguise (``_disguised``), the latter also with a drawn value (``_planted``). Documents without an id or text are not learned from.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    # Only texts with a key's letters, in either case, are searched for keys.
    cue = functools.reduce(operator.or_, [F.contains("low", F.lit(c)) for c in _CUES])
    plain = (F.contains("text", F.lit("AKIA")) & F.rlike("text", F.lit(_ACCESS_ANY))) | F.rlike("text", F.lit(_HEX_ANY))
    flagged = texts.withColumn("low", F.lower("text")).select("id", ((cue & F.rlike("text", F.lit(_ASSIGN_ANY))) | plain).alias("hit")).withColumn("h", F.xxhash64("id"))
    # One scan of the texts for both sides; the flags are staged, and sorted limits keep each task's first ones.
    scratch = Scratch(spark, "secrets-fit")
    flagged = scratch.table(flagged, "flags")
    few = [flagged.filter(c).orderBy("h", "id").limit(rows).select("id") for c in ("hit", "NOT hit")]
    ids = [r["id"] for part in few for r in part.collect()]
    scratch.drop("flags")
    if not ids:
        return fit([])
    chosen = spark.createDataFrame([(i,) for i in ids], f"id {dict(texts.dtypes)['id']}").distinct()
    kind = "id long, n int, tokens array<string>, states array<int>, file array<long>"

    def rows_of(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                n = len(TOKEN.findall(text))
                for k, (tokens, states) in enumerate(_windows(text, windows)):
                    out.append((zlib.crc32(text.encode()), k, tokens, states, file_features(text, n)))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["id", "n", "tokens", "states", "file"])

    found = texts.join(F.broadcast(chosen), "id").select("text").mapInArrow(rows_of, kind).distinct()
    # Where ids repeat there may be more texts than ids; the same ones are taken on every run.
    order = [F.xxhash64("tokens", "states"), "id", "n"]
    learned = [(list(r["tokens"]), list(r["states"]), list(r["file"])) for r in found.orderBy(*order).limit(2 * rows * windows * (3 + DISGUISES)).collect()]
    return fit(sorted(learned))


def scan(docs: DataFrame, field: Field, text_col: str = "text", findings_col: str = "findings") -> DataFrame:
    """Add ``findings`` to every row: kind, start and end (code points, end exclusive).

    Whole texts are scanned; a null text is empty and has none. Equal texts have equal
    findings; a column named ``findings``, in any letter case, gives way; no rows give no rows.
    """
    aside = Aside(docs, findings_col)
    carried = aside.working
    rows = docs.select(*aside.take, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(field)  # TABLE x 3 numbers

    def scanned(batches):
        tagger = Tagger(shared.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in find_all(tagger, texts)]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, kind)], names=[*carried, "__findings"])

    found = rows.mapInArrow(scanned, T.StructType([*aside.fields, T.StructField("__findings", FINDINGS)]))
    return found.select(*aside.give, F.col("__findings").alias(findings_col))
