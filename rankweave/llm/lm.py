"""Language-model scoring: a small causal self-attention model over subword ids, trained in numpy, and a word unigram base.

Texts are taken as lower-cased (A-Z) words; a word's subwords are its byte-level BPE ids with a space before it, and one end token
closes a text. The model predicts each subword from the CONTEXT or more before it: one attention layer with a bias for each distance,
then the next id as digits (base DIGITS) of its frequency rank, each digit a softmax given the digits before it: two digits for the
commonest ids, three for the next, five for the rest.

Scoring cuts a text's ids into blocks of STRIDE; a block's queries see the block before it and their own past, so windows
overlap, every token is scored once, and all blocks of a batch go through one masked attention.

Texts are encoded once, and their ids stored; counts, training and scores read those. A word is known by a hash of its ids.

Training: word counts of all training texts give the digits' start values; then every training text is learned from once, in rounds.
One trainer learns from a first small share; the trainers of each further round start from the average of the one before, parameters and
Adagrad's sums alike, and their number follows the text. Spark averages the trainers' parameters piece by piece, a few at a time.

A text's score is that of a mixture: a word has the share MIX of the attention model's probability for its subwords, and the rest of the
word unigram's. The share is the best of a few by what each trainer of the last round predicts of its first texts before it learns from them.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.bpe import read_vocabulary
from rankweave.llm.common import map_batches, split_join, stored
from rankweave.llm.near import _powers, mixed, slices, word_hashes

STRIDE, CONTEXT = 16, 16
DIM, DIGITS = 16, 15
#: Characters that a trainer learns from, about, those of the first round's only trainer, rounds after it, blocks a step, learning rate.
TRAINER_CHARS, FIRST_CHARS, ROUNDS, BATCH, RATE = 32 << 20, 4 << 20, 2, 384, 0.2
#: Trainers whose parameters are averaged at once; averages are averaged until one is left.
FAN_IN = 32
#: Shares of the model in the mixture that are tried.
SHARES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
#: Words whose counts are broadcast, the commonest first; the others' are joined.
COMMON_WORDS = 200_000
PIECE = 8192
#: Characters of text that are encoded at once, ids that a trainer shuffles at once, ids that are scored at once.
SLICE, PART, SCORED_IDS = 700_000, 160_000, 280_000
#: Consecutive blocks that are dealt to a training step together, and share their keys.
RUN = 8
#: Blocks whose hidden states are made at once.
SCORED = 128
#: Tokens whose digits are scored at once.
CHUNK = 8192
VISIBLE = re.compile(r"[!-~ ]*")


def openers(ranks: bytes) -> np.ndarray:
    """Whether an id, or the end after the last one, begins with a space, and so a word."""
    table = {int(b): base64.b64decode(a).startswith(b" ") for a, b in map(bytes.split, ranks.splitlines())}
    out = np.zeros(len(table) + 1, bool)
    out[[i for i, opens in table.items() if opens]] = True
    return out


class Subwords:
    """Subword ids of words, remembered by the words' hashes."""

    def __init__(self, ranks: bytes, pattern: str, memo: int = 400_000):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.size, self.end, self.memo = len(table) + 1, len(table), memo
        self.opens = openers(ranks)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.starts, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of words. Those of visible ASCII characters are encoded in one text: the pattern cuts it before every space."""
        whole = " " + " ".join(words)
        if words and VISIBLE.fullmatch(whole):
            ids = self.encoding.encode_to_numpy(whole, disallowed_special=()).astype(np.int32)
            starts = np.flatnonzero(self.opens[ids])
            return ids, np.diff(np.append(starts, len(ids)))
        if len(words) > 1:
            plain = np.array([VISIBLE.fullmatch(w) is not None for w in words])
            if plain.any():
                number = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
                parts = [self.encode([words[i] for i in np.flatnonzero(plain)]), self._each([words[i] for i in np.flatnonzero(~plain)])]
                ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
                ids, _ = gathered(ids, np.concatenate([[0], np.cumsum(sizes)]), np.argsort(number))
                return ids, sizes[np.argsort(number)]
        return self._each(words)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [self.encoding.encode_ordinary(" " + w) for w in words]
        return np.fromiter((i for m in made for i in m), np.int32), np.array([len(m) for m in made], np.int64)

    def of(self, hashes: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of distinct words, given by sorted hashes; words(k) gives those numbered k as strings."""
        if len(self.hashes) > self.memo:
            self.clear()
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        if not known.all():
            new = np.flatnonzero(~known)
            made, lengths = self.encode(words(new))
            size = np.diff(self.starts)
            order = np.argsort(np.concatenate([self.hashes, hashes[new]]), kind="stable")
            starts = np.concatenate([[0], np.cumsum(np.concatenate([size, lengths]))])
            ids = np.concatenate([self.ids, made])
            self.hashes = np.concatenate([self.hashes, hashes[new]])[order]
            self.ids, self.starts = gathered(ids, starts, order)
            at = np.searchsorted(self.hashes, hashes)
        ids, starts = gathered(self.ids, self.starts, at)
        return ids, starts


def gathered(values: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs numbered at of values, one after another, and where each begins."""
    sizes = (starts[1:] - starts[:-1])[at]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(begins[-1]) - np.repeat(begins[:-1] - starts[:-1][at], sizes)], begins


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Words:
    """The distinct words of a list of texts."""

    def __init__(self, texts: list[str | None]):
        self.hashes, self.counts = word_hashes(texts)
        self.unique, first, self.number = np.unique(self.hashes, return_index=True, return_inverse=True)
        self.first = first
        self.raw = b" ".join((t or "").encode("utf-8", "replace") for t in texts).translate(_LOWER)
        self.all: list[bytes] | None = None

    def strings(self, numbers: np.ndarray) -> list[str]:
        if self.all is None:
            self.all = self.raw.split()
        words = self.all
        return [words[i].decode("utf-8", "replace") for i in self.first[numbers].tolist()]


def subword_ids(texts: list[str | None], subwords: Subwords) -> tuple[np.ndarray, np.ndarray, Words]:
    """All texts' ids with the end token after each, where each text begins, and the words."""
    words = Words(texts)
    ids, starts = subwords.of(words.unique, words.strings) if len(words.unique) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    flat, begins = gathered(ids, starts, words.number) if len(words.number) else (ids, starts)
    ends = begins[np.cumsum(words.counts)] if len(texts) else np.zeros(0, np.int64)
    out = np.insert(flat, ends, subwords.end)
    return out, np.concatenate([[0], ends + np.arange(1, len(texts) + 1)]), words


def blocks(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, texts, firsts): ids before and at each place in rows of STRIDE, -1 past a text's end; each row's text, and
    whether it is the text's first row."""
    sizes = np.diff(starts)
    rows = -(-sizes // STRIDE)
    first = np.concatenate([[0], np.cumsum(rows)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(ids)) - starts[:-1][owner] + first[owner] * STRIDE
    targets = np.full(first[-1] * STRIDE, -1, np.int32)
    targets[place] = ids
    inputs = np.full(len(targets), end, np.int32)
    inputs[1:] = np.where(targets[:-1] >= 0, targets[:-1], end)
    inputs[first[:-1][rows > 0] * STRIDE] = end
    firsts = np.zeros(first[-1], bool)
    firsts[first[:-1][rows > 0]] = True
    return inputs.reshape(-1, STRIDE), targets.reshape(-1, STRIDE), np.repeat(np.arange(len(sizes)), rows), firsts



#: Ranks of two and of three digits, and the first digits of these; the other ranks follow the first digit LAST with four digits more.
TWO, THREE = 10 * DIGITS, 4 * DIGITS**2
LAST = 14
LEVELS = ("one", "two", "three", "four", "five")
#: Groups of each level: softmaxes of DIGITS, one for each choice of the digits before.
GROUPS = (1, DIGITS, THREE // DIGITS + DIGITS, DIGITS**2, DIGITS**3)


def _levels(t: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each digit of ranks in rising order: the place of the first rank that has it, then the groups and the digits from there on."""
    a, b = np.searchsorted(t, [TWO, TWO + THREE]).tolist()
    low, mid, high = t[:a], t[a:b] - TWO, t[b:] - (TWO + THREE)
    first = np.concatenate([low // DIGITS, mid // DIGITS**2 + TWO // DIGITS, np.full(len(high), LAST, t.dtype)])
    two = np.concatenate([low % DIGITS, mid // DIGITS % DIGITS, high // DIGITS**3])
    three = np.concatenate([mid % DIGITS, high // DIGITS**2 % DIGITS])
    group = np.concatenate([mid // DIGITS, high // DIGITS**3 + THREE // DIGITS])
    return [(0, np.zeros(len(t), t.dtype), first), (0, first, two), (a, group, three), (b, high // DIGITS**2, high // DIGITS % DIGITS), (b, high // DIGITS, high % DIGITS)]


def start(counts: np.ndarray, seed: int = 9) -> dict[str, np.ndarray]:
    """Parameters before training: random embeddings, and digit biases that give each subword its share of all."""
    rng = np.random.default_rng(seed)
    n = DIGITS**4
    rank = np.argsort(-counts, kind="stable")
    share = np.full(n, 1e-9)
    share[: len(counts)] = (counts[rank] + 0.1) / (counts.sum() + 0.1 * len(counts))
    small = lambda *shape: rng.normal(0, 1 / math.sqrt(DIM), shape).astype(np.float32)
    out = {"rank": np.argsort(rank).astype(np.int32), "embed": small(n, DIM), "far": np.zeros(STRIDE + CONTEXT, np.float32)}
    out |= {k: small(DIM, DIM) for k in ("query", "key", "value", "self")}
    for name, groups, (at, group, digit) in zip(LEVELS, GROUPS, _levels(np.arange(n)), strict=True):  # the last row is a bias
        sums = np.bincount(group * DIGITS + digit, weights=share[at:], minlength=groups * DIGITS)
        bias = np.log(np.maximum(sums, 1e-12)).reshape(groups, 1, DIGITS).astype(np.float32)
        out[name] = np.concatenate([0.1 * small(groups, DIM, DIGITS), bias], axis=1)
    return out


def _distance() -> tuple[np.ndarray, np.ndarray]:
    """(queries x keys) distances back from a query, and a mask of keys in its future."""
    back = np.arange(STRIDE)[:, None] + CONTEXT - np.arange(STRIDE + CONTEXT)[None]
    return np.maximum(back, 0), back < 0


_BACK, _FUTURE = _distance()
_ONES, _ONES_DIGITS = np.ones(STRIDE + CONTEXT, np.float32), np.ones(DIGITS, np.float32)
_ONES_DIM = np.ones(DIM, np.float32)


def _runs(group: np.ndarray, at: int) -> list[tuple[int, int, int]]:
    """The runs (group, from, to) of equal groups in order, the first at place at."""
    begins = np.flatnonzero(np.concatenate([np.ones(min(len(group), 1), bool), group[1:] != group[:-1]]))
    places = (begins + at).tolist()
    return list(zip(group[begins].tolist(), places, [*places[1:], len(group) + at], strict=True))


def with_one(h: np.ndarray) -> np.ndarray:
    """States with a last component of one, for the biases."""
    out = np.ones((len(h), DIM + 1), np.float32)
    out[:, :DIM] = h
    return out


def _shares(x: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The softmax of x's last axis, in place; a product with ones sums the axis faster than a sum over so few numbers."""
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x /= (x @ ones)[..., None]
    return x


class Model:
    """Forward and backward passes over blocks of ids (already frequency ranks)."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self.tables = None

    def attend(self, inputs: np.ndarray, firsts: np.ndarray, before: np.ndarray) -> tuple:
        """Hidden states of the blocks, and what led to them. The blocks stand in equal runs of consecutive ones; before: the inputs of
        the block before each run. Each different id is multiplied once, and the keys of a block are a view of its run's."""
        p = self.p
        runs = len(before)
        each = len(inputs) // max(runs, 1)
        rows = np.concatenate([before[:, None], inputs.reshape(runs, each, STRIDE)], axis=1)
        ids = np.flatnonzero(np.bincount(rows.ravel(), minlength=1))
        number = np.empty(ids[-1] + 1, np.int32)
        number[ids] = np.arange(len(ids))
        at = number[rows]
        known = p["embed"][ids]
        near_by = np.concatenate([p["query"] / np.float32(math.sqrt(DIM)), p["self"]], axis=1), np.concatenate([p["key"], p["value"]], axis=1)
        q = (known @ near_by[0]).take(at[:, 1:].reshape(inputs.shape), axis=0)
        kv = (known @ near_by[1]).take(at.reshape(runs, -1), axis=0)
        a, b, c = kv.strides
        kv = np.lib.stride_tricks.as_strided(kv, (runs, each, CONTEXT + STRIDE, 2 * DIM), (a, STRIDE * b, b, c), writeable=False)
        q4 = q.reshape(runs, each, STRIDE, 2 * DIM)
        weights = (q4[..., :DIM] @ kv[..., :DIM].swapaxes(2, 3)).reshape(len(inputs), STRIDE, -1)
        weights += np.where(_FUTURE, np.float32(-1e9), p["far"][np.minimum(_BACK, STRIDE + CONTEXT - 1)])
        weights[firsts, :, :CONTEXT] = -1e9
        _shares(weights, _ONES)
        seen = (weights.reshape(runs, each, STRIDE, -1) @ kv[..., DIM:]).reshape(len(inputs), STRIDE, DIM)
        return np.tanh(seen + q[..., DIM:]), weights, seen, q4[..., :DIM], kv, at, ids, known, near_by

    def states(self, inputs: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """The hidden states of consecutive blocks, as attend gives them; the first block must be a text's first.

        Every id's query, key, value and own part come from one table; the softmax is divided out after the weighted sum.
        """
        p = self.p
        if self.tables is None:
            scaled = [p["query"] / math.sqrt(DIM), p["key"], p["value"], p["self"]]
            self.tables = np.concatenate([p["embed"] @ w for w in scaled], axis=1)
            self.near = np.where(_FUTURE, np.float32(-1e9), p["far"][np.minimum(_BACK, STRIDE + CONTEXT - 1)])
        found = self.tables.take(np.concatenate([inputs[:1], inputs]), axis=0)  # a block more, in whose place the first one's masked context is
        q, own = found[1:, :, :DIM], found[1:, :, 3 * DIM :]
        _, b, c = found.strides
        keys = np.lib.stride_tricks.as_strided(found[:, :, DIM:], (len(inputs), CONTEXT + STRIDE, 2 * DIM), (STRIDE * b, b, c), writeable=False)
        scores = q @ keys[..., :DIM].transpose(0, 2, 1)
        scores += self.near
        scores[firsts, :, :CONTEXT] = -1e9
        np.minimum(scores, 60, out=scores)
        np.exp(scores, out=scores)
        seen = scores @ keys[..., DIM:]
        seen /= (scores @ _ONES)[..., None]
        seen += own
        return np.tanh(seen, out=seen)

    def log_probs(self, inputs: np.ndarray, targets: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Natural log probability of each target; 0 where there is none. The first block must be a text's first."""
        hidden = np.ones((*inputs.shape, DIM + 1), np.float32)
        for i in range(0, len(inputs), SCORED):  # a run takes the block before it along, as the context of its first
            skip = int(i > 0)
            hidden[i : i + SCORED, :, :DIM] = self.states(inputs[i - skip : i + SCORED], firsts[i - skip : i + SCORED])[skip:]
        out = np.zeros(targets.size, np.float64)
        real = np.flatnonzero(targets.ravel() >= 0)
        out[real] = self.digits(hidden.reshape(-1, DIM + 1)[real], targets.ravel()[real])
        return out.reshape(targets.shape)

    def digits(self, h: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Log probabilities of ranks t after states h (with_one); sorted, so that each group is one product."""
        order = np.argsort(t.astype(np.uint16), kind="stable")
        back = np.empty(len(t), np.float64)
        exact = {name: self.p[name].astype(np.float64) for name in LEVELS}
        room = np.empty((CHUNK, DIGITS), np.float64)
        for at in range(0, len(t), CHUNK):  # sums stay in the processor's cache
            k = order[at : at + CHUNK]
            back[k] = self._digits(exact, h.take(k, axis=0).astype(np.float64), t[k], room[: len(k)])
        return back

    def _digits(self, exact: dict[str, np.ndarray], h: np.ndarray, t: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The same for ranks that are in order already. Products are made in double precision and rounded: in single precision
        their last bit depends on the rows around, and equal texts would not score alike."""
        out = np.zeros(len(t), np.float32)
        places = np.arange(0, room.size, DIGITS)
        for name, (at, group, digit) in zip(LEVELS, _levels(t), strict=True):
            if at == len(t):
                continue
            inner = exact[name]
            for g, x, y in _runs(group, at):
                np.matmul(h[x:y], inner[g], out=room[x:y])
            logits = room[at:].astype(np.float32)
            out[at:] += logits.ravel()[places[: len(digit)] + digit]
            np.exp(logits, out=logits)  # states are within 1 and logits start as log shares: no exponential runs over
            out[at:] -= np.log(logits @ _ONES_DIGITS)
        return out

    def step(self, inputs: np.ndarray, targets: np.ndarray, firsts: np.ndarray, before: np.ndarray, sums: dict[str, np.ndarray], rate: float) -> None:
        """One Adagrad step on the blocks' mean loss; the blocks as attend takes them."""
        p = self.p
        hidden, weights, seen, q, kv, number, ids, known, near_by = self.attend(inputs, firsts, before)
        flat = hidden.reshape(-1, DIM)
        real = np.flatnonzero(targets.ravel() >= 0)
        real = real[np.argsort(targets.ravel()[real].astype(np.uint16), kind="stable")]
        h, t = with_one(flat.take(real, axis=0)), targets.ravel()[real]
        scale, places = np.float32(1 / max(len(t), 1)), np.arange(0, len(t) * DIGITS, DIGITS)
        room, dh = np.empty((len(t), DIGITS), np.float32), np.zeros((len(t), DIM), np.float32)
        for name, (at, group, digit) in zip(LEVELS, _levels(t), strict=True):
            if at == len(t):
                continue
            inner, e, runs = p[name], room[at:], _runs(group, at)
            for g, x, y in runs:
                np.matmul(h[x:y], inner[g], out=room[x:y])
            _shares(e, _ONES_DIGITS)
            e.ravel()[places[: len(digit)] + digit] -= 1
            e *= scale
            own = np.empty((len(runs), *inner.shape[1:]), np.float32)
            for i, (g, x, y) in enumerate(runs):
                dh[x:y] += room[x:y] @ inner[g, :DIM].T
                np.matmul(h[x:y].T, room[x:y], out=own[i])
            self._learn(name, sums, np.array([g for g, _, _ in runs], np.int64), own, rate)  # groups without a target have no gradient
        d = np.zeros_like(flat)
        d[real] = dh
        flat *= flat
        np.subtract(1, flat, out=flat)
        d *= flat
        d = d.reshape(hidden.shape)
        d4, w4 = d.reshape(q.shape), weights.reshape(*q.shape[:3], -1)
        seen *= d
        dscore = d4 @ kv[..., DIM:].swapaxes(2, 3)
        dscore -= (seen @ _ONES_DIM).reshape(*q.shape[:3], 1)
        dkv = np.empty((*q.shape[:2], CONTEXT + STRIDE, 2 * DIM), np.float32)
        np.matmul(w4.swapaxes(2, 3), d4, out=dkv[..., DIM:])
        dscore *= w4
        grads = {"far": np.bincount(_BACK.ravel(), weights=dscore.reshape(weights.shape).sum(0).ravel(), minlength=STRIDE + CONTEXT)[: STRIDE + CONTEXT].astype(np.float32)}
        np.matmul(dscore.swapaxes(2, 3), q, out=dkv[..., :DIM])
        each = np.zeros((len(q), q.shape[1] + 1, STRIDE, 4 * DIM), np.float32)  # of every id in its place: by query, self, key and value
        np.matmul(dscore, kv[..., :DIM], out=each[:, 1:, :, :DIM])
        each[:, 1:, :, DIM : 2 * DIM] = d4
        each[:, :-1, :, 2 * DIM :] = dkv[:, :, :CONTEXT]
        each[:, 1:, :, 2 * DIM :] += dkv[:, :, CONTEXT:]
        order = np.argsort(number.ravel().astype(np.uint16), kind="stable")
        cuts = np.searchsorted(number.ravel()[order], np.arange(len(ids)))
        total = np.add.reduceat(each.reshape(-1, 4 * DIM).take(order, axis=0).view(np.complex64), cuts).view(np.float32)  # two sums at once
        inner = known.T @ total
        grads["query"], grads["self"], grads["key"], grads["value"] = (np.ascontiguousarray(inner[:, i * DIM : (i + 1) * DIM]) for i in range(4))
        grads["query"] *= np.float32(1 / math.sqrt(DIM))
        self._learn("embed", sums, ids, total @ np.concatenate(near_by, axis=1).T, rate)
        for name, g in grads.items():
            self._learn(name, sums, slice(None), g, rate)

    def _learn(self, name: str, sums: dict[str, np.ndarray], rows, g: np.ndarray, rate: float) -> None:
        """Adagrad on some rows of a parameter; g is used up."""
        total = sums[name][rows] + g * g
        sums[name][rows] = total
        total += 1e-10
        g /= np.sqrt(total, out=total)
        g *= rate
        self.p[name][rows] -= g


def _before(inputs: np.ndarray) -> np.ndarray:
    """The block before each block; that before a text's first is masked."""
    return np.roll(inputs, 1, axis=0)


_LOADED: dict[str, tuple] = {}


def _once(kind: str, key: str, make):
    """One object a kind and Python worker, made anew for another key."""
    if _LOADED.get(kind, (None,))[0] != key:
        _LOADED[kind] = key, make()
    return _LOADED[kind][1]


def encoded(texts: DataFrame, text_col: str, ranks, pattern: str, carry: list[str]) -> DataFrame:
    """Adds _ids, a text's subword ids and the end after them (binary, little-endian unsigned 16-bit), and _chars. A null text is an empty one."""
    mark = hashlib.sha256(ranks.value + pattern.encode()).hexdigest()

    def make():
        subwords = _once("subwords", mark, lambda: Subwords(ranks.value, pattern))

        def work(column):
            ids, sizes, chars = [], [], []
            for part in slices(column.to_pylist(), SLICE):
                made, starts, _ = subword_ids(part, subwords)
                ids.append(made.astype("<u2"))
                sizes.append(np.diff(starts))
                chars += [len(t or "") + 1 for t in part]
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes) * 2)]).astype(np.int32) if sizes else np.zeros(1, np.int32)
            data = np.concatenate(ids) if ids else np.zeros(0, "<u2")
            return [pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]), pa.array(chars, pa.int64())]

        return work

    return map_batches(texts, [text_col], [T.StructField("_ids", T.BinaryType()), T.StructField("_chars", T.LongType())], make, carry)


def id_parts(column: pa.Array, most: int):
    """(ids, starts) of the texts of a column of _ids, some texts at a time: those that begin within so many ids."""
    column = column.cast(pa.binary())
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 2
    data = np.frombuffer(column.buffers()[2], "<u2")
    cuts = np.flatnonzero(np.diff((ends[:-1] - ends[0]) // most, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(column)], strict=True):
        yield data[ends[a] : ends[b]].astype(np.int32), (ends[a : b + 1] - ends[a]).astype(np.int64)


_VALUES = mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def units(ids: np.ndarray, opens: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each unit (a word, or the end of a text) begins among the ids, and a hash of its ids: equal for equal words, 0 for ends.

    A word is told from the next by the space its first id begins with; its ids give its bytes back, so they are hashed, not the text.
    """
    is_end = ids == end
    starts = np.flatnonzero(opens[ids] | is_end)
    power, inverse = _powers(len(ids) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES.take(ids) * power[: len(ids)], dtype=np.uint64)])
    hashes = mixed((sums[np.append(starts[1:], len(ids))] - sums[starts]) * inverse[starts])
    hashes[hashes == 0] = 1
    hashes[is_end[starts]] = 0
    return starts, hashes


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def count_units(texts: DataFrame, ranks, opens: np.ndarray, end: int) -> DataFrame:
    """(subword, h, n) over all _ids: how often each subword occurs (h null) and each unit by its hash (subword null), ends with h = 0."""
    shared = texts.sparkSession.sparkContext.broadcast(opens)

    def run(batches):
        opens, total, keys, n = shared.value, np.zeros(end + 1, np.int64), [], []

        def batch():
            k, m = summed(np.concatenate(keys), np.concatenate(n))
            keys.clear()
            n.clear()
            return k, m

        def rows(k, m):
            return pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int32()), pa.array(k.view(np.int64)), pa.array(m)], names=["subword", "h", "n"])

        for b in batches:
            for ids, _ in id_parts(b.column(0), PART):
                total += np.bincount(ids, minlength=end + 1)
                k = units(ids, opens, end)[1]
                k, m = summed(k, np.ones(len(k), np.int64))
                keys.append(k)
                n.append(m)
                if sum(map(len, keys)) > 1_000_000:
                    k, m = batch()
                    if len(k) > 500_000:
                        yield rows(k, m)
                    else:
                        keys.append(k)
                        n.append(m)
        if keys:
            yield rows(*batch())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.nulls(len(some), pa.int64()), pa.array(total[some])], names=["subword", "h", "n"])

    return texts.select("_ids").mapInArrow(run, "subword int, h bigint, n bigint").groupBy("subword", "h").agg(F.sum("n").alias("n"))


class Counts:
    """Broadcast word counts as log10 probabilities of the unigram base."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray, ends: int, under: int):
        self.hashes, self.numbers, self.ends, self.under = hashes, numbers, ends, under

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts of units by their hashes, 0 for those that are not among the broadcast ones, and which are."""
        unique, number = np.unique(hashes, return_inverse=True)
        at = np.searchsorted(self.hashes, unique)
        found = at < len(self.hashes)
        found[found] = self.hashes[at[found]] == unique[found]
        n = np.zeros(len(unique), np.int64)
        n[found] = self.numbers[at[found]]
        n[unique == 0], found[unique == 0] = self.ends, True
        return n[number], found[number]


def unit_scores(model: Model, ids: np.ndarray, starts: np.ndarray, begins: np.ndarray, end: int) -> np.ndarray:
    """The model's log10 probability of each unit, in the order of the texts; begins: where the units begin among the ids."""
    rank = model.p["rank"]
    inputs, targets, _, firsts = blocks(rank[ids], starts, int(rank[end]))
    if not len(inputs):
        return np.zeros(0)
    flat = model.log_probs(inputs, targets, firsts).ravel()[targets.ravel() >= 0]
    return np.add.reduceat(flat, begins) / math.log(10)


def mixed_log(model_log: np.ndarray, base_log: np.ndarray, share: float) -> np.ndarray:
    """log10 of share * model + (1 - share) * base."""
    return np.logaddexp(model_log * math.log(10) + math.log(share), base_log * math.log(10) + math.log1p(-share)) / math.log(10)


def averaged(made: DataFrame, trainers: int) -> DataFrame:
    """(piece, numbers): the mean of all trainers' pieces, weighed by what each has seen, FAN_IN at a time."""

    def mean(t: pa.Table) -> pa.Table:
        weight = t.column("seen").to_numpy().astype(float)
        order = np.lexsort((t.column("numbers").to_numpy(zero_copy_only=False), weight))
        rows = t.column("numbers").to_pylist()
        total = sum(np.frombuffer(rows[i], np.float32) * weight[i] for i in order) / weight.sum()
        return pa.table({"piece": t.column("piece").slice(0, 1), "trainer": pa.array([t.column("trainer")[0].as_py() // FAN_IN]), "seen": pa.array([int(weight.sum())]), "numbers": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    while True:
        made = made.groupBy("piece", F.floor(F.col("trainer") / FAN_IN).alias("among")).applyInArrow(mean, made.schema)
        trainers = -(-trainers // FAN_IN)
        if trainers <= 1:
            return made.select("piece", "numbers")


def train(texts: DataFrame, text_col: str, params: dict[str, np.ndarray], ranks, pattern: str, known: Counts | None = None, rate: float = RATE) -> tuple[dict[str, np.ndarray], float]:
    """(parameters, share of the model in the mixture) after one pass over all texts."""
    return learn(stored(encoded(texts.select(text_col), text_col, ranks, pattern, []), "lm-ids"), params, openers(ranks.value), known, rate)


def dealt(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, firsts) of the texts' blocks in runs of RUN, the last filled with blocks of no target, and the inputs before each run."""
    inputs, targets, _, firsts = blocks(ids, starts, end)
    more = -len(inputs) % RUN
    inputs = np.concatenate([inputs, np.full((more, STRIDE), end, inputs.dtype)])
    targets = np.concatenate([targets, np.full((more, STRIDE), -1, targets.dtype)])
    firsts = np.concatenate([firsts, np.ones(more, bool)])
    return inputs.reshape(-1, RUN, STRIDE), targets.reshape(-1, RUN, STRIDE), firsts.reshape(-1, RUN), _before(inputs)[::RUN]


def learn(given: DataFrame, params: dict[str, np.ndarray], opens: np.ndarray, known: Counts | None = None, rate: float = RATE) -> tuple[dict[str, np.ndarray], float]:
    """train over texts that are encoded; no text and no gradient reaches the driver."""
    spark = given.sparkSession
    end = len(opens) - 1
    chars = given.agg(F.coalesce(F.sum("_chars"), F.lit(0))).first()[0]
    names = [k for k in params if k != "rank"]
    shapes = {k: params[k].shape for k in names}
    first = min(1 / (ROUNDS + 1), FIRST_CHARS / max(chars, 1))
    bounds = [0.0, *(first + (1 - first) * i / ROUNDS for i in range(ROUNDS + 1))]
    place = F.pmod(F.xxhash64("_ids"), F.lit(1 << 20)) / (1 << 20)
    sums = {k: np.zeros(shapes[k], np.float32) for k in names}
    share = 0.5
    for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        trainers = 1 if k == 0 else max(1, round(chars * (high - low) / TRAINER_CHARS))
        shared = spark.sparkContext.broadcast((params, sums, known, opens))
        last = k == ROUNDS

        def run(batches, shared=shared, last=last):
            start, total, known, opens = shared.value
            now, own = {n: v.copy() for n, v in start.items()}, {n: v.copy() for n, v in total.items()}
            model, rng, rank = Model(now), np.random.default_rng(1), start["rank"]
            seen, gains = 0, np.zeros(len(SHARES))
            for ids, starts in (p for b in batches for p in id_parts(b.column(0), PART)):
                if last and not seen and known:
                    begins, hashes = units(ids, opens, end)
                    said = unit_scores(model, ids, starts, begins, end)
                    base = np.log10(np.maximum(known.of(hashes)[0], 1) / known.under)  # a training word's count is taken without the word itself
                    gains += [mixed_log(said, base, x).sum() for x in SHARES]
                    model.tables = None
                inputs, targets, firsts, before = dealt(rank[ids], starts, int(rank[end]))
                order = rng.permutation(len(inputs))
                for at in range(0, len(order), BATCH // RUN):
                    i = order[at : at + BATCH // RUN]
                    model.step(inputs[i].reshape(-1, STRIDE), targets[i].reshape(-1, STRIDE), firsts[i].ravel(), before[i], own, rate)
                seen += len(ids)
            if seen:
                flat = np.concatenate([x[n].ravel() for x in (now, own) for n in names] + [gains / seen]).astype(np.float32)
                me = TaskContext.get().partitionId()
                for i in range(0, len(flat), PIECE):
                    yield pa.RecordBatch.from_arrays([pa.array([i // PIECE]), pa.array([me]), pa.array([seen]), pa.array([flat[i : i + PIECE].tobytes()], pa.binary())], names=["piece", "trainer", "seen", "numbers"])

        of_round = given.where((place >= low) & (place < high)).select("_ids")
        pieces = averaged(of_round.repartition(trainers).mapInArrow(run, "piece bigint, trainer bigint, seen bigint, numbers binary"), trainers).collect()
        if pieces:
            flat = np.concatenate([np.frombuffer(r["numbers"], np.float32) for r in sorted(pieces, key=lambda r: r["piece"])])
            cuts = np.cumsum([0, *(math.prod(shapes[n]) for n in names + names), len(SHARES)])
            parts = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            params = {"rank": params["rank"]} | {n: x.reshape(shapes[n]).copy() for n, x in zip(names, parts, strict=False)}
            sums = {n: x.reshape(shapes[n]).copy() for n, x in zip(names, parts[len(names) :], strict=False)}
            if last and parts[-1].any():
                share = SHARES[int(parts[-1].argmax())]
    return params, share


def score(docs: DataFrame, training: DataFrame | Column, vocabulary_path: str, pattern: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score (both log10 probabilities of the whole text) to every row of docs.

    training: the texts to learn from, or which rows of docs are; these are encoded once, for learning and for scoring.
    A null text counts as empty, its one token the end. Words never seen have count 0; without training rows all have, and the model
    is untrained. Rows stay as they are, repeated ones too (equal texts, equal scores); columns named like an output are replaced.
    COMMON_WORDS word counts and the model (its size is fixed by the vocabulary) are broadcast; other counts are joined by hash.
    """
    spark = docs.sparkSession
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in new]
    vocabulary = read_vocabulary(vocabulary_path)
    ranks = spark.sparkContext.broadcast(vocabulary)
    opens = openers(vocabulary)
    end = len(opens) - 1
    if isinstance(training, Column):
        every = stored(encoded(docs.withColumn("_learned", training), text_col, ranks, pattern, [*carry, "_learned"]), "lm-ids")
        given = every.where("_learned")
    else:
        every = encoded(docs, text_col, ranks, pattern, carry)
        given = stored(encoded(training.select(text_col), text_col, ranks, pattern, []), "lm-ids")
    every_count = stored(count_units(given, ranks, opens, end), "lm-words")
    counts = every_count.where("h is not null").select("h", "n")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    of_ids = np.zeros(len(opens), np.int64)
    for r in every_count.where("subword is not null").collect():
        of_ids[r["subword"]] = r["n"]
    ends = int(of_ids[end])
    common = counts.where("h <> 0").orderBy(F.desc("n"), "h").limit(COMMON_WORDS).toArrow()
    hashes, numbers = (common.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(hashes.view(np.uint64))
    under = total + distinct + 1
    known = Counts(hashes.view(np.uint64)[order], numbers[order], ends, under)
    params, share = learn(given, start(of_ids), opens, known)
    all_common = distinct <= len(hashes) + (ends > 0)
    shared = spark.sparkContext.broadcast((params, known, opens))
    mark = hashlib.sha256(vocabulary + pattern.encode() + b"".join(params[k].tobytes() for k in sorted(params))).hexdigest()

    def make():
        params, known, opens = shared.value
        model = _once("model", mark, lambda: Model(params))

        def work(column):
            cols: list[list] = [[], [], [], []]
            rare_hashes, rare_said, rare_n = [], [], []
            for ids, starts in id_parts(column, SCORED_IDS):
                begins, hashes = units(ids, opens, end)
                said = unit_scores(model, ids, starts, begins, end)
                n, found = known.of(hashes)
                base = np.log10((n + 1.0) / known.under)
                firsts = np.searchsorted(begins, starts[:-1])  # every text has an end, so a unit
                rare = ~found
                n_units, n_rare = np.diff(np.append(firsts, len(begins))), np.add.reduceat(rare.astype(np.int64), firsts)
                for col, x in zip(cols, (n_units, n_units - n_rare - 1, np.add.reduceat(base, firsts), np.add.reduceat(mixed_log(said, base, share), firsts)), strict=True):
                    col.append(x)
                rare_hashes.append(hashes[rare].view(np.int64))
                rare_said.append(said[rare])
                rare_n.append(n_rare)
            whole = [np.concatenate(c) if c else np.zeros(0) for c in cols]
            held = [np.concatenate(x) if x and not all_common else np.zeros(0, t) for x, t in ((rare_hashes, np.int64), (rare_said, float), (rare_n, np.int64))]
            offsets = np.concatenate([[0], np.cumsum(held[2] if not all_common else np.zeros(len(whole[0]), np.int64))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in held[:2]]
            return [*(pa.array(x.astype(t)) for x, t in zip(whole, (np.int64, np.int64, float, float), strict=True)), *lists]

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("_common", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("_rare", T.ArrayType(T.LongType())), T.StructField("_said", T.ArrayType(T.DoubleType()))]
    scored = map_batches(every, ["_ids"], fields, make, carry)
    n_known = F.col("_common") + F.lit(int(ends > 0))
    counted = F.lit(int(total)).cast("long").alias("train_tokens")
    if all_common:
        return scored.select(*carry, "n_tokens", n_known.alias("n_known"), counted, "base_score", "score")
    scored = stored(scored.withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("_row", F.explode(F.arrays_zip(F.col("_rare").alias("h"), F.col("_said").alias("said"))).alias("r")).select("_row", "r.h", "r.said")
    rest = counts.where("h <> 0")
    mix = lambda n: F.log10(share * F.pow(F.lit(10.0), "said") + (1 - share) * n / under)
    gained = split_join(rare, rest, ["h"]).groupBy("_row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.sum(mix(F.col("n") + 1) - mix(F.lit(1))).alias("gain"), F.count("*").alias("found"))
    out = scored.join(gained, "_row", "left")
    zero = F.lit(0.0)
    return out.select(
        *carry, "n_tokens", (n_known + F.coalesce("found", F.lit(0))).alias("n_known"), counted, (F.col("base_score") + F.coalesce("more", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("gain", zero)).alias("score"),
    )
