"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of a bounded sample of labelled text. A text is parsed greedily into the longest phrases
that occur in a language's sample; the language that needs the fewest phrases per letter wins.
The parse runs in numpy over all blocks of a batch at once: one table look-up for each symbol and language.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.common import held, map_batches

#: Bounds of the sample that a language is learned from: rows a language, and characters (whole rows are added until one would pass
#: it; if the first alone does, it is cut).
SAMPLE_ROWS = 64
SAMPLE_CHARS = 32_000
#: Sample rows are taken from this range of lengths first.
EASY_LENGTH = (200, 4000)
#: A text is parsed in blocks of so many symbols; a phrase ends with its block, in every language alike.
BLOCK = 512
#: Symbols, the commonest first, whose steps are a table; those of the others are looked up among a language's edges.
DENSE = 96
MISS = np.int32(-(2**31))


class Symbols:
    """Code points as small numbers: 0 no letter, 1 a letter that no sample has, 2.. the samples' letters, the commonest first, and one for padding."""

    def __init__(self, samples: list[str]):
        counts = Counter(c for s in samples for c in s if c.isalpha())
        letters = sorted(counts, key=lambda c: (-counts[c], c))
        self.pad = len(letters) + 2
        self.of = np.zeros(0x110000, np.min_scalar_type(self.pad))
        self.of[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
        for k, c in enumerate(letters):
            self.of[ord(c)] = k + 2
        self.size = self.pad + 1
        self.dense = min(self.size, DENSE)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts with runs of non-letters made one, one at each text's end, and the number of each symbol's text."""
        low = [t.lower() for t in texts]
        line = "".join(f"{t}\n" for t in low)
        symbols = self.of[np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
        keep = symbols > 0
        keep[1:] |= symbols[:-1] > 0
        return symbols[keep], owner[keep]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that knows every factor of the sequence."""
    going, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        now = len(going)
        going.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in going[p]:
            going[p][c] = now
            p = link[p]
        if p >= 0:
            q = going[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(going)
                going.append(dict(going[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and going[p].get(c) == q:
                    going[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return going


class Parser:
    """Phrase counts for each language of a list of texts."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.symbols = Symbols([t.lower() for lang in self.languages for t in samples[lang]])
        self.tables = [self._table(samples[lang]) for lang in self.languages]

    def _table(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The language's automaton: next state for each state and common symbol, with the top bit where a phrase ends before the symbol;
        the sorted (state, symbol) keys of the other symbols' edges, and their next states; and the state that each symbol begins."""
        size, dense = self.symbols.size, self.symbols.dense
        own, _ = self.symbols.read(texts)
        going = suffix_automaton(own.tolist())
        alone = len(going)  # the state after a symbol that the language doesn't have: a phrase of its own
        root = np.full(size, alone, np.int32)
        for c, q in going[0].items():
            root[c] = q
        table = np.empty((alone + 1, dense), np.int32)
        table[:] = root[:dense] | MISS
        table[0] = root[:dense]
        rare = [(s * size + c, q) for s, edges in enumerate(going) for c, q in edges.items() if c >= dense]
        for s, edges in enumerate(going):
            some = [(c, q) for c, q in edges.items() if c < dense]
            if some:
                table[s, [c for c, _ in some]] = [q for _, q in some]
        if self.symbols.pad < dense:
            table[:, self.symbols.pad] = 0
        rare.sort()
        return table.ravel(), np.array([k for k, _ in rare], np.int64), np.array([q for _, q in rare], np.int32), root

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) phrase counts, and the number of symbols of each text."""
        symbols, owner = self.symbols.read(texts)
        size, dense, pad = self.symbols.size, self.symbols.dense, self.symbols.pad
        lengths = np.bincount(owner, minlength=len(texts))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        at = np.arange(len(symbols)) - starts[owner]
        per_text = -(-lengths // BLOCK)
        first = np.concatenate([[0], np.cumsum(per_text)])
        grid = np.full((BLOCK, int(first[-1])), pad, symbols.dtype)
        grid[at % BLOCK, first[owner] + at // BLOCK] = symbols
        of_block = np.repeat(np.arange(len(texts)), per_text)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        grid = grid[: min(BLOCK, int(lengths.max(initial=0)))]
        rare = [np.flatnonzero(row >= dense) for row in grid] if size > dense else None
        for k, (table, keys, ends, root) in enumerate(self.tables):
            state, count = np.zeros(grid.shape[1], np.int32), np.ones(grid.shape[1], np.int32)
            for r, row in enumerate(grid):
                if rare is None:
                    step = table.take(state * dense + row)
                else:
                    step = table.take(state * dense + np.minimum(row, dense - 1))
                    if len(i := rare[r]):
                        step[i] = self._rare(keys, ends, root, state[i], row[i])
                count += step < 0
                state = step & 0x7FFFFFFF
            out[:, k] = np.bincount(of_block, weights=count, minlength=len(texts))
        return out, lengths

    def _rare(self, keys: np.ndarray, ends: np.ndarray, root: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Steps over symbols that the table leaves out."""
        key = state.astype(np.int64) * self.symbols.size + symbol
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
        begun = np.where(state == 0, root[symbol], root[symbol] | MISS)
        step = np.where(known, ends[at] if len(keys) else 0, begun)
        return np.where(symbol == self.symbols.pad, 0, step).astype(np.int32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and a score of 0 to 1 (0.5: two languages tie). ``und`` and 0 without a letter or a learned language."""
        if not self.languages or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        given = [t or "" for t in texts]
        counts, _ = self.phrases(given)
        best = counts.argmin(axis=1)
        few = counts[np.arange(len(given)), best].astype(float)
        others = np.sort(counts, axis=1)[:, 1] if len(self.languages) > 1 else few * 2
        score = others / np.maximum(few + others, 1)
        lettered = [any(map(str.isalpha, t)) for t in given]
        return [self.languages[k] if y else "und" for k, y in zip(best, lettered, strict=True)], [float(s) if y else 0.0 for s, y in zip(score, lettered, strict=True)]


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Whole sample texts by language, at most ``rows`` and about ``chars`` a language.

    Rows are chosen by a hash of their text, so copies of one text count once: the least hash of each of ``rows`` buckets,
    a pre-aggregated minimum. Only those rows reach the driver, none with more than ``chars``: the bound of the sample that is learned from.
    """
    low, high = EASY_LENGTH
    size = F.length(text_col)
    h = F.xxhash64(text_col)
    hashed = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.substring(text_col, 1, chars).alias("text"), F.pmod(h, F.lit(rows)).alias("bucket"),
        F.when(size.between(low, high), F.shiftrightunsigned(h, 2)).otherwise(F.shiftrightunsigned(h, 2) + F.lit(1 << 62)).alias("order"),
    )
    least = hashed.groupBy("lang", "bucket").agg(F.min("order").alias("order"))
    chosen = hashed.join(F.broadcast(least), ["lang", "bucket", "order"], "left_semi").dropDuplicates(["lang", "bucket", "order"])
    out: dict[str, list[str]] = {}
    taken: dict[str, int] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["order"])):
        if r["lang"] not in out or taken[r["lang"]] + len(r["text"]) <= chars:
            out.setdefault(r["lang"], []).append(r["text"])
            taken[r["lang"]] = taken.get(r["lang"], 0) + len(r["text"])
    return out


def _parser(samples: dict[str, list[str]]) -> Parser:
    key = hash(tuple((k, tuple(v)) for k, v in samples.items()))
    return held(("languages", key), lambda: Parser(samples))


def identify(docs: DataFrame, samples: dict[str, list[str]], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and lang_score to every row, from the text alone; no shuffle.

    ``und`` with score 0 for a null, empty or letterless text, and for all if nothing was learned. Equal counts go to the language
    first in the alphabet. Repeated rows get equal answers; columns of docs named like an output are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def make():
        parser = _parser(shared.value)

        def work(texts):
            given, langs, scores = texts.to_pylist(), [], []
            for part in slices(given):
                a, b = parser.predict(part)
                langs += a
                scores += b
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return work

    return map_batches(docs, [text_col], [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())], make, carry)


def slices(texts: list[str | None], chars: int = 4_000_000):
    """Runs of texts of about so many characters, for bounded memory."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part
