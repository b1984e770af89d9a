"""Toxicity scores over deobfuscated text.

Noisy channel: a suspicious token (digits or signs among letters, letters set apart, doubled letters) becomes a lattice of
the letters it may stand for, in which a separator is nothing or the end of a word; a Viterbi pass under a character trigram model picks the likeliest reading. Restored words
then match a lexicon of words and word beginnings learned from labelled text.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.common import dropped, held, held_out, map_batches, stored

#: Bounds of the fit: labelled rows (a share of them by hash beyond this), lexicon entries, words of the character model.
SAMPLE_ROWS = 24_000
LEXICON = 20_000
MODEL_WORDS = 20_000
#: A lexicon entry is in so many toxic sample texts at least, and so large a share of the texts that hold it is toxic.
LEAST_TEXTS, LEAST_SHARE = 5, 0.9
THRESHOLD = 0.3
#: Lengths of word beginnings that count as features beside whole words.
STEMS = (4, 5, 6, 7)

#: Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c"}

_WORD = re.compile(r"[^\W\d_]+")
_LEET = re.compile(r"(?<![\w@$!|+(])(?=[\w@$!|+(]*[^\W\d_])[\w@$!|+(]{3,}")
#: What may stand between the letters of a word that is spaced out.
_APART = frozenset(" .-_*/\\,;:~'\"\u00b7\u2022\t")
_GAP = "[" + re.escape("".join(sorted(_APART))) + "]"
_SPACED = re.compile(rf"(?<!\w)[\w@$!](?:{_GAP}{{1,4}}[\w@$!(|+])+(?!\w)")
_PIECES = re.compile(rf"(?<!\w)\w{{1,4}}(?:{_GAP}{{1,3}}\w{{1,4}})+(?!\w)")
_GAPS = re.compile(f"{_GAP}+")
_RUN = re.compile(r"(.)\1")
#: Longer tokens are read each time, not remembered.
MEMO_CHARS = 64
_ODD = re.compile(r"[\d@$!|+(]")


class Letters:
    """Interpolated character trigrams with word boundaries."""

    def __init__(self, words: dict[str, int]):
        tri, bi, uni = Counter(), Counter(), Counter()
        for w, n in words.items():
            s = f"^^{w}$"
            weight = 1 + math.log(max(n, 1))
            for i in range(2, len(s)):
                tri[s[i - 2 : i + 1]] += weight
                bi[s[i - 2 : i]] += weight
                uni[s[i]] += weight
        self.total, self.tri, self.bi, self.uni = sum(uni.values()) or 1, dict(tri), dict(bi), dict(uni)
        self.memo: dict[str, float] = {}

    def cost(self, before: str, c: str) -> float:
        key = before + c
        got = self.memo.get(key)
        if got is None:
            low = (self.uni.get(c, 0) + 0.1) / (self.total + 10)
            n = self.bi.get(before, 0)
            got = self.memo[key] = -math.log((self.tri.get(key, 0) + 3 * low) / (n + 3))
        return got


#: Channel costs (negative log probabilities): a sign read as a letter, a letter of a run left out, a run kept whole, a separator
#: that ends a word.
SIGN_COST, DROP_COST, KEEP_COST, BREAK_COST = 0.7, 0.3, 1.5, 0.7


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each place of a token the letters it may stand for, with the channel's costs: a sign one of its letters, a run of one sign one, two
    or three of it, a separator nothing or the end of a word."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c = token[i]
        run = i + 1
        while run < len(token) and (token[run] == c or (c in _APART and token[run] in _APART)):
            run += 1
        if c in _APART:
            if out and run < len(token):
                out.append([("", 0.0), (" ", BREAK_COST)])
            i = run
            continue
        reads = [(x, SIGN_COST) for x in SIGNS.get(c, "")] or [(c, 0.0)]
        n = run - i
        if n == 1:
            out.append(reads)
        else:
            out.append([(x * k, cost * k + (DROP_COST if k < n else KEEP_COST * (n > 2))) for x, cost in reads for k in {1, 2, min(n, 3)} if k <= n])
        i = run
    return out


def restored(token: str, model: Letters) -> str:
    """The likeliest words behind a token, with spaces between them, by Viterbi over (last two letters)."""
    best: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}  # a word is (word before, letters), so that long tokens take linear time
    for reads in lattice(token):
        after: dict[str, tuple[float, tuple]] = {}
        for state, (cost, word) in best.items():
            for letters, channel in reads:
                total, s = cost + channel, state
                if letters == " ":
                    total, s = total + model.cost(s, "$"), "^^"
                else:
                    for c in letters:
                        total += model.cost(s, c)
                        s = s[1] + c
                if s not in after or total < after[s][0]:
                    after[s] = total, (word, letters)
        best = after
    _, _, word = min((cost + model.cost(s, "$"), s, word) for s, (cost, word) in best.items())
    read = []
    while word:
        word, letters = word
        read.append(letters)
    return "".join(reversed(read))


class Scorer:
    """Restores a text's words and scores them by the lexicon."""

    def __init__(self, lexicon: dict[str, float], model_words: dict[str, int], base: float, memo_size: int = 200_000):
        self.lexicon, self.base, self.letters, self.memo, self.memo_size = lexicon, base, Letters(model_words), {}, memo_size
        self.known = set(model_words)
        self.heads = {f[:4] for f in lexicon}
        self.stems = {f[:-1]: p for f, p in lexicon.items() if f.endswith("*")}

    def words(self, text: str) -> set[str]:
        """Distinct words as they are, and the readings of suspicious tokens."""
        low = text.lower()
        found = set(_WORD.findall(low))
        odd = {w for w in found if _RUN.search(w)}
        if _ODD.search(low):
            odd.update(m.group() for m in _LEET.finditer(low) if _ODD.search(m.group()))
        odd.update(m.group() for m in _SPACED.finditer(low))
        if any(len(w) <= 4 and w not in self.known for w in found):
            odd.update(self.pieces(low))
        for token in odd:
            got = self.memo.get(token)
            if got is None:
                stripped = token.strip("!|+( .-_*/,;:~")
                got = tuple({w for t in {token, stripped} for w in restored(t, self.letters).split()})
                if len(token) <= MEMO_CHARS:
                    if len(self.memo) >= self.memo_size:
                        self.memo.clear()
                    self.memo[token] = got
            found.update(got)
        return found

    def pieces(self, low: str):
        """Runs of two and more short pieces, none of them a known word: a word with a break inside, perhaps."""
        for m in _PIECES.finditer(low):
            run: list[str] = []
            for piece in [*_GAPS.split(m.group()), ""]:
                if piece and piece not in self.known:
                    run.append(piece)
                    continue
                if len(run) > 1:
                    yield " ".join(run)
                run = []

    def share(self, word: str) -> float:
        """The toxic share of the longest entry that the word matches, or 0."""
        if word[:4] not in self.heads:
            return 0.0
        if word in self.lexicon:
            return self.lexicon[word]
        for n in reversed(STEMS):
            if len(word) >= n and (p := self.stems.get(word[:n])):
                return p
        return 0.0

    def score(self, text: str | None) -> float:
        clean = 1 - self.base
        if text:
            for w in self.words(text):
                if p := self.share(w):
                    clean *= 1 - p
        return 1 - clean


def _features(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> dict:
    """Lexicon, character model words and base rate from labelled rows (nulls in either column are left out).

    The rows given are a bounded sample already; counts are made in the tasks, added up by Spark, and only entries that
    pass the thresholds, at most LEXICON of them, and the MODEL_WORDS commonest words reach the driver. A word's beginning is an entry only
    beside a whole word: copies of a toxic text share other rare beginnings. The base rate is that of the rows without an entry.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(text_col).alias("t"), (F.col(label_col) > 0).alias("y")).distinct()

    def count(batches):
        for batch in batches:
            seen, toxic = Counter(), Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _features(text)
                seen.update(found)
                if y:
                    toxic.update(found)
            names = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[f] for f in names], pa.int64()), pa.array([toxic[f] for f in names], pa.int64())], names=["feature", "n", "toxic"])

    rows = stored(rows, "labelled")
    counts = rows.mapInArrow(count, "feature string, n bigint, toxic bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counts = stored(counts, "features")
    entries = counts.where((F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") >= F.col("n") * LEAST_SHARE)).orderBy(F.desc("toxic"), "feature").limit(LEXICON).collect()
    words = counts.where(~F.col("feature").endswith("*")).orderBy(F.desc("n"), "feature").limit(MODEL_WORDS).collect()
    whole = {r["feature"] for r in entries if not r["feature"].endswith("*")}
    begun = {w[:n] + "*" for w in whole for n in STEMS}
    lexicon = {r["feature"]: r["toxic"] / (r["n"] + 1) for r in entries if r["feature"] in whole or r["feature"] in begun}
    model = {r["feature"]: r["n"] for r in words} | {w: 20 * r["n"] for r in entries if (w := r["feature"]) in whole}

    def without(batches):
        scorer = Scorer(lexicon, model, 0.0)
        for batch in batches:
            left = [y for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if scorer.score(text) == 0]
            yield pa.RecordBatch.from_arrays([pa.array([len(left)], pa.int64()), pa.array([sum(left)], pa.int64())], names=["n", "toxic"])

    left = rows.mapInArrow(without, "n bigint, toxic bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    dropped(rows)
    dropped(counts)
    return {"lexicon": lexicon, "words": model, "base": (left[1] + 1) / (left[0] + 20)}


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> DataFrame:
    """(text, toxic) of labelled documents outside the held-out fold: all, or a share by hash of the id of about ``rows``.

    The sampled ids are few enough to broadcast; a document's labels that differ count as toxic if one does.
    """
    usable = labels.where(~held_out(id_col, 4) & F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
    total = usable.count()
    chosen = usable.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < min(1.0, rows / max(total, 1)) * (1 << 20)).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    return docs.select(id_col, "text").join(F.broadcast(chosen), id_col).select("text", "toxic")


def _scorer(fitted: dict) -> Scorer:
    key = hash((tuple(sorted(fitted["lexicon"].items())), tuple(sorted(fitted["words"].items())), fitted["base"]))
    return held(("toxicity", key), lambda: Scorer(fitted["lexicon"], fitted["words"], fitted["base"]))


def score(docs: DataFrame, fitted: dict, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds tox_score (0 to 1) to every row, from the whole text alone; no shuffle.

    A null or empty text, and one without lexicon words, scores the base rate. With nothing learned all score the base rate.
    Repeated rows get equal scores; a column named tox_score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def make():
        scorer = _scorer(shared.value)
        return lambda texts: [pa.array([scorer.score(t) for t in texts.to_pylist()], pa.float64())]

    return map_batches(docs, [text_col], [T.StructField("tox_score", T.DoubleType())], make, carry)
