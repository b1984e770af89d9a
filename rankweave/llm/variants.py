"""Spelling variants by full neighbourhood generation.

Every word of a vocabulary emits all distinct strings one deletion, replacement or insertion over the observed alphabet away, and a
hash join with the vocabulary keeps those that are words; what joins is near by construction, so no distance is ever computed.

A word of ten letters has about a thousand such strings, so they are made as hashes first: with a polynomial hash and its running
sums, each edit's hash is one addition. A Bloom filter of the vocabulary lets about one in a thousand strangers through; only what
it lets through becomes a string and is shuffled to the exact join. The filter has 16 bits or more a word. A vocabulary is worked
off in slices of at most SLICE_WORDS words, each with its own filter, so that what is broadcast never exceeds 32 MB.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.common import dropped, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words whose filter is broadcast at once, bits a word at least, bits of the filter that one row carries, and probes.
SLICE_WORDS, WORD_BITS, PIECE_BITS, PROBES = 1 << 24, 16, 1 << 20, 4
#: Neighbours whose hashes a task holds at once.
CHUNK = 1 << 18

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PROBES = [_U(x) for x in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def symbol_values(code_points: np.ndarray) -> np.ndarray:
    """A 64-bit number for each code point."""
    h = (code_points.astype(_U) + _U(1)) * _BASE
    h = (h ^ (h >> _U(31))) * _PROBES[2]
    return h ^ (h >> _U(29))


def by_length(words: list[str]):
    """(length, places of the words that have it, their code points as a matrix)."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield int(n), at, np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(-1, n)


def sums_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the hash's base, the terms of each word and their running sums; the last sum is the word's hash."""
    n = points.shape[1]
    powers = np.cumprod(np.concatenate([[_U(1)], np.full(n + 1, _BASE, _U)]), dtype=_U)
    terms = symbol_values(points) * powers[:n]
    return powers, terms, np.concatenate([np.zeros((len(points), 1), _U), np.cumsum(terms, axis=1, dtype=_U)], axis=1)


def probe(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of each hash in a filter of 2 ** bits bits."""
    return (hashes * _PROBES[k]) >> _U(64 - bits)


def passing(hashes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Places of the hashes that the filter lets through."""
    at = None
    for k in range(PROBES):
        p = probe(hashes if at is None else hashes[at], k, bits)
        hit = (table[p >> _U(3)] >> (p & _U(7)).astype(np.uint8)) & 1
        at = np.flatnonzero(hit) if at is None else at[hit.astype(bool)]
    return at


def neighbours_of(words: list[str], alphabet: np.ndarray, table: np.ndarray, bits: int) -> tuple[list[int], list[str]]:
    """(places of words, strings): the distinct strings at one edit from each word that the filter lets through."""
    values, letters = symbol_values(alphabet), [chr(c) for c in alphabet]
    rows, made = [], []
    for n, places, points in by_length(words):
        step = max(1, CHUNK // ((n + 1) * len(alphabet)))
        for first in range(0, len(places), step):
            part, of = points[first : first + step], places[first : first + step]
            powers, terms, sums = sums_of(part)
            whole, after = sums[:, -1:], sums[:, -1:] - sums
            edited = values * powers[: n + 1, None]

            own = np.concatenate([np.ones((len(part), 1), bool), part[:, 1:] != part[:, :-1]], axis=1)  # a run of one letter loses it once
            hashes = sums[:, :-1] + after[:, 1:] * _BASE_INVERSE
            for at in passing(hashes.ravel(), table, bits).tolist():
                r, i = divmod(at, n)
                if own[r, i]:
                    w = words[of[r]]
                    rows.append(of[r])
                    made.append(w[:i] + w[i + 1 :])

            hashes = (whole - terms)[:, :, None] + edited[:n]
            for at in passing(hashes.ravel(), table, bits).tolist():
                (r, i), s = divmod(at // len(alphabet), n), at % len(alphabet)
                if part[r, i] != alphabet[s]:
                    w = words[of[r]]
                    rows.append(of[r])
                    made.append(w[:i] + letters[s] + w[i + 1 :])

            hashes = (sums + after * _BASE)[:, :, None] + edited
            for at in passing(hashes.ravel(), table, bits).tolist():
                (r, i), s = divmod(at // len(alphabet), n + 1), at % len(alphabet)
                if not i or part[r, i - 1] != alphabet[s]:  # behind its own like, a letter was inserted one place before
                    w = words[of[r]]
                    rows.append(of[r])
                    made.append(w[:i] + letters[s] + w[i:])
    return rows, made


def filter_of(words: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of the column word with 2 ** bits bits, put together from rows of PIECE_BITS."""
    piece = min(bits, PIECE_BITS.bit_length() - 1)

    def places(batches):
        for batch in batches:
            hashes = [sums_of(points)[2][:, -1] for _, _, points in by_length(batch.column(0).to_pylist())]
            if hashes:
                at = np.unique(np.concatenate([probe(h, k, bits) for h in hashes for k in range(PROBES)]))
                pieces, cuts = np.unique(at >> _U(piece), return_index=True)
                parts = np.split((at & _U((1 << piece) - 1)).astype("<u4"), cuts[1:])
                yield pa.RecordBatch.from_arrays([pa.array(pieces.astype(np.int64)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["piece", "places"])

    def merged(key, rows):
        on = np.zeros(1 << piece, bool)
        for x in rows.column("places").to_pylist():
            on[np.frombuffer(x, "<u4")] = True
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    made = words.select("word").mapInArrow(places, "piece bigint, places binary").groupBy("piece").applyInArrow(merged, "piece bigint, bits binary")
    table = np.zeros((1 << bits - piece, max(1 << piece >> 3, 1)), np.uint8)
    for row in made.toLocalIterator():
        table[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    return table.ravel()


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = "A-Za-zÀ-ÿ", least: int = 1) -> DataFrame:
    """(id, word): the maximal runs of letters of each text that have at least so many, a row each, A-Z in lower case. A null text has none."""
    found = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{letters}]{{{least},}}"), F.lit(0))).alias("word"))
    return found.withColumn("word", F.translate("word", UPPER, LOWER))


def vocabulary(words: DataFrame, least: int = 7, occurrences: int = 2) -> DataFrame:
    """(word, n): the distinct words of at least so many code points that occur so often, with their number; null is no word."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def near_words(words: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(word, near, near_n): all pairs of different words of (word, n) at one edit from each other, in both directions.

    words: distinct ones, none null or empty; it is read several times. An empty table gives no rows. The alphabet is that of the words.
    """
    total = words.count()
    letters = [r[0] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("s")).where("s <> ''").distinct().collect()]
    alphabet = np.array(sorted(map(ord, letters)), np.uint32)
    slices, spark, found = max(1, math.ceil(total / slice_words)), words.sparkSession, []
    bits = max(13, (WORD_BITS * math.ceil(total / slices)).bit_length())
    for k in range(slices):
        own = words if slices == 1 else words.where(F.pmod(F.xxhash64("word"), F.lit(slices)) == k)
        shared = spark.sparkContext.broadcast((alphabet, filter_of(own, bits)))

        def search(batches, shared=shared, bits=bits):
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for at in range(0, len(texts), 1024):
                    part = texts[at : at + 1024]
                    rows, made = neighbours_of(part, *shared.value, bits)
                    yield pa.RecordBatch.from_arrays([pa.array([part[i] for i in rows], pa.string()), pa.array(made, pa.string())], names=["word", "near"])

        schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("near", T.StringType())])
        found.append(words.select("word").mapInArrow(search, schema).join(own.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def group(words: DataFrame, ratio: int = 10, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row of (word, n), a vocabulary of distinct words.

    A word's form is its most frequent near word (ties: the smallest in code-point order), if that has at least ratio times as many
    occurrences; else null. root is the last form that forms lead to, the word itself without one. Null and empty words are left out,
    extra columns too; an empty table gives no rows.

    Forms grow by the ratio at each step, so roots are found in as many rounds as the logarithm of the largest number; each round joins
    the words whose forms were settled in the one before, of which one form has no more than its own neighbours.
    """
    own = stored(words.where(F.length("word") > 0).select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_words(own, slice_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    known = own.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    known = stored(known, "variants")
    dropped(own)
    steps = known.where(F.col("form").isNotNull()).select("word", "form")
    settled = [stored(steps.join(steps.select(F.col("word").alias("form")), "form", "left_anti").select("word", F.col("form").alias("root")), "roots")]
    while not settled[-1].isEmpty():
        settled.append(stored(steps.join(settled[-1].select(F.col("word").alias("form"), "root"), "form").select("word", "root"), "roots"))
    roots = settled[0]
    for more in settled[1:]:
        roots = roots.union(more)
    return known.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
