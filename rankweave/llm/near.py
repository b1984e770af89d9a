"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

A signature is 28 MinHash values of 16 bits at a similarity of 0.85. Two documents' signature distance is the number of values that differ.
The signature is split into 7 chunks of 4 values. A pair within distance 13 has, by pigeonhole, a chunk with at most one error;
so every chunk is indexed four times, each time with one value left out, and such a pair meets under one of 28 keys at least.
At a similarity of 0.85 the distance has mean 4.2 and exceeds 13 once in about 70,000 pairs. Lower similarities take as many chunks
as keep that rate (``chunks_for``): 11 at 0.8, so 44 values, an allowed distance of 21 and 44 keys.

Only candidates are found so; each link is confirmed on the full shingle sets. Every member of a bucket is first held against the
bucket's most central member, its leader, which joins a group of thousands of copies by as many pairs as it has members.
Where members of one leader are still in different components, all their pairs are tried in blocks: with each set written as its
difference from the leader's, the sizes of all intersections of two blocks are one matrix product, so that no pair is ever a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.common import components, dropped, forest, map_batches, split_join, stored

CHUNKS, CHUNK, BITS = 7, 4, 16
#: How often a pair at the threshold may be further apart than the allowed distance.
BEYOND = 1.5e-5
#: Members of one leader that one task holds against each other or another block, and columns of a matrix at once.
BLOCK, COLUMNS = 1024, 4096
#: Shingles by which the members in a block may differ from their leader, in all.
WEIGHT = 4 << 20
PERCENT = 85
WORDS = 5

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])
_U = np.uint64
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=_U)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = _U(0xD6E8FEB86659FD93)
_TIMES = _RNG.integers(0, 2**63 - 1, CHUNKS * CHUNK, dtype=_U) * _U(2) + _U(1)
_PLUS = _RNG.integers(0, 2**64 - 1, CHUNKS * CHUNK, dtype=_U)
#: Those of further chunks.
_TIMES, _PLUS = np.concatenate([_TIMES, _RNG.integers(0, 2**63 - 1, 1000, dtype=_U) * _U(2) + _U(1)]), np.concatenate([_PLUS, _RNG.integers(0, 2**64 - 1, 1000, dtype=_U)])
_POWERS: list[np.ndarray] = []


def chunks_for(percent: int) -> int:
    """The least number of chunks, CHUNKS or more, at which a pair at the threshold is beyond the allowed distance as seldom as BEYOND."""
    chunks, same = CHUNKS, percent / 100
    while sum(math.comb(CHUNK * chunks, d) * (1 - same) ** d * same ** (CHUNK * chunks - d) for d in range(2 * chunks, CHUNK * chunks + 1)) > BEYOND:
        chunks += 1
    return chunks


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, x, _U)]), dtype=_U) for x in (_BASE, _BASE_INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z in lower case, split at ASCII white space), and the number of words of each text.

    A word's hash is a polynomial in its bytes, read off running sums over all texts at once.
    """
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(raw).translate(_LOWER) + b" ", np.uint8)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate([[_U(0)], np.cumsum(_BYTE[data] * power[: len(data)], dtype=_U)])
    hashes = mixed((sums[end] - sums[start]) * inverse[start])
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, text_ends)]))
    return hashes, counts


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; a text of fewer words, but not none, has one of all its words."""
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    if n >= words:
        run = hashes[: n - words + 1].copy()
        for k in range(1, words):
            run = run * _STEP + hashes[k : n - words + 1 + k]
        run = mixed(run)
    out, at = [], 0
    for c in counts.tolist():
        if c >= words:
            out.append(np.unique(run[at : at + c - words + 1]))
        elif c:
            h = _U(c)
            for x in hashes[at : at + c].tolist():
                h = _U((int(h) * int(_STEP) + x) & 0xFFFFFFFFFFFFFFFF)
            out.append(mixed(np.array([h], _U)))
        else:
            out.append(np.zeros(0, _U))
        at += c
    return out


def sketches(sets: list[np.ndarray], chunks: int = CHUNKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, a 64-bit digest of each set, and (texts x chunks) signatures of four 16-bit values a word; zero for empty sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    digest, sig = np.zeros(len(sets), _U), np.zeros((len(sets), chunks), _U)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        digest[full] = mixed(np.add.reduceat(mixed(flat + _BASE), starts) + mixed(np.add.reduceat(mixed(flat ^ _STEP), starts)) * _BASE)
        for k in range(CHUNK * chunks):
            least = np.minimum.reduceat((flat ^ _PLUS[k]) * _TIMES[k], starts)
            sig[full, k // CHUNK] |= (mixed(least) & _U(0xFFFF)) << _U(BITS * (k % CHUNK))
    return sizes, digest.view(np.int64), sig.view(np.int64)


def slices(texts: list, chars: int = 1 << 20):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def sign(docs: DataFrame, text_col: str, carry: list[str], chunks: int = CHUNKS) -> DataFrame:
    """Adds n_shingles, cls (a digest of the whole shingle set: equal sets are one class) and the signature c0, c1 and so on."""

    def make():
        def work(texts):
            parts = [sketches(shingle_sets(p), chunks) for p in slices(texts.to_pylist())]
            sizes, digest, sig = (np.concatenate(x) for x in zip(*parts, strict=True))
            return [pa.array(sizes), pa.array(digest), *(pa.array(np.ascontiguousarray(sig[:, k])) for k in range(chunks))]

        return work

    return map_batches(docs, [text_col], [T.StructField(c, T.LongType()) for c in ("n_shingles", "cls", *(f"c{k}" for k in range(chunks)))], make, carry)


def with_sets(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """Adds cls and the sorted shingle set itself."""

    def make():
        def work(texts):
            sets = [s for p in slices(texts.to_pylist()) for s in shingle_sets(p)]
            digest = sketches(sets)[1]
            return [pa.array(digest), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]

        return work

    return map_batches(docs, [text_col], [T.StructField("cls", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))], make, carry)


def keys_of(classes: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """(cls, key): 4 a class and chunk, each of the place in the signature and the three other values of a chunk."""
    made = []
    for k in range(chunks):
        for j in range(CHUNK):
            keep = (~(0xFFFF << (BITS * j))) & 0xFFFFFFFFFFFFFFFF
            keep -= (keep >> 63) << 64
            made.append(F.xxhash64(F.lit(k * CHUNK + j), F.col(f"c{k}").bitwiseAND(F.lit(keep))))
    return classes.select("cls", F.explode(F.array(*made)).alias("key"))


def against_leaders(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(lead, cls, n_lead, n, shared, diff) of each pair (lead, cls): set sizes, the size of the intersection, and the shingles that
    one of the two sets has. Sets are made anew, for the classes named only."""
    named = pairs.select(F.col("lead").alias("cls")).union(pairs.select("cls")).distinct().join(classes.select("cls", "rep"), "cls")
    wanted = docs.join(named.select(F.col("rep").alias("_rep")).distinct(), F.col(id_col).eqNullSafe(F.col("_rep")), "left_semi")
    sets = with_sets(wanted, text_col, []).join(named.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
    sets = stored(sets, "sets")
    both = split_join(pairs, sets.select(F.col("cls").alias("lead"), F.col("shingles").alias("of_lead")), ["lead"]).join(sets, "cls")  # a leader may have any number of members
    made = both.select(
        "lead", "cls", F.size("of_lead").alias("n_lead"), F.size("shingles").alias("n"),
        F.concat(F.array_except("shingles", "of_lead"), F.array_except("of_lead", "shingles")).alias("diff"),
    )
    found = stored(made.select("*", ((F.col("n_lead") + F.col("n") - F.size("diff")) / 2).cast("int").alias("shared")), "led")
    dropped(sets)
    return found


def linked_pairs(t: dict[str, np.ndarray], diffs: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the rows a and b whose sets are similar enough and whose components differ.

    |x & y| = |lead| - |lead - x| - |lead - y| + (shingles that both differ by), and lead - x has |lead| - shared.
    """
    rows = np.unique(np.concatenate([a, b]))
    flat = np.concatenate([diffs[i] for i in rows]) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(diffs[i]) for i in rows])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    some = count[column] > 1
    renumbered = np.cumsum(count > 1) - 1
    column, owner = renumbered[column[some]], owner[some]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    at_a, at_b = np.searchsorted(rows, a), np.searchsorted(rows, b)
    common = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(rows), COLUMNS), np.float32)
        part[owner[x:y], column[x:y] - first] = 1
        common += part[at_a] @ part[at_b].T
    lead = int(t["n_lead"][a[0]])
    shared = (t["shared"][a][:, None] + t["shared"][b][None] - lead + common).astype(np.int64)
    union = t["n"][a][:, None] + t["n"][b][None] - shared
    return np.nonzero((shared * 100 >= union * percent) & (t["comp"][a][:, None] != t["comp"][b][None]))


def further_links(led: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join members of one leader in different components, as forests."""
    named = led.join(known.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    weight = F.sum(F.size("diff") + 1).alias("weight")
    apart = named.groupBy("lead").agg(F.count("*").alias("members"), weight, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("lead", "members", "weight")
    named = stored(split_join(named, apart, ["lead"]), "apart")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    large = blocks > 1
    small = named.where(~large).agg(F.count("*"), F.coalesce(F.sum(F.size("diff") + 1), F.lit(0))).first()
    gangs = max(1, small[0] // BLOCK, small[1] // WEIGHT)
    own = F.when(large, F.pmod(F.xxhash64("cls", F.lit(5)), blocks).cast("int")).otherwise(F.lit(0))
    gang = F.when(large, F.col("lead")).otherwise(F.pmod(F.xxhash64("lead", F.lit(6)), F.lit(gangs)))
    rows = named.select("lead", "cls", "comp", "n_lead", "n", "shared", "diff", gang.alias("gang"), own.alias("own"), large.alias("large"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")

    def search(table: pa.Table) -> pa.Table:
        t = {k: table.column(k).to_numpy() for k in ("lead", "cls", "comp", "n_lead", "n", "shared", "own")}
        column = table.column("diff").combine_chunks()
        flat, cuts = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
        diffs = [flat[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
        edges = []
        order = np.argsort(t["lead"], kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(t["lead"][order])) + 1):
            own = t["own"][rows]
            a, b = rows[own == own.min()], rows[own == own.max()]
            x, y = linked_pairs(t, diffs, a, b, percent)
            if len(x):
                pairs = np.stack([t["cls"][a[x]], t["cls"][b[y]]])
                nodes, at = np.unique(pairs, return_inverse=True)
                at = at.reshape(pairs.shape)
                root = forest(at[0], at[1], len(nodes))
                moved = root != np.arange(len(nodes))
                edges.append(np.stack([nodes[moved], nodes[root[moved]]]))
        made = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(made[0], pa.int64()), "b": pa.array(made[1], pa.int64())})

    return stored(rows.groupBy("gang", "large", "i", "j").applyInArrow(search, "a bigint, b bigint"), "links")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: its id, n_shingles, component_id (smallest id reachable by links) and kept (it is that id).

    Null, empty and wordless texts have no shingles and are linked with nothing. Equal sets are linked, whatever their texts.
    A row without an id is linked like others but never gives a component its id; a component of such rows alone has a null
    component_id; they are kept. Rows that repeat an id stay, each by its own text. An empty table gives no rows.
    """
    docs = docs.select(id_col, text_col)
    chunks = chunks_for(percent)
    signed = stored(sign(docs, text_col, [id_col], chunks), "signed")
    sig = [f"c{k}" for k in range(chunks)]
    classes = stored(signed.where("n_shingles > 0").groupBy("cls", "n_shingles", *sig).agg(F.min(id_col).alias("rep")), "classes")
    keys = keys_of(classes, chunks)
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(keys.join(shared, "key"), "members")

    central = members.groupBy("cls").agg(F.sum("size").alias("weight"))
    leaders = members.join(central, "cls").groupBy("key").agg(F.max(F.struct("weight", "cls")).getField("cls").alias("lead"))
    pairs = stored(members.join(leaders, "key").where("cls <> lead").select("lead", "cls").distinct(), "pairs")
    dropped(members)
    led = against_leaders(pairs, classes, docs, id_col, text_col)
    links = led.where(F.col("shared") * 100 >= (F.col("n_lead") + F.col("n") - F.col("shared")) * percent).select(F.col("lead").alias("a"), F.col("cls").alias("b"))
    known = stored(components(links), "known")
    more = further_links(led, known, percent)
    final = components(links.union(more))

    of_class = classes.select("cls", "rep").join(final.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    answer = of_class.join(least, "component").select("cls", "component_id")
    out = signed.select(id_col, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cls")).alias("cls")).join(answer, "cls", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id_col))
    return out.select(F.col(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(True)).alias("kept"))
