"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of every text.

Normalising lower-cases A-Z and keeps words of digits, letters and bytes beyond ASCII; it works on UTF-8 bytes, so a hit's
place in the normalised text is the number of a word, and words map to byte offsets of the text as it was.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.common import dropped, held, map_batches, stored

WINDOW = 10
#: Words of windows (each a node of the automaton at most) that one automaton may hold, about 190 bytes each while it is built; a larger benchmark is
#: scanned in blocks of this size, one after another.
MOST_NODES = 1_000_000
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORD_BYTES).split() if text else []


class Windows:
    """One Aho-Corasick automaton over the items' windows, whose letters are the items' words.

    A window is a sequence of word numbers, so a node is a word, and the place of a match is the number of a word of the text.
    Transitions are one hash table: a node may have as many children as there are words.
    """

    def __init__(self, items: list[tuple[int, str | None]], size: int):
        found: dict[tuple[int, ...], set] = defaultdict(set)
        self.number: dict[bytes, int] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
            for i in range(max(1, len(words) - size + 1) if words else 0):
                found[tuple(words[i : i + size])].add(item)
        self.going: dict[int, int] = {}  # node << 32 | word -> node
        self.matches: dict[int, tuple[int, list]] = {}  # node -> words and items of the window that ends there
        last, letter, above = {w: 0 for w in found}, array("i", [0]), array("i", [0])
        self.fail = array("i", [0])
        for depth in range(size):  # nodes are numbered by depth, so that a node's failure is known before its children's
            for window, node in last.items():
                if depth == len(window):
                    self.matches[node] = len(window), sorted(found[window], key=str)
                if depth < len(window):
                    key = node << 32 | window[depth]
                    child = self.going.get(key)
                    if child is None:
                        child = self.going[key] = len(letter)
                        letter.append(window[depth])
                        above.append(node)
                    last[window] = child
        self.matches |= {node: (size, sorted(found[window], key=str)) for window, node in last.items() if len(window) == size}
        self.shorter = array("i", [0])  # the longest window that ends a node's path, itself aside
        for node in range(1, len(letter)):
            f = self._step(self.fail[above[node]], letter[node]) if above[node] else 0
            self.fail.append(f)
            self.shorter.append(f if f in self.matches else self.shorter[f])

    def _step(self, node: int, word: int) -> int:
        while (child := self.going.get(node << 32 | word)) is None and node:
            node = self.fail[node]
        return child or 0

    def scan(self, words: list[bytes]) -> tuple[set, set]:
        """Numbers of the words inside an occurrence, and the items that occur."""
        hit: set[int] = set()
        items: set = set()
        going, fail, matches, node = self.going.get, self.fail, self.matches, 0
        for at, word in enumerate(map(self.number.get, words)):
            if word is None:
                node = 0
                continue
            child = going(node << 32 | word)
            while child is None and node:
                node = fail[node]
                child = going(node << 32 | word)
            node = child or 0
            end = node if node in matches else self.shorter[node]
            while end:
                n, ids = matches[end]
                hit.update(range(at + 1 - n, at + 1))
                items.update(ids)
                end = self.shorter[end]
        return hit, items


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, size: int, nodes: int) -> Iterator[list]:
    """Lists of (item, text) whose windows have at most about ``nodes`` words; one block is gathered at a time. A lone item of more stays whole."""
    wanted = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    words = F.size(F.split("text", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    n = -(-int(wanted.agg(F.sum(words.cast("long") * size)).first()[0] or 0) // nodes) or 1
    for k in range(n):
        part = wanted if n == 1 else wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r["item"], r["text"]) for r in part.collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", size: int = WINDOW, carry: list[str] | None = None, most_nodes: int = MOST_NODES) -> DataFrame:
    """Adds n_words, hit_words (sorted word numbers), spans (byte offsets [start, end) in the UTF-8 text as it was) and items
    (ids, sorted as strings) to every document.

    A null or empty text has no words and no hit, so does a text without word characters; null item ids or texts are no items;
    repeated items hit alike; an empty benchmark hits nothing. Documents are scanned where they lie: nothing is shuffled.
    Only a block of the benchmark is broadcast at a time, and a Python worker keeps one automaton, of about most_nodes nodes; for
    further blocks the scan is repeated over what the former one wrote. Columns of docs named like an output are replaced.
    """
    spark, out, earlier_out = docs.sparkSession, docs, None
    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType())),
    ]
    keep = [c for c in (docs.columns if carry is None else carry) if c not in [f.name for f in fields]]
    blocks = blocks_of(benchmark, id_col, text_col, size, most_nodes)
    block, k = next(blocks), 0
    while block is not None:
        after = next(blocks, None)
        shared, mark = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def make(shared=shared, mark=mark):
            found = held(("leaks", mark), lambda: Windows(shared.value, size))

            def work(texts, *earlier):
                n_words, hits, spans, items = [], [], [], []
                had = zip(*(x.to_pylist() for x in earlier), strict=True) if earlier else iter([((), ())] * len(texts))
                for text, (old_hits, old_items) in zip(texts.to_pylist(), had, strict=True):
                    words = words_of(text)
                    hit, item = found.scan(words)
                    hit = sorted(hit.union(old_hits))
                    n_words.append(len(words))
                    hits.append(hit)
                    items.append(sorted({str(i) for i in item}.union(old_items)))
                    spans.append(byte_spans(text, hit) if hit else [])
                return [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]

            return work

        out = map_batches(out, [text_col] if k == 0 else [text_col, "hit_words", "items"], fields, make, keep if after is None else list(dict.fromkeys([*keep, text_col])))
        if after is not None:
            out = stored(out, "leaks")
            if earlier_out is not None:
                dropped(earlier_out)
            earlier_out = out
        block, k = after, k + 1
    return out


def byte_spans(text: str, hit: list[int]) -> list[list[int]]:
    """[start, end) in the text's own UTF-8 bytes of each run of hit words."""
    places = [m.span() for m in _WORD.finditer(text.encode("utf-8", "replace"))]
    out: list[list[int]] = []
    for k, i in enumerate(hit):
        if k and hit[k - 1] == i - 1:
            out[-1][1] = places[i][1]
        else:
            out.append([*places[i]])
    return out
