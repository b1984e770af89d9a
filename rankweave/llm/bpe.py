"""Byte-level BPE encoding and decoding with a public vocabulary.

Merges are found by a segment tree over the ranks of adjacent pairs: the root holds the leftmost pair of the lowest rank,
a merge changes three leaves, and each change costs a path to the root. A word of n bytes takes O(n log n), long ones too.
Words repeat, so a task keeps a bounded memo of encoded words.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rankweave.llm.common import held, map_batches

#: Unicode's white space, and the word pattern of byte-level BPE.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: The same pattern for texts of code points up to U+024F alone, with their letters and numbers written out.
NARROW = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
    r"| ?[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f0-9\xb2\xb3\xb9\xbc-\xbe]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
WIDE = re.compile(r"[^\x00-\u024f]")

#: A vocabulary file beyond this is not a tokenizer to broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: The rank of a pair that doesn't merge, and a key that no pair which does has.
NONE = 1 << 48
END = 1 << 48
#: Children of a node of the segment tree.
NODE = 16


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next free code point from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary, its merges and the memo of encoded words."""

    def __init__(self, tokenizer_json: str | bytes, memo_words: int = 200_000):
        spec = json.loads(tokenizer_json)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        of_symbol = {s: b for b, s in enumerate(symbols)}
        self.first = [vocab[s] for s in symbols]
        self.pairs, self.merged = {}, []  # a pair of ids (below 2 ** 20) to its rank, a rank to the merged id
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[left] << 20 | vocab[right]] = rank
            self.merged.append(vocab[left + right])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(of_symbol[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words, self.memo, self.older, self.memo_words = regex.compile(WORDS), {}, {}, memo_words

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one word, by a segment tree over its pairs' keys (rank, then place): an inner node is the least of NODE children,
        so the root is the leftmost pair of the lowest rank; a merge updates three leaves and their paths."""
        ids, get, merged = [self.first[b] for b in data], self.pairs.get, self.merged
        n = len(ids)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        levels = [[get(ids[i] << 20 | ids[i + 1], NONE) << shift | i for i in range(n - 1)]]
        while len(levels) < 2 or len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([min(below[k : k + NODE]) for k in range(0, len(below), NODE)] or [END])
        leaves, top, flat = levels[0], levels[-1], len(levels) == 2
        if top[0] >= END:
            return ids
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := top[0]) < END:
            i = root & mask
            j = following[i]
            x = ids[i] = merged[root >> shift]
            ids[j] = -1
            after = following[i] = following[j]
            if after < n:
                before[after] = i
                leaves[i] = get(x << 20 | ids[after], NONE) << shift | i
            else:
                leaves[i] = END
            if j < n - 1:
                leaves[j] = END
            if (p := before[i]) >= 0:
                leaves[p] = get(ids[p] << 20 | x, NONE) << shift | p
            if flat:  # the leaves' only parent is the root
                top[0] = min(leaves)
                continue
            for k in (i, min(j, n - 2), p):
                for level, above in zip(levels, levels[1:]) if k >= 0 else ():
                    k //= NODE
                    key = min(level[k * NODE : k * NODE + NODE])
                    if above[k] == key:
                        break
                    above[k] = key
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        """Ids of one word, from the memo of this or the former generation of words, or merged anew."""
        got = self.older.get(word)
        if got is None:
            got = b"".join([i.to_bytes(4, "little") for i in self.merge(word.encode())])
        if len(word) <= 64:
            if len(self.memo) >= self.memo_words:
                self.older, self.memo = self.memo, {}
            self.memo[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Special tokens in the text become their ids."""
        out = []
        for part in self.split_special.split(text) if self.split_special and any(x in text for x in self.special) else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            words = (self.words if WIDE.search(part) else NARROW).findall(part)
            got = list(map(self.memo.get, words))
            if None in got:
                got = [self.word(w) if g is None else g for w, g in zip(words, got, strict=True)]
            out += got
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD. Special tokens are written out."""
        of = self.bytes_of
        return b"".join([of[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


def loaded(tokenizer_json: bytes) -> Bpe:
    """One vocabulary per Python worker, however many tasks it runs."""
    return held(("bpe", hash(tokenizer_json)), lambda: Bpe(tokenizer_json))


def read_vocabulary(path: str) -> bytes:
    """The file's bytes, read by the driver; refused beyond MAX_VOCABULARY_BYTES, as they are broadcast."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


def encode_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded to every row.

    Null text counts as empty: no tokens, empty ids, empty decoded text. Rows stay as they are, repeated ones too; an empty
    table gives none. Columns of docs named like an output are replaced. Only the vocabulary is broadcast (size checked).
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_path))

    def make():
        bpe = loaded(shared.value)

        def work(texts):
            ids = [bpe.encode(t) if t else b"" for t in texts.to_pylist()]
            return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())]

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return map_batches(docs, [text_col], fields, make, carry)
