"""Byte-level BPE encoding and decoding by speculation and verification.

A text is cut into words by the vocabulary's splitting pattern.  For words not seen
before, in batches:

1. *speculate*: greedy longest match over the vocabulary proposes tokens;
2. *verify*: a token sequence is the BPE encoding exactly if every adjacent pair of
   its tokens is, so one vectorised walk down the merge trees checks all pairs;
3. *merge*: only words with an incompatible pair are merged from bytes, exactly.

Ids travel packed, as little-endian unsigned 32-bit integers in a binary column.

Nulls and empty texts have no tokens and decode to the empty string.  Rows are
independent: repeated rows give repeated results, an empty table an empty one.  Other
columns pass through, but for those that have the name of a result, which it replaces.
Texts of any length are taken whole; a long word is merged with a queue, in n log n.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm.shared import prepare, with_results

#: Words remembered by a Python worker (some 300 bytes each) before it starts anew.
WORD_MEMORY = 60_000
#: Texts are taken in slices of this many characters.
SLICE_CHARS = 250_000
#: Failing words up to this many bytes are merged together, longer ones one by one.
SHORT_WORD = 48

# The splitting pattern of byte-level BPE vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NEVER = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def unsettled(text: str) -> bool:
    """Whether a text has code points whose class may differ between Unicode versions."""
    return any(unicodedata.category(c) == "Cn" for c in set(text))


class Vocabulary:
    """Tokens and merges of a byte-level BPE file, with the codec built on them."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normaliser or prefix space is needed")
        alphabet = byte_alphabet()
        ids = model["vocab"]
        self.tokens: list[bytes] = [b""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, k in ids.items():
            self.tokens[k] = bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, k in self.special.items():
            self.tokens[k] = token.encode()

        size = self.size = len(self.tokens)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)  # when a token comes to be
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys, made = np.empty(len(pairs), np.int64), np.empty(len(pairs), np.int64)
        self.grows = True  # parts come before wholes, and each token has one merge
        for r, (a, b) in enumerate(pairs):
            x, y, z = ids[a], ids[b], ids[a + b]
            self.grows &= self.rank[z] < 0 and max(self.rank[x], self.rank[y]) < r
            self.left[z], self.right[z], self.rank[z] = x, y, r
            keys[r], made[r] = x * size + y, z
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank, self.pair_made = keys[order], order.astype(np.int64), made[order]
        self.byte_id = np.array([ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64)

        self.longest = ahocorasick.Automaton()
        for k in {*ids.values()}:
            if self.rank[k] >= 0 or len(self.tokens[k]) == 1:
                self.longest.add_word(self.tokens[k].decode("latin-1"), k)
        self.longest.make_automaton()
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.known: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each pair (NEVER if there is none) and the token it makes."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_rank[at], NEVER), self.pair_made[at]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b together leaves the two tokens apart.

        Goes back in time along a's right edge and b's left edge.  Two edge parts that
        exist together must not merge before either of them is taken up by its own
        token; of equal merges the leftmost goes first.
        """
        fine = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        until_x, until_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            rank, _ = self.ranks(x, y)
            clash = (rank < until_x) & (rank <= until_y) & (rank < NEVER)
            fine[live[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~clash & ((rx >= 0) | (ry >= 0))
            back_x = go & (rx > ry)
            back_y = go & ~back_x
            until_x[back_x], x[back_x] = rx[back_x], self.right[x[back_x]]
            until_y[back_y], y[back_y] = ry[back_y], self.left[y[back_y]]
            live, x, y, until_x, until_y = live[go], x[go], y[go], until_x[go], until_y[go]
        return fine

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many words at once: the best pair of each word, again and again."""
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[bytes] = [b""] * len(words)
        while len(ids):
            rank, made = self.ranks(ids[:-1], ids[1:])
            rank[word[:-1] != word[1:]] = NEVER
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(np.r_[rank, NEVER], starts)
            stop = best >= NEVER
            counts = np.diff(np.r_[starts, len(ids)])
            for s, n, w in zip(starts[stop], counts[stop], word[starts[stop]], strict=True):
                done[w] = ids[s : s + n].astype("<u4").tobytes()
            at_best = np.flatnonzero(rank == np.repeat(best, counts)[:-1]) if len(rank) else starts[:0]
            at_best = at_best[rank[at_best] < NEVER]
            first = at_best[np.unique(word[at_best], return_index=True)[1]]
            ids[first] = made[first]
            keep = np.repeat(~stop, counts)
            keep[first + 1] = False
            ids, word = ids[keep], word[keep]
        return done

    def merge_long(self, word: bytes) -> bytes:
        """Exact merging of one word with a queue of pairs, in n log n."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank, made = self.ranks(np.array(ids[:-1]), np.array(ids[1:]))
        queue = [(int(r), i, ids[i], ids[i + 1], int(z)) for i, (r, z) in enumerate(zip(rank, made, strict=True)) if r < NEVER]
        heapq.heapify(queue)
        while queue:
            _, i, x, y, z = heapq.heappop(queue)
            j = after[i] if ids[i] == x else len(ids)
            if j >= len(ids) or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = z, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < len(ids):
                    r, new = self.ranks(np.array([ids[p]]), np.array([ids[q]]))
                    if r[0] < NEVER:
                        heapq.heappush(queue, (int(r[0]), p, ids[p], ids[q], int(new[0])))
        return np.array([t for t in ids if t >= 0], "<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct words: propose, verify, merge what failed."""
        raw = [w.encode() for w in words]
        apart = "Ā"  # not the character of any byte
        lined = apart.join([w.decode("latin-1") for w in raw])
        found = list(self.longest.iter_long(lined))
        ends = np.fromiter((e for e, _ in found), np.int64, len(found))
        ids = np.fromiter((k for _, k in found), np.int64, len(found))
        sizes = np.array([len(w) for w in raw], np.int64)
        word = np.searchsorted(np.cumsum(sizes + 1), ends, side="right")
        bad = np.zeros(len(words), bool)
        same = word[1:] == word[:-1]
        pairs, back = np.unique(ids[:-1][same] * self.size + ids[1:][same], return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size) if self.grows else np.zeros(len(pairs), bool)
        bad[word[1:][same][~fine[back]]] = True
        packed = ids.astype("<u4").tobytes()
        cuts = np.searchsorted(word, np.arange(len(words) + 1)) * 4
        out = [packed[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        failing = np.flatnonzero(bad)
        short = [k for k in failing if sizes[k] <= SHORT_WORD]
        for k, ids_of_word in zip(short, self.merge_short([raw[k] for k in short]), strict=True):
            out[k] = ids_of_word
        for k in failing[sizes[failing] > SHORT_WORD]:
            out[k] = self.merge_long(raw[k])
        return out

    def words_of(self, text: str) -> list[str]:
        lead = np.frombuffer(text.encode(), np.uint8)
        # Below U+0340, whose first byte is 0xCD, all classes are settled.
        if len(lead) and lead.max() >= 0xCD and unsettled(text):  # let the library draw the borders
            from tokenizers import pre_tokenizers

            drawn = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
            return [text[a:b] for _, (a, b) in drawn.pre_tokenize_str(text)]
        return self.split.findall(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        cut: list[list[str]] = []
        for text in texts:
            words: list[str] = []
            at = 0
            for m in self.cut.finditer(text or "") if self.cut else ():
                words += self.words_of(text[at : m.start()])
                words.append(m[0])
                at = m.end()
            words += self.words_of((text or "")[at:])
            cut.append(words)
        if len(self.known) > WORD_MEMORY:
            self.known = {}
        known = self.known
        for token, k in self.special.items():
            known[token] = np.array([k], "<u4").tobytes()
        fresh = list({w for words in cut for w in words if w not in known})
        if fresh:
            known.update(zip(fresh, self.encode_words(fresh), strict=True))
        return [b"".join([known[w] for w in words]) for words in cut]

    def decode(self, packed: bytes | None) -> str:
        ids = np.frombuffer(packed or b"", "<u4").tolist()
        return b"".join([self.tokens[k] for k in ids]).decode("utf-8", "replace")


_held: dict[int, Vocabulary] = {}


def held(shipped: Broadcast) -> Vocabulary:
    """The vocabulary of a broadcast file, built once in each Python worker."""
    key = id(shipped.value)
    if key not in _held:
        _held.clear()
        _held[key] = Vocabulary(shipped.value)
    return _held[key]


def slices(texts: pd.Series) -> Iterator[list[str | None]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    yield part


class Codec:
    """BPE columns for one vocabulary file.

    The file is read on the driver and broadcast; its size is that of the vocabulary
    and doesn't grow with the data.
    """

    def __init__(self, spark: SparkSession, vocabulary_path: str):
        prepare(spark)
        with open(vocabulary_path, encoding="utf-8") as f:
            text = f.read()
        shipped = spark.sparkContext.broadcast(text)

        @F.pandas_udf("token_ids binary, n_tokens long, decoded string")
        def round_trip(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            vocabulary = held(shipped)
            for texts in batches:
                packed = [x for part in slices(texts) for x in vocabulary.encode(part)]
                yield pd.DataFrame(
                    {
                        "token_ids": pd.Series(packed, dtype=object),
                        "n_tokens": np.array([len(x) // 4 for x in packed], np.int64),
                        "decoded": pd.Series([vocabulary.decode(x) for x in packed], dtype=object),
                    }
                )

        @F.pandas_udf("binary")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            vocabulary = held(shipped)
            for texts in batches:
                yield pd.Series([x for part in slices(texts) for x in vocabulary.encode(part)], dtype=object)

        @F.pandas_udf("string")
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            vocabulary = held(shipped)
            for packed in batches:
                yield pd.Series([vocabulary.decode(x) for x in packed], dtype=object)

        self._encode, self._decode, self._round_trip = encode, decode, round_trip

    def encode(self, text: Column | str) -> Column:
        """Binary: the ids of a text, four bytes each, little end first."""
        return self._encode(text)

    def decode(self, packed: Column | str) -> Column:
        """String: the text of packed ids; bytes that aren't UTF-8 become U+FFFD."""
        return self._decode(packed)

    def round_trip(self, text: Column | str) -> Column:
        """Struct: token_ids, n_tokens and the decoded text, in one pass."""
        return self._round_trip(text)


def encode_documents(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (packed), ``n_tokens`` and ``decoded`` (the round trip)."""
    codec = Codec(docs.sparkSession, vocabulary_path)
    return with_results(docs, codec.round_trip(F.col(text)), ("token_ids", "n_tokens", "decoded"))
