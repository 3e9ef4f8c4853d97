"""Byte-level BPE of a whole corpus by batched numpy merge rounds.

The words of many texts lie in one flat array of symbols. A round looks up the pairs of neighbours by
binary search over the sorted pair keys, finds every word's lowest rank and merges all of that pair's
occurrences in the word, from the left; words without a pair are done. Only pairs beside a merge are
looked up again. The vocabulary (a few hundred thousand numbers, fixed by the tokenizer) is broadcast,
so executors need no file.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarterloom.session import ship

#: Where the vocabulary files are, unless a path is given.
DEFAULT_PATH = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/byte_bpe_50k.json"

# Fixed value: the pattern by which byte_bpe_50k splits texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = np.iinfo(np.int32).max
#: Distinct words kept by a worker between batches, and bytes of text encoded at once.
CACHE_WORDS, CHUNK_BYTES = 300_000, 4_000_000


def _byte_chars() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    chars = {chr(b): b for b in plain}
    chars |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return chars


class Vocabulary:
    """Arrays of a byte-level BPE vocabulary: pair keys in order, their ranks and merged ids."""

    def __init__(self, path: str = DEFAULT_PATH) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in _byte_chars().items():
            self.byte_ids[b] = ids[c]
        keys = np.array([(ids[a] << 20) | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)[order]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if no pair) and merged id of each pair."""
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE).astype(np.int32), self.merged[at]

    def encode_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word's ids begin (one offset more than words)."""
        n = len(words)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(n), np.fromiter(map(len, words), np.int64, n))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), NONE, np.int32)  # of the pair that begins here
        into = np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            rank[:-1], into[:-1] = self.lookup(sym[:-1], sym[1:])
            rank[:-1][word[1:] != word[:-1]] = NONE
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            counts = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            if (least == NONE).any():
                over = np.repeat(least == NONE, counts)
                done.append((word[over], sym[over]))
                sym, word, rank, into = sym[~over], word[~over], rank[~over], into[~over]
                least, counts = least[least != NONE], counts[least != NONE]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, counts)
            at = np.flatnonzero(hit)
            # in a run such as a a a only every other pair can be merged; runs begin where the place before is no hit
            first = np.concatenate([[True], at[1:] != at[:-1] + 1])
            run = at[first][np.cumsum(first) - 1]
            at = at[(at - run) % 2 == 0]
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, rank, into, at = sym[keep], word[keep], rank[keep], into[keep], place[at]
            near = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[near] = NONE
            near = near[near + 1 < len(sym)]
            near = near[word[near] == word[near + 1]]
            rank[near], into[near] = self.lookup(sym[near], sym[near + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        word, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return sym[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])


class Encoder:
    """Texts to ids; keeps the ids of words seen before."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import regex

        self.split = regex.compile(PATTERN).findall
        self.vocabulary = vocabulary
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        words = [self.split(t) for t in texts]
        new = list({w for ws in words for w in ws if w not in self.known})
        if new:
            ids, at = self.vocabulary.encode_words([w.encode("utf-8", "replace") for w in new])
            ids, at = ids.tolist(), at.tolist()
            for i, w in enumerate(new):
                self.known[w] = ids[at[i] : at[i + 1]]
        known = self.known
        return [[i for w in ws for i in known[w]] for ws in words]


def pieces(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch in pieces of a bounded size; NULL as empty."""
    piece, size = [], 0
    for raw in texts.cast(pa.binary()) if not pa.types.is_binary(texts.type) else texts:
        t = raw.as_py()
        t = t.decode("utf-8", "replace") if t else ""
        piece.append(t)
        size += len(t)
        if size > CHUNK_BYTES:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


_vocabularies: dict[str, Vocabulary] = {}


def broadcast_vocabulary(spark: SparkSession, path: str = DEFAULT_PATH):
    """The vocabulary's arrays on all executors (under 2 MB, fixed by the tokenizer)."""
    ship(spark)
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return spark.sparkContext.broadcast(_vocabularies[path])


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """(doc_id, ids): the ids of every text, in one narrow pass over the documents.

    NULL and empty texts give an empty list; names of special tokens are ordinary text; bytes that
    are no UTF-8 count as U+FFFD. Rows keep their repetitions and NULL ids; an empty table gives no
    rows; other columns are ignored.
    """
    vocabulary = broadcast_vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for b in batches:
            at = 0
            for piece in pieces(b.column(1)):
                ids = pa.array(encoder.encode(piece), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(piece)), ids], ["doc_id", "ids"])
                at += len(piece)

    kind = df.schema[doc_id].dataType.simpleString()
    got = df.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, ids array<int>")
    return got.withColumnRenamed("doc_id", doc_id)


def token_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """(doc_id, n_tokens) of every text."""
    from pyspark.sql import functions as F

    return encode_corpus(df, doc_id, text, path).select(doc_id, F.size("ids").cast("bigint").alias("n_tokens"))
