"""Problem 8: encoding the whole corpus with a public byte-level BPE tokenizer.

Merges are replayed over all distinct words of a task at once instead of word by word: an inverted index leads from
each pair of adjacent tokens to the word positions that hold it, the pairs are taken in rank order from a heap, and a
merge touches only those positions and their two neighbours. Every distinct word is merged once per task; documents then
look their words up. The task needs no shuffle, so a corpus of any size is one pass over its text.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.session import read_table

DEFAULT_TOKENIZERS = "/opt/tokenizers"
#: Distinct words whose ids a task keeps; beyond it the memory is cleared and refilled, which changes no result.
WORDS_KEPT = 400_000
#: Documents are encoded in slices of about so many characters, so that very long texts do not pile up.
SLICE_CHARS = 4_000_000
#: Fixed value: the split of this vocabulary's tokenizer before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else 256 + n."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


class MergeReplay:
    """Byte-level BPE over sets of words by replaying all merges in rank order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        self.byte_ids = [vocab[c] for c in byte_letters()]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        ids: list[int] = []
        bounds = [0]
        byte_ids = self.byte_ids
        for w in words:
            ids.extend([byte_ids[b] for b in w.encode("utf-8", "surrogatepass")])
            bounds.append(len(ids))
        n = len(ids)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        for start, end in zip(bounds, bounds[1:]):
            if end > start:
                nxt[end - 1] = -1
                prv[start] = -1
        ranks = self.ranks
        where: dict[tuple[int, int], list[int]] = {}
        for i in range(n):
            j = nxt[i]
            if j >= 0:
                pair = (ids[i], ids[j])
                if pair in ranks:
                    where.setdefault(pair, []).append(i)
        heap = [(ranks[p][0], p) for p in where]
        heapq.heapify(heap)
        while heap:
            _, pair = heapq.heappop(heap)
            places = where.pop(pair, None)
            if places is None:
                continue
            a, b = pair
            made = ranks[pair][1]
            places.sort()  # overlapping occurrences merge from the left
            for i in places:
                j = nxt[i]
                if ids[i] != a or j < 0 or ids[j] != b:
                    continue
                ids[i] = made
                ids[j] = -1
                k = nxt[j]
                nxt[i] = k
                nxt[j] = -1
                if k >= 0:
                    prv[k] = i
                    new = (made, ids[k])
                    if new in ranks:
                        if new not in where:
                            where[new] = []
                            heapq.heappush(heap, (ranks[new][0], new))
                        where[new].append(i)
                h = prv[i]
                if h >= 0:
                    new = (ids[h], made)
                    if new in ranks:
                        if new not in where:
                            where[new] = []
                            heapq.heappush(heap, (ranks[new][0], new))
                        where[new].append(h)
        return [[x for x in ids[s:e] if x >= 0] for s, e in zip(bounds, bounds[1:])]


class CorpusEncoder:
    """Encodes texts, keeping the ids of words seen before."""

    def __init__(self, path: str, keep: int = WORDS_KEPT):
        import regex

        self.split = regex.compile(PATTERN).findall
        self.replay = MergeReplay(path)
        self.keep = keep
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a list of texts; NULL and empty texts have no ids."""
        words = [self.split(t) if t else [] for t in texts]
        new = {w for ws in words for w in ws if w not in self.known}
        if len(self.known) + len(new) > self.keep:
            self.known.clear()
            new = {w for ws in words for w in ws}
        if new:
            todo = list(new)
            self.known.update(zip(todo, self.replay.encode_words(todo)))
        known = self.known
        out: list[int] = []
        offsets = np.zeros(len(texts) + 1, dtype=np.int32)
        for i, ws in enumerate(words):
            for w in ws:
                out += known[w]
            offsets[i + 1] = len(out)
        return offsets, np.array(out, dtype=np.int32)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= SLICE_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def tokenizer_file(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("PRESSWORK_TOKENIZERS", DEFAULT_TOKENIZERS), f"{name}.json")


def encoded(documents: DataFrame, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """(doc_id, ids): token ids of every text without special tokens; empty list for NULL and empty texts.

    Strings that spell a special token are ordinary text. Repeated rows come out repeated; other columns are not read.
    `folder` holds the public vocabulary files on every executor.
    """
    path = tokenizer_file(tokenizer, folder)
    kind = dict(documents.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for b in batches:
            coder = coder or CorpusEncoder(path)
            texts = b.column(1).to_pylist()
            for lo, hi in _slices(texts):
                offsets, ids = coder.encode(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], names=[id_col, "ids"])

    return documents.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """(doc_id, tokens): the number of token ids of every text."""
    return encoded(documents, tokenizer, id_col, text, folder).select(id_col, F.size("ids").alias("tokens"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_table(spark, sf_dir, "documents"))


QUERIES = {"p8_ids": p8_ids}
ORACLE: dict[str, str] = {}
