"""Encoding of a corpus with a byte-level BPE vocabulary by replaying its merges over the words of the corpus."""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Splits text before the merges; the pattern of the byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text that are encoded together; bounds a task's memory, not what is encoded.
CHUNK_CHARS = 8_000_000
#: Distinct words kept with their ids from chunk to chunk of a task, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 400_000, 200


def _byte_characters() -> dict[str, int]:
    """The printable character by which byte-level vocabulary files write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def load_merges(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Of a tokenizer file: the id of each byte (256), and rows ``(left id, right id, merged id)`` in rank order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, of = model["vocab"], _byte_characters()
    first = np.zeros(256, np.int32)
    for c, b in of.items():
        first[b] = vocab[c]
    rows = []
    for m in model["merges"]:
        left, right = m.split(" ") if isinstance(m, str) else m
        rows.append((vocab[left], vocab[right], vocab[left + right]))
    return first, np.array(rows, np.int32)


class Replay:
    """Merges applied in rank order to many words at once.

    The words lie in one array of token ids with links to the previous and next live token of the same word. An
    inverted index leads from each adjacent pair to its positions; a heap gives the lowest-ranked pair that still
    occurs. Applying a merge visits the indexed positions only and indexes the pairs with the two touched
    neighbours. A merge's result can only take part in merges of higher rank, so one pass over the ranks is exact.
    """

    def __init__(self, first: np.ndarray, merges: np.ndarray):
        self.first = first.tolist()
        self.merges = merges.tolist()
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(self.merges)}

    def encode(self, words: list[str]) -> list[list[int]]:
        token, prev, nxt, starts = [], [], [], []
        first, rank = self.first, self.rank
        for w in words:
            at = len(token)
            starts.append(at)
            token.extend(first[b] for b in w.encode("utf-8"))
            end = len(token)
            prev.append(-1)
            prev.extend(range(at, end - 1))
            nxt.extend(range(at + 1, end))
            nxt.append(-1)
        where: dict[int, list[int]] = defaultdict(list)
        for i, j in enumerate(nxt):
            if j >= 0 and (r := rank.get((token[i], token[j]))) is not None:
                where[r].append(i)
        heap = list(where)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            a, b, new = self.merges[r]
            spots = where.pop(r)
            spots.sort()
            for i in spots:
                j = nxt[i]
                if token[i] != a or j < 0 or token[j] != b:
                    continue
                token[i], token[j] = new, -1
                k = nxt[i] = nxt[j]
                if k >= 0:
                    prev[k] = i
                    if (s := rank.get((new, token[k]))) is not None:
                        if s not in where:
                            heapq.heappush(heap, s)
                        where[s].append(i)
                if (h := prev[i]) >= 0 and (s := rank.get((token[h], new))) is not None:
                    if s not in where:
                        heapq.heappush(heap, s)
                    where[s].append(h)
        out = []
        for at in starts:
            ids = []
            while at >= 0:
                ids.append(token[at])
                at = nxt[at]
            out.append(ids)
        return out


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_CHARS bytes; a longer text is a range of its own."""
    offsets = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy())])
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_CHARS, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, to
        at = to


def encode(df: DataFrame, text: str, keep: list[str], path: str, ids: str | None = "ids", count: str | None = None) -> DataFrame:
    """The columns ``keep`` of each row with the token ids of ``text``, their number, or both.

    Every task takes its part of the corpus in chunks: the words of a chunk are collected, those not seen before
    are encoded together by one merge replay, and the ids are laid out document by document. No row leaves its
    task, so there is no shuffle, and a word is merged once a task however often it occurs. Only the vocabulary
    file (of fixed size) is sent to the executors. Strings of special tokens are ordinary text; an empty or null
    text gives an empty list and 0. Texts of any length are encoded whole. Extra columns are left out, so their
    names can't clash; repeated rows come out repeated, an empty table gives no row.
    """
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(load_merges(path))
    schema = df.select(*keep).schema
    if ids:
        schema = schema.add(ids, T.ArrayType(T.IntegerType()))
    if count:
        schema = schema.add(count, T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(PATTERN).findall
        replay, known = Replay(*model.value), {}
        for whole in batches:
            column = whole.column(len(keep))
            for at, to in _chunks(column):
                batch = whole.slice(at, to - at)
                docs = [split(t) if t else [] for t in column.slice(at, to - at).to_pylist()]
                new = list({w for d in docs for w in d} - known.keys())
                fresh = dict(zip(new, replay.encode(new)))
                look = known | fresh if len(known) < len(fresh) else known
                if look is known:
                    known.update(fresh)
                flat: list[int] = []
                offsets = [0]
                for d in docs:
                    for w in d:
                        flat.extend(look[w])
                    offsets.append(len(flat))
                columns = [batch.column(i) for i in range(len(keep))]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())))
                if count:
                    columns.append(pa.array(np.diff(offsets), pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *([ids] if ids else []), *([count] if count else [])])
                if len(look) > CACHE_WORDS:
                    known = {}
                else:
                    for w in new:
                        if len(w) > CACHE_CHARS:
                            look.pop(w, None)
                    known = look

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, schema)
