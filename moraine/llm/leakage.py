"""Evaluation texts leaking into training text: suffix arrays over shards of the corpus.

Each shard of documents becomes one sequence of word numbers, whose suffixes are sorted by doubling
prefixes, together with those of the test texts, as far as these follow. Every suffix of every test text is
looked up by binary search; the keys of the doubled prefixes give the longest verbatim match.
Suffixes that share no ``min_words`` words with a test text match nothing and are left out of the array.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.session import cut_table
from .textform import form

MIN_WORDS = 8
#: Words of corpus text per shard, about; a document is never cut.
SHARD_WORDS = 2_000_000
#: Words of test text that one pass over the corpus carries to the executors (8 MB of numbers).
BLOCK_WORDS = 1_000_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the text's one form, ignoring case."""
    return _WORD.findall(form(text).casefold()) if text else []


class TestTexts:
    """Word numbers of a block of test texts, each closed by a 0."""

    __test__ = False  # no test case, whatever pytest thinks of the name

    def __init__(self, texts: list[tuple[int, str, str]]):
        self.vocabulary: dict[str, int] = {}
        ids: list[int] = []
        self.starts, self.items, self.parts = [], [], []
        for item, part, text in texts:
            self.starts.append(len(ids))
            self.items.append(item)
            self.parts.append(part)
            ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            ids.append(0)
        self.ids = np.array(ids, dtype=np.int64)
        self.starts = np.array(self.starts, dtype=np.int64)
        self.items = np.array(self.items, dtype=np.int64)


def _doubled(ids: np.ndarray, split: int, length: int) -> list[tuple[int, np.ndarray]]:
    """[(span, key)] with growing spans: ``key`` numbers the first ``span`` words of each suffix in their
    order, 0 where a 0 comes before. Equal keys mean equal words.

    Spans double up to ``length`` over both texts at once, so keys of corpus and test suffixes compare.
    From ``length`` on, only suffixes keep a key that share these words with one on the other
    side; spans double until there is none. That orders the suffixes as far as the other side follows.
    """
    _, first = np.unique(ids, return_inverse=True)
    key = np.where(ids != 0, first + 1, 0)
    span, levels = 1, []
    while True:
        if span >= length:
            there = np.zeros(int(key.max()) + 1, dtype=np.int8)
            there[key[:split]] |= 1
            there[key[split:]] |= 2
            there[0] = 0
            key = np.where(there[key] == 3, key, 0)
            if not key.any():
                return levels
        levels.append((span, key.astype(np.int32)))
        step = min(span, length - span) if span < length else span
        ahead = np.zeros(len(ids), dtype=np.int64)
        ahead[: max(0, len(ids) - step)] = key[step:]
        at = np.flatnonzero((key > 0) & (ahead > 0))
        _, rank = np.unique(key[at].astype(np.int64) * (int(key.max()) + 1) + ahead[at], return_inverse=True)
        key = np.zeros(len(ids), dtype=np.int64)
        key[at] = rank + 1
        span += step


def search_shard(corpus: np.ndarray, test: TestTexts, min_words: int = MIN_WORDS, chunk: int = 1_000_000):
    """Yield (test position, corpus position, words) of the longest matches of ``min_words`` or more,
    in the order of test positions, at most ``chunk`` at once.

    Both texts end with a 0. A match is reported once, where it begins: the suffix array is sorted by the
    first ``min_words`` words and then by the word before, so the suffixes that only go on with a match which
    began earlier are a range that the search leaves out. A passage that many documents share thus costs
    one match for each of them, whatever its length.
    """
    split = len(corpus)
    ids = np.concatenate([corpus, test.ids])
    levels = _doubled(ids, split, min_words)
    longer = [(span, key) for span, key in levels if span >= min_words]
    if not longer:
        return
    shorter = [(span, key) for span, key in levels if span < min_words]
    key = longer[0][1].astype(np.int64)
    before = np.concatenate([[0], ids[:-1]])
    top = int(before.max()) + 1
    pos, want = np.flatnonzero(key[:split]), split + np.flatnonzero(key[split:])
    pos = pos[np.lexsort((*(k[pos] for _, k in reversed(longer[1:])), before[pos], key[pos]))]  # the suffix array
    heads, spots = key[pos], key[pos] * top + before[pos]
    lo, hi = np.searchsorted(heads, key[want], "left"), np.searchsorted(heads, key[want], "right")
    spot = key[want] * top + before[want]
    skip_lo, skip_hi = np.searchsorted(spots, spot, "left"), np.searchsorted(spots, spot, "right")
    starts = before[want] == 0
    skip_lo, skip_hi = np.where(starts, hi, skip_lo), np.where(starts, hi, skip_hi)
    ends = np.cumsum((skip_lo - lo) + (hi - skip_hi))
    total = int(ends[-1]) if len(ends) else 0
    for begin in range(0, total, chunk):
        pair = np.arange(begin, min(begin + chunk, total))
        owner = np.searchsorted(ends, pair, "right")
        row = lo[owner] + pair - np.where(owner > 0, ends[owner - 1], 0)
        row = np.where(row < skip_lo[owner], row, row - skip_lo[owner] + skip_hi[owner])
        t, c = want[owner], pos[row]
        size = np.zeros(len(t), dtype=np.int64)
        for span, k in [*reversed(longer), *reversed(shorter)]:
            a = k[t + size]
            size += np.where((a > 0) & (a == k[c + size]), span, 0)
        yield t - split, c, size


_MATCH = "item_id bigint, part string, doc_id bigint, matched_words int, item_word int, doc_word int"


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [words(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string()))], names=["doc_id", "words"])


def _search(test: TestTexts, min_words: int, shard_words: int, split: bool = False):
    """``split``: the second column has word lists already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = test.vocabulary.get

        def rows(which, doc, size, t, c, docs, starts) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(which), 100_000):
                cut_ = slice(lo, lo + 100_000)
                w, d = which[cut_], doc[cut_]
                columns = (test.items[w], pa.array(test.parts, pa.string()).take(pa.array(w)), docs[d], size[cut_], t[cut_] - test.starts[w], c[cut_] - starts[d])
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.astype(k.to_pandas_dtype()), k) for x, k in zip(columns, kinds)], names=[x.split()[0] for x in _MATCH.split(", ")])

        def flush(parts: list[np.ndarray], docs: list[int], starts: list[int]) -> Iterator[pa.RecordBatch]:
            """The longest match of each test text in each document. Matches come by test text, so of all
            texts but the last one seen the result is complete."""
            corpus, docs, starts = np.concatenate(parts), np.array(docs, dtype=np.int64), np.array(starts, dtype=np.int64)
            held = [np.empty(0, dtype=np.int64)] * 5
            for t, c, size in search_shard(corpus, test, min_words):
                found = (np.searchsorted(test.starts, t, "right") - 1, np.searchsorted(starts, c, "right") - 1, size, t, c)
                which, doc, size, t, c = (np.concatenate(x) for x in zip(held, found))
                order = np.lexsort((c, t, -size, doc, which))
                first = np.ones(len(order), dtype=bool)
                first[1:] = (np.diff(which[order]) != 0) | (np.diff(doc[order]) != 0)
                best = order[first]
                last = which[best] == which.max()
                yield from rows(*(x[best[~last]] for x in (which, doc, size, t, c)), docs, starts)
                held = [x[best[last]] for x in (which, doc, size, t, c)]
            yield from rows(*held, docs, starts)

        parts, docs, starts, size = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = text if split else words(text)
                if len(found) < min_words:
                    continue
                row = np.zeros(len(found) + 1, dtype=np.int64)
                row[:-1] = [get(w, 0) for w in found]
                parts.append(row)
                docs.append(doc_id)
                starts.append(size)
                size += len(row)
                if size >= shard_words:
                    yield from flush(parts, docs, starts)
                    parts, docs, starts, size = [], [], [], 0
        if parts:
            yield from flush(parts, docs, starts)

    return run


def test_blocks(items: DataFrame, item: str, parts: list[str], block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str, str]]]:
    """The test texts in blocks of bounded size, streamed from Spark partition by partition."""
    block, size = [], 0
    for row in items.select(F.col(item).cast("bigint").alias("i"), *parts).orderBy("i").toLocalIterator():
        for part in parts:
            if row[part]:
                block.append((row["i"], part, row[part]))
                size += len(row[part]) // 2 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


test_blocks.__test__ = False


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    item: str = "item_id",
    parts: tuple[str, ...] = ("question", "answer"),
    min_words: int = MIN_WORDS,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(item_id, part, doc_id, matched_words, item_word, doc_word), the longest match of each test
    text in each document that shares ``min_words`` or more consecutive words with it.

    Test texts travel to the executors in blocks of bounded size; the corpus does not move at all. If there
    is more than one block, the corpus is split into words once and written, each block is one pass over
    that, and its matches are written before the next block is made. Null and short texts match
    nothing. Of equally long matches the first is reported. Repeated documents are each reported.
    """
    corpus = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks = test_blocks(items, item, list(parts), block_words)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs.sparkSession.createDataFrame([], _MATCH)
    if second is None:
        return corpus.mapInArrow(_search(TestTexts(first), min_words, shard_words), _MATCH)
    lists = cut_table(corpus.mapInArrow(_word_lists, "doc_id bigint, words array<string>"))
    each = (cut_table(lists.mapInArrow(_search(TestTexts(b), min_words, shard_words, True), _MATCH)) for b in itertools.chain((first, second), blocks))
    return reduce(DataFrame.unionByName, each)


def clean_documents(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that hold no leaked passage."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
