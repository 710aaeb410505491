"""Evaluation texts leaking into training text, by suffix arrays of the training shards (problem 6)."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from nichelens.llm.batches import bound_batches
from nichelens.session import materialize, quoted

MIN_WORDS = 10
#: Characters of test items that are broadcast at once; a larger test set goes through in blocks.
BLOCK_CHARS = 4_000_000

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_HIDDEN = re.compile("[­​-‍⁠﻿]")
_LEAK = "doc_id bigint, item_id bigint, n_words int, doc_word int, item_word int"


def words_of(text: str | None) -> list[str]:
    """The words of a text, without entities, tags, invisible characters and case."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    return _WORD.findall(text.lower())


#: Multiplier of the rolling hash, and the seed of the words' random values in it.
_BASE, _SEED = np.uint64(0x9E3779B97F4A7C15), 20260301
#: Pairs of places that are held against each other at once.
PAIRS = 1_000_000


def _hashes(values: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Prefix sums of value x power, so that equal runs of words have equal differences up to a power."""
    return np.concatenate([[np.uint64(0)], np.cumsum(values * power[: len(values)], dtype=np.uint64)])


class TestSuffixes:
    """All suffixes of a block of test items that have ``min_words`` words or more.

    Words are numbered from 1; 0 stands for a word of no item and for the end of a
    text. A suffix's key is its first ``min_words`` numbers, big-endian, so that keys sort as suffixes do.
    """

    __test__ = False

    def __init__(self, items: list[Row], min_words: int):
        texts = [(r["item_id"], words_of(r["text"])) for r in items]
        self.min_words = min_words
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
        flat: list[int] = [0]
        item: list[int] = []
        place: list[int] = []
        start: list[int] = []
        for i, ws in texts:
            for k in range(len(ws) - min_words + 1):
                item.append(i)
                place.append(k)
                start.append(len(flat) + k)
            flat += [self.number[w] for w in ws]
            flat += [0] * min_words
        self.tokens = np.array(flat, dtype=np.uint32)
        self.start = np.array(start, dtype=np.int64)
        keys = suffix_keys(self.tokens, self.start, min_words)
        order = np.argsort(keys, kind="stable")
        self.keys, self.start = keys[order], self.start[order]
        self.item, self.place = np.array(item, dtype=np.int64)[order], np.array(place, dtype=np.int64)[order]
        self.longest = max((len(ws) for _, ws in texts), default=0)


def suffix_keys(tokens: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    if not len(starts):
        return np.empty(0, dtype=f"S{4 * n}")
    return np.ascontiguousarray(tokens[starts[:, None] + np.arange(n)].astype(">u4")).view(f"S{4 * n}").ravel()


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Places of all suffixes in lexicographic order over their whole length, by prefix doubling."""
    m = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        after = np.zeros(m, dtype=np.int64)
        after[: max(0, m - step)] = rank[step:]
        key = rank * (m + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[1], 1 + np.cumsum(key[order[1:]] != key[order[:-1]])]) if m else np.empty(0, dtype=np.int64)
        rank = np.empty(m, dtype=np.int64)
        rank[order] = new
        step *= 2
        if not m or new[-1] == m or step >= m:
            return order


def live_runs(tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of at least n words of test items, each between zeros, and their places in ``tokens``. Whatever else a shard holds can match no test suffix."""
    zero = np.concatenate([[True], tokens == 0, [True]])
    edges = np.flatnonzero(zero)
    long = np.diff(edges) > n
    first, size = edges[:-1][long], np.diff(edges)[long] - 1
    place = np.concatenate([[-1], *(np.append(np.arange(f, f + c), -1) for f, c in zip(first, size, strict=True))]).astype(np.int64)
    return np.where(place < 0, 0, tokens[place]).astype(np.uint32), place


def longest(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, power: np.ndarray, least: int, most: int) -> np.ndarray:
    """Length of the common run from place i in text a and j in b on, known to be ``least`` words long, by binary search with the texts' rolling hashes a and b."""
    low, high = np.full(len(i), least, dtype=np.int64), np.minimum(np.minimum(len(a) - 1 - i, len(b) - 1 - j), most)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) // 2
        x, y = i[open_], j[open_]
        up, down = np.maximum(y - x, 0), np.maximum(x - y, 0)  # both sides to the same power
        same = (a[x + mid] - a[x]) * power[up] == (b[y + mid] - b[y]) * power[down]
        low[open_[same]] = mid[same]
        high[open_[~same]] = mid[~same] - 1


def _search(shards: Iterator[pd.DataFrame], tests: TestSuffixes) -> Iterator[pd.DataFrame]:
    get, n = tests.number.get, tests.min_words
    value = np.random.RandomState(_SEED).randint(0, 1 << 62, size=len(tests.number) + 2, dtype=np.int64).astype(np.uint64)
    power = np.empty(0, dtype=np.uint64)
    for shard in shards:
        flat: list[int] = []
        first: list[int] = []
        for text in shard["text"]:
            first.append(len(flat))
            flat += [get(w, 0) for w in words_of(text)]
            flat.append(0)
        tokens, at = live_runs(np.array(flat, dtype=np.uint32), n)
        order = suffix_array(tokens)
        whole = np.concatenate([[0], np.cumsum(tokens == 0)])
        order = order[order + n <= len(tokens)]
        order = order[whole[order + n] == whole[order]]  # suffixes of n words or more
        keys = suffix_keys(tokens, order, n)
        lo, hi = np.searchsorted(keys, tests.keys, "left"), np.searchsorted(keys, tests.keys, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        need = max(len(tokens), len(tests.tokens)) + 1
        if len(power) < need:
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(need, _BASE)]), dtype=np.uint64)
        mine = _hashes(value[tokens], power)
        theirs = _hashes(np.where(tests.tokens == 0, value[-1], value[tests.tokens]), power)
        # a match that goes on to the left is part of a longer one: of each range only the places after another word than the test suffix has before it
        before = tokens[order - 1].astype(np.int64)
        ranges = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
        by = np.lexsort((before, ranges))
        placed = order[by]
        code = ranges[by] * (len(tests.number) + 1) + before[by]
        own = tests.tokens[tests.start[hit] - 1].astype(np.int64)
        code_own = ranges[lo[hit]] * (len(tests.number) + 1) + own
        skip_lo, skip_hi = np.searchsorted(code, code_own, "left"), np.searchsorted(code, code_own, "right")
        skip_lo, skip_hi = np.where(own == 0, hi[hit], skip_lo), np.where(own == 0, hi[hit], skip_hi)
        t = np.concatenate([hit, hit])
        begin, counts = np.concatenate([lo[hit], skip_hi]), np.concatenate([skip_lo - lo[hit], hi[hit] - skip_hi])
        doc_start, doc_id = np.array(first), shard["doc_id"].to_numpy()
        best: pd.DataFrame | None = None
        total = np.cumsum(counts)
        for k in range(0, int(total[-1]), PAIRS):
            pair = np.arange(k, min(k + PAIRS, int(total[-1])))
            owner = np.searchsorted(total, pair, "right")
            p = placed[begin[owner] + pair - (total[owner] - counts[owner])]
            q = t[owner]
            size = longest(mine, p, theirs, tests.start[q], power, n, tests.longest)
            doc = np.searchsorted(doc_start, at[p], "right") - 1
            found = pd.DataFrame({"doc_id": doc_id[doc], "item_id": tests.item[q], "n_words": size, "doc_word": at[p] - doc_start[doc], "item_word": tests.place[q]})
            found = found if best is None else pd.concat([best, found])
            best = found.sort_values(["doc_id", "item_id", "n_words", "doc_word", "item_word"], ascending=[True, True, False, True, True]).drop_duplicates(["doc_id", "item_id"])
        if best is not None:
            yield best


def leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The longest verbatim match of each document and test item that share ``min_words`` consecutive words or more.

    Columns: doc_id, item_id, n_words (length of the match), doc_word and item_word (where it
    begins, in words from 0; of equal lengths the earliest). Each Arrow batch of documents is a shard: its suffix
    array is built, every test suffix is looked up in it by binary search, and each match that can't go on to the left is extended to its end. Test items are
    broadcast in blocks of at most ``block_chars`` characters; a larger test set takes several passes, one block in memory at a time.
    NULL and empty texts match nothing; items of fewer words can't leak; documents and items delivered
    twice count once. Documents are never shuffled, only matches are.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).where("doc_id is not null and text is not null")
    out = None
    for b in range(blocks):
        tests = spark.sparkContext.broadcast(TestSuffixes(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect(), min_words))
        part = rows.mapInPandas(lambda shards, tests=tests: _search(shards, tests.value), _LEAK)
        if blocks > 1:
            part = materialize(part, "leaks")
            tests.destroy()
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.n_words", (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def without_leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the documents that contain a passage of a test item. Documents with a NULL id stay."""
    return docs.join(leaks(docs, items, min_words).select(F.col("doc_id").alias("_leaked")).distinct(), F.col(quoted("doc_id")) == F.col("_leaked"), "left_anti")
