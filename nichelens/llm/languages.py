"""Language of texts and of passages by language-bitmask n-gram filters (problem 5).

All languages share one Bloom filter whose cells are bitmasks: looking an n-gram up once
(the AND of its cells) gives the set of all languages that hold it. A word's evidence
for a language is its n-grams' bits counted, less what false positives give.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichelens.llm.batches import bound_batches
from nichelens.session import quoted

#: Codes, English names and own names under which a label may give each language.
LABELS = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues",
    "nl": "nl nld dut dutch nederlands",
    "sv": "sv swe swedish svenska",
}
LANGUAGES = tuple(LABELS)
_CODE = {name: code for code, names in LABELS.items() for name in names.split()}

#: Bounds of the sample of labelled rows that the filters are fitted on: rows a language, characters a row.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 5000
CELLS, HASHES = 1 << 21, 3
#: Costs of a change of language at the end of a sentence and inside one, in words of full evidence.
AT_END, INSIDE = 0.8, 3.0
#: Fewer different words than this are no passage: of a text in one language, and beside a passage in another.
LEAST_WORDS, LEAST_BESIDE = 3, 4

_DROP = re.compile(r"(?:https?://|www\.)\S+|[#@]\w+|<[^<>]*>")
_END = re.compile(r"[.!?…\n|]+|//|--|(?<= )/(?= )")
_TOKEN = re.compile(r"[^\W_]+")


def label_code(label: str | None) -> str | None:
    """The language that a delivered label names (code, region code or name), or None."""
    if not label:
        return None
    return _CODE.get(re.split(r"[-_ ]", label.strip().lower())[0])


def bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def sentences(text: str) -> list[list[str]]:
    """A text's words as written, sentence by sentence. Links, tags, markup and words with digits are left out."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "#" in text or "@" in text or "<" in text or "://" in text or "www." in text:
        text = _DROP.sub(" ", text)
    return [ws for part in _END.split(text) if (ws := [t for t in _TOKEN.findall(part) if t.isalpha()])]


def tokens(text: str) -> tuple[list[str], list[bool]]:
    """A text's words in lower case, in order, and whether each begins a sentence."""
    words: list[str] = []
    after: list[bool] = []
    for ws in sentences(text):
        after.append(True)
        after += [False] * (len(ws) - 1)
        words += ws
    return " ".join(words).lower().split(" ") if words else words, after


def grams(word: str) -> list[str]:
    """The n-grams of a word: three and four characters with its ends marked, and the whole word."""
    w = f"<{word}>"
    return [w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1)] + [f"={word}"]


class LanguageFilters:
    """The bit-sliced filter: one byte a cell, one bit a language."""

    def __init__(self) -> None:
        self.cells = np.zeros(CELLS, dtype=np.uint8)
        self.names: frozenset[str] = frozenset()
        self.false = np.zeros(len(LANGUAGES))

    @staticmethod
    def places(gs: Iterable[str]) -> np.ndarray:
        h = np.array([xxhash.xxh3_64_intdigest(g) for g in gs], dtype=np.uint64)
        step = (h >> np.uint64(40)) | np.uint64(1)
        return np.array([(h + np.uint64(k) * step) & np.uint64(CELLS - 1) for k in range(HASHES)]).astype(np.int64)

    def fill(self, rates: list[dict[str, float]], share: float) -> None:
        """Put an n-gram into each language whose rate of it is at least ``share`` of the highest rate."""
        top: dict[str, float] = {}
        for r in rates:
            for g, x in r.items():
                if x > top.get(g, 0.0):
                    top[g] = x
        self.cells[:] = 0
        for k, r in enumerate(rates):
            gs = [g for g, x in r.items() if x >= share * top[g]]
            if gs:
                np.bitwise_or.at(self.cells, self.places(gs).ravel(), np.uint8(1 << k))
        self.false = np.array([float(((self.cells >> k) & 1).mean()) ** HASHES for k in range(len(LANGUAGES))])

    def evidence(self, words: list[str]) -> np.ndarray:
        """For each word, the corrected share of its n-grams that each language holds; 0 for names."""
        gs = [grams(w) for w in words]
        at = self.places([g for x in gs for g in x])
        mask = self.cells[at[0]]
        for k in range(1, HASHES):
            mask = mask & self.cells[at[k]]
        bits = ((mask[:, None] >> np.arange(len(LANGUAGES), dtype=np.uint8)) & 1).astype(float)
        weight = np.array([2.0 if g[0] == "=" else 1.0 for x in gs for g in x])
        bits *= weight[:, None] / np.maximum(bits.sum(axis=1), 1)[:, None] ** 0.5
        sizes = np.array([len(x) for x in gs])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        hits = np.add.reduceat(bits, first) / np.add.reduceat(weight, first)[:, None]
        hits = np.clip((hits - self.false) / (1 - self.false), 0, None)
        hits[[w in self.names for w in words]] = 0
        return hits


class _Evidence:
    """Evidence of words, looked up once while it is kept."""

    def __init__(self, filters: LanguageFilters, most: int = 200_000):
        self.filters, self.most = filters, most
        self.place: dict[str, int] = {}
        self.rows = np.zeros((4096, len(LANGUAGES)))

    def of(self, words: list[str]) -> np.ndarray:
        place = self.place
        try:
            return self.rows[[place[w] for w in words]]
        except KeyError:
            pass
        if len(place) > self.most:
            place.clear()
        new = [w for w in dict.fromkeys(words) if w not in place]
        n = len(place)
        while n + len(new) > len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        self.rows[n : n + len(new)] = self.filters.evidence(new)
        place.update(zip(new, range(n, n + len(new)), strict=True))
        return self.rows[[place[w] for w in words]]


def passages(words: list[str], after: list[bool], e: np.ndarray, hint: int | None = None) -> list[tuple[int, int, int]]:
    """Runs (language, first, end) of the words: the path of most evidence, less the cost of changes."""
    total = e.sum(axis=0)
    if hint is not None:
        total[hint] *= 1.01
    best = int(total.argmax())
    ahead = e - e[:, best : best + 1]
    if np.maximum(ahead, 0).sum(axis=0).max() < AT_END:
        return [(best, 0, len(words))]
    gain = np.cumsum(ahead, axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros(e.shape[1]), gain[:-1]]), axis=0)
    if (gain - low).max() < AT_END:
        return [(best, 0, len(words))]
    cost = np.where(after, AT_END, INSIDE)
    score, back = e[0].copy(), np.zeros(e.shape, dtype=np.int64)
    stay = np.arange(e.shape[1])
    for i in range(1, len(words)):
        top = int(score.argmax())
        jump = score[top] - cost[i]
        moved = jump > score
        back[i] = np.where(moved, top, stay)
        score = np.where(moved, jump, score) + e[i]
    at = int(score.argmax())
    path = [at]
    for i in range(len(words) - 1, 0, -1):
        at = int(back[i][at])
        path.append(at)
    path.reverse()
    runs: list[tuple[int, int, int]] = []
    for i, k in enumerate(path):
        if runs and runs[-1][0] == k:
            runs[-1] = (k, runs[-1][1], i + 1)
        else:
            runs.append((k, i, i + 1))
    return runs


def detect(text: str | None, evidence: _Evidence, hint: str | None = None) -> list[tuple[str, float, int]]:
    """(language, confidence, words) of each passage in reading order; neighbouring passages of one language are one.

    Fewer than LEAST_WORDS different words that are no names, or words of no known language, are no passage. The confidence is the
    lead over the second language as a share of the evidence.
    """
    words, after = tokens(text) if text else ([], [])
    if not words:
        return []
    e = evidence.of(words)
    runs = passages(words, after, e, LANGUAGES.index(hint) if hint else None)
    names = evidence.filters.names
    found: list[list] = []
    for k, a, b in runs:
        total = e[a:b].sum(axis=0)
        kept = {w for w in words[a:b] if len(w) > 1} - names
        if len(kept) < (LEAST_WORDS if len(runs) == 1 else LEAST_BESIDE) or total[k] < 0.25 * (b - a):
            continue
        if found and found[-1][0] == k:
            found[-1][1] += total
            found[-1][2] += b - a
        else:
            found.append([k, total, b - a])
    out = []
    for k, total, n in found:
        shares = total.tolist()
        own = shares.pop(k)
        out.append((LANGUAGES[k], min(1.0, max(0.0, 1 - max(shares) / max(own, 1e-9))), n))
    return out


def _rates(by_language: list[Counter[str]]) -> list[dict[str, float]]:
    out = []
    for words in by_language:
        n = max(1, sum(words.values()))
        r: Counter[str] = Counter()
        for w, c in words.items():
            for g in {*grams(w), *grams(bare(w))}:
                r[g] += c
        out.append({g: c / n for g, c in r.items() if c > 1 or n < 2000})
    return out


def fit(sample: list[tuple[str, str]]) -> LanguageFilters:
    """Filters from (language, text) rows whose labels may be wrong now and then.

    The first filters take n-grams at half of their highest rate or more, which leaves out what wrong labels bring in.
    They relabel each sentence of the sample; the final filters come from these. Words that always have a capital
    inside sentences of languages other than German are names and count for nothing.
    """
    by = [Counter() for _ in LANGUAGES]
    parsed = [(LANGUAGES.index(code), sentences(text)) for code, text in sample]
    for k, parts in parsed:
        for part in parts:
            by[k].update(w.lower() for w in part)
    filters = LanguageFilters()
    filters.fill(_rates(by), 0.5)
    evidence = _Evidence(filters)
    by, capital, seen = [Counter() for _ in LANGUAGES], Counter(), Counter()
    german = LANGUAGES.index("de")
    for _, parts in parsed:
        for written in parts:
            if len(written) < LEAST_WORDS:
                continue
            part = [w.lower() for w in written]
            total = evidence.of(part).sum(axis=0)
            k = int(total.argmax())
            if total[k] < 0.25 * len(part):
                continue
            by[k].update(part)
            if k != german:
                capital.update(w.lower() for w in written[1:] if w[0].isupper() and not w.isupper())
                seen.update(part[1:])
    filters.names = frozenset(w for w, c in capital.items() if c >= 3 and c >= 0.75 * seen[w])
    for c in by:
        for w in filters.names:
            c.pop(w, None)
    filters.fill(_rates(by), 0.08)
    return filters


def label_column(label: Column) -> Column:
    """label_code as an expression."""
    codes = F.create_map(*[F.lit(x) for pair in _CODE.items() for x in pair])
    return F.try_element_at(codes, F.split(F.lower(F.trim(label)), "[-_ ]").getItem(0))


def labelled_sample(texts: DataFrame, id_col: str, text: str, label: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most about ``rows`` texts of at most ``chars`` characters a language, chosen by a hash of the id."""
    known = texts.select(label_column(F.col(quoted(label))).alias("code"), F.col(quoted(text)).alias("text"), F.col(quoted(id_col)).alias("id")).where(F.col("code").isNotNull() & (F.length("text") <= chars))
    counts = {r["code"]: r["n"] for r in known.groupBy("code").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(0.0)
    for code, n in counts.items():
        keep = F.when(F.col("code") == code, min(1.0, rows / n)).otherwise(keep)
    picked = known.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < keep * (1 << 20)).distinct()
    return sorted((r["code"], r["text"]) for r in picked.limit(2 * rows * len(LANGUAGES)).collect())


def text_passages(texts: DataFrame, filters: LanguageFilters, id_col: str = "id", text: str = "text", label: str = "lang") -> DataFrame:
    """One row per passage: chunk_id, seg_no (from 1), lang, confidence, n_words, label_code, n_langs (different languages in the text).

    Texts without words of a known language give no row. The filters (2 MB) are broadcast; texts are not shuffled. A text delivered
    twice gives its rows twice.
    """
    spark = texts.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(filters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence = _Evidence(model.value)
        for pdf in batches:
            out = []
            for i, t, lab in zip(pdf["id"], pdf["text"], pdf["label"], strict=True):
                code = label_code(lab)
                found = detect(t, evidence, code)
                n = len({x[0] for x in found})
                out += [(i, s + 1, lang, conf, words, code, n) for s, (lang, conf, words) in enumerate(found)]
            yield pd.DataFrame(out, columns=["chunk_id", "seg_no", "lang", "confidence", "n_words", "label_code", "n_langs"])

    rows = texts.select(F.col(quoted(id_col)).cast("bigint").alias("id"), F.col(quoted(text)).alias("text"), F.col(quoted(label)).alias("label")).where("id is not null and text is not null")
    return rows.mapInPandas(run, "chunk_id bigint, seg_no int, lang string, confidence double, n_words int, label_code string, n_langs int")
