"""Which texts contain which phrases, as substrings in normalized space."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of phrases that are broadcast at once; more phrases take more passes.
BLOCK_CHARS = 1_000_000


def phrase_matches(texts: DataFrame, phrases: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(text_id, needle) for each text (text_id, haystack) and each needle it contains, wherever in a word that is.

    A text is read once for a whole block of needles by an Aho-Corasick automaton, so the cost grows with the texts and the matches, not with
    texts times phrases. Blocks are bounded in size and broadcast. Empty and NULL needles match nothing; needles count once.
    """
    import ahocorasick

    spark = texts.sparkSession
    needles = phrases.select("needle").where("needle <> ''").distinct()
    chars = needles.agg(F.sum(F.length("needle"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    out = None
    for b in range(blocks):
        words = spark.sparkContext.broadcast([r[0] for r in needles.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == b).collect()])

        def run(batches: Iterator[pd.DataFrame], words=words) -> Iterator[pd.DataFrame]:
            found = ahocorasick.Automaton()
            for w in words.value:
                found.add_word(w, w)
            found.make_automaton()
            for pdf in batches:
                ids: list[int] = []
                hits: list[str] = []
                if words.value:
                    for i, text in zip(pdf["text_id"], pdf["haystack"], strict=True):
                        if text:
                            got = {w for _, w in found.iter(text)}
                            ids += [i] * len(got)
                            hits += got
                yield pd.DataFrame({"text_id": pd.Series(ids, dtype="int64"), "needle": pd.Series(hits, dtype="object")})

        part = texts.select(F.col("text_id").cast("bigint").alias("text_id"), "haystack").mapInPandas(run, "text_id bigint, needle string")
        out = part if out is None else out.unionByName(part)
    return out
