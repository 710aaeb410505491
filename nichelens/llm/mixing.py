"""Mixing sources to target weights by weighted fair queueing (problem 7)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichelens.llm.batches import bound_batches
from nichelens.operators.ordering import running_total
from nichelens.session import materialize, quoted

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the tokenizer's vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Documents that one slice of a source holds on average.
SLICE_ROWS = 50_000
#: Targets up to this number are broadcast; more are joined by a shuffle.
MAX_TARGETS = 10_000

_encodings: dict[str, object] = {}


def _encoding(vocabulary: bytes):
    import tiktoken

    key = hashlib.md5(vocabulary).hexdigest()
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encodings[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def token_sizes(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens), each document once. NULL and empty texts have 0 tokens; rows with a NULL id are left out."""
    spark = docs.sparkSession
    bound_batches(spark)
    vocabulary = spark.sparkContext.broadcast(open(tokenizer, "rb").read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(vocabulary.value).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(encode(t)) if t else 0 for t in pdf["text"]]})

    rows = docs.select(F.col(quoted("doc_id")).cast("bigint").alias("doc_id"), F.col(quoted("source")).alias("source"), F.col(quoted("text")).alias("text")).where("doc_id is not null")
    sized = rows.mapInPandas(run, "doc_id bigint, source string, tokens bigint")
    return sized.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))


def queue_positions(sizes: DataFrame, seed: int = 1) -> DataFrame:
    """``sizes`` with ``served``: tokens of the source up to and with this document, in the source's shuffled order.

    The order is that of a seeded hash. Its range is cut into slices; slice totals are summed up over a
    source's few slices, positions inside a slice apart from that. So a source with a third of all documents is
    spread over as many tasks as it has slices.
    """
    n = sizes.count()
    slices = max(1, -(-n // SLICE_ROWS))
    h = F.xxhash64("doc_id", F.lit(seed))
    rows = sizes.where("source is not null").withColumn("_h", h).withColumn("_slice", F.floor((F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53))) * slices).cast("int"))
    totals = rows.groupBy("source", "_slice").agg(F.sum("tokens").alias("_t"))
    before = totals.withColumn("_before", F.sum("_t").over(Window.partitionBy("source").orderBy("_slice")) - F.col("_t")).drop("_t")
    inside = F.sum("tokens").over(Window.partitionBy("source", "_slice").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_inside", inside).join(before, ["source", "_slice"]).select("doc_id", "source", "tokens", (F.col("_before") + F.col("_inside")).alias("served"))


def _fluid_times(queues: DataFrame, budget: int) -> DataFrame:
    """``queues`` with two times of its mixture: up to ``_sure`` all copies are within the budget, after ``_over`` none is.

    If documents could be split, source s would have served min(v x share, all its copies) by time v, which is at most one document more than it has.
    So the mixture has served the budget at the earliest when that sum reaches it, and at the latest when it reaches the budget and the
    largest document of each source. The sum is piecewise linear in v, with a bend where a source runs dry.
    """
    mix = Window.partitionBy("mix_id")
    by = mix.orderBy("_dry", "source")
    rows = queues.withColumn("_cap", F.col("_all") * F.col("_repeats")).withColumn("_dry", F.col("_cap") / F.col("_share"))
    rows = rows.withColumn("_gone", F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_live", F.sum("_share").over(by.rowsBetween(0, Window.unboundedFollowing))).withColumn("_slack", F.sum("_largest").over(mix))
    # the sum is the least of its linear pieces, so it reaches a goal where the last of them does
    until = lambda goal: F.when(F.sum("_cap").over(mix) >= goal, F.max(F.greatest((goal - F.col("_gone")) / F.col("_live"), F.lit(0.0))).over(mix)).otherwise(F.max("_dry").over(mix))
    rows = rows.withColumn("_sure", until(F.lit(float(budget))) * (1 - 1e-9)).withColumn("_over", until(F.lit(float(budget)) + F.col("_slack")) * (1 + 1e-9))
    return rows.select("mix_id", "source", "_share", "_repeats", "_all", "_sure", "_over")


def served_copies(sizes: DataFrame, targets: DataFrame, seed: int = 1, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents of every mixture: (mix_id, source, doc_id, tokens, copies, ...) of the copies 1 to ``copies`` taken for sure, and (mix_id, source, doc_id, tokens, copy, finish) of further ones.

    Virtual finish time of a copy: the tokens its source has served by then, earlier repeats included, divided by its share. How many copies of a document finish
    by a given time follows from its place in the queue, so nothing is unfolded to find the sure ones. Only copies that finish between the
    two times of _fluid_times, at most two largest documents of each source, are sorted: over all partitions by range, with a running total up to the budget.
    """
    sizes = materialize(sizes, "sizes")
    if budget is None:
        budget = sizes.agg(F.sum("tokens")).first()[0] or 0
    wanted = targets.select("mix_id", "source", F.col("target_share").alias("_share"), F.col("max_repeats").alias("_repeats")).where("_share > 0 and _repeats > 0 and source is not null").distinct()
    of_source = sizes.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("_all"), F.max("tokens").alias("_largest"))
    queues = materialize(_fluid_times(wanted.join(of_source, "source"), budget), "queues")
    if queues.count() <= MAX_TARGETS:
        queues = F.broadcast(queues)
    upto = lambda v: F.when(F.col("_all") == 0, F.col("_repeats")).otherwise(F.least(F.col("_repeats"), F.greatest(F.lit(0), F.floor((F.col(v) * F.col("_share") - F.col("served")) / F.col("_all")) + 1))).cast("int")
    rows = queue_positions(sizes, seed).join(queues, "source").withColumn("copies", upto("_sure")).withColumn("_last", upto("_over"))
    rows = materialize(rows.where("_last > 0").select("mix_id", "source", "doc_id", "tokens", "served", "copies", "_last", "_all", "_share"), "served")
    sure = rows.where("copies > 0")
    edge = rows.where("_last > copies").withColumn("copy", F.explode(F.sequence(F.col("copies") + 1, F.col("_last"))))
    edge = edge.withColumn("finish", _finish("copy")).select("mix_id", "source", "doc_id", "tokens", "copy", "finish")
    before = sure.groupBy("mix_id").agg(F.sum(F.col("tokens") * F.col("copies")).alias("_before"))
    order = ["mix_id", "finish", "source", "doc_id", "copy"]
    summed = materialize(running_total(edge, order, "tokens", "_upto"), "edge")
    base = before.join(summed.groupBy("mix_id").agg(F.min(F.col("_upto") - F.col("tokens")).alias("_base")), "mix_id", "right").select("mix_id", (F.coalesce("_before", F.lit(0)) - F.col("_base")).alias("_shift"))
    base = materialize(base, "edge-base")
    cut = summed.join(F.broadcast(base) if base.count() <= MAX_TARGETS else base, "mix_id").where(F.col("_upto") + F.col("_shift") <= budget)
    return sure, cut.select("mix_id", "source", "doc_id", "tokens", "copy", "finish")


def _finish(copy: str):
    return ((F.col(copy) - 1) * F.col("_all") + F.col("served")) / F.col("_share")


def mixture(sizes: DataFrame, targets: DataFrame, seed: int = 1, budget: int | None = None) -> DataFrame:
    """The documents of every mixture: mix_id, source, doc_id, copy (from 1), tokens, finish.

    ``targets`` has mix_id, source, target_share, max_repeats; only the proportions of a mixture's shares matter for the order.
    ``budget`` (default: the tokens of all of ``sizes``) is the size of each mixture.
    Copies are taken by finish time (ties: source, document, copy) as long as the total stays within the budget; where a
    source runs dry the others go on. Sources without documents and shares of NULL or 0 give no rows.
    """
    sure, cut = served_copies(sizes, targets, seed, budget)
    whole = sure.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("finish", _finish("copy"))
    columns = ["mix_id", "source", "doc_id", "copy", "tokens", "finish"]
    return whole.select(*columns).unionByName(cut.select(*columns))


def ordered(mixed: DataFrame) -> DataFrame:
    """A mixture in the order of its finish times, sorted by range over all partitions."""
    return mixed.repartitionByRange("mix_id", "finish", "source", "doc_id", "copy").sortWithinPartitions("mix_id", "finish", "source", "doc_id", "copy")


def shares(sizes: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """One row per mixture and source: target_share, wanted (tokens), taken (tokens), copies (documents taken), on_hand (documents), actual_share, exhausted, short.

    A source is exhausted if every one of its documents was taken max_repeats times, and short if less than ``wanted`` was
    taken and all of its copies together are less than that.
    """
    sizes = materialize(sizes, "sizes")
    budget = sizes.agg(F.sum("tokens")).first()[0] or 0
    sure, cut = served_copies(sizes, targets, seed, budget)
    both = sure.select("mix_id", "source", "tokens", F.col("copies").cast("bigint").alias("copies")).unionByName(cut.select("mix_id", "source", "tokens", F.lit(1).cast("bigint").alias("copies")))
    taken = both.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.sum("copies").alias("copies"))
    stock = sizes.where("source is not null").groupBy("source").agg(F.count("*").alias("on_hand"), F.sum("tokens").alias("stock"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    rows = targets.select("mix_id", "source", "target_share", "max_repeats").distinct().join(taken, ["mix_id", "source"], "left").join(stock, "source", "left")
    rows = rows.select("mix_id", "source", "target_share", "max_repeats", (F.col("target_share") * budget).alias("wanted"), zero("taken"), zero("copies"), zero("on_hand"), zero("stock"))
    whole = F.sum("taken").over(Window.partitionBy("mix_id"))
    most = F.greatest("max_repeats", F.lit(0))
    rows = rows.withColumn("actual_share", F.when(whole > 0, F.col("taken") / whole)).withColumn("exhausted", F.col("copies") >= F.col("on_hand") * most)
    return rows.withColumn("short", (F.col("taken") < F.col("wanted")) & (F.col("stock") * most < F.col("wanted"))).drop("stock")
