"""Keyword-stuffed and link-list pages by the shapes of their lines (problem 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichelens.session import materialize, quoted

_WORD = r"[\p{L}\p{N}]+"
_LINK = r"(?:https?://|www\.)\S+|<a\b[^>]*>|</a>|#[\p{L}\p{N}_]+"
_SPLIT = r"(?<=[.!?…])\s+|(?<=[。！？।])\s*|\n\s*\n|\n(?=\s*(?:https?://|www\.))"
_BLOCK = r"(?i)<br ?/?>|</?(?:p|div|li|ul|ol|tr|td|h\d|blockquote)\b[^>]*>"
_END = r'[.!?…。！？؟।][\p{Pe}\p{Pf}"\']*\s*(?:</\w+>)?\s*$'
_PRICE = r"\d[.,]\d\d\b"
#: Scripts without spaces between words; two of their letters count as a word.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: A page is flagged when more than this share of its words lies in its FEW most frequent shapes that are no sentence's.
SHARE, FEW = 0.5, 12
#: A shape is a sentence's if lines of it end as sentences do with at least this share, and how many lines the rule of thumb counts for beside the corpus.
ENDED, PRIOR = 0.5, 5.0


def _bucket(c: Column, *edges: float) -> Column:
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(c < edges[i], F.lit(i)).otherwise(out)
    return out.cast("string")


def lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per logical line: doc_id, n (words), shape, ends (whether it ends as a sentence), likely (the rule of thumb for its shape), fixed (-1: never a sentence's; 1: always; 0: to be learned).

    A logical line ends at the end of a sentence, an empty line, a block tag or before a line that begins with a link; other wrapped
    lines stay together. All counts are built-in expressions, and no word list of any language is used. NULL and empty texts give no
    line. Extra columns are ignored.

    The shape is: words / first letter / capitals / separators / line ends / links / prices / repeats / end mark of a short line or one of many separators, each in coarse steps. Repeats are pairs of
    neighbouring words that come again within the line; links with their words, tags and markup count as links.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    broken = F.when(F.col("text").contains("<"), F.regexp_replace("text", _BLOCK, "\n\n")).otherwise(F.col("text"))
    rows = rows.select("doc_id", F.explode(F.split(broken, _SPLIT)).alias("line"))
    line, plain = F.col("line"), F.col("plain")
    marked = line.contains("#") | line.contains("://") | line.contains("www.") | line.contains("<")
    rows = rows.withColumn("marked", marked).withColumn("plain", F.when(F.col("marked"), F.regexp_replace("line", _LINK, " ")).otherwise(line))
    rows = rows.withColumn("words", F.regexp_extract_all(F.lower("plain"), F.lit(_WORD), 0))
    rows = rows.withColumn("n", F.when(F.col("marked"), F.regexp_count("line", F.lit(_WORD))).otherwise(F.size("words"))).where("n > 0")
    pairs = F.zip_with(F.col("words"), F.slice("words", 2, 1_000_000_000), lambda a, b: F.xxhash64(a, b))
    times = lambda t: (F.length("plain") - F.length(F.replace(plain, F.lit(t), F.lit("")))) / F.lit(len(t))
    seps = F.length("plain") - F.length(F.translate("plain", ",;•·/|、", "")) - times("\n|") + times(" - ") + times(" – ") + times(" — ")
    broken_up = F.when(times("\n") * 5 > F.size("words"), times("\n")).otherwise(0)  # a list of one item a line, no wrapped text
    dense = F.when(F.length("plain") > 8 * F.size("words"), F.regexp_count("plain", F.lit(_UNSPACED)) / 2).otherwise(0)
    start = F.regexp_extract("plain", r"^[^\p{L}\p{N}]*([\p{L}\p{N}])", 1)
    rows = rows.select(
        "doc_id",
        "n",
        (F.size("words") + dense).alias("k"),
        F.size("words").alias("plain_words"),
        F.when(F.size("words") < 4, 0).otherwise(F.size("words") - 1 - F.size(F.array_distinct(F.slice(pairs, 1, F.size("words") - 1)))).alias("again"),
        seps.alias("seps"),
        broken_up.alias("broken"),
        F.regexp_count("plain", F.lit(r"\p{Lu}")).alias("caps"),
        (start == F.upper(start)).alias("raised"),
        F.substring(F.rtrim("line"), -16, 16).rlike(_END).alias("ends"),
        F.when(plain.rlike("[0-9]"), plain.rlike(_PRICE)).otherwise(False).alias("priced"),
    )
    k, links = F.greatest("k", F.lit(1)), F.col("n") - F.col("plain_words")
    stuffed = F.col("again") / k >= 0.12
    shape = F.concat_ws(
        "/",
        _bucket(F.col("k"), 4, 8, 20, 40),
        F.when(F.col("raised"), "A").otherwise("a"),
        _bucket(F.col("caps") / k, 0.001, 0.3, 0.8),
        _bucket(F.col("seps") / k, 0.05, 0.12, 0.2, 0.5),
        _bucket(F.col("broken") / k, 0.001, 0.3),
        _bucket(links / F.col("n"), 0.01, 0.3, 0.6),
        F.when(F.col("priced"), "$").otherwise("-"),
        F.when(stuffed, _bucket(F.col("again") / k, 0.2)).otherwise("-"),
        F.when(F.col("ends") & ((F.col("k") < 8) | (F.col("seps") / k >= 0.12)), ".").otherwise("-"),
    )
    marks = F.col("seps") + F.col("broken")
    unmarked = (marks / k < 0.12) & (links / F.col("n") < 0.01) & ~F.col("priced")
    likely = F.when(F.col("priced"), 0.4).when((marks / k < 0.2) & (links / F.col("n") < 0.3), 0.9).otherwise(0.1)
    fixed = F.when((F.col("k") < 4) | (links > F.col("k")) | stuffed, -1).when(unmarked & ((F.col("k") >= 8) | F.col("ends")), 1).otherwise(0)
    return rows.select("doc_id", "n", shape.alias("shape"), "ends", likely.alias("likely"), fixed.alias("fixed"))


def learned_shapes(by_shape: DataFrame) -> DataFrame:
    """(shape, sentence) over the whole corpus, one row a shape; there are fewer than 10,000 of them.

    ``by_shape`` has shape, fixed, likely, lines and ended (lines that end as sentences do). Lines of sentences mostly end with a mark, lines of lists don't, so a
    shape with separators, links or prices is a sentence's if at least ENDED of its lines do. Shapes with few lines lean on the rule of thumb, which counts as PRIOR lines. Shapes of
    fewer than four words, of more links than words and of repeated pairs of words are never a sentence's; of others, shapes without the marks of a list always are if they have eight words
    or an end mark, since parts of sentences lack the end.
    """
    sums = by_shape.groupBy("shape").agg(F.min("fixed").alias("fixed"), F.sum("lines").alias("lines"), F.sum("ended").alias("ended"), F.sum(F.col("likely") * F.col("lines")).alias("likely"))
    share = (F.col("ended") + PRIOR * F.col("likely") / F.col("lines")) / (F.col("lines") + PRIOR)
    return sums.select("shape", F.when(F.col("fixed") != 0, F.col("fixed") > 0).otherwise(share >= ENDED).alias("sentence"))


def page_shapes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", share: float = SHARE, few: int = FEW) -> DataFrame:
    """One row per page: ``words``, ``loose_words`` (in lines of no sentence shape), ``loose_shapes`` (how many such shapes), ``main_shape`` (the one with most words, ties to the smaller name) and ``flagged``.

    A page is flagged if its ``few`` most frequent shapes that are no sentence's hold more than ``share`` of its words. Words are counted with those of
    links, tags and markup. Pages without words give no row; a page
    delivered twice gives one row with the same shares. Lines are summed by (page, shape) where they arise, so
    the shuffle carries counts only, and a page's text is never moved; the sums serve to learn the shapes and to judge the pages.
    """
    rows = lines(docs, id_col, text)
    sums = rows.groupBy("doc_id", "shape").agg(F.min("fixed").alias("fixed"), F.max("likely").alias("likely"), F.sum("n").alias("n"), F.count("*").alias("lines"), F.count(F.when(F.col("ends"), 1)).alias("ended"))
    sums = materialize(sums, "page-shapes")
    judged = sums.join(F.broadcast(learned_shapes(sums)), "shape")
    loose = ~F.col("sentence")
    shapes = F.sort_array(F.collect_list(F.when(loose, F.struct((-F.col("n")).alias("m"), F.col("shape")))))
    pages = judged.groupBy("doc_id").agg(F.sum("n").alias("words"), F.coalesce(F.sum(F.when(loose, F.col("n"))), F.lit(0)).alias("loose_words"), shapes.alias("_s"))
    most = -F.aggregate(F.slice("_s", 1, few), F.lit(0).cast("bigint"), lambda a, s: a + s.m)
    return pages.select("doc_id", "words", "loose_words", F.size("_s").cast("bigint").alias("loose_shapes"), F.when(F.size("_s") > 0, F.col("_s")[0]["shape"]).alias("main_shape"), (most > F.col("words") * share).alias("flagged"))
