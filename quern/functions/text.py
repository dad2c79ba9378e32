"""Tokenizers of the word-count family and text aggregates, all in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per line of ``text`` (column ``line``); null texts have none."""
    return df.where(F.col(text).isNotNull()).select(*keep, F.explode(F.split(text, "\n")).alias("line"))


def split_blanks(line: Column) -> Column:
    """Words between runs of blanks and tabs; no empty word."""
    return F.filter(F.split(line, r"[ \t\r]+"), lambda w: w != "")


def count_words(words: DataFrame, word: str = "word", least: int = 1) -> DataFrame:
    """``(word, n)`` for words that occur ``least`` times or more."""
    counted = words.groupBy(word).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least) if least > 1 else counted


def classic_words(df: DataFrame, line: str, shortest: int = 3) -> DataFrame:
    """The classic job's words: lines shorter than ``shortest`` after trimming are skipped; words shorter than that
    are dropped *before* one trailing comma, full stop or semicolon is taken off; case is kept."""
    trimmed = F.trim(F.col(line))
    words = df.where(F.length(trimmed) >= shortest).select(F.explode(split_blanks(trimmed)).alias("w"))
    return words.where(F.length("w") >= shortest).select(F.regexp_replace("w", "[,.;]$", "").alias("word"))


def folded_words(df: DataFrame, line: str, longer_than: int = 0) -> DataFrame:
    """Lower-cased words of more than ``longer_than`` characters."""
    words = df.select(F.explode(split_blanks(F.lower(F.col(line)))).alias("word"))
    return words.where(F.length("word") > longer_than)


def inverted_index(df: DataFrame, doc: str, text: str) -> DataFrame:
    """``(doc, word)``: the postings of each lower-cased word, one row each, so that a word of all documents is no single
    value. The words of a document are made distinct inside its row."""
    found = F.array_distinct(F.filter(F.split(F.lower(text), r"[ \t\r\n]+"), lambda w: w != ""))
    return df.select(doc, F.explode(found).alias("word")).distinct()


def cooccurrence(df: DataFrame, line: str) -> DataFrame:
    """``(a, b, n)``: in how many lines two different words stand together, ``a < b``. Pairs of a line are made
    from its distinct words inside one row and pre-aggregated before the shuffle."""
    ws = F.array_sort(F.array_distinct(split_blanks(F.lower(F.col(line)))))
    indexed = df.select(ws.alias("ws")).where(F.size("ws") > 1).select("ws", F.posexplode("ws").alias("i", "a"))
    pairs = indexed.select("a", F.explode(F.slice("ws", F.col("i") + 2, F.size("ws"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def palindromes(words: DataFrame, word: str = "word", shortest: int = 3) -> DataFrame:
    """``(word, n)`` of words that read the same backwards."""
    w = F.col(word)
    return count_words(words.where((F.length(w) >= shortest) & (w == F.reverse(w))), word)


def level_counts(df: DataFrame, line: str, levels: tuple[str, ...] = ("error", "exception", "warning")) -> DataFrame:
    """``(level, n)``: lines that contain each word in any case; a line may count for several. One pass."""
    low = F.lower(F.col(line))
    sums = df.agg(*[F.count(F.when(low.contains(x), 1)).alias(x) for x in levels])
    return sums.unpivot([], list(levels), "level", "n")


def title_words(text: Column) -> Column:
    """First letter of each blank-separated word in upper case, the rest as it is (unlike ``initcap``)."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
