"""Spelling variants of a vocabulary by reduced-alphabet generation.

Letters are hashed to a few symbols, so that a word's reduced form is a string over a small
alphabet. One edit of a word is one edit, or none, of its reduced form. So the words at one
edit are among those whose reduced form lies in the full one-edit neighbourhood of the word's
own: the form itself, every deletion, replacement and insertion over the symbols. These are
some hundred strings a word, whatever the size of the real alphabet. They are joined with the
reduced vocabulary, and what meets is verified on the original strings.

The join's key is a reduced string, so the words behind one key share length and pattern.
More symbols make these groups smaller and the neighbourhoods larger.

DataFrame operations only; every group is counted before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.llm.storage import kept

#: Runs of Latin letters, those of Latin-1 included.
RUNS = "[A-Za-zÀ-ÿ]+"
SYMBOLS = "abcdefghijklmnop"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def counted(
    docs: DataFrame, least_length: int = 6, least_count: int = 5, doc_id: str = "doc_id", text: str = "text", heard: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(word, n): the words of all texts with their occurrences.

    A word is a run of Latin letters of the whole text, A-Z in lower case. `heard` may change
    each occurrence, given the document's id as text (empty for null) and the word. Words
    shorter than `least_length` code points or rarer than `least_count` are left out. Null and
    empty texts have no words, an empty table gives no rows, repeated rows count each, other
    columns are not read.
    """
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    words = F.transform(F.regexp_extract_all(F.col(text), F.lit(RUNS), F.lit(0)), lowered)
    if heard is not None:
        words = F.transform(words, lambda w: heard(ident, w))
    each = docs.select(F.explode(words).alias("word")).filter(F.char_length("word") >= least_length)
    return each.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def reduced(word: Column, symbols: int) -> Column:
    """The word with each letter replaced by the symbol of its code point."""
    letters = F.split(word, "")
    return F.array_join(F.transform(letters, lambda c: F.substring(F.lit(SYMBOLS), F.ascii(c) % symbols + 1, F.lit(1))), "")


def neighbourhood(form: Column, symbols: int) -> Column:
    """A string over the symbols and all strings at one edit of it, each once."""
    alphabet = F.array(*[F.lit(s) for s in SYMBOLS[:symbols]])
    size = F.char_length(form)

    def head(i: Column) -> Column:
        return F.substring(form, F.lit(1), i - 1)

    def tail(i: Column) -> Column:
        return F.substring(form, i, size)

    inside = F.sequence(F.lit(1), size)
    deleted = F.transform(inside, lambda i: F.concat(head(i), tail(i + 1)))
    replaced = F.flatten(F.transform(inside, lambda i: F.transform(alphabet, lambda s: F.concat(head(i), s, tail(i + 1)))))
    inserted = F.flatten(F.transform(F.sequence(F.lit(1), size + 1), lambda i: F.transform(alphabet, lambda s: F.concat(head(i), s, tail(i)))))
    return F.array_distinct(F.concat(F.array(form), deleted, replaced, inserted))


def neighbours(words: DataFrame, symbols: int = 8) -> DataFrame:
    """(word, n, other, other_n): every ordered pair of words at exactly one inserted, deleted
    or replaced code point. `words` is (word, n), each word once; empty words have no pairs."""
    if not 1 < symbols <= len(SYMBOLS):
        raise ValueError(f"symbols must be 2 to {len(SYMBOLS)}")
    forms = words.filter("word <> ''").select("word", "n", reduced(F.col("word"), symbols).alias("form"))
    reached = forms.select("word", "n", F.explode(neighbourhood(F.col("form"), symbols)).alias("form"))
    others = forms.withColumnsRenamed({"word": "other", "n": "other_n"})
    return reached.join(others, "form").filter(F.levenshtein("word", "other", 1) == 1).drop("form")


def variants(words: DataFrame, ratio: int = 5, symbols: int = 8) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of `words` (word, n).

    `n_near` counts the words at one edit. `form` is the most frequent of them, the least in
    code-point order of equal ones, if it occurs `ratio` times as often as the word or more;
    else it and `form_n` are null. `root` follows forms to the last, the word itself if it
    has none: frequencies rise along a chain, so it ends, and its length is at most the
    logarithm of the largest one. `words` is read several times: give a table.
    """
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = neighbours(words, symbols).groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best)
    taken = F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n")))
    found = kept(near.select("word", "n_near", taken.alias("taken")).select("word", "n_near", "taken.*"))
    roots = _roots(found.filter("form is not null").select("word", F.col("form").alias("root")))
    joined = words.join(found, "word", "left").join(roots, "word", "left")
    return joined.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): each word's last one along the links. Every round doubles the steps."""
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = kept(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = at.drop("moved")
        if at.filter("moved").isEmpty():
            return links
