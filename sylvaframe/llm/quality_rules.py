"""Quality rules: base rules, and the divergence of a document's histograms from references of its language.

Only DataFrame functions. A document's character classes and its language's common words are two histograms; each is compared with
the language's mean histogram by the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). The common words of a
language are those that most of its documents contain. Histograms of few characters or words scatter by chance, so documents under a
minimum length are not judged by them, and the greatest word distance of a language follows the spread of its documents' distances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import row_of, stored, words_of

#: Reference of every rare or missing language: character classes only.
OTHER = "und"
#: Common words per language; a language has a reference of its own with this share of the documents, and so many of them.
N_COMMON, MIN_LANG_SHARE, MIN_LANG_DOCS = 16, 0.01, 20
CLASSES = ("n_lower", "n_upper", "n_mark", "n_symbol", "n_space")
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Least words for the character histogram and for the word histogram, and the greatest distance of character histograms.
MIN_CHAR_WORDS, MIN_COMMON_WORDS = 50, 200
MAX_CHAR_DISTANCE = 0.25
#: No word limit is below what chance reaches in a text of MIN_COMMON_WORDS words; parts of 1 in which distances are counted.
LEAST_WORD_LIMIT, BINS = 0.20, 1000


def _left(text: Column, pattern: str) -> Column:
    """Characters of text that pattern does not match."""
    return F.length(F.regexp_replace(text, pattern, ""))


#: SQL: the mask of a sort key's head; the bits below it hold any position of the word hashes h.
_MASK = "shiftleft(-1L, length(bin(size(h))))"
#: SQL: sorted longs, one per 3-word window: head of its hash and its position, from the word hashes h and the mask m.
_KEYS = (
    "sort_array(slice(transform(h, (x, i) -> (xxhash64(x, get(h, i + 1), get(h, i + 2)) & m) | cast(i as bigint)),"
    " 1, greatest(0, size(h) - 2)))"
)


def _covered() -> str:
    """SQL: words covered by repeated windows, from the words w, the mask m and the sorted keys c.

    Equal windows share the head of their hash, so they are among the neighbours in c of equal head. Those few are
    sorted by their words; equal ones then stand side by side.
    """
    head = "(x & m)"
    near = f"filter(c, (x, i) -> (i > 0 and (c[i - 1] & m) = {head}) or (i + 1 < size(c) and (c[i + 1] & m) = {head}))"
    at = "cast(x & ~m as int)"
    full = f"sort_array(transform({near}, x -> named_struct('h', struct(w[{at}], w[{at} + 1], w[{at} + 2]), 'p', {at})))"
    twice = "filter(transform(s, (x, i) -> if((i > 0 and s[i - 1].h = x.h) or (i + 1 < size(s) and s[i + 1].h = x.h), x.p, -1)), p -> p >= 0)"
    words = "aggregate(transform(q, (p, i) -> if(i + 1 < size(q), least(3, q[i + 1] - p), 3)), 0L, (a, x) -> a + x)"
    # transform over a one-element array binds a value to a name, so it is evaluated once
    return f"transform(array({full}), s -> transform(array(sort_array({twice})), q -> {words})[0])[0]"


def common_words(docs: DataFrame, n: int = N_COMMON, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, listed): the n words that most documents of a language contain, most frequent first, equal ones by code point.

    Languages of at least MIN_LANG_DOCS documents and MIN_LANG_SHARE of all, so there are at most 1 / MIN_LANG_SHARE rows.
    """
    base = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    total = base.agg(F.count("*").alias("total"))  # one row
    own = base.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).crossJoin(total)
    large = own.where((F.col("n") >= MIN_LANG_DOCS) & (F.col("n") >= MIN_LANG_SHARE * F.col("total"))).select("lang")
    words = base.join(F.broadcast(large), "lang").select("lang", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counted.withColumn("nth", nth).where(F.col("nth") <= n)  # Spark limits the groups before it shuffles them
    return top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("nth", "word"))).alias("l")).select("lang", F.col("l.word").alias("listed"))


def features(docs: DataFrame, lists: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n_common: int = N_COMMON) -> DataFrame:
    """One row of counts per row of docs, with the row itself (row): base counts, character classes (CLASSES) and, with lists, common words (array common)."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.lit(None).cast("string") if lists is None else F.col(lang_col).cast("string")
    base = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"), lang.alias("lang"))
    if lists is None:
        base = base.withColumn("listed", F.lit(None).cast("array<string>"))
    else:
        base = base.join(F.broadcast(lists), "lang", "left")
    total = F.length("text")
    counted = base.select(
        "row",
        "doc_id",
        F.when(F.col("listed").isNull(), OTHER).otherwise(F.col("lang")).alias("lang"),
        words_of(F.col("text")).alias("w"),
        "listed",
        total.cast("long").alias("n_chars_"),
        (total - _left(F.col("text"), SYMBOLS)).cast("long").alias("n_symbol"),
        (total - _left(F.col("text"), r"\p{Lu}+")).cast("long").alias("n_upper"),
        (total - _left(F.col("text"), r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~0-9]+")).cast("long").alias("n_mark"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
    )
    hashed = counted.withColumn("word_chars", F.length(F.array_join("w", "")).cast("long")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    keyed = hashed.withColumn("m", F.expr(_MASK)).withColumn("c", F.expr(_KEYS))
    word = [F.get(F.col("listed"), F.lit(k)) for k in range(n_common)]
    common = [F.when(x.isNull(), 0).otherwise(F.size("w") - F.size(F.array_remove("w", x))).cast("long") for x in word]
    return keyed.select(
        "row",
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        F.col("word_chars"),
        F.col("n_symbol").alias("n_symbols"),
        "n_dup_lines",
        F.when(F.size("c") < 2, F.lit(0).cast("long")).otherwise(F.expr(_covered())).alias("n_repeat_words"),
        (F.col("word_chars") - F.col("n_symbol") - F.col("n_upper") - F.col("n_mark")).alias("n_lower"),
        "n_upper",
        "n_mark",
        "n_symbol",
        (F.col("n_chars_") - F.col("word_chars")).alias("n_space"),
        F.array(*common).alias("common") if lists is not None else F.lit(None).cast("array<long>").alias("common"),
    )


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _histograms(counts: DataFrame) -> DataFrame:
    """Adds p_char and p_word, arrays of shares; null below the minimum lengths."""
    chars = F.array(*[F.col(c).cast("double") for c in CLASSES])
    share = F.transform(chars, lambda x: x / (F.col("word_chars") + F.col("n_space")))
    rest = F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    words = F.concat(F.transform("common", lambda x: x / F.col("n_words")), F.array(rest / F.col("n_words")))
    return counts.withColumn("p_char", F.when(F.col("n_words") >= MIN_CHAR_WORDS, share)).withColumn(
        "p_word", F.when((F.col("n_words") >= MIN_COMMON_WORDS) & (F.col("lang") != OTHER), words)
    )


def _mean(name: str, size: int) -> list[Column]:
    return [F.avg(F.col(name)[i]).alias(f"{name}{i}") for i in range(size)]


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    half = f"aggregate(zip_with({{a}}, {{b}}, (x, y) -> if(x > 0, x * log2(2 * x / (x + y)), 0D)), 0D, (s, x) -> s + x)"
    return F.expr(f"sqrt(greatest(0D, ({half.format(a=p, b=q)} + {half.format(a=q, b=p)}) / 2))")


def word_limits(judged: DataFrame) -> DataFrame:
    """(l_lang, word_limit) from rows (lang, word_distance): third quartile and three times the spread of the quartiles, LEAST_WORD_LIMIT at least."""
    bins = judged.groupBy("lang", F.floor(F.col("word_distance") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    quartiles = bins.groupBy("lang").agg(F.expr("percentile(bin + 1, array(0.25D, 0.75D), n)").alias("q"))
    fence = (F.col("q")[1] + 3 * (F.col("q")[1] - F.col("q")[0])) / BINS
    return quartiles.select(F.col("lang").alias("l_lang"), F.greatest(F.lit(LEAST_WORD_LIMIT), fence).alias("word_limit"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n_common: int = N_COMMON, with_row: bool = False) -> DataFrame:
    """(doc_id, base counts, base_failed, char_distance, word_distance, word_limit, kept): one row per row of docs; with_row adds it as struct row.

    A language's common words are common_words(), its reference is the mean histogram over its documents that pass the base rules, its
    word limit word_limits() of them. Rare languages, null included, share one reference of character classes. kept is false if a base rule
    fails or a distance is above its limit; documents under a minimum length, whose distance is null, are not judged by it. Null texts count
    as empty: they fail the base rules. Each row is judged by its own text and language, so null and repeated ids are rows like any other;
    repeated rows give repeated rows, an empty table an empty result; other columns never clash. Texts of any length are counted whole.
    """
    # at most 1 / MIN_LANG_SHARE rows of n_common words: a broadcast of fixed size
    lists = stored(common_words(docs, n_common, text_col, lang_col))
    made = _histograms(features(docs, lists, id_col, text_col, lang_col, n_common)).withColumn("base_failed", _base_failed())
    counts = stored(made if with_row else made.drop("row"))
    n_words = n_common + 1
    # at most one row per listed language and one for all the others: a broadcast of fixed size
    means = counts.where("not base_failed").groupBy("lang").agg(*_mean("p_char", len(CLASSES)), *_mean("p_word", n_words))
    reference = means.select(
        F.col("lang").alias("r_lang"),
        F.array(*[f"p_char{i}" for i in range(len(CLASSES))]).alias("r_char"),
        F.array(*[f"p_word{i}" for i in range(n_words)]).alias("r_word"),
    )
    columns = ["lang", "p_word", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *["row"] * with_row]
    judged = counts.join(F.broadcast(reference), F.col("lang") == F.col("r_lang"), "left").select(
        *columns, distance("p_char", "r_char").alias("char_distance"), distance("p_word", "r_word").alias("word_distance")
    )
    limits = word_limits(judged.where("not base_failed and p_word is not null"))
    judged = judged.join(F.broadcast(limits), F.col("lang") == F.col("l_lang"), "left")
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | F.coalesce(F.col("word_distance") > F.col("word_limit"), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).drop("lang", "p_word", "l_lang")
