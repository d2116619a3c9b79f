"""Quality rules: counts within each text, and cross-document line frequency per host. Native DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declq.llm.common import SPACE_RE, aside, cut

#: Fixed values of the base rules: symbols, window length, least words, greatest percentage of repeated words.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: A line found in more documents of one host than this is boilerplate there.
MOST_DOCS_PER_HOST = 20
#: A document that keeps a smaller share of its words once boilerplate is gone is depleted.
LEAST_LEFT = 0.3
#: Hot lines are dealt over so many salts where they are joined back.
SALTS = 64


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def base_counts(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Works row by row without a shuffle. Windows of eight words are hashed by doubling (two, four, eight words); only a text
    whose set of window hashes is smaller than their number sorts them to find the repeated ones, so clean texts stay linear.
    Null text counts as empty: all counts 0, base_failed true.
    """
    pair = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    part = lambda x, start, less: F.slice(x, start, F.greatest(F.col("_n") - less, F.lit(0)))
    staged = (
        docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
        .withColumn("_w", F.array_remove(F.split("_text", SPACE_RE), ""))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
        .withColumn("_bare", _without(F.col("_text"), " \t\n\x0b\x0c\r"))
        .withColumn("_n", F.size("_w"))
        .withColumn("_h1", F.transform("_w", lambda w: F.xxhash64(w)))
        .withColumn("_h2", pair(part("_h1", 1, 1), part("_h1", 2, 1)))
        .withColumn("_h4", pair(part("_h2", 1, 3), part("_h2", 3, 3)))
        .withColumn("_h8", pair(part("_h4", 1, 7), part("_h4", 5, 7)))
        .withColumn("_d8", F.size("_h8") - F.size(F.array_distinct("_h8")))
    )
    # Start positions of windows found twice or more, ascending; a window adds min(8, distance to the next start) words.
    located = F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    staged = staged.withColumn("_s", F.when(F.col("_d8") > 0, located))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    marked = F.filter("_s", lambda x, k: same(x, F.get("_s", k - 1)) | same(x, F.get("_s", k + 1)))
    staged = staged.withColumn("_at", F.when(F.col("_d8") > 0, F.sort_array(F.transform(marked, lambda x: x["i"]))))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("sum"), i.alias("last")),
        lambda acc: acc["sum"],
    )
    n = F.col("_n").cast("long")
    repeats = F.coalesce(F.when(F.col("_d8") > 0, covered), F.lit(0)).cast("long")
    return (
        staged.withColumn("n_words", n)
        .withColumn("word_chars", F.length("_bare").cast("long"))
        .withColumn("n_symbols", (F.octet_length("_text") - F.octet_length(_without(F.col("_text"), SYMBOLS))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", repeats)
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
        .drop("_text", "_w", "_lines", "_bare", "_n", "_h1", "_h2", "_h4", "_h8", "_d8", "_s", "_at")
    )


def line_words(line: Column) -> Column:
    """The words of a line in lower case: lines with equal words are the same line."""
    return F.array_remove(F.split(F.lower(line), SPACE_RE), "")


def line_table(docs: DataFrame) -> DataFrame:
    """(_host, _id, _key, _pos, _line, _words): every line with a word, its normalised hash and its number of words.

    _key tells texts apart that share a doc_id. The table holds no text; it is cut, as two passes read it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(host_of(docs).alias("_host"), docs["doc_id"].cast("long").alias("_id"), F.xxhash64(text, F.length(text)).alias("_key"), F.posexplode_outer(F.split(text, "\n")).alias("_pos", "_text"))
    rows = rows.withColumn("_w", line_words(F.col("_text"))).select("_host", "_id", "_key", "_pos", F.xxhash64("_w").alias("_line"), F.size("_w").alias("_words"))
    return cut(rows).where("_words > 0")  # filtered after the cut: before it, Catalyst would push the filter, and so the splitting, below


def host_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["source"].cast("string"), F.lit(""))


def frequent_lines(lines: DataFrame, most_docs: int = MOST_DOCS_PER_HOST) -> DataFrame:
    """(host, line, n_docs): lines in more than `most_docs` documents of a host (`source`; null is one host).

    A document counts once for a line however often it holds it; rows that share a doc_id are one document. Both groupings
    combine on the map side, so a line of a third of all documents costs a row per task.
    """
    each = lines.select("_host", "_line", "_id").distinct()
    return each.groupBy(F.col("_host").alias("host"), F.col("_line").alias("line")).agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > most_docs)


def line_frequency_filter(docs: DataFrame, most_docs: int = MOST_DOCS_PER_HOST, least_left: float = LEAST_LEFT) -> DataFrame:
    """`docs` with the base counts, `removed_words`, `depleted`, `kept` and `clean_text` (boilerplate lines taken out).

    A line with a word is boilerplate if it is one of frequent_lines() for the document's host; removed_words are the words
    on those lines. depleted: a document loses lines and is left with fewer than LEAST_WORDS words or a smaller share than
    `least_left`. kept: neither base_failed nor depleted. Columns of these names are replaced; all rows stay, with null
    texts (kept false) and repeated rows. Columns that a query doesn't use are pruned, so without clean_text no text moves.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "depleted", "kept", "clean_text")
    docs, back = aside(docs, "doc_id", "text", "source")
    lines = line_table(docs)
    salted = frequent_lines(lines, most_docs).select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = lines.withColumn("_salt", F.pmod(F.xxhash64("_id", "_key"), F.lit(SALTS)).cast("int"))
    bad = dealt.join(salted, (F.col("_host") == F.col("host")) & (F.col("_line") == F.col("line")) & (F.col("_salt") == F.col("salt")), "left_semi")
    bad = bad.select("_host", "_id", "_key", "_pos", "_line", "_words").distinct()
    bad = bad.groupBy("_host", "_id", "_key").agg(F.sum("_words").alias("_gone"), F.collect_set("_line").alias("_bad"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = base_counts(docs.withColumns({"_row_host": host_of(docs), "_row_id": docs["doc_id"].cast("long"), "_row_key": F.xxhash64(text, F.length(text))}))
    joined = keyed.join(bad, (F.col("_row_host") == F.col("_host")) & F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_key") == F.col("_key")), "left")
    left = F.col("n_words") - F.col("removed_words")
    joined = joined.withColumn("removed_words", F.coalesce("_gone", F.lit(0)).cast("long"))
    joined = joined.withColumn("depleted", (F.col("removed_words") > 0) & ((left < LEAST_WORDS) | (left < least_left * F.col("n_words"))))
    joined = joined.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    is_bad = lambda x: F.array_contains("_bad", F.xxhash64(line_words(x)))
    clean = F.when(F.col("_bad").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x: ~is_bad(x)), "\n"))
    return back(joined.withColumn("clean_text", clean).drop("_row_host", "_row_id", "_row_key", "_host", "_id", "_key", "_gone", "_bad"))
