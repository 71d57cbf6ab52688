"""Benchmark decontamination with a distributed positional inverted index.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  A benchmark item's
windows are its runs of `width` words; an item of fewer words, but not none, is one window.

1. The terms of all windows are counted over the whole corpus.
2. `postings` stores, for the terms that are among the rarest of some window, one posting an
   occurrence: document, position and the words around it.
3. `phrases` takes the posting lists of a window's rarest terms, moves each by the term's
   offset, and intersects them: positions on which all lists agree start a candidate, and the
   words around the rarest term's posting settle whether it is the phrase.
4. `near` intersects lists with slack and returns proximity matches; `proximity` also takes
   windows of which some terms are in no document.

Only DataFrame functions are used.  Windows and terms are sent to every executor when a count
shows that they are few (`few`); beyond that, terms meet thin rows of document, place and word,
and the words around a place are cut from its document once all its places are known, so that no
row but a document's own holds a whole text.  Both ways give the same rows.  A document is known by
a hash of id and text, so repeated ids and repeated rows keep results of their own.  Null texts
have no words; items without words have no windows; a null item id is named "null" in `items`.
Other columns of the documents pass through; of n_words, n_hit, items and contaminated the
operator's own replace them.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 13
#: Rows up to which windows and terms are sent to every executor.
BROADCAST_ROWS = 50_000


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")


def is_small(df: DataFrame, few: int) -> bool:
    return df.limit(few + 1).count() <= few


def small(df: DataFrame, few: int) -> DataFrame:
    """`df`, broadcast if it has few rows."""
    return F.broadcast(df) if is_small(df, few) else df


def windows(items: DataFrame, key: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(win, words, items): every distinct window and the sorted distinct items that have it."""
    w = items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))
    each = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("words"))
    wins = each.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return wins.select(F.sha2(F.array_join("words", " "), 256).alias("win"), "words", "items")


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, w): documents as words; `doc` is a hash of id and text."""
    return docs.select(doc_hash(key, text).alias("doc"), words(F.col(text)).alias("w"))


def doc_hash(key: str, text: str) -> Column:
    """The same for equal rows only; 128 bits, so unlike rows do not meet."""
    return F.md5(F.concat_ws(" ", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit(""))))


def anchors(wins: DataFrame, frequency: DataFrame, most: int = 2, partial: bool = False, few: int = BROADCAST_ROWS) -> DataFrame:
    """(term, win, words, items, offset, rank, lists): the rarest distinct terms of each window, at their first offset.

    A window with a term that no document has occurs nowhere; with `partial` its other terms stay.
    """
    terms = wins.select("win", "words", "items", F.posexplode("words").alias("offset", "term"))
    rare = (
        terms.groupBy("win", "term")
        .agg(F.min("offset").alias("offset"), F.first("words").alias("words"), F.first("items").alias("items"))
        .join(small(frequency, few), "term")
        .groupBy("win")
        .agg(F.first("words").alias("words"), F.first("items").alias("items"), F.slice(F.sort_array(F.collect_list(F.struct("n", "term", "offset"))), 1, most).alias("rare"), F.count(F.lit(1)).alias("found"))
    )
    if not partial:
        rare = rare.where(F.col("found") == F.size(F.array_distinct("words")))
    return rare.select("win", "words", "items", F.size("rare").alias("lists"), F.posexplode("rare").alias("rank", "r")).select("r.term", "win", "words", "items", "r.offset", "rank", "lists")


def term_counts(docs: DataFrame, wins: DataFrame, text: str, few: int = BROADCAST_ROWS) -> DataFrame:
    """(term, n): occurrences in the whole corpus of each term of a window."""
    terms = saved(wins.select(F.explode("words").alias("term")).distinct(), "terms")
    each = docs.select(F.explode(words(F.col(text))).alias("term"))
    if is_small(terms, few):
        return each.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    # words are counted before they move
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term", "left_semi")


def postings(docs: DataFrame, terms: DataFrame, key: str, text: str, width: int = WIDTH, few: int = BROADCAST_ROWS) -> DataFrame:
    """(doc, term, pos, around, lead): the positional index of `terms`; around: the words from `lead` before pos to width - 1 after."""
    whole = tokens(docs, key, text)
    each = whole.select("doc", "w", F.posexplode("w").alias("pos", "term"))
    terms = terms.select("term").distinct()
    if is_small(terms, few):
        hit = each.join(F.broadcast(terms), "term")
    else:
        places = each.select("doc", "pos", "term").join(terms, "term", "left_semi").groupBy("doc").agg(F.collect_set(F.struct("pos", "term")).alias("places"))
        # texts move, and are cut into words behind the join
        texts = docs.select(doc_hash(key, text).alias("doc"), F.col(text).alias("t"))
        hit = texts.join(places, "doc").select("doc", words(F.col("t")).alias("w"), "places").select("doc", "w", F.explode("places").alias("p")).select("doc", "w", "p.pos", "p.term")
    lead = F.least(F.col("pos"), F.lit(width - 1))
    return hit.select("doc", "term", "pos", F.slice("w", F.col("pos") - lead + 1, lead + width).alias("around"), lead.alias("lead"))


def moved(index: DataFrame, keys: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """Posting lists moved by the terms' offsets: (doc, win, start, rank, lists, same, n, items)."""
    got = index.join(small(keys, few), "term").withColumn("start", F.col("pos") - F.col("offset"))
    here = F.slice("around", F.greatest(F.col("lead") - F.col("offset") + 1, F.lit(1)), F.size("words"))
    same = F.when(F.col("rank") == 0, (F.col("lead") >= F.col("offset")) & (here == F.col("words"))).otherwise(False)
    return got.select("doc", "win", "start", "rank", "lists", same.alias("same"), F.size("words").alias("n"), "items")


def phrases(lists: DataFrame) -> DataFrame:
    """(doc, win, start, n, items): exact occurrences, from the intersection of the moved lists."""
    met = lists.where("start >= 0").groupBy("doc", "win", "start").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("met"), F.max("lists").alias("lists"), F.max("same").alias("same"), F.first("n").alias("n"), F.first("items").alias("items"))
    return met.where(F.col("same") & (F.bit_count("met") == F.col("lists"))).select("doc", "win", "start", "n", "items")


def near(lists: DataFrame, slack: int = 5) -> DataFrame:
    """(doc, win, start, other): two of a window's rarest terms in one document, at most `slack` words from where the phrase has them."""
    first = lists.select("doc", "win", "start", "rank", F.explode(F.sequence(-(F.lit(slack)), F.lit(slack))).alias("by")).withColumn("other", F.col("start") + F.col("by"))
    second = lists.select("doc", "win", F.col("start").alias("other"), F.col("rank").alias("next"))
    return first.join(second, ["doc", "win", "other"]).where("rank < next").select("doc", "win", "start", "other").distinct()


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, most: int = 2, partial: bool = False, few: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """The windows' moved posting lists in `docs`, and the exact phrases among them."""
    wins = saved(windows(items, item, item_text, width), "windows")
    keys = saved(anchors(wins, saved(term_counts(docs, wins, text, few), "counts"), most, partial, few), "anchors")
    lists = moved(postings(docs, keys, key, text, width, few), keys, few)
    return lists, phrases(lists)


def proximity(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, slack: int = 5, most: int = 4, few: int = BROADCAST_ROWS) -> DataFrame:
    """(key, item, start): where two of the `most` rarest terms of an item's window, of those that documents have, stand about as in the window.

    start: the place, in words from 0, at which the window would begin; below 0 where it would begin before the text.
    """
    lists = saved(matches(docs, items, key, text, item, item_text, width, most, True, few)[0], "lists")
    items_of = lists.select("win", F.explode("items").alias("item")).distinct()
    names = docs.select(F.col(f"`{key}`").alias(key), doc_hash(key, text).alias("__doc"))
    found = near(lists, slack).join(items_of, "win").select(F.col("doc").alias("__doc"), F.col("item"), F.least("start", "other").alias("start")).distinct()
    return names.join(found, "__doc").drop("__doc")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, share: int = 20, few: int = BROADCAST_ROWS) -> DataFrame:
    """Every row of `docs` (all columns) with n_words, n_hit, items (sorted ids) and contaminated.

    A word inside an occurrence of a window is hit; a document is contaminated when
    share * n_hit >= n_words and n_hit > 0.  few: rows up to which windows and terms are broadcast.
    """
    _, found = matches(docs, items, key, text, item, item_text, width, few=few)
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    # the words that spans cover: each adds what lies beyond the end so far
    covered = lambda s: F.aggregate(
        s,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["start"]))).cast("long").alias("n"),
            F.greatest(a["to"], x["end"]).cast("long").alias("to"),
        ),
    )["n"]
    hits = found.groupBy("doc").agg(spans.alias("spans"), F.collect_set("items").alias("sets"))
    hits = hits.select(F.col("doc").alias("__doc"), covered(F.col("spans")).alias("__hit"), F.sort_array(F.array_distinct(F.flatten("sets"))).alias("__found"))
    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "contaminated")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.size(words(F.col(text))).cast("long").alias("n_words"), doc_hash(key, text).alias("__doc"))
    n = F.coalesce("__hit", F.lit(0)).cast("long")
    return rows.join(hits, "__doc", "left").select(*[F.col(f"`{c}`") for c in kept], "n_words", n.alias("n_hit"), F.coalesce("__found", F.array().cast("array<string>")).alias("items"), ((n > 0) & (share * n >= F.col("n_words"))).alias("contaminated"))
