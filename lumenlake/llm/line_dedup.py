"""Line dedup: an exact set-similarity join, in DataFrame operations only.

A line's tokens are its distinct five-word shingles (its word sequence if it is shorter), similar lines have a Jaccard
similarity of 0.75 or more. Tokens are ordered by rarity, from counts over all lines in a table of fixed size, then by
hash. Lines with equal token sets are one set, represented by its first line. Two similar sets share a token in their
prefixes of n - ceil(0.75 n) + 1 rarest tokens (prefix filter); a shared token at places i and j leaves room for at most
1 + min(n - i, m - j) common tokens (positional filter), and neither set is much longer than the other (length filter).
So in the shorter set the token is among the first seventh, and tokens without such a place in any set are left out.
What passes is verified on the full token sets.

A set that many lines nearly repeat would pair with all of them. So the sets of a prefix token are first compared with two
of them only, the earliest and the most repeated; later members that match are settled. Only the others are compared
with every earlier set that passes the filters.

Large inputs take these steps in rounds, each for the tokens or sets of some hashes, so that disk holds a round's shuffle files
only. Where few rows of a large table meet a small one, a table of bits holds most others back before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _store
from ._documents import with_plain_names

SHINGLE = 5
#: Lines with fewer words are never removed: only those without any.
MIN_WORDS = 1
#: Similarity as a fraction.
NUMER, DENOM = 3, 4
#: Cells of the table of token counts.
CELLS = 1 << 16
#: A round for each so many tokens of all lines, and how many rounds there are at most.
ROUND, ROUNDS = 1 << 25, 4
#: The row of a line: repeated doc_ids are told apart by a digest of the text.
ROW = ["doc_id", "digest"]
PLACE = [*ROW, "line_no"]


def _hashes(line: Column) -> Column:
    """A hash of each word. Most lines have no white space but blanks, and splitting at one character takes half the time."""
    other = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c")) | F.contains(line, F.lit("\r"))
    split = F.when(other, F.split(line, r"[\x20\x09-\x0D]+")).otherwise(F.split(line, " "))
    return F.transform(F.array_remove(split, ""), lambda w: F.xxhash64(w))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.split(text, "\n").alias("lines")).filter("doc_id is not null and lines is not null")


def _with_tokens(lines: DataFrame) -> DataFrame:
    """lines with `tokens` instead of their words' hashes `h`: distinct hashes of the shingles.

    A shingle's hash is that of two runs of three words that overlap in one. Every step is a projection of its own, so
    that none is evaluated twice.
    """
    three = F.transform("h", lambda h, i: F.xxhash64(h, F.get("h", i + 1), F.get("h", i + 2)))
    rest = [c for c in lines.columns if c != "h"]
    lines = lines.select(*rest, three.alias("h"))
    starts = F.slice("h", F.lit(1), F.greatest(F.size("h") - (SHINGLE - 1), F.lit(1)))
    return lines.select(*rest, F.array_distinct(F.transform(starts, lambda t, i: F.xxhash64(t, F.get("h", i + 2)))).alias("tokens"))


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, digest, line_no and the hashes of words (h) of each line that can be removed."""
    every = _rows(docs).select(*ROW, F.posexplode("lines").alias("line_no", "line"))
    # a filter on h would be moved down and split and hash every line once more
    every = every.filter(F.ltrim("line", F.lit(" \t\x0b\x0c\r")) != "")
    lines = every.select(*PLACE, _hashes(F.col("line")).alias("h"))
    return lines.filter(F.size("h") >= min_words) if min_words > 1 else lines


def _rarity(lines: DataFrame) -> tuple[Column, int]:
    """A number for each cell of token hashes: how often its tokens occur in all lines, in eighths of a power of two, as the high byte of a long;
    and how many tokens there are."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("h") - SHINGLE, F.lit(0)))
    each = lines.select("h", F.explode_outer(starts).alias("i"))  # starts are never empty; explode would add a filter on h
    three = [F.xxhash64(*(F.get("h", F.col("i") + k) for k in range(at, at + 3))) for at in (0, 2)]
    cells = each.select(F.xxhash64(*three).bitwiseAND(CELLS - 1).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    table, total = [0] * CELLS, 0
    for cell, n in cells.collect():  # at most CELLS rows
        table[cell] = min(255, int(8 * math.log2(n)))
        total += n
    high = (((x << 55) + 2**63) % 2**64 - 2**63 for x in table)
    return F.expr(f"from_json('[{','.join(map(str, high))}]', 'array<bigint>')"), total  # a constant, which the optimizer folds


def _ranked(token: Column, table: Column) -> Column:
    """A number that orders tokens by the byte of their cell, then by hash. It is never null, and Spark sorts such longs as they are."""
    return F.coalesce(F.get(table, token.bitwiseAND(CELLS - 1)), F.lit(0).cast("long")).bitwiseOR(F.shiftrightunsigned(token, 9))


def _least_overlap(n: Column, m: Column) -> Column:
    """How many common tokens sets of n and m need: ceil((n + m) * 3 / 7)."""
    return F.ceil((n + m) * NUMER / F.lit(NUMER + DENOM))


def _in_round(key: Column, i: int, rounds: int) -> Column:
    """Whether a hash is of round i. Low bits are left to tables of bits."""
    return F.pmod(F.shiftright(key, 32), F.lit(rounds)) == i


def _full(docs: DataFrame, firsts: DataFrame, rounds: int) -> DataFrame:
    """first and all tokens of the lines at firsts, as a written table: their documents are read again, and only those lines are shuffled."""
    firsts = firsts.select("first.*")

    def some(i: int) -> DataFrame:
        mine = _in_round(F.xxhash64("doc_id"), i, rounds)
        wanted = firsts.filter(mine)
        place = F.xxhash64(*PLACE)
        held = _store.among(wanted.select(place))
        lines = _rows(docs).filter(mine).select(*ROW, F.posexplode("lines").alias("line_no", "line")).filter(held(place))
        lines = lines.join(wanted, PLACE, "left_semi").groupBy(*PLACE).agg(F.first("line").alias("line"))  # repeated rows
        return _with_tokens(lines.select(F.struct(*PLACE).alias("first"), _hashes(F.col("line")).alias("h")))

    return _store.in_rounds(docs.sparkSession, some, rounds, "full")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, digest (of the text) and line_no (from 0) of each line of docs (doc_id long, text) that is similar to an earlier line.

    Earlier is a smaller doc_id, or an earlier line of the same document; lines are judged on the input, so a removed line
    still removes later ones. Lines end at line feeds; words are runs of non-space characters. Lines without words, or with
    fewer than min_words, are never removed. Rows that repeat doc_id and text are one document, with other texts they are
    documents of their own in the order of their digests; rows without doc_id or text have no lines here; an empty
    table gives no rows; other columns are ignored. Written tables of its work remain: call it in a `_store.scope`. Those
    that nothing reads any more, and shuffle files, go between the steps.
    """
    lines = _lines(docs, min_words)
    table, total = _rarity(lines)
    rounds = max(1, min(ROUNDS, total // ROUND))
    ordered = _with_tokens(lines).select(*PLACE, F.sort_array(F.transform("tokens", lambda t: _ranked(t, table))).alias("o"))
    kept = F.col("n") - F.ceil(F.col("n") * NUMER / F.lit(DENOM)).cast("int") + 1
    rows = ordered.select(*PLACE, F.size("o").alias("n"), F.xxhash64("o").alias("set"), F.xxhash64(F.lit(0), "o").alias("also"), "o")
    rows = _store.written(rows.select(*PLACE, "n", "set", "also", F.transform(F.slice("o", F.lit(1), kept), lambda x: F.hash(x)).alias("prefix")), "lines")
    firsts = rows.groupBy("set", "also", "n").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("copies"), F.first("prefix").alias("prefix"))
    firsts = _store.written(firsts, "firsts")
    places = _store.written(rows.drop("prefix"), "places")
    _store.drop(rows)

    group = Window.partitionBy("token")
    token = firsts.select("set", "n", F.posexplode("prefix").alias("i", "token"))
    short = F.col("i") * (NUMER + DENOM) <= F.col("n") * (DENOM - NUMER)
    token = token.withColumn("of", F.count("*").over(group)).withColumn("short", F.count_if(short).over(group)).withColumn("least", F.min("n").over(group))
    # the greatest set that can be similar, if it has the token at its first place, is at least the least one
    token = token.filter((F.col("of") > 1) & (F.col("short") > 0) & (F.col("least") * NUMER <= (NUMER + DENOM) * (F.col("n") - F.col("i")) - F.col("n") * NUMER))
    some = _store.in_rounds(docs.sparkSession, lambda i: token.filter(F.pmod("token", F.lit(rounds)) == i).select("token", "i", "n", "set"), rounds, "tokens")
    wide, firsts = firsts, _store.written(firsts.drop("prefix"), "firsts")
    _store.drop(wide)
    shared = some.join(firsts.select("set", "n", "first", "copies"), ["set", "n"]).select("token", "i", "n", "first", "copies")
    shared = shared.withColumn("earliest", F.min(F.struct("first", "n", "i")).over(group)).withColumn("common", F.max(F.struct("copies", "first", "n", "i")).over(group))
    shared = _store.written(shared, "shared")
    _store.drop(some)

    def passes(a: str, b: str) -> Column:
        """Whether set a is earlier than b and can be similar to it, by length and places of the shared token."""
        an, bn, ai, bi = (F.col(f"{x}_{y}") for y in ("n", "i") for x in (a, b))
        need = _least_overlap(an, bn)
        room = F.lit(1) + F.least(an - 1 - ai, bn - 1 - bi)
        return (F.col(f"{a}_first") < F.col(f"{b}_first")) & (room >= need) & (F.least(an, bn) * DENOM >= F.greatest(an, bn) * NUMER)

    full = _full(docs, shared.select("first").distinct(), rounds)  # of all sets that can be similar to another
    later = [F.col(x).alias(f"b_{x}") for x in ("first", "n", "i")]

    def found(pairs: DataFrame) -> DataFrame:
        """The first places of later sets that are similar to the earlier set of a pair, as a written table."""

        def some(i: int) -> DataFrame:
            mine = lambda first: _in_round(F.xxhash64(first), i, rounds)
            some = _store.written(pairs.filter(mine("b_first")).select("a_first", "b_first").distinct(), "pairs")
            held = _store.among(some.select(F.xxhash64("a_first").alias("h")).union(some.select(F.xxhash64("b_first"))))
            own = full.filter(held(F.xxhash64("first")))
            both = some.join(own.toDF("a_first", "a"), "a_first").join(own.filter(mine("first")).toDF("b_first", "b"), "b_first")
            common = F.size(F.array_intersect("a", "b"))
            return both.filter(common * DENOM >= (F.size("a") + F.size("b") - common) * NUMER).select("b_first").distinct()

        return _store.in_rounds(docs.sparkSession, some, rounds, "settled")

    def to(pivot: str) -> DataFrame:
        fields = [F.col(f"{pivot}.{x}").alias(f"a_{x}") for x in ("first", "n", "i")]
        return shared.select(*later, *fields).filter(passes("a", "b"))

    one = found(to("earliest").union(to("common")))
    rest = shared.join(one, shared["first"] == one["b_first"], "left_anti").select("token", *later)
    every = shared.select("token", *(F.col(x).alias(f"a_{x}") for x in ("first", "n", "i")))
    two = found(rest.join(every, "token").filter(passes("a", "b")))
    _store.drop(full)
    matched = one.union(two).withColumnRenamed("b_first", "first").distinct()

    marked = firsts.drop("prefix").join(matched.withColumn("gone", F.lit(True)), "first", "left").filter("gone or copies > 1")
    marked = _store.written(marked, "marked")
    for table in (shared, one, two):
        _store.drop(table)
    again = _store.lookup(places, marked, ["set", "also", "n"], "copies").filter(F.col("gone") | (F.struct(*PLACE) > F.col("first")))
    return again.select(*PLACE).distinct()


def _removed(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, digest and the sorted numbers of removed lines (gone), as a written table."""
    with _store.scope():
        gone = removed_lines(docs, min_words).groupBy(*ROW).agg(F.array_sort(F.collect_list("line_no")).alias("gone"))
        return _store.result(gone, "gone")


def summary(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and the removed lines' numbers, joined by commas, of each row of docs (doc_id long, text).

    A null text has no lines, an empty one has one; a row without doc_id loses none; repeated rows get equal values; an
    empty table gives no rows; other columns are ignored.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.size(F.split(text, "\n")).alias("n"))
    rows = rows.select(*ROW, F.when(F.col("n") > 0, F.col("n")).otherwise(0).cast("long").alias("n_lines"))
    return rows.join(_removed(docs, min_words), ROW, "left").select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id long, text and any other columns, which stay as they are) without the removed lines.

    A document that loses lines and has no word left goes; null, empty and blank texts and rows without doc_id stay;
    repeated rows lose the same lines; an empty table gives no rows.
    """
    return with_plain_names(docs, ("doc_id", "text"), lambda plain: _without_lines(plain, min_words))


def _without_lines(docs: DataFrame, min_words: int) -> DataFrame:
    lost = _removed(docs, min_words).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_of"), "gone")
    text = F.col("text").cast("string")
    row = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(text))
    held = _store.among(lost.select(F.xxhash64("_id", "_of")))(row)
    left = docs.filter(held).withColumn("_own", F.xxhash64(text))
    # hashed, not sorted: lists of lines are short, texts are not
    left = left.join(lost.hint("shuffle_hash"), (left["doc_id"].cast("long") == lost["_id"]) & (left["_own"] == lost["_of"]), "left").withColumn("_own", F.split(text, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_own") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("_own"), i)), "\n"))
    left = left.withColumn("text", text)
    left = left.filter(F.col("gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
    return left.union(docs.filter(~held))
