"""Spelling variants of frequent words by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point turns one
into the other.  The shorter word (of equal lengths the smaller) contributes two
disjoint chunks, its first and its last half; the other one its grams of that
length at the places within one shift.  One edit touches one chunk at most, so
the other stands in both words.  The half beside a whole chunk has that one edit
too, so it is cut in two chunks in turn: of those one is whole again.  The join
key is a chunk with a chunk of the rest, three quarters of the word, which keeps
frequent beginnings and endings from meeting all of their words.  Every
candidate pair is verified by its edit distance.

Counting from the word's end places the grams behind the edit: a place is
shifted by the difference of the lengths there, and not shifted before it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.runtime import materialize

HELD_WORDS = 1 << 17  # a task sends its partial counts on when it holds so many distinct words
NOISE = 199  # one of so many (document, word) pairs loses a code point


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6,
                noise: int | None = NOISE) -> DataFrame:
    """``(word, n)``: occurrences of words of at least ``least_length`` code points over all documents.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z
    lower-cased.  With ``noise``, a word loses the code point ``h % length`` where
    ``noise`` divides ``h``, the CRC-32 of ``<id>:<word>`` (a null id: nothing
    before the colon).
    """
    run_of = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for key, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                if not text:
                    continue
                # bytes.lower() changes A-Z only.
                found = Counter(m.group() for m in run_of.finditer(text.encode().lower().decode()))
                if noise:
                    begun = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for word in [w for w in found if not zlib.crc32(w.encode(), begun) % noise]:
                        at = zlib.crc32(word.encode(), begun) % len(word)
                        n = found.pop(word)
                        if len(word) > least_length:
                            # Another word of the text may be the same as what is left of this one.
                            held[word[:at] + word[at + 1:]] += n
                held.update(found)
                if len(held) >= HELD_WORDS:
                    yield send()
        yield send()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keys(word: Column, length: Column) -> Column:
    """The four keys of a word as if it had ``length`` code points: a half, and a half of the other half."""
    half = F.floor(length / 2).cast("int")
    quarter = F.floor((length - half) / 2).cast("int")
    size = F.char_length(word)

    def first(n):
        return F.substring(word, F.lit(1), n)

    def last(n):
        return F.substring(word, size - n + 1, n)

    return F.array(F.concat(first(half + quarter), F.lit(" ")), F.concat(first(half), F.lit(" "), last(quarter)),
                   F.concat(first(quarter), F.lit("  "), last(half)), F.concat(F.lit("  "), last(half + quarter)))


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, b)``: all pairs of distinct words with exactly one edit between them, once each.

    ``a`` is the shorter one, of equal lengths the smaller.  Words need two code
    points; null and repeated words are ignored.
    """
    known = words.select("word").filter(F.char_length("word") > 1).distinct()
    size = F.char_length("word")
    chunks = known.select(F.col("word").alias("a"), size.alias("length"), F.explode(_keys(F.col("word"), size)).alias("key"))
    grams = known.select(F.col("word").alias("b"), F.explode(F.array(size, size - 1)).alias("length")).select(
        "b", "length", F.explode(_keys(F.col("b"), F.col("length"))).alias("key"))
    longer = F.char_length("b") > F.col("length")
    found = chunks.join(grams, ["length", "key"]).filter(longer | (F.col("a") < F.col("b")))
    return found.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6,
             least_count: int = 5, ratio: int = 5, noise: int | None = NOISE) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each word of at least ``least_count`` occurrences.

    ``form`` is the near word of largest count (of equal ones the smallest), if it
    occurs at least ``ratio`` times as often; ``root`` is where following the forms
    ends.  Counts grow by ``ratio`` with each step, so there is no circle.

    Null and empty texts have no words; a row without an id counts like any
    other, repeated rows count each time.  A table without words gives no rows.
    Other columns are not read.
    """
    if ratio < 2 or least_length < 2:
        raise ValueError("ratio and least_length must be at least 2")
    words = materialize(word_counts(docs, id_col, text_col, least_length, noise).filter(F.col("n") >= least_count))
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("p")).select("p.*")
    # The best neighbour: largest count, then smallest word.
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"),
                                       F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    fits = -F.col("best.less") >= F.col("n") * ratio
    formed = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))

    # Doubled steps: after t rounds a word knows the word 2^t forms on.
    roots = formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialize(roots.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not roots.filter("moved").limit(1).count():
            break
        roots = roots.select("word", "root")
    return (formed.join(roots.select("word", "root"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
