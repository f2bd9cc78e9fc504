"""Removal of repeated line runs across a corpus, in DataFrame operations only.

The corpus is a sequence of line ids per document, and its suffixes are ranked by distributed prefix doubling: line ids
(64-bit hashes) are the ranks by one line; the rank by 2m lines is the place of the pair (rank by the first m, rank by the
next m) among the sorted distinct pairs of the corpus. Suffixes of equal rank by m lines are an interval of the suffix
array whose longest common prefix is at least m lines; an interval of one suffix is no repetition and is dropped. A run of
L lines is the interval of the two ranks by 2^j lines, j = floor(log2 L), at its beginning and at its end.

A run counts as repeated from ``min_words`` words on. A maximal repeated run of so many words is covered by the shortest
runs of at least ``min_words`` words that begin or end at one of its lines, so that only these have to be looked up: one
interval each way per line, found in one pass over each document, and no suffix has to be ranked by more lines. All copies
of such a run but the first (by doc_id, text hash, line) are deleted, and blank lines between two deleted lines.

Copies may overlap, as in a document that repeats a line over and over: each but the first is a later copy, and all its lines go, also those that it
shares with the first; of ten equal lines of five words one is left. Lines are cut at line feeds and named by 64-bit hashes, and a run is repeated only if the names of all its
lines are, so that two different lines of equal hash matter only where whole runs of ``min_words`` words agree around them. Blank lines don't count as lines of a run. Null and empty texts are
returned as they are. A document of which only blank lines remain is reported as emptied. Rows that repeat in id and text
share their fate. Null ids come first in the order. Runs are compared by their ranks, number of lines and of words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampwise.llm.common import column, written

#: A run of fewer words is left alone.
MIN_WORDS = 25


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, k, line, f0, words, before, through) of every line that isn't blank, once per (id, text).

    ``k`` counts these lines, ``line`` all lines; ``before`` and ``through`` are the words of the document before the line and with it.
    """
    line = F.transform(F.split(column(text_col), "\n", -1), lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("name"), F.size(F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " ")).alias("words"), (F.length(F.trim(x)) > 0).alias("some")))
    own = docs.filter(F.length(column(text_col)) > 0).select(column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("hash"), F.filter(line, lambda x: x["some"]).alias("lines"))
    once = own.groupBy("id", "hash").agg(F.first("lines").alias("lines"))
    got = once.select("id", "hash", F.posexplode("lines").alias("k", "l")).select("id", "hash", F.col("k").cast("long").alias("k"), "l.line", F.col("l.name").alias("f0"), F.greatest(F.col("l.words"), F.lit(1)).alias("words"))
    through = F.sum("words").over(Window.partitionBy("id", "hash").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return got.withColumn("through", through).withColumn("before", F.col("through") - F.col("words"))


def ranks(lines: DataFrame, min_words: int) -> list[DataFrame]:
    """(id, hash, k, f) for 2, 4, 8, ... lines: the rank ``f`` of the suffix that begins at line ``k`` by so many lines.

    One round of prefix doubling for each: the rank of 2m lines is the place of (rank of the first m, rank of the next m)
    among all such pairs of the corpus in order. Only suffixes that share their rank with another one keep it, and only
    those that a run of ``min_words`` words can need: without their first or their last line they have fewer words.
    """
    doc = Window.partitionBy("id", "hash").orderBy("k")
    level = lines.select("id", "hash", "k", F.col("f0").alias("f"), "before", "through", F.col("before").alias("last_before"), F.col("through").alias("last_through"))
    out = []
    for j in range(min_words.bit_length() - 1):
        after = F.first(F.struct("f", "last_before", "last_through")).over(doc.rangeBetween(1 << j, 1 << j))
        pairs = level.withColumn("next", after).filter("next is not null")
        needed = (F.col("next.last_before") - F.col("before") < min_words) | (F.col("next.last_through") - F.col("through") < min_words)
        pairs = written(pairs.filter(needed).select("id", "hash", "k", F.col("f").alias("r"), F.col("next.f").alias("s"), "before", "through", "next.last_before", "next.last_through"), f"pairs-{j}")
        order = pairs.groupBy("r", "s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("r", "s")
        order = written(order.select("r", "s", F.monotonically_increasing_id().alias("f")), f"ranks-{j}")
        level = written(pairs.join(order.hint("merge"), ["r", "s"]).select("id", "hash", "k", "f", "before", "through", "last_before", "last_through"), f"level-{j}")
        if not level.head(1):
            break
        out.append(level.select("id", "hash", "k", "f"))
    return out


def _runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(id, hash, start, stop, after, a, b, n, words): the shortest runs of at least ``min_words`` words from each line on, and back from it, whose ranks others share; the next line after it."""
    shared = ranks(lines, min_words)
    levels = 1 + len(shared)
    own = ["line", "words", "before", "through", "f0"]
    rows = lines.select("id", "hash", "k", *own)
    for j, level in enumerate(shared, 1):
        rows = rows.unionByName(level.withColumnRenamed("f", f"f{j}"), allowMissingColumns=True)
    if shared:
        rows = rows.repartition("id", "hash").groupBy("id", "hash", "k").agg(*(F.max(c).alias(c) for c in own), *(F.max(f"f{j}").alias(f"f{j}") for j in range(1, levels)))
    doc = Window.partitionBy("id", "hash")
    by = doc.orderBy("before")
    begin = F.array(*(f"f{j}" for j in range(levels)))
    end = F.array("f0", *(F.lag(f"f{j}", (1 << j) - 1).over(by) for j in range(1, levels)))
    ahead = by.rangeBetween(0, min_words - 1)
    back = doc.orderBy("through").rangeBetween(1 - min_words, 0)
    after = F.coalesce(F.lead("line").over(by), F.col("line") + 1).alias("after")
    got = rows.select("id", "hash", "line", "words", "before", "through", after, begin.alias("begin"), end.alias("end"))
    got = got.select("*", F.count(F.lit(1)).over(ahead).alias("n1"), F.last(F.struct("line", "after", "through", "end")).over(ahead).alias("to"))
    got = got.select("*", F.count(F.lit(1)).over(back).alias("n2"), F.first(F.struct("line", "before", "begin")).over(back).alias("from"))
    level = lambda n: F.floor(F.log2(F.col(n).cast("double")) + F.lit(1e-9)).cast("int")
    forth = F.struct(F.col("line").alias("start"), F.col("to.line").alias("stop"), F.col("to.after").alias("after"), F.get("begin", level("n1")).alias("a"), F.get("to.end", level("n1")).alias("b"), F.col("n1").alias("n"), (F.col("to.through") - F.col("before")).alias("words"))
    hence = F.struct(F.col("from.line").alias("start"), F.col("line").alias("stop"), F.col("after").alias("after"), F.get("from.begin", level("n2")).alias("a"), F.get("end", level("n2")).alias("b"), F.col("n2").alias("n"), (F.col("through") - F.col("from.before")).alias("words"))
    both = got.select("id", "hash", F.explode(F.array_distinct(F.array(forth, hence))).alias("r")).select("id", "hash", "r.*")
    return both.filter((F.col("words") >= min_words) & F.col("a").isNotNull() & F.col("b").isNotNull())


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, lines): the numbers of the lines of each document that belong to a later copy of a repeated run."""
    runs = _runs(_lines(docs, id_col, text_col), min_words)
    key = ["a", "b", "n", "words"]
    place = F.struct("id", "hash", "start")
    runs = runs.withColumn("place", place)
    first = runs.groupBy(*key).agg(F.min("place").alias("first"), F.max("place").alias("other")).filter(F.col("first") < F.col("other")).drop("other")
    later = runs.join(first.hint("merge"), key).filter(F.col("first") < F.col("place"))  # merged at every size: the plan is the same
    gone = F.transform(F.sequence("start", "stop"), lambda i: F.struct(i.alias("line"), F.when(i == F.col("stop"), F.col("after")).otherwise(i + 1).alias("after")))
    lines = later.select("id", "hash", F.explode(gone).alias("l")).repartition("id", "hash").groupBy("id", "hash", "l.line").agg(F.max("l.after").alias("after"))
    follows = F.lead("line").over(Window.partitionBy("id", "hash").orderBy("line")) == F.col("after")
    lines = lines.select("id", "hash", F.when(follows, F.sequence("line", F.col("after") - 1)).otherwise(F.array("line")).alias("lines"))
    return lines.groupBy("id", "hash").agg(F.flatten(F.collect_list("lines")).alias("lines"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", info: str = "line_dedup") -> DataFrame:
    """``docs`` with later copies taken out of the text, and a struct ``info``, which replaces a column of that name: n_lines, n_removed, emptied.

    The other columns, of any name, are carried along in a struct.
    """
    rest = [column(c) for c in docs.columns if c != text_col]
    base = docs.select(F.struct(*rest, F.lit(0).alias("none")).alias("row"), column(id_col).alias("id"), column(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    lost = written(later_copies(base.select("id", "text"), min_words, "id", "text"), "line-dedup").toDF("lost_id", "lost_hash", "lost")
    got = base.join(lost.hint("merge"), F.col("lost_id").eqNullSafe(F.col("id")) & (F.col("lost_hash") == F.col("hash")), "left").select("row", "text", "lost", F.split("text", "\n", -1).alias("all"))
    count = F.when(F.length("text") > 0, F.size("all")).otherwise(F.lit(0)).cast("long")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("lost")), lambda i: F.get("all", i))
    text = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    got = got.select("row", text.alias("text"), count.alias("n"), F.greatest(F.coalesce(F.size("lost"), F.lit(0)), F.lit(0)).cast("long").alias("removed"))
    done = F.struct(F.col("n").alias("n_lines"), F.col("removed").alias("n_removed"), ((F.col("removed") > 0) & (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) == 0)).alias("emptied"))
    own = (F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c.lower() != info.lower())
    return got.select(*own, done.alias(info))
