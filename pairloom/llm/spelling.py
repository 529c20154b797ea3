"""Spelling variants: words counted over all texts, near words found in a trie over letter-group counts, forms followed to their root."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graybits import whole_groups
from .lettertrie import GROUPS, Trie, Words
from .words import mix

LETTERS = r"a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longer texts are cut behind a run of letters, so that no array of words is long.
PIECE = 1 << 16
#: Levels of the trie that words are dealt by at first, and more levels for nodes with more than NODE_WORDS words.
FIRST_LEVELS, MORE_LEVELS = 4, 2
NODE_WORDS = 1 << 14

SEARCH = "node long, word string, n long, spent byte"


def letter_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, run): every maximal run of letters with A-Z lower-cased, repeats included; nothing is shuffled."""
    text = F.translate(F.coalesce(F.col(text_column), F.lit("")), UPPER, LOWER)
    pieces = F.when(F.length("text") > PIECE, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}[{LETTERS}]*"), F.lit(0))).otherwise(F.array("text"))
    cut = docs.select(F.col(id_column).alias("id"), text.alias("text")).select("id", F.explode(pieces).alias("piece"))
    return cut.select("id", F.explode(F.regexp_extract_all("piece", F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))


def misspelt(doc_id: Column, run: Column, one_in: int) -> Column:
    """The run, or for about one in ``one_in`` (by the CRC-32 of ``<id>:<run>``) the run without one of its code points."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(words: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n) for the words of at least ``least_length`` code points that occur ``least_n`` times; counted before they are shuffled."""
    long = words.where(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def _descend(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Take indexed words (spent -1) down to their node at level ``last``, searching words to all nodes that their budget allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                counts = Words(part.column("word").to_numpy(zero_copy_only=False)).counts(first, last).astype(np.int64)
                node = part.column("node").to_numpy(zero_copy_only=False).astype(np.uint64)
                spent = part.column("spent").to_numpy(zero_copy_only=False)
                row = np.arange(len(node))
                for g in range(last - first):
                    own = counts[row, g]
                    ways = [(np.ones(len(row), bool), 0, 0), (spent == 0, 1, 1), ((spent == 1) & (own > 0), -1, 1)]
                    node, row, spent = (np.concatenate(x) for x in zip(*[
                        (mix(node[ok] * np.uint64(0x9E3779B97F4A7C15) + (own[ok] + more + 1).astype(np.uint64)), row[ok], spent[ok] + np.int8(cost)) for ok, more, cost in ways
                    ]))
                taken = part.select(["word", "n"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *taken.columns, pa.array(spent, pa.int8())], ["node", "word", "n", "spent"])

    return rows.mapInArrow(run, SEARCH)


def _searches(words: DataFrame, node_words: int) -> DataFrame:
    """(node, word, n, searches, n_index, n_search): indexed and searching words by trie node, nodes with more than ``node_words`` words split further.

    A node is a hash of the counts on the way to it. Searching words stay only where a node has indexed words. Every word is indexed in
    one node and searches in all that are in its reach; nodes that stay large at the last level are kept as they are.
    """
    done, first, last = None, 0, FIRST_LEVELS
    roots = words.select(F.lit(0).cast("long").alias("node"), "word", "n", F.lit(-1).cast("byte").alias("spent"))
    level = _descend(roots.unionByName(roots.withColumn("spent", F.lit(0).cast("byte"))), 0, last)
    indexed = _descend(roots, 0, last)
    while True:
        sizes = cut_lineage(indexed.groupBy("node").agg(F.count(F.lit(1)).alias("n_index")))
        splits = last < GROUPS and bool(sizes.where(F.col("n_index") > node_words).head(1))
        level = cut_lineage(level.join(sizes, "node"))
        ready = level.where(F.col("n_index") <= node_words) if splits else level
        done = ready if done is None else done.unionByName(ready)
        if not splits:
            return done
        first, last = last, min(last + MORE_LEVELS, GROUPS)
        large = level.where(F.col("n_index") > node_words).select("node", "word", "n", "spent")
        level, indexed = _descend(large, first, last), _descend(large.where("spent = -1"), first, last)


NEAR = "word string, n_near long, near_n long, near string"


def _near_in_part(words: np.ndarray, n: np.ndarray, indexed: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(word, n_near, near_n, near) of the words that have a near pair in this part; a pair counts for both its words."""
    _, first, same = np.unique(words, return_index=True, return_inverse=True)  # numbers follow the code point order
    own = np.flatnonzero(indexed)
    asking = np.flatnonzero(~indexed)
    asking = asking[np.unique(same[asking], return_index=True)[1]]  # a word came here twice only if hashes of nodes collide
    pairs = list(Trie(words[own]).pairs(words[asking])) if len(own) and len(asking) else []
    a = np.concatenate([same[asking[x]] for x, _ in pairs]) if pairs else np.zeros(0, np.int64)
    if not len(a):
        return None
    b = np.concatenate([same[own[x]] for _, x in pairs])
    n = n[first]
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort([other, -n[other], one])
    one, other = one[order], other[order]
    starts = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
    return words[first[one[starts]]], np.diff(np.append(starts, len(one))), n[other[starts]], words[first[other[starts]]]


def _near_in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of (part, word, n, indexed) in the order of parts: what ``_near_in_part`` finds in each part."""
    for batch in whole_groups(batches, "part"):
        part = batch.column("part").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("word", "n", "indexed")]
        for low, high in zip(cuts[:-1], cuts[1:]):
            found = _near_in_part(*(c[low:high] for c in columns))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1]), pa.array(found[2]), pa.array(found[3], pa.string())], ["word", "n_near", "near_n", "near"])


def near_words(words: DataFrame, node_words: int = NODE_WORDS) -> DataFrame:
    """(word, n_near, near_n, near) for the words of (word, n) with a near word: how many, and the one of largest n (ties: smallest in code point order).

    Two words are near if one inserted, deleted or replaced code point makes one of the other. The upper levels of the trie deal the
    words out, see ``_searches``: a task holds the at most ``node_words`` words of a node and a part of the words that
    search there, and goes on in a trie of its own down to the leaves, whose words are verified. A leaf with more words is dealt out
    in parts, each searched by all. Counts and best words are merged before they are shuffled.
    """
    rows = _searches(words, node_words)
    asked = rows.where("spent >= 0").groupBy("node").agg(F.count(F.lit(1)).alias("n_search"))
    searching = rows.where("spent >= 0").select("node", "word", "n", "n_index")
    index = rows.where("spent = -1").select("node", "word", "n", "n_index")
    blocks = F.ceil(F.col("n_index") / node_words).cast("int")
    runs = F.ceil(F.col("n_search") / (4 * node_words)).cast("int")
    turn = F.xxhash64("word")
    some = lambda many: F.explode(F.sequence(F.lit(0), many - 1))
    left = searching.join(asked, "node").withColumn("run", F.pmod(turn, runs).cast("int")).withColumn("block", some(blocks)).withColumn("indexed", F.lit(False))
    right = index.join(asked, "node").withColumn("block", F.pmod(turn, blocks).cast("int")).withColumn("run", some(runs)).withColumn("indexed", F.lit(True))
    dealt = left.unionByName(right).select(F.xxhash64("node", "run", "block").alias("part"), "word", "n", "indexed")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_near_in_parts, NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return merged.select("word", "n_near", (-F.col("best.minus")).alias("near_n"), "best.near")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) without cycles, one a word: the last word on the way; the way known doubles every round."""
    open_ = cut_lineage(links.select("word", F.col("form").alias("root")))
    ends = None
    while True:
        onward = open_.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = cut_lineage(open_.join(onward, open_["root"] == onward["_word"], "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        if not step.where("moved").head(1):
            return step.select("word", "root")
        open_ = step.select("word", "root")


def variants(words: DataFrame, ratio: int = 2, node_words: int = NODE_WORDS) -> DataFrame:
    """(word, n, form, form_n, n_near, root) for every word of (word, n), words being different.

    The form of a word is its near word of largest n (ties: smallest in code point order) if that n is at least ``ratio`` times
    its own, else null. As n grows along forms, following them ends; the root is the last word, a word without a form its own.
    An empty table gives no rows; words of any length and any code points do.
    """
    if ratio < 2:
        raise ValueError("forms end only if n grows along them")
    words = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(words, node_words)
    is_form = F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False))
    formed = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")))
    followed = roots(formed.where("form IS NOT NULL"))
    return formed.join(followed, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, one_in: int = 97, least_length: int = 5, least_n: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Spelling variants among the words of all texts: (word, n, form, form_n, n_near, root).

    Words are maximal runs of Latin letters with A-Z lower-cased; one in ``one_in`` of the different runs of a document is
    misspelt by one lost code point, the same one wherever it stands in the document. Null and empty texts have no words; a null
    id reads as no characters; repeated rows count as often as they come; very long texts are read in pieces; other columns are not read.
    """
    runs = letter_runs(docs, id_column, text_column).where(F.length("run") >= least_length)
    spelt = runs.select(misspelt(F.col("id"), F.col("run"), one_in).alias("word"))
    return variants(word_counts(spelt, least_length, least_n))
