"""Grouping spelling variants with a variable-length gram index.

vocabulary() counts the words of all texts. dictionary() counts their grams level by level: bigrams first, and longer grams only
where the gram before their last letter is frequent (more than 1/EXTEND of all positions), so frequent grams become longer and
more selective, and no level holds more than EXTEND times the alphabet (90 letters): the dictionary is bounded whatever the vocabulary is.
A word is decomposed into variable grams: at each position the longest gram of the dictionary (else two letters), without those
that lie inside one before them.

A change at one place can only affect grams near it. Split a word there into what is left and right of the place; of the left part
those grams are safe that start before the first position from which some gram of the dictionary could reach over the place
(`_safe_left`), of the right part those that end behind all that a gram from over the place could cover (`_safe_right`). What is safe
depends on the parts alone, so two words that differ by one change have, for the place of that change, exactly the same safe grams at the
same distances from their ends; their number is the word's grams less the affected ones. near_pairs() therefore merges, for every
place of every word, the lists of all safe grams at once: words that stand in the same lists for some place meet (a join on the
fingerprint of those lists), and only pairs whose edit distance is one leave the join. Words of 2 * QMAX letters and more keep a safe
gram at every place; shorter ones are found as well, their lists are longer only.

A word's form is its near word of largest count, if that is `factor` times its own or more; forms are followed to the last (root). Counts
grow by the factor at each step, so few rounds of pointer jumping end it.

A null text has no words; a null key counts as an empty one where a word is damaged. Repeated rows count each; an empty table
gives an empty result. Other columns are not read.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

QMIN, QMAX, EXTEND = 2, 3, 512
#: Words a task counts before it passes its counts on.
HELD = 200_000
LETTERS = "a-zÀ-ÿ"


def damaged(key, run: str, modulus: int = 199) -> str:
    """A planted spelling error: one letter less where the checksum of key and run is a multiple of `modulus`."""
    h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
    return run if h % modulus else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counted(batches, least: int, modulus: int):
    runs, held = re.compile(f"[{LETTERS}]{{{max(1, least)},}}"), Counter()

    def flushed():
        out = pd.DataFrame({"word": pd.Series(list(held.keys()), dtype="str"), "n": pd.Series(list(held.values()), dtype="int64")})
        held.clear()
        return out

    for batch in batches:
        for key, text in zip(batch["key"], batch["text"], strict=True):
            if not text:
                continue
            base = zlib.crc32(f"{'' if key is None else key}:".encode())
            for run, n in Counter(runs.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                if modulus:
                    h = zlib.crc32(run.encode(), base)
                    if h % modulus == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                        if len(run) < least:
                            continue
                held[run] += n
            if len(held) > HELD:
                yield flushed()
    yield flushed()


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, occurrences: int = 5, modulus: int = 0) -> DataFrame:
    """word, n: words of at least `least` letters (runs of A-Z and U+00C0 to U+00FF, A-Z lower-cased) that occur at least `occurrences` times.
    A modulus above 0 plants errors, see damaged()."""
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    counts = rows.mapInPandas(partial(_counted, least=least, modulus=modulus), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def dictionary(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, extend: int = EXTEND) -> set[str]:
    """Grams of more than `qmin` letters; bounded by (qmax - qmin) * extend * size of the alphabet."""
    grams: set[str] = set()
    parents = None
    for q in range(qmin, qmax):
        starts = F.sequence(F.lit(1), F.length("word") - q)
        pieces = words.where(F.length("word") > q).select(F.explode(F.transform(starts, lambda p: F.substring("word", p, F.lit(q + 1)))).alias("gram"))
        pieces = pieces.withColumn("parent", F.substring("gram", 1, q))
        if parents is not None:
            pieces = pieces.where(F.col("parent").isin(sorted(parents)))
        counts = stored(pieces.groupBy("parent", "gram").agg(F.count(F.lit(1)).alias("n")))
        total = counts.agg(F.sum("n")).first()[0] or 0
        often = counts.groupBy("parent").agg(F.sum("n").alias("n")).where(F.col("n") * extend > total).select("parent")
        new = {r.gram for r in counts.join(often, "parent", "left_semi").select("gram").collect()}  # at most `extend` parents, a letter more each
        grams |= new
        parents = new
        if not new:
            break
    return grams


class Grams:
    """Decomposition of words by a dictionary, and what a change at a place leaves safe."""

    def __init__(self, grams: set[str], qmin: int = QMIN, qmax: int = QMAX):
        self.grams, self.qmin, self.qmax = grams, qmin, qmax
        self.heads = {g[:k] for g in grams for k in range(1, len(g))}
        self.tails = {g[k:] for g in grams for k in range(1, len(g))}

    def spans(self, word: str) -> list[tuple[int, int]]:
        """(start, end) of the word's variable grams; starts and ends both rise."""
        out, reached = [], 0
        for p in range(len(word) - self.qmin + 1):
            end = p + self.qmin
            for q in range(min(self.qmax, len(word) - p), self.qmin, -1):
                if word[p : p + q] in self.grams:
                    end = p + q
                    break
            if end > reached:
                out.append((p, end))
                reached = end
        return out

    def _safe_left(self, left: str) -> int:
        """First start in `left` from which a gram could reach over its end."""
        n = len(left)
        for p in range(max(0, n - self.qmax + 1), n):
            if n - p < self.qmin or left[p:] in self.heads:
                return p
        return n

    def _safe_right(self, right: str) -> int:
        """How much of `right` a gram that starts before it could cover."""
        for k in range(min(self.qmax - 1, len(right)), 0, -1):
            if right[:k] in self.tails:
                return k
        return 0

    def safe(self, word: str) -> list[tuple[int, list[tuple[int, int]], list[tuple[int, int]]]]:
        """For every place, a letter or a gap: length of the word without it, safe spans on its left and on its right."""
        spans, n = self.spans(word), len(word)
        first = [self._safe_left(word[:i]) for i in range(n + 1)]
        behind = [j + self._safe_right(word[j:]) for j in range(n + 1)]
        out = []
        for i in range(n + 1):
            for j in (i, i + 1):  # the gap before letter i, then letter i
                if j <= n:
                    out.append((n - (j - i), [s for s in spans if s[0] < first[i]], [s for s in spans if s[0] >= j and s[1] > behind[j]]))
        return out

    def affected(self, word: str) -> int:
        """The most grams that one change can affect."""
        return len(self.spans(word)) - min(len(a) + len(b) for _, a, b in self.safe(word))

    def lists(self, word: str) -> set[int]:
        """Fingerprint of the lists that are merged, for each place (as signed 64-bit numbers)."""
        spans, n = self.spans(word), len(word)
        heads = [*accumulate((f"{p} {word[p:e]}," for p, e in spans), initial="")]
        tails = [*accumulate((f"{n - e} {word[p:e]}," for p, e in reversed(spans)), initial="")]
        keys = {(m, len(left), len(right)) for m, left, right in self.safe(word)}
        return {xxhash.xxh3_64_intdigest(f"{m}|{heads[a]}|{tails[b]}".encode()) - (1 << 63) for m, a, b in keys}


def near_pairs(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, extend: int = EXTEND) -> DataFrame:
    """a, b of all pairs of `words` (column word) that differ by one letter inserted, deleted or replaced, a < b."""
    index = Grams(dictionary(words, qmin, qmax, extend), qmin, qmax)

    def listed(batches):
        for batch in batches:
            keys = [index.lists(w) for w in batch["word"]]
            yield pd.DataFrame({"word": batch["word"].repeat([len(k) for k in keys]).array, "list": pd.Series([x for k in keys for x in k], dtype="int64")})

    lists = stored(words.select("word").mapInPandas(listed, "word string, list long"))
    met = lists.select("list", F.col("word").alias("a")).join(lists.select("list", F.col("word").alias("b")), "list")
    return met.where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root for each row of `words` (word, n; words are distinct)."""
    words = stored(words.select("word", "n"))
    pairs = near_pairs(words)
    both = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(words.withColumnRenamed("word", "b"), "b"))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), "b")).alias("best"))
    out = words.join(near, "word", "left")
    strong = -F.col("best.minus") >= factor * F.col("n")
    out = stored(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.b")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n")))
    links = stored(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return out.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def groups(docs: DataFrame, modulus: int = 199) -> DataFrame:
    """Variants of the words of `documents`, with planted errors."""
    return variants(vocabulary(docs, modulus=modulus))
