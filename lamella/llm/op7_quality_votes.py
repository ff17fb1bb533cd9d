"""Quality by weak supervision: rules vote good or bad or abstain, expectation-maximisation weighs them, the posterior decides.

Every rule looks at statistics of the whole text. The votes of a document form a pattern, of which there are at most
3 ** number of rules; the documents are counted per pattern, whatever their number, and the two-class model with one
vote distribution per rule and class is fitted to these counts at the driver. Its posterior per pattern goes back as a small
table. No document is all-must-pass: one bad vote of an unreliable rule is outweighed by good votes.

A null or empty text has no words, all counts 0. Repeated rows get the same verdict. An empty table gives an empty result.
"""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .text import fresh, own_memory

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
OTHER_ASCII = bytes(b for b in range(128) if not chr(b).isalpha())
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper_words long, n_distinct long, n_echo_words long, n_bangs long, n_letter_bytes long, n_word_bytes long"

#: name, bad if, good if (neither: the rule abstains). Most rules know one kind of junk and have nothing to say for a text.
#: The share of distinct words of any text falls as it grows, about with the root of its length: beyond 4000 words so does the limit of "variety".
RULES = (
    ("symbols", "n_symbols > 0.2 * n_words", "FALSE"),
    ("letters", "n_letter_bytes < 0.6 * n_word_bytes", "n_letter_bytes >= 0.92 * n_word_bytes"),
    ("capitals", "n_upper_words > 0.4 * n_words", "FALSE"),
    ("bangs", "n_bangs > 0.15 * n_words", "FALSE"),
    ("repeats", "n_repeat_words > 0.16 * n_words", "FALSE"),
    ("lines", "n_dup_lines > 0.3 * n_lines", "FALSE"),
    ("variety", "n_distinct < 0.2 * least(n_words, sqrt(4000D * n_words)) AND n_words >= 40", "FALSE"),
    ("echo", "n_echo_words > 0.1 * n_words", "FALSE"),
    ("length", "word_chars < 2.5 * n_words OR word_chars > 14 * n_words", "FALSE"),
    ("prose", "FALSE", "n_upper_words <= 0.1 * n_words AND n_symbols <= 0.02 * n_words AND n_bangs <= 0.02 * n_words"),
    ("size", "n_words < 10", "n_words >= 25"),
)


def text_stats(text: str | None) -> tuple[int, ...]:
    """The columns of STATS for one whole text."""
    b = (text or "").encode("utf-8", "surrogatepass")
    ws = b.split()
    n = len(ws)
    bare = b.translate(None, SPACES)
    seen, lines, dup = set(), 0, 0
    for line in b.split(b"\n"):
        if line.strip():  # strips the six separators of words
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    covered = 0
    if n >= 5:
        grams = list(zip(ws, ws[1:], ws[2:], ws[3:], ws[4:], strict=False))
        if len(set(grams)) < len(grams):
            often, to = Counter(grams), 0
            for i, g in enumerate(grams):
                if often[g] > 1:
                    covered += i + 5 - max(i, to)
                    to = i + 5
    letters = len(bare.translate(None, OTHER_ASCII))
    return (n, len(text or "") - (len(b) - len(bare)), len(b) - len(b.translate(None, SYMBOLS)), dup, covered, lines, sum(map(bytes.isupper, ws)), len(set(ws)),
            sum(map(eq, ws, ws[1:])), b.count(b"!"), letters, len(bare))


def _stats(texts: pd.Series) -> pd.DataFrame:
    own_memory("quality")
    return pd.DataFrame([text_stats(t) for t in texts], columns=[f.split(" ")[0] for f in STATS.split(", ")], dtype="int64")


def stats(text: Column) -> Column:
    """Struct of STATS."""
    return F.pandas_udf(_stats, STATS)(text)


def pattern(prefix: str) -> Column:
    """The votes as one number, base 3, a digit per rule: 0 bad, 1 abstained, 2 good."""
    names = [f.split(" ")[0] for f in STATS.split(", ")]
    code = F.lit(0).cast("long")
    s = {n: F.col(f"{prefix}.{n}") for n in names}
    for k, (_, bad, good) in enumerate(RULES):
        vote = F.when(_sql(bad, s, prefix), 0).when(_sql(good, s, prefix), 2).otherwise(1)
        code = code + vote * 3**k
    return code


def _sql(condition: str, names: dict, prefix: str) -> Column:
    for n in sorted(names, key=len, reverse=True):
        condition = condition.replace(n, f"\0{n[::-1]}\0")
    for n in names:
        condition = condition.replace(f"\0{n[::-1]}\0", f"`{prefix}`.`{n}`")
    return F.expr(condition)


@dataclass(frozen=True)
class Votes:
    """Fitted model: prior of good, and for each class, rule and vote its probability."""

    prior: float
    table: np.ndarray  # class (bad, good) x rule x vote (bad, abstained, good)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes 0, 1, 2."""
        rules = np.arange(votes.shape[1])
        logs = np.log(self.table[:, rules, votes]).sum(-1) + np.log([[1 - self.prior], [self.prior]])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def digits(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(RULES)) % 3


def fit(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Votes:
    """Expectation-maximisation over vote patterns and their counts. It starts from the votes cast, a bad one
    counting as two good ones; a small count
    per cell, leaning to a rule being right, keeps rules that never fire and empty tables defined."""
    votes, lean = digits(codes), np.array([[2.0, 1.0, 0.2], [0.2, 1.0, 2.0]])
    bad, good = (votes == 0).sum(1), (votes == 2).sum(1)
    q = (good + 0.5) / (good + 2 * bad + 1) if len(codes) else np.empty(0)
    model = None
    for _ in range(rounds):
        weight = np.stack([(1 - q) * counts, q * counts])
        cells = np.stack([[(weight[c][:, None] * (votes == v)).sum(0) for v in range(3)] for c in range(2)]).transpose(0, 2, 1) + lean[:, None, :]
        model = Votes(float((weight[1].sum() + 2) / (counts.sum() + 3)), cells / cells.sum(-1, keepdims=True))
        new = model.posterior(votes) if len(codes) else q
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return model


def fitted(codes: DataFrame) -> Votes:
    """Count the patterns of all documents (a row per pattern, at most 3 ** rules, to the driver) and fit."""
    rows = codes.groupBy("pattern").count().orderBy("pattern").collect()
    return fit(np.array([r["pattern"] for r in rows], np.int64), np.array([r["count"] for r in rows], float))


def posterior_table(spark, model: Votes, codes: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, model.posterior(digits(codes)), strict=True)], "pattern long, quality double")


def base_failed(prefix: str = "s") -> Column:
    return (F.col(f"{prefix}.n_words") < 10) | (100 * F.col(f"{prefix}.n_repeat_words") > 20 * F.col(f"{prefix}.n_words"))


def keep(docs: DataFrame, least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that pass: base rules hold and the posterior of good is at least `least`. Same columns as `docs`. Reads the texts
    twice, for the fit and for the verdict, and shuffles none."""
    s, p, q = fresh(docs, "stats", "pattern", "posterior")
    coded = docs.withColumn(s, stats(F.col(text).cast("string"))).withColumn(p, pattern(s))
    seen = coded.groupBy(p).count().orderBy(p).collect()  # at most 3 ** rules rows
    codes = np.array([r[0] for r in seen], np.int64)
    model = fit(codes, np.array([r[1] for r in seen], float))
    out = coded.join(F.broadcast(posterior_table(docs.sparkSession, model, codes).toDF(p, q)), p, "left")
    return out.where(~base_failed(s) & (F.col(q) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def verdicts(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The contract's row per document."""
    coded = stored(docs.select("doc_id", stats(F.col("text").cast("string")).alias("s")).withColumn("pattern", pattern("s")))
    model = fitted(coded)
    codes = np.array([r[0] for r in coded.select("pattern").distinct().collect()], np.int64)
    out = coded.join(F.broadcast(posterior_table(docs.sparkSession, model, codes)), "pattern", "left")
    return out.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", base_failed().alias("base_failed"),
                      (~base_failed() & (F.col("quality") >= least)).alias("kept"), F.col("quality").alias("posterior"))
