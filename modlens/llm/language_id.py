"""Language identification by interpolated Kneser-Ney character models.

For each language a model of order 4 over the letters of words (padded at their ends): raw counts at the highest
order, continuation counts (number of different left neighbours) below, each interpolated with the next lower one.
Spark counts n-grams over all learning documents. The interpolated log probabilities and the back-off weights of
contexts are kept in arrays sorted by a 64-bit hash of the n-gram, which tasks search for all distinct words
of a block at once. The language with the lowest cross-entropy per letter is the prediction.

Pruning bounds the model: an n-gram or context with under ``MIN_SHARE`` of a language's counts is left out of the
arrays (at most 1 / MIN_SHARE of each order can stay), and then costs a back-off; counts and discounts come from all.

Calibrated rejection: per language the cross-entropies of all learning documents give a median and a deviation that
narrows with the number of letters; a text that is further off than ``TOLERANCE`` deviations in its best language is
marked ``rejected``. Medians are those of values rounded to 1 / ``GRID``, so that Spark counts a bounded number of them. The contract's lang_pred stays the best language; score is its share against the
other languages and falls with that distance.

Edge cases: null texts and texts without letters are ``und`` with score 0 and rejected; without a learning row
every text is; ties go to the first language in order; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, spread, text_blocks, written

ORDER = 4
MIN_SHARE = 1e-6
TOLERANCE = 6.0
GRID = 10_000
LETTERS = re.compile(r"[^\W\d_]+")
START, END = "\ue000", "\ue001"
# Distinct words that a task counts before it hands the n-grams on, and whose scores a worker remembers.
COUNTED, REMEMBERED = 300_000, 300_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters; fractions, circled numbers and the like are no letters, though they count as word characters."""
    found = LETTERS.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split(" ") if w]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, c): counts of the n-grams of the highest order in documents (text, lang)."""

    def grams(words: dict[str, Counter]) -> pa.RecordBatch:
        rows = []
        for lang, counted in words.items():
            found: Counter = Counter()
            for word, n in counted.items():
                padded = START * (ORDER - 1) + word + END
                for i in range(len(padded) - ORDER + 1):
                    found[padded[i : i + ORDER]] += n
            rows.extend((lang, g, n) for g, n in found.items())
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        kinds = (pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "gram", "c"]
        )

    def run(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        for block in text_blocks(batches):
            get = lambda name: block.column(block.schema.get_field_index(name)).to_pylist()
            for text, lang in zip(get("text"), get("lang"), strict=True):
                words[lang].update(words_of(text))
            if sum(map(len, words.values())) > COUNTED:
                yield grams(words)
                words = defaultdict(Counter)
        yield grams(words)

    counted = spread(docs.select("text", "lang")).mapInArrow(run, "lang string, gram string, c long")
    return counted.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


@dataclass
class Order:
    """One order of one language: sorted hashes with log probabilities, and contexts with log back-off weights."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


@dataclass
class LanguageModels:
    languages: list[str]
    orders: list[list[Order]]  # by language, from order 1 up
    unseen: list[float]  # log probability of an unseen letter


def hashes(codes: np.ndarray, n: int, ends: np.ndarray) -> np.ndarray:
    """Hashes of the n code points that end before each position in ``ends``."""
    h = np.full(len(ends), np.uint64(n), dtype=np.uint64)
    for i in range(n, 0, -1):
        h = h * _STEP + codes[ends - i].astype(np.uint64) + np.uint64(1)
    return mixed(h)


def _hashed(grams: list[str]) -> np.ndarray:
    if not grams:
        return np.zeros(0, np.uint64)
    n = len(grams[0])
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return hashes(codes, n, np.arange(1, len(grams) + 1) * n)


def _sorted(grams: list[str], values: list[float]) -> tuple[np.ndarray, np.ndarray]:
    h = _hashed(grams)
    order = np.argsort(h)
    return h[order], np.array(values, dtype=np.float64)[order]


def levels(counts: DataFrame) -> list[DataFrame]:
    """From order 1 to the highest: (lang, gram, c, total, types, share), pruned; total and types are those of
    the n-gram's context and share is the context's part of the language."""
    tables = [written(counts, "grams")]
    for n in range(ORDER - 1, 0, -1):
        shorter = tables[0].select("lang", F.expr(f"right(gram, {n})").alias("gram"))
        tables.insert(0, written(shorter.groupBy("lang", "gram").agg(F.count("*").alias("c")), "grams"))
    return tables


def collected(table: DataFrame) -> tuple[dict, dict, dict]:
    """Per language: pruned {gram: c}, pruned {context: (total, types)}, and the discount."""
    context = F.expr("left(gram, length(gram) - 1)").alias("context")
    sums = table.groupBy("lang").agg(
        F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")
    ).collect()
    size = {r["lang"]: r["n"] for r in sums}
    discount = {r["lang"]: r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] and r["n2"] else 0.5 for r in sums}
    least = F.lit(0.0)
    for lang, n in size.items():
        least = F.when(F.col("lang") == lang, F.lit(MIN_SHARE * n)).otherwise(least)
    grams, contexts = defaultdict(dict), defaultdict(dict)
    for r in table.where(F.col("c") >= least).collect():
        grams[r["lang"]][r["gram"]] = r["c"]
    around = table.groupBy("lang", context).agg(F.sum("c").alias("c"), F.count("*").alias("types"))
    for r in around.where(F.col("c") >= least).collect():
        contexts[r["lang"]][r["context"]] = (r["c"], r["types"])
    return grams, contexts, discount


def learn_models(docs: DataFrame) -> LanguageModels:
    """Models of all languages among the learning documents (text, lang)."""
    known = docs.where("lang is not null and text is not null")
    per_order = [collected(t) for t in levels(gram_counts(known))]
    languages = sorted(per_order[-1][0])
    models = LanguageModels(languages, [], [])
    for lang in languages:
        orders, lower = [], {}
        letters = len(per_order[0][0][lang]) + 1
        for n, (grams, contexts, discount) in enumerate(per_order, 1):
            d, around, p = discount[lang], contexts[lang], {}
            for g, c in grams[lang].items():
                total, types = around.get(g[:-1], (None, None))
                if total is None:
                    continue
                below = lower.get(g[1:], 1e-7) if n > 1 else 1.0 / letters
                p[g] = max(c - d, 0) / total + d * types / total * below
            gram_list = list(p)
            table = _sorted(gram_list, list(np.log([p[g] for g in gram_list])))
            context_list = list(around)
            weights = [np.log(d * around[x][1] / around[x][0]) for x in context_list]
            back = _sorted(context_list, weights) if n > 1 else (np.zeros(0, np.uint64), np.zeros(0))
            orders.append(Order(*table, *back))
            if n == 1:
                total, types = around[""]
                models.unseen.append(float(np.log(d * types / total / letters)))
            lower = p
        models.orders.append(orders)
    return models


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def word_scores(words: list[str], models: LanguageModels) -> np.ndarray:
    """Log probability of each word in each language, and in the last column its number of symbols."""
    text = "".join(START * (ORDER - 1) + w + END for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.flatnonzero(codes != ord(START)) + 1
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    firsts = np.cumsum(sizes) - sizes
    grams = [hashes(codes, n, ends) for n in range(1, ORDER + 1)]
    contexts = [hashes(codes, n, ends - 1) if n else None for n in range(ORDER)]
    out = np.empty((len(words), len(models.languages) + 1))
    out[:, -1] = sizes
    for k, orders in enumerate(models.orders):
        logp, open_ = np.zeros(len(ends)), np.arange(len(ends))
        for n in range(ORDER, 0, -1):
            table = orders[n - 1]
            at, hit = _find(table.grams, grams[n - 1][open_])
            logp[open_[hit]] += table.logp[at[hit]]
            open_ = open_[~hit]
            if n > 1:
                at, hit = _find(table.contexts, contexts[n - 1][open_])
                logp[open_[hit]] += table.backoff[at[hit]]
        logp[open_] += models.unseen[k]
        out[:, k] = np.add.reduceat(logp, firsts)
    return out


class Scorer:
    """Scores texts, remembering those of words."""

    def __init__(self, models: LanguageModels):
        self.models, self.known = models, {}
        self.table = np.zeros((0, len(models.languages) + 1))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol in each language, and the number of symbols, of each text."""
        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, self.table[:0]
        words = [words_of(t) for t in texts]
        new = list({w for ws in words for w in ws if w not in self.known})
        if new:
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, word_scores(new, self.models)])
        counts = np.array([len(ws) for ws in words])
        sums = np.zeros((len(texts), self.table.shape[1]))
        if counts.sum():
            index = np.fromiter((self.known[w] for ws in words for w in ws), np.int64, int(counts.sum()))
            some = counts > 0
            sums[some] = np.add.reduceat(self.table[index], (np.cumsum(counts) - counts)[some], axis=0)
        symbols = sums[:, -1]
        return -sums[:, :-1] / np.maximum(symbols, 1)[:, None], symbols


def medians(rows: DataFrame, value: Column) -> dict[int, float]:
    """The median of each language, over values rounded to the grid; few of them reach a task."""
    cells = rows.groupBy("own", F.round(value * GRID).cast("long").alias("cell")).agg(F.count("*").alias("c"))
    return {r["own"]: r["m"] / GRID for r in cells.groupBy("own").agg(F.expr("percentile(cell, 0.5D, c) AS m")).collect()}


def _of(values: list, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index)


def _width() -> Column:
    return F.expr("0.02D + 1 / sqrt(greatest(symbols, 1))")


def calibrate(scored: DataFrame, n: int) -> tuple[list[float], list[float]]:
    """Median and scaled deviation of cross-entropy of n languages, from all learning documents with a letter."""
    rows = scored.where("own is not null and symbols > 0")
    centre = medians(rows, F.col("own_entropy"))
    centres = [centre.get(k, 0.0) for k in range(n)]
    off = F.abs(F.col("own_entropy") - _of(centres, F.col("own"))) / _width()
    found = medians(rows, off)
    return centres, [max(found[k] * 1.4826, 0.05) if k in found else 1.0 for k in range(n)]


SCORED = "doc_id long, best int, symbols long, lowest double, share double, own int, own_entropy double"


def language_id(docs: DataFrame, learning: Column) -> DataFrame:
    """doc_id, lang_pred, score, rejected, cross_entropy of every document; learns from the rows for which
    ``learning`` holds."""
    models = learn_models(docs.where(learning))
    if not models.languages:
        return docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(True).alias("rejected"), F.lit(0.0).alias("cross_entropy"),
        )
    place = {lang: k for k, lang in enumerate(models.languages)}

    def run(batches):
        scorer = Scorer(models)
        for block in text_blocks(batches):
            entropy, symbols = scorer.entropies(block.column(1).to_pylist())
            rows = np.arange(len(symbols))
            best = entropy.argmin(1)
            lowest = entropy[rows, best]
            scale = np.minimum(symbols, 200)[:, None]
            share = 1 / np.exp(np.minimum((lowest[:, None] - entropy) * scale, 0)).sum(1)
            own = np.array([place.get(x, -1) for x in block.column(2).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0), pa.array(best, pa.int32()), pa.array(symbols.astype(np.int64)), pa.array(lowest), pa.array(share),
                    pa.array(own, pa.int32(), mask=own < 0), pa.array(entropy[rows, np.maximum(own, 0)], mask=own < 0),
                ],
                [c.split()[0] for c in SCORED.split(", ")],
            )

    # The language of a learning document calibrates; no prediction sees it.
    known = F.when(learning, F.col("lang")).alias("lang")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", known)
    scored = written(spread(slim).mapInArrow(run, SCORED), "entropies")
    centres, spreads = calibrate(scored, len(models.languages))
    off = (F.col("lowest") - _of(centres, F.col("best"))) / _width() / _of(spreads, F.col("best"))
    far, lettered = F.greatest(off - TOLERANCE, F.lit(0.0)), F.col("symbols") > 0
    return scored.select(
        "doc_id", F.when(lettered, _of(models.languages, F.col("best"))).otherwise("und").alias("lang_pred"),
        F.when(lettered, F.col("share") / (1 + far)).otherwise(0.0).alias("score"),
        (~lettered | (far > 0)).alias("rejected"), F.col("lowest").alias("cross_entropy"),
    )
