"""Text quality statistics of documents, and what is not running prose.

A document is cut into runs of lines that are laid out alike. Every run, and the
document as a whole, is measured by the same statistics. The mean and covariance of
prose are fitted robustly for each language over all runs, and the squared Mahalanobis
distance to them, split into what each statistic adds, decides: a run is prose if
the distance lies within a quantile of chi-squared, and if not, it is what
the statistics that add most to the distance speak for, junk, list or table. No other rule takes part.

Shares of few words say little, so deviations of statistics that are counted in
words (or in trigrams) shrink by n / (n + k). The fit starts from medians and absolute deviations over documents and
is reweighted, with the runs within the bound of the last distance, until the means stand still. A language's fit
is drawn to that of all languages by the weight of ``PRIOR_RUNS`` runs. A text in no known
language is held against the language to whose prose it is nearest. Only sums, a few
hundred numbers for each language, return to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shapes import COUNTS, count_runs, word_digest
from tidemark.session import Scratch

STATISTICS = (
    "common", "word_length", "segment_words", "short_items", "symbols", "numbers", "odd", "item_marks",
    "cells", "labels", "closed_lines", "loops", "vowels", "token_length", "mixed",
)
# Least standard deviation of each statistic, so that one which prose never shows does not make the covariance singular.
FLOOR = np.array([0.05, 0.3, 0.2, 0.08, 0.03, 0.05, 0.01, 0.03, 0.03, 0.05, 0.2, 0.04, 0.03, 0.12, 0.025])
# The 0.99 quantile of chi-squared with fifteen degrees of freedom.
OUTLIER = 30.58
# Words, or trigrams, at which half of a deviation counts.
HALF_WORDS, HALF_TRIGRAMS = 3, 10
_BY_WORDS = np.isin(STATISTICS, ("common", "word_length", "segment_words", "short_items", "vowels"))
_BY_TRIGRAMS = np.isin(STATISTICS, ("loops",))
PRIOR_RUNS = 50
MOST_ROUNDS = 25
# A text with a smaller share of a language's function words is in none that is known.
LEAST_COMMON = 0.1
MOST_WORDS = 100_000
# Characters that are laid out at once.
STRETCH = 1_000_000

KINDS = ("junk", "list", "table")
# What a statistic above, or below, its mean speaks for; closed lines speak for nothing.
ABOVE = {"segment_words": 0, "symbols": 0, "odd": 0, "loops": 0, "vowels": 0, "token_length": 0, "mixed": 0, "word_length": 0, "short_items": 1, "item_marks": 1, "numbers": 2, "cells": 2, "labels": 2}
BELOW = {"common": 0, "word_length": 0, "vowels": 0, "token_length": 0, "segment_words": 1}


def statistics(counts: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """The statistics, in the order of ``STATISTICS``, of rows of counts with their number of function words."""
    c = {name: counts[:, k].astype(float) for k, name in enumerate(COUNTS)}
    share = lambda part, whole: part / np.maximum(whole, 1)
    return np.stack([
        share(hits, c["words"]), share(c["letters"], c["words"]), np.log1p(share(c["words_in_words"], c["words"])), share(c["words_in_short"], c["words"]),
        share(c["symbols"], c["chars"]), share(c["numbers"], c["tokens"]), share(c["odd"], c["chars"]), share(c["marked"], c["tokens"]),
        share(c["cells"], c["tokens"] + c["cells"]), share(c["labels"], c["lines"]), share(c["closed"], c["lines"]), share(c["loops"], c["trigrams"]),
        share(c["vowels"], c["letters"]), np.log1p(share(c["chars"], c["tokens"])), share(c["mixed"], c["tokens"]),
    ], 1)


def _shrink(words: np.ndarray, trigrams: np.ndarray) -> np.ndarray:
    """The part of each deviation that counts."""
    by_words, by_trigrams = (words / (words + HALF_WORDS))[:, None], (trigrams / (trigrams + HALF_TRIGRAMS))[:, None]
    return np.where(_BY_WORDS, by_words, np.where(_BY_TRIGRAMS, by_trigrams, 1.0))


@lru_cache(maxsize=8)
def _vocabulary(pairs: tuple[tuple[str, str], ...]) -> tuple[tuple[str, ...], np.ndarray, np.ndarray]:
    langs = tuple(sorted({lang for lang, _ in pairs}))
    of: dict[int, set[str]] = {}
    for lang, word in pairs:
        of.setdefault(word_digest(word), set()).add(lang)
    known = np.array(sorted(of), np.uint64)
    return langs, known, np.array([[lang in of[int(k)] for lang in langs] for k in known], float).reshape(len(known), len(langs))


def measure(texts: list[str], pairs: tuple[tuple[str, str], ...]) -> dict[str, np.ndarray]:
    """Arrays over texts (``guess, chars, words, trigrams, closed, whole``) and over their runs (``of``, ``run_*``)."""
    langs, known, languages = _vocabulary(pairs)
    parts, at = [], 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) < STRETCH):
            held += len(texts[to])
            to += 1
        of, counts, hits = count_runs(texts[at:to], (known, languages))
        parts.append((of.astype(np.int64) + at, counts, hits))
        at = to
    of, counts, hits = (np.concatenate([p[k] for p in parts]) for k in range(3)) if parts else (np.zeros(0, np.int64), np.zeros((0, len(COUNTS))), np.zeros((0, len(langs))))
    n = len(texts)
    summed = lambda v: np.stack([np.bincount(of, weights=v[:, k], minlength=n) for k in range(v.shape[1])], 1) if v.shape[1] else np.zeros((n, 0))
    whole, whole_hits = summed(counts), summed(hits)
    words = whole[:, COUNTS.index("words")]
    best = whole_hits.argmax(1) if langs else np.zeros(n, int)
    most = whole_hits.max(1) if langs else np.zeros(n)
    sure = most > LEAST_COMMON * words
    own = np.where(sure[of], hits[np.arange(len(of)), best[of]], hits.max(1)) if langs else np.zeros(len(of))
    column = lambda name, c: c[:, COUNTS.index(name)]
    return {
        "guess": np.where(sure, np.array([*langs, "und"], object)[best], "und"), "chars": column("chars", whole), "words": words,
        "trigrams": column("trigrams", whole), "whole": statistics(whole, most), "of": of, "run_chars": column("chars", counts), "run_words": column("words", counts),
        "run_trigrams": column("trigrams", counts), "run_stats": statistics(counts, own),
    }


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


_UNITS = "guess string, chars bigint, words bigint, trigrams bigint, whole array<double>, run_chars array<double>, run_words array<double>, run_trigrams array<double>, run_stats array<double>"


def measured(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, guess`` and the statistics of the whole and of its runs, flat.

    Null texts and texts without visible characters have 0 ``chars`` and no run.
    """
    pairs = common_words.select("lang", F.lower("word").alias("word")).where(F.col("lang").isNotNull() & F.col("word").isNotNull()).distinct().limit(MOST_WORDS + 1).collect()
    if len(pairs) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words cannot be handed to every task")
    key = tuple(sorted((r.lang, r.word) for r in pairs))
    p = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            m = measure(texts, key)
            runs = np.bincount(m["of"], minlength=len(texts))
            columns = {
                "doc_id": batch.column("doc_id"), "guess": pa.array(m["guess"], pa.string()),
                **{c: pa.array(m[c].astype(np.int64)) for c in ("chars", "words", "trigrams")}, "whole": _lists(m["whole"].ravel(), np.full(len(texts), p)),
                **{c: _lists(m[c].astype(float), runs) for c in ("run_chars", "run_words", "run_trigrams")}, "run_stats": _lists(m["run_stats"].ravel(), runs * p),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, {_UNITS}")


class Prose:
    """The fitted mean and inverse covariance of each language's prose."""

    def __init__(self, fits: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(fits)
        self.fits = fits

    def contributions(self, lang: str, v: np.ndarray, shrink: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each statistic adds to the squared distance of each row, and its deviation; the sum is the distance."""
        mean, inverse = self.fits[lang]
        z = (v - mean) * shrink
        return z * (z @ inverse), z


def _kinds(parts: np.ndarray, z: np.ndarray) -> np.ndarray:
    """0 junk, 1 list, 2 table or 3 prose of each run: by what adds most to the distance, if that is an outlier."""
    votes = np.zeros((len(parts), len(KINDS)))
    for k, name in enumerate(STATISTICS):
        for side, kinds in ((z[:, k] > 0, ABOVE), (z[:, k] < 0, BELOW)):
            if name in kinds:
                votes[:, kinds[name]] += np.where(side, parts[:, k], 0.0)
    return np.where(parts.sum(1) > OUTLIER, votes.argmax(1), 3)


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, characters, statistics and shrinkage of each run of a batch of units."""
    flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
    sizes = batch.column("run_chars").value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(batch.num_rows), sizes), flat("run_chars"), flat("run_stats").reshape(-1, len(STATISTICS)), _shrink(flat("run_words"), flat("run_trigrams"))


def _start(units: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Medians and absolute deviations over the documents of each language, and of all (``any``)."""
    at = F.array(*(F.percentile_approx(F.col("whole")[k], [0.25, 0.5, 0.75], 10000) for k in range(len(STATISTICS))))
    known = units.where(F.col("guess") != "und").select(F.explode(F.array("guess", F.lit("any"))).alias("lang"), "whole")
    fits = {}
    for r in known.groupBy("lang").agg(at.alias("q")).collect():
        q = np.array(r.q, float)
        spread = np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOOR)
        fits[r.lang] = (q[:, 1], np.diag(1 / spread**2))
    return fits


def fit(units: DataFrame) -> Prose | None:
    """Fit prose over all runs of documents in a known language, weighted by their characters; None if there are none."""
    known = units.where(F.col("guess") != "und").select("guess", "run_chars", "run_words", "run_trigrams", "run_stats")
    prose, p = Prose(_start(units)), len(STATISTICS)
    if not prose.fits:
        return None
    for _ in range(MOST_ROUNDS):

        def sums(batches: Iterator[pa.RecordBatch], prose: Prose = prose) -> Iterator[pa.RecordBatch]:
            totals: dict[str, np.ndarray] = {}
            for batch in batches:
                of, chars, v, shrink = _runs(batch)
                guess = np.array(batch.column("guess").to_pylist(), object)[of]
                for lang in prose.langs:
                    own = np.ones(len(of), bool) if lang == "any" else guess == lang
                    near = own.copy()
                    near[own] = prose.contributions(lang, v[own], shrink[own])[0].sum(1) <= OUTLIER
                    x, w = v[near], chars[near]
                    found = np.concatenate([[len(x), w.sum()], w @ x, ((x * w[:, None]).T @ x).ravel()])
                    totals[lang] = totals.get(lang, 0) + found
            if totals:
                yield pa.RecordBatch.from_arrays([pa.array(list(totals)), _lists(np.concatenate(list(totals.values())), np.full(len(totals), 2 + p + p * p))], ["lang", "sums"])

        parts = known.mapInArrow(sums, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("at", "x"))
        totals = {lang: np.zeros(2 + p + p * p) for lang in prose.langs}
        for r in parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).collect():
            totals[r.lang][r.at] = r.x
        means, spreads, runs = {}, {}, {}
        for lang, t in totals.items():
            if t[1] > 0:
                means[lang], runs[lang] = t[2 : 2 + p] / t[1], t[0]
                spreads[lang] = t[2 + p :].reshape(p, p) / t[1] - np.outer(means[lang], means[lang])
        fits = dict(prose.fits)
        for lang in means:
            own, drawn = runs[lang], PRIOR_RUNS if lang != "any" and "any" in means else 0
            mixed = lambda a, lang=lang, own=own, drawn=drawn: (own * a[lang] + drawn * a.get("any", 0)) / (own + drawn)
            fits[lang] = (mixed(means), np.linalg.inv(mixed(spreads) + np.diag(FLOOR**2)))
        moved = max(float(np.max(np.abs(fits[x][0] - prose.fits[x][0]) / FLOOR)) for x in fits)
        prose = Prose(fits)
        if moved < 1e-3:
            break
    return prose


_JUDGED = "lang_guess string, chars bigint, words bigint, prose_share double, kind string, distance double, statistics array<double>, contributions array<double>"


def judge(units: DataFrame, prose: Prose | None) -> DataFrame:
    """``doc_id, lang_guess, chars, words, prose_share, kind, distance`` and the statistics and their contributions as arrays.

    ``kind`` is null for prose. A document is not prose if runs that are not hold more than half of its visible
    characters, and has the kind that holds most of those, ties in the order junk, list,
    table. Texts without visible characters have 0 of them and no kind. ``lang_guess`` is ``und`` for a text in no known
    language. Where no document is in a known language there is no prose to compare with, and no kind and no distance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(STATISTICS)
        for batch in batches:
            n, guess = batch.num_rows, np.array(batch.column("guess").to_pylist(), object)
            number = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            chars, whole = number("chars"), batch.column("whole").flatten().to_numpy(zero_copy_only=False).reshape(n, p)
            adds, held, named = np.zeros((n, p)), np.zeros((n, 4)), np.full(n, None, object)
            if prose is not None:
                of, run_chars, v, shrink = _runs(batch)
                langs = [x for x in prose.langs if x != "any"] or ["any"]
                per_lang, best, nearest = {}, np.full(n, np.inf), np.where(np.isin(guess, langs), guess, langs[0])
                for lang in langs:
                    parts, z = prose.contributions(lang, v, shrink)
                    per_lang[lang] = _kinds(parts, z)
                    far = np.bincount(of, weights=parts.sum(1) * run_chars, minlength=n)
                    closer = ~np.isin(guess, langs) & (far < best)
                    nearest[closer], best = lang, np.minimum(best, far)
                kinds, whole_shrink = np.zeros(len(of), int), _shrink(number("words"), number("trigrams"))
                for lang in langs:
                    kinds = np.where(nearest[of] == lang, per_lang[lang], kinds)
                    own = nearest == lang
                    adds[own] = prose.contributions(lang, whole[own], whole_shrink[own])[0]
                held = np.bincount(of * 4 + kinds, weights=run_chars, minlength=4 * n).reshape(n, 4)
                named = np.where(2 * held[:, :3].sum(1) > held.sum(1), np.array(KINDS, object)[held[:, :3].argmax(1)], None)
            there = chars > 0
            known = there & (prose is not None)
            seen = lambda values, valid: pa.array(np.where(valid, values, np.nan), pa.float64(), from_pandas=True)
            rows = lambda values, valid: pa.array([v if ok else None for v, ok in zip(values.tolist(), valid, strict=True)], pa.list_(pa.float64()))
            columns = {
                "doc_id": batch.column("doc_id"), "lang_guess": pa.array(np.where(there, guess, None), pa.string()), "chars": batch.column("chars"), "words": batch.column("words"),
                "prose_share": seen(held[:, 3] / np.maximum(held.sum(1), 1), known), "kind": pa.array(named, pa.string()),
                "distance": seen(np.sqrt(np.maximum(0.0, adds.sum(1))), known), "statistics": rows(whole, there), "contributions": rows(adds, known),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = dict(units.dtypes)["doc_id"]
    return units.mapInArrow(run, f"doc_id {kind}, {_JUDGED}")


def document_quality(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``judge`` of all documents against prose fitted over all documents. Null and blank texts have a row with 0 characters."""
    scratch = Scratch(documents.sparkSession, "quality")
    units = scratch.save(measured(documents, common_words), "units")
    return scratch.finish(judge(units, fit(units)))


def statistics_table(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``document_quality`` with a column for every statistic and for what it adds to the squared distance.

    ``common`` is the share of words that are function words, ``symbols`` the ratio of symbols to visible
    characters, ``closed_lines`` the share of lines that end in closing punctuation.
    """
    judged = document_quality(documents, common_words)
    return judged.select(
        "doc_id", "lang_guess", "chars", "words", "prose_share", "kind", "distance",
        *(F.col("statistics")[k].alias(name) for k, name in enumerate(STATISTICS)),
        *(F.col("contributions")[k].alias(f"{name}_adds") for k, name in enumerate(STATISTICS)),
    )
