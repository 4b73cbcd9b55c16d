"""Toxicity by two class-conditional Kneser-Ney models.

Both models spell words character by character. A character's longest history
(up to four characters, no further back than the word) has discounted counts of
each class; what a class has seen too rarely there backs off to one model that
both share: the counts of both classes, interpolated down to single characters
by continuation counts (in how many contexts something was seen). A rare or new expression is therefore smoothed
alike in both classes and says little by itself. A text's raw value is the
difference of the two log-likelihoods per character, a word counting as far as it
exceeds a margin (else the languages a class happens to hold outweigh a few
expressions in a long text); a logistic curve, fitted on
labelled texts that were kept out of the counts, turns it into a probability.

Counts are gathered by Spark over all labelled rows, by a 64-bit key of the n-gram itself: what is
gathered grows with the text, and no two n-grams share a count. The model that is
broadcast has one row for every n-gram of up to five characters that labelled words have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presscan.llm.columns import bytes_of
from presscan.llm.shingles import mix
from presscan.llm.wordbatch import letter_words, slices, tidy
from presscan.session import stored

ORDER = 5
DISCOUNT = 0.75
#: Occurrences of a history in a class that weigh as much as what both classes have seen there.
STRENGTH = 50.0
#: N-grams a task holds before it hands its counts on.
HELD = 1 << 20
#: One text in this many calibrates; the others are counted.
CALIBRATE = 4
#: Steps per unit of raw value when calibration looks at them, and their bounds.
STEPS, FARTHEST = 20_000, 6000
#: What a word's log-likelihood ratio must exceed to count, either way.
MARGIN = 2.0
_ALPHABET = 1 << 16
_GRAMS = "key long, length int, top boolean, history long, suffix long, ordinary long, toxic long"


def _mixed(key: np.ndarray, length: int) -> np.ndarray:
    return mix(key + np.uint64(length)).view(np.int64)


@dataclass
class _Grams:
    """``key[m - 1]``: the n-gram of length m that ends at each predicted character; ``longest``: the longest m."""

    word: np.ndarray
    key: list[np.ndarray]
    history: list[np.ndarray]
    longest: np.ndarray


def _grams(words: list[bytes]) -> _Grams:
    text = "\x00".join(f" {w.decode()}\x01" for w in words) + "\x00"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(codes == 0)
    lengths = np.diff(np.concatenate([[-1], ends])) - 1
    word = np.repeat(np.arange(len(words)), lengths + 1)
    place = np.arange(len(codes)) - np.repeat(np.concatenate([[0], ends[:-1] + 1]), lengths + 1)
    total, keys = np.zeros(len(codes), np.uint64), []
    factor = np.uint64(1)
    for m in range(1, ORDER + 1):
        shifted = np.zeros_like(codes)
        shifted[m - 1 :] = codes[: len(codes) - m + 1]
        total = total + (shifted + np.uint64(1)) * factor
        factor = np.uint64(int(factor) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF)
        keys.append(_mixed(total, m))
    at = np.flatnonzero((codes != 0) & (place > 0))
    return _Grams(
        word[at],
        [k[at] for k in keys],
        [np.zeros(len(at), np.int64), *[k[at - 1] for k in keys[:-1]]],
        np.minimum(place[at] + 1, ORDER),
    )


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is among the sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


@dataclass(frozen=True)
class ToxicityModel:
    """By sorted keys. For n-grams seen: their probabilities (ordinary, toxic); for histories: the weight of what is below."""

    keys: np.ndarray
    probability: np.ndarray
    histories: np.ndarray
    backoff: np.ndarray
    floor: float


def _gather(labelled: DataFrame) -> DataFrame:
    names = ["key", "length", "top", "history", "suffix", "ordinary", "toxic"]

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        key, *about, ordinary, toxic = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, first, index = np.unique(key, return_index=True, return_inverse=True)
        sums = (np.bincount(index, weights=c, minlength=len(key)).astype(np.int64) for c in (ordinary, toxic))
        return (key, *(x[first] for x in about), *sums)

    def batch_of(held: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in held], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in slices(batch):
                words = letter_words(part.column("text"))
                if not words.distinct:
                    continue
                label = part.column("toxic").to_numpy(zero_copy_only=False)
                n = len(words.distinct)
                times = np.bincount(label[words.row] * n + words.index, minlength=2 * n).reshape(2, n)
                grams = _grams(words.distinct)
                for m in range(1, ORDER + 1):
                    fits = grams.longest >= m
                    word, size = grams.word[fits], int(fits.sum())
                    suffix = grams.key[m - 2][fits] if m > 1 else np.zeros(size, np.int64)
                    length, top = np.full(size, m, np.int32), grams.longest[fits] == m
                    found = (grams.key[m - 1][fits], length, top, grams.history[m - 1][fits], suffix, times[0][word], times[1][word])
                    held = merged([found] if held is None else [held, found])
                if len(held[0]) > HELD:
                    yield batch_of(held)
                    held = None
        if held is not None:
            yield batch_of(held)

    rows = labelled.mapInArrow(tidy(count), _GRAMS)
    # What a key stands for is the same in every row of it.
    about = [F.first(c).alias(c) for c in names[1:5]]
    return rows.groupBy("key").agg(*about, F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _smooth(table) -> ToxicityModel:
    """Interpolated probabilities of all n-grams seen, shortest first.

    Longest n-grams have a probability in each class, the others the shared one twice.
    """
    table = table.sort_values("key")
    keys, length = table["key"].to_numpy(np.int64), table["length"].to_numpy(np.int64)
    top = table["top"].to_numpy(bool)
    own = np.stack([table["ordinary"].to_numpy(np.float64), table["toxic"].to_numpy(np.float64)])
    suffix, _ = _places(keys, table["suffix"].to_numpy(np.int64))
    histories, history = np.unique(table["history"].to_numpy(np.int64), return_inverse=True)
    contexts = np.bincount(suffix[length > 1], minlength=len(keys))
    value = np.zeros((2, len(keys)))
    weight = np.ones((2, len(histories)))
    floor = 1.0 / _ALPHABET

    def interpolate(some, counts: np.ndarray, below: np.ndarray, strength: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        place = history[some]
        total = np.bincount(place, weights=counts, minlength=len(histories))[place]
        kinds = np.bincount(place, weights=counts > 0, minlength=len(histories))[place]
        seen = total > 0
        back = np.divide(DISCOUNT * kinds + strength, total + strength, out=np.ones(len(place)), where=seen)
        share = np.divide(np.maximum(counts - DISCOUNT, 0), total + strength, out=np.zeros(len(place)), where=seen)
        return share + back * below, back

    for m in range(1, ORDER + 1):
        some = (length == m) & ~top
        if some.any():
            below = value[0, suffix[some]] if m > 1 else np.full(some.sum(), floor)
            value[:, some], back = interpolate(some, contexts[some].astype(np.float64), below)
            if m > 1:
                weight[:, history[some]] = back
            else:
                floor *= float(back[0])
    below = np.maximum(value[0, suffix[top]], floor)
    both, pooled = interpolate(top, own[:, top].sum(0), below)
    for c in range(2):
        value[c, top], back = interpolate(top, own[c, top], both, STRENGTH)
        weight[c, history[top]] = back * pooled
    return ToxicityModel(keys, value.astype(np.float32), histories, weight.astype(np.float32), floor)


def _log_ratios(grams: _Grams, model: ToxicityModel) -> np.ndarray:
    """How much likelier toxic words have each predicted character, from its longest n-gram seen on."""
    p = np.full((2, len(grams.word)), model.floor)
    for m, (key, history) in enumerate(zip(grams.key, grams.history, strict=True), 1):
        place, seen = _places(model.keys, key)
        back = 1.0
        if m > 1:
            at, known = _places(model.histories, history)
            back = np.where(known, model.backoff[:, at], 1.0) if len(model.histories) else 1.0
        found = model.probability[:, place] if len(model.keys) else p
        p = np.where(grams.longest >= m, np.where(seen & (found > 0), found, back * p), p)
    return np.log(np.maximum(p[1], 1e-30)) - np.log(np.maximum(p[0], 1e-30))


def _word_values(words: list[bytes], model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio beyond the margin and number of predicted characters of each word."""
    grams = _grams(words)
    # A character's longest n-gram holds all its shorter ones and histories: each is looked up once.
    whole = np.stack(grams.key)[grams.longest - 1, np.arange(len(grams.word))]
    _, first, index = np.unique(whole, return_index=True, return_inverse=True)
    some = _Grams(grams.word[first], [k[first] for k in grams.key], [h[first] for h in grams.history], grams.longest[first])
    n = len(words)
    total = np.bincount(grams.word, weights=_log_ratios(some, model)[index], minlength=n)
    return np.sign(total) * np.maximum(np.abs(total) - MARGIN, 0), np.bincount(grams.word, minlength=n)


def raw_values(docs: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    """doc_id, columns to ``keep``, and ``raw``: log-likelihood ratio per character; null without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text", *keep)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = letter_words(part.column("text"))
                raw = np.full(len(part), np.nan)
                if words.distinct:
                    ratio, size = _word_values(words.distinct, shared.value)
                    total = np.bincount(words.row, weights=ratio[words.index], minlength=len(part))
                    chars = np.bincount(words.row, weights=size[words.index], minlength=len(part))
                    raw = np.divide(total, chars, out=raw, where=chars > 0)
                columns = [part.column(c) for c in ("doc_id", *keep)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, from_pandas=True)], ["doc_id", *keep, "raw"])

    schema = rows.drop("text").schema.add("raw", "double")
    return rows.mapInArrow(tidy(value), schema)


def calibrate(values: DataFrame) -> tuple[float, float]:
    """Slope and centre of the logistic curve for ``values`` (raw, toxic), by Newton steps over a histogram.

    Raw values are looked at in steps of 1 / :data:`STEPS` between two fixed bounds, so the histogram is bounded.
    """
    step = F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.round(F.col("raw") * STEPS).cast("int")))
    table = values.filter(F.col("raw").isNotNull()).groupBy(step.alias("x"), "toxic").count().toArrow().to_pandas()
    toxic = table["toxic"].to_numpy(np.float64)
    if not 0 < toxic.sum() < len(toxic):
        return 1.0, 0.0
    x, n = table["x"].to_numpy(np.float64) / STEPS, table["count"].to_numpy(np.float64)
    # Both classes weigh alike at first, so the curve starts between them.
    means = [np.average(x[toxic == c], weights=n[toxic == c]) for c in (0, 1)]
    scale = max(abs(means[1] - means[0]), 1e-4)
    z = (x - (means[0] + means[1]) / 2) / scale
    a, b = 4.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        gradient = np.array([np.sum(n * (toxic - p) * z) - 0.01 * a, np.sum(n * (toxic - p))])
        w = n * p * (1 - p) + 1e-9
        hessian = np.array([[np.sum(w * z * z) + 0.01, np.sum(w * z)], [np.sum(w * z), np.sum(w)]])
        change = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        a, b = a + change[0], b + change[1]
        if np.abs(change).max() < 1e-6:
            break
    a = max(a, 1e-3)
    return float(a / scale), float((means[0] + means[1]) / 2 - b * scale / a)


def score(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, raw and score (0 to 1) of all ``docs``, learned from ``labelled`` (text, toxic 0 or 1).

    A text that is null or has no letters scores as the value 0 would; if one class
    has no labelled text, every score is that of the other. Repeated rows are rows of
    their own.
    """
    known = labelled.filter(F.col("text").isNotNull() & F.col("toxic").isin(0, 1)).select("text", F.col("toxic").cast("int").alias("toxic"))
    kept_out = F.crc32(bytes_of(F.col("text"))) % CALIBRATE == 0
    # One scan and join of the labelled texts serves the counts; the calibrating ones are read again, a quarter.
    model = _smooth(_gather(known.filter(~kept_out)).toArrow().to_pandas())
    values = stored(raw_values(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model))
    classes = {r["toxic"] for r in known.select("toxic").distinct().collect()}
    if len(classes) < 2:
        return values.withColumn("score", F.lit(float(classes == {1})))
    calibrating = known.filter(kept_out).withColumn("doc_id", F.lit(0).cast("long"))
    slope, centre = calibrate(raw_values(calibrating, model, "toxic"))
    return values.withColumn("score", 1 / (1 + F.exp(-F.lit(slope) * (F.coalesce("raw", F.lit(0.0)) - F.lit(centre)))))
