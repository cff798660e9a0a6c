"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on passages that toxic training texts have and ordinary
ones lack, one on the common passages of ordinary texts. A window is one word with its delimiters;
how many bytes each dictionary needs for it, against its length, puts it in a bin. Either half of
the training texts calibrates the bins (how much likelier a toxic text has one) with dictionaries
of the other half; a logistic curve over the strongest bins of a text gives the score, the mean of
both halves. Each distinct word of a task is compressed once.

The fit takes a bounded sample of labelled rows, at most ``sample`` of each class, chosen by the
hash of doc_id; all their words, however many and long, are counted by a Spark aggregation. Scoring
covers every row.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.arrow import forget, map_rows, release, schema_with
from groundwork.llm.registry import query, table
from groundwork.llm.storage import stored
from groundwork.llm.words import ALNUM, slices

#: Labelled rows of each class that the fit may use.
SAMPLE = 4_000
THRESHOLD = 0.3
#: Bytes of the toxic and of the ordinary dictionary.
SIZES = 16_384, 32_768
#: Standing behind each window, so that short words are searched in the dictionary too.
FILLER = b"\x01" * 8
_SPLIT = bytes(c if ALNUM[c] else 32 for c in range(256))


def fold(text: str) -> list[bytes]:
    """Lower-cased words of letters and digits."""
    return text.lower().encode().translate(_SPLIT).split()


def window(word: bytes) -> bytes:
    return b" " + word + b" " + FILLER


@dataclass(frozen=True)
class Half:
    """Dictionaries of one half of the sample, calibrated on the other."""

    toxic: bytes
    ordinary: bytes
    weights: dict[int, float]
    curve: tuple[list[float], list[float], list[float]] | None


@dataclass(frozen=True)
class Model:
    """Everything a task needs to score texts, about a hundred kilobytes; the mean of its halves.

    ``base`` is the share of toxic rows among the labels, the score where there are no halves."""

    halves: list[Half]
    base: float


class Scorer:
    """One half at work; every distinct word is compressed once."""

    def __init__(self, half: Half):
        import zstandard as zs

        self.half, self.bins = half, {}
        shape = zs.ZstdCompressionParameters(
            window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=16, strategy=zs.STRATEGY_LAZY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self.ordinary, self.toxic = (
            zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d), compression_params=shape).compress for d in (half.ordinary, half.toxic)
        )

    def bin(self, word: bytes) -> int:
        """Length of a word, and of its window under either dictionary, in one number."""
        found = self.bins.get(word)
        if found is None:
            text = window(word)
            o, t = min(len(self.ordinary(text)), 255), min(len(self.toxic(text)), 255)
            found = min(len(word), 15) << 16 | o << 8 | t
            if len(self.bins) >= 500_000:
                self.bins.clear()
            if len(word) <= 64:  # longer ones are seldom met again
                self.bins[word] = found
        return found

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        weight = self.half.weights
        rows = [_features([weight.get(self.bin(w), 0.0) for w in set(words)], len(words)) for words in texts]
        mean, spread, w = map(np.array, self.half.curve)
        z = w[0] + ((np.array(rows, float).reshape(-1, 5) - mean) / spread) @ w[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(gains: list[float], words: int) -> list[float]:
    """The three strongest bins, the length, and how many strong bins there are for it."""
    gains = sorted(gains, reverse=True)
    top = [max(g, 0.0) for g in gains[:3]] + [0.0] * (3 - min(3, len(gains)))
    return [*top, math.log1p(words), sum(g > 1.0 for g in gains) / math.sqrt(words + 20)]


def _unlikely(count: int, mean: float) -> float:
    """Probability of ``count`` or more events where ``mean`` are expected."""
    term, below = math.exp(-mean), 0.0
    for k in range(count):
        below += term
        term *= mean / (k + 1)
    return max(1 - below, 1e-18)


def _dictionary(words: list[tuple[bytes, int]], size: int) -> bytes:
    """A trained dictionary; empty when there is too little text to train on."""
    import random

    import zstandard as zs

    samples = [window(w) for w, times in words for _ in range(min(times, 20))]
    random.Random(3).shuffle(samples)
    if not samples:
        return b""
    samples = (samples * (3000 // len(samples) + 1))[: max(3000, len(samples))]
    joined = [b"".join(samples[i : i + 4]) for i in range(0, len(samples), 4)]
    return zs.train_dictionary(size, joined, k=64, d=6).as_bytes()


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """Mean, spread and weights of a ridge logistic regression by Newton's method."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w)) * 0.05
    ridge[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
    return mean.tolist(), spread.tolist(), w.tolist()


def held_out(column: str = "doc_id"):
    """Whether a row must not be learned from; a missing doc_id has no label and is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(label, half, text) of the training rows, written once, and how many labels of each class there are.

    At most ``2 * sample`` labels are broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    order = F.xxhash64(F.lit(7), "doc_id")
    picked = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    half = F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(2)).alias("half")
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return stored(joined.select("label", half, "text"), "toxicity-sample"), counts


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``labels`` (doc_id, toxic) of rows that are not held out.

    Without labelled texts of both classes, or where no window tells them apart, the model has no
    halves: it scores every text with the share of toxic ones among those labels, and nothing is
    filtered by it.
    """
    rows, known = _sample(docs, labels, sample)
    sizes = {(r["half"], r["label"]): r["n"] for r in rows.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    base = known.get(1, 0) / sum(known.values()) if known else 0.0
    if any(not sizes.get((h, k)) for h in (0, 1) for k in (0, 1)):
        return Model([], base)

    def distinct(tables):
        for part in tables:
            found = [sorted(set(fold(t))) for t in part["text"].to_pylist()]
            yield {
                "word": [w for f in found for w in f],
                "half": [h for f, h in zip(found, part["half"].to_pylist(), strict=True) for _ in f],
                "label": [k for f, k in zip(found, part["label"].to_pylist(), strict=True) for _ in f],
            }

    seen = map_rows(rows, schema_with(rows, {}, "word binary, half int, label int"), distinct)
    counts = stored(
        seen.groupBy("word").agg(*(F.count_if((F.col("half") == h) & (F.col("label") == k)).alias(f"n{h}{k}") for h in (0, 1) for k in (0, 1))),
        "toxicity-terms",
    )
    trained = [_train(counts, sizes, h) for h in (0, 1)]
    if not all(trained):
        return Model([], base)
    halves = [Half(*pair, {}, None) for pair in trained]

    def binned(tables):
        # A text is calibrated with the dictionaries of the other half.
        scorers = [Scorer(halves[1]), Scorer(halves[0])]
        for part in tables:
            found = [fold(t) for t in part["text"].to_pylist()]
            bins = [Counter(map(scorers[h].bin, set(f))) for f, h in zip(found, part["half"].to_pylist(), strict=True)]
            yield {
                "label": part["label"],
                "half": part["half"],
                "words": [len(f) for f in found],
                "bins": [[{"bin": b, "n": n} for b, n in sorted(c.items())] for c in bins],
            }

    # Of each text only its bins and how often each occurs come to the driver.
    shape = schema_with(rows, {"label": "label", "half": "half"}, "words long, bins array<struct<bin: int, n: int>>")
    calibration = map_rows(rows, shape, binned).collect()
    odds = known[1] / known[0]
    return Model([_calibrated(halves[h], [r for r in calibration if r["half"] != h], odds) for h in (0, 1)], base)


def _calibrated(half: Half, rows: list, odds: float) -> Half:
    """Weights and curve for texts of which the toxic are ``odds`` to one, whatever their share in ``rows``."""
    y = np.array([r["label"] for r in rows])
    has: dict[int, list[int]] = {}
    for r in rows:
        for b in r["bins"]:
            has.setdefault(b["bin"], [0, 0])[r["label"]] += 1
    toxic, ordinary = y.sum() + 1, (y == 0).sum() + 1
    weights = {b: math.log((t + 0.5) / toxic) - math.log((o + 0.5) / ordinary) for b, (o, t) in has.items()}
    x = np.array([_features([weights[b["bin"]] for b in r["bins"] for _ in range(b["n"])], r["words"]) for r in rows])
    mean, spread, w = _logistic(x, y.astype(float))
    w[0] += math.log(odds) - math.log(y.sum() / (y == 0).sum())
    return Half(half.toxic, half.ordinary, weights, (mean, spread, w))


def _train(counts: DataFrame, sizes: dict, h: int) -> tuple[bytes, bytes] | None:
    """Toxic and ordinary dictionary from one half of the sample; None without toxic terms.

    Every word that toxic texts have far more often than chance is material of the first. That of the
    second is the most common words of ordinary texts, whole ranks of equal count, up to twice the
    dictionary's size and at least one rank.
    """
    t, o = F.col(f"n{h}1"), F.col(f"n{h}0")
    mean = sizes[h, 1] * (o + 0.5) / sizes[h, 0]
    more = counts.where((t >= 2) & (t > 8 * mean) & (F.octet_length("word") >= 3)).select("word", t.alias("t"), mean.alias("mean"))
    terms = sorted((-r["t"], bytes(r["word"])) for r in more.collect() if _unlikely(r["t"], r["mean"]) < 1e-4)
    spent, least = 0, None
    ranks = counts.where(o > 0).groupBy(o.alias("n")).agg(F.sum(F.octet_length("word") + len(window(b""))).alias("bytes"))
    for r in ranks.orderBy(F.desc("n")).collect():
        spent += r["bytes"]
        if least is not None and spent > 2 * SIZES[1]:
            break
        least = r["n"]
    if not terms or least is None:
        return None
    common = sorted((-r["n"], bytes(r["word"])) for r in counts.where(o >= least).select("word", o.alias("n")).collect())
    return _dictionary([(w, -n) for n, w in terms], SIZES[0]), _dictionary([(w, 5) for _, w in common], SIZES[1])


def score_toxicity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted (1 if score >= 0.3).

    A null text is the empty text, which has the score of a text without any window. Texts with the
    same words have the same score; repeated rows each have a row. Other columns, whatever their names,
    are not looked at. An empty table gives no rows.
    """
    schema = schema_with(docs, {"doc_id": id_column}, "score double, predicted int")

    def work(tables):
        scorers = [Scorer(half) for half in model.halves]
        for part in tables:
            words = [fold(t or "") for t in part["text"].to_pylist()]
            scores = np.mean([s.scores(words) for s in scorers], axis=0).tolist() if scorers else [model.base] * len(words)
            yield {"doc_id": part["doc_id"], "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}

    return map_rows(docs.selectExpr(f"`{id_column}` AS doc_id", f"`{text_column}` AS text"), schema, work)


def without_toxic(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted to be toxic.

    A model without halves knows nothing of single texts: all rows stay. Null texts are empty,
    repeated rows share their text's verdict, an empty table stays empty.
    """
    if not model.halves:
        return docs

    def keep(batches):
        forget()
        scorers = [Scorer(half) for half in model.halves]
        for batch in batches:
            for part in slices(batch, text_column):
                words = [fold(t or "") for t in part[text_column].to_pylist()]
                scores = np.mean([s.scores(words) for s in scorers], axis=0)
                yield from part.filter(pa.array(scores < THRESHOLD)).to_batches()
        scorers.clear()
        release()

    return docs.mapInArrow(keep, docs.schema)


@query("op6_toxicity")
def op6(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    scored = score_toxicity(docs, fit(docs, table(spark, directory, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
