"""Language of texts by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed letter
trigrams tells the languages with 1 from those with 0. A text's language is the one
whose codeword costs the classifiers' margins the least loss.

The classifiers are linear: the weight of a trigram is the logarithm of the odds
between the bit's two sides, learned from a bounded sample of labelled rows. The
model is some hundred kilobytes and goes to the tasks with the code.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.llm.common import map_in_arrow, steps
from bindery.llm.tokens import kept

#: The sample that the classifiers learn from: about so many rows of each language, and so
#: many in all. Their texts count whole.
PER_LANGUAGE, IN_ALL = 400, 8_000
#: Languages that are learned at most, those with most rows.
MOST_LANGUAGES = 400
BUCKETS = 1 << 14
#: A margin counts as if the text had so many trigrams at most, as they are not independent.
TRUSTED = 30
#: Losses of the two best languages nearer than this are ambiguous.
CLEAR = 1.0
UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams, where each text's begin, and which texts have a letter.

    Letters are lower-cased, all else is a space; trigrams without a letter in the
    middle are bucket 0, which has no weight.
    """
    known = kept("letters", _letters)
    texts = [t.lower() for t in texts]
    points = np.frombuffer(" ".join(["", *texts, "", ""]).encode("utf-32-le", "replace"), "<u4")
    letter = known[points]
    points = np.where(letter, points, 32).astype(np.uint32)
    a, b, c = points[:-2], points[1:-1], points[2:]
    mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    bucket = np.where(letter[1:-1], 1 + (mixed >> np.uint32(18)) % (BUCKETS - 1), 0)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    return bucket, starts, np.add.reduceat(letter[1:-1].astype(np.int64), starts)


def codewords(n: int) -> np.ndarray:
    """`n` rows of -1 and 1, far from each other; every column has both.

    Few languages get all different columns; many get random ones, ten for each
    doubling, the best of several draws by least distance.
    """
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        columns = np.arange(1, 1 << (n - 1))
        return np.where(columns[None, :] >> np.arange(n)[:, None] & 1, 1, -1).astype(np.int8)
    random, best, width = np.random.default_rng(7), None, math.ceil(10 * math.log2(n))
    for _ in range(20):
        code = random.choice(np.array([-1, 1], np.int8), (n, width))
        code = code[:, np.abs(code.sum(0, dtype=np.int64)) < n]
        likeness = code.astype(np.int64) @ code.T.astype(np.int64)
        np.fill_diagonal(likeness, -width)
        if best is None or likeness.max() < best[0]:
            best = likeness.max(), code
    return best[1]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x buckets

    def losses(self, bucket: np.ndarray, starts: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Texts x languages: softplus losses of the margins against each codeword."""
        trust = (np.minimum(letters, TRUSTED) / np.maximum(letters, 1))[:, None]
        sums = [np.add.reduceat(w[bucket], starts) for w in self.weights]
        margin = np.stack(sums, 1).astype(np.float64) * trust if sums else np.zeros((len(starts), 0))
        return np.stack(
            [np.logaddexp(0, -margin * word[None, :]).sum(1) for word in self.code], 1
        )


def fit_languages(
    labelled: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> LanguageModel:
    """Learn from a sample of the rows whose `text` and `lang` are not null.

    Which rows are drawn depends on a hash of `key`; rows that repeat it are drawn
    together. Their whole texts are counted within tasks, and only the trigram counts of
    each language reach the driver. Past `MOST_LANGUAGES` values of `lang` the rarest are
    not learned. Without such rows the model knows no language.
    """
    rows = labelled.select(
        F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")
    ).where("lang is not null and text is not null")
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    held = {r.lang: r.n for r in found.limit(MOST_LANGUAGES).collect()}
    if not held:
        return LanguageModel((), np.zeros((0, 0), np.int8), np.zeros((0, BUCKETS), np.float32))
    each = max(20, min(per_language, IN_ALL // len(held)))
    shares = [x for k, n in held.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))]
    draw = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1_000_000)) / 1e6
    sample = rows.where(draw < F.try_element_at(F.create_map(*shares), F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang_, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                bucket, _, _ = trigrams([body.as_py()])
                own = np.bincount(bucket, minlength=BUCKETS)
                sums[lang_] = sums[lang_] + own if lang_ in sums else own
        for lang_, own in sums.items():
            hit = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang_] * len(hit)), pa.array(hit.astype(np.int32)), pa.array(own[hit].astype(np.int64))],
                names=["lang", "bucket", "n"],
            )

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    taken = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("grams")).collect()
    languages = tuple(sorted(r.lang for r in taken))
    counts = np.zeros((len(languages), BUCKETS))
    for row in taken:
        bucket, n = zip(*row.grams)
        counts[languages.index(row.lang), list(bucket)] = n
    counts[:, 0] = 0
    shares = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    code, floor = codewords(len(languages)), 1e-6
    weights = np.zeros((code.shape[1], BUCKETS), np.float32)
    for bit in range(code.shape[1]):
        one, other = shares[code[:, bit] > 0].mean(0), shares[code[:, bit] < 0].mean(0)
        weights[bit] = np.log((one + floor) / (other + floor))
    weights[:, 0] = 0
    return LanguageModel(languages, code, weights)


def predict_languages(
    docs: DataFrame,
    model: LanguageModel,
    text: str = "text",
    names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous"),
) -> DataFrame:
    """`docs` with `lang_pred`, `score` and `ambiguous`, or so named, from the whole text alone.

    `lang_pred` is `und` with score 0, and ambiguous, where the text is null or has no
    letter, or if the model knows no language. `score` is the share of the best
    language among all by exp(-loss). `ambiguous` says that the second language is
    about as near. Ties go to the language that sorts first. Rows stay as they are,
    repeated ones too; an empty table stays empty. `names` must be new to `docs`, whose
    other columns may have any name.
    """
    if {name.lower() for name in names} & {name.lower() for name in docs.columns}:
        raise ValueError(f"{', '.join(names)} must be new names")
    place, languages = docs.columns.index(text), np.array([*model.languages, UNKNOWN])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            named, scores, doubts = [], [], []
            for a, b in steps(texts, 1024 * 1024):
                body = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                bucket, starts, letters = trigrams(body)
                best = np.full(len(body), len(languages) - 1)
                score, doubt = np.zeros(len(body)), np.ones(len(body), bool)
                if len(languages) > 1:
                    losses = model.losses(bucket, starts, letters)
                    order = np.sort(losses, 1)
                    best = np.where(letters > 0, losses.argmin(1), best)
                    share = 1 / np.exp(order[:, :1] - losses).sum(1)
                    score = np.where(letters > 0, share, 0.0)
                    if losses.shape[1] > 1:
                        doubt = order[:, 1] - order[:, 0] < CLEAR
                    else:
                        doubt = np.zeros(len(body), bool)
                    doubt |= letters == 0
                named += languages[best].tolist()
                scores += score.tolist()
                doubts += doubt.tolist()
            added = [
                pa.array(named, pa.string()),
                pa.array(scores, pa.float64()),
                pa.array(doubts, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added],
                names=[*batch.schema.names, *names],
            )

    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField(names[0], T.StringType()),
            T.StructField(names[1], T.DoubleType()),
            T.StructField(names[2], T.BooleanType()),
        ]
    )
    return map_in_arrow(docs, predict, schema)


def held_out(doc_id: str = "doc_id"):
    """Is the row kept from learning? A third of all, by the identifier's checksum."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
