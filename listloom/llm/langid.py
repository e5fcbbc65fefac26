"""Language ID by rank-order profiles: a document's most frequent letter n-grams against each language's profile.

Letters of any script are lower-cased and everything else separates words; n-grams of 1 to 3 letters (with the word
edges) are counted by their code points over all documents that carry a language and belong to the learning folds. A
profile is the PROFILE most frequent n-grams of a language; ties go to the shorter n-gram, then by code points. A text
goes to the language with the least out-of-place distance, ties to the first name; score is 1 - distance / largest
possible distance. Null texts and texts without a letter give `und` and 0.0, and so does everything if no document can
be learned from. Rows with a null language, or outside the learning folds, are predicted but never learned. Repeated
rows count each time. Very long texts are read whole. Other columns play no part (a stage passes them through). An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import fold, small_batches, table

#: n-grams in a profile.
PROFILE = 300
#: An n-gram is its code points as digits of this base; n-grams of one letter come first, then those of two and three.
BASE = 0x110000
#: Distinct n-grams that a task holds for one language before it hands their counts on.
HELD = 1 << 19
#: A stage rejects texts below half of this quantile of the labelled texts' scores.
QUANTILE = 0.01
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(BASE)]))
    return _LETTERS[0]


def codes(text: str) -> np.ndarray:
    """The code of every n-gram occurrence of a text; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    s = np.concatenate(([0], np.where(_letters()[points], points, 0), [0]))
    if not s.any():
        return np.zeros(0, np.int64)
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    two = s[:-1] * BASE + s[1:]
    three = (two[:-1] * BASE + s[2:])[s[1:-1] != 0]
    return np.concatenate((s[s != 0], two[two != 0] + BASE, three + (BASE + BASE * BASE)))


def counted(found: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, in order, and how often each is there (or the sum of its n)."""
    if not len(found):
        return found, np.zeros(0, np.int64)
    if n is None:
        found = np.sort(found)
    else:
        order = np.argsort(found, kind="stable")
        found, n = found[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    return found[first], np.diff(np.append(first, len(found))) if n is None else np.add.reduceat(n, first)


def top(found: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, the most frequent first, ties by code."""
    distinct, n = counted(found)
    return distinct[np.argsort(-n, kind="stable")[:size]]


def profiles(docs: DataFrame, usable: Column, size: int = PROFILE) -> list[tuple[str, list[int]]]:
    """(language, n-gram codes by rank), by language; languages x size codes come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size_of: dict[str, int] = {}

        def rows(lang: str) -> pa.RecordBatch:
            (grams, n), = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n, pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                some = counted(codes(text.as_py()))
                held.setdefault(lang, []).append(some)
                size_of[lang] = size_of.get(lang, 0) + len(some[0])
                if size_of[lang] > 2 * HELD:
                    held[lang] = [counted(*(np.concatenate(x) for x in zip(*held[lang], strict=True)))]
                    size_of[lang] = len(held[lang][0][0])
                    if size_of[lang] > HELD:
                        yield rows(lang)
                        size_of[lang] = 0
        for lang in list(held):
            held[lang] = [counted(*(np.concatenate(x) for x in zip(*held[lang], strict=True)))]
            yield rows(lang)

    each = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    total = each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The most frequent of each of 64 shares of the n-grams, then of what is left: no task sorts a whole language.
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(F.desc("n"), "gram")
    few = total.withColumn("place", F.row_number().over(share)).where(F.col("place") <= size)
    ranked = few.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram"))).alias("all"))
    rows = ranked.select("lang", F.slice("all", 1, size)["gram"].alias("grams")).collect()
    return sorted((r["lang"], list(r["grams"])) for r in rows)


class Labeler:
    """Predicts in a task; carries only the profiles, a sorted table of their n-grams is built on first use."""

    def __init__(self, learned: list[tuple[str, list[int]]], size: int = PROFILE):
        self.learned, self.size, self.grams = learned, size, None

    def __getstate__(self):
        return {"learned": self.learned, "size": self.size, "grams": None}

    def distances(self, mine: np.ndarray) -> np.ndarray:
        """The out-of-place distance of a text's n-grams, by rank, to each profile; n-grams that it lacks count `size`."""
        if self.grams is None:
            grams = np.array([g for _, own in self.learned for g in own], np.int64)
            order = np.argsort(grams, kind="stable")
            self.grams = grams[order]
            self.lang = np.repeat(np.arange(len(self.learned)), [len(own) for _, own in self.learned])[order]
            self.rank = np.concatenate([np.arange(len(own)) for _, own in self.learned])[order]
        low, high = np.searchsorted(self.grams, mine, "left"), np.searchsorted(self.grams, mine, "right")
        n = high - low
        place = np.repeat(np.arange(len(mine)), n)
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        nearer = self.size - np.abs(self.rank[at] - place)
        return self.size * len(mine) - np.bincount(self.lang[at], weights=nearer, minlength=len(self.learned))

    def __call__(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for text in texts:
            mine = top(codes(text.as_py() or ""), self.size)
            if not len(mine) or not self.learned:
                langs.append("und")
                scores.append(0.0)
                continue
            far = self.distances(mine)
            best = int(far.argmin())
            langs.append(self.learned[best][0])
            scores.append(1.0 - float(far[best]) / (self.size * len(mine)))
        return langs, scores


def predict(docs: DataFrame, learned: list[tuple[str, list[int]]]) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text)."""
    label = Labeler(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = label(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def least_score(docs: DataFrame, learned: list[tuple[str, list[int]]]) -> float:
    """Half of the QUANTILE of the scores of all labelled texts that have a letter; 0 if there are none."""
    found = predict(docs.where(F.col("lang").isNotNull()), learned).where("lang_pred <> 'und'")
    return (found.agg(F.percentile_approx("score", QUANTILE, 10_000).alias("q")).first()["q"] or 0.0) / 2


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    found = predict(docs, profiles(docs, ~held_out))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops documents whose language cannot be told; others stay as they are.

    These are null texts, texts without a letter, and texts so far from every profile that their best score is below
    half of what all but one in a hundred labelled texts reach: text in none of the learned languages. Where no text
    can be learned from, nothing can be told of any language and every text with a letter stays.
    """
    learned = profiles(docs, fold(F.col("doc_id"), 4) != 2)
    least, label, at = least_score(docs, learned) if learned else 0.0, Labeler(learned), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(at)
            if learned:
                good = [lang != "und" and score >= least for lang, score in zip(*label(texts), strict=True)]
            else:
                good = [any(c.isalpha() for c in t.as_py() or "") for t in texts]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
