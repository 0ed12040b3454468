"""Language identification by rank-order profiles (operator 7).

A profile is the ranked list of a language's most frequent letter n-grams (1 to 3, words bounded by
a blank). A text's own list is compared with each profile by the out-of-place distance: the sum,
over the text's n-grams, of how far their ranks differ, and the longest distance for an n-gram
that the profile lacks. The nearest profile wins.

Profiles are fitted on at most SAMPLE texts a language, those of smallest hash in as many hash
cells, from documents that aren't held out. Every other step covers all rows.

Edge cases: null texts and texts without letters are `und` with score 0; equal distances go to
the smaller language name, equal counts to the smaller n-gram; with nothing to learn from, every
text is `und`; an empty table gives no rows; columns beside doc_id, text and lang are ignored, and
lang_pred and score take the place of columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm import arrays

#: Texts a language that profiles are fitted on.
SAMPLE = 400
#: N-grams in a profile and in a text's own list.
TOP = 300
#: Letters handled at once.
CHUNK = 1 << 19
#: What stands for everything between words.
BLANK = 1

#: Unicode's letters, in all planes.
LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count) of letters and blanks."""
    c = codes.astype(np.int64)
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    grams = np.sort(np.concatenate([c[c > BLANK], two[(c[:-1] > BLANK) | (c[1:] > BLANK)], three[c[1:-1] > BLANK]]))  # a middle blank joins two words: no n-gram
    if not len(grams):
        return grams, grams
    at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[at], np.diff(np.append(at, len(grams)))


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count) of a whole text; n-grams are up to three code points of 21 bits."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(LETTER[codes], codes, BLANK)
    blank = codes == BLANK
    codes = np.concatenate([[BLANK], codes[~blank | np.concatenate([[True], ~blank[:-1]])], [BLANK]])
    parts = [_counts(codes[a : a + CHUNK + 2 * bool(a + CHUNK < len(codes))]) for a in range(0, len(codes) - 1, CHUNK)]
    if len(parts) == 1:
        return parts[0]
    # Pieces overlap by two letters, so each n-gram but the shorter ones at a cut is counted once; one more changes no rank of a text this long.
    gram, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return gram, np.bincount(back, np.concatenate([n for _, n in parts]), len(gram)).astype(np.int64)


def ranked(gram: np.ndarray, count: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, most frequent first."""
    if len(gram) > top:
        least = np.partition(count, len(count) - top)[len(count) - top]
        keep = count >= least
        gram, count = gram[keep], count[keep]
    return gram[np.lexsort((gram, -count))][:top]


def profiles(docs: DataFrame, sample: int = SAMPLE, top: int = TOP) -> DataFrame:
    """lang, gram, rank (from 0), learned from docs (doc_id, text, lang)."""
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(sample))
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    picked = known.groupBy("lang", cell.alias("cell")).agg(F.min_by("text", F.struct(F.xxhash64("doc_id", F.lit(7)), "text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.sliced(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                gram, n = grams(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counted = picked.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("rank", F.expr("CAST(0 AS BIGINT)") + order - 1).where(F.col("rank") < top).select("lang", "gram", "rank")


class Matcher:
    def __init__(self, rows: list[tuple[str, int, int]], top: int = TOP) -> None:
        self.langs = sorted({r[0] for r in rows})
        place = {x: i for i, x in enumerate(self.langs)}
        self.gram = np.unique(np.array([r[1] for r in rows], np.int64))
        self.rank = np.full((len(self.langs), len(self.gram) + 1), -1, np.int64)
        for lang, gram, rank in rows:
            self.rank[place[lang], np.searchsorted(self.gram, gram)] = rank
        self.top = top

    def match(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - its distance over the longest distance)."""
        own = ranked(*grams(text), self.top)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.gram, own)
        at[(at < len(self.gram)) & (self.gram[np.minimum(at, len(self.gram) - 1)] != own)] = len(self.gram)
        rank = self.rank[:, at]
        far = np.where(rank < 0, self.top, np.abs(rank - np.arange(len(own)))).sum(1)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.top * len(own)))


def predict(docs: DataFrame, learned: DataFrame, top: int = TOP) -> DataFrame:
    """docs with lang_pred and score, in place of columns of that name. The profiles (languages x top rows) are collected, as their size is bounded.

    Only texts go to Python, and only languages and scores come back.
    """
    rows = [tuple(r) for r in learned.collect()]

    def match(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Matcher(rows, top)
        for column in columns:
            langs, scores = [], []
            for batch in arrays.sliced([pa.RecordBatch.from_arrays([column], ["text"])], done=False):
                for text in batch.column("text").to_pylist():
                    lang, score = known.match(text)
                    langs.append(lang)
                    scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])
        arrays.trim()

    match.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(match, "lang string, score double")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "_found")]
    return docs.withColumn("_found", found("text")).select(*kept, F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = profiles(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text"), learned).drop("text")
