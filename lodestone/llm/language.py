"""Language identification by string kernels.

Texts become sets of character n-grams of lengths 1 to 3 (letters in lower case, everything else one blank): the blended
spectrum, by presence. Some sampled texts are landmarks; the kernel of a text and a landmark is the number of shared
n-grams over the root of the product of both texts' numbers of n-grams. Ridge regression on the kernels with the
landmarks (Nyström), one target per language against the rest, gives weights. Kernel times weights is linear in a text's
n-gram vector, so the landmark matrix times the weights is computed once, and a batch is scored by one product of its
presence matrix with that.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import documents, give_back, pieces, tidied
from lodestone.ship import ship

#: Rows of each language in the fitting sample, and how many of them are landmarks at most. All languages together:
#: MOST_ROWS. Texts of more than MOST_CHARS characters aren't drawn. The model that goes to the workers: MODEL_BYTES.
PER_LANGUAGE, LANDMARKS, MOST_ROWS, MOST_CHARS, MODEL_BYTES = 200, 48, 20_000, 20_000, 128 << 20
RIDGE, UNKNOWN = 1e-2, "und"
#: Documents whose crc32(id as text) modulo FOLDS is HELD_OUT take no part in learning.
FOLDS, HELD_OUT = 4, 2
#: A text whose best regression value is smaller than this is in none of the learnt languages, for keep_identified(). Words
#: of one syllable in a learnt language reach 0.14, other scripts 0.04.
LEAST = 0.08

_BLANK = 32


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: a letter's or mark's lower case, else a blank; and whether it is a letter. Planes 4 to 13 hold none."""
    lower, letter = np.full(0x110000, _BLANK, np.int32), np.zeros(0x110000, bool)
    for c in (*range(0x40000), *range(0xE0000, 0xE1000)):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            lower[c], letter[c] = ord(chr(c).lower()[0]), kind == "L"
    return lower, letter


def grams(text: str) -> np.ndarray:
    """Codes of the text's n-grams, repeats included: 21 bits a character, so no two n-grams share a code. None without a letter."""
    lower, letter = letters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not letter[points].any():
        return np.empty(0, np.int64)
    a = lower[points].astype(np.int64)
    keep = a != _BLANK
    keep[1:] |= keep[:-1].copy()  # the first of several blanks
    a = a[keep]
    a = np.r_[_BLANK, a] if a[-1] == _BLANK else np.r_[_BLANK, a, _BLANK]
    two = a[:-1] << 21 | a[1:]
    return np.concatenate([a, two, two[:-1] << 21 | a[2:]])


class Lookup:
    """Codes to columns by a multiplicative hash without collisions among the known codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        odd = (k * 0x9E3779B97F4A7C15 | 1 for k in count(1))
        bits = max(4, int(len(codes)).bit_length() + 3)
        for tries, m in enumerate(odd):
            self.multiplier, self.shift = np.uint64(m & (1 << 64) - 1), np.uint64(64 - bits)
            slots = self._slots(codes)
            left = np.arange(len(codes))
            # several rounds of slots: what collides goes to the next table
            self.tables = []
            while len(left) and len(self.tables) < 4:
                table = np.full(1 << bits, -1, np.int32)
                table[slots[left]] = left
                self.tables.append(table)
                left = left[table[slots[left]] != left]
            if not len(left):
                return
            if tries % 4 == 3:
                bits += 1

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * self.multiplier) >> self.shift).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The columns of those codes that are known, repeats included, and the other codes."""
        out = []
        for table in self.tables:
            at = table[self._slots(codes)]
            found = (at >= 0) & (self.codes[at] == codes)
            out.append(at[found])
            codes = codes[~found]
        return np.concatenate(out) if out else np.empty(0, np.int32), codes


@dataclass
class Model:
    languages: list[str]
    lookup: Lookup
    weights: np.ndarray  # known n-grams by languages

    def score(self, texts: list[str], rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Regression values, texts by languages; and whether a text has a letter."""
        out, seen = [np.empty((0, len(self.languages)))], np.zeros(len(texts), bool)
        present = np.zeros((rows, len(self.weights)), np.float32)
        for at in range(0, len(texts), rows):
            part = texts[at : at + rows]
            own, sizes = present[: len(part)], np.ones((len(part), 1))
            own[:] = 0
            for i, text in enumerate(part):
                codes = grams(text)
                columns, others = self.lookup(codes)
                own[i, columns] = 1
                sizes[i] = np.count_nonzero(own[i]) + len(np.unique(others))
                seen[at + i] = len(codes) > 0
            out.append(own @ self.weights / np.sqrt(np.maximum(sizes, 1)))
        return np.concatenate(out), seen

    def best(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Each text's language and score; `und` and 0 without a letter."""
        found, seen = self.score(texts)
        langs = [self.languages[k] if ok else UNKNOWN for k, ok in zip(found.argmax(axis=1), seen, strict=True)]
        return langs, np.where(seen, np.clip(found.max(axis=1), 0, 1), 0.0)


def solve(languages: list[str], sets: list[np.ndarray], labels: np.ndarray, landmarks: np.ndarray, ridge: float = RIDGE, rows: int = 256) -> Model:
    """sets: each sampled text's distinct n-grams; landmarks: places in sets.

    Kernels are counted from lists of the landmarks that hold an n-gram, and the normal equations are summed over batches
    of the sample, so no matrix of samples and n-grams is made.
    """
    known, column = np.unique(np.concatenate([sets[i] for i in landmarks]), return_inverse=True)
    owner = np.repeat(np.arange(len(landmarks)), [len(sets[i]) for i in landmarks])
    order = np.argsort(column, kind="stable")
    holders, starts = owner[order], np.searchsorted(column[order], np.arange(len(known) + 1))
    lookup = Lookup(known)
    root = np.sqrt([max(1, len(s)) for s in sets])

    def kernels(at: np.ndarray) -> np.ndarray:
        out = np.empty((len(at), len(landmarks)))
        for k, i in enumerate(at):
            columns = lookup(sets[i])[0]
            sizes = starts[columns + 1] - starts[columns]
            places = np.repeat(starts[columns] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            out[k] = np.bincount(holders[places], minlength=len(landmarks)) / (root[i] * root[landmarks])
        return out

    m = len(landmarks)
    square, targets = np.zeros((m, m)), np.zeros((m, len(languages)))
    for at in range(0, len(sets), rows):
        part = np.arange(at, min(at + rows, len(sets)))
        k = kernels(part)
        square += k.T @ k
        targets += k.T @ (labels[part][:, None] == np.arange(len(languages))[None, :])
    alpha = np.linalg.solve(square + ridge * len(sets) / m * kernels(landmarks) + 1e-8 * np.eye(m), targets) / root[landmarks][:, None]
    weights = np.zeros((len(known), len(languages)), np.float32)
    ends = np.cumsum([0, *(len(sets[i]) for i in landmarks)])
    for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):  # a landmark holds an n-gram once
        weights[column[a:b]] += alpha[k]
    return Model(languages, lookup, weights)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = [np.unique(grams(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64())), batch.column(2), batch.column(3)], names=["lang", "grams", "draw", "id"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS, model_bytes: int = MODEL_BYTES) -> Model | None:
    """A model from a bounded sample: `per_language` rows of each language of docs, drawn by a hash of id and text.

    Rows without text, letters or language, or with more than most_chars characters, are left aside. With more than
    most_rows / per_language languages each gets fewer rows, two at least; of more than most_rows / 2 languages the
    rarest aren't learnt. None if no row is left. The sample is drawn in two steps, by a threshold from the languages'
    counts and by rank, so a language with most of the rows doesn't meet in one task. Each language has as many landmarks
    as `landmarks` and a model of model_bytes allow; one landmark each beyond that is an error.
    """
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.col(id_col).cast("long").alias("id"))
    rows = rows.filter(F.col("lang").isNotNull() & (F.length("text") <= most_chars) & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_rows // 2)
    counts = {r["lang"]: r["count"] for r in counts.collect()}
    if not counts:
        return None
    per_language = max(2, min(per_language, most_rows // len(counts)))
    shares = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 3 * per_language / n)))))
    drawn = rows.withColumn("draw", F.xxhash64(F.col("id"), F.col("text"), F.lit("language"))).filter(F.pmod("draw", F.lit(1 << 30)) < shares[F.col("lang")] * (1 << 30))
    drawn = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))).filter(F.col("rank") <= per_language)
    found = drawn.select("lang", "text", "draw", "id").mapInArrow(tidied(_distinct), "lang string, grams array<long>, draw long, id long").toArrow()
    found = found.combine_chunks()
    names, draws, ids = (found[c].to_pylist() for c in ("lang", "draw", "id"))
    sets = [x.values.to_numpy() for x in found["grams"]]
    order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: (names[i], draws[i], ids[i] is None, ids[i] or 0))
    if not order:
        return None
    sets, names = [sets[i] for i in order], [names[i] for i in order]
    languages = sorted(set(names))
    labels = np.searchsorted(languages, names)
    while True:
        chosen = np.concatenate([np.flatnonzero(labels == k)[:landmarks] for k in range(len(languages))])
        if len(np.unique(np.concatenate([sets[i] for i in chosen]))) * (len(languages) * 4 + 8) <= model_bytes:
            return solve(languages, sets, labels, chosen)
        if landmarks == 1:
            raise ValueError(f"{len(languages)} languages make a model of more than {model_bytes} bytes")
        landmarks //= 2


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(id, *more, lang_pred, score): the best language and its regression value cut to 0 to 1.

    `und` with score 0 for a null text, one without letters, or no model; ties go to the language first in the alphabet.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # model_bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches):
            langs, scores = m.best(batch.column(1).to_pylist()) if m else ([UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["_id", *batch.schema.names[2:], "lang_pred", "score"])

    rows = documents(docs, id_col, text_col, *more)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    return rows.mapInArrow(tidied(run), f"{schema}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def _identified(model: Model | None, spark: SparkSession, least: float):
    """Whether a text is in one of the model's languages; without a model, whether it has a letter."""
    shared = ship(spark).sparkContext.broadcast(model)  # model_bytes at most

    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            out = []
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256].to_pylist()
                if m:
                    langs, scores = m.best(part)
                    out += [lang != UNKNOWN and score >= least for lang, score in zip(langs, scores, strict=True)]
                else:
                    out += [len(grams(t)) > 0 for t in part]
            yield pa.array(out, pa.bool_())
        give_back()

    return run


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST) -> DataFrame:
    """The documents, all columns, less those that aren't in any learnt language: null texts, texts without letters, and
    texts whose predicted language has a score below `least`.

    Learns from every labelled row; with no labelled row to learn from, letters alone decide.
    """
    model = fit(docs, id_col, text_col, lang_col)
    return docs.filter(_identified(model, docs.sparkSession, least)(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def held_out(id_col: Column) -> Column:
    """A null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every document, learnt from those that aren't held out.

    Repeated rows give repeated rows, null ids stay, an empty table gives no row; other columns are left aside.
    """
    key = F.col(id_col).cast("long")
    model = fit(docs.filter(~held_out(key)), id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col, held_out(key).alias("held_out"))
