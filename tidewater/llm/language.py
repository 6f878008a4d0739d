"""Language identification with a blended-spectrum string kernel.

A text's features are the n-grams (1 to 3 bytes of its lower-cased letters) that occur in it; the
kernel of two texts is the number of n-grams they share over the root of the product of their
numbers. Landmark texts give a Nyström approximation, and one-versus-rest kernel ridge regression
on the training texts gives one function per language. Whole texts are scored in batches: a
presence matrix times the landmarks' presence matrix, times the coefficients.

The classifier is fitted on at most `sample` labelled rows, chosen by a hash of the id, languages
in turn; what goes to the tasks is bounded by the landmarks. Scoring is one pass without a shuffle.

Defined results: a null text or one without a letter is `und` with score 0; without any labelled
row all texts are `und`; equal texts get equal results; ties go to the first language by code point;
a null id is not held out and not learned from; a very long text is one block, of some 30 bytes of
memory a byte; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.llm.blocks import row_blocks, texts
from tidewater.llm.storage import bounded

#: ASCII other than a-z is a space: only letters (and all bytes beyond ASCII) tell languages apart.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LENGTHS = (1, 2, 3)
BATCH = 128
UNDETERMINED = "und"
#: Hexadecimal digits of the hash whose values are counted to find a language's first rows.
BIN = 3
#: Score under which a text is taken to be of none of the learned languages.
LEAST = 0.2
_LETTER = regex.compile(r"\p{L}")


def has_letter(raw: bytes) -> bool:
    return bool(_LETTER.search(raw.decode()))


def presence(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text, text after texts, as (text number, gram code)."""
    folded = [b" %b " % x.decode().lower().encode().translate(LETTERS) for x in raw]
    sizes = np.array([len(x) for x in folded], np.int64)
    b = np.frombuffer(b"".join(folded), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(raw), dtype=np.int64), sizes)
    keys, code = [], np.zeros(len(b), np.int64)
    for n in range(1, max(LENGTHS) + 1):
        code = (code[: len(b) - n + 1] << 8) | b[n - 1 :]
        if n in LENGTHS:
            inside = owner[: len(code)] == owner[n - 1 :]
            keys.append(((owner[: len(code)] << 26) | (n << 24) | code)[inside])
    every = np.sort(np.concatenate(keys))
    distinct = every[np.concatenate(([True], every[1:] != every[:-1]))]
    return distinct >> 26, distinct & (1 << 26) - 1


@dataclass
class Classifier:
    """Landmarks and coefficients; langs in code-point order, a column of coefficients each."""

    langs: list[str]
    grams: np.ndarray
    landmarks: np.ndarray
    norms: np.ndarray
    alpha: np.ndarray

    @classmethod
    def fit(cls, raw: list[bytes], langs: list[str], landmarks: int, ridge: float) -> Classifier:
        names = sorted(set(langs))
        chosen = np.arange(min(landmarks, len(raw)))
        text, code = presence([raw[i] for i in chosen])
        grams = np.unique(code)
        own = np.zeros((len(chosen), len(grams)), np.float32)
        own[text, np.searchsorted(grams, code)] = 1
        model = cls(names, grams, own, np.sqrt(np.bincount(text, minlength=len(chosen))), np.zeros((len(chosen), len(names))))
        k_nm = np.concatenate([model.kernel(raw[i : i + BATCH]) for i in range(0, len(raw), BATCH)])
        y = (np.array(langs)[:, None] == np.array(names)[None, :]).astype(float)
        weight = 1 / np.maximum(y.sum(0), 1)
        each = (y * weight).sum(1) * len(raw) / len(names)
        k_mm = k_nm[chosen]
        left = (k_nm * each[:, None]).T @ k_nm + ridge * len(raw) / len(chosen) * k_mm + 1e-6 * np.eye(len(chosen))
        model.alpha = np.linalg.solve(left, (k_nm * each[:, None]).T @ y)
        return model

    def kernel(self, raw: list[bytes]) -> np.ndarray:
        """Kernel values of texts (rows) with landmarks (columns)."""
        text, code = presence(raw)
        size = np.sqrt(np.bincount(text, minlength=len(raw)))
        at = np.searchsorted(self.grams, code)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == code[known]
        here = np.zeros((len(raw), len(self.grams)), np.float32)
        here[text[known], at[known]] = 1
        return (here @ self.landmarks.T).astype(float) / (size[:, None] * self.norms[None, :])

    def predict(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        f = self.kernel(raw) @ self.alpha
        return f.argmax(1), np.clip(f.max(1), 0, 1)


def training_sample(labelled: DataFrame, sample: int) -> DataFrame:
    """At most `sample` rows of (doc_id, text, lang), languages in turn, in order of a hash. Counts by
    language and the hash's first BIN digits tell which bins hold a language's first `sample` rows;
    only those are ordered, so that a language of most rows is not one task's."""
    key = F.md5(F.col("doc_id").cast("string"))
    keyed = labelled.select("doc_id", "lang", key.alias("_key"), F.substring(key, 1, BIN).alias("_bin"))
    counts = keyed.groupBy("lang", "_bin").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("lang").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = counts.select("lang", "_bin", before.alias("_before")).where(F.col("_before") < sample).select("lang", "_bin")
    # A language has 16 ** BIN bins at most.
    near = keyed.join(F.broadcast(bins), ["lang", "_bin"])
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("_key", "doc_id"))
    ids = near.withColumn("_turn", turn).where(F.col("_turn") <= sample)
    ids = ids.orderBy("_turn", "lang", "doc_id").limit(sample).select("doc_id", "lang", "_turn")
    # At most `sample` narrow rows: the side that is broadcast is bounded.
    return labelled.select("doc_id", "text", "lang").join(F.broadcast(ids), ["doc_id", "lang"]).orderBy("_turn", "lang", "doc_id").limit(sample).drop("_turn")


def fit(labelled: DataFrame, sample: int = 1600, landmarks: int = 160, ridge: float = 1e-3) -> Classifier | None:
    """A classifier from labelled rows (doc_id, text, lang); None if there are none with a letter."""
    usable = labelled.where(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    rows = training_sample(usable, sample).collect()
    if not rows:
        return None
    return Classifier.fit([r["text"].encode() for r in rows], [r["lang"] for r in rows], landmarks, ridge)


def _label(model: Classifier | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in row_blocks(batch, "text", 256 << 10):
                raw = texts(block.column(1))
                lang, score = [UNDETERMINED] * len(raw), [0.0] * len(raw)
                judged = [i for i, x in enumerate(raw) if has_letter(x)] if model else []
                for at in range(0, len(judged), BATCH):
                    part = judged[at : at + BATCH]
                    for i, best, s in zip(part, *model.predict([raw[i] for i in part])):
                        lang[i], score[i] = model.langs[best], float(s)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["key", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Classifier | None, keys: Column | str = "doc_id") -> DataFrame:
    """One row per document: key, lang_pred and score, from the text alone."""
    key = F.col(keys) if isinstance(keys, str) else keys
    narrow = bounded(docs).select(key.cast("long").alias("key"), "text")
    return narrow.mapInArrow(_label(model), "key long, lang_pred string, score double")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the id falls into the held-out part; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def keep_identified(docs: DataFrame, model: Classifier | None, languages: Sequence[str] | None = None, least: float = LEAST) -> DataFrame:
    """The documents, with all their columns, that are predicted to be of one of `languages` (None: of
    any learned one) with a score of `least`. Without a model, those that have a letter."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = _label(model)
        at = columns.index("text")
        for batch in batches:
            if model is None:
                yield batch.filter(pa.array([has_letter(x) for x in texts(batch.column(at))], pa.bool_()))
                continue
            narrow = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], ["key", "text"])
            rows = [x for b in label(iter([narrow])) for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least and (languages is None or lang in languages) for lang, score in rows], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)
