"""Language identification by mixture inference.

A document is read as a mixture of languages.  Features are byte trigrams of the
lower-cased text (everything that is no letter is one separator), hashed to
``BUCKETS`` buckets; a language is a smoothed distribution over buckets.
Expectation-maximisation estimates the document's language proportions, and the
set of languages is chosen by penalised log-likelihood: the single best language,
then its best two, three and so on (in the order of the full mixture's
proportions), each further language costing ``PENALTY * log(n-grams)``.  Languages of
equal likelihood or proportion come in the order of their names.

A text's evidence is the log-likelihood per n-gram of its chosen mixture less that of
noise, under which all buckets are equally likely.  Its plausibility puts this on a
scale on which noise has 0 (the expected evidence of equally likely buckets under the
language that fits them best) and the text of the learned languages 1 (their mean); both
follow from the model.  ``filter_language`` rejects by it, not by the largest share, so
texts in several languages stay, while random letters and languages that were not
learned go.

Learning uses labelled rows only.  Of each label at most about ``PER_LANGUAGE``
rows are used, chosen by a hash of the id, so the model costs the same at any
corpus size; the counts are summed in Spark and only (labels x buckets) numbers
reach the driver.  Prediction is one pass without a shuffle over whole texts.

A null text, or one without a letter, is ``und`` with score 0; so is every text
where nothing could be learned.  Repeated rows are judged one by one.  A label
that is null or blank is no label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import appended, numbered, position
from .words import LOWER, blocks, utf8

BUCKETS = 1 << 12
PER_LANGUAGE = 2_000
PENALTY = 8.0
ITERATIONS = 12
#: Documents counted at a time: a table of counts takes ROWS * BUCKETS numbers.
ROWS = 256
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: languages x buckets, each bucket divided by its largest value, and the logarithms of these.
    likelihood: np.ndarray
    log_largest: np.ndarray

    def levels(self) -> tuple[float, float]:
        """Expected evidence of noise, and of the learned languages' own text."""
        logs = np.log(self.likelihood) + self.log_largest
        return float(logs.mean(axis=1).max() + np.log(BUCKETS)), float((np.exp(logs) * logs).sum(axis=1).mean() + np.log(BUCKETS))


def bucket_counts(column) -> tuple[np.ndarray, np.ndarray]:
    """documents x BUCKETS trigram counts, and which documents hold an ASCII letter."""
    raw, at = utf8(column)
    n = len(at) - 1
    b = LOWER[raw]
    upper = np.zeros(len(b), dtype=bool)
    upper[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)  # Latin-1 capitals
    b = np.where(_LETTER[b], b + np.uint8(0x20) * upper, 0).astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(at))
    code = np.zeros(len(b) + 2, dtype=np.uint32)
    code[1:-1] = b
    gram = (code[:-2] << np.uint32(16)) | (code[1:-1] << np.uint32(8)) | code[2:]
    first = at[:-1][at[:-1] < at[1:]]
    gram[first] &= np.uint32(0x00FFFF)  # nothing of the document before
    last = at[1:][at[:-1] < at[1:]] - 1
    gram[last] &= np.uint32(0xFFFF00)
    used = b > 0
    key = (gram[used] * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    counts = np.bincount(doc[used] * BUCKETS + key, minlength=n * BUCKETS).reshape(n, BUCKETS)
    ascii_letter = np.bincount(doc[(b > 0) & (b < 0x80)], minlength=n) > 0
    return counts, ascii_letter


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in blocks(batch, "text", max_rows=ROWS):
            counts, _ = bucket_counts(part.column(1))
            names = np.array(part.column(0).to_pylist(), dtype=object)
            for name in set(names.tolist()):
                sums[name] = sums.get(name, 0) + counts[names == name].sum(axis=0)
    for name, c in sums.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "bucket", "n"])


def fit(rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """The model of labelled rows; about per_language rows of each label are read for n-grams."""
    labelled = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("trim(lang) <> '' and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model((), np.zeros((0, BUCKETS)), np.zeros(BUCKETS))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))]), F.col("lang"))
    chosen = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    counts = chosen.mapInArrow(_count_rows, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = tuple(sorted(sizes))
    table = np.full((len(names), BUCKETS), 0.5)
    table[[names.index(x) for x in counts["lang"]], counts["bucket"]] += counts["n"]
    table /= table.sum(axis=1, keepdims=True)
    return Model(names, table / table.max(axis=0), np.log(table.max(axis=0)))


def _em(counts: np.ndarray, likelihood: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) within the allowed sets, and log-likelihoods."""
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    total = counts.sum(axis=1, keepdims=True)
    for _ in range(ITERATIONS):
        pi = pi * ((counts / np.maximum(pi @ likelihood, 1e-300)) @ likelihood.T) / total
    return pi, (counts * np.log(np.maximum(pi @ likelihood, 1e-300))).sum(axis=1)


def infer(counts: np.ndarray, model: Model, penalty: float = PENALTY) -> np.ndarray:
    """Proportions of the chosen language set of each document (which has one n-gram at least)."""
    counts = counts.astype(np.float64)
    lik, k = model.likelihood, len(model.languages)
    alone = counts @ np.log(lik).T
    best = alone.argmax(axis=1)
    out = np.zeros((len(counts), k))
    out[np.arange(len(counts)), best] = 1.0
    if k == 1:
        return out
    cost = penalty * np.log1p(counts.sum(axis=1))
    pi, full = _em(counts, lik, np.ones((len(counts), k)))
    # No set of more languages explains more than the full mixture does.
    open_ = np.flatnonzero(full - alone.max(axis=1) > cost)
    if len(open_):
        c, cost, order = counts[open_], cost[open_], np.argsort(-pi[open_], axis=1)
        top, chosen = alone[open_].max(axis=1), out[open_]
        for size in range(2, k + 1):
            allowed = np.zeros((len(open_), k))
            np.put_along_axis(allowed, order[:, :size], 1.0, axis=1)
            own, value = _em(c, lik, allowed)
            better = value - (size - 1) * cost > top
            top = np.where(better, value - (size - 1) * cost, top)
            chosen[better] = own[better]
        out[open_] = chosen
    return out


def plausibility(counts: np.ndarray, model: Model, pi: np.ndarray) -> np.ndarray:
    """The evidence of each document's mixture on a scale from noise (0) to the learned languages' text (1)."""
    value = (counts * np.log(np.maximum(pi @ model.likelihood, 1e-300))).sum(axis=1) + counts @ model.log_largest
    noise, typical = model.levels()
    return (value / counts.sum(axis=1) + np.log(BUCKETS) - noise) / max(typical - noise, 1e-9)


def _predict(text: str, sent, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for batch in batches:
            for part in blocks(batch, text, max_rows=ROWS):
                column = part.column(part.schema.get_field_index(text))
                counts, letter = bucket_counts(column)
                for i in np.flatnonzero(~letter & (counts.sum(axis=1) > 0)).tolist():
                    letter[i] = any(c.isalpha() for c in column[i].as_py())
                known = np.flatnonzero(letter) if model.languages else np.zeros(0, np.int64)
                pi = np.zeros((len(counts), max(1, len(model.languages))))
                told = np.zeros(len(counts))
                if len(known):
                    pi[known] = infer(counts[known], model, penalty)
                    told[known] = plausibility(counts[known], model, pi[known])
                names = np.array([UNKNOWN] * len(counts), dtype=object)
                if len(known):
                    names[known] = np.array(model.languages, dtype=object)[pi[known].argmax(axis=1)]
                mix = [[{"lang": name, "share": float(x)} for name, x in zip(model.languages, row) if x > 0] for row in pi]
                yield appended(part, {"lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(np.minimum(pi.max(axis=1), 1.0)), "mixture": pa.array(mix, _MIX), "plausibility": pa.array(told)})

    return run


_MIX = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def _with_language(docs: DataFrame, text_col: str, model: Model, penalty: float) -> DataFrame:
    """Numbered columns of docs, then lang_pred, score, mixture and plausibility."""
    out = numbered(docs)
    extra = out.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "mixture": F.array().cast("array<struct<lang:string,share:double>>"), "plausibility": F.lit(0.0)})
    return out.mapInArrow(_predict(position(docs, text_col), docs.sparkSession.sparkContext.broadcast(model), penalty), extra.schema)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (its share), mixture (the chosen set with shares) and plausibility."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _with_language(chosen, "text", model, penalty).select(F.col("c0").alias("doc_id"), "lang_pred", "score", "mixture", "plausibility")


def filter_language(docs: DataFrame, model: Model, *, text_col: str = "text", languages: tuple[str, ...] | None = None, least_share: float = 0.5, least_plausibility: float = 0.25, penalty: float = PENALTY) -> DataFrame:
    """The columns of docs; documents go that have no language, less plausibility than least_plausibility, or less than
    least_share in the languages wanted (all learned ones, if none are named)."""
    out = _with_language(docs, text_col, model, penalty).where((F.col("lang_pred") != UNKNOWN) & (F.col("plausibility") >= least_plausibility))
    share = F.aggregate("mixture", F.lit(0.0), lambda s, m: s + F.when(m["lang"].isin(*(languages or model.languages)), m["share"]).otherwise(0.0))
    out = out.where(share >= least_share)
    return out.select(*[F.col(f"c{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
