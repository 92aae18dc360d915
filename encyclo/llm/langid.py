"""Language identification of mixed-language text.

Every word is scored under each learned language by its character trigrams
(naive Bayes, trigrams hashed into ``BUCKETS``).  The script of its first
letter narrows the candidates to the languages that use this script in
training.  Viterbi over the words, with a penalty for each switch of
language, labels the text; runs of one label are its spans, the language with
most letters is the document's, and its share of the letters the score.

The model is a table of languages x BUCKETS numbers, whatever the corpus size:
the tasks add up their counts, Spark sums them by (language, bucket), and only
the sums reach the driver.

A text that is null or has no letters is ``und`` with score 0 and no spans; so
is every text when nothing was learned.  Equal shares go to the first language
by name.  Rows without a language, or with an empty text, teach nothing.
Repeated rows each count and each get their row.  Columns whose names clash
with the new ones are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, slices

BUCKETS = 1 << 16
SWITCH_PENALTY = 12.0
SLICE_BYTES = 2 << 20  # of text at once: as words and scores it takes some thirty times that, in every worker
SCRIPT_SHARE = 0.001  # of a language's words, for the script to be one of its own
UNKNOWN = "und"

# First code points of Unicode script ranges, with the script.
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"),
    (0x3190, "Other"), (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})

_WORD = re.compile(r"[^\W\d_]+")


def words_of(col: pa.Array):
    """Distinct words of a batch, the words of all texts as numbers, and each text's offset."""
    number: dict[str, int] = {}
    texts = pc.fill_null(col, "").to_pylist()
    found = [_WORD.findall(t.lower()) for t in texts]
    off = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
    codes = np.fromiter((number.setdefault(w, len(number)) for f in found for w in f), np.int64, int(off[-1]))
    words = list(number)
    # the pattern lets through a few signs that are no letters
    lettered = np.fromiter((w.isalpha() or any(c.isalpha() for c in w) for w in words), bool, len(words))
    if not lettered.all():
        ok = lettered[codes]
        off = np.concatenate([[0], np.cumsum(ok)])[off]
        codes = codes[ok]
    return words, codes, off


def features(words: list[str]):
    """Trigram buckets of all words, each word's offset, and its script."""
    text = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size
    mid = np.flatnonzero(text != 0x20)
    h = text[mid - 1] * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29)) ^ text[mid]) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32)) ^ text[mid + 1]) * np.uint64(0x94D049BB133111EB)
    first = np.array([a for a, _ in SCRIPT_RANGES], dtype=np.uint64)
    script_of = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])
    script = script_of[np.searchsorted(first, text[start], side="right") - 1]
    return (h >> np.uint64(48)).astype(np.int64) % BUCKETS, np.cumsum(size) - size, size, script


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # [BUCKETS, languages]
    uses_script: np.ndarray  # [scripts, languages]
    penalty: float = SWITCH_PENALTY


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model of all rows of ``docs`` that have a language."""
    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, SLICE_BYTES):
            words, codes, off = words_of(batch.column(0))
            if not len(codes):
                continue
            bucket, at, size, script = features(words)
            lang = pc.dictionary_encode(batch.column(1))
            names = lang.dictionary.to_pylist()
            row_lang = np.repeat(lang.indices.to_numpy(), np.diff(off))
            for k, name in enumerate(names):
                times = np.bincount(codes[row_lang == k], minlength=len(words))
                sums = total.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS)))
                sums[:BUCKETS] += np.bincount(bucket, weights=np.repeat(times, size), minlength=BUCKETS)
                sums[BUCKETS:] += np.bincount(script, weights=times, minlength=len(SCRIPTS))
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(sums[at].astype(np.int64))],
                names=["lang", "bucket", "n"])

    counts = (docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
              .select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
              .mapInArrow(count, "lang string, bucket long, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(counts["lang"].unique())
    sums = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    sums[counts["bucket"].to_numpy(np.int64), np.searchsorted(languages, counts["lang"]) if languages else []] = counts["n"]
    grams, scripts = sums[:BUCKETS], sums[BUCKETS:]
    log_prob = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(languages, log_prob, scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log probability of each word under each language; out of script is out of reach."""
    bucket, at, _, script = features(words)
    scores = np.add.reduceat(model.log_prob[bucket], at, axis=0)
    allowed = model.uses_script[script]
    allowed[~allowed.any(axis=1)] = True
    return np.where(allowed, scores, scores.min(axis=1, keepdims=True) - np.float32(1e4))


def viterbi(scores: np.ndarray, codes: np.ndarray, off: np.ndarray, penalty: float) -> np.ndarray:
    """Label of every word; texts of similar length go through the steps together."""
    labels = np.zeros(len(codes), dtype=np.int64)
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    at = 0
    while at < len(order):
        longest = size[order[at]]
        rows = order[at:at + max(1, int(400_000 // longest))]
        at += len(rows)
        active = np.searchsorted(-size[rows], -np.arange(1, longest + 1), side="right")
        best = scores[codes[off[rows]]].copy()
        n_lang = best.shape[1]
        own = np.arange(n_lang, dtype=np.int16)
        back = []
        for t in range(1, longest):
            a = active[t]
            v = best[:a]
            top = v.argmax(axis=1)
            jump = (v[np.arange(a), top] - penalty)[:, None]
            back.append(np.where(v >= jump, own, top[:, None].astype(np.int16)))
            best[:a] = np.maximum(v, jump) + scores[codes[off[rows[:a]] + t]]
        now = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            a = active[t]
            labels[off[rows[:a]] + t] = now[:a]
            if t:
                now[:a] = back[t - 1][np.arange(a), now[:a]]
    return labels


RESULT = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("lang", T.StringType())])))])


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` plus lang_pred, score and spans (ranges of words, with their language)."""
    # languages x BUCKETS numbers; plain values, since a broadcast class needs the package on the workers
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_prob, model.uses_script, model.penalty))

    def run(batch):
        m = Model(*shared.value)
        words, codes, off = words_of(batch.column(batch.schema.get_field_index(text_col)))
        n = batch.num_rows
        if not m.languages or not len(codes):
            return {"lang_pred": [UNKNOWN] * n, "score": [0.0] * n, "spans": [[]] * n}
        labels = viterbi(word_scores(words, m), codes, off, m.penalty)
        letters = np.fromiter(map(len, words), np.int64, len(words))[codes]
        row = np.repeat(np.arange(n), np.diff(off))
        share = np.bincount(row * len(m.languages) + labels, weights=letters,
                            minlength=n * len(m.languages)).reshape(n, -1)
        top, total = share.argmax(axis=1), share.sum(axis=1)
        new = np.ones(len(codes), dtype=bool)
        new[1:] = (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(codes))
        base = off[row[begin]]
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(row[begin], np.arange(n + 1)).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32)),
                                        pa.array([m.languages[k] for k in labels[begin]], pa.string())],
                                       names=["start", "end", "lang"]))
        return {"lang_pred": [m.languages[k] if t else UNKNOWN for k, t in zip(top, total)],
                "score": np.where(total > 0, share.max(axis=1) / np.maximum(total, 1), 0.0), "spans": spans}

    return map_batches(docs, run, RESULT, keep, SLICE_BYTES)
