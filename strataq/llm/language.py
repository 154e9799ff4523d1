"""Operator 6: language identification by rank-order n-gram profiles."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.llm.common import bounded_batches, load, tidied

PROFILE = 400  # n-grams in a profile
PIECE = 1 << 20  # characters of a text that are counted at once
_LETTER: list = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the 1- to 3-grams of a text's words, in lower case, each word within blanks.

    A word is a run of letters. The blank alone is no n-gram. A key holds up to three code points of 21 bits, the
    first one highest, so keys sort as the n-grams do.
    """
    c = np.frombuffer(f" {text.lower()}  ".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[c]
    if not is_letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = np.where(is_letter, c, np.uint32(32)).astype(np.uint64)
    found = []
    for at in range(0, len(c) - 2, PIECE):
        n = min(PIECE, len(c) - 2 - at)
        x, y, z = c[at: at + n] << np.uint64(42), c[at + 1: at + n + 1] << np.uint64(21), c[at + 2: at + n + 2]
        a, b = is_letter[at: at + n], is_letter[at + 1: at + n + 1]
        xy = x | y
        found.append(_count(np.concatenate([x[a], xy[a | b], (xy | z)[b]])))
    return found[0] if len(found) == 1 else merge(found)


def _count(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.r_[at, len(keys)])


def merge(parts) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def top(keys: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent n-grams; equal counts by code point."""
    return keys[np.argsort(-counts, kind="stable")[:k]]


def train_profiles(docs: DataFrame, text_col: str, lang_col: str, k: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): the k most frequent n-grams of each language, counted over all given rows.

    Each task sends one row per language and n-gram (as a key, see gram_counts); the counts are
    summed and ranked per language over pre-aggregated rows.
    """
    def run(batches):
        held: dict[str, list] = defaultdict(list)
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                parts = held[lang]
                parts.append(gram_counts(text.as_py()))
                if len(parts) >= 256:
                    held[lang] = [merge(parts)]
            if sum(len(k) for parts in held.values() for k, _ in parts) > 2_000_000:
                yield from emit(held)
                held.clear()
        yield from emit(held)

    def emit(held):
        for lang, parts in held.items():
            keys, counts = merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col)
    counts = rows.mapInArrow(tidied(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).select("lang", "gram", "rank")


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             k: int = PROFILE, carry: dict[str, Column] | None = None, max_languages: int = 1000) -> DataFrame:
    """Per document: id, the `carry` columns, lang_pred and score.

    Profiles are learned from rows where `train` holds and text and language are not null. A document's k most frequent
    n-grams are compared with every profile by out-of-place distance: the sum of rank differences, k for an n-gram the
    profile lacks. The nearest profile wins, equal ones by name; score is one less the distance over its maximum.
    A text that is null or has no letter is "und" with score 0, as is every text when nothing could be learned. Repeated
    rows are judged each; extra columns are ignored. Profiles hold at most max_languages x k rows (else it raises)
    and are the only thing that is sent to all tasks. Very long texts are counted whole.
    """
    bounded_batches(docs.sparkSession)
    names = list(carry or {})
    profiles = train_profiles(docs.where(train), text_col, lang_col, k)
    found = profiles.limit(max_languages * k + 1).collect()  # bounded: k rows a language
    if len(found) > max_languages * k:
        raise ValueError("more languages than max_languages")
    langs = sorted({r[0] for r in found})
    vocabulary = np.unique(np.array([r[1] for r in found], np.uint64))
    ranks = np.full((len(vocabulary) + 1, len(langs)), -1, np.int32)  # the last row: an n-gram that no profile has
    for lang, gram, rank in found:
        ranks[np.searchsorted(vocabulary, np.uint64(gram)), langs.index(lang)] = rank - 1
    place = np.arange(k, dtype=np.int32)

    def run(batches):
        for b in batches:
            pred, score = [], []
            for text in b.column(b.num_columns - 1):
                keys, counts = gram_counts(text.as_py() or "")
                if not len(keys) or not langs:
                    pred.append("und"), score.append(0.0)
                    continue
                best = top(keys, counts, k)
                at = np.minimum(np.searchsorted(vocabulary, best), len(vocabulary) - 1)
                rows = ranks[np.where(vocabulary[at] == best, at, -1)]
                apart = np.where(rows < 0, k, np.abs(rows - place[: len(best), None])).sum(0)
                j = int(apart.argmin())
                pred.append(langs[j]), score.append(1.0 - float(apart[j]) / (k * len(best)))
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             [id_col, *names, "lang_pred", "score"])

    rows = docs.select(F.col(id_col), *[e.alias(n) for n, e in (carry or {}).items()], F.col(text_col).alias("__text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [id_col, *names]) + ", lang_pred string, score double"
    return rows.mapInArrow(tidied(run), schema)


def op6_language(spark, sf_dir):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return identify(load(spark, sf_dir, "documents"), ~F.coalesce(held, F.lit(False)), carry={"held_out": F.coalesce(held, F.lit(False))})


SQL = None  # tested by held-out accuracy and against a brute-force version
