"""Tokenizers, filters and similarity as column expressions; pandas UDFs only where the JVM has nothing."""

import unicodedata
from functools import cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once a row: a lambda computes what it names anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# tokenizers -> array<string>
def simple_tokens(text, min_length: int = 1) -> Column:
    """Lower case, split on anything but letters and digits, drop short ones; positions count kept tokens."""
    return F.filter(F.split(F.lower(_c(text)), "[^\\p{L}\\p{N}]+"), lambda t: F.length(t) >= max(1, min_length))


def _stem(t: Column) -> Column:
    n = F.length(t)
    return (F.when(t.endswith("ing") & (n > 5), F.left(t, n - 3))
            .when(t.endswith("ed") & (n > 4), F.left(t, n - 2))
            .when(t.endswith("s") & ~t.endswith("ss") & (n > 3), F.left(t, n - 1)).otherwise(t))


def stem_tokens(text, min_length: int = 1) -> Column:
    return F.transform(simple_tokens(text, min_length), _stem)


def ngram_tokens(text, k: int = 3) -> Column:
    def grams(s: Column) -> Column:
        n = F.length(s)
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return _let(F.lower(_c(text)), grams)


def keyword_token(text) -> Column:
    return F.array(F.trim(F.lower(_c(text))))


def whitespace_tokens(text) -> Column:
    return F.filter(F.split(_c(text), "\\s+"), lambda t: t != "")


# token filters
def lowercase(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def length_between(tokens: Column, low: int = 1, high: int = 1_000_000) -> Column:
    return F.filter(tokens, lambda t: F.length(t).between(low, high))


def trim_tokens(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, F.trim), lambda t: t != "")


def without(tokens: Column, stopwords) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stopwords))


_FOLD = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY")


def ascii_fold(text) -> Column:
    s = F.translate(_c(text), *_FOLD)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


@cache
def _accents() -> tuple[str, str]:
    """Every character that changes by itself when it is decomposed and its marks are dropped, and what is left; marks alone (nothing left) last."""
    pairs = []
    for c in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        a = chr(c)
        b = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", a) if unicodedata.category(x)[0] != "M"))
        if a != b:
            pairs.append((a, b))
    pairs.sort(key=lambda x: not x[1])
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_SYLLABLES = "".join(map(chr, range(0xAC00, 0xD7A4)))  # the blocks that Hangul letters compose to, 28 for each pair of a first and a second letter
_LETTERS = "(?:[\\u1100-\\u1112][\\u1161-\\u1175][\\u11a7-\\u11c2]?|[\\uac00-\\ud7a3][\\u11a7-\\u11c2])"


def _syllable(s: Column) -> Column:
    """The block of two or three Hangul letters, or of a block of two and a letter; anything else as it is."""
    at = lambda i: F.ascii(F.substring(s, i, 1))
    last = lambda i: F.greatest(at(i) - 0x11A7, F.lit(0))
    whole = lambda i: F.substring(F.lit(_SYLLABLES), i + 1, F.lit(1))
    return (F.when(F.length(s) == 1, s).when(at(1) < 0x1200, whole(((at(1) - 0x1100) * 21 + at(2) - 0x1161) * 28 + last(3)))
            .when((at(1) - 0xAC00) % 28 == 0, whole(at(1) - 0xAC00 + last(2))).otherwise(s))


def strip_accents(text) -> Column:
    """Drop the marks of all letters, which stay letters of their own: ß, æ, ø and ł have none. The result is composed (NFC)."""
    def composed(s: Column) -> Column:
        return F.when(s.rlike(_LETTERS), F.array_join(F.transform(F.regexp_extract_all(s, F.lit(f"(?s){_LETTERS}|."), F.lit(0)), _syllable), "")).otherwise(s)

    return _let(F.translate(_c(text), *_accents()), composed)


# similarity
def trigrams(text) -> Column:
    return _let(F.lower(_c(text)), lambda s: F.when(F.length(s) < 3, F.array(s)).otherwise(F.array_distinct(ngram_tokens(s, 3))))


def trigram_similarity(a, b) -> Column:
    """Dice coefficient of the distinct trigrams."""
    return _let(F.struct(trigrams(a).alias("x"), trigrams(b).alias("y")), lambda t: 2.0 * F.size(F.array_intersect(t["x"], t["y"])) / (F.size(t["x"]) + F.size(t["y"])))


def within_edits(a, b, edits: int, prefix: int = 0) -> Column:
    a, b = _c(a), _c(b)
    near = F.levenshtein(a, b) <= edits
    return near if not prefix else near & (F.left(a, F.lit(prefix)) == F.left(b, F.lit(prefix)))


@F.pandas_udf(Y.IntegerType())
def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(s, t):
        if s is None or t is None:
            return None
        rows = [list(range(len(t) + 1))]
        for i, x in enumerate(s, 1):
            row = [i]
            for j, y in enumerate(t, 1):
                best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
                if i > 1 and j > 1 and x == t[j - 2] and s[i - 2] == y:
                    best = min(best, rows[-2][j - 2] + 1)
                row.append(best)
            rows.append(row)
        return rows[-1][-1]

    return pd.Series([one(s, t) for s, t in zip(a, b)], dtype="Int32")


def _jaro(s: str, t: str) -> float:
    if s == t:
        return 1.0
    if not s or not t:
        return 0.0
    reach = max(0, max(len(s), len(t)) // 2 - 1)
    used, hit = [False] * len(t), []
    for i, x in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if not used[j] and t[j] == x:
                used[j] = True
                hit.append(x)
                break
    if not hit:
        return 0.0
    other = [y for y, u in zip(t, used) if u]
    swaps = sum(x != y for x, y in zip(hit, other)) / 2
    m = len(hit)
    return (m / len(s) + m / len(t) + (m - swaps) / m) / 3


@F.pandas_udf(Y.DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or t is None else _jaro(s, t) for s, t in zip(a, b)])


@F.pandas_udf(Y.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(s, t):
        if s is None or t is None:
            return None
        j, p = _jaro(s, t), 0
        while p < min(4, len(s), len(t)) and s[p] == t[p]:
            p += 1
        return j + p * 0.1 * (1 - j)

    return pd.Series([one(s, t) for s, t in zip(a, b)])


def soundex(text) -> Column:
    return F.soundex(_c(text))


# highlighting
def highlight(text, terms: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    import re

    pattern = "(?i)(?<![\\p{L}\\p{N}])(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + ")(?![\\p{L}\\p{N}])"
    return F.regexp_replace(_c(text), pattern, f"{before}$1{after}")


def fragments(text, terms: list[str], context: int = 40, most: int = 3) -> Column:
    """Up to `most` pieces of text about matches, with `context` characters on either side."""
    import re

    pattern = "(?is).{0,%d}(?<![\\p{L}\\p{N}])(?:%s)(?![\\p{L}\\p{N}]).{0,%d}" % (context, "|".join(re.escape(t) for t in terms), context)
    return F.slice(F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(0)), 1, most)


_VOWELS = set("aeiouy")


def _porter2(w: str) -> str:
    """The English Snowball stemmer's steps, from its published description."""
    special = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
               "early": "earli", "only": "onli", "singly": "singl"}
    same = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
    if len(w) <= 2 or w in same:
        return w
    if w in special:
        return special[w]
    w = w.lstrip("'")
    chars = list(w)
    for i, c in enumerate(chars):
        if c == "y" and (i == 0 or chars[i - 1] in _VOWELS):
            chars[i] = "Y"
    w = "".join(chars)

    def region(s: str, start: int) -> int:
        i = start
        while i < len(s) and s[i] not in _VOWELS:
            i += 1
        while i < len(s) and s[i] in _VOWELS:
            i += 1
        return min(len(s), i + 1)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = region(w, 0) if r1 is None else r1
    r2 = region(w, r1)

    def short_end(s: str) -> bool:
        if len(s) == 2:
            return s[0] in _VOWELS and s[1] not in _VOWELS
        return len(s) >= 3 and s[-3] not in _VOWELS and s[-2] in _VOWELS and s[-1] not in _VOWELS and s[-1] not in "wxY"

    for suf in ("'s'", "'s", "'"):
        if w.endswith(suf):
            w = w[: -len(suf)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    for suf in ("eedly", "eed"):
        if w.endswith(suf):
            if len(w) - len(suf) >= r1:
                w = w[: -len(suf)] + "ee"
            break
    else:
        for suf in ("ingly", "edly", "ing", "ed"):
            if w.endswith(suf):
                stem = w[: -len(suf)]
                if any(c in _VOWELS for c in stem):
                    w = stem
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
                        w = w[:-1]
                    elif r1 >= len(w) and short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for suf, rep in (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
                     ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
                     ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")):
        if w.endswith(suf):
            if len(w) - len(suf) >= r1 and (suf != "ogi" or w[-4:-3] == "l") and (suf != "li" or w[-3:-2] in set("cdeghkmnrt")):
                w = w[: -len(suf)] + rep
            break
    for suf, rep in (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")):
        if w.endswith(suf):
            at = len(w) - len(suf)
            if at >= r1 and (suf != "ative" or at >= r2):
                w = w[:at] + rep
            break
    for suf in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"):
        if w.endswith(suf):
            at = len(w) - len(suf)
            if at >= r2 and (suf != "ion" or w[at - 1: at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.arrow_udf(Y.ArrayType(Y.StringType()))
def snowball_tokens(tokens: pa.Array) -> pa.Array:
    """Stems of arrays of tokens. Only a batch's different tokens become Python strings; the arrays stay in Arrow's buffers."""
    words = tokens.flatten().dictionary_encode()
    stems = pa.array([None if w is None else _porter2(w) for w in words.dictionary.to_pylist()], pa.string())
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    ends = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(ends, stems.take(words.indices), mask=tokens.is_null())
