"""The three places Python is unavoidable: fuzzy ratio, Porter stem, pluggable scorers. Arrow batches only."""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

_VOWELS = "aeiou"


def _is_cons(w: str, i: int) -> bool:
    if w[i] in _VOWELS:
        return False
    return w[i] != "y" or i == 0 or not _is_cons(w, i - 1)


def _measure(stem: str) -> int:
    """Number of vowel-consonant runs."""
    shape = "".join("c" if _is_cons(stem, i) else "v" for i in range(len(stem)))
    return sum(1 for a, b in zip(shape, shape[1:]) if a == "v" and b == "c")


def _has_vowel(stem: str) -> bool:
    return any(not _is_cons(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _is_cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) == 2:
        return not _is_cons(w, 0) and _is_cons(w, 1)
    return len(w) >= 3 and _is_cons(w, len(w) - 3) and not _is_cons(w, len(w) - 2) and _is_cons(w, len(w) - 1) and w[-1] not in "wxy"


# Suffix tables of the Porter algorithm with its common extensions.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
          ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
          ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
_IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
              "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
              "exceed": "exceed", "succeed": "succeed"}


def stem_word(word: str) -> str:
    w = word.lower()
    if w in _IRREGULAR:
        return _IRREGULAR[w]
    if len(w) <= 2:
        return w
    # plurals
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # past and progressive
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            base = w[:-len(suffix)]
            if w.endswith(suffix):
                if _has_vowel(base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w):
                        w = w if w[-1] in "lsz" else w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    # y to i after a consonant that is not the first letter
    if w.endswith("y") and len(w) > 2 and _is_cons(w, len(w) - 2):
        w = w[:-1] + "i"
    w = _table(w, _STEP2)
    if w.endswith("logi") and _measure(w[:-3]) > 0:
        w = w[:-1]
    w = _table(w, _STEP3)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[:-len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            w = base
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def _table(w: str, table) -> str:
    for suffix, put in sorted(table, key=lambda x: len(x[0]), reverse=True):
        if w.endswith(suffix):
            base = w[:-len(suffix)]
            if _measure(base) > 0:
                out = base + put
                return _table(out, table) if suffix == "alli" else out
            return w
    return w


@pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    """Porter stem; apply it to distinct words."""
    return words.map(lambda w: None if w is None else stem_word(w))


@pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff–Obershelp ratio; apply it to pairs nothing cheaper has decided."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def reaches(a: str, b: str, least: float, grams: Callable[[str], Counter]) -> bool:
    """Whether the Ratcliff–Obershelp ratio is `least` or more, without working it out where it cannot be.

    With M matched characters at most 2 (len(a) - M) + (len(b) - M) of a's character pairs fail to stand in b, as often as in a.
    """
    match = math.ceil(least * (len(a) + len(b)) / 2 - 1e-9)
    for x, y in ((a, b), (b, a)):
        need = len(x) - 1 - 2 * (len(x) - match) - (len(y) - match)
        if need > 0 and (grams(x) & grams(y)).total() < need:
            return False
    return SequenceMatcher(None, a, b).ratio() >= least


def fuzzy_reaches(least: float):
    """(a, b) -> whether `fuzzy_ratio` is `least` or more; most pairs are turned down by their counts of character pairs."""
    @pandas_udf(BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        grams = lru_cache(1024)(lambda s: Counter(zip(s, s[1:])))
        return pd.Series([None if x is None or y is None else reaches(x, y, least, grams) for x, y in zip(a, b)], dtype=object)
    return run


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.DataFrame], "pd.Series"], out: str = "score", length: str | None = None) -> DataFrame:
    """Apply a batch scorer (cross-encoder, embedding, …) to pair rows as Arrow batches.

    With `length`, rows of like size share a batch. Every row must get a finite score: a scorer that fails, returns
    another number of scores or a score that is not finite stops the job.
    """
    rows = pairs.sortWithinPartitions(length) if length else pairs

    def checked(pdf: pd.DataFrame) -> np.ndarray:
        scores = np.asarray(scorer(pdf), dtype="float64")
        if scores.shape != (len(pdf),) or not np.isfinite(scores).all():
            raise ValueError("a scorer must return one finite score per row")
        return scores

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: pd.Series(checked(pdf), index=pdf.index, dtype="float64")})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(out, DoubleType())]))
