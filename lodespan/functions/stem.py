"""Stop words and stemming of query words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodespan.session import make_importable

LANGUAGES = {"en": "english", "es": "spanish", "fr": "french", "de": "german", "pt": "portuguese", "it": "italian", "nl": "dutch"}

#: Common English function words.
ENGLISH = """
a about above after again against all am an and any are as at be because been before being below between both but by
can did do does doing don down during each few for from further had has have having he her here hers herself him himself
his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours
ourselves out over own same she should so some such than that the their theirs them themselves then there these they
this those through to too under until up very was we were what when where which while who whom why will with you your
yours yourself yourselves
""".split()


def stop_words() -> dict[str, list[str]]:
    return {"en": ENGLISH}


def spark_stop_words() -> dict[str, list[str]]:
    """Spark's own lists for all seven languages; needs a running session."""
    from pyspark.ml.feature import StopWordsRemover

    return {code: StopWordsRemover.loadDefaultStopWords(name) for code, name in LANGUAGES.items()}


# ---- English, by the published rules of the second Porter stemmer

_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = set("cdeghkmnrt")
#: Words with stems of their own, and words that stay once step 1a is done.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_STAY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Endings and what they become in steps 2, 3 and 4.
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(word: str) -> tuple[int, int]:
    """Where the parts after the first, and after the second, consonant that follows a vowel begin."""

    def after(start: int) -> int:
        found = re.compile(f"[{_VOWEL}][^{_VOWEL}]").search(word, start)
        return found.end() if found else len(word)

    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    first = after(0) if first is None else first
    return first, after(first)


def _short_end(word: str) -> bool:
    return bool(re.search(f"[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]$", word)) or bool(re.fullmatch(f"[{_VOWEL}][^{_VOWEL}]", word))


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.replace("’", "'").lstrip("'")
    if word in _SPECIAL:
        return _SPECIAL[word]
    word = re.sub(f"(^|[{_VOWEL}])y", r"\1Y", word)
    r1, r2 = _regions(word)
    word = re.sub("('s'|'s|')$", "", word)
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_VOWEL}]", word[:-2]):
        word = word[:-1]
    if word in _STAY:
        return word
    # 1b
    if found := re.search("(eedly|eed)$", word):
        if found.start() >= r1:
            word = word[: found.start()] + "ee"
    elif (found := re.search("(ingly|edly|ing|ed)$", word)) and re.search(f"[{_VOWEL}]", word[: found.start()]):
        word = word[: found.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLE):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    # 2
    for ending, new in _STEP2.items():
        if word.endswith(ending):
            if len(word) - len(ending) >= r1:
                word = word[: -len(ending)] + new
            break
    else:
        if word.endswith("ogi"):
            if len(word) - 3 >= r1 and word[-4:-3] == "l":
                word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in _LI:
            word = word[:-2]
    # 3
    for ending, new in _STEP3.items():
        if word.endswith(ending):
            if len(word) - len(ending) >= r1:
                word = word[: -len(ending)] + new
            break
    else:
        if word.endswith("ative") and len(word) - 5 >= r2:
            word = word[:-5]
    # 4
    for ending in _STEP4:
        if word.endswith(ending):
            if len(word) - len(ending) >= r2:
                word = word[: -len(ending)]
            break
    else:
        if word.endswith(("sion", "tion")) and len(word) - 3 >= r2:
            word = word[:-3]
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


#: Stemmers by language; a language without one keeps its words, an unknown one is treated as English.
STEMMERS = {"en": english} | {code: str for code in LANGUAGES if code != "en"}


def stemmed(df: DataFrame, words: str, language: str, made: str) -> DataFrame:
    """df with the column `made`: the stems of the array `words`, joined by a space."""
    make_importable(df.sparkSession)
    names = [c for c in df.columns if c != made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, codes = batch.column(words).to_pylist(), batch.column(language).to_pylist()
            values = [None if x is None else " ".join(map(STEMMERS.get(code, english), x)) for x, code in zip(lists, codes, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values, pa.string())], [*names, made])

    return df.mapInArrow(run, T.StructType([df.schema[n] for n in names] + [T.StructField(made, T.StringType())]))
