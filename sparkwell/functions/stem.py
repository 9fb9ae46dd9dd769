"""Porter's stemmer for English (An algorithm for suffix stripping, 1980), over distinct lexemes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The suffixes of the paper's steps 2 to 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_LONGEST_FIRST = {name: re.compile(f"({'|'.join(sorted(suffixes, key=len, reverse=True))})$") for name, suffixes in (("2", STEP_2), ("3", STEP_3), ("4", STEP_4))}
_ENGLISH = re.compile(r"[a-z]{3,}\Z")
_MEASURE = re.compile("v+c+")
_CVC = re.compile("cvc$")


def shape(word: str) -> str:
    """v for vowels and c for consonants, letter by letter; y after a consonant is a vowel."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out[-1:] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return len(_MEASURE.findall(shape(stem)))


def _short_end(stem: str) -> bool:
    """Whether it ends consonant, vowel, consonant, the last of them not w, x or y."""
    return stem[-1:] not in ("w", "x", "y") and _CVC.search(shape(stem)) is not None


def _double_end(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c"


def _inflection(word: str) -> str:
    """Steps 1a to 1c: plurals, -ed, -ing and a final y."""
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if measure(word[:-3]):
            word = word[:-1]
    else:
        cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and "v" in shape(word[: -len(s)])), None)
        if cut is not None:
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double_end(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif measure(word) == 1 and _short_end(word):
                word += "e"
    return word[:-1] + "i" if word.endswith("y") and "v" in shape(word[:-1]) else word


def _derivation(word: str) -> str:
    """Steps 2 to 4: of the suffixes of a step the longest that the word has counts, whether or not its condition holds."""
    for name, table in (("2", STEP_2), ("3", STEP_3)):
        m = _LONGEST_FIRST[name].search(word)
        if m and measure(word[: m.start()]) > 0:
            word = word[: m.start()] + table[m[0]]
    m = _LONGEST_FIRST["4"].search(word)
    if m and measure(word[: m.start()]) > 1 and (m[0] != "ion" or word[: m.start()].endswith(("s", "t"))):
        word = word[: m.start()]
    return word


def _tidied(word: str) -> str:
    """Step 5: a final e, and a double l."""
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and those that are not all of a to z, stay as they are."""
    return _tidied(_derivation(_inflection(word))) if _ENGLISH.match(word) else word


def stem_table(lexemes: DataFrame) -> DataFrame:
    """(lexeme, stem) of the distinct lexemes of lexemes(lexeme); nulls are left out. Only distinct ones visit Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([stem(w) for w in words], pa.string())], names=["lexeme", "stem"])

    return lexemes.select("lexeme").where("lexeme IS NOT NULL").distinct().mapInArrow(run, "lexeme string, stem string")
