"""Column functions over text: normal forms, slugs, trigrams, hashes and ids."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Token estimate: code points per token.
CODE_POINTS_PER_TOKEN = 4
#: Default threshold of trigram similarity.
SIMILAR = 0.3

#: Letters that fold to two; fixed values.
LIGATURES = {"æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L"}


def accent_table() -> tuple[str, str]:
    """Accented Latin letters (up to U+017F) and the letters they decompose to."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@F.pandas_udf(StringType())
def _nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.str.normalize("NFKC")


def normalize(c: Column) -> Column:
    """NFKC, white space collapsed to single spaces, trimmed, lower-cased. Only texts beyond ASCII visit Python."""
    wide = c.rlike(r"[^\x00-\x7F]")
    plain = F.when(wide, _nfkc(F.when(wide, c))).otherwise(c)
    return F.lower(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def fold_accents(c: Column) -> Column:
    """Accented Latin letters and ligatures to plain ones. Only texts beyond ASCII are looked through."""
    folded = F.translate(c, *accent_table())
    for a, b in LIGATURES.items():
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def slug(c: Column) -> Column:
    """Lower case; runs outside [a-z0-9._-] become one dash; no dash at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")


def path_slug(parts: Column) -> Column:
    """Slugs of an array of headings, joined by two dashes, empty ones dropped."""
    return F.array_join(F.filter(F.transform(parts, slug), lambda s: s != ""), "--")


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / CODE_POINTS_PER_TOKEN)


def trigrams(c: Column) -> Column:
    """Distinct three-letter runs of the words of c, each word padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of the JSON of the fields by name; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based id, version 5."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def joined_lines(*parts: Column) -> Column:
    """Trimmed parts that are not empty, one a line."""
    return F.array_join(F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda s: s != ""), "\n")


def valid_date(c: Column) -> Column:
    """YYYY-MM-DD that is a day of the calendar."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), "yyyy-MM-dd") == c), F.lit(False))


def contains_any(term: Column, *columns: Column) -> Column:
    """Case-insensitive literal substring of any column."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lower(term)), F.lit(False))
    return out


def fixture_embedding(c: Column, dim: int) -> Column:
    """Deterministic stand-in vector: bytes of chained SHA-256 as b / 255 - 0.5."""
    rounds = -(-dim // 32)
    chain = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        F.struct(F.encode(c, "UTF-8").alias("b"), F.lit("").alias("h")),
        lambda s, _: F.struct(F.unhex(F.sha2(s["b"], 256)).alias("b"), F.concat(s["h"], F.sha2(s["b"], 256)).alias("h")),
        lambda s: s["h"],
    )
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(chain, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5)


def lexemes(c: Column) -> Column:
    """Lower-cased alphanumeric words in order, without the stop words."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


#: Fixed short list of English stop words.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]
