"""Scalar functions on text: tokens, patterns, estimates."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    accented, plain = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and not unicodedata.combining(base[0]):
            accented.append(chr(code))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _folds()


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """The runs of letters and digits of a text, folded; none for a null."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def token_count(text: Column) -> Column:
    """How many tokens() gives."""
    return F.regexp_count(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"))


def python_tokens(text: str) -> list[str]:
    """What tokens() gives, on the driver."""
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower().translate(str.maketrans(ACCENTED, PLAIN)))


def trigrams(text: Column) -> Column:
    """The runs of three characters of a text in lower case; none if it is shorter."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """How often the words of phrase stand next to each other in an array of words."""
    k = len(phrase)
    if k == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0]))
    wanted = F.array(*(F.lit(w) for w in phrase))
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.when(F.array_contains(words, phrase[0]), F.size(F.filter(starts, lambda i: F.slice(words, i, F.lit(k)) == wanted))).otherwise(0)


def substring_count(text: Column, part: str) -> Column:
    """How often part is in text, overlaps counted."""
    quoted = "\\Q" + part.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.when(text.contains(part), F.regexp_count(text, F.lit(f"(?={quoted})"))).otherwise(0)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like(text: Column, pattern: str) -> Column:
    """LIKE that ignores the case of ASCII letters only and has no escape."""
    return F.translate(text, _UPPER, _LOWER).like(pattern.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def file_of(node_id: Column) -> Column:
    """What precedes the first colon of an id, if anything does; else null."""
    return F.when(F.instr(node_id, ":") > 1, F.substring_index(node_id, ":", 1))


def _any(chain: Column, *parts: str) -> Column:
    held = F.lit(False)
    for part in parts:
        held = held | chain.contains(part)
    return held


def side_effect(chain: Column) -> Column:
    """The kind of side effect that a call's chain of names tells of, or null; the first rule that fits decides."""
    reads = F.when(_any(chain, "find", "get", "query", "select"), "db_read").otherwise("db_write")
    return (
        F.when(_any(chain, "fs.", "readFile", "writeFile", "appendFile", "unlink", "mkdir"), F.when(chain.contains("read"), "file_read").otherwise("file_write"))
        .when(_any(chain, "fetch", "axios", "http.", "https."), "network")
        .when(_any(chain, "db.", "prisma.", "mongoose.", ".query", ".find", ".create", ".update", ".delete", ".save"), reads)
        .when(chain.contains("console."), "console")
        .when(_any(chain, "process.", "child_process"), "process")
        .when(_any(chain, "document.", "window.", "getElementById", "querySelector"), "dom")
        .when(_any(chain, "localStorage", "sessionStorage"), "storage")
    )
