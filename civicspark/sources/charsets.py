"""Charsets of single lines: UTF-8 where the bytes are valid, else the single-byte charset whose letters fit them best."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters beyond ASCII by how usual they are in the languages written with a charset, most usual first.
USUAL_LETTERS = {
    "windows-1252": ["éüä", "èàöáíóñç", "êúßãåøëâôæîÉÜÄÖ", "õòùïûìœÁÀÇÈÊÍÑÓÚÅØÆŠšŽž"],
    "windows-1250": ["íěšřłč", "žýąáężő", "ůśćńťďűóéŁŚŻČŠŘŽ", "ňăźľţşäöüÁÍÝĆŹĎŤÉÓ"],
}
CYRILLIC = {"ISO-8859-5", "windows-1251", "KOI8-R"}
CHARSETS = ("windows-1252", "windows-1250", "ISO-8859-5")


def _upper_half(charset: str) -> list[tuple[str, str]]:
    """(Latin-1 character, character in the charset) of the bytes 0x80 to 0xFF that the charset defines."""
    return [(chr(b), t) for b in range(0x80, 0x100) if (t := bytes([b]).decode(charset, "ignore"))]


def decode_single_byte(raw: Column, charset: str) -> Column:
    """Text of a single-byte charset that agrees with ASCII below 0x80; bytes it does not define stay the controls of Latin-1."""
    moved = [(a, t) for a, t in _upper_half(charset) if a != t]
    latin = F.decode(raw, "ISO-8859-1")
    return F.translate(latin, "".join(a for a, _ in moved), "".join(t for _, t in moved)) if moved else latin


def encode_single_byte(text: Column, charset: str) -> Column:
    """Bytes of a text in a single-byte charset; characters it does not have become question marks."""
    moved = [(a, t) for a, t in _upper_half(charset) if a != t]
    latin = F.translate(text, "".join(t for _, t in moved), "".join(a for a, _ in moved)) if moved else text
    return F.encode(latin, "ISO-8859-1")


def fitness(raw: Column, charset: str) -> Column:
    """How well bytes look like text of the charset: usual letters count for it, bytes that are no letters against it.

    In a Cyrillic charset words are runs of high bytes, in the others high bytes stand among ASCII letters: what stands
    otherwise counts against the charset too.
    """
    latin = F.decode(raw, "ISO-8859-1")
    pairs = _upper_half(charset)

    def count(chars: str) -> Column:
        return F.length(latin) - F.length(F.translate(latin, chars, ""))

    def runs(pattern: str) -> Column:
        return F.length(latin) - F.length(F.regexp_replace(latin, pattern, ""))

    others = "".join(chr(b) for b in range(0x80, 0x100) if not bytes([b]).decode(charset, "ignore").isalpha())
    score = [F.lit(-3) * count(others)]
    if charset in CYRILLIC:
        score += [F.lit(2) * runs("[\u0080-ÿ]{3,}"), F.lit(-4) * runs("(?<=[A-Za-z])[\u0080-ÿ]|[\u0080-ÿ](?=[A-Za-z])")]
    else:
        for weight, letters in zip((4, 3, 2, 1), USUAL_LETTERS.get(charset, []), strict=False):
            score.append(F.lit(weight) * count("".join(a for a, t in pairs if t in letters)))
        score.append(-runs("[\u0080-ÿ]{3,}"))
    return reduce(add, score)


def decoded(raw: Column, charsets: Sequence[str] = CHARSETS) -> Column:
    """The text of one line's bytes; of charsets that fit alike the first is taken. No line is lost, NULL stays NULL."""
    text = raw.cast("string")
    if len(charsets) == 1:
        return F.when(F.is_valid_utf8(text), text).otherwise(decode_single_byte(raw, charsets[0]))
    scores = [fitness(raw, c) for c in charsets]
    best = F.greatest(*scores)
    guess = F.coalesce(*[F.when(s == best, decode_single_byte(raw, c)) for s, c in zip(scores, charsets, strict=True)])
    return F.when(F.is_valid_utf8(text), text).otherwise(guess)


def decode_lines(lines: DataFrame, col: str = "value", charsets: Sequence[str] = CHARSETS) -> DataFrame:
    """Decode each line by itself."""
    return lines.withColumn(col, decoded(F.col(col).cast("binary"), charsets))
