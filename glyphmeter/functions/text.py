"""Text functions as Column expressions: white space, unit counts, splitting, normalisation.

White space is Python's: the 29 code points for which str.isspace() holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The body of a character class, understood alike by Java and RE2 regular expressions.
WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same for Java alone, which matches it four times as fast: Unicode's white space and four separators.
SPACE = r"\s\x1c-\x1f"
WS_RUN = f"(?U)[{SPACE}]+"
WORD = f"(?U)[^{SPACE}]+"
#: Runs of word characters, or of what is neither word nor white space.
PIECE = r"(?U)\w+|[^\w\s]+"
PUNCTUATION = '.,!?;:"()[]{}'
MIN_UNIT = 5


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^[{SPACE}]+|[{SPACE}]+\z", "")


def not_blank(text: Column) -> Column:
    """Whether there is any character but white space; the search ends at the first."""
    return text.isNotNull() & text.rlike(f"(?U)[^{SPACE}]")


def split_words(text: Column) -> Column:
    """The parts between runs of white space."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def split_spaces(text: Column) -> Column:
    """Every part between single spaces, empty ones too."""
    return F.split(text, " ", -1)


def split_regex(text: Column, pattern: str, keep_empty: bool = False) -> Column:
    """Parts between matches; blank parts go unless they are wanted.  Capture groups are rejected: engines differ on them."""
    if "(" in pattern.replace(r"\(", "").replace("(?:", "").replace("(?", "?:"):
        raise ValueError("capture groups split differently in different engines; use (?:...)")
    parts = F.split(text, pattern, -1)
    return parts if keep_empty else F.filter(parts, lambda x: strip(x) != "")


def pieces(text: Column) -> Column:
    """Words and runs of punctuation."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def byte_tokens(text: Column) -> Column:
    """Each byte of the UTF-8 text as two hexadecimal digits."""
    return F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))


def trigrams(text: Column) -> Column:
    """Consecutive runs of three characters; the last may be shorter."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,3}"), F.lit(0))


def count_lines(text: Column) -> Column:
    """Parts between line feeds."""
    return F.size(F.split(text, "\n", -1))


def marked_bytes(text: Column) -> Column:
    """Bytes of all pieces with one start mark (2 bytes as a character, 1 as counted) per piece."""
    return F.aggregate(pieces(text), F.lit(0), lambda acc, x: acc + F.octet_length(x) + 1)


class Unit(Enum):
    LINES = "lines"
    BYTES = "bytes"
    CHARACTERS = "characters"
    WORDS = "words"


class Splitter(Enum):
    WHITESPACE = "whitespace"
    PIECES = "pieces"
    PATTERN = "pattern"
    CUSTOM = "custom"


@dataclass(frozen=True)
class Normalization:
    """What one unit of text is: the denominator or numerator of ratios.

    lines counts every non-empty text as one unit; marked bytes are bytes of pieces with their start marks.
    """

    unit: Unit = Unit.BYTES
    splitter: Splitter = Splitter.WHITESPACE
    custom: str | None = None
    keep_empty: bool = False
    marked: bool = False

    def __post_init__(self) -> None:
        if self.splitter is Splitter.CUSTOM and not self.custom:
            raise ValueError("a custom splitter needs its pattern")
        if self.marked and self.unit is not Unit.BYTES:
            raise ValueError("only bytes can be marked")

    @classmethod
    def from_dict(cls, d: dict) -> Normalization:
        names = {"unit": Unit, "splitter": Splitter}
        return cls(**{k: names[k](v) if k in names else v for k, v in d.items()})

    def to_dict(self) -> dict:
        return {"unit": self.unit.value, "splitter": self.splitter.value, "custom": self.custom, "keep_empty": self.keep_empty, "marked": self.marked}

    def description(self) -> str:
        return {Unit.LINES: "line", Unit.BYTES: "byte", Unit.CHARACTERS: "char", Unit.WORDS: "word"}[self.unit]

    def parts(self, text: Column) -> Column:
        if self.splitter is Splitter.WHITESPACE:
            return split_spaces(text) if self.keep_empty else split_words(text)
        if self.splitter is Splitter.PIECES:
            return pieces(text)
        return split_regex(text, self.custom if self.splitter is Splitter.CUSTOM else WS_RUN, self.keep_empty)

    def count(self, text: Column) -> Column:
        """Units of a text; 0 for null and empty ones."""
        if self.unit is Unit.LINES:
            n = F.lit(1)
        elif self.unit is Unit.CHARACTERS:
            n = F.length(text)
        elif self.unit is Unit.BYTES:
            n = marked_bytes(text) if self.marked else F.octet_length(text)
        else:
            n = F.size(self.parts(text))
        return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(n).cast("bigint")


LINES = Normalization(Unit.LINES)
BYTES = Normalization(Unit.BYTES)
MARKED_BYTES = Normalization(Unit.BYTES, marked=True)
CHARACTERS = Normalization(Unit.CHARACTERS)
WORDS = Normalization(Unit.WORDS)
PIECES = Normalization(Unit.WORDS, Splitter.PIECES)
PATTERN_WORDS = Normalization(Unit.WORDS, Splitter.PATTERN)


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.array_join(split_words(text), " ")


def tidy(text: Column) -> Column:
    """Runs of spaces as one, no spaces around line feeds, no white space at the ends."""
    text = F.regexp_replace(text, " +", " ")
    text = F.regexp_replace(text, "\n +", "\n")
    return strip(F.regexp_replace(text, " +\n", "\n"))


def _long_enough(parts: Column, least: int) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: F.length(x) >= least)


def paragraphs(text: Column, least: int = MIN_UNIT) -> Column:
    """Parts between blank lines; none if there is no blank line."""
    return F.when(text.contains("\n\n"), _long_enough(F.split(text, "\n\n", -1), least)).otherwise(F.array().cast("array<string>"))


def lines(text: Column, least: int = MIN_UNIT) -> Column:
    return _long_enough(F.split(text, "\n", -1), least)


def sentences(text: Column, least: int = MIN_UNIT) -> Column:
    return _long_enough(F.split(text, rf"(?U)[.!?]+[{SPACE}]+", -1), least)


def chunks(text: Column, size: Column | int = 500, most: int = 100) -> Column:
    """Windows of `size` characters; the whole text if it is no longer."""
    size = F.lit(size) if isinstance(size, int) else size
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), size), lambda i: strip(F.substring(text, i, size)))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.slice(F.filter(cut, lambda x: x != ""), 1, most))


def extract_units(text: Column, most: int) -> Column:
    """Up to `most` units of a tidied text: its paragraphs, then lines and sentences that aren't there yet, or else chunks.

    Lines are taken too while there are fewer than `most`, sentences while there are fewer than `most` and 10.
    """
    blocks = paragraphs(text)
    with_lines = F.when(F.size(blocks) < most, F.concat(blocks, F.array_except(lines(text), blocks))).otherwise(blocks)
    short = (F.size(with_lines) < most) & (F.size(with_lines) < 10)
    with_sentences = F.when(short, F.concat(with_lines, F.array_except(sentences(text), with_lines))).otherwise(with_lines)
    width = F.least(F.lit(500), F.floor(F.length(text) / F.lit(max(1, most)))).cast("int")
    none = F.array().cast("array<string>")
    fallback = F.when((F.length(text) > MIN_UNIT) & (width > 0), chunks(text, F.greatest(width, F.lit(1)), most)).otherwise(none)
    return F.slice(F.when(F.size(with_sentences) > 0, with_sentences).otherwise(fallback), 1, most)


def safe_divide(n: Column, d: Column, default: float = 0.0) -> Column:
    return F.when(d == 0, F.lit(default)).otherwise(n / d)


def short_label(code: Column) -> Column:
    return F.split_part(code, F.lit("_"), F.lit(1))


def clean_marker(token: Column) -> Column:
    """A token without its word-start or continuation mark; '' for special tokens."""
    return (
        F.when(token.rlike(r"^[Ġ▁ ]"), F.substring(token, 2, 1 << 30))
        .when(token.startswith("##"), F.substring(token, 3, 1 << 30))
        .when(token.endswith("</w>"), F.regexp_replace(token, r"</w>\z", ""))
        .when(token.endswith("@@"), F.regexp_replace(token, r"@@\z", ""))
        .when(token.rlike(r"^(<\||\[).*(\|>|\])$"), F.lit(""))
        .otherwise(token)
    )


def clean_tokens(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, clean_marker), lambda x: x != "")


def strip_punctuation(word: Column) -> Column:
    return F.btrim(word, F.lit(PUNCTUATION))
