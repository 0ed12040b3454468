"""Text expressions. Patterns name their character classes, so that Java and RE2 read them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line ends as Python's str methods and \s have them.
SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
NOT_SPACE = SPACE.replace("[", "[^", 1)
#: The same classes for Java, with a cheap range first: a class of many ranges is tried range by range on every character.
FAST_SPACE, FAST_NOT_SPACE = f"[[^!-~]&&{SPACE}]", f"[!-~{NOT_SPACE}]"
LINE_END = r"\r\n|[\n-\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: Single signs of a line end, a cheap range first; both halves of a CR LF match, with an empty line between.
FAST_LINE_END = r"[[^ -~]&&[\n-\r\x1C-\x1E\x{85}\x{2028}\x{2029}]]"
NOT_LINE_END = r"[^\n-\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
#: A word of letters, digits, apostrophes and hyphens.
WORD = r"[\p{L}\p{N}_'-]*[\p{L}\p{N}_][\p{L}\p{N}_'-]*"
#: The same words, for engines with possessive repetition.
WORD_RUN = r"['-]*+[\p{L}\p{N}_][\p{L}\p{N}_'-]*+"
#: What lies between such words.
_BETWEEN = r"(?:[^\p{L}\p{N}_'-]|['-]++(?![\p{L}\p{N}_]))*+"
LATIN_WORD = "[A-Za-z][A-Za-z'-]+"
LATIN_WORD_OR_LETTER = "[A-Za-z][A-Za-z'-]*"


def ascii_words(pattern: str) -> str:
    r"""A pattern for Java with \b and (?i) as RE2 has them: words of ASCII letters, digits and _ end beside any other letter, and case folds in Unicode."""
    return pattern.replace("(?i)", "(?iu)").replace(r"\b", "(?-iu:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))")


#: White space other than blanks, without and with NUL; a cheap range first.
ODD_SPACE, ODD_SPACE_OR_NUL = f"[[^ -~]&&{SPACE}]", "[[^ -~]&&" + SPACE.replace("[", r"[\x00", 1) + "]"


def held(c: Column, f) -> Column:
    """f of c, for which c is computed once; f is evaluated in a lambda."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _single_blanks(c: Column, odd: str) -> Column:
    """One pass for the rare signs that aren't blanks, one for runs of blanks: a pattern that matches every blank takes twice the time."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), odd, " "), "  +", " "))


def squeezed(c: Column) -> Column:
    """Every run of white space as one blank, none at the ends; null as empty."""
    return _single_blanks(c, ODD_SPACE_OR_NUL)


def spaced(c: Column) -> Column:
    """A text's `words` with a blank between each two: as `squeezed`, but NUL is no white space."""
    return _single_blanks(c, ODD_SPACE)


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def lines(c: Column) -> Column:
    """Non-blank lines without white space at their ends."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), FAST_LINE_END), stripped), lambda x: x != "")


def first_line(c: Column) -> Column:
    """The first of `lines`, without cutting the rest; empty where there is none."""
    return stripped(F.regexp_extract(F.coalesce(c, F.lit("")), f"^{SPACE}*({NOT_LINE_END}*)", 1))


def words(c: Column) -> Column:
    """Runs of other than white space."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({FAST_NOT_SPACE}++)"), 1)


def n_words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(f"{FAST_NOT_SPACE}++"))


def n_squeezed(c: Column) -> Column:
    """`n_words` of a text that is squeezed."""
    return F.when(c == "", F.lit(0)).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def has_words(c: Column, n: int) -> Column:
    """Whether a text has n of its `words` or more; reads no more of it than that takes."""
    return F.coalesce(c, F.lit("")).rlike(f"^{FAST_SPACE}*+(?:{FAST_NOT_SPACE}++(?:{FAST_SPACE}++|$)){{{n}}}")


def fewer_words(c: Column, n: int) -> Column:
    """Whether a text has fewer than n words (WORD); reads no more of it than that takes."""
    return ~c.rlike(f"^(?:{_BETWEEN}{WORD_RUN}){{{n}}}")


def content_hash(c: Column) -> Column:
    """Equal for texts that differ in white space and case only."""
    return F.sha2(F.lower(squeezed(c)), 256)


def first_match(c: Column, ladder: tuple[tuple[str, str], ...], otherwise: Column) -> Column:
    """The name beside the first needle that the text contains."""
    out = otherwise
    for needle, name in reversed(ladder):
        out = F.when(F.contains(c, F.lit(needle)), F.lit(name)).otherwise(out)
    return out


def first_pattern(c: Column, ladder: tuple[tuple[str, str], ...], otherwise: Column) -> Column:
    """The name beside the first pattern that the text matches."""
    out = otherwise
    for pattern, name in reversed(ladder):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def count_of(c: Column, needles: tuple[str, ...]) -> Column:
    """How many of the needles occur."""
    total = F.lit(0)
    for n in needles:
        total = total + F.contains(c, F.lit(n)).cast("int")
    return total
