"""DuckDB counterparts of functions.text, for building the oracles."""

from __future__ import annotations

from corpusflow.functions import text as T
from corpusflow.tables import quoted as q


def squeezed(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), {q('(' + chr(92) + 'x00|' + T.SPACE + ')+')}, ' ', 'g'))"


def stripped(c: str) -> str:
    return f"regexp_replace({c}, {q(f'^{T.SPACE}+|{T.SPACE}+$')}, '', 'g')"


def lines(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({c}, ''), {q(T.LINE_END)}), lambda x: {stripped('x')}), lambda x: x <> '')"


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


def words(c: str) -> str:
    return f"regexp_extract_all(coalesce({c}, ''), {q(T.NOT_SPACE + '+')})"


def n_words(c: str) -> str:
    return f"len({words(c)})"


def content_hash(c: str) -> str:
    return f"sha256(lower({squeezed(c)}))"


def matches(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def first_match(c: str, ladder: tuple[tuple[str, str], ...], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({c}, {q(n)}) THEN {q(v)}" for n, v in ladder) + f" ELSE {otherwise} END"


def first_pattern(c: str, ladder: tuple[tuple[str, str], ...], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {matches(c, p)} THEN {q(v)}" for p, v in ladder) + f" ELSE {otherwise} END"


def count_of(c: str, needles: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({c}, {q(n)})::INT" for n in needles) + ")"


def any_of(c: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(n)})" for n in needles) + ")"
