"""SQL text fragments shared by the DuckDB counterparts of the queries."""
from __future__ import annotations

from ..functions import text as tx

WS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def slist(words) -> str:
    return "[" + ",".join(q(w) for w in words) + "]"


def strip(c: str) -> str:
    return f"trim({c},{WS})"


def norm(c: str) -> str:
    return strip(f"regexp_replace(coalesce({c},''),'\\s+',' ','g')")


def norm_source(c: str) -> str:
    return strip(f"regexp_replace(lower({norm(c)}),{q('[^a-z0-9' + chr(39) + ']+')},' ','g')")


WORDS = "[\\p{L}\\p{N}\\p{M}_]+|[^\\p{L}\\p{N}\\p{M}_]+"


def drop_articles(c: str) -> str:
    """Whole-word removal by Unicode words (RE2's \\b is ASCII only)."""
    return (f"array_to_string(list_transform(regexp_extract_all({c},{q(WORDS)}),"
            "lambda w: case when w in ('a','an','the') then ' ' else w end),'')")


def norm_match(c: str) -> str:
    return strip(f"regexp_replace({drop_articles(f'lower({norm(c)})')},{q('[^a-z0-9' + chr(39) + ']+')},' ','g')")


def norm_answer(c: str) -> str:
    inner = f"regexp_replace({strip(f'lower(coalesce({c},{q(str())}))')},'[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]',' ','g')"
    return strip(f"regexp_replace({inner},'\\s+',' ','g')")


def toks(c: str, profile: str = "lexical") -> str:
    pattern, shortest, stop = tx.TOKEN_PROFILES[profile]
    found = f"regexp_extract_all(lower(coalesce({c},'')),{q(pattern)})"
    if shortest == 1 and not stop:
        return found
    test = f"length(x)>={shortest}" + (f" and not list_contains({slist(stop)},x)" if stop else "")
    return f"list_filter({found}, lambda x: {test})"


def tokset(c: str, profile: str = "lexical") -> str:
    return f"list_distinct({toks(c, profile)})"


def count_tokens(c: str) -> str:
    return f"length(regexp_extract_all(coalesce({c},''),'\\S+'))"


def inter(a: str, b: str) -> str:
    return f"length(list_intersect({a},{b}))"
