"""The text functions as DuckDB SQL, for the oracle queries."""

from __future__ import annotations

from loomspark.functions import text as T

SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def space(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACES}+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{T.TOKEN}')"


def content(x: str, stop: list[str], shortest: int = 3) -> str:
    return f"list_filter({tokens(x)}, lambda t: length(t) >= {shortest} AND NOT list_contains({quoted(stop)}, t))"


def slug(x: str, limit: int = 64) -> str:
    bare = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"regexp_replace(left(CASE WHEN {bare} = '' THEN 'query' ELSE {bare} END, {limit}), '-+$', '')"


def shorten(x: str, limit: int = 220) -> str:
    flat = space(x)
    return f"CASE WHEN length({flat}) <= {limit} THEN {flat} ELSE concat(rtrim(left({flat}, {limit - 3})), '...') END"


def label(x: str) -> str:
    return f"array_to_string({tokens(x)}, ' ')"


def sentences(x: str) -> str:
    parts = f"regexp_split_to_array(regexp_replace(coalesce({x}, ''), '([?!.])', '\\1' || chr(10), 'g'), '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    return f"list_filter(list_transform({parts}, lambda s: {space('s')}), lambda s: s <> '')"


def ordered_distinct(x: str) -> str:
    """Of a column or a name, as x is written twice."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def distinct_ignoring_case(x: str) -> str:
    return f"list_filter({x}, lambda v, i: v <> '' AND list_position(list_transform({x}, lambda u: lower(u)), lower(v)) = i)"


def marked(x: str, markers: list[str], question: bool) -> str:
    """Shortened sentences of a list that hold a marker."""
    hit = " OR ".join(f"contains(lower(s), '{m}')" for m in markers) + (" OR ends_with(s, '?')" if question else "")
    return f"list_transform(list_filter({x}, lambda s: length(s) BETWEEN 24 AND 220 AND ({hit})), lambda s: {shorten('s', 180)})"


def title_case(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '\\p{{L}}+|[^\\p{{L}}]+'), lambda r: upper(left(r, 1)) || substr(r, 2)), '')"


def trigrams(x: str) -> str:
    return f"list_distinct(flatten(list_transform({content(x, T.CHAT_STOP_WORDS)}, lambda t: list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))))"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE round({both}::DOUBLE / (len({a}) + len({b}) - {both}), 4) END"


def strip_html(x: str) -> str:
    y = f"regexp_replace(coalesce({x}, ''), '(?is)<(script|style)\\b.*?</(script|style)>', ' ', 'g')"
    y = f"regexp_replace({y}, '(?i)<br\\s*/?>|</(p|div|li|h1|h2|h3|h4|h5|h6|tr|section|article)>', chr(10), 'g')"
    for name, char in T.ENTITIES.items():
        y = f"replace({y}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    y = f"regexp_replace({y}, '<[^>]+>', ' ', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({y}, chr(10)), lambda s: {space('s')}), lambda s: s <> ''), chr(10))"
