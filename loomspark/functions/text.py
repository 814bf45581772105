"""Text functions as column expressions: whitespace, tokens, slugs, sentences, ledgers, snippets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space, the token pattern, word lists, markers, synonyms.
SPACE_CLASS = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
TOKEN = "[a-z0-9][a-z0-9_-]+"
SEARCH_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "if", "in", "into", "is", "it", "of", "on", "or", "should", "that", "the",
    "this", "to", "what", "when", "where", "which", "why", "with",
]
CHAT_STOP_WORDS = [
    "a", "about", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "being", "but", "by", "can", "could", "do", "for", "from",
    "get", "going", "have", "if", "in", "into", "is", "it", "just", "like", "make", "maybe", "more", "need", "not", "of", "on", "or", "our", "out",
    "say", "should", "so", "that", "the", "their", "them", "then", "there", "they", "this", "to", "want", "we", "what", "where", "will", "with",
    "you", "your",
]
ACTION_MARKERS = ["need to", "needs to", "should", "will", "want to", "implement", "add", "build", "develop", "next step", "recommend"]
UNRESOLVED_MARKERS = ["maybe", "perhaps", "unclear", "unknown", "whether", "what if", "which option"]
QUERY_SYNONYMS = {
    "action": ["implement", "task", "todo", "pressure"],
    "actions": ["implement", "task", "todo", "pressure"],
    "drift": ["movement", "transition", "change", "doctrine"],
    "timeline": ["movement", "transition", "change", "lineage"],
    "unresolved": ["open", "ambiguity", "question", "unknown"],
    "question": ["unresolved", "open", "ambiguity"],
    "contradiction": ["opposition", "conflict", "axis"],
    "duplicate": ["same", "merge", "alias"],
}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_list(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def normalize_space(x: Column | str) -> Column:
    """Runs of white space become one blank; none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(x), F.lit("")), SPACE_CLASS + "+", " "))


def tokenize(x: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_col(x), F.lit(""))), F.lit(TOKEN), F.lit(0))


def content_tokens(x: Column | str, stop: list[str], shortest: int = 3) -> Column:
    stops = words_list(stop)
    return F.filter(tokenize(x), lambda t: (F.length(t) >= shortest) & ~F.array_contains(stops, t))


def slugify(x: Column | str, limit: int = 64) -> Column:
    dashed = F.regexp_replace(F.lower(F.coalesce(_col(x), F.lit(""))), "[^a-z0-9]+", "-")
    bare = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.regexp_replace(F.left(F.when(bare == "", F.lit("query")).otherwise(bare), F.lit(limit)), "-+$", "")


def shorten(x: Column | str, limit: int = 220) -> Column:
    flat = normalize_space(x)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(limit - 3))), F.lit("...")))


def normalize_label(x: Column | str) -> Column:
    return F.array_join(tokenize(x), " ")


def split_sentences(x: Column | str) -> Column:
    """Parts between line ends and after each ``?``, ``!`` or ``.``, white space normalised, without empty ones."""
    parts = F.split(F.regexp_replace(F.coalesce(_col(x), F.lit("")), "([?!.])", "$1\n"), r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]")
    return F.filter(F.transform(parts, normalize_space), lambda s: s != "")


def distinct_ignoring_case(values: Column) -> Column:
    """The first of values alike but for case, in order, without empty ones."""

    def keep(held: Column, x: Column) -> Column:
        known = F.exists(held, lambda y: F.lower(y) == F.lower(x))
        return F.when((x == "") | known, held).otherwise(F.concat(held, F.array(x)))

    return F.aggregate(F.transform(values, normalize_space), F.expr("cast(array() as array<string>)"), keep)


def _marked(sentences: Column, markers: list[str], limit: int, question: bool) -> Column:
    def fits(s: Column) -> Column:
        low = F.lower(s)
        hit = reduce(lambda a, m: a | F.contains(low, F.lit(m)), markers[1:], F.contains(low, F.lit(markers[0])))
        return F.length(s).between(24, 220) & (hit | F.endswith(s, F.lit("?")) if question else hit)

    return F.slice(distinct_ignoring_case(F.transform(F.filter(sentences, fits), lambda s: shorten(s, 180))), 1, limit)


def extract_actions(sentences: Column, limit: int = 6, markers: list[str] | None = None) -> Column:
    return _marked(sentences, markers or ACTION_MARKERS, limit, False)


def extract_unresolved(sentences: Column, limit: int = 5, markers: list[str] | None = None) -> Column:
    return _marked(sentences, markers or UNRESOLVED_MARKERS, limit, True)


def title_case(x: Column | str) -> Column:
    """Each letter that doesn't follow a letter in upper case, the others in lower case."""
    runs = F.regexp_extract_all(F.lower(_col(x)), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substr(r, F.lit(2)))), "")


def trigrams(x: Column | str) -> Column:
    """Distinct character trigrams within the content tokens."""
    grams = F.transform(content_tokens(x, CHAT_STOP_WORDS), lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values, to four places; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.round(both / (F.size(a) + F.size(b) - both), 4))


def token_set(x: Column) -> Column:
    return F.array_distinct(tokenize(x))


def alpha_ratio(x: Column | str) -> Column:
    solid = F.length(F.regexp_replace(_col(x), SPACE_CLASS, ""))
    return F.when(solid == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(_col(x), r"[^\p{L}]", "")) / solid)


def subject_key(ids: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(ids)), "::")


def fingerprint(ids: Column) -> Column:
    return F.left(F.sha1(subject_key(ids)), F.lit(8))


def review_id(kind: str, ids: Column, with_fingerprint: bool = True) -> Column:
    base = F.concat(F.lit(f"federated-{kind}-"), slugify(F.array_join(ids, " "), 80))
    return F.concat_ws("-", base, fingerprint(ids)) if with_fingerprint else base


def strip_uuid_suffix(x: Column) -> Column:
    return F.when(F.length(x) >= 10, F.regexp_replace(x, "-[0-9a-fA-F]{8}$", "")).otherwise(x)


def snippet(text: Column, query_tokens: Column, width: int = 220) -> Column:
    """A window of the text around the earliest token, with ellipses where it is cut."""
    flat = normalize_space(text)
    places = F.filter(F.transform(query_tokens, lambda t: F.instr(F.lower(flat), t)), lambda p: p > 0)
    first = F.coalesce(F.array_min(places), F.lit(1)) - 1
    start = F.greatest(first - max(20, width // 3), F.lit(0))
    part = F.trim(F.substring(flat, start + 1, F.lit(width)))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), part, F.when(start + width < F.length(flat), "...").otherwise(""))
    return F.when(F.length(flat) <= width, flat).otherwise(cut)


#: Named character references that occur in practice, by what they stand for; ``&amp;`` comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def strip_html(x: Column | str) -> Column:
    """Text of a page: scripts and styles go, block ends break lines, references are resolved, then tags go."""
    y = F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    y = F.regexp_replace(y, r"(?i)<br\s*/?>|</(p|div|li|h1|h2|h3|h4|h5|h6|tr|section|article)>", "\n")
    for name, char in ENTITIES.items():
        y = F.replace(y, F.lit(name), F.lit(char))
    y = F.regexp_replace(y, r"<[^>]+>", " ")
    lines = F.transform(F.split(y, "\n"), normalize_space)
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")
