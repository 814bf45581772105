"""Markdown cleaning: lines without decoration, noise left out, sentences that can be ledger items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions import text as T

# What marks an action and an open question in a Markdown document, and keywords that give a tag.
ACTION_MARKERS = ["need to", "needs to", "should", "will", "want to", "want", "implement", "add", "build", "develop", "action step", "next step", "recommendation", "recommended", "do not", "minimize", "call ", "keep ", "use "]
UNRESOLVED_MARKERS = ["maybe", "perhaps", "whether", "unclear", "unknown", "open question", "decision remains", "which option", "what if"]
TAGS = {"code-heavy": ["react", "python", "javascript", "code"], "planning": ["plan", "roadmap", "workflow", "implementation"], "research": ["research", "review", "funding", "grant", "blueprint"], "support": ["housing", "benefits", "support", "trauma", "recovery"]}


def clean_line(x: Column) -> Column:
    """A line without heading, quote and list marks, links as their text, images and emphasis gone."""
    y = F.regexp_replace(x, r"!\[[^\]]*\]\([^)]*\)", "")
    y = F.regexp_replace(y, r"\[([^\]]*)\]\([^)]*\)", "$1")
    y = F.regexp_replace(y, r"\[\^[^\]]*\]", "")
    y = F.regexp_replace(y, r"^\s*(#{1,6}\s+|>\s*|[-*+]\s+|\d+[.)]\s+)", "")
    return T.normalize_space(F.regexp_replace(y, r"[*`]+", ""))


def is_noise(x: Column) -> Column:
    """Q:/A: lines, code fences, tables, rules, and lines of 18 characters or more with few letters."""
    bars = F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
    return x.rlike(r"^\s*[QA]:") | F.startswith(F.trim(x), F.lit("```")) | (bars >= 3) | x.rlike(r"^[^\p{L}0-9]{4,}$") | ((F.length(x) >= 18) & (T.alpha_ratio(x) < 0.35))


def clean(x: Column) -> Column:
    """A Markdown text as its lines that aren't noise, cleaned."""
    lines = F.filter(F.split(F.coalesce(x, F.lit("")), r"\r?\n"), lambda s: ~is_noise(s))
    return F.array_join(F.filter(F.transform(lines, clean_line), lambda s: s != ""), "\n")


def sentences(x: Column) -> Column:
    """Split at line ends and at white space after a full stop, question or exclamation mark."""
    return F.filter(F.transform(F.split(x, r"(?:\n+|(?<=[.!?])\s+)"), T.normalize_space), lambda s: s != "")


def candidates(x: Column) -> Column:
    """Sentences that can be ledger items: 24 to 220 characters, no noise, no link, mostly letters."""
    return F.filter(sentences(x), lambda s: F.length(s).between(24, 220) & ~is_noise(s) & ~F.contains(s, F.lit("http")) & (T.alpha_ratio(s) >= 0.55))


def ledger(x: Column, unresolved: bool = False, markers: list[str] | None = None) -> Column:
    """At most five actions, or four open questions, of a cleaned text: its candidates with a marker, alike but for case once."""
    words = markers or (UNRESOLVED_MARKERS if unresolved else ACTION_MARKERS)

    def fits(s: Column) -> Column:
        hit = reduce(lambda a, m: a | F.contains(F.lower(s), F.lit(m)), words, F.lit(False))
        return hit | F.endswith(s, F.lit("?")) if unresolved else hit

    found = F.transform(F.filter(candidates(x), fits), lambda s: T.shorten(s, 180))
    return F.slice(T.distinct_ignoring_case(found), 1, 4 if unresolved else 5)


def tags(text: Column, title: Column, keywords: Column) -> Column:
    """Tags of a document by its text, its title and its keywords, in a fixed order."""
    low, name = F.lower(text), F.lower(title)
    tests = [(F.contains(low, F.lit("## q:")) & F.contains(low, F.lit("## a:")), "q-and-a")]
    for tag, words in TAGS.items():
        known = F.arrays_overlap(keywords, T.words_list(words))
        tests.append((known | F.contains(text, F.lit("```")) if tag == "code-heavy" else known, tag))
    tests.append((F.contains(name, F.lit("resume-me")) | F.contains(name, F.lit("branch")), "branch-export"))
    own = [F.when(F.coalesce(test, F.lit(False)), tag) for test, tag in tests]
    return F.array_compact(F.array(F.lit("markdown-import"), F.lit("markdown-document"), *own))
