"""Text functions as column expressions. Null text is the empty text unless said otherwise."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no evidence, in comparisons of quotes and items.
STOP_WORDS = (
    "the a an of and or to in on at for with was were is are be been had has have that this it its as by from not "
    "he she they his her their which when no there but about after"
).split()
# Kinds of evidence items.
KINDS = ("observation", "measurement", "statement", "test result", "examination conclusion")
# Words that say that somebody said or tested something.
SAID = "stated|reported|recalled|said|described|told|advised|claimed|complained"
TESTED = "test|assay|culture|analysis|sample|laborator|specimen|scan|imaging|radiograph"
# Phrases that give a conclusion away.
CONCLUSIONS = (
    r"(?i)probable cause|reason for closing|root cause was|was the cause of the|final diagnosis|diagnosis was confirmed|contributing factor|"
    r"\b(?:the (?:investigation|investigators|board|bureau|branch|office|analysis)|ODI|we)\b[^.]{0,40}\b(?:concluded|determined|found that|attributed)\b"
)
# What dates and registrations look like.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATES = rf"(?i)\b(?:\d{{1,2}}\s+)?(?:{MONTHS})\s+\d{{1,2}}?,?\s*(?:19|20)\d{{2}}\b|\b\d{{1,2}}/\d{{1,2}}/(?:19|20)\d{{2}}\b|\b(?:19|20)\d{{2}}-\d{{2}}-\d{{2}}\b"
REGISTRATIONS = r"\b(?:[A-Z]{1,2}-?\d{2,5}[A-Z]{0,3}|N\d{2,5}[A-Z]{0,2})\b"
# Heads of role names, which identify nobody, and words that names may hold in lower case.
ROLES = "pilot passenger crew driver master patient occupant witness investigator operator manufacturer owner captain engineer".split()
CONNECTORS = "of the and de van von for at on in &".split()
# What a name never starts with.
LEADS = ("the ", "a ", "an ", "at the ", "on the ", "in the ", "of the ")
# Evidence ids, words of a normed text, and moves of a ledger.
EVIDENCE_ID = r"\bE[1-9][0-9]*\.[1-9][0-9]*\b"
WORD = r"[a-z0-9][a-z0-9'\-.]*"
MOVE = r"H(\d+)\s*\[([^\]→>]+?)\s*(?:→|->)\s*([^\]]+?)\]"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def squash(c: Column | str) -> Column:
    """White space, Unicode's too, collapsed and trimmed."""
    return F.trim(F.regexp_replace(_text(c), r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; no built-in function does it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def straighten(c: Column) -> Column:
    """Straight quotes, one kind of dash, single spaces, lower case."""
    quotes = F.translate(c, "’‘“”", "''\"\"")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(quotes, "[‐-―−]", "-"), r"(?U)\s+", " ")))


def norm(c: Column | str) -> Column:
    return straighten(nfkc(_text(c)))


def words(normed: Column) -> Column:
    """Content words of a text that norm() or straighten() has seen."""
    found = F.regexp_extract_all(normed, F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def contains_quote(haystack: Column, needle: Column, least: int = 5) -> Column:
    """Whether a normed quote occurs; a longer one may miss its first word, its last or both."""
    tokens = F.filter(F.split(needle, " "), lambda t: t != "")
    n = F.size(tokens)
    cut = [F.array_join(F.slice(tokens, a, F.greatest(n - b, F.lit(0))), " ") for a, b in ((2, 1), (1, 1), (2, 2))]
    trimmed = [(x != "") & haystack.contains(x) for x in cut]
    return (needle != "") & (haystack.contains(needle) | ((n >= least) & (trimmed[0] | trimmed[1] | trimmed[2])))


def overlap(item: Column, pool: Column) -> Column:
    """Share of the item's words, each as often as it comes, that the pool holds; 0 without words."""
    return F.when(F.size(item) == 0, 0.0).otherwise(F.size(F.filter(item, lambda w: F.array_contains(pool, w))) / F.size(item))


def coverage(pool: Column, source: Column) -> Column:
    """Share of the source's words that the items' words hold; 1 without words."""
    return F.when(F.size(source) == 0, 1.0).otherwise(F.size(F.filter(source, lambda w: F.array_contains(pool, w))) / F.size(source))


def strip_control(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")


def tidy(c: Column | str) -> Column:
    """Doubled articles and spaces before punctuation mended."""
    once = F.regexp_replace(_text(c), r"\b[Aa]n?\s+(the|a|an)\b", "$1")
    once = F.regexp_replace(once, r"(?i)\b(the)\s+the\b", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(once, r"\s+([,.;:])", "$1"), r"\s{2,}", " "))


def conclusion_hits(c: Column | str) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(CONCLUSIONS), F.lit(0))


def _first_distinct(c: Column, pattern: str, n: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))), 1, n)


def residual_identifiers(c: Column | str, n: int = 20) -> Column:
    return F.struct(_first_distinct(_text(c), DATES, n).alias("dates"), _first_distinct(_text(c), REGISTRATIONS, n).alias("registration_like"))


def normalise_kind(kind: Column | str, text: Column | str) -> Column:
    """The allowed kind that the label names or starts as, else what the text speaks of."""
    label, text = F.lower(squash(kind)), _text(text)
    out = F.when(text.rlike(rf"(?iU)\b(?:{SAID})\b"), "statement").when(text.rlike(rf"(?iU)\b(?:{TESTED})\w*\b"), "test result").when(text.rlike(r"\d"), "measurement").otherwise("observation")
    for allowed in reversed(KINDS):
        out = F.when((label == allowed) | label.startswith(allowed[:6]), allowed).otherwise(out)
    return out


def clean_pdf_text(c: Column | str) -> Column:
    """One kind of line end, words joined over hyphens at line ends, no blanks at line ends, one blank line at most."""
    lines = F.replace(F.replace(_text(c), F.lit("\r\n"), F.lit("\n")), F.lit("\f"), F.lit("\n"))
    joined = F.regexp_replace(lines, r"(?U)(\w)-\n\s*(\w)", "$1$2")
    return F.regexp_replace(F.regexp_replace(joined, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")


def paragraphs(c: Column | str, least: int = 40) -> Column:
    """Texts between blank lines; a short one belongs to the one before, and goes if there is none."""
    parts = F.transform(F.split(_text(c), r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^\s+", ""), r"\s+$", "")))
    start = F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), F.lit("\n"), p)))
        return F.when(F.length(p) >= least, F.concat(acc, F.array(p))).when((F.size(acc) > 0) & (p != ""), longer).otherwise(acc)

    return F.aggregate(parts, start, step)


def page_furniture(line: Column) -> Column:
    bare = F.lower(F.trim(line))
    return F.length(bare).between(1, 120) & (bare.rlike(r"^(?:page\s*)?\d+(?:\s*of\s*\d+)?$") | bare.rlike(r"\bpage \d+ of \d+\b") | bare.rlike(r"^[-–—_.•\s]+$"))


def garbled_score(c: Column | str) -> Column:
    """From 0, clean, to 1: odd characters, few long words, many lines of a character or two."""
    text = _text(c)
    found = F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0))
    odd = F.length(F.regexp_replace(text, r"[\x09\x0a\x0d\x20-\x7e£§°±–—’‘“”é]", ""))
    lines = F.split(text, "\n")
    single = F.size(F.filter(lines, lambda x: F.length(F.trim(x)).between(1, 2)))
    long_share = F.least(F.lit(1.0), F.size(F.filter(found, lambda w: F.length(w) >= 4)) / F.greatest(F.size(found), F.lit(1)))
    score = 0.5 * (odd / F.greatest(F.length(text), F.lit(1)) * 20) + 0.3 * (1 - long_share) + 0.2 * F.least(F.lit(1.0), single / F.greatest(F.size(lines), F.lit(1)) * 3)
    return F.when((F.trim(text) == "") | ~text.rlike(r"\p{L}"), 1.0).otherwise(F.least(F.lit(1.0), score))


def flexible_pattern(value: Column) -> Column:
    """A pattern for a name however its words are joined; null for values without words."""
    tokens = F.regexp_extract_all(_text(value), F.lit("[A-Za-z0-9][A-Za-z0-9'’]*"), F.lit(0))
    last = F.element_at(tokens, -1)
    tail = F.when((F.length(last) >= 4) & last.rlike("^[A-Za-z]+$"), "[A-Za-z]*").otherwise("")
    body = F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("\\Q"), t, F.lit("\\E"))), "[^A-Za-z0-9]{0,3}")
    return F.when(F.size(tokens) > 0, F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), body, tail, F.lit("(?![A-Za-z0-9])")))


def leaks(text: Column, normed: Column, value: Column, normed_value: Column) -> Column:
    """Whether a withheld value shows, as it is or with its words joined otherwise."""
    return (normed_value != "") & (normed.contains(normed_value) | F.coalesce(F.rlike(text, flexible_pattern(value)), F.lit(False)))


def identifier_hygiene(values: Column) -> Column:
    """The distinct values that look like names, in order."""
    cleaned = F.transform(values, lambda v: F.regexp_replace(F.trim(F.coalesce(v, F.lit(""))), r"^[.,;]+|[.,;]+$", ""))

    def good(v: Column) -> Column:
        tokens = F.split(v, r"\s+")
        rest = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
        role = F.lower(F.element_at(F.split(v, "[^A-Za-z]"), 1)).isin(ROLES) & (F.size(tokens) > 1)
        plain = F.exists(rest, lambda t: t.rlike(r"^\p{Ll}+$") & ~t.isin(CONNECTORS))
        return (
            F.length(v).between(1, 50) & (F.size(tokens) <= 6) & v.rlike(r"(?U)^[A-Z0-9][\w'’\-./ ]{1,48}$")
            & ~reduce(Column.__or__, [F.lower(v).startswith(x) for x in LEADS]) & ((F.length(v) >= 4) | v.rlike(r"\d")) & ~role & ~plain
        )

    return F.sort_array(F.array_distinct(F.filter(cleaned, good)))


def evidence_ids(c: Column | str) -> Column:
    """All ids of the deep grammar, as often as they come."""
    return F.regexp_extract_all(_text(c), F.lit(EVIDENCE_ID), F.lit(0))


def id_order(ids: Column) -> Column:
    """Evidence ids by their numbers: E1.10 after E1.9."""
    def key(i: Column) -> Column:
        parts = F.split(F.substring(i, 2, 1000), r"\.")
        return F.struct(F.transform(parts, lambda p: p.cast("int")).alias("key"), i.alias("id"))

    return F.transform(F.array_sort(F.transform(ids, key)), lambda s: s["id"])


def expand_ids(c: Column | str) -> Column:
    """Ids in order of first mention, ranges within a group written out; other ranges give their ends."""
    found = F.regexp_extract_all(F.translate(_text(c), "–—", "--"), F.lit(r"E[1-9][0-9]*\.[1-9][0-9]*(?:\s*-\s*E[1-9][0-9]*\.[1-9][0-9]*)?"), F.lit(0))

    def spread(part: Column) -> Column:
        ends = F.regexp_extract_all(part, F.lit(r"E[1-9][0-9]*\.[1-9][0-9]*"), F.lit(0))
        number = lambda i, k: F.element_at(F.split(F.substring(F.element_at(ends, i), 2, 1000), r"\."), k).cast("int")
        run = (F.size(ends) == 2) & (number(1, 1) == number(-1, 1)) & (number(1, 2) <= number(-1, 2))
        listed = F.transform(F.sequence(number(1, 2), F.greatest(number(-1, 2), number(1, 2))), lambda k: F.concat(F.lit("E"), number(1, 1), F.lit("."), k))
        return F.when(run, listed).otherwise(ends)

    return F.array_distinct(F.flatten(F.transform(found, spread)))


def closure_marker(c: Column | str) -> Column:
    """`not_closed`, `closed` or null; the longer marker is looked for first."""
    return F.when(_text(c).contains("CASE NOT CLOSED"), "not_closed").when(_text(c).contains("CASE CLOSED"), "closed")


def leading_marker(c: Column | str) -> Column:
    """The marker that the text starts with, after white space."""
    bare = F.regexp_replace(_text(c), r"^\s+", "")
    return F.when(bare.startswith("CASE NOT CLOSED"), "not_closed").when(bare.startswith("CASE CLOSED"), "closed")


def first_line_marker(c: Column | str) -> Column:
    """The marker that the text starts with, nothing before it."""
    return F.when(_text(c).startswith("CASE NOT CLOSED"), "not_closed").when(_text(c).startswith("CASE CLOSED"), "closed")


def status_rank(c: Column | str) -> Column:
    """How strongly a hypothesis stands, -2 to 2; null if the word isn't known."""
    word = F.lower(F.trim(_text(c)))
    # What the words for a state begin with.
    ladder = [
        (-2, ("ruled out", "excluded", "eliminated", "rejected", "refuted")),
        (-1, ("weaken", "weaker", "disfavo", "less likely", "unlikely")),
        (0, ("open", "unresolved", "undetermined", "uncertain", "possible")),
        (1, ("favo", "support", "stronger", "strengthen", "leading", "likely", "more likely")),
        (2, ("confirmed", "established", "strongly")),
    ]
    out = F.lit(None).cast("int")
    for rank, heads in reversed(ladder):
        out = F.when(word.rlike("^(?:" + "|".join(heads) + ")"), rank).otherwise(out)
    return out


def ledger(c: Column | str) -> Column:
    """Moves `H1 [before -> after]`, the first of each hypothesis, lower-cased."""
    pattern = F.lit(MOVE)
    parts = [F.regexp_extract_all(_text(c), pattern, F.lit(k)) for k in (1, 2, 3)]
    moves = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("h", "b", "a"))]), lambda m: F.struct(F.concat(F.lit("H"), m["h"]).alias("hypothesis"), F.lower(F.trim(m["b"])).alias("before"), F.lower(F.trim(m["a"])).alias("after")))
    start = F.array().cast("array<struct<hypothesis:string,before:string,after:string>>")
    return F.aggregate(moves, start, lambda acc, m: F.when(F.exists(acc, lambda x: x["hypothesis"] == m["hypothesis"]), acc).otherwise(F.concat(acc, F.array(m))))


def issue_kind(finding: Column, about_final: Column) -> Column:
    """What a reviewer's finding is about, by the first rung whose words it holds."""
    text = F.lower(finding)
    # The words of each rung.
    return (
        F.when(text.rlike("before it was fetched|before it was disclosed|not yet returned|unread|premature|forward|before the tool"), "temporal_evidence")
        .when(text.rlike("hypothesis|ledger|favored|weakened|state change"), "hypothesis_update")
        .when(text.rlike("missing evidence|not fetched|fetch|request"), "evidence_selection")
        .when(about_final | text.rlike("final answer|conclusion|closure"), "final_answer")
        .otherwise("factual_grounding")
    )


def token_proxy(chars: Column, factor: float = 1.2) -> Column:
    return F.ceil(chars / 2.5 * factor)


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens, joined by spaces. tokens: a column, as an expression would be evaluated at every run."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def clock_times(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_text(c), F.lit(r"(?<![\d:])\d{1,2}:\d{2}(?::\d{2})?(?![\d:])"), F.lit(0)))


def sections(c: Column | str) -> Column:
    """Heading to body of `## ` sections; of equal headings the last counts."""
    pieces = F.split(F.concat(F.lit("\n"), _text(c)), r"\n##[ \t]+")
    parts = F.slice(pieces, F.lit(2), F.size(pieces))
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    entries = F.transform(parts, lambda p: F.struct(bare(F.element_at(F.split(p, "\n", 2), 1)).alias("key"), bare(F.coalesce(F.try_element_at(F.split(p, "\n", 2), F.lit(2)), F.lit(""))).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def occurs_once(text: Column, part: Column) -> Column:
    return (part != "") & (F.length(text) - F.length(F.replace(text, part, F.lit(""))) == F.length(part))


def replace_once(text: Column, old: Column, new: Column) -> Column:
    """The text with its only occurrence of `old` replaced; null if there isn't exactly one."""
    return F.when(occurs_once(text, old), F.replace(text, old, new))


def pick_sections(c: Column | str, names: list[str], most: int = 4000) -> Column:
    """The named sections that a text has, with their headings; without any its first `most` code points, or `(empty)`."""
    found, bare = sections(c), F.regexp_replace(F.regexp_replace(_text(c), r"^\s+", ""), r"\s+$", "")
    parts = [F.when(F.map_contains_key(found, F.lit(n)), F.concat(F.lit(f"## {n}\n"), F.try_element_at(found, F.lit(n)))) for n in names]
    return F.coalesce(F.nullif(F.concat_ws("\n\n", *parts), F.lit("")), F.nullif(F.substring(bare, 1, most), F.lit("")), F.lit("(empty)"))


def task_question(c: Column | str, most: int = 600) -> Column:
    """The section of that name, or the beginning of a text without one."""
    own = F.try_element_at(sections(c), F.lit("Task question"))
    return F.coalesce(F.nullif(own, F.lit("")), F.substring(_text(c), 1, most))


def strict_section(c: Column | str, heading: str, following: str | None = None) -> Column:
    """(text, problem): what stands between a heading and the one that has to follow; a heading that is missing is a
    problem, not an empty text."""
    after = F.split(_text(c), re.escape(f"## {heading}\n"), 2)
    body = F.get(after, F.lit(1))
    ended = F.split(body, re.escape(f"\n## {following}"), 2) if following else F.array(body)
    missing = F.when(F.size(after) < 2, f"missing {heading}")
    if following:
        missing = missing.when(F.size(ended) < 2, f"missing {following}")
    trimmed = F.regexp_replace(F.regexp_replace(F.get(ended, F.lit(0)), r"^\s+", ""), r"\s+$", "")
    return F.struct(F.when(missing.isNull(), trimmed).alias("text"), missing.alias("problem"))


def fill(template: Column | str, values: dict[str, Column]) -> Column:
    """A template with each `{name}` replaced as it stands; values aren't read for names of later ones' sake, but in turn."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def role_hint(heading: Column) -> Column:
    """`factual` for headings that announce facts, else `unknown`."""
    # What such headings hold.
    words_ = ("MANUFACTURER", "PRODUCT INFORMATION", "FAILURE REPORT", "PROBLEM DESCRIPTION", "COMPLAINT", "TESTING", "SIMULATION", "FIELD", "WARRANTY", "WHAT WE KNOW")
    return F.when(F.upper(_text(heading)).rlike("|".join(words_)), "factual").otherwise("unknown")


def insert_citations(text: Column, insertions: Column, visible: Column) -> Column:
    """(text, problem): a text with ids in brackets after each anchor. insertions: array of (anchor, ids). An anchor has to
    stand in the text exactly once, in any case; ids have to be visible, each once; no two go to one place."""
    low = F.lower(text)
    at = F.transform(insertions, lambda i: F.struct((F.position(F.lower(i["anchor"]), low) + F.length(i["anchor"])).alias("end"), i["anchor"].alias("anchor"), i["ids"].alias("ids")))
    unique = F.forall(insertions, lambda i: F.coalesce((i["anchor"] != "") & occurs_once(low, F.lower(i["anchor"])), F.lit(False)))
    good = F.forall(insertions, lambda i: F.coalesce((F.size(i["ids"]) > 0) & (F.size(F.array_distinct(i["ids"])) == F.size(i["ids"])) & (F.size(F.array_except(i["ids"], visible)) == 0), F.lit(False)))
    apart = F.size(F.array_distinct(F.transform(at, lambda i: i["end"]))) == F.size(at)
    problem = F.when(~unique, "an anchor is not there exactly once").when(~good, "unread or malformed ids").when(~apart, "two citations at one place")
    # from the last place to the first, so that earlier places stay where they are
    done = F.aggregate(F.reverse(F.array_sort(at)), text, lambda acc, i: F.concat(F.substring(acc, F.lit(1), i["end"] - 1), F.lit(" ["), F.array_join(i["ids"], ", "), F.lit("]"), F.substring(acc, i["end"], F.length(acc))))
    return F.struct(F.when(problem.isNull(), done).alias("text"), problem.alias("problem"))
