"""String columns: titles, keys, identifiers, markup."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE_A, _EDGE_B = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
SPACES = "[\\s ]+"


def bounded(pattern: str) -> str:
    """A Java pattern whose word boundaries are ASCII ones, from one written with \\b at its two ends."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return f"{_EDGE_A}(?:{inner.replace(chr(92) + 'b', '(?:' + _EDGE_A + '(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])' + _EDGE_B + ')')}){_EDGE_B}"


def normal_title(title: Column) -> Column:
    """Lower case, straight quotes without escapes, single spaces."""
    steps = ((r"\\+'", "'"), (r'\\+"', '"'), ("[‘’]", "'"), ("[“”]", '"'), (SPACES, " "))
    return F.lower(F.trim(reduce(lambda text, step: F.regexp_replace(text, *step), steps, title)))


# The keyword patterns of the title classes, over normalised titles.
STICK_PUCK = r"\b(stick\s*(&|and|n|')?\s*puck|sticks?\s*(&|and)\s*pucks?|stick\s+(practice|time|session|&\s*shoot)|shooting\s+practice|drop[-\s]?in\s+(hockey\s+)?practice)\b"
KIDS = r"\b(kids?|youth|junior|jr\.?|grades?|k-\d|mites?|squirts?|pee\s*wees?|bantams?|under\s*\d+|u\d{1,2}|ages?\s*\d+\s*(-|to|&)\s*\d+|children|tots?|family\s*&\s*kids)\b"
ADULT = r"\b(adult|adults|men'?s|mens|women'?s|womens|ladies|18\+|21\+|over\s*\d{2}|\d{2}\+|\d{2}\s*(and|&)\s*(up|over|older)|senior|old\s*timers?|masters?)\b"
FAMILY = r"\b(family|parent\s*(&|and|\/)\s*(child|kid|tot))\b"
PUBLIC_HOCKEY = r"\b(public\s+hockey|pick[-\s]?up\s+hockey|pickup|drop[-\s]?in\s+hockey|open\s+hockey|rat\s+hockey|shinny|adult\s+open\s+hockey|lunch(time)?\s+hockey|noon\s+hockey)\b"
COACH = r"\b(coach(es|'s|s')?\s+ice|coaches?\s+(open\s+)?ice|open\s+ice|bring\s+your\s+own\s+coach|private\s+lesson\s+ice|instructional\s+ice)\b"
FREESTYLE = r"\b(freestyle|free\s*style|figure\s+skating\s+(practice|ice|session)|fs\s+ice|dance\s+ice)\b"
PUBLIC_SKATE = r"\b(public\s+skat(e|ing)|open\s+skat(e|ing)|family\s+skat(e|ing)|general\s+skat(e|ing)|skating\s+session|free\s+skate)\b"
LESSONS = r"\b(learn\s+to\s+(skate|play)|lessons?|skating\s+school|clinic|camp|class(es)?|lts|ltp|intro\s+to|beginner|tot\s+skating|hockey\s+school|skills)\b"
CLOSED = r"\b(closed|unavailable|holiday|maintenance|no\s+ice|ice\s+out|blocked|conflict)\b"
RENTAL = r"\b(hockey\s+(club|league|association|assoc)|youth\s+hockey|high\s+school|hs\s|college|university|varsity|jv\b|party|birthday|tournament|game|practice|league|club|school|team|rental|private)\b"
OPEN_CLASSES = ("stick_puck_kids", "stick_puck_adult", "stick_puck_family", "stick_puck", "public_hockey", "coach_ice")
# End of fixed values.

#: (class, patterns that must match, patterns that must not), first match wins.
CASCADE = (
    ("closed", (CLOSED,), (STICK_PUCK, PUBLIC_HOCKEY)),
    ("stick_puck_family", (STICK_PUCK, FAMILY), ()),
    ("stick_puck_kids", (STICK_PUCK, KIDS), ()),
    ("stick_puck_adult", (STICK_PUCK, ADULT), ()),
    ("stick_puck", (STICK_PUCK,), ()),
    ("public_hockey", (PUBLIC_HOCKEY,), ()),
    ("coach_ice", (COACH,), ()),
    ("freestyle", (FREESTYLE,), ()),
    ("public_skate", (PUBLIC_SKATE,), ()),
    ("learn_to_skate", (LESSONS,), ()),
    ("private_rental", (RENTAL,), ()),
)


def title_class(text: Column) -> Column:
    """The class of a normalised title by keywords, or null. Take the normal form as a column: it is read many times."""
    out = F.lit(None).cast("string")
    for name, need, avoid in reversed(CASCADE):
        test = reduce(lambda a, b: a & b, [text.rlike(bounded(p)) for p in need] + [~text.rlike(bounded(p)) for p in avoid])
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def sql_normal_title(title: str) -> str:
    return f"lower(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace({title}, '\\\\+''', '''', 'g'), '\\\\+\"', '\"', 'g'), chr(8216), ''''), chr(8217), ''''), chr(8220), '\"'), chr(8221), '\"'), '[\\s ]+', ' ', 'g')))"


def sql_title_class(title: str) -> str:
    text = sql_normal_title(title)
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    whens = []
    for name, need, avoid in CASCADE:
        tests = [f"regexp_matches({text}, {quoted(p)})" for p in need] + [f"NOT regexp_matches({text}, {quoted(p)})" for p in avoid]
        whens.append(f"WHEN {' AND '.join(tests)} THEN '{name}'")
    return "CASE " + " ".join(whens) + " END"


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the text's characters (their UTF-16 units, for text in the basic plane)."""
    units = F.transform(F.split(text, "(?!^)(?=.)"), lambda c: F.ascii(c).cast("long"))
    times = lambda h: (h * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(text == "", F.lit(2166136261)).otherwise(F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: times(h.bitwiseXOR(u))))


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def short_id(prefix: Column, *parts: Column) -> Column:
    """prefix, hyphen, base-36 FNV-1a of prefix and parts joined by bars."""
    return F.concat(prefix, F.lit("-"), base36(fnv1a(F.concat_ws("|", prefix, *parts))))


def location_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def team_key(text: Column) -> Column:
    """A team name without years and levels, in lower-case words."""
    lower = F.lower(text)
    bare = F.regexp_replace(lower, bounded(r"\b(?:20\d\d|\d{2}u|u\d{2}|aaa|aa|elite|select)\b"), " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


#: Named character references that occur in listings.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Markup taken out: block ends become line ends, other tags spaces; named references decoded; white space tidied."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?i)<br[^>]*>|</(p|div|li|h[1-6]|tr|article|footer)>", "\n")
    text = F.regexp_replace(text, "(?s)<[^>]+>", " ")
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)
    text = F.regexp_replace(text, "[ \\t\\r\\f ]+", " ")
    return F.trim(F.regexp_replace(text, " ?\n[ \n]*", "\n"), F.lit(" \n"))


def html_links(html: Column) -> Column:
    """Distinct link targets in page order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('(?i)href="([^"]+)"'), 1))


def folded(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered rewrites of a lower-case name, then single spaces. Patterns have \\b at their two ends."""
    out = F.replace(F.lower(text), F.lit("."), F.lit(""))
    for pattern, value in rules:
        out = F.regexp_replace(out, bounded(pattern), value)
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))
