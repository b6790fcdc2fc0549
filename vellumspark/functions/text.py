"""Column builders for text: numbers, tokens, sentences, readability, labels. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that mark a reference before a number, and the words a match never rests on.
LABELS = r"Figure|Fig\.|Table|Section|Sec\.|§|Appendix|RQ|Eq\.|Equation|Chapter"
STOP_WORDS = (
    "a an the and or of to in on for with by from as at is are was were be been being this that these those it its "
    "their they them we our us you your he she his her which who whom whose what when where why how than then there here "
    "also into over under about after before between during each both more most other some such only own same so too very "
    "can will just not no nor but if because while do does did done have has had having one two three four five six seven "
    "eight nine ten paper authors author study show shows shown result results use used using"
).split()
LIMITS = (
    r"(?i)\b(limitation|limit(ed|s)?|threat|bias|caveat|may not (generali[sz]e|carry)|only (covers|one|python|claude)|"
    r"does not (show|isolate|measure)|doesn't|cannot|can't|excluded|subset)\b"
)

#: A number that no letter, digit, underscore or dot touches on its left; Unicode classes, as Java's \w is ASCII.
NUMBER = r"(?<![\p{L}\p{N}_.])(\d(?:[\d,]*\d)?(?:\.\d+)?)"
UNIT = r"(\s?%|\s?percent|[kK]\b)?"
#: The same number, unless a label stands directly before it (look-behind needs a bound for the blanks). The digit is
#: asked for first, so that the long look-behind is tried at numbers only, not at every character.
CLAIM = rf"(?<![\p{{L}}\p{{N}}_.])(?=\d)(?<!(?i:{LABELS})\s{{0,40}})" + NUMBER.partition(")")[2] + UNIT
CITATION = r"\[\s*\d+(?:\s*[,–-]\s*\d+)*\s*\]"


def norm_number(c: Column) -> Column:
    """Commas dropped; after a point, zeros at the end dropped, and the point with them. A string stays a string."""
    bare = F.trim(F.regexp_replace(c, ",", ""))
    short = F.regexp_replace(F.regexp_replace(bare, r"0+$", ""), r"\.$", "")
    return F.when(bare.contains("."), F.when(short == "", F.lit("0")).otherwise(short)).otherwise(bare)


def stated_numbers(text: Column) -> Column:
    """Array of the numbers that a sentence claims, as written; numbers after a label are references."""
    return F.regexp_extract_all(text, F.lit(CLAIM), F.lit(1))


def known_numbers(text: Column) -> Column:
    """Distinct normalised numbers of a text; ``12k`` is known as 12 and as 12000."""
    plain = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), norm_number)
    kilo = F.regexp_extract_all(text, F.lit(NUMBER + r"[kK]\b"), F.lit(1))
    thousand = F.transform(kilo, lambda n: norm_number((F.regexp_replace(n, ",", "").cast("decimal(28,6)") * 1000).cast("decimal(28,3)").cast("string")))
    return F.array_distinct(F.concat(plain, thousand))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def tokens(text: Column) -> Column:
    """Lower-case words of three letters or more and numbers, without citations and stop words, in order."""
    bare = F.lower(F.regexp_replace(text, CITATION, " "))
    found = F.regexp_extract_all(bare, F.lit(r"([a-z][a-z\-]{2,}|\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(found, lambda w: ~F.array_contains(stop, w))


def word_set(text: Column, pattern: str = "([a-z]{3,})") -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; null where either is empty."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / any_)


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent e at the end, at least one; 0 without a letter."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(letters, F.lit("[aeiouy]+"))
    silent = F.when(letters.endswith("e") & (groups > 1), 1).otherwise(0)
    return F.when(letters == "", 0).otherwise(F.greatest(F.lit(1), groups - silent))


def text_syllables(text: Column) -> Column:
    return F.aggregate(F.transform(words(text), syllables), F.lit(0).cast("long"), lambda a, n: a + n)


def flesch(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    per = n_words / F.greatest(n_sentences, F.lit(1))
    return F.lit(206.835) - F.lit(1.015) * per - F.lit(84.6) * (n_syllables / F.greatest(n_words, F.lit(1)))


def half_even(c: Column, digits: int) -> Column:
    """Rounded in double arithmetic, halves to even. ``bround`` rounds the shortest decimals that print a double, so it
    takes 52.650000000000006 (a half, as far as doubles tell) up to 52.7."""
    scale = F.lit(10.0**digits)
    return F.rint(c * scale) / scale


def sentences(text: Column) -> Column:
    """Cut behind . ? ! and the white space after it."""
    return F.filter(F.split(text, r"(?<=[.?!])\s+"), lambda s: F.trim(s) != "")


def squash(text: Column) -> Column:
    """Lower-case ASCII letters and digits only (compatibility forms are folded by functions.unicode.squash)."""
    return F.regexp_replace(F.lower(text), "[^0-9a-z]", "")


def listing(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``; empty items are left out."""
    kept = F.filter(items, lambda x: F.coalesce(x, F.lit("")) != "")
    head = F.concat_ws(", ", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
    return F.when(F.size(kept) == 0, "").when(F.size(kept) == 1, kept[0]).otherwise(F.concat(head, F.lit(" and "), F.element_at(kept, -1)))


def figure_label(text: Column) -> Column:
    """``Figure 3`` or ``Table 3`` of the first mention, else null."""
    pattern = r"(?i)\b(Fig(?:ure)?\.?|Table)\s*(\d+)"
    kind, number = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(number != "", F.concat(F.when(F.lower(kind).startswith("tab"), "Table ").otherwise("Figure "), number))


def clock(seconds: Column, total: Column) -> Column:
    """M:SS, or H:MM:SS where the whole is an hour or longer."""
    s = F.floor(seconds).cast("long")
    return F.when(total >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(
        F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    )


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**30))
