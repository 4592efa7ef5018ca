"""Text as columns: words, folding, coverage, features, near duplicates, shortening and escaping."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


@cache
def _accents() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters with marks, and the same without."""
    marked, plain = [], []
    for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]):
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and unicodedata.category(base[0])[0] == "L" and all(unicodedata.combining(x) for x in base[1:]):
            marked.append(c)
            plain.append(base[0])
    return "".join(marked), "".join(plain)


def folded(text: Column) -> Column:
    """Lower case without diacritics; combining marks that stand alone go too."""
    low = F.lower(text)
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, low).otherwise(F.regexp_replace(F.translate(low, *_accents()), r"\p{Mn}+", ""))


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(folded(text), F.lit(f"({WORD})"))


def fold_terms(terms: list[str]) -> list[str]:
    """Query terms as the tokens that they match; terms that are marks alone go."""
    plain = ("".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)) for t in terms)
    return [t for t in plain if t]


def query_terms(query: str) -> list[str]:
    """The terms of a query: whatever white space and other signs than letters and digits part."""
    import unicodedata as u

    return "".join(c if u.category(c)[0] in "LN" or c.isspace() else " " for c in query).split()


def terms_of(text: Column) -> Column:
    """query_terms of a column."""
    parts = F.split(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " "), r"\s+")
    return F.filter(parts, lambda x: x != "")


def coverage(terms: list[str], content: Column) -> Column:
    """The share of terms that occur anywhere in the content, in either case."""
    if not terms:
        return F.lit(0.0)
    low = F.lower(content)
    hits = sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    return hits / F.lit(float(len(terms)))


def words(content: Column) -> Column:
    """Runs of letters and digits of a text in lower case, marks kept."""
    return F.filter(F.split(F.regexp_replace(F.lower(content), r"[^\p{L}\p{N}\s]+", " "), r"\s+"), lambda x: x != "")


def features_of(words: Column) -> Column:
    """The distinct words, and runs of three words in sorted order."""
    runs = F.transform(shifted(words, 3), lambda z: F.array_join(F.array_sort(F.array(z["a"], z["b"], z["c"])), " "))
    return F.array_distinct(F.concat(words, runs))


def features(content: Column) -> Column:
    return features_of(words(content))


def shifted(words: Column, n: int) -> Column:
    """Structs a, b, c, ... of each n neighbours, so that functions of them refer to no whole array, which would cost its length each."""
    names = "abcdefghijklmnopqrstuvwxyz"[:n]
    rows = F.arrays_zip(*(F.slice(words, i + 1, F.greatest(F.size(words) - (n - 1), F.lit(0))).alias(c) for i, c in enumerate(names)))
    return rows.cast("array<struct<" + ",".join(f"{c}:string" for c in names) + ">>")


def jaccard(a: Column, b: Column) -> Column:
    """Common over all of two sets; two empty sets are alike, an empty and another are not."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, 1.0).otherwise(common / every)


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


#: Characters from which on a beginning counts as a near duplicate.
LONG = 40


def near_duplicate(a: str, b: str) -> bool:
    """Equal, or one begins with the other and that is of LONG characters or more; both normalized."""
    return a == b or (min(len(a), len(b)) >= LONG and (a.startswith(b) or b.startswith(a)))


def near_duplicates(a: Column, b: Column) -> Column:
    long = F.least(F.length(a), F.length(b)) >= LONG
    return (a == b) | (long & (F.startswith(a, b) | F.startswith(b, a)))


def shortened(text: Column, most: int) -> Column:
    """Texts of more than `most` characters cut to that, three dots included."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def preview(text: Column, most: int = 60) -> Column:
    """One line: control characters and white space collapsed, cut with an ellipsis."""
    line = F.trim(F.regexp_replace(text, r"[\x00-\x1f\x7f\s]+", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


#: Closing tags that could end the block which memories are shown in.
_TAGS = ((r"(?i)</memory_context>", "&lt;/memory_context&gt;"), (r"(?i)</recalled_memories>", "&lt;/recalled_memories&gt;"), (r"(?i)</memory([\s>])", "&lt;/memory$1"))


def escaped(text: Column) -> Column:
    for pattern, put in _TAGS:
        text = F.regexp_replace(text, pattern, put)
    return text


def escape(text: str) -> str:
    for pattern, put in _TAGS:
        text = re.sub(pattern, put.replace("$1", r"\1"), text)
    return text


def dot_label(text: Column) -> Column:
    """Backslashes, line ends and quotes as DOT writes them."""
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit('"'), F.lit('\\"'))


#: Signs that a workspace file tells an agent to keep memories in files.
FILE_MEMORY = (r"memory/YYYY-MM-DD", r"MEMORY\.md", r"(?i)WRITE IT TO A FILE", r"(?i)memory maintenance", r"(?i)daily.*notes.*memory/", r"memory/\d{4}-\d{2}-\d{2}", r"(?i)curated.*memor", r"(?i)update.*MEMORY\.md")


def about_file_memory(text: Column) -> Column:
    out = F.lit(False)
    for pattern in FILE_MEMORY:
        out = out | text.rlike(pattern)
    return out


def has_event_token(body: Column, token: Column) -> Column:
    """The trimmed body, or one trimmed line of it, is the trimmed token; blank ones match nothing."""
    want = F.trim(token)
    line = F.exists(F.split(body, r"\r?\n"), lambda x: F.trim(x) == want)
    return F.coalesce((want != "") & (F.trim(body) != "") & ((F.trim(body) == want) | line), F.lit(False))


def language_of(profile: Column) -> Column:
    """The first word behind 'Kielet:', 'Language:' or 'Languages:' in either case, or an empty text."""
    return F.regexp_replace(F.regexp_extract(profile, r"(?i)(?:Kielet|Languages?)\s*[:\uFF1A]\s*(\S+)", 1), "[,;]$", "")


def two_places(x: Column) -> Column:
    """A number with two decimals; halves as they are stored go up."""
    return F.format_string("%.2f", F.floor(x * 100 + 0.5) / 100)
