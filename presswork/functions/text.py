"""Scalar text functions as column expressions; all stay inside whole-stage code generation.

NULL inputs count as empty text unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space of the Unicode standard that regular expressions of other engines call \s.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize_ws(c: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(c), f"{SPACE}+", " "))


def content_hash(c: Column) -> Column:
    """SHA-256 of the UTF-8 text in hex; that of the empty text for NULL."""
    return F.sha2(text_or_empty(c), 256)


def slugify(c: Column, max_length: int = 72) -> Column:
    """Lower-case ASCII slug; one that is too long is cut and ends in ten hex digits of the original's hash."""
    t = text_or_empty(c)
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(t)), "[^0-9a-z]+", "_"), "^_+|_+$", "")
    s = F.when(s == "", "item").otherwise(s)
    return F.when(F.length(s) <= max_length, s).otherwise(F.concat(F.left(s, F.lit(max_length - 11)), F.lit("_"), F.left(F.sha2(t, 256), F.lit(10))))


def title_key(c: Column) -> Column:
    """Title for comparisons: lower case, everything but ASCII letters and digits is a space."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), "[^0-9a-z]+", " "))


def prompt_tokens(c: Column) -> Column:
    """Estimated prompt tokens: 0 for empty text, else a quarter of the characters, at least 1."""
    n = F.char_length(text_or_empty(c))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("bigint")


def words(c: Column) -> Column:
    """White-space-separated words; none for empty text."""
    return F.filter(F.split(normalize_ws(c), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("bigint")


def truncate_text(c: Column, limit: int) -> Column:
    return F.left(normalize_ws(c), F.lit(limit))


def model_text(title: Column, body: Column, limit: int = 900) -> Column:
    """Title, a blank line and the first words of the body; without title the body only."""
    t, b = normalize_ws(title), F.array_join(F.slice(words(body), 1, limit), " ")
    return F.when((t != "") & (b != ""), F.concat(t, F.lit("\n\n"), b)).when(t != "", t).otherwise(b)


def model_ready(body: Column, counted: Column, least: int = 120) -> Column:
    """An article with text and enough words for a topic model."""
    return (normalize_ws(body) != "") & (F.coalesce(counted.cast("string").try_cast("double"), F.lit(0.0)) >= least)


def to_float(c: Column) -> Column:
    """A number from its text, NULL for anything else."""
    return F.trim(text_or_empty(c)).try_cast("double")


def with_subtype(name: Column, subtype: Column) -> Column:
    """The name with its subtype behind it, unless it holds it already."""
    n, s = normalize_ws(name), normalize_ws(subtype)
    return F.when((s == "") | F.lower(n).contains(F.lower(s)), n).otherwise(F.concat_ws(" ", F.nullif(n, F.lit("")), s))


def elapsed(seconds: Column) -> Column:
    """Seconds as hours, minutes and seconds."""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60)


def model_input(title: Column, body: Column, limit: int, summary: Column | None = None) -> Column:
    """struct(title, text) for a model: the summary where there is one and a body to sum up, else the body, cut at the
    limit."""
    whole = normalize_ws(body)
    chosen = whole if summary is None else F.when((whole != "") & (normalize_ws(summary) != ""), normalize_ws(summary)).otherwise(whole)
    return F.struct(normalize_ws(title).alias("title"), F.left(chosen, F.lit(limit)).alias("text"))


def first_rule(c: Column, rules: list[tuple[str, str]], default: str, whole: bool = False) -> Column:
    """Outcome of the first rule (word, outcome) whose word the text holds, or is if `whole`, without regard to case."""
    t = F.lower(normalize_ws(c))
    out = F.lit(default)
    for word, outcome in reversed(rules):
        out = F.when(t == word.lower() if whole else t.contains(word.lower()), outcome).otherwise(out)
    return out


def token_set(c: Column) -> Column:
    """Distinct lower-case ASCII words, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("([a-z0-9]+)"))))


def canonical_phrase(c: Column) -> Column:
    """Lower case without punctuation and quotes, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}\s]", " "), f"{SPACE}+", " "))


def first_of_list(c: Column) -> Column:
    """First entry of a text that lists several, separated by ; , | or a slash."""
    return F.trim(F.split(text_or_empty(c), "[;,|/]").getItem(0))


def split_terms(c: Column) -> Column:
    """Entries of a list text (; , |), trimmed, without empty ones, first spelling of each kept in order."""
    parts = F.filter(F.transform(F.split(text_or_empty(c), "[;,|]"), normalize_ws), lambda x: x != "")
    return dedupe_ordered(parts)


def dedupe_ordered(parts: Column) -> Column:
    """Array without later repeats, compared without regard to case."""
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)),
    )


def search_string(terms: Column) -> Column:
    """Quoted alternatives of a search: "a" OR "b"."""
    return F.array_join(F.transform(terms, lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit("")), F.lit('"'))), " OR ")


def normalise_key(c: Column) -> Column:
    """Quotes and apostrophes in one form, lower case, white space collapsed."""
    return F.lower(normalize_ws(F.translate(text_or_empty(c), "‘’‛′“”«»", "''''\"\"\"\"")))


def capitalised(c: Column) -> Column:
    t = text_or_empty(c)
    return F.concat(F.upper(F.left(t, F.lit(1))), F.substr(t, F.lit(2)))


def to_bool(c: Column) -> Column:
    """true/1/yes/y and false/0/no/n in any case; NULL for anything else."""
    t = F.lower(F.trim(text_or_empty(c)))
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n"), False)


def label_action(c: Column) -> Column:
    return F.when(c == "relevant", "keep").when(c == "irrelevant", "drop").otherwise("review")


def rfc822_utc(c: Column) -> Column:
    """Instant of a mail date with a named or numeric zone, NULL where it is none."""
    t = F.regexp_replace(normalize_ws(c), r"^[A-Za-z]{3},\s*", "")
    numeric = F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z"))
    named = F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss z"))
    return F.when(t.rlike(r"[+-]\d{4}$"), numeric).otherwise(named)


def serialize(array: Column, mark: str = " | ") -> Column:
    return F.coalesce(F.array_join(array, mark), F.lit(""))
