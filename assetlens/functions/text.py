"""Text expressions: tokens, concepts, names, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no concept.
STOPWORDS = ["a", "an", "and", "asset", "element", "for", "in", "into", "of", "on", "or", "the", "to", "vfx", "with"]


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), 1)


def concepts(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """Distinct canonical tokens: underscores and hyphens part words; stopwords, numbers and single letters go."""
    words = F.filter(tokens(F.translate(text, "_-", "  ")), lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$") & ~w.isin(STOPWORDS))
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in sorted(aliases.items()) for x in pair])
        words = F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w))
    return F.array_distinct(words)


def csv_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(F.ltrim(value).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


# Endings that say nothing of what a file shows.
MASTER_ENDINGS = ["master", "proxy", "preview", "prores", "h264", "h265", "exr", "dpx"]
SIZE_ENDINGS = ["480p", "720p", "1080p", "2k", "4k", "6k", "8k", "uhd", "hd", "sd"]


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot begins no extension."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def normalized_root(path: Column, keep_numbers: bool = False) -> Column:
    """Lower-case stem without a frame number, one master, one size and one version ending, squeezed to underscores."""
    plain = F.lower(stem(path))
    out = plain if keep_numbers else F.regexp_replace(plain, r"(?<![a-z])[0-9]{2,8}$", "")
    for endings in (MASTER_ENDINGS, SIZE_ENDINGS):
        out = F.regexp_replace(out, f"[._-]?(?:{'|'.join(endings)})$", "")
    if not keep_numbers:
        out = F.regexp_replace(out, r"[._-]+v[0-9]{1,4}$", "")
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", plain).otherwise(out)


def phrase_concepts(text: Column, phrases: list[tuple[str, str]], aliases: dict[str, str] | None = None) -> Column:
    """Concepts of a text in which phrases, taken in table order, stand for one concept each and their words for none."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "  "), F.lit(" "))
    for k, (phrase, _) in enumerate(phrases):
        spaced = F.regexp_replace(spaced, " " + " +".join(phrase.split()) + " ", f" #{k}# ")
    words = F.filter(F.split(F.trim(spaced), " +"), lambda w: w != "")
    marks = F.create_map(*[F.lit(x) for k, (_, c) in enumerate(phrases) for x in (f"#{k}#", c)], *[F.lit(x) for pair in sorted((aliases or {}).items()) for x in pair])
    kept = F.filter(words, lambda w: w.startswith("#") | ((F.length(w) >= 2) & ~w.rlike("^[0-9]+$") & ~w.isin(STOPWORDS)))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda w: F.coalesce(F.element_at(marks, w), w))))


def snake(value: Column) -> Column:
    """Runs of anything but ASCII letters and digits become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def has_any(value: Column, needles: list[str]) -> Column:
    """Whether any needle stands in the text with a blank put at both of its ends."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(value, F.lit(""))), F.lit(" "))
    return F.greatest(*[F.contains(padded, F.lit(n)) for n in needles], F.lit(False))


def clauses(text: Column) -> Column:
    """Clauses of a text, cut at punctuation and at but, however, whereas."""
    return F.split(F.lower(text), r"[.;,!?:]|\b(?:but|however|whereas)\b")


def affirmative_words(text: Column) -> Column:
    """Words that the text affirms: no clause of doubt, none of the six words before it a negator, no copula and not after it."""
    # Words of doubt and negators.
    doubt = r"\b(?:unclear|uncertain|possibly|perhaps|whether|cannot determine)\b"
    negators = ["no", "not", "without", "neither", "absent"]
    kept = F.filter(clauses(text), lambda c: ~c.rlike(doubt))
    words = F.transform(kept, lambda c: F.regexp_extract_all(c, F.lit("([a-z0-9_]+)"), 1))

    def affirmed(ws: Column) -> Column:
        def ok(w: Column, i: Column) -> Column:
            start = F.greatest(i - 5, F.lit(1))
            before = F.slice(ws, start, i + 1 - start)
            behind = F.concat_ws(" ", F.slice(ws, i + 2, 3))
            return ~w.isin(negators) & ~F.arrays_overlap(before, F.array(*map(F.lit, negators))) & ~behind.rlike("^(?:(?:is|are|was|were) )?(?:not|absent)\\b")

        return F.filter(ws, ok)

    return F.flatten(F.transform(words, affirmed))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once a row; inside a lambda it would be worked out for every element."""
    return F.transform(F.array(value), use)[0]


def bucket_counts(words: Column, buckets: int = 64) -> Column:
    """Tokens in each hash bucket: the first 32 bits of a token's MD5, modulo the number of buckets."""
    at = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(buckets)))
    return _once(at, lambda a: F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(a, lambda x: x == b))))


def unit_vector(counts: Column) -> Column:
    """Counts divided by their Euclidean norm; all zeros stay."""
    def scaled(exact: Column) -> Column:
        norm = F.sqrt(F.aggregate(exact, F.lit(0.0), lambda s, x: s + x * x))
        return _once(norm, lambda n: F.transform(exact, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    return _once(F.transform(counts, lambda x: x.cast("double")), scaled)
