"""Text columns: trimming, folding, tokenising, hashing features."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from citeloom import fixed

# Characters that NFKC never changes, alone or beside each other. Text made of
# these only is passed through without leaving the JVM.
_NFKC_STABLE = r"^[\x00-\x7fÀ-ÖØ-öø-ı一-鿿㐀-䶿。、]*$"


def _normalise_nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def _fold(values: pd.Series) -> pd.Series:
    return values.map(str.casefold, na_action="ignore")


# Characters whose case folding is their lower-casing (``ß`` aside, which is
# replaced below).
_FOLD_STABLE = (
    r"^[\x00-\xb4\xb6-\u0148\u014a-\u017e\u2010-\u206f\u3000-\u303f\u3400-\u4dbf\u4e00-\u9fff\uff00-\uffef]*$"
)


def nfkc(text: Column) -> Column:
    """Unicode NFKC; only rows holding characters it may change visit Python."""
    convert = F.pandas_udf(_normalise_nfkc, StringType())
    return F.coalesce(convert(F.when(~text.rlike(_NFKC_STABLE), text)), text)


def casefold(text: Column) -> Column:
    """Full Unicode case folding; common text stays in the JVM.

    Lower-casing plus ``ß`` to ``ss`` is exact for rows made of the stable
    ranges; any other row uses an Arrow function.
    """
    convert = F.pandas_udf(_fold, StringType())
    return F.coalesce(convert(F.when(~text.rlike(_FOLD_STABLE), text)), native_fold(text))


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(fixed.SPACE_CHARS))


def collapse_space(text: Column) -> Column:
    """Runs of whitespace become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"[{fixed.SPACE_CLASS}]+", " "))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.length(strip(text)) == 0)


def sha(*parts: Column) -> Column:
    """Hex SHA-256 of the parts joined by newlines; NULL parts count as '-'."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), 256)


def stable_ids(ids: Column) -> Column:
    """Trim, drop blanks, keep the first of each id; order is kept."""
    return F.array_distinct(F.filter(F.transform(ids, strip), lambda v: F.length(v) > 0))


# --- questions ---------------------------------------------------------------


def clean_question(text: Column) -> Column:
    return strip(F.regexp_replace(text, fixed.ANY_CONTROL, ""))


def question_problem(cleaned: Column) -> Column:
    """NULL for a usable question, else why it is refused."""
    return (
        F.when(cleaned.isNull() | (F.length(cleaned) == 0), F.lit("EMPTY_QUESTION"))
        .when(F.length(cleaned) > fixed.MAX_QUESTION_CHARS, F.lit("QUESTION_TOO_LONG"))
        .otherwise(F.lit(None).cast("string"))
    )


def normalise_query(cleaned: Column) -> Column:
    marks = "".join("\\" + m if m in ".?!" else m for m in fixed.PUNCTUATION_AFTER_SPACE)
    return F.regexp_replace(collapse_space(nfkc(cleaned)), f"[{fixed.SPACE_CLASS}]+([{marks}])", "$1")


def apply_aliases(normalised: Column) -> tuple[Column, Column]:
    """The text with every alias replaced in order, and the aliases that hit."""
    current, applied = normalised, []
    for alias, canonical in fixed.QUERY_ALIASES:
        if alias.isascii():
            pattern = f"(?iu)(?<![A-Za-z0-9]){alias}(?![A-Za-z0-9])"
            replaced, hit = F.regexp_replace(current, pattern, canonical), current.rlike(pattern)
        else:
            replaced, hit = F.replace(current, F.lit(alias), F.lit(canonical)), current.contains(alias)
        applied.append(F.when(hit, F.lit(f"{alias}→{canonical}")))
        current = replaced
    return current, F.filter(F.array(*applied), lambda v: v.isNotNull())


# --- tokens ------------------------------------------------------------------

def _bigrams(run: Column) -> Column:
    return F.when(
        F.length(run) > 1,
        F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))),
    ).otherwise(F.expr("cast(array() as array<string>)"))


def _characters(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, i, F.lit(1)))


def lexical_tokens(text: Column) -> Column:
    """ASCII words lower-cased and CJK runs as bigrams, repeats kept."""
    ascii_lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(ascii_lower, F.lit("([a-z0-9]+)"), 1)
    runs = F.regexp_extract_all(ascii_lower, F.lit(f"([a-z0-9]+|[{fixed.CJK_CLASS}]+)"), 1)
    mixed = F.flatten(
        F.transform(runs, lambda r: F.when(r.rlike("^[a-z0-9]"), F.array(r)).otherwise(_bigrams(r)))
    )
    return F.when(text.rlike(f"[{fixed.CJK_CLASS}]"), mixed).otherwise(words)


def diagnostic_tokens(text: Column) -> Column:
    """Distinct folded words, CJK characters and CJK bigrams."""
    folded = casefold(text)
    words = F.regexp_extract_all(folded, F.lit("([A-Za-z0-9]+)"), 1)
    runs = F.regexp_extract_all(folded, F.lit(f"([A-Za-z0-9]+|[{fixed.CJK_CLASS}]+)"), 1)
    mixed = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(r.rlike("^[A-Za-z0-9]"), F.array(r)).otherwise(
                F.concat(_characters(r), _bigrams(r))
            ),
        )
    )
    return F.array_distinct(F.when(text.rlike(f"[{fixed.CJK_CLASS}]"), mixed).otherwise(words))


def hash_tokens(text: Column) -> Column:
    return F.regexp_extract_all(casefold(text), F.lit(f"([{fixed.CJK_UNIFIED_CLASS}]|[a-z0-9]+)"), 1)


def hash_buckets(text: Column) -> Column:
    """The bucket (0-1023) of every token occurrence of the text."""
    return F.transform(
        hash_tokens(text),
        lambda t: (
            F.conv(F.substring(F.sha2(t, 256), 1, 8), 16, 10).cast("bigint") % fixed.HASH_DIMENSION
        ).cast("int"),
    )


# --- comparison keys ---------------------------------------------------------


def near_text_key(text: Column) -> Column:
    """Folded text without spaces and punctuation; underscores stay."""
    return F.regexp_replace(collapse_space(casefold(text)), r"(?U)[^\w一-鿿]+", "")


def locator_key(text: Column) -> Column:
    """NFKC, folded, without whitespace, punctuation and symbols."""
    return F.regexp_replace(casefold(nfkc(text)), rf"[{fixed.SPACE_CLASS}\p{{P}}\p{{S}}]+", "")


def question_key(text: Column) -> Column:
    """NFKC, folded, letters and numbers only."""
    return F.regexp_replace(casefold(nfkc(text)), r"[^\p{L}\p{N}]+", "")


def question_fingerprint(text: Column) -> Column:
    return F.sha2(question_key(text), 256)


def heading_title(text: Column) -> Column:
    """The normalised heading, or NULL when empty, too long or unprintable."""
    title = collapse_space(nfkc(text))
    usable = (F.length(title) > 0) & (F.length(title) <= fixed.MAX_HEADING_CHARS) & ~title.rlike(r"\p{C}")
    return F.when(usable, title)


# --- splitting ---------------------------------------------------------------


def sentences(text: Column) -> Column:
    """Pieces that end after a sentence mark or a newline; joined they give the text."""
    return F.filter(
        F.split(text, f"(?<=[{fixed.SENTENCE_MARKS}])", -1), lambda s: F.length(s) > 0
    )


def hard_pieces(text: Column, size: int) -> Column:
    return F.when(
        F.length(text) > 0,
        F.transform(
            F.sequence(F.lit(1), F.length(text), F.lit(size)),
            lambda i: F.substring(text, i, F.lit(size)),
        ),
    ).otherwise(F.expr("cast(array() as array<string>)"))


# --- checks ------------------------------------------------------------------


def iso_date(text: Column) -> Column:
    """The date of a strict YYYY-MM-DD text, else NULL."""
    parsed = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(parsed, "yyyy-MM-dd") == text), parsed)


def native_fold(text: Column) -> Column:
    """Lower-casing with ``ß`` as ``ss``, for use inside lambdas, where Arrow functions cannot run."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def covers_points(answer: Column, points: Column) -> Column:
    """Every reference point occurs in the answer, compared by :func:`native_fold`."""
    return F.coalesce(
        ~is_blank(answer)
        & (F.size(points) > 0)
        & F.forall(points, lambda p: native_fold(answer).contains(native_fold(strip(p)))),
        F.lit(False),
    )


def generation_available(answered: Column, refused: Column, reason: Column) -> Column:
    return F.coalesce(
        (answered & ~refused & reason.isNull()) | (refused & (reason == fixed.MODEL_REFUSED)), F.lit(False)
    )


def mapped(key: Column, pairs) -> Column:
    """Look a fixed, small code table up as an expression; NULL when absent."""
    entries = [F.lit(v) for pair in pairs for v in pair]
    return F.try_element_at(F.create_map(*entries), key)
