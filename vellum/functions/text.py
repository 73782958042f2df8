"""Column builders for text: predicates, counts and normal forms.

Python's notions are kept: white space is Unicode's, word boundaries see letters of
every script, lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------

#: Letters that count as Vietnamese for scores (both cases).
VIETNAMESE = (
    "àáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵđ"
    "ÀÁẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬÈÉẺẼẸÊẾỀỂỄỆÌÍỈĨỊÒÓỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÙÚỦŨỤƯỨỪỬỮỰỲÝỶỸỴĐ"
)
#: Vietnamese function words.
FUNCTION_WORDS = (
    "của và là trong với được cho các này đó những một có không từ đến trên theo bằng về như để khi nếu hoặc nhưng vì tại cũng đã sẽ đang rằng mà hay còn hơn nhất rất"
).split()
MATH_SYMBOLS = r"+\-*/=<>≤≥≠≈∞∑∏∫∂∇±×÷∈∉⊂⊃∪∩∀∃∧∨¬→←↔⇒⇐⇔αβγδεζηθικλμνξπρστυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΠΡΣΤΥΦΧΨΩ"
NUMBER = r"-?[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?"
METADATA = r"(?i)(arxiv:|@[\w.]+\.(com|edu|org)|university of|department of|proceedings of|conference on|et al\.|©|copyright)"
SENTENCE_END = r"[.!?。！？]\s*$"
HEADING = r"^[0-9]+(\.[0-9]+)*\s+\w"
CAPTION = r"(?i)^(Figure|Fig\.|Table|Algorithm|Appendix)\s"
SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: The characters of SPACE.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

TOKEN, STRIP = f"[^{SPACE}]+", f"^[{SPACE}]+|[{SPACE}]+$"
WORD = r"[\p{L}\p{N}_]+"


def _of(chars: str) -> str:
    """A class of these characters in Java's notation: runs of them, and ASCII told apart by the first test, so that not each character goes through a long list."""
    runs: list[list[int]] = []
    for c in sorted({ord(c) for c in chars if ord(c) > 0x7F}):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(set(chars)) if ord(c) <= 0x7F) + r"[[^\x00-\x7f]&&[" + "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in runs) + "]]]"


# The same sets as in the patterns above, for Spark alone.
VIETNAMESE_CLASS, MATH_CLASS = _of(VIETNAMESE), _of(MATH_SYMBOLS.replace("\\", ""))
TOKEN_RUN = rf"[!-~[^{SPACE}]]+"


def _lit(pattern: str) -> Column:
    return F.lit(pattern)


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, _lit(pattern), F.lit(0))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, _lit(pattern))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """Without white space at both ends; null becomes empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))  # only the ends are looked at


def tokens(text: Column) -> Column:
    return found(text, TOKEN_RUN)


def n_tokens(text: Column) -> Column:
    return count(text, TOKEN_RUN)


def english_words(text: Column, least: int = 4) -> Column:
    """Number of whole words of ``least`` ASCII letters or more."""
    return F.size(F.filter(found(text, WORD), lambda w: w.rlike(f"^[A-Za-z]{{{least},}}$")))


def function_words(text: Column) -> Column:
    return F.size(F.filter(found(F.lower(text), WORD), lambda w: w.isin(*FUNCTION_WORDS)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def has_vietnamese(text: Column) -> Column:
    return text.rlike(VIETNAMESE_CLASS)


def vietnamese_chars(text: Column) -> Column:
    return count(text, VIETNAMESE_CLASS)


def letters(text: Column) -> Column:
    return count(text, r"\p{L}")


def english_ratio(text: Column, least: int = 4) -> Column:
    return ratio(english_words(text, least), n_tokens(text))


def collapsed(text: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.array_join(tokens(F.lower(text)), " ")


def untranslated(src: Column, mt: Column) -> Column:
    """Whether a stripped translation looks like none."""
    return (
        F.when(mt == "", True)
        .when(has_vietnamese(mt), False)
        .when(collapsed(src) == collapsed(mt), True)
        .otherwise(english_ratio(mt) > 0.6)
    )


def untranslated_severity(src: Column) -> Column:
    n = n_tokens(src)
    return F.when(n <= 4, "info").when(src.rlike(HEADING), "warning").when(src.rlike(CAPTION), "info").when(n <= 15, "warning").otherwise("error")


def is_metadata(text: Column) -> Column:
    return text.rlike(METADATA)


def english_heavy(text: Column) -> Column:
    """Much English and little Vietnamese, for diagnoses; letters are matched without case."""
    n = english_words(text)
    return (F.length(strip(text)) >= 20) & (n >= 5) & (vietnamese_chars(F.lower(text)) < n * 0.5)


def truncated(src: Column, mt: Column) -> Column:
    """Long source with a translation under 0.3 of it."""
    return (F.length(src) >= 200) & ((mt == "") | (F.length(mt) < F.length(src) * 0.3))


def response_truncated(src: Column, mt: Column) -> Column:
    """The stricter form: a blank translation always, else sources over 200 stripped characters."""
    return (strip(mt) == "") | ((F.length(strip(src)) > 200) & (F.length(strip(mt)) < F.length(strip(src)) * 0.3))


def ends_at_sentence(text: Column) -> Column:
    """Ends with one of .!?;: and perhaps a closing quote or bracket; the empty text does too."""
    bare = F.regexp_replace(text, f"[{SPACE}]+$", "")
    return (text == "") | bare.rlike(r"[.!?;:]\s*[\")]?$")


def missing(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def numbers_missing(src: Column, mt: Column) -> Column:
    """Distinct numbers of the source that the translation lacks and that matter: two characters or more, or over 9."""
    gone = missing(found(src, r"[0-9]+\.?[0-9]*"), found(mt, r"[0-9]+\.?[0-9]*"))
    return F.filter(gone, lambda n: F.length(n) > 1)


def slug(name: Column) -> Column:
    """File name without extension, other characters than letters, digits, ``_`` and ``-`` as ``_``, at most 50."""
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.left(F.regexp_replace(base, r"[^\w-]+", "_"), F.lit(50))


def safe_username(name: Column) -> Column:
    clean = F.left(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\w.-]", "_"), r"^[._]+|[._]+$", ""), F.lit(64))
    return F.when(clean == "", "_anon").otherwise(clean)


def clean_field(field: Column) -> Column:
    """Trimmed to 64 characters; blank is null."""
    return F.nullif(F.left(strip(field), F.lit(64)), F.lit(""))


def friendly_name(original: Column, title: Column, job_id: Column) -> Column:
    """A name for a download: that of the file without its ending, else the title, else the id without ``pdf_``.

    Characters that file names can't hold become an underscore a run; a name without any other is ``document``.
    """
    stem = F.regexp_replace(original, r"^(.*[^/.].*)\.[^./]*$", "$1")
    base = F.coalesce(F.nullif(F.when(F.coalesce(original, F.lit("")) != "", stem).otherwise(title), F.lit("")), F.regexp_replace(job_id, "^pdf_", ""))
    return F.coalesce(F.nullif(strip(F.regexp_replace(base, r'[\\/:*?"<>|\r\n\t]+', "_")), F.lit("")), F.lit("document"))


# ---- SQL with the same meaning, for comparisons ------------------------------------


def sql_strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{STRIP}', '', 'g')"


def sql_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{TOKEN}')"


def sql_english(x: str, least: int = 4) -> str:
    return f"len(list_filter(regexp_extract_all({x}, '{WORD}'), lambda w: regexp_matches(w, '^[A-Za-z]{{{least},}}$')))"


def sql_function_words(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
    return f"len(list_filter(regexp_extract_all(lower({x}), '{WORD}'), lambda w: w in ({words})))"


def sql_collapsed(x: str) -> str:
    return f"array_to_string({sql_tokens(f'lower({x})')}, ' ')"


def sql_ratio(a: str, b: str) -> str:
    return f"case when ({b}) = 0 then 0.0 else ({a})::double / ({b}) end"


def sql_untranslated(src: str, mt: str) -> str:
    return (
        f"case when {mt} = '' then true when regexp_matches({mt}, '[{VIETNAMESE}]') then false "
        f"when {sql_collapsed(src)} = {sql_collapsed(mt)} then true else {sql_ratio(sql_english(mt), sql_count(mt, TOKEN))} > 0.6 end"
    )


def sql_severity(src: str) -> str:
    n = sql_count(src, TOKEN)
    return f"case when {n} <= 4 then 'info' when regexp_matches({src}, '{HEADING}') then 'warning' when regexp_matches({src}, '{CAPTION}') then 'info' when {n} <= 15 then 'warning' else 'error' end"
