"""String expressions. Regular expressions are Unicode-aware: ``(?U)`` makes \\s and \\w mean what they say."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Legal forms stripped from names.
LEGAL_FORMS = ("incorporated", "corporation", "corp", "inc", "ltd", "limited", "llc", "plc", "co", "company", "holding", "holdings", "nv", "sa", "ag", "kk")
#: Bare references of a filer to itself.
SELF_REFERENCES = ("we", "our", "us", "ourselves", "the company", "the filer")
#: Fixed value: the form of a citation, accession:section:sequence in brackets.
CITATION = r"\[([0-9\-]+:[IVX]+\.[0-9A-Z]+:[0-9]{4})\]"
#: Fixed value: wordings by which an answer declines.
REFUSAL = (
    r"(?i)does not (contain|include|provide)|not available|no (information|data|filings)|cannot (be )?(determin|answer|find)"
    r"|isn't|is not in the (context|filings|corpus)|not an SEC filer"
)


#: Words that scale the number before them.
SCALES = {"trillion": 1e12, "billion": 1e9, "bn": 1e9, "b": 1e9, "million": 1e6, "mn": 1e6, "m": 1e6}


def tidy_code(value: Column) -> Column:
    """Letter case, blanks and separators of a source or language code made alike; blank is null."""
    tidy = F.regexp_replace(F.lower(F.trim(F.regexp_replace(value, r"(?U)[\s]+", " "))), r"[\s_-]+", "_")
    return F.when(tidy != "", tidy)


def tidy_ticker(value: Column) -> Column:
    tidy = F.upper(F.trim(value))
    return F.when(tidy != "", tidy)


def tidy_form(value: Column) -> Column:
    """``Form 10-k``, ``10K`` and ``10-K `` are 10-K; amendments (``/A``) stay apart."""
    bare = F.regexp_replace(F.upper(F.trim(value)), r"^FORM\s+", "")
    tidy = F.regexp_replace(bare, r"^(\d+)[\s-]*([A-Z]+)", "$1-$2")
    return F.when(tidy != "", tidy)


def comparable_quote(value: Column) -> Column:
    """Lower case, with every run of blanks and quotation marks as one space."""
    return F.trim(F.lower(F.regexp_replace(value, "(?U)[\\s’'\"“”]+", " ")))


def quote_in_text(quote: Column, text: Column) -> Column:
    """Whether a quote is found in a text, blanks and quotation marks aside; an empty quote is."""
    return F.contains(comparable_quote(text), comparable_quote(quote))


def squeezed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def comparable_name(value: Column) -> Column:
    """A name in lower case without punctuation and legal forms."""
    bare = F.regexp_replace(F.lower(value), r"(?U)[^\w\s]", " ")
    return squeezed(F.regexp_replace(bare, rf"(?U)\b({'|'.join(LEGAL_FORMS)})\b", " "))


def title_case(value: Column) -> Column:
    """Each letter after a non-letter in upper case, all others in lower case (unlike ``initcap``, which
    knows word starts after blanks only)."""
    marked = F.regexp_replace(F.lower(value), r"(?<!\p{L})(\p{L})", "\u0001$1")
    parts = F.split(marked, "\u0001")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))))), "")


def sentences(value: Column) -> Column:
    return F.split(value, r"(?U)(?<=[.!?])\s+")


def citations(value: Column) -> Column:
    """Distinct citation ids in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit(CITATION), F.lit(1)))


def is_citation_id(value: Column) -> Column:
    return value.rlike(r"^[0-9\-]+:[IVX]+\.[0-9A-Z]+:[0-9]{4}$")


def is_refusal(value: Column) -> Column:
    return value.rlike(REFUSAL)


def question_key(question: Column, strategy: Column) -> Column:
    """Key of an answer: a hash of the strategy and the question without case, spacing and final marks."""
    plain = F.regexp_replace(squeezed(F.lower(question)), r"[?.! ]+$", "")
    return F.left(F.sha2(F.concat_ws("|", strategy, plain), 256), F.lit(32))


def short_hash(value: Column, digits: int = 16) -> Column:
    return F.left(F.sha2(value, 256), F.lit(digits))


def risk_key(chunk_id: Column, summary: Column) -> Column:
    return F.left(F.sha1(F.concat_ws("|", chunk_id, summary)), F.lit(16))


def grouped_usd(value: Column) -> Column:
    return F.concat(F.format_number(value, 0), F.lit(" USD"))


def numbers(value: Column) -> Column:
    """The numbers of a text as doubles, scaled by a following word (1.5 billion is 1.5e9).

    Commas are dropped first; what is no number after all (1.2.3) is left out.
    """
    pattern = r"(?i)\$?([0-9][0-9.]*)\s*(billion|bn|b\b|million|mn|m\b|trillion)?"
    plain = F.regexp_replace(value, ",", "")
    found = F.arrays_zip(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(plain, F.lit(pattern), F.lit(2)).alias("u"))

    def scaled(x: Column) -> Column:
        by = F.lit(1.0)
        for word, factor in SCALES.items():
            by = F.when(F.lower(x["u"]) == word, factor).otherwise(by)
        return x["n"].try_cast("double") * by

    return F.filter(F.transform(found, scaled), lambda v: v.isNotNull())


def section_marker(value: Column) -> Column:
    """A candidate section name: without '(continued)', then without up to three page digits, in lower case."""
    text = F.regexp_replace(F.trim(value), r"(?iU)\s*\(continued\)\s*$", "")
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s*\d{1,3}$", "")))
