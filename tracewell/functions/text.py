"""Text functions as Column expressions: everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of lexical search.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on",
    "or", "that", "the", "to", "was", "were", "what", "which", "who", "with",
)

# Question words that coverage does not count.
QUESTION_WORDS = (
    "how", "what", "which", "who", "whom", "whose", "when", "where", "why", "does", "do", "did", "is", "are", "was",
    "were", "can", "could", "should", "shall", "will", "would", "many", "much", "according", "provide", "provides",
    "consume", "consumes", "require", "requires", "depend", "depends", "belong", "belongs", "include", "includes",
    "list", "order", "ids", "link", "connect", "connects", "communicate", "communicates", "carry", "carries", "use",
    "uses", "apply", "applies", "happen", "happens", "stored", "store", "using", "between", "into", "over", "this",
    "that", "these", "those", "their",
)


def tokenize(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits without stop words, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


def stem_variants(term: Column) -> Column:
    """The term and its light suffix-stripped forms, sorted."""
    n = F.length(term)

    def cut(k: int, add: str = "") -> Column:
        return F.concat(F.substring(term, F.lit(1), n - k), F.lit(add))

    forms = [
        F.when(term.endswith("ies") & (n > 4), cut(3, "y")),
        F.when(term.endswith("es") & (n > 3), cut(2)),
        F.when(term.endswith("s") & (n > 3), cut(1)),
        F.when(term.endswith("ed") & (n > 4), cut(2)),
        F.when(term.endswith("ed") & (n > 4), cut(1)),
        F.when(term.endswith("ing") & (n > 5), cut(3)),
        F.when(term.endswith("ing") & (n > 5), cut(3, "e")),
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(term, *forms))))


# Forms that the evidence gate takes for one.
PRE_STEMS = {
    "provide": "provide", "provides": "provide", "provided": "provide",
    "consume": "consume", "consumes": "consume", "consumed": "consume",
    "require": "require", "requires": "require", "required": "require",
    "depend": "depend", "depends": "depend", "depended": "depend",
}


def gate_variants(term: Column) -> Column:
    """The variants under which the gate looks for a term: the one form of a listed verb, else `stem_variants`."""
    fixed = F.create_map(*[F.lit(x) for pair in PRE_STEMS.items() for x in pair])[term]
    return F.when(fixed.isNotNull(), F.array(fixed)).otherwise(stem_variants(term))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 4))


def chunk_id(sha: Column, version: Column, section: Column, seq: Column, text: Column) -> Column:
    """Content-addressed id: 16 hex digits over document, version, section, number and text."""
    return F.substring(F.sha1(F.concat_ws("|", F.substring(sha, 1, 12), version, section, F.lpad(seq.cast("string"), 4, "0"), F.substring(F.sha1(text), 1, 12))), 1, 16)


def normalize_key(kind: Column, ident: Column, name: Column) -> Column:
    """type:ID in upper case where the id looks like one, else type:name in lower case."""
    shaped = ident.rlike("^[A-Za-z]{1,4}-[0-9]{1,4}$")
    return F.concat(kind, F.lit(":"), F.when(shaped, F.upper(ident)).otherwise(F.lower(F.trim(name))))


def is_page_number(line: Column) -> Column:
    return line.rlike("(?i)^\\s*(?:page\\s+)?[0-9]{1,3}\\s*$")


def is_banner(line: Column, patterns: tuple[str, ...]) -> Column:
    return line.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


HEADING = "^([0-9]{1,2}(?:\\.[0-9]{1,2}){0,3})\\.?\\s+(\\S.*)$"


def heading(line: Column) -> Column:
    """struct(no, title) of a numbered heading, else null."""
    no, title = F.regexp_extract(F.trim(line), HEADING, 1), F.trim(F.regexp_extract(F.trim(line), HEADING, 2))
    return F.when((no != "") & (F.length(title) <= 120) & title.rlike("^\\p{Lu}"), F.struct(no.alias("no"), title.alias("title")))


def heading_level(no: Column) -> Column:
    return F.length(no) - F.length(F.replace(no, F.lit("."), F.lit(""))) + 1


def section_key(no: Column) -> Column:
    """A sortable form of a dotted number."""
    return F.transform(F.split(no, "\\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def page_text(lines: Column) -> Column:
    """Lines joined, words broken at a line end rejoined, blanks squeezed."""
    joined = F.regexp_replace(F.array_join(lines, "\n"), "([\\p{L}\\p{N}_])-\n", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, "[ \t]+", " "), "\n{3,}", "\n\n"))


def linearize_table(headers: Column, rows: Column) -> Column:
    """A heading line of columns and a line of `header: value` pairs per row, empty cells left out."""
    pairs = F.transform(rows, lambda r: F.array_join(F.filter(F.zip_with(headers, r, lambda h, v: F.when(v != "", F.concat(h, F.lit(": "), v))), lambda x: x.isNotNull()), " | "))
    return F.array_join(F.concat(F.array(F.concat(F.lit("Table columns: "), F.array_join(headers, " | "))), pairs), "\n")


def normalize_rows(rows: Column) -> Column:
    """Null cells become '', line feeds blanks; rows of empty cells go."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))))
    return F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))


def parse_table(text: Column) -> Column:
    """Rows of pipe-separated lines whose number of cells is that of the first line."""
    rows = F.transform(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|"))), lambda x: F.transform(F.split(x, "\\|"), lambda c: F.trim(c)))
    return F.filter(rows, lambda r: F.size(r) == F.size(F.get(rows, F.lit(0))))


def guess_version(text: Column) -> Column:
    """The first `V1.2` or `version 1.2.3`, else the first x.y.z, else ''."""
    named, bare = F.regexp_extract(text, "(?i)\\bv(?:ersion)?\\s*([0-9]+\\.[0-9]+(?:\\.[0-9]+)?)", 1), F.regexp_extract(text, "\\b([0-9]+\\.[0-9]+\\.[0-9]+)\\b", 1)
    return F.when(named != "", named).otherwise(bare)


def pages_label(lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, lo.cast("string")).otherwise(F.concat_ws("-", lo.cast("string"), hi.cast("string")))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, "(?<=[.!?])\\s+"), lambda s: s != "")


def safe_filename(name: Column) -> Column:
    base = F.trim(F.element_at(F.split(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1))
    base = F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._ -]", "_"), "^[. ]+|[. ]+$", "")
    base = F.when(base == "", "upload.pdf").when(F.lower(base).endswith(".pdf"), base).otherwise(F.concat(base, F.lit(".pdf")))
    return F.concat(F.substring(base, F.lit(1), F.least(F.length(base) - 4, F.lit(100))), F.substring(base, F.length(base) - 3, F.lit(4)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def escape_html(text: Column) -> Column:
    for found, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(found), F.lit(put))
    return text


def digest10(*parts: Column) -> Column:
    """Ten hex digits of the SHA-256 of the parts joined by a pipe."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 10)


def sorted_keys(keys: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(keys)), ",")
