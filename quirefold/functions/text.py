"""Text functions as column expressions; Unicode classes throughout."""

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the query semantics.
ASSESSMENT_STOP = "a an about and are can could does for from how in is of on the to what when where why".split()
INTENT = "a an about and can could explain for give handling how i in is me of on please show tell the to what code".split()
MODES = {
    "comparison": "compare comparison versus vs difference tradeoff tradeoffs pros cons".split(),
    "examples": "example examples sample samples".split(),
    "risks": "risk risks danger security pitfall pitfalls".split(),
    "steps": "step steps guide tutorial".split(),
    "troubleshooting": "troubleshoot troubleshooting debug diagnose diagnosis fix error issue problem".split(),
}
NEGATIONS = "no not without exclude excluding except avoid".split()
HEADING = r"(?i)^(chapter|part|section)\s+(?:[0-9]+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten)(?:\s*[:.\-]\s*|\s+|$)(.{0,200})$"


def words(value: Column) -> Column:
    """Lower-case runs of letters and numbers, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", " "), r"\s+"), lambda w: w != "")


def _set_of(tokens: Column, without: list[str] = ()) -> Column:
    return F.array_sort(F.array_distinct(F.array_except(tokens, F.array(*map(F.lit, without))) if without else tokens))


def topic_tokens(value: Column) -> Column:
    """Assessment topics: distinct sorted words that are no stop words."""
    return _set_of(words(value), ASSESSMENT_STOP)


def answer_topic_tokens(value: Column) -> Column:
    """Answer topics: also without the words that only ask for a mode."""
    return _set_of(words(value), INTENT + [w for ws in MODES.values() for w in ws])


def digit_guards(value: Column) -> Column:
    return _set_of(F.filter(words(value), lambda w: w.rlike(r"\p{Nd}")))


def answer_modes(value: Column) -> Column:
    """Sorted modes that a question's words ask for; overview if none."""
    own = words(value)
    found = F.array_compact(F.array(*[F.when(F.arrays_overlap(own, F.array(*map(F.lit, ws))), F.lit(mode)) for mode, ws in MODES.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("overview")))


def symbolic_guards(value: Column) -> Column:
    """Guards over raw tokens: digits, negations, and names such as c++ or c#."""
    raw = F.filter(F.split(F.regexp_replace(value, r"[^\p{L}\p{N}_/.:+#-]", " "), " "), lambda w: w != "")
    bare = lambda w: F.regexp_replace(w, r"^[_/.:-]+|[_/.:-]+$", "")

    def guard(w: Column) -> Column:
        named = bare(w).rlike(r"^[\p{L}\p{N}][\p{L}\p{N}+#]*$") & bare(w).rlike("[+#]")
        told = F.lower(bare(w)).isin(*NEGATIONS) | bare(w).rlike(r"\p{Nd}")
        return F.when(named, F.lower(bare(w))).when(told, F.array_join(words(w), " ")).otherwise("")

    return _set_of(F.filter(F.transform(raw, guard), lambda w: w != ""))


def collapse_lower(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")))


def normalize(value: Column) -> Column:
    """One kind of line end, no control characters but LF and TAB, lines trimmed on the right, all trimmed.

    Composition to NFC is not here: see ``nfc``.
    """
    plain = F.regexp_replace(F.regexp_replace(value, "\r\n|\r", "\n"), r"[\p{Cc}&&[^\n\t]]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\S\n]+(?=\n|$)", ""), r"(?U)^\s+|\s+$", "")


def nfc():
    """An Arrow function for canonical composition, which Spark does not have built in."""
    @F.arrow_udf("string")
    def compose(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else v if v.isascii() else unicodedata.normalize("NFC", v) for v in values.to_pylist()], pa.string())

    return compose


def first_line(value: Column) -> Column:
    """The first line that is not blank, trimmed."""
    lines = F.filter(F.transform(F.split(value, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.get(lines, F.lit(0))


def heading(value: Column) -> Column:
    """struct(chapter, section): what the first line of a page opens."""
    line = first_line(value)
    kind = F.lower(F.regexp_extract(line, HEADING, 1))
    return F.struct(F.when(kind.isin("chapter", "part"), line).alias("chapter"), F.when(kind == "section", line).alias("section"))


def word_count(value: Column) -> Column:
    return F.size(F.regexp_extract_all(value, F.lit(r"[\p{L}\p{N}]+"), 0))


def digest(*values: Column | str) -> Column:
    """SHA-256 over NUL-joined values."""
    return F.sha2(F.concat_ws("\u0000", *values), 256)


def fingerprint(*values: Column) -> Column:
    """SHA-256 over length-prefixed values, so no two lists collide by joining."""
    return F.sha2(F.concat(*[x for v in values for x in (F.octet_length(v).cast("string"), F.lit(":"), v)]), 256)
