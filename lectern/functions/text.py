"""Scalar text functions. Every function builds a Column from Columns; nothing here runs Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space the trimming and tokenising rules know (Unicode spaces, line ends, BOM).
WS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WORD = r"\p{L}\p{M}\p{N}_"
# One Han character, or a run of other letters/digits, or one symbol that is not white space.
TOKEN = rf"\p{{IsHan}}|[{WORD}&&[^\p{{IsHan}}]]+|[^{WS}{WORD}]"

# Summary-question keywords, and patterns of model errors.
SUMMARY_KEYWORDS = "总结|汇总|盘点|概览|全貌|罗列|列出|亮点|要点|重点|有哪些|有什么|有几个|都做了|做了什么|进展如何|整体情况"
TOKEN_LIMIT_PATTERN = (
    r"(?is)token limit|maximum context length|context_length_exceeded|context length\b"
    r"|超出[^\n]*(?:上下文|context)|上下文[^\n]*(?:超出|溢出|超过)"
)
RETRYABLE_PATTERN = r"(?i)HTTP (?:429|502|503|504)|overload|rate.?limit|too many requests|engine.busy"


def tokens(text: Column) -> Column:
    """TXT-1: word tokens; punctuation kept, white space dropped, one token per Han character."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def terms(text: Column) -> Column:
    """Index terms: the tokens in lower case."""
    return tokens(F.lower(text))


def token_count(text: Column) -> Column:
    """TXT-2."""
    return F.coalesce(F.size(tokens(text)), F.lit(0))


def content_hash(data: Column) -> Column:
    """TXT-3: SHA-256 in lower-case hex."""
    return F.sha2(data, 256)


def trim_ws(text: Column) -> Column:
    """TXT-4: trim every kind of white space (``trim`` would take spaces only)."""
    return F.regexp_replace(text, rf"\A[{WS}]+|[{WS}]+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{WS}]")


def version_key(extractor_version: Column, opts: Column, parser_version: int = 2) -> Column:
    """TXT-5: FNV-1a, 32 bit, over ``parser|extractor|opts`` (ASCII keys), as a BIGINT."""
    key = F.concat_ws("|", F.lit(parser_version).cast("string"), extractor_version.cast("string"), opts)
    codes = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.ascii(F.substr(key, i, F.lit(1))))
    return F.aggregate(
        codes,
        F.lit(2166136261).cast("bigint"),
        lambda h, c: (h.bitwiseXOR(c.cast("bigint")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)),
    )


def heading_text(path: Column) -> Column:
    """TXT-6."""
    return F.array_join(path, " > ")


def preview(text: Column, n: int = 200) -> Column:
    """TXT-7."""
    return F.substring(text, 1, n)


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def citation_marks(text: Column) -> Column:
    """TXT-8: every ``[N]`` of an answer, in order, as numbers."""
    marks = F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.transform(marks, lambda m: m.try_cast("bigint"))


_TAIL = rf"((?:[{WS}]*+\[\d++\])++)[{WS}]*+\z"  # possessive, so that a long run needs no stack


def trailing_citations(text: Column) -> tuple[Column, Column]:
    """TXT-9: (text without its trailing run of ``[N]``, the numbers of that run)."""
    tail = F.regexp_extract(text, _TAIL, 1)
    return trim_ws(F.regexp_replace(text, _TAIL, "")), citation_marks(tail)


def is_summary_question(text: Column, keywords: str = SUMMARY_KEYWORDS) -> Column:
    """TXT-10."""
    return text.rlike(keywords)


def note_filename(question: Column, ts: Column) -> Column:
    """TXT-11: first 20 characters made safe for a file name, then the time; the time alone if none are left."""
    head = F.regexp_replace(F.substring(question, 1, 20), r'[\\/:*?"<>|]', "-")
    head = F.regexp_replace(head, rf"\A[{WS}.\-]+|[{WS}.\-]+\z", "")
    stamp = F.date_format(ts, "yyyy-MM-dd HH-mm-ss")
    return F.concat(F.when(head != "", F.concat(head, F.lit(" "))).otherwise(F.lit("")), stamp, F.lit(".md"))


def title_slug(title: Column, n: int = 50) -> Column:
    """TXT-11, title form: unsafe characters become ``_``."""
    return F.substring(F.regexp_replace(title, r'[\\/:*?"<>|]', "_"), 1, n)


def classify_error(msg: Column) -> dict[str, Column]:
    """TXT-12: what a model error message says; limits are null where the message gives none."""

    def number_after(words: str, of: Column = msg) -> Column:
        """The number that stands right behind one of the words."""
        return F.regexp_extract(of, rf"(?i)\b(?:{words})\W+(\d+)", 1).try_cast("bigint")

    limit = number_after("token limit|context length is|context length")
    return {
        "is_token_limit": msg.rlike(TOKEN_LIMIT_PATTERN),
        "model_limit": limit,
        "requested": F.when(limit.isNotNull(), number_after("requested|resulted in")),
        "is_retryable": msg.rlike(RETRYABLE_PATTERN),
    }


def offset_to_line_col(text: Column, offset: Column) -> tuple[Column, Column]:
    """TXT-13: 0-based (line, column) of a clamped offset."""
    at = F.least(F.greatest(offset, F.lit(0)), F.length(text)).cast("int")
    before = F.substr(text, F.lit(1), at)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return line, F.length(F.substring_index(before, "\n", -1))


def l2_normalize(vec: Column) -> Column:
    """TXT-14: unit length; the zero vector stays as it is."""
    wide = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, wide).otherwise(F.transform(wide, lambda x: x / norm))


def decode_text(content: Column) -> Column:
    """TXT-15: UTF-8 bytes to text; a leading byte-order mark goes, bad bytes become U+FFFD."""
    bom = F.lit("\ufeff")
    valid = F.make_valid_utf8(content.cast("string"))
    return F.when(F.startswith(valid, bom), F.substring(valid, 2, 2**31 - 1)).otherwise(valid)
