"""Column functions: identities, token estimates, keys and text patterns. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of one estimated token for Han script and for ASCII; any other character is a token.
HAN_PER_TOKEN, ASCII_PER_TOKEN = 1.5, 4.0
#: Budget states and their bounds on used / limit.
BUDGET_OK, BUDGET_ATTENTION, BUDGET_SPLIT = "BUDGET_OK", "BUDGET_ATTENTION", "BUDGET_SPLIT_REQUIRED"
SPLIT_RATIO = 1.2
#: Durations in a text and the units they stand for, in order of precedence.
SLA_UNITS = {"工作日": "WORKING_DAY", "天": "CALENDAR_DAY", "小时": "HOUR", "分钟": "MINUTE", "周": "WEEK", "月": "MONTH"}
#: Domain tags and the patterns that give them.
DOMAIN_TAGS = {"BPMN": r"\bBPMN\b", "L4": r"\bL4\b", "L5": r"\bL5\b", "L6": r"\bL6\b", "SOP": r"\bSOP\b", "VISUAL": "可视化|VISUAL|图表|流程图"}
#: Suffixes that end a business topic, and characters that bound it on the left.
TOPIC_SUFFIXES = ["阈值", "口径", "标准", "规则", "依据", "周期", "粒度", "范围", "边界"]
TOPIC_DELIMITERS = "与和及或等的地得，。、；：？！「」“”‘’《》（）()<>[]{}· \t\r\n,.:;?!/"


def short_hash(value: Column, n: int = 12) -> Column:
    """First n hex digits of the SHA-256 of a string."""
    return F.substring(F.sha2(value, 256), 1, n)


def prefixed_id(prefix: str, value: Column, n: int = 12) -> Column:
    return F.concat(F.lit(f"{prefix}-"), short_hash(value, n))


def block_id(artifact_sha: Column, locator: Column) -> Column:
    return prefixed_id("B", F.concat_ws(":", artifact_sha, locator))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def token_parts(text: Column) -> tuple[Column, Column, Column]:
    """Numbers of Han, ASCII and other characters."""
    text = F.coalesce(text, F.lit(""))
    han = F.length(F.regexp_replace(text, r"[^\p{IsHan}]+", ""))
    ascii_ = F.length(F.regexp_replace(text, r"[^\x00-\x7F]+", ""))
    return han.cast("long"), ascii_.cast("long"), (F.length(text) - han - ascii_).cast("long")


def tokens_of(han: Column, ascii_: Column, other: Column) -> Column:
    return F.ceil(han / F.lit(HAN_PER_TOKEN) + ascii_ / F.lit(ASCII_PER_TOKEN) + other).cast("long")


def estimate_tokens(text: Column) -> Column:
    return tokens_of(*token_parts(text))


def coordinate(value: Column) -> Column:
    """A number as text with two decimals at most and no trailing zeros."""
    whole = (F.rint(value) == value) & (F.abs(value) < 1e15) & (value != 0)  # most are; -0.0 isn't among them
    return F.when(whole, value.cast("long").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), r"0+$", ""), r"\.$", ""))


def budget_status(used: Column, limit: Column) -> Column:
    """State of a budget; a limit of 0 or less is always exceeded."""
    ratio = F.when(limit > 0, used / limit).otherwise(F.lit(float("inf")))
    return F.when(ratio > SPLIT_RATIO, BUDGET_SPLIT).when(ratio >= 1.0, BUDGET_ATTENTION).otherwise(BUDGET_OK)


def token_limit(chars: int) -> int:
    """Tokens that stand for a number of characters of Han script."""
    return -int(-chars // HAN_PER_TOKEN)


def blank_null(text: Column) -> Column:
    """Null for null and empty strings."""
    return F.nullif(text, F.lit(""))


def machine_key(raw: Column) -> Column:
    """Key of a process inside the engine: trimmed, points as hyphens, 'default' if empty."""
    return F.replace(F.coalesce(blank_null(F.trim(raw)), F.lit("default")), F.lit("."), F.lit("-"))


def canonical_key(raw: Column) -> Column:
    """Key of a process as people write it: trimmed, upper case, 'default' if empty."""
    return F.upper(F.coalesce(blank_null(F.trim(raw)), F.lit("default")))


def candidate_codes(text: Column) -> Column:
    """Process codes such as CM-1.4 in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z]{1,4}-\d+(?:\.\d+)?)\b"), F.lit(1)))


def referenced_codes(text: Column) -> Column:
    """Codes that a remark refers to: two letters at least, so that block ids don't count."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z]{2,4}-\d+(?:[.-]\d+)?)\b"), F.lit(1)))


def parse_sla(text: Column) -> Column:
    """struct(value, unit, raw_text) of the first kind of duration found, else null."""
    out = F.lit(None)
    for word, unit in reversed(SLA_UNITS.items()):
        found = F.regexp_extract(text, rf"(\d+)\s*个?\s*{word}", 1)
        out = F.when(found != "", F.struct(found.cast("int").alias("value"), F.lit(unit).alias("unit"), text.alias("raw_text"))).otherwise(out)
    return out


def strip_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def event_label(label: Column, word: str) -> Column:
    """An event's label without the suffix that says what it is, such as （结束）."""
    return F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), rf"（{word}）$|\({word}\)$", ""))


def domain_tags(heading_path: Column, content: Column) -> Column:
    """Sorted tags whose pattern is in a heading or the first 500 characters."""
    where = F.concat(F.coalesce(heading_path, F.array().cast("array<string>")), F.array(F.substring(F.coalesce(content, F.lit("")), 1, 500)))
    found = lambda p: F.exists(where, lambda t: t.rlike(f"(?i){p}"))
    tags = [F.when(found(p), F.lit(tag)) for tag, p in DOMAIN_TAGS.items()]
    return F.array_sort(F.filter(F.array(*tags), lambda t: t.isNotNull()))


def topics(text: Column) -> Column:
    """Sorted business topics: a suffix with up to eight CJK characters before it, back to a delimiter."""
    bounds = "".join(rf"\{c}" if not c.isalnum() and ord(c) < 128 and not c.isspace() else c for c in TOPIC_DELIMITERS)
    cjk = rf"[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}&&[^{bounds}]]"

    def of(suffix: str) -> Column:
        # each occurrence looks back on its own, so occurrences may share characters
        ends = F.regexp_extract_all(text, F.lit(f"(?=({suffix}))"), F.lit(1))
        pieces = F.split(text, suffix)
        upto = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ends), F.lit(1))), lambda k: F.array_join(F.slice(pieces, 1, k), suffix))
        topic = F.transform(upto, lambda t: F.concat(F.regexp_extract(t, f"({cjk}{{0,8}})$", 1), F.lit(suffix)))
        return F.when(F.size(ends) > 0, topic).otherwise(F.array().cast("array<string>"))

    return F.array_sort(F.array_distinct(F.concat(*map(of, TOPIC_SUFFIXES))))


def split_values(text: Column) -> Column:
    """Values of a cell with several."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,+；，]"), lambda v: F.trim(v)), lambda v: v != "")


def looks_technical(name: Column) -> Column:
    return name.rlike(r"(?i)(?:_|\b(?:SAP|API|SQL|DB|HTTP|JSON|XML)\b)")


def personal_role(role_id: Column) -> Column:
    return role_id.rlike("(?i)^(person_|employee_|emp_|user_)")


def normal_name(name: Column) -> Column:
    """Lower-case letters, digits and single spaces of a name. Compose Unicode before (see operators.names.compose)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def names_match(a: Column, b: Column) -> Column:
    """Whether two normal names are equal, one holds the other, or their last two words agree."""
    last = lambda x: F.slice(F.split(x, " "), -2, 2)
    both = (F.size(F.split(a, " ")) >= 2) & (F.size(F.split(b, " ")) >= 2)
    return (a != "") & (b != "") & ((a == b) | F.contains(a, b) | F.contains(b, a) | (both & F.when(both, last(a) == last(b)).otherwise(False)))


def xml_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def xml_unescape(text: Column) -> Column:
    for entity, raw in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def derived_name(heading: Column, code: Column) -> Column:
    """A process's name from its heading: without the Chinese ordinal, the code and a closing remark in parentheses."""
    name = F.regexp_replace(F.trim(heading), "^[一二三四五六七八九十百千]+、\\s*", "")
    name = F.trim(F.replace(name, code, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(name, "（[^）]*）\\s*$", ""), r"\([^)]*\)\s*$", ""))


def extension(path: Column) -> Column:
    """Lower-case extension with its point, '' without one. A leading point doesn't start an extension."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*?(\.[^./\\]*)$", 1))
