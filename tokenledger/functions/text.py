"""Column functions on texts, names and figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripting languages of the web define it, beyond ASCII as well.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def half_up(x: Column, digits: int = 0) -> Column:
    """x rounded to digits places, halves upwards (towards positive infinity)."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits if digits else F.floor(x + 0.5).cast("long")


def normalize_model(model: Column) -> Column:
    """The text after the last slash, trimmed."""
    return F.trim(F.substring_index(model, "/", -1))


def _decoded(uri: Column) -> Column:
    """Percent-decoded; text that is badly encoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri)


def project_from_uri(uri: Column) -> Column:
    """The last segment of a folder's URI or path, 'unknown' where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(_decoded(uri), r"([^/\\]+)[/\\]*$", 1), F.lit("")), F.lit("unknown"))


def norm_uri(uri: Column) -> Column:
    """A URI decoded, without slashes at its end, in lower case."""
    return F.lower(F.regexp_replace(_decoded(uri), r"[/\\]+$", ""))


def norm_path(path: Column) -> Column:
    """A path with slashes only, in lower case."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def _words(text: Column, longer_than: int) -> Column:
    parts = F.split(F.regexp_replace(text, r"[^a-z0-9]+", " "), " ")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda w: F.length(w) > longer_than)))


def prompt_words(text: Column) -> Column:
    """Distinct words of two letters and more (lower case, ASCII letters and digits), sorted: prompts within a session are compared by them."""
    return _words(F.lower(text), 1)


def long_words(text: Column) -> Column:
    """As prompt_words, of three letters and more: tools are ranked by them."""
    return _words(F.lower(text), 2)


def history_norm(text: Column) -> Column:
    """Lower case, fenced code dropped, white space collapsed and trimmed, the first 500 characters."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"(?s)```.*?```", " "), SPACE + "+", " ")
    return F.left(F.trim(plain), F.lit(500))


def history_words(norm: Column) -> Column:
    """Distinct words of three letters and more of a normalised prompt, sorted."""
    return _words(norm, 2)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct elements; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def has_word(text: Column, alternatives: str) -> Column:
    """Whether a text holds one of the alternatives between ASCII word boundaries, without regard to case."""
    return text.rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{alternatives})(?![A-Za-z0-9_])")


def has_output_cap(text: Column, brief: str) -> Column:
    """Whether a text bounds its answer: a word of brief, or '<N words' right behind a letter or digit."""
    return has_word(text, brief) | text.rlike(rf"(?i)[A-Za-z0-9_]<{SPACE}*[0-9]+{SPACE}*(?:words|lines|tokens)(?![A-Za-z0-9_])")


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", half_up(x, digits) if digits else x)


def format_usd(x: Column, style: str = "price") -> Column:
    """Dollars as text. price: 4, 3 or 2 places by size; short: 4 or 3; compact: thousands as k; axis: both."""
    four, three, two, k = (F.concat(F.lit("$"), c) for c in (_fixed(x, 4), _fixed(x, 3), _fixed(x, 2), F.concat(_fixed(x / 1000, 1), F.lit("k"))))
    if style == "price":
        return F.when(x == 0, "$0").when(x < 0.01, four).when(x < 1, three).otherwise(two)
    if style == "short":
        return F.when(x < 0.01, four).otherwise(three)
    small = three if style == "compact" else F.when(x >= 0.001, three).otherwise(four)
    return F.when(x >= 1000, k).when(x >= 1, two).otherwise(small)


def format_tokens(n: Column, style: str = "millions") -> Column:
    """Token counts as text. millions: M and k with one place; panel: k alone, whole from 10 000 on."""
    plain, k = n.cast("string"), F.concat(_fixed(n / 1000, 1), F.lit("k"))
    if style == "panel":
        return F.when(n >= 10_000, F.concat(half_up(n / 1000).cast("string"), F.lit("k"))).when(n >= 1000, k).otherwise(plain)
    return F.when(n >= 1_000_000, F.concat(_fixed(n / 1e6, 1), F.lit("M"))).when(n >= 1000, k).otherwise(plain)


def strip_panels(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """A reply without what the patterns match, each replaced in turn by its own text, trimmed."""
    for pattern, by in patterns:
        text = F.regexp_replace(text, pattern, by)
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def finish_reason(hit_cap: Column, tool_calls: Column, duplicate: Column) -> Column:
    """How a turn ended: skipped as a duplicate, cut at the cap, stopped after tools, or stopped."""
    return F.when(duplicate, "duplicate_skipped").when(hit_cap, "length").when(tool_calls > 0, "tool_calls_then_stop").otherwise("stop")


def whole_workspace(ref_ids: Column) -> Column:
    """Whether a reference stands for the whole workspace."""
    return F.coalesce(F.exists(ref_ids, lambda r: F.lower(r).contains("workspace") | F.lower(r).contains("codebase")), F.lit(False))
