"""Text expressions, all within Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaria.constants import CATEGORY_ALIASES, CLUSTERS, HIGH_RISK_LABELS, SCRIPTS

URL = r"(?i)https?://\S+|www\.\S+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: What (?U)\s stands for.
_BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def ascii_only(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def one_line(c: Column) -> Column:
    return F.replace(F.replace(strip(c), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s\s+", " ")


def without_urls(c: Column) -> Column:
    """URLs become blanks; texts that hold no beginning of one skip the pattern."""
    low = F.lower(c)
    return F.when(F.contains(low, F.lit("http")) | F.contains(low, F.lit("www.")), F.regexp_replace(c, URL, " ")).otherwise(c)


def lower_line(c: Column | str) -> Column:
    return F.lower(one_line(col(c)))


def clean(line: Column | str) -> Column:
    """Lower-case words only: no URLs, digits, punctuation or symbols. line: a column of lower_line(), which is read more than once.

    In texts of ASCII only, the classes are spelled out, which takes a fraction of the time.
    """
    rest = without_urls(col(line))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"\s\s+", " "), "[^a-z_ ]+", ""), "  +", " ")
    any_ = squeeze(F.regexp_replace(squeeze(rest), r"(?U)[^\w\p{Zs}]|\d", ""))
    return strip(F.when(ascii_only(col(line)), plain).otherwise(any_))


def tokens(text: Column | str, beyond: Column | str) -> Column:
    """The number of words of a cleaned text; beyond: of beyond_ascii()."""
    c = col(text)
    blanks = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return F.when(c == "", 0).when(col(beyond) == "", blanks + 1).otherwise(F.size(F.split(c, r"(?U)\s+")))


def has_url(c: Column | str) -> Column:
    low = F.lower(col(c))
    return (F.contains(low, F.lit("http")) | F.contains(low, F.lit("www."))) & col(c).rlike(URL)


def has_hashtag(c: Column | str) -> Column:
    return F.contains(col(c), F.lit("#")) & col(c).rlike(r"(?U)#\w+")


def has_symbol(c: Column | str) -> Column:
    return F.when(ascii_only(col(c)), col(c).rlike(r"[$+<=>^`|~]")).otherwise(col(c).rlike(r"[\p{So}\p{Sk}\p{Sc}\p{Sm}]"))


def letter_words(text: Column | str) -> Column:
    """What stands between characters that are no letters."""
    return F.when(ascii_only(col(text)), F.split(col(text), "[^A-Za-z]+")).otherwise(F.split(col(text), r"[^\p{L}]+"))


def clean_native(c: Column | str) -> Column:
    """Without line ends and URLs; case, digits and punctuation stay."""
    return strip(squeeze(without_urls(one_line(col(c)))))


def script_columns(text: Column | str, beyond: Column | str) -> dict[str, Column]:
    """Letter counts by script of a cleaned text; ``other`` counts letters of any further script.

    beyond: of beyond_ascii(). A cleaned text's ASCII characters are letters, blanks and _; the patterns read only what is left.
    """
    plain = F.length(F.replace(F.replace(col(text), F.lit(" "), F.lit("")), F.lit("_"), F.lit(""))) - F.length(col(beyond))
    counts = {s: F.when(col(beyond) == "", 0).otherwise(F.regexp_count(col(beyond), F.lit(p))) for s, p in {"letter": r"\p{L}", **SCRIPTS}.items()}
    counts |= {"letter": counts["letter"] + plain, "latin": counts["latin"] + plain}
    return {"clean_letter_count": counts.pop("letter"), **{f"{s}_char_count": n for s, n in counts.items()}}


def beyond_ascii(text: Column | str) -> Column:
    return F.when(F.octet_length(col(text)) == F.length(col(text)), F.lit("")).otherwise(F.regexp_replace(col(text), r"[\x00-\x7F]+", ""))


def dominant_script(names: list[str]) -> Column:
    """The first script with the largest count (``other`` last); ``none`` without letters."""
    most = F.greatest(*[F.col(f"{s}_char_count") for s in names])
    out = F.when(F.col("clean_letter_count") == 0, F.lit("none"))
    for s in names:
        out = out.when(F.col(f"{s}_char_count") == most, F.lit(s))
    return out


def keyword_hits(text: Column | str, words: list[str]) -> Column:
    """All occurrences of whole keywords in a lower-cased text, the longest alternative first."""
    alternatives = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    return F.regexp_extract_all(F.lower(col(text)), F.lit(rf"\b({alternatives})\b"), F.lit(1))


def parsed_label(raw: Column | str) -> Column:
    """struct(label, iso639_3, script) of a raw model label; blank labels are null."""
    label = F.regexp_replace(F.trim(col(raw)), "^__label__", "")
    label = F.when(label != "", label)
    part = lambda k: F.when(F.get(F.split(label, "_"), F.lit(k)) != "", F.get(F.split(label, "_"), F.lit(k)))
    return F.struct(label.alias("label"), part(0).alias("iso639_3"), part(1).alias("script"))


def cluster_of(label: Column | str, iso: Column | str) -> Column:
    """The review cluster of a label, else of its language; null if neither has one."""
    table = F.create_map(*[F.lit(x) for name, keys in CLUSTERS.items() for k in keys for x in (k, name)])
    return F.coalesce(F.element_at(table, col(label)), F.element_at(table, col(iso)))


def high_risk(label: Column | str) -> Column:
    return F.coalesce(col(label).isin(HIGH_RISK_LABELS), F.lit(False))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.try_divide(a, b))


def label_key(c: Column | str) -> Column:
    return F.lower(F.trim(F.replace(col(c), F.lit("&"), F.lit("and"))))


def category_id(label: Column | str, names: dict[str, str]) -> Column:
    """The id of a category given by id, name or alias; null if unknown."""
    known = {k: k for k in names} | {n.lower().replace("&", "and"): k for k, n in names.items()} | CATEGORY_ALIASES
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), label_key(label))


def subscribers(c: Column | str) -> Column:
    """A count written as a number or as text such as ``1.2M`` or ``3k subscribers``; null if none or negative."""
    text = F.lower(F.trim(col(c).cast("string")))
    number = F.regexp_replace(text, ",", "")
    first = F.regexp_extract(number, r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    unit = F.regexp_extract(number, r"-?[0-9]+(?:\.[0-9]+)?\s*(billion|million|thousand|b|m|k)?\b", 1)
    scale = F.when(unit.isin("billion", "b"), 1e9).when(unit.isin("million", "m"), 1e6).when(unit.isin("thousand", "k"), 1e3).otherwise(1.0)
    value = F.floor(F.coalesce(text.try_cast("double"), first * scale)).cast("long")
    return F.when(value >= 0, value)


def order_hash(*parts: Column | str, strategy: str = "md5") -> Column:
    """A value to order samples by: xxhash64, or md5 of the parts' text, which other engines have too."""
    cols = [col(p).cast("string") for p in parts]
    return F.xxhash64(*cols) if strategy == "xxhash64" else F.md5(F.concat_ws("|", *cols))
