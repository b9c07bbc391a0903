"""Cleaning, tokens, sentences, language and display of texts (X01-X20), all built-in expressions.

Classes of word characters and spaces are written out, since Java's, Python's and RE2's
shorthands differ beyond ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
#: Link, mention, tag and emoji patterns; mentions and tags are ASCII.
URL = r"(?i)(?:https?://|www\.)[^" + SPACE + "]+"
MENTION, HASHTAG = r"@[A-Za-z0-9_]{1,64}", r"#[A-Za-z0-9_]{1,64}"
EMOJI = r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
#: Words that tell English.
ENGLISH = "a an and are as at bank be by central for from has have in inflation interest is market news of on rate rates said says stock that the to was with".split()
#: Ranges of letters by script, in the order that decides ties.
SCRIPTS = {"ru": r"\x{0400}-\x{04FF}", "latin": "A-Za-z", "ar": r"\x{0600}-\x{06FF}", "zh": r"\x{3400}-\x{9FFF}", "he": r"\x{0590}-\x{05FF}"}


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def squeeze(text: Column) -> Column:
    """Single spaces, none at the ends (X11)."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def blank(text: Column) -> Column:
    """Nothing but spaces, or null: what squeeze leaves nothing of. The search ends at the first other character."""
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACE}]")


def urls(text: Column) -> Column:
    """(X01) Links without the punctuation behind them."""
    return F.filter(F.transform(_all(text, URL), lambda u: F.regexp_replace(u, "[.,!?:;]+$", "")), lambda u: u != "")


def mentions(text: Column) -> Column:
    """(X02)"""
    return _all(text, MENTION)


def hashtags(text: Column) -> Column:
    return _all(text, HASHTAG)


def cleaned(text: Column) -> Column:
    """(X03, X04) Without links, mentions, tags, emoji and punctuation but %, in lower case.

    Most texts hold none of the signs that these begin with; finding a sign is cheaper than searching for the pattern.
    """
    low, far = F.lower(text), F.octet_length(text) > F.length(text)
    marked = low.contains("://") | low.contains("www.") | text.contains("@") | text.contains("#")
    plain = text
    for pattern in (URL, MENTION, HASHTAG):
        plain = F.regexp_replace(plain, pattern, " ")
    plain = F.when(marked, plain).otherwise(text)
    plain = F.when(far, F.regexp_replace(plain, EMOJI, " ")).otherwise(plain)
    return F.trim(F.regexp_replace(F.lower(plain), f"[^{WORD}%]+", " "))  # spaces are no word characters


def tokens(clean: Column) -> Column:
    """(X05)"""
    return F.filter(F.split(clean, " "), lambda t: t != "")


def sentences(text: Column) -> Column:
    """(X06) At least one unless the text is blank."""
    parts = F.size(F.filter(F.split(text, "[.!?]+"), lambda p: squeeze(p) != ""))
    return F.when(squeeze(text) == "", 0).otherwise(F.greatest(F.lit(1), parts))


def language(text: Column, least: float = 0.55) -> Column:
    """(X08) struct(language, confidence) by shares of scripts and, for Latin, English words."""
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    far = text.rlike(r"[\x{0400}-\x{9FFF}]")  # all scripts but Latin; few texts are searched for each of them
    counts = {name: count(f"[{r}]+") if name == "latin" else F.when(far, count(f"[{r}]+")).otherwise(0) for name, r in SCRIPTS.items()}
    words = "|".join(w for w in ENGLISH if len(w) > 1)
    hits = F.regexp_count(F.lower(text), F.lit(f"(?<![a-z])(?:{words})(?![a-z])"))
    seen = F.struct(count(r"\p{L}+").alias("letters"), *(c.alias(name) for name, c in counts.items()), hits.alias("hits"), F.lower(text).rlike("[a-z]{2}").alias("words"))
    # a bound variable: what is counted is counted once
    return F.get(F.transform(F.array(seen), lambda s: _language_of(s, least)), F.lit(0))


def _language_of(s: Column, least: float) -> Column:
    most = F.greatest(*(s[name] for name in SCRIPTS))
    script = F.coalesce(*(F.when(s[name] == most, F.lit(name)) for name in SCRIPTS))
    share = most / s["letters"]
    english = F.greatest(share * F.least(F.lit(1.0), s["hits"] / 2), F.when(s["hits"] > 0, 0.5).otherwise(0.0))
    out = lambda name, value: F.struct(name.alias("language"), value.cast("double").alias("confidence"))
    latin = F.when(~s["words"], out(F.lit("und"), share)).when(english >= least, out(F.lit("en"), english)).otherwise(out(F.lit("other"), share))
    return F.when(s["letters"] == 0, out(F.lit("und"), F.lit(0.0))).when(share < least, out(F.lit("und"), share)).when(script == "latin", latin).otherwise(out(script, share))


def detected_language(name: Column, confidence: Column, fallback: Column, least: float = 0.55) -> Column:
    """(X10) A detector's answer, the fallback where it has none (null); two letters or other, und below the threshold."""
    known = F.when(name.isNull(), fallback).when((confidence < least) & (name != "und"), "und").otherwise(name)
    return F.when(known.isin("und", "other") | known.rlike("^[a-z]{2}$"), known).otherwise("other")


def flags(text: Column) -> Column:
    """(X07) struct of whether there are links, mentions and tags."""
    return F.struct(text.rlike(URL).alias("has_urls"), text.rlike(MENTION).alias("has_mentions"), text.rlike(HASHTAG).alias("has_hashtags"))


def analysis_mode(name: Column, full: tuple[str, ...] = ("ru", "en")) -> Column:
    """(X09)"""
    return F.when(name == "und", "unknown").when(name.isin(*full), "full").otherwise("partial")


def shortened(text: Column, most: int) -> Column:
    """(X12) With three dots if it is longer."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def graph_label(text: Column, most: int = 48) -> Column:
    """(X13) A message's label in a graph: blanks squeezed, three dots behind the first characters if there are more."""
    plain = squeeze(F.coalesce(text, F.lit("")))
    return F.when(F.length(plain) > most, F.concat(F.rtrim(F.substring(plain, 1, most)), F.lit("..."))).otherwise(plain)


def snippet(text: Column, most: int = 220) -> Column:
    return shortened(squeeze(F.coalesce(text, F.lit(""))), most)


def topic_label(inferred: Column, exact: Column, entities: Column, shown: Column, cluster: Column) -> Column:
    """(X14) The first of: given labels, two entities, a short snippet, the id."""
    two = F.array_join(F.slice(entities, 1, 2), " / ")
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(inferred), blank(exact), blank(two), blank(F.substring(shown, 1, 80)), cluster)


def source_status(exact_type: Column, inferred_type: Column) -> Column:
    """(X15)"""
    known = lambda c: c.isNotNull() & (c != "unknown")
    return F.when(known(exact_type), "exact").when(known(inferred_type), "probable").otherwise("unknown")


def mood(score: Column, border: float = 0.2) -> Column:
    """(X17)"""
    return F.when(score > border, "positive").when(score < -border, "negative").otherwise("neutral")


def channel_name(reference: Column) -> Column:
    """(X18) Name of a channel from @name, a link or a plain name; null for private links and anything else."""
    plain = F.regexp_replace(F.trim(reference), r"^(?:https?://)?(?:www\.)?t\.me/(?:s/)?", "@")
    name = F.regexp_extract(plain, r"^@?([A-Za-z][A-Za-z0-9_]{4,31})/?$", 1)
    return F.nullif(name, F.lit(""))


def start_date(asked: Column, today: Column, floor: str = "2026-01-01") -> Column:
    """(X19) Null before the floor, no later than today."""
    return F.when(asked >= F.lit(floor).cast("date"), F.least(asked, today))


def registry_status(validation: Column, registry: Column, open_days: Column) -> Column:
    """(X20) Of a registered channel: validation first, then open days of its backfill, then the registry."""
    return (
        F.when((validation == "pending") | (registry == "pending_validation"), "validating").when((validation == "failed") | (registry == "validation_failed"), "validation_failed")
        .when((F.coalesce(open_days, F.lit(0)) > 0) | (registry == "backfilling"), "backfilling").when(registry == "live_enabled", "live_enabled").otherwise("ready")
    )


def channel_status(enabled: Column, total: Column, done: Column, failed: Column, running: Column, has_data: Column) -> Column:
    """(X20) From its jobs."""
    return (
        F.when(~enabled, "disabled").when(running > 0, "backfilling").when((total > 0) & (done == total), "ready").when(failed > 0, F.when(has_data, "partial").otherwise("failed")).when(total > 0, "pending").otherwise(F.when(has_data, "ready").otherwise("pending"))
    )


def slug(text: Column) -> Column:
    """(X43)"""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), f"[^{WORD}]+", "_"), "^_+|_+$", "")


def surface(text: Column) -> Column:
    """(X46) Without quotes and brackets, one kind of dash, shouting in title case."""
    plain = squeeze(F.regexp_replace(F.regexp_replace(text, r"[\"'«»“”„()\[\]{}]", ""), "[–—−]", "-"))
    return F.when((F.length(plain) > 5) & (F.upper(plain) == plain), F.initcap(F.lower(plain))).otherwise(plain)
