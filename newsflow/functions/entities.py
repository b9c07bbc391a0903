"""Clean-up of entity names (X42, X44, X45, M09), all expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow.functions.semantics import title_case

#: Single words that name no entity.
STOP_WORDS = (
    "глава", "президент", "министр", "депутат", "чиновник", "правительство", "администрация", "суд", "прокуратура", "город", "район", "область", "край", "республика", "компания", "корпорация", "банк", "партия", "комитет", "совет", "федерация",
    "страна", "страны", "улица",
)
#: Legal forms of organisations.
LEGAL_FORMS = ("ооо", "оао", "зао", "пао", "ао", "нко", "ип", "гуп", "муп", "фгуп", "уфгуп", "кфх")
#: Other names of places.
SYNONYMS = {"LOC": {"сша": "Соединенные Штаты", "соединенные штаты америки": "Соединенные Штаты", "рф": "Россия", "российская федерация": "Россия"}}


def is_noise(text: Column, stop: tuple[str, ...] = STOP_WORDS, least: int = 3) -> Column:
    """(X44) Empty, too short, a number or a single stop word."""
    compact = F.regexp_replace(F.lower(text), "[^0-9a-zа-яё]+", "")
    single = ~F.trim(text).rlike(r"\s")
    return text.isNull() | (F.length(compact) < least) | compact.rlike("^[0-9]*$") | (F.lower(text).isin(*stop) & single)


def synonym(text: Column, kind: Column, synonyms: dict[str, dict[str, str]] = SYNONYMS) -> Column:
    """(X45) The other name by type and lower-case text, or null."""
    pairs = [(f"{t}:{k}", v) for t, names in synonyms.items() for k, v in names.items()]
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs for x in pair)), F.concat_ws(":", kind, F.lower(text)))


def without_legal_forms(text: Column, forms: tuple[str, ...] = LEGAL_FORMS) -> Column:
    """(X45) The words that are no legal form, the text if none is left."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: ~F.lower(F.trim(w, F.lit("."))).isin(*forms))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(text)


def flattened(*lists: Column) -> Column:
    """(X42, X41) One list of several (null counts as empty), in order and without repeats."""
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))


def canonical(text: Column) -> Column:
    """(M09) Short names in capitals stay, others get title case. Inflected forms are not led back to one another: that needs a dictionary."""
    return F.when((F.length(text) <= 5) & (F.upper(text) == text), text).otherwise(title_case(text))
