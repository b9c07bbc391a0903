"""Canonical names (M09): inflected forms of a word led back to one another, without a dictionary.

Inflection is induced from the words of all names. Two words are forms of each other if they
share a stem and their endings are a pair that occurs with several stems (anna, anny; marta,
marty). An ending that makes words which inflect themselves derives a new word (ivan, ivanov,
ivanova) and is no inflection. Forms that are connected are one word, shown by its most frequent
form. Everything is joins and counts over distinct words; a stem's words are as many as there
are endings, not as there are mentions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.entities import canonical
from newsflow.operators.components import components
from newsflow.session import shared_folder, written

#: Letters of a stem, letters of an ending, stems that a pair of endings needs.
STEM, ENDING, SUPPORT = 3, 3, 3
#: Endings by which parts of a person's name are told apart, in any case.
PATRONYMICS = r"(?:ович|евич|ич|овн|евн|ичн)(?:а|у|ем|ом|е|ы|ой|и)?$"
SURNAMES = r"(?:ов|ев|ёв|ин|ын|енко|швили|дзе|ян|ук|юк)(?:а|у|ым|ом|е|ой|ы)?$|(?:ск|цк)(?:ий|ого|ому|им|ом|ая|ой|ую)$"


def words_of(names: DataFrame) -> DataFrame:
    """names(text) -> word (lower case), n: words with a letter; short ones in capitals are left out."""
    split = names.where("text is not null").select(F.explode(F.split(F.trim("text"), r"\s+")).alias("w")).where(F.col("w").rlike(r"\p{L}"))
    return split.where(~((F.upper("w") == F.col("w")) & (F.length("w") <= 5))).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))


def inflections(words: DataFrame, stem: int = STEM, ending: int = ENDING, support: int = SUPPORT) -> DataFrame:
    """words(word, n) -> pairs of words that are forms of each other: a, b, with their endings."""
    cuts = F.sequence(F.lit(0), F.least(F.lit(ending), F.length("word") - stem))
    split = words.where(F.length("word") >= stem).select("word", F.explode(cuts).alias("k")).select("word", F.col("word").substr(F.lit(1), F.length("word") - F.col("k")).alias("stem"), F.expr("right(word, k)").alias("ending"))
    x, y = split.alias("x"), split.alias("y")
    # the longest common beginning is the stem, so a pair of words is looked at once
    apart = (F.col("x.ending") < F.col("y.ending")) & ((F.col("x.ending") == "") | (F.substring("x.ending", 1, 1) != F.substring("y.ending", 1, 1)))
    pairs = x.join(y, (F.col("x.stem") == F.col("y.stem")) & apart).select(F.col("x.stem").alias("stem"), F.col("x.word").alias("a"), F.col("y.word").alias("b"), F.col("x.ending").alias("ea"), F.col("y.ending").alias("eb"))
    pairs = pairs.checkpoint()
    usual = pairs.groupBy("ea", "eb").agg(F.count_distinct("stem").alias("stems")).where(F.col("stems") >= support).select("ea", "eb")
    pairs = pairs.join(usual, ["ea", "eb"])
    # a word with endings of its own, put behind a stem that is a word, is another word
    grown = pairs.where("ea = ''").groupBy(F.col("a").alias("b")).agg(F.count("*").alias("own")).where("own >= 2")
    derived = pairs.where("ea = ''").join(grown.select("b"), "b", "left_semi").select("a", "b")
    pairs = pairs.join(derived, ["a", "b"], "left_anti")
    # forms of the new word keep their links to it and to one another, not those to the old stem
    families = derived.select(F.col("b").alias("stem")).distinct()
    inside = pairs.join(families, "stem", "left_semi").select(F.explode(F.array("a", "b")).alias("word")).distinct().withColumn("inside", F.lit(True))
    mark = lambda c: inside.select(F.col("word").alias(c), F.col("inside").alias(f"in_{c}"))
    marked = pairs.join(mark("a"), "a", "left").join(mark("b"), "b", "left")
    return marked.where(F.coalesce("in_a", F.lit(False)) == F.coalesce("in_b", F.lit(False))).select("a", "b", "stem", "ea", "eb")


def word_forms(words: DataFrame, **limits: int) -> DataFrame:
    """words(word, n) -> word, shown: the most frequent of its forms, of equally frequent ones the shortest, then the first."""
    shared_folder(words.sparkSession)
    found = components(inflections(words, **limits).select("a", "b")).select(F.col("node").alias("word"), "root")
    rooted = words.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))
    shown = rooted.groupBy("root").agg(F.min_by("word", F.struct((-F.col("n")).alias("n"), F.length("word"), "word")).alias("shown"))
    return rooted.join(shown, "root").select("word", "shown")


def ordered_person(words: Column) -> Column:
    """Surname, name and patronymic, the first of each, if there is a surname or a name beside a patronymic; else the words as they are."""
    patronymic = F.filter(words, lambda w: w.rlike(PATRONYMICS))
    surname = F.filter(words, lambda w: ~w.rlike(PATRONYMICS) & w.rlike(SURNAMES))
    name = F.filter(words, lambda w: ~w.rlike(PATRONYMICS) & ~w.rlike(SURNAMES))
    known = (F.size(surname) > 0) & (F.size(words) > 1)
    return F.when(known, F.concat(*(F.slice(part, 1, 1) for part in (surname, name, patronymic)))).otherwise(words)


def canonical_names(mentions: DataFrame, **limits: int) -> DataFrame:
    """(M09) mentions(entity_text, entity_type, ...) with canonical: each word by its shown form, people as surname, name, patronymic, title case; short words in capitals stay.

    Names are rebuilt once for each distinct text, for which 128 bits stand: its words don't carry
    it with them. A text without a letter stays as it is; null has null. Mentions are read several
    times, so they are written first: what finds them in texts runs once.
    """
    mentions = written(mentions.drop("canonical"))
    forms = word_forms(words_of(mentions.select(F.col("entity_text").alias("text"))), **limits)
    person = F.upper(F.coalesce("entity_type", F.lit(""))).isin("PER", "PERSON").alias("person")
    key = [F.xxhash64("entity_text").alias("_one"), F.xxhash64(F.lit("two"), "entity_text").alias("_two")]
    texts = mentions.where("entity_text is not null").select(*key, person, "entity_text").dropDuplicates(["_one", "_two", "person"])
    each = texts.select("_one", "_two", "person", F.posexplode(F.split(F.trim("entity_text"), r"\s+")).alias("at", "w")).where(F.col("w").rlike(r"\p{L}"))
    each = each.withColumn("word", F.lower("w")).join(forms, "word", "left")
    short = (F.upper("w") == F.col("w")) & (F.length("w") <= 5)
    built = each.groupBy("_one", "_two", "person").agg(F.array_sort(F.collect_list(F.struct("at", F.when(short, F.col("w")).otherwise(F.coalesce("shown", "word")).alias("w")))).alias("ws"))
    ws = F.transform("ws", lambda x: x["w"])
    ordered = F.when(F.col("person"), ordered_person(ws)).otherwise(ws)
    named = built.select("_one", "_two", "person", F.array_join(F.transform(ordered, canonical), " ").alias("canonical"))
    out = mentions.select("*", *key, person).join(named, ["_one", "_two", "person"], "left").drop("_one", "_two", "person")
    return out.withColumn("canonical", F.coalesce("canonical", "entity_text"))
