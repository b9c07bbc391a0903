"""Names in several cases fall together; derived names don't."""

import random

from pyspark.sql import functions as F

from newsflow.operators import enrich, names

#: A made-up corpus: names with their forms in five cases.
MEN = ["Иван", "Степан", "Роман", "Богдан", "Тарас"]
WOMEN = ["Анн", "Марин", "Светлан", "Полин"]
SURNAMES = ["Козлов", "Лебедев", "Иванов", "Морозов", "Романов", "Степанов"]


def forms_of_man(w):
    return [w + e for e in ("", "а", "у", "ом", "е")]


def forms_of_woman(w):
    return [w + e for e in ("а", "ы", "е", "у", "ой")]


def forms_of_surname(w):
    return [w + e for e in ("", "а", "у", "ым", "е")]


def corpus():
    rng, rows, want = random.Random(1), [], {}
    for name, forms in [(m, forms_of_man(m)) for m in MEN] + [(w + "а", forms_of_woman(w)) for w in WOMEN]:
        for case in range(5):
            rows += [(forms[case], "PER")] * (12 if case == 0 else 2)
            want[forms[case]] = name
    for surname in SURNAMES:
        for case, form in enumerate(forms_of_surname(surname)):
            name, shown = rng.choice([(forms_of_man(m)[case], m) for m in MEN])
            rows += [(f"{name} {form}", "PER")] * (12 if case == 0 else 2)
            want[f"{name} {form}"] = f"{surname} {shown}"
    rows += [("МВД", "ORG"), ("NATO", "ORG"), ("газпром", "ORG"), ("Иван Петрович Козлов", "PER"), ("12", "ORG"), (None, "PER"), ("Козлов", None)]
    want |= {"МВД": "МВД", "NATO": "NATO", "газпром": "Газпром", "Иван Петрович Козлов": "Козлов Иван Петрович", "12": "12", None: None, "Козлов": "Козлов"}
    rng.shuffle(rows)
    return rows, want


def test_forms_fall_together(spark):
    rows, want = corpus()
    df = spark.createDataFrame(rows, "entity_text string, entity_type string").withColumns({"word": F.lit("clash"), "canonical": F.lit("old")}).repartition(5)
    got = names.canonical_names(df).collect()
    assert len(got) == len(rows)
    assert {r.entity_text: r.canonical for r in got} == want


def test_few_words(spark):
    """Endings that no other stem has are no inflection; an empty table gives no row."""
    df = spark.createDataFrame([("Marta",), ("Marty",), ("Anna",), ("Annex",)], "entity_text string").withColumn("entity_type", F.lit("PER"))
    assert {r.entity_text: r.canonical for r in names.canonical_names(df).collect()} == {w: w for w in ("Marta", "Marty", "Anna", "Annex")}
    assert names.canonical_names(df.where("false")).count() == 0


def test_long_runs_of_capitals(spark):
    """A run of thousands of capitalised words is one mention; its match takes no stack for each word, and its words don't carry it with them."""
    run = " ".join(f"Alba{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(20_000))
    docs = spark.createDataFrame([(1, f"so {run} ends. By Anna, said Berta Carl."), (2, "by O'Neil-Smith Ltd and 3 Äpfel")], "event_id long, text string")
    found = enrich.entities(docs)
    assert {(r.event_id, r.start_pos, r.entity_text) for r in found.collect()} == {(1, 3, run), (1, len(run) + 13, "Anna"), (1, len(run) + 24, "Berta Carl"), (2, 3, "O'Neil-Smith Ltd"), (2, 26, "Äpfel")}
    shown = {(r.event_id, r.start_pos): r.canonical for r in names.canonical_names(found).collect()}
    assert len(shown) == 5 and len(shown[1, 3]) == len(run) and shown[2, 26] == "Äpfel"
