import random
import re

from recordsearch.llm import decontaminate as d

QUESTION = ("A farmer called Anna Bell sold 12 apples for 3 dollars each to Peter and then 12 pears to Anna Bell again, "
            "how much money did Peter pay in total?")
CHANGED = QUESTION.replace("Anna Bell", "Maria").replace("Peter", "Tom Lee").replace("12", "1,450").replace(" 3 ", " 7 ")
MIXED = QUESTION.replace("12 pears", "99 pears").replace("to Anna Bell again", "to Carl again").replace("did Peter", "did Susan")
OTHER = "Which of the following rivers is the longest one in the whole of western europe?"


def test_changed_questions(spark, rows):
    rng = random.Random(1)
    filler = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    docs = [(1, f"{filler(50)}. {QUESTION} {filler(50)}"), (2, f"{filler(50)}. {CHANGED} {filler(50)}"),
            (3, filler(200)), (4, None), (5, ""), (6, OTHER.upper()), (7, f"{filler(400000)} {OTHER} {filler(10)}"), (1, QUESTION),
            (8, f"{QUESTION} {filler(9)} {CHANGED}"), (9, " ".join(OTHER.split()[:7])), (None, OTHER), (10, "1 2 3 4 5 6"), (11, "1 2 3 4 5 7")]
    bench = spark.createDataFrame([(70, QUESTION), (71, OTHER), (71, OTHER), (72, None), (73, ""), (74, "1 2 3 4 5 6")], "item_id long, text string")
    table = rows(docs).selectExpr("*", "1 AS item_id", "2 AS share")
    got = sorted(((r.doc_id, r.item_id) for r in d.find_questions(table, bench).collect()), key=repr)
    assert got == sorted([(1, 70), (1, 70), (2, 70), (6, 71), (7, 71), (8, 70), (None, 71), (10, 74)], key=repr)
    kept = d.without_questions(table, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 9, 11] and kept.columns == table.columns
    assert d.find_questions(table.where("false"), bench).collect() == []
    assert d.find_questions(table, bench.where("false")).collect() == []
    assert d.without_questions(table, bench.where("false")).count() == len(docs)


def test_inconsistent_slots_do_not_count():
    question = d.Questions([1], [QUESTION])
    (same,), (changed,), mixed = question.matches([QUESTION, CHANGED, MIXED])
    assert same[1] > 0.9 and changed[1] > 0.9
    assert not mixed or mixed[0][1] < changed[1]


def test_a_large_benchmark_takes_several_passes(spark, rows, monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 8)
    bench = spark.createDataFrame([(70, QUESTION), (71, OTHER)], "item_id long, text string")
    got = d.find_questions(rows([(1, QUESTION), (2, OTHER), (3, "no")]), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 70), (2, 71)]


def test_names_at_the_beginning_of_sentences():
    question = d.Questions([1], ["Alice has 3 apples. Bob gives her 4 more. How many apples does Alice have now?"])
    same = "Carol has 7 apples. Dan gives her 9 more. How many apples does Carol have now?"
    swapped = "Carol has 7 apples. Dan gives her 9 more. How many apples does Eve have now?"
    assert question.matches([f"Read this. {same} Then answer."]) == [[(1, 1.0)]]
    assert question.matches([same.lower()]) == [[]]
    other = question.matches([swapped])[0]
    assert not other or other[0][1] < 1.0


def test_short_questions_need_their_values():
    question = d.Questions([1, 2], ["What is 12 + 7?", "How much is 3 kg of 5%?"])
    texts = ["so tell me what is 5 and then go", "what is 12 - 7?", "What is 12 7", "what is 13 + 7", "I ask: what is 12 + 7? Nineteen.",
             "how much is 4 kg of 5%", "How much is 3 KG of 5 % then"]
    assert [[i for i, _ in m] for m in question.matches(texts)] == [[], [], [], [], [1], [], [2]]


def plain(text, names):
    """Templates token by token."""
    out, end = [], 0
    for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text):
        w, gap = m[0], text[end:m.start()]
        solid = text[:m.start()].rstrip(" \t\n\v\f\r")
        inside = solid and solid[-1] not in ".!?:;\"([{" and "\n" not in text[len(solid):m.start()]
        kind = 1 if re.search("[0-9]", w) else 2 if out and out[-1][1] == 1 and w.lower() in d.UNITS else \
            3 if re.match("[A-ZÀ-ÖØ-Þ]", w) and re.search("[a-z\u0080-\U0010ffff]", w[1:]) and (inside or names) else 0
        out.append((w.lower(), kind, gap))
        end = m.end()
    merged, last = [], 0
    for _, kind, gap in out:
        if not (merged and kind and last == kind and (kind != 1 or gap in (".", ","))):
            operators = sorted(c for c in gap if c in "+-*/=<>^%") if kind == 1 and last == 1 else []
            merged.append((kind, "".join(operators)))
        last = kind
    return merged


def test_templates_equal_a_plain_reading():
    rng = random.Random(3)
    pieces = ["Anna", "bob", "É1", "Élan", "élan", "12", "7", "kg", "km", "THE", "The", ".", "\n", "!", "(", "x1", "ÀB", "I", "Öl", "+", "-"]
    codes = {}
    for _ in range(600):
        text = "".join(rng.choice(pieces) + rng.choice([" ", "", ", ", ","]) for _ in range(rng.randrange(15)))
        for names, (kind, _, between, _) in enumerate(d.readings([text])):
            wanted = plain(text, names)
            assert kind.tolist() == [k for k, _ in wanted], text
            for (_, operators), code in zip(wanted, between.tolist(), strict=True):
                assert codes.setdefault(operators, code) == code, text
    assert len(set(codes.values())) == len(codes)
