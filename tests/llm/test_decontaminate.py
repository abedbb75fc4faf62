import random
import re

from pyspark.sql import functions as F

from stresslens.llm import decontaminate
from stresslens.llm import texts as texts_

ITEMS = [
    (1, "Yesterday Alice drove 120 km in 3 hours and then stopped, how fast did Alice drive in km per hour?"),
    (2, "The quick brown fox jumps over the lazy dog while seven wizards look on from the hill."),
    (3, "name the capital of France"),
    (4, "too short"),
    (5, None),
    (6, "In the morning after breakfast Alice walked to the shop and later on that day Alice walked back home again."),
]


def found(spark, docs, **more):
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string, w string") if docs else spark.createDataFrame([], "doc_id long, text string, w string")
    return {(x.doc_id, x.item_id): x for x in decontaminate.matches(d, b, **more).collect()}


def test_passages_templates_and_slots(spark):
    docs = [
        (1, "Something before. " + ITEMS[0][1] + " Something after.", "x"),
        (2, "Yesterday Bob drove 77 km in 9 hours and then stopped, how fast did Bob drive in km per hour?", "x"),
        # the name changes from one place to the other: not the same question
        (3, ITEMS[5][1].replace("Alice", "Bob", 1).replace("Alice", "Carol"), "x"),
        (12, ITEMS[5][1].replace("Alice", "Bob"), "x"),
        (4, ITEMS[1][1].upper(), "x"),
        (5, "the quick brown fox jumps over a wall and is gone. " * 3, "x"),
        (6, "Please name the capital of France", "x"),
        (7, None, None),
        (8, "", None),
        (9, "too short", None),
        (10, "The quick brown fox jumps over the lazy dog while seven wizards", "x"),
        (10, "The quick brown fox jumps over the lazy dog while seven wizards", "x"),
        (11, "120 km 3 hours 5 kg 7 m 120 km 3 hours 5 kg 7 m", "x"),
    ]
    got = found(spark, docs)
    assert set(got) == {(1, 1), (2, 1), (4, 2), (6, 3), (9, 4), (10, 2), (12, 6)}
    assert got[1, 1].exact == got[1, 1].coverage and got[2, 1].exact < 0.5 <= got[2, 1].coverage
    assert not found(spark, [])


def test_copies_that_differ_in_capitals_and_sentence_starts(spark):
    items = [(1, "Name the capital of France"), (2, "Where did Marie Curie and Pierre Curie meet Henri Becquerel in Paris?")]
    b = spark.createDataFrame(items, "item_id long, text string")
    docs = [
        (1, "A Quiz\nName the capital of France"),
        (2, "next, Name the capital of France"),
        (3, items[0][1].upper()),
        (4, items[1][1].lower()),
        (5, "so " + items[1][1].upper() + " and on"),
        (6, "Name the capital of Norway"),
        (7, "Where did the train stop, and did Marie Curie ever travel by it?"),
    ]
    got = {(x.doc_id, x.item_id): x for x in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    assert set(got) - {(6, 1)} == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)}
    assert all(got[k].exact == got[k].coverage == 1 for k in [(1, 1), (3, 1), (4, 2), (5, 2)])


def test_windows_of_numbers_and_names_count_by_their_values(spark):
    items = [
        (1, "1 1 2 3 5 8 13 21 34 55 89 144"),
        (2, "Alice Bob Carol Dave Erin Frank Grace Heidi Ivan Judy"),
        (3, "please continue this list of numbers for me 2 3 5 7 11 13 17 19 23 29 31 37 41 43"),
        (4, "12 7 31 5"),
    ]
    b = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, "Here it comes: " + t + " and that is it") for i, t in items] + [
        (11, "1 1 2 3 5 8 13 22 35 56 90 146"),
        (12, "Rupert Sybil Ted Uma Victor Wendy Xavier Yves Zoe Oscar"),
        (13, "Could you please continue this list of numbers for me by tomorrow morning"),
        (14, "12 7 31 6"),
    ]
    got = {(x.doc_id, x.item_id): x for x in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4)}
    assert got[1, 1].exact == got[2, 2].exact == got[4, 4].exact == 1 and got[3, 3].matched == 15


def test_pieces_see_the_same(spark, monkeypatch):
    text = ("filler words go here and on. " * 7 + ITEMS[0][1] + " and again the end. " + ITEMS[1][1] + " yes").encode()
    whole = list(decontaminate.Scan([8, 5], None).text(decontaminate.Template(), None, text))
    monkeypatch.setattr(texts_, "PIECE", 40)
    cut = list(decontaminate.Scan([8, 5], None).text(decontaminate.Template(), None, text))
    assert sorted(whole) == sorted(cut) and len(whole) > 50


def plain(tokens, names):
    """What stands for each token, and the values of slots: with names and units as slots too, or numbers only."""
    out, slots = [], []
    for i, token in enumerate(tokens):
        core = token.strip("\"'`()[]{}<>*_.,;:!?") or token
        number = lambda x: bool(re.fullmatch(r"[$€]*[+-]?[0-9][0-9.,:/]*[0-9]?(%|[a-z]{1,3})?", (x.strip("\"'`()[]{}<>*_.,;:!?") or x).lower()))
        kind = "<number>" if number(token) else None
        if names and kind is None:
            name = len(core) > 1 and core[0].isupper() and core.replace("-", "").replace("'", "").isalpha() and not core.isupper()
            unit = core.lower().encode() in decontaminate.UNITS and i > 0 and number(tokens[i - 1])
            kind = "<unit>" if unit else "<name>" if name else None
        elif names and i > 0 and core.lower().encode() in decontaminate.UNITS and number(tokens[i - 1]):
            kind = "<unit>"
        out.append(kind or core.lower())
        slots.append(core.lower() if kind else None)
    return out, slots


def windows(text):
    """(position, key, slot values) of all windows of a text's items or documents, of every size from 4 to 8."""
    tokens = text.split()
    forms = [plain(tokens, True), plain(tokens, False)]
    for size in range(4, 9):
        for i in range(len(tokens) - size + 1):
            keys = []
            for f, (out, slots) in enumerate(forms):
                some, values = out[i : i + size], slots[i : i + size]
                if 2 * sum(v is None for v in values) >= size:
                    keys.append((tuple(some), [v for v in values if v is not None]))
                elif f == 1:
                    keys.append((("values", *[v or x for v, x in zip(values, some, strict=True)]), [v for v in values if v is not None]))
            for n, (key, values) in enumerate(keys):
                if n == 0 or key != keys[0][0]:
                    yield size, i, key, values


def brute(docs, items, coverage=0.5, run=6):
    out = {}
    for item, question in items:
        size = min(8, len(question.split()))
        known = [(i, k, v) for z, i, k, v in windows(question) if z == size]
        for doc, text in docs:
            there = {}
            for z, i, k, v in windows(text):
                if z == size:
                    there.setdefault(k, []).append((i, v))
            lines = {}
            for i, k, v in known:
                for j, w in there.get(k, []):
                    lines.setdefault(j - i, []).append((i, v, w))
            found, same = set(), set()
            for hits in lines.values():
                pairs = {p for _, v, w in hits for p in zip(v, w, strict=True)}
                exact = {i for i, v, w in hits if v == w}
                one = len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
                found |= {i for i, _, _ in hits} if one else exact
                same |= exact
            total = len({i for i, _, _ in known})
            if found and (len(found) / total >= coverage or len(found) >= run):
                out[doc, item] = (len(found), round(len(found) / total, 9), round(len(same) / total, 9))
    return out


def test_against_plain_windows(spark):
    r = random.Random(3)
    word = lambda: r.choice(["Alice", "Robert", "how", "How", "many", "apples", "keep", "7", "12", "$5", "km", "kg", "gives", "away.", "The", "the", "red", "and", "USA", "3.5", "has", "Has,"])
    items = [(i, " ".join(word() for _ in range(r.choice([4, 5, 6, 7, 8, 9, 14, 25])))) for i in range(25)]
    swap = {"Alice": "Carol", "Robert": "Dora", "7": "8", "12": "13", "red": "green"}
    docs = []
    for i in range(120):
        text = r.choice(items)[1].split()
        kind = r.randint(0, 4)
        if kind == 1:
            text = [swap.get(x, x) for x in text]
        if kind == 2:
            text[r.randint(0, len(text) - 1)] = word()
        if kind == 3:
            text = [x.upper() if r.random() < 0.5 else x.lower() for x in text]
        if kind == 4:
            text = text[: len(text) // 2]
        docs.append((i, " ".join([word() for _ in range(r.randint(0, 12))] + text + [word() for _ in range(r.randint(0, 12))])))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()
    want = brute(docs, items)
    assert {(x.doc_id, x.item_id): (x.matched, round(x.coverage, 9), round(x.exact, 9)) for x in got} == want and 60 < len(want)


def test_names_at_the_start_and_tiny_items(spark):
    question = "Alice has 5 red apples and 3 green pears. Alice gives 2 apples away. How many apples does Alice keep?"
    b = spark.createDataFrame([(1, question), (2, "2 + 2?"), (3, question.replace("apples", "plums"))], "item_id long, text string")
    other = question.replace("Alice", "Robert").replace("5", "9").replace("3", "4").replace("2", "6")
    d = spark.createDataFrame([(1, other, "x"), (None, " 2 +\n2?", "x"), (3, "what is 2 + 2?", "x"), (None, other, "x")], "doc_id long, text string, item_id string")
    assert sorted((str(x.doc_id), x.item_id, x.coverage) for x in decontaminate.matches(d, b).collect()) == [("1", 1, 1.0), ("None", 1, 1.0), ("None", 2, 1.0)]


def test_tiny_texts_are_told_by_their_first_words(spark):
    texts = ["", " ", "a", " a\tb ", "a b\n", "é x y", "a  b\r\nc", "a b c d", "\n a b c \x0b", "a b c \nd", "a\x1cb c", "a b c" + " " * 9000, "word " * 200000, None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i for x in d.where(decontaminate.tiny_text(F.col("t"))).collect()}
    assert got == {i for i, t in enumerate(texts) if t and 1 <= len(re.findall(r"[^\x20\x09-\x0D]+", t)) < decontaminate.LEAST}
    # no expression reads every whole text for a count of its words
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = decontaminate.matches(d.select(F.col("i").alias("doc_id"), F.col("t").alias("text")), b)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and not [x for x in plan.splitlines() if "Filter" in x and "regexp_count" in x.lower() and "t#" in x]
