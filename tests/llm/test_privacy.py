import hashlib
import math
import random
import re

from stresslens.llm import privacy

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def keeps(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def plain(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if keeps(k, m.group())] for k, p in PLAIN.items()}


def test_spans_against_brute_force(spark):
    r = random.Random(4)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "@", ".", "..", "a@b", "é", "😀", "1.2.3.4", "001.002.300.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4", "55", "+1 (499) 555-6503", "+49 30 123456789", "+", "+1", " ", " ", "-", "_", "\n", "\x01", "\x02", "word"]
    texts = [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "9" * 5000, "a" * 20000 + "@x", "1" * 19, "+" * 50 + "1234567890"] + ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "k1") for i, t in enumerate(texts)], "doc_id long, text string, k1 string")
    got = {x.doc_id: x for x in privacy.report(df).collect()}
    for i, t in enumerate(texts):
        want = plain(t)
        spans = ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in want[k])
        x = got[i]
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(len(want[k]) for k in PLAIN), t
        assert x.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert ",".join(s for s in x.spans.split(",") if s and not s.startswith("term")) == spans


def test_disclosing_terms(spark):
    clean = [f"nothing to see here number{i} ordinary words the of and" for i in range(200)]
    told = [f"hello {w} the zorbulon Li writes from {w}@corp.example today {w} and the rest" for w in ("alpha", "bravo", "carol", "delta")]
    copies = ["the quagmire person is other@corp2.example again"] * 4  # the same surroundings each time: no evidence
    far = ["a text without any mail speaks of Zorbulon, of the zorbulonic and ZORBULON"]
    texts = clean + told + copies + far
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, told string")
    few = dict(generalise_bits=3.0, remove_bits=5.6)
    terms = {x.term: x for x in privacy.disclosing(df, **few).collect()}
    n = len(texts)
    # by plain counting: beside the domain in four documents, in five at all
    assert abs(terms["zorbulon"].bits - math.log2(4 * n / (4 * 5))) < 1e-9 and terms["zorbulon"].act == "generalise"
    assert abs(terms["li"].bits - math.log2(n / 4)) < 1e-9 and terms["li"].act == "remove"
    assert not {"the", "and", "quagmire", "again", "alpha"} & set(terms)
    rows = {x.doc_id: x for x in privacy.sanitise_spans(df, **few).withColumn("out", privacy.sanitised()).collect()}
    last = rows[n - 1]
    assert [far[0][t.s : t.e] for t in last.terms] == ["Zorbulon", "ZORBULON"] and last.out == "a text without any mail speaks of [TERM], of the zorbulonic and [TERM]"
    assert all(not x.terms and x.out == texts[i] for i, x in rows.items() if i < 200)
    # what is said in these four only goes too; what others say stays
    assert rows[200].out == " alpha the [TERM]    [EMAIL]  alpha and the "
    got = {x.doc_id: x for x in privacy.report(df, **few).collect()}
    assert got[n - 1].n_term == 2 and got[n - 1].sanitised_sha256 == hashlib.sha256(last.out.encode()).hexdigest()
    assert got[n - 1].acts == ",".join(f"{t.s}:generalise" for t in last.terms)


def test_very_many_matches(spark):
    text = "a@b.cd " * 3000
    x = privacy.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert x.n_email == 3000 and x.spans.endswith(f"email:{7 * 2999}:{7 * 2999 + 6}")


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "+1 23 456 7890")], "doc_id long, text string")
    assert sorted((str(x.doc_id), x.spans) for x in privacy.report(df).collect()) == [("1", "email:0:5"), ("1", "email:0:5"), ("None", "phone:0:14")]
    assert privacy.report(df.limit(0)).count() == 0
