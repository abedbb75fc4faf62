"""Personal data: exact patterns, and terms whose company gives a protected entity away.

Natively: patterns are marked in the text by one replacement each, and the pieces' lengths give the spans. What a
pattern finds is a protected entity, and so is what many of them have in common: a mail domain, a network, a dialling
code, a card's issuer. Over all documents it is counted in how many a term occurs, and in how many it stands beside an
entity; a term that is seen beside an entity in different surroundings, that points to it with enough probability and
by enough information (pointwise mutual information in bits), gives it away wherever it stands, so it is sanitised in
all documents: generalised above the first threshold, removed above the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stresslens.llm.common import cut, packed

KINDS = ("email", "ip", "card", "phone")
#: As the patterns say, but never going back: what may follow a part can't be a piece of it, and a run of characters
#: that can't start a match at its first one can't at a later one, so long runs stay linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
MARK, OTHER = "\x01", "\x02"
_SPAN = "array<struct<s:int,e:int,m:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.lit(0) + i, F.lit(1)).cast("int")
        d = F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return total + d

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def accepted(kind: str, m: Column) -> Column:
    """Does a match hold what its pattern can't say."""
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


#: Pieces of a text are laid end to end by so many; even, as every second piece is a match.
_BLOCK = 512


def _spans(parts: Column) -> Column:
    """The spans (s, e, m) of every second one of the parts that make up a text.

    Arrays are appended to within a block, and by block, so a text of very many matches stays cheap.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(_BLOCK)), lambda i: F.slice(parts, i + 1, F.lit(_BLOCK)))
    sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, p: n + F.length(p)))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda out, n: F.array_append(out, F.element_at(out, -1) + n))
    first = lambda at: F.struct(at.alias("at"), F.lit(False).alias("hit"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        one = F.struct(acc["at"].alias("s"), end.alias("e"), piece.alias("m"))
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.flatten(F.transform(blocks, lambda b, i: F.aggregate(b, first(F.element_at(starts, i + 1)), step)["out"]))


def matches(text: Column, kind: str) -> Column:
    """The spans (s, e, end exclusive, in code points, and the string m) of a kind in a text without marks."""
    parts = F.split(F.regexp_replace(text, f"({PATTERNS[kind]})", f"{MARK}$1{MARK}"), MARK, -1)
    found = F.filter(_spans(parts), lambda x: accepted(kind, x["m"]))
    possible = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
    return F.when(possible, found).otherwise(F.array().cast(_SPAN))


def base_spans(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, clean (the text, its marks replaced) and an array of spans for each kind."""
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), MARK, OTHER)
    d = documents.select(F.col(doc_id).cast("long").alias("doc_id"), clean.alias("clean"))
    return d.select("doc_id", "clean", *[matches(F.col("clean"), k).alias(k) for k in KINDS])


def words(text: Column) -> Column:
    """A text's lower-cased words without the signs around them."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def shared(kind: Column, m: Column) -> Column:
    """What an entity has in common with others of its sort."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    return (
        F.when(kind == "email", F.substring_index(m, "@", -1))
        .when(kind == "ip", F.substring_index(m, ".", 2))
        .when(kind == "card", F.substring(digits, 1, 6))
        .otherwise(F.substring(digits, 1, 4))
    )


def disclosing(documents: DataFrame, context: int = 120, support: int = 3, probability: float = 0.5, generalise_bits: float = 6.0, remove_bits: float = 10.0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """term, act, bits: the terms that give an entity away, and what to do with them.

    context: how many code points to either side of an entity its company is; a word that the edge cuts counts as what
    is left of it. A term discloses an entity if it stands beside it in `support` documents at least and in different
    surroundings, if at least `probability` of the documents with the term have it there, and if the pointwise mutual
    information is generalise_bits at least; from remove_bits on it is removed. Of several entities the most certain
    one counts. Terms are letters only, of any number; digits belong to the entities themselves.
    """
    d = base_spans(documents, text, doc_id).select("doc_id", "clean", F.xxhash64("clean").alias("k1"), F.xxhash64(F.lit(1), "clean").alias("k2"), *KINDS)

    def of(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lower(x["m"]).alias("m")))

    all_spans = F.concat(*[of(k) for k in KINDS])

    def beside(x: Column) -> Column:
        low = F.greatest(x["s"] - context, F.lit(0))
        sides = F.concat_ws(" \n ", F.substring(F.col("clean"), low + 1, x["s"] - low), F.substring(F.col("clean"), x["e"] + 1, F.lit(context)))
        entities = F.array(F.xxhash64(x["kind"], x["m"]), F.xxhash64(F.lit(1), x["kind"], shared(x["kind"], x["m"])))
        return F.struct(entities.alias("entities"), F.regexp_replace(sides, PATTERNS["email"], " ").alias("sides"))

    company = cut(d.select("doc_id", "k1", "k2", F.explode(F.transform(all_spans, beside)).alias("c")).select("doc_id", "k1", "k2", F.explode("c.entities").alias("entity"), "c.sides"))
    near = company.select("doc_id", "k1", "k2", "entity", F.xxhash64("sides").alias("around"), F.explode(F.array_distinct(words(F.col("sides")))).alias("term")).where(F.col("term").rlike(r"^\p{L}+$"))
    once = near.groupBy("entity", "term", "doc_id", "k1", "k2").agg(F.min("around").alias("around"))
    pairs = once.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.min("around").alias("a"), F.max("around").alias("b")).where((F.col("n_et") >= support) & (F.col("a") != F.col("b"))).select("entity", "term", "n_et")
    pairs = cut(pairs)
    entities = company.select("doc_id", "k1", "k2", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    each = d.select(F.explode(F.array_distinct(words(F.col("clean")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    bits = F.log2(F.col("n_et") * F.lit(float(max(documents.count(), 1))) / (F.col("n_e") * F.col("n_t")))
    told = pairs.join(entities, "entity").join(each, "term").withColumn("bits", bits).where((F.col("n_et") >= probability * F.col("n_t")) & (F.col("bits") >= generalise_bits))
    return told.groupBy("term").agg(F.max("bits").alias("bits")).select("term", F.when(F.col("bits") >= remove_bits, "remove").otherwise("generalise").alias("act"), "bits")


def sanitise_spans(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", **thresholds: float) -> DataFrame:
    """doc_id, clean, the spans of each kind, and terms: spans (s, e, act) of the terms that give an entity away, wherever they stand."""
    key = [F.xxhash64("clean").alias("k1"), F.xxhash64(F.lit(1), "clean").alias("k2")]
    d = base_spans(documents, text, doc_id).select("doc_id", "clean", *key, *[F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in KINDS])
    told = packed(disclosing(documents, text=text, doc_id=doc_id, **thresholds).select("term", "act"))
    none = F.array().cast("array<struct<s:int,e:int,act:string>>")
    if told.isEmpty():
        return d.withColumn("terms", none)
    plain = base_spans(documents, text, doc_id).select("clean", *key)
    # texts are told by two hashes; the size of what is told decides how it is joined
    hits = plain.select("k1", "k2", F.explode(F.array_distinct(words(F.col("clean")))).alias("term")).join(told, "term").groupBy("k1", "k2").agg(F.collect_set(F.struct("term", "act")).alias("told"))
    hits = packed(hits.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.map_from_entries("told").alias("told")))
    # a text's own disclosing terms make one pattern
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])("), F.array_join(F.map_keys("told"), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    parts = F.split(F.regexp_replace("clean", pattern, F.lit(f"{MARK}$1{MARK}")), MARK, -1)
    spans = F.transform(_spans(parts), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at("told", F.lower(x["m"])).alias("act")))
    terms = F.when(F.col("told").isNotNull(), F.filter(spans, lambda x: x["act"].isNotNull())).otherwise(none)
    both = d.join(hits, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    return both.select("doc_id", "clean", *KINDS, terms.alias("terms"))


def joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def report(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", **thresholds: float) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans, acts, sanitised_sha256 for every row of documents.

    A null text counts as empty. Spans are in code points, end exclusive, written kind:start:end, by kind (email, ip,
    card, phone, then the method's term) and start; base_sha256 is over those of the four kinds. acts says of each term
    span what is done with it; sanitised_sha256 is over the text afterwards, entities generalised. Spans of different
    kinds may overlap. A row given twice comes back twice; a null doc_id is carried along.
    """
    d = sanitise_spans(documents, text=text, doc_id=doc_id, **thresholds)
    base = F.array_join(F.concat(*[joined(k, F.col(k)) for k in KINDS]), ",")
    everything = F.array_join(F.concat(*[joined(k, F.col(k)) for k in KINDS], joined("term", F.col("terms"))), ",")
    acts = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", x["s"].cast("string"), x["act"])), ",")
    return d.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.size("terms").cast("long").alias("n_term"), F.sha2(base, 256).alias("base_sha256"), everything.alias("spans"), acts.alias("acts"), F.sha2(sanitised(), 256).alias("sanitised_sha256"))


def sanitised() -> Column:
    """The text of a row of sanitise_spans() without its entities and disclosing terms."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit("generalise").alias("act")))

    entities = [of(k) for k in KINDS]
    terms = F.transform("terms", lambda x: F.struct(F.lit("term").alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["act"].alias("act")))
    spans = F.concat(*entities, terms)
    return F.when(F.size(spans) == 0, F.col("clean")).otherwise(sanitise(F.col("clean"), spans))


def sanitise(text: Column, spans: Column) -> Column:
    """A text with spans (kind, s, e, act) cut out or replaced by their kind in brackets; spans by start, of overlapping ones the first."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,put:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        put = F.when(x["act"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        one = F.struct(acc["at"].alias("s"), x["s"].alias("e"), put.alias("put"))
        return F.when(x["s"] < acc["at"], acc).otherwise(F.struct(x["e"].alias("at"), F.array_append(acc["out"], one).alias("out")))

    done = F.aggregate(F.array_sort(spans, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["e"] - a["e"])), first, step)
    kept = F.transform(done["out"], lambda g: F.concat(F.substring(text, g["s"] + 1, g["e"] - g["s"]), g["put"]))
    return F.concat(F.array_join(kept, ""), F.substring(text, done["at"] + 1, F.length(text)))
