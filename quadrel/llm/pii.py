"""Information-theoretic sanitisation of personal data.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, by pattern and check.
Every base match is a protected entity, and so is the value of an assignment to a secret's name
(`token = "..."`), which is a span of kind "secret". Terms are the runs of letters and digits outside
of those spans. Over all documents it is counted which documents hold an entity and a term together.
An entity's information is log2(N / df_entity); what a term tells of it is their pointwise mutual
information, log2(N * joint / (df_term * df_entity)). A term discloses an entity if it leaves at most
`left_bits` of that information open (the entity is in at least 2 ** -left_bits of the term's
documents) and tells at least `told_bits` (what nearly every document holds is disclosed by nothing);
and at least `support` documents have both, as fewer estimate nothing. Every occurrence of such a term,
in any document, becomes a span of kind "term". A text is sanitised by generalising base spans and
secrets to their kind and removing disclosing terms.

Everything is DataFrame functions. No row carries a text beside a match: matches are exploded with the
length of the gap before them, and positions are running sums in a window of one document, so one text
of very many matches costs in proportion to them. Only documents with an entity give terms, only terms
of which enough documents can hold one entity are paired, and entities (terms) of the same set of
documents are paired as one class, known by two 64-bit sums over that set; so what is paired are
classes, not the entities and words of a document. Words of all texts are counted before they are
shuffled, and joined with what is wanted by broadcast below a measured size, by shuffle beyond it.
The patterns are possessive where the plain form gives the same matches, so they are linear on long
runs and don't recurse.

Edge cases: a null text counts as empty and has no spans; texts of any length are read whole;
overlapping spans of different kinds are all reported, and generalised once, as the first; repeated
rows get the same spans each and are counted each; an empty table gives an empty result; columns other
than those named are ignored, or kept by sanitise, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, once

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret", "term")
SECRET, TERM_KIND = 4, 5
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?i)(?<![A-Za-z0-9])(?:pass(?:word|wd)|secret|token|(?:api|access|private|auth)[_-]?key)[\"']?\s{0,8}[:=]\s{0,8}[\"']?[A-Za-z0-9+/_.~-]{8,}+",
}
GATES = {"ip": "[0-9][.][0-9]", "card": "[0-9][ -]?[0-9]", "phone": "[+][0-9]", "secret": r"(?i)(?:pass(?:word|wd)|secret|token|key)[\"']?\s{0,8}[:=]"}
BYTE = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
TERM = r"[\p{L}\p{N}]+"
#: Code points in a part of a text that sanitise cuts from.
PART = 512


@dataclass(frozen=True)
class Settings:
    support: int = 2
    left_bits: float = 0.25
    told_bits: float = 3.0


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    at = lambda i: F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 0, at(i)).otherwise(F.when(at(i) > 4, 2 * at(i) - 9).otherwise(2 * at(i)))
    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def secret_of(value: Column) -> Column:
    """What is assigned, without the name."""
    return F.regexp_extract(value, r"[:=]\s*[\"']?([A-Za-z0-9+/_.~-]+)$", 1)


def valid(kind: Column, value: Column) -> Column:
    n = F.length(digits(value))
    return (
        F.when(kind == 0, True)
        .when(kind == 1, value.rlike(rf"^{BYTE}[.]{BYTE}[.]{BYTE}[.]{BYTE}$"))
        .when(kind == 2, F.when((n >= 14) & (n <= 19), luhn(digits(value))).otherwise(False))
        .when(kind == 3, (n >= 10) & (n <= 15))
        .otherwise(secret_of(value).rlike("[0-9]") & secret_of(value).rlike("[A-Za-z]"))
    )


def matches(text: Column, kind: int, pattern: str, gate: Column | None = None) -> Column:
    """array<struct<kind, pos, gap, value>> of the pattern's matches in text; gap: characters since the last."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)), F.lit(1), F.size(found))
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("value"))
    made = F.transform(pairs, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x["gap"].alias("gap"), x["value"].alias("value")))
    empty = F.array().cast("array<struct<kind:int,pos:int,gap:int,value:string>>")
    return made if gate is None else F.when(gate, made).otherwise(empty)


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda x: F.lower(x)))


def placed(rows: DataFrame, found: str, key: tuple[str, ...]) -> DataFrame:
    """key, kind, start, end, value: a row for each of the matches in the array found."""
    each = rows.select(*key, F.inline(found))
    running = Window.partitionBy(*key, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ended = each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(running).cast("int"))
    return ended.select(*key, "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value")


def read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, text_hash, found (matches that aren't checked yet), _t (the text, if there are any)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("_t"))
    t = F.col("_t")
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        gate = t.contains("@") if kind == "email" else t.rlike(GATES[kind])
        rows = rows.withColumn(f"_{kind}", matches(t, k, pattern, gate))
    rows = rows.withColumn("found", F.concat(*[f"_{k}" for k in PATTERNS]))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "text_hash", "found", F.when(F.size("found") > 0, t).alias("_t"))


def apart(words: DataFrame, spans: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The rows of words (key, start, end, value) that overlap no row of spans (key, start, end).

    A word is compared with the furthest end before it and the nearest start after it, no more.
    """
    line = words.select(*key, "start", "end", "value", F.lit(False).alias("is_span")).unionByName(spans.select(*key, "start", "end", F.lit(None).cast("string").alias("value"), F.lit(True).alias("is_span")))
    # in both orders a span comes before the words that start where it does
    before = Window.partitionBy(*key).orderBy("start", F.desc("is_span")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*key).orderBy(F.desc("start"), F.desc("is_span")).rowsBetween(Window.unboundedPreceding, -1)
    seen = line.withColumn("_end", F.max(F.when(F.col("is_span"), F.col("end"))).over(before)).withColumn("_start", F.min(F.when(F.col("is_span"), F.col("start"))).over(after))
    free = ~F.col("is_span") & (F.coalesce("_end", F.lit(0)) <= F.col("start")) & (F.col("_start").isNull() | (F.col("_start") >= F.col("end")))
    return seen.where(free).select(*key, "start", "end", "value")


def classes(held: DataFrame, what: str) -> DataFrame:
    """what, class, df: those of the same set of rows have one class. held: distinct what, row."""
    of = held.groupBy(what).agg(F.count("*").alias("df"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("_s"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("_x"))
    return of.select(what, "df", F.concat_ws(":", F.col("df").cast("string"), F.col("_s").cast("string"), F.col("_x").cast("string")).alias("class"))


def disclosing(protected: DataFrame, words: DataFrame, docs: DataFrame, s: Settings, text_col: str) -> DataFrame:
    """term: those over the threshold. protected: row, entity; words: row, term, both distinct."""
    words = materialise(words, "words")
    entities = classes(protected, "entity").where(F.col("df") >= s.support)
    least = 2.0**-s.left_bits
    near = classes(words, "term").where(F.col("df") >= s.support)
    # a term's documents are at least those with an entity; count the others for terms that may pass
    wanted = materialise(near, "terms")
    every = docs.select(F.explode(terms_of(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    every = every.join(broadcast_if_small(wanted.select("term"), 96), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df_term"))
    # the classes of terms that are in the same documents and in as many others
    passing = wanted.join(every, "term").where(F.col("df") >= least * F.col("df_term"))
    passing = materialise(passing.select("term", F.concat_ws("/", "class", F.col("df_term").cast("string")).alias("class"), "df_term"), "terms")
    first = passing.groupBy("class").agg(F.min("term").alias("term"), F.first("df_term").alias("df_term"))
    in_rows = words.join(first, "term").select("row", F.col("class").alias("term_class"), "df_term")
    of_entity = entities.groupBy("class").agg(F.min("entity").alias("entity"), F.first("df").alias("df_entity"))
    held = protected.join(of_entity, "entity").select("row", F.col("class").alias("entity_class"), "df_entity")
    joint = in_rows.join(held, "row").groupBy("term_class", "entity_class", "df_term", "df_entity").agg(F.count("*").alias("joint"))
    n = F.lit(float(max(docs.count(), 1)))
    told = F.log2(n) + F.log2("joint") - F.log2("df_term") - F.log2("df_entity")
    over = joint.where((F.col("joint") >= s.support) & (F.col("joint") >= least * F.col("df_term")) & (told >= s.told_bits))
    return passing.join(over.select(F.col("term_class").alias("class")).distinct(), "class").select("term").distinct()


def find(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, text_hash, base and spans, arrays of struct<start, kind, end>.

    Kinds are numbers into ALL_KINDS; base has the first four, spans those and the method's.
    """
    held = materialise(read(docs, id_col, text_col), "matches")  # from here on row is fixed
    some = held.where(F.size("found") > 0)
    checked = placed(some, "found", ("row",)).where(valid(F.col("kind"), F.col("value")))
    name = F.when(F.col("kind") == 0, F.lower("value")).when(F.col("kind") == SECRET, secret_of(F.col("value"))).otherwise(digits(F.col("value")))
    spans = materialise(checked.select("row", "kind", "start", "end", F.concat_ws(":", F.col("kind").cast("string"), name).alias("entity")), "entities")
    protected = spans.select("row", "entity").distinct()
    holding = broadcast_if_small(spans.select("row").distinct(), 16)
    texts = some.join(holding, "row", "left_semi").select("row", matches(F.col("_t"), TERM_KIND, TERM).alias("found"))
    words = apart(placed(texts, "found", ("row",)), spans, ("row",)).select("row", F.lower("value").alias("term")).distinct()
    telling = materialise(disclosing(protected, words, docs, s, text_col), "telling")
    # every occurrence, in any text: first the documents that have one, then the places in those
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("_t"))
    terms = broadcast_if_small(telling, 96)
    having = own.select("id", once(F.col("text_hash")).alias("text_hash"), F.explode(terms_of(F.col("_t"))).alias("term")).join(terms, "term", "left_semi")
    having = materialise(having.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "having")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    texts = held.select("row", "id", "text_hash").join(having, same, "left_semi")
    one = texts.groupBy("id", "text_hash").agg(F.min("row").alias("row"))  # of rows that agree, one
    one = one.withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
    read_again = own.join(broadcast_if_small(one, 32), same).dropDuplicates(["row"]).select("row", matches(F.col("_t"), TERM_KIND, TERM).alias("found"))
    extra = placed(read_again, "found", ("row",)).withColumn("term", F.lower("value")).join(terms, "term", "left_semi")
    extra = apart(extra, spans, ("row",))
    every = spans.select("row", "start", "kind", "end").unionByName(extra.select("row", "start", F.lit(TERM_KIND).alias("kind"), "end"))
    listed_ = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    # rows that agree share the places found in the one of least number
    alike = held.select("row", "id", "text_hash").join(one.withColumnRenamed("row", "of"), same, "left").select("row", "id", "text_hash", F.coalesce("of", "row").alias("of"))
    found = alike.join(listed_.withColumnRenamed("row", "of"), "of", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = found.withColumn("spans", F.coalesce("spans", none))
    return found.select(F.col("id").alias(id_col), "text_hash", F.filter("spans", lambda x: x["kind"] < len(KINDS)).alias("base"), "spans")


def listed(spans: str | Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten: base spans and secrets become <kind>, disclosing terms go.

    Texts are cut from parts of PART code points, so a long text isn't read anew for each span.
    """
    keys = ("__pii_id", "__pii_hash")
    some = found.where(F.size("spans") > 0).select(F.col(id_col).alias(keys[0]), F.col("text_hash").alias(keys[1]), "spans").dropDuplicates(list(keys))
    before = Window.partitionBy(*keys).orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    each = some.select(*keys, F.inline("spans")).withColumn("at", F.coalesce(F.max("end").over(before), F.lit(0)))
    kept = F.when(F.col("start") >= F.col("at"), F.struct("start", "at", "kind"))  # else within what is gone already
    marked = each.groupBy(*keys).agg(F.sort_array(F.collect_list(kept)).alias("__pii_spans"), F.max("end").alias("__pii_last"))
    marked = materialise(marked, "marked")
    most = marked.agg(F.sum(F.size("__pii_spans") * 40 + 64).alias("b")).first()["b"] or 0
    marked = F.broadcast(marked) if most <= 32 << 20 else marked
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("__pii_own", F.xxhash64(text)).join(marked, F.col(id_col).eqNullSafe(F.col(keys[0])) & (F.col("__pii_own") == F.col(keys[1])), "left")
    rows = rows.withColumn("__pii_parts", F.when(F.col("__pii_spans").isNotNull(), F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))))
    tags = F.array(*[F.lit(t) for t in (*(f"<{k}>" for k in ALL_KINDS[:TERM_KIND]), "")])

    def piece(a: Column, b: Column) -> Column:
        """Characters [a, b) of the text."""
        first, last = F.floor(a / PART).cast("int"), F.floor((b - 1) / PART).cast("int")
        cut = F.array_join(F.slice("__pii_parts", first + 1, last - first + 1), "")
        return F.when(b > a, F.substring(cut, a % PART + 1, b - a)).otherwise("")

    parts = F.transform("__pii_spans", lambda x: F.concat(piece(x["at"], x["start"]), F.get(tags, x["kind"])))
    changed = F.concat(F.array_join(parts, ""), piece(F.col("__pii_last"), F.length(text_col)))
    return rows.withColumn(text_col, F.when(F.col("__pii_spans").isNotNull(), changed).otherwise(F.col(text_col))).select(*[F.col(f"`{c}`") for c in docs.columns])
