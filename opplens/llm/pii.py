r"""Information-theoretic sanitisation of personal data, in DataFrame expressions only.

Protected entities are e-mail addresses, IP addresses, payment card numbers and phone numbers. Each kind's pattern is matched
leftmost and without overlap; matches that fail their check (IP parts over 255, cards of other than 13 to 19 digits or a wrong
Luhn sum, phones of other than 9 to 15 digits) are dropped without a retry.

What else tells of an entity is estimated from the whole corpus: a term t that stands within `reach` characters of a mention of e
discloses e if PMI(t; e) = ln(N n(t,e) / (n(t) n(e))) is at least `disclosure` times the information content
IC(e) = ln(N / n(e)); the quotient of the two is 1 where t is only found with e. All of these count distinct texts, so copies of one
prove nothing: N and n(t) all texts, n(e) those that mention e and n(t,e) those with t near a mention. No number of mentions is asked
for: an entity in one text is told by terms that hardly any other text has. Every occurrence of a disclosing term in a text that
mentions its entity becomes a span of kind `term`. Nothing is capped. Defaults: 80 characters are the sentence around a mention;
0.9 leaves a term that N ** 0.1 texts have for an entity in one, which is 3 to 4 texts in 250,000.

A disclosing term is generalised: to the class of its form ([NAME], [CODE] or [WORD]) below `removal`, from it on to [TERM], the
top of that hierarchy, which says no more than that something stood there.

Spans depend on the text and the corpus statistics alone, so they are found once for each text (by its SHA-256) and joined
back. A null text is empty; empty texts have no spans; equal texts get equal spans; repeated rows all stay; an empty table gives
no rows. Columns base and spans replace input columns of these names, all others pass through whatever their names are. Work
grows with n ** 1.5 of the matches in one text at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chunked, cut_from, let, scan_before, sums_before

#: The patterns of the four kinds, possessive and anchored so that no text takes more than linear time.
#: \G keeps the search after a match where it is; elsewhere a run of characters is entered at its start only.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain to have a match at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = tuple(PATTERNS)
#: The table of texts with spans is broadcast up to about this many bytes; beyond it the documents are shuffled to it.
BROADCAST_BYTES = 48 << 20
TERM = r"[\p{L}][\p{L}\p{N}]{2,}+"
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
#: Candidate terms and repeated texts are broadcast up to this many rows.
BROADCAST_ROWS = 400_000


def _octet(p: Column) -> Column:
    digits = F.ltrim(p, F.lit("0"))
    return (F.length(digits) < 3) | ((F.length(digits) == 3) & (digits <= "255"))


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int"))))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _octet),
    "card": lambda v: F.when(_digits(v).between(13, 19), _luhn(v)).otherwise(False),
    "phone": lambda v: _digits(v).between(9, 15),
}


def _placed(text: Column, pattern: str, matches: Column, span) -> Column:
    """span(match, start, end) of the matches of a pattern, with their places from the lengths of what lies between them."""

    def place(m: Column, between: Column) -> Column:
        steps = F.transform(m, lambda x, i: F.length(F.get(between, i)) + F.length(x))
        at = lambda starts, i: (F.get(starts, i) + F.length(F.get(between, i))).cast("int")
        return let(sums_before(steps), lambda starts: F.transform(m, lambda x, i: span(x, at(starts, i), at(starts, i) + F.length(x))))

    return let(matches, lambda m: let(F.split(text, pattern, -1), lambda between: place(m, between)))


def _span(kind: str):
    return lambda value, start, end: F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"))


def merged(spans: Column) -> Column:
    """array<struct<start, end, first>> of sorted, disjoint intervals that cover spans; first is the earliest span of each."""

    def join(s: Column, reach: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i)["start"] >= F.get(reach, i))
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return let(last, lambda top: let(heads, lambda h: F.transform(h, lambda i, k: F.struct(F.get(s, i)["start"].alias("start"), F.coalesce(F.get(reach, F.get(h, k + 1)), top).alias("end"), F.get(s, i).alias("first")))))

    before = lambda s: scan_before(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
    in_order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), *[x[c].alias(c) for c in ("kind", "value")])))
    return F.when(F.size(spans) > 0, let(in_order, lambda s: let(before(s), lambda reach: join(s, reach))))


def replaced(text: Column, spans: Column, by) -> Column:
    """text with each joined interval of spans replaced by by(interval)."""

    def build(chunks: Column, joined: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(joined, i - 1)["end"]).otherwise(0)
        parts = F.transform(joined, lambda x, i: F.concat(cut_from(chunks, before(i), x["start"]), by(x)))
        rest = cut_from(chunks, F.element_at(joined, -1)["end"], F.length(text))
        return F.concat(F.array_join(parts, ""), rest)

    return F.when(F.size(spans) > 0, let(chunked(text), lambda chunks: let(merged(spans), lambda joined: build(chunks, joined)))).otherwise(text)


def find_entities(docs: DataFrame, text_col: str = "text", out_col: str = "base") -> DataFrame:
    """docs with the base spans of each kind in the order of KINDS, then by start; offsets in code points, end exclusive."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    empty = F.expr("cast(array() as array<string>)")
    df = docs
    for k in KINDS:  # the matches first: most texts have none and are not split
        found = F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))
        if k == "card":  # short digit runs are no cards: only runs with 13 digits or more are looked at again
            found = F.when(F.exists(found, lambda m: F.length(m) >= 13), found).otherwise(empty)
        df = df.withColumn(f"__{k}", F.when(F.contains(text, F.lit(NEEDS[k])), found).otherwise(empty) if NEEDS[k] else found)
    none = F.expr(f"cast(array() as {SPANS})")

    def checked(kind: str) -> Column:
        placed = _placed(text, PATTERNS[kind], F.col(f"__{kind}"), _span(kind))
        return F.when(F.size(f"__{kind}") > 0, F.filter(placed, lambda s: CHECKS[kind](s["value"]))).otherwise(none)

    each = [checked(k) for k in KINDS]
    return df.withColumn(out_col, F.concat(*each)).drop(*[f"__{k}" for k in KINDS])


def find_terms(text: Column, base: Column) -> Column:
    """array<struct<term, start, end, form>> of the whole words outside the base spans; form is the class of the word's form."""
    blank = replaced(text, base, lambda x: F.repeat(F.lit(" "), x["end"] - x["start"]))
    form = lambda w: F.when(w.rlike(r"\p{N}"), "CODE").when(w.rlike(r"^\p{Lu}"), "NAME").otherwise("WORD")
    one = lambda w, start, end: F.struct(F.lower(w).alias("term"), start.alias("start"), end.alias("end"), form(w).alias("form"))
    return let(blank, lambda t: _placed(t, TERM, F.regexp_extract_all(t, F.lit(TERM), F.lit(0)), one))


def _key(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256))


def disclosing_terms(mentions: DataFrame, terms: DataFrame, docs: DataFrame, text_col: str = "text", reach: int = 80, disclosure: float = 0.9) -> DataFrame:
    """(entity, term, told): the terms that reveal an entity, from co-occurrence counts over all distinct texts.

    mentions and terms have (key, entity, start, end) and (key, term, start, end). Near ones meet by stretches of the text, so
    a text with any number of either is no single group.
    """
    wide = 2 * reach
    at = F.explode(F.sequence(F.floor((F.col("start") - reach) / wide), F.floor((F.col("end") + reach) / wide)))
    around = mentions.select("key", "entity", (F.col("start") - reach).alias("lo"), (F.col("end") + reach).alias("hi"), at.alias("at"))
    placed = terms.withColumn("at", F.floor(F.col("start") / wide))
    shown = around.join(placed, ["key", "at"]).where("start >= lo and end <= hi").select("key", "entity", "term").distinct()
    pairs = checkpointed(shown.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te")))
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("told"))
    n_e = mentions.select("key", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    copies = checkpointed(docs.select(_key(text_col).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c")))
    total, several = copies.count(), copies.where("c > 1")
    asked = checkpointed(pairs.select("term").distinct())
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(TERM), F.lit(0)))
    held = docs.select(_key(text_col).alias("key"), words.alias("words"))
    if several.count() <= BROADCAST_ROWS:  # a text of c copies counts 1 / c in each, which the sum takes back to whole numbers
        held = held.join(F.broadcast(several), "key", "left").select(F.explode("words").alias("term"), (1 / F.coalesce("c", F.lit(1))).alias("part"))
        n_t = held.join(asked, "term").groupBy("term").agg(F.round(F.sum("part")).alias("n_t"))
    else:
        n_t = held.select("key", F.explode("words").alias("term")).join(asked, "term").distinct().groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("n_t"))
    scored = pairs.join(n_e, "entity").join(n_t, "term")
    pmi = F.log(F.lit(float(total)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    content = F.log(F.lit(float(total)) / F.col("n_e"))
    return scored.where((pmi >= disclosure * content) & (pmi > 0)).select("entity", "term", (pmi / content).alias("told"))


def sanitise(docs: DataFrame, text_col: str = "text", reach: int = 80, disclosure: float = 0.9, removal: float = 0.999) -> DataFrame:
    """docs with base (the entities' spans) and spans (those and all disclosing terms of these entities in the text). The value
    of a term span is the class that it is generalised to."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = find_entities(docs.select(text.alias("t"), _key(text_col).alias("key")), "t").where("size(base) > 0")
    found = checkpointed(found.select("key", "base", find_terms(F.col("t"), F.col("base")).alias("terms")).dropDuplicates(["key"]))
    mentions = found.select("key", F.explode("base").alias("b")).select("key", F.concat_ws(":", "b.kind", F.lower("b.value")).alias("entity"), "b.start", "b.end")
    terms = found.select("key", F.explode("terms").alias("w")).select("key", "w.*")
    told = checkpointed(disclosing_terms(mentions, terms, docs, text_col, reach, disclosure))
    of_text = mentions.select("key", "entity").distinct().join(told, "entity").groupBy("key", "term").agg(F.max("told").alias("told"))
    hits = terms.join(of_text, ["key", "term"])
    value = F.when(F.col("told") >= removal, "TERM").otherwise(F.col("form"))
    more = hits.select("key", F.struct(F.lit("term").alias("kind"), "start", "end", value.alias("value")).alias("s")).groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("more"))
    none = F.expr(f"cast(array() as {SPANS})")
    of_text = found.select("key", "base").join(more, "key", "left").select("key", F.col("base").alias("b"), F.concat("base", F.coalesce("more", none)).alias("s"))
    of_text = checkpointed(of_text)
    size = of_text.agg(F.count(F.lit(1)) * 96 + F.coalesce(F.sum(F.size("b") + F.size("s")), F.lit(0)) * 96).first()[0]
    if size <= BROADCAST_BYTES:
        of_text = F.broadcast(of_text)
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("base", "spans")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(text_col).alias("key"))
    return rows.join(of_text, "key", "left").select(*kept, F.coalesce("b", none).alias("base"), F.coalesce("s", none).alias("spans"))


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The text with overlapping spans joined and each replaced by a tag: an entity by its kind, a term by its class."""
    tag = lambda x: F.concat(F.lit("["), F.when(x["first"]["kind"] == "term", x["first"]["value"]).otherwise(F.upper(x["first"]["kind"])), F.lit("]"))
    return found.withColumn(text_col, replaced(F.col(f"`{text_col}`").cast("string"), F.col("spans"), tag))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans as text."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    n = [of_kind(k) for k in KINDS]
    return found.select(id_col, *n, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
