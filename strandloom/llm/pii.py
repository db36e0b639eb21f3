"""Personal data: exact patterns, and terms that disclose a protected value by co-occurrence.

The base finds e-mail addresses, IP addresses, card and phone numbers. Information-theoretic
sanitisation adds to them. Protected entities are the base values, secrets (long runs that mix
letters and digits, which carry far more information than words) and the kinds of both. Over the corpus, a term's disclosure of an entity is the pointwise
information log2 P(entity | term) / P(entity), as a share of the entity's own information
-log2 P(entity); it is 1 for a term that never occurs without the entity. Terms are those of
whole documents, outside protected spans.

A term that shares enough contexts with a value is generalised above one share and removed above a
higher one, wherever it stands in a document with the value. Contexts are the effective number of
different surroundings of the term, by their collision entropy: among copies of one text, edited
ones too, most surroundings are the same. A term that discloses a kind is treated so in all documents, also in those where
nothing else is found; there the evidence is the number of different values it stands with, and
P(kind | term) is the lower end of its confidence interval, so that chance discloses nothing.
Documents without the entity count each, those with it once a context or value: copies can
only lower a disclosure. Everything is DataFrame expressions; positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, old_names, own_names

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds: secrets, terms to generalise, terms to remove.
ADDED = ("secret", "term", "drop")
_SECRET, _GENERALISE, _REMOVE = (len(KINDS) + i for i in range(3))
#: Normal quantile of the confidence interval of P(kind | term).
_SURE = 3.29

# Possessive loops match the same strings as greedy ones here, without deep recursion. A run of
# characters is only tried from its beginning or the end of the match before it: from a later
# place it would fail as it does from there.
_PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot have the kind.
_GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_TERM = r"[\p{L}\p{M}\p{N}]+"
#: A secret: a long run with letters between digits or digits between letters, or a cloud key of fixed form.
_RUNS = r"[A-Za-z0-9]{16,}+"
_CHANGES = r"[A-Za-z][0-9]++[A-Za-z]|[0-9][A-Za-z]++[0-9]|A[KS]IA[A-Z0-9]{16}"
_SPANS = "array<struct<start:int,end:int,rank:int,kind:string>>"
_BLOCK = 256


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of the matches of a pattern that matches no empty string.

    Starts are running sums over gaps and matches, taken in blocks so that many matches in one
    text do not cost their square.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, v: F.struct(F.char_length(g).alias("gap"), v.alias("value")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _BLOCK).cast("int")), lambda b: F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK)))
    none = F.array().cast("array<struct<start:int,value:string>>")

    def walk(block: Column, at: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(at.alias("at"), none.alias("out")),
            lambda s, p: F.struct(
                (s["at"] + p["gap"] + F.coalesce(F.char_length(p["value"]), F.lit(0))).alias("at"),
                F.when(p["value"].isNull(), s["out"]).otherwise(F.array_append(s["out"], F.struct((s["at"] + p["gap"]).alias("start"), p["value"].alias("value")))).alias("out"),
            ),
        )

    return F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,value:string>>>").alias("out")),
        lambda s, b: _step(s, walk(b, s["at"])),
        lambda s: F.flatten(s["out"]),
    )


def _step(s: Column, w: Column) -> Column:
    # The walk is bound once, as the only element of an array.
    return F.get(F.transform(F.array(w), lambda x: F.struct(x["at"].alias("at"), F.array_append(s["out"], x["out"]).alias("out"))), 0)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(s: Column, i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        d = _digits(v)
        return F.when(F.char_length(d).between(12, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(v)).between(9, 15)
    return F.lit(True)


def _kind_spans(text: Column, rank: int, kind: str) -> Column:
    gate = text.contains("@") if kind == "email" else text.rlike(_GATE[kind])
    hits = F.filter(located(text, _PATTERN[kind]), lambda h: _valid(kind, h["value"]))
    spans = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (h["start"] + F.char_length(h["value"])).alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), h["value"].alias("value")))
    return F.when(gate, spans).otherwise(F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,value:string>>"))


def base_spans(text: Column) -> Column:
    """array<struct<start, end, rank, kind, value>> of a non-null text, by start, then kind."""
    parts = [_kind_spans(text, rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower)


def _places(text: Column, terms: Column) -> Column:
    """array<struct<start, value>> of the places of some terms in a text."""
    return F.filter(located(text, _TERM), lambda h: F.array_contains(terms, F.lower(h["value"])))


def _with_neighbours(text: Column) -> Column:
    """array<struct<term, around>> of a text's terms and a hash of the two on either side."""
    near = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in (-2, -1, 1, 2)])
    return F.get(F.transform(F.array(_terms(text)), lambda w: F.transform(w, lambda t, i: F.struct(t.alias("term"), near(w, i).alias("around")))), 0)


def _entity(s: Column) -> Column:
    value = F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(_digits(s["value"]))
    return F.concat_ws(":", s["kind"], value)


def _apart(spans: Column, others: Column) -> Column:
    return F.filter(spans, lambda a: ~F.exists(others, lambda s: (s["start"] < a["end"]) & (a["start"] < s["end"])))


def secret_spans(text: Column, base: Column) -> Column:
    """array<struct<start, end, rank, kind, value>> of the secrets of a non-null text that touch no base span."""
    hits = F.filter(located(text, _RUNS), lambda h: h["value"].rlike(_CHANGES))
    spans = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (h["start"] + F.char_length(h["value"])).alias("end"), F.lit(_SECRET).alias("rank"), F.lit(ADDED[0]).alias("kind"), h["value"].alias("value")))
    return F.when(text.rlike(_CHANGES), _apart(spans, base)).otherwise(F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,value:string>>"))


def merged(spans: Column) -> Column:
    """array<struct<start, end, kind>>: spans by start, then longest, overlaps made one span of the first one's kind."""
    by = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("out"))
    return F.aggregate(
        by,
        start,
        lambda m, s: F.struct(
            F.greatest(m["at"], -s["less"]).alias("at"),
            F.when((s["start"] < m["at"]) & (F.size(m["out"]) > 0), F.concat(F.slice(m["out"], F.lit(1), F.size(m["out"]) - 1), F.array(F.element_at(m["out"], -1).withField("end", F.greatest(m["at"], -s["less"])))))
            .otherwise(F.array_append(m["out"], F.struct(s["start"].alias("start"), (-s["less"]).alias("end"), s["kind"].alias("kind"))))
            .alias("out"),
        ),
        lambda m: m["out"],
    )


def _replaced(text: str, spans: str, by) -> Column:
    """The text of a column with the merged spans of another replaced: by(kind, value)."""
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(F.col(spans), i - 1)["end"])
    value = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    pieces = F.transform(spans, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), by(s["kind"], value(s))))
    return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(spans, -1)["end"] + 1, F.lit(2**31 - 1)))


def _marked(share: Column, generalise: float, remove: float) -> Column:
    return F.when(share >= remove, _REMOVE).when(share >= generalise, _GENERALISE)


def find(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95, least_contexts: int = 3) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, content (xxhash64 of the text), base and added spans.

    base is array<struct<start, end, rank, kind, value>>, added array<struct<start, end, rank,
    kind>> of kind secret, term or drop (see the module); both by start, then kind. Added spans
    never overlap base ones, which stay as they are, nor each other.

    A null text counts as empty. Rows that repeat stay apart, each with its spans; equal values
    of several rows count for each of those documents, but contexts count once, so that copies
    of one passage disclose nothing. Shares equal to a threshold pass it. Other columns are
    ignored; an empty table stays empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), text.alias("text"))
    b = d.withColumn("base", base_spans(F.col("text"))).withColumn("secrets", secret_spans(F.col("text"), F.col("base")))
    has = F.size("base") + F.size("secrets") > 0
    b = b.select(F.monotonically_increasing_id().alias("row"), "doc_id", "content", "base", "secrets", F.when(has, F.col("text")).alias("text"))
    b = materialize(b, "spans")
    n = b.count()
    spans = b.where(has).select("row", "text", F.concat("base", "secrets").alias("all"))
    pairs = spans.select("row", F.explode(F.array_distinct(F.transform("all", _entity))).alias("entity"))
    # No term can have more contexts than its value has documents.
    entities = pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.count(F.lit(1)).alias("seen")).where(F.col("n_entity") >= least_contexts)
    # Of a kind's values in a document the least stands for the document.
    kinds = spans.select("row", F.explode("all").alias("s")).groupBy("row", F.col("s.kind").alias("entity")).agg(F.min(_entity(F.col("s"))).alias("value"))
    kinds = materialize(kinds, "kinds")
    of_kinds = kinds.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.countDistinct("value").alias("seen"))
    entities = materialize(entities.withColumn("of_kind", F.lit(False)).unionByName(of_kinds.withColumn("of_kind", F.lit(True))), "entities")
    asked = pairs.join(entities.select("entity"), "entity").select("row", "entity", F.lit(None).cast("long").alias("value")).unionByName(kinds.withColumn("value", F.xxhash64("value")))
    asked = materialize(asked, "asked")

    outside = spans.withColumn("m", merged(F.col("all"))).select("row", _replaced("text", "m", lambda kind, value: F.lit(" ")).alias("rest"))
    terms = outside.select("row", F.posexplode(_with_neighbours(F.col("rest"))).alias("i", "t"))
    terms = terms.groupBy("row", F.col("t.term").alias("term")).agg(F.xxhash64(F.min_by("t.around", "i"), F.max_by("t.around", "i")).alias("around"))
    terms = materialize(terms, "terms")
    both = terms.join(asked, "row").groupBy("entity", "term", F.coalesce("value", "around").alias("context"), F.col("value").isNotNull().alias("of_kind")).agg(F.count(F.lit(1)).alias("c"))
    squares = F.sum(F.col("c").cast("double") * F.col("c"))
    both = both.groupBy("entity", "term", "of_kind").agg(F.sum("c").alias("n_both"), F.when(F.col("of_kind"), F.count(F.lit(1))).otherwise(F.floor(F.sum("c") * F.sum("c") / squares + 1e-9)).alias("contexts"))
    both = both.drop("of_kind").where(F.col("contexts") >= least_contexts)
    # Document frequencies over all documents, counted before they meet the terms asked for; of documents with spans, over what is outside.
    each = lambda df: df.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term")
    df = each(d).agg(F.count(F.lit(1)).alias("n_term"))
    within = each(spans).agg(F.count(F.lit(1)).alias("n_within"))
    out = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_outside"))
    info = both.join(df, "term").join(within, "term").join(out, "term").join(entities, "entity")
    # Documents with the term and without the entity, and both probabilities.
    others = F.col("n_term") - F.col("n_within") + F.col("n_outside") - F.col("n_both")
    k, m, z2 = F.col("contexts"), F.col("contexts") + others, _SURE**2
    low = (k / m + z2 / (2 * m) - _SURE * F.sqrt((k / m) * (1 - k / m) / m + z2 / (4 * m * m))) / (1 + z2 / m)
    given = F.when(F.col("of_kind"), low).otherwise(k / m)
    chance = F.col("seen") / (F.col("seen") + n - F.col("n_entity"))
    share = F.when(chance < 1, F.log2(given / chance) / -F.log2(chance)).otherwise(0.0)
    info = info.withColumn("rank", _marked(share, generalise, remove)).where("rank is not null").select("entity", "term", "of_kind", "rank")
    info = materialize(info, "disclosing")

    place = lambda t: (F.col(f"{t}.start").alias("start"), (F.col(f"{t}.start") + F.char_length(f"{t}.value")).alias("end"), F.lower(f"{t}.value").alias("term"))
    listed = F.array_sort(F.collect_list(F.struct("start", "end", "rank", F.when(F.col("rank") == _REMOVE, ADDED[2]).otherwise(ADDED[1]).alias("kind"))))
    added = b.select("row", "doc_id", "content", "base", "secrets")
    # A term that discloses discloses wherever it stands, also where it is the only trace. The
    # stronger mark wins where it discloses several values or kinds.
    everywhere = materialize(info.groupBy("term").agg(F.max("rank").alias("rank")), "everywhere")
    if not everywhere.isEmpty():
        # Spans depend on the text alone, so rows of one id and text share them.
        hits = d.select("doc_id", "content", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(everywhere, "term", "left_semi")
        hits = materialize(hits.groupBy(F.col("doc_id").alias("__d"), F.col("content").alias("__c")).agg(F.collect_set("term").alias("__t")), "everywhere")
        same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("content") == F.col("__c"))
        texts = d.join(hits, same).dropDuplicates(["doc_id", "content"])
        # Of a text's words only those that disclose become rows.
        places = texts.select("doc_id", "content", F.explode(_places(F.col("text"), F.col("__t"))).alias("t")).select("doc_id", "content", *place("t"))
        wide = places.join(everywhere, "term").groupBy(F.col("doc_id").alias("__d"), F.col("content").alias("__c")).agg(listed.alias("wide"))
        added = added.join(wide, same, "left").drop("__d", "__c")
    else:
        added = added.withColumn("wide", F.lit(None).cast(_SPANS))
    once = F.coalesce("wide", F.array().cast(_SPANS))
    bare = F.transform("secrets", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind")))
    return added.select("doc_id", "content", "base", F.array_sort(F.concat(bare, _apart(_apart(once, F.col("base")), F.col("secrets")))).alias("added"))


def summary(found: DataFrame) -> DataFrame:
    """find's result as doc_id, counts by kind, base_sha256 and spans."""
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind")))
    by_kind = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_written(by_kind(F.col("base"))), 256).alias("base_sha256"), _written(by_kind(F.concat(bare("base"), bare("added")))).alias("spans"))


def _class(value: Column) -> Column:
    """What a term is: the word that generalises it."""
    return F.when(value.rlike(r"^\p{N}+$"), "number").when(value.rlike(r"\p{N}"), "code").when(value.rlike(r"^\p{Lu}"), "name").otherwise("word")


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """docs with personal data replaced in text, and n_chars, where there is such a column, set anew.

    A base span or secret becomes its kind in brackets, a term to generalise the word for what it
    is (word, name, number or code); a term to remove goes. Of overlapping spans the one that
    starts first, then the longest, names the place. Texts without spans, null ones too, stay as
    they are. Rows that repeat stay apart; other columns, whatever their names, are kept.
    """
    own, names = own_names(docs)
    text, doc_id = names["text"], names["doc_id"]
    hit = find(docs, **how).where(F.size("base") + F.size("added") > 0)
    # Spans depend on the text alone, so rows of one id and text share them.
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    hit = hit.select(F.col("doc_id").alias("__d"), F.col("content").alias("__c"), F.concat(bare("base"), bare("added")).alias("__s"), (F.size("base") == 0).alias("__bare"))
    hit = materialize(hit.groupBy("__d", "__c", "__bare").agg(F.first("__s").alias("__s")), "hits")
    gate = F.col(text).contains("@") | F.col(text).rlike(_CHANGES)
    for k in KINDS[1:]:
        gate = gate | F.col(text).rlike(_GATE[k])
    gate = F.coalesce(gate, F.lit(False))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(text) == F.col("__c"))
    # A text that passes no gate can have terms of a kind only: few do, and their table is small as a rule.
    d = own.where(gate).join(hit, same, "left").unionByName(own.where(~gate).join(hit.where("__bare"), same, "left"))
    d = d.withColumn("__m", merged(F.col("__s")))

    def by(kind: Column, value: Column) -> Column:
        return F.when(kind == ADDED[2], "").when(kind == ADDED[1], _class(value)).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))

    untouched = F.col("__m").isNull()
    d = d.withColumn(text, F.when(untouched, F.col(text)).otherwise(_replaced(text, "__m", by)))
    if "n_chars" in names:
        n = names["n_chars"]
        d = d.withColumn(n, F.when(untouched, F.col(n)).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType)))
    return old_names(d, names)
