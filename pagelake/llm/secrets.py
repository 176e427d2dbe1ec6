"""Secret scans over a trigram inverted index, in Spark expressions only.

Each rule's expression gives a Boolean query over trigrams that a text with a match must hold
(trigrams.py). The index holds postings, trigram to row, for the trigrams that some query names, of
texts lower-cased once. A query opens with few trigrams (Query.lead): only where they are held are
its others looked up. The postings of a rule are intersected to its candidate rows, and the expression
itself verifies those alone. A rule whose expression needs no trigram scans every text.

Candidates (a key and a bit for each rule) go to the scan by broadcast up to FEW of them. Beyond, the
texts that satisfy a query themselves, and no others, are shuffled to meet their candidates, with
the copies of one text spread over SALTS tasks.

Spans are code points, end exclusive, of leftmost non-overlapping matches of each rule. They come from
the lengths of what lies between matches (split) and of the matches (regexp_extract_all), added up in
runs, so that a text with very many matches takes time in proportion.

Nulls: a null text is empty and has no spans; redacted() leaves it null. A null id is kept. Repeated
rows, and texts that share a hash, share their candidates, and each gets its own spans. Spans that
start together are listed in the order of the rules. Very long texts are taken whole; an empty table
gives no rows. Of the input, only the id and the text are read, or the row is carried in one struct, so
further columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm import folds
from pagelake.llm.trigrams import TRUE, Query, derive
from pagelake.session import staged


@dataclass(frozen=True)
class Rule:
    """least: code points that the group needs for a match to count; group 0 is the match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run that is long enough is matched from its start, so its least length can stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Key forms that issuers publish.
FURTHER = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = (*BASE, *FURTHER)
KEY = "__row"
#: Candidates (of some 50 bytes) that are broadcast at most.
FEW = 400_000
#: Tasks over which copies of a text are spread.
SALTS = 16
NONE = "cast(array() as array<struct<start:int,place:int,end:int>>)"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bits(places: list[int]) -> Column:
    return F.lit(sum(1 << p for p in places))


def _held(low: str, queries: list[Query], grams: list[str]) -> Column:
    """The places of grams that a lower-cased text holds, as far as a query that names them is open."""
    place = {g: i for i, g in enumerate(grams)}
    open_ = {g: {x for q in queries if g in q.grams() and g not in q.lead() for x in q.lead()} for g in grams}
    leads = set().union(*(q.lead() for q in queries))

    def has(g: str) -> Column:
        return F.contains(F.col(low), F.lit(g))

    found = [F.when(reduce(lambda a, b: a | b, (F.col(f"__g{place[x]}") for x in sorted(open_[g]))) & has(g), F.lit(place[g])) for g in grams if g not in leads]
    return F.array_compact(F.array(*(F.when(F.col(f"__g{place[g]}"), F.lit(place[g])) for g in sorted(leads)), *found))


def _opened(rows: DataFrame, text: str, queries: list[Query], grams: list[str]) -> DataFrame:
    """The rows with __low and, for each trigram that opens a query, whether it is held."""
    place = {g: i for i, g in enumerate(grams)}
    rows = rows.withColumn("__low", F.lower(F.col(text)))
    return rows.select("*", *(F.contains("__low", F.lit(g)).alias(f"__g{place[g]}") for g in sorted(set().union(*(q.lead() for q in queries)))))


def index(texts: DataFrame, text: str, queries: list[Query], grams: list[str]) -> DataFrame:
    """Postings (gram, row): gram is a place in grams. One row a text and trigram that it holds."""
    rows = _opened(texts.select(KEY, text), text, queries, grams)
    return rows.select(F.explode(_held("__low", queries, grams)).alias("gram"), KEY)


def candidates(postings: DataFrame, queries: list[Query], grams: list[str]) -> DataFrame:
    """(row, rules): a bit for each query that the row's postings satisfy.

    Postings of a row come from one task, which unites them before the shuffle."""
    place = {g: i for i, g in enumerate(grams)}
    words = range(-(-len(grams) // 63))
    met = postings.groupBy(KEY).agg(*(F.bit_or(F.when(F.floor(F.col("gram") / 63) == w, F.expr("shiftleft(1L, gram % 63)")).otherwise(F.lit(0))).alias(f"w{w}") for w in words))

    def holds(q: Query) -> Column:
        if q.kind == "gram":
            return F.col(f"w{place[q.gram] // 63}").bitwiseAND(F.lit(1 << place[q.gram] % 63)) != 0
        return reduce((lambda a, b: a & b) if q.kind == "all" else (lambda a, b: a | b), (holds(p) for p in q.parts))

    return met.select(KEY, _rules([(i, holds(q)) for i, q in enumerate(queries) if q != TRUE]).alias("rules")).where("rules <> 0")


def _rules(told: list[tuple[int, Column]]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in told))


def _spans(m: str, between: str, told: str, rule: Rule, place: int) -> str:
    """SQL for array<struct<start, place, end>> of matches m: each begins where all before it, and
    what lies between them, ends."""
    sizes = f"transform({m}, (x, j) -> cast(length({between}[j]) + length(x) as bigint))"
    spans = f"""transform(filter(transform({m}, (x, j) -> struct(cast(at[j] + length({between}[j]) as int) as start, length(x) as size, length({told}[j]) as told)), y -> y.told >= {rule.least}),
        y -> struct(y.start as start, {place} as place, y.start + y.size as end))"""
    return folds.let(folds.before(sizes), "at", spans)


def _marked(rows: DataFrame, queries: list[Query], few: int) -> DataFrame:
    """rows (row, __t, KEY) with rules: a bit for each query that has the row as a candidate, or null."""
    named = [q for q in queries if q != TRUE]
    if not named:
        return rows.withColumn("rules", F.lit(None).cast("long"))
    grams = sorted(set().union(*(q.grams() for q in named)))
    found = staged(candidates(index(rows, "__t", named, grams), queries, grams), "candidates")
    if found.count() <= few:
        return rows.join(F.broadcast(found), KEY, "left")

    def holds(q: Query) -> Column:
        if q.kind == "gram":
            return F.contains("__low", F.lit(q.gram))
        return reduce((lambda a, b: a & b) if q.kind == "all" else (lambda a, b: a | b), (holds(p) for p in q.parts))

    # the salt also keeps the filters from being pushed below the lower case, where each would make its own
    near = rows.withColumns({"__low": F.lower("__t"), "__salt": F.spark_partition_id() % SALTS})
    near = near.withColumn("__near", reduce(lambda a, b: a | b, (holds(q) for q in named))).drop("__low")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    met = near.where("__near").join(found.withColumn("__salt", salts).hint("shuffle_hash"), [KEY, "__salt"], "left")
    columns = [*rows.columns, "rules"]
    return met.select(*columns).unionByName(near.where("not __near").withColumn("rules", F.lit(None).cast("long")).select(*columns))


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, few: int = FEW) -> DataFrame:
    """row (the input's, in one struct), __t (its text, null as empty) and __s: all spans, sorted by start, then rule."""
    queries = [derive(r.pattern) for r in rules]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    rows = _marked(rows.withColumn(KEY, F.xxhash64("__t")), queries, few)
    matches = [
        F.expr(f"regexp_extract_all(__t, {_quoted(r.pattern)}, 0)" if q == TRUE else f"case when rules & {1 << i}L <> 0 then regexp_extract_all(__t, {_quoted(r.pattern)}, 0) end").alias(f"__m{i}")
        for i, (r, q) in enumerate(zip(rules, queries, strict=True))
    ]
    rows = rows.select("row", "__t", *matches)
    around = [F.expr(f"case when size(__m{i}) > 0 then split(__t, {_quoted(r.pattern)}, -1) end").alias(f"__b{i}") for i, r in enumerate(rules)]
    around += [F.expr(f"case when size(__m{i}) > 0 then regexp_extract_all(__t, {_quoted(r.pattern)}, {r.group}) end").alias(f"__g{i}") for i, r in enumerate(rules)]
    rows = rows.select("row", "__t", *(f"__m{i}" for i in range(len(rules))), *around)
    found = [f"case when size(__m{i}) > 0 then {_spans(f'__m{i}', f'__b{i}', f'__g{i}', r, i)} else {NONE} end" for i, r in enumerate(rules)]
    return rows.select("row", "__t", F.expr(f"array_sort(concat({', '.join(found)}))").alias("__s"))


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def reports(docs: DataFrame, id_column: str = "doc_id", text: str = "text", few: int = FEW) -> DataFrame:
    """id, counts of the base kinds, the digest of base spans, and all spans."""
    s = F.col("__s")
    counts = [F.expr(f"cast(size(filter(__s, x -> x.place = {i})) as bigint)").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    base = F.filter(s, lambda x: x["place"] < len(BASE))
    found = scan(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")), few=few)
    return found.select(F.col("row.id").alias(id_column), *counts, F.sha2(_listed(base, RULES).cast("binary"), 256).alias("base_sha256"), _listed(s, RULES).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", few: int = FEW) -> DataFrame:
    """The rows with every span of their text replaced by the mark; overlapping spans by one."""
    to = folds.before("transform(__s, x -> cast(x.end as bigint))", "greatest({a}, {x})")
    gaps = f"array_join(transform(__s, (x, j) -> if(x.start >= tos[j], concat({folds.cut('bs', 'tos[j]', 'x.start')}, {_quoted(mark)}), '')), '')"
    rest = folds.cut("bs", "array_max(transform(__s, x -> x.end))", "length(__t)")
    clean = folds.let(folds.blocks("__t"), "bs", folds.let(to, "tos", f"concat({gaps}, {rest})"))
    done = scan(docs, text, few=few).withColumn("__c", F.expr(f"case when size(__s) > 0 then {clean} end"))
    return done.select(*(F.coalesce("__c", F.col(f"row.`{c}`")).alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))
