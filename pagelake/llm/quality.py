"""Quality rules as weak supervision, in Spark expressions only.

Each rule votes for a document (1), against it (-1) or abstains (0). A rule has an unknown rate of
being right on good and on bad documents; expectation-maximisation over all documents estimates
both and the share of good documents, from the counts of vote patterns alone: RULES rules have at
most 3 ** RULES patterns, however many documents there are. The posterior probability of being
good then decides, in place of all rules having to pass.

Rates on good documents stay within RATE, and a rule speaks against bad documents more often than
against good ones by MARGIN at least, so "good" keeps its meaning; a rule that nearly all documents
pass tells little either way. A table without documents leaves the rates at their start. The symbol
rules look at different things: symbols for each word, words of symbols alone, and others that end in one.
"common" abstains where under two of its words occur, as in a language that it doesn't list.

Nulls: a null text has no words and fails the base rule; a null id is kept. A repeated row is judged
as often as it occurs, and alike. An empty table gives no rows. Of further columns those asked for
come back unchanged, whatever their names: scores() reads the id and the text alone, and kept() and
judge() carry the row in one struct. Texts of any length are taken whole; their windows are sorted
by the three words themselves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.session import staged

SPACES = "[\\x20\\x09-\\x0D]+"
#: Words of each language that prose cannot do without.
COMMON = (
    "the of and to in is that it for on with as are this was by from at or an be not have".split()
    + "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()
    + "de la le et les des en un du une que est pour qui dans par sur pas au il elle".split()
    + "el los y del se las por con no una su para al lo como más o pero sus".split()
)
ROUNDS = 25
START, RATE = 0.8, (0.55, 0.99)
#: A rule speaks against a bad document more often than against a good one, by so much at least.
MARGIN = 0.02
PRIOR = (0.1, 0.98)
KEEP = 0.5


def measure(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns and, in __m, what the rules look at."""
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    df = df.select(*keep, "__t", F.expr("cast(regexp_count(__t, '[#*$%&|<>]') as bigint)").alias("__s"), F.array_remove(F.split("__t", SPACES), "").alias("__w"), F.expr("filter(split(__t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("__l"))
    # windows sorted by their three words, then place: equal ones are neighbours, whatever lies between them in the text
    sorted_ = """case when size(__w) > 2 then sort_array(arrays_zip(
        slice(__w, 1, size(__w) - 2), slice(__w, 2, size(__w) - 2), slice(__w, 3, size(__w) - 2), sequence(0, size(__w) - 3))) end"""
    df = df.select(*keep, "__t", "__s", "__w", "__l", F.expr(sorted_).alias("__p"))

    def same(j: str) -> str:
        return "(" + " and ".join(f"__p[{j}].`{k}` = x.`{k}`" for k in range(3)) + ")"

    twice = f"filter(__p, (x, j) -> (j > 0 and {same('j - 1')}) or (j + 1 < size(__p) and {same('j + 1')}))"
    df = df.select(*keep, "__t", "__s", "__w", "__l", F.expr(f"sort_array(transform({twice}, x -> x.`3`))").alias("__r"))
    repeat = "aggregate(transform(__r, (p, j) -> if(j = 0, 3L, least(3L, cast(p - __r[j - 1] as bigint)))), 0L, (a, x) -> a + x)"
    common = ", ".join(f"'{w}'" for w in sorted(set(COMMON)))
    return df.select(*keep, F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.col("__s").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr(repeat), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.expr("size(filter(__l, l -> l rlike '[.!?\"”»:;…)][\\\\x20\\\\x09-\\\\x0D]*$'))").cast("long").alias("n_closed_lines"),
        F.expr("if(__s = 0, 0, size(filter(__w, w -> rtrim('#*$%&|<>', w) = '')))").cast("long").alias("n_bare"),
        F.expr("if(__s = 0, 0, size(filter(__w, w -> right(w, 1) in ('#', '*', '$', '%', '&', '|', '<', '>') and rtrim('#*$%&|<>', w) <> '')))").cast("long").alias("n_glued"),
        F.expr("regexp_count(__t, '[0-9]')").cast("long").alias("n_digits"),
        F.expr(f"size(filter(slice(__w, 1, size(__w)), w -> lower(w) in ({common})))").cast("long").alias("n_common"),
    ).alias("__m"))


def base_failed() -> Column:
    m = F.col("__m")
    return (m.n_words < 50) | (m.n_repeat_words * 100 > m.n_words * 50)


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """The votes. A rule abstains between its bounds, and where it has nothing to look at."""
    m = F.col("__m")

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b)

    symbols, lines, repeats = share(m.n_symbols, m.n_words), share(m.n_dup_lines, m.n_lines), share(m.n_repeat_words, m.n_words)
    bare, glued = share(m.n_bare, m.n_words), share(m.n_glued, m.n_words)
    length, closed, digits, common = share(m.word_chars, m.n_words), share(m.n_closed_lines, m.n_lines), share(m.n_digits, m.word_chars), F.when(m.n_common >= 2, share(m.n_common, m.n_words))
    return {
        "symbols": _vote(symbols, symbols < 0.03, symbols > 0.15),
        "bare": _vote(bare, bare < 0.1, bare > 0.3),
        "glued": _vote(glued, glued < 0.03, glued > 0.15),
        "lines": _vote(lines, lines < 0.05, lines > 0.3),
        "repeats": _vote(repeats, repeats < 0.1, repeats > 0.3),
        "length": _vote(length, length.between(3.5, 9), ~length.between(2.5, 14)),
        "closed": _vote(closed, closed > 0.7, closed < 0.1),
        "digits": _vote(digits, digits < 0.05, digits > 0.25),
        "common": _vote(common, common > 0.12, common < 0.02),
        "size": _vote(m.n_words, m.n_words >= 100, m.n_words < 50),
    }


@dataclass(frozen=True)
class Model:
    """Share of good documents, and of each rule the rate of being right on good and bad ones."""

    prior: float
    good: dict[str, float]
    bad: dict[str, float]

    def posterior(self, votes: dict[str, Column]) -> Column:
        """Probability of being good."""
        odds = [F.lit(math.log(self.prior / (1 - self.prior)))]
        for name, vote in votes.items():
            g, b = self.good[name], self.bad[name]
            odds.append(F.when(vote == 1, math.log(g / (1 - b))).when(vote == -1, math.log((1 - g) / b)).otherwise(0.0))
        return 1 / (1 + F.exp(-reduce(lambda x, y: x + y, odds)))


def fit(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over the vote columns of all rows."""
    patterns = staged(votes.groupBy(*names).agg(F.count("*").alias("n")), "patterns")
    model = Model(0.7, dict.fromkeys(names, START), dict.fromkeys(names, START))
    columns = {c: F.col(c) for c in names}

    def within(right: float | None, all_: float | None, bounds: tuple[float, float]) -> float:  # two votes that agree with START are added
        return min(max(((right or 0) + 2 * START) / ((all_ or 0) + 2), bounds[0]), bounds[1])

    for _ in range(rounds):
        p = patterns.select("*", model.posterior(columns).alias("p"))
        sums = [F.sum(F.col("n") * F.col("p")).alias("good"), F.sum("n").alias("all")]
        for c in names:
            for kind, weight in (("g", F.col("p")), ("b", 1 - F.col("p"))):
                sums += [F.sum(F.when(F.col(c) == v, F.col("n") * weight).otherwise(0.0)).alias(f"{kind}{v}_{c}") for v in (1, -1)]
        s = p.agg(*sums).first()
        before = model
        good = {c: within(s[f"g1_{c}"], (s[f"g1_{c}"] or 0) + (s[f"g-1_{c}"] or 0), RATE) for c in names}
        bad = {c: within(s[f"b-1_{c}"], (s[f"b1_{c}"] or 0) + (s[f"b-1_{c}"] or 0), (1 - good[c] + MARGIN, RATE[1])) for c in names}
        model = Model(within(s["good"], s["all"], PRIOR), good, bad)
        if max(abs(a - b) for a, b in zip((model.prior, *model.good.values(), *model.bad.values()), (before.prior, *before.good.values(), *before.bad.values()), strict=True)) < 1e-4:
            break
    return model


def judge(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row (the input's columns, or those named, in one struct), __m, __failed (the base rule), __good
    (posterior) and __keep."""
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)))
    rows = staged(measure(docs.select(row.alias("row"), F.col(f"`{text}`").alias("text")), "text", ["row"]), "measured")
    votes = rules()
    model = fit(rows.select(*(v.alias(k) for k, v in votes.items())), list(votes))
    rows = rows.select("*", base_failed().alias("__failed"), model.posterior(votes).alias("__good"))
    return rows.select("*", (~F.col("__failed") & (F.col("__good") >= KEEP)).alias("__keep"))


def scores(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, the base counts, base_failed, kept and the posterior of every row."""
    m = F.col("__m")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = judge(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")), carry=["id"]).select("row.id", "__m", "__failed", "__keep", "__good")
    return rows.select(F.col("id").alias(id_column), *(m[c].alias(c) for c in counts), F.col("__failed").alias("base_failed"), F.col("__keep").alias("kept"), F.col("__good").alias("posterior"))


def kept(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, as they are."""
    return judge(docs, text).where("__keep").select("row.*")
