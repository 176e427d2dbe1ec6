"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import audio, chat, language, packing, pieces, quality, secrets, simhash, substrings, token_files
from pagelake.session import shared_path, table


def tokenizer(name: str) -> str:
    """The path of a public tokenizer file; the package lies beside the other libraries."""
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None or spec.origin is None:
        return f"/opt/tokenizers/{name}"
    return str(Path(spec.origin).parent / name)


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_debruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.deduplicate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.reports(table(spark, sf_dir, "documents"))


def op5_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), out)
    return token_files.read(spark, out, token_files.crc_column, "ids_crc32 long")


def op6_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no recordings: each vector of embeddings is sounded as a melody."""
    prints = audio.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", audio.melody)
    return audio.search(prints, "vec_id", "vec_id % 20 = 0")


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.sql("select -1L as conv_id, turn, role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_simhash_variants": op2_simhash_variants,
    "op3_debruijn_substrings": op3_debruijn_substrings,
    "op4_trigram_secrets": op4_trigram_secrets,
    "op5_simple8b_files": op5_simple8b_files,
    "op6_chroma_fingerprints": op6_chroma_fingerprints,
    "op7_weak_supervision": op7_weak_supervision,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_output_codes": op9_output_codes,
    "op10_relational_chat": op10_relational_chat,
}

_SPACES = "[\\x20\\x09-\\x0D]+"


def _op3_sql(window: int = substrings.WINDOW) -> str:
    """Windows as strings, as no word holds a space; a word goes if a repeated window starts so near before it."""
    return f"""with docs as (select row_number() over () as r, doc_id, regexp_split_to_array(coalesce(text, ''), '{_SPACES}') as l from documents),
    split as (select r, unnest(l) as w, generate_subscripts(l, 1) as i from docs),
    words as (select r, w, row_number() over (partition by r order by i) as i from split where w <> ''),
    lists as (select r, list(w order by i) as l from words group by r),
    starts as (select r, unnest(range(1, len(l) - {window - 2})) as i, l from lists where len(l) >= {window}),
    windows as (select r, i, array_to_string(l[i:i + {window - 1}], ' ') as x from starts),
    twice as (select x from windows group by x having count(*) > 1),
    hits as (select r, i from windows semi join twice using (x)),
    marked as (select w.r, w.i, w.w, coalesce(max(h.i) over (partition by w.r order by w.i) > w.i - {window}, false) as gone from words w left join hits h using (r, i))
    select doc_id, count(m.i) as n_words, count(*) filter (gone) as n_removed, sha256(coalesce(string_agg(w, ' ' order by i) filter (not gone), '')) as kept_sha256
    from docs left join marked m using (r) group by r, doc_id"""


def _op4_sql() -> str:
    """Each rule's matches, placed by the lengths of what lies before them."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts, found = [], []
    for i, r in enumerate(secrets.RULES):
        p = quoted(r.pattern)
        parts.append(f"""m{i} as (select r, generate_subscripts(m, 1) as j, unnest(m) as x, unnest(g) as g, unnest(b[1:len(m)]) as b from
        (select r, regexp_extract_all(t, {p}, 0) as m, regexp_extract_all(t, {p}, {r.group}) as g, string_split_regex(t, {p}) as b from docs where regexp_matches(t, {p})))""")
        found.append(f"""select r, {i} as place, '{r.kind}' as kind, sum(length(b) + length(x)) over (partition by r order by j) - length(x) as a, sum(length(b) + length(x)) over (partition by r order by j) as z, length(g) >= {r.least} as counts from m{i}""")
    line = "kind || ':' || a::bigint || ':' || z::bigint"
    base = len(secrets.BASE)
    counts = ", ".join(f"count(*) filter (place = {i}) as n_{r.kind}" for i, r in enumerate(secrets.BASE))
    return f"""with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents), {", ".join(parts)}, spans as (select * from ({" union all ".join(found)}) where counts)
    select doc_id, {counts}, sha256(coalesce(string_agg({line}, ',' order by a, place) filter (place < {base}), '')) as base_sha256, coalesce(string_agg({line}, ',' order by a, place), '') as spans
    from docs left join spans using (r) group by r, doc_id"""


def _op10_sql() -> str:
    def escaped(x: str) -> str:
        return f"replace(replace({x}, '<', '<\\'), '[', '[\\')"

    size = len(chat.OPEN) + len(chat.SHUT)
    return f"""with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
    ordered as (select *, row_number() over w as k, lag(role) over w as before, lead(role) over w as after from turns window w as (partition by conv_id order by turn nulls first, role, text)),
    sized as (select *, case when before is distinct from role then {size} + length(replace({escaped("role")}, chr(10), '[n')) else {len(chat.NEXT)} end
      + length({escaped("text")}) + case when after is distinct from role then {len(chat.END)} else 0 end as n from ordered)
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
      cast(coalesce(sum(length(text)) filter (role = '{chat.LEARN}'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by k) filter (role = '{chat.LEARN}'), '')) as loss_sha256,
      cast(sum(n) as bigint) as formatted_chars from sized group by conv_id"""


#: DuckDB SQL of those whose rows SQL can give. Tokenizers, XXH64, sounds and fitted models are beyond it.
ORACLE_SQL: dict[str, str] = {"op3_debruijn_substrings": _op3_sql(), "op4_trigram_secrets": _op4_sql(), "op10_relational_chat": _op10_sql()}
