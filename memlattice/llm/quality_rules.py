"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule, and is stored; a
policy is a named, versioned set of rules, applied afterwards as a mask, and an ablation is an aggregation over the bits
alone, so neither reads a text again. Everything is a native expression: no Python runs on the executors.

Null or empty texts have no words and fail the rule on few words. A text of any length is measured whole, in time in
proportion to it but for sorting the windows of one that repeats itself. Repeated rows are judged one by one (there are no
ties to break), an empty table gives an empty ledger, and the added columns take free names where the input has columns of
theirs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import SPACE, free, words


@dataclass(frozen=True)
class Rule:
    """A document fails where the predicate over the measurements is true; the bit never changes its meaning."""

    name: str
    bit: int
    fails: str


#: Bits are for ever: a changed rule gets a new bit and a new name.
RULES = (
    Rule("few_words", 0, "{n_words} < 50"),
    Rule("repeated_windows", 1, "100 * {n_repeat_words} > 50 * {n_words}"),
    Rule("symbols", 2, "10 * {n_symbols} > 3 * {n_words}"),
    Rule("repeated_lines", 3, "{n_dup_lines} >= 3 and 10 * {n_dup_lines} > 6 * {n_text_lines}"),
    Rule("short_words", 4, "{word_chars} < 2 * {n_words}"),
    Rule("long_words", 5, "{word_chars} > 25 * {n_words}"),
    Rule("shouting", 6, "10 * {n_capitals} > 6 * {word_chars}"),
    Rule("exclamations", 7, "2 * {n_exclamations} > {n_words}"),
)

#: Policies name rules; a new version is a new entry.
POLICIES = {
    "base@1": ("few_words", "repeated_windows"),
    "standard@1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "shouting", "exclamations"),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines", "n_capitals", "n_exclamations")


def mask(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of a policy's rules."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {r.name: 1 << r.bit for r in rules}
    return reduce(int.__or__, (bits[n] for n in names), 0)


def _count(text: Column, but: str) -> Column:
    """How many characters of the text are left without those that match."""
    return F.length(F.regexp_replace(text, but, "")).cast("long")


def ledger(df: DataFrame, text: str = "text", out: str = "ledger", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with one struct column more: the measurements and fail_bits.

    Words in repeated three-word windows are found by hashing each window (64 bits), and only where a document has fewer
    distinct hashes than windows, by sorting (hash, position) and adding up how far each marked window reaches.
    """
    base, arrays, marks, ranked = free(df, "q_base", "q_arrays", "q_windows", "q_ranked")
    t = F.coalesce(F.col(text), F.lit(""))
    out = free(df, out)[0]
    df = df.withColumn(base, words(F.col(text)))
    n = F.size(base)
    df = df.withColumn(
        arrays,
        F.when(n >= 3, F.expr(f"transform(sequence(0, size({base}) - 3), i -> xxhash64(get({base}, i), get({base}, i + 1), get({base}, i + 2)))")).otherwise(F.expr("array()").cast("array<bigint>")),
    )
    df = df.withColumn(
        marks,
        F.when(F.size(F.array_distinct(arrays)) < F.size(arrays), F.expr(f"sort_array(transform({arrays}, (h, i) -> struct(h, i as p)))")),
    )
    df = df.withColumn(ranked, F.expr(f"sort_array(transform(filter({marks}, (x, i) -> get({marks}, i - 1).h = x.h or get({marks}, i + 1).h = x.h), x -> x.p))"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    measured = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(base, "")).cast("long").alias("word_chars"),
        _count(t, r"[^#*$%&|<>]+").alias("n_symbols"),
        F.coalesce(F.expr(f"aggregate(transform({ranked}, (p, i) -> least(3, get({ranked}, i + 1) - p)), 0L, (a, x) -> a + x)"), F.lit(0)).cast("long").alias("n_repeat_words"),
        lines.alias("lines"),
        _count(t, r"[^\p{Lu}]+").alias("n_capitals"),
        _count(t, r"[^!]+").alias("n_exclamations"),
    )
    df = df.withColumn(marks, measured)
    x = F.col(marks)
    fields = {m: x[m] for m in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_capitals", "n_exclamations")}
    fields |= {"n_text_lines": F.size(x["lines"]).cast("long"), "n_dup_lines": (F.size(x["lines"]) - F.size(F.array_distinct(x["lines"]))).cast("long")}
    df = df.withColumn(marks, F.struct(*(fields[m].alias(m) for m in MEASURES)))
    bits = [F.when(F.expr(r.fails.format(**{m: f"{marks}.{m}" for m in MEASURES})), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")) for r in rules]
    # The last term is nothing, but isn't deterministic: a filter on the ledger stays above it. Pushed down it would take
    # the place of every column it stands for, and each measurement would be worked out many times over.
    fence = F.spark_partition_id().cast("long").bitwiseAND(F.lit(0).cast("long"))
    df = df.withColumn(out, F.struct(*(F.col(marks)[m].alias(m) for m in MEASURES), reduce(lambda a, b: a.bitwiseOR(b), [*bits, fence]).alias("fail_bits")))
    return df.drop(base, arrays, marks, ranked)


def passes(fail_bits: Column, policy: str | tuple[str, ...]) -> Column:
    """Whether a document passes a policy."""
    return fail_bits.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(ledgered: DataFrame, policy: str | tuple[str, ...], fail_bits: str = "ledger.fail_bits", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing else, and that pass with the rule left out.

    The documents are first counted by their failure bits, of which there are at most 2 to the number of rules.
    """
    whole = mask(policy, rules)
    counts = ledgered.groupBy(F.col(fail_bits).bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    names = POLICIES[policy] if isinstance(policy, str) else policy
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if r.name in names)))
    counts = counts.select("bits", "n", each.alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    only = F.col("bits") == F.col("r.bit")
    return counts.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(only | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def stored_ledger(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger as a table: (id_col, measurements, fail_bits). The texts are read for it, and never again."""
    out = free(df.select(id_col), "ledger")[0]
    names = free(df.select(id_col), *MEASURES, "fail_bits")
    x = ledger(df.select(id_col, F.col(text)), text, out)
    return materialize(x.select(id_col, *(F.col(out)[c].alias(n) for c, n in zip((*MEASURES, "fail_bits"), names))))


def op4(df: DataFrame, policy: str = "standard@1") -> DataFrame:
    """The digest of the contract, from the stored ledger: measurements, base_failed and kept for every document."""
    return stored_ledger(df).select(
        "doc_id",
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        (~passes(F.col("fail_bits"), "base@1")).alias("base_failed"),
        passes(F.col("fail_bits"), policy).alias("kept"),
        "fail_bits",
    )


def ablation(df: DataFrame, policy: str = "standard@1") -> DataFrame:
    """What each rule of a policy does to all documents, from the stored ledger."""
    return ablations(stored_ledger(df), policy, "fail_bits")


def stage(df: DataFrame, policy: str = "standard@1") -> DataFrame:
    """The documents that pass the policy, with their own columns."""
    out = free(df, "ledger")[0]
    return ledger(df, out=out).where(passes(F.col(out)["fail_bits"], policy)).drop(out)


_LEDGER_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents
), g as (
  select doc_id, p, count(*) over (partition by doc_id, g) as n
  from (select doc_id, unnest(range(1, len(ws) - 1)) as p, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as g from w)
), r as (
  select doc_id, sum(least(3, coalesce(nxt - p, 3))) as n_repeat_words
  from (select doc_id, p, lead(p) over (partition by doc_id order by p) as nxt from g where n > 1) group by doc_id
), m as (
  select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls) as n_text_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         length(regexp_replace(t, '\P{Lu}', '', 'g')) as n_capitals, length(regexp_replace(t, '[^!]', '', 'g')) as n_exclamations
  from w left join r on r.doc_id = w.doc_id
), b as (
  select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
    + case when 10 * n_symbols > 3 * n_words then 4 else 0 end
    + case when n_dup_lines >= 3 and 10 * n_dup_lines > 6 * n_text_lines then 8 else 0 end
    + case when word_chars < 2 * n_words then 16 else 0 end + case when word_chars > 25 * n_words then 32 else 0 end
    + case when 10 * n_capitals > 6 * word_chars then 64 else 0 end + case when 2 * n_exclamations > n_words then 128 else 0 end)::bigint as fail_bits
  from m
)
"""

ORACLE = (
    _LEDGER_SQL
    + """
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept, fail_bits
from b
"""
)

ABLATION_ORACLE = (
    _LEDGER_SQL
    + f"""
select rule, (count(*) filter (where fail_bits & bit <> 0))::bigint as n_failed, (count(*) filter (where fail_bits = bit))::bigint as n_failed_alone,
       (count(*) filter (where fail_bits in (0, bit)))::bigint as n_kept_without
from b, (values {", ".join(f"('{r.name}', {1 << r.bit}::bigint)" for r in RULES)}) as r(rule, bit) group by rule
"""
)
