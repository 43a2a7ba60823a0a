"""Rule bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger stores the measurements
and one bit per failed rule. Policies are versions of (which bits reject at
once, which count, how many of those are allowed); applying one, comparing
versions, or asking what each rule costs (ablation) reads the mask alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, text_of, word_list

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and MEASURES (bigint) of every document's whole text.

    Each step is a projection of its own, so that Catalyst keeps word and window
    arrays as columns instead of evaluating them again inside a lambda.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(F.col(f"`{text_col}`")).alias("_text"))
    words = base.select("_id", "_text", word_list(F.col("_text")).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = words.select(
        "_id",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.translate("_text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        _count_of("_text", SYMBOLS).alias("n_symbols"),
        _count_of("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        lines.alias("_lines"),
    ).select("*", F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))
    start = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.struct(F.concat_ws(" ", F.col("_words")[i], F.col("_words")[i + 1], F.col("_words")[i + 2]).alias("w"), i.alias("at"))
    windows = counted.drop("_lines").withColumn("_windows", F.sort_array(F.transform(start, window)))
    return windows.withColumn("_last", F.size("_windows") - 1).withColumn("n_repeat_words", _covered()).select(F.col("_id").alias(id_col), *MEASURES)


def _count_of(text: str, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def _covered() -> Column:
    """Words that lie in a window whose equal stands next to it in the sorted windows."""
    sorted_, last = F.col("_windows"), F.col("_last")
    twice = F.filter(sorted_, lambda x, j: ((j > 0) & (sorted_[F.greatest(j - 1, F.lit(0))]["w"] == x["w"])) | ((j < last) & (sorted_[F.least(j + 1, last)]["w"] == x["w"])))
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))))).cast("long")


@dataclass(frozen=True)
class Rule:
    """A named test over the measures: true where a document fails. Its place in a rule list is its bit."""

    name: str
    fails: Callable[[], Column] = field(repr=False)


def _c(name: str) -> Column:
    return F.col(name)


RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda: _c("n_words") < 50),
    Rule("repeated_windows", lambda: 100 * _c("n_repeat_words") > 50 * _c("n_words")),
    Rule("symbols", lambda: 10 * _c("n_symbols") > _c("n_words")),
    Rule("word_length", lambda: (_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 15 * _c("n_words"))),
    Rule("repeated_lines", lambda: 10 * _c("n_dup_lines") > 3 * _c("n_lines")),
    Rule("capitals", lambda: 2 * _c("n_upper") > _c("word_chars")),
)


@dataclass(frozen=True)
class Policy:
    """A version: rules that reject at once, rules that count, and how many of the latter may fail."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    allowed: int = 0

    def mask(self, names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
        places = {r.name: i for i, r in enumerate(rules)}
        return sum(1 << places[n] for n in names)


POLICIES = {
    "base": Policy("base", ("few_words", "repeated_windows")),
    "2": Policy("2", ("few_words", "repeated_windows", "symbols", "capitals"), ("word_length", "repeated_lines"), 1),
}


def ledger(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, all measures and failed, a bigint with bit i set where rule i fails.

    Defined cases: a null text counts as the empty text (all measures 0, which
    fails few_words); null ids and repeated rows give one row each; an empty
    table gives an empty ledger; other columns are not read.
    """
    if len(rules) > 62:
        raise ValueError("a bigint ledger holds 62 rules")
    bits = [F.when(F.coalesce(r.fails(), F.lit(False)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(rules)]
    return measured(docs, id_col=id_col, text_col=text_col).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long")))


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES, without: int = 0) -> Column:
    """True where a ledger row passes the policy, with the bits of without left out."""
    failed = F.col("failed")
    hard, soft = policy.mask(policy.hard, rules) & ~without, policy.mask(policy.soft, rules) & ~without
    return (failed.bitwiseAND(F.lit(hard)) == 0) & (F.bit_count(failed.bitwiseAND(F.lit(soft))) <= policy.allowed)


def ablations(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule: documents that fail it, that only it rejects (they pass without it), and the union of what fails beside it.

    Documents are summed up by mask first, so only distinct masks are looked at rule by rule.
    """
    masks = book.groupBy("failed").agg(F.count("*").alias("_n"))
    each = []
    for i, r in enumerate(rules):
        bit = 1 << i
        alone = ~passes(policy, rules) & passes(policy, rules, bit)
        has = F.col("failed").bitwiseAND(F.lit(bit)) != 0
        each.append(F.struct(F.lit(r.name).alias("rule"), F.when(has, F.col("_n")).otherwise(0).alias("fails"), F.when(alone, F.col("_n")).otherwise(0).alias("only"), F.when(has, F.col("failed").bitwiseAND(F.lit(~bit & ((1 << 62) - 1)))).otherwise(0).alias("beside")))
    return masks.select(F.explode(F.array(*each)).alias("e")).groupBy("e.rule").agg(F.sum("e.fails").alias("fails"), F.sum("e.only").alias("only"), F.bit_or("e.beside").alias("beside"))


def judged(docs: DataFrame, policy: Policy = POLICIES["2"], **options) -> DataFrame:
    """The ledger with base_failed and kept under the policy (never kept where the base version rejects)."""
    book = ledger(docs, **options)
    return book.withColumn("base_failed", ~passes(POLICIES["base"])).withColumn("kept", passes(POLICIES["base"]) & passes(policy))
