"""Token counts, truncation and few-shot identity on texts of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.sources import catalog

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
PAD = "[PAD]"


def tokens(text: Column | str) -> Column:
    """Words and single other marks, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def n_tokens(text: Column | str) -> Column:
    return F.size(tokens(text))


def truncated(tokens_column: Column, max_length: int, side: str = "right") -> Column:
    """At most ``max_length`` tokens; ``side`` names the end that is cut off."""
    if side not in catalog.TRUNCATION_SIDES:
        raise ValueError(f"Unknown truncation side: {side}")
    size = F.size(tokens_column)
    start = F.lit(1) if side == "right" else F.greatest(size - max_length, F.lit(0)) + 1
    return F.slice(tokens_column, start, F.lit(max_length))


def padded(tokens_column: Column, max_length: int) -> Column:
    return F.concat(tokens_column, F.array_repeat(F.lit(PAD), F.greatest(F.lit(max_length) - F.size(tokens_column), F.lit(0))))


def attention_mask(tokens_column: Column, max_length: int) -> Column:
    used = F.least(F.size(tokens_column), F.lit(max_length))
    return F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(max_length) - used))


def tokenize(df: DataFrame, max_length: int, side: str = "right", column: str = "text") -> DataFrame:
    """Add n_tokens, the cut and padded tokens, and the mask of real tokens."""
    cut = df.withColumn("_t", tokens(column)).withColumn("n_tokens", F.size("_t"))
    cut = cut.withColumn("_t", truncated(F.col("_t"), max_length, side))
    return cut.withColumn("attention_mask", attention_mask(F.col("_t"), max_length)).withColumn(
        "tokens", padded(F.col("_t"), max_length)
    ).drop("_t")


def expand_options(df: DataFrame, n_options: int | Column, key: str) -> DataFrame:
    """One (text, option) row per option; every row must have ``n_options`` of them.

    A column gives the number where tasks of several widths share a frame.
    """
    options = F.when(F.size("options") == n_options, F.col("options")).otherwise(
        F.raise_error(F.lit("a row has another number of options than its task"))
    )
    return df.select(key, "text", "label", F.posexplode(options).alias("option_idx", "option"))


def regroup_options(pairs: DataFrame, key: str) -> DataFrame:
    """Undo ``expand_options``: options back in order (each group has n_options rows)."""
    ordered = F.array_sort(F.collect_list(F.struct("option_idx", "option")))
    return pairs.groupBy(key).agg(
        F.first("text").alias("text"), F.first("label").alias("label"), ordered["option"].alias("options")
    )


def last_shared_index(text: Column, reference: Column) -> Column:
    """Zero-based index of the last character of the common prefix (0 if there is none).

    A binary search on prefixes: log(length) comparisons, no per-character array.
    """
    shorter = F.least(F.length(text), F.length(reference))
    digits = F.length(F.bin(shorter))
    powers = F.slice(F.array(*[F.lit(1 << bit) for bit in range(30, -1, -1)]), 32 - digits, digits)
    same = lambda n: F.substr(text, F.lit(1), n) == F.substr(reference, F.lit(1), n)

    def step(known: Column, power: Column) -> Column:
        fits = power <= shorter - known
        return F.when(fits, F.when(same(known + power), known + power).otherwise(known)).otherwise(known)

    return F.greatest(F.aggregate(powers, F.lit(0), step) - 1, F.lit(0))


def same_instance(text: Column, reference: Column) -> Column:
    """Does a few-shot text end on the zero-shot text, a shared preamble aside?

    The last shared character stays in the part that must match.
    """
    rest = F.substr(reference, last_shared_index(text, reference) + 1)
    return F.endswith(text, rest)


def share_longer_than(df: DataFrame, max_tokens: int, group: list[str], column: str = "text") -> DataFrame:
    """Rows, rows over the limit, and their share, per group."""
    return (
        df.select(*group, n_tokens(column).alias("_n"))
        .groupBy(*group)
        .agg(
            F.count("*").alias("n_total"),
            F.count_if(F.col("_n") > max_tokens).alias("n_long"),
            F.avg((F.col("_n") > max_tokens).cast("double")).alias("n_long_sequences"),
        )
    )


def token_cost(df: DataFrame, group: list[str], max_tokens: int | None = None, column: str = "text") -> DataFrame:
    """Price of running every row: input tokens plus the fixed output length, at each rate.

    ``max_tokens`` limits what counts per row as a tokenizer's truncation does.
    One row per (group, engine) plus the engine ``all``.
    """
    size = n_tokens(column)
    if max_tokens is not None:
        size = F.least(size, F.lit(max_tokens))
    total = df.select(*group, size.alias("_n")).groupBy(*group).agg(
        (F.coalesce(F.sum("_n"), F.lit(0)) + F.count("*") * catalog.OUTPUT_TOKENS_PER_ROW).alias("n_tokens_total")
    )
    rates = catalog.PRICES_PER_1000_TOKENS | {"all": sum(catalog.PRICES_PER_1000_TOKENS.values())}
    table = F.array(*[F.struct(F.lit(k).alias("engine"), F.lit(v).alias("rate")) for k, v in rates.items()])
    return total.select(*group, "n_tokens_total", F.explode(table).alias("r")).select(
        *group, "n_tokens_total", "r.engine", (F.col("r.rate") * F.col("n_tokens_total") / 1000).alias("price")
    )


def token_histogram(df: DataFrame, bins: int = 100, column: str = "text") -> DataFrame:
    """Counts over equal-width bins from the smallest to the largest token count."""
    counts = df.select(n_tokens(column).alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("_c"))
    span = counts.agg(F.min("n_tokens"), F.max("n_tokens")).first()
    low, high = (span[0] or 0), (span[1] or 0)
    width = (high - low) / bins if high > low else 1.0
    index = F.least(F.floor((F.col("n_tokens") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    return counts.groupBy(index.cast("int").alias("bin")).agg(F.sum("_c").alias("n"))
