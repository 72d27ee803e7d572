"""Imputation of missing registrations and amounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tagtrail.functions.text import LOOSE_TAG_LENGTH, REGISTRATION_ANY, REGISTRATION_LOOSE, clean_tag, prefix
from tagtrail.operators.dominant import modal_amount, with_modal_key
from tagtrail.operators.keyed import Names, names, skew_join, valued_pairs


def valid_registrations(
    df: DataFrame, value: str, pattern: str = REGISTRATION_ANY, codes: DataFrame | None = None, code: str = "code"
) -> DataFrame:
    """Rows whose value matches ``pattern`` and, if given, starts with a known two-letter code."""
    valid = df.where(F.col(value).rlike(pattern))
    if codes is None:
        return valid
    known = codes.select(F.col(code).cast("string").alias("_code")).distinct()
    return skew_join(valid.withColumn("_code", prefix(value, 2)), known, "_code", "left_semi").drop("_code")


def split_by_validity(
    df: DataFrame, key: str, value: str, pattern: str = REGISTRATION_ANY, codes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Keys with one valid value as (key, value), and keys with several as a row (key, value, n_values) per value."""
    pairs = valued_pairs(valid_registrations(df, value, pattern, codes), key, value)
    return pairs.where(F.col("n_values") == 1).select(key, value), pairs.where(F.col("n_values") > 1)


def impute_registration(
    need: DataFrame,
    txn: DataFrame,
    codes: DataFrame,
    key: str = "tag",
    value: str = "registration",
    state: str = "state",
    code: str = "code",
    pattern: str = REGISTRATION_LOOSE,
    keep: Column | None = None,
    min_share: float = 0.25,
    default: str = "default",
) -> DataFrame:
    """Registrations for the keys that need one: (key, method, value), from one grouping of ``txn``.

    ``unique`` and ``multi`` come from well-formed values in ``txn``; a key with several
    has a row for each. The other keys get ``imputed``: the code of their dominant state, or ``default``,
    with 00 after it. Keys without a dominant state are ``remaining``, with a null value.
    """
    keep = clean_tag(key, band=LOOSE_TAG_LENGTH) if keep is None else keep
    wanted = need.where(keep).select(key).distinct()
    code_of = codes.where(F.col(code).isNotNull()).groupBy(state).agg(F.min(code).alias("_code"))
    good = F.col(value).rlike(pattern)
    # one row per key and state, or per key and well-formed value: a veto, a count or a value
    facts = (
        txn.where(F.col(key).isNotNull() & (F.coalesce(good, F.lit(False)) | F.col(state).isNotNull()))
        .groupBy(key, F.when(good, F.col(value)).alias("_value"), F.when(~F.coalesce(good, F.lit(False)), F.col(state)).alias("_state"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    best = F.min(F.when(F.col("_state").isNotNull(), F.struct((-F.col("_n")).alias("neg"), F.col("_state").alias("state"))))
    decided = facts.groupBy(key).agg(
        F.min("_value").alias("_low"),
        F.max("_value").alias("_high"),
        best.alias("_best"),
        F.sum(F.when(F.col("_state").isNotNull(), F.col("_n"))).alias("_total"),
    )
    every = wanted.join(decided, key, "left")  # a row per key on both sides, dealt out by it already
    dominant = F.col("_low").isNull() & (-F.col("_best.neg") / F.col("_total") >= min_share)
    method = (
        F.when(F.col("_low") == F.col("_high"), "unique")
        .when(F.col("_low").isNotNull(), "multi")
        .when(dominant, "imputed")
        .otherwise("remaining")
    )
    one = every.select(
        key, method.alias("method"), F.col("_low").alias("_value"), F.when(dominant, F.col("_best.state")).alias(state)
    )
    # only keys with several values read their pairs again; the other keys meet no row
    several = facts.where(F.col("_value").isNotNull()).select(F.col(key).alias("_key"), F.col("_value").alias("_each"))
    spread = one.join(several, (F.col("method") == "multi") & (F.col(key) == F.col("_key")), "left")
    coded = skew_join(spread, code_of, state, "left")
    made = F.when(F.col("method") == "imputed", F.concat(F.coalesce("_code", F.lit(default)), F.lit("00")))
    return coded.select(key, "method", F.coalesce(F.col("_each"), F.col("_value"), made).alias("value"))


def unmatched(need: DataFrame, valid: DataFrame, txn: DataFrame, key: str = "tag") -> DataFrame:
    """Rows of ``need`` whose key has no valid value and no transaction."""
    known = valid.select(key).unionByName(txn.select(key)).distinct()
    return skew_join(need, known, key, "left_anti")


def impute_modal(
    need: DataFrame,
    freq_tables: list[DataFrame],
    key: Names = ("vehicle_class", "plaza"),
    amount: str = "amount",
    frequency: str = "frequency",
) -> DataFrame:
    """Rows of ``need`` with the modal amount of the first table that has one.

    ``source`` is the number of that table from 1, or null for the rows that
    remain, rows without a class included. The tables first merge into one row
    per key, the best of the earliest table, so that ``need`` is joined once.
    """
    key = names(key)
    numbered = [
        modal_amount(table, key, amount, frequency).select(*key, F.lit(i).alias("source"), amount)
        for i, table in enumerate(freq_tables, start=1)
    ]
    return _first_source(need, reduce(DataFrame.unionByName, numbered), key, amount)


def impute_modal_windows(
    need: DataFrame, counted: DataFrame, key: Names = ("vehicle_class", "plaza"), amount: str = "amount", frequencies: Names = ()
) -> DataFrame:
    """:func:`impute_modal` where all windows were counted together: one column of ``frequencies`` each, the first window first.

    ``counted`` has a row per key and amount; a window without that amount has 0 there. Both modal amounts come from
    one grouping of it, and nothing is read once per window.
    """
    key = names(key)
    seen = [F.when(F.col(f) > 0, F.struct((-F.col(f)).alias("neg"), F.col(amount))) for f in names(frequencies)]
    best = with_modal_key(counted, key, amount).groupBy(*key).agg(*[F.min(x).alias(f"_{i}") for i, x in enumerate(seen, 1)])
    first = F.coalesce(*[F.when(F.col(f"_{i}").isNotNull(), F.struct(F.lit(i).alias("source"), F.col(f"_{i}.{amount}"))) for i in range(1, len(seen) + 1)])
    best = best.select(*key, first.alias("_best")).where("_best IS NOT NULL").select(*key, f"_best.{amount}", "_best.source")
    return skew_join(need, best, key, "left")


def _first_source(need: DataFrame, modal: DataFrame, key: list[str], amount: str) -> DataFrame:
    best = modal.groupBy(*key).agg(F.min(F.struct("source", amount)).alias("_best"))
    best = best.select(*key, F.col("_best")[amount].alias(amount), F.col("_best")["source"].alias("source"))
    return skew_join(need, best, key, "left")
