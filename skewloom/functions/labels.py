"""Labels: cleaning onto closed vocabularies, length bins, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import Vocabulary

#: White space of any kind, for Java and RE2 alike.
SPACE = r"[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def has_text(c: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(c.rlike(f"[^{SPACE[1:-1]}]"), F.lit(False))


def clean_value(c: Column, options: Sequence[str], fallback: str) -> Column:
    """The option that equals the stripped value, else the first of which one is a prefix of the other, else the fallback.

    Null gives the fallback; a blank value is a prefix of every option and gives the first.
    """
    v = strip(c)
    listed = F.array(*(F.lit(o) for o in options))
    close = F.filter(listed, lambda o: o.startswith(v) | v.startswith(o))
    return F.when(F.array_contains(listed, v), v).otherwise(F.coalesce(F.get(close, F.lit(0)), F.lit(fallback)))


def words(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    """Number of white-space tokens."""
    return F.size(words(text))


def length_bin(n: Column, width: int = 50) -> Column:
    """To the nearest multiple of ``width``, halves to the even one, as a string."""
    return (F.bround(n / F.lit(float(width))) * width).cast("int").cast("string")


def clean_labels(df: DataFrame, vocabulary: Vocabulary, attributes: Sequence[str], text: str = "text") -> DataFrame:
    """Replaces the attributes by their clean labels; ``word_count`` is measured from the text, unknown attributes become strings."""
    out = {}
    for a in attributes:
        if a == "word_count":
            out[a] = length_bin(word_count(F.coalesce(F.col(text), F.lit(""))))
        elif a in vocabulary.options:
            out[a] = clean_value(F.col(a).cast("string"), vocabulary.options[a], vocabulary.fallback[a])
        else:
            out[a] = F.coalesce(F.col(a).cast("string"), F.lit("nan"))
    return df.withColumns(out)


def labels_from_map(df: DataFrame, vocabulary: Vocabulary, attributes: Sequence[str], prefix: str = "map_") -> DataFrame:
    """Annotated labels: all null where no attribute was annotated, else a missing one takes its fallback."""
    none = F.coalesce(*(F.col(prefix + a) for a in attributes)).isNull()
    return df.withColumns(
        {prefix + a: F.when(~none, clean_value(F.col(prefix + a), vocabulary.options[a], vocabulary.fallback[a])) for a in attributes}
    )


def inherited_labels(df: DataFrame, vocabulary: Vocabulary, attributes: Sequence[str]) -> DataFrame:
    """Clean labels that a table carries; an attribute that it lacks is null."""
    have = [a for a in attributes if a in df.columns]
    missing = {a: F.lit(None).cast("string") for a in attributes if a not in df.columns}
    return clean_labels(df, vocabulary, have).withColumns(missing)


def group_key(columns: Sequence[str]) -> Column:
    """Display form of a null-safe key: values joined by a bar, null as 'nan'. Group by the columns themselves where possible."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns))


def to_long(df: DataFrame, id_cols: Sequence[str], attributes: Sequence[str], attr: str = "attr", value: str = "value") -> DataFrame:
    """One row per record and attribute."""
    pairs = F.array(*(F.struct(F.lit(a).alias(attr), F.col(a).cast("string").alias(value)) for a in attributes))
    return df.select(*id_cols, F.inline(pairs))


def paired_long(df: DataFrame, id_cols: Sequence[str], attributes: Sequence[str], one: str = "", other: str = "map_") -> DataFrame:
    """(ids, attr, a, b): two labels of every attribute that one row carries under two prefixes, without a join."""
    pairs = F.array(*(F.struct(F.lit(x).alias("attr"), F.col(one + x).cast("string").alias("a"), F.col(other + x).cast("string").alias("b")) for x in attributes))
    return df.select(*id_cols, F.inline(pairs))


def encode_labels(df: DataFrame, vocabulary: Vocabulary, attributes: Sequence[str], prefix: str = "") -> DataFrame:
    """Replaces labels by their place in the vocabulary, from 0; null for a missing label and for one that the vocabulary lacks."""
    at = lambda a: F.array_position(F.array(*(F.lit(o) for o in vocabulary.options[a])), F.col(prefix + a))
    return df.withColumns({prefix + a: F.when(at(a) > 0, at(a).cast("int") - 1) for a in attributes})


def cyclic(values: Column, n: Column | int) -> Column:
    """The array repeated from its start until it has n entries."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(values, F.pmod(i, F.size(values))))).otherwise(F.slice(values, 1, 0))
