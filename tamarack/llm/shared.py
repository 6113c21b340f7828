"""Columns, names and joins that the corpus operators have in common, and their tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.sources.scratch import scratch, shared_dir, stored  # noqa: F401  the operators take them from here


def has_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


#: Keys that hold more than one in so many rows go by broadcast; there are fewer of them than this.
SHARE = 1000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], fan: str) -> DataFrame:
    """``left`` with the columns of ``right``, a stored table of one row for each key, nulls where it has none.

    ``fan`` counts the rows of ``left`` that a key has. Those with over a thousandth of all rows, of which there cannot
    be a thousand, are broadcast, so that their rows stay where they are; only the others are shuffled by key. Rows
    with a null key find nothing.
    """
    most = -(-left.count() // SHARE)
    hot, cold = right.where(F.col(fan) > most), right.where(F.col(fan) <= most)
    found = left.join(F.broadcast(hot), keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return found.unionByName(rest)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, name: str, kind: str):
    """The column, or a null where the table lacks it."""
    return (F.col(quoted(name)) if name in df.columns else F.lit(None)).cast(kind)


def unclashed(df: DataFrame, *wanted: str) -> DataFrame:
    """``df`` under names without back-ticks that differ however they are cased: of those that clash the wanted one, else the first, keeps its own."""
    names, taken = [c.replace("`", "_") for c in df.columns], set()
    for i in sorted(range(len(names)), key=lambda i: (names[i] not in wanted, i)):
        while names[i].lower() in taken:
            names[i] = "_" + names[i]
        taken.add(names[i].lower())
    return df if names == df.columns else df.toDF(*names)


def neutral(df: DataFrame, *wanted: str) -> DataFrame:
    """``df`` with every column but the ``wanted`` ones under a name of its own that no expression can misread.

    The order stays, so ``toDF`` with the old names undoes it.
    """
    names, seen = [], set()
    for k, c in enumerate(df.columns):
        names.append(c if c in wanted and c not in seen else f"__other_{k}")
        seen.add(c)
    return df.toDF(*names)


def fresh_prefix(df: DataFrame, base: str) -> str:
    """A prefix that no column of ``df`` begins with, so that added columns never clash."""
    prefix = f"__{base}_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def ddl(df: DataFrame) -> str:
    """The columns of ``df`` as a schema string, for operators that hand them through."""
    return "".join(f"{quoted(f.name)} {f.dataType.simpleString()}, " for f in df.schema.fields)


def text_in_place(df: DataFrame, name: str, base: str) -> tuple[DataFrame, str, bool]:
    """(frame, column to read, whether it was added): the text column itself where it is a string, so that it travels once."""
    if name in df.columns and df.schema[name].dataType.simpleString() == "string":
        return df, name, False
    inner = fresh_prefix(df, base) + "text"
    return df.withColumn(inner, column(df, name, "string")), inner, True
