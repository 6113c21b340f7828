"""Quality rules with thresholds that adapt to each language and source.

Every document is measured (words, symbols, repeated lines and words). The measures of each
(language, source) go into a quantile sketch: counts of logarithmic buckets, whose relative error is
fixed by ``GROWTH`` and which merge by addition, so Spark builds them with a partial aggregate and
any two may be merged. A group's percentiles are averaged with those of its language, weighted by its
documents against ``PRIOR``, and the language's with those of all documents: a small group leans on the
merged sketches, a large one on its own, with no step between.

A fence stands ``WIDEN`` times the spread beyond the 80th (or 20th) percentile of a measure; the spread is the
distance from either to the median, the widest of the group's, its language's and the whole's, so that copies
which fill a group do not close it, and no less than the sketch's buckets are wide. Where hardly any document holds what is measured that distance is nothing; then the
least that a document of the group's median length can hold takes its place. A document outside a fence is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm import kernels
from tamarack.llm.shared import column, ddl, fresh_prefix, neutral, quoted, stored, text_in_place, unclashed

#: Ratio of neighbouring bucket bounds: values are known to 1 per cent.
GROWTH = 1.02
#: Documents that the merged sketch counts as in a group's percentiles, and how many spreads a fence stands off.
PRIOR, WIDEN = 100, 3
#: name: (expression over the counts, 1000 times the least that tells: a symbol, a line of twelve words said twice, two such lines; is there a lower fence)
MEASURES = {
    "symbols": ("1000 * n_symbols div greatest(n_words, 1)", 1000, False),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", 24000, False),
    "lines": ("1000 * n_dup_lines div greatest(n_words, 1)", 2000, False),
    "length": ("100 * word_chars div greatest(n_words, 1)", 0, True),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

IS_SYMBOL = np.zeros(256, np.int64)
IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
STARTS_CHAR = ((np.arange(256) & 0xC0) != 0x80).astype(np.int64)


def _sums(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[b] - total[a]


def word_equality(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """A function of two arrays of words: are they the same bytes."""
    sizes = ends - starts
    return lambda i, j: (sizes[i] == sizes[j]) & kernels.equal_spans(raw, starts[i], starts[j], np.minimum(sizes[i], sizes[j]))


def count_slice(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, 5) counts named by COUNTS."""
    n = len(offsets) - 1
    out = np.zeros((n, len(COUNTS)), np.int64)
    if not len(raw):
        return out
    starts, ends, rows = kernels.words(raw, offsets)
    out[:, 0] = np.bincount(rows, minlength=n)
    out[:, 1] = np.bincount(rows, _sums(STARTS_CHAR[raw], starts, ends), n).astype(np.int64)
    out[:, 2] = _sums(IS_SYMBOL[raw], offsets[:-1], offsets[1:])
    # lines that hold a word; an empty stretch between two breaks is no line with a word
    a, b, line_rows = kernels.spans(raw, offsets, raw != 0x0A)
    full = np.searchsorted(starts, a) < np.searchsorted(starts, b)
    a, b, line_rows = a[full], b[full], line_rows[full]
    sizes = b - a
    same = lambda i, j: (sizes[i] == sizes[j]) & kernels.equal_spans(raw, a[i], a[j], np.minimum(sizes[i], sizes[j]))
    _, later = kernels.seen(line_rows, kernels.span_hashes(raw, a, b), same, lambda i: raw[a[i] : b[i]].tobytes())
    out[:, 3] = np.bincount(line_rows[later], minlength=n)
    hashes = kernels.span_hashes(raw, starts, ends)
    if len(hashes) >= 3:
        run = kernels.mix(hashes[:-2] * kernels.MIX[3] + kernels.mix(hashes[1:-1] + kernels.MIX[4]) * kernels.MIX[5] + kernels.mix(hashes[2:] ^ kernels.MIX[6]))
        at = np.flatnonzero(rows[:-2] == rows[2:])
        alike = word_equality(raw, starts, ends)
        same = lambda i, j: alike(at[i], at[j]) & alike(at[i] + 1, at[j] + 1) & alike(at[i] + 2, at[j] + 2)
        twice, _ = kernels.seen(rows[at], run[at], same, lambda i: tuple(raw[starts[w] : ends[w]].tobytes() for w in range(at[i], at[i] + 3)))
        marked = np.zeros(len(hashes), bool)
        for k in range(3):
            marked[at[twice] + k] = True
        out[:, 4] = np.bincount(rows[marked], minlength=n)
    return out


def _measure(text: str, prefix: str, drop: bool):
    def run(batches):
        for batch in batches:
            raw, offsets = kernels.buffers(batch.column(text))
            parts = [count_slice(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in kernels.slices(offsets)]
            found = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
            keep = [i for i, name in enumerate(batch.schema.names) if not (drop and name == text)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), *(pa.array(np.ascontiguousarray(x)) for x in found.T)],
                [*(batch.schema.names[i] for i in keep), *(prefix + c for c in COUNTS)],
            )

    return run


def measured(docs: DataFrame, text_col: str = "text", prefix: str = "", keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns of COUNTS (long), whose names take ``prefix``; without ``keep_text`` the text goes. A null text has none of anything."""
    given, name, added = text_in_place(docs, text_col, "measured")
    rest = docs if keep_text else docs.drop(text_col)
    return given.mapInArrow(_measure(name, prefix, added or not keep_text), ddl(rest) + ", ".join(f"`{prefix}{c}` long" for c in COUNTS))


def base_failed(prefix: str = ""):
    words, repeats = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < 50) | (100 * repeats > 50 * words)


def _values(prefix: str = ""):
    counted = {c: quoted(prefix + c) for c in COUNTS}
    out = []
    for name, (text, *_) in MEASURES.items():
        for c, real in counted.items():
            text = text.replace(c, real)
        out.append(F.struct(F.lit(name).alias("measure"), F.expr(text).alias("value")))
    return F.array(*out, F.struct(F.lit("words").alias("measure"), F.expr(counted["n_words"]).alias("value")))


def sketches(counts: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    """(lang, source, measure, bucket, n): one mergeable sketch for each group and measure, and of its texts' words. Texts without words are left out."""
    each = counts.where(F.col(prefix + "n_words") > 0).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(_values(prefix)).alias("m"))
    value = F.col("m.value")
    bucket = F.when(value <= 0, 0).otherwise(1 + F.ceil(F.log(value.cast("double")) / F.log(F.lit(GROWTH))))
    return each.select("lang", "source", "m.measure", bucket.cast("int").alias("bucket")).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def points(sketch: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """(by, <prefix>measure, <prefix>n, <prefix>p20, p50, p80) of sketches merged over all but ``by``."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(2 * F.pow(F.lit(GROWTH), F.col("bucket") - 1) / (GROWTH + 1))
    point = lambda k: F.min(F.when(100 * F.col("upto") >= k * F.col("total"), F.floor(value + 0.5))).alias(f"{prefix}p{k}")
    found = ranked.groupBy(*by, "measure").agg(F.max("total").alias(f"{prefix}n"), *(point(k) for k in (20, 50, 80)))
    return found.withColumnsRenamed({c: prefix + c for c in (*by, "measure")})


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, <measure>_high, <measure>_low) for each group.

    Only sketches are read here: their size follows the number of groups, not of documents. Whole numbers throughout, so
    any engine finds the same.
    """
    own, language, whole = points(sketch, ["lang", "source"], ""), points(sketch, ["lang"], "l_"), points(sketch, [], "w_")
    both = own.join(language, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure")))
    every = both.join(whole, F.col("measure") == F.col("w_measure"))
    ask = (20, 50, 80)
    lean = lambda n, p, q: F.expr(f"({n} * {p} + {PRIOR} * {q}) div ({n} + {PRIOR})")
    every = every.withColumns({f"l_p{k}": lean("l_n", f"l_p{k}", f"w_p{k}") for k in ask})
    every = every.withColumns({f"p{k}": lean("n", f"p{k}", f"l_p{k}") for k in ask})
    # the widest distance on either side, and no less than a sketch can tell apart
    sides = [f"{x}p{a} - {x}p{b}" for x in ("", "l_", "w_") for a, b in ((80, 50), (50, 20))]
    every = every.withColumn("spread", F.expr(f"greatest({', '.join(sides)}, p80 div 50)"))
    of = lambda name, c: F.max(F.when(F.col("measure") == name, F.col(c))).alias(f"{name}_{c}")
    wide = every.groupBy("lang", "source").agg(of("words", "p50"), *(of(m, c) for m in MEASURES for c in ("p20", "p80", "spread")))
    out = []
    for name, (_, least, lower) in MEASURES.items():
        out.append(F.expr(f"{name}_p80 + {WIDEN} * greatest({name}_spread, {least} div greatest(words_p50, 1))").alias(f"{name}_high"))
        if lower:
            out.append(F.expr(f"{name}_p20 - {WIDEN} * {name}_spread").alias(f"{name}_low"))
    return wide.select("lang", "source", *out)


def judged(counts: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    """``counts`` with <prefix>base_failed and <prefix>kept. Spark broadcasts the fences only where their size allows it."""
    p = fresh_prefix(counts, "fence")
    limits = limits.select([F.col(c).alias(p + c) for c in limits.columns])
    joined = counts.join(limits, F.col(lang).eqNullSafe(F.col(p + "lang")) & F.col(source).eqNullSafe(F.col(p + "source")), "left")
    verdict = F.lit(True)
    for k, (name, (_, _, lower)) in enumerate(MEASURES.items()):
        value = F.element_at(_values(prefix), k + 1)["value"]
        verdict = verdict & F.coalesce(value <= F.col(f"{p}{name}_high"), F.lit(True))
        if lower:
            verdict = verdict & F.coalesce(value >= F.col(f"{p}{name}_low"), F.lit(True))
    failed = base_failed(prefix)
    return joined.withColumn(prefix + "base_failed", failed).withColumn(prefix + "kept", ~failed & verdict).drop(*limits.columns)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, counts, base_failed, kept) for each row; null texts have no words and fail.

    Null languages and sources form groups of their own; a table without the columns is one group.
    Texts of any length are counted whole. Repeated rows are judged alike, and a value on a fence is inside. An empty
    table gives an empty result.
    """
    docs = unclashed(docs, id_col, text_col, lang_col, source_col)
    plain = docs.select(column(docs, id_col, "long").alias("doc_id"), column(docs, text_col, "string").alias("text"), column(docs, lang_col, "string").alias("lang"), column(docs, source_col, "string").alias("source"))
    counts = stored(measured(plain, keep_text=False), "rules")
    return judged(counts, fences(sketches(counts))).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that quality_rules would keep, with their columns as they came, whatever their names.

    Null texts have no words and go; null languages and sources are groups of their own, as is a table without the
    columns; repeated rows go or stay together; a value on a fence is inside; an empty table stays empty. The texts are
    read twice, once for the sketches and once for the verdict, so that no shuffle and no stored copy carries them.
    """
    names, docs = docs.columns, neutral(docs, text_col, lang_col, source_col)
    p = fresh_prefix(docs, "rule")
    keyed = docs.withColumns({f"{p}lang": column(docs, lang_col, "string"), f"{p}source": column(docs, source_col, "string")})
    narrow = measured(keyed.select(f"{p}lang", f"{p}source", column(docs, text_col, "string").alias("text")), keep_text=False)
    limits = stored(fences(stored(sketches(narrow, f"{p}lang", f"{p}source"), "sketch")), "fences")
    kept = judged(measured(keyed, text_col, p), limits, f"{p}lang", f"{p}source", p).where(F.col(p + "kept"))
    return kept.select(*[F.col(quoted(c)) for c in docs.columns]).toDF(*names)
