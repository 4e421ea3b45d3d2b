"""Quality rules by distribution divergence, with DataFrame functions only.

Each document's character-class histogram and common-word histogram are
compared with references of its language by Jensen-Shannon distance (base 2,
so between 0 and 1). The references are counted over the whole corpus: per
language the code points in each class, and the ``n_common`` most frequent
short words. Every language has one, however rare, and so have the documents
without a language. They are written to the scratch folder, so that Spark knows
their size and chooses the join: a broadcast, or for very many languages a
sort-merge join whose large partitions it splits.

The work per document is one row's: no join but that with the references, no
shuffle but that of the corpus counts (and of the documents where the
references are too large to broadcast).

Edge cases: a null text has no words and fails the base rules; null is a
language of its own; the only document of a language is its own reference and
so at distance 0; texts under the minimum lengths for a histogram to be steady
are judged by the base rules alone.
Repeated rows are judged alike. Other columns, whatever their names, pass
through; the columns made here replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rmalytics.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
#: Classes taken off the text one after the other; what is left is the last class.
CLASSES = (
    ("lower", "[a-z]+"),
    ("space", r"[\x20\x09-\x0D]+"),
    ("upper", "[A-Z]+"),
    ("symbol", r"[#*$%&|<>]+"),
    ("digit", "[0-9]+"),
    ("point", r"[\x21-\x7E]+"),
    ("letter", r"[\p{L}\p{M}]+"),
)
POSITION_BITS = 23


@dataclass(frozen=True)
class Params:
    min_words: int = 50
    max_repeat_pct: int = 50
    max_char_distance: float = 0.35
    max_word_distance: float = 0.45
    min_chars: int = 200
    min_words_histogram: int = 100
    n_common: int = 24
    max_common_chars: int = 5


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _class_columns(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds array ``to``: code points in each class, the rest last."""
    left, counts = F.coalesce(F.col(text), F.lit("")), []
    df = df.withColumn("_r0", left)
    for k, (_, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"_r{k + 1}", F.regexp_replace(f"_r{k}", pattern, ""))
        counts.append(F.length(f"_r{k}") - F.length(f"_r{k + 1}"))
    counts.append(F.length(f"_r{len(CLASSES)}"))
    return df.withColumn(to, F.array(*[c.cast("long") for c in counts])).drop(*[f"_r{k}" for k in range(len(CLASSES) + 1)])


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more.

    Hash and position share one long, so that equal windows are neighbours
    after a sort of primitive longs. Neighbours that agree on the hash bits
    kept there but not on the whole hash (about one long text in thousands)
    send the text to the sort of (whole hash, position) pairs.
    """
    n = F.size(words)
    mask = (1 << POSITION_BITS) - 1
    none = F.lit(0).cast("long")
    pos = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    same = lambda a, b: F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)
    or_not = lambda c: F.coalesce(c, F.lit(False))

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def packed(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))

    def near(p: Column) -> Column:
        return F.filter(p, lambda x, i: or_not(same(x, F.get(p, i + 1))) | or_not(same(x, F.get(p, i - 1))))

    def clash(h: Column, m: Column) -> Column:
        return F.exists(
            F.sequence(F.lit(1), F.size(m) - 1),
            lambda i: same(F.get(m, i), F.get(m, i - 1)) & (F.get(h, pos(F.get(m, i))) != F.get(h, pos(F.get(m, i - 1)))),
        )

    def exact(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        kept = lambda p: F.filter(p, lambda x, i: or_not(x["h"] == F.get(p, i + 1)["h"]) | or_not(x["h"] == F.get(p, i - 1)["h"]))
        return F.transform(_bind(pairs, kept), lambda x: x["i"])

    def marked(h: Column, m: Column) -> Column:
        return F.sort_array(F.when((n > mask) | clash(h, m), exact(h)).otherwise(F.transform(m, pos)))

    def covered(m: Column) -> Column:
        step = F.transform(m, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(m, i + 1), x + 3) - x).cast("long"))
        return F.aggregate(step, none, lambda a, x: a + x)

    def total(h: Column) -> Column:
        return _bind(_bind(packed(h), near), lambda m: F.when(F.size(m) == 0, none).otherwise(_bind(marked(h, m), covered)))

    return F.when(n < 4, none).otherwise(_bind(hashes, total))


def base_columns(df: DataFrame, text: str = "text", params: Params = Params()) -> DataFrame:
    """Adds the base counts, ``base_failed``, and the arrays ``_classes`` and ``_words``."""
    df = _class_columns(df.withColumn("_words", _words(F.coalesce(F.col(text), F.lit("")))), text, "_classes")
    space, symbol = (next(k for k, (name, _) in enumerate(CLASSES) if name == x) for x in ("space", "symbol"))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.coalesce(F.col(text), F.lit(""))).cast("long") - F.get("_classes", F.lit(space)),
            "n_symbols": F.get("_classes", F.lit(symbol)),
            "n_dup_lines": _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("_words")),
        }
    )
    failed = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_pct * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def language_references(df: DataFrame, text: str = "text", lang: str = "lang", params: Params = Params()) -> DataFrame:
    """Per language: class counts, its common words and their counts, all words.

    Counted over every document; one row per language, null being one.
    """
    slim = df.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    classes = _class_columns(slim, "_text", "_classes")
    sums = [F.sum(F.get("_classes", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES) + 1)]
    per_lang = classes.groupBy("_lang").agg(*sums)
    # words that may be common are short; longer ones only count among all words
    word = F.explode(_words(F.coalesce(F.col("_text"), F.lit("")))).alias("_w")
    short = F.when(F.length("_w") <= params.max_common_chars, F.col("_w")).otherwise(F.lit(""))
    counts = slim.select("_lang", word).select("_lang", short.alias("_w")).groupBy("_lang", "_w").agg(F.count("*").alias("_n"))
    totals = counts.groupBy(F.col("_lang").alias("_lang_all")).agg(F.sum("_n").alias("_all_words"))
    by_rank = W.partitionBy("_lang").orderBy(F.desc("_n"), "_w")
    top = counts.where(F.col("_w") != "").withColumn("_rank", F.row_number().over(by_rank)).where(F.col("_rank") <= params.n_common)
    top = top.groupBy(F.col("_lang").alias("_lang_top")).agg(F.sort_array(F.collect_list(F.struct("_rank", "_w", "_n"))).alias("_top"))
    beside = lambda other: F.col("_lang").eqNullSafe(F.col(other))
    return per_lang.join(totals, beside("_lang_all"), "left").join(top, beside("_lang_top"), "left").select(
        F.col("_lang").alias("ref_lang"),
        F.array(*[f"c{k}" for k in range(len(CLASSES) + 1)]).alias("ref_classes"),
        F.coalesce(F.transform("_top", lambda x: x["_w"]), F.array().cast("array<string>")).alias("ref_words"),
        F.coalesce(F.transform("_top", lambda x: x["_n"]), F.array().cast("array<bigint>")).alias("ref_counts"),
        F.coalesce("_all_words", F.lit(0)).alias("ref_all_words"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; null if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    share = lambda a: _bind(total(a), lambda t: F.when(t > 0, F.transform(a, lambda x: x / t)))
    each = F.zip_with(share(p), share(q), lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(each, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", params: Params = Params(), references: DataFrame | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_distance, word_distance (null where not judged) and kept."""
    refs = references
    if refs is None:
        folder = scratch_path(df.sparkSession, "quality")
        language_references(df, text, lang, params).write.parquet(folder)
        refs = df.sparkSession.read.parquet(folder)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    df = df.drop(*[c for c in made if c not in (text, lang)])
    out = base_columns(df, text, params)
    out = out.join(refs, F.col(lang).eqNullSafe(F.col("ref_lang")), "left")
    spaced = F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" "))
    out = out.withColumn("_spaced", F.when(F.col("n_words") >= params.min_words_histogram, spaced))
    seen = lambda w: ((F.octet_length("_spaced") - F.octet_length(F.replace(F.col("_spaced"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2)).cast("long")
    out = out.withColumn("_common", F.transform("ref_words", seen))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    out = out.withColumn("_hist", F.concat("_common", F.array(F.col("n_words") - add(F.col("_common")))))
    ref_hist = F.concat("ref_counts", F.array(F.col("ref_all_words") - add(F.col("ref_counts"))))
    long_enough = F.aggregate("_classes", F.lit(0).cast("long"), lambda s, x: s + x) >= params.min_chars
    out = out.withColumns(
        {
            "char_distance": F.when(long_enough & F.col("ref_classes").isNotNull(), js_distance(F.col("_classes"), F.col("ref_classes"))),
            "word_distance": F.when(F.col("_spaced").isNotNull() & F.col("ref_words").isNotNull(), js_distance(F.col("_hist"), ref_hist)),
        }
    )
    near = (F.coalesce("char_distance", F.lit(0.0)) <= params.max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= params.max_word_distance)
    out = out.withColumn("kept", ~F.col("base_failed") & near)
    # a filter on ``kept`` would be pushed through all the projections above, each of whose
    # columns it would evaluate anew wherever it is used; it isn't pushed through a generator
    own = [F.col(c) for c in df.columns]
    out = out.select(*own, F.explode(F.array(F.struct(*made))).alias("_verdict"))
    return out.select(*own, "_verdict.*")
