"""Quality rules: counts of a text, and the divergence of its histograms from language references; DataFrame functions only.

Every language of the table gives a reference: how its characters fall into classes, and how its words fall
into its commonest ones and the rest, over all of its texts. A text whose Jensen-Shannon distance from every
reference is too large, in characters or in words, is not kept. Short texts have rough histograms, so each
comparison has a least length. The references are a few numbers for each language and go into the plan as
literals; the texts themselves are never shuffled.

Repeated windows of words are searched by hashes first; only texts in which a hash returns build the windows
themselves, and those decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes of characters other than white space and lower-case letters, in the order in which they are taken out of what is left of a text; the last class is the rest.
CLASSES = (r"\p{P}", r"[\p{Lu}\p{Lt}]", r"\p{N}", r"[\p{L}\p{M}]")
N_CLASSES = len(CLASSES) + 3
SPACES = ("\\t", "\\n", "\\u000b", "\\u000c", "\\r")
SYMBOLS = "#*$%&|<>"


def flat(text: str) -> str:
    """SQL of the text with \\x20 for each of \\x09-\\x0D. Replacing single bytes costs a fraction of a regular expression."""
    for space in SPACES:
        text = f"replace({text}, '{space}', ' ')"
    return text


def word_counts(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """docs with _t (its text), _w (its words), _chars and n_words, word_chars, n_dup_lines and n_repeat_words.

    Words are runs of characters other than \\x20 and \\x09-\\x0D; null has none. n_dup_lines: lines (split at
    \\n) with a word that equal an earlier line. n_repeat_words: words in windows of `window` words that are
    found twice or more in the text, the first included.
    """
    out = docs.withColumn("_t", F.coalesce(text, F.lit(""))).withColumn("_flat", F.expr(flat("_t")))
    out = out.withColumns({
        "_w": F.expr("filter(split(_flat, ' '), x -> x <> '')"), "_lines": F.expr(r"filter(split(_t, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')"), "_chars": F.length("_t"),
        "word_chars": F.length(F.expr("replace(_flat, ' ', '')")).cast("long"),
    })
    out = out.withColumns({"_h": F.expr("transform(_w, x -> xxhash64(x))"), "_n": F.size("_w"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    # a lambda reads an array of another column by place; each such column is used more than once, so that the optimizer does not put its expression into the lambda
    rest = ", ".join(f"_h[i + {k}]" for k in range(1, window))
    out = out.withColumn("_g", F.expr(f"if(_n > {window}, transform(slice(_h, 1, _n - {window - 1}), (x, i) -> xxhash64(x, {rest})), array())")).withColumn("_hs", F.size("_h"))
    out = out.withColumn("_sorted", F.expr("if(size(array_distinct(_g)) < size(_g), sort_array(transform(_g, (x, i) -> struct(x AS g, i AS i))), null)"))
    out = out.withColumn("_maybe", _repeated("_sorted"))
    out = out.withColumn("_exact", F.expr(f"sort_array(transform(_maybe, i -> struct(array_join(slice(_w, i + 1, {window}), ' ') AS g, i AS i)))"))
    out = out.withColumn("_at", F.sort_array(_repeated("_exact"))).withColumn("_m", F.size("_at"))
    gaps = f"zip_with(slice(_at, 2, _m - 1), slice(_at, 1, _m - 1), (b, a) -> least(b - a, {window}))"
    covered = F.expr(f"if(_m > 0, aggregate({gaps}, {window}, (s, x) -> s + x), 0)")
    return out.withColumns({"n_words": F.col("_n").cast("long"), "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long")}).drop("_flat", "_lines", "_h", "_hs", "_n", "_g", "_sorted", "_maybe", "_exact", "_at", "_m")


def _repeated(name: str) -> Column:
    """The i of those elements (g, i) of a sorted array whose g equals a neighbour's."""
    n = f"greatest(size({name}) - 1, 0)"
    return F.expr(f"array_distinct(flatten(filter(zip_with(slice({name}, 1, {n}), slice({name}, 2, {n}), (a, b) -> if(a.g = b.g, array(a.i, b.i), null)), x -> x IS NOT NULL)))")


def with_classes(df: DataFrame) -> DataFrame:
    """df (with _t, _chars and word_chars) with _c, the counts of its characters by class, and n_symbols."""
    out = df.withColumn("_r0", F.regexp_replace("_t", r"[\p{Ll}\x20\x09-\x0D]+", ""))
    for i, kind in enumerate(CLASSES):  # each takes its characters away, so later ones read a short rest
        out = out.withColumn(f"_r{i + 1}", F.regexp_replace(f"_r{i}", f"{kind}+", ""))
    symbols = "_r0"  # no symbol is a lower-case letter or white space
    for c in SYMBOLS:
        symbols = f"replace({symbols}, '{c}', '')"
    out = out.withColumn("n_symbols", (F.length("_r0") - F.length(F.expr(symbols))).cast("long"))
    names = [f"_r{i}" for i in range(len(CLASSES) + 1)]
    counts = [F.col("word_chars") - F.length("_r0"), F.col("_chars") - F.col("word_chars")] + [F.length(a) - F.length(b) for a, b in zip(names, names[1:])] + [F.length(names[-1])]
    return out.withColumn("_c", F.array(*(c.cast("long") for c in counts))).drop(*names)


def language_references(docs: DataFrame, common: int = 40, most: int = 256, least_words: int = 200) -> list[dict]:
    """lang, classes (share of each character class) and words (share of each of its `common` commonest words) of each language.

    All texts count. The `most` - 1 languages with most texts have a reference of their own; the others and
    rows without language share one, named null. Words are lower-cased; ties go to the smaller word. A
    reference of fewer than `least_words` words is left out. The result is bounded by `most` and `common`.
    """
    texts = docs.select("lang", F.coalesce("text", F.lit("")).alias("_t"))
    own = [r["lang"] for r in texts.groupBy("lang").agg(F.count("*").alias("n")).filter("lang IS NOT NULL").orderBy(F.desc("n"), "lang").limit(most - 1).collect()]
    kind = F.when(F.col("lang").isin(own), F.col("lang")) if own else F.lit(None).cast("string")
    texts = texts.withColumn("lang", kind)
    vocabulary = texts.select("lang", F.explode(F.expr(f"split(lower({flat('_t')}), ' ')")).alias("word")).filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = vocabulary.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("k") <= common).drop("k")
    totals = vocabulary.groupBy("lang").agg(F.lit(None).cast("string").alias("word"), F.sum("n").alias("n"))
    found = ranked.unionByName(totals).collect()  # both read one exchange of the vocabulary
    totals = {r["lang"]: r["n"] for r in found if r["word"] is None}
    words: dict = {}
    for r in found:
        if r["word"] is not None:
            words.setdefault(r["lang"], {})[r["word"]] = r["n"] / totals[r["lang"]]
    sums = [F.sum(F.col("_c")[i]).alias(f"c{i}") for i in range(N_CLASSES)]
    sized = texts.withColumns({"_chars": F.length("_t"), "word_chars": F.length(F.expr(f"replace({flat('_t')}, ' ', '')"))})
    classes = {r["lang"]: [r[f"c{i}"] for i in range(N_CLASSES)] for r in with_classes(sized).groupBy("lang").agg(*sums).collect()}
    return [
        {"lang": lang, "classes": [c / sum(classes[lang]) for c in classes[lang]], "words": words[lang]}
        for lang in sorted(totals, key=lambda x: (x is None, x)) if totals[lang] >= least_words
    ]


def apply_rules(
    docs: DataFrame, references: list[dict] | None = None, least_words: int = 10, repeat_percent: int = 20, class_distance: float = 0.2, word_distance: float = 0.45,
    least_chars: int = 200, least_compared: int = 80,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance and word_distance, for each row.

    base_failed: fewer than `least_words` words, or more than `repeat_percent` of them in repeated windows.
    Others are kept if some language's reference is near in both histograms: Jensen-Shannon distance (base 2,
    from 0 to 1) of the character classes up to `class_distance` where the text has `least_chars`
    characters, and of the common words up to `word_distance` where it has `least_compared` words;
    shorter texts pass that comparison. The distances returned are those of the reference for which the
    greater of both, each against its limit, is least; null where there is none. Null and empty texts have no words and
    fail. Without references nothing but the base rules applies. Repeated rows are judged each for itself.
    """
    rows = docs.select("doc_id", "lang", "text")
    references = language_references(rows) if references is None else references
    counted = word_counts(rows.select("doc_id", "text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    counted = with_classes(counted.withColumn("base_failed", failed))
    if not references:
        return counted.select("doc_id", *counts, "base_failed", (~F.col("base_failed")).alias("kept"), *(F.lit(None).cast("double").alias(x) for x in ("class_distance", "word_distance")))

    listed = sorted({w for r in references for w in r["words"]})
    # runs of the common words in order: each word with its share of the text's words
    out = counted.withColumn("_s", F.sort_array(F.transform(F.filter("_w", lambda x: F.lower(x).isin(listed)), F.lower)))
    out = out.withColumn("_k", F.size("_s")).withColumn("_new", F.expr(
        "filter(transform(zip_with(slice(_s, 1, greatest(_k - 1, 0)), slice(_s, 2, greatest(_k - 1, 0)), (a, b) -> a <> b), (x, i) -> if(x, i + 1, null)), x -> x IS NOT NULL)"
    )).withColumn("_p", F.expr("if(_k = 0, array(), zip_with(concat(_new, array(_k)), concat(array(0), _new), (b, a) -> (b - a) / n_words))"))
    out = out.withColumn("_runs", F.expr("zip_with(array_distinct(_s), _p, (w, p) -> struct(w AS w, p AS p))"))
    out = out.withColumn("_cp", F.expr("transform(_c, x -> x / _chars)"))
    literal = F.array(*(
        F.struct(
            F.array(*map(F.lit, r["classes"])).alias("classes"), F.map_from_arrays(F.array(*map(F.lit, r["words"])), F.array(*map(F.lit, r["words"].values()))).alias("words"),
            F.lit(sum(r["words"].values())).alias("common"),
        )
        for r in references
    ))

    def shared(p: Column, q: Column) -> Column:
        """Twice what a bin adds to the divergence."""
        part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
        return part(p, q) + part(q, p)

    def distances(ref: Column) -> Column:
        classes = F.aggregate(F.zip_with("_cp", ref["classes"], shared), F.lit(0.0), lambda s, x: s + x)
        # words of the reference that the text lacks add their share each
        start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

        def add(s: Column, run: Column) -> Column:
            q = F.element_at(ref["words"], run["w"])
            return F.when(q.isNull(), s).otherwise(F.struct((s["d"] + shared(run["p"], q)).alias("d"), (s["p"] + run["p"]).alias("p"), (s["q"] + q).alias("q")))

        words = F.aggregate("_runs", start, add, lambda s: s["d"] + ref["common"] - s["q"] + shared(F.greatest(1 - s["p"], F.lit(0.0)), F.greatest(1 - ref["common"], F.lit(0.0))))
        return F.struct(*(F.round(F.sqrt(F.greatest(x / 2, F.lit(0.0))), 9).alias(name) for name, x in (("c", classes), ("w", words))))

    out = out.withColumn("_d", F.when(F.col("n_words") > 0, F.transform(literal, distances)))
    near_c = F.col("_chars") < least_chars
    near_w = F.col("n_words") < least_compared
    worst = lambda d: F.greatest(F.when(near_c, 0.0).otherwise(d["c"] / class_distance), F.when(near_w, 0.0).otherwise(d["w"] / word_distance))
    out = out.withColumn("_best", F.array_min(F.transform("_d", lambda d: F.struct(worst(d).alias("x"), d["c"].alias("c"), d["w"].alias("w")))))
    kept = ~F.col("base_failed") & F.coalesce(F.col("_best.x") <= 1, F.lit(False))
    return out.select("doc_id", *counts, "base_failed", kept.alias("kept"), F.col("_best.c").alias("class_distance"), F.col("_best.w").alias("word_distance"))
