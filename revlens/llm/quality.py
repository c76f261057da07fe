"""Operator 4 [native]: quality rules with risk-controlled thresholds.

Each rule measures a rate of a text (symbols, repeated lines, repeated words,
mean word length). For each stratum and each rule, a grid of cutoffs is
tested on the labelled rows: with n clean rows in the stratum of which a
cutoff rejects k, it is certified if the exact binomial test rejects "the
false-rejection rate is ALPHA or more", that is if P(Bin(n, ALPHA) <= k) <=
DELTA / number of tests (Bonferroni over strata, rules and cutoffs). That is
the condition that the one-sided Clopper-Pearson bound lies below ALPHA. So,
with probability 1 - DELTA, no chosen cutoff rejects more than ALPHA of the
clean texts of its stratum. Of the certified cutoffs, the one with the best
balance of bad over clean rows rejected is taken; if none rejects more bad
than clean rows, or none is certified, the rule is off in that stratum.

All of it is DataFrame expressions: word windows are hashed and sorted inside
each row's arrays, label counts are aggregated to strata x rules x cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.store import stored

SPACE = " \t\n\x0b\f\r"  # fixed value: what separates words
SYMBOLS = "#*$%&|<>"     # fixed value: what counts as a symbol

MIN_WORDS = 50
ALPHA = 0.02   # false-rejection rate allowed to one rule in one stratum
DELTA = 0.05   # chance that any of the guarantees fails

#: rule -> (what is counted, what it is counted against, cutoffs in thousandths); a text is rejected above the cutoff
RULES: dict[str, tuple[str, str, list[int]]] = {
    "symbols": ("n_symbols", "word_chars", [10, 20, 30, 40, 60, 80, 120, 160, 240]),
    "lines": ("n_dup_lines", "n_lines", [50, 100, 150, 200, 300, 400, 500, 600, 800]),
    "repeats": ("n_repeat_words", "n_words", [50, 100, 150, 200, 250, 300, 350, 400, 450]),
    "long_words": ("word_chars", "n_words", [6000, 7000, 8000, 9000, 10000, 12000, 15000, 20000, 30000]),
}

_HIGH = -(1 << 31)       # the hash bits of a packed (hash, position)
_LOW = (1 << 31) - 1     # its position bits


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(bare) > 0, F.split(bare, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column, k: int = 3) -> Column:
    """Words inside k-word windows that occur twice or more.

    Each window becomes a 64-bit hash. A sort of longs that pack 33 bits of
    hash and the position brings possible repeats together; those few are
    compared by their whole hash. The work is n log n for any text.
    """
    def covered(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(_HIGH)).bitwiseOR(i.cast("long"))))

        def near(s: Column) -> Column:
            return F.filter(s, lambda x, i: (F.coalesce(x.bitwiseXOR(F.get(s, i - 1)), F.lit(-1)).bitwiseAND(F.lit(_HIGH)) == 0)
                            | (F.coalesce(x.bitwiseXOR(F.get(s, i + 1)), F.lit(-1)).bitwiseAND(F.lit(_HIGH)) == 0))

        def exact(s: Column) -> Column:
            return F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))

        places = F.transform(_let(packed, near), lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int"))
        pairs = F.sort_array(F.transform(places, lambda p: F.struct(F.get(h, p).alias("h"), p.alias("p"))))
        spans = F.transform(_let(pairs, exact), lambda x: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: x["p"] + j))
        return F.size(F.array_distinct(F.flatten(spans))).cast("long")

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) > k, _let(hashes, covered)).otherwise(F.lit(0).cast("long"))


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of each whole text; a null text has no words."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.select("doc_id", "stratum", *measures(F.col("text")))


def measures(text: Column) -> list[Column]:
    """The counts of a text that isn't null."""
    words = _words(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    per_word = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                                              _repeat_words(w).alias("n_repeat_words")))
    per_line = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
    return [per_word.alias("w"), per_line.alias("l"), symbols.alias("n_symbols")]


def counted(df: DataFrame) -> DataFrame:
    """The columns of :func:`measures` as plain columns, with base_failed."""
    keep = [c for c in df.columns if c not in ("w", "l", "n_symbols")]
    flat = df.select(*keep, "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "l.n_lines", "w.n_repeat_words")
    return flat.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def over(rule: str, cutoff: Column) -> Column:
    """Whether a rule with a cutoff rejects the row."""
    part, whole, _ = RULES[rule]
    return 1000 * F.col(part) > cutoff * F.col(whole)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), summed term by term in logarithms."""
    start = F.struct((n * F.log1p(F.lit(-p))).alias("term"), (n * F.log1p(F.lit(-p))).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, start, step)["total"]


def thresholds(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the chosen cutoffs, from rows with counts, stratum, clean and bad.

    Rows that the base rules reject are no part of the choice. The verdict is
    that any rule rejects, so each rule is certified at its share of alpha:
    together they reject no more than alpha of a stratum's clean documents.
    """
    grid = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), over(r, F.lit(c)).alias("hit")) for r, (_, _, cuts) in RULES.items() for c in cuts])
    tested = (labelled.filter("NOT base_failed AND (clean OR bad)").select("stratum", "clean", "bad", F.explode(grid).alias("g"))
              .groupBy("stratum", "g.rule", "g.cutoff")
              .agg(F.count_if("clean").alias("n"), F.count_if(F.col("clean") & F.col("g.hit")).alias("k"), F.count_if(F.col("bad") & F.col("g.hit")).alias("caught")))
    tests = F.count(F.lit(1)).alias("tests")
    tested = tested.crossJoin(F.broadcast(tested.agg(tests)))  # one row: the number of tests
    sure = tested.filter((F.col("n") > 0) & (F.col("caught") > F.col("k")) & (binomial_tail(F.col("n"), F.col("k"), alpha / len(RULES)) <= F.log(F.lit(delta) / F.col("tests"))))
    return sure.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(F.col("caught") - F.col("k"), "cutoff")).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each row of ``docs``.

    ``labels`` has doc_id, quality and toxic; clean is quality 1 and not
    toxic, bad is quality 0, and all labelled rows are used.

    Nulls and edges: a null or empty text has no words and fails the base
    rules; a null stratum is a stratum of its own; a row without an id or a
    label isn't learned from; of repeated labels, a document is clean only if
    all say so; repeated rows give repeated results; without labels the base
    rules decide alone; an empty table gives an empty result; other columns
    are ignored.
    """
    rows = stored(counted(signals(docs, id_col, text_col, stratum_col)), "quality")
    return rows.join(cutoffs(rows, labels, alpha, delta), "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~verdict())


def cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each stratum with the chosen cutoff of each rule (null: off)."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).filter("doc_id IS NOT NULL")
             .groupBy("doc_id").agg((F.min("q") == 1).alias("good"), (F.max(F.coalesce("t", F.lit(0))) == 0).alias("mild"), (F.min("q") == 0).alias("poor")))
    seen = rows.join(known.select("doc_id", F.coalesce(F.col("good") & F.col("mild"), F.lit(False)).alias("clean"), F.coalesce("poor", F.lit(False)).alias("bad")), "doc_id")
    chosen = thresholds(seen.dropDuplicates(), alpha, delta)  # a repeated row is one observation
    return chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def verdict() -> Column:
    """Whether a chosen cutoff rejects the row."""
    hits = [F.coalesce(over(r, F.col(f"cut_{r}")), F.lit(False)) for r in RULES]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
         alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their own columns.

    The counts are stored once, with one number for each row; rows with equal
    id and text get equal verdicts, so the verdict is joined by both.
    """
    key = [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(stratum_col).cast("string"), F.lit("")), F.col(text_col).cast("string")).alias("_text")]
    src = docs.select(*key, F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = stored(counted(src.select("doc_id", "_text", "stratum", *measures(F.col("text")))), "quality")
    failed = rows.join(cutoffs(rows, labels, alpha, delta), "stratum", "left").filter(F.col("base_failed") | verdict())
    failed = failed.select(F.col("doc_id").alias("fail_id"), F.col("_text").alias("fail_text")).distinct()
    marked = docs.select(F.struct(*docs.columns).alias("row"), *key)  # the row's own columns, whatever their names, stay inside
    return marked.join(failed, F.col("doc_id").eqNullSafe(F.col("fail_id")) & (F.col("_text") == F.col("fail_text")), "left_anti").select("row.*")
