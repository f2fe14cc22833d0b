"""Word tables: lemmas, stems, and their application to token lists inside their rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwire.functions import wordlists as W
from siftwire.session import stored

#: Rows of a word table that go to every task; a larger one meets the tokens in a join.
TABLE_WORDS = 1 << 18
#: Stems that a task remembers.
KNOWN_STEMS = 1 << 18

# Published detachment rules, suffix and ending per word class.
DETACHMENT = {
    "n": [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"),
          ("shes", "sh"), ("men", "man"), ("ies", "y")],
    "v": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""),
          ("ing", "e"), ("ing", "")],
}


def lemma_table(forms: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """Lemma of every form: ``form, pos, lemma``, one row where the lemma differs.

    ``forms(form)`` are the words in use, ``lexicon(lemma, pos)`` the dictionary, ``exceptions
    (form, pos, lemma)`` the irregular forms. A candidate counts if the dictionary holds it; the
    shortest one wins, then the earliest rule.
    """
    rules = [
        (pos, order + 1, suffix, ending)
        for pos, pairs in DETACHMENT.items()
        for order, (suffix, ending) in enumerate(pairs)
    ]
    candidates = F.array(
        *[
            F.when(
                F.col("form").endswith(suffix),
                F.struct(
                    F.lit(pos).alias("pos"),
                    F.lit(order).alias("rule"),
                    F.concat(
                        F.substring("form", F.lit(1), F.length("form") - F.lit(len(suffix))), F.lit(ending)
                    ).alias("lemma"),
                ),
            )
            for pos, order, suffix, ending in rules
        ],
        *[
            F.struct(F.lit(pos).alias("pos"), F.lit(0).alias("rule"), F.col("form").alias("lemma"))
            for pos in DETACHMENT
        ],
    )
    words = forms.select("form").distinct()
    spread = words.select("form", F.explode(F.array_compact(candidates)).alias("c")).select(
        "form", "c.pos", "c.rule", "c.lemma"
    )
    if exceptions is not None:
        irregular = exceptions.select("form", "pos", F.lit(1).alias("rule"), "lemma").join(
            words, "form", "left_semi"
        )
        spread = spread.join(exceptions.select("form", "pos"), ["form", "pos"], "left_anti").unionByName(
            irregular.unionByName(
                irregular.select("form", "pos", F.lit(0).alias("rule"), F.col("form").alias("lemma"))
            )
        )
    known = spread.join(lexicon.select("lemma", "pos").distinct(), ["lemma", "pos"], "left_semi")
    best = known.groupBy("form", "pos").agg(
        F.min(F.struct(F.length("lemma").alias("size"), "rule", "lemma")).alias("best")
    )
    return best.select("form", "pos", F.col("best.lemma").alias("lemma")).filter(
        F.col("form") != F.col("lemma")
    )


def lexicon_rows() -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """(lemma, pos) and (form, pos, lemma) of the words that come with the library."""
    irregular = {"v": W.irregular(W.IRREGULAR_VERBS), "n": W.irregular(W.IRREGULAR_NOUNS)}
    regular = {"v": W.REGULAR_VERBS, "n": W.REGULAR_NOUNS}
    lexicon = {(word, pos) for pos, text in regular.items() for word in text.split()}
    lexicon |= {(lemma, pos) for pos, pairs in irregular.items() for _, lemma in pairs}
    return sorted(lexicon), sorted((form, pos, lemma) for pos, pairs in irregular.items() for form, lemma in pairs)


def default_lemmas(forms: DataFrame) -> DataFrame:
    """``lemma_table`` of ``forms`` by the library's own words: irregular forms and common words of messages.

    A larger dictionary is a matter of other tables for ``lemma_table``.
    """
    spark = forms.sparkSession
    lexicon, exceptions = lexicon_rows()
    return lemma_table(forms, spark.createDataFrame(lexicon, "lemma string, pos string"), spark.createDataFrame(exceptions, "form string, pos string, lemma string"))


def verb_then_noun(lemmas: DataFrame) -> DataFrame:
    """One step per form: its verb lemma, and the noun lemma of that."""
    verbs = lemmas.filter(F.col("pos") == "v").select("form", F.col("lemma").alias("verb"))
    nouns = lemmas.filter(F.col("pos") == "n").select(
        F.col("form").alias("noun_form"), F.col("lemma").alias("noun")
    )
    both = verbs.join(
        nouns.select(F.col("noun_form").alias("form"), "noun"), "form", "full_outer"
    ).select("form", F.coalesce("verb", "form").alias("verb"))
    joined = both.join(nouns, both["verb"] == nouns["noun_form"], "left")
    return joined.select("form", F.coalesce("noun", "verb").alias("word")).filter(
        F.col("form") != F.col("word")
    )


def apply_word_table(df: DataFrame, table: DataFrame, tokens_col: str, id_col: str) -> DataFrame:
    """Replace tokens by ``table(form, word)``, keeping order, repeats and empty lists.

    A table of up to ``TABLE_WORDS`` rows goes to the tasks, and no token moves; a larger one, or one that
    has two words for a form, is joined.
    """
    known = table.filter("form is not null and word is not null").select("form", "word").limit(TABLE_WORDS + 1).toArrow()
    words = dict(zip(known["form"].to_pylist(), known["word"].to_pylist(), strict=True))
    if known.num_rows > TABLE_WORDS or len(words) < known.num_rows:
        return _joined(df, table, tokens_col, id_col)
    sent = df.sparkSession.sparkContext.broadcast(words)
    return _in_rows(df, lambda form: sent.value.get(form, form), lambda _: table, tokens_col, id_col)


def _in_rows(df: DataFrame, word: Callable[[str], str], table: Callable[[DataFrame], DataFrame], tokens_col: str, id_col: str) -> DataFrame:
    """Replace tokens by their ``word`` inside their rows, in Arrow batches that look up each distinct token once.

    Rows that share an id have the words of all of them, so these, of which there are few, are joined
    with the ``table`` of their tokens. Tokens of a row without an id stay as they are.
    """

    @F.arrow_udf("array<string>")
    def rewritten(lists: pa.Array) -> pa.Array:
        return _replaced(lists, word)

    tokens = F.col(tokens_col)
    done = F.when(F.col(id_col).isNotNull(), rewritten(tokens)).otherwise(tokens).alias(tokens_col)
    columns = [done if c == tokens_col else F.col(f"`{c}`") for c in df.columns]
    repeated = stored(df.groupBy(id_col).agg(F.count("*").alias("n")).filter((F.col("n") > 1) & F.col(id_col).isNotNull()).select(id_col), "repeated-ids")
    if repeated.isEmpty():
        return df.select(*columns)
    together = df.join(repeated, id_col, "left_semi").select(*df.columns)
    alone = df.join(repeated, id_col, "left_anti").select(*columns)
    return alone.unionByName(_joined(together, table(together), tokens_col, id_col))


def _replaced(lists: pa.Array, word: Callable[[str], str]) -> pa.Array:
    """The lists with each token's ``word``; null tokens go, unless a list has nothing else."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    forms = lists.flatten().dictionary_encode()
    words = pa.array([word(x) for x in forms.dictionary.to_pylist()], pa.string()).take(forms.indices)
    if words.null_count:
        there = words.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(counts)), counts)
        full = np.bincount(row[there], minlength=len(counts))
        words = words.filter(pa.array(there | (full[row] == 0)))
        counts = np.where(full > 0, full, counts)
    ends = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
    return pa.ListArray.from_arrays(ends, words, mask=lists.is_null() if lists.null_count else None)


def _joined(df: DataFrame, table: DataFrame, tokens_col: str, id_col: str) -> DataFrame:
    """``apply_word_table`` by a join of the exploded tokens.

    Word and document sides are partitioned by document, so only the table moves; whether it
    is broadcast is left to Spark's own size check.
    """
    rows = df.repartition(F.col(id_col))
    cells = rows.select(id_col, F.posexplode_outer(tokens_col).alias("pos", "form"))
    cells = cells.filter(F.col("form").isNotNull())
    rewritten = (
        cells.join(table, "form", "left")
        .groupBy(id_col)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("pos", F.coalesce("word", "form").alias("word")))
            ).alias("cells")
        )
        .select(id_col, F.col("cells.word").alias("rewritten"))
    )
    merged = rows.join(rewritten, id_col, "left")
    return merged.withColumn(tokens_col, F.coalesce("rewritten", tokens_col)).select(*df.columns)


def lemmatize(df: DataFrame, lemmas: DataFrame, tokens_col: str = "tokens", id_col: str = "doc_id") -> DataFrame:
    """Verb lemma, then noun lemma, of every token."""
    return apply_word_table(df, verb_then_noun(lemmas), tokens_col, id_col)


# ---- Porter's suffix stripping (1980), with the usual later additions -------------------

# Suffix, replacement, least measure of the stem.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
          ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
          ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
          ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
          ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
          ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
          "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
# Words with a stem of their own.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
             "news": "news", "inning": "inning", "innings": "inning", "outing": "outing",
             "outings": "outing", "canning": "canning", "cannings": "canning", "howe": "howe",
             "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}

_CONSONANT = "[bcdfghjklmnpqrstvwxzY]"
_VOWEL = "[aeiouy]"


def _shape(word: Column) -> Column:
    """The word with every consonant y written as capital Y."""
    return F.regexp_replace(word, r"(^|[aeiou])y", "$1Y")


def _measure_above(stem: Column, least: int) -> Column:
    pairs = f"({_VOWEL}+{_CONSONANT}+)" + "{" + str(least + 1) + ",}"
    return _shape(stem).rlike(f"^[^aeiouy]*{pairs}")


def _has_vowel(stem: Column) -> Column:
    return _shape(stem).rlike(_VOWEL)


def _double_end(word: Column) -> Column:
    return _shape(word).rlike(r"([bcdfghjklmnpqrstvwxzY])\1$")


def _short_end(word: Column) -> Column:
    """Consonant, vowel, consonant other than w, x, y; or a vowel-consonant word of two."""
    return _shape(word).rlike(f"{_CONSONANT}{_VOWEL}[bcdfghjklmnpqrstvz]$|^{_VOWEL}{_CONSONANT}$")


def _cut(word: Column, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.lit(len(suffix)))


def _longest_rule(word: Column, rules) -> Column:
    """Apply the rule of the longest matching suffix if its condition holds."""
    result = None
    for suffix, replacement, holds in sorted(rules, key=lambda r: -len(r[0])):
        stem = _cut(word, suffix)
        hit = F.when(holds(stem), F.concat(stem, F.lit(replacement))).otherwise(word)
        matched = word.endswith(suffix)
        result = F.when(matched, hit) if result is None else result.when(matched, hit)
    return result.otherwise(word)


def stem_vocabulary(words: DataFrame) -> DataFrame:
    """Stem of every distinct word: ``form, word``.

    Each step is one projection over the vocabulary, which is far smaller than the text.
    """
    w = F.col("word")
    steps = words.select("form").distinct().withColumn("word", F.lower("form"))

    steps = steps.withColumn(
        "word",
        F.when(w.endswith("ies") & (F.length(w) == 4), F.concat(_cut(w, "ies"), F.lit("ie")))
        .when(w.endswith("sses") | w.endswith("ies"), _cut(w, "es"))
        .when(w.endswith("ss"), w)
        .when(w.endswith("s"), _cut(w, "s"))
        .otherwise(w),
    )
    steps = steps.withColumn(
        "bare",
        F.when(w.endswith("ed") & _has_vowel(_cut(w, "ed")), _cut(w, "ed")).when(
            w.endswith("ing") & _has_vowel(_cut(w, "ing")), _cut(w, "ing")
        ),
    )
    bare = F.col("bare")
    tidy = (
        F.when(bare.endswith("at") | bare.endswith("bl") | bare.endswith("iz"), F.concat(bare, F.lit("e")))
        .when(_double_end(bare) & ~bare.rlike("[lsz]$"), F.substring(bare, F.lit(1), F.length(bare) - 1))
        .when(~_measure_above(bare, 1) & _measure_above(bare, 0) & _short_end(bare), F.concat(bare, F.lit("e")))
        .otherwise(bare)
    )
    steps = steps.withColumn(
        "word",
        F.when(
            w.endswith("ied"),
            F.concat(_cut(w, "ied"), F.when(F.length(w) == 4, F.lit("ie")).otherwise(F.lit("i"))),
        )
        .when(
            w.endswith("eed"),
            F.when(_measure_above(_cut(w, "eed"), 0), _cut(w, "d")).otherwise(w),
        )
        .when(bare.isNotNull(), tidy)
        .otherwise(w),
    )
    before_y = _cut(w, "y")
    steps = steps.withColumn(
        "word",
        F.when(
            w.endswith("y") & (F.length(before_y) > 1) & _shape(before_y).rlike(f"{_CONSONANT}$"),
            F.concat(before_y, F.lit("i")),
        ).otherwise(w),
    )

    def above(least):
        return lambda stem: _measure_above(stem, least)

    long_enough = lambda stem: _measure_above(F.concat(stem, F.lit("l")), 0)
    step_2 = [(s, r, long_enough if s == "logi" else above(0)) for s, r in STEP_2]
    # A shortened "-alli" may end in a suffix of this step again.
    steps = steps.withColumn(
        "word",
        F.when(w.endswith("alli") & _measure_above(_cut(w, "alli"), 0), _cut(w, "li")).otherwise(w),
    )
    steps = steps.withColumn("word", _longest_rule(w, step_2))
    steps = steps.withColumn("word", _longest_rule(w, [(s, r, above(0)) for s, r in STEP_3]))
    ion = lambda stem: _measure_above(stem, 1) & stem.rlike("[st]$")
    steps = steps.withColumn(
        "word", _longest_rule(w, [(s, "", ion if s == "ion" else above(1)) for s in STEP_4])
    )
    stem = _cut(w, "e")
    steps = steps.withColumn(
        "word",
        F.when(
            w.endswith("e")
            & (_measure_above(stem, 1) | (_measure_above(stem, 0) & ~_short_end(stem))),
            stem,
        ).otherwise(w),
    )
    steps = steps.withColumn(
        "word", F.when(w.endswith("ll") & _measure_above(_cut(w, "l"), 1), _cut(w, "l")).otherwise(w)
    )
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    final = (
        F.when(F.lower("form").isin(*IRREGULAR), irregular[F.lower("form")])
        .when(F.length("form") <= 2, F.lower("form"))
        .otherwise(w)
    )
    # No filter here: it would be pushed through the steps and repeat each of them.
    return steps.select("form", final.alias("word"))


_MEASURES = [re.compile(f"[^aeiouy]*(?:{_VOWEL}+{_CONSONANT}+)" + "{" + str(n + 1) + ",}") for n in range(2)]
_DOUBLE = re.compile(r"([bcdfghjklmnpqrstvwxzY])\1\Z")
_SHORT = re.compile(f"{_CONSONANT}{_VOWEL}[bcdfghjklmnpqrstvz]\\Z|\\A{_VOWEL}{_CONSONANT}\\Z")
_STEP_2, _STEP_3 = (sorted(rules, key=lambda r: -len(r[0])) for rules in (STEP_2, STEP_3))
_STEP_4 = sorted(STEP_4, key=lambda s: -len(s))


@lru_cache(KNOWN_STEMS)
def stem_word(form: str) -> str:
    """Stem of one word: what ``stem_vocabulary`` gives, for use inside a task."""
    low = form.lower()
    if low in IRREGULAR:
        return IRREGULAR[low]
    if len(form) <= 2:
        return low

    def shape(stem):
        return re.sub("(^|[aeiou])y", r"\1Y", stem)

    def above(stem, least):
        return _MEASURES[least].match(shape(stem)) is not None

    def vowel(stem):
        return re.search(_VOWEL, shape(stem)) is not None

    def short(stem):
        return _SHORT.search(shape(stem)) is not None

    def by_rule(w, rules, holds):
        for suffix, ending in rules:
            if w.endswith(suffix):
                stem = w[: len(w) - len(suffix)]
                return stem + ending if holds(stem, suffix) else w
        return w

    w = low
    if w.endswith("ies") and len(w) == 4:
        w = w[:-3] + "ie"
    elif w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    bare = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and vowel(w[: -len(s)])), None)
    if w.endswith("ied"):
        w = w[:-3] + ("ie" if len(w) == 4 else "i")
    elif w.endswith("eed"):
        w = w[:-1] if above(w[:-3], 0) else w
    elif bare is not None:
        if bare.endswith(("at", "bl", "iz")):
            w = bare + "e"
        elif _DOUBLE.search(shape(bare)) and not bare.endswith(("l", "s", "z")):
            w = bare[:-1]
        elif not above(bare, 1) and above(bare, 0) and short(bare):
            w = bare + "e"
        else:
            w = bare
    if w.endswith("y") and len(w) > 2 and re.search(f"{_CONSONANT}\\Z", shape(w[:-1])):
        w = w[:-1] + "i"
    if w.endswith("alli") and above(w[:-4], 0):
        w = w[:-2]
    w = by_rule(w, _STEP_2, lambda stem, suffix: above(stem + "l" if suffix == "logi" else stem, 0))
    w = by_rule(w, _STEP_3, lambda stem, _: above(stem, 0))
    w = by_rule(w, [(s, "") for s in _STEP_4], lambda stem, suffix: above(stem, 1) and (suffix != "ion" or stem.endswith(("s", "t"))))
    if w.endswith("e") and (above(w[:-1], 1) or (above(w[:-1], 0) and not short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and above(w[:-1], 1) else w


def stem(df: DataFrame, tokens_col: str = "tokens", id_col: str = "doc_id") -> DataFrame:
    """Stem token lists inside their rows: a batch's distinct words are stemmed once."""

    def stems(rows: DataFrame) -> DataFrame:
        return stem_vocabulary(rows.select(F.explode_outer(tokens_col).alias("form")).filter(F.col("form").isNotNull()))

    return _in_rows(df, stem_word, stems, tokens_col, id_col)
