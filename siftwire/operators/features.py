"""N-gram counts, vocabulary, IDF, TF-IDF in long and vector form, integer sequences."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwire.functions import patterns as P
from siftwire.functions import tokens as K
from siftwire.functions import vectors as V
from siftwire.functions.cleaning import decode_text
from siftwire.session import stored

MAX_BROADCAST_TERMS = 200_000
#: Texts of one id that may meet in one row; where an id has more, their terms are added up after the explode.
TOGETHER = 64
#: Texts that one task counts, on average: more texts are more tasks, and no task needs more memory.
TASK_TEXTS = 4096
#: Words of documents that are counted together in a task; a longer document is counted by itself.
PIECE_WORDS = 1 << 20
COUNTED = "array<struct<term:string,tf:bigint>>"


@dataclass(frozen=True)
class TfidfOptions:
    """Vectorizer settings. ``max_features`` also bounds what is broadcast."""

    max_features: int = 50_000
    ngrams: tuple[int, int] = (1, 2)
    min_df: int | float = 2
    max_df: int | float = 0.95
    sublinear_tf: bool = True
    use_idf: bool = True
    analyzer: str = "word"
    strip_accents: bool = True


# For texts out of the cleaner: they are ASCII already, so there is no accent to strip.
CLEANED = TfidfOptions(strip_accents=False)


def prepare_text(df: DataFrame, text_col: str, out_col: str, strip_accents: bool = True) -> DataFrame:
    """Lowercase, then drop accents; ASCII texts never leave the JVM."""
    df = df.withColumn(out_col, F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    if strip_accents:
        df = df.withColumn(out_col, decode_text(F.col(out_col), unescape=False, fold="combining"))
    return df


def split_terms(df: DataFrame, prepared_col: str, options: TfidfOptions = TfidfOptions()) -> DataFrame:
    """Turn the prepared text in ``prepared_col`` into the array of its terms, with repeats."""
    return reduce(lambda rows, step: rows.withColumn(prepared_col, step(F.col(prepared_col))), _splitting(options), df)


def _splitting(options: TfidfOptions) -> list:
    """The steps from a prepared text to its terms; each is a projection of its own, as the next one uses its result often."""
    low, high = options.ngrams
    if _analyzer(options) == "word":
        return [_words, lambda words: K.word_ngrams(words, low, high)]
    return [lambda text: F.array_remove(F.split(_squeezed(text), ""), ""), lambda chars: K.char_ngrams(chars, low, high)]


def _analyzer(options: TfidfOptions) -> str:
    if options.analyzer not in ("word", "char"):
        raise ValueError(f"unknown analyzer '{options.analyzer}', supported: word, char")
    return options.analyzer


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.FEATURE_TOKEN), F.lit(0))


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{P.SPACE}]{{2,}}+", " ")


def ngram_terms(
    df: DataFrame,
    text_col: str = "text",
    out_col: str = "terms",
    options: TfidfOptions = TfidfOptions(),
) -> DataFrame:
    """Add the array of all terms of a text, with repeats."""
    return split_terms(prepare_text(df, text_col, out_col, options.strip_accents), out_col, options)


def term_counts(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    options: TfidfOptions = TfidfOptions(),
    keep: tuple[str, ...] = (),
    outer: bool = False,
    packed: bool = False,
) -> DataFrame:
    """One row per document and term: ``id, *keep, term, tf``.

    With ``outer`` a document without terms keeps one row whose term is null.

    The prepared text is shuffled once by id, into as many tasks as there are texts for; left to itself, Spark
    would join small tasks to ones that grow with the table. Everything grouped by document afterwards (term
    counts here, norms and scores later) stays in place; moving exploded terms instead
    would ship each text many times over. Terms are counted inside the row, so that no task holds or
    spills the terms of many documents. The explode is an outer one in any case: an inner
    one makes the optimizer test the array for emptiness next to the scan, which would run
    the whole text pipeline twice.

    With ``packed`` it is one row per document, ``id, *keep, terms`` with the terms and their counts in an
    array, which ``tfidf`` and ``tfidf_vectors`` take as well; only where more than ``TOGETHER`` rows share an id
    the rows are as without it.
    """
    texts, most = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    texts, most = texts or 0, most or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, texts // TASK_TEXTS + 1)
    rows = prepare_text(df, text_col, "prepared_text", options.strip_accents)
    rows = rows.select(id_col, *keep, "prepared_text").repartition(tasks, F.col(id_col))
    if 1 < most <= TOGETHER:
        rows = rows.groupBy(id_col, *keep).agg(F.collect_list("prepared_text").alias("prepared_text"))
    counted = _counted(rows, options)
    if packed and most <= TOGETHER:
        return counted
    terms = counted.select(id_col, *keep, F.explode_outer("terms").alias("cell")).select(
        id_col, *keep, F.col("cell.term").alias("term"), F.coalesce("cell.tf", F.lit(1).cast("bigint")).alias("tf")
    )
    if not (outer or packed):
        terms = terms.filter(F.col("term").isNotNull())
    if most <= TOGETHER:
        return terms
    return terms.groupBy(id_col, *keep, "term").agg(F.sum("tf").alias("tf"))


def _counted(rows: DataFrame, options: TfidfOptions) -> DataFrame:
    """``rows`` with ``terms``, the distinct terms and their counts, in place of ``prepared_text``, a text or an array of texts."""
    here, several = F.col("prepared_text"), rows.schema["prepared_text"].dataType.typeName() == "array"
    units, counts = (_words, _word_counts) if _analyzer(options) == "word" else (_squeezed, _char_counts)
    cut = F.transform(here, units) if several else F.array(units(here))
    return rows.withColumn("terms", counts(*options.ngrams)(cut)).drop("prepared_text")


def _word_counts(low: int, high: int):
    """Counts of the runs of ``low`` to ``high`` words in arrays of texts, which are arrays of words.

    Words and runs of some documents at a time are numbered, so that equal ones are found as numbers and named once.
    """

    def counted_cells(texts: pa.Array, n_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        n_words = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(len(texts)), n_words)
        owner = np.repeat(np.arange(len(n_texts)), n_texts)[text]
        coded = texts.flatten().cast(pa.string()).dictionary_encode()
        word, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        run, names = word, words
        owners, terms, tfs, told = [], [], [], []
        for n in range(1, high + 1):
            starts = np.arange(len(word))
            if n > 1:
                starts = np.flatnonzero(text[n - 1 :] == text[: max(0, len(text) - n + 1)])
                code, pairs = pd.factorize(run[starts] * len(words) + word[starts + n - 1])
                first, last = np.divmod(pairs, max(1, len(words)))
                names = pc.binary_join_element_wise(names.take(pa.array(first)), words.take(pa.array(last)), " ")
                run = np.full(len(word), -1)
                run[starts] = code
            if n >= low:
                cell, tf = np.unique(owner[starts] * max(1, len(names)) + run[starts], return_counts=True)
                of, term = np.divmod(cell, max(1, len(names)))
                owners.append(of)
                terms.append(term + sum(map(len, told)))
                tfs.append(tf)
                told.append(names)
        owners, terms, tfs = map(np.concatenate, (owners, terms, tfs))
        order = np.argsort(owners, kind="stable")
        return owners[order], terms[order], tfs[order], pa.concat_arrays(told)

    @F.arrow_udf(COUNTED)
    def counted(column: pa.Array) -> pa.Array:
        n_texts = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        texts = column.flatten()
        ends = np.concatenate(([0], np.cumsum(n_texts)))
        words = np.concatenate(([0], np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False))))[ends]
        sizes, parts, a = [np.zeros(1, np.int64)], [], 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(words, words[a] + PIECE_WORDS, "right")) - 1)
            owner, term, tf, names = counted_cells(texts.slice(ends[a], ends[b] - ends[a]), n_texts[a:b])
            parts.append(pa.StructArray.from_arrays([names.take(pa.array(term)), pa.array(tf, pa.int64())], ["term", "tf"]))
            sizes.append(np.bincount(owner, minlength=b - a))
            a = b
        none = pa.array([], pa.struct([("term", pa.string()), ("tf", pa.int64())]))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.concat_arrays([none, *parts]))

    return counted


def _char_counts(low: int, high: int):
    """Counts of the runs of ``low`` to ``high`` characters in arrays of texts, run by run length and code point."""

    def runs(texts: list[str], n: int) -> np.ndarray:
        codes = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in texts]
        found = [np.lib.stride_tricks.sliding_window_view(c, n) for c in codes if len(c) >= n]
        return np.concatenate(found) if found else np.zeros((0, n), dtype=np.uint32)

    def named(rows: np.ndarray) -> list[str]:
        text = np.ascontiguousarray(rows, dtype="<u4").tobytes().decode("utf-32-le")
        return [text[i : i + rows.shape[1]] for i in range(0, len(text), rows.shape[1])]

    @F.arrow_udf(COUNTED)
    def counted(column: pa.Array) -> pa.Array:
        documents = column.to_pylist()
        terms, tfs, owner = [], [], []
        for n in range(low, high + 1):
            if n > 3:  # too long for a number
                for i, texts in enumerate(documents):
                    own, tf = np.unique(runs(texts, n), axis=0, return_counts=True)
                    terms.append(pa.array(named(own), pa.string()))
                    tfs.append(tf)
                    owner.append(np.full(len(tf), i))
                continue
            shift = np.arange(n, dtype=np.uint64)[::-1] * np.uint64(21)
            keys = []
            for i, texts in enumerate(documents):
                key = (runs(texts, n).astype(np.uint64) << shift).sum(axis=1, dtype=np.uint64)
                key, tf = np.unique(key, return_counts=True)
                keys.append(key)
                tfs.append(tf)
                owner.append(np.full(len(tf), i))
            at, distinct = pd.factorize(np.concatenate(keys)) if keys else (np.zeros(0, int), np.zeros(0, np.uint64))
            names = named((distinct[:, None] >> shift) & np.uint64((1 << 21) - 1))
            terms.append(pa.array(names, pa.string()).take(pa.array(at)))
        owner, tfs = (np.concatenate(x) if x else np.zeros(0, int) for x in (owner, tfs))
        order = np.argsort(owner, kind="stable")
        term = pa.concat_arrays(terms).take(pa.array(order)) if terms else pa.array([], pa.string())
        cells = pa.StructArray.from_arrays([term, pa.array(tfs[order], pa.int64())], ["term", "tf"])
        offsets = np.searchsorted(owner[order], np.arange(len(documents) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells)

    return counted


def document_frequency(counts: DataFrame) -> DataFrame:
    """Documents and occurrences per term; combined map-side, so hot terms stay cheap."""
    return counts.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("corpus_tf")
    )


def document_total(df: DataFrame) -> Column:
    """Number of documents as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def _limit(bound: int | float, total: Column) -> Column:
    return F.lit(bound) if isinstance(bound, int) else F.lit(float(bound)) * total


def select_vocabulary(
    frequencies: DataFrame, total: Column, options: TfidfOptions = TfidfOptions()
) -> DataFrame:
    """Terms within the frequency bounds, the most used first, numbered alphabetically.

    Returns ``term, idx, df, corpus_tf, idf``. Whole-table ranking happens only here, on at
    most ``max_features`` rows.
    """
    if options.max_features is None or options.max_features < 1:
        raise ValueError("max_features must be a positive number")
    counted = frequencies.withColumn("n_docs", total)
    kept = counted.filter(
        (F.col("df") >= _limit(options.min_df, F.col("n_docs")))
        & (F.col("df") <= _limit(options.max_df, F.col("n_docs")))
    )
    top = kept.orderBy(F.col("corpus_tf").desc(), F.col("term")).limit(options.max_features)
    return top.select(
        "term",
        (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"),
        "df",
        "corpus_tf",
        (idf(F.col("n_docs"), F.col("df")) if options.use_idf else F.lit(1.0)).alias("idf"),
    )


def idf(total: Column, df: Column) -> Column:
    """Smoothed inverse document frequency, never below one."""
    return F.log((F.lit(1.0) + total) / (F.lit(1.0) + df)) + F.lit(1.0)


def fit_tfidf(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    options: TfidfOptions = TfidfOptions(),
) -> DataFrame:
    """Vocabulary with IDF, learned from the given texts."""
    counts = term_counts(df, text_col, id_col, options)
    return select_vocabulary(document_frequency(counts), document_total(df), options)


def small(table: DataFrame, options: TfidfOptions = TfidfOptions()) -> DataFrame:
    """Broadcast hint for tables with one row per vocabulary term, within the size bound."""
    return F.broadcast(table) if options.max_features <= MAX_BROADCAST_TERMS else table


def weigh(
    counts: DataFrame,
    vocabulary: DataFrame,
    options: TfidfOptions = TfidfOptions(),
    outer: bool = False,
) -> DataFrame:
    """Join counts with the vocabulary and add the raw weight.

    Unknown terms drop out; with ``outer`` they stay with a null weight, so that documents
    without any known term stay, too.
    """
    if vocabulary is None:
        raise RuntimeError("fit the vocabulary before using it")
    tf = F.col("tf").cast("double")
    level = F.lit(1.0) + F.log(tf) if options.sublinear_tf else tf
    joined = counts.join(small(vocabulary, options), "term", "left" if outer else "inner")
    return joined.withColumn("weight", level * F.col("idf"))


def tfidf(
    counts: DataFrame,
    vocabulary: DataFrame,
    id_col: str = "doc_id",
    options: TfidfOptions = TfidfOptions(),
) -> DataFrame:
    """Long form: counts plus ``idx`` and ``tfidf``, scaled to unit length per document.

    Packed counts know their document's length before they are exploded; others are sorted by document for it.
    """
    if vocabulary is None:
        raise RuntimeError("fit the vocabulary before using it")
    if _packed(counts, options):
        vocabulary = stored(vocabulary, "vocabulary")
        kept = [c for c in counts.columns if c != "terms"]
        normed = counts.withColumn("norm", _norms(vocabulary, options)("terms"))
        cell = normed.select(*kept, "norm", F.explode_outer("terms").alias("cell"))
        rows = cell.select(*kept, F.col("cell.term").alias("term"), F.col("cell.tf").alias("tf"), "norm")
        weighed, norm = weigh(rows, vocabulary, options), F.col("norm")
    else:
        weighed = weigh(_exploded(counts), vocabulary, options)
        norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(id_col)))
    return weighed.withColumn("tfidf", F.col("weight") / norm).drop("weight", "norm", "df", "corpus_tf")


def _packed(counts: DataFrame, options: TfidfOptions) -> bool:
    """Whether ``counts`` are packed and the vocabulary may go to every task."""
    return "terms" in counts.columns and options.max_features <= MAX_BROADCAST_TERMS


def _exploded(counts: DataFrame) -> DataFrame:
    if "terms" not in counts.columns:
        return counts
    kept = [c for c in counts.columns if c != "terms"]
    cell = counts.select(*kept, F.explode_outer("terms").alias("cell"))
    return cell.select(*kept, F.col("cell.term").alias("term"), F.col("cell.tf").alias("tf"))


def _known(vocabulary: DataFrame, options: TfidfOptions, number: Column):
    """Terms known, and a function of an array of counted terms: (documents, and of each known term its document, ``number`` and weight)."""
    table = vocabulary.select("term", number.alias("number"), F.col("idf").cast("double").alias("idf")).toArrow()
    told = vocabulary.sparkSession.sparkContext.broadcast(
        (table["term"].combine_chunks().cast(pa.string()), table["number"].to_numpy(), table["idf"].to_numpy())
    )

    def cells(column: pa.Array) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        terms, numbers, idfs = told.value
        lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(column)
        at = pc.index_in(flat.field("term").cast(pa.string()), terms).fill_null(-1).to_numpy(zero_copy_only=False)
        known = at >= 0
        row, at = np.repeat(np.arange(len(column)), lengths)[known], at[known]
        tf = flat.field("tf").to_numpy(zero_copy_only=False)[known].astype(np.float64)
        return len(column), row, numbers[at], (1.0 + np.log(tf) if options.sublinear_tf else tf) * idfs[at]

    return table.num_rows, cells


def _norms(vocabulary: DataFrame, options: TfidfOptions):
    _, cells = _known(vocabulary, options, F.lit(0))

    @F.arrow_udf("double")
    def norms(column: pa.Array) -> pa.Array:
        n, row, _, weight = cells(column)
        return pa.array(np.sqrt(np.bincount(row, weights=weight * weight, minlength=n)))

    return norms


def tfidf_dots(
    counts: DataFrame,
    vocabulary: DataFrame,
    number: Column,
    id_col: str = "doc_id",
    keep: tuple[str, ...] = (),
    options: TfidfOptions = TfidfOptions(),
) -> DataFrame:
    """Unit-length vectors times the vocabulary's ``number``: ``id, *keep, dot``, which is 0 for documents without a known term.

    Count with ``outer=True`` (or ``packed``) to keep these. Packed counts are looked up inside their rows; others are summed by document.
    """
    if _packed(counts, options):
        _, cells = _known(vocabulary, options, number.cast("double"))

        @F.arrow_udf("double")
        def dots(column: pa.Array) -> pa.Array:
            n, row, own, weight = cells(column)
            norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=n))
            return pa.array(np.bincount(row, weights=weight * own, minlength=n) / np.where(norm > 0, norm, 1.0))

        return counts.select(id_col, *keep, dots("terms").alias("dot"))
    weight = F.col("weight")
    return weigh(_exploded(counts), vocabulary, options, outer=True).groupBy(id_col, *keep).agg(
        F.coalesce(F.sum(weight * number) / F.sqrt(F.sum(weight * weight)), F.lit(0.0)).alias("dot")
    )


def tfidf_vectors(
    counts: DataFrame,
    vocabulary: DataFrame,
    id_col: str = "doc_id",
    keep: tuple[str, ...] = (),
    options: TfidfOptions = TfidfOptions(),
) -> DataFrame:
    """One unit-length sparse vector per document: ``id, *keep, features``.

    Count with ``outer=True`` (or ``packed``) to get an empty vector for documents without a known term.
    """
    if _packed(counts, options):
        size, cells = _known(vocabulary, options, F.col("idx").cast("int"))

        @F.arrow_udf(VectorUDT())
        def unit(column: pa.Array) -> pa.Array:
            n, row, idx, weight = cells(column)
            order = np.lexsort((idx, row))
            norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=n))
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))), pa.int32())
            own = pa.array(idx[order], pa.int32()), pa.array((weight / norm[row])[order], pa.float64())
            head = pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, size), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in own]
            return pa.StructArray.from_arrays([*head, *lists], ["type", "size", "indices", "values"])

        return counts.select(id_col, *keep, unit("terms").alias("features"))
    size = vocabulary.agg(F.count(F.lit(1)).alias("n")).scalar()
    packed = (
        weigh(_exploded(counts), vocabulary, options, outer=True)
        .groupBy(id_col, *keep)
        .agg(
            F.array_sort(
                F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "weight")))
            ).alias("cells"),
            F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
        )
    )
    values = F.transform("cells", lambda c: c["weight"] / F.col("norm"))
    return packed.select(
        id_col, *keep, V.sparse_vector(size, F.col("cells.idx"), values).alias("features")
    )


def feature_names(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.select("idx", "term").orderBy("idx")


def vocabulary_size(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.agg(F.count(F.lit(1)).alias("vocabulary_size"))


def top_idf_terms(vocabulary: DataFrame, n: int = 20) -> DataFrame:
    return vocabulary.select("term", "idf").orderBy(F.col("idf").desc(), "term").limit(n)


PAD, UNKNOWN = 0, 1


def build_vocab(df: DataFrame, text_col: str = "text", max_vocab: int = 30_000) -> DataFrame:
    """Word to number by falling frequency; 0 pads and 1 stands for unknown words."""
    words = df.select(F.explode_outer(K.tokenize_whitespace(F.col(text_col))).alias("word"))
    words = words.filter(F.col("word").isNotNull())
    top = (
        words.groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "word")
        .limit(max_vocab - 2)
    )
    order = Window.orderBy(F.col("n").desc(), "word")
    ranked = top.select("word", (F.row_number().over(order) + 1).cast("int").alias("word_id"))
    special = df.sparkSession.range(2).select(
        F.when(F.col("id") == PAD, "<PAD>").otherwise("<UNK>").alias("word"),
        F.col("id").cast("int").alias("word_id"),
    )
    return special.unionByName(ranked)


def texts_to_sequences(
    df: DataFrame,
    vocab: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    length: int = 256,
) -> DataFrame:
    """Fixed-length arrays of word numbers: cut to the first ``length`` words, then padded."""
    rows = df.select(id_col, F.col(text_col).alias("source_text")).repartition(F.col(id_col))
    words = rows.select(
        id_col, F.slice(K.tokenize_whitespace(F.col("source_text")), 1, length).alias("words")
    )
    cells = words.select(id_col, F.posexplode_outer("words").alias("pos", "word"))
    coded = cells.join(vocab, "word", "left").groupBy(id_col).agg(
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("pos").isNotNull(),
                    F.struct("pos", F.coalesce("word_id", F.lit(UNKNOWN)).alias("code")),
                )
            )
        ).alias("cells")
    )
    codes = F.col("cells.code")
    padding = F.array_repeat(F.lit(PAD), F.lit(length) - F.size("cells"))
    return coded.select(id_col, F.concat(codes, padding).alias("sequence"))
