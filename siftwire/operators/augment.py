"""Text augmentation for the rare class, reproducible under any partitioning."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwire.functions import tokens as K
from siftwire.functions.draws import DRAW_RANGE, draw, draws_along, stem_of_draws, uniform, wide_draw
from siftwire.operators.ranks import ranked
from siftwire.session import stored

#: Bytes of texts whose noise is drawn together, about; a longer text is on its own.
NOISE_BYTES = 1 << 20


def _words(text: Column) -> Column:
    return K.tokenize_whitespace(text)


def synonym_lists(synonyms: DataFrame) -> DataFrame:
    """``word`` (lowercase) with its sorted ``choices``; broadcast where Spark finds it small."""
    return synonyms.groupBy(F.lower("word").alias("word")).agg(
        F.array_sort(F.collect_set("synonym")).alias("choices")
    )


def synonym_replace(
    df: DataFrame, synonyms: DataFrame, n: int = 2, seed: int = 42,
    text_col: str = "text", id_col: str = "doc_id", draw_col: str | None = None,
) -> DataFrame:
    """Replace ``n`` drawn words of more than three characters that have a synonym."""
    turn = F.col(draw_col) if draw_col else F.lit(0)
    key = [id_col] + ([draw_col] if draw_col else [])
    rows = df.repartition(F.col(id_col)).withColumn("words_", _words(F.col(text_col)))
    cells = rows.select(*key, F.posexplode_outer("words_").alias("pos", "token")).filter(F.length("token") > 3)
    options = cells.join(synonym_lists(synonyms), F.lower("token") == F.col("word"))
    pick = draw(seed, "synonym", F.col(id_col), turn, F.col("pos"))
    choice = F.col("choices")[F.pmod(pick, F.size("choices")).cast("int")]
    order = draw(seed, "order", F.col(id_col), turn, F.col("pos"))
    chosen = (
        options.select(*key, F.struct(order.alias("rank"), "pos", choice.alias("word")).alias("c"))
        .groupBy(*key)
        .agg(F.slice(F.array_sort(F.collect_list("c")), 1, n).alias("chosen"))
        .select(*key, F.map_from_arrays("chosen.pos", "chosen.word").alias("new_words"))
    )
    merged = rows.join(chosen, key, "left")
    changed = F.array_join(
        F.transform("words_", lambda w, i: F.coalesce(F.col("new_words")[i], w)), " "
    )
    result = F.when(F.size("words_") < 2, F.col(text_col)).otherwise(
        F.when(F.col("new_words").isNull(), F.array_join("words_", " ")).otherwise(changed)
    )
    return merged.withColumn(text_col, result).select(*df.columns)


def random_insert(
    df: DataFrame, synonyms: DataFrame, n: int = 1, seed: int = 42,
    text_col: str = "text", id_col: str = "doc_id", draw_col: str | None = None,
) -> DataFrame:
    """Insert a synonym of a drawn word at a drawn place, ``n`` times."""
    turn = F.col(draw_col) if draw_col else F.lit(0)
    lists = synonym_lists(synonyms).withColumnRenamed("word", "known_word")
    rows = df.withColumn("words_", _words(F.col(text_col))).withColumn("empty_", F.size("words_") == 0)
    for k in range(n):
        size = F.greatest(F.size("words_"), F.lit(1))
        at = F.pmod(draw(seed, "source", F.col(id_col), turn, k), size).cast("int") + 1
        rows = rows.withColumn("picked_", F.lower(F.try_element_at("words_", at)))
        rows = rows.join(lists, rows["picked_"] == F.col("known_word"), "left")
        pick = draw(seed, "synonym", F.col(id_col), turn, k)
        word = F.col("choices")[F.pmod(pick, F.size("choices")).cast("int")]
        place = F.pmod(draw(seed, "place", F.col(id_col), turn, k), F.size("words_") + 1).cast("int") + 1
        rows = rows.withColumn(
            "words_",
            F.when(F.col("choices").isNull(), F.col("words_")).otherwise(F.array_insert("words_", place, word)),
        ).drop("picked_", "known_word", "choices")
    result = F.when(F.col("empty_"), F.col(text_col)).otherwise(F.array_join("words_", " "))
    return rows.withColumn(text_col, result).select(*df.columns)


def random_swap(
    df: DataFrame, n: int = 1, seed: int = 42,
    text_col: str = "text", id_col: str = "doc_id", draw_col: str | None = None,
) -> DataFrame:
    """Exchange two drawn words, ``n`` times; no shuffle."""
    turn = F.col(draw_col) if draw_col else F.lit(0)
    rows = df.withColumn("words_", _words(F.col(text_col)))
    size = F.size("words_")
    for k in range(n):
        first = F.pmod(draw(seed, "swap", F.col(id_col), turn, k), F.greatest(size, F.lit(1)))
        step = F.pmod(draw(seed, "step", F.col(id_col), turn, k), F.greatest(size - 1, F.lit(1))) + 1
        rows = rows.withColumn("a_", first.cast("int")).withColumn(
            "b_", F.pmod(F.col("a_") + step, F.greatest(size, F.lit(1))).cast("int")
        )
        swapped = F.transform(
            "words_",
            lambda w, i: F.when(i == F.col("a_"), F.col("words_")[F.col("b_")])
            .when(i == F.col("b_"), F.col("words_")[F.col("a_")])
            .otherwise(w),
        )
        rows = rows.withColumn("words_", F.when(size < 2, F.col("words_")).otherwise(swapped))
    result = F.when(size < 2, F.col(text_col)).otherwise(F.array_join("words_", " "))
    return rows.withColumn(text_col, result).select(*df.columns)


def random_delete(
    df: DataFrame, p: float = 0.1, seed: int = 42,
    text_col: str = "text", id_col: str = "doc_id", draw_col: str | None = None,
) -> DataFrame:
    """Drop every word with chance ``p``; if all fall, one drawn word stays."""
    turn = F.col(draw_col) if draw_col else F.lit(0)
    rows = df.withColumn("words_", _words(F.col(text_col)))
    rows = rows.withColumn(
        "left_",
        F.filter("words_", lambda w, i: uniform(seed, "drop", F.col(id_col), turn, i) > p),
    )
    size = F.size("words_")
    rescue = F.pmod(draw(seed, "rescue", F.col(id_col), turn), F.greatest(size, F.lit(1))).cast("int")
    result = (
        F.when(size <= 1, F.col(text_col))
        .when(F.size("left_") == 0, F.col("words_")[rescue])
        .otherwise(F.array_join("left_", " "))
    )
    return rows.withColumn(text_col, result).select(*df.columns)


def char_noise(
    df: DataFrame, p: float = 0.05, seed: int = 42,
    text_col: str = "text", id_col: str = "doc_id", draw_col: str | None = None,
) -> DataFrame:
    """Change case, double or skip single characters with chance ``p``; no shuffle.

    One hash per character decides both whether and how: values below ``p`` of the range
    act, and their position inside that part picks the action. Hashes are computed in Arrow batches, many at a time.
    """
    turn = F.col(draw_col) if draw_col else F.lit(0)

    @F.arrow_udf("string")
    def noisy(texts: pa.Array, stems: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        edges = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, NOISE_BYTES), "right"), len(texts)))
        parts = [_noisy(texts.slice(a, b - a), stems.slice(a, b - a), p) for a, b in zip([0, *edges], edges, strict=False) if b > a]
        return pa.concat_arrays([pa.array([], pa.string()), *parts])

    stem = stem_of_draws(seed, "char", F.col(id_col), turn)
    return df.withColumn(text_col, noisy(F.coalesce(F.col(text_col).cast("string"), F.lit("")), stem)).select(*df.columns)


def _noisy(texts: pa.Array, stems: pa.Array, p: float) -> pa.Array:
    rows = [t.encode() for t in texts.to_pylist()]
    every = b"".join(rows).decode()
    codes = np.frombuffer(every.encode("utf-32-le"), np.uint32).copy()
    counts = np.array([len(r) for r in rows], dtype=np.int64)
    if not every.isascii():
        starts = np.concatenate(([0], np.cumsum((np.frombuffer(b"".join(rows), np.int8) >= -64).astype(np.int64))))
        ends = np.cumsum(counts)
        counts = starts[ends] - starts[ends - counts]
    third = draws_along([s.encode() for s in stems.to_pylist()], counts) / float(DRAW_RANGE) / p * 3 if p else np.full(len(codes), 3.0)
    acts = np.flatnonzero(third < 3)
    acts = acts[third[acts] / 3 < 1]
    many = np.ones(len(codes), dtype=np.int64)
    many[acts[third[acts] >= 2]] = 0
    many[acts[(third[acts] >= 1) & (third[acts] < 2)]] = 2
    changed = acts[third[acts] < 1]
    before, longer = codes[changed], []
    for code in np.unique(before):
        new = _swapped(chr(code))
        own = changed[before == code]
        if len(new) > 1:
            longer += [(at, new) for at in own]
        many[own] = len(new)
        codes[own] = ord(new[0])
    out = np.repeat(codes, many)
    if longer:
        first = np.cumsum(many) - many
        for at, new in longer:
            out[first[at] : first[at] + len(new)] = [ord(c) for c in new]
    ends = np.concatenate(([0], np.cumsum(many)))[np.cumsum(counts)]
    text = out.tobytes().decode("utf-32-le").encode()
    if len(text) > len(out):
        ends = np.concatenate(([0], np.cumsum(1 + (out >= 0x80) + (out >= 0x800) + (out >= 0x10000))))[ends]
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text))


#: Capitals that Spark knows and Python does not yet.
_CAPITALS = {"\u019b": "\ua7dc", "\u0264": "\ua7cb"}


def _swapped(letter: str) -> str:
    """The other case of a letter, as Spark has it but for some scripts newer than its own; other characters as they are."""
    if unicodedata.category(letter)[0] != "L":
        return letter
    upper = _CAPITALS.get(letter, letter.upper())
    return letter.lower() if upper == letter else upper


TECHNIQUES = ("synonym_replacement", "random_insertion", "random_swap", "random_deletion", "char_noise")


def apply_technique(
    name: str, df: DataFrame, synonyms: DataFrame | None, seed: int, **kwargs
) -> DataFrame:
    if name in ("synonym_replacement", "random_insertion"):
        if synonyms is None:
            raise ValueError(f"'{name}' needs a synonym table")
        run = synonym_replace if name == "synonym_replacement" else random_insert
        return run(df, synonyms, seed=seed, **kwargs)
    if name == "random_swap":
        return random_swap(df, seed=seed, **kwargs)
    if name == "random_deletion":
        return random_delete(df, seed=seed, **kwargs)
    if name == "char_noise":
        return char_noise(df, seed=seed, **kwargs)
    raise ValueError(f"unknown technique '{name}', supported: {', '.join(TECHNIQUES)}")


@dataclass(frozen=True)
class AugmentOptions:
    techniques: tuple[str, ...] = ("synonym_replacement", "random_swap", "random_deletion")
    augment_minority: bool = True
    minority_label: int = 1
    factor: int = 3
    max_samples: int | None = None  # bounds the synthetic rows
    seed: int = 42

    def __post_init__(self):
        for name in self.techniques:
            if name not in TECHNIQUES:
                raise ValueError(f"unknown technique '{name}', supported: {', '.join(TECHNIQUES)}")


def _varied(drawn: DataFrame, options: AugmentOptions, synonyms, text_col, id_col) -> DataFrame:
    """Give every drawn row the technique its hash picks; unchanged and empty results drop out."""
    count = len(options.techniques)
    pick = F.pmod(draw(options.seed, "technique", F.col(id_col), F.col("draw_no")), F.lit(count))
    rows = drawn.withColumn("technique_no", pick).withColumn("before_", F.col(text_col))
    parts = [
        apply_technique(
            name, rows.filter(F.col("technique_no") == i), synonyms, options.seed,
            text_col=text_col, id_col=id_col, draw_col="draw_no",
        )
        for i, name in enumerate(options.techniques)
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    # Read the finished text through a generator: a plain filter would be pushed below the
    # steps that build the text and repeat each of them.
    others = [c for c in result.columns if c != text_col]
    result = result.select(*others, F.explode_outer(F.array(text_col)).alias(text_col))
    changed = (F.col(text_col) != "") & (F.col(text_col) != F.col("before_"))
    return result.filter(changed).drop("technique_no", "before_")


def draw_rows(df: DataFrame, factor: int, most: int | None, seed: int, id_col: str = "doc_id") -> DataFrame:
    """``factor`` draws with replacement for each row, at most ``most``: the drawn rows with their ``draw_no``.

    Rows are ranked over the whole table, every draw is a rank, and both meet on it; a rank is drawn
    ``factor`` times on average, so no task gets more than its share, however many rows and draws there are.
    """
    spark = df.sparkSession
    rows = ranked(df, [id_col], "place")
    total = rows.count()
    wanted = total * factor if most is None else min(total * factor, most)
    number = F.col("id").alias("draw_no")
    draws = spark.range(wanted).select(number, F.pmod(wide_draw(seed, "draw", F.col("id")), F.lit(max(1, total))).alias("place"))
    return rows.join(draws, "place").drop("place")


def augment_minority(
    df: DataFrame, synonyms: DataFrame | None = None, options: AugmentOptions = AugmentOptions(),
    text_col: str = "text", label_col: str = "label_encoded", id_col: str = "doc_id",
) -> DataFrame:
    """The corpus plus synthetic rows of the rare class (``synthetic`` tells them apart).

    ``factor`` draws for each rare row, all of them unless ``max_samples`` says otherwise; a draw that its
    technique leaves as it was adds nothing.
    """
    marked = df.withColumn("synthetic", F.lit(False))
    if not options.augment_minority:
        return marked
    rare = df.filter(F.col(label_col) == options.minority_label)
    drawn = stored(draw_rows(rare, options.factor, options.max_samples, options.seed, id_col), "drawn")
    varied = _varied(drawn, options, synonyms, text_col, id_col)
    return marked.unionByName(varied.drop("draw_no").withColumn("synthetic", F.lit(True)))


def augment_variants(
    df: DataFrame, k: int = 3, synonyms: DataFrame | None = None,
    options: AugmentOptions = AugmentOptions(), text_col: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """Up to ``k`` variants of every text, numbered by ``draw_no``."""
    drawn = df.withColumn("draw_no", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return _varied(drawn, options, synonyms, text_col, id_col)


def class_balance(df: DataFrame, label_col: str = "label_encoded", minority: int = 1) -> DataFrame:
    rare = F.count_if(F.col(label_col) == minority)
    rest = F.count_if(F.col(label_col) != minority)
    return df.agg(
        rest.alias("majority"), rare.alias("minority"), (rare / F.greatest(rest, F.lit(1))).alias("ratio")
    )
