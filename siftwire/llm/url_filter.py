"""Address filter: a list of host and path rules, and association rules mined from labelled addresses."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwire.llm.common import stored

#: Labelled addresses that are mined at most, picked by a hash of the id.
FIT_ROWS = 200_000
#: Rules of the query: (verdict, host and path). Fixed values.
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
BLOCK = "=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest of ``rules`` (verdict, host/path) that fits, as struct<rule, verdict>, else null.

    A rule fits its host and all its subdomains where the path starts with the rule's.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def url_tokens(url: Column) -> Column:
    """Distinct parts of an address: scheme, host labels, path parts without digits, ending, query names, fragment."""
    text = F.coalesce(url, F.lit(""))
    host, path = host_of(text), path_of(text)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)

    def named(kind: str, parts: Column) -> Column:
        kept = F.filter(parts, lambda x: (x != "") & ~x.rlike(r"^\d+$"))
        return F.transform(kept, lambda x: F.concat(F.lit(kind), x))

    return F.array_distinct(
        F.concat(
            named("scheme:", F.array(F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))),
            named("host:", F.split(host, r"\.")),
            named("path:", F.split(F.lower(F.regexp_replace(path, r"\.\w+$", "")), "/")),
            named("ending:", F.array(F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)))),
            named("query:", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^[^=]*", 0))),
            named("fragment:", F.array(F.regexp_extract(text, r"#(.*)$", 1))),
        )
    )


@dataclass
class MinedRules:
    """Rules (items, key, confidence, support) that block, and ``classes`` (item, token): tokens of one item always occur together.

    An address fits a rule if it has a token of each of its items; ``key`` is the item that the fewest addresses have.
    """

    table: DataFrame
    classes: DataFrame

    def judge(self, pages: DataFrame, tokens: str, name: str) -> DataFrame:
        """``pages`` with ``name``: confidence, support and tokens of the best rule whose items all occur, else null.

        Distinct token lists meet the rules' inverted index, one row for each key, at the tokens of the key;
        an address meets a rule once. Repeated addresses are judged once and joined back.
        """
        index = self.table.groupBy("key").agg(F.collect_list(F.struct("confidence", "support", "items")).alias("rules"))
        lists = pages.select(F.col(tokens).alias("__list")).distinct()
        items = lists.select("__list", F.explode("__list").alias("token")).join(self.classes, "token")
        items = items.groupBy("__list").agg(F.collect_set("item").alias("own"))
        met = items.select("__list", "own", F.explode("own").alias("key")).join(index, "key")
        fits = F.array_max(F.filter("rules", lambda r: F.size(F.array_except(r["items"], F.col("own"))) == 0))
        best = met.select("__list", fits.alias("fit")).groupBy("__list").agg(F.max("fit").alias("fit"))
        told = best.filter("fit is not null").select("__list", F.struct("fit.confidence", "fit.support", F.col("fit.items").alias("tokens")).alias(name))
        return pages.join(told, F.col(tokens) == F.col("__list"), "left").drop("__list")


def _needed(sets: DataFrame) -> DataFrame:
    """Rules of ``sets`` (items, confidence, support, rule) that no part of their items makes with the same confidence or more.

    What the parts of a set reach at most follows level by level from its parts of one item less, all of
    which are frequent with it. So a set of n items looks at n rows, and no rule is compared with all others.
    """
    deepest = sets.agg(F.max(F.size("items"))).first()[0] or 0
    reached = F.greatest(F.when(F.col("rule"), F.col("confidence")).otherwise(0.0), F.col("below"))
    level = stored(sets.filter("size(items) = 1").withColumn("below", F.lit(0.0)), "url-level")
    kept = [level]
    for n in range(2, deepest + 1):
        parts = sets.filter(F.size("items") == n).withColumn("part", F.explode(F.transform("items", lambda x: F.array_remove("items", x))))
        less = level.select(F.col("items").alias("part"), reached.alias("reached"))
        below = parts.join(less, "part").groupBy("items", "confidence", "support", "rule").agg(F.max("reached").alias("below"))
        level = stored(below, "url-level")
        kept.append(level)
    return reduce(DataFrame.unionByName, kept).filter(F.col("rule") & (F.col("confidence") > F.col("below")))


def mine_rules(
    labelled: DataFrame, tokens: str = "tokens", label: str = "label", min_support: float = 0.002, min_rows: int = 10,
    min_confidence: float = 0.6, min_lift: float = 1.5,
) -> MinedRules:
    """Association rules tokens -> block of the labelled rows (``label``: 1 block, 0 allow), by FP-growth.

    A rule needs ``min_support`` of the rows and ``min_rows`` of them, its confidence and lift; one
    that a part of its tokens makes with the same confidence or more is pruned, and every other is kept. Tokens that occur
    in the same rows are one item, so a family of tokens that a template puts together counts as one. Without rows, or
    without any to block, there are no rules.
    """
    spark = labelled.sparkSession
    shape, class_shape = "items array<string>, key string, confidence double, support double", "item string, token string"
    rows = labelled.filter(F.col(label).isin(0, 1)).select(F.col(tokens).alias("tokens"), F.col(label).alias("label"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "url-labels")
    total = rows.count()
    blocked = rows.filter("label = 1").count()
    if not blocked:
        return MinedRules(spark.createDataFrame([], shape), spark.createDataFrame([], class_shape))
    least = max(min_support * total, min_rows)
    uses = rows.select("row", F.explode(F.array_distinct("tokens")).alias("token"))
    marks = [F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(38,0)")).alias(f"mark{seed}") for seed in (1, 2)]
    often = uses.groupBy("token").agg(F.count("*").alias("uses"), *marks).filter(F.col("uses") >= least)
    same = Window.partitionBy("uses", "mark1", "mark2")  # one row for each frequent token
    classes = stored(often.select(F.min("token").over(same).alias("item"), "token", "uses"), "url-classes")
    of_items = uses.join(classes.filter("item = token").select("token"), "token").groupBy("row").agg(F.collect_list("token").alias("items"))
    items = rows.join(of_items, "row", "left").select(
        F.concat(F.coalesce("items", F.array().cast("array<string>")), F.when(F.col("label") == 1, F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items")
    )
    found = FPGrowth(itemsCol="items", minSupport=least / total).fit(items).freqItemsets
    found = stored(found.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    with_block = found.filter(F.array_contains("items", BLOCK) & (F.size("items") > 1))
    with_block = with_block.select(F.array_remove("items", BLOCK).alias("items"), F.col("freq").alias("hits"))
    sets = with_block.join(found, "items").select(
        "items", (F.col("hits") / F.col("freq")).alias("confidence"), (F.col("hits") / F.lit(total)).alias("support")
    )
    is_rule = (F.col("confidence") >= min_confidence) & (F.col("confidence") / (blocked / total) >= min_lift)
    rules = stored(_needed(stored(sets.withColumn("rule", is_rule), "url-sets")), "url-rules")
    rarest = (
        rules.select("items", F.explode("items").alias("token")).join(classes.select("token", "uses"), "token")
        .groupBy("items").agg(F.min(F.struct("uses", "token")).alias("least"))
    )
    keyed = rules.join(rarest, "items").select("items", F.col("least.token").alias("key"), "confidence", "support")
    return MinedRules(stored(keyed, "url-index"), classes.select("item", "token"))


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url",
    row_id: str = "page_id", label_id: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS, **mining,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict, mined_tokens and mined_confidence of every address.

    The verdict is that of the longest listed rule that fits, else block where a mined rule fits,
    else allow. Rules are mined from the pages whose id has a label (0: block, 1: allow), at most
    about ``fit_rows`` of them. A null address, or one without ``://``, has an empty host and path.
    Null ids have no label; of repeated labels of an id the smaller counts; repeated pages are each
    judged. Columns of ``pages`` named like a result are replaced.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(label_id).isNotNull()).groupBy(label_id).agg(
        (1 - F.min(label)).cast("int").alias("label")
    )
    n = known.count()
    if n > fit_rows:
        known = known.filter(F.pmod(F.xxhash64(F.lit(5), label_id), F.lit(n)) < fit_rows)
    address = pages.select(F.col(row_id).alias("id"), url_tokens(F.col(url)).alias("tokens"))
    mined = mine_rules(address.join(known.withColumnRenamed(label_id, "id"), "id").select("tokens", "label"), **mining)

    host, path = host_of(F.col(url)), path_of(F.col(url))
    results = ("host", "path", "rule", "verdict", "mined_tokens", "mined_confidence")
    rows = pages.drop(*[c for c in results if c != url]).withColumn("__tokens", url_tokens(F.col(url)))
    rows = mined.judge(rows, "__tokens", "__mined").withColumns({"__listed": listed_rule(host, path, rules), "host": host, "path": path})
    mined_verdict = F.when(F.col("__mined").isNotNull(), "block").otherwise("allow")
    return rows.withColumns(
        {
            "rule": F.col("__listed.rule"),
            "verdict": F.coalesce("__listed.verdict", mined_verdict),
            "mined_tokens": F.col("__mined.tokens"),
            "mined_confidence": F.col("__mined.confidence"),
        }
    ).drop("__tokens", "__mined", "__listed")


def url_digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    judged = judge_urls(pages.select("page_id", "url"), labels)
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_tokens", "mined_confidence")
