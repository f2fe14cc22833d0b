"""ANSI SQL twins of the catalog queries, for a second engine to check results against.

Patterns are written for an engine without look-around and back-references, word lists come
from the same fixed values.
"""

from __future__ import annotations

from siftwire.functions import wordlists as W
from siftwire.functions.tokens import NormalizeOptions
from siftwire.operators import event_metrics as M
from siftwire.operators.lexicon import DETACHMENT, IRREGULAR, STEP_2, STEP_3, STEP_4, lexicon_rows
from siftwire.plans.catalog import AS_OF, RATE_LIMIT, RATE_WINDOW, SYNONYMS, USER

WS = r"\t\n\x0b\f\r\x1c-\x20\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
TLD = "com|org|net|edu|gov|io|co|uk|in|ai|app|dev|xyz"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(words) -> str:
    return ", ".join(q(w) for w in words)


URL = q(
    rf"""(?i)(?:https?://|ftp://|www\.)[^{WS}<>"')\]]*|[{WORD}.\-]+\.(?:{TLD})[^{WS}<>"')\]]*"""
)
EMAIL = q(r"(?i)[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}")
PHONE = q(
    rf"(?:\+?\p{{Nd}}{{1,3}}[-.{WS}]?)?(?:\(?\p{{Nd}}{{1,4}}\)?[-.{WS}]?)?\p{{Nd}}{{3,4}}[-.{WS}]?\p{{Nd}}{{3,4}}"
)
EMOJI = q(
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}"
    r"\x{24C2}-\x{1F251}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}"
    r"\x{FE00}-\x{FE0F}]+"
)
CURRENCY = q(
    rf"(?i)[$£€₹¥][{WS}]?\p{{Nd}}+(?:[.,]\p{{Nd}}+)*"
    rf"|\p{{Nd}}+(?:[.,]\p{{Nd}}+)*[{WS}]?(?:dollars?|pounds?|euros?|rupees?|rs\.?|usd|gbp|eur|inr)"
)
NUMBER = q(r"\b\p{Nd}+(?:[.,]\p{Nd}+)*\b")
SPECIAL = q(rf"""[^a-zA-Z0-9{WS}.,!?;:'"\-]""")


def sub(x: str, pattern: str, token: str) -> str:
    return f"regexp_replace({x}, {pattern}, {q(token)}, 'g')"


def spaces(x: str) -> str:
    return f"trim({sub(x, q(f'[{WS}]+'), ' ')})"


def squeeze_select(table: str, key: str, column: str, out: str) -> str:
    """Characters by position; the third and later of a run fall out."""
    return (
        f"SELECT {key}, coalesce(array_to_string(list_transform(list_filter(list_zip(cs, ps, pps), "
        f"lambda r: NOT coalesce(r[1] = r[2] AND r[1] = r[3] AND r[1] <> chr(10), false)), lambda r: r[1]), ''), '') AS {out} "
        f"FROM (SELECT {key}, cs, list_prepend(NULL, cs)[1:len(cs)] AS ps, "
        f"list_prepend(NULL, list_prepend(NULL, cs))[1:len(cs)] AS pps "
        f"FROM (SELECT {key}, string_split({column}, '') AS cs FROM {table}))"
    )


def masked(x: str, numbers: bool = True) -> str:
    x = sub(x, q("<[^>]+>"), " ")
    x = f"strip_accents({x})"
    x = sub(x, URL, " __URL__ ")
    x = sub(x, EMAIL, " __EMAIL__ ")
    x = sub(x, PHONE, " __PHONE__ ")
    x = sub(x, EMOJI, " __EMOJI__ ")
    x = sub(x, CURRENCY, " __CURRENCY__ ")
    return sub(x, NUMBER, " __NUM__ ") if numbers else x


def clean_ctes(table: str, key: str, keep: str = "", name: str = "clean") -> str:
    """CTEs ending in ``name(key, keep, cleaned)``."""
    extra = f", {keep}" if keep else ""
    head = f"{key}{extra}"
    lower = sub(f"lower({masked('coalesce(text, %s)' % q(''))})", SPECIAL, " ")
    return (
        f"{name}_a AS (SELECT {head}, {lower} AS t FROM {table}), "
        f"{name}_b AS ({squeeze_select(f'{name}_a', head, 't', 't')}), "
        f"{name} AS (SELECT {head}, {spaces('t')} AS cleaned FROM {name}_b)"
    )


TOKENS = rf"regexp_extract_all(cleaned, {q(rf'[{WORD}]+(?:' + chr(39) + rf'[{WORD}]+)?')})"
SLANG_MAP = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in NormalizeOptions().dictionary().items()) + "}"
STOP = names(NormalizeOptions().stop_list())


def slang(tokens: str) -> str:
    return f"list_transform({tokens}, lambda t: coalesce({SLANG_MAP}[t], t))"


def normal(tokens: str) -> str:
    return (
        f"list_filter({slang(f'list_transform({tokens}, lambda s: lower(s))')}, "
        f"lambda t: length(t) BETWEEN 2 AND 50 AND t NOT IN ({STOP}))"
    )


def text_ctes(table: str, key: str, keep: str = "", name: str = "ready") -> str:
    """CTEs ending in ``name(key, keep, tokens, final)``."""
    extra = f", {keep}" if keep else ""
    return (
        f"{clean_ctes(table, key, keep, name + '_c')}, "
        f"{name} AS (SELECT {key}{extra}, tokens, array_to_string(tokens, ' ') AS final FROM "
        f"(SELECT {key}{extra}, {normal(TOKENS)} AS tokens FROM {name}_c))"
    )


CORPUS = (
    "corpus AS (SELECT d.doc_id, d.text, CASE WHEN l.toxic = 1 THEN 'spam' ELSE 'ham' END AS label, "
    "l.toxic AS label_encoded FROM documents d JOIN labels l USING (doc_id))"
)
DEDUPED = "deduped AS (SELECT * FROM corpus QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)"
CHAT = "chat AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"
LOG = (
    "log AS (SELECT event_id AS id, user_id, CASE WHEN p >= 0.5 THEN 'spam' ELSE 'ham' END AS prediction, "
    "greatest(p, 1 - p) AS confidence, p AS spam_probability, event_type AS model_used, "
    "value AS processing_time_ms, ts AS created_at FROM (SELECT *, value / (value + 50) AS p FROM events))"
)
SCORED = (
    f"{LOG}, scored AS (SELECT model_used AS model, CAST(user_id % 3 = 0 AS INTEGER) AS y, "
    "CAST(prediction = 'spam' AS INTEGER) AS yhat, spam_probability AS score FROM log)"
)
REQUESTS = (
    "requests AS (SELECT event_id, user_id AS client, ts, CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END "
    "AS method, event_type AS endpoint, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, "
    "value / 1000 AS duration FROM events)"
)
FEEDBACK = (
    "batch AS (SELECT id, prediction_id, CASE WHEN base % 3 = 0 THEN 'spam' ELSE 'ham' END AS correct_label, user_id FROM ("
    "SELECT id, id AS prediction_id, id AS base, user_id FROM log WHERE id % 10 = 0 UNION ALL "
    "SELECT id + 2000000000, id, id, user_id FROM log WHERE id % 20 = 0 UNION ALL "
    "SELECT id + 3000000000, id + 1000000000, id, user_id FROM log WHERE id % 50 = 0)), "
    "stored AS (SELECT id + 5000000000 AS id, id AS prediction_id, user_id, "
    "CASE WHEN id % 3 = 0 THEN 'spam' ELSE 'ham' END AS correct_label, created_at FROM log WHERE id % 30 = 0)"
)
USERS = "users AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 5 <> 0)"


def allocate(counts: str, share: str, name: str) -> str:
    return (
        f"{name}_a AS (SELECT label, n, sum(n) OVER () - ceil(sum(n) OVER () * {share}) AS wanted, "
        f"n * (sum(n) OVER () - ceil(sum(n) OVER () * {share})) / (sum(n) OVER ()) AS exact FROM {counts}), "
        f"{name} AS (SELECT label, n, CAST(floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, label) "
        f"<= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS kept FROM {name}_a)"
    )


def split_ctes(stratify: bool = True) -> str:
    label = "label_encoded" if stratify else "0"
    return (
        f"WITH {CORPUS}, counts AS (SELECT {label} AS label, count(*) AS n FROM corpus GROUP BY 1), "
        f"{allocate('counts', '0.2', 'tv')}, tvn AS (SELECT label, kept AS n FROM tv), "
        f"{allocate('tvn', '(0.1 / (1 - 0.2))', 'tr')}, "
        f"placed AS (SELECT doc_id, label_encoded, {label} AS label, row_number() OVER (PARTITION BY {label} "
        "ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place FROM corpus), "
        "split AS (SELECT p.doc_id, p.label_encoded, CASE WHEN p.place >= tr.n THEN 'test' WHEN p.place >= tr.kept "
        "THEN 'val' ELSE 'train' END AS split FROM placed p JOIN tr USING (label))"
    )


# ---- features and naive Bayes ----

FEATURE_WORDS = rf"regexp_extract_all(%s, {q(rf'[{WORD}]{{2,}}')})"


def count_ctes(source: str, text: str, keep: str = "", name: str = "counts") -> str:
    extra = f", {keep}" if keep else ""
    return (
        f"{name}_w AS (SELECT doc_id{extra}, {FEATURE_WORDS % text} AS w FROM {source}), "
        f"{name}_t AS (SELECT doc_id{extra}, unnest(list_concat(w, list_transform(range(1, len(w)), "
        f"lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {name}_w), "
        f"{name} AS (SELECT doc_id{extra}, term, count(*) AS tf FROM {name}_t GROUP BY ALL)"
    )


def vocabulary_ctes(min_df: str = "2", max_df: str = "0.95", limit: int = 50000) -> str:
    return (
        "freq AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS corpus_tf FROM counts GROUP BY term), "
        "total AS (SELECT count(*) AS n FROM corpus), "
        f"kept AS (SELECT freq.* FROM freq, total WHERE df >= {min_df} AND df <= CAST({max_df} AS DOUBLE) * n "
        f"ORDER BY corpus_tf DESC, term LIMIT {limit}), "
        "voc AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, df, corpus_tf, "
        "ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM kept, total)"
    )


FIT = (
    f"WITH {CORPUS}, {text_ctes('corpus', 'doc_id', 'label_encoded')}, "
    f"{count_ctes('ready', 'final', 'label_encoded')}, {vocabulary_ctes()}"
)
TFIDF = (
    "weighed AS (SELECT c.*, v.idx, v.idf, (1.0 + ln(c.tf)) * v.idf AS weight FROM counts c JOIN voc v USING (term)), "
    "tfidf AS (SELECT *, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS tfidf FROM weighed)"
)
BAYES = (
    f"{FIT}, {TFIDF}, sums AS (SELECT v.term, v.idf, "
    "coalesce(sum(t.tfidf) FILTER (WHERE label_encoded = 0), 0.0) AS h, "
    "coalesce(sum(t.tfidf) FILTER (WHERE label_encoded = 1), 0.0) AS s "
    "FROM voc v LEFT JOIN tfidf t USING (term) GROUP BY v.term, v.idf), "
    "model AS (SELECT term, idf, ln(h + 1.0) - ln(sum(h) OVER () + count(*) OVER ()) AS ham_logp, "
    "ln(s + 1.0) - ln(sum(s) OVER () + count(*) OVER ()) AS spam_logp FROM sums), "
    "prior AS (SELECT ln(avg(label_encoded)) - ln(1 - avg(label_encoded)) AS gain FROM corpus)"
)


def bayes_scores(table: str, name: str = "scores") -> str:
    """CTEs ending in ``name(doc_id, spam, ham)`` for every message of ``table``."""
    return (
        f"{text_ctes(table, 'doc_id', name='m_ready')}, {count_ctes('m_ready', 'final', name='m_counts')}, "
        "m_dot AS (SELECT doc_id, sum((1.0 + ln(tf)) * idf * (spam_logp - ham_logp)) / "
        "sqrt(sum(((1.0 + ln(tf)) * idf) * ((1.0 + ln(tf)) * idf))) AS dot FROM m_counts JOIN model USING (term) GROUP BY doc_id), "
        f"{name} AS (SELECT r.doc_id, 1.0 / (1.0 + exp(-(coalesce(dot, 0.0) + gain))) AS spam, "
        "1.0 / (1.0 + exp(coalesce(dot, 0.0) + gain)) AS ham FROM m_ready r LEFT JOIN m_dot USING (doc_id), prior)"
    )


KEYWORDS = f"list_filter(tokens, lambda t: lower(t) IN ({names(W.SPAM_KEYWORDS)}))"


def chars(pattern: str, x: str = "text") -> str:
    return f"length(regexp_replace({x}, {q(pattern)}, '', 'g'))"


# Superscript digits count as digits as well.
DIGITS = chars(r"[^\p{Nd}\x{B2}\x{B3}\x{B9}]")
RATIOS = {
    "uppercase_ratio": rf"round({chars(r'[^\p{Lu}]')} / greatest({chars(r'[^\p{L}]')}, 1), 6)",
    "digit_ratio": f"round({DIGITS} / greatest(length(text), 1), 6)",
    "special_char_ratio": f"round({chars(rf'[\p{{L}}\p{{N}}{WS}]')} / greatest(length(text), 1), 6)",
}
FLAGS = {"has_url": URL, "has_email": EMAIL, "has_phone": PHONE, "has_currency": CURRENCY}
FLAG_SQL = ", ".join(f"regexp_matches(text, {p}) AS {k}" for k, p in FLAGS.items())


def step(expression: str, table: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, {expression} AS result FROM {table}"


def token_query(tokens: str) -> str:
    return (
        f"WITH {clean_ctes('documents', 'doc_id')} SELECT doc_id, array_to_string({tokens}, '|') AS tokens FROM clean"
    )


def cells(keys: str = "model") -> str:
    return (
        f"cells AS (SELECT {keys}, count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp, "
        "count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn FROM scored GROUP BY 1)"
    )


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END"


METRICS = (
    f"{cells()}, metrics AS (SELECT model, tp + fp + fn + tn AS n, {ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy, "
    f"{ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM cells)"
)
AUC = (
    "ranks AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY score) + "
    "(count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM scored), "
    "auc AS (SELECT model, coalesce((sum(r) FILTER (WHERE y = 1) - p * (p + 1) / 2.0) / nullif(p * (count(*) - p), 0), 0.0) AS roc_auc "
    "FROM ranks JOIN (SELECT model, CAST(sum(y) AS DOUBLE) AS p FROM scored GROUP BY 1) USING (model) GROUP BY model, p)"
)
CLASSES = (
    "classes AS (SELECT model, 'ham' AS label, tn + fp AS support, "
    f"{ratio('tn', 'tn + fn')} AS precision, {ratio('tn', 'tn + fp')} AS recall, {ratio('2 * tn', '2 * tn + fp + fn')} AS f1 FROM cells UNION ALL "
    f"SELECT model, 'spam', tp + fn, {ratio('tp', 'tp + fp')}, {ratio('tp', 'tp + fn')}, {ratio('2 * tp', '2 * tp + fp + fn')} FROM cells), "
    "present AS (SELECT * FROM classes WHERE support > 0)"
)
LEADER = (
    f"WITH {SCORED}, {METRICS}, {AUC} SELECT model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, "
    "round(recall, 6) AS recall, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc FROM metrics JOIN auc USING (model)"
)
RESULTS = LEADER.replace("SELECT model, round(accuracy", "SELECT model AS model_name, round(accuracy")


def histogram(source: str, table: str, keys: str, value: str, bounds) -> str:
    marks = ", ".join(f"({q(format(b, 'g'))}, CAST({b} AS DOUBLE))" for b in bounds) + ", ('+Inf', 'inf'::DOUBLE)"
    return (
        f"WITH {source}, marks(le, bound) AS (VALUES {marks}), g AS (SELECT {keys}, list({value}) AS vs, count(*) AS total_count, "
        f"round(sum({value}), 6) AS total_sum FROM {table} GROUP BY ALL) "
        f"SELECT {keys}, le, len(list_filter(vs, lambda v: v <= bound)) AS cumulative, total_count, total_sum FROM g, marks"
    )


# ---- draws ----


def draw(*parts: str) -> str:
    """The shared hash rule on SQL expressions; text parts come quoted."""
    joined = " || ':' || ".join(["'42'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT)"


SYN = (
    "syn AS (SELECT word, list_sort(list_distinct(list(synonym))) AS choices FROM (VALUES "
    + ", ".join(f"({q(a)}, {q(b)})" for a, b in SYNONYMS)
    + ") AS s(word, synonym) GROUP BY word)"
)
SPLIT_WORDS = f"list_filter(regexp_split_to_array(text, {q(f'[{WS}]+')}), lambda w: w <> '')"


def technique(name: str, source: str, turn: str, keys: str, out: str) -> str:
    """CTEs ending in ``out(keys, text, new_text)`` for the rows of ``source``."""
    words = f"{out}_w AS (SELECT {keys}, text, {SPLIT_WORDS} AS w FROM {source})"
    if name == "swap":
        a, b = draw("'swap'", "doc_id", turn, "0"), draw("'step'", "doc_id", turn, "0")
        return (
            f"{words}, {out}_i AS (SELECT *, CAST({a} % greatest(len(w), 1) AS INTEGER) AS a, {b} % greatest(len(w) - 1, 1) + 1 AS stp FROM {out}_w), "
            f"{out}_j AS (SELECT *, CAST((a + stp) % greatest(len(w), 1) AS INTEGER) AS b FROM {out}_i), "
            f"{out} AS (SELECT {keys}, text, CASE WHEN len(w) < 2 THEN text ELSE array_to_string(list_transform(range(1, len(w) + 1), "
            f"lambda i: CASE WHEN i - 1 = a THEN w[b + 1] WHEN i - 1 = b THEN w[a + 1] ELSE w[i] END), ' ') END AS new_text FROM {out}_j)"
        )
    if name == "delete":
        u = draw("'drop'", "doc_id", turn, "(i - 1)")
        r = draw("'rescue'", "doc_id", turn)
        return (
            f"{words}, {out}_k AS (SELECT *, list_transform(list_filter(range(1, len(w) + 1), lambda i: {u} / 4294967296.0 > 0.1), lambda i: w[i]) AS k FROM {out}_w), "
            f"{out} AS (SELECT {keys}, text, CASE WHEN len(w) <= 1 THEN text WHEN len(k) = 0 THEN w[{r} % greatest(len(w), 1) + 1] "
            f"ELSE array_to_string(k, ' ') END AS new_text FROM {out}_k)"
        )
    rank, pick = draw("'order'", "doc_id", turn, "(pos - 1)"), draw("'synonym'", "doc_id", turn, "(pos - 1)")
    return (
        f"{words}, {out}_p AS (SELECT {keys}, pos, w[pos] AS token FROM (SELECT {keys}, w, unnest(range(1, len(w) + 1)) AS pos FROM {out}_w)), "
        f"{out}_c AS (SELECT {keys}, pos, choices[{pick} % len(choices) + 1] AS word FROM {out}_p JOIN syn ON lower(token) = syn.word "
        f"WHERE length(token) > 3 QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {rank}, pos) <= 2), "
        f"{out}_m AS (SELECT {keys}, list(pos) AS ps, list(word) AS ws FROM {out}_c GROUP BY ALL), "
        f"{out} AS (SELECT {keys}, text, CASE WHEN len(w) < 2 THEN text ELSE array_to_string(list_transform(range(1, len(w) + 1), "
        f"lambda i: coalesce(ws[list_position(ps, i)], w[i])), ' ') END AS new_text FROM {out}_w LEFT JOIN {out}_m USING ({keys}))"
    )


def varied(source: str, keys: str = "doc_id, draw_no") -> str:
    pick = draw("'technique'", "doc_id", "draw_no")
    parts = [
        f"src{i} AS (SELECT * FROM {source} WHERE {pick} % 3 = {i}), {technique(name, f'src{i}', 'draw_no', keys, f'tech{i}')}"
        for i, name in enumerate(("synonym", "swap", "delete"))
    ]
    union = " UNION ALL ".join(f"SELECT {keys}, text, new_text FROM tech{i}" for i in range(3))
    return (
        f"{SYN}, {', '.join(parts)}, varied AS (SELECT {keys}, new_text AS text FROM ({union}) "
        "WHERE new_text <> '' AND new_text <> text)"
    )


DRAWN = (
    "rare AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM deduped WHERE label_encoded = 1), "
    "sizes AS (SELECT count(*) AS n FROM rare), "
    f"draws AS (SELECT draw_no, {draw(q('draw'), 'draw_no').replace('1, 8', '1, 15')} % n AS place "
    "FROM (SELECT unnest(range(3 * n)) AS draw_no FROM sizes), sizes), "
    "drawn AS (SELECT rare.doc_id, rare.text, draws.draw_no FROM draws JOIN rare USING (place))"
)

NOISE_U = f"({draw(q('char'), 'doc_id', '0', '(i - 1)')} / 4294967296.0 / 0.05)"

ORACLES: dict[str, str] = {
    "read_labelled_tsv": f"WITH {CORPUS} SELECT regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g') AS text, label, label_encoded FROM corpus",
    "read_labelled_csv": f"WITH {CORPUS} SELECT text, label_encoded FROM corpus",
    "encode_label": f"WITH {CORPUS} SELECT doc_id, label_encoded FROM corpus",
    "drop_unknown_labels": f"WITH {CORPUS} SELECT doc_id, label, label_encoded FROM corpus WHERE text IS NOT NULL",
    "unknown_label_counts": "SELECT count(toxic) AS kept, count(*) - count(toxic) AS dropped FROM documents LEFT JOIN labels USING (doc_id)",
    "dedupe_text": f"WITH {CORPUS}, {DEDUPED} SELECT doc_id, label_encoded, md5(text) AS text_md5 FROM deduped",
    "corpus_stats": f"WITH {CORPUS}, {DEDUPED} SELECT count(*) AS total, count(*) FILTER (WHERE label_encoded = 0) AS ham, "
    "count(*) FILTER (WHERE label_encoded = 1) AS spam, round(avg(label_encoded) * 100, 6) AS spam_percent FROM deduped",
    "stratified_split": f"{split_ctes()} SELECT doc_id, label_encoded, split FROM split",
    "random_split": f"{split_ctes(False)} SELECT doc_id, split FROM split",
    "split_summary": f"{split_ctes()} SELECT split, count(*) AS total, count(*) FILTER (WHERE label_encoded = 1) AS spam, "
    "count(*) FILTER (WHERE label_encoded = 0) AS ham, round(avg(label_encoded), 6) AS spam_ratio FROM split GROUP BY split",
    "processed_roundtrip": f"WITH {CORPUS} SELECT doc_id, label, label_encoded, md5(text) AS text_md5 FROM corpus",
    "append_predictions": f"WITH {LOG} SELECT id, strftime(created_at, '%Y-%m-%d') AS day, CASE WHEN id % 2 = 0 THEN 'api' ELSE 'batch' END AS source, "
    "CAST(user_id AS VARCHAR) AS user_id, prediction, round(confidence, 6) AS confidence, round(spam_probability, 6) AS spam_probability, "
    "CAST(NULL AS DOUBLE) AS ham_probability, model_used, round(processing_time_ms, 6) AS processing_time_ms FROM log",
    "benchmark_store": RESULTS,
    "model_benchmarks": RESULTS,
    # The entities that occur in the table; the ampersand comes last, as its result is not read again.
    "html_unescape": "SELECT page_id, regexp_replace(replace(replace(replace(html, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;?', '&', 'g') AS result FROM pages",
    "model_registry": "SELECT * FROM (VALUES ('naive_bayes'), ('logistic_regression')) AS t(model_name)",
    "logistic_regression": f"{split_ctes()} SELECT doc_id, split, label_encoded, true AS adds_up, true AS larger_wins, true AS learned FROM split",
    "linear_svm": f"{split_ctes()} SELECT doc_id, split, label_encoded, true AS adds_up, true AS larger_wins, true AS learned FROM split",
    "random_forest": f"{split_ctes()} SELECT doc_id, split, label_encoded, true AS adds_up, true AS larger_wins, true AS learned FROM split",
    "boosted_trees": f"{split_ctes()} SELECT doc_id, split, label_encoded, true AS adds_up, true AS larger_wins, true AS learned FROM split",
    "boosted_trees_leafwise": f"{split_ctes()} SELECT doc_id, split, label_encoded, true AS adds_up, true AS larger_wins, true AS learned FROM split",
    "model_save_load": "SELECT doc_id, true AS same FROM documents JOIN labels USING (doc_id)",
    "train_all": "SELECT model, true AS fitted, CAST(NULL AS VARCHAR) AS error, true AS ranked, true AS stored FROM (VALUES ('naive_bayes'), "
    "('logistic_regression'), ('svm'), ('random_forest'), ('xgboost'), ('lightgbm')) AS t(model)",
    "scoring_latency": "SELECT model, count(*) AS n, true AS measured FROM documents CROSS JOIN (VALUES ('naive_bayes'), ('logistic_regression')) AS t(model) GROUP BY model",
    "score_two_models": "SELECT conv_id * 1000 + turn AS doc_id, model AS model_used, true AS consistent FROM conversations "
    "CROSS JOIN (VALUES ('naive_bayes'), ('logistic_regression')) AS t(model)",
    "clean_guard": step("coalesce(text, '')"),
    "strip_html_tags": step(sub("html", q("<[^>]+>"), " "), "pages", "page_id"),
    "fold_unicode": step("strip_accents(text)"),
    "mask_urls": step(sub("text", URL, " __URL__ ")),
    "mask_urls_html": step(sub("html", URL, " __URL__ "), "pages", "page_id"),
    "mask_emails": step(sub("text", EMAIL, " __EMAIL__ ")),
    "mask_phones": step(sub("text", PHONE, " __PHONE__ ")),
    "handle_emoji": step(sub("text", EMOJI, " __EMOJI__ ")),
    "mask_currency": step(sub("text", CURRENCY, " __CURRENCY__ ")),
    "mask_numbers": step(sub("text", NUMBER, " __NUM__ ")),
    "lowercase": step("lower(text)"),
    "drop_special_chars": step(sub("text", SPECIAL, " ")),
    "squeeze_repeats": squeeze_select("documents", "doc_id", "text", "result"),
    "squeeze_spaces": step(spaces("text")),
    "min_length": step("CASE WHEN length(text) < 200 THEN '' ELSE text END"),
    "clean_text": f"WITH {clean_ctes('documents', 'doc_id')} SELECT doc_id, cleaned AS cleaned_text FROM clean",
    "clean_chat": f"WITH {CHAT}, a AS (SELECT doc_id, {masked('text', numbers=False)} AS t FROM chat), b AS ({squeeze_select('a', 'doc_id', 't', 't')}), "
    f"c AS (SELECT doc_id, {spaces('t')} AS t FROM b) SELECT doc_id, CASE WHEN length(t) < 40 THEN '' ELSE t END AS cleaned_text FROM c",
    "tokenize_whitespace": f"SELECT doc_id, array_to_string({SPLIT_WORDS}, '|') AS tokens FROM documents",
    "tokenize_regex": token_query(TOKENS),
    "detokenize": f"SELECT doc_id, array_to_string({TOKENS.replace('cleaned', 'text')}, ' ') AS text FROM documents",
    "token_fold": token_query("list_filter(string_split(cleaned, ' '), lambda t: t <> '')"),
    "expand_slang": token_query(slang(TOKENS)),
    "remove_stopwords": token_query(f"list_filter({TOKENS}, lambda t: t NOT IN ({STOP}))"),
    "token_length_filter": token_query(f"list_filter({TOKENS}, lambda t: length(t) BETWEEN 2 AND 50)"),
    "normalize_tokens": token_query(normal(TOKENS)),
    "spam_keywords": f"WITH {text_ctes('documents', 'doc_id')} SELECT doc_id, array_to_string({KEYWORDS}, '|') AS keywords FROM ready",
    "spam_keyword_count": f"WITH {text_ctes('documents', 'doc_id')} SELECT doc_id, len({KEYWORDS}) AS n FROM ready",
    "contact_flags": f"SELECT doc_id, {FLAG_SQL} FROM documents",
    **{k: f"SELECT doc_id, {v} AS {k} FROM documents" for k, v in RATIOS.items()},
    "text_lengths": f"WITH {clean_ctes('documents', 'doc_id', 'text', 'c')} SELECT doc_id, length(text) AS original_length, "
    f"length(cleaned) AS cleaned_length, len({normal(TOKENS)}) AS token_count FROM c",
    "preprocess": f"WITH {clean_ctes('documents', 'doc_id', 'text', 'c')}, n AS (SELECT *, {normal(TOKENS)} AS tokens FROM c) "
    f"SELECT doc_id, cleaned AS cleaned_text, array_to_string(tokens, ' ') AS final_text, array_to_string({KEYWORDS}, '|') AS spam_keywords, "
    f"length(text) AS original_length, length(cleaned) AS cleaned_length, len(tokens) AS token_count, len({KEYWORDS}) AS spam_keyword_count, "
    f"{FLAG_SQL}, " + ", ".join(f"{v} AS {k}" for k, v in RATIOS.items()) + " FROM n",
    "ngram_terms": f"WITH {count_ctes('documents', 'lower(strip_accents(text))')} SELECT doc_id, term, tf FROM counts",
    "char_ngram_terms": f"WITH p AS (SELECT doc_id, regexp_replace(lower(strip_accents(text)), {q(f'[{WS}]{{2,}}')}, ' ', 'g') AS t FROM documents), "
    "g AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, length(t)), lambda i: substring(t, i, 2)), "
    "list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)))) AS term FROM p), "
    "c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL) "
    "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS corpus_tf FROM c GROUP BY term",
    "document_frequency": f"{FIT} SELECT term, df, corpus_tf FROM freq",
    "select_vocabulary": FIT.replace(vocabulary_ctes(), vocabulary_ctes("3", "0.5", 2000)) + " SELECT term, idx, df, corpus_tf FROM voc",
    "idf": f"{FIT} SELECT term, round(idf, 6) AS idf FROM voc",
    "tfidf": f"{FIT}, {TFIDF} SELECT doc_id, term, tf, round(tfidf, 6) AS tfidf FROM tfidf",
    "feature_names": f"{FIT} SELECT idx, term FROM voc",
    "vocabulary_size": f"{FIT} SELECT count(*) AS vocabulary_size FROM voc",
    "top_idf_terms": f"{FIT} SELECT term, round(idf, 6) AS idf FROM voc ORDER BY voc.idf DESC, term LIMIT 20",
    "save_load_vectorizer": f"{FIT} SELECT term, idx, round(idf, 6) AS idf FROM voc",
    "build_vocab": f"WITH {CORPUS}, {text_ctes('corpus', 'doc_id')}, w AS (SELECT unnest(string_split(final, ' ')) AS word FROM ready), "
    "c AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 29998) "
    "SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) + 1 AS INTEGER) AS word_id FROM c UNION ALL SELECT '<PAD>', 0 UNION ALL SELECT '<UNK>', 1",
    "texts_to_sequences": f"WITH {CORPUS}, {text_ctes('corpus', 'doc_id')}, w AS (SELECT unnest(string_split(final, ' ')) AS word FROM ready), "
    "c AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 29998), "
    "v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS code FROM c), "
    f"{text_ctes('documents', 'doc_id', name='m')}, s AS (SELECT doc_id, list_filter(string_split(final, ' '), lambda x: x <> '')[1:256] AS ws FROM m), "
    "e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM s), "
    "k AS (SELECT doc_id, list(coalesce(code, 1) ORDER BY pos) AS codes FROM e LEFT JOIN v USING (word) GROUP BY doc_id) "
    "SELECT s.doc_id, array_to_string(list_resize(coalesce(codes, []), 256, 0), ' ') AS sequence FROM s LEFT JOIN k USING (doc_id)",
    "naive_bayes": f"{BAYES} SELECT term, round(ham_logp, 6) AS ham_logp, round(spam_logp, 6) AS spam_logp FROM model",
    "balanced_weights": f"WITH {CORPUS}, k AS (SELECT label_encoded, count(*) AS n FROM corpus GROUP BY 1) SELECT doc_id, label_encoded, "
    "round((SELECT sum(n) FROM k) / ((SELECT count(*) FROM k) * n), 6) AS weight FROM corpus JOIN k USING (label_encoded)",
    "score_messages": f"{BAYES}, {bayes_scores('documents')} SELECT s.doc_id, CASE WHEN spam >= 0.5 THEN 'spam' ELSE 'ham' END AS prediction, "
    "round(greatest(spam, ham), 6) AS confidence, round(spam, 6) AS spam_probability, round(ham, 6) AS ham_probability, 'naive_bayes' AS model_used, "
    f"length(text) AS original_length, len(tokens) AS token_count, len({KEYWORDS}) AS spam_keyword_count, regexp_matches(text, {URL}) AS has_url, "
    f"{RATIOS['uppercase_ratio']} AS uppercase_ratio FROM scores s JOIN m_ready r USING (doc_id) JOIN documents d USING (doc_id)",
    "score_batch": f"{BAYES}, {CHAT}, {bayes_scores('chat')} SELECT doc_id, CASE WHEN spam >= 0.3 THEN 'spam' ELSE 'ham' END AS prediction, "
    "round(greatest(spam, ham), 6) AS confidence, round(spam, 6) AS spam_probability, 'batch' AS source FROM scores",
    "score_by_model": f"{BAYES}, {CHAT}, {bayes_scores('chat')} SELECT 'naive_bayes' AS model_used, CASE WHEN spam >= 0.5 THEN 'spam' ELSE 'ham' END AS prediction, "
    "count(*) AS n FROM scores GROUP BY ALL",
    "score_stream": f"{BAYES}, {CHAT}, {bayes_scores('chat')} SELECT CAST(s.doc_id AS VARCHAR) AS id, CASE WHEN spam >= 0.5 THEN 'spam' ELSE 'ham' END AS prediction, "
    f"round(spam, 6) AS spam_probability, 'naive_bayes' AS model_used, length(text) AS text_length, len({KEYWORDS}) AS spam_keyword_count, 'api' AS source "
    "FROM scores s JOIN m_ready r USING (doc_id) JOIN chat c USING (doc_id)",
    "flagship": f"{BAYES}, {bayes_scores('documents')} SELECT CASE WHEN spam >= 0.5 THEN 'spam' ELSE 'ham' END AS prediction, count(*) AS messages, "
    "round(avg(greatest(spam, ham)), 6) AS mean_confidence FROM scores GROUP BY ALL",
    "proba_argmax": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), m AS (SELECT vec_id, x, list_max(x) AS top FROM e) "
    "SELECT vec_id, CAST(list_position(x, top) - 1 AS INTEGER) AS label, round(1.0 / list_sum(list_transform(x, lambda v: exp(v - top))), 6) AS top_proba FROM m",
    "validate_requests": "WITH s AS (SELECT *, doc_id % 7 / 5 AS threshold, count(*) OVER (PARTITION BY source) AS n FROM documents) "
    "SELECT doc_id, array_to_string(list_filter([CASE WHEN coalesce(length(text), 0) < 1 THEN 'text_too_short' END, CASE WHEN length(text) > 10000 THEN 'text_too_long' END, "
    "CASE WHEN threshold > 1 THEN 'threshold_range' END, CASE WHEN n > 100 THEN 'batch_too_large' END], lambda v: v IS NOT NULL), '|') AS violations FROM s",
    "classification_metrics": f"WITH {SCORED}, {METRICS} SELECT model, n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, "
    "round(recall, 6) AS recall, round(f1, 6) AS f1 FROM metrics",
    "confusion_matrix": f"WITH {SCORED} SELECT model, y, count(*) FILTER (WHERE yhat = 0) AS predicted_0, count(*) FILTER (WHERE yhat = 1) AS predicted_1 FROM scored GROUP BY ALL",
    "roc_auc": f"WITH {SCORED}, {AUC} SELECT model, round(roc_auc, 6) AS roc_auc FROM auc",
    "per_class_metrics": f"WITH {SCORED}, {cells()}, {CLASSES} SELECT model, label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM present",
    "classification_report": f"WITH {SCORED}, {METRICS}, {CLASSES}, everything AS (SELECT model, label, support, precision, recall, f1 FROM present UNION ALL "
    "SELECT model, 'accuracy', n, NULL, NULL, accuracy FROM metrics UNION ALL "
    "SELECT model, 'macro avg', CAST(sum(support) AS BIGINT), avg(precision), avg(recall), avg(f1) FROM present GROUP BY model UNION ALL "
    "SELECT model, 'weighted avg', CAST(sum(support) AS BIGINT), sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support) "
    "FROM present GROUP BY model) SELECT model, label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM everything",
    "model_leaderboard": LEADER,
    "best_model": f"SELECT * FROM ({LEADER}) ORDER BY f1 DESC, model LIMIT 1",
    "summary": f"WITH {LOG} SELECT count(*) AS total_predictions, count(*) FILTER (WHERE prediction = 'spam') AS total_spam, count(*) FILTER (WHERE prediction <> 'spam') AS total_ham, "
    "round(count(*) FILTER (WHERE prediction = 'spam') / greatest(count(*), 1), 6) AS spam_ratio, round(coalesce(avg(confidence), 0), 6) AS avg_confidence, "
    "round(coalesce(avg(processing_time_ms), 0), 6) AS avg_processing_time_ms, count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00') AS predictions_today, 'lightgbm|logistic_regression|naive_bayes|random_forest|svm|xgboost' AS models_available FROM log",
    "timeline": f"WITH {LOG} SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) FILTER (WHERE prediction = 'ham') AS ham, count(*) FILTER (WHERE prediction = 'spam') AS spam, "
    f"count(*) AS total FROM log WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1",
    "timeline_long": f"WITH {LOG} SELECT strftime(created_at, '%Y-%m-%d') AS date, model_used AS prediction, count(*) AS count FROM log "
    f"WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY ALL",
    "prediction_history": f"WITH {LOG} SELECT id, prediction, round(confidence, 6) AS confidence, model_used, "
    "rtrim(rtrim(strftime(created_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS created_at "
    f"FROM log WHERE user_id = {USER} ORDER BY log.created_at DESC, id LIMIT 20 OFFSET 5",
    "feedback_history": f"WITH {LOG}, {FEEDBACK} SELECT id, prediction_id, correct_label, rtrim(rtrim(strftime(created_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS created_at "
    f"FROM stored WHERE user_id = {USER} ORDER BY stored.created_at DESC, id LIMIT 50",
    "feedback_ingest": f"WITH {LOG}, {FEEDBACK} SELECT b.id, b.prediction_id, b.correct_label, CASE WHEN l.id IS NULL THEN 'not_found' "
    "WHEN s.id IS NOT NULL OR row_number() OVER (PARTITION BY b.prediction_id ORDER BY b.id) > 1 THEN 'duplicate' ELSE 'accepted' END AS status "
    "FROM batch b LEFT JOIN log l ON l.id = b.prediction_id LEFT JOIN stored s ON s.prediction_id = b.prediction_id",
    "key_checks": f"WITH {LOG}, {FEEDBACK}, {USERS} SELECT 'repeated_feedback' AS rule, count(*) AS violations FROM (SELECT prediction_id FROM batch GROUP BY 1 HAVING count(*) > 1) UNION ALL "
    "SELECT 'dangling_feedback', count(*) FROM batch WHERE prediction_id NOT IN (SELECT id FROM log) UNION ALL "
    "SELECT 'dangling_user', count(*) FROM log WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT id FROM users)",
    "clear_missing_users": f"WITH {LOG}, {USERS} SELECT log.id, users.id AS user_id FROM log LEFT JOIN users ON users.id = log.user_id",
    "cascade_delete": f"WITH {LOG}, {FEEDBACK} SELECT id, prediction_id FROM batch WHERE prediction_id IN (SELECT id FROM log WHERE id % 4 <> 0)",
    "point_lookup": f"WITH {LOG} SELECT id, user_id, prediction, round(confidence, 6) AS confidence FROM log WHERE id = 77",
    "prediction_counts": f"WITH {LOG} SELECT model_used, prediction, count(*) AS count FROM log GROUP BY ALL",
    "latency_histogram": histogram(LOG, "log", "model_used", "processing_time_ms", M.LATENCY_MS),
    "confidence_histogram": histogram(LOG, "log", "model_used, prediction", "confidence", M.CONFIDENCE),
    "request_counts": f"WITH {REQUESTS} SELECT method, endpoint, status, count(*) AS count FROM requests GROUP BY ALL",
    "request_duration_histogram": histogram(REQUESTS, "requests", "method, endpoint", "duration", M.REQUEST_SECONDS),
    "model_load_histogram": histogram(
        f"{LOG}, loads AS (SELECT model_used, processing_time_ms / 10 AS load_seconds FROM log)", "loads", "model_used", "load_seconds", M.LOAD_SECONDS
    ),
    "metrics_batch": histogram(
        f"{REQUESTS}, wr AS (SELECT *, CAST(floor(epoch_us(ts) / 15000000) AS BIGINT) * 15 AS window_start FROM requests)",
        "wr", "window_start, endpoint", "duration", M.REQUEST_SECONDS,
    ),
    "metrics_stream": histogram(
        f"{REQUESTS}, wr AS (SELECT *, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600 AS window_start FROM requests)",
        "wr", "window_start, endpoint", "duration", M.REQUEST_SECONDS,
    ),
    "in_flight_gauge": f"WITH {REQUESTS}, c AS (SELECT epoch_us(ts) AS a, 1 AS d FROM requests UNION ALL SELECT epoch_us(ts) + CAST(round(duration * 100000 * 1000000) AS BIGINT), -1 FROM requests), "
    "n AS (SELECT CAST(floor(a / 3600000000) AS BIGINT) AS slot, CAST(sum(d) AS BIGINT) AS net_change FROM c GROUP BY 1) "
    "SELECT slot * 3600 AS window_start, net_change, CAST(sum(net_change) OVER (ORDER BY slot) AS BIGINT) AS in_flight FROM n",
    "rate_limit": "WITH RECURSIVE ordered AS (SELECT user_id AS client, event_id, epoch_us(ts) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), "
    "walk AS (SELECT client, event_id, k, true AS admitted, [a] AS recent FROM ordered WHERE k = 1 UNION ALL "
    "SELECT o.client, o.event_id, o.k, o.live < {limit}, CASE WHEN o.live < {limit} THEN list_append(o.kept, o.a) ELSE o.kept END FROM ("
    "SELECT n.*, list_filter(w.recent, lambda x: n.a - x < {width}) AS kept, len(list_filter(w.recent, lambda x: n.a - x < {width})) AS live "
    "FROM walk w JOIN ordered n ON n.client = w.client AND n.k = w.k + 1) o) "
    "SELECT client, event_id, admitted, CAST(CASE WHEN admitted THEN {limit} - len(recent) ELSE 0 END AS INTEGER) AS remaining FROM walk".format(
        limit=RATE_LIMIT, width=RATE_WINDOW * 1_000_000
    ),
    "synonym_replace": f"WITH {SYN}, {technique('synonym', 'documents', '0', 'doc_id', 'done')} SELECT doc_id, new_text AS text FROM done",
    "random_swap": f"WITH {technique('swap', 'documents', '0', 'doc_id', 'done')} SELECT doc_id, new_text AS text FROM done",
    "random_delete": f"WITH {technique('delete', 'documents', '0', 'doc_id', 'done')} SELECT doc_id, new_text AS text FROM done",
    "random_insert": f"WITH {SYN}, w AS (SELECT doc_id, text, {SPLIT_WORDS} AS w FROM documents), "
    f"p AS (SELECT *, lower(w[{draw(q('source'), 'doc_id', '0', '0')} % greatest(len(w), 1) + 1]) AS picked FROM w), "
    f"j AS (SELECT p.*, choices[{draw(q('synonym'), 'doc_id', '0', '0')} % len(choices) + 1] AS word, "
    f"{draw(q('place'), 'doc_id', '0', '0')} % (len(w) + 1) AS place FROM p LEFT JOIN syn ON syn.word = picked) "
    "SELECT doc_id, CASE WHEN len(w) = 0 THEN text WHEN word IS NULL THEN array_to_string(w, ' ') "
    "ELSE array_to_string(list_concat(list_concat(w[1:place], [word]), w[place + 1:]), ' ') END AS text FROM j",
    "char_noise": f"WITH c AS (SELECT doc_id, string_split(text, '') AS cs FROM documents) SELECT doc_id, array_to_string(list_transform(range(1, len(cs) + 1), lambda i: "
    f"CASE WHEN {NOISE_U} >= 1 THEN cs[i] WHEN {NOISE_U} * 3 < 1 THEN CASE WHEN regexp_matches(cs[i], '\\p{{L}}') THEN CASE WHEN cs[i] = 'ß' THEN 'SS' WHEN upper(cs[i]) = cs[i] THEN lower(cs[i]) ELSE upper(cs[i]) END ELSE cs[i] END "
    f"WHEN {NOISE_U} * 3 < 2 THEN cs[i] || cs[i] ELSE '' END), '') AS text FROM c",
    "augment_minority": f"WITH {CORPUS}, {DEDUPED}, {DRAWN}, {varied('drawn')} SELECT doc_id, label_encoded, false AS synthetic, text FROM deduped UNION ALL "
    "SELECT doc_id, 1, true, text FROM varied",
    "augment_variants": f"WITH drawn AS (SELECT doc_id, text, unnest(range(1, 4)) AS draw_no FROM documents), {varied('drawn')} SELECT doc_id, draw_no, text FROM varied",
    "class_balance": f"WITH {CORPUS} SELECT count(*) FILTER (WHERE label_encoded <> 1) AS majority, count(*) FILTER (WHERE label_encoded = 1) AS minority, "
    "round(count(*) FILTER (WHERE label_encoded = 1) / greatest(count(*) FILTER (WHERE label_encoded <> 1), 1), 6) AS ratio FROM corpus",
}
ORACLES["rate_limit_stream"] = ORACLES["rate_limit"]

_LEXICON, _EXCEPTIONS = lexicon_rows()
_RULES = [(pos, i + 1, suffix, ending) for pos, pairs in DETACHMENT.items() for i, (suffix, ending) in enumerate(pairs)]


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


ORACLES |= {
    "lemmatize": f"""
        WITH lexicon AS (SELECT * FROM {_values(_LEXICON)} t(lemma, pos)), exceptions AS (SELECT * FROM {_values(_EXCEPTIONS)} t(form, pos, lemma)),
        rules AS (SELECT * FROM {_values(_RULES)} t(pos, n, suffix, ending)),
        lists AS (SELECT doc_id, list_transform({TOKENS.replace('cleaned', "coalesce(text, '')")}, lambda t: lower(t)) AS tokens FROM documents),
        forms AS (SELECT DISTINCT unnest(tokens) AS form FROM lists),
        ruled AS (SELECT form, pos, n, left(form, length(form) - length(rules.suffix)) || ending AS lemma FROM forms JOIN rules ON ends_with(form, rules.suffix)
                  UNION ALL SELECT form, pos, 0, form FROM forms CROSS JOIN (VALUES ('n'), ('v')) t(pos)),
        spread AS (SELECT * FROM ruled WHERE (form, pos) NOT IN (SELECT (form, pos) FROM exceptions)
                   UNION ALL SELECT form, pos, 1, lemma FROM exceptions SEMI JOIN forms USING (form)
                   UNION ALL SELECT form, pos, 0, form FROM exceptions SEMI JOIN forms USING (form)),
        best AS (SELECT form, pos, arg_min(lemma, (length(lemma), n, lemma)) AS lemma FROM spread SEMI JOIN lexicon USING (lemma, pos) GROUP BY form, pos),
        lemmas AS (SELECT * FROM best WHERE lemma <> form),
        cells AS (SELECT doc_id, unnest(tokens) AS form, unnest(range(len(tokens))) AS i FROM lists),
        verbs AS (SELECT doc_id, i, coalesce(lemma, cells.form) AS form FROM cells LEFT JOIN (FROM lemmas WHERE pos = 'v') v ON v.form = cells.form),
        nouns AS (SELECT doc_id, i, coalesce(lemma, verbs.form) AS word FROM verbs LEFT JOIN (FROM lemmas WHERE pos = 'n') n ON n.form = verbs.form)
        SELECT lists.doc_id, coalesce(string_agg(word, '|' ORDER BY i), '') AS tokens FROM lists LEFT JOIN nouns USING (doc_id) GROUP BY lists.doc_id
    """,
    "tokenize_by_name": f"SELECT doc_id, 'regex' AS name, array_to_string({TOKENS.replace('cleaned', "coalesce(text, '')")}, '|') AS tokens FROM documents "
    f"UNION ALL SELECT doc_id, 'whitespace', array_to_string({SPLIT_WORDS}, '|') FROM documents",
    "file_checksums_written": "SELECT lang, strlen(content) AS length, sha256(content) AS sha256 FROM (SELECT lang, "
    "string_agg(doc_id || ' ' || strlen(text) || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY lang)",
    "scored_log_summary": "SELECT count(*) AS total_predictions, count(*) AS predictions_today, true AS timed FROM conversations",
    "explain_errors": "SELECT item_id, starts_with(text, 'A') AS failed, NOT starts_with(text, 'A') AS explained FROM benchmark",
}


def _shape(w: str) -> str:
    return f"regexp_replace({w}, '(^|[aeiou])y', '\\1Y', 'g')"


_CONSONANTS = "bcdfghjklmnpqrstvwxzY"


def _measured(w: str, least: int) -> str:
    return f"regexp_matches({_shape(w)}, '^[^aeiouy]*([aeiouy]+[{_CONSONANTS}]+){{{least + 1},}}')"


def _vowel(w: str) -> str:
    return f"regexp_matches({_shape(w)}, '[aeiouy]')"


def _short(w: str) -> str:
    return f"regexp_matches({_shape(w)}, '[{_CONSONANTS}][aeiouy][bcdfghjklmnpqrstvz]$|^[aeiouy][{_CONSONANTS}]$')"


def _cut(w: str, suffix: str) -> str:
    return f"left({w}, length({w}) - {len(suffix)})"


def _by_longest(w: str, rules: list[tuple]) -> str:
    parts = [
        f"WHEN ends_with({w}, '{suffix}') THEN CASE WHEN {holds(_cut(w, suffix))} THEN {_cut(w, suffix)} || '{end}' ELSE {w} END"
        for suffix, end, holds in sorted(rules, key=lambda r: -len(r[0]))
    ]
    return f"CASE {' '.join(parts)} ELSE {w} END"


def _stem_steps() -> list[str]:
    """Each step of the stemmer as an expression over ``w``; the second also reads ``bare``, which the first of its pair makes."""
    doubled = "|".join(c * 2 for c in _CONSONANTS)
    plain = f"regexp_matches({_shape('bare')}, '({doubled})$')"
    tidy = (
        "CASE WHEN ends_with(bare, 'at') OR ends_with(bare, 'bl') OR ends_with(bare, 'iz') THEN bare || 'e' "
        f"WHEN {plain} AND NOT regexp_matches(bare, '[lsz]$') THEN left(bare, length(bare) - 1) "
        f"WHEN NOT {_measured('bare', 1)} AND {_measured('bare', 0)} AND {_short('bare')} THEN bare || 'e' ELSE bare END"
    )
    above = lambda n: lambda stem: _measured(stem, n)
    longer = lambda stem: _measured(f"({stem} || 'l')", 0)
    ion = lambda stem: f"{_measured(stem, 1)} AND regexp_matches({stem}, '[st]$')"
    no_y, no_e, no_l = _cut("w", "y"), _cut("w", "e"), _cut("w", "l")
    return [
        f"CASE WHEN ends_with(w, 'ies') AND length(w) = 4 THEN {_cut('w', 'ies')} || 'ie' WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut('w', 'es')} "
        f"WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {_cut('w', 's')} ELSE w END",
        f"CASE WHEN ends_with(w, 'ied') THEN {_cut('w', 'ied')} || CASE WHEN length(w) = 4 THEN 'ie' ELSE 'i' END "
        f"WHEN ends_with(w, 'eed') THEN CASE WHEN {_measured(_cut('w', 'eed'), 0)} THEN {_cut('w', 'd')} ELSE w END WHEN bare IS NOT NULL THEN {tidy} ELSE w END",
        f"CASE WHEN ends_with(w, 'y') AND length({no_y}) > 1 AND regexp_matches({_shape(no_y)}, '[{_CONSONANTS}]$') THEN {no_y} || 'i' ELSE w END",
        f"CASE WHEN ends_with(w, 'alli') AND {_measured(_cut('w', 'alli'), 0)} THEN {_cut('w', 'li')} ELSE w END",
        _by_longest("w", [(a, b, longer if a == "logi" else above(0)) for a, b in STEP_2]),
        _by_longest("w", [(a, b, above(0)) for a, b in STEP_3]),
        _by_longest("w", [(a, "", ion if a == "ion" else above(1)) for a in STEP_4]),
        f"CASE WHEN ends_with(w, 'e') AND ({_measured(no_e, 1)} OR ({_measured(no_e, 0)} AND NOT {_short(no_e)})) THEN {no_e} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_measured(no_l, 1)} THEN {no_l} ELSE w END",
    ]


def _stemmed() -> str:
    bare = " ".join(f"WHEN ends_with(w, '{x}') AND {_vowel(_cut('w', x))} THEN {_cut('w', x)}" for x in ("ed", "ing"))
    parts, last = [f"tokens AS ({ORACLES['normalize_tokens']})"], "s0"
    parts.append("cells AS (SELECT doc_id, unnest(string_split(tokens, '|')) AS form, unnest(range(length(tokens) - length(replace(tokens, '|', '')) + 1)) AS i FROM tokens WHERE tokens <> '')")
    parts.append("s0 AS (SELECT form, lower(form) AS w, CAST(NULL AS VARCHAR) AS bare FROM (SELECT DISTINCT form FROM cells))")
    for n, step in enumerate(_stem_steps(), 1):
        parts.append(f"s{n} AS (SELECT form, {step} AS w, bare FROM {last})")
        last = f"s{n}"
        if n == 1:
            parts.append(f"s1b AS (SELECT form, w, CASE {bare} END AS bare FROM s1)")
            last = "s1b"
    own = _values(sorted(IRREGULAR.items()))
    parts.append(f"own AS (SELECT * FROM {own} t(form, stem))")
    parts.append(f"stems AS (SELECT s.form, CASE WHEN own.stem IS NOT NULL THEN own.stem WHEN length(s.form) <= 2 THEN lower(s.form) ELSE w END AS stem FROM {last} s LEFT JOIN own ON own.form = lower(s.form))")
    parts.append("listed AS (SELECT doc_id, string_agg(stem, '|' ORDER BY i) AS tokens FROM cells JOIN stems USING (form) GROUP BY doc_id)")
    return f"WITH {', '.join(parts)} SELECT doc_id, coalesce(listed.tokens, '') AS tokens FROM tokens LEFT JOIN listed USING (doc_id)"


ORACLES["stem_vocabulary"] = _stemmed()
