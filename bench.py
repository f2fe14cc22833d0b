"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local threads).
"""

import json
import os
import statistics
import time

from siftwire.functions.cleaning import clean_text
from siftwire.operators import classifiers as G
from siftwire.operators import features as X
from siftwire.operators import log_analytics as Q
from siftwire.operators import scoring as S
from siftwire.plans import catalog
from siftwire.plans.preprocess import preprocess, preprocess_to_text
from siftwire.session import session
from siftwire.sources import views as V


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__sql__shuffle__partitions=str(2 * int(cpus)),
        spark__driver__memory="12g", spark__sql__files__maxPartitionBytes=str(4 << 20),
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = V.table(spark, folder, "documents").count()
    model = catalog._bayes(spark, folder)

    # The test file has few row groups; spread its rows over the cores before the text steps.
    spread = 2 * int(cpus)

    def messages():
        return V.messages(spark, folder).repartition(spread)

    def chats():
        return V.chat_messages(spark, folder).repartition(spread)

    def corpus():
        return preprocess_to_text(V.corpus(spark, folder).repartition(spread), keep=("label_encoded",))

    def tfidf():
        texts = preprocess_to_text(messages())
        counts = X.term_counts(texts, "final_text", options=X.CLEANED)
        return X.tfidf(counts, X.fit_tfidf(texts, "final_text", options=X.CLEANED), options=X.CLEANED)

    log = lambda: V.prediction_log(spark, folder)
    jobs = {
        "clean_text": lambda: clean_text(messages()),
        "preprocess": lambda: preprocess(messages()),
        "clean_chat": lambda: clean_text(chats()),
        "preprocess_chat": lambda: preprocess(chats()),
        "tfidf": tfidf,
        "naive_bayes": lambda: G.fit_naive_bayes(corpus()).terms,
        "score_messages": lambda: S.score_messages(
            messages(), S.naive_bayes_scorer(model), "naive_bayes"
        ),
        "summary": lambda: Q.summary(log(), catalog.as_of()),
        "timeline": lambda: Q.timeline(log(), catalog.as_of(), 7),
        "rate_limit": lambda: catalog.rate_limit(spark, folder),
    }
    seconds = {}
    for name, job in jobs.items():
        runs = []
        job().write.format("noop").mode("overwrite").save()  # warm-up
        while len(runs) < 3:
            started = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(runs), 3)
    short = V.table(spark, folder, "conversations").count()
    texts = {name: rows for name in ("clean_text", "preprocess", "tfidf", "score_messages")}
    texts |= {"clean_chat": short, "preprocess_chat": short}
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": {n: round(k / seconds[n]) for n, k in texts.items()},
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
