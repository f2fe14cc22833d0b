import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from siftwire.llm import simhash
from siftwire.llm.components import components


def plain_fingerprint(text, width=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, threshold):
    """prints: list of (id, fingerprint); id -> smallest reachable id."""
    n = len(prints)
    part = list(range(n))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= threshold:
                part[find(i)] = find(j)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), prints[i][0]), prints[i][0])
    return {prints[i][0]: low[find(i)] for i in range(n)}


def test_fingerprints(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    for r in simhash.fingerprint_digest(docs).join(docs, "doc_id").collect():
        assert r.fingerprint == f"{plain_fingerprint(r.text):016x}"
    assert simhash.fingerprint("One\ttwo\x0bTHREE") == simhash.fingerprint("one two three")
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_codes_cover():
    rng = np.random.default_rng(1)
    prints = rng.integers(-(1 << 63), 1 << 63, 200, dtype=np.int64)
    for code in simhash.CODES:
        for threshold in (4, 8):
            r, place, home = simhash.anchors(prints, code, threshold)
            at = {}
            for i, p, h in zip(r.tolist(), place.tolist(), home.tolist()):
                at.setdefault(i, {})[p] = h
            assert all(sum(x.values()) == 3 for x in at.values())
            for i in range(50):
                flips = rng.choice(64, threshold, replace=False)
                other = np.array([np.bitwise_xor.reduce([prints[i].astype(np.uint64), *(np.uint64(1) << flips.astype(np.uint64))])]).view(np.int64)
                _, there, _ = simhash.anchors(other, code, threshold)
                assert any(h and p in set(there.tolist()) for p, h in at[i].items())


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5])):
            for _ in range(rng.randrange(6)):
                base ^= 1 << rng.randrange(64)
            prints.append(base)
    crowd = rng.getrandbits(64)
    prints += [crowd ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)]
    prints = list(dict.fromkeys(prints))
    want = plain_components(list(enumerate(prints)), 4)
    signed = [(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)]
    frame = spark.createDataFrame(signed, "id long, fp long")
    for code, cell in (("golay", 4096), ("golay", 16), ("hamming", 4096), ("whole", 4096)):
        roots = components(simhash.links(frame.select("fp"), 4, code, cell))
        got = {r.id: r.root for r in frame.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("id", F.coalesce("root", "fp").alias("root")).collect()}
        groups = lambda of: sorted(sorted(i for i in of if of[i] == g) for g in set(of.values()))
        assert groups(got) == groups(want)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (None, 3), (200, 201)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert len({got[i] for i in range(41)}) == 1 and got[200] == got[201] != got[0] and 100 not in got


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = " ".join(f"word{rng.randrange(500)}" for _ in range(400))
    rows = [(9, base, "x"), (4, base, "y"), (7, base + " tail", "z"), (1, None, None), (2, "", "a"), (3, "alone", None), (None, base, "n"), (4, base, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = simhash.near_duplicates(docs)
    assert out.columns == ["doc_id", "fp", "component_id"] and out.count() == len(rows)
    got = {(r.doc_id, r.component_id) for r in out.collect()}
    assert got == {(9, 4), (4, 4), (7, 4), (1, 1), (2, 1), (3, 3), (None, 4)}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.fp or "") for r in kept.collect()) == [(1, ""), (3, ""), (4, "y")]
    nameless = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, "other words stand here now")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.drop_near_duplicates(nameless).collect()) == ["a b c d e", "other words stand here now"]
    empty = spark.createDataFrame([], docs.schema)
    assert simhash.fingerprint_digest(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0
