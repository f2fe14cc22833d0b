import hashlib
import zlib

import pytest

from siftwire.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def remainder(c, n):
    return c - int(c / n) * n


def plain_rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - remainder(c, 5), [])[:h] + turns[h:]
    return out


def plain_trie(rows):
    convs, members = plain_rebuilt(rows), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for prefix, own in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        parent = min(members[prefix[:-1]]) if prefix else None
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in own if convs[c] == list(prefix))))
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.add((min(own), len(prefix), parent, len(own), len(children), leaves, saved, sha))
    return out


def digest(frame):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert frame.columns == columns
    found = [tuple(r) for r in frame.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_given_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert digest(queries.QUERIES["op13_conversation_trie"](spark, small)) == plain_trie(rows)


def test_deep_shared_and_odd_turns(spark):
    rows = [(c, t, "user" if t % 2 else "bot", f"turn {t if t < c * 3 else (c, t)}") for c in range(0, 24) for t in range(c % 7 * 5)]
    rows += [(100 + i, t, "user", f"same {t}") for i in range(6) for t in range(20)]  # copies
    rows += [(3, None, "user", "first"), (3, 2, None, None), (3, 2, "a", "tie"), (3, 2, "a", "tie"), (None, 1, "a", "no id")]
    rows += [(-7, 0, "u", "below"), (-5, 0, "u", "zero"), (-5, 1, "u", "è"), (40, 1, "u", ""), (41, 1, "", None), (42, 1, None, "")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as name", "1 as depth", "2 as pos", "3 as size")
    assert digest(trie.trie_digest(frame)) == plain_trie(rows)


def test_one_conversation_over_many_tasks(spark):
    rows = [(5, t // 3, "u", f"t{t % 4}") for t in range(300)] + [(6, t, "u", f"t{t}") for t in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert digest(trie.trie_digest(frame)) == plain_trie(rows)


def test_empty(spark):
    assert trie.trie_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.trie_digest(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


@pytest.mark.parametrize("piece", [1, 7])
def test_ids_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(trie, "PIECE_BYTES", piece)
    rows = [(1, 4, c) for c in range(-3, 40)] + [(2, 4, 9)]
    got = {(r.depth, r.name): r.ends_sha256 for r in trie.id_digests(spark.createDataFrame(rows, "depth long, name long, conv_id long")).collect()}
    assert got == {(1, 4): hashlib.sha256(",".join(map(str, range(-3, 40))).encode()).hexdigest(), (2, 4): hashlib.sha256(b"9").hexdigest()}
