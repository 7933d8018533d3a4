"""Pairs that meet under several contents of a step are formed once, and none is lost."""

from dyadlab.llm import ngram_join as N

SCHEMA = "key bigint, rep bigint, role int, part int, step int, n bigint, component bigint, parity array<bigint>, first array<bigint>, first_step array<bigint>"


def test_pairs_of_a_step_are_formed_once(spark, monkeypatch):
    line = lambda key, rep, role, first_step: (key, rep, role, 255, 3, 14, rep, None, [], first_step)
    lines = [line(key, rep, N.PROBE, [10, 20, 30]) for key in (10, 20, 30) for rep in (1, 2)]
    lines += [line(40, 3, N.PROBE, [40]), line(50, 3, N.INDEX, [40]), line(40, 4, N.INDEX, [50]), line(50, 4, N.PROBE, [50])]
    stars = spark.createDataFrame([], "a bigint, b bigint")
    left = spark.createDataFrame(lines, SCHEMA)
    assert {tuple(r) for r in N._open_pairs(left, stars).collect()} == {(1, 2), (3, 4)}
    monkeypatch.setattr(type(left), "distinct", lambda self: self)
    assert sorted(tuple(r) for r in N._open_pairs(left, stars).collect()) == [(1, 2), (3, 4), (3, 4)]


def test_contents_that_tell_different_things_are_not_listed(spark):
    filed = spark.createDataFrame([(k, rep, N.PROBE, part, 2, 1, 14) for k, rep, part in [(1, 7, 255), (2, 7, 255), (1, 8, 255), (2, 8, 200)]], "key bigint, rep bigint, role int, part int, step int, votes int, n bigint")
    member = spark.createDataFrame([(7, 14, None, 7), (8, 14, None, 8)], "doc bigint, n bigint, parity array<bigint>, rep bigint")
    label = spark.createDataFrame([], "node bigint, component bigint")
    assert {(r["rep"], *r["first_step"]) for r in N._open_lines(filed, label, member).collect()} == {(7, 1, 2), (8,)}


def test_a_round_tries_one_pair_a_class(spark):
    parity = [0, 0, 0, 0]
    lines = spark.createDataFrame([(k, rep, N.PROBE, 40, parity) for k in (1, 2, 3) for rep in range(20)] + [(4, 30, N.INDEX, 40, parity), (4, 31, N.INDEX, 40, parity)], "key bigint, rep bigint, role int, n bigint, parity array<bigint>")
    label = spark.createDataFrame([], "node bigint, component bigint")
    centres = set()
    for turn in range(6):
        pairs = [tuple(r) for r in N._tries(lines, label, turn).collect()]
        assert len(pairs) == 19 and all(a < b for a, b in pairs)
        (centre,) = set.intersection(*map(set, pairs))
        centres.add(centre)
    assert len(centres) > 1
    joined = spark.createDataFrame([(i, 0) for i in range(20)], "node bigint, component bigint")
    assert N._tries(lines, joined, 0).count() == 0


def test_rounds_join_what_the_smallest_class_does_not(spark, monkeypatch):
    """Two groups of near copies under the same frequent words: after the rounds few pairs are left, and components are exact."""
    monkeypatch.setattr(N, "LEAST", 2)
    monkeypatch.setattr(N, "HOT", 2)
    monkeypatch.setattr(N, "CROWD", 4)
    words = lambda name: [f"{name}{i}" for i in range(60)]
    texts = [(1000 * g + i, " ".join(words("ab"[g])[:50] + words("c")[: 8 + i % 3] + [f"own{g}_{i}"])) for g in range(2) for i in range(24)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    formed, seen = N._open_pairs, []
    monkeypatch.setattr(N, "_open_pairs", lambda *a: seen.append(formed(*a)) or seen[-1])
    monkeypatch.setattr(N, "_stars", lambda filed: filed.filter("false").select(N.F.col("low").alias("a"), N.F.col("rep").alias("b")))
    pairs = []
    kept = N.Shelf.put
    monkeypatch.setattr(N.Shelf, "put", lambda self, df: (lambda out: pairs.append(out.count()) or out if seen and df is seen[-1] else out)(kept(self, df)))
    got = {r["doc_id"]: r["component_id"] for r in N.near_classes(docs).collect()}
    assert got == {i: 1000 * (i // 1000) for i, _ in texts}
    assert sum(pairs) < 48


def test_held_entries_are_stored_before_they_are_folded(spark, monkeypatch):
    """The exchange of all entries is let go before those that are left are exchanged again."""
    stored, put = [], N.Shelf.put
    monkeypatch.setattr(N.Shelf, "put", lambda self, df: stored.append(df.columns) or put(self, df))
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "x y")], "doc_id bigint, text string")
    assert {tuple(r) for r in N.near_classes(docs).collect()} == {(1, 4, 1), (2, 5, 1), (3, 1, 3)}
    assert stored.index(["key", "doc", "role", "part", "step"]) < stored.index(["key", "rep", "role", "part", "step", "votes", "n"])
