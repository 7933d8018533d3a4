"""Cross-tokenizer alignment, embedding whitening and quality rules against brute force on small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

KINDS = "doc_id long, text string, row string, n long, pair long"  # extra columns clash with internal names


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "k", 1, None) for i, t in zip(ids or range(len(texts)), texts)], KINDS).repartition(3)


def odd_texts():
    r = random.Random(4)
    pool = list("abcxyzéñß 中文字😀\t\n\r  ​　\x1c\x85.,'!0123") + ["  ", "   ", " \n ", "\n\n", "don't", "<|endoftext|>", "<s>", "<0x41>", "́", " the", " of", "ing"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(1, 60))) for _ in range(150)]
    words = ["".join(r.choice(["th", "er", "in", "ción", "ß", "eau"]) for _ in range(r.randint(1, 5))) for _ in range(80)]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(60)]
    return texts + [None, "", " ", "  ", "\n", "x", "holds ▁ a mark", "▁", "tail  ", "a" * 3000, texts[-1], texts[-1], "Ünïcödé  double  spaces"]


# ---- 11


def brute_alignment(texts):
    from dyadlab.llm.alignment import BYTE_BPE, PIECE_BPE, tokenizers

    pair, all_links, out = tokenizers(BYTE_BPE, PIECE_BPE), [], []
    for t in texts:
        none = ([], [], [], [])
        if not t:
            all_links.append([])
            out.append(none)
            continue
        a = pair.a.encode(" " + t, add_special_tokens=False).ids
        b = pair.b.encode(t)
        if not b"".join(pair.bytes_a[i] for i in a) == (" " + t).encode() == b"".join(pair.bytes_b[i] for i in b):
            all_links.append([])
            out.append(none)
            continue
        ends = [np.cumsum([len(x[i]) for i in ids]).tolist() for x, ids in ((pair.bytes_a, a), (pair.bytes_b, b))]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, last = [], 0
        for c in common:
            groups.append(tuple([i for i, e in zip(ids, end) if last < e <= c] for ids, end in ((a, ends[0]), (b, ends[1]))))
            last = c
        where = dict(zip(ends[1], b))
        links = [(i, where[e]) for i, e in zip(a, ends[0]) if e in where]
        all_links.append(links)
        out.append((a, b, groups, links))
    count = Counter(x for links in all_links for x in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    rows = []
    for a, b, groups, links in out:
        s = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(s.encode()).hexdigest() if a else ""))
    return rows


@pytest.mark.parametrize("limits", [{}, {"HOT_PAIRS": 5, "PAIRS_HELD": 30, "CACHE_CHUNKS": 20, "BATCH_BYTES": 300, "JOINED": 3}])
def test_alignment_is_that_of_whole_texts(spark, monkeypatch, limits):
    from dyadlab.llm import alignment
    from dyadlab.session import cut

    for name, value in limits.items():
        monkeypatch.setattr(alignment, name, value)
    texts = odd_texts()
    got = {r["doc_id"]: r for r in alignment.link_report(cut(alignment.align(frame(spark, texts)))).collect()}
    want = brute_alignment(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert tuple(got[i][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == w, repr(texts[i])


def test_alignment_of_repeated_and_null_ids_and_of_nothing(spark):
    from dyadlab.llm import alignment
    from dyadlab.session import cut

    rows = alignment.link_report(cut(alignment.align(frame(spark, ["some words", "other", None], [None, 3, 3])))).collect()
    assert sorted((r["doc_id"] or -1, r["n_a"] > 0) for r in rows) == [(-1, True), (3, False), (3, True)]
    empty = alignment.link_report(cut(alignment.align(frame(spark, ["x"]).filter("false"))))
    assert empty.count() == 0 and empty.columns[0] == "doc_id"


def test_row_products_equal_dense_ones():
    from dyadlab.llm.alignment import Csr, align_tokens, row_products

    r = np.random.default_rng(3)
    for rows, inner, width in [(1, 1, 1), (4, 6, 5), (7, 3, 2), (3, 4, 0)]:
        a, b = r.integers(0, 3, (rows, inner)), r.integers(0, 3, (inner, width))
        both = []
        for m in (a, b):
            i, j = np.nonzero(m)
            order = r.permutation(len(i))
            both.append(Csr.of_entries(i[order], j[order], m[i, j][order], *m.shape))
        product = row_products(*both)
        dense = np.zeros((rows, width), np.int64)
        dense[product.row_of_entry(), product.column] = product.value
        assert (dense == a @ b).all()
    found = align_tokens(np.array([2, 3, 1, 4]), np.array([5, 2, 2, 1]))  # common ends 5 and 10
    dense = np.zeros((4, 4), np.int64)
    dense[found.overlap.row_of_entry(), found.overlap.column] = found.overlap.value
    assert dense.tolist() == [[2, 0, 0, 0], [3, 0, 0, 0], [0, 1, 0, 0], [0, 1, 2, 1]]
    assert [x.tolist() for x in found.together()] == [[1, 3], [0, 3]]
    shared = found.shared_groups()
    assert sorted(zip(shared.row_of_entry().tolist(), shared.column.tolist())) == [(0, 0), (1, 0), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3)]


# ---- 12

VECTORS = "vec_id long, embedding array<float>, x string, block int"


def vectors(spark, rows, ids=None):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "k", 1) for i, v in zip(ids or range(len(rows)), rows)], VECTORS).repartition(3)


def check_whitening(spark, rows, tolerance=1e-9):
    from dyadlab.llm import whitening

    good = {i: v for i, v in enumerate(rows) if v is not None and all(c is not None and math.isfinite(np.float32(c)) for c in v)}
    x = {i: tuple(int(math.floor(64 * float(np.float32(c)))) + 1000000 for c in v) for i, v in good.items()}
    fit = sorted(set(x.values()))
    n = len(fit)
    total = [sum(c) for c in zip(*fit)]
    centred = np.array([[n * a - s for a, s in zip(v, total)] for v in fit], object).astype(float) / n
    _, singular, basis = np.linalg.svd(centred, full_matrices=False)
    values, basis = singular**2 / n, basis.T
    k = min(16, int((singular > 1e-11 * singular[0]).sum())) if singular[0] > 0 else 0
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == k * len(x)
    by = {(r["vec_id"], r["component"]): r for r in got}
    gaps = [min([abs(values[j] - values[m]) for m in range(len(values)) if m != j] or [1.0]) / values[0] for j in range(k)]
    for i, v in x.items():
        moved = [n * a - s for a, s in zip(v, total)]
        for j in range(k):
            r = by[i, j + 1]
            assert r["n"] == n and r["deviation"] == sum(m * m for m in moved)
            assert abs(r["explained"] / (values[j] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-4
    for j in range(k):
        if gaps[j] > 1e-4:
            mine = np.array([by[i, j + 1]["whitened"] for i in x])
            other = np.array([[n * a - s for a, s in zip(v, total)] for v in x.values()], object).astype(float) / n @ basis[:, j] / math.sqrt(values[j])
            assert min(np.abs(mine - other).max(), np.abs(mine + other).max()) < tolerance


def test_whitening_equals_dense_eigenvectors(spark):
    r = np.random.default_rng(5)
    rows = [*(r.standard_normal((300, 24)) @ np.diag(np.linspace(0.1, 2, 24))), None, [float("nan")] * 24, [None] + [0.0] * 23, [float("inf")] + [0.0] * 23]
    check_whitening(spark, rows + rows[:40] + [rows[0]] * 200)


def test_whitening_of_few_dimensions_low_rank_and_wide_spread(spark):
    r = np.random.default_rng(6)
    check_whitening(spark, list(r.standard_normal((80, 5))))
    check_whitening(spark, [[a, 2 * a, 0, b] for a in range(6) for b in range(5)])  # rank 2, a constant dimension
    check_whitening(spark, list(r.standard_normal((200, 20)) * np.logspace(0, 3.5, 20)))
    check_whitening(spark, [[0.0] * 30, [1.0] * 30])
    check_whitening(spark, [r.standard_normal(30) for _ in range(7)])  # fewer vectors than dimensions


def test_equal_eigenvalues_are_all_found(spark):
    rows = [np.eye(6)[i] * s for i in range(6) for s in (3, -3)] + [np.eye(6)[0] * 5, np.eye(6)[0] * -5]
    check_whitening(spark, rows)


def test_whitening_of_nothing(spark):
    from dyadlab.llm import whitening

    assert whitening.whiten(vectors(spark, [[1.0, 2.0]]).filter("false")).count() == 0
    assert whitening.whiten(vectors(spark, [None, [float("nan"), 1.0]])).count() == 0
    assert whitening.whiten(vectors(spark, [[1.0, 2.0]] * 4)).count() == 0  # one distinct vector has no deviation
    with pytest.raises(Exception, match="one length"):
        whitening.whiten(vectors(spark, [[1.0, 2.0], [1.0, 2.0, 3.0]])).count()
    rows = whitening.whiten(vectors(spark, [[1.0, 2.0], [3.0, 1.0], [0.0, 1.0]], [None, 4, 4])).collect()
    assert sorted((r["vec_id"] or -1, r["component"]) for r in rows) == [(-1, 1), (-1, 2), (4, 1), (4, 1), (4, 2), (4, 2)]


# ---- 13

PROSE = "The first sentence is here, with some words. A second one follows it, in the same line!"


def quality_texts():
    r = random.Random(9)
    words = ["".join(r.choice("abcdeñé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    pool = [lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 30))) + r.choice([".", "!", '."', "”", ":", "", "!!", " ###"]), lambda: " | ".join(r.choice(words) for _ in range(r.randint(1, 9))),
            lambda: r.choice(["ALL Rights reserved.", "Read our Privacy Policy", "", "   ", "\t", "Alle Rechte vorbehalten", "x" * 300]), lambda: PROSE, lambda: " ".join(w + r.choice(["!!", "###", "$$$", "."]) for w in words[: r.randint(1, 12)])]
    texts = ["\n".join(r.choice(pool)() + r.choice(["", "", " ", "\r"]) for _ in range(r.randint(1, 25))) for _ in range(120)]
    return texts + [None, "", " ", "\n\n", "one", "a b c", "a b c a b c", "a a a a", "\n".join([PROSE] * 40), "word " * 20000, texts[0], texts[0], "a b c. " * 30, "<p> & |"]


def test_quality_counts_by_brute_force(spark):
    from dyadlab.llm import quality_lines

    texts = quality_texts()
    got = {r["doc_id"]: r for r in quality_lines.clean(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        count = Counter(windows)
        covered = {j + k for j, w in enumerate(windows) if count[w] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), base)
        left = r["cleaned"].split("\n")
        assert r["lost_chars"] == r["word_chars"] - sum(len(w) for x in left for w in re.findall(r"[^\x20\x09-\x0D]+", x))
        assert r["kept"] == (not base and 2 * r["lost_chars"] <= r["word_chars"])


def test_quality_equals_its_sql(spark):
    from dyadlab.llm import quality_lines

    texts = quality_texts()
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    cursor = db.execute(quality_lines.SQL)
    names = [c[0] for c in cursor.description]
    df = quality_lines.clean(frame(spark, texts), with_text=False)
    assert sorted(df.columns) == sorted(names)
    got, want = sorted(map(tuple, df.select(*names).collect())), sorted(cursor.fetchall())
    for a, b in zip(got, want):
        assert a == b, (dict(zip(names, a)), dict(zip(names, b)), texts[a[0]])
    assert len(got) == len(want)


def test_rules_per_line_and_verdicts(spark):
    from dyadlab.llm import quality_lines as q

    def rule(line):
        return q.failing_rule(line.encode(), len(line.split()))

    assert rule("Home | News | Sports | About") == "navigation" and rule("All Rights Reserved.") == "boilerplate"
    assert rule("no mark at all here") == "punctuation" and rule("BUY!! NOW!! CHEAP.") == "punctuation"
    assert rule(PROSE) is None and rule('He said "so."') is None and rule("a | b is a choice.") is None
    assert rule("We uphold all rights reserved to the parties in this long sentence of more than twelve words.") is None
    prose = "\n".join(f"Sentence number {i} says that {i * 7} things are {i * 13} and nothing else is {i + 1}." for i in range(20))
    menu = "\n".join(" | ".join(f"entry{i}{j}" for j in range(9)) for i in range(9))
    rows = {r["doc_id"]: r for r in q.clean(frame(spark, [prose, prose + "\n" + menu, "\n".join([menu] * 1 + [prose[:200]]), prose + "\nAll rights reserved."])).collect()}
    assert [rows[i]["kept"] for i in range(4)] == [True, True, False, True]
    assert rows[1]["cleaned"] == prose and rows[3]["n_boilerplate"] == 1 and rows[3]["cleaned"] == prose


def test_quality_of_repeated_and_null_ids_and_of_nothing(spark):
    from dyadlab.llm import quality_lines as q

    rows = q.clean(frame(spark, ["a", None, "b"], [None, 2, 2])).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"]) for r in rows) == [(-1, 1), (2, 0), (2, 1)]
    assert q.clean(frame(spark, ["x"]).filter("false")).count() == 0
