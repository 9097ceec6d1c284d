"""Packing, whitening and the filter audit on small tables, against plain Python."""

import itertools
import math
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tallyloom.llm import filter_audit, packing, whitening
from tallyloom.llm.entry import oracle_sql, queries, tokenizer_path

SCHEMA = "doc_id long, text string, source string, length string, failed string"  # the last two clash with inner names

# --- 11 --------------------------------------------------------------------------------------------------


def test_products_are_exact():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((300, 3)) * 10.0 ** rng.integers(-8, 9, (300, 3))
    b = rng.standard_normal((300, 2)) * 1e6
    none = np.zeros_like
    high, low = whitening.product((a, none(a)), (b, none(b)))
    for i, j in itertools.product(range(3), range(2)):
        exact = sum(Fraction(x) * Fraction(y) for x, y in zip(a[:, i].tolist(), b[:, j].tolist(), strict=True))
        size = sum(abs(x * y) for x, y in zip(a[:, i], b[:, j], strict=True)) + 300 * abs(a[:, i]).max() * abs(b[:, j]).max()
        assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact) < Fraction(size) / 2**75


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "d", 1) for i, v in rows], "vec_id long, embedding array<double>, dim string, n long")


def expected_whitening(rows):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in rows], dtype=object)
    n, sums = len(x), x.sum(0)
    centred = np.array([[float(Fraction(int(v)) - Fraction(int(s), n)) for v, s in zip(r, sums, strict=True)] for r in x])
    values, q = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    return centred, values[::-1], q[:, ::-1], deviation


def test_whitening(spark):
    rng = np.random.default_rng(2)
    rows = (rng.standard_normal((240, 40)) * np.linspace(0.2, 3, 40) @ rng.standard_normal((40, 40))).tolist()
    bad = [(900, None), (901, []), (902, [None] + [1.0] * 39), (903, [float("nan")] * 40), (904, [float("inf")] * 40)]
    table = vectors(spark, [*((None if i == 7 else i // 2, v) for i, v in enumerate(rows)), *bad])
    found = whitening.whiten(table.repartition(5)).collect()
    assert Counter(r["vec_id"] for r in found) == Counter(None if i == 7 else i // 2 for i in range(240))
    centred, values, q, deviation = expected_whitening(rows)
    expected = centred @ q[:, :32] / np.sqrt(values[:32])
    order = {d: k for k, d in enumerate(deviation)}
    got = np.zeros_like(expected)
    for r in found:
        got[order[r["deviation"]]] = r["whitened"]
    assert sorted(order) == sorted(r["deviation"] for r in found)
    signs = np.sign((got * expected).sum(0))
    assert np.allclose(got * signs, expected, atol=1e-9)
    assert found[0]["explained"] == pytest.approx(values[:32] / values.sum()) and found[0]["n"] == 240
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-12


def test_whitening_of_nearly_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-4000, 4000, (500, 4)) * 1e4
    rows = np.c_[base, base.sum(1) + rng.integers(-2, 3, 500), rng.integers(-3, 4, (500, 2)), np.full(500, 0.5)]
    found = whitening.whiten(vectors(spark, list(enumerate(rows.tolist())))).collect()
    w = np.array([r["whitened"][:7] for r in found])
    assert found[0]["identity_error"] < 1e-5 and np.abs(w.T @ w / 500 - np.eye(7)).max() < 1e-5
    assert all(r["whitened"][7] is None and r["explained"][7] == 0 for r in found)


def test_whitening_of_few_odd_and_huge_vectors(spark):
    one = whitening.whiten(vectors(spark, [(1, [0.25, 0.5])])).collect()[0]
    assert one["deviation"] == 0 and one["whitened"] == [None, None] and one["explained"] == [0, 0] and one["identity_error"] == 0
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.5]), (3, [5.0]), (4, [6.0]), (5, [8.0, 1.0]), (6, [1e300, -1.0, 0.0]), (7, [-1e300, 1.0, 0.0])]
    found = {r["vec_id"]: r for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert [found[i]["n"] for i in range(1, 8)] == [3, 3, 2, 2, 3, 2, 2]
    assert sorted(abs(found[i]["whitened"][0]) for i in (3, 4)) == pytest.approx([1, 1]) and found[6]["deviation"] is None
    assert found[1]["deviation"] == expected_whitening([r[1] for r in rows if len(r[1]) == 2])[3][0]
    assert whitening.whiten(vectors(spark, [])).count() == 0


# --- 12 --------------------------------------------------------------------------------------------------


def best_fit_by_piece(counts, capacity):
    """Sequences of plain best fit by falling length, a piece at a time."""
    gaps = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= n]
        k = min(fits, key=lambda k: gaps[k], default=None)
        if k is None:
            gaps.append(capacity - n)
        else:
            gaps[k] -= n
    return sorted(gaps)


def test_packed_counts():
    rng = np.random.default_rng(4)
    for _ in range(300):
        capacity = int(rng.integers(1, 40))
        counts = Counter(rng.integers(1, capacity + 1, rng.integers(0, 60)).tolist())
        found = packing.pack_counts(dict(counts), capacity)
        used = Counter()
        for own in found:
            assert own.count > 0 and own.gap == capacity - sum(n * c for n, c in own.runs) >= 0
            large = sum(c for n, c in own.runs if 3 * n > capacity)
            assert large <= 2
            for n, c in own.runs:
                used[n] += own.count * c
        assert used == counts
        assert sorted(g for own in found for g in [own.gap] * own.count) == best_fit_by_piece(counts, capacity)


def most_pairs(lengths, capacity):
    if not lengths:
        return 0
    head, *rest = lengths
    best = most_pairs(rest, capacity)
    for k, n in enumerate(rest):
        if head + n <= capacity:
            best = max(best, 1 + most_pairs(rest[:k] + rest[k + 1 :], capacity))
    return best


def test_large_pieces_are_matched_as_often_as_they_can_be():
    rng = np.random.default_rng(6)
    for _ in range(60):
        lengths = rng.integers(11, 31, 8).tolist()
        found = packing.match_large(Counter(lengths), 30)
        assert sum(own.count for own in found) == 8 - most_pairs(lengths, 30)


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rng = np.random.default_rng(9)
    texts = [" ".join(f"word{k}" for k in rng.integers(0, 50, n)) for n in (*rng.integers(0, 12, 120), 300)] + [None, "", " ", "copy", "copy"]
    rows = [(None if i % 50 == 3 else i // 2, t, "s", "l", "f") for i, t in enumerate(texts)]
    found = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(4), tokenizer_path(), capacity=16)
    pieces = found.collect()
    expected = Counter()
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        over = len(ids) % 16
        bounds = ([0] if over else []) + list(range(over, len(ids) + 1, 16))
        expected.update((i, p, a, b - a, ids[a:b].tobytes()) for p, (a, b) in enumerate(itertools.pairwise(bounds)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in pieces) == expected
    by_sequence = {}
    for r in sorted(pieces, key=lambda r: r["offset"]):
        own = by_sequence.setdefault(r["sequence_id"], [])
        assert r["offset"] == sum(x["length"] for x in own)
        own.append(r)
    assert all(sum(x["length"] for x in own) <= 16 for own in by_sequence.values())
    total = sum(r["length"] for r in pieces)
    assert -(-total // 16) <= len(by_sequence) <= total / 16 * 1.05 + 1
    whole = {r["sequence_id"]: (bytes(r["ids"]), r["lengths"]) for r in packing.sequences(found).collect()}
    assert whole == {s: (b"".join(bytes(x["ids"]) for x in own), [x["length"] for x in own]) for s, own in by_sequence.items()}
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_packing_query(spark, sf_dir):
    found = queries()["op12_best_fit_packing"](spark, sf_dir).toPandas()
    from_four = queries()["op4_token_output"](spark, sf_dir).toPandas().set_index("doc_id")
    assert found.groupby("doc_id")["length"].sum().to_dict() == from_four["n_tokens"].to_dict()
    alone = found[found["length"] == found["doc_id"].map(from_four["n_tokens"])]
    assert len(alone) and (alone["ids_crc32"] == alone["doc_id"].map(from_four["ids_crc32"])).all()
    assert found["sequence_id"].nunique() <= -(-found["length"].sum() // 1024) * 1.02 + 1


# --- 13 --------------------------------------------------------------------------------------------------


def failures_by_hand(rows):
    first = {}
    for i, t, *_ in rows:
        k = float("inf") if i is None else i
        first[t or ""] = min(k, first.get(t or "", k))
    for i, t, *_ in rows:
        text = t or ""
        own = text.encode().split()
        failed = "A" * (len(own) < 50) + "B" * (100 * len(set(own)) < 65 * len(own)) + "C" * (100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) > 5 * len(text))
        failed += "D" * any(c in "#$%&*|" for c in text) + "E" * ((float("inf") if i is None else i) > first[text])
        yield failed


def test_filter_audit(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(150):
        n, v = int(rng.choice([3, 49, 50, 60, 90])), int(rng.choice([5, 200, 5000]))
        text = " ".join(("É" if rng.random() < 0.5 else "w") + str(k) for k in rng.integers(0, v, n))
        text += " ABC" * int(rng.choice([0, 0, 9])) + ("\x1f#" if rng.random() < 0.2 else "") + " x"
        rows.append((i, text, f"s{i % 3}", "", ""))
    rows += [(i + 200, rows[i][1], rows[i + 1][2], "", "") for i in range(40)] + [rows[3], (None, rows[5][1], "s0", "", ""), (None, "null id", None, "", ""), (None, "null id", "", "", "")]
    rows += [(500, None, None, "", ""), (501, "", "", "", ""), (501, "", "s1", "", ""), (-1, "late " * 60, "s1", "", "")]
    labels = [(i, int(rng.random() < 0.5), int(rng.random() < 0.3)) for i in range(0, 260, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (9999, 1, 1)]
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    parts = {}
    for (i, _, s, *_), failed in zip(rows, failures_by_hand(rows), strict=True):
        parts.setdefault(s or "", []).append((failed, i in good, i in toxic))
    expected = {}
    for part, own in parts.items():
        shapley, found = Counter(), {}
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [d for d in own if f in d[0] and not before & set(d[0])]
                shapley[f] += len(here)
                kept, redundant = sum(not (before | {f}) & set(d[0]) for d in own), sum(f in d[0] and bool(before & set(d[0])) for d in own)
                found["".join(order), step] = (kept, len(here), redundant, sum(d[0] == f for d in own), sum(d[1] for d in here), sum(d[2] for d in here))
        for (order, step), counts in found.items():
            expected[part, order, step] = (*counts, shapley[order[step - 1]])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in filter_audit.audit(docs, told).collect()}
    assert got == expected
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), told).count() == 0
    assert filter_audit.audit(docs, told.where("false")).where("good_lost + toxic_lost > 0").count() == 0


def test_filter_audit_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found, expected = queries()["op13_filter_audit"](spark, sf_dir).toPandas(), con.sql(oracle_sql()["op13_filter_audit"]).df()
    rows = lambda df: sorted(map(tuple, df[sorted(found.columns)].astype(object).to_numpy().tolist()))
    assert rows(found) == rows(expected)


def test_digests_of_ids(spark):
    found = packing.pack(spark.createDataFrame([(1, None, "", "", "")], SCHEMA), tokenizer_path()).collect()
    assert [(r["length"], zlib.crc32(r["ids"])) for r in found] == [(1, zlib.crc32(np.array([2], "<u4").tobytes()))]
