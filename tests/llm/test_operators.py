"""Each operator on small tables, against plain Python; nulls, empty texts, ties, repeats, empty tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import decontamination, embedding_dedup, hmm_lm, html_extraction, language_id, mixing, shingle_dedup, simhash, substring_dedup, token_output, toxicity, wordpack
from tallyloom.llm.entry import tokenizer_path

SCHEMA = "doc_id long, text string, key string, component string"  # the last two clash with inner names


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "k", "c") for i, t in enumerate(texts)], SCHEMA)


def words(t):
    return (t or "").encode().split()


# --- 1 ---------------------------------------------------------------------------------------------------


def test_html_lines_and_differencing(spark):
    frame = '<html><head><title>T</title></head><body><div>Site line</div><nav>Menu</nav>{}<div>About us</div><footer>F</footer></body></html>'
    pages = [
        (1, "http://a.org/x/1", frame.format("<p>One &amp;  two</p>")),
        (2, "http://a.org/x/2", frame.format("<p>Three<br>four <b>fi</b>ve</p>")),
        (3, "http://b.org/", "<article><h1>H</h1><script>var t='</p>'</script><p>Body<div class='comments'>no</div></article><div>out</div>"),
        (4, None, None), (5, "http://c.org/", ""), (6, "::bad[", "plain text"), (6, "::bad[", "plain text"),
    ]
    found = html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lines", F.lit(1)))
    rows = sorted((r["page_id"], r["text"], r["n_chars"]) for r in found.collect())
    texts = ["One & two", "Three four five", "H Body", "", "", "plain text", "plain text"]
    assert rows == [(p[0], t, len(t)) for p, t in zip(pages, texts, strict=True)]
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<body style="overflow-x:hidden"><div class="overflow-hidden has-sidebar search-page"><article><p>One</p></article></div>', "One"),
        ('<div class="sidebar-wrapper"><main><p>Two</p></main>side</div>', "Two"),
        ("<article><p class='share price'>Three</p><section id='related-work'>Four</section><div class='comment-list'>no</div></article>", "Three Four"),
        ('<article><p hidden>no</p><p style="display: none">no</p><p data-hidden="1">Five</p><div class="comments"><article>no</article></div></article>', "Five"),
        ('<div class="site-header">no</div><p>Six</p><div id="cookie-notice">no</div>', "Six"),
    ],
)
def test_html_marks(html, text):
    lines = html_extraction.lines_of(html)
    kinds = np.array([k for _, k in lines], np.uint8)
    assert html_extraction.main_text([x for x, _ in lines], kinds, np.zeros(len(lines), bool)) == text


def test_pages_are_paired_whatever_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    frames = [f"<div>top {k}</div>{{}}<div>end {k}</div>" for k in range(3)]
    pages = [(i, f"http://h{i % 4}.org/a/{rng.integers(60)}", frames[i % 3].format(f"<p>own {i}</p>")) for i in range(80)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_extraction.extract(df).collect()}
    order = sorted(pages, key=lambda p: (*html_extraction.place_of(p[1]), p[0]))
    for k, (i, u, h) in enumerate(order):
        host, path = html_extraction.place_of(u)
        near = [p for p in (*order[max(k - 1, 0) : k], *order[k + 1 : k + 2]) if html_extraction.place_of(p[1])[0] == host]
        near.sort(key=lambda p: -html_extraction._alike(html_extraction.place_of(p[1])[1], path))
        lines = [x for x, _ in html_extraction.lines_of(h)]
        other = [x for x, _ in html_extraction.lines_of(near[0][2])] if near else []
        assert found[i] == " ".join(x for x in lines if x not in other)
    monkeypatch.setattr(html_extraction, "BLOCK", 3)
    assert {r["page_id"]: r["text"] for r in html_extraction.extract(df.repartition(7)).collect()} == found


def test_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(0, 12)).tolist() for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        for bits in (1 << 28, 4):
            found, rest = html_extraction.common_lines(a, b, bits), iter(b)
            assert len(found) == best[-1][-1] and all(any(y == a[i] for y in rest) for i in found)


# --- 2 ---------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rows = [(i, "s%d" % (i % 5) if i % 7 else None, i % 40) for i in range(600)] + [(600, "tiny", 0), (601, "tiny", 1), (601, "tiny", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    targets = mixing.targets_by_weight(mixing.source_sizes(df, size=F.col("size")))
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    order = sorted(s for s in sizes if s is not None) + [None]
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values())
    full: set = set()
    while True:
        share = {s: 2 * sizes[s] if s in full else (total - sum(2 * sizes[x] for x in full)) * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        more = {s for s in order if share[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    found = {r["source"]: r["target"] for r in targets.collect()}
    assert found == pytest.approx(share)
    mixed = mixing.mix(df, targets, size="size").collect()
    assert len(mixed) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in mixed)
    source_of = {i: s for i, s, _ in rows}

    def near_targets(mix):
        taken = Counter()
        for r in mix:
            taken[source_of[r["doc_id"]]] += r["taken"]
        return all(abs(taken[s] - t) <= 2 for s, t in share.items())

    assert near_targets(mixed)
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, mixing.mix(df, targets, size="size").collect()))
    based = mixing.mix(df.withColumn("b", F.when(F.col("doc_id") % 2 == 0, 0.2).otherwise(1.5)), targets, size="size", base="b").collect()
    assert near_targets(based)
    assert mixing.mix(df.limit(0), mixing.targets_by_weight(mixing.source_sizes(df.limit(0), size=F.col("size"))), size="size").count() == 0


def test_mixing_reaches_the_optimum_of_a_dense_solver(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "ab"[i % 2], int(n)) for i, n in enumerate(rng.integers(0, 900, 400))]
    total = [sum(n for _, s, n in rows if s == x) for x in "ab"]
    targets = spark.createDataFrame([("a", total[0], 0.3 * total[0]), ("b", total[1], 1.6 * total[1])], "source string, source_size long, target double")
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), targets, size="size").collect()
    for x, target in (("a", 0.3 * total[0]), ("b", 1.6 * total[1])):
        own = np.array([n for _, s, n in rows if s == x], float)
        low, high = -1.0, 1.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if (own * np.minimum(2, np.exp(middle * own))).sum() < target else (low, middle)
        rates = {r["doc_id"]: r["rate"] for r in found}
        best = {i: min(2.0, math.exp(low * n)) for i, s, n in rows if s == x}
        assert {i: rates[i] for i in best} == pytest.approx(best, rel=1e-5)
        assert len({round(v, 6) for v in best.values()}) > 50  # rates differ within a source


# --- 3 ---------------------------------------------------------------------------------------------------


def test_language_code_lengths_are_exact(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("die katze und der hund", "de"), ("the end", "en"), (None, "de"), ("x", None)] * 3)]
    trees = language_id.learn_trees(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts: dict = {}
    for _, t, lang in rows:
        for w in language_id.words_of(t) if lang else []:
            raw = b" " + w.encode() + b" "
            for k in range(1, len(raw)):
                for start in range(max(0, k - language_id.ORDER), k + 1):
                    counts.setdefault((lang, raw[start:k]), Counter())[raw[k]] += 1
    for word in ("the", "katze", "zebra", "é", "thethethe"):
        for column, lang in enumerate(trees.languages):
            raw, bits = b" " + word.encode() + b" ", 0.0
            for k in range(1, len(raw)):
                for start in range(max(0, k - language_id.ORDER), k + 1):
                    seen = counts.get((lang, raw[start:k]))
                    if not seen:
                        continue
                    whole = sum(seen.values()) + len(seen)
                    if raw[k] in seen:
                        bits -= math.log2(seen[raw[k]] / whole)
                        break
                    bits -= math.log2(len(seen) / whole)
                else:
                    bits += 8
            assert trees.code_lengths([word])[0][column] == pytest.approx(bits, rel=1e-5)
    found = {r["doc_id"]: r for r in language_id.predict(docs(spark, ["the dog", "der hund", None, "", "12 34 !", "the " * 50_000]), trees).collect()}
    assert [found[i]["lang_pred"] for i in range(6)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language_id.predict(docs(spark, ["a"]).limit(0), trees).count() == 0


def test_every_language_keeps_its_trees(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + i % 7)} zz", f"l{i:03d}") for i in range(300)]
    rows += [(1000 + i, " ".join(f"w{chr(97 + i % 26)}{chr(97 + k)}" for k in range(26)), "l000") for i in range(40)]
    trees = language_id.learn_trees(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_nodes=6)
    assert len(trees.languages) == 300


def test_samples_are_exact(spark):
    from tallyloom.llm.common import thinned

    rows = spark.range(5000).selectExpr("id", "if(id % 10 = 0, 'rare', null) as label")
    for each, sizes in ((501, {"rare": 500, None: 501}), (100, {"rare": 100, None: 100})):
        found = thinned(rows, ["label"], "id", each)
        assert {r["label"]: r["count"] for r in found.groupBy("label").count().collect()} == sizes
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, thinned(rows.repartition(3), ["label"], "id", each).collect()), key=str)


# --- 4 ---------------------------------------------------------------------------------------------------


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ["b  c", None, "", "Été\n\nnoël  x", "a " * 5000, " lead", "tail "]
    tok = Tokenizer.from_file(tokenizer_path())
    df = docs(spark, texts).unionByName(docs(spark, ["again"], 2)).repartition(3)
    manifest = token_output.write_tokens(df, tokenizer_path(), sequence=128)
    found = [tuple(r) for r in token_output.read_tokens(manifest).orderBy("start").collect()]
    order = sorted([*enumerate(texts), (2, "again")], key=lambda x: (x[0], x[1] is not None, x[1] or ""))
    start, expected = 0, []
    for i, t in order:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert found == expected
    batch = token_output._opened(manifest.first()["path"]).get_batch(0)
    assert str(batch.schema.field("input_ids").type).startswith("fixed_size_list")
    assert token_output.write_tokens(df.limit(0), tokenizer_path()).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------


def _edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("abcdefg  "), n))
    items = ["x" + text(n) + "x" for n in (60, 90, 200, 40)] + ["qu Ick", None, "", " "]
    bodies = [text(300) for _ in range(12)]
    for k, item in enumerate(items[:4]):
        bodies += [text(50) + item + text(50), "  " + item.upper() + "\n"]
        for edits in (1, 2, 4, 9, 14):
            bad = list(item)
            for at in rng.choice(len(bad), edits, replace=False):
                bad[at] = ("", "z", bad[at] + "y")[k % 3]
            bodies.append(text(80) + "".join(bad) + text(20))
    bodies += [None, "", items[2] + " " + items[0], "a  QU\nick b", "aqu icky", "qui ck"]
    bodies.append("z " * 300_000 + items[0] + " z" * 300_000)  # longer than a piece
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, doc_id long")
    expected = set()
    for d, body in enumerate(bodies):
        for i, item in enumerate(items):
            norm = decontamination.normalised(item)
            if 0 < len(norm) < decontamination.Q:
                if norm in decontamination.normalised(body):
                    expected.add((d, i))
            elif norm and len(body or "") < 10_000 and _edits(norm, decontamination.normalised(body)) <= min(int(len(norm) * decontamination.BUDGET + 1e-9), (len(norm) - decontamination.Q) // decontamination.Q):
                expected.add((d, i))
    expected.add((len(bodies) - 1, 0))
    for block in (decontamination.BLOCK_CHARS, 100):
        found = decontamination.contaminated(docs(spark, bodies), bench, block_chars=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == expected and len(found) == len(expected)
    kept = decontamination.without_benchmark(docs(spark, bodies).withColumn("_row", F.lit("mine")), bench)
    assert {r["_row"] for r in kept.collect()} == {"mine"}
    kept = kept.drop("_row")
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(bodies))) - {d for d, _ in expected} and kept.columns == ["doc_id", "text", "key", "component"]
    assert decontamination.contaminated(docs(spark, bodies), bench.limit(0)).count() == 0


# --- 6 ---------------------------------------------------------------------------------------------------


def _print(text):
    w = [x.lower() for x in words(text)]
    n = min(3, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(n, linked):
    least = list(range(n))
    for _ in range(n):
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    return least


@pytest.mark.parametrize("bucket", [64, 2])
def test_simhash_against_brute_force(spark, bucket):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 300, 200)) for _ in range(6)]
    texts = base + [b.replace(" w1", " W1") for b in base] + [b + f" t{k}" for b in base for k in range(6)] + [None, "", "  ", "a b", "A  b", "x"]
    prints = [_print(t) for t in texts]
    least = _classes(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    found = simhash.near_duplicates(docs(spark, texts), bucket=bucket).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, least, strict=True))}
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs(spark, texts)).collect()) == sorted(set(least))


def test_keep_one_with_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (7, c), (7, d), (9, c), (7, c), (3, None), (None, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (7, c), (7, d), (3, None)], key=str)


def _similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("bucket", [64, 4])
def test_shingle_dedup_against_brute_force(spark, bucket):
    rng = np.random.default_rng(11)
    texts = [None, "", "a b", "A  b", "a b c"]
    for k in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, 150)]
        for changes in (0, 0, 1, 1, 1, 2, 2, 3, 4):  # few words changed: far apart for SimHash, alike by shingles
            own = list(base)
            for at in rng.integers(0, 150, changes):
                own[at] = f"c{k}-{rng.integers(1000)}"
            texts.append(" ".join(own))
    sets = []
    for t in texts:
        w = [x.lower() for x in words(t)]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    least = _classes(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if _similar(sets[a], sets[b])])
    kept = shingle_dedup.keep_one(docs(spark, texts), bucket=bucket).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(least))
    assert len(kept) < simhash.keep_one(docs(spark, texts)).count()  # two bits of 64 leave both copies of many pairs


def test_shingle_dedup_loses_no_link_of_a_crowd(spark):
    rng, size = np.random.default_rng(5), 600
    base, texts = [f"w{x}" for x in range(size)], []
    for k in range(160):  # all alike at about 0.76, few pairs at 0.8
        own = list(base)
        for at in rng.integers(0, size, 8):
            own[at] = f"c{k}-{at}"
        texts.append(own)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(size - 4)) for w in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if _similar(sets[a], sets[b])]
    assert links
    kept = shingle_dedup.keep_one(docs(spark, [" ".join(w) for w in texts])).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(_classes(len(texts), links)))


# --- 7 ---------------------------------------------------------------------------------------------------


def test_hmm_base_and_likelihood(spark):
    texts = ["the cat sat on the mat"] * 20 + ["A dog ran off"] * 10 + [None, "", "unseen words here"]
    df = docs(spark, texts)
    found = sorted(hmm_lm.score_texts(df, train="doc_id % 10 <> 0").collect(), key=lambda r: r["doc_id"])
    tokens = lambda t: [w.lower() for w in words(t)] + [None]
    counts = Counter(w for i, t in enumerate(texts) if i % 10 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for r, (i, t) in zip(found, enumerate(texts), strict=True):
        own = tokens(t)
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, i % 10 == 0, len(own), sum(counts[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
    assert sum(r["score"] for r in found if r["held_out"]) > sum(r["base_score"] for r in found if r["held_out"])
    rng = np.random.default_rng(2)
    model = hmm_lm.Model(*(x / x.sum(a, keepdims=True) for x, a in ((rng.random(3), 0), (rng.random((3, 3)), 1), (rng.random((4, 3)), 0))))
    assert 10 ** hmm_lm.log10_likelihoods(model, [np.array(p, np.uint16) for p in np.ndindex(4, 4)]).sum() > 0
    assert sum(10 ** hmm_lm.log10_likelihoods(model, [np.array(p, np.uint16) for p in np.ndindex(4, 4)])) == pytest.approx(1)


def test_hmm_every_count_class_receives_mass():
    for counts in (np.arange(1, 200), np.array([1, 2, 5, 8, 9]), np.array([3, 9, 18, 36])):
        kinds = hmm_lm.count_class(counts)
        edge = hmm_lm.falls(counts, kinds)
        tokens, stay = (np.bincount(kinds, weights=w, minlength=hmm_lm.COUNT_CLASSES) for w in (counts, counts * ~edge))
        got = hmm_lm.left_out(kinds, edge & hmm_lm.falling_classes(tokens, stay)[kinds])
        assert set(kinds.tolist()) <= set(got.tolist())
    counts = np.array([8, 9, 10, 17, 18, 19])
    kinds = hmm_lm.count_class(counts)
    assert hmm_lm.left_out(kinds, hmm_lm.falls(counts, kinds)).tolist() == [7, 8, 9, 9, 9, 10]


# --- 8 ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk_bytes", [substring_dedup.CHUNK_BYTES, 200])
def test_substring_dedup_against_brute_force(spark, chunk_bytes):
    rng = np.random.default_rng(4)
    long = " ".join(f"w{x}" for x in rng.integers(0, 50, 60))
    texts = [long, "a " + long, None, "", " ".join(long.split()[20:40]) + "\nz " * 30, "z " * 40, long, "q " * 12]
    first: dict = {}
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    expected = {}
    for i, t in enumerate(texts):
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        expected[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    found = substring_dedup.remove_repeats(docs(spark, texts), chunk_bytes=chunk_bytes, range_windows=40).withColumn("sha", F.sha2("kept_text", 256))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["sha"]) for r in found.collect()} == expected


@pytest.mark.parametrize("chunk_bytes", [substring_dedup.CHUNK_BYTES, 300])
def test_substring_dedup_with_null_and_repeated_ids(spark, chunk_bytes):
    rng = np.random.default_rng(5)
    ids = [None] * 12 + [7] * 12 + [-(2**63), 2**63 - 1, 3, 8, 9]
    pool = [" ".join(f"w{x}" for x in rng.integers(0, 9, 20)) for _ in range(6)]
    rows = [(i, f"r{k} {pool[k % 6]} e{k}") for k, i in enumerate(ids)]
    place = [2**63 - 1 if i is None else i for i in ids]
    first: dict = {}
    for p, (_, t) in zip(place, rows, strict=True):
        for k in range(len(words(t)) - 12):
            g = tuple(words(t)[k : k + 13])
            first[g] = min(first.get(g, p), p)
    expected = []
    for p, (i, t) in zip(place, rows, strict=True):
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < p for j in range(13)}
        expected.append((str(i), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.remove_repeats(table, chunk_bytes=chunk_bytes, range_windows=40).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in found) == sorted(expected)
    assert substring_dedup.remove_repeats(table.where("false"), chunk_bytes=chunk_bytes).collect() == []


def test_ranges_of_hashes():
    hashes = np.sort(np.random.default_rng(6).integers(0, 2**64, 500, np.uint64))
    for ranges in (1, 3, 7, 64, 100_000):
        expected = [int(h) // 2**33 * ranges >> 31 for h in hashes]
        numbers, cuts = wordpack.in_ranges(hashes, ranges)
        assert [r for r, part in zip(numbers, np.split(hashes, cuts), strict=True) for _ in part] == expected
    assert wordpack.in_ranges(hashes[:0], 9)[0] == []


# --- 9 ---------------------------------------------------------------------------------------------------


def test_embedding_dedup_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((5, 16))
    vectors = [c + 0.05 * rng.standard_normal(16) for c in centres for _ in range(20)] + [centres[0]] * 30
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] + [1.0] * 15), (204, [None] + [1.0] * 15)]
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    least = _classes(len(vectors), [(a, b) for a in range(len(vectors)) for b in range(a) if near[a, b]])
    for crowd in (2048, 8):
        found = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), crowd=crowd).collect()}
        assert [found[i]["n_links"] for i in range(len(vectors))] == (near.sum(1) - 1).tolist()
        assert [found[i]["component_id"] for i in range(len(vectors))] == least
        assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(200, 205))


def test_embedding_passes_are_on_disk_a_few_at_a_time(spark, monkeypatch):
    seen, ranked = [], embedding_dedup.with_rank

    def counted(rows, order):
        seen.append(rows.count())
        return ranked(rows, order)

    monkeypatch.setattr(embedding_dedup, "with_rank", counted)
    monkeypatch.setattr(embedding_dedup, "PASS_ROWS", 300, raising=False)
    monkeypatch.setattr(embedding_dedup, "FETCHED", 10, raising=False)
    rng = np.random.default_rng(8)
    vectors = np.concatenate([c + 0.03 * rng.standard_normal((3, 24)) for c in rng.standard_normal((40, 24))])
    vectors[:60] = vectors[:60].astype(np.float32)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    least = _classes(len(vectors), [(a, b) for a in range(len(vectors)) for b in range(a) if near[a, b]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = sorted(embedding_dedup.near_duplicates(df, passes=6).collect(), key=lambda r: r["vec_id"])
    assert [r["n_links"] for r in found] == (near.sum(1) - 1).tolist()
    assert [r["component_id"] for r in found] == least
    assert max(seen) <= 300


# --- 10 --------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = np.random.default_rng(8)
    plain = lambda: " ".join(f"{''.join(rng.choice(list('abcdefgh'), 4))}" for _ in range(30))
    rows = [(i, plain() + (" you IDIOT " if i % 4 == 0 else " ") + plain(), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn_lexicon(df.drop("toxic"), df.select("doc_id", "toxic"), label="toxic")
    assert any(t.strip().startswith("idio") for t in lexicon.weights)
    texts = [plain() + " !d10t " + plain(), plain() + " іdiоt", plain(), None, "", "idiotic"]
    found = {r["doc_id"]: r for r in toxicity.score_texts(docs(spark, texts), lexicon).collect()}
    assert [found[i]["predicted"] for i in range(6)] == [1, 1, 0, 0, 0, 1]
    assert toxicity.without_toxic(docs(spark, texts), lexicon).count() == 3
    lexicon.exceptions = {" no idiot "}
    assert toxicity.matches(" no idiot here ", lexicon.automaton()) == []
    empty = toxicity.learn_lexicon(df.drop("toxic").limit(0), df.select("doc_id", "toxic").limit(0), label="toxic")
    assert toxicity.score_texts(docs(spark, ["a", None]), empty).count() == 2


def test_crc_of_ids_as_text(spark):
    from tallyloom.llm.common import id_remainder

    found = spark.range(50).select("id", id_remainder("id", 10).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 10 for r in found)


def test_large_ids_beside_null_ones(spark):
    ids = [2**60 + 1, None, 2**60 + 3, -(2**62) - 1]
    table = spark.createDataFrame([(i, f"some words of text number {k} here", True) for k, i in enumerate(ids)], "doc_id long, text string, train boolean").coalesce(1)
    expected = sorted(map(str, ids))
    pages = table.selectExpr("doc_id as page_id", "'http://a.b/c' as url", "text as html")
    trees = language_id.learn_trees(table.withColumn("lang", F.lit("en")))
    tokenizer = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    items = spark.createDataFrame([(2**60 + 7, "words of text number"), (None, "some words of text")], "item_id long, text string").coalesce(1)
    found = {
        "op1": html_extraction.extract(pages).withColumnRenamed("page_id", "doc_id"),
        "op3": language_id.predict(table, trees),
        "op4": token_output.read_tokens(token_output.write_tokens(table, tokenizer)),
        "op6": simhash.near_duplicates(table),
        "op7": hmm_lm.score_texts(table, train="train"),
        "op8": substring_dedup.remove_repeats(table),
        "op10": toxicity.score_texts(table, toxicity.Lexicon({})),
    }
    for name, result in found.items():
        assert sorted(str(r["doc_id"]) for r in result.select("doc_id").collect()) == expected, name
    hits = decontamination.contaminated(table, items).select("doc_id", "item_id").collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in hits) == sorted((i, j) for i in expected for j in (str(2**60 + 7), "None"))


# --- learning on rows whose ids say nothing, and repetitive texts ----------------------------------------------


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 5, lambda i: i if i % 3 else None])
def test_learning_with_null_and_equal_ids(spark, ids):
    rng = np.random.default_rng(3)
    pools = {"xx": "kalo mira tuve sano peli", "yy": "brugt skov hjem vand stol"}
    rows = [(ids(i), " ".join(rng.choice(pools[g].split(), 6)) + f" {i}", g) for i, g in enumerate(("xx", "yy") * 300)]
    rows += [(ids(i), "kalo mira kalo", "xx") for i in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language_id.learn_trees(df, sample_rows=40)
    assert trees.languages == ["xx", "yy"]
    found = language_id.predict(df, trees).join(df.select("text", "lang").distinct().withColumnRenamed("text", "t"), F.lit(False), "left").select("lang_pred").collect()
    assert Counter(r["lang_pred"] for r in found) == Counter(g for *_, g in rows)
    labels = spark.createDataFrame([(ids(i), int(i % 2)) for i in range(600)] + [(5, 0), (5, 1)], "doc_id long, toxic int")
    docs_ = spark.createDataFrame([(5, ("vilebad " if i % 2 else "nice ") + f"w{i} some words here", None) for i in range(500)], "doc_id long, text string, lang string")
    lexicon = toxicity.learn_lexicon(docs_, labels, label="toxic", sample_rows=50)
    assert toxicity.score_texts(docs_, lexicon).count() == 500


def test_repetitive_texts_are_compared_in_slices(monkeypatch):
    index = decontamination.Index.of(["1", "2"], ["a " * 60, "the quick brown fox jumps over it"], decontamination.Q, decontamination.BUDGET)
    texts = ["a " * 700 + "the quick brown fox jumps over it " + "a " * 50, "a " * 59, "a " * 60, "b " * 400]
    whole = [decontamination.found_in(decontamination.normalised(t), index) for t in texts]
    assert [sorted(f) for f in whole] == [[0, 1], [0], [0], []]
    monkeypatch.setattr(decontamination, "HITS", 100)
    assert [decontamination.found_in(decontamination.normalised(t), index) for t in texts] == whole


@pytest.mark.parametrize(("cosine", "beside"), [(0.92, 0), (0.91, 900)])
def test_loose_crowds_lose_no_links(spark, cosine, beside):
    rng = np.random.default_rng(17)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centre, n, dims = unit(rng.standard_normal((1, 64))), 1300, 64
    crowd = unit(np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * unit(rng.standard_normal((n, dims))))
    x = np.r_[crowd, unit(rng.standard_normal((beside, dims)))] if beside else crowd
    linked = x @ x.T >= embedding_dedup.THRESHOLD
    np.fill_diagonal(linked, False)
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = sorted((root(int(i)), root(int(j))))
        parent[b] = a
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = embedding_dedup.near_duplicates(df).toPandas().set_index("vec_id").sort_index()
    assert linked.sum() > 200
    assert found["n_links"].tolist() == linked.sum(1).tolist()
    assert found["component_id"].tolist() == [root(i) for i in range(len(x))]


def test_hmm_learns_from_all_training_documents(spark, monkeypatch):
    seen = []

    def counted(model, sequences, tasks, prior):
        seen.append(sequences.count())
        return model

    monkeypatch.setattr(hmm_lm, "_round", counted)
    df = spark.range(4500).selectExpr("id AS doc_id", "concat('word ', id % 7) AS text")
    assert hmm_lm.score_texts(df, train="doc_id % 10 <> 0").count() == 4500
    assert set(seen) == {4050}
