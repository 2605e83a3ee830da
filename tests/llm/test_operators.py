"""The training-data operators against brute force on small, awkward tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

INTERNAL = "_chunks _lines _hashes _ends _kept _drop rest row kept counts n_lines_ text_id hi lo late idx start size spans found slots range hash rank rn offset first spot tile early _h _source _range mix_slots".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, drop string, h string, key string, n int, comp string, bucket string, grams string, "
SCHEMA += ", ".join(f"`{c}` string" for c in INTERNAL)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(40)) for _ in range(n))


def awkward(seed=1):
    """(doc_id, text) with nulls, empty and very long texts, copies, near copies and repeated rows."""
    rng = random.Random(seed)
    base = [words(rng, 60) for _ in range(5)]
    rows = []
    for i in range(60):
        t = base[i % 5].split(" ")
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = "edit" + str(rng.randrange(9))
        rows.append((i, "\n".join(" ".join(t[k : k + 12]) for k in range(0, 60, 12)) if i % 2 else " ".join(t)))
    rows += [(60 + i, words(rng, 50)) for i in range(20)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "one"), (104, "one two"), (105, words(rng, 9000)), (106, "ÄÖÜ ñ 日本 ☃ " * 30), (107, "A b"), (108, "a B"), (7, rows[7][1]), (None, "no id here at all"), (None, None)]
    return rows


def frame(spark, rows):
    """With further columns whose names clash with those the operators use inside."""
    more = [(k, t, ["en", "de", None][(k or 0) % 3], ["a", "b", None, "a"][(k or 0) % 4], None, "x", "y", "z", 1, "c", "d", "e", *INTERNAL) for k, t in rows]
    return spark.createDataFrame(more, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# words that a Python worker remembers between its tasks
def test_codes_are_bounded_and_of_one_operator_at_a_time():
    from stockmerge.llm import decontaminate, jaccard
    from stockmerge.llm.common import Codes, word_code

    few = Codes(limit=100)
    many = [f"w{i % 170}" for i in range(1000)] + ["long" * 1000]
    most = 0

    def counted(word):
        nonlocal most
        most = max(most, len(few))
        return word_code(word)

    few.code = counted
    assert few.array(many).tolist() == [word_code(w) for w in many]  # one text with more words than are remembered
    assert most <= 100 and len(few) <= 100 and "long" * 1000 not in few
    text = " ".join(f"Word{i}" for i in range(300))
    for _ in range(2):
        jaccard.shingles(text, 5)
        assert len(jaccard._CODES) == 300 and not decontaminate._KNOWN and not few
        decontaminate.readings(text)
        assert decontaminate._KNOWN and not jaccard._CODES


# 1
def line_chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, own = [], []
    for i, line in enumerate(lines):
        own.append(line)
        if i == len(lines) - 1 or (h[i] + (31 * h[i - 1] if i else 0)) % 1_000_003 % 4 == 0:
            out.append(own)
            own = []
    return out


def test_line_dedup(spark, empty):
    from stockmerge.llm.lines import dedup

    rng = random.Random(3)
    block = ["\n".join(words(rng, 5) for _ in range(9)) for _ in range(4)]
    rows = [(i, "\n".join([words(rng, 4), block[i % 4], words(rng, 3), block[(i + 1) % 4]])) for i in range(20)] + awkward()
    got = {(r["doc_id"], r["n_lines"], r["removed_chunks"], r["removed_lines"], r["text"]) for r in dedup(frame(spark, [r for r in rows if r[0] != 7])).collect()}
    seen, want = set(), set()
    for k, t in sorted((r for r in rows if r[0] is not None and r[0] != 7), key=lambda r: (r[0], r[1] or "")):
        if t is None:
            want.add((k, 0, 0, 0, None))
    # ids below 20 occur twice here: rows with one id count as one document, so leave those out of the comparison
    twice = set(range(20))
    first = {}
    for k, t in rows:
        if k is not None and t is not None and k != 7:
            for c in line_chunks(t):
                if len(c) > 1:
                    first[tuple(c)] = min(first.get(tuple(c), k), k)
    for k, t in rows:
        if k is None or t is None or k in twice:
            continue
        kept, gone, seen = [], 0, set()
        for c in line_chunks(t):
            if len(c) > 1 and (first[tuple(c)] < k or tuple(c) in seen):
                gone += len(c)
            else:
                kept += c
            seen.add(tuple(c))
        assert any(g[0] == k and g[3] == gone and g[4] == "\n".join(kept) for g in got), k
    assert sum(g[3] for g in got) > 50
    assert dedup(empty).count() == 0
    assert dedup(empty).columns[: len(empty.columns)] == empty.columns


def test_line_dedup_keeps_each_text_of_an_id(spark):
    from stockmerge.llm.lines import clean, dedup

    rng = random.Random(13)
    a, b, c = ("\n".join(words(rng, 4) for _ in range(12)) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (5, b), (7, c), (7, a + "\n" + c)]
    for runs in (False, True):
        out = dedup(frame(spark, rows), runs=runs).collect()
        assert sum(r["text"] == b and r["removed_lines"] == 0 for r in out) == 2
        assert all(r[x] == x for r in out for x in INTERNAL)
        kept = "\n".join(r["text"] for r in out).split("\n")
        assert {*a.split("\n"), *b.split("\n"), *c.split("\n")} <= set(kept)
    left = clean(frame(spark, rows).withColumn("n_lines", F.lit("77")))
    assert {r["n_lines"] for r in left.collect()} == {"77"} and left.columns[-1] == "n_lines"


def test_line_dedup_leaves_nothing_of_a_copy(spark):
    from stockmerge.llm.lines import dedup

    rng = random.Random(12)
    texts = ["\n".join(words(rng, 4) for _ in range(2 + i % 12)) for i in range(60)]
    assert sum(len(c) == 1 for t in texts for c in line_chunks(t)) > 30
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)] + [(300, "one line"), (301, "one line"), (302, None), (None, texts[0])]
    rows += [(400, "\n".join(["same"] * 9)), (500, texts[3]), (500, texts[4])]  # one id, two texts
    out = {}
    for r in dedup(frame(spark, rows), runs=True).collect():
        out.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        n = t.count("\n") + 1
        assert out[i][0]["text"] == t and out[i][0]["removed_lines"] == 0
        assert out[100 + i][0]["text"] == "" and out[100 + i][0]["removed_lines"] == n
    assert out[301][0]["text"] == "one line" and out[302][0]["text"] is None and out[None][0]["text"] == texts[0]
    assert out[400][0]["text"].startswith("same")


# 2
def sets(rows, k):
    import re

    out = []
    for key, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append((key, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    return out


@pytest.mark.parametrize("k,least,p,q", [(3, "9/10", 9, 10), (5, "4/5", 4, 5), (1, "1/2", 1, 2)])
def test_ngram_jaccard(spark, docs, empty, k, least, p, q, request):
    from stockmerge.llm.jaccard import cluster

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5 if k == 5 else 10_000)  # groups that cross batches
    request.addfinalizer(lambda: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000))

    rows = awkward()
    own = sets(rows, k)
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(own):
        for b, t in own[:i]:
            if a is not None and b is not None and s and t and q * len(s & t) >= p * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = sorted((a if a is not None else -1, len(s), find(a) if a is not None else -1) for a, s in own)
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1) for r in cluster(docs, k, least).collect())
    assert got == want
    assert len({w[2] for w in want}) < len(want) - 10
    assert cluster(empty, k, least).count() == 0


def test_ngram_jaccard_without_leaders_is_the_same(spark, docs):
    from stockmerge.llm.jaccard import cluster

    a = {tuple(r) for r in cluster(docs, 3, "9/10", leaders=False).collect()}
    assert a == {tuple(r) for r in cluster(docs, 3, "9/10", leaders=True).collect()}


def test_ngram_jaccard_tiles(spark):
    """A large component meets the others of its bucket, in cells and tiles of bounded size; a bucket of one component meets
    nothing; every pair of two components is in some tile."""
    from fractions import Fraction

    from stockmerge.llm.jaccard import SKETCH, TILE, Rule, bucket_tiles, cells

    comp = {k: 0 if k < 300 else 1 if k < 400 else k for k in range(460)}
    members = spark.createDataFrame([(7, k) for k in comp] + [(8, k) for k in range(300)] + [(9, 5), (9, 459)] + [(10, k) for k in comp], "bucket long, key long")
    labels = spark.createDataFrame(list(comp.items()), "key long, comp long")
    dealt = cells(members, labels, 32).collect()
    size, met = {}, set()
    for r in dealt:
        size.setdefault(r["cell"], []).append(r)
    for rows in size.values():
        assert len(rows) <= 140
        met |= {(x["key"], y["key"]) for x in rows for y in rows if x["key"] < y["key"] and x["comp"] != y["comp"] and (x["side"] != y["side"] or not x["cross"])}
    want = {(a, b) for a in comp for b in comp if a < b and comp[a] != comp[b]}
    assert met == want
    assert len(dealt) < 8000 and all(len({x["comp"] for x in rows}) > 1 for rows in size.values())
    counts = bytearray([1] * 40 + [0] * (SKETCH - 40))
    for n in (40, 40_000):  # n-grams of a set bound the tiles too
        classes = spark.createDataFrame([(k, n, counts if n == 40 else bytearray(np.full(SKETCH, n, np.uint32).tobytes())) for k in comp], "key long, n int, counts binary")
        for block in (32, 1024):
            found, rows = set(), bucket_tiles(members, classes, labels, Rule(3, Fraction(9, 10)), block=block).collect()
            for r in rows:
                assert len(r["keys"]) == len(r["ns"]) <= (2 * TILE if n == 40 else 60)
                i = r["split"]
                for a, b in [(a, b) for a in r["keys"][:i] for b in r["keys"][i:]] if i else [(a, b) for a in r["keys"] for b in r["keys"] if a < b]:
                    found.add((min(a, b), max(a, b)))
            assert found >= want
            assert len({r["tile"] for r in rows}) == len(rows)


def test_ngram_jaccard_counts_by_fragment(spark):
    """The overlap is the sum of the fragments' partial overlaps: with one fragment left out, links are lost."""
    from fractions import Fraction

    from stockmerge.llm import jaccard as j

    rng = random.Random(31)
    base = [words(rng, 90).split(" ") for _ in range(4)]
    rows = []
    for i in range(40):
        t = list(base[i % 4])
        t[rng.randrange(90)] = f"new{i}"
        rows.append((i, " ".join(t)))
    rule, docs = j.Rule(3, Fraction(4, 5)), spark.createDataFrame(rows, "doc_id long, text string")
    described = j.cut(j.describe(docs.withColumn("text_id", F.xxhash64("text")), 3))
    order = j.global_order(described)
    classes = described.where("kind = 0").select("key", "doc_id", "n", "counts")
    by_id = {r["doc_id"]: r for r in classes.collect()}
    tiles = spark.createDataFrame([(1, 0, [by_id[i]["key"] for i in range(40)], [by_id[i]["n"] for i in range(40)]), (2, 3, [by_id[i]["key"] for i in range(8)], [by_id[i]["n"] for i in range(8)])], j._TILE)
    parts = j.cut(j.partial_overlaps(j.cut_sets(tiles, docs, classes, rule, order)))
    own = {k: {tuple(x) for x in zip(t.split(" "), t.split(" ")[1:], t.split(" ")[2:])} for k, t in rows}
    pieces = {}
    for r in parts.collect():
        pieces.setdefault(r["tile"], {})[r["piece"]] = np.frombuffer(r["counts"], "<i4")
    assert all(len(p) == j.PIECES for p in pieces.values())
    total = {t: sum(p.values()) for t, p in pieces.items()}
    assert all(total[1].reshape(40, 40)[a][b] == len(own[a] & own[b]) for a in range(40) for b in range(40) if a != b)
    assert total[2].reshape(3, 5).tolist() == [[len(own[a] & own[b]) for b in range(3, 8)] for a in range(3)]
    edges = j.summed_links(parts, tiles, rule).count()
    assert edges == 36 + 3 and j.summed_links(parts.where("piece <> 3"), tiles, rule).count() < edges


def test_ngram_jaccard_equal_buckets_are_one(spark):
    """Near copies share many n-grams: their buckets have the same members and become one, with their number."""
    from fractions import Fraction

    from stockmerge.llm.jaccard import Rule, shared_grams

    rows = [(g, k, 100) for g in range(1000) for k in ((1, 2) if g % 2 else (1, 2, 3))] + [(5000 + k, k, 100) for k in range(50)] + [(7000, k, n) for k, n in ((8, 50), (9, 100))]
    out = shared_grams(spark.createDataFrame(rows, "gram long, key long, n int"), Rule(3, Fraction(9, 10))).collect()
    members = {}
    for r in out:
        assert r["lead"] == 1
        members.setdefault(r["bucket"], {})[r["key"]] = r["often"]
    assert {tuple(sorted(m)) for m in members.values()} == {(1, 2), (1, 2, 3)}
    assert all(len(set(m.values())) == 1 for m in members.values())
    assert [sum(m[1] for m in members.values() if len(m) == n) for n in (2, 3)] == [500, 500]
    assert len(members) <= 2 + 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ngram_jaccard_first_look(spark):
    """Of the members of a bucket only those with a partner get whole sketches; folded ones are narrow and lose no link."""
    from fractions import Fraction

    from stockmerge.llm import jaccard as j

    rule, rng = j.Rule(3, Fraction(9, 10)), np.random.default_rng(5)
    sets = {k: rng.integers(0, 1 << 63, 300 if k < 140 else 3000, np.uint64) for k in range(150)}
    near = [(3, 77), (20, 101), (141, 149)]
    for a, b in near:
        sets[b] = np.r_[sets[a][: len(sets[a]) * 96 // 100], sets[b][: len(sets[a]) * 4 // 100]]
    n = int(j.widths(rule, np.arange(1, 1000)).searchsorted(32)) + 1  # widths change here
    sets[30] = rng.integers(0, 1 << 63, n, np.uint64)
    sets[31] = sets[30][:-1]
    counts = {k: j.sketch(s) for k, s in sets.items()}
    classes = spark.createDataFrame([(k, len(s), bytearray(counts[k].astype(np.uint8).tobytes())) for k, s in sets.items()], "key long, n int, counts binary")
    few = {r["key"]: len(r["few"]) for r in j.folded(classes, rule).collect()}
    assert few[0] == 32 and few[140] == 64 and (few[30], few[31]) == (32, 16)
    members = spark.createDataFrame([(7, k) for k in sets], "bucket long, key long")
    labels = spark.createDataFrame([(k, k) for k in sets], "key long, comp long")
    for block in (64, 1024):
        left = {r["key"] for r in j.possible(j.cells(members, labels, block), classes, rule).collect()}
        assert left >= {x for p in [*near, (30, 31)] for x in p} and len(left) <= 15
        tiles = j.bucket_tiles(members, classes, labels, rule, block=block).collect()
        assert all(any(a in t["keys"] and b in t["keys"] for t in tiles) for a, b in [*near, (30, 31)])


def test_ngram_jaccard_long_sets(spark):
    """The longer a set, the more pieces its sketch has: long texts that share an n-gram by chance come into no tile, near copies do, across
    widths too; a count beyond a byte is read back."""
    from stockmerge.llm import jaccard as j

    rng = np.random.default_rng(11)
    rows = {i: [f"w{x}" for x in rng.integers(0, 1 << 40, 9000)] for i in range(24)}
    rows |= {30: [f"w{x}" for x in rng.integers(0, 1 << 40, 4900)], 40: [f"w{x}" for x in rng.integers(0, 1 << 40, 100)]}
    near = [(3, 17), (30, 31)]
    rows[17] = rows[3][:8800] + rows[17][:200]
    rows[31] = rows[30][:4600]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    classes = j.cut(j.describe(docs.withColumn("text_id", F.xxhash64("text")), 5).where("kind = 0").select("key", "doc_id", "n", "counts"))
    by_id = {r["doc_id"]: r for r in classes.collect()}
    key = {i: r["key"] for i, r in by_id.items()}
    members = spark.createDataFrame([(7, key[0], k, 1) for k in key.values()], "bucket long, lead long, key long, often long")
    labels = members.select("key", F.col("key").alias("comp"))
    met = lambda tiles: {frozenset((a, b)) for t in tiles.collect() for a in t["keys"][: t["split"] or None] for b in t["keys"][t["split"] :] if a != b}
    want = {frozenset((key[a], key[b])) for a, b in near}
    for near_rows in (4, 48):
        assert met(j.bucket_tiles(members.select("bucket", "key"), classes, labels, j.Rule(), near=near_rows)) >= want
        assert {x for p in met(j.bucket_tiles(members.select("bucket", "key"), classes, labels, j.Rule(), near=near_rows)) for x in p} == {x for p in want for x in p}
    assert j.leader_tiles(members, classes, j.Rule()).count() == 0
    heads = spark.createDataFrame([(7, key[a], key[b], 1) for a, b in near], "bucket long, lead long, key long, often long")
    assert met(j.leader_tiles(heads, classes, j.Rule())) == want
    assert len(by_id[30]["counts"]) == 2 * len(by_id[31]["counts"]) == 2 * j.SKETCH and len(by_id[40]["counts"]) == j.SKETCH
    sizes = [600, 600, 9000]
    some = [np.r_[300, 300, np.zeros(254, int)], np.r_[299, 301, np.zeros(254, int)], j.sketch(rng.integers(0, 1 << 63, 9000, np.uint64), 512)]
    both = j.Sketches(j.Rule(), np.array(sizes), [j.packed(c) for c in some])
    assert both.likely(np.array([0, 0]), np.array([1, 2])).tolist() == [True, False]
    assert all(both.folded(np.array([i]), len(c)).tolist() == [c.tolist()] for i, c in enumerate(some))
    fine = j.Sketches(j.Rule(), np.array([9000, 9000]), [j.packed(some[2]), j.packed(some[2].reshape(2, 256).sum(0))])
    assert fine.likely(np.array([0, 1]), np.array([1, 0])).all()


def test_keep_first(spark):
    from stockmerge.llm.jaccard import keep_first

    rng = random.Random(14)
    a, b, c = (words(rng, 40) for _ in range(3))
    rows = [(1, a), (2, a + " more"), (3, b), (3, b), (4, c), (4, b + " x"), (5, None), (5, None), (None, a), (6, c)]
    out = keep_first(frame(spark, rows), words=5, least="4/5")
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert got.count((3, b)) == 1 and got.count((1, a)) == 1 and got.count((4, c)) == 1 and (None, a) in got
    assert not any(k in (2, 6) for k, _ in got)


# 3
def gradient_by_differences(f, p):
    return [(f(p + e) - f(p - e)) / 2e-5 for e in np.eye(len(p)) * 1e-5]


def test_quality_thresholds_fit_the_labels():
    """The recalibrated thresholds are a stationary point of the likelihood, worked out row by row."""
    from stockmerge.llm.quality import recalibrated

    rng = np.random.default_rng(3)
    y = np.repeat([0, 1, 2], 60)
    x = y * 0.8 + rng.normal(size=180)
    counts = {0: 50, 1: 400, 2: 900}
    m = recalibrated(np.ones(1), np.array([0.3, 1.2]), x, y, counts)

    def loss(p):
        total = 0.0
        for s, g in zip(x, y):
            for k in (0, 1):
                over = 1 / (1 + np.exp(-(p[0] * s - p[1 + k])))
                total -= counts[g] / 60 / 1350 * np.log(over if g > k else 1 - over)
        return total + 0.5e-4 * (p[0] - 1) ** 2

    p = np.r_[m.weights[0], m.thresholds]
    assert np.abs(gradient_by_differences(loss, p)).max() < 1e-4
    over = 1 / (1 + np.exp(-(p[0] * x[:, None] - p[None, 1:])))
    weight = np.array([counts[g] / 60 for g in y])
    assert abs((over[:, 1] * weight).sum() / weight.sum() - 900 / 1350) < 0.02  # calibrated as a whole


def test_quality(spark, empty):
    from stockmerge.llm.quality import bucket, classify, fit, grades

    rng = random.Random(5)
    good, bad, foul = ["clear", "sound", "proof"], ["junk", "spam", "click"], ["vile", "scum", "trash"]
    rows, labels = [], []
    for i in range(240):
        g = i % 3
        rows.append((i, " ".join(rng.choice([foul, bad, good][g] + ["the", "of", "and"]) for _ in range(40))))
        if i < 180:
            labels.append((i, int(g == 2), int(g == 0), "x"))
    rows += [(900, None), (901, ""), (902, "  ")]
    lab = spark.createDataFrame(labels + [(None, 1, 0, "x"), (5000, None, None, "x"), labels[0]], "doc_id long, quality int, toxic int, text string")
    df = frame(spark, rows)
    model = fit(df.select("doc_id", "text"), grades(lab))
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    out = {r["doc_id"]: r for r in classify(df, lab).collect()}
    held = [i for i in range(180, 240)]
    assert sum(out[i]["grade"] == i % 3 for i in held) >= 57
    assert all(out[i]["selected"] == (i % 3 == 2) for i in held)
    for i in held[:9]:  # the grades' probabilities, worked out word by word
        count = {}
        for w in dict(rows)[i].split(" "):
            count[bucket(w)] = count.get(bucket(w), 0) + 1
        value = {k: 1 + np.log(n) for k, n in count.items()}
        z = sum(model.weights[k] * v for k, v in value.items()) / np.sqrt(sum(v * v for v in value.values()))
        over = [1 / (1 + np.exp(t - z)) for t in model.thresholds]
        assert abs(out[i]["expected_grade"] - sum(over)) < 1e-6 and abs(out[i]["tail_probability"] - over[1]) < 1e-6
    assert [out[i]["expected_grade"] for i in (900, 901, 902)] == [0, 0, 0]
    assert not out[900]["selected"]
    assert classify(empty, lab).count() == 0
    assert not any(r["selected"] for r in classify(df, lab.limit(0)).collect())


def test_quality_sample_is_bounded_for_a_repeated_id(spark):
    from stockmerge.llm.quality import grades, sample

    rng = random.Random(8)
    rows = [(1, words(rng, 5)) for _ in range(900)] + [(1, "the same text")] * 300 + [(k, words(rng, 5)) for k in range(2, 30)]
    graded = grades(spark.createDataFrame([(k, k % 2, 0) for k in range(1, 30)], "doc_id long, quality int, toxic int"))
    got = sample(frame(spark, rows), graded, 40).collect()
    per = {g: [r for r in got if r["grade"] == g] for g in (1, 2)}
    assert len(per[1]) == 14 and len(per[2]) == 40 and sorted(r["rn"] for r in per[2]) == list(range(1, 41))


def test_quality_fit_against_a_plain_fit(spark):
    """The likelihood's gradient at the fitted model is near zero, worked out over dense rows."""
    from stockmerge.llm.quality import fit, grades, sample

    rng = random.Random(12)
    marks = ["bad awful", "plain dull", "fine great"]
    rows = [(k, marks[k % 3] + " " + words(rng, 12)) for k in range(150)]
    graded = grades(spark.createDataFrame([(k, int(k % 3 == 2), int(k % 3 == 0)) for k in range(150)], "doc_id long, quality int, toxic int"))
    df = frame(spark, rows).select("doc_id", "text")
    model = fit(df, graded)
    pdf = sample(df, graded, 1500).toPandas()
    x, y = np.zeros((len(pdf), 1 << 14)), pdf["grade"].to_numpy()
    for i, (at, value) in enumerate(zip(pdf["at"], pdf["value"], strict=True)):
        x[i, at] = value

    def loss(w, t):
        over = np.c_[np.ones(len(y)), 1 / (1 + np.exp(t[None] - (x @ w)[:, None])), np.zeros(len(y))]
        return -np.log(np.maximum((over[:, :-1] - over[:, 1:])[np.arange(len(y)), y], 1e-300)).mean()

    # plain gradient descent of the same likelihood from zero ends no better than the fit did
    w, t = np.zeros(1 << 14), np.array([-1.0, 1.0])
    for _ in range(400):
        over = 1 / (1 + np.exp(t[None] - (x @ w)[:, None]))
        miss = over - (y[:, None] > np.arange(2)[None])
        w, t = w - x.T @ miss.sum(1) / len(y), t + 0.3 * miss.mean(0)
    assert loss(model.weights, model.thresholds) <= loss(w, t) + 0.02
    assert (((x @ model.weights)[:, None] > model.thresholds[None]).sum(1) == y).mean() == 1


# 4
def test_decontaminate(spark, empty):
    from stockmerge.llm.decontaminate import flag, remove, template

    assert template("Ann has 3 apples")[2].tolist() == [False, False, True, False]
    assert template("He paid Bob 5kg of tea, 12 km away")[2].tolist() == [False, False, True, True, True, False, False, True, True, False]
    rng = random.Random(9)
    question = "A train that leaves from Boston at 9 travels 120 km until it meets Boston again so how far from Boston does it stop after 9 more stations"
    items = spark.createDataFrame([(1, question, 0), (2, words(rng, 30), 0), (3, "short item here", 0), (4, None, 0), (5, "", 0), (None, "x", 0)], "item_id long, text string, doc_id int")
    changed = question.replace("Boston", "Leeds").replace("9", "7").replace("120", "455")
    mixed = changed.replace("from Leeds does", "from York does").replace("meets Leeds", "meets Hull")
    rows = [(10, words(rng, 40) + " " + question), (11, words(rng, 30) + ". " + changed + " " + words(rng, 9)), (12, mixed), (13, words(rng, 200)), (14, "a short item here it is"), (15, None), (16, ""), (11, None), (None, question), (17, question[:40])]
    out = {}
    for r in flag(frame(spark, rows), items).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert out[10][0]["contaminated"] and out[10][0]["items"] == [1]
    assert sorted(r["contaminated"] for r in out[11]) == [False, True]  # the text that leaks, and the null one of the same id
    assert out[14][0]["items"] == [3]
    for k in (12, 13, 15, 16, 17, None):
        assert not any(r["contaminated"] for r in out[k]), k
    left = remove(frame(spark, rows), items)
    assert sorted((r["doc_id"] or 0, r["text"] is None) for r in left.collect()) == [(0, False), (11, True), (12, False), (13, False), (15, True), (16, False), (17, False)]
    assert flag(empty, items).count() == 0
    assert not any(r["contaminated"] for r in flag(frame(spark, rows), items.limit(0)).collect())


def test_decontaminate_reparameterised(spark):
    from stockmerge.llm.decontaminate import flag

    rng = random.Random(21)
    short = "Tom has 5 apples and 3 pears. Tom buys 3 more apples now. Tom eats 2 of these apples. Tom sells all the pears left."
    other = short.replace("Tom", "Anna").replace("5", "7").replace("3", "8").replace("2", "6")
    long = words(rng, 40)
    put = long.split(" ")
    put.insert(20, "really")
    slots = "Boston lies " + words(rng, 18) + " Boston " + words(rng, 18) + " near Boston " + words(rng, 3)
    wrong = slots.replace("Boston", "Leeds").replace("near Leeds", "near York")
    sums = "12 34 46 and 7 8 56 or 9 9 81 17"
    repeated = "row row row " * 10
    items = spark.createDataFrame([(1, short), (2, long), (3, slots), (4, sums), (5, repeated)], "item_id long, text string")
    rows = [(1, words(rng, 30) + ".\n" + other + " " + words(rng, 30)), (2, words(rng, 9) + " " + " ".join(put)), (3, words(rng, 9) + ". " + wrong), (4, "so " + sums + " then"), (5, "row row " * 3000)]
    rows += [(11, "Anna has 7 bananas. Bob buys 8 more apples. Carl eats 6 of these."), (12, " ".join(long.split(" ")[:18])), (14, "so 1 2 3 and 4 5 20 or 6 6 36 5"), (15, "row row row")]
    # two halves far from each other are not one copy
    rows.append((16, " ".join(long.split(" ")[:22]) + " " + words(rng, 400) + " " + " ".join(long.split(" ")[22:])))
    out = {r["doc_id"]: r["items"] for r in flag(frame(spark, rows), items).collect()}
    assert {k: out[k] for k in (1, 2, 3, 4, 5)} == {k: [k] for k in (1, 2, 3, 4, 5)}
    assert {k: out[k] for k in (11, 12, 14, 15, 16)} == {k: [] for k in (11, 12, 14, 15, 16)}


def naive_coverage(text, item, size=8, least_plain=4):
    """The best share of an item's windows in any stretch of the text as long as the item and a half and two windows, counted window by window."""
    from stockmerge.llm.decontaminate import readings

    def plain_windows(t, literal):
        words, codes, slot, loose, own = readings(t)
        low = [w.strip("\"'`.,;:!?()[]{}").lower() for w in words]
        n, out = min(size, len(codes)), []
        for flags, shown in ((slot, codes), (slot | loose, None)):
            for i in range(len(codes) - n + 1):
                if flags is not slot and not loose[i : i + n].any():
                    continue
                if (~flags[i : i + n]).sum() >= min(least_plain, n):
                    form = tuple("<slot>" if f else w for f, w in zip(flags[i : i + n], low[i : i + n], strict=True))
                    out.append((i, form, tuple(low[k] for k in range(i, i + n) if flags[k])))
        return out

    have, want = plain_windows(text, True), plain_windows(item, None)
    if not want:
        return 0.0
    span = max(i for i, _, _ in want) - min(i for i, _, _ in want) + 1
    width = span + span // 2 + 2 * size
    best = 0
    for start in sorted({i for i, _, _ in have}):
        hits = [(i, j, fill, slots) for i, form, fill in have if start <= i < start + width for j, other, slots in want if form == other]
        votes = {}
        for _, _, fill, slots in hits:
            for s, v in set(zip(slots, fill, strict=True)):
                votes.setdefault(s, {}).setdefault(v, []).append(1)
        most = {s: min(v, key=lambda x: (-len(v[x]), x)) for s, v in votes.items()}
        held = {j for _, j, fill, slots in hits if all(most[s] == v for s, v in zip(slots, fill, strict=True))}
        best = max(best, len(held))
    return best / len({j for j, _, _ in want})


def question(rng, values):
    """A question of its own wording with slots for two names and three numbers."""
    w = lambda n: " ".join(rng.choice("walks takes gives shares finds sells keeps counts with from under while until some many small green boxes stones cards roads after before then also never".split()) for _ in range(n))
    form = f"When {{0}} {w(5)} {{2}} {w(4)} and {{1}} {w(5)} {{3}} {w(3)} of what {{0}} {w(4)}, how much {w(3)} {{4}} {w(4)} for {{1}}?"
    return form, form.format(*values)


def test_decontaminate_recall_and_naive_windows(spark):
    """Planted copies, re-parameterised and with words put in, are found; clean texts are left alone; coverage is that of a plain count."""
    from stockmerge.llm.decontaminate import flag

    rng = random.Random(31)
    names = ["Anna", "Boris", "Carla", "Dmitri", "Elena", "Farid"]
    draw = lambda: (*rng.sample(names, 2), *(rng.randrange(2, 90) for _ in range(3)))
    forms = [question(rng, draw()) for _ in range(12)]
    items = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(forms)], "item_id long, text string")
    rows = []
    for k in range(60):
        leak = forms[k % 12][0].format(*draw()).split(" ")
        if k % 3 == 1:
            leak.insert(len(leak) // 2, "really")
        rows.append((k, words(rng, 20) + ". " + " ".join(leak) + " " + words(rng, 20 + k)))
    rows += [(100 + k, question(rng, draw())[1] + " " + words(rng, 30)) for k in range(60)]
    out = {r["doc_id"]: r for r in flag(frame(spark, rows), items).collect()}
    assert sum(out[k]["contaminated"] and out[k]["items"] == [k % 12] for k in range(60)) >= 54
    assert not any(out[100 + k]["contaminated"] for k in range(60))
    for k in [*range(0, 60, 7), *range(100, 160, 9)]:
        naive = max(naive_coverage(dict(rows)[k], t) for _, t in forms)
        assert naive - 0.1 <= out[k]["coverage"] <= naive + 1e-9, k


def test_decontaminate_one_template(spark):
    """Documents and items of one template: a row for each document, whatever the number of items; another pattern of equal values is a class of its own."""
    from stockmerge.llm.decontaminate import flag, item_classes, matches

    form = "On his way home Mr {0} walks past {1} shops and buys {2} pencils for {0} and then goes on until all {3} pencils are given away again"
    rng = random.Random(5)
    draw = lambda: (rng.choice(["Abel", "Bruno", "Carlo"]), *rng.sample(range(2, 99), 3))
    texts = [form.format(*draw()) for _ in range(60)]
    twice = form.format("Abel", 7, 7, 12)
    items = spark.createDataFrame([(500 + i, t) for i, t in enumerate(texts)] + [(900, twice)], "item_id long, text string")
    docs = frame(spark, [(i, words(rng, 9) + ". " + form.format(*draw())) for i in range(50)])
    classes = item_classes(items).collect()
    assert {r["class_id"] for r in classes} == {500, 900} and sum(r["class_id"] == 500 for r in classes) == 60
    found = matches(docs, items).collect()
    assert len(found) == 100 and all(r["coverage"] == 1 for r in found if r["item_id"] == 500) and all(r["coverage"] < 1 for r in found if r["item_id"] == 900)
    assert all(r["items"][0] == 500 for r in flag(docs, items).collect())


# 5
def test_mixing(spark, docs, empty):
    from stockmerge.llm.mixing import interleave

    out = interleave(docs, {"a": 2, "b": 1}, block=4).collect()
    assert len(out) == docs.count()
    assert len({(r["mix_slot"], r["mix_rank"]) for r in out}) == len(out)
    per = {}
    for r in out:
        per.setdefault(r["mix_slot"], set()).add(r["source"])
    assert all(len(v) == 1 for v in per.values())
    assert all(r[c] == c for r in out for c in INTERNAL)
    assert interleave(empty).count() == 0


def test_mixing_tiny_weights_and_thirds():
    from fractions import Fraction

    from stockmerge.llm.mixing import run

    for weights, slots in (({"a": 1, "b": 1, "c": 1}, 1_000_000), ({"big": 1, "tiny": Fraction(1, 100_000)}, 300_000)):
        total = sum(map(Fraction, weights.values()))
        target, done = {s: Fraction(w) / total for s, w in weights.items()}, dict.fromkeys(weights, 0)
        for t, (s, _, _, on) in enumerate(run(weights, dict.fromkeys(weights, slots))):
            if t == slots:
                break
            done[s] += 1
            if t % 997 == 0 or t > slots - 50 or s == "tiny":
                assert on and all(abs(done[x] - (t + 1) * target[x]) < 1 for x in weights)
        assert t == slots


def test_mixing_of_many_sources(spark):
    from stockmerge.llm.mixing import interleave

    rows = spark.range(24_000).selectExpr("id AS doc_id", "cast(id % 12000 AS string) AS source")
    out = interleave(rows, block=1).agg(F.count("*"), F.count_distinct("mix_slot"), F.max("mix_slot")).first()
    assert tuple(out) == (24_000, 24_000, 23_999)


def test_mixing_holds_the_weights_given(spark):
    from fractions import Fraction

    from stockmerge.llm.mixing import interleave, run

    many = {str(i): 1 + i % 7 for i in range(300)} | {"big": 900}
    for weights in ({"a": 0.7, "b": 0.2, "c": 0.1}, {"x": 0.5} | {str(i): 0.5 / 19 for i in range(19)}, many):
        total = sum(map(Fraction, weights.values()))
        target, done = {s: Fraction(w) / total for s, w in weights.items()}, dict.fromkeys(weights, 0)
        for t, (s, j, slot, on) in enumerate(run(weights, dict.fromkeys(weights, 4000))):
            if not on or t == 5500:
                break
            assert (t, done[s]) == (slot, j)
            done[s] += 1
            assert all(abs(done[x] - (t + 1) * target[x]) < 1 for x in (weights if t % 250 < 20 else [s]))
        assert t > 4000
    # all blocks get a place, also of sources that run out or weigh nothing
    plan = list(run({"a": 3, "b": 1, "z": 0}, {"a": 5, "b": 40, "z": 3}))
    assert [p[2] for p in plan] == list(range(48)) and [p[0] for p in plan[-3:]] == ["z"] * 3
    assert {(p[0], p[1]) for p in plan} == {("a", j) for j in range(5)} | {("b", j) for j in range(40)} | {("z", j) for j in range(3)}
    rows = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 7 THEN 'a' WHEN id % 10 < 9 THEN 'b' ELSE 'c' END AS source")
    out = {r["mix_slot"]: (r["source"], r["on_target"]) for r in interleave(rows, {"a": 0.7, "b": 0.2, "c": 0.1}, block=2).collect()}
    assert sorted(out) == list(range(3000))
    done = dict.fromkeys("abc", 0)
    for t in range(3000):
        done[out[t][0]] += 1
        assert out[t][1] and all(abs(done[s] - (t + 1) * w) < 1 for s, w in {"a": Fraction(7, 10), "b": Fraction(2, 10), "c": Fraction(1, 10)}.items())


# 6
def brute_suffixes(rows, order=lambda r: r[0]):
    seen, out = set(), []
    for k, t in sorted(rows, key=order):
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = [True] * 100
            else:
                seen.add(b[i : i + 100])
        out.append((k, len(b), sum(gone), sum(y and (i == 0 or not gone[i - 1]) for i, y in enumerate(gone)), hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,part", [(0, None), (1, None), (2, 3)])
def test_suffix_dedup(spark, empty, seed, part, monkeypatch):
    from stockmerge.llm import suffixes

    if part:  # crowded buckets on a small table
        monkeypatch.setattr(suffixes, "PART", part)
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd é") for _ in range(400)) for _ in range(4)]
    rows = []
    for k in range(60):
        t = ""
        for _ in range(rng.randrange(1, 6)):
            r, b = rng.random(), rng.choice(base)
            i = rng.randrange(300)
            t += b[i : i + rng.randrange(20, 350)] if r < 0.5 else "ab " * rng.randrange(1, 90) if r < 0.6 else "".join(rng.choice("abcd é") for _ in range(rng.randrange(10, 200)))
        rows.append((k, t))
    rows += [(500, None), (501, ""), (502, "x" * 99), (503, "x" * 100), (504, "x" * 101), (505, rows[3][1]), (506, rows[3][1] + "zz")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if seed == 0 else 5)  # groups that cross batches
    try:
        assert rows_of(suffixes.dedup(frame(spark, rows))) == brute_suffixes(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    if seed == 0:
        assert suffixes.dedup(empty).count() == 0
        assert suffixes.dedup(frame(spark, awkward())).count() == len(awkward())


def rows_of(out):
    return sorted((tuple(r) for r in out.drop("spans").collect()), key=str)


def test_suffix_dedup_keeps_each_text_of_an_id(spark):
    from stockmerge.llm.suffixes import dedup

    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c = text(640), text(640), text(300)
    rows = [(1, a), (5, a), (5, b), (5, c + b), (7, c), (9, "zz"), (9, a + c)]
    digest = {r["text"]: r["h"] for r in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("h")).collect()}
    got = rows_of(dedup(frame(spark, rows)))
    assert got == brute_suffixes(rows, lambda r: (r[0], digest[r[1]]))
    kept = sum(n - gone for _, n, gone, _, _ in got)
    assert kept <= 640 + 640 + 300 + 2 + 200 and kept >= 640 + 640 + 300
    twice = rows_of(dedup(frame(spark, [(3, a), (3, a), (4, b), (None, a)])))
    assert [r[2] for r in twice if r[0] is not None] == [0, 0, 0]


# 7
def naive_chunks(data, smallest, bits):
    """Borders found byte by byte."""
    from stockmerge.llm.common import gear_table

    table, out, h, last = gear_table().tolist(), [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + table[b]) % (1 << 32)
        if h < 1 << (32 - bits) and i + 1 - last >= smallest:
            out.append(data[last : i + 1])
            last = i + 1
    return out + [data[last:]] * (last < len(data))


def test_substring_dedup_against_naive_chunks(spark):
    from stockmerge.llm.substring import remove, report

    rng = random.Random(15)
    passages = [words(rng, 60) for _ in range(3)]
    rows = [(i, words(rng, rng.randrange(5, 60)) + " " + rng.choice(passages) + " " + words(rng, rng.randrange(40)) + " ü " + rng.choice(passages)) for i in range(40)]
    rows += [(3, rows[4][1]), (7, passages[0] * 3), (200, None), (201, ""), (None, passages[0]), (9, rows[9][1])]
    digest = {r["text"]: r["h"] for r in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("h")).collect()}
    first, want = {}, []
    known = sorted({r for r in rows if r[0] is not None and r[1]}, key=lambda r: (r[0], digest[r[1]]))
    for k, t in known:
        runs, at, open_ = [], 0, False
        for c in naive_chunks(t.encode(), 24, 5):
            if c in first:
                runs = [*runs[:-1], (runs[-1][0], runs[-1][1] + len(c))] if open_ else [*runs, (at, len(c))]
            first.setdefault(c, k)
            open_, at = c in first and bool(runs) and runs[-1][0] + runs[-1][1] == at + len(c), at + len(c)
        want.append((k, t, ",".join(f"{s}+{n}" for s, n in runs if n >= 100)))
    spans_of = {(k, t): s for k, t, s in want}
    out = report(frame(spark, rows)).collect()
    expect = sorted([(k if k is not None else -1, spans_of.get((k, t), "")) for k, t in rows])
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["spans"]) for r in out) == expect
    assert sum(len(s) > 0 for _, s in expect) > 20
    left = remove(frame(spark, rows))
    assert all(r[c] == c for r in left.collect() for c in INTERNAL) and left.columns == frame(spark, []).columns


def test_substring_dedup(spark, docs, empty):
    from stockmerge.llm.substring import remove, report

    rng = random.Random(4)
    passage = words(rng, 70)
    rows = [(i, words(rng, 80) + " " + passage + " " + words(rng, 60)) for i in range(12)] + [(50 + i, words(rng, 120)) for i in range(10)] + [(90, None), (91, "")]
    out = {r["doc_id"]: r for r in report(frame(spark, rows)).collect()}
    assert out[0]["n_removed"] == 0
    assert all(len(passage) * 0.5 < out[i]["n_removed"] <= len(passage) + 40 for i in range(1, 12))
    assert all(out[i]["n_removed"] == 0 for i in [*range(50, 60), 90, 91])
    text = {r["doc_id"]: r["text"] for r in remove(frame(spark, rows), least=100).collect()}
    for i in range(12):
        start, size = (map(int, out[i]["spans"].split("+")) if out[i]["spans"] else (0, 0))
        whole = dict(rows)[i]
        assert text[i] == whole[:start] + whole[start + size :]
    assert report(docs).count() == docs.count()
    assert report(empty).count() == 0


# 8
def test_token_counts(spark, docs, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from stockmerge.llm.tokens import SPACE, Counter, count_tokens, load_vocabulary, words_of

    vocabulary = load_vocabulary()
    other = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    other.pre_tokenizer = pre_tokenizers.Metaspace(replacement=SPACE, prepend_scheme="always", split=True)
    count = lambda t: len(other.encode(t, add_special_tokens=False).ids)
    got = {(r["doc_id"], r["n_tokens"]) for r in count_tokens(docs).collect()}
    assert got == {(k, count(t) if t else 0) for k, t in awkward()}
    own, rng = Counter(vocabulary), random.Random(1)
    for _ in range(400):
        t = "".join(rng.choice(["a", "b", " ", "  ", "\n", "é", "☃", "th", "the", "▁", "<0x41>", "🙂"]) for _ in range(rng.randrange(30)))
        assert sum(map(own, words_of(t))) == count(t), t
    # a vocabulary without byte pieces: unknown characters in a row are one token
    small = [("<unk>", 0.0), (SPACE, -1.0), ("a", -1.0), ("ab", -1.5), ("b", -1.0), ("ba", -2.0), (SPACE + "a", -2.0)]
    plain = Tokenizer(models.Unigram(small, unk_id=0, byte_fallback=False))
    plain.pre_tokenizer = other.pre_tokenizer
    own = Counter(small)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b", " ", "x", "y"]) for _ in range(rng.randrange(14)))
        assert sum(map(own, words_of(t))) == len(plain.encode(t, add_special_tokens=False).ids), t
    assert count_tokens(empty).count() == 0


# 9
def test_fingerprints(spark, docs, empty):
    from stockmerge.llm.fingerprint import chunks_of, edit, fingerprints, likeness, pack

    rows = [r for r in awkward() if r[0] is not None and r[0] != 7]
    order = sorted(rows, key=lambda r: -r[0])
    for per_bucket in (7, 5000):
        out = {r["doc_id"]: r for r in fingerprints(frame(spark, rows), per_bucket=per_bucket).collect()}
        assert len(out) == len(rows)
        for i, (k, t) in enumerate(order):
            t, following = t or "", order[(i + 1) % len(order)][1] or ""
            changed = edit(t, following)
            assert len(changed) == len(t) - len(t) // 2 + min(len(t) // 2, len(following))
            assert out[k]["n_chars"] == len(t)
            assert out[k]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            assert out[k]["fingerprint"] == pack(chunks_of(t)) and out[k]["edited_fingerprint"] == pack(chunks_of(changed))
            assert out[k]["near_next"] == likeness(chunks_of(t), chunks_of(following))
            assert 0 <= out[k]["near_edited"] <= 1
    assert fingerprints(docs, per_bucket=10).count() == docs.count()
    assert fingerprints(empty).count() == 0
    assert fingerprints(frame(spark, [(1, "alone here")])).collect()[0]["near_next"] == 1
    long = words(random.Random(2), 3000)
    assert likeness(chunks_of(long), chunks_of("X inserted " + long)) > 0.95


def test_fingerprints_against_naive_chunks(spark):
    """The fingerprint worked out again byte by byte, without the operator's own parts."""
    import re

    import xxhash

    from stockmerge.llm.fingerprint import fingerprints

    def naive(t):
        data = re.sub(r"\s+", " ", t.lower()).strip().encode()
        return {xxhash.xxh3_64_hexdigest(c)[:12]: len(c) for c in naive_chunks(data, 32, 6)}

    def alike(a, b):
        if not a or not b:
            return float(not a and not b)
        both = sum(n for d, n in a.items() if d in b)
        return (both / sum(a.values()) + both / sum(b.values())) / 2

    rng = random.Random(16)
    rows = [(i * 3, words(rng, rng.randrange(80)) + rng.choice(["", "  Ünïcode\n", "\t"])) for i in range(25)] + [(500, ""), (501, None), (502, words(rng, 900))]
    order = sorted(rows, key=lambda r: -r[0])
    out = {r["doc_id"]: r for r in fingerprints(frame(spark, rows + [(None, "no id")]), per_bucket=6).collect()}
    assert out[None]["n_chars"] == 5 and out[None]["fingerprint"] == ",".join(f"{d}:{n:x}" for d, n in sorted(naive("no id").items()))
    for i, (k, t) in enumerate(order[:-1]):
        t, following = t or "", order[i + 1][1] or ""
        changed = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert out[k]["fingerprint"] == ",".join(f"{d}:{n:x}" for d, n in sorted(naive(t).items()))
        assert abs(out[k]["near_edited"] - alike(naive(t), naive(changed))) < 1e-9
        assert abs(out[k]["near_next"] - alike(naive(t), naive(following))) < 1e-9


def test_fingerprints_deal_a_frequent_id_over_ranges(spark):
    """Ids that fill ranges, and null ids, are split by the text's hash; each row still gets its next."""
    import xxhash

    from stockmerge.llm.fingerprint import chunks_of, dealt_in_order, edit, fingerprints, likeness

    rng = random.Random(17)
    ids = [*range(8), *[8] * 60, *range(9, 20), *[20] * 30, *[None] * 45]
    rows = [(i, words(rng, 3 + rng.randrange(40)) + f" {n}") for n, i in enumerate(ids)] + [(20, "twice"), (20, "twice"), (None, ""), (None, None)]
    docs = frame(spark, rows)
    seen, firsts = dealt_in_order(docs.fillna("", ["text"]), per_bucket=10)
    of = lambda c: {r["bucket"] for r in seen.where(c).collect()}
    assert len(of("doc_id = 8")) > 2 and len(of("doc_id IS NULL")) > 2 and {b for b, _, _ in firsts} == of("true")
    by_hash = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) >> 33, t)
    order = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), by_hash(r[1])))
    want = sorted((str(i), hashlib.sha256(edit(t, f).encode()).hexdigest(), likeness(chunks_of(t), chunks_of(f))) for (i, t), f in zip(order, [t for _, t in order[1:] + order[:1]], strict=True))
    for per_bucket in (10, 5000):
        got = fingerprints(docs, per_bucket=per_bucket).select("doc_id", "edited_sha256", "near_next").collect()
        assert sorted((str(i), s, n) for i, s, n in got) == want


# 10
def test_language_kernel_is_the_cosine_of_presence_sets():
    from stockmerge.llm.language import Presence, encode, gram_codes

    rng = random.Random(17)
    marks = [words(rng, 20) for _ in range(4)] + ["ä", "ab"]
    texts = [words(rng, 30), "ÄÖ 日本", "a", marks[1], "zzz qqq"]
    sets = lambda t: {t.lower().encode()[i : i + n] for n in (1, 2, 3) for i in range(len(t.lower().encode()) - n + 1)}
    grams = np.unique(np.concatenate([c for t in marks for c in gram_codes(encode(t))]))
    near = Presence(grams).rows(texts) @ Presence(grams).rows(marks).T
    want = [[len(sets(t) & sets(m)) / (len(sets(t)) * len(sets(m))) ** 0.5 for m in marks] for t in texts]
    assert np.allclose(near, want, atol=1e-5)


def test_language(spark, docs, empty):
    from stockmerge.llm.language import fit, held_out_part, identify, keep, predict

    rng = random.Random(8)
    letters = {"en": "the of and ing er on".split(), "de": "sch ung ein der ü ß".split(), "es": "ción ar el que ñ os".split()}
    rows = [(i, " ".join("".join(rng.choice(letters[g]) for _ in range(3)) for _ in range(60)), g) for i in range(300) for g in [list(letters)[i % 3]]]
    df = spark.createDataFrame(rows + [(900, None, "en"), (901, "", "de"), (902, "12 34 !", "de"), (903, "the of and", None)], "doc_id long, text string, lang string")
    model = fit(df, per_language=40, landmarks=10)
    out = predict(df, model).join(df, "doc_id").withColumn("held", held_out_part() == 2).collect()
    held = [r for r in out if r["held"] and r["doc_id"] < 900]
    assert len(held) > 40 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (900, 901, 902)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in out)
    assert keep(df, model).count() == 301 and keep(df, model).columns == df.columns
    assert identify(empty).count() == 0
    assert {r["lang_pred"] for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_sample_is_bounded_for_a_repeated_id(spark):
    from stockmerge.llm.common import sampled_texts
    from stockmerge.llm.language import labelled

    rng = random.Random(6)
    rows = [(1, words(rng, 5), "en") for _ in range(600)] + [(1, "just this", "en")] * 200 + [(1, "das da", "de")] * 300 + [(k, words(rng, 5), "de") for k in range(2, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = sampled_texts(labelled(df), "lang", 50).collect()
    per = {g: [r for r in got if r["lang"] == g] for g in ("en", "de")}
    assert len(per["en"]) == 50 and all(r["doc_id"] == 1 for r in per["en"]) and len({r["text"] for r in per["en"]}) == 50
    assert 1 < len(per["de"]) <= 39 and len({(r["doc_id"], r["text"]) for r in per["de"]}) == len(per["de"])
    assert {r["text"] for r in per["de"]} <= {t for _, t, g in rows if g == "de"}


def tongues(seed, n, wrong=0.0):
    """Rows of three made-up languages; of ``wrong`` of them the label is drawn anew."""
    rng = random.Random(seed)
    says = {"en": "the of and th er ing ly wh sh ed ou re", "de": "der ei ch sch und ü ä tz en keit ver ge", "fr": "le é è eau ou qu ç ai les des ment ré"}
    rows = []
    for k in range(n):
        g = list(says)[k % 3]
        text = " ".join("".join(rng.choice(says[g].split()) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(15, 60)))
        rows.append((k, text, rng.choice(list(says)) if rng.random() < wrong else g))
    return rows


def test_language_threshold_survives_wrong_labels(spark):
    """With two labels in a hundred wrong, letter junk and other scripts still go and all rows of right label stay."""
    from stockmerge.llm.language import fit, keep, predict

    rows = tongues(3, 900, wrong=0.03)
    junk = [(10_000, "xqzk wvvj qqpx zzkw jjxq " * 5, None), (10_001, "Съешь ещё этих мягких французских булок да выпей чаю " * 3, None), (10_002, "これは日本語の文章です。言語を判定します。" * 3, None)]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    model = fit(df)
    left = {r["doc_id"] for r in keep(df, model, least=0.8 * model.least).collect()}
    right = {k for k, (_, _, g) in enumerate(rows) if g == ["en", "de", "fr"][k % 3]}
    assert 10 < 900 - len(right) < 30 and right <= left <= set(range(900)) and model.least > 0.6
    assert sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in predict(df.where("doc_id < 900"), model).collect()) > 0.97 * 900


def test_language_regression_against_a_plain_solve():
    """Landmarks, kernels and weights against dense 0/1 vectors of all n-grams."""
    from stockmerge.llm.language import Presence, encode, gram_codes, regression

    rng = random.Random(2)
    texts = [words(rng, 8) + t for t in (" ähnlich", " same", " même", "") for _ in range(9)]
    own, marks = np.array([[0, 1, 2, 2, 1, 2][k % 6] for k in range(len(texts))]), texts[::4]

    def grams(text):
        b = text.lower().encode()
        return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    sets = [grams(t) for t in texts]
    kernel = np.array([[len(a & grams(m)) / (len(a) * len(grams(m))) ** 0.5 for m in marks] for a in sets])
    core = np.array([[len(grams(a) & grams(m)) / (len(grams(a)) * len(grams(m))) ** 0.5 for m in marks] for a in marks])
    presence = Presence(np.unique(np.concatenate([c for t in marks for c in gram_codes(encode(t))])))
    basis = presence.rows(marks).T
    near = presence.rows(texts) @ basis
    assert np.allclose(near, kernel, atol=1e-5) and np.allclose(basis.T @ basis, core, atol=1e-5)
    got = regression(core, kernel, own, 3, 1e-2)
    # min sum of w (K b + c - y)^2 + r (b'Cb + c^2), the same problem without the map
    k1 = np.c_[kernel, np.ones(len(texts))]
    penalty = np.zeros((len(marks) + 1,) * 2)
    penalty[:-1, :-1], penalty[-1, -1] = core, 1
    y = np.where(own[:, None] == np.arange(3)[None], 1.0, -1.0)
    w = np.diag(len(own) / 3 / np.bincount(own)[own])
    want = np.linalg.solve(k1.T @ w @ k1 + 1e-2 * penalty, k1.T @ w @ y)
    assert np.allclose(k1 @ got, k1 @ want, atol=1e-4)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(6)
    rows = [r for r in awkward()] + [(300 + i, "\n".join(words(rng, 12) for _ in range(6))) for i in range(10)]
    item = words(rng, 30)
    rows.append((400, words(rng, 20) + "\n" + item + "\n" + words(rng, 20)))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    frame(spark, rows).select(columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[:5] == columns, name
        assert i == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    ids = {r[0] for r in docs.select("doc_id").collect()}
    assert set(range(300, 310)) <= ids and 400 not in ids and not {100, 101, 102} & ids
    assert sorted(map(str, docs.collect())) == sorted(map(str, p.run(spark, str(tmp_path)).collect()))
    assert docs.where("mix_slot IS NULL").count() == 0
    # a run that is begun again goes on behind the stages it has finished
    held = str(tmp_path / "held")
    want = sorted(map(str, p.run(spark, str(tmp_path), held).collect()))
    stages = p.STAGES
    try:
        p.STAGES = [(name, None) for name, _ in stages[:-1]] + stages[-1:]
        assert sorted(map(str, p.run(spark, str(tmp_path), held).collect())) == want
    finally:
        p.STAGES = stages
