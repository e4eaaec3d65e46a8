"""Near-duplicates and lines against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm import hashing, lines, minhash
from halyard.llm.groups import compare_in_blocks, components, one_by_one
from tests.compare import oracle, rows
from tests.llm.helpers import empty, groups, odd, shingle_set, table

SF = "/root/testdata/sf0.001"


def near_texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for size in (1, 2, 3, 40, 120):
        base = [word() for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(size)] = word()
            out.append(" ".join(copy).title() if rng.random() < 0.3 else "\t".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_components_against_all_pairs(spark, words, percent):
    texts = near_texts(words)
    sets = [shingle_set(t, words) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(table(spark, texts), words, percent).collect()}
    root = groups(len(texts), links)
    assert len(links) > 10
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(texts))] == [(len(sets[i]), root[i], root[i] == i) for i in range(len(texts))]


def test_query_against_sql(spark):
    from halyard.llm.queries import QUERIES, SQL

    assert rows(QUERIES["op1_minhash"](spark, SF).toPandas()) == rows(oracle(SQL["op1_minhash"], SF))


def test_odd_rows(spark):
    got = minhash.near_duplicates(odd(spark)).collect()
    by = {(r["doc_id"], r["n_shingles"]): r for r in got}
    assert len(got) == 9 and all(r["kept"] for r in got)
    assert by[1, 0]["component_id"] == 1 and by[None, 5]["component_id"] is None
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert minhash.one_of_each(odd(spark)).count() == 8


def test_small_sets_are_found_whole(spark):
    rng = random.Random(6)
    texts = []
    for i in range(400):
        words = [f"w{i}x{k}" for k in range(rng.randint(5, 9))]
        texts += [" ".join(words), " ".join([*words, f"y{i}"])]
    sets = [shingle_set(t, 5) for t in texts]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table(spark, texts), 5, 80).collect()}
    for i in range(0, len(texts), 2):
        linked = 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])
        assert got[i + 1] == (i if linked else i + 1)


def test_ids_beyond_floats_and_clashing_columns(spark):
    big = 2**53 + 1
    text = "one line of several words in a row\na second line that stands here once"
    docs = spark.createDataFrame([(big, text), (None, text), (None, "b " * 9), (big + 2, "one line of several words in a row")], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 as _row", "2 as _ats", "3 as _r", "4 as _d", "5 as _r2", "6 as _key", "'k' as key", "7 as root")
    assert {r["doc_id"] for r in minhash.near_duplicates(docs, 3).collect()} == {big, None, big + 2}
    one = minhash.one_of_each(docs, 3)
    assert one.columns == docs.columns and {(r["_row"], r["_r"], r["_r2"], r["root"]) for r in one.collect()} == {(1, 3, 5, 7)}
    got = lines.dedup_lines(docs).collect()
    left = {r["doc_id"]: r for r in got if r["doc_id"]}
    # The row without an id comes first, so the lines of the others go.
    assert left[big]["text"] == "" and left[big + 2]["text"] == "" and left[big]["_ats"] == 2 and left[big]["n_removed_lines"] == 2
    with pytest.raises(ValueError):
        lines.dedup_lines(docs.withColumn("n_removed_lines", F.lit(1)))
    assert lines.dedup_lines(docs.withColumn("n_removed_lines", F.lit(1)), removed="gone").filter("gone > 0").count() == 2


def test_many_lines_of_one_document(spark):
    text = "\n".join(f"line number {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} of many words that go on {i % 7 * 'z'} and on" for i in range(30_000))
    (got,) = lines.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert got["n_removed_lines"] > 29_000

def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (3, 50, 3000):
        pool = hashing.mix(rng.integers(0, 2**62, 2 * n, dtype=np.uint64))
        a, b = pool[: n + n // 2], pool[n // 2 : 2 * n]
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = np.mean([np.mean(minhash.superminhash(hashing.mix(a + np.uint64(s))) == minhash.superminhash(hashing.mix(b + np.uint64(s)))) for s in range(20)])
        assert same == pytest.approx(j, abs=0.05)


def test_bands_miss_few():
    for threshold in (0.8, 0.85):
        r = minhash.band_rows(threshold)
        assert (1 - threshold**r) ** (minhash.SLOTS // r) <= 4e-6


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_by_shuffles_and_in_one_task(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    root = groups(300, links)
    want = {x: root[x] for a, b in links if a != b for x in (a, b)}
    edges = spark.createDataFrame([*links, (None, 1)], "a long, b long")
    for few in (0, 1000):
        assert {r["node"]: r["root"] for r in components(edges, few).collect()} == want
        name = lambda x: f"{x:03}\u00ff".encode("latin-1") if x is not None else None
        named = spark.createDataFrame([(name(a), name(b)) for a, b in links], "a binary, b binary")
        assert {bytes(r["node"]): bytes(r["root"]) for r in components(named, few).collect()} == {name(a): name(b) for a, b in want.items()}
    assert components(edges.limit(0), 0).count() == 0


def test_blocks_look_at_every_pair(spark):
    members = spark.range(60).select(F.lit(1).alias("key"), F.col("id"))
    every = lambda g: ((i, j) for i in range(len(g["id"])) for j in range(i))
    for block in (7, 100):
        pairs = {tuple(sorted(r)) for r in compare_in_blocks(members, one_by_one(every), block).collect() if r["a"] != r["b"]}
        assert len(pairs) == 60 * 59 // 2


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))
    for _ in range(1500):
        a, b, most = text(), text(), rng.randint(0, 25)
        want, got = levenshtein(a, b), lines.edit_distance(a, b, most)
        assert got == want if want <= most else got > most


def sketch(kinds):
    parts = lines.slots(list(kinds))
    return lines.band_keys(parts), lines.simhashes(parts)


def test_sketches_do_not_depend_on_the_batch():
    kinds = [n for t in line_texts() for n in lines.normalised(t) if n]
    keys, sim = sketch(kinds)
    for i in range(0, len(kinds), 17):
        one, two = sketch(kinds[i : i + 1])
        assert (one[0] == keys[i]).all() and (two[0] == sim[i]).all()


def test_edit_distance_of_long_texts():
    rng = random.Random(4)
    for n in (1600, 6500):
        a = "".join(rng.choice("abcdefgh ") for _ in range(n))
        for edits in (0, 3, n // 30, n // 9):
            b = list(a)
            for _ in range(edits):
                b[rng.randrange(len(b))] = rng.choice(["", "x", "ab"])
            b = "".join(b)
            want, most = levenshtein(a, b), n // 10
            got = lines.edit_distance(a, b, most)
            assert got == want if want <= most else got > most
            assert lines._by_diagonals(*sorted((a, b), key=len), most) == lines._by_bits(*sorted((a, b), key=len), most)
    assert lines.edit_distance(a, "".join(rng.choice("abcdefgh ") for _ in range(n)), n // 10) > n // 10
    long = "some words of a long line " * 40_000
    assert lines.similar(long, "x" + long[:-3] + "yz", 90) and not lines.similar(long, long[::-1], 90)


def test_similar_is_the_edit_rule():
    rng, missed, linked = random.Random(11), 0, 0
    for _ in range(400):
        a = "".join(rng.choice("abcdef ") for _ in range(rng.choice([5, 30, 90, 200])))
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 8 + 1)):
            at = rng.randrange(len(b))
            b[at : at + rng.choice([0, 1, 1, 6])] = rng.choice(["", "x", "yy", "abc de"])
            b = b or ["z"]
        b = "".join(b)
        longer = max(len(a), len(b))
        for percent in (80, 90):
            distance = levenshtein(a, b)
            assert lines.edit_distance(a, b, longer) == distance
            aligned = lines._aligned(a, b, longer)
            assert aligned is None or aligned >= distance
            want = 100 * (longer - distance) >= percent * longer
            got = lines.similar(a, b, percent)
            assert got <= want
            missed += want and not got
            linked += want
    assert missed <= linked / 100  # where an alignment breaks up long common runs


def test_similar_loses_no_pair():
    """Texts of any length that fall out of step, or whose alignment is dear, are settled by the distance."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz 0é"
    pairs = []
    for n in (5, 63, 64, 65, 130, 310, 500, 900):
        for step in (9, 10, 11, 13, 40):
            a = "".join(rng.choice(letters) for _ in range(n))
            strewn = "".join(rng.choice("XY") if i % step == 0 else c for i, c in enumerate(a))
            moved = a[n // 12 :] + a[: n // 24] if step > 11 else a[:40] + "".join(rng.choice(letters) for _ in range(n // step)) + a[40:]
            pairs += [(a, strewn), (moved, a), (strewn, moved)]
    want = [100 * (max(map(len, p)) - levenshtein(*p)) >= 90 * max(map(len, p)) for p in pairs]
    assert [lines.similar(*p, 90) for p in pairs] == want and 20 < sum(want) < len(want) - 20
    maybe = lines._maybe([(lines._kinds(a), lines._kinds(b)) for a, b in pairs], 90)
    assert all(m or not w for m, w in zip(maybe, want, strict=True)) and sum(maybe) < len(want) - 10


def test_groups_side_by_side():
    """Links of many groups that are searched at once connect what all pairs of each group connect."""
    rng = random.Random(13)
    found, all_ = [], []
    for size in [2] * 30 + [3, 5, 9, 40, 1]:
        base = " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(rng.choice([4, 12, 60])))
        text = []
        for _ in range(size):
            b = list(base)
            for _ in range(rng.randint(0, len(b) // 9)):
                b[rng.randrange(len(b))] = rng.choice(["x", "", "yz"])
            text.append("".join(b).encode())
        sims = lines.simhashes(lines.slots(text))
        near = lambda i, j: size == 2 or np.bitwise_count(sims[i] ^ sims[j]).sum() <= lines.RADIUS  # noqa: B023, E731
        links = [(i, j) for i in range(size) for j in range(i) if near(i, j) and lines.similar(text[i].decode(), text[j].decode(), 90)]
        found.append({"line": np.array(text, object)})
        all_.append(groups(size, links))
    got = [[] for _ in found]
    for group, i, j in lines._edits(90)(iter(found)):
        got[next(k for k, g in enumerate(found) if g is group)].append((i, j))
    assert [groups(len(a), g) for a, g in zip(all_, got, strict=True)] == all_
    assert any(len(set(a)) < len(a) for a in all_) and any(len(set(a)) > 1 for a in all_)


def line_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    pool = [" ".join(word() for _ in range(rng.choice([1, 4, 80, 150]))) for _ in range(25)]

    def vary(line):
        w = line.split()
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = word()
        return ("; ".join(w).upper() if rng.random() < 0.3 else " ".join(w)) + (f" {rng.randint(1, 9)}" if rng.random() < 0.2 else "")

    return ["\n".join(rng.choice(["", "---", vary(rng.choice(pool)), vary(rng.choice(pool))]) for _ in range(rng.randint(1, 8))) for _ in range(80)]


def test_lines_against_all_pairs(spark):
    texts = line_texts()
    all_ = [(d, i, n) for d, t in enumerate(texts) for i, n in enumerate(lines.normalised(t)) if n]
    kinds = sorted({n for *_, n in all_})
    links, alike = [], 0
    keys, sim = sketch(kinds)
    for i in range(len(kinds)):
        for j in range(i):
            a, b = kinds[i].decode(), kinds[j].decode()
            longer = max(len(a), len(b))
            if abs(len(a) - len(b)) <= longer // 10 and 100 * (longer - levenshtein(a, b)) >= 90 * longer:
                alike += 1
                if (keys[i] == keys[j]).any() and np.bitwise_count(sim[i] ^ sim[j]).sum() <= lines.RADIUS:
                    links.append((i, j))
    assert alike > 50 and len(links) >= 0.95 * alike
    root = dict(zip(kinds, groups(len(kinds), links), strict=True))
    seen, gone = set(), set()
    for d, i, n in all_:
        if root[n] in seen:
            gone.add((d, i))
        seen.add(root[n])
    want = ["\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(table(spark, texts)).collect()}
    assert [got[d]["text"] for d in range(len(texts))] == want
    assert [got[d]["n_chars"] for d in range(len(texts))] == list(map(len, want))


def test_large_neighbourhoods_are_parted(spark, monkeypatch):
    """A chain of likely pairs that is longer than what is verified together is met by its bands, not all by all."""
    rng = random.Random(17)
    words = [" ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(6)) for _ in range(40)]
    chain = [" ".join(words[i : i + 12]) for i in range(28)]
    texts = [*chain, *(c.replace(c[100:105], "zzzzz") for c in chain)]
    want = sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(table(spark, texts)).collect())
    largest = {}
    write = lines.table

    def watched(df, name):
        out = write(df, name)
        if name in ("likely_lines", "parted_lines"):
            largest[name] = out.groupBy("key").count().agg(F.max("count")).first()[0]
        return out

    monkeypatch.setattr(lines, "NEIGHBOURS", 20)
    monkeypatch.setattr(lines, "table", watched)
    got = sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(table(spark, texts)).collect())
    assert got == want and [t for _, t in got].count("") >= 28
    assert largest["parted_lines"] <= 20 < largest["likely_lines"]


def test_odd_lines(spark):
    got = lines.dedup_lines(odd(spark)).collect()
    assert len(got) == 9 and sum(r["n_removed_lines"] for r in got) == 0
    assert [r["text"] for r in got if r["doc_id"] == 1] == [None]
    assert lines.dedup_lines(empty(spark)).count() == 0


def near_equal_pairs(words, kind, n=150):
    """Pairs of normalised lines of ``words`` words that the edit rule links: one changed word, one typo, or edits in a tenth of the places."""
    rng = random.Random(f"{words} {kind}")
    word = lambda: "".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 8)))
    pool = [word() for _ in range(3000)]
    out = []
    while len(out) < n:
        a = [rng.choice(pool) for _ in range(words)]
        if kind == "word":
            b = list(a)
            b[rng.randrange(words)] = rng.choice(pool)
            a, b = " ".join(a), " ".join(b)
        else:
            a = " ".join(a)
            b = list(a)
            for _ in range(1 if kind == "typo" else len(a) // 10):
                b[rng.randrange(len(b))] = rng.choice("etaoinshrdlucm")
            b = "".join(b)
        if a != b and lines.similar(a, b, 90):
            out.append((a.encode(), b.encode()))
    return out


@pytest.mark.parametrize("words", [8, 12, 20, 50, 100])
def test_links_reach_the_edit_rule(words):
    share = {}
    for kind in ("word", "typo", "tenth"):
        a, b = zip(*near_equal_pairs(words, kind), strict=True)
        (ka, sa), (kb, sb) = sketch(a), sketch(b)
        share[kind] = np.mean((ka == kb).any(axis=1) & (np.bitwise_count(sa ^ sb).sum(axis=1) <= lines.RADIUS))
    print(words, share)
    assert share["word"] >= 0.9 and share["typo"] >= 0.95


def test_near_equal_lines_go(spark):
    pairs = [p for words in (8, 12, 20, 50, 100) for p in near_equal_pairs(words, "word", 20)]
    texts = [f"{a.decode()}\n{b.decode()}" for a, b in pairs]
    got = lines.dedup_lines(table(spark, texts)).collect()
    assert sum(r["n_removed_lines"] for r in got) >= 0.9 * len(pairs) and all(r["n_removed_lines"] <= 1 for r in got)
