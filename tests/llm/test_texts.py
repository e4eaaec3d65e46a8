"""Operators that read one text at a time, against brute force on whole tables and odd rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from halyard.llm import crossentropy, decontaminate, packing, pii, quality, secrets, spots, tokens, toxicity
from halyard.llm.queries import QUERIES, SQL
from tests.compare import oracle, rows
from tests.llm.helpers import empty, groups, lower, odd, table

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def fuzz(alphabet, n=4000, most=90, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


# personal data


def plain_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_personal_data():
    for t in fuzz("a1.@+ -()3459é") + fuzz("0123456789.@ +-", seed=2):
        assert pii.base_spans(t) == plain_pii(t)


def test_personal_data_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op3_pii"](spark, SF).collect()}
    for r in documents(spark).collect():
        base = plain_pii(r["text"])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(g["spans"].split(","))
        assert [g["n_email"], g["n_ip"], g["n_card"], g["n_phone"]] == [sum(k == i for _, k, _ in base) for i in range(4)]


def test_contexts_find_unseen_identifiers(spark):
    known = [f"word reach me at user{i}@mail.example.com now" for i in range(40)]
    got = pii.find_personal_data(table(spark, [*known, "reach me at user77_mail.example.com now", "nothing here", "item 12345 sold"])).orderBy("doc_id").collect()
    assert "email:" in got[0]["spans"]
    assert got[41]["spans"] == "" and got[42]["spans"] == ""
    unseen = ["reach me at user7@mail.example.com now"] * 5
    again = pii.bootstrap(pii.scan(table(spark, [*known, *unseen])).selectExpr("inline(occurrences)"))
    assert again.filter("kind = 'email'").count() >= 1


def test_contexts_find_other_shapes_in_rounds(spark):
    phones = [f"please call me at +1 415 555 01{i:02d} today" for i in range(40)] * 50
    mails = [f"you should mail user{i}@site{i}.example.com soon" for i in range(40)]
    planted = ["please call me at 415-555-0123 today", "you should mail john@intranet soon"]
    # Trusted by the first context, these support a second one where no seed stands.
    chain = [f"please call me at 415-555-9{i:03d}" for i in range(20)] * 8 + [f"voicemail box 415-555-9{i:03d} beeps" for i in range(20)] + ["voicemail box 212-777-1234 beeps"]
    plain = ["item 12345 sold", "in the year 20191 nothing"]
    texts = [*phones, *mails, *planted, *chain, *plain]
    got = [r["spans"] for r in pii.find_personal_data(table(spark, texts)).orderBy("doc_id").collect()]
    at = dict(zip(texts, got, strict=True))
    assert at[planted[0]] == "ctx_phone:18:30" and at[planted[1]] == "ctx_email:16:29"
    assert at[chain[-1]].startswith("ctx_phone:14:26") and at[plain[0]] == at[plain[1]] == ""


def test_ids_beyond_floats(spark):
    """A null id in the same batch makes no float of the others."""
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "token = 'abcdefgh12' and a@b.cd"), (None, "x"), (big + 2, "the end of it")], "doc_id long, text string")
    labels = spark.createDataFrame([(big, 1, 0), (big + 2, 0, 1)], "doc_id long, quality int, toxic int")
    found = [pii.find_personal_data(docs), secrets.find_secrets(docs), packing.pack(docs, VOCABULARY), quality.score_quality(docs, labels), toxicity.score_toxicity(docs, labels), crossentropy.score_documents(docs, labels)]
    for got in (*found, quality.keep_good(docs, labels, threshold=0.0)):
        assert {r["doc_id"] for r in got.collect()} == {big, None, big + 2}


def test_odd_personal_data(spark):
    got = pii.find_personal_data(odd(spark)).collect()
    assert len(got) == 9 and all(r["spans"] == "" for r in got)
    assert pii.find_personal_data(empty(spark)).count() == 0


# secrets


def plain_secrets(t):
    word = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)
    names = "|".join([word("password"), word("passwd"), word("secret"), word("token"), word("api") + "_?" + word("key")])
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_base_secrets():
    parts = ["token", "Password", '="', "abc12345", "AKIA", "A1B2C3D4E5F6", " ", ":", "apiKey", "api_key", "0123456789abcdef", "\n", "x = ", "ſecret", "K"]
    for t in fuzz(parts, most=15) + fuzz('tokenTOKEN="\'=: abc019', seed=4):
        assert secrets.base_spans(t) == plain_secrets(t)


def test_constants_are_followed():
    t = "a = 'x9Kq-72hhTT0'\nb = a\ndb_password = b + 'Zz81'\ncolour = 'x9Kq-72hhTT1'\npassword = 'changeme'\n"
    found = [t[a:b] for a, k, b in secrets.spans_of(t) if k == 3]
    assert found == ["x9Kq-72hhTT0", "Zz81"]  # a sum is one value, and its parts are scored as that
    assert not [k for _, k, _ in secrets.spans_of("a = 'Zz81'\ndb_password = a\n") if k == 3]


def test_literals_names_and_sums_of_any_length():
    rng = random.Random(5)
    literal = "".join(rng.choice("abcXYZ0189-_") for _ in range(2000))
    spans = lambda t: [t[a:b] for a, k, b in secrets.spans_of(t) if k == 3]
    for quote in "\"'`":
        assert spans(f"credential = {quote}{literal}{quote}") == [literal]
    assert spans("db." + "x" * 100 + f"_auth = '{literal}'") == [literal]
    sums = "a = " + " + ".join(f"'{literal[30 * i : 30 * i + 20]}'" for i in range(40)) + "\nbearer = a\n"
    assert len(spans(sums)) == 40
    many = f"first = '{literal[:30]}'\n" + "".join(f"n{i} = {i}\n" for i in range(12_000)) + "password = first\n"
    assert spans(many) == [literal[:30]]
    assert spans("--password=" + literal[:30]) == [literal[:30]]
    doubled = "a = 'x9Kq-72hhTT0'\n" + "a = a + a\n" * 60 + "password = a\n"
    assert spans(doubled) == ["x9Kq-72hhTT0"]


def test_secrets_query_and_odd_rows(spark):
    got = {r["doc_id"]: r for r in QUERIES["op8_secrets"](spark, SF).collect()}
    for r in documents(spark).collect():
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in plain_secrets(r["text"]))
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert secrets.find_secrets(odd(spark)).count() == 9 and secrets.find_secrets(empty(spark)).count() == 0


# decontamination


def test_decontamination_query(spark):
    assert rows(QUERIES["op7_decontamination"](spark, SF).toPandas()) == rows(oracle(SQL["op7_decontamination"], SF))


def test_search_against_every_window(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("ab cd ef gh 12 é".split())
    items = [" ".join(word() for _ in range(rng.choice([1, 3, 7, 8, 11]))) for _ in range(12)] + ["", None]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))).upper() for _ in range(60)] + [None]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    for most in (10**6, 60):  # in one part, and in many
        got = {r["doc_id"]: r for r in decontaminate.contamination(table(spark, texts), bench, 8, most=most).collect()}
        found = {r["doc_id"]: r["found"] for r in decontaminate.find_passages(table(spark, texts), bench, 8, most).collect()}
        for d, t in enumerate(texts):
            w, hit, which = split(t), set(), set()
            for i, x in enumerate(items):
                for p in decontaminate.windows_of([c.encode() for c in split(x)], 8):
                    for at in range(len(w) - len(p) + 1):
                        if tuple(c.encode() for c in w[at : at + len(p)]) == p:
                            hit.update(range(at, at + len(p)))
                            which.add(str(i))
            assert found[d]["items"] == sorted(which) and found[d]["n_words"] == len(w)
            assert (got[d]["n_words"], got[d]["n_hit"], got[d]["n_items"], got[d]["contaminated"]) == (len(w), len(hit), len(which), len(which) >= 2)


def test_clean_keeps_columns(spark):
    bench = spark.createDataFrame([(i, f"w{i} x y z") for i in range(3)], "item_id long, text string")
    docs = spark.createDataFrame([(2**53 + 1, "w0 x y z", 1, 2, 3), (None, "w0 x y z w1 x y z", 1, 2, 3), (None, None, 1, 2, 3)], "doc_id long, text string, found int, _items int, _found0 int")
    for most in (10**6, 8):
        kept = decontaminate.find_passages(docs.drop("found"), bench, 8, most).filter("size(found.items) < 2")
        assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2**53 + 1]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {(r["found"], r["_items"], r["_found0"]) for r in kept.collect()} == {(1, 2, 3)} and kept.count() == 2
    with pytest.raises(ValueError):
        decontaminate.find_passages(docs, bench)


def test_odd_decontamination(spark):
    bench = spark.createDataFrame([(1, None), (None, "x"), (2, "lorem ipsum dolor"), (3, "x"), (3, "x")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r["n_items"] for r in decontaminate.contamination(odd(spark), bench).collect()}
    assert got[1, 0] == 0 and got[7, 1] == 1 and got[4, 180_000] == 1
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    assert decontaminate.clean(odd(spark), bench.limit(0)).count() == 9


# packing


def test_ids_equal_the_tokenizer(spark):
    t = tokens.WordTokenizer(VOCABULARY)
    strange = ["don't I'LL we've", "x\x1cy z", "Éé İstanbul ΣΑΣ ß ŉ ſ Ǆ", "<|endoftext|>hi", "日本語 テスト 123 ４５", "a b\tc\r\nd", "é ́x", "́ a​b ﻿z", "ĲĳŁł ÀÖ×÷ ñ"]
    for text in [*strange, *(r["text"] for r in documents(spark).collect()), *fuzz("ab'ts Éé1!_-\n", n=500)]:
        assert np.frombuffer(t.ids(text), "<u4").tolist() == t.whole.encode(text, add_special_tokens=False).ids


def test_plain_texts_are_split_as_a_whole():
    """No word of a plain text is met alone, and the pieces are those of the tokenizer's own pattern."""
    t = tokens.WordTokenizer(VOCABULARY)
    plain = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0x180))]
    for text in (s.replace("{}", c) for c in plain for s in ("{}", "a{} {}a", "'{}", "''{}s", "0{}0 é{}.", "'r{}\t'l{}l\n")):
        assert t.ids(text) == np.array(t.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert not t.words
    assert t.ids("plain words \u2014 and a dash") and "\u2014" in t.words


def check_packing(pieces, texts, size):
    t = tokens.WordTokenizer(VOCABULARY)
    sequences = defaultdict(list)
    by = defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for doc, text in texts.items():
        ids = t.ids(text) + (1).to_bytes(4, "little")
        at = 0
        for p in sorted(by[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) // 4
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[4 * p["start"] : 4 * at])
        assert 4 * at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= size
    return sum(p["length"] for p in pieces) / (size * len(sequences))


def test_packing_query(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    assert check_packing(QUERIES["op6_packing"](spark, SF).collect(), texts, 2048) > 0.97


def test_packing_of_odd_rows(spark):
    got = packing.pack(odd(spark), VOCABULARY, group=3).collect()
    assert len({(r["doc_id"], r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter([1, 2, 3, None, 4, 5, 5, 6, 7])
    assert packing.pack(empty(spark), VOCABULARY).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 80))]
        bins: list[int] = []
        want = {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            b = next((k for k, used in enumerate(bins) if used + lengths[i] <= 64), len(bins))
            bins += [0] * (b == len(bins))
            want[i] = (b, bins[b])
            bins[b] += lengths[i]
        assert packing.first_fit_decreasing(lengths, 64) == [want[i] for i in range(len(lengths))]


# fingerprints


def test_fingerprints_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op9_spots"](spark, SF).collect()}
    order = sorted(((r["doc_id"], r["text"]) for r in documents(spark).collect()), reverse=True)
    for k, (doc, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = map(spots.signature_set, (text, edited, following))
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        like = lambda x, y: (j := len({*x.tolist()} & {*y.tolist()}) / len({*x.tolist()} | {*y.tolist()})) * (j >= spots.LEAST)
        assert (r["near_edited"], r["near_next"]) == pytest.approx((like(a, b), like(a, c)))
        assert base64.b64decode(r["fingerprint"]) == a.astype("<u4").tobytes()
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.3 > 0.05 > np.mean([r["near_next"] for r in got.values()])


def test_odd_fingerprints(spark):
    got = spots.against_next(odd(spark)).collect()
    assert len(got) == 9
    same = [r["fingerprint"] for r in got if r["doc_id"] == 5]
    assert len(same) == 2 and same[0] == same[1]
    assert [r["near_next"] for r in spots.against_next(table(spark, ["a lone text of words"])).collect()] == [1.0]
    assert spots.against_next(empty(spark)).count() == 0
    assert spots.likeness(np.array([1, 2]), np.array([1, 2, 3, 4, 5]), 0.5) == 0.0


def test_chains_follow_common_words():
    """The signatures of a sentence, by hand: anchors are common words, chains skip them."""
    from halyard.llm import hashing

    text = "The river that flows in winter is for boats."
    words = dict(zip(w := "the river that flows in winter is for boats".split(), next(hashing.word_hashes([" ".join(w)])), strict=True))
    chains = [(None, "river", "flows"), ("the", "river", "flows"), ("in", "winter", "boats")]
    want = set()
    for anchor, *chain in chains:
        h = np.array([words[anchor] if anchor else 0], np.uint64)
        for c in chain:
            h = hashing.mix(h * hashing._STEP[0] + words[c])
        want.add(int(h[0] >> np.uint64(32)))
    assert set(spots.signature_set(text).tolist()) == want
    bare = " ".join(f"x{i}y" for i in range(400))
    assert 60 < len(spots.signature_set(bare)) < 140  # one word in four, where none is common


def test_pruned_likeness():
    rng = np.random.default_rng(5)
    for n, m in ((0, 0), (1, 1), (40, 50), (900, 1000), (3000, 400), (5, 2000)):
        for share in (0.0, 0.3, 0.9, 1.0):
            pool = rng.permutation(10**6)[: n + m]
            a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[: int(share * min(n, m))], pool[n : n + m - int(share * min(n, m))])))
            union = len(set(a.tolist()) | set(b.tolist()))
            j = len(set(a.tolist()) & set(b.tolist())) / union if union else 1.0
            for least in (0.01, 0.5, 0.8):
                assert spots.likeness(a, b, least) == (pytest.approx(j) if j >= least else 0.0)
                if j >= least:
                    assert abs(spots.length_class(n, least) - spots.length_class(m, least)) <= 1


def test_alike_documents_against_all_pairs(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    texts = [None, "", "the", "the a of"]
    for _ in range(25):
        base = [rng.choice(pool) if i % 3 else rng.choice(spots.ANCHORS) for i in range(rng.choice([9, 60, 300]))]
        for edits in (0, 0, 1, 3, 20):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(pool)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets = [spots.signature_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) and spots.likeness(sets[i], sets[j], 0.8) >= 0.8]
    got = {r["doc_id"]: r for r in spots.alike(table(spark, texts)).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == groups(len(texts), links) and len(links) > 30
    assert [got[i]["n_spots"] for i in range(len(texts))] == list(map(len, sets))
    assert spots.alike(empty(spark)).count() == 0 and spots.alike(odd(spark)).count() == 9


def test_fingerprints_keep_ids_and_columns(spark):
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "the river flows in winter"), (None, "the boats of summer days"), (big, "the river flows in winter")], "doc_id long, text string")
    got = spots.against_next(docs).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, big, big]
    kept = spots.fingerprints(docs.selectExpr("*", "1 as _s", "2 as n_spots", "3 as fingerprint"))
    assert kept.columns == ["doc_id", "text", "_s", "n_spots", "fingerprint", "_n_spots", "_fingerprint"] and kept.first()["n_spots"] == 2


def test_parts_join_up(spark, monkeypatch):
    """As many parts as rows, and rows that repeat at their borders."""
    texts = ["the river flows in winter and the boats of summer", "a hill is in the fog"] * 2 + ["", None, "the river"]
    docs = table(spark, texts).union(table(spark, texts[:3])).union(table(spark, texts[:2]))
    whole = sorted(map(str, spots.against_next(docs).collect()))
    monkeypatch.setattr(spots, "PART", 1)
    assert sorted(map(str, spots.against_next(docs).collect())) == whole and len(whole) == 12


# scores


@pytest.mark.parametrize(("share", "most"), [(crossentropy.SHARE, 1_000_000), (crossentropy.SHARE, 2000), (1e-3, 0), (2e-4, 300)])
def test_cross_entropy_against_counts(spark, share, most):
    """As registered, with most pairs joined, and with most words unknown."""
    docs = {r["doc_id"]: re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(r["text"])) for r in documents(spark).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    every = Counter(w for v in docs.values() for w in v)
    known = {w for w, n in every.items() if n >= share * every.total()}
    docs = {i: [w if w in known else "?" for w in v] for i, v in docs.items()}

    def counts(ids):
        one, two, start = Counter(), Counter(), Counter()
        for i in ids:
            one.update(docs[i])
            two.update(zip(["", *docs[i]], docs[i], strict=False))
            start.update(["", *docs[i]] if docs[i] else [])
        return one, two, start

    models = [(good, counts(good)), (set(docs), counts(docs))]
    got = {r["doc_id"]: r for r in crossentropy.score_documents(documents(spark), labels, share, most).collect()}
    for i, v in docs.items():
        losses = []
        own, before = Counter(zip(["", *v], v, strict=False)), Counter(["", *v[:-1]])
        for ids, (one, two, start) in models:
            out = i in ids
            p = lambda w: (one[w] + 1) / (one.total() + len(known) + 1)  # noqa: B023, E731
            c = lambda h, w: (two[h, w] - out * own[h, w] + 50 * p(w)) / (start[h] - out * before[h] + 50)  # noqa: B023, E731
            losses.append(-sum(math.log2(c(h, w)) for h, w in zip(["", *v], v, strict=False)) / len(v))
        r = got[i]
        assert [r["n_tokens"], r["target_loss"], r["background_loss"], r["difference"]] == pytest.approx([len(v), *losses, losses[0] - losses[1]])


def test_documents_that_occur_elsewhere_stand_out(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    texts = [" ".join(rng.choice(pool) for _ in range(60)) for _ in range(60)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)], "doc_id long, quality int")
    got = {r["doc_id"]: r["difference"] for r in crossentropy.score_documents(table(spark, [*texts, *texts[1:20:2]]), labels).collect()}
    twice = [got[i] for i in (*range(1, 20, 2), *range(60, 70))]
    assert min(twice) > max(got[i] for i in range(60) if i % 2 == 0 or i > 20) + 1
    assert got[1] == pytest.approx(got[60])


def test_pairs_are_sent_by_whole_counts(spark):
    rows = spark.createDataFrame([(i, n, 0) for i, n in enumerate([2] * 50 + [3] * 20 + [50_000] * 5 + [3_000_000] * 4)], "pair long, n long, n1 long")
    assert [crossentropy._sent_from(rows, most) for most in (0, 3, 4, 8, 9, 28, 29, 100)] == [2**62, 2**62, 3_000_000, 3_000_000, 50_000, 50_000, 3, 2]


def test_target_marks_sent_or_joined(spark):
    docs, good = odd(spark).select("doc_id", "text"), spark.createDataFrame([(4,), (5,), (99,)], "doc_id long")
    sent, met = (sorted(str((r["doc_id"], r["target"])) for r in crossentropy._marked(docs, good, most).collect()) for most in (10, 0))
    assert sent == met and sum(x.endswith("1)") for x in sent) == 3


def test_scores_of_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for f in (crossentropy.score_documents, toxicity.score_toxicity, quality.score_quality):
        for l in (labels, labels.limit(0)):
            assert f(odd(spark), l).count() == 9
        assert f(empty(spark), labels).count() == 0
    got = {r["doc_id"]: r for r in crossentropy.score_documents(odd(spark), labels).collect()}
    assert got[1]["n_tokens"] == 0 and got[1]["difference"] is None


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    tox = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").toPandas()
    assert (tox["held_out"] == tox["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    held = tox[tox["held_out"]]
    toxic = held[held["toxic"] == 1]
    assert (toxic["predicted"] == 1).mean() > 0.6 and (held[held["toxic"] == 0]["predicted"] == 0).mean() > 0.98
    assert ((held["predicted"] == held["toxic"]).mean() > 0.92) and held[held["toxic"] == 1]["score"].mean() > 3 * held[held["toxic"] == 0]["score"].mean()
    seen = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2")
    good = quality.score_quality(docs, seen).join(labels, "doc_id").toPandas()
    good = good[good["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)]
    assert (good["good"] == good["quality"]).mean() > 0.93


def test_gate_never_changes_features():
    lex = toxicity.Lexicon({"idiot": 4.0, "idiota": 4.0, "moron": 3.0, "connard": 3.0, "fool*": 2.0})
    for t in ("'idiot'", "¡idiota!", "„idiot“", "“moron”", "«connard»", "‘foolish’ été", "é—kill—", "'kill'"):
        assert toxicity.features(t, lex)[0] > 0
    assert toxicity.features("a calm 'day' «été»", lex) == [0.0] * 6


def test_quoted_words_are_learned(spark):
    texts = [(f"„Dummkopf“ número{i} a{i} b{i}", 1) for i in range(30)] + [(f"día número{i} c{i} d{i}", 0) for i in range(30)]
    assert "dummkopf" in toxicity.learn_lexicon(spark.createDataFrame(texts, "text string, label int"))


def test_quality_against_plain_cotraining(spark):
    """Two naive Bayes views that hand each other the rows they are sure of, by loops over rows."""
    q = quality
    rows_ = documents(spark).collect()
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bins = {r["doc_id"]: q.text_view(r["text"]) + q.meta_view(r["lang"], r["source"], r["n_chars"]) for r in rows_}
    n, views = q.TEXT_VIEW + q.META_VIEW, (range(q.TEXT_VIEW), range(q.TEXT_VIEW, q.TEXT_VIEW + q.META_VIEW))
    labelled = Counter((known[d], f, b) for d in known for f, b in enumerate(bins[d]))
    sizes = Counter(known.values())
    share = (sizes[1] + 1) / (len(known) + 2)
    prior = math.log(share / (1 - share))
    extra = Counter()
    for turn in range(4):
        odds = {}
        for f in range(n):
            total = [sum(labelled[c, f, b] + extra[c, f, b] + 0.5 for b in range(q.BINS)) for c in (0, 1)]
            for b in range(q.BINS):
                p = [(labelled[c, f, b] + extra[c, f, b] + 0.5) / total[c] for c in (0, 1)]
                odds[f, b] = math.log(p[1] / p[0])
        if turn == 3:
            break
        given = Counter()
        for d, x in bins.items():
            if d in known:
                continue
            z = [prior + sum(odds[f, x[f]] for f in view) for view in views]
            for view, other in ((0, 1), (1, 0)):
                for c, sure in ((0, z[other] <= -math.log(49)), (1, z[other] >= math.log(49))):
                    if sure:
                        given.update((c, f, x[f]) for f in views[view])
        # What is handed over weighs as much as the labelled rows of its class at most.
        extra = Counter({(c, f, b): k * min(1, sizes[c] / max(1, sum(given[c, f, y] for y in range(q.BINS)))) for (c, f, b), k in given.items()})
    z = {d: [sum(odds[f, x[f]] for f in view) for view in views] for d, x in bins.items()}
    w = q.logistic(np.array([z[d] for d in known]), np.array([known[d] for d in known], float), ridge=0.01)
    for r in QUERIES["op5_quality"](spark, SF).collect():
        want = 1 / (1 + math.exp(-max(-30, min(30, z[r["doc_id"]] @ w[:-1] + w[-1]))))
        assert [r["text_odds"], r["meta_odds"], r["score"]] == pytest.approx([*z[r["doc_id"]], want], abs=1e-6)
        assert r["good"] == (r["score"] >= 0.3)


def plain_clause(words, lexicon):
    """What a clause weighs, from the rules and without transducers."""
    t = toxicity
    total, insults, tagged, verb = 0.0, 0, 0, None
    hit = [bool(lexicon.weight(w)) for w in words]
    for i, w in enumerate(words):
        before = lambda cues, reach: any(words[j] in cues and not hit[j] and (j not in harm) for j in range(max(0, i - reach), i))  # noqa: B023, E731
        if i == 0:
            harm = set()
        weight, tags = 0.0, set()
        if hit[i]:
            weight, tags = lexicon.weight(w), {"chained"} if i and hit[i - 1] else set()
            insults += 1
        elif w in t.THREATS:
            near = any(words[j] in t.AGENTS | t.TARGETS for j in range(max(0, i - 6), i))
            weight, verb = 2.0 * (1 if near else 0.15), None if near else i
            harm.add(i)
        elif w in t.TARGETS and verb is not None and i - verb <= 3:
            weight, verb = 2.0 * 0.85, None
            harm.add(i)
        else:
            continue
        tags |= {"negated"} if before(t.NEGATIONS, 3) else set()
        tags |= {"reported"} if before(t.REPORTS, 12) else set()
        tags |= {"targeted"} if before(t.TARGETS, 6) else set()
        total += weight * math.prod(t.SCALE[x] for x in tags)
        tagged += bool(tags)
    return total, insults, tagged


def test_grammar_against_its_rules():
    rng = random.Random(13)
    lex = toxicity.Lexicon({"idiot": 4.0, "fool*": 2.0, "moron": 3.0})
    pool = ["idiot", "foolish", "moron", "you", "he", "i", "we", "not", "never", "said", "kill", "hurt", *"abcdefgh"]
    for _ in range(4000):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 16))]
        assert toxicity.clause_weight(words, lex) == pytest.approx(plain_clause(words, lex)), words


def test_scores_are_those_of_the_clauses(spark):
    """The query's scores from features that the rules alone give."""
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in QUERIES["op4_toxicity"](spark, SF).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    lex = toxicity.learn_lexicon(spark.createDataFrame([(text[d], t) for d, t in seen.items()], "text string, label int"))

    def features(t):
        clauses = [re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", c) for c in re.split(r"[.!?;:,\n()]+", (t or "").lower())]
        hits = [c for c in clauses if any(lex.weight(w) or w in toxicity.THREATS for w in c)]
        found = [plain_clause(c, lex) for c in hits]
        words = {w for c in hits for w in c if lex.weight(w)}
        n, total, insults = sum(map(len, clauses)), sum(x[0] for x in found), sum(x[1] for x in found)
        return [min(max((x[0] for x in found), default=0.0), 12.0), math.log1p(total), float(min(len(words), 8)), math.log1p(len(found)), min(1.0, 50 * len(found) / max(n, 1)), sum(x[2] for x in found) / max(insults, 1)] if found else [0.0] * 6

    x = np.array([features(text[d]) for d in seen])
    w = toxicity.logistic(x, np.array(list(seen.values()), float))
    for d, t in text.items():
        assert got[d] == pytest.approx(1 / (1 + math.exp(-(np.array(features(t)) @ w[:-1] + w[-1]))), abs=1e-6)


def test_clauses():
    lex = toxicity.Lexicon({"idiot": 4.0, "fool*": 2.0})
    weight = lambda s: toxicity.clause_weight(s.split(), lex)[0]
    assert weight("such an idiot") == 4 and weight("foolish") == 2 and weight("a calm day") == 0
    assert weight("not an idiot") < weight("an idiot") < weight("you idiot")
    assert weight("he said an idiot came") < weight("you idiot")
    assert weight("kill time") < weight("you i will kill")
