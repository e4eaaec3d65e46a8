"""Record selection and ingestion on small literals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from halyard.functions import text as X
from halyard.operators import corpus as C
from halyard.operators import geometry as G
from halyard.operators import lexical as L
from halyard.operators.encode import encode, hashing_encoder
from halyard.sources import articles
from halyard.sources.tables import RECORD, checksums, land_raw, read_config, read_csv, read_npy, read_raw, read_records, verify_checksums, write_csv, write_json, write_json_array, write_parquet
from halyard.streaming.windows import drain, tumbling_means

BASE = {"pmid": "1", "title": " T ", "abstract": "A", "year": "2001", "languages": ["eng"], "publication_types": ["Journal Article"]}


def records(spark, *changes):
    return spark.createDataFrame([tuple(({**BASE, **c}).get(n) for n in RECORD.names) for c in changes], RECORD)


def test_selection(spark):
    kept = C.select_records(records(spark, {}, {"pmid": "2", "languages": None}, {"pmid": "3", "languages": ["ger"]}, {"pmid": "4", "publication_types": [" EDITORIAL "]}, {"pmid": "5", "year": None}, {"pmid": ""}, {"pmid": "6", "title": " ", "abstract": None}, {"pmid": "7", "year": "soon"}), ["editorial"])
    assert [(r["pmid"], r["text"], r["year"]) for r in kept.collect()] == [("1", "T A", 2001)]


@pytest.mark.parametrize("year", ["2000.5", "true"])
def test_fractional_and_boolean_years_are_errors(spark, year):
    with pytest.raises(Exception, match="year is not an integer"):
        C.select_records(records(spark, {"year": year}), []).collect()


def test_whole_float_year(spark):
    assert C.select_records(records(spark, {"year": "2003.0"}), []).first()["year"] == 2003


def test_duplicates_and_counts_are_errors(spark):
    with pytest.raises(ValueError, match="occurs 2"):
        C.check_unique(records(spark, {}, {}), "pmid")
    with pytest.raises(ValueError, match="declared"):
        C.check_count(records(spark, {}), 2)
    with pytest.raises(ValueError, match="only on the right"):
        C.check_keys_equal(records(spark, {}), records(spark, {}, {"pmid": "9"}), "pmid")


def test_window_and_floor(spark):
    sizes = {1998: 7, 2000: 6, 2010: 4, 2013: 5, 2024: 9, 2025: 8, 2031: 1}
    rows = [(y, k) for y, n in sizes.items() for k in range(n)] + [(None, 0)] * 6
    df = C.floor_mask(spark.createDataFrame(rows, "year int, k int"), [])
    kept = {r["year"]: r["n"] for r in df.filter("analyzed = 1").groupBy("year").agg(F.count("*").alias("n")).collect()}
    assert df.count() == len(rows) and kept == {2000: 6, 2013: 5, 2024: 9}


def test_types(spark):
    df = spark.createDataFrame([("['Clinical Trial, Phase I', 'Review']",), ("Review",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(X.parse_types(F.col("t"))).collect()] == [["clinical trial, phase i", "review"], ["review"], [], []]
    w = {"RCT": 3.0, "Case Reports": 0.5}
    lists = spark.createDataFrame([(["RCT"],), (["rct"],), (["Case Reports"],), (["Case Reports", "RCT"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in lists.select(X.evidence_weight(F.col("t"), w)).collect()] == [3, 1, 1, 3, 1, 1]


def reply(*items):
    return f"<?xml version='1.0'?><Set>{''.join(items)}</Set>"


def article(pmid, title="", *, date="", abstracts=(), types=(), headings=(), language=""):
    """An article as the archive writes one, of the parts that a test names."""
    listed = "".join(f"<PublicationType>{t}</PublicationType>" for t in types)
    subjects = "".join(f"<MeshHeading><DescriptorName MajorTopicYN='{flag}'>{name}</DescriptorName></MeshHeading>" for name, flag in headings)
    return (
        f"<PubmedArticle><MedlineCitation><PMID Version='1'>{pmid}</PMID><Article><Journal><JournalIssue><PubDate>{date}</PubDate></JournalIssue><Title>Annals</Title></Journal>"
        f"<ArticleTitle>{title}</ArticleTitle><Abstract>{''.join(f'<AbstractText>{a}</AbstractText>' for a in abstracts)}</Abstract><Language>{language}</Language>"
        f"<PublicationTypeList>{listed}</PublicationTypeList></Article><MeshHeadingList>{subjects}</MeshHeadingList>"
        "<CommentsCorrectionsList><CommentsCorrections><PMID>999</PMID></CommentsCorrections></CommentsCorrectionsList></MedlineCitation></PubmedArticle>"
    )


def test_article_xml(spark):
    full = article(31, "Tendon <sup>2</sup>repair", date="<Year> 2015 </Year><Month>May</Month>", abstracts=["Aim: <u>none</u>", "", "Result"], types=["Letter", " "], headings=[("Knee", "Y"), ("Adult", "N")], language="fre")
    loose = article(32, "", date="<MedlineDate>Winter 2003/04</MedlineDate>")
    undated = article(33, "Untold", date="<Season>Spring</Season>")
    book = "<PubmedBookArticle><BookDocument><PMID>34</PMID></BookDocument></PubmedBookArticle>"
    rows = articles.parse_replies(spark.createDataFrame([(reply(full, book, loose),), (reply(undated),), (reply(),)], "xml string")).collect()
    by = {r["pmid"]: r for r in rows}
    assert [r["pmid"] for r in rows] == ["31", "34", "32", "33"]
    assert (by["31"]["title"], by["31"]["abstract"], by["31"]["year"]) == ("Tendon 2repair", "Aim: none Result", "2015")
    assert (by["31"]["languages"], by["31"]["publication_types"]) == (["fre"], ["Letter"])
    assert by["32"]["year"] == "2003" and by["32"]["title"] == "" and by["33"]["year"] is None
    assert by["34"]["exclusion"] and by["34"]["languages"] is None
    (got,) = articles.records_of(reply(full))
    assert got["mesh_major"] == ["Knee"] and got["journal"] == "Annals"


@pytest.mark.parametrize("bad", ["<Failure>down</Failure>", "<PubmedBookArticle><BookDocument/></PubmedBookArticle>"])
def test_other_elements_are_refused(bad):
    with pytest.raises(ValueError):
        list(articles.records_of(reply(article(1, "x"), bad)))


def search(ids, count=None, **more):
    return {"header": {"type": "esearch"}, "esearchresult": {"count": str(len(ids) if count is None else count), "idlist": ids} | more}


def test_search_replies():
    assert articles.ids_of(search(["41", "42", "43"])) == ["41", "42", "43"]
    cut, repeated, nothing = search(["41"], 20), search(["41", "42", "41"]), search([])
    inside, listed, above = search(["41"], error="x"), search(["41"], errorlist={"phrasesnotfound": ["q"]}), search(["41"]) | {"error": "API rate limit"}
    for bad in (cut, repeated, nothing, inside, listed, above, search(["41"], ERROR="x"), {}, {"esearchresult": {"count": "1"}}):
        with pytest.raises(ValueError):
            articles.ids_of(bad)
    assert articles.ids_of(search(["41"], errorlist={})) == ["41"]


class Shelf:
    """A remote archive of a few articles."""

    def __init__(self, lost=()):
        self.lost = lost

    def search(self, term):
        return [str(i) for i in range(50, 57)] if term == "tendon" else []

    def fetch(self, ids):
        return reply(*[article(i, f"Title {i}", date="<Year>2011</Year>") for i in reversed(ids) if i not in self.lost])


def test_remote_archive(spark):
    got = articles.remote_records(spark, Shelf(), "tendon", batch=3).collect()
    assert [r["pmid"] for r in got] == [str(i) for i in range(50, 57)] and {r["year"] for r in got} == {"2011"}
    with pytest.raises(Exception, match="not returned"):
        articles.remote_records(spark, Shelf(lost={"53"}), "tendon", batch=3).collect()


def test_retries():
    class Busy(Exception):
        code = 429

    waits, calls = [], iter([Busy(), OSError(), "ok"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert articles.patiently(call, sleep=waits.append) == "ok" and waits == [0.34, 1.0, 0.34, 2.0, 0.34]
    with pytest.raises(ValueError):
        articles.patiently(lambda: (_ for _ in ()).throw(ValueError()), sleep=waits.append)


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"pmid": "1", "year": 2001, "languages": ["eng"]}, {"pmid": "2", "year": "1999"}]')
    got = read_records(spark, str(tmp_path / "r.json"), declared=2)
    assert [r["year"] for r in got.orderBy("pmid").collect()] == ["2001", "1999"]
    write_csv(got.select("pmid", "year"), str(tmp_path / "out"))
    assert read_csv(spark, str(tmp_path / "out"), "pmid string, year int").count() == 2


def test_lexical_literal(spark):
    texts = spark.createDataFrame([(1, 2000, "alpha beta"), (2, 2000, "beta gamma"), (3, 2001, "gamma delta"), (4, 2001, "alpha beta")], "doc_id long, year int, text string")
    counts = L.term_counts(texts, ["doc_id", "year"])
    anchor = counts.filter("doc_id = 1").select("term", "tf")
    got = {r["year"]: r["value"] for r in L.variant(counts, anchor, "record", "record_mean").collect()}
    assert got[2000] > 0.5 and got[2001] == pytest.approx(0.5)


def test_terms_are_counted_within_their_text(spark):
    got = spark.createDataFrame([("b a b Ä ä a b",), ("",), (None,), ("aa",)], "t string").select(X.counted(F.split("t", " ")).alias("c")).collect()
    assert [[tuple(x) for x in r["c"]] for r in got] == [[("a", 2), ("b", 3), ("Ä", 1), ("ä", 1)], [("", 1)], [], [("aa", 1)]]


def test_tfidf_groups_no_terms_by_document(spark, tmp_path):
    """Memory of a task follows the terms of years, not those of documents; an id that stands in two rows is one document."""
    from halyard.plans import registry
    from tests.compare import oracle, rows

    texts = ["alpha beta beta", "beta gamma", "gamma delta alpha", "alpha beta", "", None, "delta delta", "beta alpha eta"]
    odd = {"once": list(range(8)), "repeated": [0, 1, 2, 1, 3, 4, 2, 6]}
    for name, ids in odd.items():
        d = [(i, t, "en", f"src{k % 3}", 1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        spark.createDataFrame(d, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/x")
        spark.read.parquet(f"{tmp_path}/{name}/x").coalesce(1).write.parquet(f"{tmp_path}/{name}/y")
        one = next((tmp_path / name / "y").glob("*.parquet"))
        one.rename(tmp_path / name / "documents.parquet")
        for query in ("tfidf_record_year", "tfidf_year_year", "tfidf_record_record", "tfidf_year_record"):
            assert rows(registry.QUERIES[query](spark, f"{tmp_path}/{name}").toPandas()) == rows(oracle(registry.ORACLE_SQL[query], f"{tmp_path}/{name}")), (name, query)
    d = spark.read.parquet(f"{tmp_path}/once/documents.parquet").select("doc_id", F.lit(2000).alias("year"), "text")
    assert "Aggregate" not in L.document_counts(d)._jdf.queryExecution().executedPlan().toString()


def test_moving_mean_and_peak(spark):
    df = spark.createDataFrame([("a", x, y) for x, y in enumerate([3.0, 3.0, 0.0, 3.0])], "k string, x int, y double")
    assert [round(r["smooth"], 6) for r in G.moving_mean(df, ["k"], "x", "y").orderBy("x").collect()] == [3.0, 2.0, 2.0, 2.0]
    assert G.peak(df, ["k"], "x", "y").first()["x"] == 0


def test_encoder_is_unit_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, text string")
    a, b, c = (r["vector"] for r in encode(df, hashing_encoder).orderBy("id").collect())
    assert a == b and sum(x * x for x in a) == pytest.approx(1, abs=1e-5) and len(c) == 64


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", "ts", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    drain(tumbling_means(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["event_type"], r["start"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["event_type"], r["start"]): r["n"] for r in tumbling_means(events).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_raw_replies_make_the_archive(spark, tmp_path):
    xml = [reply(article(61, "One", date="<Year>2012</Year>")), reply(article(62, "Two"), "<PubmedBookArticle><BookDocument><PMID>63</PMID></BookDocument></PubmedBookArticle>")]
    land_raw(spark.createDataFrame([(f"r{i}.xml", x) for i, x in enumerate(xml)], "name string, payload string"), str(tmp_path / "raw"))
    raw = read_raw(spark, str(tmp_path / "raw")).select(F.col("payload").cast("string").alias("xml"))
    archive = articles.parse_replies(raw)
    write_json(archive, str(tmp_path / "archive"))
    kept = spark.read.schema(RECORD).json(str(tmp_path / "archive"))
    searches = [(search(["61", "62", "63"]), [61, 62, 63])]
    assert articles.check_raw(searches, raw, kept).first().asDict() == {"queries": 1, "replies": 2, "records": 3, "excluded": 1}
    with pytest.raises(ValueError, match="search 0 differs"):
        articles.check_raw([(searches[0][0], ["61"])], raw, kept)
    with pytest.raises(ValueError, match="62 is not archived"):
        articles.check_raw(searches, raw, kept.filter("pmid != '62'"))
    with pytest.raises(ValueError, match="is not in the replies"):
        articles.check_raw(searches, raw, kept.union(kept.limit(1)))
    bad = spark.read.parquet(str(tmp_path / "raw")).withColumn("sha256", F.lit("0"))
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="content differs"):
        read_raw(spark, str(tmp_path / "bad")).collect()


def test_files_of_other_kinds(spark, tmp_path):
    import gzip
    import hashlib
    import json

    import numpy as np

    vectors = np.arange(12.0).reshape(4, 3)
    np.save(tmp_path / "v.npy", vectors.astype(np.float32))
    got = read_npy(spark, str(tmp_path / "v.npy"), 3).orderBy("row").collect()
    assert [r["vector"] for r in got] == vectors.tolist()
    with pytest.raises(Exception, match="4 expected"):
        read_npy(spark, str(tmp_path / "v.npy"), 4).collect()
    (tmp_path / "r.json.gz").write_bytes(gzip.compress(b'[{"pmid": "9", "year": 2003}]'))
    assert read_records(spark, str(tmp_path / "r.json.gz"), 1).first()["year"] == "2003"
    digest = hashlib.sha256((tmp_path / "v.npy").read_bytes()).hexdigest()
    assert checksums(spark, str(tmp_path / "v.npy")).first()["sha256"] == digest
    verify_checksums(spark, {str(tmp_path / "v.npy"): digest})
    with pytest.raises(ValueError, match="content differs"):
        verify_checksums(spark, {str(tmp_path / "v.npy"): "0"})
    (tmp_path / "c.json").write_text('{"a": [1]}')
    assert read_config(str(tmp_path / "c.json")) == {"a": [1]}
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    write_json_array(df, str(tmp_path / "array"))
    (part,) = (tmp_path / "array").glob("part-*")
    assert sorted(json.loads(part.read_text()), key=lambda r: r["k"]) == [{"k": 1, "v": "x"}, {"k": 2}]
    write_parquet(df, str(tmp_path / "p"), "k")
    with pytest.raises(Exception, match="already exists"):
        write_parquet(df, str(tmp_path / "p"))


def test_terms_in_context(spark):
    import numpy as np

    from halyard.operators import encode as E

    texts = ["a big knee hurts", "knee pain and knee care and knee", None, "nothing", "big knee", "a big knee"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = E.occurrence_vectors(docs, ["knee", "big knee"], E.neighbour_encoder)
    got = {r["term"]: r for r in E.in_context(found, ["doc_id"], most=4, least=2).collect()}
    encoder, unit = E.neighbour_encoder(), lambda v: v / np.linalg.norm(v)
    want = {"knee": [], "big knee": []}
    for text in texts:
        words, states = encoder([text or ""])[0]
        for term, vectors in want.items():
            part = term.split()
            if len(vectors) < 4:
                vectors += [unit(states[i : i + len(part)].mean(axis=0)) for i in range(len(words)) if words[i : i + len(part)] == part][:2]
    assert {t: r["n"] for t, r in got.items()} == {"knee": 4, "big knee": 3}
    for term, vectors in want.items():
        assert got[term]["vector"] == pytest.approx(unit(np.mean(vectors, axis=0)))
    alone = spark.createDataFrame([("knee", got["knee"]["vector"])], "term string, vector array<double>")
    row = E.displacement(alone, E.in_context(found, ["doc_id"], most=4, least=2), list(got["knee"]["vector"])).first()
    assert (row["displacement"], row["cos_alone"], row["pull"]) == pytest.approx((0, 1, 0), abs=1e-9)


def test_only_the_texts_that_count_are_encoded(spark, tmp_path):
    from halyard.operators import encode as E

    texts = [None, "nothing", "", *[f"a knee {i} and a big knee and knee" if i % 3 else f"the big\u00a0KNEE {i}" for i in range(300)]]
    docs = spark.createDataFrame([(None if i == 5 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    folder = str(tmp_path)

    def make():
        import uuid
        from pathlib import Path

        encoder = E.neighbour_encoder()

        def run(batch):
            Path(folder, uuid.uuid4().hex).write_text("\n".join(["text"] * len(batch)))
            return encoder(batch)

        run.tokens = encoder.tokens
        return run

    terms = ["knee", "big knee", "the", "hip"]
    got = {r["term"]: (r["n"], r["vector"]) for r in E.context_vectors(docs, terms, make, ["doc_id"], most=20, least=2).collect()}
    encoded = sum(len(p.read_text().split()) for p in tmp_path.iterdir())
    want = {r["term"]: (r["n"], r["vector"]) for r in E.in_context(E.occurrence_vectors(docs, terms, E.neighbour_encoder), ["doc_id"], most=20, least=2).collect()}
    assert set(got) == {"knee", "big knee", "the"}
    for term, (n, vector) in want.items():
        assert got[term][0] == n and got[term][1] == pytest.approx(vector)
    assert 0 < encoded <= 60


def _big_enough(spark, folder, rows=300_000):
    """Documents and vectors whose ranges Spark would draw anew each time: keys are many and stand in no order."""
    ids = spark.range(rows, numPartitions=4).select(F.pmod(F.col("id") * 7919, F.lit(rows)).alias("doc_id"))
    d = ids.select("doc_id", F.lit("a").alias("text"), F.when(F.col("doc_id") % 3 == 0, "de").otherwise("en").alias("lang"), F.concat(F.lit("src"), (F.xxhash64("doc_id", F.lit(1)) % 20 + 20) % 20).alias("source"), F.lit(1).cast("long").alias("n_chars"))
    d.write.parquet(f"{folder}/documents.parquet")


def test_ordinals_are_the_same_in_every_run(spark, tmp_path):
    from halyard.operators.corpus import with_ordinal

    rows = 300_000
    _big_enough(spark, tmp_path, rows)
    d = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "lang")
    out = with_ordinal(d, "doc_id")
    assert out.filter("ordinal != doc_id").count() == 0 and out.count() == rows
    # By two columns: numbers are whole and follow the order, and a part of the plan gives the same ones.
    two = with_ordinal(d, "lang", "doc_id")
    german = -(-rows // 3)
    assert two.filter(F.col("lang") == "de").filter(F.col("ordinal") != F.col("doc_id") / 3).count() == 0
    assert two.select("ordinal").distinct().count() == rows
    assert two.filter("lang = 'en'").agg(F.min("ordinal"), F.max("ordinal")).first()[:] == (german, rows - 1)


def _values(spark, folder, rows=120_000):
    """(doc_id, year, cos) on disk, in no order, and the same as arrays in the order of doc_id."""
    import numpy as np

    i = F.col("id")
    at = spark.range(rows, numPartitions=4).select(F.pmod(i * 7919, F.lit(rows)).alias("doc_id"))
    at.select("doc_id", (2000 + F.pmod(F.xxhash64("doc_id"), F.lit(12))).cast("int").alias("year"), (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1000)) / 1000).alias("cos")).write.parquet(f"{folder}/v")
    df = spark.read.parquet(f"{folder}/v")
    frame = df.toPandas().sort_values("doc_id")
    return df, *(frame[c].to_numpy() for c in ("doc_id", "year", "cos")), np


def _draws(np, keys):
    import hashlib

    return np.array([int(hashlib.md5(k.encode()).hexdigest()[:8], 16) for k in keys])


def _tau(np, x):
    i, j = np.triu_indices(len(x), 1)
    return np.sign(x[j] - x[i]).sum() / len(i)


def test_shuffled_years_of_many_rows(spark, tmp_path):
    from halyard.operators.resample import year_shuffle

    df, ids, years, cos, np = _values(spark, tmp_path)
    taus = []
    for rep in (1, 2, 3):
        of = years[np.argsort(_draws(np, [f"{i}-{rep}" for i in ids]), kind="stable")]
        taus.append(_tau(np, np.array([cos[of == y].mean() for y in range(2000, 2012)])))
    # The bound lies between neighbours among the taus, so each of them is told apart.
    for bound in sorted(abs(t) for t in taus):
        row = year_shuffle(df, bound, 3).first()
        assert (row["replicates"], row["exceed"]) == (3, sum(abs(t) >= bound - 1e-12 for t in taus))


def test_bootstrap_of_many_rows(spark, tmp_path):
    """Means, and the sign and the range that are made of them."""
    from halyard.operators import resample as B

    df, ids, years, cos, np = _values(spark, tmp_path)
    want = {}
    for rep in (1, 2):
        for y in range(2000, 2012):
            own = cos[years == y]
            want[rep, y] = own[_draws(np, [f"{y}-{k}-{rep}" for k in range(1, len(own) + 1)]) % len(own)].mean()
    means = B.bootstrap_means(df, 2)
    assert {(r["rep"], r["year"]): r["mean"] for r in means.collect()} == pytest.approx(want)
    taus = [_tau(np, np.array([want[rep, y] for y in range(2000, 2012)])) for rep in (1, 2)]
    lines = B.bootstrap_lines(means)
    assert B.same_sign(lines, 1.0).first()["same_sign_pct"] == pytest.approx(50 * sum(t > 0 for t in taus))
    assert B.tau_range(lines).first()[:] == pytest.approx(tuple(np.percentile(taus, [2.5, 97.5])))


@pytest.mark.parametrize("keys", [[], [7], [3, None, 1, None, 2], list(range(200)), [5] * 50 + [4] * 50])
def test_ordinals_of_odd_tables(spark, monkeypatch, keys):
    from halyard.operators import corpus

    monkeypatch.setattr(corpus, "RANGE", 10)
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int").repartition(3)
    got = [(r["ordinal"], r["k"]) for r in corpus.with_ordinal(df, "k").collect()]
    assert sorted(got, key=lambda x: x[0]) == list(enumerate(sorted(keys, key=lambda k: (k is not None, k or 0))))


def test_number_formats(spark):
    from halyard.functions import series as S

    values = [0.0, 1.0, 0.5, 123456.7, 1234567.0, 0.000123456789, 0.00001234567, -2.5e-9, 3.14159265, 100000.0, 999999.6, -0.25]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for v, r in zip(values, df.select("x", S.general(F.col("x")).alias("g"), S.scientific(F.col("x")).alias("e"), S.fixed(F.col("x"), 3).alias("f")).collect(), strict=True):
        assert r["g"] == f"{v:.6g}" and r["e"] == f"{v:.2e}"
    assert [r[0] for r in df.select(S.fixed(F.col("x"), 3)).collect()][:3] == ["0.000", "1.000", "0.500"]
