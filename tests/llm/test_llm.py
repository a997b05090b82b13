import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from netloom.llm import ann, decontam, langid, license, linededup, mixing, ngram_join, quality, toxicity, warc
from netloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keys string"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    rows = lambda d: sorted(tuple("null" if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x) for x in r) for r in d[sorted(d.columns)].astype(object).values.tolist())
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


@pytest.fixture(scope="module")
def odd(spark):
    long = "word " * 30_000
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (3, long, "en", "a", 5, "x"), (3, long, "en", "a", 5, "x"), (None, "The MIT License", "en", None, 9, None), (4, "\n\n", None, "b", 2, None)]
    return spark.createDataFrame(rows, DOCS)


def test_odd_rows_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "word word"), (2, None), (None, "x")], "item_id long, text string")
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for df in (decontam.digest(docs, bench), linededup.digest(docs), ngram_join.similar_components(docs), license.scan(docs), langid.predict(docs), toxicity.score(docs, labels), quality.scores(docs, labels), mixing.mix(docs)):
            assert df.count() == n
    hit = {r.doc_id: r.n_hit for r in decontam.digest(odd, bench).collect()}
    assert hit[3] == 30_000 and hit[1] == 0


BIG = 1 << 60


def test_ids_above_2_to_the_60_stay_exact_beside_nulls(spark):
    pages = spark.createDataFrame([(BIG + 1, "u", "same"), (BIG + 3, "u", "same"), (None, "u", "same"), (None, "u", "other")], "page_id long, url string, html string").coalesce(1)
    got = warc.digest(pages).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [(0, "response", None), (0, "revisit", BIG + 1), (BIG + 1, "response", None), (BIG + 3, "revisit", BIG + 1)]
    docs = spark.createDataFrame([(BIG + 3, "a b c d e f"), (BIG + 1, "A  b c d e f"), (None, "a b c d e f"), (BIG + 5, "x y"), (BIG + 7, None)], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs).collect()}
    assert rows == {BIG + 1: (3, BIG + 1), BIG + 3: (3, BIG + 1), None: (3, None), BIG + 5: (1, BIG + 5), BIG + 7: (0, BIG + 7)}


def test_every_record_has_the_mandatory_fields(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (None, None, None)], "page_id long, url string, html string")
    index = warc.write_bundles(pages)
    heads = [h for r in warc.fetch(index, pages).collect() for h, _ in warc.records(bytes(r.record))]
    assert len({h["WARC-Record-ID"] for h in heads}) == len(heads) == 2 and all({"WARC-Date", "WARC-Type", "Content-Length"} <= set(h) for h in heads)
    answer, again = sorted(heads, key=lambda h: h["WARC-Type"])
    assert again["WARC-Refers-To"] == answer["WARC-Record-ID"]


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "one long line here\nx", "k", "s", 1, "f", "c", "en", "src0"), (2, "one long line here\ny", "k", "s", 2, "f", "c", "en", "src0")],
                                 "doc_id long, text string, keys string, s string, n_lines long, _full string, _key string, lang string, source string")
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert (got[2]["keys"], got[2].s, got[2].text, got[2].n_lines, got[2].n_dropped) == ("k", "s", "y", 2, 1)
    mixed = mixing.mix(docs)
    assert {(r._full, r._key, r.copies) for r in mixed.collect()} == {("f", "c", 1)} and mixed.columns == [*docs.columns, "n_tokens", "copies"]


def _mixture(spark, rows, **how):
    docs = spark.createDataFrame([(i, "w " * n, lang, source) for i, (n, lang, source) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    return {r.doc_id: r.copies for r in mixing.mix(docs, max_epochs=1, **how).collect()}


def test_mixing_passes_a_shortage_up_two_levels(spark):
    # 30 tokens to give. Domain x holds 6 in all: its languages and sources cannot take more, so y gets 24 of its 40.
    rows = [(2, "en", "x1"), (2, "en", "x2"), (2, "de", "x1")] + [(2, "en", "y1")] * 20
    copies = _mixture(spark, rows, share=30 / 46)
    assert [copies[i] for i in range(3)] == [1, 1, 1] and sum(copies.values()) == 15
    # Within x the weights 3 : 1 hold while both have enough: of 8 tokens 6 are English.
    rows = [(1, "en", "x1")] * 20 + [(1, "de", "x1")] * 20
    copies = _mixture(spark, rows, share=8 / 40, weights={"lang": {"en": 3.0}})
    assert sum(copies[i] for i in range(20)) == 6 and sum(copies[i] for i in range(20, 40)) == 2


def test_mixing_takes_a_weight_of_zero(spark):
    rows = [(1, "en", "x1")] * 4 + [(1, "de", "x1")] * 4
    copies = _mixture(spark, rows, share=0.5, weights={"lang": {"de": 0.0}})
    assert [copies[i] for i in range(8)] == [1, 1, 1, 1, 0, 0, 0, 0]
    assert sum(_mixture(spark, rows, weights={"lang": {"de": 0.0, "en": 0.0}}).values()) == 0
    with pytest.raises(ValueError):
        _mixture(spark, rows, weights={"lang": {"de": -1.0}})


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(2, "u", "same"), (1, None, "same"), (3, "u", None), (4, "u", "é" * 400_000)], "page_id long, url string, html string")
    index = warc.write_bundles(pages, frame_bytes=1000)
    got = {r.page_id: r for r in warc.read_bundles(index).collect()}
    assert got[2].refers_to == 1 and got[1].record_type == "response" and got[4].payload_bytes == 800_000
    one = warc.fetch(index, pages.where("page_id = 4")).first().record
    assert next(iter(warc.records(bytes(one))))[1].decode() == "é" * 400_000
    assert warc.digest(pages.limit(0)).count() == 0


def test_line_index_is_reversible(spark):
    docs = spark.createDataFrame([(1, "a shared line\nown line of one"), (2, "A shared line \nother"), (3, "a shared line")], "doc_id long, text string")
    whole = linededup.LineIndex.build(docs)
    lost = lambda ix: sorted(r.doc_id for r in ix.losses().collect())
    assert lost(whole) == [2, 3] == lost(linededup.LineIndex.build(docs.where("doc_id < 3")).insert(docs.where("doc_id = 3")))
    assert lost(whole.delete(spark.createDataFrame([(1,)], "doc_id long"))) == [3]


def test_cuckoo_filter():
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    f = linededup.CuckooFilter(5000)
    f.insert(h)
    assert f.contains(h).all() and f.contains(h + 1).mean() < 0.01
    f.delete(h[:2500])
    assert f.contains(h[2500:]).all() and f.contains(h[:2500]).mean() < 0.05


@pytest.mark.parametrize("shards", [32, 96])
def test_cuckoo_filter_of_one_shard_among_many(shards):
    h = np.random.default_rng(3).integers(-(2**57), 2**57, 200_000) // shards * shards + 7
    f = linededup.CuckooFilter(len(h))
    f.insert(h)
    assert f.contains(h).all()


def test_line_index_updates_touched_shards_only(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('line number ', id div 2, '\\nfamily of lines ', id % 7) as text")
    lost = lambda ix, **how: sorted((r.doc_id, sorted(r["keys"])) for r in ix.losses(**how).collect())
    whole = linededup.LineIndex.build(docs, shards=16)
    assert lost(whole) == lost(whole, broadcast_bytes=0) and len(lost(whole)) == 396
    part = linededup.LineIndex.build(docs.where("doc_id < 30"), shards=16)
    one = part.insert(docs.where("doc_id = 30"))
    blobs = lambda ix: {r.shard: bytes(r.filter) for r in ix.filters.collect()}
    assert one.shards == 16 and blobs(one) == blobs(part)  # counts rise, no key becomes shared
    two = one.insert(docs.where("doc_id = 31"))
    assert len(blobs(two).items() - blobs(one).items()) == 1
    grown = two.insert(docs)
    counts = lambda ix: sorted((r.key, r.refs, r.owner) for r in ix.refs.collect())
    assert counts(grown) == counts(whole) and lost(grown) == lost(whole) == lost(grown, broadcast_bytes=0)
    back = grown.delete(docs.where("doc_id >= 30").select("doc_id"))
    assert counts(back) == counts(part) and lost(back) == lost(part) == lost(back, broadcast_bytes=0)


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (50, 100)])
@pytest.mark.parametrize("shape", [(2, 1), (3, 1), (1, 0), (4, 2)])
def test_signatures_meet_for_every_linked_pair(num, den, shape):
    rng = np.random.default_rng(2)
    for n in [1, 2, 3, 6, 7, 8, 12, 13, 15, 16, 17, 20, 47, 100, 333, 1000]:
        for _ in range(12):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop, add = rng.integers(0, n // 6 + 2), rng.integers(0, n // 6 + 2)
            y = np.unique(np.r_[rng.permutation(x)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)])
            both = len(np.intersect1d(x, y))
            if len(y) and den * both >= num * (len(x) + len(y) - both) and not np.array_equal(x, y):
                assert np.intersect1d(ngram_join.signatures(x, num, den, *shape), ngram_join.signatures(y, num, den, *shape)).size


def test_components_equal_brute_force(spark):
    got = {r.doc_id: r for r in ngram_join.similar_components(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    sets, up = {}, {}
    for i, t in duckdb.execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        w = [x for x in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[i], up[i] = ({tuple(w[a : a + 4]) for a in range(max(1, len(w) - 3))} if w else set()), i
    top = lambda x: x if up[x] == x else top(up[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), top(i)) for i, s in sets.items()}


def test_nearest_recall(spark):
    got = ann.nearest(spark.read.parquet(f"{SF}/embeddings.parquet")).toPandas()
    t = duckdb.execute(f"select vec_id, embedding from '{SF}/embeddings.parquet'").df()
    x = np.stack(t.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T
    np.fill_diagonal(near, -9)
    want = {(t.vec_id[q], t.vec_id[v]) for q in np.flatnonzero(t.vec_id % 50 == 0) for v in np.argsort(-near[q], kind="stable")[:5]}
    assert len(want & set(zip(got.query_id, got.vec_id, strict=True))) >= 0.9 * len(want)


def test_nearest_bounds_both_sides_of_a_group(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(3000, 8))
    x[1000:1900] = x[7]  # copies of one vector share all their cells
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    plain = lambda: ann.nearest(df, every=5, cells=20).orderBy("query_id", "rank").toPandas()
    want, apply = plain(), PandasCogroupedOps.applyInPandas

    def watched(ops, func, schema):
        def bounded(left, right):
            assert len(left) <= 300 and len(right) <= 150, (len(left), len(right))
            return func(left, right)

        return apply(ops, bounded, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", watched)
    monkeypatch.setattr(ann, "QUERY_ROWS", 100)
    monkeypatch.setattr(ann, "CELL_ROWS", 200)
    pd.testing.assert_frame_equal(plain(), want)
    copies = want[want["query_id"] == 1000]
    assert copies["vec_id"].tolist() == [7, 1001, 1002, 1003, 1004] and (copies["score"] > 0.999999).all()


def test_nearest_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0]), (None, [1.0, 0.0]), (50, [0.0, -1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, o int, cell int")
    got = [tuple(r) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 3)]
    assert [r[3] for r in got] == [1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, -1.0] and ann.nearest(df.limit(0)).count() == 0


def _licences(text, share=0.8):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = lambda p: [s for s in range(len(w) - len(p) + 1) if w[s : s + len(p)] == p]
    places = {label: at(p.split()) for p, label in license.BASE.items()}
    everywhere, labels, best = sum(places.values(), []), {x for x, v in places.items() if v}, 0.0
    base = ",".join(sorted(labels))
    for label, template, must in license.TEMPLATES:
        t, m = template.split(), must.split()
        o = next(i for i in range(len(t)) if t[i : i + len(m)] == m)
        for s in at(m):
            same = sum(0 <= s - o + i < len(w) and w[s - o + i] == x for i, x in enumerate(t)) / len(t)
            if same >= share:
                labels, best = labels | {label}, max(best, same)
    return len(w), len(everywhere), min(everywhere, default=None), max(everywhere, default=None), base, ",".join(sorted(labels)), 1.0 if base else best


def test_licences_equal_brute_force(spark):
    mit, bsd = license.TEMPLATES[0][1], license.TEMPLATES[3][1]
    odd = [None, "", mit.upper(), mit.replace("merge publish", "fork and sell"), "granted free of charge to any person obtaining a copy", f"x {bsd} the mit license {mit}", "cc by nc cc by nc", "word " * 30_000 + "the mit license", "boost software license"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6, t) for t in odd] + [(None, mit)], "doc_id long, text string"))
    got = sorted(map(str, (tuple(r)[1:] for r in license.scan(docs).collect())))
    assert got == sorted(str(_licences(r.text)) for r in docs.collect())


def test_license_base_places(spark):
    df = spark.createDataFrame([(1, "x The MIT-License, the mit license. Apache License, Version 2.0"), (2, "ccbync"), (3, "CC BY NC")], "doc_id long, text string")
    a, b, c = license.scan(df).orderBy("doc_id").collect()
    assert (a.n_base, a.first_word, a.last_word, a.base_labels) == (3, 1, 7, "apache-2,mit") and b.n_base == 0 and c.labels == "cc-by-nc"


def test_license_query_base_phrases(spark, tmp_path):
    rows = [(1, "x Under the MIT-License. the mit license"), (2, "the mit license"), (3, "cc by nc, Apache License Version 2"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_license"](spark, str(tmp_path)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels").orderBy("doc_id")
    assert [tuple(r) for r in got.collect()] == [(1, 8, 1, 1, 1, "mit", "mit"), (2, 3, 0, None, None, "", "mit"), (3, 7, 2, 0, 3, "apache-2,cc-by-nc", "apache-2,cc-by-nc"), (4, 0, 0, None, None, "", "")]


def test_viterbi_restores(spark):
    lm = toxicity.language_model(spark.createDataFrame([("stupid loser trash " * 50,)], "text string"))
    assert toxicity.restorer(lm)("you st00pid l0ser t r a s h stuuuupid").split()[2:] == ["loser", "trash", "stupid"]


@pytest.fixture(scope="module")
def restored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return toxicity.restorer(toxicity.language_model(docs), toxicity.vocabulary(docs))


@pytest.mark.parametrize("form", ["what a {}", "you are a {}", "y o u {}", "y o u  {}", "{}!", '"{}"', "({})"])
def test_disguised_words_are_found(restored, form):
    held = duckdb.execute("select doc_id, text from '/root/testdata/sf0.01/documents.parquet' join '/root/testdata/sf0.01/labels.parquet' using (doc_id) where toxic = 1").fetchall()
    seen = {w for i, t in held if zlib.crc32(str(i).encode()) % 4 == 2 for w in toxicity.WORD.findall(t.lower())}
    words = sorted(seen & {"clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"})
    assert len(words) > 5
    leet = str.maketrans("oieas", "01345")
    for masked in (" ".join, "  ".join, lambda w: w.translate(leet)):
        found = [w in toxicity.WORD.findall(restored(form.format(masked(w)))) for w in words]
        assert np.mean(found) >= 0.9, [w for w, x in zip(words, found, strict=True) if not x]


def test_words_of_three_letters_are_found(restored):
    assert [restored(" ".join(w)).strip() for w in ("the", "for", "are", "was")] == ["the", "for", "are", "was"] and restored("5cum!") == "scum"


def test_restoring_takes_linear_time(restored):
    import time

    for text in ("abcdefgh", "0123456789", "a1", "a b ", "!", " . ", "x12345678"):
        began = time.perf_counter()
        restored(text * (200_000 // len(text)))
        assert time.perf_counter() - began < 20, text


def test_quality_is_learned_and_kept(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    apart = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = quality.scores(docs, labels.where(~apart)).join(labels.where(apart & F.col("quality").isNotNull()), "doc_id").toPandas()
    assert (got.keep == (got.quality == 1)).mean() > 0.95 and got[got.quality == 1].keep.mean() > 0.97


def test_a_rare_language_is_learned(spark):
    rows = [(i, "the quick brown fox jumps over lazy dogs and runs away", "en") for i in range(3000)] + [(10**6 + i, "zażółć gęślą jaźń pchnąć w tę łódź jeża", "pl") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.lang_pred for r in langid.predict(docs, sample=200).where("doc_id >= 1000000").collect()}
    assert got == {"pl"}


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    stages, held = dict(corpus_pipeline.STAGES), [docs]
    for name in stages:
        held.append(corpus_pipeline.cut(stages[name](spark, held[-1], SF), "test"))
    con = duckdb.connect()
    for n, d in enumerate(held):
        con.register(f"h{n}", d.toPandas())
    con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    kept = quality.scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("keep")
    assert {r.doc_id for r in held[1].collect()} == {r.doc_id for r in kept.collect()}
    lines = con.execute(ORACLE_SQL["op2_line_dedup"].replace("FROM documents", "FROM h1") + " ORDER BY doc_id").df()
    lines = lines[(lines.n_dropped == 0) | (lines.kept_sha256 != hashlib.sha256(b"").hexdigest())]
    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in held[2].collect()} == dict(zip(lines.doc_id, lines.kept_sha256, strict=True))
    first = ngram_join.similar_components(held[2], 5, 80, 100).where("doc_id = component_id")
    assert {r.doc_id for r in held[3].collect()} == {r.doc_id for r in first.collect()}
    clean = con.execute("SELECT doc_id FROM (" + ORACLE_SQL["op1_decontaminate"].replace("FROM documents", "FROM h3") + ") WHERE NOT contaminated").df()
    assert {r.doc_id for r in held[4].collect()} == set(clean.doc_id)
    share = con.execute("SELECT doc_id, copies FROM (" + mixing.mixture_sql("h4", weights=mixing.WEIGHTS) + ") WHERE copies > 0").df()
    assert {r.doc_id: r.copies for r in held[5].collect()} == dict(zip(share.doc_id, share.copies, strict=True))
    assert all(d.columns == docs.columns for d in held[:5])


def test_pipeline_stages_take_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(3, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "mit license words"), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd.withColumn("_key", F.lit(1)), odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs.where("doc_id is null or doc_id != 3"), str(tmp_path))
            assert {None} <= {r.doc_id for r in got.collect()} or not docs.count()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lang = langid.predict(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (lang.lang == lang.lang_pred).mean() > 0.97
    bad = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (bad.toxic == bad.predicted).mean() > 0.9
