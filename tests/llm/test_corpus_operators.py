"""Operators over the whole corpus against plain Python and SQL."""

import duckdb
import pytest
from llm_cases import awkward, documents, jaccard_components, prose, windows_removed

import corpus_pipeline
from legnet.checks.views import TABLES
from legnet.llm import mixing, ngram_join, phrases, quality
from legnet.llm.queries import QUERIES, SQL
from legnet.llm.words import gram_hashes, split_words, word_hashes


def rows_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def near_copies(n, words, edits, start):
    """A group of near copies, some linked directly and some through others only."""
    import random

    rnd = random.Random(words)
    base = prose(words, words).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = prose(rnd.randrange(10**6), 1)
        out.append((start + i, " ".join(w)))
    return out


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    cur = con.execute(SQL[name])
    order = sorted(range(len(cur.description)), key=lambda i: cur.description[i][0])
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == want


def test_words_and_grams():
    texts = ["A b\x0bc", None, "", "x y z", "a b c"]
    w = split_words(texts)
    assert [w.data[a:b].decode() for a, b in zip(w.start, w.end)] == ["A", "b", "c", "x y", "z", "a", "b", "c"]
    assert w.first.tolist() == [0, 3, 3, 3, 5, 8]
    h = word_hashes(w)
    assert h[1] == h[6] and h[0] != h[5]
    g = gram_hashes(h, 2)
    assert g[1] == g[6] and len(set(g.tolist())) == 6


@pytest.mark.parametrize("size, num, den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_join(spark, sf, size, num, den, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)  # large groups take the blocked way too
    rows = [r[:2] for r in awkward() if r[0] is not None] + near_copies(60, 150, 7, 2000)
    rows += near_copies(30, 12, 2, 3000) + near_copies(40, 600, 30, 4000)
    if size == 3:
        rows += [(i + 10_000, t) for i, t in rows_of(spark, sf)]
    like = ngram_join.Similarity(num, den)
    got = ngram_join.join(documents(spark, rows), size=size, like=like).collect()
    want = jaccard_components(rows, size, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)


def test_jaccard_join_edges(spark):
    assert ngram_join.join(documents(spark, [])).count() == 0


def test_jaccard_row_without_id_has_no_component(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "A B  C d"), (3, None)]
    got = ngram_join.join(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == [
        ("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("3", 0, 3), ("None", 2, None)
    ]


def test_jaccard_cells_are_bounded(spark, tmp_path, monkeypatch):
    """A bucket of documents that are mostly not linked: no task holds the whole bucket."""
    import numpy as np

    real, folder, most = ngram_join._walk, str(tmp_path), 16

    def spy(batches, keys, like, exact, arrow):
        import uuid
        from collections import Counter

        rows = list(batches)
        seen = Counter(k for b in rows for k in zip(*(b.to_pydict()[c] for c in keys)))
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(" ".join(map(str, seen.values())))
        yield from real(iter(rows), keys, like, exact, arrow)

    monkeypatch.setattr(ngram_join, "_walk", spy)
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", most)
    rnd = np.random.default_rng(3)
    sketches = rnd.integers(0, 1 << 63, (400, 4), dtype=np.uint64)
    for i in range(0, 400, 10):  # pairs far apart in the table, one bit away from each other
        sketches[(i + 205) % 400] = sketches[i] ^ np.uint64(1)
    rows = [(7, i, 200, s.tobytes()) for i, s in enumerate(sketches)]
    frame = spark.createDataFrame(rows, "g long, rep long, n long, sketch binary")
    got = ngram_join.linked(frame, ngram_join.Similarity(), exact=False).df.collect()
    assert {frozenset((r.u, r.v)) for r in got} == {frozenset((i, (i + 205) % 400)) for i in range(0, 400, 10)}
    sizes = [int(x) for f in tmp_path.iterdir() for x in f.read_text().split()]
    assert max(sizes) <= 5 * most  # two blocks and what hashing puts unevenly; it was all 400
    assert sum(x * x for x in sizes) / 2 < 4 * 400 * 400


def test_difference_bound():
    like = ngram_join.Similarity(9, 10)
    for n in range(1, 60):
        for m in range(n, 70):
            for common in range(n + 1):
                if 100 * common >= 90 * (n + m - common):
                    assert n + m - 2 * common <= like.difference(n + m) and m <= like.largest(n)


def test_phrases(spark, sf, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_DOCS", 5)  # frequent anchors go to several shards
    monkeypatch.setattr(phrases, "SHARD_PHRASES", 50)
    passage = prose(77, 55)
    rows = [r[:2] for r in awkward() if r[0] is not None] + [(10_000 + i, t) for i, t in rows_of(spark, sf)]
    rows += [(500 + i, f"{prose(i, 30)} {passage} {prose(i + 900, 10)}") for i in range(40)]
    rows += [(600, " ".join([passage] * 3)), (601, "ab cd " * 40), (602, "ab cd " * 41), (603, passage[:200])]
    got = phrases.dedup(documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == windows_removed(rows)
    assert len(got) == len(rows)


def test_phrases_of_a_frequent_anchor_are_dealt_once(spark, tmp_path, monkeypatch):
    """One run of words with different surroundings, which recur in pairs of documents."""
    real, folder = phrases.automaton, str(tmp_path)

    def spy(passages, size=phrases.SIZE):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(sum(max(0, len(p) - size + 1) for p in passages)))
        return real(passages, size)

    def locate(batches, plain=phrases._locate):
        plain.__globals__["automaton"] = spy
        yield from plain(batches)

    monkeypatch.setattr(phrases, "_locate", locate)
    monkeypatch.setattr(phrases, "SHARD_DOCS", 5)
    line = prose(41, 19)  # every window over it has one of few anchors
    rows = []
    for i in range(60):
        own = f"{prose(i, 15)} {line} {prose(i + 700, 15)}"
        rows += [(2 * i, f"{own} {prose(i + 2000, 5)}"), (2 * i + 1, f"{own} {prose(i + 3000, 5)}")]
    got = phrases.dedup(documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == windows_removed(rows)
    compiled = [int(f.read_text()) for f in tmp_path.iterdir()]
    phrases_owned = 60 * 30
    assert compiled and sum(compiled) <= 1.2 * phrases_owned  # each automaton held all of its anchor's
    assert max(compiled) < phrases_owned / 4


def test_phrases_edges(spark):
    assert phrases.dedup(documents(spark, [])).count() == 0
    text = prose(5, 25)
    got = phrases.dedup(documents(spark, [(None, text), (1, text), (1, text), (2, text), (3, None)])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got) == [
        ("1", 25, 0), ("1", 25, 0), ("2", 25, 25), ("3", 0, 0), ("None", 25, 0)
    ]


def test_quality_edges(spark):
    got = {r.doc_id: r for r in quality.judge(documents(spark, awkward())).collect()}
    assert not got[1].kept and not got[2].kept and got[1].n_words == 0
    assert got[7].n_words == 300 and got[7].n_repeat_words == 300 and got[7].base_failed
    assert got[11].n_words == 30000 and got[13].word_distance is None
    assert quality.judge(documents(spark, [])).count() == 0
    kept = quality.passing(documents(spark, awkward()))
    assert kept.columns[:2] == ["doc_id", "text"] and kept.where("doc_id IS NULL").count() == 1


def test_quality_on_labels(spark, sf):
    verdicts = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"))
    seen = verdicts.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good = seen[seen.quality == 1]
    assert (good.kept | good.base_failed).mean() > 0.98
    assert seen[seen.quality == 0].kept.mean() < 0.3


def test_raking(spark):
    rows = [(i, prose(i, 5 + i % 7), ("en", "de", "fr")[i % 3], f"s{i * i % 5}") for i in range(300)]
    docs = documents(spark, rows)
    got = mixing.weights(docs, topic="id").toPandas()
    assert got.gap.max() < 1e-9 and got.probability.between(0, 1).all()
    for dim, power in mixing.TEMPER.items():
        base = got.groupby(dim).n_tokens.sum() ** power
        mass = (got.n_tokens * got.rate).groupby(got[dim]).sum()
        assert ((mass / mass.sum()) - (base / base.sum())).abs().max() < 1e-9
    assert mixing.weights(documents(spark, [])).count() == 0
    odd = mixing.weights(documents(spark, awkward())).collect()
    assert len(odd) == len(awkward())
    drawn = mixing.sample(docs, topic="id")
    assert drawn.columns == docs.columns
    assert {r.doc_id for r in drawn.collect()} == set(got[got.sampled].doc_id)


def test_many_cells_are_joined(spark, monkeypatch):
    """Cells beyond the table that one task rakes: the same rates, also of values with U+0000."""
    rows = [(i, prose(i, 5 + i % 7), ("en", "c", "b\0c")[i % 3], ("a\0b", "a", "d")[i * i % 7 % 3]) for i in range(60)]
    docs = documents(spark, rows)
    few = mixing.weights(docs).toPandas().set_index("doc_id").sort_index()
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    many = mixing.weights(docs).toPandas().set_index("doc_id").sort_index()
    assert len(many) == len(rows) and (many.sampled == few.sampled).all()
    assert (many.rate - few.rate).abs().max() < 1e-9


def test_rare_cell_does_not_shrink_the_sample(spark):
    rows = [(i, prose(i, 40), "en", f"s{i % 2}") for i in range(2000)] + [(9999, prose(1, 2), "en", "rare")]
    got = mixing.weights(documents(spark, rows), topic="id").toPandas()
    due = got.n_tokens.sum() * mixing.KEEP
    assert (got.n_tokens * got.probability).sum() == pytest.approx(due)
    assert 0.6 < got.sampled.mean() < 0.8
    rare = got[got.doc_id == 9999].iloc[0]
    assert rare.probability == 1 and rare.sampled and rare.shortfall > 0.5
    assert got[got.doc_id != 9999].shortfall.max() == 0


def test_contradicting_targets_are_told(spark, monkeypatch):
    """Each source has one language: the separate targets cannot be met together."""
    monkeypatch.setattr(mixing, "SWEEPS", 4)  # enough to show it; forty take long
    rows = [(i, prose(i, 20), *(("en", "a"), ("en", "b"), ("en", "b"), ("de", "c"), ("de", "c"))[i % 5]) for i in range(100)]
    docs = documents(spark, rows)
    with pytest.warns(UserWarning, match="cannot be met together"):
        got = mixing.weights(docs, topic="id").toPandas()
    assert got.gap.max() > 1e-3
    rate = 1.0
    for dim, power in mixing.TEMPER.items():
        share = got.groupby(dim).n_tokens.transform("sum") / got.n_tokens.sum()
        rate = rate * share ** (power - 1)
    want = rate / (got.n_tokens * rate).sum() * got.n_tokens.sum()
    assert (got.rate - want).abs().max() < 1e-9
    goal = mixing.tempered(mixing.cells_of(mixing.measured(docs, "doc_id", "text", "id")), "source", 0.5)
    other = spark.createDataFrame([("en", 0.9), ("de", 0.1)], "lang string, target double")
    with pytest.raises(ValueError, match="cannot be met together"):
        mixing.weights(docs, topic="id", targets={"source": goal, "lang": other})


def test_pipeline_by_stages(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    from legnet.llm import pii

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect() if r.doc_id in good]
    groups = jaccard_components([r[:2] for r in rows], 5, 4, 5)
    rows = [(i, pii.redact(t), s, g) for i, t, s, g in rows if groups[i][1] == i]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    drawn = {r.doc_id for r in mixing.weights(frame).where("sampled").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t, _, _ in rows if i in drawn}
    got = corpus_pipeline.run(spark, sf)
    assert {r.doc_id: r.ids for r in got.collect()} == want
    assert len(corpus_pipeline.STAGES) == 5
    empty = docs.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf).columns == docs.columns
