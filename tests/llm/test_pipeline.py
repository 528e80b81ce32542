"""The pipeline on a small corpus against plain Python."""

import random

import corpus_pipeline
import numpy as np
from corpus_made import prose
from tallyloom.llm import decontam, mixing, quality, simhash


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    clean = [prose(rng, 80) for _ in range(30)]
    item = prose(rng, 20)
    near = clean[0].split()
    near[40] = "other"
    texts = [*clean, clean[1], " ".join(near), "too short", prose(rng, 30) + " " + item + " " + prose(rng, 30), None]
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(rng, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        kept.append({r[0] for r in at.select("doc_id").collect()})
    assert kept[0] == set(range(34)) - {32} | {33}
    assert kept[1] == kept[0] - {30, 31} and kept[2] == kept[1] - {33}
    mixed = mixing.copies(at)
    plan = {r["doc_id"]: r for r in mixing.mix(at).collect()}
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, r in plan.items() if (n := r["taken"] // r["size"] + (2 * (r["taken"] % r["size"]) >= r["size"]))}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == sum(counts.values()) and sorted(r["start"] for r in out)[0] == 0


def test_parts_are_whole():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "decontamination", "mixing", "token_ids"]
    assert all(m.__doc__ for m in (decontam, mixing, quality, simhash))


def _edited(rng, words, share):
    """A copy with a share of its words replaced, each by a word of its own."""
    out = list(words)
    for k in rng.sample(range(len(out)), int(share * len(out))):
        out[k] = f"new{rng.randrange(10**9)}"
    return out


def _kept_by_brute_force(texts, width=5, least=0.8):
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= least * (len(a) + len(sets[j]) - both) and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {i for i in range(len(texts)) if top(i) == i}


def test_near_dedup_of_large_groups_of_edited_copies(spark):
    rng, texts = random.Random(12), []
    for _ in range(2):
        words = prose(rng, 120).split()
        texts.append(" ".join(words))
        texts += [" ".join(_edited(rng, words, rng.choice((0.01, 0.02, 0.025, 0.04)))) for _ in range(300)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.first_of_each(docs).collect()} == _kept_by_brute_force(texts)


def test_near_dedup_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(13)
    words = prose(rng, 120).split()
    texts = [" ".join(_edited(rng, words, rng.choice((0.01, 0.02, 0.03)))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.first_of_each(docs).collect()} == _kept_by_brute_force(texts)


def test_near_dedup_finds_isolated_pairs(spark):
    rng, texts = random.Random(14), []
    for _ in range(150):
        words = prose(rng, 300).split()
        texts += [" ".join(words), " ".join(_edited(rng, words, 0.02))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.first_of_each(docs).collect()} == _kept_by_brute_force(texts)


def test_near_dedup_writes_no_file_for_each_task_over_texts(spark, monkeypatch):
    rng, texts, files = random.Random(19), [], {}
    for _ in range(40):
        words = prose(rng, 100).split()
        texts += [" ".join(words), " ".join(_edited(rng, words, 0.02))]
    plain = simhash.materialize

    def counted(df, name, *rows):
        out = plain(df, name, *rows)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(24)
    assert {r["doc_id"] for r in simhash.first_of_each(docs).collect()} == _kept_by_brute_force(texts)
    assert files and max(files.values()) <= 4, files  # the session has 4 shuffle partitions


def test_near_dedup_goes_through_anchors_alone(spark, monkeypatch):
    rng = random.Random(15)
    words = prose(rng, 120).split()
    texts = [" ".join(words), *(" ".join(_edited(rng, words, 0.01)) for _ in range(4))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.first_of_each(docs).collect()] == [0]
    covering = simhash.anchors

    def nowhere(values, extra=1):
        """Each word is its own home and reaches no other's."""
        return covering(values, extra)[0] * 0 + np.arange(len(values)), np.zeros(0, np.int64), np.zeros(0, np.int64)

    monkeypatch.setattr(simhash, "anchors", nowhere)
    assert simhash.first_of_each(docs).count() == len(texts)


def test_candidates_reach_all_pairs_just_alike():
    rng, lost, far, pairs = np.random.default_rng(16), 0, 0, 0
    for common in (8, 16, 36, 80, 240):
        for _ in range(400):
            h = rng.integers(0, 2**63, common * 5 // 4, np.uint64) * np.uint64(2) + np.uint64(1)  # of these, 0.8 are in both sets
            cut = (len(h) - common) // 2
            a, b = simhash.fingerprints(h[: common + cut]), simhash.fingerprints(np.concatenate((h[:common], h[common + cut :])))
            assert simhash.alike(np.sort(h[: common + cut]), np.sort(np.concatenate((h[:common], h[common + cut :])))) >= 0.8
            reach = [[(p, k, int(home[0]), {int(x) for x in anchor}) for p in range(simhash.PRINTS) for k, home, _, anchor in simhash._reached(w[p : p + 1], simhash.EXTRA)] for w in (a, b)]
            lost += not any(x[2] in y[3] or y[2] in x[3] for x, y in zip(*reach, strict=True))
            far += np.bitwise_count(a[: simhash.SKETCH] ^ b[: simhash.SKETCH]).sum() > simhash.FAR
            pairs += 1
    assert (pairs, lost, far) == (2000, 0, 0)


def test_candidate_links_of_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 1)
    monkeypatch.setattr(simhash, "GATHER", 50)
    rng = np.random.default_rng(17)
    base = rng.integers(0, 2**63, (3, 100), np.uint64)
    sets = [np.concatenate((b[: 100 - k], rng.integers(0, 2**63, k, np.uint64))) for b in base for k in (0, 1, 2, 3, 4) * 12]
    rows = [(i, bytearray(simhash.fingerprints(s).tobytes())) for i, s in enumerate(sets)]
    found = simhash.candidate_links(spark.createDataFrame(rows, "id long, words binary"))
    got = {r["node"]: r["root"] for r in simhash.components(found).collect()}
    assert [got.get(i, i) for i in range(180)] == [i // 60 * 60 for i in range(180)]


def test_stars_keep_components():
    rng = np.random.default_rng(18)
    for n in (1, 5, 200):
        a, b = rng.integers(-n, n, (2, n))
        group = {x: {x} for x in (*a.tolist(), *b.tolist())}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            both = group[x] | group[y]
            group.update(dict.fromkeys(both, both))
        got = dict(zip(*(x.tolist() for x in simhash._stars(a, b)), strict=True))
        assert got == {x: min(g) for x, g in group.items() if x != min(g)}


def _clashing(spark, rows):
    """Documents with columns of names that operators use, or that differ by case only."""
    wide = [(d, t, lang, s, None if t is None else len(t), -1, "k", 2.5, True, "x", None, 7, 8, 9, 1, 2, 3) for d, t, lang, s in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, DOC_ID long, kept string, profile double, rule boolean, did string, row_hash string, c0 int, c1 int, `__n` int, `__t` int, h int, count int"
    return spark.createDataFrame(wide, names)


def test_every_stage_takes_odd_rows(spark, tmp_path):
    spark.conf.set("spark.sql.caseSensitive", "true")
    rng = random.Random(21)
    base = prose(rng, 90)
    near, item, long = _edited(rng, base.split(), 0.02), prose(rng, 12), prose(rng, 40_000)
    rows = [
        (1, base, "en", "a"), (2, base, None, "a"), (3, " ".join(near), "en", None), (8, prose(rng, 60), "en", "a"), (8, prose(rng, 70), "en", "b"), (8, " ".join(_edited(rng, base.split(), 0.02)), "en", "b"),
        (None, prose(rng, 50), "fr", "a"), (None, base, "fr", "a"), (9, None, None, None), (10, "", "en", "a"), (11, "\t\n", "en", "a"), (12, long, "de", "c"), (13, prose(rng, 30) + " " + item + " " + prose(rng, 30), "en", "a"),
        (14, prose(rng, 40), "en", "a"), (14, prose(rng, 41), "en", "a"), (15, "seven words are too few to stay", "en", "a"),
    ]
    rows += [(16, rows[3][1] + " " + prose(rng, 60), "en", "a")] * 3
    docs = _clashing(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    of = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    try:
        # Each stage on all the rows, whatever its predecessors would have left.
        kept = stages["quality_rules"](spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and of(kept) == sorted(((d, t) for d, t, *_ in rows if len((t or "").split()) >= 20), key=str)
        kept = stages["simhash_near_dedup"](spark, docs, str(tmp_path))
        gone = [(2, base), (3, rows[2][1]), (8, rows[5][1]), (None, base), (10, ""), (11, "\t\n"), (16, rows[-1][1]), (16, rows[-1][1])]
        want = sorted(((d, t) for d, t, *_ in rows), key=str)
        for x in gone:
            want.remove(x)
        assert kept.columns == docs.columns and of(kept) == want
        kept = stages["decontamination"](spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and of(kept) == sorted(((d, t) for d, t, *_ in rows if d != 13), key=str)
        mixed = stages["mixing"](spark, docs, str(tmp_path))
        assert mixed.columns == docs.columns and {x for x in of(mixed)} <= {(d, t) for d, t, *_ in rows if (t or "").split()}
        ids = stages["token_ids"](spark, docs, str(tmp_path)).collect()
        assert len(ids) == len(rows) and sum(r["n_tokens"] == 1 for r in ids) == 3
        assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_odd_names_without_case(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(random.Random(i), 40), "en", "a", 1, "k") for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clash = docs.toDF("doc_id", "text", "lang", "source", "DOC_ID", "Text")
    for name, stage in corpus_pipeline.STAGES[:4]:
        for table in (clash, clash.limit(0)):
            out = stage(spark, table, str(tmp_path))
            assert out.columns == clash.columns and (out.count() > 0) == (table is clash), name
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
