"""Operators over small tables with nulls, empty and repeated rows, against brute force."""

import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerlens.llm import bpe, chaining, jaccard, lattice, packing, quality, sharding, shingles, site_bayes, surrogates, tree_extract

WORDS = [f"w{i}" for i in range(400)]


def rooted(pairs, keys):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def corpus(seed, n=120):
    """Fresh texts, copies, edits of one another, shared lines, nulls and blanks."""
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(rng.randrange(1, 90))] for _ in range(n // 4)]
    line = [rng.choice(WORDS) for _ in range(12)]
    texts = [None, "", " \n ", "a", "A", "a b c d", "A  b\nc d"]
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(line + words if rng.random() < 0.3 else words))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(docs_of, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs_of(texts)).collect()}
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = rooted(links, sets)
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}
    kept = jaccard.keep_first(docs_of(texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, s in sets.items() if root[i] == i) and all(r.text == texts[r.doc_id] and r.node == r.doc_id for r in kept)


def test_empty_tables_and_repeated_rows(docs_of, spark, tokenizer):
    none = docs_of([]).limit(0)
    assert jaccard.near_duplicates(none).count() == chaining.repeated_passages(none).count() == surrogates.pseudonymize(none).count() == 0
    assert packing.pack_documents(none, tokenizer).count() == bpe.digests(none, tokenizer).count() == 0
    assert sharding.shard_documents(none, sharding.even_tree(24)).count() == 0
    same = docs_of(["one two three four five six"] * 3, ids=[5, 5, None])
    assert sorted((r.doc_id, r.component_id) for r in jaccard.near_duplicates(same).collect() if r.doc_id) == [(5, 5), (5, 5)]
    assert chaining.repeated_passages(docs_of([" ".join(WORDS[:80])] * 2, ids=[5, 5])).count() == 0


def test_repeated_passages(docs_of):
    rng = random.Random(4)
    fresh = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n)]
    passage, short = fresh(70), fresh(30)
    fuzzy = list(passage)
    fuzzy[20], fuzzy[45] = "changed", "too"
    texts = [" ".join(x) for x in (fresh(60) + passage + fresh(9), fresh(200), fresh(30) + fuzzy, short + fresh(90), fresh(80) + short, passage)] + [None, "", "a b"]
    got = {r.doc_id: r for r in chaining.repeated_passages(docs_of(texts)).collect()}
    assert set(got) == {2, 5} and all(r.first_doc_id == 0 for r in got.values())
    assert (got[2].start_word, got[2].end_word, got[2].first_start_word, got[2].equal_words) == (30, 100, 60, 68)
    assert (got[5].start_word, got[5].end_word) == (0, 70)
    left = {r.doc_id: r for r in chaining.drop_repeated(docs_of(texts)).collect()}
    assert 5 not in left and len(left[2].text.split()) == 30 and left[2].n_chars == len(left[2].text)
    assert all(left[i].text == texts[i] for i in (0, 1, 3, 4, 8)) and left[6].text is None


def test_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 64))
    rows = [(i, (centres[i % 6] + rng.normal(size=64) * [0.02, 0.08, 0.4][i % 3]).astype(np.float32).tolist(), i % 2) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, [2 * x for x in rows[0][1]], 0), (203, None, 0), (204, [0.0] * 64, 0), (205, rows[0][1], None),
             (206, [float("nan")] * 64, 0), (207, [1.0, None], 0), (208, [1.0, 2.0], 0), (209, [1.0, 2.0], 0), (210, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for chunk in (1024, 4):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicate_vectors(df, chunk=chunk).collect()}
        links = []
        for (a, x, s), (b, y, t) in itertools.combinations(rows, 2):
            if s == t and s is not None and x and y and len(x) == len(y) and None not in x and np.isfinite(x).all() and np.isfinite(y).all() and any(x) and any(y):
                x, y = np.array(x, np.float64), np.array(y, np.float64)
                if x @ y >= 0.98 * np.sqrt((x @ x) * (y @ y)):
                    links.append((a, b))
        root = rooted(links, [r[0] for r in rows])
        want = {k: (sum(k in p for p in links), root[k], root[k] == k) for k in root}
        assert got == want and len(links) > 50


def test_shards(docs_of):
    texts = ["t" * (i % 9) for i in range(4000)] + [None]
    out = sharding.shard_documents(docs_of(texts), sharding.even_tree(24)).collect()
    by = {}
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert r.bytes == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.grown_shard in (r.shard, 24)
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(100 < len(s) < 250 for s in by.values()) and 80 < sum(r.grown_shard == 24 for r in out) < 260
    heavy = sharding.Tree.of({**dict(sharding.even_tree(24).leaves), (1, 5, 11): 3.0})
    moved = [(a.shard, b.shard) for a, b in zip(*[sorted(sharding.place(docs_of(texts), t, "doc_id").collect(), key=lambda r: r.doc_id) for t in (sharding.even_tree(24), heavy)]) if a.shard != b.shard]
    assert moved and all(8 <= b <= 15 for _, b in moved) and all(b == 11 for a, b in moved if a in (10, 11))


def test_digests_and_packing(docs_of, tokenizer):
    from tokenizers import Tokenizer

    texts = ["", None, "one two", "x" * 5000, "Émile's 12 <|endoftext|> z", "the end " * 4000, "one two"]
    model = Tokenizer.from_file(tokenizer)
    ids = [model.encode(t or "", add_special_tokens=False).ids for t in texts]
    raw = [np.array(x, "<u4").tobytes() for x in ids]
    for r in bpe.digests(docs_of(texts), tokenizer).collect():
        shown = model.decode(ids[r.doc_id], skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), hashlib.sha256(raw[r.doc_id]).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())
    pieces = packing.pack_documents(docs_of(texts), tokenizer).collect()
    for i in range(len(texts)):
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == raw[i] + (2).to_bytes(4, "little") and {p.doc_tokens for p in own} == {len(ids[i]) + 1}
        assert all(p.ids_crc32 == zlib.crc32(p.ids) and p.length == len(p.ids) // 4 for p in own)
    for s in {p.sequence_id for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= p.window <= 4096


def test_classifier_and_site_rates(docs_of, spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) + ("%%%" if i % 3 == 0 else "") for _ in range(60 + i % 30)) for i in range(300)] + [None, ""]
    docs = docs_of(texts)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 200)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, sample=150)
    rated = {r.doc_id: r for r in quality.rate(docs, model).collect()}
    right = sum(rated[i].kept == (i % 3 != 0) for i in range(200, 300))  # rows the model didn't see
    assert right >= 98 and not rated[300].kept and not rated[301].kept
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == {i for i, r in rated.items() if r.kept}
    assert quality.fit(docs, labels.limit(0)).logit(b"x") == 30.0
    scores = site_bayes.evidence(docs, model, ["doc_id", "source", "lang"])
    out = site_bayes.posterior(scores, "source", "lang").collect()
    assert len(out) == 302 and not any(r.kept for r in out if r.doc_id >= 300)
    by = {r.source: r for r in out}
    assert by["src0"].path_rate < 0.2 < 0.8 < by["src1"].path_rate and all(min(0.0, r.global_rate) <= r.path_rate <= 1 for r in out)
    assert site_bayes.posterior(scores.limit(0), "source", "lang").count() == 0


def test_pseudonyms_over_a_table(docs_of):
    texts = ["to a.b@mail.example.com and 9.8.7.6", None, "", "a.b@mail.example.com again", "clean"]
    out = {r.doc_id: r for r in surrogates.pseudonymize(docs_of(texts), counts=True).collect()}
    assert [out[i].n_entities for i in range(5)] == [2, 0, 0, 1, 0] and out[1].text is None and out[4].text == "clean"
    assert out[0].text.split()[1] == out[3].text.split()[0] != "a.b@mail.example.com"
    found = surrogates.entities(docs_of(texts))
    assert found.count() == 2 and surrogates.collisions(found).count() == 0
    clash = found.unionByName(found.withColumn("value", F.concat("value", F.lit("x"))))
    assert surrogates.collisions(clash).count() == 2


def test_pages(spark):
    rows = [(1, "u", "<article><p>a</p></article>"), (2, None, None), (3, "u", ""), (3, "u", "")]
    out = tree_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in out) == [(1, "a", 1), (2, "", 0), (3, "", 0), (3, "", 0)]


def test_pipeline_runs_its_stages(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names and docs.count() == docs.select("doc_id").distinct().count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "substring_dedup", "pii", "packing"]
    assert docs.count() == corpus_pipeline.run(spark, folder).count()


def test_pipeline_sends_small_batches(spark, monkeypatch):
    import corpus_pipeline
    from offerlens.llm.arrow import BATCH_BYTES

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    monkeypatch.setattr(surrogates, "pseudonymize", lambda docs: docs.mapInArrow(sizes, "rows long, size long"))
    before = spark.conf.get(setting, None)
    try:
        spark.conf.unset(setting)
        got = dict(corpus_pipeline.STAGES)["pii"](spark, rows, "").collect()
        assert sum(r.rows for r in got) == 3000 and max(r.size for r in got) < 2 * BATCH_BYTES  # 30 MB in one batch before
        spark.conf.set(setting, "1m")  # a limit of the caller's own stays
        got = dict(corpus_pipeline.STAGES)["pii"](spark, rows, "").collect()
        assert sum(r.rows for r in got) == 3000 and max(r.size for r in got) < 2 << 20
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def test_words_kept_for_packing_are_bounded(tokenizer):
    from tokenizers import Tokenizer

    model = packing.WordIds(tokenizer)
    fresh = map("".join, itertools.product("bcdfghjklm", "aeiou", "npqrstvwxz", "aeiou", "bcdfghjklm", "aeiouy", "st"))
    texts = [" ".join(["the end", *itertools.islice(fresh, 25_000)]) for _ in range(12)]
    ids = model.batch(texts)
    assert len(model._known) <= 200_000  # all words of all texts before
    library = Tokenizer.from_file(tokenizer)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids[::5]] == [library.encode(t, add_special_tokens=False).ids for t in texts[::5]]
    assert model.batch(texts[:1]) == ids[:1]


def test_passages_that_share_a_lone_seed(docs_of):
    rng = random.Random(12)
    fresh = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n)]
    texts, want = [], set()
    for i in range(20):  # runs of 24 words hold a seed, those of 5 between edits none
        passage = fresh(60)
        edited = [f"new{k}" if k < 36 and k % 6 == 5 else w for k, w in enumerate(passage)]
        texts += [" ".join(fresh(70) + passage + fresh(70)), " ".join(fresh(70) + edited + fresh(70))]
        want.add((2 * i + 1, 70, 130, 2 * i, 54))
    got = {(r.doc_id, r.start_word, r.end_word, r.first_doc_id, r.equal_words) for r in chaining.repeated_passages(docs_of(texts)).collect()}
    assert got == want


def test_one_short_name_leaves_the_table(docs_of):
    texts = ["Mr. J. Smith", "Dr. A", "Dr. J", "to 张@例子.公司", "clean"]
    out = {r.doc_id: r.text for r in surrogates.pseudonymize(docs_of(texts)).collect()}
    assert len(out) == 5 and out[4] == "clean" and all(out[i] != texts[i] for i in range(4)) and "Smith" not in out[0] and "张" not in out[3]


def test_rows_without_shingles_all_stay(docs_of):
    texts = [None, None, "", "", " \n\t ", " \n\t ", None, None, "a b", "a b", " ", " "]
    kept = jaccard.keep_first(docs_of(texts, ids=[1, 1, 2, 2, 3, 3, None, None, 4, 4, 5, 5])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.text and r.text.strip(" \n\t")) == [(4, "a b"), (5, " ")]
    assert sorted(r.node for r in kept)[:8] == list(range(8)) and len(kept) == 10


def test_edited_passages_far_beyond_their_seeds(docs_of):
    """Forty equal words hold all seeds; hundreds of edited ones go on from there, on one
    side or both, and are found whole, once."""
    rng = random.Random(31)
    fresh = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n)]
    texts, want = [], {}
    for at, (size, low) in enumerate(((300, 0), (300, 260), (700, 330), (1500, 0))):
        passage = fresh(size)
        edited = [f"new{at}x{k}" if not low <= k < low + 40 and (k - low) % 7 == 6 else w for k, w in enumerate(passage)]
        texts += [" ".join(fresh(90) + passage + fresh(1200)), " ".join(fresh(30) + edited + fresh(30))]
        want[2 * at + 1] = size
    rows = chaining.repeated_passages(docs_of(texts)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(want)
    for r in rows:
        first = 30
        assert r.first_doc_id == r.doc_id - 1
        assert first <= r.start_word <= first + 6 and first + want[r.doc_id] - 7 <= r.end_word <= first + want[r.doc_id]


def test_words_that_came_back_are_encoded_once(tokenizer):
    from tokenizers import Tokenizer

    class Counting(packing.WordIds):
        seen: list[str] = []

        def _encode(self, batch, *model):
            self.seen += [w for text in batch for w in text.split()]
            return super()._encode(batch, *model)

    model = Counting(tokenizer)
    model.most = 8
    library = Tokenizer.from_file(tokenizer)
    for text in ["alpha beta", "gamma, alpha", "delta epsilon zeta eta theta", "iota kappa", "alpha beta", "über-alpha ʼnever 𱍐x"]:
        assert np.frombuffer(model.batch([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert model.seen.count("alpha") == 1 and model.seen.count("beta") == 2  # what didn't come back is dropped first


def test_seeds_are_made_once_and_are_the_leftmost_least(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    for size in (0, 5, 6, 7, 20, 21, 22, 23, 300):
        text = " ".join(f"w{i}" for i in rng.integers(0, 4, size)).encode()
        hashes = shingles.rolling(shingles.word_hashes(text), chaining.K) if size >= chaining.K else []
        for window in (1, 3, 16, 21):
            starts = range(max(1, len(hashes) - window + 1)) if len(hashes) else ()
            want = sorted({s + int(np.argmin(hashes[s : s + window])) for s in starts})
            got, at = chaining.seeds(text, window=window)
            assert at.tolist() == want and got.tolist() == [hashes[i] for i in want]

    long = " ".join(f"w{i}" for i in range(80))
    marks = tmp_path / "marks"
    marks.mkdir()

    def marked(text, k=chaining.K, window=chaining.WINDOW, found=chaining.seeds):
        (marks / os.urandom(8).hex()).touch()
        return found(text, k, window)

    monkeypatch.setattr(chaining, "seeds", marked)
    try:
        frame = spark.createDataFrame([(1, long), (2, "x " + long), (3, "of its own")], "doc_id long, text string").coalesce(1)
        rows = chaining.repeated_passages(frame).collect()
    finally:
        monkeypatch.undo()
    assert [(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in rows] == [(2, 1, 81, 1)]
    assert len(list(marks.iterdir())) == 3  # twice as many before
