"""Decontamination, whitening and alignment, held against brute force on small tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from offerlens.llm import alignment, decontaminate, whitening

WORDS = [f"w{i}" for i in range(60)]


# Decontamination -------------------------------------------------------------
def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def shingles_of(words, size):
    k = min(3, size)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def occurs(stretch, window, share):
    if share >= 1:
        return stretch == window
    own = shingles_of(window, len(window))
    return len(own & shingles_of(stretch, len(window))) >= math.ceil(share * len(own) - 1e-9)


def hits_by_hand(texts, items, share):
    out = []
    for text in texts:
        doc, hit, found = words_of(text), set(), set()
        for item, body in items:
            words = words_of(body)
            size = min(10, len(words))
            for a in range(len(words) - size + 1 if size and item is not None else 0):
                for s in range(len(doc) - size + 1):
                    if occurs(doc[s : s + size], words[a : a + size], share):
                        hit |= set(range(s, s + size))
                        found.add(str(item))
        out.append((len(doc), len(hit), sorted(found)))
    return out


def leaks(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 25])))) for i in range(4, 14)]
    items += [(20, None), (21, " .,! "), (None, "w1 w2 w3"), (4, items[0][1]), (30, "Größe, 日本語 x9 y z"), (31, "a b a b a b a b a b a b")]
    texts = [None, "", "?!", "w1", "B a b a b a b-a b A b a b a", "x größe 日本語 X9 y z.", items[5][1] or "", "a" * 50_000, "w2 " * 3_000]
    for _ in range(40):
        parts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(12))) for _ in range(2)]
        body = (rng.choice(items)[1] or "").split()
        cut = body[rng.randrange(len(body) + 1) :] if rng.random() < 0.4 else body
        if cut and rng.random() < 0.4:
            cut = [*cut]
            cut[rng.randrange(len(cut))] = "other"
        texts.append(f"{parts[0]}, {rng.choice([' ', '. ', chr(10)]).join(cut).upper()} - {parts[1]}")
    return texts + [texts[-1]], items


@pytest.mark.parametrize(("share", "sent"), [(1.0, decontaminate.SENT_BYTES), (1.0, 0), (0.7, decontaminate.SENT_BYTES), (0.7, 0)])
def test_items_found(spark, docs_of, share, sent):
    texts, items = leaks(3)
    # Columns of the documents have names that the operator uses itself, ids repeat.
    docs = docs_of(texts, [None, None, 7, 7, *range(10, 10 + len(texts) - 4)]).withColumnsRenamed({"lang": "row", "source": "n_words", "node": "found"})
    rows, hits = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id int, text string"), share=share, sent_bytes=sent)
    got = decontaminate.documents_hit(rows, hits).collect()
    want = hits_by_hand(texts, items, share)
    assert collections.Counter((r.n_words, r.n_hit, tuple(r["items"])) for r in got) == collections.Counter((n, h, tuple(i)) for n, h, i in want)
    by_id = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got if r.doc_id is not None and r.doc_id >= 10}
    assert by_id == {i: w for i, w in zip(range(10, 10 + len(texts) - 4), want[4:])}
    assert sum(h > 0 for _, h, _ in want) > 10


def test_items_found_in_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id int, text string")
    rows, hits = decontaminate.contamination(docs_of(["a b", None]), none)
    assert [(r.n_hit, r.n_items, r["items"]) for r in decontaminate.documents_hit(rows, hits).collect()] == [(0, 0, [])] * 2
    rows, hits = decontaminate.contamination(docs_of([]), spark.createDataFrame([(1, "a")], "item_id int, text string"))
    assert decontaminate.documents_hit(rows, hits).count() == 0


def test_one_item_word_in_every_document(spark, docs_of):
    texts = [f"the {i} the" for i in range(300)]
    rows, hits = decontaminate.contamination(docs_of(texts), spark.createDataFrame([(1, "The"), (2, "the!")], "item_id int, text string"), sent_bytes=0)
    assert {(r.n_hit, tuple(r["items"])) for r in decontaminate.documents_hit(rows, hits).collect()} == {(2, ("1", "2"))}


# Whitening -------------------------------------------------------------------
def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 1.5) for k, v in rows], "vec_id long, embedding array<float>, x double")


def check_whitened(got, rows, components=16):
    usable = {k: v for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    whole = {k: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) + 1_000_000 for k, v in usable.items()}
    fit = np.unique(np.array(list(whole.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1], columns[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == k * len(whole)
    table = {(r.vec_id, r.component): r for r in got}
    for i in range(k):
        own = np.array([table[v, i + 1].whitened for v in whole])
        want = (n * np.array(list(whole.values())) - sums) / n @ columns[:, i] / np.sqrt(values[i])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-9
        assert abs(table[next(iter(whole)), i + 1].explained / (values[i] / values.sum()) - 1) < 1e-9
    for key, x in whole.items():
        row = table[key, 1]
        assert row.n == n and row.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)) and row.identity_error < 1e-8


def test_whitened_rows(spark):
    draw = np.random.default_rng(5)
    base = draw.standard_normal((300, 40)) * np.linspace(1, 4, 40) + 30
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, list(rows[i][1])) for i in range(60)]
    bad = [(2000, None), (2001, [None] + rows[0][1][1:]), (2002, [math.nan] + rows[0][1][1:]), (2003, [math.inf] + rows[0][1][1:]), (2004, []), (2005, [1.0])]
    got = whitening.whitened(vectors(spark, rows + bad)).collect()
    check_whitened(got, rows)


def test_whitening_of_few_or_flat_vectors(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).count() == 0
    draw = np.random.default_rng(6)
    few = [(i, draw.standard_normal(50).astype(np.float32).tolist()) for i in range(6)]
    check_whitened(whitening.whitened(vectors(spark, few)).collect(), few)
    narrow = [(i, draw.standard_normal(3).astype(np.float32).tolist()) for i in range(200)]
    check_whitened(whitening.whitened(vectors(spark, narrow)).collect(), narrow)


def test_spectrum_without_gaps_is_certified(spark):
    draw = np.random.default_rng(7)
    rows = [(i, (3 * draw.standard_normal(96)).astype(np.float32).tolist()) for i in range(400)]
    whole = spark.createDataFrame([(96, whitening._narrow(np.floor(64 * np.array(v, float)).astype("<i8"))) for _, v in rows], "dims int, x binary")
    fit = whitening.principal_components(whole)
    assert fit.residual < 1e-14 and len(fit.values) == 16
    x = np.floor(64 * np.array([v for _, v in rows], float))
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:16]
    assert np.allclose(fit.values, want, rtol=1e-12)


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 39, 0], [0, 0]])
    sums = np.array([1 << 39, 0], object)
    assert whitening.deviations(x, 2, sums) == [None, None]
    assert whitening.deviations(np.array([[3, 4]]), 5, np.array([5, 10], object)) == [100 + 100]


# Alignment -------------------------------------------------------------------
@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spelled(rng, n=50):
    texts = ["", None, "a", "hello wörld <|endoftext|> x\n\n  y", "</s><s>", "▁bad", "日本語のテキスト 😀😀", " <0x41> \x00", "x" * 5_000, "ab " * 3_000]
    return texts + ["".join(rng.choice("ab éthe日 \n.,") for _ in range(rng.randrange(1, 120))) for _ in range(n)]


def tokens_by_hand(paths, text):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    letters = alignment.byte_alphabet()

    def of(text):
        if not text:
            return [], [], [], []
        x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        bytes_a = [bytes(letters[c] for c in t) for t in x.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, y)]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return [], [], [], []
        return x.ids, y, np.cumsum([len(t) for t in bytes_a]).tolist(), np.cumsum([len(t) for t in bytes_b]).tolist()

    return [of(t) for t in text]


def aligned_by_hand(a, b, ends_a, ends_b):
    links, j = [], 0
    for i, end in enumerate(ends_a):
        start = ends_a[i - 1] if i else 0
        for j in range(len(b)):
            if max(start, ends_b[j - 1] if j else 0) < min(end, ends_b[j]):
                links.append((i, j))
    both = sorted(set(ends_a) & set(ends_b))
    groups, pa, pb = [], 0, 0
    for e in both:
        x, y = ends_a.index(e) + 1, ends_b.index(e) + 1
        groups.append(",".join(map(str, a[pa:x])) + "|" + ",".join(map(str, b[pb:y])))
        pa, pb = x, y
    return links, groups


@pytest.mark.parametrize("sent", [alignment.PAIRS_SENT, 0])
def test_aligned_documents(docs_of, paths, sent):
    texts = spelled(random.Random(4))
    texts = texts[:8] + [t and t[:400] for t in texts[8:]] + [texts[3], texts[3]]
    ids = [None, 5, 5, *range(6, len(texts) + 3)]
    got = alignment.aligned_documents(docs_of(texts, ids).withColumnRenamed("lang", "pairs").withColumnRenamed("source", "row"), *paths, pairs_sent=sent).collect()
    hand = [(a, b, *aligned_by_hand(a, b, ea, eb)) for a, b, ea, eb in tokens_by_hand(paths, texts)]
    held = collections.Counter(p for a, b, links, _ in hand for p in {(a[i], b[j]) for i, j in links})
    top = collections.defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    want = collections.Counter()
    for k, (a, b, links, groups) in zip(ids, hand):
        pairs = [(a[i], b[j]) for i, j in links]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        want[k, len(a), len(b), len(groups), len(links), sum(held[p] == top[p[0]] for p in pairs), sum(held[p] for p in pairs), digest] += 1
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert collections.Counter(tuple(r[c] for c in columns) for r in got) == want
    assert set(got[0].asDict()) == set(columns)


@pytest.mark.parametrize("work", [1, 2, 5, 64, alignment.WORK])
def test_pieces_of_any_size_give_one_merge(paths, work):
    pair = alignment.vocabularies(*paths)
    for r in alignment.align_batch(pair, [t or "" for t in spelled(random.Random(work), 20) if len(t or "") < 1_000], work):
        ends_a, ends_b = np.cumsum(pair.sizes_a[r.a]).tolist(), np.cumsum(pair.sizes_b[r.b]).tolist()
        links, groups = aligned_by_hand(r.a.tolist(), r.b.tolist(), ends_a, ends_b)
        assert list(zip(r.merge.link_a.tolist(), r.merge.link_b.tolist())) == links
        assert pair.groups_text(r.a, r.b, r.merge.stop_a, r.merge.stop_b) == ";".join(groups)


def test_parts_between_spaces_encode_as_the_whole(paths):
    rng = random.Random(11)
    letters = list("ab é日\n\t.,'  \x1c\x85\u00a0\u200b\u3000\ufeff1") + ["the", " of", "  ", "'s", "<|endoftext|>", "▁"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(3_000)]
    texts += [" ".join(chr(rng.choice([rng.randrange(1, 0x3000), rng.randrange(0x3000, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(9)) for _ in range(1_000)]
    for got, (a, b, _, _) in zip(alignment.vocabularies(*paths).encode(texts), tokens_by_hand(paths, texts)):
        assert ([] if got is None else got[0].tolist(), [] if got is None else got[1].tolist()) == (a, b)


def test_diagonals_cut_equal_work():
    rng = np.random.default_rng(8)
    for _ in range(50):
        a, b = (np.unique(rng.integers(1, 500, rng.integers(1, 200))) for _ in range(2))
        a, b = np.append(a, 500), np.append(b, 500)
        i, j = alignment.diagonals(a, b, 16)
        assert (np.diff(i + j)[:-1] == 16).all() and i[-1] == len(a) and j[-1] == len(b)
        order = np.argsort(np.concatenate([a, b]), kind="stable")
        for cut, taken in zip((i + j).tolist(), i.tolist()):
            assert (order[:cut] < len(a)).sum() == taken


def test_aligned_tokens_of_each_document(docs_of, paths):
    texts = ["hello world", None, "▁", "hello world"]
    rows = {r.doc_id: r for r in alignment.align(docs_of(texts), *paths).collect()}
    assert rows[0].a_ids and rows[0].a_stops[-1] == len(rows[0].a_ids) and rows[0].b_stops[-1] == len(rows[0].b_ids)
    assert rows[1].a_ids == rows[2].b_ids == [] and rows[0][1:] == rows[3][1:]
    assert alignment.aligned_documents(docs_of([]), *paths).count() == 0
