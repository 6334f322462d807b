"""The per-text and per-vector parts, held against plain recomputation."""

import collections
import random
import re

import numpy as np
import pytest

from offerlens.llm import bpe, chaining, lattice, packing, quality, shingles, surrogates, tree_extract

HARD = ["", " ", "a", "\x00", "x" * 700, "ab" * 400 + " ccc", "ΣΑΣ İstanbul ẞ ŉ K Å", "é é ﬁ", "<|endoftext|>hi<|startoftext|> there", "a\x1cb\x1d \x85c　d",
        "it's DON'T 12ab３４ “q” </w> w</w>", "😀😀 a​b", "Thnd%%% iner*** $$$ |", "\n\n\t\r one\x0btwo\x0c"]


def test_ids_equal_the_library(tokenizer):
    from tokenizers import Tokenizer

    model, rng = Tokenizer.from_file(tokenizer), random.Random(3)
    made = ["".join(rng.choice("abz éÉ.,'9\n%Ω") for _ in range(rng.randrange(80))) for _ in range(200)]
    texts = HARD + made + made[:5]
    want = model.encode_batch(texts, add_special_tokens=False)
    own = bpe.encoder(tokenizer)
    for got in (own.encode_batch(texts), packing.word_ids(tokenizer).batch(texts)):
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in want]
    assert [own.decode(x) for x in own.encode_batch(texts)] == [model.decode(e.ids, skip_special_tokens=False) for e in want]


def test_windows_hold_every_id_once():
    rng = random.Random(5)
    for totals in ([], [1], [4096, 8192], [5000] * 3, [rng.choice([1, 7, 511, 512, 513, 4097, rng.randrange(1, 30_000)]) for _ in range(300)]):
        windows = packing.pack(totals)
        seen = collections.defaultdict(list)
        for length, pieces in windows:
            assert 0 < sum(p[2] for p in pieces) <= length <= 4096 and length & (length - 1) == 0
            for doc, start, size in pieces:
                seen[doc].append((start, start + size))
        for doc, total in enumerate(totals):
            at = 0
            for a, b in sorted(seen[doc]):
                assert a == at
                at = b
            assert at == total
        assert sum(n for n, _ in windows) - sum(totals) < 512
        dealt = collections.Counter()
        for (length, _), step in zip(windows, packing.steps(windows)):
            dealt[step] += length
        assert not windows or max(dealt.values()) - min(dealt.get(i, 0) for i in range(8)) <= 2 * 4096


def base_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_base_counts():
    rng = random.Random(7)
    texts = HARD + [" ".join(rng.choice(["a", "b", "c\n", "é#", "\n", "d|"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    for t in texts:
        assert quality.base_counts(t.encode()) == base_by_hand(t), repr(t)


def test_word_hashes_follow_words():
    rng = random.Random(9)
    seen = {}
    for _ in range(300):
        text = "".join(rng.choice("aAbé \n\x0b") for _ in range(rng.randrange(40)))
        words, hashes = shingles.words(text.encode()), shingles.word_hashes(text.encode()).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(shingles.shingle_set(b"one two")) == 1 and len(shingles.shingle_set(b" \n")) == 0
    assert len(shingles.shingle_set(b"a b c d e a b c d e")) == 5


def test_chains_against_all_predecessors():
    rng = random.Random(11)
    for _ in range(60):
        matches = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 25))})
        score = {}
        for x, y in matches:
            before = [score[p] - chaining.GAP * (x + y - sum(p)) for p in matches if p[0] < x and p[1] < y]
            score[x, y] = chaining.K + max([0.0, *before])
        best = chaining.chains(matches)[0]
        assert best[-1] in [m for m in matches if abs(score[m] - max(score.values())) < 1e-9]
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(best, best[1:]))
        assert sorted(m for c in chaining.chains(matches) for m in c) == matches


def test_alignment_finds_the_borders():
    core = [f"w{i}" for i in range(40)]
    edited = core[:15] + ["new"] + core[16:30] + core[31:]
    a, b = ["x"] * 5 + core + ["y"] * 5, ["p"] * 9 + edited + ["q"] * 3
    start, stop, other, other_stop, equal = chaining.align([w.encode() for w in a], [w.encode() for w in b], [(7, 11), (25, 29)])
    assert (start, stop, other, other_stop, equal) == (5, 45, 9, 48, 38)
    assert chaining.cut("one  two\nthree four", [(1, 3)]) == "one  four" and chaining.cut("a b", [(0, 2)]) == ""


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    roots = lattice.e8_roots()
    assert len({tuple(r) for r in roots}) == 240 and np.allclose((roots**2).sum(1), 2)
    x = rng.normal(size=(200, 8)) * 3
    p = lattice.nearest_point(x)
    whole = np.isclose(p, np.rint(p)).all(1) | np.isclose(p - 0.5, np.rint(p - 0.5)).all(1)
    assert whole.all() and np.allclose(p.sum(1) % 2, 0)
    own = ((x - p) ** 2).sum(1)
    for r in roots:
        assert (((x - p - r) ** 2).sum(1) >= own - 1e-9).all()


@pytest.mark.parametrize("kind,values", [
    ("ipv4", [f"{a}.{b}.1{c}.9" for a in range(4) for b in range(9) for c in range(10)]), ("ssn", [f"{i:09d}" for i in range(0, 1000)]),
    ("card", [f"4000{i:012d}" for i in range(500)]), ("email", [f"{c}{i}@ab{i % 3}.example.org" for c in "abc" for i in range(100)]),
    ("name", ["anna meier", "otto klein", "ана петрова", "иван петров", "νίκος", "li"]), ("phone", [f"+1202555{i:04d}" for i in range(300)]),
    ("secret", [f"{i:032x}" for i in range(200)]),
])
def test_surrogates_are_distinct_and_like_in_kind(kind, values):
    draw, other = surrogates.Surrogates(b"k"), surrogates.Surrogates(b"l")
    made = [draw.of(kind, v) for v in values]
    assert len(set(made)) == len(set(values)) and all(a != b for a, b in zip(made, values))
    assert made == [draw.of(kind, v) for v in values] != [other.of(kind, v) for v in values]
    for a, b in zip(values, made):
        assert len(a) == len(b) and [c.isdigit() for c in a] == [c.isdigit() for c in b] or kind in ("secret", "ipv4")
        if kind == "card":
            assert surrogates._luhn(a) == surrogates._luhn(b)
        if kind == "name":
            assert a[-1] == b[-1] and [ord(c) > 0x3FF for c in a] == [ord(c) > 0x3FF for c in b]


def test_entities_in_texts():
    draw = surrogates.Surrogates(b"k")
    text = 'Write Ana.9@mail4.example.com or ANA.9@MAIL4.EXAMPLE.COM, 10.20.30.40. Call +1 (415) 555-0100! token = "0123456789abcdef01" Mr. Hugo Brand, 4111-1111-1111-1111.'
    got, kinds = draw.replace(text)
    assert sorted(kinds) == ["card", "email", "email", "ipv4", "name", "phone", "secret"]
    one, two = re.findall(r"\S+@\S+", got)
    assert one.lower() == two.lower().rstrip(",") and two.isupper() and one != two
    for gone in ("Ana.9", "10.20.30.40", "555-0100", "0123456789abcdef01", "Hugo", "4111"):
        assert gone not in got
    for clean in ("", "Licensed under CC BY-NC 4.0.", "version 3. of 1999 and 12:30, § 5", "A mister came by; 1.2.3 and 1.2.3.4.5"):
        assert draw.replace(clean) == (clean, [])


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain & text", "plain & text"), ("<p>a<p>b", "a\nb"), ("<p>a&nbsp;b&lt;c&#233;", "a b<cé"),
    ("<nav><a href=/>x</a></nav><article><h1>T</h1><p><b>one,<br>two<p>three</article><footer>f</footer>", "T\none, two\nthree"),
    ("<header>Site</header><main><p>Text, long enough.</p></main><div class='cookie-notice'><p>Cookies, cookies, cookies</p></div>", "Text, long enough."),
    ("<div id=main><p>one, two, three</p></div><div class=comments><p>me, too, and, more, of, it</p></div><form><p>x</p></form>", "one, two, three"),
    ("<article><p>x</p><script>var a='</p>';</script><style>p{}</style><div class=ad>buy</div><aside>s</aside><p>y</p></article><p", "x\ny"),
    ("<article><ul><li>a<li>b</ul>" + "<div>" * 3000 + "deep", "a\nb\ndeep"),
])
def test_main_text(page, want):
    assert tree_extract.main_text(page) == want


@pytest.mark.parametrize("size,between", [(60, 40), (60, 60), (60, 150), (100, 100), (200, 90), (200, 150), (200, 300)])
def test_passages_around_own_words_are_found_apart(size, between):
    rng = random.Random(size + between)
    fresh = lambda n: [b"%x" % rng.randrange(10**12) for _ in range(n)]
    one, two = fresh(size), fresh(size)
    own = fresh(30) + one + fresh(between) + two + fresh(30)
    held = fresh(10) + one + fresh(between) + two + fresh(10)
    matches = [(30 + at, 10 + at) for start in (0, size + between) for at in range(start, start + size - chaining.K, 9)]
    got = sorted(p for c in chaining.chains(matches) for p in chaining.Alignment(own, held, c).parts())
    rest = 30 + size + between
    assert got == [(30, 30 + size, 10, 10 + size, size), (rest, rest + size, rest - 20, rest - 20 + size, size)]


@pytest.mark.parametrize("inserted,want", [(100, [(5, 65), (165, 225)]), (3, [(5, 128)])])
def test_words_put_into_a_passage(inserted, want):
    core = [b"w%d" % i for i in range(120)]
    own = [b"x"] * 5 + core[:60] + [b"new%d" % i for i in range(inserted)] + core[60:]
    chain = [(5 + at + (at >= 60) * inserted, at) for at in (0, 20, 40, 54, 60, 80, 110)]
    for a, b, links in ((own, core, chain), (core, own, [(y, x) for x, y in chain])):
        got = chaining.Alignment(a, b, links).parts()
        assert [p[:2] if a is own else p[2:4] for p in got] == want and sum(p[4] for p in got) == 120


def test_exact_words_beside_heavy_edits():
    rng = random.Random(2)
    core = [b"%x" % rng.randrange(10**12) for _ in range(260)]
    edited = [b"new%d" % i if i >= 60 and i % 4 == 0 else w for i, w in enumerate(core)]
    for a, b, chain in ((edited, core, [(0, 0), (50, 50)]), (edited[::-1], core[::-1], [(204, 204), (254, 254)])):
        (start, stop, *_, equal), *more = [p for p in chaining.Alignment(a, b, chain).parts() if p[1] - p[0] >= 50]
        assert not more and equal >= 60 and equal >= chaining.IDENTITY * (stop - start) and (start == 0 or stop == 260)


@pytest.mark.parametrize("kind,values", [
    ("name", ["j", "k", "a", "e", "j. smith", "j. r. smith", "k. smith", "ж", "张", "伟", "张伟", "ªa", "ªb"]),
    ("email", ["张@例子.公司", "李@例子.公司", "é@ñ.ö", "٣@١.com", "ｘ@例.例", "+@ⅷ.a"]),
])
def test_formats_of_few_values_get_surrogates(kind, values):
    draw = surrogates.Surrogates(b"k")
    made = [draw.of(kind, v) for v in values]
    assert len(set(made)) == len(values) and all(a != b for a, b in zip(made, values)) and made == [surrogates.Surrogates(b"k").of(kind, v) for v in values]


@pytest.mark.parametrize("text,found", [
    ("Mr. J. Smith came", ["J. Smith"]), ("Mrs. J. R. Smith.", ["J. R. Smith"]), ("Dr. A", ["A"]), ("Dr. John R. Smith, here", ["John R. Smith"]),
    ("Dr. 张伟 came", ["张伟"]), ("Mr. Smith went", ["Smith"]), ("Mr. Smith. The end", ["Smith"]), ("Miss universe", []),
])
def test_initials_belong_to_names(text, found):
    assert [text[s:e] for s, e, _ in surrogates.find(text)] == found
    got, _ = surrogates.Surrogates(b"k").replace(text)
    assert all(w not in re.findall(r"\w+", got) for f in found for w in re.findall(r"\w+", f))


def test_mentions_of_one_person_stay_together():
    text = "Mr John Smith came. Mr Smith's dog met Smith and SMITH; John Smith-led smiths. Dr. J. Smith, Ms O’Neil: O’Neil’s. Smithson"
    got, kinds = surrogates.Surrogates(b"k").replace(text)
    words = re.findall(r"[\w]+(?:’\w+)?", got)
    given, smith = words[1], words[2]
    assert (given, smith) != ("John", "Smith") and given[-1] == "n" and smith[-1] == "h"
    assert got.startswith(f"Mr {given} {smith} came. Mr {smith}'s dog met {smith} and {smith.upper()}; {given} {smith}-led smiths. Dr. ")
    neil = re.search(r"Ms ([\w’]+): ([\w’]+)’s\. Smithson$", got)
    assert neil and neil[1] == neil[2] != "O’Neil" and f" {smith}, Ms" in got and kinds == ["name"] * 8


_LONG, _SHORT, _LINKS = "Words, of, some, length, " * 12, "A short section, with, few commas. " * 5, "<div><a href=/a>one link</a> <a href=/b>another link of the site</a></div>"


@pytest.mark.parametrize("inside", [
    "<div id=content>{long}{short}{table}</div>", "<div><h1>T</h1>{long}</div><div>{short}</div>{table}", "<div>{long}</div><div><div>{short}</div>{table}</div>",
    "<main>{long}{short}{table}</main>", "<article>{long}{short}{table}</article>",
])
def test_sections_of_an_article_stay(inside):
    parts = {"long": "<section>" + f"<p>{_LONG}</p>" * 30 + "</section>", "short": f"<section><p>{_SHORT}</p></section>",
             "table": "<div><table><tr><td>cell one<td>cell two, and what it says of the matter at hand, in words</table></div>"}
    got = tree_extract.main_text(f"<body><nav><a href=/>Home</a></nav>{_LINKS}{inside.format(**parts)}<div class=comments><p>{_LONG}</p></div><footer>F</footer></body>").split("\n")
    assert got[got.index(_LONG.strip()) :] == [_LONG.strip()] * 30 + [_SHORT.strip(), "cell one", "cell two, and what it says of the matter at hand, in words"]
    assert set(got) - {_LONG.strip(), _SHORT.strip(), "T"} == {"cell one", "cell two, and what it says of the matter at hand, in words"}


def test_every_code_point_encodes_as_the_library(tokenizer):
    """Unassigned and new ones too; of the large blocks of ideographs some each."""
    from tokenizers import Tokenizer

    model, own, words = Tokenizer.from_file(tokenizer), bpe.encoder(tokenizer), packing.word_ids(tokenizer)
    large = ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0xE0000), (0xE1000, 0x110000))
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c % 997 == 0 or not any(a <= c < b for a, b in large))]
    for s in range(0, len(points), 100):
        part = [chr(c) for c in points[s : s + 100]]
        texts = [" ".join(f"ab{c}cd" for c in part), " ".join(f"{c}X" for c in part)]
        want = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
        for got in (own.encode_batch(texts), words.batch(texts)):
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == want, hex(points[s])


def test_common_words_of_runs_of_any_length(monkeypatch):
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                keep = row[j]
                row[j] = last + 1 if x == y else max(keep, row[j - 1])
                last = keep
        return row[-1]

    rng = random.Random(21)
    for bits in (1 << 27, 40, 3):  # the last ones halve runs again and again
        monkeypatch.setattr(chaining, "LCS_BITS", bits)
        for _ in range(150):
            a, b = ([rng.choice([b"x", b"y", b"z", b"w"][: rng.randrange(1, 5)]) for _ in range(rng.randrange(30))] for _ in range(2))
            pairs = chaining.common(a, b)
            assert len(pairs) == chaining.gap_equal(a, b) == plain(a, b)
            assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    core = [str(i).encode() for i in range(400)]
    for n in (99, 105, 400):  # a run shifted in its middle is found whole at every length
        shifted = core[: n // 2] + [b"new"] + core[n // 2 : n]
        assert chaining.gap_equal(shifted, core[:n]) == n == len(chaining.common(core[:n], shifted))


def test_extensions_say_when_they_are_cut_short():
    core = [str(i).encode() for i in range(200)]
    edited = [b"x" if i % 4 == 0 and i > 20 else w for i, w in enumerate(core)]
    near = chaining.Alignment(edited, core[:80], [(5, 5)])
    near.parts()
    assert near.cut_short(False, True) and not near.cut_short(False, False)
    whole = chaining.Alignment(edited[:60], core, [(5, 5)])  # the own text ends first
    whole.parts()
    assert not whole.cut_short(False, True)
