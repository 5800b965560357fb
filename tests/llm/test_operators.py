"""The training-data operators against brute force, public libraries and hand-made cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from weftgraph.llm import bpe, components, decontaminate, exact_dedup, html_extract, jaccard_join, line_dedup, quality, token_counts, toxicity, warc  # noqa: E402
from weftgraph.llm.common import Scratch  # noqa: E402
from weftgraph.llm.wordhash import shingle_set, words_of  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long, rep string, keys string, cell string"
ODD = ["", None, " ", "\n", "a", "A", "a<|endoftext|>b", "  x   y\n\n z\t", "I'll don't 're", "İSTANBUL ΣΑΣ ὈΔΟΣ", "\x1c\x1d a\x85b c  ", "日本語 😀👍🏽 é", "a" * 3000, " " * 500 + "x", "½²Ⅷ١٢", "<|startoftext|> Hi", " \n "]


def docs_of(spark, texts, first=0):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i + first, t, "en", "s", len(t or ""), "r", "k", "c") for i, t in enumerate(texts)], DOC)


def prose(n, rng, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def sample(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_token_counts(spark, sample):
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = sample.select("doc_id", "text").union(docs_of(spark, ODD, 10_000).select("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect():
        n = len(lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 1024)


def test_prefix_counts():
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    c = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    for t in filter(None, [*ODD, "We'll see   what 3 prefixes\n\n give, don't we?"]):
        t = t[:60]
        p = c.prefixes(t)
        assert [p.count(k) for k in range(len(t) + 1)] == [len(lib.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        counts = [p.count(k) for k in range(len(t) + 1)]
        for b in (0, 1, 2, 5, 1000):
            cut = p.truncate(b)
            # No longer prefix within the budget, but for those that end inside white space.
            assert counts[cut] <= b and all(counts[k] > b or t[k - 1].isspace() or t[cut : k - 1].isspace() for k in range(cut + 1, len(t) + 1)), (t, b)


def test_bpe(spark, sample):
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = sample.select("doc_id", "text").union(docs_of(spark, ODD, 10_000).select("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in bpe.bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json")).collect():
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_every_code_point():
    """All code points, each between letters and next to a digit, in lines of many."""
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    c = bpe.coder(public_tokenizers.path("word_bpe_49k.json"))
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for k in range(0, len(every), 256):
        line = " ".join(f"a{x}b 1{x}{x}" for x in every[k : k + 256])
        if c.encode(line) != lib.encode(line, add_special_tokens=False).ids:
            for x in every[k : k + 256]:
                assert c.encode(f"a{x}b 1{x}{x}") == lib.encode(f"a{x}b 1{x}{x}", add_special_tokens=False).ids, hex(ord(x))


def lower_ascii(t):
    return (t or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def test_exact_dedup(spark):
    rng = random.Random(1)
    long = prose(6000, rng)
    texts = [*ODD, long, long.upper(), long + "x", "Straße É", "STRASSE É", "straße é", "STRAßE É", *["copy"] * 30]
    rows = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs_of(spark, texts)).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lower_ascii(t), []).append(i)
    assert len(rows) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            assert (rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert rows[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_recipes_join_to_the_text(spark):
    text = prose(5000, random.Random(2)).replace("1", "a b") + "\n" + "é" * 40000
    df = spark.createDataFrame([(text,)], "t string")
    parts = df.select(exact_dedup.chunks(F.col("t")).alias("c")).first()["c"]
    assert "".join(parts) == text and len(parts) > 10 and max(map(len, parts)) <= exact_dedup.MOST


def components_by_brute_force(rows):
    """(n_shingles, component) of each row of (id, text): all pairs of sets are compared."""
    sets = [(i, set(shingle_set(t).tolist())) for i, t in rows]
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (_, x) in enumerate(sets):
        for m in range(k):
            y = sets[m][1]
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = find(k), find(m)
                up[max(p, q)] = min(p, q)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)]


def edited(base, rng, changes):
    v = base.split()
    for _ in range(changes):
        v[rng.randrange(len(v))] = f"n{rng.randrange(9)}"
    return " ".join(v)


def test_jaccard_brute_force(spark, sample):
    rng = random.Random(3)
    base = [prose(n, rng) for n in (3, 5, 6, 40, 200)]
    texts = [*ODD, "one two", "ONE  two", *base, *(edited(t, rng, k) for t in base for k in (1, 2, 3, 6, 12))]
    docs = sample.select("doc_id", "text").union(docs_of(spark, texts, 10_000).select("doc_id", "text"))
    want = components_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()]
    assert sorted(got) == sorted(want)


def test_jaccard_large_families(spark, monkeypatch):
    """Blocks, levels and block pairs: many near copies of several distances, and small blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(4)
    base = " ".join(f"w{i}" for i in range(120))
    texts = [edited(base, rng, k) for k in (1, 2, 3, 4, 5, 8) for _ in range(15)]
    texts += [prose(100, rng) for _ in range(5)] + [base[: len(base) * 9 // 10], base[: len(base) * 7 // 10]]
    docs = docs_of(spark, texts)
    want = components_by_brute_force(list(enumerate(texts)))
    assert 2 < len({c for _, _, c in want}) < len(texts) - 20
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()]
    assert sorted(got) == sorted(want)
    left = jaccard_join.one_of_each_group(docs)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for _, _, c in want}) and left.columns == docs.columns


def test_jaccard_repeated_and_null_ids(spark):
    rng = random.Random(14)
    a, b = prose(40, rng, 10**6), prose(40, rng, 10**6)
    rows = [(3, a), (5, a + " x"), (5, b), (5, b), (7, b), (None, a), (None, "nowhere else at all in here"), (None, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == Counter([(3, 36, 3), (5, 37, 3), (5, 36, 5), (5, 36, 5), (7, 36, 5), (None, 36, 3), (None, 2, None), (None, 0, None), (9, 0, 9)])
    assert Counter(r["doc_id"] for r in jaccard_join.one_of_each_group(docs).collect()) == Counter([3, 5, 5, 5, None, None, None, 9])


@pytest.mark.parametrize("bitmap_bytes", [64 << 20, 64])
def test_trees_prune_and_lose_nothing(monkeypatch, bitmap_bytes):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", bitmap_bytes)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 5, 30, 31, 63, 64, 200, 210)]
    for share in (0.97, 0.9, 0.8, 0.7):
        sets += [np.unique(np.concatenate([rng.permutation(s)[: int(np.ceil(len(s) * share))], rng.integers(0, 1 << 63, 1, dtype=np.uint64)])) for s in sets[:8]]
    n = len(sets)
    want = {(i, j) for i in range(n) for j in range(n) if i != j and jaccard_join.linked(sets[i], sets[j])}

    def joined(pairs):
        union = jaccard_join.Union(n)
        for i, j in pairs:
            union.join(i, j)
        return union

    found = jaccard_join.set_links(sets)
    assert set(found) <= want and (joined(found).names() == joined(want).names()).all()
    across = jaccard_join.set_links(sets, cut=20)
    assert {i < 20 <= j for i, j in across} == {True}
    assert (joined(across).names() == joined((i, j) for i, j in want if i < 20 <= j).names()).all()
    size = np.array([len(s) for s in sets])
    may = joined(jaccard_join.bitmap_links(size, [jaccard_join.bitmap(s, jaccard_join.width(len(s))).tobytes() for s in sets]))
    assert all(may.find(i) == may.find(j) for i, j in want) and len(set(may.names().tolist())) > 3


def test_components_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", 3)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 40), (41, 40), (50, 50)], "u long, v long")
    with Scratch(spark) as scratch:
        got = {r["id"]: r["component"] for r in components.components(edges, scratch).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in (30, 40, 41)} == {30}


def test_word_hashes_are_those_of_words(monkeypatch):
    from weftgraph.llm import wordhash

    monkeypatch.setattr(wordhash, "GROUP", 50)
    texts = [t for t in ODD] + [prose(100, random.Random(6)), "one\x0btwo\x0cthree A B"]
    seen = {}
    for t, w in zip(texts, words_of(texts), strict=True):
        found = (t or "").encode().lower().split()
        assert len(found) == len(w)
        for word, h in zip(found, w.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def runs_by_brute_force(rows):
    """Word ranges to delete of (doc_id, key, text) rows, from the definition: every fingerprint meets its first occurrence, word by word."""
    rows = sorted({r for r in rows if r[0] is not None and r[2] is not None})
    words = [r[2].encode("utf-8", "replace").lower().split() for r in rows]
    first, ranges = {}, {}
    for d, w in enumerate(words):
        order = line_dedup.line_hashes(next(words_of([rows[d][2]]))).tolist()
        n = len(w) - line_dedup.LINE + 1
        assert len(order) == max(0, n)
        windows = [order[k : k + line_dedup.WINDOW] for k in range(n - line_dedup.WINDOW + 1)]
        picked = sorted({k + j for k, x in enumerate(windows) for j, v in enumerate(x) if v == min(x)})
        for a in picked:
            f, at = first.setdefault(tuple(w[a : a + line_dedup.LINE]), (d, a))
            if (f, at) != (d, a):
                l, r, v = 0, 0, words[f]
                while l < min(line_dedup.BEFORE, a, at) and w[a - l - 1] == v[at - l - 1]:
                    l += 1
                while r < min(line_dedup.AFTER, len(w) - a, len(v) - at) and w[a + r] == v[at + r]:
                    r += 1
                ranges.setdefault(d, []).append((a - l, a + r))
    out = {}
    for d, found in ranges.items():
        covered = {k for lo, hi in found for k in range(lo, hi)}
        # Ranges that touch are one; words between ranges that do not touch are not covered.
        starts = [k for k in sorted(covered) if k - 1 not in covered]
        runs = [(k, next(e for e in range(k, len(words[d]) + 1) if e not in covered)) for k in starts]
        out[rows[d][:2]] = [r for r in runs if r[1] - r[0] >= line_dedup.LEAST_WORDS]
    return {k: v for k, v in out.items() if v}


def passages(rng):
    """Texts with planted passages of 51 to 90 words, of rich and of poor vocabulary, and with repeats of a few words over and over."""
    own = lambda n: " ".join(f"own{rng.randrange(10**9)}" for _ in range(n))
    planted = [prose(rng.randrange(51, 90), rng, size) for size in (10**6, 10**6, 300, 300, 30, 4)]
    texts = [own(60) + " " + " ".join(rng.sample(planted, 2)) + "\n" + own(40) + "\t" + rng.choice(planted).upper() for _ in range(40)]
    texts += [planted[0], "x " * 300, "a b c " * 200, own(44) + "\n" + own(10), None, "", " ", *["exact copy " + planted[1] + " of all"] * 3]
    return texts, planted


def report_of(spark, docs):
    keyed = docs.select("doc_id", line_dedup.text_key().alias("key"), "text").collect()
    runs = {(r["doc_id"], r["key"]): list(zip(r["lo"], r["hi"], strict=True)) for r in line_dedup.repeated_runs(docs).collect()}
    return runs, runs_by_brute_force([tuple(r) for r in keyed])


def test_line_dedup_is_as_defined(spark, sample):
    texts, planted = passages(random.Random(7))
    texts += [t[: len(t) * 2 // 3] + " changed " + t[len(t) * 2 // 3 :] for t in planted]
    docs = docs_of(spark, texts).select("doc_id", "text").union(sample.select(F.col("doc_id") + 1000, "text").limit(150))
    got, want = report_of(spark, docs)
    assert got == want and len(got) > 40


def test_line_dedup(spark):
    texts, planted = passages(random.Random(8))
    docs = docs_of(spark, texts)
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()}
    assert line_dedup.line_dedup(docs).columns == docs.columns and len(out) == len(texts)
    left = " ".join((out[i] or "").lower() for i in sorted(out))
    # Every passage of rich vocabulary is there once, to the word; what is not repeated stays.
    for p in planted[:4]:
        assert " ".join(left.split()).count(" ".join(p.split()[:20])) == 1 and " ".join(left.split()).count(" ".join(p.split()[-20:])) == 1
    for i, t in enumerate(texts[:40]):
        assert [w for w in out[i].split() if w.startswith("own")] == [w for w in t.split() if w.startswith("own")]
    assert out[44] is None and out[45] == "" and out[46] == " " and out[0] == texts[0]
    report = {r["doc_id"]: r for r in line_dedup.line_dedup_report(docs).collect()}
    assert all(report[i]["n_words_deleted"] == len((texts[i] or "").split()) - len((out[i] or "").split()) for i in out)


def test_line_dedup_on_odd_tables(spark):
    rng = random.Random(13)
    t, u = prose(80, rng, 10**6), prose(80, rng, 10**6)
    rows = [(3, t, 1, 2), (5, t, 1, 2), (5, t, 1, 2), (5, u, 1, 2), (5, t + " " + u, 1, 2), (None, t, 1, 2), (None, None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lo int, _lo int")
    got = line_dedup.line_dedup(docs)
    assert got.columns == docs.columns
    left = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert left[3, t] == 1 and left[5, ""] >= 2 and left[None, t] == 1 and left[None, None] == 1 and sum(left.values()) == 7
    assert sum(n for (_, x), n in left.items() if x and u in x) == 1
    # A line feed every few words, none at all, and a text of 70 000 words before the passage.
    long = "word " * 70_000 + t
    docs = docs_of(spark, [t.replace(" ", "\n"), long])
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()}
    assert out[1].split() == ["word"]
    got, want = report_of(spark, docs_of(spark, ["q " * 500 + t, t]))
    assert got == want


def test_line_dedup_deletes_only_what_was_there_before(spark, sample):
    texts = {r["doc_id"]: r["text"] for r in sample.collect()}
    seen = set()
    runs = {r["doc_id"]: list(zip(r["first_words"], r["end_words"], strict=True)) for r in line_dedup.line_dedup_report(sample).collect()}
    for i in sorted(texts):
        w = texts[i].lower().split()
        covered = np.zeros(len(w), bool)
        for k in range(len(w) - line_dedup.LINE + 1):
            x = tuple(w[k : k + line_dedup.LINE])
            if x in seen:
                covered[k : k + line_dedup.LINE] = True
            seen.add(x)
        assert all(covered[a:b].all() and b - a >= line_dedup.LEAST_WORDS for a, b in runs[i])
        assert line_dedup.delete_runs(texts[i], []) == texts[i]


def test_decontamination(spark, data, sample):
    rng = random.Random(8)
    item = prose(40, rng, 10**6)
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, ""), (4, None), (5, prose(30, rng, 10**6))], "item_id long, text string")
    half = " ".join(item.split()[:20])
    texts = [prose(3000, rng) + " " + item.upper() + " " + prose(50, rng), half, "x", None, "", "too  SHORT", item]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs_of(spark, texts), items).collect()}
    assert got == {(0, 1), (6, 1), (5, 2)}
    by_join = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs_of(spark, texts), items, broadcast_shingles=1).collect()}
    assert by_join == got
    left = decontaminate.decontaminate(docs_of(spark, texts), items)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 4]
    # Rows that share an id or have none, and clashing names.
    odd = spark.createDataFrame([(1, item, 1, 2), (1, "x", 1, 2), (None, item, 1, 2), (None, None, 1, 2)], "doc_id long, text string, found int, row int")
    for limit in (1, 10**6):
        left = decontaminate.decontaminate(odd, items, broadcast_shingles=limit)
        assert left.columns == odd.columns and Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(1, "x"), (None, None)])
        got = decontaminate.contamination(odd, items.union(items.where("item_id = 1")), broadcast_shingles=limit).collect()
        assert sorted((r["doc_id"] or 0, r["n_items"], r["item_ids"], r["contaminated"]) for r in got) == [(0, 0, [], False), (0, 1, [1], True), (1, 0, [], False), (1, 1, [1], True)]
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    sets = {r["item_id"]: set(shingle_set(r["text"]).tolist()) for r in bench.collect()}
    want = {(r["doc_id"], i) for r in sample.collect() for s in [set(shingle_set(r["text"]).tolist())] for i, x in sets.items() if len(x & s) >= 0.75 * len(x)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(sample, bench).collect()} == want


PAGE = "<html><head><title>t</title></head><body><header>H</header><nav><a href=x>n</a></nav><div class='cookie-notice'>c</div><main><h1>A &amp; B</h1><p>one <b>two</b>&nbsp;x<p>three<ul><li>i1<li>i2</ul><form>f</form><div id='comments'><p>c1</div><aside>s</aside><script>var p='</p>';</script>tail</main><footer>f</footer></body></html>"


def test_html(spark):
    pages = [(1, "http://a.example/1", PAGE), (2, None, None), (3, "bad url", ""), (4, "http://b.example/", "<p>a</p>loose <i>b</i><!-- c --><br>d")]
    # A line that every page of a host has goes; an article that is copied there stays.
    pages += [(10 + i, f"http://h.example/{i}", f"<body><div><p>Join our club today</p></div><p>Body number {i} here</p></body>") for i in range(8)]
    pages += [(30 + i, f"http://k.example/{i}", "<body><article><p>Same article</p></article></body>") for i in range(8)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1][0] == "A & B\none two x\nthree\ni1\ni2\ntail"
    assert got[2] == ("", 0) and got[3] == ("", 0) and got[4][0] == "a\nloose b d"
    assert all(got[10 + i][0] == f"Body number {i} here" for i in range(8)) and all(got[30 + i][0] == "Same article" for i in range(8))
    assert got[1][1] == len(got[1][0])


def text_of(html):
    return "\n".join(t for t, _ in html_extract.blocks(html)[0])


def test_html_names():
    for open_, close in (("<article class='post has-sidebar'>", "</article>"), ("<div class='layout no-sidebar'>", "</div>"), ("<main id='content-with-toolbar'>", "</main>"), ("<div class='sidebar-layout'><article>", "</article></div>")):
        assert text_of(f"<body>{open_}<p>One</p><p class='related-work'>Two</p>{close}</body>") == "One\nTwo", open_
    for extra in ("<div class='cookie-notice'>x</div>", "<div id='comments'><article class='comment'>x</article></div>", "<p class='advert'>x</p>", "<div class='site_footer'>x</div>", "<ul role=navigation><li>x</ul>"):
        assert text_of(f"<body><article><p>One</p>{extra}</article></body>") == "One", extra


def test_html_of_odd_pages(spark):
    import time

    began = time.time()
    assert "x" in text_of("x" + "<a " * 20_000) and text_of("<div>" * 300 + "deep" + "</div>" * 300) == "deep"
    assert len(text_of("<p>word " * 20_000).split("\n")) == 20_000
    assert time.time() - began < 20
    pages = [(1, "http://a/1", "<p>a", 7), (1, "http://a/1", "<p>a", 7), (1, "http://a/1", "<p>b", 7), (None, "http://a/2", "<p>c", 7)]
    got = html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string, host int"))
    assert sorted(r["text"] for r in got.collect()) == ["a", "a", "b", "c"]


def test_warc(spark):
    rng = random.Random(9)
    big = "<p>" + prose(400, rng) + "</p>"
    pages = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, "small"), (4, "http://a/4", "small"), (5, "http://a/5", None), (6, "http://a/6", big), (7, "http://a/7", prose(300_000, rng))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.warc_round_trip(df).collect()}
    for i, _, h in pages:
        h = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(h), hashlib.sha1(h).hexdigest())
    assert {i: got[i]["refers_to"] for i in got if got[i]["record_type"] == "revisit"} == {1: 6, 2: 6}
    assert warc.warc_round_trip(df.limit(0)).count() == 0
    records = [warc.record(i, "u", b"x" * i, None) for i in range(50)]
    assert list(warc.unpack(warc.pack(records))) == records


def test_warc_files(spark, tmp_path):
    rng = random.Random(10)
    pages = [(i, f"http://a/{i}", None if i == 7 else "<p>" + prose(300, rng) + "</p>") for i in range(40)]
    pages += [(None, None, "same"), (None, None, "same"), (41, "http://a/41", pages[0][2])]
    # Five pages of 5 MB fill more than one archive in a task.
    pages += [(50 + i, None, f"{i}" + "x" * 5_000_000) for i in range(5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    folder = tmp_path / "archives"
    made = warc.write_files(df, str(folder)).collect()
    files = {f.name: f.stat().st_size for f in folder.iterdir() if f.name.endswith(".warc.zst")}
    assert files == {r["file"]: r["n_bytes"] for r in made} and len(made) > 1
    assert not list(folder.glob("*.part"))
    assert sum(r["records"] for r in made) == df.count()
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    from_files = Counter(map(tuple, warc.read_files(spark, str(folder)).select(names).collect()))
    assert from_files == Counter(map(tuple, warc.read_archives(warc.write_archives(df)).select(names).collect()))
    assert sum(from_files.values()) == df.count()
    for f in files:
        content = (folder / f).read_bytes()
        assert content[:4] == (0x184D2A5D).to_bytes(4, "little") and sum(1 for _ in warc.unpack(content))
    assert warc.write_files(df.limit(0), str(tmp_path / "none")).count() == 0


def test_kernel_by_brute_force():
    from itertools import combinations

    def brute(s, t, n, d):
        spans = lambda x: [("".join(x[i] for i in c), c[-1] - c[0] + 1) for c in combinations(range(len(x)), n)]
        return sum(d ** (a + b) for u, a in spans(s) for v, b in spans(t) if u == v)

    for s, t in (("idiot", "idiot"), ("id.iot", "idiot"), ("trashy", "trash"), ("ab", "abc"), ("aaaa", "aaa")):
        w = max(len(s), len(t))
        assert abs(toxicity.kernel(toxicity.codes([s], w), toxicity.codes([t], w))[0] - brute(s, t, 3, toxicity.DECAY)) < 1e-9


def test_kernel_rows_are_the_highest_of_all_windows():
    landmarks = ["idiot", "^moro", "loser$", "stup"]

    def brute(unit, x):
        k = lambda a, b: toxicity.kernel(toxicity.codes([a], len(a)), toxicity.codes([b], len(b)))[0]
        whole = toxicity.marked(unit)
        windows = {whole[i : i + w] for w in range(len(x), 2 * len(x) + 1) for i in range(max(1, len(whole) - w + 1))}
        return max(k(w, x) / max(1e-12, (k(w, w) * k(x, x)) ** 0.5) for w in windows)

    machine = toxicity.Machine(landmarks)
    found = ["idiot", "ixdixot", "idxxiot", "ixdxiot", "idxiot", "idxxxiot", "idit", "mxoron", "l.o.s.e.r", "q" * 20, "st", "stpu", "tree"]
    machine.learn(set(found))
    assert all(machine[u] is not None and machine[u][0] > 0 for u in ("idxiot", "ixdixot", "idxxiot", "ixdxiot"))
    for u in found:
        row = machine[u] if machine[u] is not None else np.zeros(len(landmarks))
        full = np.array([brute(u, x) for x in landmarks])
        assert np.allclose(row, np.where(full >= machine.least, full, 0), atol=1e-9), u


def test_windows_only_where_a_kernel_may_reach_the_least(monkeypatch):
    rng = random.Random(12)
    parts = "the ion an er ti ou st re lo mo di po us it to".split()
    words = sorted({"".join(rng.choices(parts, k=rng.randrange(2, 6))) for _ in range(3000)} | {"ixdixot", "s.t.u.p", "m-or-o", "o" * 50 + "loser", "iidiioott" * 3, "st", "", "s\0tup\0"})
    highest, looked = toxicity.Machine.highest, []
    monkeypatch.setattr(toxicity.Machine, "highest", lambda self, text, *more: looked.append(len(text)) or highest(self, text, *more))
    machine = toxicity.Machine(["idiot", "^moro", "loser$", "stup"])
    machine.learn(set(words))
    # Rows were words with windows for every landmark before (2200 of 2389); now they are pairs of a word and a landmark (576).
    assert sum(looked) < 0.5 * len(words)
    got = np.array([machine[u] if machine[u] is not None else np.zeros(4) for u in words])
    assert (got.max(axis=0) > 0).all()
    # Without the bounds: windows of every word for every landmark.
    monkeypatch.setattr(toxicity.Machine, "near", lambda self, small, size: (np.repeat(np.arange(len(small)), 4), np.tile(np.arange(4), len(small))))
    plain = toxicity.Machine(machine.landmarks)
    plain.learn(set(words))
    assert np.allclose(got, [plain[u] if plain[u] is not None else np.zeros(4) for u in words], rtol=0, atol=1e-12)


def labelled(rng, n):
    rows = []
    for i in range(n):
        toxic = i % 3 == 0
        words = [f"{rng.choice('bcdfg')}a{rng.choice('klmn')}e{rng.randrange(40)}" for _ in range(40)]
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["stupidhead", "numbskull"])
        rows.append((i, ". ".join(" ".join(words[k : k + 8]) for k in range(0, 40, 8)), int(toxic)))
    return rows


def test_toxicity_finds_disguised_words():
    model = toxicity.fit(labelled(random.Random(10), 240), 1 / 3)
    scorer = toxicity.Scorer(model)
    clean, plain, dotted, inserted = scorer.scores(["bake1 cale2. dane3", "you numbskull", "s.t.u.p.i.d.h.e.a.d here", "what a stu*pidhead numb-skull"])
    assert clean < 0.3 < plain and dotted > clean and inserted > 0.3


def test_margins_are_those_of_distinct_units():
    model = toxicity.fit(labelled(random.Random(10), 240), 1 / 3)
    texts = ["Stupidhead, stupidhead! (numbskull) bake1", "n u m b s k u l l s.t.u.p.i.d", None, "...", "numb-skull s.t.u.p.i.d.h.e.a.d stupid", "x" * 90 + "numbskull"]
    scorer = toxicity.Scorer(model)
    for _ in range(2):
        for text, got in zip(texts, scorer.margins(texts), strict=True):
            machine = toxicity.Machine(model.landmarks, model.own)
            machine.learn(set(toxicity.units(text or "")))
            found = sorted((float(r @ model.root @ model.weights + model.bias) for r in machine.values() if r is not None), reverse=True)
            found = [x for x in found if x > model.bias][: toxicity.WORST]
            assert np.allclose(got, found + [model.bias] * (toxicity.WORST - len(found)), atol=1e-9), text


def test_classifiers_on_odd_rows(spark, data, sample):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    odd = sample.unionByName(docs_of(spark, ODD, 10_000).select(sample.columns))
    for got in (quality.quality_scores(odd, labels, per_class=60), toxicity.toxicity_scores(odd, labels, per_class=60)):
        rows = got.collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (10_000, 10_001)}) == 1
    none = quality.quality_scores(odd, labels.limit(0))
    assert {r["score"] for r in none.collect()} == {1.0}
    assert {r["score"] for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect()} == {0.0}


def test_quality_learns(spark):
    rng = random.Random(11)
    rows = [(i, prose(60, rng) if i % 2 else " ".join(f"W{rng.randrange(99)}!!" for _ in range(60)), i % 2) for i in range(200)]
    model = quality.fit(rows, 0.5)
    pooler = quality.Pooler(model.rows, model.vectors)
    good, bad = quality.probability(model, np.stack([pooler.pool(prose(50, rng)), pooler.pool("SHOUT!! W7!! W8!! W9!!")]))
    assert good > 0.7 and bad < 0.3


def test_empty_tables(spark):
    none = docs_of(spark, ["x"]).limit(0)
    assert token_counts.token_counts(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert bpe.bpe_encode(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert html_extract.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert decontaminate.contained_items(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_fold_of_a_row(spark):
    import zlib

    from weftgraph.llm.common import crc_bucket

    rows = spark.range(50).select("id", crc_bucket(F.col("id"), 5).alias("k")).collect()
    assert all(r["k"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)
    assert len(Counter(r["k"] for r in rows)) == 5
