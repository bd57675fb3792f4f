"""Operators against brute force, and their edge cases: nulls, empties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from casegrain.llm import decontamination, fingerprint, frames, html_extraction, line_dedup, mixing, ngram_join, quality, secrets, substring_dedup, toxicity

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a", "en", "s", 1), (3, "a", "en", "s", 1), (None, "a b c d e f g", "en", None, 13), (4, " \t\n ", "en", "s", 4), (5, "x " * 30000, "en", "s", 60000), (6, "naïve ß 漢字 🙂\nline", "de", "t", 18)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) if lower else raw).split()


def covered(rows, window):
    first, out = {}, {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, i), i)
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def test_substring_dedup(spark, docs, odd):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == covered(rows, 50)
    r = random.Random(3)
    base = [[f"w{r.randrange(40)}" for _ in range(r.randrange(120))] for _ in range(8)]
    texts = [(i, " ".join(sum((r.choice(base)[r.randrange(20) :] for _ in range(3)), []))) for i in range(60)]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring_dedup.substring_dedup(spark.createDataFrame(texts, "doc_id long, text string"), window=20).collect()}
    assert got == covered(texts, 20)
    out = substring_dedup.substring_dedup(odd).collect()
    assert len(out) == len(ODD) and {x.n_words for x in out if x.doc_id in (1, 2, 4)} == {0}
    assert substring_dedup.substring_dedup(odd.where("false")).count() == 0


def linked(rows, percent=75):
    sets = {}
    for i, text in rows:
        w = words(text, lower=True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block, shingles", [(512, 400_000), (3, 400_000), (3, 150)])
def test_ngram_join(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", block)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", shingles)
    r = random.Random(5)
    base = [[f"w{r.randrange(500)}" for _ in range(60)] for _ in range(6)]
    texts = []
    for i in range(70):
        w = list(r.choice(base))
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = f"n{i}"
        texts.append((i, " ".join(w)))
    common = [f"c{k}" for k in range(12)]  # texts that share a passage only
    for i in range(200, 240):
        w = [f"u{i}_{k}" for k in range(r.randrange(30, 50))]
        texts.append((i, " ".join(w[:10] + common + w[10:])))
        if i % 4 == 0:
            w[20] = "changed"
            texts.append((i + 100, " ".join(w[:10] + common + w[10:])))
    texts += [(100, None), (101, ""), (102, "One two"), (103, "one TWO")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == linked(texts)


def test_common_words_make_no_candidates(spark, monkeypatch):
    """Unrelated texts that share shingles of common words, more than the list of frequent shingles holds, don't meet."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 16)
    r, met = random.Random(3), []
    texts = [(i, " ".join(r.choice("abcd") if r.random() < 0.7 else f"{r.randrange(10**6)}" for _ in range(80))) for i in range(400)]
    texts += [(1000 + i, f"{t} end") for i, t in texts[:5]]
    of = frames.components
    monkeypatch.setattr(frames, "components", lambda edges: met.append(edges.distinct().count()) or of(edges))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == linked(texts) and met[0] == 5


def test_shares_keep_size_and_overlap():
    blob = np.sort(np.array([5, 7, 7, 7, 9], "<u4"))
    other = np.sort(np.array([7, 7, 9, 11], "<u4"))
    a, b = ngram_join._share(blob), ngram_join._share(other)
    assert len(np.unique(a)) == 5 and len(np.unique(b)) == 4 and len(np.intersect1d(a, b)) == 3


def test_first_of_group(odd):
    kept = [r.doc_id for r in ngram_join.first_of_group(odd).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 3, None, 4, 5, 6], key=str)
    assert ngram_join.ngram_join(odd.where("false")).count() == 0


def test_t_occurrence_is_exact():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(60)]
    links = ngram_join.t_occurrence(sets, np.arange(60), np.ones(60, bool), 60)
    for i, j in links:
        a, b = set(sets[i]), set(sets[j])
        assert 100 * len(a & b) >= 60 * len(a | b)
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def count(pairs):
        root[:] = range(60)
        for i, j in pairs:
            root[find(i)] = find(j)
        return [find(i) == find(j) for i in range(60) for j in range(i)]

    assert count(links) == count([(i, j) for i in range(60) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 60 * len(set(sets[i]) | set(sets[j]))])


def test_fingerprint(docs, odd):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    for k, (i, t) in enumerate(rows):
        u = rows[(k + 1) % len(rows)][1]
        h = len(t) // 2
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest())
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95
    a, b, ab, ba = (fingerprint.to_text(*[x[0] for x in fingerprint.sums(pa.array([t]))]) for t in ("one two three four", "five six", "one two three four\nfive six", "five six\none two three four"))
    assert ab == ba == fingerprint.combine(a, b) and fingerprint.combine(ab, b, delete=True) == a
    assert fingerprint.fingerprints(odd).count() == len(ODD) and fingerprint.fingerprints(odd.where("false")).count() == 0
    assert fingerprint.fingerprints(odd.where("doc_id = 6")).first().near_next == 1.0


def test_levenshtein_trie():
    trie = toxicity.Trie()
    lexicon = ["idiot", "moron", "scum"]
    for w in lexicon:
        trie.add(w, 1)
    trie.add("vequ", 2)

    def near(a, b):  # optimal string alignment distance
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    r = random.Random(2)
    tokens = ["".join(r.choice("idotmrnscu0") for _ in range(r.randrange(4, 7))) for _ in range(3000)] + ["idi0t", "idoit", "iidiot", "idit", "idiot", "vequez"]
    for t in tokens:
        want = 1 if t in lexicon else 2 if t.startswith("vequ") else 3 if any(near(t, w) <= 1 for w in lexicon) else 0
        assert trie.find(t) == want, t
    assert toxicity.quoted("he said moron".split(), 2) and toxicity.quoted(["„du", "moron“"], 1) and not toxicity.quoted("you moron".split(), 1)


def test_classifiers(spark, odd):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    marked = {r.doc_id: r for r in labels.collect()}
    for f, column, least in ((toxicity.toxicity, "toxic", 0.96), (quality.quality, "quality", 0.93)):
        rows = [r for r in f(docs, labels).collect() if r.doc_id in marked and r.held_out]
        assert np.mean([getattr(marked[r.doc_id], column) == r.predicted for r in rows]) > least
        assert all(0 <= r.score <= 1 for r in rows)
        assert f(odd, labels.limit(0)).count() == len(ODD) and f(docs.limit(0), labels).count() == 0
    model = toxicity.learn([(1, "you idiot"), (0, "fine day")] * 10)
    out = toxicity.score_toxicity(odd.withColumnRenamed("lang", "score"), model)
    assert out.count() == len(ODD) and out.columns.count("score") == 1


def test_toxicity_misspelled_forms_of_a_stem():
    """Once its forms have a stem, a term's misspellings are still seen, and the forms count as before."""
    toxic = [(1, f"you {w} there") for w in ("idiot", "idiots", "idiotic", "idiotically")] * 10
    model = toxicity.learn(toxic + [(0, "a fine day there")] * 40)
    assert model.stems and any("idiot".startswith(s) for s in model.stems)
    assert [model.kind(w) for w in ("idiot", "idiots", "idoit", "iidiotic", "day")] == [2, 2, 3, 3, 0]


def test_decontamination(spark, docs, odd):
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    bench, rows = [(r.item_id, r.text) for r in items.collect()], [(r.doc_id, r.text) for r in docs.collect()]
    want = {(i, k) for i, t in rows for k, b in bench if b in t}
    found = {(r.doc_id, x.item_id) for r in decontamination.find_leaks(docs, items).collect() for x in r.leaks}
    assert want <= found and len(found - want) <= 2
    whole = spark.createDataFrame([(1, "pad " * 50 + bench[0][1] + " pad" * 50), (2, "clean words only")], "doc_id long, text string")
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in decontamination.find_leaks(whole, items).collect()} == {1: [bench[0][0]], 2: []}
    assert all(r.leaks == [] for r in decontamination.find_leaks(odd, items).collect())
    assert all(r.leaks == [] for r in decontamination.find_leaks(odd, spark.createDataFrame([(None, "x"), (1, None), (2, " ")], "item_id long, text string")).collect())


def test_block_max_skips_lose_nothing():
    r = random.Random(4)
    items = [(i, " ".join(r.choice("the of a in to".split()) if r.random() < 0.5 else f"t{r.randrange(80)}" for _ in range(30))) for i in range(40)]
    index = decontamination.Index(items)
    texts = [" ".join(items[r.randrange(40)][1].split()[: r.randrange(10, 30)] + [f"t{r.randrange(80)}" for _ in range(60)]) for _ in range(30)]
    from casegrain.llm.textkit import buffers

    w = decontamination._words(*buffers(pa.array(texts)))
    got = {(int(d), index.ids[i]): s for d, i, s in zip(*index.retrieve(w))}
    tf = {i: Counter(t.split()) for i, t in items}
    df = Counter(x for c in tf.values() for x in c)
    mean = np.mean([sum(c.values()) for c in tf.values()])
    score = lambda q, i: sum(np.log(1 + (40 - df[x] + 0.5) / (df[x] + 0.5)) * tf[i][x] * 2.2 / (tf[i][x] + 1.2 * (0.25 + 0.75 * sum(tf[i].values()) / mean)) for x in q if x in tf[i])
    for d, t in enumerate(texts):
        t = t.split()
        for i, _ in items:
            limit = 0.5 * score(set(tf[i]), i) * min(1, 48 / 30)
            best = max(score(set(t[k : k + 64]), i) for k in range(0, max(1, len(t) - 32), 32))
            assert ((d, i) in got) == (best >= limit) or abs(best - limit) < 1e-3


def test_html(spark):
    page = '<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>First\n line<br><p>Second &lt;x&gt;</article><div id="comments"><p>nice</p></div><footer>&copy; me</footer>'
    bare = '<div class="top">Site name</div><div class="content"><p>Story {0} one</p><p>Story {0} two</p></div><div>Imprint of site</div>'
    rows = [(1, "http://h.example/a", page), (2, None, None), (3, "http://h.example/b", ""), (4, "http://g.example/1", bare.format("A")), (5, "http://g.example/2", bare.format("B")), (6, "http://g.example/3", bare.format("C"))]
    got = {r.page_id: r.text for r in html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Head & more\nFirst line\nSecond <x>", 2: "", 3: "", 4: "Story A one\nStory A two", 5: "Story B one\nStory B two", 6: "Story C one\nStory C two"}
    a, b = html_extraction.parse("<div><p>x</p><ul><li>1</li><li>2</li></ul></div>"), html_extraction.parse("<div><ul><li>3</li></ul><p>y</p></div>")
    assert html_extraction.tree_match(a, b) == 4


def test_html_wrapper_decides(spark):
    """Template text inside the content goes wherever it stands; every part of a split article stays; copies keep theirs."""
    note = "<p>Help us write: give to the site.</p>"
    split = "<body><div>Site</div><article><h1>T{0}</h1>{1}" + note + "{2}</article><div><p>Also read</p></div><article><p>End {0}</p></article></body>"
    bare = "<div>Site name</div><div><p>Tale {0} one</p>" + note + "<p>Tale {0} two</p></div><div>Imprint</div>"
    copy = "<article><h1>Same</h1><p>Same text on each</p></article>"
    rows = [(i, "http://s.example/%d" % i, split.format(i, f"<p>Text {i} a</p>" * (1 + i % 3), f"<p>Text {i} b</p>")) for i in range(8)]
    rows += [(10 + i, "http://b.example/%d" % i, bare.format(i)) for i in range(5)]
    rows += [(20 + i, "http://c.example/%d" % i, copy if i < 6 else f"<article><h1>Own {i}</h1><p>Words {i}</p></article>") for i in range(8)]
    rows += [(30, "http://one.example/", split.format(1, "", ""))]
    got = {r.page_id: r.text for r in html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: "\n".join([f"T{i}", *[f"Text {i} a"] * (1 + i % 3), f"Text {i} b", f"End {i}"]) for i in range(8)}
    want |= {10 + i: f"Tale {i} one\nTale {i} two" for i in range(5)}
    want |= {20 + i: "Same\nSame text on each" if i < 6 else f"Own {i}\nWords {i}" for i in range(8)}
    assert got == want | {30: "T1\nHelp us write: give to the site.\nEnd 1"}


def test_mixing_measures(docs):
    texts = [r.text for r in docs.collect()] + [row[1] for row in ODD] + ["?!", "\x0b\x1c\u00a0\u2003 a", "🙂", "é!"]
    size, weight = mixing.measures(pa.array(texts, pa.string()))
    for text, n, w in zip(texts, size, weight, strict=True):
        solid = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        marks = re.findall(r"[!-/:-@\[-`{-~]", solid)
        assert n == len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) and w == 0.1 + 0.9 * ((len(solid) - len(marks)) / len(solid) if solid else 0.0)
    assert [len(x) for x in mixing.measures(pa.array([], pa.string()))] == [0, 0]


def test_mixing(docs, odd, spark):
    rows = mixing.mix(docs).collect()
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and sum(r.size for r in own) == own[0].source_size
    assert abs(sum(r.taken for r in rows) - sum(r.size for r in rows)) <= 20
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert len(mixing.mix(odd).collect()) == len(ODD) and mixing.mix(odd.where("false")).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).collect())


def test_secrets(docs, odd, spark):
    assign = re.compile(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

    def base(t):
        t = t or ""
        out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])

    tricky = [(1, "🙂 token=secret: abcdefgh12 PASSWD = 'abcdefgh' api_key:xAKIA12"), (2, "x" + "a" * 31 + " " + "0" * 32 + "gAKIAABCDEFGHIJKL"), (3, None)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(tricky, "doc_id long, text string").selectExpr("doc_id + 100000 as doc_id", "text"))
    want = {r.doc_id: base(r.text) for r in frame.collect()}
    got = {r.doc_id: [tuple(s) for s in r.found if s["rank"] < 3] for r in secrets.secret_scan(frame).collect()}
    assert got == want
    r = random.Random(1)
    hexes = [(i, "see " + "".join(r.choice("0123456789ABCDEF") for _ in range(40))) for i in range(40)]
    plain = [(100 + i, "file2023reportfinalversion_draft_number3") for i in range(40)]
    found = Counter((x.doc_id // 100, x.n_random) for x in secrets.secret_scan(spark.createDataFrame(hexes + plain, "doc_id long, text string")).collect())
    assert found[0, 1] >= 36 and found[1, 0] == 40
    assert secrets.secret_scan(odd).count() == len(ODD) and secrets.secret_scan(odd.where("false")).count() == 0


def test_secrets_recall_by_encoding_and_length(spark):
    """Tokens drawn at random from each encoding are found, long ones too, and natural identifiers among them are not."""
    from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits

    alphabets = {"hex": digits + "ABCDEF", "base32": ascii_uppercase + "234567", "lower36": digits + ascii_lowercase, "upper36": digits + ascii_uppercase, "alnum": digits + ascii_letters, "base64": digits + ascii_letters + "+/", "base64url": digits + ascii_letters + "-_", "lower": ascii_lowercase, "upper": ascii_uppercase, "letters": ascii_letters, "digits": digits}
    r = random.Random(11)
    kinds = [(name, n) for name in alphabets for n in ((24, 30) if name == "digits" else (40, 64, 128, 2400))]  # longer digits are base spans
    rows = [(100 * k + i, "see " + "".join(r.choice(alphabets[name]) for _ in range(n)) + " there") for k, (name, n) in enumerate(kinds) for i in range(50)]
    plain = ["internationalizationsupportmodule", "file2023reportfinalversion_draft_number3", "getUserAccountSettingsFromDatabaseRecord", "usr/local/share/applications/menu", "Donaudampfschifffahrtsgesellschaft", "00000000000000000000001234", "a_b/c-d_e/f-g_h/i-j_k/l-m9"]
    rows += [(1_000_000 + i, f"see {plain[i % len(plain)]} there") for i in range(70)]
    found = Counter((x.doc_id // 100, x.n_random) for x in secrets.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    recall = {kind: found[k, 1] / 50 for k, kind in enumerate(kinds)}
    assert {kind: share for kind, share in recall.items() if share < (0.8 if kind[1] <= 40 else 0.94)} == {}
    assert found[10_000, 0] == 70


def test_line_dedup(docs, odd, spark):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    sites, first = {}, {}
    for i, t, s in rows:
        for x in t.split("\n"):
            if k := x.strip():
                sites.setdefault(k, set()).add(s)
                first[k] = min(first.get(k, i), i)
    common = {k for k, v in sites.items() if len(v) >= 10}
    want = {i: "\n".join(x for x in t.split("\n") if x.strip() not in common or first[x.strip()] == i) for i, t, _ in rows}
    out = line_dedup.line_dedup(docs).collect()
    assert {r.doc_id: r.text for r in out} == want
    extra = odd.withColumnRenamed("lang", "lines_removed")
    kept = line_dedup.line_dedup(extra).collect()
    assert len(kept) == len(ODD) and sum(r.lines_removed for r in kept) == 0
    assert line_dedup.line_dedup(odd.where("false")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        assert 0.7 * docs.count() <= out.count() <= docs.count(), name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == docs.count()


def test_components(spark):
    from casegrain.llm import frames

    r = random.Random(7)
    edges = [(i, i + 1) for i in range(200)] + [(r.randrange(300, 500), r.randrange(300, 500)) for _ in range(90)] + [(900, 900), (None, 3), (1, None)]
    root = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in frames.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert frames.components(spark.createDataFrame([], "a long, b long")).count() == 0
