"""Whole results against brute force, hot and odd rows, clashing names, and the pipeline stage by stage."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casegrain.llm import decontamination, fingerprint, frames, html_extraction, line_dedup, mixing, ngram_join, quality, queries, secrets, toxicity
from tests.llm.test_operators import DIR, ODD, SCHEMA, linked

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, Score string, text_0 string, kept_id_0 string, gone_0 string, LEAKS string, Lines_Removed string, __gone string, __text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f", "g", "h") for r in ODD], CLASHING)


def test_clashing_names(spark, clashing):
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    scored = toxicity.score_toxicity(clashing, toxicity.learn([(1, "you idiot"), (0, "fine day")] * 10))
    assert scored.columns == [c for c in clashing.columns if c != "Score"] + ["score", "predicted"] and {r["__text"] for r in scored.collect()} == {"h"}
    found = decontamination.find_leaks(clashing, items)
    assert found.columns == [c for c in clashing.columns if c != "LEAKS"] + ["leaks"] and {r["text_0"] for r in found.collect()} == {"b"}
    kept = line_dedup.line_dedup(clashing)
    assert kept.columns == [c for c in clashing.columns if c != "Lines_Removed"] + ["lines_before", "lines_removed"] and {r["__gone"] for r in kept.collect()} == {"g"}
    assert ngram_join.first_of_group(clashing).columns == clashing.columns


# ---- fingerprints -------------------------------------------------------------------------------


def test_sums_do_not_wrap():
    _, signs = fingerprint.sums(pa.array(["one line of five words\n" * 66_000, "one line of five words\n" * 65_000, "x " * 65_538, "x " * 65_538 + "and more"]))
    likeness = lambda i, j: float(fingerprint.likeness(signs[i : i + 1], signs[j : j + 1])[0])
    assert likeness(0, 1) > 0.999 and likeness(2, 3) > 0.99 and likeness(0, 2) < 0.5


def test_edited_texts_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(frames, "GROUP_BYTES", 300)
    r = random.Random(2)
    rows = [(i * 7, "".join(r.choice("ab \n") for _ in range(r.randrange(60)))) for i in range(300)] + [(7, "again"), (None, "no id"), (None, None), (None, "no id")]
    got = fingerprint.fingerprints(spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string"), keep_text=True).collect()
    assert len(got) == len(rows) and sum(x.doc_id is None for x in got) == 3
    unique = [i * 7 for i in range(3, 299)]
    texts = {i: t or "" for i, t in rows}
    for x in got:
        if x.doc_id in unique:
            t, u = texts[x.doc_id], texts[x.doc_id + 7]
            assert x.edited_text == t[: len(t) - len(t) // 2] + u[: len(t) // 2]
    last = next(x for x in got if x.doc_id == 299 * 7)
    assert last.edited_text.startswith(texts[299 * 7][: (len(texts[299 * 7]) + 1) // 2])
    same = [x.fingerprint for x in got if x.doc_id is None and x.n_chars == 5]
    assert len(same) == 2 and len(set(same)) == 1


# ---- toxicity and quality ---------------------------------------------------------------------------


def near(a, b):
    """Optimal string alignment distance."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def plain_features(model, text):
    """The four counts with a distance to every term instead of the trie."""
    counts, tokens = [0] * 4, (text or "").lower().split()
    for i, token in enumerate(tokens):
        t = token.strip(toxicity._EDGE)
        forms = [w for w in model.words if any(w.startswith(s) for s in model.stems)]
        kind = 0
        if t and t in model.words and t not in forms:
            kind = 1
        elif t and any(t.startswith(s) for s in model.stems):
            kind = 2
        elif len(t) >= model.shortest and t not in model.plain and any(abs(len(t) - len(w)) <= 1 and near(t, w) <= 1 for w in model.words):
            kind = 3
        if kind:
            counts[3 if toxicity.quoted(tokens, i, reporting=model.reporting) else kind - 1] += 1
    return [math.log1p(c) for c in counts]


def test_toxicity_of_whole_documents(spark, docs, odd):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    model = toxicity.fit(docs, labels)
    marked = {r.doc_id: r.toxic for r in labels.where(~toxicity.held_out(F.col("doc_id"))).collect()}
    texts = [(marked[r.doc_id], r.text) for r in docs.collect() if r.doc_id in marked and r.text is not None and marked[r.doc_id] in (0, 1)]
    local = toxicity.learn(texts)
    assert (model.words, model.stems) == (local.words, local.stems) and np.allclose(model.weights, local.weights, atol=1e-6)
    planted = spark.createDataFrame([(1000 + i, t, None, None, None) for i, t in enumerate(["a " + w[:1] + w[2:] + " b" for w in model.words[:20]] + ['he said "' + w + '" there' for w in model.words[:20]])], SCHEMA)
    frame = docs.limit(60).unionByName(odd).unionByName(planted)
    for r in toxicity.score_toxicity(frame, model).collect():
        x = np.array([plain_features(model, r.text)])
        assert abs(r.score - float(model.scores(x)[0])) < 1e-9


def test_planted_misspellings_and_quotations_decide():
    clean = [(0, f"a fine day number {i} there for you") for i in range(60)]
    model = toxicity.learn([(1, f"you {w} there {i}") for i, w in enumerate(["moron", "scumbag", "cretin"] * 20)] + clean)
    score = lambda t: float(model.scores(np.array([model.features(t)]))[0])
    for w, wrong in (("moron", "morron"), ("scumbag", "scmubag"), ("cretin", "cretn")):
        assert score(f"you {w}") >= score(f"you {wrong}") > 0.3 > score("a fine day")
        assert score(f'they wrote "{w}" on it') < 0.3 < score(f"you {w}") and score(f'they wrote "{w}" on it') > score("a fine day")
    assert model.weights[4] == pytest.approx(toxicity.QUOTED_SHARE * model.weights[1]) and model.weights[3] == pytest.approx(toxicity.MISSPELT_SHARE * model.weights[1])
    strict = toxicity.learn([(1, "you moron")] * 20 + clean, edits=0, reporting=frozenset({"claims"}))
    assert strict.kind("morron") == 0 and toxicity.quoted("she claims moron".split(), 2, reporting=strict.reporting)


def test_quality_votes_against_loops(spark, docs, odd):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    model = quality.fit(docs, labels)
    frame = docs.unionByName(odd.where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10_000).dropDuplicates(["doc_id"]))
    got = {r.doc_id: r.score for r in quality.score_quality(frame, model).collect()}
    for r in frame.collect():
        raw = (r.text or "").encode()
        x = np.zeros(quality.TERMS, np.float32)
        for (a, b), n in Counter(zip(raw, raw[1:], strict=False)).items():
            x[((a * 257 + b) * 2654435761 % (1 << 32)) >> 20] += n
        v = (np.log1p(x) * model.idf) @ model.basis
        v = v / np.linalg.norm(v) if np.linalg.norm(v) else v
        cosines = [float(v @ w) for w in model.vectors]
        best = sorted(range(len(cosines)), key=lambda i: -cosines[i])[: quality.NEIGHBOURS]
        weights = [max(cosines[i], 0.0) ** quality.SHARPNESS for i in best]
        want = sum(w * model.labels[i] for w, i in zip(weights, best, strict=True)) / sum(weights) if sum(weights) else model.prior
        assert abs(got[r.doc_id] - want) < 0.01


# ---- decontamination --------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub(r"[!-/:-@\[-`{-~]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def plain_leaks(texts, items):
    """(document, item, score) of verified items, by loops over all passages and items."""
    items = sorted({(i, t) for i, t in items if i is not None and t is not None})
    bags = [Counter(plain_words(t)) for _, t in items]
    df, n = Counter(w for b in bags for w in b), len(items)
    mean = sum(sum(b.values()) for b in bags) / max(n, 1)

    def score(words, k):
        b, length = bags[k], sum(bags[k].values())
        return sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * length / mean)) for w in words if w in b)

    def found(part, window):
        w = plain_words(part)
        k = max(1, min(5, len(w) // 2))
        wanted = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        have = {tuple(window[j : j + k]) for j in range(len(window) - k + 1)}
        return len(wanted & have) / len(wanted) if wanted else 1.0

    out, close = set(), set()
    for d, text in texts:
        w = plain_words(text)
        starts = range(0, max(1, len(w) - 32), 32) if w else ()
        for k, (i, t) in enumerate(items):
            length = sum(bags[k].values())
            if not length:
                continue
            limit = 0.5 * score(set(bags[k]), k) * min(1, 48 / length)
            passing = [(s, x) for s in starts for x in [score(set(w[s : s + 64]), k)] if x >= limit * (1 - 1e-7)]
            if not passing:
                continue
            window = w[max(0, passing[0][0] - length) : passing[-1][0] + 64 + length]
            q, a = decontamination.parts(t)
            if found(q, window) >= 0.5 and found(a, window) >= 0.5:
                out.add((d, i, round(max(x for _, x in passing), 5)))
    return out


@pytest.mark.parametrize("parts, passages", [(2000, 8192), (7, 8192), (7, 3)])
def test_leaks_whatever_the_parts(spark, monkeypatch, parts, passages):
    """Scores and leaks are those of one index, whatever the parts, the order of items and the passages at once."""
    monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", parts)
    monkeypatch.setattr(decontamination, "PASSAGES_AT_ONCE", passages)
    monkeypatch.setattr(decontamination, "PARTS_AT_ONCE", 2)
    r = random.Random(9)
    word = lambda: r.choice("the of a in to".split()) if r.random() < 0.4 else f"t{r.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(r.randrange(6, 90))) + ("? " + " ".join(word() for _ in range(r.randrange(1, 8))) if i % 2 else "")) for i in range(40)]
    items += [items[3], items[3], (3, "another text with this id of some length"), (None, "x y"), (50, None), (51, " ")]
    texts = []
    for d in range(60):
        own = [word() for _ in range(r.randrange(0, 200))]
        if d % 3:
            leak = plain_words(items[r.randrange(40)][1])
            if d % 3 == 2 and len(leak) > 8:
                leak[len(leak) // 3] = "changed"
            own[len(own) // 2 : len(own) // 2] = leak
        texts.append((d, " ".join(own)))
    r.shuffle(items)
    found = decontamination.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x.doc_id, leak.item_id, round(leak.score, 5)) for x in found for leak in x.leaks}
    assert got == plain_leaks(texts, items) and len(got) > 30


def test_leaks_edges(spark, odd):
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    assert decontamination.find_leaks(odd.where("false"), items).count() == 0
    assert all(r.leaks == [] for r in decontamination.find_leaks(odd, items.where("false")).collect())
    text = items.first().text
    long = spark.createDataFrame([(1, "pad " * 400_000 + text + " pad" * 400_000)], "doc_id long, text string")
    assert [x.item_id for x in decontamination.find_leaks(long, items).first().leaks] == [items.first().item_id]


# ---- pages -------------------------------------------------------------------------------------------


def test_deep_and_long_pages(spark):
    deep = [("<div>" * 10_000 + w + "</div>" * 10_000) for w in ("one", "two", "three")] + ["<b>" * 3000 + "x" + "<font>" * 3000 + "y"]
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    rows = [(i, "http://d.example/", h) for i, h in enumerate(deep)] + [(10, "http://l.example/", long), (11, None, "<p>a"), (12, "no host", "<p>b"), (None, "http://l.example/", None)]
    frame = spark.createDataFrame(rows + rows[-2:], "page_id long, url string, html string")
    got = sorted(((r.page_id is not None, r.page_id or 0, r.text) for r in html_extraction.extract_main_text(frame).collect()))
    assert len(got) == len(rows) + 2 and [t for _, i, t in got if i in (1, 2)] == ["two", "three"] and next(t for k, i, t in got if k and i == 10) == "\n".join(["word word"] * 50_000)
    assert html_extraction.extract_main_text(frame.where("false")).count() == 0


def test_long_lists_align_fast_and_exactly():
    r = random.Random(1)
    part = lambda n: "<ul>" + "".join(f"<li>{r.choice(['<b>x</b>', '<i>y</i>', '<b>a</b><i>q</i>', '<p>1</p><p>2</p>'])}</li>" for _ in range(n)) + "</ul>"
    x, y = html_extraction.parse(part(1500)), html_extraction.parse(part(1500))
    start, pairs = time.time(), []
    total = html_extraction.tree_match(x, y, pairs)
    assert total == len(pairs) and time.time() - start < 1

    def plain(a, b):
        if a.tag != b.tag:
            return 0
        c, d = a.elements(), b.elements()
        best = [[0] * (len(d) + 1) for _ in range(len(c) + 1)]
        for i, e in enumerate(c):
            for j, f in enumerate(d):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain(e, f))
        return 1 + best[-1][-1]

    tree = lambda n: "".join(f"<{t}>{tree(n - 1) if r.random() < 0.8 and n else ''}</{t}>" for t in [r.choice(["div", "b", "i"]) for _ in range(r.randrange(1, 4))])
    for _ in range(60):
        x, y = html_extraction.parse(tree(4)), html_extraction.parse(tree(4))
        pairs = []
        assert html_extraction.tree_match(x, y, pairs) == plain(x, y) == len(pairs)
        place = {id(n): k for k, n in enumerate(html_extraction.walk(x))}, {id(n): k for k, n in enumerate(html_extraction.walk(y))}
        order = sorted((place[0][id(a)], place[1][id(b)]) for a, b in pairs)
        assert order == sorted(order, key=lambda p: p[1]) and all(a.tag == b.tag for a, b in pairs)


def test_halved_tables_align_as_well(monkeypatch):
    r = np.random.default_rng(3)
    for _ in range(40):
        weight = r.integers(0, 4, (r.integers(1, 30), r.integers(1, 30)))
        monkeypatch.setattr(html_extraction, "TABLE", 1 << 22)
        whole = sum(weight[i, j] for i, j in html_extraction._align(weight))
        monkeypatch.setattr(html_extraction, "TABLE", 10)
        pairs = sorted(html_extraction._align(weight))
        assert sum(weight[i, j] for i, j in pairs) == whole == html_extraction._last_row(weight)[-1]
        assert [j for _, j in pairs] == sorted({j for _, j in pairs})


def test_the_wrapper_finds_the_content_alone(spark, monkeypatch):
    """Without landmarks, semantic tags, classes and roles alignment still gives the same texts; without it, none of them."""
    neutral = lambda h: re.sub(r'\s(class|id|role|aria-\w+)="[^"]*"', "", re.sub(r"<(/?)(article|main|nav|header|footer|aside|section|form)\b", r"<\1div", h))
    pages = [r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r.html]
    hosts = {}
    for p in pages:
        hosts.setdefault(re.sub(r"^[a-z]+://([^/]*).*", r"\1", p.url or ""), []).append(p.html)
    groups = [h for h in hosts.values() if len(h) >= 3]
    texts = lambda make: [t for g in groups for t in html_extraction.main_texts([html_extraction.parse(make(h)) for h in g])]
    want, got = texts(lambda h: h), texts(neutral)
    same = np.mean([a == b for a, b in zip(want, got, strict=True)])
    monkeypatch.setattr(html_extraction, "induce", lambda trees: None)
    without = np.mean([a == b for a, b in zip(want, texts(neutral), strict=True)])
    assert same > 0.9 and without < 0.1


# ---- joins, mixing, secrets ---------------------------------------------------------------------------


def test_links_of_the_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()} == linked(rows)


def duck_mix(rows):
    import pandas as pd

    c = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64", "text": "string", "source": "string"})
    c.register("documents", frame)
    return sorted((tuple(None if v is None or v != v else round(v, 6) for v in r) for r in c.sql(queries._OP8).fetchall()), key=repr)


def test_mixing_hot_rows(spark, monkeypatch):
    """A source of empty texts, one of rows that are all equal, and weights of all sizes: same rows as the SQL, no bucket too full."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    r = random.Random(4)
    rows = [(i, None if i % 2 else " ", "empty") for i in range(600)] + [(7, "same words here", "equal")] * 300
    rows += [(1000 + i, " ".join(r.choice(["word", "!!!", "?", "longer"]) for _ in range(r.randrange(30))), r.choice(["a", "b", None])) for i in range(400)]
    seen = []
    kept = frames.checkpointed
    monkeypatch.setattr(frames, "checkpointed", lambda df: seen.append(kept(df)) or seen[-1])
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "size", "source_size", "target", "taken")
    got = sorted((tuple(None if v is None else round(v, 6) for v in x) for x in out.collect()), key=repr)
    want = duck_mix(rows)
    assert len(got) == len(want) and [x for x in got if x[0] != 7] == [x for x in want if x[0] != 7]
    assert sum(x[4] for x in got if x[0] == 7) == sum(x[4] for x in want if x[0] == 7)
    sizes = [x["count"] for t in seen if "bucket" in t.columns for x in t.groupBy("bucket").count().collect()]
    assert sizes and max(sizes) <= 200


def plain_battery(token):
    """The tests' p-values by loops."""
    core = token.rstrip("=")
    name = next((k for k, (p, _) in secrets._ENCODINGS.items() if re.search(p, core)), None)
    if name is None:
        return None
    alphabet = secrets._ENCODINGS[name][1]
    low = core.lower() if name == "hex" else core
    n, size = len(low), len(alphabet)
    tail = lambda z: 0.5 * math.erfc(z / 2**0.5)
    squares = sum(low.count(c) ** 2 for c in alphabet)
    d = size - 1
    z = ((max(size / n * squares - n, 0) / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))
    half = lambda c: c in "01234" if name == "digits" else c.lower() < "n" if name in ("lower", "upper", "letters") else c.isdigit()
    changes = sum(half(a) != half(b) for a, b in zip(low, low[1:], strict=False))
    share = sum(c.isdigit() for c in alphabet) / size
    turn = 2 * share * (1 - share) if 0 < share < 1 else 0.5
    runs = 2 * tail(abs((changes - (n - 1) * turn) / math.sqrt((n - 1) * turn * (1 - turn))))
    place = np.array([alphabet.index(c) + 1 for c in low], float) - np.mean([alphabet.index(c) + 1 for c in low])
    spread = float((place**2).sum())
    serial = 2 * tail(abs(float((place[:-1] * place[1:]).sum()) / spread * math.sqrt(n) if spread else 99.0))
    return {"uniform": tail(z), "runs": runs, "serial": serial, "random": min(1.0, 3 * min(tail(z), runs, serial))}


def test_battery_against_loops(spark):
    r = random.Random(6)
    tokens = ["".join(r.choice(a) for _ in range(r.choice([20, 33, 64, 200]))) for _, a in secrets._ENCODINGS.values() for _ in range(8)]
    tokens += ["a" * 30, "0" * 25, "abcabcabcabcabcabcabcabc", "QUJDREVGR0hJSktMTU5PUA==", "mixed-and/both_signs+here", "getUserAccountSettingsFromDatabase"]
    rows = spark.createDataFrame(list(enumerate(tokens)), "i int, token string").select("i", secrets.battery(F.col("token")).alias("b")).collect()
    for x in rows:
        want = plain_battery(tokens[x.i])
        for test in ("uniform", "runs", "serial", "random"):
            assert x.b[test] is None if want is None else x.b[test] == pytest.approx(want[test], abs=2e-6), (tokens[x.i], test)


def test_secret_candidates_and_places(spark):
    """Tokens outside base spans are those of loops, their places too, in texts of thousands of matches, in time that grows with them."""
    r = random.Random(8)
    hexes = lambda n, chars: " ".join("".join(r.choice(chars) for _ in range(32)) for _ in range(n))
    mixed = " é🙂 ".join([hexes(500, "0123456789ABCDEF"), "password=" + hexes(1, "0123456789ABCDEF"), hexes(500, "0123456789abcdef"), hexes(500, "0123456789ABCDEF")])
    frame = spark.createDataFrame([(1, mixed)], "doc_id long, text string")
    found = [tuple(s) for s in secrets.secret_scan(frame).first().found]
    base = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{32,}", mixed)] + [(m.start(), 0, m.end()) for m in re.finditer("password=[0-9A-F]+", mixed)]
    assert sorted(s for s in found if s[1] < 3) == sorted(base)
    tokens = {(m.start(), 3, m.end()) for m in re.finditer(secrets.TOKEN, mixed) if not any(a < m.end() and m.start() < b for a, _, b in base)}
    added = {s for s in found if s[1] == 3}
    assert added <= tokens and len(added) > 0.9 * len(tokens) == 900.0
    accepted = {t for t in tokens if plain_battery(mixed[t[0] : t[2]])["random"] > secrets.ACCEPT}
    assert added <= accepted
    times = []
    for n in (40, 40, 4000):
        one = spark.createDataFrame([(1, hexes(n, "0123456789abcdef"))], "doc_id long, text string")
        start = time.time()
        assert secrets.secret_scan(one).first().n_hex == n
        times.append(time.time() - start)
    assert times[2] < times[1] + 3


# ---- pipeline ------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, docs, odd):
    """Each stage's kept documents and texts, on the small table with odd rows in it."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in df.collect()), key=repr)
    base = docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("n_chars", F.length("text").cast("long")))
    here = spark.createDataFrame(base.collect(), docs.schema)

    out = stages["toxicity"](spark, here, DIR)
    model = toxicity.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    want = [(i, t) for i, t in rows(here) if float(model.scores(np.array([model.features(t)]))[0]) < 0.3]
    assert rows(out) == sorted(want, key=repr) and 0 < len(want) < here.count() and out.columns == docs.columns

    here = spark.createDataFrame(out.collect(), docs.schema)
    out, sites, first = stages["line_dedup"](spark, here, DIR), {}, {}
    every = [(r.doc_id, r.text, r.source) for r in here.collect()]
    for i, t, s in every:
        for x in (t or "").split("\n"):
            if k := re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", x):
                sites.setdefault(k, set()).add(s)
                first[k] = min(first.get(k, math.inf), math.inf if i is None else i)
    gone = {k for k, v in sites.items() if len(v) >= 10}
    cut = lambda i, t: t if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c") not in gone or first[x.strip(" \t\n\r\x0b\x0c")] == i)
    assert rows(out) == sorted(((i if i is not None else -1, cut(i, t)) for i, t, _ in every), key=repr) and gone
    assert all(r.n_chars == len(r.text) for r in out.where("text is not null").collect())

    here = spark.createDataFrame(out.collect(), docs.schema)
    out = stages["ngram_join"](spark, here, DIR)
    named = {i: t for i, t in rows(here) if i >= 0}
    roots = linked(list(named.items()))
    kept = rows(out)
    assert {i for i, _ in kept if i >= 0} == {i for i in named if roots[i][1] == i} and [x for x in kept if x[0] < 0] == [x for x in rows(here) if x[0] < 0]
    assert Counter(i for i, _ in kept)[100_003] == 2  # rows that are equal stay together

    here = spark.createDataFrame(out.collect(), docs.schema)
    out = stages["decontamination"](spark, here, DIR)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    places = list(enumerate(t for _, t in rows(here)))
    dirty = {d for d, _, _ in plain_leaks(places, bench)}
    assert rows(out) == [x for k, x in enumerate(rows(here)) if k not in dirty] and dirty

    here = spark.createDataFrame(out.collect(), docs.schema)
    out = stages["mixing"](spark, here, DIR)
    got = sorted((tuple(None if v is None else round(v, 6) for v in x) for x in out.select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)
    assert got == duck_mix([(r.doc_id, r.text, r.source) for r in here.collect()])
    for name, stage in corpus_pipeline.STAGES:
        if name != "toxicity":
            assert stage(spark, here.where("false"), DIR).count() == 0


def test_md5_draws_are_reproducible(spark):
    u = spark.createDataFrame([(5, "abc")], "doc_id long, text string").select(mixing.uniform(F.col("doc_id"), F.col("text")).alias("u")).first().u
    digest = hashlib.md5(b"5:" + hashlib.md5(b"abc").hexdigest().encode()).hexdigest()
    assert u == (int(digest[:13], 16) + 0.5) / 2**52
