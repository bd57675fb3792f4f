"""Toxicity: a learnt lexicon in a trie, met by Levenshtein automata, and a score from the hits' contexts.

`fit` learns terms (words, and stems that many inflected forms share) that occur in toxic documents far more often than
in clean ones, from a bounded sample of labelled rows.  `score_toxicity` looks every distinct token of a text up in the
trie of terms: a Levenshtein automaton of the token runs over the trie, so exact, inflected and misspelled terms are found in
one walk.  Each hit is weighed by its context window: inside quotation marks, or after a word of reporting, it is a
quotation rather than abuse.  A logistic regression on the counts of hits by kind gives the score; where the sample says
nothing of misspelled or quoted hits, they weigh a set share of what a word does.

Texts are counted and met on the executors; the driver gets the lexicon and four numbers for each row of the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.llm import frames
from casegrain.llm.labelled import held_out, sample

#: At most so many labelled rows of each class are learnt from.
SAMPLE_ROWS = 4000
WINDOW = 6
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’‹›…–—¿¡"
_OPEN = re.compile(r"^[\"'“„«‘‹]")
_CLOSE = re.compile(r"[\"'”“»’›][.,;:!?]*$")
#: Share of a used word's weight that a misspelled hit, and a quoted one, has unless the sample says otherwise.
MISSPELT_SHARE, QUOTED_SHARE = 0.75, 0.25
#: Tokens of fewer letters are met exactly only: within one edit of three letters stands half a language.
SHORTEST = 4
#: Words of reporting speech, a parameter of `fit`: a term soon after one is reported, not used.
REPORTING = frozenset("said says quote quoted quotes wrote called term word saying sagte schrieb nannte wort zitat dit écrit mot terme appelé dijo escribió palabra término llamó".split())
#: So many tokens, and moves of the automaton, are kept at most; then they are met anew.
_CACHE, _MOVES = 1 << 16, 1 << 18


class Trie:
    """Terms by letter; a node's kind is 1 where a word ends, 2 where a stem does, 4 where a form of a stem does.

    `find` runs the product of the trie and the Levenshtein automaton (with swaps of neighbours) of `edits` edits.  Its
    states are sets of (node, edits so far, letter owed by a swap); they are made when first met and kept, so a token costs
    a dictionary look-up a letter, and most tokens die after a few.
    """

    def __init__(self, edits: int = 1, shortest: int = SHORTEST):
        self.edits, self.shortest = edits, shortest
        self.children: list[dict[str, int]] = [{}]
        self.kind: list[int] = [0]
        self.moves: dict[tuple[frozenset, str], frozenset] = {}

    def add(self, term: str, kind: int) -> None:
        node = 0
        for letter in term:
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.kind)
                self.children.append({})
                self.kind.append(0)
            node = self.children[node][letter]
        self.kind[node] |= kind

    def _skips(self, states: set) -> frozenset:
        """With the states that leaving out letters of a term reaches; of each node the fewest edits."""
        stack = list(states)
        while stack:
            node, used, owed = stack.pop()
            if used < self.edits and not owed:
                new = {(n, used + 1, "") for n in self.children[node].values()} - states
                states |= new
                stack += new
        least: dict[tuple[int, str], int] = {}
        for node, used, owed in states:
            least[node, owed] = min(used, least.get((node, owed), used))
        return frozenset((node, used, owed) for (node, owed), used in least.items())

    def _move(self, states: frozenset, letter: str) -> frozenset:
        out = set()
        for node, used, owed in states:
            if owed:
                if owed == letter:
                    out.add((node, used, ""))
                continue
            near = self.children[node]
            if letter in near:
                out.add((near[letter], used, ""))
            if used < self.edits:
                out.add((node, used + 1, ""))
                out |= {(n, used + 1, "") for n in near.values()}
                out |= {(self.children[n][letter], used + 1, c) for c, n in near.items() if letter in self.children[n] and c != letter}
        return self._skips(out)

    def find(self, token: str) -> int:
        """1 a word of the lexicon, 2 a form of a stem, 3 within the edits of a word or of a form, 0 none of those."""
        node, stem = 0, False
        for letter in token:
            node = self.children[node].get(letter, -1)
            if node < 0:
                break
            stem |= bool(self.kind[node] & 2)
        else:
            if self.kind[node] & 1:
                return 1
        if stem:
            return 2
        if len(token) < self.shortest:
            return 0
        moves = self.moves
        states = moves.get((frozenset(), ""))
        if states is None:
            states = moves[frozenset(), ""] = self._skips({(0, 0, "")})
        for letter in token:
            after = moves.get((states, letter))
            if after is None:
                if len(moves) >= _MOVES:
                    return self._slow(states, token)
                after = moves[states, letter] = self._move(states, letter)
            states = after
            if not states:
                return 0
        return 3 * any(not owed and self.kind[node] & 5 for node, _, owed in states)

    def _slow(self, _: frozenset, token: str) -> int:
        self.moves.clear()
        return self.find(token)


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    plain: frozenset[str]  # words of clean texts, which are no misspellings
    weights: np.ndarray
    edits: int = 1
    shortest: int = SHORTEST
    reporting: frozenset[str] = REPORTING

    def __post_init__(self) -> None:
        self.trie, self.cache = Trie(self.edits, self.shortest), {}
        for w in self.words:
            self.trie.add(w, 4 if any(w.startswith(s) for s in self.stems) else 1)
        for w in self.stems:
            self.trie.add(w, 2)

    def parts(self) -> tuple:
        """What Model() takes to make it again."""
        return self.words, self.stems, self.plain, self.weights, self.edits, self.shortest, self.reporting

    def kind(self, token: str) -> int:
        found = self.cache.get(token)
        if found is None:
            bare = token.strip(_EDGE)
            found = self.trie.find(bare) if bare else 0
            if found == 3 and bare in self.plain:
                found = 0
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            self.cache[token] = found
        return found

    def features(self, text: str | None) -> list[float]:
        """Hits used as words, stems, misspellings, and hits in quotation; each log(1 + count)."""
        tokens = (text or "").lower().split()
        cache = self.cache
        hits = {t for t in set(tokens) if cache.get(t) or (t not in cache and self.kind(t))}
        counts = [0.0] * 4
        if hits:
            for i, t in enumerate(tokens):
                if t in hits:
                    counts[3 if quoted(tokens, i, reporting=self.reporting) else self.kind(t) - 1] += 1
        return [float(np.log1p(c)) for c in counts]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def quoted(tokens: list[str], i: int, window: int = WINDOW, reporting: frozenset[str] = REPORTING) -> bool:
    """Whether the token stands in quotation marks that open and close within the window, or soon after a word of reporting."""
    near = tokens[max(0, i - window) : i + 1]
    opened = any(_OPEN.search(t) for t in near)
    closed_before = any(_CLOSE.search(t) for t in near[:-1])
    if opened and not closed_before and any(_CLOSE.search(t) for t in tokens[i : i + window]):
        return True
    return any(t.strip(_EDGE) in reporting for t in near[:-1])


def _terms(text: str) -> tuple[set[str], set[str]]:
    """The distinct bare words of a text, and their beginnings of 4 to 8 letters that are shorter than a word."""
    bare = {t.strip(_EDGE) for t in text.lower().split()}
    return bare, {w[:k] for w in bare for k in range(4, min(len(w), 9))}


def _telling(toxic, clean, n: tuple[int, int], least: float, times: float):
    """Whether a term of so many toxic and clean rows is that much likelier in toxic ones; numbers or columns."""
    return (toxic >= max(least, 0.01 * n[1])) & (toxic / n[1] >= times * (clean + 0.1) / n[0])


def _likely(toxic, clean, n: tuple[int, int]):
    return _telling(toxic, clean, n, max(5, 0.03 * n[1]), 50)


def _stems(forms: dict[str, int]) -> list[str]:
    """Beginnings that three or more inflected forms share, the shortest of those that hold each other."""
    out: set[str] = set()
    for s in sorted(forms, key=lambda s: (len(s), s)):
        if forms[s] >= 3 and not any(s[:k] in out for k in range(4, len(s))):
            out.add(s)
    return sorted(out)


def _weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps of a logistic regression; the penalty draws misspelled and quoted hits to their shares of a word's weight."""
    x = np.hstack([np.ones((len(x), 1)), x])
    away = np.eye(5)
    away[3, 1], away[4, 1] = -MISSPELT_SHARE, -QUOTED_SHARE
    penalty, w = 0.1 * away.T @ away, np.zeros(5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _constant(n: tuple[int, int]) -> Model:
    """Without rows of both classes every score is the share of toxic rows."""
    share = float(np.clip(n[1] / max(1, sum(n)), 0.001, 0.999))
    return Model([], [], frozenset(), np.array([np.log(share / (1 - share)), 0, 0, 0, 0]))


def learn(rows: list[tuple[int, str]], **settings) -> Model:
    """The model from (label, text) rows: what `fit` does, in one process; settings are the Model's edits, shortest and reporting."""
    n = tuple(sum(1 for y, _ in rows if y == k) for k in (0, 1))
    if not all(n):
        return _constant(n)
    words, starts = (Counter(), Counter()), (Counter(), Counter())
    for y, text in rows:
        bare, begin = _terms(text)
        words[y].update(bare)
        starts[y].update(begin)
    likely = {s for s, c in starts[1].items() if _likely(c, starts[0][s], n)}
    forms = Counter(w[:k] for w, c in words[1].items() if c > 1 for k in range(4, min(len(w), 9)) if w[:k] in likely)
    lexicon = sorted(w for w, c in words[1].items() if len(w) > 2 and _telling(c, words[0][w], n, 4, 20))  # forms of stems too, for their misspellings
    plain = frozenset(w for w, c in words[0].items() if c >= 2)
    model = Model(lexicon, _stems(forms), plain, np.zeros(5), **settings)
    model.weights = _weights(np.array([model.features(text) for _, text in rows]), np.array([y for y, _ in rows], float))
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, start, toxic, clean): in how many rows of a batch of the sample each term is."""
    for batch in batches:
        found: dict[tuple[str, bool], list[int]] = {}
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text"), strict=True):
            for start, terms in enumerate(_terms(text.as_py())):
                for t in terms:
                    found.setdefault((t, bool(start)), [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], pa.bool_()), pa.array([c[1] for c in found.values()], pa.int64()), pa.array([c[0] for c in found.values()], pa.int64())], names=["term", "start", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, **settings) -> Model:
    """Learn from at most `rows` labelled rows of each class, never from held-out ones; the same model as `learn` of those rows.

    Settings are the Model's edits, shortest and reporting.
    """
    spark = docs.sparkSession
    found = frames.checkpointed(sample(docs, labels, "toxic", rows))
    by_class = {r["y"]: r["count"] for r in found.groupBy("y").count().collect()}
    n = by_class.get(0, 0), by_class.get(1, 0)
    if not all(n):
        return _constant(n)
    counted = frames.map_batches(found.select("y", "text"), _counted, "term string, start boolean, toxic long, clean long")
    counted = frames.checkpointed(counted.groupBy("term", "start").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    toxic, clean = F.col("toxic"), F.col("clean")
    words = counted.where("not start")
    likely = counted.where("start").where(_likely(toxic, clean, n)).select("term")
    begin = F.explode(F.transform(F.sequence(F.lit(4), F.least(F.length("term"), F.lit(9)) - 1), lambda k: F.substring("term", F.lit(1), k)))
    forms = words.where((toxic > 1) & (F.length("term") > 4)).select(begin.alias("term")).join(likely, "term").groupBy("term").count().where("count >= 3").collect()
    lexicon = words.where((F.length("term") > 2) & _telling(toxic, clean, n, 4, 20)).select("term").collect()
    model = Model(sorted(r["term"] for r in lexicon), _stems({r["term"]: r["count"] for r in forms}), frozenset(), np.zeros(5), **settings)
    parts = spark.sparkContext.broadcast(model.parts())  # bounded by the sample

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Model(*parts.value).trie
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t for t in batch.column("term").to_pylist() if trie.find(t) == 3], pa.string())], names=["term"])

    plain = frames.map_batches(words.where(clean >= 2).select("term"), near, "term string").collect()  # the others are no hits anyway
    model = Model(*model.parts()[:2], frozenset(r["term"] for r in plain), *model.parts()[3:])
    shared = spark.sparkContext.broadcast(model.parts())

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            x = np.array([own.features(t.as_py()) for t in batch.column("text")]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("y"), *[pa.array(c) for c in x.T]], names=["y", "w", "s", "m", "q"])

    x = frames.map_batches(found.select("y", "text"), hits, "y int, w double, s double, m double, q double").orderBy("y", "w", "s", "m", "q").toArrow()
    model.weights = _weights(np.stack([np.asarray(x.column(c)) for c in "wsmq"], axis=1), np.asarray(x.column("y"), float))
    frames.forget(found, counted)
    return model


def _scorer(spark, model: Model, schema: pa.Schema, text: str):
    shared = spark.sparkContext.broadcast(model.parts())  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            x = np.array([own.features(t.as_py()) for t in batch.column(text)]).reshape(-1, 4)
            columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != text]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own.scores(x))], schema=schema)

    return run


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", score: str = "score", threshold: float = 0.3) -> DataFrame:
    """`docs` with two more columns: `score` (0 to 1) and predicted (1 if score >= threshold).

    Only the text is an input of the score.  A null or empty text has no hits and gets the score of such texts.  Columns
    of docs named like the new ones are replaced; others keep their values.  No shuffle; rows are independent.
    """
    kept = [c for c in docs.columns if c.lower() not in (score.lower(), "predicted")]
    own = frames.fresh_name([*docs.columns, score, "predicted"], "text")
    frame = docs.select(*[docs[f"`{c}`"] for c in kept], docs[text].cast("string").alias(own))
    out = frame.drop(own).withColumn(score, F.lit(0.0))
    schema = _arrow(out)
    return frames.map_batches(frame, _scorer(docs.sparkSession, model, schema, own), out.schema).withColumn("predicted", (F.col(score) >= threshold).cast("int"))


def _arrow(frame: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.schema([f.with_nullable(True) for f in to_arrow_schema(frame.schema)])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
