r"""Secret scans: three base patterns and a randomness test battery, with DataFrame functions only.

Base spans are what the patterns match, leftmost and without overlap per kind, that are long enough.  The method adds
spans of kind `random`: tokens of 20 or more characters of [A-Za-z0-9+/_=-] outside base spans that look drawn at random
from the alphabet of the encoding inferred for them, the smallest of _ENCODINGS that holds them (padding aside; a token
that mixes the signs of standard and URL-safe base64 has none):

* chi-squared test of uniformity over that alphabet (Wilson-Hilferty),
* runs test of letters against digits (of the halves of the alphabet, where it has only letters or only digits), and
* lag-one serial correlation of the alphabet places

give one p-value of randomness, three times the least of them, that must not reject at ACCEPT.  The statistic under
Benjamini-Hochberg control at FALSE_DISCOVERY, within bands of length, is 1 for a token that these tests reject, else the
p-value of natural identifiers: those change between letters and digits at about one place in ten, and about one in twelve
of their letters is one of RARE.  Both z-values are summed where both have meaning.  The bands' p-values are gathered
as counts by bin (at most BANDS * BINS rows), never as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.llm import frames

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS = 8, 16
ACCEPT, FALSE_DISCOVERY = 0.001, 0.001
CHANGE = 0.1  # share of places where a natural identifier changes between letters and digits
RARE, RARE_SHARE = "jkqvwxyz", 0.08  # letters that are rare in natural text, and their share of its letters at most
BANDS = (20, 24, 32, 48, 64, 128)
BINS = 64
#: Positions are summed in runs of so many matches.
STEP = 32

_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _once(frame: DataFrame, **columns: Column) -> DataFrame:
    """frame with the columns, each worked out once a row: a generator stands between them and what uses them.

    Plain projections are merged, and then every use of a column repeats its regular expressions.
    """
    kept = [F.col(c) for c in frame.columns if c not in columns]
    made = F.struct(*kept, *[c.alias(n) for n, c in columns.items()])
    return frame.select(F.explode(F.array(made)).alias("once")).select("once.*")


def _matches(text: Column, pattern: str, possible: Column, group: int = 0) -> Column:
    """The pattern's matches, their `group`s, and the pieces between them; null where there is none."""
    get = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    return F.when(possible & text.rlike(pattern), F.struct(get(0).alias("whole"), get(group).alias("value"), F.split(text, pattern).alias("between")))


def _starts(sizes: Column, levels: int = 3) -> Column:
    """Sum of all sizes before each, in STEP * levels steps an item: sums inside runs of STEP, and those of the runs before.

    An array longer than STEP ** (levels + 1) costs more; shorter ones use as few levels as they need.
    """
    upto = lambda a, lo, n: F.aggregate(F.slice(a, lo + 1, n), F.lit(0), lambda x, y: x + y)
    flat = lambda a: F.transform(a, lambda _, i: upto(a, F.lit(0), i))
    if not levels:
        return flat(sizes)

    def stepped(a: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / STEP).cast("int")), lambda k: upto(a, k * STEP, F.lit(STEP)))
        return _let(_starts(runs, levels - 1), lambda before: F.transform(a, lambda _, i: F.get(before, F.floor(i / STEP).cast("int")) + upto(a, i - i % STEP, i % STEP)))

    return _let(sizes, lambda a: F.when(F.size(a) <= STEP, flat(a)).otherwise(stepped(a)))


def _spans(m: Column, rank: int, least: int) -> Column:
    """Spans of the matches in code points; one stays if its group has `least` characters."""
    steps = F.zip_with(F.slice(m["between"], 1, F.size(m["whole"])), m["whole"], lambda b, x: F.length(b) + F.length(x))

    def place(before: Column) -> Column:
        return F.transform(m["whole"], lambda x, i: _let(F.get(before, i) + F.length(F.get(m["between"], i)), lambda start: F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x)).alias("end"), F.length(F.get(m["value"], i)).alias("n"))))

    found = F.filter(_let(_starts(steps), place), lambda s: s["n"] >= least)
    found = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return F.when(m.isNotNull(), found).otherwise(F.array().cast(_SPAN))


def _meets(spans: Column, start: Column, end: Column) -> Column:
    """Whether a span overlaps one of `spans`, which are ascending and apart: halving finds the first that ends after its start."""
    half = lambda lo, k: F.when((lo + k <= F.size(spans)) & (F.get(spans, lo + k - 1)["end"] <= start), lo + k).otherwise(lo)
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda k: k <= F.size(spans))
    return F.coalesce(_let(F.aggregate(steps, F.lit(0), half), lambda at: F.get(spans, at)["start"] < end), F.lit(False))


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), by Abramowitz and Stegun 7.1.26."""

    def tail(x: Column) -> Column:
        poly = lambda t: t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        return _let(1 / (1 + F.lit(0.3275911) * x), lambda t: 0.5 * poly(t) * F.exp(-x * x))

    return _let(z, lambda z: _let(tail(F.abs(z) / 2**0.5), lambda p: F.when(z > 0, p).otherwise(1 - p)))


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings in the order in which they are tried, smallest alphabets first, by the pattern of the token without padding.
_ENCODINGS = {
    "digits": ("^[0-9]+$", _DIGITS),
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "lower": ("^[a-z]+$", _LOWER),
    "upper": ("^[A-Z]+$", _UPPER),
    "base32": ("^[A-Z2-7]+$", _UPPER + "234567"),
    "lower36": ("^[a-z0-9]+$", _DIGITS + _LOWER),
    "upper36": ("^[A-Z0-9]+$", _DIGITS + _UPPER),
    "letters": ("^[A-Za-z]+$", _UPPER + _LOWER),
    "alnum": ("^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    "base64": ("^[A-Za-z0-9+/]+$", _DIGITS + _UPPER + _LOWER + "+/"),
    "base64url": ("^[A-Za-z0-9_-]+$", _DIGITS + _UPPER + _LOWER + "-_"),
}


def _by_encoding(encoding: Column, value) -> Column:
    """value(name, alphabet) of the encoding; null if it is null."""
    return F.element_at(F.create_map(*[F.lit(x) for name, (_, alphabet) in _ENCODINGS.items() for x in (name, value(name, alphabet))]), encoding)


def _turn(name: str, alphabet: str) -> float:
    """Share of places of a random token where the runs test sees a change."""
    digits = sum(c.isdigit() for c in alphabet) / len(alphabet)
    return 2 * digits * (1 - digits) if 0 < digits < 1 else 0.5


def battery(token: Column) -> Column:
    """Struct of n (padding aside), encoding, and p-values of a token: uniform, runs, serial, random (of randomness) and natural (of natural identifiers).

    The p-values are null for a token without an encoding.
    """
    core = F.rtrim(F.replace(token, F.lit("="), F.lit(" ")))  # tokens have no spaces
    return _let(core, lambda core: _let(_kind(core), _tests))


def _kind(core: Column) -> Column:
    encoding = F.lit(None).cast("string")
    for name, (pattern, _) in reversed(_ENCODINGS.items()):
        encoding = F.when(core.rlike(pattern), name).otherwise(encoding)
    return F.struct(core.alias("core"), encoding.alias("encoding"))


def _tests(k: Column) -> Column:
    encoding = k["encoding"]
    low = F.when(encoding == "hex", F.lower(k["core"])).otherwise(k["core"])
    alphabet = _by_encoding(encoding, lambda _, a: a)
    halves = encoding.isin("digits", "lower", "upper", "letters")
    # a letter a for the first half and a digit for the second, where the alphabet has one class only
    split = F.when(encoding == "digits", F.translate(low, "01234", "aaaaa")).otherwise(F.translate(F.lower(low), "nopqrstuvwxyz", "0" * 13))
    changes = F.size(F.regexp_extract_all(F.when(halves, split).otherwise(low), F.lit("[0-9]+|[^0-9]+"), F.lit(0))).cast("double") - 1
    first = F.struct(F.length(low).cast("double").alias("n"), encoding.alias("encoding"), alphabet.alias("alphabet"), low.alias("low"), changes.alias("changes"))
    return _let(first, _p_values)


def _p_values(s: Column) -> Column:
    n, size, low, encoding = s["n"], F.length(s["alphabet"]).cast("double"), s["low"], s["encoding"]
    symbols = F.transform(F.sequence(F.lit(1), F.length(s["alphabet"])), lambda i: F.substring(s["alphabet"], i, F.lit(1)))
    count = lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))).cast("double")
    squares = F.aggregate(F.transform(symbols, count), F.lit(0.0), lambda a, c: a + c * c)
    degrees = size - 1
    z_uniform = (F.pow(F.greatest(size / n * squares - n, F.lit(0.0)) / degrees, F.lit(1 / 3)) - (1 - 2 / (9 * degrees))) / F.sqrt(2 / (9 * degrees))
    z_changes = lambda turn: (s["changes"] - (n - 1) * turn) / F.sqrt((n - 1) * turn * (1 - turn))
    place = F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.instr(s["alphabet"], F.substring(low, i, F.lit(1))).cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def serial(centred: Column) -> Column:
        spread = total(F.transform(centred, lambda x: x * x))
        lagged = total(F.zip_with(F.slice(centred, 1, F.size(centred) - 1), F.slice(centred, 2, F.size(centred) - 1), lambda x, y: x * y))
        return F.when(spread > 0, lagged / spread * F.sqrt(n)).when(spread == 0, F.lit(99.0))

    centred = _let(place, lambda p: _let(total(p) / n, lambda mean: F.transform(p, lambda x: x - mean)))
    letters = F.length(F.regexp_replace(low, "[^A-Za-z]", "")).cast("double")
    rare = F.length(F.regexp_replace(F.lower(low), f"[^{RARE}]", "")).cast("double")
    z_rare = (rare - letters * RARE_SHARE) / F.sqrt(F.greatest(letters, F.lit(1.0)) * RARE_SHARE * (1 - RARE_SHARE))
    natural = F.when(encoding.isin("hex", "digits"), z_changes(F.lit(CHANGE))).when(encoding.isin("lower", "upper", "letters"), z_rare).otherwise((z_changes(F.lit(CHANGE)) + z_rare) / 2**0.5)
    p = F.struct(n.cast("int").alias("n"), encoding.alias("encoding"), _upper_tail(z_uniform).alias("uniform"), (2 * _upper_tail(F.abs(z_changes(_by_encoding(encoding, _turn))))).alias("runs"), (2 * _upper_tail(F.abs(_let(centred, serial)))).alias("serial"), _upper_tail(natural).alias("natural"))
    random = lambda p: F.when(p["encoding"].isNotNull(), F.least(F.lit(1.0), 3 * F.least(p["uniform"], p["runs"], p["serial"])))
    return _let(p, lambda p: F.struct(*[p[c].alias(c) for c in ("n", "encoding", "uniform", "runs", "serial", "natural")], random(p).alias("random")))


def statistic(b: Column) -> Column:
    """The p-value under control: 1 unless the tests let the token be random."""
    return F.when(b["random"] > ACCEPT, b["natural"]).otherwise(1.0)


def _band(n: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(BANDS):
        out = F.when(n >= least, k).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    """Half powers of two: 0 for p = 1, BINS - 1 for the least."""
    return F.least(F.lit(BINS - 1), F.floor(-2 * F.log2(F.greatest(p, F.lit(1e-12)))).cast("int"))


def thresholds(tokens: DataFrame) -> dict[int, int]:
    """For each band the least bin whose tokens are discoveries, from (n, p) of all candidates."""
    counted = tokens.groupBy(_band(F.col("n")).alias("band"), _bin(F.col("p")).alias("bin")).count().collect()  # at most len(BANDS) * BINS rows
    out = {}
    for band in range(len(BANDS)):
        counts = {r["bin"]: r["count"] for r in counted if r["band"] == band}
        total, so_far, found = sum(counts.values()), 0, BINS
        for b in sorted(counts, reverse=True):
            so_far += counts[b]
            if 2 ** (-b / 2) <= FALSE_DISCOVERY * so_far / total:  # the largest p-value that bin can hold
                found = b
        out[band] = found
    return out


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of likely secrets in each text: doc_id, n_assign, n_access, n_hex, n_random, found.

    `found` is an array of (start, rank, end), ascending: code points, end exclusive; rank is the place in KINDS.  A null
    text is empty and has none.  Repeated rows each give a row; a null doc_id is kept.  An empty table gives none.  Other
    columns are not read.  No shuffle but that of the bins; texts are read once, and spans and tokens written.  Work grows
    with the length of a text and the number of its matches, not with their square.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("t"))
    text, yes, small = F.col("t"), F.lit(True), F.lower("t")
    hinted = small.contains("passw") | small.contains("secret") | small.contains("token") | small.contains("api")
    rows = _once(rows, m0=_matches(text, ASSIGN, hinted, group=2), m1=_matches(text, ACCESS, text.contains("AKIA")), m2=_matches(text, HEX, yes), m3=_matches(text, TOKEN, yes)).drop("t")
    rows = _once(rows, b0=_spans(F.col("m0"), 0, LEAST_VALUE), b1=_spans(F.col("m1"), 1, LEAST_ACCESS), b2=_spans(F.col("m2"), 2, 32), tokens=_spans(F.col("m3"), 3, 20))
    token = F.col("m3.whole")
    pairs = F.zip_with("tokens", F.coalesce(token, F.array().cast("array<string>")), lambda s, x: F.struct(s.alias("span"), x.alias("token")))
    free = F.filter(pairs, lambda p: ~(_meets(F.col("b0"), p["span"]["start"], p["span"]["end"]) | _meets(F.col("b1"), p["span"]["start"], p["span"]["end"]) | _meets(F.col("b2"), p["span"]["start"], p["span"]["end"])))
    rows = frames.checkpointed(rows.select("doc_id", F.concat("b0", "b1", "b2").alias("base"), F.when(F.size("tokens") > 0, free).alias("free")))
    tested = rows.where(F.size("free") > 0).select(F.explode("free").alias("f")).select(battery(F.col("f.token")).alias("b")).select("b.n", statistic(F.col("b")).alias("p"))
    cut = thresholds(tested)

    def random(b: Column) -> Column:
        least = F.element_at(F.array(*[F.lit(cut[k]) for k in range(len(BANDS))]), _band(b["n"]) + 1)
        return _bin(statistic(b)) >= least

    tests = F.transform("free", lambda p: F.struct(p["span"].alias("span"), battery(p["token"]).alias("b")))
    rows = _once(rows, tests=F.when(F.size("free") > 0, tests))
    added = F.when(F.col("tests").isNotNull(), F.transform(F.filter("tests", lambda x: random(x["b"])), lambda x: x["span"])).otherwise(F.array().cast(_SPAN))
    found = _once(rows.select("doc_id", "base", "tests"), found=F.array_sort(F.concat("base", added)))
    count = lambda k: F.size(F.filter("found", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], "found")


def as_text(found: Column, kinds: int = len(KINDS)) -> Column:
    """kind:start:end of the first `kinds` kinds, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    part = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.filter(found, lambda s: s["rank"] < kinds), part), ",")
