"""Operator 1, secret scans: patterns plus a battery of randomness tests, in DataFrame functions only.

Patterns (``assign``, ``access``, ``hex``) are matched leftmost and without overlap, each on its own; matches that are
too short are dropped after matching. All further runs of MIN_LENGTH or more encoding characters are inferred to be in
one of the ENCODINGS (hexadecimal, base 32, base 36, base 64; the smallest alphabet that holds all characters, with
letters and digits, and both cases for base 64); of runs that fit none, the parts between / - and _ are judged. The
battery measures how far a run is from uniformly random characters of its encoding:

* chi-squared tests on eight near-equal bins of the alphabet (Wilson-Hilferty normal form) and on its kinds of characters
  (capitals, small letters, others),
* a runs test on the halves of the alphabet,
* a lag-1 serial correlation test on the alphabet positions,

joined by Fisher's method (eight degrees of freedom, closed form). A discovery is a run that is too random to be ordinary.
What the battery gives for ordinary text is learnt from the corpus: every document gives decoys, some of its words from a
place chosen by hash, written in an encoding and cut to each length class, with a number behind them. In each stratum
(encoding and length class), a run's p-value is the share of decoys that look at least as random, (1 + those) / (1 + all),
and the Benjamini-Hochberg rule at FDR decides which runs are reported as kind ``random``. So the share of ordinary runs
among the reported ones is bounded, as far as ordinary runs are like decoys. Length classes have levels of their own: short
runs, on which the battery is weak, have decoys that look as random as secrets do, and are then not reported. A stratum
without decoys reports nothing. Results of the battery are binned by 1/GRID of a decade for the rule, so what is gathered
is at most BINS rows a stratum, however large the corpus.

Null and empty texts have no spans. Repeated rows and null ids are scanned row by row. Offsets are code points, ends
exclusive. Other columns are ignored. An empty table gives an empty result. Texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import cut

#: Fixed patterns of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

MIN_LENGTH, FDR, GRID, BINS = 24, 0.1, 50, 800
RUN, PART = rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}", rf"[A-Za-z0-9+]{{{MIN_LENGTH},}}"
#: Length classes: the least length of each and the number of lengths that decoys of it have; characters that decoys are taken from.
CLASSES, STRETCH = ((24, 8), (32, 16), (48, 32), (80, 80)), 400

LETTERS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Name, alphabet, and the pattern of runs in it; the first that fits is taken.
ENCODINGS = (
    ("hex", DIGITS + "abcdef", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$"),
    ("HEX", DIGITS + "ABCDEF", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$"),
    ("base32", LETTERS + "234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$"),
    ("base36", DIGITS + LETTERS.lower(), r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$"),
    ("BASE36", DIGITS + LETTERS, r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$"),
    ("base64", LETTERS + LETTERS.lower() + DIGITS + "+/", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$"),
    ("base64url", LETTERS + LETTERS.lower() + DIGITS + "-_", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$"),
)


def _found(text: Column, pattern: str, gate: Column, group: int = 0) -> Column:
    """All matches in order, as structs of start, end and the group's text. Texts that fail the gate aren't scanned."""
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("skip"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    none = F.array().cast("array<struct<start:int,end:int,part:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["skip"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["part"].alias("part"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    fold = F.aggregate(F.filter(zipped, lambda x: x["hit"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(gate, fold).otherwise(none)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, whatever number of times body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _upper_tail(z: Column) -> Column:
    """P(N > z), by the five-term polynomial of Abramowitz and Stegun 26.2.17 (absolute error below 1e-7)."""
    poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = lambda z: _let(1 / (1 + 0.2316419 * F.abs(z)), poly) * F.exp(-z * z / 2) * 0.3989422804014327
    return _let(z, lambda z: _let(tail(z), lambda q: F.when(z >= 0, q).otherwise(1 - q)))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def _kind_shares(alphabet: str) -> list[tuple[str, float]]:
    """The patterns of the kinds of characters that an alphabet has, and their shares of it."""
    kinds = (("[A-Z]", sum(c in LETTERS for c in alphabet)), ("[a-z]", sum(c in LETTERS.lower() for c in alphabet)))
    rest = len(alphabet) - sum(n for _, n in kinds)
    return [(k, n / len(alphabet)) for k, n in (*kinds, ("[^A-Za-z]", rest)) if n]


def _encoding(token: Column) -> Column:
    """The first encoding that fits, with its alphabet dealt to eight bins and two halves; null if none does."""
    out = None
    for k, (_, alphabet, pattern) in enumerate(ENCODINGS):
        size = len(alphabet)
        bins = [8 * i // size for i in range(size)]
        value = F.struct(
            F.lit(k).alias("k"), F.lit(alphabet).alias("alphabet"), F.lit("".join(map(str, bins))).alias("bins"), F.lit("".join("01"[2 * i >= size] for i in range(size))).alias("halves"),
            F.array(*(F.struct(F.lit(str(b)).alias("bin"), F.lit(bins.count(b) / size).alias("share")) for b in range(8))).alias("shares"),
            F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(share).alias("share")) for k, share in _kind_shares(alphabet))).alias("kinds"),
        )
        out = F.when(token.rlike(pattern), value) if out is None else out.when(token.rlike(pattern), value)
    return out


def _without(text: Column, what: Column) -> Column:
    return F.length(F.replace(text, what, F.lit(""))).cast("double")


def _chi_squared(binned: Column, shares: Column, n: Column) -> Column:
    term = lambda s, x: s + F.pow(n - _without(binned, x["bin"]) - n * x["share"], F.lit(2.0)) / (n * x["share"])
    return (F.pow(F.aggregate(shares, F.lit(0.0), term) / 7, F.lit(1 / 3)) - (1 - 2 / 63)) / (2 / 63) ** 0.5


def _kinds(token: Column, kinds: Column, n: Column) -> Column:
    """The p-value of the chi-squared test on kinds of characters, with one or two degrees of freedom."""
    seen = lambda k: n - F.length(F.call_function("regexp_replace", token, k["kind"], F.lit("")))
    chi = F.aggregate(kinds, F.lit(0.0), lambda s, k: s + F.pow(seen(k) - n * k["share"], F.lit(2.0)) / (n * k["share"]))
    return _let(chi, lambda x: F.when(F.size(kinds) > 2, F.exp(-x / 2)).otherwise(_two_sided(F.sqrt(x))))


def _runs(half: Column, n: Column) -> Column:
    z = lambda mean: _let((mean - 1) * (mean - 2) / (n - 1), lambda var: F.when(var > 0, (F.length(F.regexp_replace(half, "0+|1+", "x")) - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.lit(9.0)))
    return _let(_without(half, F.lit("0")), lambda n1: _let(2 * n1 * (n - n1) / n + 1, z))


def _serial(token: Column, alphabet: Column, n: Column) -> Column:
    """From running sums: of places, of their squares, of products of neighbours; first and last."""
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("first", "last", "s", "s2", "sp")), F.lit(True).alias("new"))

    def add(acc: Column, c: Column) -> Column:
        step = lambda x: F.struct(F.when(acc["new"], x).otherwise(acc["first"]).alias("first"), x.alias("last"), (acc["s"] + x).alias("s"), (acc["s2"] + x * x).alias("s2"), (acc["sp"] + F.when(acc["new"], 0.0).otherwise(acc["last"] * x)).alias("sp"), F.lit(False).alias("new"))
        return _let(F.call_function("instr", alphabet, c).cast("double"), step)

    def close(acc: Column) -> Column:
        m = acc["s"] / n
        lagged = acc["sp"] - m * (2 * acc["s"] - acc["first"] - acc["last"]) + (n - 1) * m * m
        return _let(acc["s2"] - m * acc["s"], lambda sq: F.when(sq > 0, (lagged / F.greatest(sq, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0)))

    return F.aggregate(F.split(token, ""), zero, add, close)


def _battery(token: Column, e: Column) -> Column:
    """The combined p-value of the tests for a token in its encoding, were it uniformly random."""
    mapped = lambda to: F.call_function("translate", token, e["alphabet"], e[to])
    minus_log = lambda p: -F.log(F.greatest(p, F.lit(1e-15)))

    def fisher(n: Column) -> Column:
        p = (_upper_tail(_chi_squared(mapped("bins"), e["shares"], n)), _kinds(token, e["kinds"], n), _two_sided(_runs(mapped("halves"), n)), _two_sided(_serial(token, e["alphabet"], n)))
        return _let(sum(map(minus_log, p), F.lit(0.0)), lambda h: F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6))

    return _let(F.length(token).cast("double"), fisher)


def _length_class(n: Column) -> Column:
    return F.when(n < CLASSES[1][0], 0).when(n < CLASSES[2][0], 1).when(n < CLASSES[3][0], 2).otherwise(3)


def _judged(part: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body of the stratum and the battery's bin of a run (null and null if it is in no encoding)."""
    log_bin = lambda e: F.least(F.lit(BINS - 1), F.floor(-F.log10(F.greatest(_battery(part, e), F.lit(1e-15))) * GRID)).cast("int")
    stratum = lambda e: 4 * e["k"] + _length_class(F.length(part))
    return _let(_encoding(part), lambda e: body(stratum(e), F.when(e.isNotNull(), log_bin(e))))


def _mixed(part: Column) -> Column:
    return part.rlike("[0-9]") & part.rlike("[A-Za-z]")


def _parts(run: Column) -> Column:
    """A run that is in an encoding, or else its parts between / - and _ that may be."""
    fits = _encoding(run["part"]).isNotNull()
    shifted = lambda y: F.struct((run["start"] + y["start"]).alias("start"), (run["start"] + y["end"]).alias("end"), y["part"].alias("part"))
    inner = F.filter(_found(run["part"], PART, F.lit(True)), lambda y: _mixed(y["part"]))
    return F.when(fits, F.array(run)).otherwise(F.transform(inner, shifted))


def _decoys(text: Column, number: Column) -> Column:
    """Two ordinary runs: words of a stretch of the text, in base 64 or (every other text) any encoding, in two length classes; stratum and bin."""
    start = 1 + F.pmod(number, F.greatest(F.lit(1), F.length(text) - STRETCH))
    words = F.regexp_extract_all(F.substr(text, start.cast("int"), F.lit(STRETCH)), F.lit("[A-Za-z]{2,}"), F.lit(0))
    digits = F.pmod(F.shiftright(number, 7), F.lit(10_000)).cast("string")
    few = F.translate(digits, "0189", "2367")

    def written(words: Column) -> Column:
        camel = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
        plain = F.lower(F.array_join(words, ""))
        hexed = F.translate(plain, LETTERS.lower(), "0123456789abcdef0123456789")
        forms = (  # in the order of ENCODINGS: the text, what stands behind it
            (hexed, digits), (F.upper(hexed), digits), (F.upper(plain), few), (plain, digits), (F.upper(plain), digits),
            (F.array_join(camel, ""), digits), (F.array_join(camel, "_"), digits),
        )
        turn = lambda bits, n: F.pmod(F.shiftright(number, bits), F.lit(n)).cast("int")
        which = F.when(turn(17, 2) == 0, F.lit(5)).otherwise(turn(23, len(forms)))
        form = lambda part: reduce(lambda c, k: c.when(which == k, forms[k][part]), range(1, len(forms)), F.when(which == 0, forms[0][part]))
        least = F.array(*(F.lit(n) for n, _ in CLASSES))
        some = F.array(*(F.lit(n) for _, n in CLASSES))
        sizes = F.transform(F.array(turn(29, 4), F.pmod(turn(29, 4) + 2, F.lit(4))), lambda c: F.get(least, c) + F.pmod(F.shiftright(number, 31), F.get(some, c)).cast("int"))
        cut_to = lambda body, tail, n: F.when(F.length(body) >= n, F.concat(F.substr(body, F.lit(1), n - F.length(tail)), tail))
        return _let(form(0), lambda body: F.transform(sizes, lambda n: cut_to(body, form(1), n)))

    runs = F.filter(_let(words, written), lambda x: x.isNotNull())
    found = F.transform(runs, lambda x: _judged(x, lambda stratum, bin_: F.struct(stratum.alias("stratum"), bin_.alias("bin"))))
    return F.filter(found, lambda x: x["stratum"].isNotNull())


def _overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, spans array<struct<start, kind, end>> by start and kind number, and the text if it is asked for."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *([F.struct("*").alias("row")] if keep_text else []))
    t = F.col("text")
    rows = rows.withColumns({
        "assign": F.filter(_found(t, ASSIGN, t.rlike("(?i:passw|secret|token|api_?key)"), 2), lambda x: F.length(x["part"]) >= 6),
        "access": F.filter(_found(t, ACCESS, t.contains("AKIA")), lambda x: x["end"] - x["start"] >= 20),
        "hex": F.filter(_found(t, HEX, t.rlike(HEX)), lambda x: x["end"] - x["start"] >= 24),
        "run": F.filter(_found(t, RUN, t.rlike(RUN)), lambda x: _mixed(x["part"])),
    })
    rows = rows.withColumn("run", F.flatten(F.transform("run", _parts)))
    rows = rows.withColumn("run", F.filter("run", lambda x: ~_overlaps(x, F.col("assign")) & ~_overlaps(x, F.col("access")) & ~_overlaps(x, F.col("hex"))))
    placed = lambda x: _judged(x["part"], lambda stratum, bin_: F.struct(x["start"].alias("start"), x["end"].alias("end"), stratum.alias("stratum"), bin_.alias("bin")))
    rows = rows.withColumn("run", F.filter(F.transform("run", placed), lambda x: x["stratum"].isNotNull()))
    pairs = lambda kind: F.transform(kind, lambda x: F.struct(x["start"], F.lit(KINDS.index(kind)).alias("kind"), x["end"]))
    base = F.concat(pairs("assign"), pairs("access"), pairs("hex")).alias("base")
    kept = cut(rows.select(*(["row"] if keep_text else ["doc_id"]), base, "run", _decoys(t, F.xxhash64(t)).alias("decoys")), "secrets")
    limits = _limits(kept)
    limit = lambda x: F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in limits.items() for v in kv)), x["stratum"]), F.lit(-1)) if limits else F.lit(-1)
    random = F.transform(F.filter("run", lambda x: x["bin"] <= limit(x)), lambda x: F.struct(x["start"], F.lit(3).alias("kind"), x["end"]))
    return kept.select(*(["row"] if keep_text else ["doc_id"]), F.array_sort("base").alias("base"), F.array_sort(F.concat("base", random)).alias("spans"))


def _limits(kept: DataFrame) -> dict[int, int]:
    """By stratum the last bin that is reported: Benjamini-Hochberg on p-values against decoys. At most 28 rows come back."""
    one = lambda kind: kept.select(F.explode(kind).alias("x")).groupBy("x.stratum", "x.bin").agg(F.count("*").alias(kind))
    counts = one("run").join(one("decoys"), ["stratum", "bin"], "full").fillna(0, ["run", "decoys"])  # at most 28 * BINS rows
    whole, so_far = Window.partitionBy("stratum"), Window.partitionBy("stratum").orderBy("bin")
    ranked = counts.withColumns({"m": F.sum("run").over(whole), "all": F.sum("decoys").over(whole), "rank": F.sum("run").over(so_far), "above": F.sum("decoys").over(so_far)})
    passed = ranked.filter((F.col("m") > 0) & ((1 + F.col("above")) * F.col("m") <= FDR * F.col("rank") * (1 + F.col("all"))))
    return {r.stratum: r.limit for r in passed.groupBy("stratum").agg(F.max("bin").alias("limit")).collect()}


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the spans of scan()."""
    many = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", many(0), many(1), many(2), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows and columns of docs, with each run of overlapping spans in the text replaced by the mask."""
    found = scan(docs, docs.columns[0], text_col, keep_text=True)
    text = F.col("row")[text_col]

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: F.concat(F.concat_ws("", acc["out"]), F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(text.isNull() | (F.size("spans") == 0), text).otherwise(whole)
    return found.select(*(clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
