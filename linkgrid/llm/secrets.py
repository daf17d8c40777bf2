"""Secret scans: known patterns, and a randomness test battery; DataFrame operations only.

Patterns give the base spans. Further candidates are runs of encoding characters. The encoding
is inferred from the characters (hex, base32, base64), and three tests ask whether the symbols
could be uniform and independent: chi-squared uniformity over the alphabet, the runs test
about the middle of the alphabet, and serial correlation. A candidate that passes all three
still needs evidence against ordinary words, whose letters coincide more often than random
symbols do: its p-value under that null falls with its length. Benjamini-Hochberg control is
applied within each encoding and length band, over all distinct candidates of the corpus:
copies of one string are one hypothesis, so boilerplate hides no keys.

The p-values are counted in a fixed number of bins per band (rounded up, so the control errs
on the safe side); at most 3 x 8 x 601 counts reach the driver. Texts are scanned once; what is
written to the shared folder are spans. No shuffle but those of the counts and of the digests
they count, each sent once per task. Positions come from the lengths of what lies between
matches, in code points.

Edge cases: null text is empty and has no spans; repeated rows alike; an empty table gives an
empty table; ties in start are ordered by kind as listed, random last. A candidate with fewer
than two symbols besides its padding (a line of '=') is not random.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgrid.llm.common import kept, text_of

# Fixed patterns of the base scan.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]

HEX_DIGITS = "0123456789abcdef"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
# Encoding: digits, and how often two letters of ordinary text in it coincide.
ENCODINGS = {"hex": (HEX_DIGITS, 0.12), "base32": (BASE32_DIGITS, 0.085),
             "base64": (BASE64_DIGITS, 0.065)}


@dataclass(frozen=True)
class Battery:
    false_discovery: float = 0.05
    largest_z: float = 3.3  # in each of the three tests; about 0.001 two-sided
    bins_per_decade: int = 20
    decades: int = 30


def _spans(text: Column, pattern: str, kind: str, wanted=None) -> Column:
    """Array of (start, kind, end) of the matches, code points, end exclusive."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start: bigint, kind: int, end: bigint, of: string>>")
    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found,
                       lambda gap, of: F.struct(F.length(gap).alias("gap"), of.alias("of")))

    def step(so_far, pair):
        start = so_far["at"] + pair["gap"]
        end = start + F.length(pair["of"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                        end.alias("end"), pair["of"].alias("of"))
        return F.struct(end.alias("at"), F.concat(so_far["spans"], F.array(span)).alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans"))
    spans = F.aggregate(pairs, start, step)["spans"]
    if wanted is not None:
        spans = F.filter(spans, lambda s: wanted(s["of"]))
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def _normal_below(z: Column) -> Column:
    """Normal distribution function by the rational approximation with error below 1e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (
        -1.453152027 + t * 1.061405429))))
    tail = series * F.exp(-x * x) / 2
    return F.when(z < 0, tail).otherwise(1 - tail)


def encoding_of(token: Column) -> Column:
    return (
        F.when(token.rlike("^[0-9a-fA-F]+$"), "hex")
        .when(token.rlike("^[A-Z2-7]+=*$"), "base32")
        .otherwise("base64")
    )


def _symbols(token: Column, encoding: Column) -> Column:
    """Values of the symbols in the alphabet of the encoding, padding left out."""
    bare = F.translate(F.regexp_replace(token, "=", ""), "-_", "+/")
    hexed = F.lower(bare)
    digits, source = F.lit(BASE64_DIGITS), bare
    for name, alphabet in (("hex", HEX_DIGITS), ("base32", BASE32_DIGITS)):
        digits = F.when(encoding == name, alphabet).otherwise(digits)
    source = F.when(encoding == "hex", hexed).otherwise(source)
    symbols = F.filter(F.split(source, ""), lambda c: c != "")  # "" splits into [""]
    return F.transform(symbols, lambda c: F.position(c, digits) - 1)


def _total(array: Column, of) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda total, v: total + of(v).cast("double"))


def battery(token: Column) -> Column:
    """Struct of the tests on one token: encoding, n, z_chi, z_runs, z_serial, p_words.

    With fewer than two symbols no test is defined: each z is 99 and p_words is 1.
    """
    encoding = encoding_of(token)
    values = _symbols(token, encoding)
    size = F.size(values)
    n = F.when(size >= 2, size.cast("double"))  # null otherwise, and so is what it divides
    k, coincide = F.lit(64.0), F.lit(ENCODINGS["base64"][1])
    for name in ("hex", "base32"):
        k = F.when(encoding == name, float(len(ENCODINGS[name][0]))).otherwise(k)
        coincide = F.when(encoding == name, ENCODINGS[name][1]).otherwise(coincide)
    squares = _total(
        F.array_distinct(values),
        lambda v: F.pow(F.size(F.filter(values, lambda w: w == v)).cast("double"), F.lit(2.0)))
    chi = k / n * squares - n
    z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)

    high = _total(values, lambda v: (v >= k / 2).cast("double"))
    low = n - high
    rest = F.greatest(size - 1, F.lit(0))
    pairs = F.zip_with(F.slice(values, F.lit(1), rest), F.slice(values, F.lit(2), rest),
                       lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    changes = _total(pairs, lambda p: ((p["a"] >= k / 2) != (p["b"] >= k / 2)).cast("double"))
    expected = 2 * high * low / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = F.when(variance > 0, (changes + 1 - expected) / F.sqrt(variance)).otherwise(
        F.lit(99.0))

    mean = _total(values, lambda v: v) / n
    spread = _total(values, lambda v: (v - mean) * (v - mean))
    lagged = _total(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean))
    z_serial = F.when(spread > 0, (lagged / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))

    # Coinciding pairs: fewer than in words speaks against words.
    total = n * (n - 1) / 2
    equal = (squares - n) / 2
    deviation = F.sqrt(total * coincide * (1 - coincide) + n * n * n * 0.0002)
    p_words = _normal_below((equal - total * coincide) / deviation)
    undefined = F.lit(99.0)
    return F.struct(
        encoding.alias("encoding"), size.cast("double").alias("n"),
        F.coalesce(z_chi, undefined).alias("z_chi"), z_runs.alias("z_runs"),
        z_serial.alias("z_serial"), F.coalesce(p_words, F.lit(1.0)).alias("p_words"))


def _tested(span: Column, test: Column, settings: Battery) -> Column:
    n = F.greatest(test["n"], F.lit(1.0))
    band = F.least(F.floor(F.log2(n / 16) * 2), F.lit(7)).cast("int")
    decades = F.least(-F.log10(F.greatest(test["p_words"], F.lit(10.0**-settings.decades))),
                      F.lit(float(settings.decades)))
    return F.struct(
        span["start"].alias("start"), span["kind"].alias("kind"), span["end"].alias("end"),
        F.concat_ws(":", test["encoding"], F.greatest(band, F.lit(0)).cast("string"))
        .alias("band"),
        F.floor(decades * settings.bins_per_decade).cast("int").alias("bin"),
        ((test["z_chi"] <= settings.largest_z)
         & (F.abs(test["z_runs"]) <= settings.largest_z)
         & (F.abs(test["z_serial"]) <= settings.largest_z)).alias("random"),
    )


def thresholds(counts: DataFrame, settings: Battery) -> dict[str, int]:
    """Per band the least bin that Benjamini-Hochberg accepts, from (band, bin, count)."""
    rows = counts.toArrow().to_pylist()
    out: dict[str, int] = {}
    for band in {r["band"] for r in rows}:
        own = sorted((r for r in rows if r["band"] == band), key=lambda r: -r["bin"])
        total, so_far = sum(r["count"] for r in own), 0
        for r in own:
            so_far += r["count"]
            largest_p = 10 ** (-r["bin"] / settings.bins_per_decade)
            if largest_p <= settings.false_discovery * so_far / total:
                out[band] = r["bin"]
    return out


def scan(docs: DataFrame, settings: Battery = Battery()) -> DataFrame:
    """doc_id and ``spans``, an array of (start, kind, end, of) in order: base and random ones."""
    text = F.col("text")
    base = F.concat(
        _spans(text, ASSIGN, "assign",
               lambda of: F.length(F.regexp_extract(of, "^" + ASSIGN, 2)) >= 12),
        _spans(text, ACCESS, "access"),
        _spans(text, HEX, "hex"),
    )
    found = kept(
        docs.select("doc_id", text_of().alias("text")).select(
            "doc_id", base.alias("base"), _spans(text, CANDIDATE, "random").alias("more")),
        "secret-spans",
    )
    tested = kept(
        found.withColumn("tested", F.transform(
            "more", lambda s: _tested(s, battery(s["of"]), settings))),
        "secret-tests",
    )
    # Equal strings have equal tests; a digest keeps long ones out of the shuffle.
    each = tested.select(F.explode(F.zip_with("tested", "more", lambda t, s: F.struct(
        t["band"].alias("band"), t["bin"].alias("bin"),
        F.unhex(F.md5(s["of"])).alias("digest")))).alias("t"))
    counts = each.select("t.*").distinct().groupBy("band", "bin").count()
    least = thresholds(counts, settings)
    limit = F.lit(settings.decades * settings.bins_per_decade + 1)
    limits = F.create_map(*[F.lit(x) for pair in least.items() for x in pair]) if least else None

    def accepted(t: Column) -> Column:
        enough = F.coalesce(limits[t["band"]], limit) if least else limit
        own = F.exists("base", lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"]))
        return t["random"] & (t["bin"] >= enough) & ~own

    plain = lambda s: F.struct(s["start"], s["kind"], s["end"])
    spans = F.concat(F.transform("base", plain),
                     F.transform(F.filter("tested", accepted), plain))
    return tested.select("doc_id", F.array_sort(spans).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _number(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def secret_report(docs: DataFrame, settings: Battery = Battery()) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    rows = scan(docs, settings)
    counts = {f"n_{kind}": _number(i) for i, kind in enumerate(KINDS)}
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("random"))
    return rows.select(
        "doc_id", *[counts[f"n_{k}"].alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        counts["n_random"].alias("n_random"),
    )
