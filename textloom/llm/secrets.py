"""Secret scan by pattern and by character Markov models, in DataFrame functions only.

Three patterns give the base spans. Beyond them, each long run of key characters is scored by two character Markov
models, of random strings and of ordinary identifiers; a run whose log-likelihood ratio a step is above the threshold
that best parts labelled samples, which the models haven't seen, is a span too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stored

# Fixed values of the base patterns. The last two ask for their least length in the pattern, which finds the same spans.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")
#: Runs of these characters are candidates for the models.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN_LEAST = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{RUN_LEAST},}}"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9]{3,}"
#: One in so many of the different samples is kept from the models, to set the threshold.
HELD_OUT = 8
#: Bins a unit of the ratio in the histograms of held-out samples, the ratios they reach to, and how many missed random
#: strings weigh as much as one false alarm, as shares of their kinds.
BINS, REACH, FALSE_ALARM = 20, 8.0, 20.0

SPAN = "array<struct<start:long,kind:int,end:long>>"


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Spans of all matches, from the lengths of the matches and of what lies between them."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    own = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    pairs = F.filter(F.arrays_zip(between.alias("between"), own.alias("own")), lambda x: x["own"].isNotNull())
    zero, empty = F.lit(0).cast("long"), F.expr(f"cast(array() as {SPAN})")

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["between"]
        end = begin + x["own"]
        return F.struct(end.alias("at"), F.array_append(a["out"], F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))).alias("out"))

    # Matches go in stretches of about the root of their number, as each step copies what its stretch has so far.
    def in_stretches(rows: Column) -> Column:
        n = F.greatest(F.ceil(F.sqrt(F.size(rows))), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / n).cast("int")), lambda i: F.slice(rows, i * n + 1, n))

    def placed(stretches: Column) -> Column:
        lengths = F.transform(stretches, lambda p: F.aggregate(p, zero, lambda a, x: a + x["between"] + x["own"]))
        ends = F.aggregate(lengths, F.array(zero), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
        return _once(ends, lambda at: F.flatten(F.transform(stretches, lambda p, i: F.aggregate(p, F.struct(F.get(at, i).alias("at"), empty.alias("out")), step, lambda a: a["out"]))))

    return _once(pairs, lambda rows: F.when(F.size(rows) > 0, _once(in_stretches(rows), placed)).otherwise(empty))


def _once(x: Column, use) -> Column:
    """use(x), with x computed once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _none() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def with_base_spans(docs: DataFrame) -> DataFrame:
    """docs (with a string column ``whole``) and base: the base spans as array of (start, kind, end), unsorted."""
    low = F.lower("whole")
    hints = F.lit(False)
    for w in ASSIGN_WORDS:
        hints = hints | low.contains(w)
    docs = docs.withColumns({"maybe_assign": hints, "maybe_access": F.col("whole").contains("AKIA"), "maybe_hex": F.col("whole").rlike("[0-9a-f]{32}")})
    values = F.transform(F.regexp_extract_all(F.col("whole"), F.lit(ASSIGN), F.lit(1)), lambda x: F.length(x))
    long_enough = F.filter(F.arrays_zip(_spans(F.col("whole"), ASSIGN, 0).alias("span"), values.alias("n")), lambda x: x["n"] >= ASSIGN_LEAST)
    docs = docs.withColumns(
        {
            "base_assign": F.when(F.col("maybe_assign"), F.transform(long_enough, lambda x: x["span"])).otherwise(_none()),
            "base_access": F.when(F.col("maybe_access"), _spans(F.col("whole"), ACCESS, 1)).otherwise(_none()),
            "base_hex": F.when(F.col("maybe_hex"), _spans(F.col("whole"), HEX, 2)).otherwise(_none()),
        }
    )
    return docs.withColumn("base", F.concat("base_assign", "base_access", "base_hex")).drop("maybe_assign", "maybe_access", "maybe_hex", "base_assign", "base_access", "base_hex")


def bigrams(strings: DataFrame) -> DataFrame:
    """(pair, n) of columns ``s`` and ``n``: how often two characters of the alphabet stand side by side."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))
    rows = strings.where(F.length("s") >= 2).select("n", F.explode(pairs).alias("pair"))
    inside = F.translate("pair", ALPHABET, "") == ""
    return rows.where(inside & (F.length("pair") == 2)).groupBy("pair").agg(F.sum("n").alias("n"))


def ratio_table(random: dict[str, int], ordinary: dict[str, int], smoothing: float = 1.0) -> list[float]:
    """Log ratio of the next character's probabilities under both models, by pair in alphabet order."""
    size = len(ALPHABET)
    out = []
    for a in ALPHABET:
        r, o = [random.get(a + b, 0) + smoothing for b in ALPHABET], [ordinary.get(a + b, 0) + smoothing for b in ALPHABET]
        out += [math.log(x / sum(r)) - math.log(y / sum(o)) for x, y in zip(r, o, strict=True)]
    assert len(out) == size * size
    return out


@dataclass(frozen=True)
class Models:
    """The ratio table of both models, and the log-likelihood ratio a step from which a string counts as random."""

    table: list[float]
    threshold: float


def train(samples: DataFrame) -> Models:
    """Models of labelled samples (s: string, random: boolean, n: how often it counts). Nulls teach nothing; without samples
    of a kind its model is uniform. One in HELD_OUT different strings, by hash, is kept from the models; those of RUN_LEAST
    characters or more set the threshold, at the ratio with the fewest missed random strings and false alarms (infinite if
    a kind has none: then nothing counts as random). The driver gets pairs of characters and histograms, of fixed size."""
    samples = samples.where("s is not null and random is not null")
    aside = F.pmod(F.xxhash64("s"), F.lit(HELD_OUT)) == 0
    got = {True: {}, False: {}}
    for kind in got:
        got[kind] = {r["pair"]: r["n"] for r in bigrams(samples.where((F.col("random") == kind) & ~aside)).collect()}
    table = ratio_table(got[True], got[False])
    held = samples.where(aside & (F.length("s") >= RUN_LEAST))
    place = F.floor(F.least(F.greatest(per_step(F.col("s"), table), F.lit(-REACH)), F.lit(REACH)) * BINS).cast("long")
    rows = held.groupBy("random", place.alias("place")).agg(F.sum("n").alias("n")).collect()
    sums = {kind: {r["place"]: r["n"] for r in rows if r["random"] == kind} for kind in got}
    if not all(sums.values()):
        return Models(table, math.inf)

    def cost(edge: int) -> float:
        missed = sum(n for p, n in sums[True].items() if p < edge) / sum(sums[True].values())
        return missed + FALSE_ALARM * sum(n for p, n in sums[False].items() if p >= edge) / sum(sums[False].values())

    edges = range(int(-REACH * BINS), int(REACH * BINS) + 2)
    least = min(map(cost, edges))
    best = [e for e in edges if cost(e) == least]
    return Models(table, best[len(best) // 2] / BINS)


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(s, random, n) from all docs (a string column ``whole``). Random: the values of base spans, and strings made for
    each text from its hash, in the alphabets of keys (base64, letters and digits, hexadecimal), which no base pattern has
    to know. Ordinary: all identifiers outside base spans and of less than RUN_LEAST characters, and for each text one
    composed of its first three. Longer runs are what the models judge, so they teach neither: the more keys a table had, the
    more would count as ordinary."""
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("whole", ASSIGN, " "), ACCESS, " "), HEX, " "), RUN, " ")
    names = docs.select(F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0)).alias("names"))
    joints = F.array(*map(F.lit, ("_", "-", "/", "")))
    joint = F.get(joints, F.pmod(F.xxhash64("names"), F.lit(4)).cast("int"))
    parts = [F.get("names", F.lit(0)), joint, F.initcap(F.get("names", F.lit(1))), joint, F.get("names", F.lit(2))]
    composed = F.when(F.size("names") >= 3, F.concat(*parts))
    ordinary = names.select(F.explode(F.concat("names", F.array_compact(F.array(composed)))).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    spans = with_base_spans(docs).where(F.size("base") > 0).select("whole", F.explode("base").alias("x"))
    value = F.when(F.col("x.kind") == 0, F.regexp_extract("own", ASSIGN, 1)).otherwise(F.col("own"))
    secret = spans.withColumn("own", F.expr("substring(whole, cast(x.start + 1 as int), cast(x.end - x.start as int))")).select(value.alias("s"))
    digest = F.sha2("whole", 256)
    plain = F.translate(F.base64(F.unhex(digest)), "=", "")
    made = docs.where("whole <> ''").select(F.explode(F.array(plain, F.translate(plain, "+/", ""), F.translate(plain, "+/", "_-"), F.substring(digest, 1, 40), F.upper(F.substring(digest, 21, 40)))).alias("s"))
    random = secret.union(made).groupBy("s").agg(F.count("*").alias("n"))
    return random.select("s", F.lit(True).alias("random"), "n").union(ordinary.select("s", F.lit(False).alias("random"), "n"))


def log_ratio(s: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string of the alphabet's characters under a ratio table."""
    values = F.split(F.lit(",".join(f"{x:.6g}" for x in table)), ",").cast("array<double>")
    places = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = F.zip_with(F.slice(places, F.lit(1), F.size(places) - 1), F.slice(places, F.lit(2), F.size(places) - 1), lambda a, b: F.get(values, a * len(ALPHABET) + b))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def per_step(s: Column, table: list[float]) -> Column:
    """log_ratio for each pair of neighbouring characters, so that strings of any length compare."""
    return log_ratio(s, table) / F.greatest(F.length(s) - 1, F.lit(1))


def find_secrets(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text, base and spans: arrays of (start, kind, end), by start, then kind.

    docs: doc_id, text; other columns are ignored. start and end count code points, end exclusive; kind is a place in
    KINDS. base has the matches of the three patterns, leftmost and non-overlapping for each kind, that are long enough;
    spans adds runs of RUN_LEAST or more key characters that overlap no base span and whose ratio a step is at least the
    models' threshold. models: trained on docs if missing (see labelled_samples). Null and empty texts have no spans;
    repeated rows are alike; an empty table gives no rows. Whole texts are searched, of any length.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("whole"))
    models = train(stored(labelled_samples(rows))) if models is None else models
    rows = with_base_spans(rows).withColumn("maybe_run", F.col("whole").rlike(RUN))
    runs = F.arrays_zip(_spans(F.col("whole"), RUN, 3).alias("span"), F.regexp_extract_all(F.col("whole"), F.lit(RUN), F.lit(0)).alias("s"))
    rows = rows.withColumn("runs", F.when(F.col("maybe_run"), runs))
    free = F.filter(F.coalesce("runs", F.expr("cast(array() as array<struct<span:struct<start:long,kind:int,end:long>,s:string>>)")), lambda x: ~F.exists("base", lambda b: (b["start"] < x["span"]["end"]) & (x["span"]["start"] < b["end"])))
    rows = rows.withColumn("free", free)
    random = F.transform(F.filter("free", lambda x: per_step(x["s"], models.table) >= models.threshold), lambda x: x["span"])
    return rows.select("doc_id", F.col("whole").alias("text"), F.array_sort("base").alias("base"), F.array_sort(F.concat("base", random)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")
