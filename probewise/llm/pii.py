"""Personal data: base patterns, and candidates that boosted trees choose among. All of it in SQL functions.

Generators of high recall propose spans that may overlap. A candidate is described by its format and by
the words around it, not by the mark that the base pattern asks for (a plus sign, an at sign). Boosted
trees learn base spans, as they stand and with their mark stripped, against spans that are none by the way
they came about: base spans broken at random, in the context of another kind or inside a longer word, and
candidates that another kind's base span covers. A candidate of the corpus that is neither has no label:
how common unmarked cases are does not count against them. Scores are calibrated per kind on the other
half of the sample, and a candidate whose calibrated score reaches the wanted precision is added; of those
that overlap the best stays. No rule stands before or behind the trees. Base spans always stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probewise.llm import store

KINDS = ["email", "ip", "card", "phone"]

#: The base patterns, written so that a run of characters is tried once: quantifiers are possessive
#: where nothing after them could match, and a match begins where its run does or the last match ended.
BASE = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
_HEX = "[0-9A-Fa-f]{1,4}+"
#: Eight hexadecimal groups, or fewer with one double colon in the middle, at the end or at the start.
IPV6 = rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}+{_HEX}|(?:{_HEX}:){{1,6}}+(?::{_HEX}){{1,6}}+|(?:{_HEX}:){{1,7}}+:|::{_HEX}(?::{_HEX}){{0,6}}+)(?![0-9A-Za-z:])"
#: Generators: at sign or a spelt-out at; four numbers or an IPv6 address, compressed or not; long numbers
#: with any separators; digit groups of a telephone number with or without its plus sign.
WIDE = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}|" + IPV6,
    r"[0-9](?:[\x20./-]?[0-9]){12,}+",
    r"\+?(?:[0-9]{1,3}+[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}",
]
#: A card's digits without separators, whatever numbers stand beside them.
SOLID_CARD = r"(?<![0-9])[0-9]{13,19}+(?![0-9])"
#: Patterns by generator number; the kind is the remainder by 4.
PATTERNS = {**dict(enumerate([*BASE, *WIDE])), 10: SOLID_CARD}
#: What a text must hold for a kind's patterns to be worth running.
NEEDED = [r"@|[\[(]at[\])]|\x20at\x20", r"[0-9]\.[0-9]|[0-9A-Fa-f]:|::", r"[0-9]", r"[0-9]"]
#: Words that announce a kind, in the four languages of the corpus and as labels.
ANNOUNCED = [
    r"mail|contact|write to|correo|courriel|kontakt",
    r"\bip\b|host|server|address|addr|client|adresse",
    r"card|visa|credit|payment|tarjeta|carte|karte|iban|account",
    r"phone|tel|call|fax|mobile|llam|appel|anruf|cell",
]
_NUMBERED = r"invoice|order|total|amount|serial|isbn|tracking|reference|\bref\b|\bsku\b|\bid\b|price|article|\bitem|\bpart\b|version|\bdate|rechnung|facture|factura"
#: Words that speak against a kind where none announces it.
OBJECTED = [r"$.", r"version|release|section|chapter|build|revision|\bv\.?\x20?$", _NUMBERED, _NUMBERED]
BEFORE, AFTER = 32, 12
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
FEATURES = [
    "kind", "length", "digits", "letters", "marks", "groups", "longest", "parens", "luhn", "last", "word_before", "word_after", "announced", "distinct",
    "objected", "spelt", "colons", "octets", "paired",
]
#: Bounds of the training sample of candidates, and the precision thresholds are set for.
SAMPLE_ROWS = 20_000
PRECISION = 0.98


def _found(text: Column, pattern: str, needed: str, gen: int) -> Column:
    """Matches as (gen, k, gap, match, before, after); positions follow from the gaps' lengths."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(matches.alias("m"), gaps.alias("g"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("h"))
    some = text.rlike(needed) & text.rlike(pattern)

    def row(z: Column, k: Column) -> Column:
        return F.struct(
            F.lit(gen).alias("gen"),
            k.alias("k"),
            F.length(z["g"]).alias("gap"),
            z["m"].alias("match"),
            F.right(z["g"], F.lit(BEFORE)).alias("before"),
            F.left(z["h"], F.lit(AFTER)).alias("after"),
        )

    spans = F.filter(F.transform(zipped, row), lambda s: s["match"].isNotNull())
    return F.when(some, spans)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(F.filter(each, lambda c: c.isNotNull()), F.lit(0), lambda a, c: a + c) % 10 == 0


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, gen, start, end, match, before, after): every match of every pattern. ``gen`` is the
    kind's number for base patterns and 4 or 8 more for generators. Each document also has a row of gen -1, so
    that documents without matches stay. Only matches and the text next to them are moved."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    kind = "array<struct<gen:int,k:int,gap:int,match:string,before:string,after:string>>"
    none = F.array().cast(kind)
    runs = [_found(F.col("text"), p, NEEDED[i % 4], i).cast(kind) for i, p in PATTERNS.items()]
    itself = F.array(F.struct(F.lit(-1).alias("gen"), F.lit(0).alias("k"), F.lit(0).alias("gap"), F.lit("").alias("match"), F.lit("").alias("before"), F.lit("").alias("after")))
    rows = rows.select("row", "doc_id", F.inline(F.concat(itself.cast(kind), *[F.coalesce(r, none) for r in runs])))
    order = Window.partitionBy("row", "gen").orderBy("k")
    end = F.sum(F.col("gap") + F.length("match")).over(order)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match")).drop("k", "gap")


def is_base(gen: Column, match: Column) -> Column:
    """Whether a base pattern's match passes its kind's test."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(gen == 0, F.lit(True))
        .when(gen == 1, match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(gen == 2, n.between(14, 19) & F.when(n.between(14, 19), luhn(digits)))
        .when(gen == 3, n.between(10, 15))
        .otherwise(False)
    )


def judged(found: DataFrame) -> DataFrame:
    """Candidates with ``base`` (a base span), ``near`` (a generator's span that overlaps one of its kind)
    and ``crossed`` (overlaps any base span)."""
    found = found.withColumn("base", F.col("gen").between(0, 3) & F.coalesce(is_base(F.col("gen"), F.col("match")), F.lit(False)))
    found = found.where("base or gen = -1 or gen >= 4").withColumn("kind", F.pmod("gen", F.lit(4)))

    def overlaps(*keys: str) -> Column:
        sides = Window.partitionBy("row", *keys).orderBy("start", "end", "gen")
        ended = F.max(F.when(F.col("base"), F.col("end"))).over(sides.rowsBetween(Window.unboundedPreceding, -1))
        begun = F.min(F.when(F.col("base"), F.col("start"))).over(sides.rowsBetween(1, Window.unboundedFollowing))
        return F.coalesce(ended > F.col("start"), F.lit(False)) | F.coalesce(begun < F.col("end"), F.lit(False))

    return found.withColumn("crossed", overlaps()).withColumn("near", overlaps("kind"))


def described(found: DataFrame) -> DataFrame:
    """Format and context features of generator candidates. The mark of the base pattern is left out of
    the format: a plus sign and an at sign, spelt or not, count alike."""
    match = F.regexp_replace(F.col("match"), r"\x20?[\[(](?:at|dot)[\])]\x20?|\x20(?:at|dot)\x20|^\+|@", ".")
    digits = F.regexp_replace(match, "[^0-9]", "")
    n, kind = F.length(digits), F.col("kind")
    announced, objected = F.lit(False), F.lit(False)
    for k, (words, against) in enumerate(zip(ANNOUNCED, OBJECTED, strict=True)):
        announced = F.when(kind == k, F.col("before").rlike("(?i)" + words)).otherwise(announced)
        objected = F.when(kind == k, F.col("before").rlike("(?i)" + against)).otherwise(objected)
    groups = F.filter(F.split(match, "[^A-Za-z0-9]+"), lambda g: g != "")
    last = F.length(F.regexp_extract(match, "[A-Za-z]*$", 0))
    spelt = F.col("match").rlike(r"\x20at\x20")
    octets = match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    colons = F.length(F.regexp_replace(match, "[^:]", ""))
    number = {
        "length": F.length(match),
        "digits": n,
        "letters": F.length(F.regexp_replace(match, "[^A-Za-z]", "")),
        "marks": F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")),
        "groups": F.size(groups),
        "longest": F.array_max(F.transform(groups, F.length)),
        "parens": match.contains("("),
        "luhn": F.when(kind == 2, luhn(digits)).otherwise(False),
        "last": last,
        "word_before": F.col("before").rlike(r"[\p{L}\p{N}_]$|[0-9][.,/-]$"),
        "word_after": F.col("after").rlike(r"^(?:[\p{L}\p{N}_]|[.,/-][0-9])"),
        "announced": announced,
        "distinct": F.size(F.array_distinct(F.split(digits, ""))),
        "objected": objected,
        "spelt": spelt,
        "colons": colons,
        "octets": octets,
    }
    paired = (F.size(groups) == 8) & F.forall(groups, lambda g: F.length(g) == 2)
    number["paired"] = paired
    return found.where("gen >= 4").withColumns({name: F.coalesce(c.cast("double"), F.lit(0.0)) for name, c in number.items()})


@dataclass
class Model:
    """Boosted trees and the least score by kind at which a candidate is taken; no trees, none taken."""

    trees: GBTClassificationModel | None
    thresholds: list[float]


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.withColumn("kind", F.col("kind").cast("double")))


def _any(*values: str) -> Column:
    """One of the values, by the hash of the span."""
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(F.xxhash64("source", "before"), F.lit(len(values))).cast("int") + 1)


def _by_kind(*values: Column) -> Column:
    return reduce(lambda out, kv: F.when(F.col("kind") == kv[0], kv[1]).otherwise(out), enumerate(values), F.lit(None))


def _bare() -> Column:
    """A base span in a form without its mark: a spelt-out at, a card's digits between points or slashes, a
    number without its country code. An address of four numbers has no other form."""
    spelt = F.regexp_replace("match", F.lit("@"), _any(" at ", " (at) ", " [at] ", "(at)"))
    spelt = F.when(_any("dot", "point", "point") == "point", spelt).otherwise(F.regexp_replace(spelt, r"\.(?=[A-Za-z0-9-]*$)", " dot "))
    fours = F.regexp_replace(F.regexp_replace("match", "[^0-9]", ""), F.lit("([0-9]{4})(?=[0-9])"), F.concat(F.lit("$1"), _any(".", "/")))
    return _by_kind(spelt, F.col("match"), fours, F.regexp_replace("match", r"^\+[0-9]{1,3}[\x20.-]|^\+", ""))


def _broken() -> Column:
    """A base span spoilt: a last label of one digit, a number above 255, a wrong check digit, three years."""
    at = F.pmod(F.xxhash64("match", F.lit("broken")), F.lit(1 << 20))
    digit = F.pmod(F.right("match", F.lit(1)).cast("int") + 1 + at % 9, F.lit(10)).cast("string")
    card = F.concat(F.expr("left(match, length(match) - 1)"), digit)
    year = [(F.lit(1940) + F.shiftright(at, 6 * k) % 90).cast("string") for k in range(3)]
    years = F.array_join(F.array(*year), " ")
    octet = F.regexp_replace("match", F.lit(r"\.[0-9]+$"), F.concat(F.lit("."), (256 + at % 740).cast("string")))
    first = F.regexp_replace("match", F.lit(r"^[0-9]+"), (256 + at % 740).cast("string"))
    return _by_kind(F.regexp_replace("match", r"\.[A-Za-z0-9-]+$", ".7"), F.when(at % 2 == 0, octet).otherwise(first), card, years)


def labelled(source: DataFrame) -> DataFrame:
    """Candidates with features and ``label``, from generator candidates with ``source`` = their match.

    1: spans that coincide with a base span, as they stand and bare. 0: candidates that a base span of
    another kind covers; base spans broken; bare and plain ones where no such thing stands (a version, the
    number of an order, two words about a place), in the context of another kind, or inside a longer word.
    """
    near = source.where("near")
    # the context of another base span of the bounded sample, where that is of another kind
    order = Window.partitionBy(F.pmod(F.xxhash64("match"), F.lit(16))).orderBy(F.xxhash64("before", "match"), "match")
    elsewhere = near.withColumns({"kind_": F.lag("kind").over(order), "before_": F.lag("before").over(order)}).where("kind_ <> kind")
    numbered = _any("the order no ", "invoice ", "total amount ", "serial ", "tracking ", "article ", "price ", "reference ")
    nowhere = _by_kind(_any("we met ", "they arrived ", "look ", "she is "), _any("see version ", "release ", "section ", "build "), numbered, numbered)
    unmarked = F.when(_any("all", "bare") == "all", F.regexp_replace("match", r"^\+", "")).otherwise(_bare())
    plain = F.when(F.col("kind") == 0, F.regexp_replace("match", "@", " at ")).otherwise(unmarked)
    inside = F.when(F.pmod(F.xxhash64("match"), F.lit(2)) == 0, F.lit("x")).otherwise(F.lit("7."))
    parts = [
        (near, {}, 1.0),
        (near.where(_bare() != F.col("match")), {"match": _bare()}, 1.0),
        (source.where("crossed AND NOT near"), {}, 0.0),
        (near, {"match": _broken()}, 0.0),
        (near.where("kind = 2"), {"match": F.concat("match", F.lit(" "), "match")}, 0.0),
        (near.where("kind = 2"), {"match": F.regexp_replace(_broken(), r"[\x20-]", ".")}, 0.0),
        (near, {"match": plain, "before": nowhere}, 0.0),
        (elsewhere.where("kind IN (0, 3)"), {"match": plain, "before": F.col("before_")}, 0.0),
        (near.where("kind > 0"), {"before": F.concat("before", inside)}, 0.0),
    ]
    made = [described(rows.withColumns(changes)).withColumn("label", F.lit(label)) for rows, changes, label in parts]
    columns = ["label", "source", *FEATURES]
    return reduce(DataFrame.unionByName, [part.select(*columns) for part in made])


def _made(spark: SparkSession) -> DataFrame:
    """IPv6 addresses, which have no base pattern, and look-alikes (eight pairs, names with a double colon,
    addresses in longer words), by a fixed rule in ``described``'s columns."""
    raw = F.md5(F.col("id").cast("string"))
    group = lambda k, size=4: F.substring(raw, 1 + 4 * k, size)
    cut = lambda k: F.substring(group(k), F.lit(1), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(4)).cast("int") + 1)
    digits = F.pmod(F.xxhash64(raw), F.lit(3)) == 0
    short = lambda k: F.when(digits, F.translate(cut(k), "abcdef", "012345")).otherwise(cut(k))
    name = lambda k: F.concat(F.lit("a"), F.translate(group(k, 3), "0123456789", "abcdefabcd"))
    forms = [
        F.concat_ws(":", *map(short, range(8))),
        F.concat_ws(":", F.lit("2001:db8"), *map(short, range(6))),
        F.concat(F.lit("2001:db8"), *[F.when(F.col("id") % 16 >= 4 * k, F.concat(F.lit(":"), short(k))).otherwise("") for k in range(1, 4)], F.lit("::"), short(5)),
        F.concat(F.lit("fe80::"), short(1), F.lit(":"), short(2)),
        F.concat(F.lit("2a0"), group(0, 1), F.lit(":"), short(1), F.lit("::")),
        F.concat_ws(":", *[group(k, 2) for k in range(8)]),
        F.concat(name(0), F.lit("::"), name(1)),
    ]
    kinds, leads = len(forms), F.array(*map(F.lit, ["", "from ", "the address is ", "host ", "(", "x"]))
    form = (F.col("id") % kinds).cast("int")
    rows = spark.range(kinds * 150).select(
        F.lit(5).alias("gen"),
        F.lit(1).alias("kind"),
        F.element_at(F.array(*forms), form + 1).alias("match"),
        F.element_at(leads, F.pmod(F.xxhash64("id"), F.lit(6)).cast("int") + 1).alias("before"),
        F.lit(" ").alias("after"),
        (form < 5).alias("good"),
    )
    rows = rows.withColumns({"source": F.col("match"), "label": (F.col("good") & (F.col("before") != "x")).cast("double")})
    return described(rows).select("label", "source", *FEATURES)


def learn(judged_rows: DataFrame, rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> Model:
    """Fit on a bounded sample of generator candidates (at most ``2 * rows``), labelled by ``labelled``.

    Half of the sources train, the other half calibrates: per kind an isotonic regression of the label on
    the score, and as threshold the least score whose calibrated value is at least ``precision``. A kind
    without such a score gets none.
    """
    known = judged_rows.where("gen >= 4")
    n = known.count()
    unit = F.pmod(F.xxhash64("match", "before", "start"), F.lit(1 << 30)) / float(1 << 30)
    source = known.where(unit < rows / max(1, n)).limit(2 * rows).withColumn("source", F.col("match"))
    source = store.kept(source.select("gen", "kind", "match", "before", "after", "near", "crossed", "source"), "sources")
    sample = labelled(source).unionByName(_made(judged_rows.sparkSession))
    sample = store.kept(sample.withColumn("half", F.pmod(F.xxhash64("source"), F.lit(2))).drop("source"), "candidates")
    train = sample.where("half = 0")
    if {r["label"] for r in train.select("label").distinct().collect()} != {0.0, 1.0}:
        return Model(None, [2.0] * len(KINDS))
    trees = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=5, minInstancesPerNode=5).fit(_vectors(train))
    scored = trees.transform(_vectors(sample.where("half = 1")))
    bins = scored.groupBy("kind", _score().alias("score")).agg(F.avg("label").alias("label"), F.count("label").cast("double").alias("weight"))
    bins = store.kept(bins, "bins")  # at most 101 a kind
    thresholds = []
    for kind in range(len(KINDS)):
        part = bins.where(F.col("kind") == kind)
        if part.isEmpty():
            thresholds.append(2.0)
            continue
        curve = IsotonicRegression(featuresCol="score", labelCol="label", weightCol="weight").fit(part)
        reached = [x for x, y in zip(curve.boundaries, curve.predictions, strict=True) if y >= precision]
        thresholds.append(float(min(reached, default=2.0)))
    return Model(trees, thresholds)


def _score() -> Column:
    return F.round(vector_to_array("probability")[1], 2)


def best_first(spans: DataFrame) -> DataFrame:
    """Of (row, doc_id, kind, start, end, score) those that remain where the best score goes first and takes
    its place; among equals the earlier start, then the earlier kind. Only spans that hang together are
    brought together, so a list is as long as such a chain."""
    side = Window.partitionBy("row").orderBy("start", "end", "kind")
    reach = F.max("end").over(side.rowsBetween(Window.unboundedPreceding, -1))
    chain = F.sum(F.when(reach > F.col("start"), 0).otherwise(1)).over(side)
    span = F.struct((-F.col("score")).alias("order"), F.col("start"), F.col("kind").cast("int").alias("kind"), F.col("end"))
    lists = spans.withColumn("chain", chain).groupBy("row", "doc_id", "chain").agg(F.sort_array(F.collect_list(span)).alias("found"))
    none = F.filter("found", lambda s: F.lit(False))

    def walk(taken: Column, s: Column) -> Column:
        met = F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
        return F.when(met, taken).otherwise(F.concat(taken, F.array(s)))

    return lists.select("row", "doc_id", F.inline(F.aggregate("found", none, walk))).select("row", "doc_id", "kind", "start", "end")


def added(judged_rows: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, kind, start, end) of candidates that are taken: clear of base spans, at or above their
    kind's threshold, and not overlapped by a better one."""
    free = judged_rows.where("gen >= 4 AND NOT crossed")
    if model.trees is None:
        return free.select("row", "doc_id", F.col("kind").cast("int").alias("kind"), "start", "end").where(F.lit(False))
    least = F.element_at(F.array(*map(F.lit, model.thresholds)), F.col("kind").cast("int") + 1)
    scored = model.trees.transform(_vectors(described(free))).withColumn("score", _score()).where(F.col("score") >= least)
    return best_first(scored)


def written(spans: Column) -> Column:
    """kind:start:end of an array of (start, kind, end), by start, then kind, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    one = F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"]))
    return F.concat_ws(",", one)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Positions count code points, ends are exclusive. A null or empty text has no spans: zero counts, the
    hash of an empty string, an empty string. Rows with equal or null ids stay apart. An empty table
    gives no rows. Work grows with a text's length: runs of characters are scanned once.
    """
    seen = store.kept(judged(candidates(docs, doc_id, text)), "judged")
    model = learn(seen.where("gen >= 4"))
    base = seen.where("base or gen = -1").select("row", "doc_id", "kind", "start", "end", "base", (F.col("gen") == -1).alias("itself"))
    more = added(seen.where("gen >= 4"), model)
    more = more.withColumns({"base": F.lit(False), "itself": F.lit(False)})
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("kind").cast("int").alias("kind"), F.col("end").cast("long").alias("end"))
    count = [F.sum((F.col("base") & (F.col("kind") == k)).cast("long")).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    found = base.unionByName(more).groupBy("row", "doc_id").agg(
        *count,
        F.collect_list(F.when(F.col("base"), span)).alias("own"),
        F.collect_list(F.when(~F.col("itself"), span)).alias("every"),
    )
    return found.select(
        "doc_id",
        *[f"n_{name}" for name in KINDS],
        F.sha2(written(F.col("own")), 256).alias("base_sha256"),
        written(F.col("every")).alias("spans"),
        (F.size("every") - F.size("own")).cast("long").alias("n_added"),
    )
