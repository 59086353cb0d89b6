"""Personal data: fixed kinds by pattern, further identifiers by bootstrapped context. DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers. They are the seeds. Tokens with
a digit in them that are no base span are candidates. Seeds and candidates are instances of a graph
whose other nodes are lexical patterns: the word before an instance, the two words before it, and the words on
both sides, with signs such as ``=`` or ``:`` made one and numbers made one. All words are those of the text, so a word
before an instance may itself be one, and any white space may stand between.

Patterns are scored in ``ROUNDS`` rounds. A pattern's confidence is the share of its uses in the whole corpus that
lead to an instance, each weighted by what is believed of the instance without this pattern: 1 for a seed, and for
what a pattern after another word has found in the round before (so what was found is a seed of the next round); after an
introducing sign (``=``, ``:``, a quote or a bracket), ``RANDOM`` for values whose statistics are those of random ones; else 0.
These statistics are fixed, so no share of seeds, and no other values of the corpus, decide how a value is seen:
``RANDOM_LENGTH`` characters or more, ``RANDOM_ENTROPY`` bits a character or more, and ``RANDOM_CHANGES`` changes or more between
letters and digits. Numbers alone change nowhere. So an introducing word that random values follow nearly always finds what follows it,
beside no seed at all; a plain word (``commit``) does not, nor does any word in running prose; and a
word whose uses are seeds for the most part finds all that follows it. Patterns with fewer than ``SUPPORT`` different instances have no
confidence; neither have those that less than ``ACCEPT`` of their uses lead to any instance from, which are dropped
before the rounds: words such as "the", whatever their number of instances.
Candidates at a pattern of confidence ``ACCEPT`` or more become spans of kind ``context``; of these, values of
``LONG`` characters or more are spans wherever they stand.

Numbers that stand side by side can run together into a match that is no card and no phone number. The
shapes of seeds (their digits made one) are patterns for these: neighbouring words of such a run, as many
as the longest of these shapes has, that have a shape of confidence ``ACCEPT``, and pass the test of its
kind, are ``context`` spans too.

A null text counts as empty. Long texts and long tokens are matched whole, by patterns that do not
backtrack into what they have read; positions take time in proportion to the text. A null ``doc_id`` keeps
its row. Repeated rows stay. An empty table gives none. Other columns are ignored, or kept as they are by
``mask``, whatever their names. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SUPPORT = 5
ACCEPT = 0.5
ROUNDS = 4
#: Characters of a value that is taken for an identifier outside its context too.
LONG = 12
#: Patterns that are few enough to be sent to all executors; more are joined by a shuffle.
BROADCAST_PATTERNS = 50_000
#: Matches whose positions are added up one by one; more are taken in blocks of as many.
BLOCK = 256
#: Characters of the blocks in which a text is masked.
TEXT_BLOCK = 4096
#: Belief in a value that looks random and follows an introducing sign, and what such a value has at least.
RANDOM = 0.6
RANDOM_LENGTH, RANDOM_ENTROPY, RANDOM_CHANGES = 16, 3.0, 4

# The base patterns. Possessive, and a look-behind so that a run that failed is not tried again from its middle.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_ID = "A-Za-z0-9._@%+-"
CANDIDATE = rf"(?<![{_ID}])(?=[A-Za-z._@%+-]*+[0-9])[{_ID}]++"
_TRIM = "._@%+-"
_CUE = r"=:#\"'(<\["
CUE = rf"(?<!\s)\s*+[{_CUE}]++[\s{_CUE}]*+"
_SPAN = "struct<start:int,stop:int,value:string>"
_BESIDE = "struct<last:string,two:string,right:string>"
_PLACED = "struct<start:int,stop:int,value:string,last:string,two:string,right:string>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _matches(text: Column, pattern: str, possible: Column) -> Column:
    """Leftmost non-overlapping matches with the words beside them, where ``possible`` holds.

    ``last``, ``two``: the word before and the one before that, ``right``: the word after; no ``last`` where that touches the match.
    """
    parts = F.split(F.regexp_replace(text, f"({pattern})", "\x01$1\x01"), "\x01", -1)

    def matched(parts: Column) -> Column:
        one = lambda j: F.struct(parts[2 * j - 2].alias("gap"), parts[2 * j - 1].alias("hit"))
        return F.transform(F.sequence(F.lit(1), (F.size(parts) / 2).cast("int")), one)

    def blocks(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(found) - 1) / BLOCK).cast("int")), lambda b: F.slice(found, b * BLOCK + 1, BLOCK))

    def starts(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, m: n + F.length(m["gap"]) + F.length(m["hit"])))
        first = F.struct(F.lit(0).alias("at"), _none("int").alias("out"))
        return F.aggregate(sizes, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def placed(block: Column, at: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            start = acc["at"] + F.length(m["gap"])
            stop = start + F.length(m["hit"])
            return F.struct(stop.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), stop.alias("stop"), m["hit"].alias("value"))).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), _none(_SPAN).alias("out")), step, lambda acc: acc["out"])

    in_blocks = lambda p: F.flatten(_let(_let(matched(p), blocks), lambda b: F.zip_with(b, starts(b), placed)))
    joined = lambda s, c: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), c["last"].alias("last"), c["two"].alias("two"), c["right"].alias("right"))
    spans = _let(parts, lambda p: F.when(F.size(p) > 1, F.zip_with(in_blocks(p), _beside(p), joined)))
    return F.coalesce(F.when(possible, spans), _none(_PLACED))


def _beside(parts: Column) -> Column:
    """For each match, the second of two ``parts``, the words beside it, as ``_normal`` has them. Takes time in proportion to the text.

    Matches are marked, spaces in them replaced, and the text is cut into words; a match has a word before it only if it begins a word.
    """
    marked = lambda p, i: F.when(i % 2 == 1, F.concat(F.lit("\x01"), F.regexp_replace(_cued(p), r"\s", "\x02"), F.lit("\x03"))).otherwise(_cued(p))
    words = F.split(F.array_join(F.transform(parts, marked), ""), r"\s+", -1)
    plain = lambda w: _numbered(F.translate(w, "\x01\x03", ""))

    def near(words: Column) -> Column:
        def of(x: Column) -> Column:
            at = x["i"]
            left = F.filter(F.split(F.concat_ws("\x02", F.get(words, at - 2), F.get(words, at - 1)), "\x02"), lambda w: plain(w) != "")
            right = plain(F.substring_index(F.get(words, at + 1), "\x02", 1))
            own = F.struct(plain(F.get(left, F.size(left) - 1)).alias("last"), plain(F.get(left, F.size(left) - 2)).alias("two"), F.when(right != "", right).alias("right"))
            begins = F.when(x["w"].startswith("\x01"), own).otherwise(F.lit(None).cast(_BESIDE))
            more = F.length(x["w"]) - F.length(F.replace(x["w"], F.lit("\x01"), F.lit(""))) - 1
            return F.concat(F.array(begins), F.array_repeat(F.lit(None).cast(_BESIDE), more))

        held = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].contains("\x01"))
        return F.flatten(F.transform(held, of))

    return _let(words, near)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _n_digits(value: Column, least: int, most: int) -> Column:
    return F.length(_digits(value)).between(least, most)


#: Kind, pattern, a cheap test that a text may have one, and what a match must also be.
KINDS = (
    ("email", EMAIL, lambda t: t.contains("@"), lambda v: F.lit(True)),
    ("ip", IP, lambda t: t.rlike(IP), lambda v: v.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")),
    ("card", CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), lambda v: _n_digits(v, 13, 19) & F.call_function("luhn_check", _digits(v))),
    ("phone", PHONE, lambda t: t.contains("+"), lambda v: _n_digits(v, 9, 15)),
)

#: Kinds whose seeds have shapes to look for in runs of numbers.
SHAPED = ("card", "phone")


def _valid(spans: Column, test) -> Column:
    return F.filter(spans, lambda s: test(s["value"]))


def _fails(test):
    return lambda v: ~test(v) & (F.length(_digits(v)) >= 9)


def _shape(value: Column) -> Column:
    return F.regexp_replace(value, "[0-9]", "9")


def _cued(text: Column) -> Column:
    """Introducing signs made one."""
    return F.regexp_replace(text, CUE, "= ")


def _numbered(text: Column) -> Column:
    """Numbers made one, lower case."""
    return F.lower(F.regexp_replace(text, "[0-9]+", "0"))


def _normal(text: Column) -> Column:
    return _numbered(_cued(text))


def _patterns(span: Column) -> Column:
    """The lexical patterns of a span as array<pattern, last>; none where the word before touches it."""
    last = span["last"]
    both = F.array(last, F.concat(span["two"], F.lit(" "), last), F.concat(last, F.lit(" _ "), span["right"]))
    return F.transform(F.array_compact(both), lambda p: F.struct(p.alias("pattern"), last.alias("last")))


def _looks_random(value: Column) -> Column:
    """Are a value's length, entropy and changes between letters and digits those of a random one?"""
    n = F.length(value)

    def entropy(characters: Column) -> Column:
        share = lambda c: F.size(F.filter(characters, lambda x: x == c)) / F.size(characters)
        return F.aggregate(F.transform(F.array_distinct(characters), share), F.lit(0.0), lambda h, p: h - p * F.log2(p))

    changes = F.regexp_count(value, F.lit("(?<=[0-9])[a-z]|(?<=[a-z])[0-9]"))
    return (n >= RANDOM_LENGTH) & (changes >= RANDOM_CHANGES) & (_let(F.split(value, ""), entropy) >= RANDOM_ENTROPY)


def _trimmed(spans: Column) -> Column:
    """Candidates without signs at their ends, of four characters or more."""

    def one(s: Column) -> Column:
        start = s["start"] + F.length(s["value"]) - F.length(F.ltrim(s["value"], F.lit(_TRIM)))
        value = F.trim(s["value"], F.lit(_TRIM))
        last = F.when(start == s["start"], s["last"])  # else a sign touches it
        return F.struct(start.alias("start"), (start + F.length(value)).alias("stop"), value.alias("value"), last.alias("last"), s["two"].alias("two"), s["right"].alias("right"))

    return F.filter(F.transform(spans, one), lambda s: F.length(s["value"]) >= 4)


def base_spans(docs: DataFrame, keep: bool = False) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text), one span array per kind, ``candidates`` outside these, and ``runs``: long numbers that failed.

    With ``keep``, also ``row``: the whole row of ``docs`` as a struct.
    """
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if keep else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *whole)
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), F.translate("text", "\x01\x02\x03", "\x7f\x7f\x7f").alias("t"), *(["row"] if keep else []))  # marks must not occur; they match nothing either way
    text = F.col("t")
    for kind, pattern, possible, _ in KINDS:
        rows = rows.withColumn(kind, _matches(text, pattern, possible(text)))
    rows = rows.withColumn("runs", F.concat(*(_valid(F.col(k), _fails(valid)) for k, _, _, valid in KINDS if k in SHAPED)))
    for kind, _, _, valid in KINDS:
        rows = rows.withColumn(kind, _valid(F.col(kind), valid))
    apart = lambda base: lambda c: ~F.exists(base, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    offered = _trimmed(_matches(text, CANDIDATE, text.rlike(CANDIDATE)))
    return rows.withColumn("candidates", _let(F.concat(*(k[0] for k in KINDS)), lambda base: F.filter(offered, apart(base)))).drop("t")


def _uses(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern``, ``uses``: how often each of ``patterns`` (``pattern``, ``last``) occurs in all texts."""
    words = docs.select(F.split(_normal(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"\s+").alias("words")).select("words", F.posexplode("words").alias("at", "last"))
    last, at = F.col("last"), F.col("at")
    each = F.explode(F.array(last, F.concat(F.get("words", at - 1), F.lit(" "), last), F.concat(last, F.lit(" _ "), F.get("words", at + 2)))).alias("pattern")
    if patterns.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS:
        words = words.join(F.broadcast(patterns.select("last").distinct()), "last").select(each)
        return words.join(F.broadcast(patterns.select("pattern")), "pattern").groupBy("pattern").agg(F.count("*").alias("uses"))
    return words.select(each).where("pattern is not null").groupBy("pattern").agg(F.count("*").alias("uses")).join(patterns.select("pattern"), "pattern")


def _seen(spans: DataFrame) -> DataFrame:
    """``patterns``, ``instance`` and ``seed`` of every seed and candidate."""
    of = lambda kind, seed: F.transform(kind, lambda s: F.struct(_patterns(s).alias("patterns"), F.lower(s["value"]).alias("instance"), F.lit(seed).alias("seed")))
    seen = F.concat(*(of(k[0], True) for k in KINDS), of("candidates", False))
    return spans.select(F.explode(seen).alias("s")).select("s.*").where(F.size("patterns") > 0)


def _few(patterns: DataFrame) -> DataFrame:
    """Patterns are sent to all executors if a count shows that they are few."""
    return F.broadcast(patterns) if patterns.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS else patterns


def scored_patterns(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``pattern``, ``confidence`` of the patterns with enough instances, from the rows of ``base_spans``."""
    edges = cut(_seen(spans).select(F.explode("patterns").alias("p"), "instance", "seed").groupBy("p.pattern", "p.last", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    known = cut(edges.groupBy("pattern", "last").agg(F.count("*").alias("instances"), F.sum("n").alias("hits")).where(F.col("instances") >= SUPPORT))
    if not known.limit(1).count():
        return known.select("pattern", F.lit(0.0).alias("confidence"))
    able = cut(known.join(_uses(docs, known.select("pattern", "last")), "pattern").where(F.col("hits") >= ACCEPT * F.col("uses")).select("pattern", "last", "uses"))
    least = F.when(F.col("last").endswith("=") & _looks_random(F.col("instance")), RANDOM).otherwise(0.0)
    edges = cut(edges.join(_few(able), ["pattern", "last"]).select("pattern", "last", "uses", "instance", "n", F.when(F.col("seed"), 1.0).otherwise(least).alias("least")))
    believed = edges.withColumn("belief", F.col("least"))
    for turn in range(ROUNDS):
        patterns = believed.groupBy("pattern", "last", "uses").agg(F.sum(F.col("n") * F.col("belief")).alias("hits")).select("pattern", "last", F.least(F.lit(1.0), F.col("hits") / F.col("uses")).alias("confidence"))
        if turn < ROUNDS - 1:
            patterns = cut(patterns)
            accepted = patterns.where(F.col("confidence") >= ACCEPT).select("pattern")
            found = edges.join(_few(accepted), "pattern").groupBy("instance").agg(F.min("last").alias("one"), F.max("last").alias("other"))
            elsewhere = (F.col("one") != F.col("last")) | (F.col("other") != F.col("last"))  # null, so not so, if no pattern has found it
            believed = cut(edges.join(found, "instance", "left").select("pattern", "last", "uses", "n", F.when(elsewhere, 1.0).otherwise(F.col("least")).alias("belief")))
    return patterns.select("pattern", "confidence")


def shaped(spans: DataFrame) -> DataFrame:
    """``doc_id``, ``h``, ``s``: parts of failed runs that have the shape of many seeds and pass their kind's test."""

    def seeds(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["value"].alias("value")))

    known = spans.select(F.explode(F.concat(*map(seeds, SHAPED))).alias("s")).select("s.*").withColumn("shape", _shape(F.col("value"))).groupBy("kind", "shape", "value").agg(F.count("*").alias("n"))
    shapes = cut(known.groupBy("kind", "shape").agg(F.sum("n").alias("hits"), F.count("*").alias("support")).where(F.col("support") >= SUPPORT))
    most = shapes.agg(F.max(F.size(F.split("shape", " ")))).first()[0] or 1

    at = Window.partitionBy("doc_id", "h", "run").orderBy("pos")
    base = F.transform(F.concat(*(k[0] for k in KINDS)), lambda b: F.struct(b["start"], b["stop"]))
    runs = spans.where("size(runs) > 0").select("doc_id", "h", base.alias("base"), F.explode("runs").alias("s")).select("doc_id", "h", "base", F.col("s.start").alias("run"), F.col("s.value").alias("value"))
    words = runs.dropDuplicates(["doc_id", "h", "run"]).select("doc_id", "h", "base", "run", F.posexplode(F.split("value", " ")))
    before = F.coalesce(F.sum(F.length("col") + 1).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = words.select("doc_id", "h", "base", (F.col("run") + before).cast("int").alias("start"), F.array(*(F.lead("col", n).over(at) for n in range(most))).alias("next"))
    grams = F.array(*(F.when(F.col("next")[n].isNotNull(), F.concat_ws(" ", F.slice("next", 1, n + 1))) for n in range(most)))
    parts = placed.select("doc_id", "h", "base", "start", F.explode(F.array_compact(grams)).alias("value"))
    parts = parts.withColumn("stop", F.col("start") + F.length("value")).withColumn("shape", _shape(F.col("value")))
    parts = parts.where(~F.exists("base", lambda b: (b["start"] < F.col("stop")) & (F.col("start") < b["stop"]))).drop("base")
    valid = F.coalesce(*(F.when((F.col("kind") == k), test(F.col("value"))) for k, _, _, test in KINDS if k in SHAPED), F.lit(False))
    found = cut(parts.join(shapes, "shape").where(valid))
    uses = found.groupBy("kind", "shape").agg(F.count("*").alias("others"))
    good = shapes.join(uses, ["kind", "shape"]).where(F.col("hits") >= ACCEPT * (F.col("hits") + F.col("others"))).select("kind", "shape")
    return found.join(good, ["kind", "shape"]).select("doc_id", "h", F.struct("start", "stop").alias("s"))


def contexts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``d``, ``g``, ``context``: the spans that shapes and patterns of high confidence found, by ``doc_id`` and ``h``, for texts that have any."""
    extra = shaped(spans)
    accepted = cut(scored_patterns(docs, spans).where(F.col("confidence") >= ACCEPT).select("pattern"))
    if accepted.limit(1).count():
        offered = spans.select("doc_id", "h", F.explode("candidates").alias("c")).select("doc_id", "h", _patterns(F.col("c")).alias("patterns"), F.lower("c.value").alias("instance"), F.struct("c.start", "c.stop").alias("s"))
        found = cut(offered.select("doc_id", "h", "s", "instance", F.explode("patterns.pattern").alias("pattern")).join(accepted, "pattern").select("doc_id", "h", "s", "instance"))
        long = found.where(F.length("instance") >= LONG).select("instance").distinct()
        again = offered.join(long, "instance", "left_semi").select("doc_id", "h", "s")
        extra = extra.unionByName(found.select("doc_id", "h", "s")).unionByName(again)
    return extra.groupBy("doc_id", "h").agg(F.collect_set("s").alias("found")).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), _apart(F.col("found")).alias("context"))


def _with_contexts(docs: DataFrame, spans: DataFrame, *kept: str) -> DataFrame:
    """``spans`` with ``context``. Only rows that can have such spans are joined."""
    found = contexts(docs, spans)
    columns = [*kept, *(k[0] for k in KINDS)]
    may = F.size("candidates") + F.size("runs") > 0
    joined = spans.where(may).join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    rest = spans.where(~may).select(*columns, _none(_PLACE).alias("context"))
    return joined.select(*columns, F.coalesce("context", _none(_PLACE)).alias("context")).unionAll(rest)


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``h``, a span array per kind, and ``context``: spans that patterns of high confidence found."""
    return _with_contexts(docs, cut(base_spans(docs)), "doc_id", "h")


_PLACE = "struct<start:int,stop:int>"


def _apart(spans: Column) -> Column:
    """Spans from left to right, of overlapping ones the first and of these the longest."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["stop"] - a["stop"]))
    first = F.struct(F.lit(0).alias("at"), _none(_PLACE).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fits = s["start"] >= acc["at"]
        return F.struct(F.when(fits, s["stop"]).otherwise(acc["at"]).alias("at"), F.when(fits, F.array_append(acc["out"], s)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ordered, first, step, lambda acc: acc["out"])


def listed(*kinds: str) -> Column:
    """kind:start:end of the spans of ``kinds``, in this order and then by start, comma-joined."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string")))

    return F.concat_ws(",", F.concat(*map(of, kinds)))


def report(found: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, the digest of their spans, and all spans as text."""
    base = tuple(k[0] for k in KINDS)
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in base), F.sha2(listed(*base), 256).alias("base_sha256"), listed(*base, "context").alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    A column ``n_chars`` gets the new length where the text changed. All other columns stay as they
    are. Texts travel only where a context span is possible.
    """
    kinds = (*(k[0] for k in KINDS), "context")

    def tag(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(f"[{kind.upper()}]").alias("kind")))

    found = _with_contexts(docs, cut(base_spans(docs, keep=True)), "row")
    tagged = found.select("row", F.array_sort(F.concat(*map(tag, kinds))).alias("spans"))
    text = F.col("row.text").cast("string")

    def between(blocks: Column, start: Column, stop: Column) -> Column:
        """Characters from ``start`` to before ``stop``, found without counting from the text's first one."""
        first = (start / TEXT_BLOCK).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, (stop / TEXT_BLOCK).cast("int") - first + 1), "")
        return near.substr(start - first * TEXT_BLOCK + 1, stop - start)

    def replaced(blocks: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            gap = F.concat(between(blocks, acc["at"], s["start"]), s["kind"])
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], F.array_append(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("at"), _none("string").alias("out"))
        return F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), between(blocks, acc["at"], F.length(text))))

    masked = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), 0), replaced)
    ready = tagged.select("row", F.when(F.size("spans") > 0, masked).alias("changed"))
    kind = {f.name: f.dataType for f in docs.schema.fields}

    def value(name: str) -> Column:
        own = F.col("row")[name]
        new = {"text": F.col("changed"), "n_chars": F.length("changed")}.get(name)
        return own.alias(name) if new is None else F.when(F.col("changed").isNotNull(), new.cast(kind[name])).otherwise(own).alias(name)

    return ready.select(*map(value, docs.columns))
