"""Personal data by fixed patterns, and further identifiers by the contexts that such data stands in.

Everything is DataFrame functions. A text is searched once, for its runs of words with a digit or an
``@``; every match of the base patterns lies inside one run, so these are matched in the short runs.
Places come from the lengths of what lies between matches.

Bootstrapping: base spans are the seeds. The words around an occurrence make its lexical patterns
(the word before, the two words before, the words on both sides, the two words after). Patterns and
instances (distinct identifier texts) form a graph, which Spark scores for ``ROUNDS`` rounds: a
pattern's confidence in a kind is the belief in its instances of that kind over all its instances,
unknown ones counted in part, one more being added to the divisor, so that few instances don't
suffice; an instance's belief joins the confidences of its confident patterns (one less the product
of what each leaves open). Only instances believed in (``BELIEVED``) count in the next round, so that
doubtful ones don't raise each other. What looks like a kind (``FORMS``) and is believed to be of it
is added as a span wherever it occurs, as are texts of seeds that the base patterns miss elsewhere.

Edges are distinct (pattern, instance) pairs, so a thousand copies of a document say no more than one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import stored

KINDS = ["email", "ip", "card", "phone"]
#: Words with a digit or an @, joined to the next such word where only blanks, parentheses, dots and dashes lie between.
RUN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:[\x20().-]++[^\s0-9@]*+[0-9@]\S*+)*+"
#: The base patterns. They are possessive and begin where a match can, so that no text takes quadratic time or deep recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What an identifier of a kind looks like that the base pattern of the kind needn't match, with the number of its digits.
FORMS = {
    "email": (r"^\S*[A-Za-z]\S*@\S+$", 0, 64),
    "ip": (r"^(?:[0-9]+(?:[.:][0-9]+){2,}|[0-9a-fA-F]*(?::[0-9a-fA-F]*){2,})$", 1, 64),
    "card": (r"^[0-9][0-9\x20-]*[0-9]$", 8, 24),
    "phone": (r"^[+(]?[0-9][0-9\x20().-]*[0-9]$", 6, 15),
}
ROUNDS, CONFIDENT, SUPPORT, BELIEVED, UNKNOWN = 3, 0.8, 5, 0.95, 0.5
#: Characters of a context on each side; the longest text of an instance.
CONTEXT, LONGEST = 60, 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a column named in a lambda may be computed for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def running(lengths: Column) -> Column:
    """Running sums of an array of integers, in blocks of the root of its size, as each step of a fold that appends copies the array."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, b: a + b)
    edge = lambda x: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
    blocks = lambda x: F.transform(F.sequence(F.lit(0), edge(x) - 1), lambda i: F.slice(x, i * edge(x) + 1, edge(x)))
    before = lambda sums: F.transform(sums, lambda _, i: total(F.slice(sums, 1, i)))
    inside = lambda block, offset: F.transform(block, lambda _, k: offset + total(F.slice(block, 1, k + 1)))
    return F.flatten(let(let(lengths, blocks), lambda all_: F.zip_with(all_, let(F.transform(all_, total), before), inside)))


def matches(text: Column, pattern: str) -> Column:
    """Array of at, match, before, after for every match: its start in code points from 0, and what lies between it and its neighbours."""

    def placed(found: Column) -> Column:
        n = F.size(found)

        def zipped(gaps: Column) -> Column:
            before, after = F.slice(gaps, 1, n), F.slice(gaps, 2, n)
            previous = F.concat(F.array(F.lit("")), F.slice(found, 1, n - 1))
            at = running(F.zip_with(before, previous, lambda g, m: F.length(g) + F.length(m)))
            first = F.zip_with(at, found, lambda a, m: F.struct(a.alias("at"), m.alias("match")))
            second = F.zip_with(before, after, lambda b, a: F.struct(b.alias("before"), a.alias("after")))
            return F.zip_with(first, second, lambda x, y: F.struct(x["at"].alias("at"), x["match"].alias("match"), y["before"].alias("before"), y["after"].alias("after")))

        none = F.array().cast("array<struct<at:int,match:string,before:string,after:string>>")
        return F.when(n > 0, let(F.split(text, pattern, -1), zipped)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    turned = F.split(F.reverse(number), "")
    value = lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(turned, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    """Whether a match of a base pattern counts."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        n = F.length(digits(match))
        return F.when(n.between(12, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def runs_of(docs: DataFrame) -> DataFrame:
    """row, doc_id, runs of every document: array of start, text and the context on both sides."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    near = lambda x: F.struct(x["at"].alias("start"), x["match"].alias("text"), F.substring(x["before"], -CONTEXT, CONTEXT).alias("left"), F.substring(x["after"], 1, CONTEXT).alias("right"))
    return texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.transform(matches(F.col("text"), RUN), near).alias("runs"))


def _context(before: Column, after: Column) -> Column:
    """The lexical patterns of an occurrence between two texts: lower case, digits as 0; those that lack a word are left out."""
    plain = lambda t: F.lower(F.regexp_replace(F.regexp_replace(t, "[0-9]", "0"), r"\s+", " "))
    left, right = plain(F.substring(before, -CONTEXT, CONTEXT)), plain(F.substring(after, 1, CONTEXT))
    one, two = F.regexp_extract(left, r"(\S++ ?)$", 1), F.regexp_extract(left, r"(\S+ \S+ ?)$", 1)
    next_one, next_two = F.regexp_extract(right, r"^( ?\S++)", 1), F.regexp_extract(right, r"^( ?\S+ \S++)", 1)
    named = [("before", one, one), ("before2", two, two), ("after2", next_two, next_two), ("around", F.concat(one, F.lit("|"), next_one), F.when(one != "", next_one).otherwise(""))]
    return F.filter(F.array(*[F.when(test != "", F.concat(F.lit(f"{name}:"), text)) for name, text, test in named]), lambda p: p.isNotNull())


def _bits(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(flags)])


def occurrences(runs: DataFrame) -> DataFrame:
    """row, start, end, kind (number of the base kind, null: none), instance, fits, patterns of base spans and of what else may be an identifier.

    A run without a base span is one candidate, or one for each of its words where every word has seven digits
    or more; ``fits`` has a bit for each kind that it looks like.
    """
    each = runs.where(F.size("runs") > 0).select("row", F.explode("runs").alias("run")).select("row", F.col("run.start").alias("from"), "run.text", "run.left", "run.right")

    def hit(kind: Column, at: Column, match: Column, before: Column, after: Column) -> Column:
        return F.struct(kind.alias("kind"), at.alias("at"), match.alias("match"), F.substring(before, -CONTEXT, CONTEXT).alias("before"), F.substring(after, 1, CONTEXT).alias("after"))

    def hits(name: str, number: int) -> Column:
        def all_(found: Column) -> Column:
            def one(x: Column, k: Column) -> Column:
                # What lies between two matches of the kind is context of both.
                before = F.concat(F.when(k == 0, F.col("left")).otherwise(""), F.substring(x["before"], -CONTEXT, CONTEXT))
                after = F.concat(F.substring(x["after"], 1, CONTEXT), F.when(k == F.size(found) - 1, F.col("right")).otherwise(""))
                return hit(F.lit(number), x["at"], x["match"], before, after)

            return F.filter(F.transform(found, one), lambda s: _valid(name, s["match"]))

        return let(matches(F.col("text"), BASE[name]), all_)

    def unit(word: Column, at: Column, before: Column, after: Column) -> Column:
        skipped = F.length(F.regexp_extract(word, r"^[^0-9A-Za-z+(]*+", 0))
        match = F.regexp_extract(word, r"(?s)[0-9A-Za-z+(].*[0-9A-Za-z)]|[0-9A-Za-z]", 0)
        rest = F.substring(word, skipped + F.length(match) + 1, F.lit(CONTEXT))
        return hit(F.lit(None).cast("int"), at + skipped, match, F.concat(before, F.substring(word, F.lit(1), skipped)), F.concat(rest, after))

    def units(words: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            before = F.when(k == 0, F.col("left")).otherwise(F.concat(F.get(words, k - 1)["match"], F.lit(" ")))
            after = F.when(k == F.size(words) - 1, F.col("right")).otherwise(F.concat(F.lit(" "), F.get(words, k + 1)["match"]))
            return unit(x["match"], x["at"], before, after)

        apart = F.forall(words, lambda x: (F.length(x["before"]) <= 1) & (F.length(digits(x["match"])) >= 7))
        return F.when(apart, F.transform(words, one)).otherwise(F.array(unit(F.col("text"), F.lit(0), F.col("left"), F.col("right"))))

    every = F.concat(*[hits(name, n) for n, name in enumerate(BASE)])
    either = let(every, lambda found: F.when(F.size(found) > 0, found).otherwise(let(matches(F.col("text"), r"[^\x20]++"), units)))
    spans = each.select("row", "from", F.explode(either).alias("hit")).select("row", "from", "hit.*").where("match <> ''").withColumn("long", F.length("match"))
    fits = _bits([(F.col("long") <= LONGEST) & F.col("match").rlike(form) & F.length(digits(F.col("match"))).between(least, most) for form, least, most in FORMS.values()])
    start = F.col("from") + F.col("at")
    instance = F.md5(F.lower("match").cast("binary"))
    return spans.select("row", start.alias("start"), (start + F.col("long")).alias("end"), "kind", instance.alias("instance"), fits.alias("fits"), _context(F.col("before"), F.col("after")).alias("patterns"))


def believed(found: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT, believe: float = BELIEVED) -> DataFrame:
    """instance, kind: what the pattern-instance graph of ``found`` (occurrences) takes for identifiers, seeds included."""
    nodes = found.groupBy("instance").agg(F.min("kind").alias("seed"), F.max("fits").alias("fits"))
    pairs = found.select("instance", F.explode("patterns").alias("pattern")).distinct()
    edges = stored(pairs.join(nodes, "instance"), "edges")
    seeds = [F.count_if(F.col("seed") == k).cast("double").alias(f"seed{k}") for k in range(len(KINDS))]
    patterns = stored(edges.groupBy("pattern").agg(F.count("*").alias("instances"), *seeds), "patterns")
    open_ = edges.where("seed is null and fits > 0").select("pattern", "instance", "fits")
    beliefs = None
    for _ in range(rounds):
        scored = patterns
        for k in range(len(KINDS)):
            scored = scored.withColumn(f"known{k}", F.col(f"seed{k}"))
        if beliefs is not None:
            sums = [F.sum(F.when(F.col("kind") == k, F.col("belief")).otherwise(0.0)).alias(f"more{k}") for k in range(len(KINDS))]
            more = open_.join(beliefs.where(F.col("belief") >= believe), "instance").groupBy("pattern").agg(*sums)
            scored = patterns.join(more, "pattern", "left")
            for k in range(len(KINDS)):
                scored = scored.withColumn(f"known{k}", F.col(f"seed{k}") + F.coalesce(f"more{k}", F.lit(0.0)))
        every = reduce(lambda a, b: a + b, [F.col(f"known{k}") for k in range(len(KINDS))])
        # An instance may be believed to be of two kinds, so what is known can exceed what there is.
        divisor = every + UNKNOWN * F.greatest(F.col("instances") - every, F.lit(0.0)) + 1
        trusted = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"known{k}").alias("known"), (F.col(f"known{k}") / divisor).alias("confidence")) for k in range(len(KINDS))])
        good = scored.select("pattern", F.explode(trusted).alias("t")).select("pattern", "t.*").where((F.col("known") >= support) & (F.col("confidence") >= confident))
        drawn = open_.join(good, "pattern").where(F.expr("shiftright(fits, kind) % 2 = 1"))
        beliefs = stored(drawn.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.ln(1 - F.col("confidence"))))).alias("belief")), "beliefs")
    best = beliefs.where(F.col("belief") >= believe).groupBy("instance").agg(F.min_by("kind", F.struct(-F.col("belief"), "kind")).alias("kind"))
    return best.unionByName(nodes.where("seed is not null").select("instance", F.col("seed").alias("kind")))


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row of ``docs`` (doc_id, text).

    Counts and digest are of the base spans, ``spans`` has all, ``n_added`` counts those that the contexts
    add. A null or empty text has none, with the digest of the empty text. Rows that repeat a doc_id, and rows
    without one, are documents of their own. Other columns are ignored; an empty table gives no rows.
    """
    runs = stored(runs_of(docs), "runs")
    found = stored(occurrences(runs), "occurrences")
    known = believed(found, rounds).select("instance", F.col("kind").alias("added"))
    base = found.where("kind is not null").select("row", "start", "kind", "end", F.lit(True).alias("base"))
    extra = found.where("kind is null").join(known, "instance").select("row", "start", F.col("added").alias("kind"), "end", F.lit(False).alias("base"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("kind", "int"), ("end", "int"), ("base", "boolean"))]
    # One shuffle by row: every document's own line, and its spans.
    spans = base.unionByName(extra).select("row", F.lit(None).cast("long").alias("doc_id"), "start", "kind", "end", "base")
    lines = runs.select("row", "doc_id", *none).unionByName(spans)
    span = F.when(F.col("start").isNotNull(), F.struct("start", "kind", "end", "base"))
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    whole = lines.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *counts, F.count_if(~F.col("base")).alias("n_added"), F.sort_array(F.collect_list(span)).alias("all"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda parts: F.array_join(F.transform(parts, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    digest = F.sha2(text(F.filter("all", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256")
    return whole.select("doc_id", *[f"n_{k}" for k in KINDS], digest, text(F.col("all")).alias("spans"), "n_added")
