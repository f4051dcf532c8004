"""PII (1): weak-supervision aggregation, in DataFrame functions alone.

Strict patterns give the contract's base spans, looser ones further candidates
(numbers without a country code, written-out addresses, card numbers of other
lengths or with a wrong check digit) and those of further kinds: secrets that are
assigned to a name, bank account numbers (IBAN) and social-security numbers. Six
labelers vote on every candidate: yes, no or nothing. They are the strict pattern
with its check (octets, check digit), the form (number of digits, remainder of an
account number, letters and digits of a secret), a gazetteer (top-level domains,
issuer, country and key prefixes), words before that speak for the kind, words
before that speak against, and what stands next to the span. For each kind expectation-maximisation estimates the labelers'
reliabilities from the counts of vote patterns (at most 3 ** 6, whatever the
input), and the resulting posteriors train the final classifier, naive Bayes over
the span's own features. Base spans stay; a further candidate is added if the
classifier gives it 0.5 or more, its form is its kind's, it stands alone, no word
before it speaks against it, and it overlaps nothing found before.

Positions come from splitting the text by the pattern: the lengths of what lies
between the matches, added up in a window over the document's matches. Patterns
use possessive repeats, so long texts neither recurse nor backtrack.

Defined results
* null text is empty; a document without spans has counts 0, the digest of the
  empty string and empty spans.
* Every row gives one row, repeated rows and rows without id too. An empty table
  gives no rows. Other columns are ignored.
* Positions are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

KINDS = ("email", "ip", "card", "phone")
#: Kinds beyond the contract's; their spans come after those.
MORE_KINDS = ("secret", "iban", "ssn")
#: Matches of these, if valid, are the base spans.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}"
              r" ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,10}"),
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![ .-]?[0-9])",
    "secret": r"(?<=[:=] {0,2}[\"']{0,1})[A-Za-z0-9+/_-]{16,200}+(?![A-Za-z0-9+/_-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A match of the kind's strict or loose pattern needs one of these in the text.
GATES: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][0-9 -]{11}"),
    "phone": lambda t: t.contains("+"),
    "loose email": lambda t: t.contains("(at)") | t.contains("[at]"),
    "loose phone": lambda t: t.rlike(r"[0-9][ .-][0-9]{3}"),
    "loose secret": lambda t: t.rlike(r"[:=] {0,2}[\"']?[A-Za-z0-9+/_-]{16}"),
    "loose iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "loose ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
PATTERNS = [*STRICT, *(f"loose {k}" for k in LOOSE)]
BEFORE, AFTER = 40, 1
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "co", "example", "test")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
COUNTRIES = r"^\+?(?:1|33|34|44|49|39|41|43|31|32|351|45|46|47|48|7|81|86|91|55|52|61)"
#: Countries whose account numbers begin with these letters have this many characters.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22,
                "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
KEY_PREFIXES = r"^(?:AKIA|ASIA|gh[pousr]_|sk[-_]|pk[-_]|xox[abp]-|AIza|eyJ)"
SPEAKS_FOR = {
    "email": r"mail|contact|write|address|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|addr|node|login",
    "card": r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|pay",
    "phone": r"phone|tel|call|mobile|cell|fax|contact|ruf|appel|llama",
    "secret": r"token|secret|passw|pwd|credential|auth|\bkey|_key|-key|apikey",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social|security|tax",
}
SPEAKS_AGAINST = {
    "email": r"example of|regex|pattern",
    "ip": r"version|section|chapter|release|\bv$",
    "card": r"\b(?:isbn|order|serial|invoice|ref|tracking|account id)\b",
    "phone": r"\b(?:isbn|order|serial|invoice|version|date|price)\b|\$ ?$",
    "secret": r"\b(?:sha-?(?:1|256)|md5|digest|checksum|commit|path|url|href|src)\b|https?:?$",
    "ssn": r"\b(?:isbn|order|serial|invoice|part)\b",
}
LABELERS = 6
ROUNDS = 25
ACCEPT = 0.5
NOTHING = -1


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _found(text: Column, pattern: str, gate: Column) -> Column:
    """An array of what lies between matches (its length, its end and its start)
    and of the matches; the last has none."""
    between = F.transform(F.split(text, pattern, -1), lambda s: F.struct(
        F.length(s).alias("gap"), F.right(s, F.lit(BEFORE)).alias("before"), F.left(s, F.lit(AFTER)).alias("after")))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(gate, F.arrays_zip(between.alias("between"), matches.alias("match")))


def matches(docs: DataFrame, folder: str) -> DataFrame:
    """Written, a row for each document: its number, doc_id and the matches of each
    pattern. Texts are read once and not kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = PATTERNS
    patterns = [*STRICT.values(), *LOOSE.values()]
    return written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text")).select(
        "row", "doc_id", *[_found(F.col("text"), p, GATES[name](F.col("text"))).alias(name)
                           for name, p in zip(names, patterns)]), folder, "matches")


def candidates(found: DataFrame) -> DataFrame:
    """A row for each match: row, kind, strict, start, end, match, before, after."""
    parts = None
    for name in PATTERNS:
        kind = name.removeprefix("loose ")
        own = found.where(F.size(name) > 1).select(
            "row", F.lit(kind).alias("kind"), F.lit(name == kind).alias("strict"), F.posexplode(name).alias("at", "m"))
        parts = own if parts is None else parts.unionByName(own)
    of = Window.partitionBy("row", "kind", "strict").orderBy("at")
    gap, match = F.col("m.between.gap"), F.col("m.match")
    end = F.sum(gap + F.coalesce(F.length(match), F.lit(0))).over(of)
    return (parts.select("row", "kind", "strict", match.alias("match"), F.lower("m.between.before").alias("before"),
                         F.lead("m.between.after").over(of).alias("after"), end.cast("long").alias("end"))
            .where("match IS NOT NULL").withColumn("start", F.col("end") - F.length("match")))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    def value(d: Column, i: Column) -> Column:
        twice = 2 * d.cast("int")
        return F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0),
                       lambda total, v: total + F.coalesce(v, F.lit(0))) % 10 == 0


def structure(kind: Column, match: Column) -> Column:
    """Whether a match has its kind's form: the contract's validity for strict ones."""
    digits = digits_of(match)
    n = F.length(digits)
    octets = F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(F.lit("0"), p)) <= 3)
                      & (F.coalesce(F.right(p, F.lit(4)).cast("int"), F.lit(0)) <= 255))
    return (F.when(kind == "ip", octets).when(kind == "card", n.between(16, 19) & luhn(digits))
            .when(kind == "phone", n.between(8, 15)).otherwise(F.lit(True)))


def iban_remainder(match: Column) -> Column:
    """97-remainder of an account number: the first four characters moved behind the
    others, letters as two digits. 1 for a right one."""
    compact = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.expr("substring(replace(match, ' ', ''), 5)"), F.left(compact, F.lit(4)))
    def read(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), read)


def form(kind: Column, match: Column, n: Column) -> Column:
    """Whether a candidate has the shape of its kind, whatever a check digit says."""
    letters, figures = match.rlike("[A-Za-z]"), match.rlike("[0-9]")
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    compact = F.length(F.replace(match, F.lit(" "), F.lit("")))
    known = F.coalesce(lengths[F.left(match, F.lit(2))] == compact, compact.between(15, 34))
    return (F.when(kind == "card", n.between(13, 19))
            .when(kind == "secret", letters & figures & (F.length(match) >= 20))
            .when(kind == "iban", known & (iban_remainder(match) == 1))
            .when(kind == "ssn", ~match.rlike("^(?:000|666|9)|-00-|-0000$"))
            .otherwise(structure(kind, match)))


def votes(spans: DataFrame) -> DataFrame:
    """``spans`` with ``base``, the labelers' ``votes`` (1, 0 or NOTHING) and ``features``."""
    kind, match = F.col("kind"), F.col("match")
    digits = digits_of(match)
    n = F.length(digits)

    def of_kind(table: dict[str, str]) -> Column:
        hit = F.lit(False)
        for k, pattern in table.items():
            hit = F.when(kind == k, F.col("before").rlike(pattern)).otherwise(hit)
        return hit

    well_formed = structure(kind, match)
    base = F.col("strict") & well_formed
    other_form = form(kind, match, n)
    gazetteer = (F.when(kind == "email", F.lower(F.regexp_extract(match, r"([A-Za-z]+)$", 1)).isin(*TOP_DOMAINS))
                 .when(kind == "card", digits.rlike(ISSUERS)).when(kind == "phone", match.rlike(COUNTRIES))
                 .when(kind == "secret", match.rlike(KEY_PREFIXES) | match.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"))
                 .when(kind == "iban", F.left(match, F.lit(2)).isin(*IBAN_LENGTHS))
                 .when(kind == "ssn", F.lit(False))
                 .otherwise(~match.rlike(r"^(?:0|22[4-9]|2[3-5][0-9])\.")))
    # lists that name only some of a kind's members: not to be listed says nothing
    listed = F.when(gazetteer, 1).otherwise(F.when(kind.isin("card", "secret", "iban", "ssn"), NOTHING).otherwise(0))
    alone = ~F.col("before").rlike(r"[a-z0-9]$") & ~F.coalesce(F.col("after"), F.lit("")).rlike("^[A-Za-z0-9]")
    yes_no = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    says = [
        F.when(base, 1).otherwise(NOTHING),
        yes_no(other_form),
        F.coalesce(listed, F.lit(0)),
        F.when(of_kind(SPEAKS_FOR), 1).otherwise(NOTHING),
        F.when(of_kind(SPEAKS_AGAINST), 0).otherwise(NOTHING),
        yes_no(alone),
    ]
    named = lambda name, c: F.concat(F.lit(f"{name}="), F.coalesce(c.cast("string"), F.lit("")))
    features = F.array(
        named("form", other_form), named("prefix", gazetteer), named("alone", alone),
        named("for", of_kind(SPEAKS_FOR)), named("against", of_kind(SPEAKS_AGAINST)),
        named("digits", F.least(n, F.lit(20))), named("length", F.least(F.length(match), F.lit(60)) / 4),
        named("separator", F.regexp_extract(match, "[ ().-]", 0)))
    open_to = F.coalesce(other_form & alone, F.lit(False)) & ~of_kind(SPEAKS_AGAINST)
    return spans.withColumns({"base": F.coalesce(base, F.lit(False)), "open": open_to, "votes": F.array(*says),
                              "features": features})


def posterior(state: Column, says: Column) -> Column:
    """P(span is personal data | votes) under a state (prior, hit, miss): hit and
    miss are the chances that a labeler that votes says yes to a right or wrong one."""
    def odds(total: Column, j: Column) -> Column:
        hit, miss = state["hit"][j], state["miss"][j]
        return total + (F.when(says[j] == 1, F.log(hit / miss)).when(says[j] == 0, F.log((1 - hit) / (1 - miss)))
                        .otherwise(F.lit(0.0)))
    start = F.log(state["prior"] / (1 - state["prior"]))
    return 1 / (1 + F.exp(-F.aggregate(F.sequence(F.lit(0), F.lit(LABELERS - 1)), start, odds)))


def reliabilities(patterns: Column) -> Column:
    """EM over an array of (votes, n): the state after ROUNDS steps. Two votes of 0.8
    and 0.2 for every rate keep the classes apart and the rates off 0 and 1."""
    def rate(with_q: Column, j: Column, right: bool) -> Column:
        def add(total: Column, p: Column) -> Column:
            w = p["n"] * (p["q"] if right else 1 - p["q"])
            return F.struct((total["yes"] + F.when(p["votes"][j] == 1, w).otherwise(0.0)).alias("yes"),
                            (total["all"] + F.when(p["votes"][j] >= 0, w).otherwise(0.0)).alias("all"))
        kept = 0.8 if right else 0.2
        return F.aggregate(with_q, F.struct(F.lit(2 * kept).alias("yes"), F.lit(2.0).alias("all")), add,
                           lambda t: t["yes"] / t["all"])

    def step(state: Column, _: Column) -> Column:
        with_q = F.transform(patterns, lambda p: F.struct(
            p["votes"].alias("votes"), p["n"].cast("double").alias("n"), posterior(state, p["votes"]).alias("q")))

        def update(ps: Column) -> Column:
            total = F.aggregate(ps, F.lit(2.0), lambda t, p: t + p["n"])
            right = F.aggregate(ps, F.lit(1.0), lambda t, p: t + p["n"] * p["q"])
            labelers = F.sequence(F.lit(0), F.lit(LABELERS - 1))
            return F.struct((right / total).alias("prior"), F.transform(labelers, lambda j: rate(ps, j, True)).alias("hit"),
                            F.transform(labelers, lambda j: rate(ps, j, False)).alias("miss"))
        return let(with_q, update)

    start = F.struct(F.lit(0.5).alias("prior"), F.array(*[F.lit(0.8)] * LABELERS).alias("hit"),
                     F.array(*[F.lit(0.2)] * LABELERS).alias("miss"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def classified(spans: DataFrame, folder: str) -> DataFrame:
    """``spans`` with ``p``, what the final classifier gives them."""
    patterns = spans.groupBy("kind", "votes").agg(F.count("*").alias("n"))
    states = patterns.groupBy("kind").agg(
        reliabilities(F.collect_list(F.struct("votes", "n"))).alias("state"))
    soft = written(patterns.join(states, "kind").withColumn("q", posterior(F.col("state"), F.col("votes"))),
                   folder, "posteriors")
    soft = soft.select("kind", "votes", "q")  # at most 3 ** LABELERS rows for each kind
    # naive Bayes from soft labels; features are few by construction
    labelled = (spans.groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))
                .join(soft, ["kind", "votes"]).select("kind", F.explode(F.concat("features", F.array(F.lit("all")))).alias("feature"),
                                                      (F.col("n") * F.col("q")).alias("right"), (F.col("n") * (1 - F.col("q"))).alias("wrong")))
    weights = labelled.groupBy("kind", "feature").agg(F.sum("right").alias("right"), F.sum("wrong").alias("wrong"))
    totals = weights.where("feature = 'all'").select("kind", F.col("right").alias("all_right"), F.col("wrong").alias("all_wrong"))
    weights = weights.join(totals, "kind").select("kind", F.struct("feature", F.when(
        F.col("feature") == "all", F.log((F.col("right") + 1) / (F.col("wrong") + 1))).otherwise(
        F.log((F.col("right") + 1) / (F.col("all_right") + 2)) - F.log((F.col("wrong") + 1) / (F.col("all_wrong") + 2))
    ).alias("w")).alias("e")).groupBy("kind").agg(F.map_from_entries(F.collect_list("e")).alias("weights"))
    distinct = spans.select("kind", "features").distinct().join(weights, "kind")
    odds = F.aggregate(F.concat("features", F.array(F.lit("all"))), F.lit(0.0),
                       lambda t, f: t + F.coalesce(F.col("weights")[f], F.lit(0.0)))
    scored = written(distinct.select("kind", "features", (1 / (1 + F.exp(-odds))).alias("p")), folder, "scored")
    return spans.join(scored, ["kind", "features"])


def find(docs: DataFrame) -> DataFrame:
    """For each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    folder = shared_dir(docs.sparkSession)
    found = matches(docs, folder)
    spans = written(votes(candidates(found)), folder, "candidates")
    spans = classified(spans, folder)
    earlier = Window.partitionBy("row").orderBy("start", F.col("base").cast("int").desc(), "end")
    later = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("base").cast("int"), F.col("end").desc())
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    likely = F.col("base") | (F.col("open") & (F.col("p") >= ACCEPT))
    spans = (spans.where(likely)
             .withColumn("left", F.coalesce(F.max("end").over(upto(earlier)), F.lit(0)))
             .withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(upto(later)))
             .where(F.col("base") | ((F.col("left") <= F.col("start")) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))))
    order = F.array_position(F.array(*map(F.lit, KINDS + MORE_KINDS)), F.col("kind"))
    one = F.struct(order.alias("of"), "start", "end", "kind")
    lists = spans.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("base"), one))).alias("base"), F.sort_array(F.collect_list(one)).alias("all"))

    def joined(c: str) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")

    def number(k: str) -> Column:
        return F.coalesce(F.size(F.filter("base", lambda s: s["kind"] == k)), F.lit(0)).cast("long")

    return found.select("row", "doc_id").join(lists, "row", "left").select(
        "doc_id", *[F.when(F.col("base").isNull(), F.lit(0).cast("long")).otherwise(number(k)).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce(joined("base"), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(joined("all"), F.lit("")).alias("spans"))


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
