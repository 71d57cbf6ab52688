"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

1. Candidates of four kinds (email, ip, card, phone) are found by strict patterns (the base)
   and by looser ones: e-mail addresses with "(at)" and "(dot)", IPv6 addresses, card numbers in
   groups whose checksum fails, phone numbers without a country code.
2. Labelers vote yes, no or nothing on each candidate: a pattern (its strict form; yes or nothing), a check
   (Luhn, value ranges, plausible lengths), a gazetteer (top-level domains, issuer and country
   prefixes, reserved networks), and the words before and after it.
3. Expectation-maximisation over the counts of vote patterns estimates each labeler's
   reliability for each kind and a probability for each pattern.  There are at most 3 ** 5
   patterns a kind, so the counts are a bounded table.
4. A logistic classifier over a candidate's own binary features is trained on these soft labels,
   again over a bounded table of counts, and decides on the candidates outside the base.

Everything that touches texts is DataFrame functions, in time linear in a text however many
candidates it has; the two fits are arithmetic over bounded tables of counts.  Base spans always
stay; an added span never overlaps a base span.  Added spans of two kinds may overlap each other:
each is judged on its own, and both may stay.

Offsets are code points, ends exclusive.  Null and empty texts have no spans.  Every row has its
own result, so repeated rows have equal ones, and the key may be null or of any type.  Other
columns, whatever their names, take no part.  An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: Each equals its plain form, leftmost and non-overlapping, for every match that can pass its check; possessive, so linear in the text.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9])++",
}
LOOSE = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+ ?[\(\[{{]at[\)\]}}] ?[A-Za-z0-9-]{{1,63}}+(?: ?(?:\.|[\(\[{{]dot[\)\]}}]) ?[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}(?![0-9])(?![ -][0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])(?![.-][0-9])",
}
#: A text without these has no candidate of the kind; cheap to test.
GATES = {"email": r"@|[\(\[{]at[\)\]}]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]|[0-9]{3}[ .-][0-9]{4}"}
#: Words that stand near each kind, and near its look-alikes.
NEAR = {
    "email": "e-?mail|mail|contact|write|address|correo|courriel|kontakt",
    "ip": "ip|host|server|address|addr|from|login|client|adresse",
    "card": "card|visa|master|credit|debit|payment|tarjeta|carte|karte|cc",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|tel[eé]fono|t[eé]l[eé]phone|telefon|anruf",
}
UNLIKE = {"email": "password|regex|example of", "ip": "version|release|v|section|chapter|§|build", "card": "isbn|order|invoice|serial|tracking|id", "phone": "version|isbn|order|invoice|serial|page|id"}
DOMAINS = "com|org|net|edu|gov|io|co|de|fr|es|uk|eu|info|biz|us|ca|ch|at|it|nl|be|pl|se|no|mx|ar|br|jp|in|au"
RESERVED = r"^(?:0|10|127|255)\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."
LABELERS = 5


MATCH = "array<struct<start:int,end:int,s:string,before:string,after:string>>"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scanned(items: Column, zero: Column, step, emit, kind: str, block: int = 256) -> Column:
    """emit(state, x) for every x of an array; step(state, x) makes the state for the next one.

    kind: the type of the outcome.  An array grows by copying, so outcomes are gathered in blocks
    first: the cost is linear for all arrays that there are.
    """

    def inner(state: Column, xs: Column) -> Column:
        start = F.struct(state.alias("state"), F.array().cast(kind).alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], F.array(emit(a["state"], x))).alias("out")))

    def outer(a: Column, xs: Column) -> Column:
        return let(inner(a["state"], xs), lambda i: F.struct(i["state"].alias("state"), F.concat(a["out"], F.array(i["out"])).alias("out")))

    blocks = let(items, lambda z: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(z) - 1) / block).cast("int"))), lambda b: F.slice(z, b * block + 1, F.lit(block))))
    return F.flatten(F.aggregate(blocks, F.struct(zero.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), outer)["out"])


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, s, before, after>> of all matches, from what lies between them; before, after: the 24 characters before and 4 after."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    last = lambda c: F.substring(c, -24, 24)
    # each gap with the match behind it, and the start of what follows that one
    next_ = F.transform(F.slice(F.concat(between, F.array(F.lit(""))), 2, F.size(between)), lambda g: F.left(g, F.lit(4)))
    zipped = F.arrays_zip(between.alias("g"), found.alias("m"), next_.alias("n"), F.slice(F.concat(found, F.array(F.lit(""))), 2, F.size(found) + 1).alias("o"))

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + F.char_length(x["g"]) + F.char_length(F.coalesce(x["m"], F.lit("")))
        return F.struct(at.cast("int").alias("at"), last(F.concat(a["tail"], x["g"], F.coalesce(x["m"], F.lit("")))).alias("tail"))

    def emit(a: Column, x: Column) -> Column:
        start = a["at"] + F.char_length(x["g"])
        after = F.left(F.concat(F.coalesce(x["n"], F.lit("")), F.coalesce(x["o"], F.lit(""))), F.lit(4))
        return F.struct(start.cast("int").alias("start"), (start + F.char_length(x["m"])).cast("int").alias("end"), x["m"].alias("s"), last(F.concat(a["tail"], x["g"])).alias("before"), after.alias("after"))

    return F.filter(scanned(zipped, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), step, emit, MATCH), lambda x: x["s"].isNotNull())


def apart(loose: Column, base: Column) -> Column:
    """Those of `loose` that overlap none of `base`; both array<struct<start, end, ...>>, by one pass in either direction."""
    far = 2**31 - 1
    kind = MATCH.replace("after:string", "after:string,hit:boolean,b:boolean")
    # sorted by start, base spans first; a span overlaps what begins before it and ends in it, and what begins in it
    each = lambda c, b: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(not b).alias("l"), x["end"].alias("end"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after"), F.lit(False).alias("hit"), F.lit(b).alias("b")))
    events = F.sort_array(F.concat(each(base, True), each(loose, False)))
    keep = lambda x, hit: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after"), (x["hit"] | hit).alias("hit"), x["b"].alias("b"))
    ahead = scanned(events, F.lit(-1), lambda a, x: F.when(x["b"], F.greatest(a, x["end"])).otherwise(a), lambda a, x: keep(x, a > x["start"]), kind)
    back = scanned(F.reverse(ahead), F.lit(far), lambda a, x: F.when(x["b"], F.least(a, x["start"])).otherwise(a), lambda a, x: keep(x, a < x["end"]), kind)
    free = F.filter(F.reverse(back), lambda x: ~x["b"] & ~x["hit"])
    return F.when(F.size(loose) == 0, F.array().cast(MATCH)).otherwise(F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after"))))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    value = lambda x, i: F.when(i % 2 == 1, F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)).otherwise(x.cast("int"))
    each = F.transform(F.filter(F.split(F.reverse(d), ""), lambda x: x != ""), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def octets(c: Column) -> Column:
    return F.forall(F.split(c, r"\."), lambda p: F.coalesce(F.regexp_extract(p, "^0*([0-9]{1,3})$", 1).try_cast("int") <= 255, F.lit(False)))


def passes(kind: str, s: Column) -> Column:
    """The check of a strict match."""
    if kind == "ip":
        return octets(s)
    n = F.length(digits(s))
    if kind == "card":
        return n.between(16, 19) & luhn(digits(s))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def votes(kind: str, x: Column) -> Column:
    """array<int> of the labelers' votes on a candidate: 1 yes, 2 no, 0 nothing."""
    yes_no = lambda yes, no: F.when(yes, 1).when(no, 2).otherwise(0)
    s, d = x["s"], digits(x["s"])
    n = F.length(d)
    if kind == "email":
        check = yes_no(F.length(s).between(6, 254) & ~s.contains(".."), F.length(s) > 254)
        gazetteer = yes_no(F.lower(s).rlike(rf"[.\)\]}}] ?(?:{DOMAINS})$"), s.rlike(r"[0-9]$"))
    elif kind == "ip":
        check = yes_no(octets(s) | s.contains(":"), ~s.contains(":") & ~octets(s))
        gazetteer = yes_no(~s.rlike(RESERVED) & F.length(s).between(9, 39), s.rlike(RESERVED) | s.rlike(r"^[0-9](?:\.[0-9]){3}$"))
    elif kind == "card":
        check = yes_no(luhn(d), ~luhn(d))
        gazetteer = yes_no(d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), d.rlike("^[01789]"))
    else:
        check = yes_no(n.between(10, 13), n < 8)
        gazetteer = yes_no(s.rlike(r"^\+(?:1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])") | s.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]"), s.rlike(r"^\+0|^\(?[01]"))
    before = yes_no(F.lower(x["before"]).rlike(rf"(?<!\w)(?:{NEAR[kind]})\b\W*(?:\w+\W+)?$"), F.lower(x["before"]).rlike(rf"(?<!\w)(?:{UNLIKE[kind]})\W*$"))
    edges = yes_no(x["before"].rlike(r"(?:^|[\s(<\[:,;\"'])$") & x["after"].rlike(r"^(?:$|[\s)>\],;:.!?\"'])"), x["before"].rlike(r"[\w$/=-]$") | x["after"].rlike(r"^[\w/=%-]"))
    return F.array(F.when(x["base"], 1).otherwise(0), check, gazetteer, before, edges)


def features(kind: str, x: Column) -> Column:
    """array<int> of binary features of a candidate."""
    s = x["s"]
    n = F.length(digits(s))
    flags = [s.contains(" "), s.contains("-"), n > 9, n > 12, F.length(s) > 18, s.rlike("[A-Za-z]"), F.lower(x["before"]).rlike(rf"(?<!\w)(?:{NEAR[kind]})\b"), x["before"].rlike(r"[\s(<\[:,;\"']$"), x["after"].rlike(r"^[\s)>\],;:.!?\"']"), F.lower(x["before"]).rlike(rf"(?<!\w)(?:{UNLIKE[kind]})\b")]
    return F.array(*[F.coalesce(f.cast("int"), F.lit(0)) for f in flags])


def checked(kind: str):
    return lambda x: passes(kind, x["s"])


def judged(k: int, kind: str):
    return lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), votes(kind, x).alias("votes"), features(kind, x).alias("features"))


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, c): every row with its candidates, as array<struct<kind, start, end, base, votes, features>>."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(MATCH)
    rows = docs.select(F.col(key).alias("key"), t.alias("t"))
    for k, kind in enumerate(KINDS):
        gate = F.col("t").rlike(GATES[kind])
        base = F.filter(located(F.col("t"), BASE[kind]), checked(kind))
        rows = rows.withColumn(f"b{k}", F.when(gate, base).otherwise(none)).withColumn(f"l{k}", F.when(gate, located(F.col("t"), LOOSE[kind])).otherwise(none))
    parts = []
    taken = F.concat(*[F.col(f"b{i}") for i in range(len(KINDS))])
    tag = lambda c, base: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after"), F.lit(base).alias("base")))
    for k, kind in enumerate(KINDS):
        tagged = F.concat(tag(F.col(f"b{k}"), True), tag(apart(F.col(f"l{k}"), taken), False))
        parts.append(F.transform(tagged, judged(k, kind)))
    return rows.select("key", F.concat(*parts).alias("c"))


# ------------------------------------------------------------------ fits over bounded tables


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 30) -> dict[tuple[int, ...], float]:
    """Probability of each vote pattern, by EM over labelers that err independently given the truth."""
    p = {v: min(0.95, max(0.05, 0.5 + 0.2 * (sum(x == 1 for x in v) - sum(x == 2 for x in v)))) for v in counts}
    for _ in range(rounds):
        share = (1 + sum(n * p[v] for v, n in counts.items())) / (2 + sum(counts.values()))
        rate = []  # labeler -> truth -> vote -> probability; all start from one vote of each kind
        for j in range(LABELERS):
            table = [[1.0] * 3, [1.0] * 3]
            for v, n in counts.items():
                table[1][v[j]] += n * p[v]
                table[0][v[j]] += n * (1 - p[v])
            rate.append([[x / sum(row) for x in row] for row in table])
        for v in counts:
            z = math.log(share / (1 - share)) + sum(math.log(rate[j][1][v[j]] / rate[j][0][v[j]]) for j in range(LABELERS))
            p[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return p


def logistic(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 300, rate: float = 0.5, ridge: float = 0.01) -> list[float]:
    """Weights, the intercept last, for (features, probability, count)."""
    size = len(rows[0][0]) if rows else 0
    w = [0.0] * (size + 1)
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        g = [ridge * x for x in w]
        for f, p, n in rows:
            z = w[-1] + sum(x for x, on in zip(w, f) if on)
            e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
            for i, on in enumerate(f):
                if on:
                    g[i] += e
            g[-1] += e
        w = [x - rate * y for x, y in zip(w, g)]
    return w


def fitted(found: DataFrame) -> dict[int, list[float]]:
    """A classifier for each kind, from the candidates of all documents."""
    each = found.select(F.explode("c").alias("x")).select("x.kind", "x.votes", "x.features")
    table = each.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the patterns there are
    out = {}
    for k in range(len(KINDS)):
        own = [(tuple(r["votes"]), tuple(r["features"]), r["n"]) for r in sorted(table, key=lambda r: (r["votes"], r["features"])) if r["kind"] == k]
        counts: dict[tuple[int, ...], int] = {}
        for v, _, n in own:
            counts[v] = counts.get(v, 0) + n
        p = reliabilities(counts)
        if own:
            out[k] = logistic([(f, p[v], n) for v, f, n in own])
    return out


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(key, spans): every row with its spans, array<struct<kind, start, end, base, p>> by kind, then start."""
    found = saved(candidates(docs, key, text), "candidates")
    models = fitted(found)

    def p(x: Column) -> Column:
        out = F.lit(0.0)
        for k, w in models.items():
            z = F.lit(w[-1])
            for i, v in enumerate(w[:-1]):
                z = z + F.get(x["features"], i) * F.lit(v)
            out = F.when(x["kind"] == k, 1 / (1 + F.exp(-z))).otherwise(out)
        return out

    judged = F.transform("c", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), p(x).alias("p")))
    kept = F.filter(judged, lambda x: x["base"] | (x["p"] >= least))
    return found.select(F.col("key").alias(key), F.sort_array(kept).alias("spans"))
