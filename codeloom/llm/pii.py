"""Personal data: candidates by pattern, gradient-boosted trees, calibrated thresholds, redaction.

Four kinds have exact base rules (a pattern and a check), whose spans always
count. Looser generators propose further, overlapping spans of each kind:
addresses spelt out, numbers that a base rule swallowed together with their
neighbour, phone numbers without a plus, quads with other dots.

Boosted trees of depth two score a candidate by its form and context. They
learn from a bounded sample which candidates overlap base spans of their kind.
The rest are no counter-examples: a form that no base rule has is unlabelled.
So the features tell nothing that sets such a form apart (a country code, the
signs in place of @ and dots), and the score is read as in positive-unlabelled
learning: the mean score c of known positives is how often a true span has a
label, and a span is true with probability score / c. The threshold of a kind is
c / 2, or what the reliable negatives (runs inside words, spans of other kinds,
failed checks) ask for to keep to the precision, where that is higher. Both are
counted over all documents that the sample doesn't hold. Candidates over it
that pass their kind's check and overlap no base span are added, the best of
those that overlap each other.

Everything runs as DataFrame expressions. A text's spans are found within its
row, so nothing is shuffled but the sample and the counts by score; the trees
grow on the driver from the sample's bounded counts of feature values and then
are expressions, too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage

KINDS = ("email", "ip", "card", "phone")

# The base patterns. They match what [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+,
# [0-9]+(\.[0-9]+){3}, [0-9]([\x20-]?[0-9])+ and \+[0-9][\x20().0-9-]+[0-9] match, written with possessive
# quantifiers, and start at a run's first character or where the last match ended: linear time and flat stacks.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: A part of an ip address: at most 255, leading zeros allowed.
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Generators of further candidates: addresses spelt out, runs of digits with any separators, and what can be part of one.
_HOST = "[A-Za-z0-9-]++"
_DOT = "(?:\\x20?(?:\\(dot\\)|\\[dot\\])\\x20?|\\x20dot\\x20|\\.)"
_TAIL = "(?:[0-9]{2,4}|\\([0-9]{2,4}\\))[\\x20.-]?[0-9]{3}[\\x20.-]?[0-9]{4}"
_QUAD_DOT = "(?:\\.|\\x20?(?:\\[\\.\\]|\\(\\.\\)|\\[dot\\]|\\(dot\\))\\x20?|\\x20dot\\x20)"
LOOSE = {
    "spelt": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++(?:(?:@|\\x20?(?:\\(at\\)|\\[at\\])\\x20?){_HOST}(?:{_DOT}[A-Za-z]{{2,}})++|\\x20at\\x20{_HOST}(?:\\x20dot\\x20[A-Za-z]{{2,}})++)",
    "digits": "(?<![0-9])[(]?[0-9](?:[\\x20().-]{0,2}+[0-9])++",
    "solid": "(?<![0-9])[0-9]{13,19}(?![0-9])",
    "grouped": "(?<![0-9])[0-9]{4}(?:[\\x20._/-][0-9]{4}){2,3}(?:[\\x20._/-][0-9]{1,3})?(?![0-9])",
    "national": f"(?<![0-9])(?:\\+?[0-9]{{1,3}}[\\x20.-]?)?{_TAIL}(?![0-9])",
    "quad": f"(?<![0-9])[0-9]{{1,3}}(?:{_QUAD_DOT}[0-9]{{1,3}}){{3}}(?![0-9])",
}
#: The kind that a generator's candidates are of; runs of digits are cards or phone numbers by their number.
KIND_OF = {"spelt": "email", "solid": "card", "grouped": "card", "national": "phone", "quad": "ip"}
LEAST_DIGITS, CONTEXT = 7, 24
#: Labels of a candidate.
NEGATIVE, POSITIVE, UNLABELLED = 0, 1, 2


@dataclass(frozen=True)
class Limits:
    """Bounds of the training sample and of the model. ``places`` is the number of steps in which scores are counted."""

    documents: int = 20_000
    candidates: int = 20_000
    rounds: int = 12
    rate: float = 0.5
    precision: float = 0.998
    places: int = 1000


@dataclass
class Model:
    """Trees as (feature, limit, (feature, limit, leaf, leaf), (feature, limit, leaf, leaf)); thresholds by kind."""

    prior: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: dict = field(default_factory=dict)


# Expressions below are SQL text: one call for each array in place of hundreds for its parts.


def digits_of(t: str) -> str:
    return f"regexp_replace({t}, '[^0-9]', '')"


def luhn(t: str) -> str:
    """Whether the digits of ``t`` pass the Luhn check."""
    digit = "if(acc.i % 2 = 0, int(c), if(int(c) > 4, 2 * int(c) - 9, 2 * int(c)))"
    step = f"named_struct('i', acc.i + 1, 'n', acc.n + if(c = '', 0, {digit}))"
    return f"aggregate(split(reverse({digits_of(t)}), ''), named_struct('i', 0, 'n', 0), (acc, c) -> {step}, acc -> acc.n % 10 = 0)"


def _passes(kind: str, t: str) -> str:
    n = f"length({digits_of(t)})"
    return {
        "email": "true",
        "ip": f"rlike({t}, r'^{_BYTE}\\.{_BYTE}\\.{_BYTE}\\.{_BYTE}$')",
        "card": f"if({n} between 13 and 19, {luhn(t)}, false)",
        "phone": f"{n} between 9 and 15",
    }[kind]


def _checks(kind: str, t: str) -> str:
    """The check of a candidate's kind, however its parts are set apart."""
    return _passes(kind, f"regexp_replace({t}, '[^0-9]+', '.')" if kind == "ip" else t)


_SPANS = "array<struct<s:int,e:int,t:string,b:string,a:string>>"


def _spans(matches: str, gaps: str, keep: str) -> Column:
    """(start, end, text, before, after) of the matches ``x.t`` that ``keep`` accepts, from the matches and the gaps around them."""
    span = f"named_struct('s', acc.at + length(x.b), 'e', acc.at + length(x.b) + length(x.t), 't', x.t, 'b', substring(x.b, -{CONTEXT}, {CONTEXT}), 'a', substring(x.a, 1, {CONTEXT}))"
    step = f"named_struct('at', acc.at + length(x.b) + length(x.t), 'out', if({keep}, concat(acc.out, array({span})), acc.out))"
    pieces = f"transform({matches}, (x, i) -> named_struct('t', x, 'b', get({gaps}, i), 'a', get({gaps}, i + 1)))"
    none = f"cast(array() as {_SPANS})"
    return F.expr(f"if(size({matches}) > 0, aggregate({pieces}, named_struct('at', 0, 'out', {none}), (acc, x) -> {step}, acc -> acc.out), {none})")


def found(docs: DataFrame, loose: bool = True) -> DataFrame:
    """``docs`` with the arrays of spans email, ip, card, phone and, if ``loose``, of each generator, in columns pii_<name>."""
    patterns = BASE | (LOOSE if loose else {})
    gates = {"email": F.contains("pii_text", F.lit("@")), "phone": F.contains("pii_text", F.lit("+")), "spelt": F.lit(True)}
    none = F.expr("cast(array() as array<string>)")
    out = docs.withColumn("pii_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn("pii_any_digit", F.col("pii_text").rlike("[0-9]"))
    all_of = {k: F.when(gates.get(k, F.col("pii_any_digit")), F.regexp_extract_all("pii_text", F.lit(p), 0)).otherwise(none) for k, p in patterns.items()}
    out = out.withColumns({f"pii_m_{k}": v for k, v in all_of.items()})
    out = out.withColumns({f"pii_g_{k}": F.when(F.size(f"pii_m_{k}") > 0, F.split("pii_text", p, -1)) for k, p in patterns.items()})
    keep = {k: _passes(k, "x.t") for k in BASE} | dict.fromkeys(LOOSE, "true") | {"digits": f"length({digits_of('x.t')}) >= {LEAST_DIGITS}"}
    out = out.withColumns({f"pii_{k}": _spans(f"pii_m_{k}", f"pii_g_{k}", keep[k]) for k in patterns})
    return out.drop("pii_text", "pii_any_digit", *(f"pii_{x}_{k}" for k in patterns for x in "mg"))


FEATURES = ("kind", "digits", "parts", "brackets", "dots", "dashes", "luhn", "before", "after", "word", "longest")


def _class_of(c: str) -> str:
    """0 nothing or a blank, 1 a letter or digit, 2 anything else."""
    return f"case when {c} = '' or rlike({c}, r'^\\s$') then 0 when rlike({c}, r'^[\\p{{L}}0-9]$') then 1 else 2 end"


def _core(kind: str, t: str) -> str:
    """What of a candidate's text its features are of: without signs that only one way of writing it has."""
    if kind == "email":
        t = f"regexp_replace({t}, r'\\x20?[(\\[]at[)\\]]\\x20?|\\x20at\\x20', '@')"
        return f"regexp_replace(regexp_replace({t}, r'\\x20?[(\\[]dot[)\\]]\\x20?|\\x20dot\\x20', '.'), '^[^@]*@', '')"
    if kind == "phone":
        return f"regexp_replace({t}, r'^\\+?[0-9]{{1,3}}[\\x20.-]?(?={_TAIL}$)', '')"
    return f"regexp_replace({t}, '[^0-9]+', '.')" if kind == "ip" else f"regexp_replace({t}, '[._/]', ' ')"


def _features(kind: str) -> str:
    """The features of a candidate ``x`` whose core is ``x.c``."""
    near = "lower(x.b)"
    words = ("(?:mail|e-mail|contact)", "(?:tel|phone|call|fax|mobile)", "(?:card|visa|credit|iban)", "(?:token|key|id|order|no\\.|version)")
    word = " ".join(f"when rlike({near}, r'{w}') then {i}" for i, w in enumerate(words, 1))
    # Of an address, the parts of its host.
    parts = "split(x.c, '[.]')" if kind == "email" else "split(x.c, '[^0-9]+')"
    longest = f"length(element_at({parts}, -1))" if kind == "email" else f"array_max(transform({parts}, r -> length(r)))"
    n = f"length({digits_of('x.c')})"
    values = (
        str(KINDS.index(kind)), f"least({n}, 24)", f"least(size({parts}), 12)", "int(contains(x.c, '('))", "int(contains(x.c, '.'))", "int(contains(x.c, '-'))",
        f"int(if({n} between 2 and 24, {luhn('x.c')}, false))", _class_of("substring(regexp_replace(x.b, r'\\+$', ''), -1, 1)"), _class_of("substring(x.a, 1, 1)"),
        f"case {word} else 0 end", f"least({longest}, 24)",
    )
    return f"array({', '.join(values)})"


def _candidates() -> Column:
    """Candidates of a row, (kind, s, e, f, y): place, features, label.

    A candidate that overlaps a base span of its kind is positive. One inside a
    longer word (as in a hexadecimal token), one that overlaps a base span of
    another kind and one that fails its check is negative. Others have no label.
    """

    def proposed(kind: str, spans: str) -> str:
        with_core = f"transform({spans}, x -> named_struct('s', x.s, 'e', x.e, 't', x.t, 'b', x.b, 'a', x.a, 'c', {_core(kind, 'x.t')}))"
        return f"transform({with_core}, x -> named_struct('kind', '{kind}', 's', x.s, 'e', x.e, 'f', {_features(kind)}, 'ok', {_checks(kind, 'x.t')}))"

    is_card = f"length({digits_of('x.t')}) between 13 and 19"
    sources = [("card", f"filter(pii_digits, x -> {is_card})"), ("phone", f"filter(pii_digits, x -> not ({is_card}))"), *((kind, f"pii_{name}") for name, kind in KIND_OF.items())]
    hits = {k: f"exists(pii_{k}, y -> y.s < c.e and c.s < y.e)" for k in KINDS}
    own = " or ".join(f"(c.kind = '{k}' and {hit})" for k, hit in hits.items())
    other = " or ".join(f"(c.kind <> '{k}' and {hit})" for k, hit in hits.items())
    inside = f"get(c.f, {FEATURES.index('before')}) = 1 or get(c.f, {FEATURES.index('after')}) = 1"
    label = f"case when {inside} then {NEGATIVE} when {own} then {POSITIVE} when {other} or not c.ok then {NEGATIVE} else {UNLABELLED} end"
    every = f"concat({', '.join(proposed(kind, spans) for kind, spans in sources)})"
    return F.expr(f"transform({every}, c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e, 'f', c.f, 'y', {label}))")


def _score(model: Model, f: str) -> str:
    def node(n: tuple) -> str:
        return f"if(get({f}, {n[0]}) <= {n[1]}, {n[2]!r}D, {n[3]!r}D)"

    total = " + ".join([f"{model.prior!r}D", *(f"if(get({f}, {feature}) <= {limit}, {node(low)}, {node(high)})" for feature, limit, low, high in model.trees)])
    return f"(1 / (1 + exp(-({total}))))"


def _split(rows: list[tuple], ridge: float = 1.0) -> tuple:
    """(feature, limit, leaf below, leaf above) with the largest gain for (features, gradient, hessian) rows."""
    best = (-1.0, 0, 0, 0.0, 0.0)
    g_all, h_all = sum(r[1] for r in rows), sum(r[2] for r in rows)
    for feature in range(len(FEATURES)):
        values: dict[int, list[float]] = {}
        for f, g, h in rows:
            cell = values.setdefault(f[feature], [0.0, 0.0])
            cell[0] += g
            cell[1] += h
        g = h = 0.0
        for value in sorted(values):
            g, h = g + values[value][0], h + values[value][1]
            gain = g * g / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge)
            if gain > best[0] + 1e-9:
                best = (gain, feature, value, -g / (h + ridge), -(g_all - g) / (h_all - h + ridge))
    return best[1:]


def _value(model: Model, f: list[int]) -> float:
    """The score of one candidate on the driver, as ``_score`` has it."""
    total = model.prior
    for feature, limit, low, high in model.trees:
        node = low if f[feature] <= limit else high
        total += node[2] if f[node[0]] <= node[1] else node[3]
    return 1 / (1 + math.exp(-total))


def boosted(rows: list[tuple], limits: Limits) -> Model:
    """Trees of depth two from (features, label, count) rows."""
    n, p = sum(r[2] for r in rows), sum(r[1] * r[2] for r in rows)
    model = Model()
    if not p or p == n:
        return model
    model.prior = math.log(p / (n - p))
    for _ in range(limits.rounds):
        slopes = []
        for f, y, count in rows:
            q = _value(model, f)
            slopes.append((f, (q - y) * count, q * (1 - q) * count))
        feature, limit, _, _ = _split(slopes)
        sides = ([r for r in slopes if r[0][feature] <= limit], [r for r in slopes if r[0][feature] > limit])
        nodes = [(f, v, limits.rate * low, limits.rate * high) for f, v, low, high in map(_split, sides)]
        model.trees.append((feature, limit, *nodes))
    return model


def _fold(column: str = "doc_id") -> Column:
    """0 for the documents that are never in the sample."""
    return F.pmod(F.xxhash64(column, F.lit("back")), F.lit(3))


def fit(docs: DataFrame, limits: Limits = Limits()) -> Model:
    """Boosted trees from at most ``limits.documents`` documents and ``limits.candidates`` candidates of them; thresholds from all others."""
    picked = docs.select("doc_id").where("doc_id is not null").where(_fold() != 0).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limits.documents)
    picked = stage(picked, "sample_ids")
    last = picked.agg(F.max(F.xxhash64("doc_id"))).first()[0]
    if last is None:
        return Model()
    # Bounded: at most limits.documents ids.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sample = found(rows).select("doc_id", F.explode(_candidates()).alias("c")).select("doc_id", "c.kind", "c.s", "c.e", "c.f", "c.y")
    sample = sample.orderBy(F.xxhash64("doc_id", "s"), "doc_id", "s", "e", "kind").limit(limits.candidates)
    # Bounded: at most limits.candidates rows of a few small numbers.
    sample = [tuple(r) for r in sample.groupBy("f", (F.col("y") == POSITIVE).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()]
    model = boosted(sample, limits)
    if model.trees:
        rest = docs.select("doc_id", "text").where((_fold() == 0) | (F.xxhash64("doc_id") > last) | F.col("doc_id").isNull())
        scored = found(rest).select(F.explode(F.filter(_candidates(), lambda c: c["y"] != UNLABELLED)).alias("c"))
        scored = scored.select("c.kind", "c.y", F.expr(f"floor({_score(model, 'c.f')} * {limits.places})").alias("place"))
        # Bounded: at most limits.places + 1 rows for each of two labels of four kinds.
        counts = scored.groupBy("kind", "y", "place").agg(F.count("*").alias("n")).collect()
        for kind in KINDS:
            model.thresholds |= _threshold(kind, [(r.place, r.y, r.n) for r in counts if r.kind == kind], limits)
    return model


def _threshold(kind: str, counts: list[tuple], limits: Limits) -> dict:
    """The threshold of a kind from (place of the score, label, count) rows; none where there is no positive or no precise place."""
    positives = sum(n for _, y, n in counts if y == POSITIVE)
    if not positives:
        return {}
    mean = sum(place * n for place, y, n in counts if y == POSITIVE) / positives / limits.places
    n = p = 0
    fine, below = False, 0.0
    for place in sorted({c[0] for c in counts}, reverse=True):
        here = [c for c in counts if c[0] == place]
        n, p = n + sum(c[2] for c in here), p + sum(c[2] for c in here if c[1] == POSITIVE)
        if p >= limits.precision * n:
            fine, below = True, 0.0
        elif not below:
            # Scores above the highest place at which the precision is lost for good will do.
            below = (place + 1) / limits.places
    return {kind: max(below, mean / 2)} if fine else {}


def _plain(kind: str) -> Column:
    return F.transform(f"pii_{kind}", lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with pii_<kind> (base spans) and pii_all: (k, s, e) of base and added spans, by kind as listed, then start."""
    out = found(docs, loose=bool(model.thresholds))
    parts = [_plain(kind) for kind in KINDS]
    if model.thresholds:
        limit = " ".join(f"when '{kind}' then {value!r}D" for kind, value in model.thresholds.items())
        number = " ".join(f"when '{kind}' then {i}" for i, kind in enumerate(KINDS))
        none = "cast(array() as array<struct<k:int,s:int,e:int>>)"
        out = out.withColumn("pii_free", F.filter(_candidates(), lambda c: c["y"] == UNLABELLED))
        # The best first; of those that overlap, the first one stays.
        scored = f"transform(pii_free, c -> named_struct('rank', -{_score(model, 'c.f')}, 's', c.s, 'e', -c.e, 'k', case c.kind {number} end, 'least', case c.kind {limit} else 2D end))"
        ranked = f"array_sort(filter({scored}, x -> -x.rank >= x.least))"
        step = "if(exists(acc, y -> y.s < -x.e and x.s < y.e), acc, concat(acc, array(named_struct('k', x.k, 's', x.s, 'e', -x.e))))"
        parts.append(F.expr(f"if(size(pii_free) > 0, aggregate({ranked}, {none}, (acc, x) -> {step}), {none})"))
    out = out.withColumn("pii_all", F.array_sort(F.concat(*parts)))
    return out.drop("pii_free", *(f"pii_{name}" for name in LOOSE))


def _listed(array: Column | str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are of the base spans, offsets in code points, ends
    exclusive. Null text: empty, so no spans. Rows that repeat get one row
    each; a null doc_id is never in the training sample. An empty table gives no
    rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    out = spans(docs, fit(docs, limits))
    base = F.concat(*(_plain(kind) for kind in KINDS))
    return out.select("doc_id", *(F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed("pii_all").alias("spans"))


def redacted(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind in brackets, as [EMAIL].

    Where spans overlap, the earlier (of two that start together, the longer)
    is replaced and what the other has beyond it, too. Null texts stay null;
    all other columns stay. Write the result before filtering on its text: the
    optimizer would move such a filter, and all patterns with it, below.
    """
    own = docs.select("doc_id", "text", F.struct(*docs.columns).alias("pii_row"))
    out = spans(own, fit(docs, limits))
    by_start = F.array_sort(F.transform("pii_all", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))))
    out = out.withColumn("pii_order", by_start)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["e"]
        gap = F.col("text").substr(acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        more = F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.get(names, x["k"])))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], end).alias("at"), more.alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.col("text").substr(acc["at"] + 1, F.length("text")))
    text = F.when(F.size("pii_order") > 0, F.aggregate("pii_order", zero, step, rest)).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*(F.col("text") if c == "text" else F.col(f"pii_row.`{c}`") for c in docs.columns))
