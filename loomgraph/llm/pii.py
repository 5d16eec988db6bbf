"""Personal data by weak supervision, in DataFrame functions only.

Regular expressions propose candidate spans with their positions. Labelers vote on each candidate, for (1),
against (-1) or not at all (0): a validity rule for the kind, gazetteers of words that go before it, the
characters on either side, and its shape. Expectation maximisation over the counts of vote patterns
estimates how reliable each labeler is for each kind, without labels, and so the chance that a pattern is personal
data. A logistic classifier over votes, kind and shape is trained on those chances, and its weights, as a
literal array, decide on every candidate. Vote patterns and shape grades are of fixed number, kinds times 3 to the
power of the labelers times grades (51,030), so no more rows of counts reach the driver however large the table
is; the rest is one pass and no shuffle. Work in a text grows with its length, however many spans it holds.

Base kinds (email, ip, card, phone) are kept whenever they are valid. The method adds ``national`` (phone
numbers without a country code), ``ssn`` and ``iban`` (country and check digits have to be right) where the classifier accepts them and no base span overlaps.

Spans are in code points, end exclusive. Defined results: a null or empty text has no spans; repeated
texts get equal spans; an empty table gives no rows, and a kind without candidates keeps its starting estimate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from loomgraph.sessions import cut

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("national", "ssn", "iban")
KINDS = BASE_KINDS + ADDED_KINDS
CONTEXT = 24
BLOCK = 256

# Possessive, and anchored where a run begins, so that no text makes them back up: they match what
# the plain patterns would, leftmost and without overlap. Numbers of 16 digits or more only are cards.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){16})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "national": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
_GATES = {"email": "@", "ip": None, "card": None, "phone": "+", "national": None, "ssn": "-", "iban": None}
_GATE_PATTERNS = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "national": r"[0-9]{4}", "iban": r"[A-Z]{2}[0-9]{2}"}
# Words that stand before personal data of a kind, and words that stand before other numbers.
_BEFORE = {
    "email": "e-?mail|mail|contact|write|reach|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|client|login|dirección|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte",
    "phone": r"phone|\btel\b|telefon|téléphone|teléfono|mobile|call|fax|cell|whatsapp",
    "national": r"phone|\btel\b|telefon|téléphone|teléfono|mobile|call|fax|cell|whatsapp",
    "ssn": "ssn|social security",
    "iban": "iban|account|konto|cuenta|compte",
}
_NOT_BEFORE = r"version|\bv\b|release|order|invoice|isbn|issn|serial|build|section|chapter|figure|hash"
_SPAN = "struct<kind:string,start:int,end:int,word:string,left:string,right:string>"


# Countries that have IBANs.
_IBAN_COUNTRIES = (
    "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU "
    "NI NL NO PK PL PS PT QA RO RS RU SA SC SD SE SI SK SM ST SV TL TN TR UA VA VG XK"
).split()


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` is ``value``, worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _running(values: str, step: str, zero: int) -> str:
    """SQL: what ``step`` over ``a`` and ``x`` makes of an array of ints up to each place.

    Arrays grow by copying, so the fold goes over blocks of ``BLOCK`` values, and then over the blocks.
    """
    last = lambda of: f"coalesce(get({of}, size({of}) - 1), {zero})"
    ints = "cast(array() as array<int>)"
    block = f"aggregate(slice(vs, n * {BLOCK} + 1, {BLOCK}), {ints}, (acc, v) -> concat(acc, array({_step(step, last('acc'), 'v')})))"
    blocks = f"transform(sequence(0, cast((size(vs) - 1) div {BLOCK} as int)), n -> {block})"
    offsets = f"aggregate(bs, array({zero}), (acc, b) -> concat(acc, array({_step(step, last('acc'), last('b'))})))"
    shifted = f"flatten(zip_with(bs, slice({offsets}, 1, size(bs)), (b, o) -> transform(b, e -> {_step(step, 'o', 'e')})))"
    return _let("vs", values, _let("bs", blocks, shifted))


def _step(step: str, a: str, x: str) -> str:
    return step.format(a=a, x=x)


def _located(kind: str) -> str:
    """SQL: spans of a kind, from what matches and what stands between the matches.

    The left context is the end of the match before and what follows it, the right one a character.
    """
    n = f"size(_m_{kind})"
    lengths = f"zip_with(_m_{kind}, slice(_g_{kind}, 1, {n}), (w, g) -> length(w) + length(g))"
    matched = f"zip_with(_m_{kind}, {_running(lengths, '{a} + {x}', 0)}, (w, e) -> named_struct('w', w, 'e', e))"
    before = f"zip_with(slice(concat(array(''), _m_{kind}), 1, {n}), slice(_g_{kind}, 1, {n}), (p, g) -> right(concat(p, g), {CONTEXT}))"
    after = f"zip_with(slice(_g_{kind}, 2, {n}), slice(concat(_m_{kind}, array('')), 2, {n}), (g, w) -> left(if(g = '', w, g), 1))"
    around = f"zip_with({before}, {after}, (l, r) -> named_struct('l', l, 'r', r))"
    one = f"named_struct('kind', '{kind}', 'start', m.e - length(m.w), 'end', m.e, 'word', m.w, 'left', c.l, 'right', c.r)"
    return f"if({n} = 0, cast(array() as array<{_SPAN}>), zip_with({matched}, {around}, (m, c) -> {one}))"


def candidates(documents: DataFrame, text: str = "text") -> DataFrame:
    """Every row with ``candidates`` in place of its text: the spans that the patterns find, by kind, then start."""
    named = documents.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    pieces = {}
    for kind in KINDS:
        gate = F.col("_text").contains(_GATES[kind]) if _GATES[kind] else F.col("_text").rlike(_GATE_PATTERNS[kind])
        none = F.array().cast("array<string>")
        pieces[f"_m_{kind}"] = F.when(gate, F.regexp_extract_all("_text", F.lit(_PATTERNS[kind]), F.lit(0))).otherwise(none)
        pieces[f"_g_{kind}"] = F.when(gate, F.split("_text", _PATTERNS[kind], -1)).otherwise(none)
    found = named.withColumns(pieces)
    spans = F.concat(*(F.expr(_located(k)) for k in KINDS))
    return found.withColumn("candidates", spans).drop("_text", text, *pieces)


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, and its digits added; the sum has to end in 0."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int"))),
        F.lit(0), lambda a, d: (a + F.coalesce(d, F.lit(0))).cast("int"),
    )
    return total % 10 == 0


def valid(s: Column) -> Column:
    """Whether a candidate keeps its kind's rule."""
    kind, word = s["kind"], s["word"]
    digits = _digits(word)
    n = F.length(digits)
    octet = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", word.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(kind == "card", n.between(16, 19) & F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .when(kind == "national", ~digits.rlike("^[01]"))
        .when(kind == "ssn", ~word.rlike("^(?:000|666|9..)-") & ~word.contains("-00-") & ~word.endswith("0000"))
        .otherwise((n >= 8) & _check_digits(word))
    )


def _check_digits(word: Column) -> Column:
    """Whether an IBAN, its first four characters put last and letters read as 10 to 35, leaves 1 when divided by 97."""
    characters = F.split(F.concat(F.substr(word, F.lit(5)), F.substr(word, F.lit(1), F.lit(4))), "")
    worth = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    scale = lambda c: F.when(c.between("0", "9"), 10).otherwise(100)
    return F.aggregate(F.filter(characters, lambda c: c != ""), F.lit(0), lambda a, c: ((a * scale(c) + worth(c)) % 97).cast("int")) == 1


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out if no is None else out.when(no, F.lit(-1))).otherwise(F.lit(0))


def votes(s: Column) -> Column:
    """The labelers' votes on a candidate, as an array of -1, 0 and 1."""
    kind, word = s["kind"], s["word"]
    left = F.lower(s["left"])
    before = F.lit(False)
    for k in KINDS:
        before = F.when(kind == k, left.rlike(_BEFORE[k])).otherwise(before)
    shape = (
        F.when(kind == "email", word.rlike(r"\.[A-Za-z]{2,10}$"))
        .when(kind == "ip", word.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\."))
        .when(kind == "card", word.rlike(r"^[3-6]"))
        .when(kind == "phone", word.rlike(r"^\+[1-9]") & word.rlike(r"[ ().-]"))
        .when(kind == "national", word.rlike(r"^(?:\([0-9]{3}\) [0-9]{3}-|[0-9]{3}([.-])[0-9]{3}\1)"))
        .when(kind == "iban", F.substr(word, F.lit(1), F.lit(2)).isin(*_IBAN_COUNTRIES))
        .otherwise(F.lit(True))
    )
    return F.array(
        _vote(valid(s), ~valid(s)), _vote(before), _vote(F.lit(False), left.rlike(f"(?:{_NOT_BEFORE})[^a-z]*$")),
        _vote((left == "") | left.rlike(r"[\s(:<,;=\"'\[]$"), left.rlike(r"[\w./-]$")), _vote((s["right"] == "") | s["right"].rlike(r"[\s.,;:)>\"'\]!?]"), s["right"].rlike(r"[\w/@-]")),
        _vote(shape, ~shape),
    )


LABELERS = 6


def grades(s: Column) -> Column:
    """Coarse shape of a candidate: a grade of its length and whether it holds separators."""
    length = F.length(s["word"])
    size = F.when(length < 10, 0).when(length < 14, 1).when(length < 18, 2).when(length < 26, 3).otherwise(4)
    return (size * 2 + s["word"].rlike(r"[ ().-]").cast("int")).cast("int")


def pattern_counts(found: DataFrame) -> list[Row]:
    """(kind, votes, grade, n): at most kinds x 3**labelers x grades of them, whatever the size of the table."""
    spans = found.select(F.explode("candidates").alias("s"))
    told = spans.select(F.col("s.kind").alias("kind"), votes(F.col("s")).alias("votes"), grades(F.col("s")).alias("grade"))
    return told.groupBy("kind", "votes", "grade").agg(F.count("*").alias("n")).orderBy("kind", "votes", "grade").collect()


def reliabilities(counts: list[Row], rounds: int = 50) -> tuple[dict, dict]:
    """Expectation maximisation by kind: what each labeler votes on personal data and on the rest, and the share of it.

    Returns chances by (kind, votes) and the reliabilities by kind. Votes count as independent given the truth.
    """
    chance: dict = {}
    learnt: dict = {}
    for kind in sorted({r["kind"] for r in counts}):
        own: dict[tuple, int] = {}
        for r in counts:
            if r["kind"] == kind:
                own[tuple(r["votes"])] = own.get(tuple(r["votes"]), 0) + r["n"]
        share = 0.7
        start = {1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.25, 0: 0.35, -1: 0.4}}
        rates = {y: [dict(start[y]) for _ in range(LABELERS)] for y in (0, 1)}
        post: dict[tuple, float] = {}
        for _ in range(rounds):
            for v in own:
                like = {y: math.log(share if y else 1 - share) + sum(math.log(rates[y][j][x]) for j, x in enumerate(v)) for y in (0, 1)}
                post[v] = 1 / (1 + math.exp(min(700.0, like[0] - like[1])))
            total = sum(own.values())
            share = min(max((sum(n * post[v] for v, n in own.items()) + 7) / (total + 10), 0.01), 0.99)
            for y in (0, 1):
                for j in range(LABELERS):
                    mass = {x: 10 * start[y][x] for x in (1, 0, -1)}
                    for v, n in own.items():
                        mass[v[j]] += n * (post[v] if y else 1 - post[v])
                    whole = sum(mass.values())
                    rates[y][j] = {x: m / whole for x, m in mass.items()}
        chance |= {(kind, v): p for v, p in post.items()}
        learnt[kind] = {"share": share, "rates": rates}
    return chance, learnt


_WIDTH = 1 + len(KINDS) + 3 * LABELERS + 10


def _active(kind: str, vote: tuple, grade: int) -> list[int]:
    base = 1 + len(KINDS)
    return [0, 1 + KINDS.index(kind), *(base + 3 * j + v + 1 for j, v in enumerate(vote)), base + 3 * LABELERS + grade]


def train(counts: list[Row], chance: dict, steps: int = 400, rate: float = 0.5, decay: float = 1e-4) -> list[float]:
    """Weights of a logistic classifier on the estimated chances, each pattern weighed by the logarithm of its count."""
    rows = [(_active(r["kind"], tuple(r["votes"]), r["grade"]), chance[r["kind"], tuple(r["votes"])], math.log1p(r["n"])) for r in counts]
    mass = sum(n for *_, n in rows) or 1.0
    w = [0.0] * _WIDTH
    speed = [1e-8] * _WIDTH
    for _ in range(steps):
        g = [decay * x for x in w]
        for active, p, n in rows:
            z = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in active)))))
            for i in active:
                g[i] += n * (z - p) / mass
        for i in range(_WIDTH):
            speed[i] += g[i] * g[i]
            w[i] -= rate * g[i] / math.sqrt(speed[i])
    return w


def chance_of(s: Column, weights: list[float]) -> Column:
    """The classifier as an expression over a candidate."""
    table = F.array(*(F.lit(float(x)) for x in weights))
    base = 1 + len(KINDS)
    number = F.array_position(F.array(*(F.lit(k) for k in KINDS)), s["kind"]).cast("int")
    from_votes = F.aggregate(
        F.transform(votes(s), lambda v, j: F.element_at(table, (F.lit(base + 2) + 3 * j + v).cast("int"))), F.lit(0.0), lambda a, x: a + x
    )
    z = F.element_at(table, 1) + F.element_at(table, number + 1) + from_votes + F.element_at(table, (F.lit(base + 3 * LABELERS + 1) + grades(s)).cast("int"))
    return 1 / (1 + F.exp(-z))


def _unclaimed(base: str, more: str) -> str:
    """SQL: the spans of ``more`` that overlap with none of ``base``, by kind, then start.

    Over all spans by start: the furthest end of a base span so far, and the first start of one yet to come.
    """
    is_base = " or ".join(f"s.kind = '{k}'" for k in BASE_KINDS)
    sortable = f"array_sort(transform(concat({base}, {more}), s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind, 'word', s.word, 'left', s.left, 'right', s.right)))"
    furthest = _running(f"transform(ss, s -> if({is_base}, s.end, 0))", "greatest({a}, {x})", 0)
    nearest = f"reverse({_running(f'reverse(transform(ss, s -> if({is_base}, s.start, {2**31 - 1})))', 'least({a}, {x})', 2**31 - 1)})"
    bounds = f"zip_with({furthest}, {nearest}, (f, t) -> named_struct('f', f, 't', t))"
    told = f"zip_with(ss, {bounds}, (s, w) -> if(({is_base}) or w.f > s.start or w.t < s.end, null, named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'word', s.word, 'left', s.left, 'right', s.right)))"
    by_kind = ", ".join(f"filter(ks, k -> k.kind = '{kind}')" for kind in ADDED_KINDS)
    return f"if(size({more}) = 0 or size({base}) = 0, {more}, {_let('ss', sortable, _let('ks', told, f'concat({by_kind})'))})"


def find(documents: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """Every row with ``spans`` in place of its text: valid base spans by kind, then those of added kinds that the classifier accepts."""
    found = cut(candidates(documents, text), "candidates")
    counts = pattern_counts(found)
    chance, _ = reliabilities(counts)
    weights = train(counts, chance)
    base = F.filter("candidates", lambda s: s["kind"].isin(*BASE_KINDS) & valid(s))
    more = F.filter("candidates", lambda s: s["kind"].isin(*ADDED_KINDS) & valid(s) & (chance_of(s, weights) >= least))
    some = F.size("candidates") > 0
    none = F.array().cast(f"array<{_SPAN}>")
    out = found.withColumns({"_base": F.when(some, base).otherwise(none), "_more": F.when(some, more).otherwise(none)})
    out = out.withColumn("spans", F.concat("_base", F.expr(_unclaimed("_base", "_more"))))
    return out.drop("candidates", "_base", "_more")


def joined(spans: str, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the kinds asked for, comma-joined in the order of ``spans``."""
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
